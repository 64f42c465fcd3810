"""Documents that arrive as a stream: whole ones, or in chunks of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..config import ParserConfig
from ..sources.parse import parse


def parse_stream(docs: DataFrame, text: str = "xml", doc_id: str = "doc_id", config: ParserConfig | None = None) -> DataFrame:
    """Whole documents in micro-batches: parsing one needs no state, so this is the batch operator."""
    return parse(docs, text, doc_id, config)


def assembled(chunks: DataFrame) -> DataFrame:
    """``chunks(doc_id string, chunk_no long, data binary, is_last boolean)`` -> (doc_id, xml) once all of a
    document's chunks are there, in whatever order they come.

    State by document holds the chunks so far; it goes when the document is whole. Chunks are joined before
    anything is parsed, so no event is cut where a chunk ends.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, datas, last = state.get if state.exists else ([], [], -1)
        held = dict(zip(numbers, datas, strict=True))
        for f in frames:
            for no, data, is_last in zip(f["chunk_no"], f["data"], f["is_last"], strict=True):
                held[int(no)] = bytes(data)
                last = int(no) if is_last else last
        if last >= 0 and len(held) == last + 1:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "xml": [b"".join(held[i] for i in range(last + 1))]})
        else:
            state.update((list(held), list(held.values()), last))

    return chunks.groupBy("doc_id").applyInPandasWithState(step, "doc_id string, xml binary", "numbers array<long>, datas array<binary>, last long", "append", GroupStateTimeout.NoTimeout)
