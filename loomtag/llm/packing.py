"""Best-fit-decreasing packing of token sequences into fixed windows.

A document's ids are cut into full windows first; what is left over is placed,
longest first, into the open window with the least room that still holds it. A
segment tree over remaining capacities 0..window answers that query: each leaf
holds the open windows with exactly that much room, each inner node the number
below it, so finding the tightest window is one descent.

Packing runs in groups of consecutive documents of one input partition, each
bounded by ``group_docs`` and ``group_tokens``; no shuffle, and a lost
executor repeats only its partition.

Null text counts as empty: a document then holds only the end id. Null
``doc_id`` is packed like any other and stays null. Ties between equal lengths
go in input order. Rows that repeat are packed as often as they occur.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import kept, released, slices

#: Signs that end words often; none of them is a letter, a digit or an apostrophe.
_SIGNS = ".,;:!?*#$%&|-)"


class CapacityTree:
    """Open windows by remaining capacity, over the leaves 0..window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window_id: int) -> None:
        self.open[room].append(window_id)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room >= need that an open window has, or -1."""
        count, i = self.count, need + self.size
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, room: int) -> int:
        i = room + self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """For pieces of 1..window tokens: each piece's window, its offset there, and the tokens of each window."""
    where, offset, filled = [0] * len(lengths), [0] * len(lengths), []
    tree = CapacityTree(window)
    for k in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[k]
        room = tree.tightest(n)
        if room < 0:
            w, room = len(filled), window
            filled.append(0)
        else:
            w = tree.take(room)
        where[k], offset[k] = w, filled[w]
        filled[w] += n
        if room > n:
            tree.add(room - n, w)
    return where, offset, filled


class WordEncoder:
    """Ids of whole texts as little-endian bytes, by the ``tokenizers`` file at ``path``.

    For a tokenizer that drops white space and never merges across it, ids of a
    text are those of its space-separated words in turn. Arrow splits the texts
    and finds their distinct words; letters alone and signs alone come from the
    library once and are kept, in two generations of ``keep`` parts; Arrow puts
    the ids back in order. Texts with added tokens, or with separators that
    Arrow takes for white space and the library doesn't, go to the library whole.
    """

    def __init__(self, path: str, keep: int = 350_000):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]
        self.whole = re.compile("|".join([*map(re.escape, self.added), "[\x1c-\x1f]"])).search
        self.keep, self.part, self.older = keep, {}, {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, names: list[str]) -> None:
        """Have the library encode pre-tokens, many to a text."""
        for i in range(0, len(names), 2048):
            group = names[i : i + 2048]
            x = self.library.encode(" ".join(group), add_special_tokens=False)
            at = np.array(x.word_ids, np.int64)
            if len(at) and at[-1] + 1 == len(group):  # one pre-token each
                ids = np.array(x.ids, "<u4").tobytes()
                cuts = (4 * np.searchsorted(at, np.arange(len(group) + 1))).tolist()
                self.part.update(zip(group, [ids[s:e] for s, e in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:
                self.part.update(zip(group, self._encode(group), strict=True))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Letters with signs behind them are two of the library's pre-tokens;
        all else goes in word by word."""
        if len(self.part) > self.keep:
            self.part, self.older = {}, self.part
        part, older, new, halves = self.part, self.older, [], []
        for w in words:
            core, tail = w, ""
            if not w.isalpha():
                core = w.rstrip(_SIGNS)
                if core.isalpha():
                    tail = w[len(core) :]
                    if tail not in part:
                        part[tail] = None
                        new.append(tail)
                else:
                    core = w
            if core not in part:
                part[core] = older.get(core)
                if part[core] is None:
                    new.append(core)
            halves.append((core, tail))
        plain = [x for x in new if x.isalpha() or not x.strip(_SIGNS)]
        self._learn(plain)
        odd = [x for x in new if not (x.isalpha() or not x.strip(_SIGNS))]
        for i in range(0, len(odd), 2048):
            part.update(zip(odd[i : i + 2048], self._encode(odd[i : i + 2048]), strict=True))
        out = [part[core] + part[tail] if tail else part[core] for core, tail in halves]
        for x in new:
            if len(x) > 64:  # what is kept is bounded in bytes too
                del part[x]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = {k for k, t in enumerate(texts) if self.whole(t)}
        split = pc.utf8_split_whitespace(pa.array(["" if k in whole else t for k, t in enumerate(texts)], pa.string()))
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        ids = pa.array(self._words(words), pa.binary()).take(flat.indices)
        # splitting leaves an empty word at the ends of a text and for an empty one; it has no ids
        data = memoryview(ids.buffers()[2] or b"")
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1][split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        return [self._encode([t])[0] if k in whole else bytes(data[s:e]) for k, (t, s, e) in enumerate(zip(texts, ends, ends[1:], strict=False))]


def word_encoder(path: str, keep: int = 350_000) -> WordEncoder:
    """One encoder for each file and worker process, which keeps what it has learnt from task to task."""
    return kept(("words", path, keep), lambda: WordEncoder(path, keep))


def _emit(first: int, docs: list, ids: list[bytes], window: int, with_ids: bool) -> tuple[pa.RecordBatch, int]:
    """The pieces of a group of documents; windows are numbered from ``first``."""
    cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    pieces, ends = [], []
    for d, b in zip(docs, ids, strict=True):
        n = len(b) // 4
        for s in range(0, n, window):
            e = min(n, s + window)
            p = b[4 * s : 4 * e]
            cols["doc_id"].append(d)
            cols["start"].append(s)
            cols["length"].append(e - s)
            cols["ids_crc32"].append(zlib.crc32(p))
            cols["doc_tokens"].append(n)
            pieces.append(p)
    where, cols["offset"], filled = best_fit_decreasing(cols["length"], window)
    cols["sequence_id"] = [first + w for w in where]
    ends = [filled[w] for w in where]
    arrays = [pa.array(v, pa.int64()) for v in cols.values()]
    # a sequence whose tokens are a power of two stays so; any other is padded to the window
    padded = [n if n & (n - 1) == 0 else window for n in ends]
    arrays += [pa.array(ends, pa.int64()), pa.array(padded, pa.int64()), pa.array(pieces if with_ids else [None] * len(ends), pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, [*cols, "sequence_tokens", "padded_tokens", "ids"]), len(filled)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long, ids binary"


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list[str]], list[bytes]]],
    window: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
    group_docs: int = 16384,
    group_tokens: int = 8_000_000,
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """Pack ``docs(doc_id, text)``: a row for each piece, as in ``SCHEMA``.

    ``encoder()`` is called once in each task and gives a function from texts
    to little-endian unsigned 32-bit ids. ``sequence_id`` is the partition's
    number in the high bits and the window's in the low 32. ``slice_bytes`` of
    texts are encoded at once; smaller ones, and smaller groups, take less memory
    of a worker and more time.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        base, made, docs_, ids, held = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                new = [b + end for b in encode([t or "" for t in part.column(1).to_pylist()])]
                docs_ += part.column(0).to_pylist()
                ids += new
                held += sum(map(len, new)) // 4
                if len(docs_) >= group_docs or held >= group_tokens:
                    out, n = _emit(base + made, docs_, ids, window, with_ids)
                    yield out
                    made, docs_, ids, held = made + n, [], [], 0
        if docs_:
            yield _emit(base + made, docs_, ids, window, with_ids)[0]

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), SCHEMA)
