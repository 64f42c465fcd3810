"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token's bytes form a doubly linked list. A heap holds its adjacent
pairs by (rank, place); the pair of lowest rank, leftmost first, is popped and
merged, and the pairs at both sides of the merged symbol enter the heap. A
popped entry counts only if its two symbols are still what they were. The count
is the initial symbols less the merges; no identifiers are made.

A file with settings that this way of counting doesn't follow (another split or
normalizer, added tokens that strip or want whole words, dropout, affixes) is
refused with a ValueError. Null text counts as empty: zero bytes and tokens. An
empty table gives an empty result; very long texts are counted whole, in
slices. Ties of rank go to the
leftmost pair. Rows that repeat are counted as often as they occur.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, slices

#: The published split pattern of this tokenizer family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of pre-tokens and whole texts by the merges in a ``tokenizers`` JSON file."""

    def __init__(self, path: str, keep: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._accept(spec)
        vocab = spec["model"]["vocab"]
        self.byte_id = [vocab[s] for s in byte_symbols()]
        # (left, right) as one integer -> rank; and by rank the two symbols and the merged one
        self.rank: dict[int, int] = {}
        self.rule: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[x] << 32 | vocab[y]] = rank
            self.rule.append((vocab[x], vocab[y], vocab[x + y]))
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.tokens = regex.compile(PATTERN).findall
        self.single = re.compile(r"\s(?= )|(?<= )\s|\s\Z|\A\s").search  # spaces that don't each open a word
        self.safe_cut = re.compile(r"(?<=\S) (?=\S)")
        self.keep, self.chunks, self.words = keep, {}, {}

    @staticmethod
    def _accept(spec: dict) -> None:
        """Refuse a file that asks for more than merges of pre-tokens."""
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        other = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        other += [k for k in ("single_word", "lstrip", "rstrip") if any(x.get(k) for x in spec["added_tokens"])]
        if spec.get("normalizer"):
            other.append("normalizer")
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            other.append("pre_tokenizer")
        if model.get("type") != "BPE":
            other.append("model")
        if other:
            raise ValueError(f"token counts don't follow these settings of the tokenizer file: {', '.join(other)}")

    def pretoken(self, token: str) -> int:
        """Tokens of one pre-token. Heap entries are rank and place in one integer."""
        sym = [self.byte_id[b] for b in token.encode("utf-8")]
        n, rank, rule = len(sym), self.rank.get, self.rule
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(sym[i] << 32 | sym[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        count, pop, push = n, heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            a, b, new = rule[top >> 32]
            if sym[i] != a or (j := right[i]) >= n or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            count -= 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank(new << 32 | sym[k])) is not None:
                    push(heap, r << 32 | i)
            h = left[i]
            if h >= 0 and (r := rank(sym[h] << 32 | new)) is not None:
                push(heap, r << 32 | h)
        return count

    def _word(self, token: str) -> int:
        words = self.words
        if (n := words.get(token)) is None:
            n = self.pretoken(token)
            if len(token) <= 64:
                if len(words) >= self.keep:
                    words.clear()
                words[token] = n
        return n

    def _chunk(self, chunk: str, space: bool = False) -> int:
        """Tokens of what stands between two such spaces; ``space``: with the one before it."""
        core = chunk.rstrip(".,;:!?*#$%&|-)")
        if space and core.isalpha():  # letters, then perhaps signs: two pre-tokens
            n = self._word(" " + core)
            return n if len(core) == len(chunk) else n + self._word(chunk[len(core) :])
        return sum(map(self._word, self.tokens(" " + chunk if space else chunk)))

    def _plain(self, text: str) -> int:
        """A text without added tokens. A single space between two other characters always opens a
        pre-token, so what lies between such spaces is counted apart and remembered."""
        if not text:
            return 0
        chunks, total = self.chunks, 0
        if self.single(text) is None:
            first, *rest = text.split(" ")
        else:
            first, *rest = self.safe_cut.split(text)
        total = self._chunk(first)
        for c in rest:
            if (n := chunks.get(c)) is None:
                n = self._chunk(c, True)
                if len(c) <= 64:
                    if len(chunks) >= self.keep:
                        chunks.clear()
                    chunks[c] = n
            total += n
        return total

    def __call__(self, text: str) -> int:
        if self.split_added is None or self.split_added.search(text) is None:
            return self._plain(text)
        parts = self.split_added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def merge_counter(path: str) -> MergeCounter:
    """One counter for each file and worker process, which keeps what it has learnt from task to task."""
    return kept(("tokens", path), lambda: MergeCounter(path))


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, counter: Callable[[], Callable[[str], int]], limit: int = 1024) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_bytes, n_tokens and whether these exceed ``limit``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = [count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
