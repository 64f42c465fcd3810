"""Exact repeated byte strings by a sparse, depth-bounded suffix array with bucket-pointer refinement.

A byte goes if it lies in a string of ``depth`` bytes that also starts earlier:
in a document of smaller id, or earlier in the same one. Suffixes need to be
told apart to that depth only, and only those that can repeat need sorting.

1. *Initial buckets.* Every ``depth``-byte window has an anchor: of its q-grams
   (q = ``gram``) the one whose hash is least, the leftmost of equals. Equal
   windows have equal anchors at equal places. A run of windows with one anchor
   is a *unit*, and its anchor's q-gram is its bucket. A bucket with one unit
   is done: its windows repeat nowhere.
2. *Equal units.* Units with equal bytes are one bucket at full depth already:
   all but the earliest repeat as they stand.
3. *Refinement.* Where distinct units share a bucket, their bytes meet. The
   pointer of a suffix starts as its q-gram's bucket; the pointer to depth 2q
   is made from its own and that of the suffix q later, those pointers are
   used again for the suffixes 2q later, and so on to ``depth``. Each round
   sorts only suffixes whose bucket still has others in it. Of a final bucket
   the first by document and place stays, and the others repeat.

Pointers are hashes of what they stand for instead of ranks, so that tasks agree
on them without a global sort; windows that share the last one are told apart by
their bytes, or by 128 bits where the bytes do not meet. What is dealt is
combined first: of what is equal within a few megabytes of text only the earliest
goes on, and the others, known to repeat, never meet. So a passage that a third
of all documents hold makes a row for each such part of the text. Buckets are
dealt to ranges of the hash, whose number follows the bytes of all texts. A
bucket of ``hot`` distinct units or more would still fill a task: it is refined
where its units stand, by the same pointers, and its windows are dealt by their
last ones.

Null text counts as empty. Texts shorter than ``depth`` stay as they are, very
long ones are read whole. A null doc_id takes no part: its text stays whole and
lets others stay. Rows that repeat a document give its result each. doc_id is to
name one text only. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, released, shuffle_partitions, slices, written

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram of ``data`` (bytes), by doubling."""
    acc, have = None, 0
    h, width, p = _mixed(data.astype(np.uint64) + np.uint64(1)), 1, _P
    n = q
    with np.errstate(over="ignore"):
        while n:
            if n & 1:
                # acc covers ``have`` bytes; put h after it
                acc = h if acc is None else acc[: len(h) - have] * p + h[have : have + len(acc)][: len(h) - have]
                have += width
            n >>= 1
            if n:
                h = h[:-width] * p + h[width:] if len(h) > width else h[:0]
                p, width = p * p, 2 * width
        return _mixed(acc)


def least_places(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of the least one, the leftmost of equals."""
    n = len(h) - w + 1
    best, at, width = h, np.arange(len(h), dtype=np.int64), 1
    while width * 2 <= w:
        right = best[width:] < best[:-width]
        at = np.where(right, at[width:], at[:-width])
        best, width = h[at], width * 2
    rest = w - width
    if rest:
        right = best[rest : rest + n] < best[:n]
        at = np.where(right, at[rest : rest + n], at[:n])
    return at[:n]


def units(data: np.ndarray, depth: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: the anchor's hash, the first window, the number of windows."""
    if len(data) < depth:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e
    h = gram_hashes(data, q)
    at = least_places(h, depth - q + 1)
    first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    return h[at[first]], first, np.diff(np.concatenate([first, [len(at)]]))


def _ranges(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit values each lies in."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _any_range(docs: np.ndarray, n: int) -> np.ndarray:
    """One of n ranges for all rows, by their first document."""
    return np.full(len(docs), _ranges(_mixed(docs[:1].view(np.uint64)), n)[0] if len(docs) else 0)


def _dealt(r: np.ndarray, columns: dict[str, np.ndarray], extra: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each range, with each column's values of that range as bytes."""
    if not len(r):
        return
    order = np.argsort(r, kind="stable")
    cut = np.concatenate([[0], np.nonzero(np.diff(r[order]))[0] + 1, [len(r)]])
    out: dict[str, list] = {"r": [], **{k: [] for k in columns}}
    if extra is not None:
        out["data"] = []
    for s, e in zip(cut, cut[1:], strict=False):
        k = order[s:e]
        out["r"].append(int(r[k[0]]))
        for name, v in columns.items():
            out[name].append(v[k].tobytes())
        if extra is not None:
            out["data"].append(b"".join([extra[i] for i in k]))
    yield pa.RecordBatch.from_arrays([pa.array(out.pop("r"), pa.int32()), *(pa.array(v, pa.binary()) for v in out.values())], ["r", *out])


def _joined(t: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(t[name].to_pylist()), kind)


def _arrays(texts: pa.Array) -> Iterator[np.ndarray]:
    for x in texts:
        b = x.as_buffer()
        yield np.frombuffer(b, np.uint8) if b is not None else np.empty(0, np.uint8)


def _later(ids: np.ndarray, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For rows sorted by (id, document, place): which aren't at the first place of their id."""
    start = np.concatenate([[True], ids[1:] != ids[:-1]])
    first = np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))
    return (docs != docs[first]) | (at != at[first])


def _chunks(keys: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of sorted keys that keep equal ones together and reach ``most`` in size at the earliest end."""
    last = np.nonzero(np.concatenate([keys[1:] != keys[:-1], [True]]))[0] + 1
    upto, begin, done = np.cumsum(sizes), 0, 0
    for e in last.tolist():
        if upto[e - 1] - done >= most or e == len(keys):
            yield slice(begin, e)
            begin, done = e, upto[e - 1]


def deepen(pointer: np.ndarray, have: int, depth: int) -> tuple[np.ndarray, int]:
    """Pointers to twice their depth, or to ``depth``, from each one and that of the suffix behind what it covers."""
    step = min(have, depth - have)
    return _mixed(pointer[:-step] * _P + pointer[step:]), have + step


def last_pointers(data: np.ndarray, depth: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Pointers of every window at full depth, 128 bits: a second chain starts from bytes shifted by one."""
    out = []
    for x in (data, data + np.uint8(1)):
        pointer, have = gram_hashes(x, q), q
        while have < depth:
            pointer, have = deepen(pointer, have, depth)
        out.append(pointer)
    return out[0], out[1]


def refined(data: np.ndarray, windows: np.ndarray, docs: np.ndarray, at: np.ndarray, depth: int, q: int) -> np.ndarray:
    """Of the windows that start at ``windows`` of ``data`` and stand at (docs, at): whether each repeats
    one that stands earlier."""
    out = np.zeros(len(windows), bool)
    pointer, have, alive = gram_hashes(data, q), q, np.arange(len(windows))
    while True:
        mine = pointer[windows[alive]]
        order = np.argsort(mine, kind="stable")
        same = mine[order][1:] == mine[order][:-1]
        alive = alive[order][np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if have == depth or not len(alive):
            break
        pointer, have = deepen(pointer, have, depth)
    if len(alive):
        mine = pointer[windows[alive]]
        order = np.lexsort((at[alive], docs[alive], mine))
        k, mine = alive[order], mine[order]
        start = np.concatenate([[True], mine[1:] != mine[:-1]])
        first = k[np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))]
        behind = np.arange(depth)
        equal = np.concatenate([(data[windows[k[i : i + 8192], None] + behind] == data[windows[first[i : i + 8192], None] + behind]).all(1) for i in range(0, len(k), 8192)])
        out[k] = equal & _later(mine, docs[k], at[k])
    return out


def _combined(columns: tuple[np.ndarray, ...], keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (keys…, document, place) in order: the order, whether a row is the first of its keys, and
    whether it stands later than that."""
    *k, docs, at = columns
    order = np.lexsort((at, docs, *k[:keys][::-1]))
    new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in k[:keys]], axis=0)]) if len(order) else np.empty(0, bool)
    return order, new, _later(np.cumsum(new), docs[order], at[order]) if len(order) else new


def _runs(d: np.ndarray, at: np.ndarray) -> pa.Table:
    """Windows that repeat, as runs of neighbours: doc_id, at, size."""
    order = np.lexsort((at, d))
    d, at = d[order], at[order]
    cut = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)]))[0] if len(d) else np.empty(0, np.int64)
    return pa.table({"doc_id": d[cut], "at": at[cut], "size": np.diff(np.concatenate([cut, [len(d)]])).astype(np.int32)})


def remove_repeats(docs: DataFrame, depth: int = 100, gram: int = 32, hot: int = 20_000, range_bytes: int = 16 << 20, with_text: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept:
    the bytes that stay."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    long_ = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= depth))
    size = long_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(shuffle_partitions(docs.sparkSession), size // range_bytes)
    n = 4 * tasks
    in_ranges = lambda df: df.repartition(tasks, "r").groupBy("r")

    def initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size = [], [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            h, d = np.concatenate(held), np.concatenate(names)
            order, new, _ = _combined((h, d, d), 1)
            h, d = h[order], d[order]
            count = np.diff(np.concatenate([np.nonzero(new)[0], [len(h)]])).astype(np.int32)
            yield from _dealt(_ranges(h[new], n), {"hash": h[new], "doc": d[new], "count": count})
            # units that share a bucket here are known to: all in one row, for any range
            more = np.repeat(count, count) > 1
            more &= new | np.concatenate([[True], d[1:] != d[:-1]])
            yield from _dealt(_any_range(d[more], n) + n, {"hash": h[more], "doc": d[more], "count": np.zeros(int(more.sum()), np.int32)})

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for d, x in zip(ids, _arrays(batch.column(1)), strict=True):
                h = units(x, depth, gram)[0]
                held.append(h)
                names.append(np.full(len(h), d, np.int64))
                size += len(h)
                if size > 200_000:
                    yield from dealt()
                    held, names, size = [], [], 0
        if held:
            yield from dealt()

    def repeated(t: pa.Table) -> pa.Table:
        h, d, count = _joined(t, "hash", "<u8"), _joined(t, "doc", "<i8"), _joined(t, "count", "<i4")
        if t["r"][0].as_py() < n:
            order = np.argsort(h, kind="stable")
            h, d, count = h[order], d[order], count[order]
            start = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            total = np.repeat(np.add.reduceat(count.astype(np.int64), start), np.diff(np.concatenate([start, [len(h)]])))
            keep = (total > 1) & (count == 1)
            h, d = h[keep], d[keep]
        return pa.table({"doc_id": d, "hash": h.view(np.int64)})

    first = in_ranges(long_.mapInArrow(lambda b: released(initial(b)), "r int, hash binary, doc binary, count binary")).applyInArrow(repeated, "doc_id long, hash long")
    lists = first.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 1, 4 << 20)):
            parts = []
            for d, x, some in zip(batch.column(0).to_pylist(), _arrays(batch.column(1)), batch.column(2), strict=True):
                h, at, size = units(x, depth, gram)
                k = np.nonzero(np.isin(h, np.unique(some.values.to_numpy().view(np.uint64))))[0]
                raw, ends = x.tobytes(), (at + size - 1 + depth)
                key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(at[k].tolist(), ends[k].tolist(), strict=True)]), "<u8").reshape(-1, 2)
                parts.append((key[:, 0], key[:, 1], np.full(len(k), d, np.int64), at[k].astype(np.int64), size[k].astype(np.int32), h[k]))
            k1, k2, d, at, size, h = (np.concatenate(c) for c in zip(*parts, strict=True))
            order, new, again = _combined((k1, k2, d, at), 2)
            k1, k2, d, at, size, h = (x[order] for x in (k1, k2, d, at, size, h))
            kind = np.where(again, 0, 1).astype(np.int32)
            r = np.where(again, _any_range(d, n) + n, _ranges(k1, n))
            once = new | again  # a document that is there twice
            yield from _dealt(r[once], {k: v[once] for k, v in {"hash": h, "k1": k1, "k2": k2, "doc": d, "at": at, "size": size, "kind": kind}.items()})

    def equal(t: pa.Table) -> pa.Table:
        h, k1, k2, d, at, size, kind = (_joined(t, c, x) for c, x in (("hash", "<u8"), ("k1", "<u8"), ("k2", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("size", "<i4"), ("kind", "<i4")))
        if t["r"][0].as_py() < n:
            order, new, again = _combined((k1, k2, d, at), 2)
            h, d, at, size = (x[order] for x in (h, d, at, size))
            keep = new | again
            h, d, at, size, kind = h[keep], d[keep], at[keep], size[keep], np.where(again, 0, 1)[keep].astype(np.int32)
        release()
        return pa.table({"doc_id": d, "at": at, "size": size, "hash": h.view(np.int64), "kind": kind})

    dealt = long_.join(lists, "doc_id").select("doc_id", "text", "hashes")
    dealt = dealt.mapInArrow(lambda b: released(candidates(b)), "r int, hash binary, k1 binary, k2 binary, doc binary, at binary, size binary, kind binary")
    second = written(in_ranges(dealt).applyInArrow(equal, "doc_id long, at long, size int, hash long, kind int"), "repeats")
    distinct = second.where("kind = 1").drop("kind")
    shared = distinct.groupBy("hash").agg(F.count("*").alias("units")).where("units > 1").select("hash", (F.col("units") >= hot).alias("hot"))
    meets = distinct.join(shared, "hash").groupBy("doc_id").agg(F.collect_list(F.struct("at", "size", "hash", "hot")).alias("found"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 1, 4 << 20)):
            own: dict[str, list] = {k: [] for k in ("h", "d", "at", "size", "data")}
            far: list[tuple[np.ndarray, ...]] = []
            for d, x, found in zip(batch.column(0).to_pylist(), _arrays(batch.column(1)), batch.column(2), strict=True):
                raw = x.tobytes()
                f = {k: found.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "size", "hash", "hot")}
                for at, size, h, is_hot in zip(*(f[k].tolist() for k in ("at", "size", "hash", "hot")), strict=True):
                    data = raw[at : at + size - 1 + depth]
                    if not is_hot:
                        for k, v in zip(own, (h, d, at, size, data), strict=True):
                            own[k].append(v)
                    else:
                        p1, p2 = last_pointers(np.frombuffer(data, np.uint8), depth, gram)
                        far.append((p1, p2, np.full(len(p1), d, np.int64), np.arange(at, at + len(p1), dtype=np.int64)))
            if own["h"]:
                h = np.array(own["h"], np.int64).view(np.uint64)
                k2 = np.zeros(len(h), np.uint64)
                yield from _dealt(_ranges(h, n), {"hash": h, "k2": k2, "doc": np.array(own["d"], np.int64), "at": np.array(own["at"], np.int64), "size": np.array(own["size"], np.int32)}, own["data"])
            if far:
                p1, p2, d, at = (np.concatenate(c) for c in zip(*far, strict=True))
                order, new, again = _combined((p1, p2, d, at), 2)
                p1, p2, d, at = (x[order] for x in (p1, p2, d, at))
                r = np.where(again, _any_range(d, n) + 2 * n, _ranges(p1, n) + n)
                once = new | again
                ones = np.ones(len(p1), np.int32)
                yield from _dealt(r[once], {k: v[once] for k, v in {"hash": p1, "k2": p2, "doc": d, "at": at, "size": ones}.items()}, [b""] * int(once.sum()))

    def refine(t: pa.Table) -> pa.Table:
        h, k2, d, at, size = (_joined(t, c, x) for c, x in (("hash", "<u8"), ("k2", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("size", "<i4")))
        r = t["r"][0].as_py()
        if r >= 2 * n:
            return _runs(d, at)
        if r >= n:
            order, _, again = _combined((h, k2, d, at), 2)
            return _runs(d[order][again], at[order][again])
        raw = b"".join(t["data"].to_pylist())
        order = np.argsort(h, kind="stable")
        end = np.cumsum(size + depth - 1)
        h, d, at, size, start, end = (x[order] for x in (h, d, at, size, end - (size + depth - 1), end))
        parts = []
        for k in _chunks(h, end - start, 1 << 20):  # whole buckets, about a megabyte of them at once
            data = np.frombuffer(b"".join([raw[s:e] for s, e in zip(start[k].tolist(), end[k].tolist(), strict=True)]), np.uint8)
            n_ = size[k]
            begin = np.cumsum(n_ + depth - 1) - (n_ + depth - 1)
            place = np.arange(n_.sum()) - np.repeat(np.cumsum(n_) - n_, n_)
            own, where = np.repeat(d[k], n_), np.repeat(at[k], n_) + place
            again = refined(data, np.repeat(begin, n_) + place, own, where, depth, gram)
            parts.append((own[again], where[again]))
        d, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        release()
        return _runs(d, at)

    near = long_.join(meets, "doc_id").select("doc_id", "text", "found").mapInArrow(lambda b: released(contexts(b)), "r int, hash binary, k2 binary, doc binary, at binary, size binary, data binary")
    third = in_ranges(near).applyInArrow(refine, "doc_id long, at long, size int")
    gone = second.where("kind = 0").select("doc_id", "at", "size").unionByName(third).groupBy("doc_id").agg(F.collect_list(F.struct("at", "size")).alias("gone"))

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 1, 4 << 20)):
            rows: list[list] = [[] for _ in names[1:]]
            for x, found in zip(_arrays(batch.column(1)), batch.column(2), strict=True):
                raw, spans = x.tobytes(), []
                if found.is_valid and len(found):
                    s = found.values.field("at").to_numpy()
                    e = s + found.values.field("size").to_numpy() - 1 + depth
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.concatenate([[True], s[1:] > e[:-1]])
                    spans = list(zip(s[new].tolist(), e[np.concatenate([new[1:], [True]])].tolist(), strict=True))
                kept = raw
                if spans:
                    ends = [0, *(e for _, e in spans)]
                    kept = b"".join([raw[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(raw)], strict=True)])
                for out, v in zip(rows, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    out.append(v)
            kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(rows, kinds_, strict=False))], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(lambda b: released(cut(b)), schema)
