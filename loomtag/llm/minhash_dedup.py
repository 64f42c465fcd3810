"""Near-duplicate documents by bottom-k sketches under one hash function.

1. Each document's shingle set is hashed once; documents with equal sets form
   a class, of which the one with the smallest id stands for all.
2. A class's sketch is the ``k`` smallest hashes. Inverted lists are kept by
   runs of consecutive retained values. If two sets reach the threshold t and
   their union has u members, at most (1-t)u of these are not shared, so they
   leave a run of shared consecutive members of a length that follows from u;
   a set emits the runs its possible unions call for, three values at most.
   For sets of up to k members no pair is missed; for larger ones a pair is
   missed if no run of three falls in the part of the union that the sketches
   hold (below 1e-9 at k = 64 and t >= 0.8).
3. Every member of a list is paired with the list's smallest id. The bottom-k
   of the union, taken from both sketches, estimates the similarity; pairs more
   than seven standard deviations short are left out, all others are decided on
   the full sets. What links joins *components*; whatever reaches the much lower
   estimate ``kin`` joins *families*: copies with so many changes that few link.
4. What step 3 did not pair is decided only across components. Families of
   several components are compared in blocks: a task holds two blocks of full
   sets, counts all their intersections at once and returns a spanning forest
   of the links. Lists that still span several families give their pairs across
   families, decided as in step 3, as long as they are short.
5. Of lists longer than ``long_list``, such as a widespread passage makes, the
   members are listed anew, and without any miss: by the prefixes of their full
   sets. In any one order of all values, two sets that reach t share a value among
   the first n - ceil(t n) + 1 of each. The order is by hash, but what two members
   of a long list, of different families, have in common comes last: it is what
   makes the list long. Lists of prefixes that are long even so are compared in
   blocks, as families are.
   So no link between components is lost, and neither a large group of near copies
   nor a widespread passage ever becomes rows for all its pairs.

A document without words links with nothing, nor does one without doc_id;
both are kept. Rows that repeat a doc_id share its component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, released, slices, written
from .shingles import shingler


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n (set size), set_key (128-bit hash of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = shingler(width)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [shingle(t) for t in part.column(1).to_pylist()]
                low = [s[:k].view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, low)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low) if low else [], pa.int64())),
                    ],
                    ["doc_id", "n", "set_key", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), "doc_id long, n long, set_key binary, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, shingles: the whole set as sorted 64-bit hashes in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = shingler(width)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([shingle(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), "doc_id long, shingles binary")


def shared_run(union: int, t: Fraction, most: int = 3) -> int:
    """The length of a run of shared consecutive members that any two sets with ``union`` members
    between them have at similarity >= t; 0 if only equal sets reach it."""
    apart = math.floor((1 - t) * union)
    return 0 if not apart else max(1, min(most, -(-(union - apart) // (apart + 1))))


def run_lengths(size: int, t: Fraction, most: int = 3) -> set[int]:
    """The run lengths that a set of ``size`` members must be listed under."""
    return {shared_run(u, t, most) for u in range(size, math.floor(size / t) + 1)} - {0} if size < 1000 else {most}


def _runs(sketch: Column, r: int) -> Column:
    def run(i: Column) -> Column:
        return F.xxhash64(F.lit(r), *[F.get(sketch, i + j) for j in range(r)])

    return F.transform(F.sequence(F.lit(0), F.size(sketch) - r), run)


def _lists(classes: DataFrame, t: Fraction, most: int = 3) -> DataFrame:
    """Postings (run, rep). Sizes from 1000 on call for runs of ``most`` only; smaller ones are looked up."""
    by_length: dict[int, list[int]] = {}
    for size in range(1, 1000):
        for r in run_lengths(size, t, most):
            by_length.setdefault(r, []).append(size)
    n, s, arrays = F.col("n"), F.col("sketch"), []
    for r, sizes in sorted(by_length.items()):
        called = n.isin(sizes)
        if r == most:  # all sizes from some one on, but for a few
            called = (n >= min(sizes)) & ~n.isin([-1, *({*range(min(sizes), 1000)} - {*sizes})])
        arrays.append(F.when(called & (F.size(s) >= r), _runs(s, r)).otherwise(F.array().cast("array<long>")))
    return classes.select(F.explode(F.concat(*arrays)).alias("run"), "rep")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, t: float, kin: float) -> DataFrame:
    """``pairs(a, b)`` that are ``possible``: sizes allow similarity t and the bottom-k of the union doesn't
    speak against it; or that are ``kin``: their estimate reaches that much lower mark."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("union", union)
    shared = F.size(F.array_intersect("union", F.array_intersect("sketch_a", "sketch_b")))
    both = both.select("a", "b", "n_a", "n_b", F.size("union").alias("size"), shared.alias("shared"))
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (t - 1e-9)
    margin = 7 * math.sqrt(t * (1 - t) / k)
    out = both.select("a", "b", (sizes & (F.col("shared") >= F.col("size") * (t - margin))).alias("possible"), (F.col("shared") >= F.col("size") * kin).alias("kin"))
    return out.where("possible OR kin")


def _linked(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Of ``pairs(a, b)`` those whose full sets reach the threshold."""
    full = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(full("a"), "a").join(full("b"), "b").select("a", "b", "set_a", "set_b")
    top, bottom = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                keep.append(shared > 0 and bottom * shared >= top * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def block_links(sets: list[np.ndarray], component: np.ndarray, t: Fraction, columns: int = 4096) -> np.ndarray:
    """For each set the first set of its connected part, by links between sets of different components."""
    n, size = len(sets), np.array([len(s) for s in sets])
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = count > 1
    name = np.cumsum(shared) - 1  # of shingles that several sets hold
    keep = shared[where]
    row, col = row[keep], name[where[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), np.float32)
    for c in range(0, int(shared.sum()), columns):
        s, e = np.searchsorted(col, [c, c + columns])
        x = np.zeros((n, columns), np.float32)
        x[row[s:e], col[s:e] - c] = 1
        both += x @ x.T
    inter = both.astype(np.int64)
    linked = (inter > 0) & (t.denominator * inter >= t.numerator * (size[:, None] + size[None, :] - inter)) & (component[:, None] != component[None, :])
    i, j = np.nonzero(np.triu(linked, 1))
    label = np.arange(n)
    while len(i) and (label[i] != label[j]).any():
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
    return label


def prefix(values: np.ndarray, hot: np.ndarray, t: Fraction) -> np.ndarray:
    """Of a set's sorted values those of which a set at similarity >= t shares one, if ``hot`` ones come last."""
    n = len(values)
    keep = n - math.ceil(t * n) + 1
    if len(hot):
        at = np.isin(values, hot, assume_unique=True)
        values = np.concatenate([values[~at], values[at]])
    return values[:keep]


def _prefixes(full: DataFrame, hot: np.ndarray, t: Fraction) -> DataFrame:
    """``full(rep, n, family, shingles)`` -> run, rep, n, family: a row for each value of each prefix."""
    shared = full.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 3, 4 << 20)):
            values = [prefix(np.frombuffer(x, np.uint64), shared.value, t).view(np.int64) for x in batch.column(3).to_pylist()]
            row = np.repeat(np.arange(len(values)), [len(v) for v in values])
            own = batch.select(range(3)).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), *own.columns], ["run", "rep", "n", "family"])

    return full.select("rep", "n", "family", "shingles").mapInArrow(run, "run long, rep long, n long, family long")


def _open(spread: DataFrame) -> DataFrame:
    """Of postings (run, rep, n, family) those in lists that span several families, with the lists' lengths."""
    lists = spread.groupBy("run").agg(F.min("family").alias("x"), F.max("family").alias("y"), F.count("*").alias("length")).where("x <> y")
    return spread.join(lists.select("run", "length"), "run")


def _widespread(long_: DataFrame, full: DataFrame, most: int) -> np.ndarray:
    """What the members of the first and the last family of each long list have in common, sorted; ``most`` values
    at the most, as they are broadcast (any order of values is right, so the others may stay in theirs)."""
    ends = long_.groupBy("run").agg(F.min(F.struct("family", "rep"))["rep"].alias("a"), F.max(F.struct("family", "rep"))["rep"].alias("b")).select("a", "b").distinct()
    side = lambda x: full.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = ends.join(side("a"), "a").join(side("b"), "b").select("set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).view(np.int64))], ["value"])

    found = both.mapInArrow(run, "value long").distinct().limit(most).collect()
    return np.sort(np.array([r["value"] for r in found], np.int64).view(np.uint64))


def _within_families(members: DataFrame, sets: DataFrame, t: Fraction, block_shingles: int, block_docs: int) -> DataFrame:
    """Links between components of one family: ``members(rep, n, component, family)`` -> (a, b)."""
    several = members.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum("n").alias("all"), F.count("*").alias("docs"))
    several = several.where("x <> y").select("family", F.ceil(F.greatest(F.col("all") / block_shingles, F.col("docs") / block_docs)).cast("int").alias("p"))
    own = members.join(several, "family").withColumn("own", F.pmod(F.xxhash64("rep"), "p").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).select("rep", "component", "family", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    dealt = dealt.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")

    def compare(g: pa.Table) -> pa.Table:
        sets_ = [np.frombuffer(x, np.uint64) for x in g["shingles"].to_pylist()]
        rep = g["rep"].to_numpy()
        label = block_links(sets_, g["component"].to_numpy(), t)
        k = np.nonzero(label != np.arange(len(rep)))[0]
        return pa.table({"a": rep[k], "b": rep[label[k]]})

    return dealt.groupBy("family", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: str = "0.8", k: int = 64, kin: float = 0.3, long_list: int = 48, hot_values: int = 1_000_000, broadcast_rows: int = 500_000, block_shingles: int = 250_000, block_docs: int = 512) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_shingles, component_id, kept, a row for each row."""
    t = Fraction(threshold)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_ = written(sketches(texts, width, k), "sketches")
    named = all_.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("x")).select("set_key", F.col("x.doc_id").alias("rep"), "x.n", "x.sketch")
    classes = written(classes, "classes")

    lists = _lists(classes, t)
    leads = lists.groupBy("run").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("run", "lead")
    shared = written(lists.join(leads, "run").select("run", "rep", "lead"), "lists")
    stars = shared.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    stars = written(_estimated(stars, classes, k, float(t), kin), "pairs")

    ids = shared.select(F.col("rep").alias("doc_id")).distinct()
    few = ids.count() <= broadcast_rows
    once = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = written(full_sets(once, width).dropDuplicates(["doc_id"]), "sets")

    links = written(_linked(stars.where("possible").select("a", "b"), sets, t), "linked")
    joined, families = components(links), components(stars.select("a", "b"))
    members = classes.select("rep", "n").join(ids.withColumnRenamed("doc_id", "rep"), "rep")
    members = members.join(joined.withColumnRenamed("id", "rep"), "rep", "left").join(families.select(F.col("id").alias("rep"), F.col("component").alias("family")), "rep", "left")
    members = written(members.select("rep", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("family", "rep").alias("family")), "members")
    inside = _within_families(members, sets, t, block_shingles, block_docs)

    own = members.select("rep", "n", "family")
    spread = written(_open(shared.select("run", "rep").join(own, "rep")), "open")
    long_ = own.join(spread.where(F.col("length") > long_list).select("rep").distinct(), "rep")
    full = written(long_.join(sets.withColumnRenamed("doc_id", "rep"), "rep"), "long")
    hot = _widespread(spread.where(F.col("length") > long_list), full, hot_values)
    again = written(_open(written(_prefixes(full, hot, t), "prefixes")), "open")
    short = spread.unionByName(again).where(F.col("length") <= long_list)
    side = lambda x: short.select("run", F.col("rep").alias(x), F.col("family").alias(f"f_{x}"), F.col("n").alias(f"n_{x}"))
    across = side("a").join(side("b"), "run").where((F.col("a") < F.col("b")) & (F.col("f_a") != F.col("f_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (float(t) - 1e-9)))
    across = _estimated(across.select("a", "b").distinct(), classes, k, float(t), kin).where("possible")
    across = _linked(across.select("a", "b"), sets, t)
    groups = again.where(F.col("length") > long_list).select("rep", "n", F.col("run").alias("family")).join(members.select("rep", "component"), "rep")
    inside = inside.unionByName(_within_families(groups, sets, t, block_shingles, block_docs))
    more = written(inside.unionByName(across), "linked")
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    reps = classes.select("set_key", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    out = all_.select("doc_id", "n", F.when(~alone, F.col("set_key")).alias("set_key")).join(reps, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
