"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame expressions only.

1. Texts and items become lower-case runs of letters and digits, and those
   become shingles of ``width`` words; of an item of fewer words, of all its
   words. A text that shares no shingle with any item of some size has no
   window of that size with a similarity above 0; for that size it is set aside.
2. Over every other text slides a window of the item's size, a word at a time,
   and each stop gets a 64-bit SimHash of its shingles. Votes are packed: one
   sum adds up several bits of all shingles at once, in lanes that can't run over.
3. Items are indexed by 8-bit blocks of their own fingerprints: within
   ``radius`` of an item, some block lies within ``radius // 8`` bits of its
   own, so each item is listed under all such values and every fingerprint
   within the radius is found; each find is held against the full distance.
4. Candidates are decided by the exact similarity of the shingles themselves,
   weighted by how often each occurs: the sum of the lesser counts over the sum
   of the greater ones.

At similarity 0.8 two of fifteen bits differ: 9.7 of 64 on average with a
deviation of 2.9. The default radius leaves 4.6 deviations, a miss in a million.

Work goes by distinct text (its 64-bit hash; what is found is decided on the
text itself). Null and empty texts and items match nothing, nor does a text of
fewer words than an item's shingle. A text shorter than an item is one window.
Of windows that are as similar the first counts. Rows that repeat are each
found. Empty tables give no rows. Columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

BLOCKS, BLOCK_BITS = 8, 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value made once for each row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _starts(n: Column, width: Column) -> Column:
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _hashes(w: Column, most: int, width: Column | None = None) -> Column:
    """A 64-bit hash of each shingle of ``width`` words, ``most`` at most; nulls hash to nothing."""
    of = F.lit(most) if width is None else width

    def shingle(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + j) if width is None or j == 0 else F.when(F.lit(j) < of, F.get(w, i + j)) for j in range(most)])

    return F.transform(_starts(F.size(w), of), shingle)


def _shingles(w: Column, width: Column) -> Column:
    return F.transform(_starts(F.size(w), width), lambda i: F.array_join(F.slice(w, i + 1, width), " "))


def lane_bits(most: int) -> int:
    """How many bits each lane needs to hold the votes of ``most`` shingles, and a bit more, below the sign."""
    return next(q for q in (8, 16, 32) if most <= (1 << (q - 1)) - 2)


def lanes(hashes: Column, q: int) -> list[Column]:
    """The bits of each hash in q longs of 64 / q lanes; bit b is in long b % q."""
    ones = sum(1 << i for i in range(0, 64, q))

    def lane(k: int) -> Column:
        return F.transform(hashes, lambda x: F.call_function("shiftrightunsigned", x, F.lit(k)).bitwiseAND(F.lit(ones)))

    return [lane(k) for k in range(q)]


def majority(n: Column, q: int) -> Column:
    """What, added to votes, sets a lane's top bit but one if more than half of ``n`` voted."""
    ones = sum(1 << i for i in range(0, 64, q))
    return ((F.lit((1 << (q - 2)) - 1) - F.floor(n / 2)) * F.lit(ones)).cast("long")


def simhash(votes: list[Column], q: int, enough: Column) -> Column:
    """Bit b is set if more shingles have it set than not: ``votes`` is the sum of their lanes, ``enough`` the
    ``majority`` of their number."""
    top, out = sum(1 << i for i in range(q - 2, 64, q)), None
    for k, v in enumerate(votes):
        bits = F.call_function("shiftrightunsigned", (v + enough).bitwiseAND(F.lit(top)), F.lit(q - 2))
        bits = F.call_function("shiftleft", bits, F.lit(k))
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def total(lane: Column) -> Column:
    return F.aggregate(lane, F.lit(0).cast("long"), lambda acc, x: acc + x)


def doubled(sums: Column, step: int) -> Column:
    """Of each lane's sums over ``step`` shingles those over twice as many, from every place that has so many."""
    pair = lambda lane: F.transform(F.slice(lane, F.lit(1), F.greatest(F.size(lane) - step, F.lit(0))), lambda x, i: x + F.get(lane, i + step))
    return F.transform(sums, pair)


def _blocks(fingerprint: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.struct(b.alias("block"), F.call_function("shiftrightunsigned", fingerprint, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")))


def _masks(bits: int) -> list[int]:
    """All block values with at most so many bits set."""
    return [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(BLOCK_BITS), n)]


def similarity(a: Column, b: Column) -> Column:
    """Weighted by count: two arrays of shingles. If one has no repeats, all it shares counts once."""
    times = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, s: acc + F.least(times(a, s), times(b, s)))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def most_similar(a: Column, b: Column) -> Column:
    """What the similarity can't exceed: as if all repeats of a shared shingle were shared."""
    both = F.size(F.array_intersect(a, b))
    shared = F.least(F.size(a) - F.size(F.array_distinct(a)) + both, F.size(b) - F.size(F.array_distinct(b)) + both)
    return shared / (F.size(a) + F.size(b) - shared)


def windows(texts: DataFrame, q: int, width: int, most: int) -> DataFrame:
    """``texts(text_key, w, n_words)`` -> text_key, n_words, window_start and the print of every window of so
    many words, of ``most`` shingles at the most. Sums over 1, 2, 4 … shingles are made once for a text; a
    window's votes are those of the powers of two that its size is made of."""
    gram = F.least(F.col("n_words"), F.lit(width))
    own = texts.where(F.size("w") >= gram).select("text_key", "n_words", F.size("w").alias("size"), _hashes(F.col("w"), width, gram).alias("h"))
    held = F.least("size", "n_words") - gram + 1
    own = own.select("text_key", "n_words", held.alias("held"), majority(held, q).alias("enough"), F.greatest(F.col("size") - F.col("n_words"), F.lit(0)).alias("last"), F.array(*lanes(F.col("h"), q)).alias("s0"))
    levels = most.bit_length()
    for j in range(1, levels):
        own = own.withColumn(f"s{j}", doubled(F.col(f"s{j - 1}"), 1 << (j - 1)))
    part = lambda j: F.when(F.col("held").bitwiseAND(F.lit(1 << j)) != 0, F.struct(F.col("held").bitwiseAND(F.lit((1 << j) - 1)).alias("at"), F.col(f"s{j}").alias("sums")))
    parts = F.filter(F.array(*[part(j) for j in range(levels)]), lambda x: x.isNotNull())
    own = own.select("text_key", "n_words", "enough", "last", parts.alias("parts"))

    def at(i: Column) -> Column:
        votes = [F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + F.get(F.get(p["sums"], k), i + p["at"])) for k in range(q)]  # noqa: B023
        return F.struct(i.alias("window_start"), simhash(votes, q, F.col("enough")).alias("print"))

    each = F.transform(F.sequence(F.lit(0), F.col("last")), at)
    return own.select("text_key", "n_words", F.explode_outer(each).alias("x")).select("text_key", "n_words", "x.window_start", "x.print")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 23, broadcast_rows: int = 500_000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs(text, ...)`` and ``benchmark(item_id, text)`` -> text_key, item_id, similarity, window_start,
    window_words: for each distinct text and item the best window that reaches the threshold."""
    fits = lambda df, rows: F.broadcast(df) if rows <= broadcast_rows else df
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    gram = F.least(F.size("w"), F.lit(width))
    items = written(items.select("item_id", "w", F.size("w").alias("n_words"), gram.alias("gram"), _hashes(F.col("w"), width, gram).alias("h")), "items")
    per_item = BLOCKS * len(_masks(radius // BLOCKS))
    of = items.agg(F.count("*"), F.sum(F.size("h")), F.max(F.size("h")), F.sum(F.octet_length(F.array_join("w", " "))), F.collect_set("gram")).first()
    n_items, n_seeds, most, item_bytes, grams = of[0], of[1] or 0, of[2] or 1, of[3] or 0, sorted(of[4])
    q = lane_bits(most)

    # the sizes that a text can have a window of: those of items that it shares a shingle with
    seeds = items.select("n_words", F.explode("h").alias("shingle")).distinct()
    texts = docs.select("text").where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    of_text = F.concat(*[_hashes(F.col("w"), g) for g in grams]) if grams else F.array().cast("array<bigint>")
    sizes = texts.select("text_key", F.explode(of_text).alias("shingle")).join(fits(seeds, n_seeds), "shingle")
    sizes = written(sizes.select("text_key", "n_words").distinct(), "sizes")
    held = texts.join(fits(sizes, sizes.count()), "text_key").select("text_key", "n_words", "w").dropDuplicates(["text_key", "n_words"])
    held = written(held, "texts")

    # the index: items of the window's size under every block value near their own
    near = F.explode(F.array(*[F.lit(m) for m in _masks(radius // BLOCKS)]))
    own = items.select("item_id", "n_words", F.size("h").alias("n"), F.array(*lanes(F.col("h"), q)).alias("lanes"))
    listed = own.select("item_id", "n_words", simhash([total(F.get("lanes", k)) for k in range(q)], q, majority(F.col("n"), q)).alias("item_print")).distinct()
    listed = listed.select("item_id", "n_words", "item_print", F.explode(_blocks(F.col("item_print"))).alias("b"))
    listed = listed.select("item_id", "n_words", "item_print", "b.block", "b.value", near.alias("mask"))
    index = listed.select("item_id", "n_words", "item_print", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    prints = windows(held, q, width, most)
    keyed = prints.select("text_key", "n_words", "window_start", "print", F.explode(_blocks(F.col("print"))).alias("b")).select("text_key", "n_words", "window_start", "print", "b.block", "b.value")
    found = keyed.join(fits(index, n_items * per_item), ["n_words", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    found = written(found.select("text_key", "n_words", "window_start", "item_id").distinct(), "candidates")

    # exact
    of_item = items.select("item_id", F.col("w").alias("item"), "gram", F.col("h").alias("item_hashes"))
    pairs = found.join(held, ["text_key", "n_words"]).join(F.broadcast(of_item) if item_bytes <= broadcast_bytes else of_item, "item_id")
    own = F.slice("w", F.col("window_start") + 1, F.col("n_words"))
    may = let(own, lambda w: let(_hashes(w, width, F.col("gram")), lambda h: most_similar(h, F.col("item_hashes"))))
    pairs = pairs.where(may >= threshold - 1e-9).withColumn("item", _shingles(F.col("item"), F.col("gram")))
    exact = let(own, lambda w: let(_shingles(w, F.col("gram")), lambda x: similarity(x, F.col("item"))))
    pairs = pairs.select("text_key", "item_id", exact.alias("similarity"), "window_start", F.col("n_words").alias("window_words")).where(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("similarity", "window_start", "window_words"), F.struct("similarity", -F.col("window_start"))).alias("x")
    return pairs.groupBy("text_key", "item_id").agg(best).select("text_key", "item_id", "x.similarity", "x.window_start", "x.window_words")


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, item_id, similarity, window_start, window_words for contaminated rows."""
    found = find_leaks(docs, benchmark, **how)
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key")).join(found, "text_key").drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without those whose text holds a benchmark item."""
    key = unused("text_key", docs)
    found = written(find_leaks(docs, benchmark, **how).select(F.col("text_key").alias(key)).distinct(), "leaks")
    few = found.count() <= 500_000
    keyed = docs.withColumn(key, F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    return keyed.join(F.broadcast(found) if few else found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
