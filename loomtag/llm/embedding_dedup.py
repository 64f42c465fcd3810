"""Near-duplicate vectors by PCA-ordered, tiled comparison.

An orthogonal basis from the second moments of all vectors is ordered by
falling variance, so that leading coordinates carry most of a cosine. Tiles of
two bands of vectors accumulate leading coordinates first; the rest of each
product is bounded by the product of the two suffix norms. Rows and columns of
which no pair's bound reaches the threshold leave the tile, and a tile without
any is done. Pairs that survive are decided on the original vectors in double
precision.

Every vector is dealt to one of ``p`` bands by its id, and each task holds two
bands of at most ``band_bytes``. All pairs are compared, so every vector goes to
p tasks: what is shuffled grows with the square of the vectors, over the size of
a band. A task gives link counts by vector and a
spanning forest of its links, never the pairs themselves, so a large group of
near copies costs no more rows than vectors.

Vectors that are null, zero or hold null or non-finite components link with
nothing, nor do vectors of different lengths link. Rows equal in vec_id and
vector count once; a null vec_id links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: Rounding that a rotated product may lose against the direct one, many times over.
_SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding)`` with ``dim``, without rows that link with nothing."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    some = F.exists(x, lambda v: v != 0)
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & some).dropDuplicates().withColumn("dim", F.size("embedding"))


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the PCA basis, columns by falling variance. Partitions send sums of
    products, a row for each coordinate."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                m = _matrix(batch.column(0).filter(pa.array(dims == d)), d)
                m = _unit(m)[0]
                total[d] = total.get(d, 0) + m.T @ m
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "row": pa.array(list(m), pa.list_(pa.float64()))})

    def summed(t: pa.Table) -> pa.Table:
        row = _matrix(t["row"], t["dim"][0].as_py()).sum(0)
        return pa.table({"dim": t["dim"][:1], "i": t["i"][:1], "row": pa.array([row], pa.list_(pa.float64()))})

    kind = "dim int, i int, row array<double>"
    parts = vectors.select("embedding", "dim").mapInArrow(moments, kind)
    found: dict[int, dict[int, list[float]]] = {}
    for r in parts.groupBy("dim", "i").applyInArrow(summed, kind).collect():  # d rows of d numbers
        found.setdefault(r["dim"], {})[r["i"]] = r["row"]
    return {d: np.linalg.eigh(np.array([rows[i] for i in range(d)]))[1][:, ::-1].copy() for d, rows in found.items()}


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and their lengths; large components are scaled down first."""
    top = np.abs(x).max(1, keepdims=True)
    y = x / top
    n = np.linalg.norm(y, axis=1, keepdims=True)
    return y / n, n


def _stages(dim: int) -> list[int]:
    return sorted({k for k in (dim // 8, dim // 4, dim // 2) if k} | {dim})


def tile_links(ra: list, rb: list, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose bound reaches the threshold to the end. ra, rb: for each stage the next
    rotated coordinates and the norm of those behind them. Products add up from stage to stage, and only
    over rows and columns that still hold a pair."""
    rows, cols = np.arange(len(ra[0][0])), np.arange(len(rb[0][0]))
    total = np.zeros((len(rows), len(cols)))
    for (x, left), (y, right) in zip(ra, rb, strict=True):
        total += x[rows] @ y[cols].T
        alive = total + left[rows, None] * right[None, cols] >= threshold - _SLACK
        r, c = alive.any(1), alive.any(0)
        if not r.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if not (r.all() and c.all()):
            total, alive, rows, cols = total[r][:, c], alive[r][:, c], rows[r], cols[c]
    i, j = np.nonzero(alive)
    return rows[i], cols[j]


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold on the original vectors."""
    parts = [np.einsum("ij,ij->i", a[i[s : s + 65536]], b[j[s : s + 65536]]) for s in range(0, len(i), 65536)]
    return np.concatenate(parts) >= threshold if parts else np.empty(0, bool)


def _staged(rotated: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    rest = np.sqrt(np.cumsum((rotated * rotated)[:, ::-1], axis=1)[:, ::-1])
    out, at, dim = [], 0, rotated.shape[1]
    for k in _stages(dim):
        out.append((np.ascontiguousarray(rotated[:, at:k]), rest[:, k] if k < dim else np.zeros(len(rotated))))
        at = k
    return out


def band_links(ids: np.ndarray, x: np.ndarray, band: np.ndarray, basis: np.ndarray, threshold: float, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Compare two bands with each other, or one band with itself: for each row how many rows of
    another id it links with here, and a row of its connected set here."""
    unit, _ = _unit(x)
    rotated = unit @ basis
    staged, lead = _staged(rotated), rotated[:, 0]
    names = np.unique(band)
    # by the leading coordinate, so that a tile's vectors are alike and tiles far apart stop early
    of_band = lambda name: (k := np.nonzero(band == name)[0])[np.argsort(lead[k], kind="stable")]
    first = of_band(names[0])
    second = first if len(names) == 1 else of_band(names[1])
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for s in range(0, len(first), tile):
        p = first[s : s + tile]
        rp = [(m[p], n[p]) for m, n in staged]
        for t in range(s if second is first else 0, len(second), tile):
            q = second[t : t + tile]
            i, j = tile_links(rp, [(m[q], n[q]) for m, n in staged], threshold)
            once = i < j if second is first and s == t else np.ones(len(i), bool)
            i, j = p[i[once]], q[j[once]]
            keep = _exact(unit, unit, i, j, threshold) & (ids[i] != ids[j])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            while True:  # the smaller label of both ends, until nothing changes
                low = np.minimum(label[i], label[j])
                if (low == label[i]).all() and (low == label[j]).all():
                    break
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                while (label[label] != label).any():
                    label = label[label]
    return links, label


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, band_bytes: int = 32_000_000, least_bands: int = 6) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> vec_id, n_links, component_id, kept, a row for each vec_id."""
    spark = vectors.sparkSession
    good = usable(vectors)
    stats = good.groupBy("dim").count().collect()  # a row for each length of vectors
    ids = vectors.select("vec_id").distinct()
    if not stats:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    basis = spark.sparkContext.broadcast(bases(good))
    p = max(least_bands, max(math.ceil(r["count"] * r["dim"] * 8 / band_bytes) for r in stats))
    mine = F.pmod(F.xxhash64("vec_id"), F.lit(p)).cast("int")
    dealt = good.withColumn("band", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    dealt = dealt.select("vec_id", "embedding", "dim", "band", F.least("band", "other").alias("lo"), F.greatest("band", "other").alias("hi"))

    def compare(t: pa.Table) -> pa.Table:
        d = t["dim"][0].as_py()
        own = t["vec_id"].to_numpy()
        links, label = band_links(own, _matrix(t["embedding"], d), t["band"].to_numpy(), basis.value[d], threshold)
        k = np.nonzero(links)[0]
        return pa.table({"vec_id": pa.array(own[k], pa.int64()), "root": pa.array(own[label[k]], pa.int64()), "n": pa.array(links[k], pa.int64())})

    found = dealt.groupBy("dim", "lo", "hi").applyInArrow(compare, "vec_id long, root long, n long")
    found = written(found, "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    out = ids.join(counts, "vec_id", "left").join(joined, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
