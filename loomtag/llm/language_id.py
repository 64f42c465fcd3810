"""Language identification by nearest centroid over TF-IDF character n-grams.

Every run of letters, lower-cased and set between spaces, gives its 1- to
3-grams, hashed into a fixed number of dimensions. Counts times inverse
document frequency, scaled to length one, are compared by cosine with several
centroids per language, found by spherical k-means within each language.

The model is fitted on a bounded sample: about ``per_language`` labelled texts
of each label, drawn by hash, whole. Executors count their n-grams and fit each
label in a task of its own; the driver holds the centroids alone, ``clusters``
times ``dims`` numbers a label. Prediction reads every whole text.

A text that is null or has no letter is ``und`` with score 0, and rejected. Any
other is *rejected* if its best cosine is under the floor of its nearest
language at its number of letters; that language is still named. Short texts
have lower cosines, so floors are set from the beginnings of the training texts,
cut to 1, 2, 4 … 512 letters: ``share`` times the ``low`` quantile of their
cosines with their own language. A text goes by the greatest such number that
it reaches. ``dims`` is a power of two. Ties go to the label that sorts first.

Rows that repeat are learned from once and predicted alike. A table without rows
gives none; without a labelled text nothing is learned, and all texts are
``und`` and rejected. Columns of any name pass through; if ``lang_pred``,
``score`` or ``rejected`` are among them, the new ones get underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, slices, unused, written

UNDETERMINED = "und"
_SPACE = 32
_STEPS = 10
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter, made once in each process."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000))
    return _TABLE[0]


def gram_counts(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, a row for each text; and for each the number of its letters."""
    table, lowered = _letters(), [t.lower() for t in texts]
    sizes = [len(t) + 1 + (i == 0) for i, t in enumerate(lowered)]  # a space before the first text and behind each
    c = np.frombuffer((" " + " ".join(lowered)).encode("utf-32-le", "surrogatepass") + b" \0\0\0", "<u4")
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    one = table[c]
    letters = np.bincount(row, one, len(texts)).astype(np.int64)
    # only spaces next to a letter take part: they mark where a word begins or ends
    keep = one.copy()
    keep[1:] |= one[:-1]
    keep[:-1] |= one[1:]
    c, one, row = c[keep], one[keep], row[keep]
    x = np.where(one, c, _SPACE).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y = x[1:] + (x[:-1] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    z = y[1:] + (x[:-2] >> np.uint64(11)) * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - (dims.bit_length() - 1))
    base, words = row * dims, one[1:] | one[:-1]
    cells = np.concatenate([((x ^ x >> np.uint64(29)) >> shift).astype(np.int64)[one] + base[one], ((y >> shift).astype(np.int64) + base[1:])[words], ((z >> shift).astype(np.int64) + base[2:])[one[1:-1]]])
    return np.bincount(cells, minlength=len(texts) * dims)[: len(texts) * dims].reshape(len(texts), dims).astype(np.float32), letters


@dataclass
class CentroidModel:
    labels: list[str]  #: sorted
    owner: np.ndarray  #: of each centroid, an index into labels
    centroids: np.ndarray  #: rows of length one
    idf: np.ndarray
    floor: np.ndarray  #: least cosine that isn't rejected, by label and power of two of letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, cosine in 0..1 and whether rejected, for each text."""
        if not self.labels:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        x, letters = gram_counts(texts, len(self.idf))
        x *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        cos = (x @ self.centroids.T) / np.maximum(norm, 1e-12)[:, None]
        best = cos.argmax(1)
        score = np.where(letters > 0, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0)
        names = [self.labels[self.owner[b]] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
        step = np.minimum(np.log2(np.maximum(letters, 1)).astype(int), _STEPS - 1)
        return names, score.astype(np.float64), (letters == 0) | (score < self.floor[self.owner[best], step])


def beginnings(text: str) -> list[str | None]:
    """A text up to 1, 2, 4 … letters, where it has them, without signs between words."""
    out: list[str | None] = []
    held, want = [], 1
    for ch in text:
        if ch.isalpha():
            held.append(ch)
            want -= 1
            if not want:
                out.append("".join(held))
                if len(out) == _STEPS:
                    break
                want = 1 << (len(out) - 1)
        elif held and held[-1] != " ":
            held.append(" ")
    return out + [None] * (_STEPS - len(out))


def _inverse(n: int, df: np.ndarray) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def _floors(own: np.ndarray, cuts: list[list[str | None]], centroids: np.ndarray, idf: np.ndarray, low: float, share: float) -> list[float]:
    """Of one language, for each number of letters; one that fewer than 20 texts reach goes by the number before."""
    out: list[float] = []
    for k in range(_STEPS):
        cut = [c[k] for c in cuts if c[k]]
        if len(cut) < 20 and out:
            out.append(out[-1])
            continue
        cosines = [(own @ centroids.T).max(1)] if len(cut) < 20 else []
        for i in range(0, len(cut) if not cosines else 0, 64):
            x = gram_counts(cut[i : i + 64], len(idf))[0] * idf
            cosines.append((x @ centroids.T).max(1) / np.maximum(np.linalg.norm(x, axis=1), 1e-12))
        out.append(share * float(np.quantile(np.concatenate(cosines), low)))
    return out


def fit_language(counts: np.ndarray, cuts: list[list[str | None]], idf: np.ndarray, clusters: int = 4, low: float = 0.01, share: float = 0.85, rounds: int = 8) -> tuple[np.ndarray, list[float]]:
    """Centroids and floors of one language, from its texts' n-gram counts and beginnings."""
    own = counts * idf
    own /= np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]
    # seeds: the mean, then each time the text furthest from those so far
    c = own.mean(0, keepdims=True)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    while len(c) < min(clusters, len(own)):
        c = np.concatenate([c, own[(own @ c.T).max(1).argmin()][None]])
    for _ in range(rounds):
        near = (own @ c.T).argmax(1)
        c = np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c.astype(np.float32), _floors(own, cuts, c, idf, low, share)


def _model(parts: list[tuple[str, np.ndarray, list[float]]], idf: np.ndarray) -> CentroidModel:
    parts = sorted(parts, key=lambda p: p[0])
    owner = np.repeat(np.arange(len(parts)), [len(c) for _, c, _ in parts])
    centroids = np.concatenate([c for _, c, _ in parts]) if parts else np.empty((0, len(idf)), np.float32)
    return CentroidModel([p[0] for p in parts], owner, centroids, idf, np.array([f for *_, f in parts]))


def fit(texts: list[str], labels: list[str], dims: int = 1 << 12, **how) -> CentroidModel:
    """Fit on texts in memory."""
    x = np.concatenate([gram_counts(texts[i : i + 64], dims)[0] for i in range(0, len(texts), 64)])
    idf = _inverse(len(x), (x > 0).sum(0))
    some, y = x.any(1), np.array(labels, object)
    parts = []
    for name in sorted(set(y[some].tolist())):
        k = np.nonzero(some & (y == name))[0]
        parts.append((name, *fit_language(x[k], [beginnings(texts[i]) for i in k], idf, **how)))
    return _model(parts, idf)


def fit_on(docs: DataFrame, per_language: int = 400, dims: int = 1 << 12, **how) -> CentroidModel:
    """Fit on ``docs(doc_id, text, lang)``, all of which may be learned from."""
    pool = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rates = pool.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("rate"))  # a row for each label
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = pool.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "text").distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = part.column(1).to_pylist()
                x, letters = gram_counts(texts, dims)
                k = np.nonzero(letters)[0].tolist()
                cuts = [beginnings(texts[j]) for j in k]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k, pa.int64())), pa.array([x[j].tobytes() for j in k], pa.binary()), pa.array(cuts, pa.list_(pa.string()))], ["lang", "counts", "cuts"])

    sample = written(drawn.mapInArrow(counted, "lang string, counts binary, cuts array<string>"), "sample")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(dims, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n, df = n + 1, df + (np.frombuffer(x, np.float32) > 0)
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.tobytes()]}, pa.schema([("n", pa.int64()), ("df", pa.binary())]))

    n, df = 0, np.zeros(dims, np.int64)
    for r in sample.select("counts").mapInArrow(held, "n long, df binary").toLocalIterator():  # a row for each partition of the sample
        n, df = n + r["n"], df + np.frombuffer(r["df"], np.int64)
    idf = _inverse(n, df)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def fitted(t: pa.Table) -> pa.Table:
        order = np.argsort(np.array(t["counts"].to_pylist(), object), kind="stable")  # in any order of rows the same
        x = np.stack([np.frombuffer(t["counts"][int(k)].as_py(), np.float32) for k in order])
        c, floor = fit_language(x, [t["cuts"][int(k)].as_py() for k in order], shared.value, **how)
        return pa.table({"lang": t["lang"][:1], "centroids": pa.array([c.tobytes()], pa.binary()), "floor": pa.array([floor], pa.list_(pa.float64()))})

    found = sample.groupBy("lang").applyInArrow(fitted, "lang string, centroids binary, floor array<double>").collect()  # a row for each label
    return _model([(r["lang"], np.frombuffer(r["centroids"], np.float32).reshape(-1, dims), r["floor"]) for r in found], idf)


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """All columns of ``docs`` (with ``text``) and, as the last three, lang_pred, score, rejected; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    own = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType()))
    names = [*docs.columns, *(unused(name, docs) for name, _ in own)]
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name will do, dots in it too
    out = T.StructType([*numbered.schema.fields, *(T.StructField(*x) for x in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in (x for batch in batches for x in slices(batch, at, 1 << 20)):
            for i in range(0, part.num_rows, 64):
                few = part.slice(i, 64)
                labels, score, rejected = m.predict([t or "" for t in few.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array(labels, pa.string()), pa.array(score), pa.array(rejected)], out.names)

    return numbered.mapInArrow(lambda batches: released(run(batches)), out).toDF(*names)
