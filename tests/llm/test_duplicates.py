import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from loomtag.llm import common, embedding_dedup, minhash_dedup, repeated_bytes
from loomtag.llm.shingles import Shingler


def roots(links, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if k in got} and all(v == k for k, v in want.items() if k not in got)


# near duplicates


def sets_of(texts, width):
    out = {}
    for d, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def by_force(texts, width, t):
    sets = sets_of(texts, width)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (k := len(sets[a] & sets[b])) and t.denominator * k >= t.numerator * (len(sets[a]) + len(sets[b]) - k)]
    top = roots(links, ids)
    return {d: (len(sets[d]), top[d]) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = {}
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 8, 12, 30, 80, 300]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
                k = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(k, word()), lambda: w.insert(k, word()), lambda: w.pop(k) if len(w) > 1 else None])()  # noqa: B023
            texts[len(texts)] = " ".join(w) + (" " + " ".join(passage) if rng.random() < 0.3 else "")
    base = [word() for _ in range(120)]
    for _ in range(40):  # a family of which few link
        w = list(base)
        for _ in range(rng.randrange(2, 14)):
            w[rng.randrange(len(w))] = word()
        texts[len(texts)] = " ".join(w)
    return texts


@pytest.mark.parametrize(("seed", "width", "threshold"), [(1, 3, "0.85"), (2, 5, "0.8"), (3, 3, "0.85")])
def test_near_duplicates_by_force(spark, seed, width, threshold):
    texts = corpus(seed)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(rows, width, threshold, block_docs=16, long_list=3).collect()}
    assert got == by_force(texts, width, Fraction(threshold))


def test_runs_that_any_similar_pair_shares():
    t, rng = Fraction("0.8"), random.Random(2)
    for _ in range(3000):
        u = rng.randrange(1, 40)
        apart = rng.randrange(0, int((1 - t) * u) + 1)
        gone = set(rng.sample(range(u), apart))
        half = {x for x in gone if rng.random() < 0.5}
        a, b = [x for x in range(u) if x not in half], [x for x in range(u) if x not in gone - half]
        if a == b:
            continue
        runs = lambda s: {tuple(s[i : i + r]) for r in minhash_dedup.run_lengths(len(s), t) for i in range(len(s) - r + 1)}
        assert runs(a) & runs(b)


def test_near_duplicates_of_odd_tables(odd, empty, clashing):
    got = minhash_dedup.near_duplicates(clashing).collect()
    assert len(got) == odd.count()
    own = {r.doc_id: r for r in got if r.doc_id is not None}
    assert own[2].component_id == own[1].component_id == 1 and own[7].component_id == 6 and own[3].component_id == 3 and own[5].n_shingles == 0
    assert all(r.kept for r in got if r.doc_id is None) and minhash_dedup.near_duplicates(empty).count() == 0


# repeated bytes


def bytes_by_force(texts, depth):
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if b[p : p + depth] in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(b[p : p + depth])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), len(b) - len(kept), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2, 20_000])
def test_repeats_by_force(spark, hot):
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefghij ", k=150))
    texts = {0: None, 1: "", 2: "x" * 99, 3: "x" * 350, 4: "é" * 60, 5: "ab" * 200, 6: line, 7: line}
    for i in range(10, 60):
        t = "".join(rng.choices("abcdefghij ", k=rng.randrange(50, 700)))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice([line, texts.get(i - 1) or "", line[20:]])
            k = rng.randrange(len(t))
            t = t[:k] + s + t[k:]
        texts[i] = t
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes.remove_repeats(rows, hot=hot).collect()}
    assert got == bytes_by_force(texts, 100)


def test_repeats_of_odd_tables(odd, empty, clashing):
    got = repeated_bytes.remove_repeats(clashing).collect()
    assert len(got) == odd.count() and all(r.n_removed == 0 for r in got if r.doc_id in (1, None)) and all(r.n_removed == r.n_bytes and not r.kept for r in got if r.doc_id == 2)
    assert repeated_bytes.remove_repeats(empty).count() == 0


def test_grams_and_anchors():
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=2000)), np.uint8)
    h = repeated_bytes.gram_hashes(data, 11)
    by = {}
    for i in range(len(h)):
        assert by.setdefault(data[i : i + 11].tobytes(), h[i]) == h[i]
    assert len(set(by.values())) == len(by)
    at = repeated_bytes.least_places(h, 23)
    assert all(at[i] == i + int(np.argmin(h[i : i + 23])) for i in range(len(at)))


# vectors


def vectors(seed=4, n=400, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[:60] + 0.25 * rng.normal(size=(60, dim))
    ring = base[0] + 0.2 * rng.normal(size=(40, dim))
    x = np.concatenate([base, near, ring, base[:5] * 3])
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


def test_vectors_by_force(spark):
    rows = vectors()
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] + [1.0] * 23), (1003, [1.0] * 5), (1004, [2.0] * 5), (1005, [None] + [1.0] * 23), (1006, [float("inf")] + [0.0] * 23), (None, rows[0][1]), rows[1]]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, least_bands=3).collect()}
    x = np.array([r[1] for r in rows[:505]])
    cos = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(cos >= 0.9, 1)), strict=True)] + [(1003, 1004)]
    ids = [*range(505), *range(1000, 1007)]
    top = roots(links, ids)
    assert got == {i: (sum(i in e for e in links), top[i], top[i] == i) for i in ids} | {None: (0, None, False)}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(bad).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_shingles():
    s = Shingler(3)
    assert len(s("a b")) == len(s("A\tb")) == 1 and (s("a b") == s("A\x0bB")).all() and len(s(None)) == len(s(" \n")) == 0 and len(s("a b c d a b c d")) == 4
    assert len(s("a\u00a0b")) == 1 and not (s("a\u00a0b") == s("a b")).all()


def test_prefixes_of_any_order_share_a_value():
    t, rng = Fraction("0.85"), random.Random(3)
    for _ in range(2000):
        u = rng.randrange(1, 80)
        union = np.array(sorted(rng.sample(range(10_000), u)), np.uint64)
        gone = set(rng.sample(range(u), rng.randrange(0, int((1 - t) * u) + 1)))
        half = {x for x in gone if rng.random() < 0.5}
        a, b = union[[x for x in range(u) if x not in half]], union[[x for x in range(u) if x not in gone - half]]
        hot = np.array(sorted(rng.sample(union.tolist(), rng.randrange(0, u + 1))), np.uint64)
        assert {*minhash_dedup.prefix(a, hot, t).tolist()} & {*minhash_dedup.prefix(b, hot, t).tolist()}


def test_a_passage_in_texts_of_all_families(spark):
    """One passage in every text, all its lists long, and links between texts that share little else."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    texts = {}
    for k in range(120):
        own = [word() for _ in range(rng.choice([2, 4, 20, 90]))]
        for _ in range(rng.choice([1, 2])):
            texts[len(texts)] = " ".join(own[: len(own) - k % 2] + passage + [word()])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(rows, 3, "0.85", long_list=3, block_docs=16, kin=0.9).collect()}
    assert got == by_force(texts, 3, Fraction("0.85"))
