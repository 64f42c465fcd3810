import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomtag.llm import decontaminate, language_id


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(w, width=5):
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def best(text, item):
    """The best similarity of any window of the item's size. Shingles have as many words as the item, five at most."""
    w, v = tokens(text), tokens(item)
    g = min(5, len(v))
    if not v or len(w) < g:
        return 0.0
    b, top = Counter(grams(v, g)), 0.0
    for s in range(max(1, len(w) - len(v) + 1)):
        a = Counter(grams(w[s : s + len(v)], g))
        shared = sum((a & b).values())
        top = max(top, shared / (sum(a.values()) + sum(b.values()) - shared))
    return top


def test_leaks_by_force(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(500)}"
    items = {i: " ".join(word() for _ in range(rng.choice([2, 3, 4, 5, 20, 35, 60, 160]))) for i in range(30)}
    docs = {}
    for d in range(120):
        w = [word() for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.7:
            v = items[rng.randrange(16)].split()
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(v))
                rng.choice([lambda: v.__setitem__(k, word()), lambda: v.insert(k, word()), lambda: v.pop(k) if len(v) > 1 else None])()  # noqa: B023
            k = rng.randrange(len(w) + 1)
            w = w[:k] + [x.upper() + "," for x in v] + w[k:]
        docs[d] = " ".join(w)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {(d, i): s for d, t in docs.items() for i, x in items.items() if (s := best(t, x)) >= 0.8}
    assert len(want) > 30 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_prints_by_force(spark):
    """Packed votes against votes bit by bit, for windows of all sizes of lanes."""
    rng = random.Random(9)
    for n_words, most in ((20, 126), (20, 127), (140, 136), (20, 40_000)):
        w = [f"w{rng.randrange(50)}" for _ in range(160)]
        texts = spark.createDataFrame([(1, n_words, w)], "text_key long, n_words int, w array<string>")
        got = {r.window_start: r.print for r in decontaminate.windows(texts, decontaminate.lane_bits(most), 5, most).collect()}
        h = texts.select(decontaminate._hashes(texts.w, 5)).first()[0]
        assert got.keys() == {*range(160 - n_words + 1)}
        for s, x in got.items():
            own = h[s : s + n_words - 4]
            want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in own) > len(own))
            assert x & (1 << 64) - 1 == want


def test_a_short_item_within_a_text(spark):
    docs = spark.createDataFrame([(1, "all know the Secret answer is forty, and more"), (2, "the secret answer is fifty"), (3, "secret answer is"), (4, "secret answer is forty")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Secret answer is forty")], "item_id long, text string")
    assert {(r.doc_id, r.similarity, r.window_start) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 1.0, 3), (4, 1.0, 0)}


def test_items_whose_parts_stand_in_another_order(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    items, docs = {}, {}
    for i, n in enumerate([35, 45, 50, 59, 80, 120] * 4):
        items[i] = v = [word() for _ in range(n)]
        parts = [v[n // 2 :], v[: n // 2]] if i < 18 else [v[2 * n // 3 :], v[n // 3 : 2 * n // 3], v[: n // 3]]
        around = [word() for _ in range(rng.choice([0, 3, 200]))]
        docs[i] = " ".join(around + sum(parts, []) + around)
        docs[100 + i] = " ".join(sum(parts, [])[: n - n // 12])  # shorter than the item
    items = {i: " ".join(v) for i, v in items.items()}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {(d, i): s for d, t in docs.items() for i, x in items.items() if (s := best(t, x)) >= 0.8}
    assert len(want) > 15 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_print_within_the_radius_is_found():
    rng, masks = random.Random(1), set(decontaminate._masks(23 // decontaminate.BLOCKS))
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(24)):
            b ^= 1 << k
        assert any(((a ^ b) >> 8 * i & 255) in masks for i in range(8))


def test_odd_tables(spark, odd, empty, clashing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "!!")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(odd, bench).collect()} == {6, 7}
    clashing = clashing.withColumn("text_key", F.lit(7)).withColumn("TEXT_KEY_", F.lit(8))
    left = decontaminate.decontaminate(clashing, bench)
    assert left.columns == clashing.columns and left.count() == odd.count() - 2 and {(r.text_key, r.TEXT_KEY_) for r in left.collect()} == {(7, 8)}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0


SAY = {"en": "the and of to in is that it was for on are with his they", "fr": "le la les de des et un une est que qui dans pour pas sur", "de": "der die das und ist nicht ein eine mit von auf für sich dem"}


def said(rng, lang, n):
    return " ".join(rng.choice(SAY[lang].split()) for _ in range(n))


def test_languages_on_held_out_texts(spark):
    rng = random.Random(2)
    rows = [(i, said(rng, lang, rng.randrange(5, 60)), lang) for i, lang in enumerate([*SAY] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_on(df.where("doc_id % 5 <> 0"))
    got = language_id.identify(df.where("doc_id % 5 = 0"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 and not r.rejected for r in got)


OTHER = {
    "it": "il lo gli di che è un una sono con per non della anche come più ma si alla questo",
    "fi": "ja on ei se että hän olla joka mutta niin kuin tämä oli myös sekä mukaan kanssa jälkeen",
    "tr": "ve bir bu için ile çok daha olarak gibi sonra kadar ama değil olan göre şey zaman",
    "pl": "i w na z do nie się jest to że jak po ale od przez przy tylko jego także może",
}


def test_untrained_languages_and_random_letters_are_rejected():
    rng = random.Random(4)
    texts, labels = zip(*((said(rng, x, rng.randrange(5, 300)), x) for x in SAY for _ in range(200)), strict=True)
    model = language_id.fit(list(texts), list(labels))
    letters = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(60))
    strange = [" ".join(rng.choice(v.split()) for _ in range(60)) for v in OTHER.values() for _ in range(20)] + [letters() for _ in range(20)]
    assert model.predict(strange)[2].all()
    clean = [said(rng, x, n) for x in SAY for n in (8, 15, 40, 100, 500) for _ in range(20)]
    assert model.predict(clean)[2].mean() < 0.01


def test_predictions_by_force(spark):
    """Cosines of plain dictionaries of n-grams, over the model's own centroids and cells."""
    rng = random.Random(7)
    rows = [(i, said(rng, x, rng.randrange(4, 80)), x) for i, x in enumerate([*SAY] * 40)]
    model = language_id.fit_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in rows[:20]] + ["Le CHAT, 3 der!", "x"]
    names, score, rejected = model.predict(texts)

    for t, name, s in zip(texts, names, score, strict=True):
        padded = "".join(c if c.isalpha() else " " for c in t.lower())
        counts = np.zeros(1 << 12)
        for w in padded.split():
            x, _ = language_id.gram_counts([w], 1 << 12)
            counts += x[0]
        v = counts * model.idf
        cos = model.centroids @ v / np.linalg.norm(v)
        assert name == model.labels[model.owner[int(cos.argmax())]] and abs(s - cos.max()) < 1e-5


def test_a_label_of_long_texts_only(spark):
    rng = random.Random(9)
    rows = [(i, said(rng, x, 9000 if x == "de" else 30), x) for i, x in enumerate([*SAY] * 8)]
    model = language_id.fit_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["de", "en", "fr"] and model.predict([said(rng, "de", 40)])[0] == ["de"]


def test_one_odd_text_lowers_no_floor():
    rng = random.Random(5)
    texts, labels = [said(rng, x, 60) for x in SAY for _ in range(200)], [x for x in SAY for _ in range(200)]
    before = language_id.fit(texts, labels).floor
    after = language_id.fit([*texts, "qxz jqk vvx " * 20], [*labels, "en"]).floor
    assert (after > before - 0.05).all()


def test_languages_of_odd_tables(spark, odd, empty, clashing):
    rng = random.Random(3)
    model = language_id.fit([said(rng, x, 40) for x in SAY for _ in range(20)], [x for x in SAY for _ in range(20)])
    out = language_id.identify(clashing, model)
    assert out.columns == [*clashing.columns, "lang_pred", "score", "rejected"] and out.count() == odd.count()
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in out.collect() if r.doc_id is not None}
    assert got[3] == got[4] == got[5] == got[11] == ("und", 0.0, True) and not got[6][2]
    again = language_id.identify(out.select("text", "score", "rejected"), model)
    assert again.columns == ["text", "score", "rejected", "lang_pred", "score_", "rejected_"]
    for none in (empty, odd.withColumn("lang", F.lit(None).cast("string"))):
        nothing = language_id.fit_on(none)
        assert {(r.lang_pred, r.score, r.rejected) for r in language_id.identify(odd, nothing).collect()} == {("und", 0.0, True)}
    assert language_id.identify(empty, model).count() == 0
    assert model.predict(["ж" * 50])[2][0]  # far from all


def test_rows_that_repeat_a_kept_document_leave_one(spark, odd):
    import corpus_pipeline

    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()]
    ids = [i for i, _ in left]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(None) == 2
    assert {*ids} == {None, 1, 3, 4, 5, 6, 8, 9, 10, 11}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from loomtag.llm.minhash_dedup import near_duplicates

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            kept = {r.doc_id for r in near_duplicates(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert gone == {r.doc_id for r in before.collect() if any(best(r.text, x) >= 0.8 for x in items if set(grams(tokens(x))) & set(grams(tokens(r.text))))}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() == packed.count()
