import re

from pyspark.sql import functions as F

from loomtag.llm.surrogates import distinct_surrogates, replace_entities


def run(spark, *texts, key="k"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in replace_entities(rows, key).orderBy("doc_id").collect()]


def luhn(s):
    d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(x - 9 * (x > 9) for x in d) % 10 == 0


def test_each_kind_keeps_its_form(spark):
    text = 'Mail Jo.Doe@mail5.example.com or +1 (743) 555-3824, card 4845 1681-1440 7329 x 4845168114407329, ip 70.23.22.57, password=b7db7aa4a5fcc78305 token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" ssn 078-05-1120 iban GB82 WEST 1234 5698 7654 32 Herr Meier and Mrs. Ann Smith.'
    (out,) = run(spark, text)
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d+", "9", t)))
    for found in ("Jo.Doe@", "743", "3824", "4845168114407329", "70.23.22.57", "b7db7aa4a5fcc78305", "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae", "078-05-1120", "5698", "Meier", "Ann Smith"):
        assert found not in out
    card = re.search(r"x (\d{16})", out)[1]
    assert luhn(card) and card[0] == "4" and "+1 (" in out and ".com or" in out and re.search(r"password=[0-9a-f]{18} token = \"[0-9a-f]{40}\"", out)
    assert all(0 <= int(o) <= 255 for o in re.search(r"ip ([\d.]+),", out)[1].split(".")) and re.search(r"Herr \w+ and Mrs\. \w+ \w+\.$", out)
    iban = re.search(r"iban ([A-Z0-9 ]+?) Herr", out)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and shape(out)[:10] == shape(text)[:10]


def test_what_is_not_personal_stays(spark):
    texts = ["9807915762804490 is no card", "999.1.2.3 is no address", "version 3.0", "CC BY-NC 4.0.", "no entity", "", None]
    assert run(spark, *texts) == texts


def test_coreference_and_distinctness(spark):
    a, b, c = run(spark, "x@y.com 4845168114407329", "X@Y.com 4845-1681-1440-7329", "z@y.com")
    assert a.split()[0].lower() == b.split()[0].lower() != c and a.split()[1] == b.split()[1].replace("-", "")
    assert run(spark, "x@y.com", key="k") != run(spark, "x@y.com", key="other")


def test_gender_and_script(spark):
    from loomtag.llm.surrogates import FIRST

    he, she = run(spark, "г-н Иван Петров", "г-жа Анна Петрова")
    assert he.split()[1] in FIRST["m", "cyrillic"] and she.split()[1] in FIRST["f", "cyrillic"] and she.endswith("ова")


def test_clashes_are_resolved(spark):
    rows = spark.range(3000).select(F.lit("secret").alias("kind"), F.lpad(F.col("id").cast("string"), 4, "0").alias("norm"))
    out = distinct_surrogates(rows, "k").collect()
    assert len({r.made for r in out}) == 3000 and not {r.made for r in out} & {r.norm for r in out}


def test_names_of_one_person_and_of_other_scripts(spark):
    full, short, other, greek, cc = run(spark, "Mr John Smith", "Mr Smith", "Mrs Ann Smith and Mr John Roe", "κύριος Παπαδόπουλος", "+33 123 456 789 and +49 3012 3456")
    assert full.split()[2] == short.split()[1] == other.split()[2] != "Smith" and full.split()[1] == other.split()[5] != "John" and other.split()[6] != full.split()[2]
    assert re.fullmatch(r"κύριος [Ͱ-Ͽἀ-῿]+", greek) and greek != "κύριος Παπαδόπουλος" and re.fullmatch(r"\+33 \d{3} \d{3} \d{3} and \+49 \d{4} \d{4}", cc) and "456" not in cc


def test_more_names_than_short_ones_there_are(spark):
    """More surnames, first names and one-letter addresses than the shortest form has."""
    rows = spark.range(9000).select(F.explode(F.array(F.struct(F.lit("last").alias("kind"), F.concat(F.lit("- S"), F.col("id")).alias("norm")), F.struct(F.lit("first").alias("kind"), F.concat(F.lit("m F"), F.col("id") % 300).alias("norm")), F.struct(F.lit("email").alias("kind"), F.concat(F.char(97 + F.col("id") % 26), F.lit("@"), F.char(97 + F.floor(F.col("id") / 26) % 26), F.lit(".org")).alias("norm")))).alias("x")).select("x.*").distinct()
    out = distinct_surrogates(rows, "k").collect()
    assert len(out) == rows.count() == len({(r.kind, r.made) for r in out}) and not {(r.kind, r.made) for r in out} & {(r.kind, r.norm) for r in out}


def test_by_force(spark):
    """The whole operator against plain Python around the map that it made: what is found, what stays, one to one."""
    base = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(base).select("doc_id", "text")
    got = {r.doc_id: (r.text, r.n_entities) for r in replace_entities(docs, "k").collect()}
    octets = lambda x: all(int(o) < 256 for o in x.split("."))
    plain = {  # another reading of the kinds that the table holds
        "email": (r"[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", lambda x: True),
        "secret": r'(?:password|token)\s?=\s?"?([A-Za-z0-9]{8,})',
        "phone": (r"\+\d \(\d{3}\) \d{3}-\d{4}", lambda x: True),
        "ip": (r"(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])", octets),
        "card": (r"(?<!\d)(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<!\d)\d{13,19}(?!\d)", lambda x: luhn(re.sub(r"\D", "", x)) and re.match("4|5[1-5]|2[2-7]|3[47]|6", x)),
    }
    pairs, changed = {}, 0
    for r in docs.collect():
        text, n = got[r.doc_id]
        want = set()
        for kind, rule in plain.items():
            pattern, test = rule if isinstance(rule, tuple) else (rule, lambda x: True)
            for m in re.finditer(pattern, r.text or "", re.A):
                if test(m[0]):
                    want.add((m.start(1 if m.re.groups else 0), m.end(), kind))
        if not want:
            assert text == r.text and n == 0
            continue
        changed += 1
        assert n == len(want)
        at, shift = 0, 0
        order = sorted(want)
        for (s, e, kind), after in zip(order, [*(x[0] for x in order[1:]), len(r.text)], strict=True):
            assert text[at + shift : s + shift] == r.text[at:s]  # what lies between stays
            tail = r.text[e : min(e + 12, after)]
            end = text.index(tail, s + shift) if tail else len(text)
            norm = lambda x: re.sub(r"\D", "", x) if kind in ("card", "phone") else x.lower() if kind == "email" else x  # noqa: E731, B023
            made = norm(text[s + shift : end])
            assert pairs.setdefault((kind, norm(r.text[s:e])), made) == made
            at, shift = e, end - e
        assert text[at + shift :] == r.text[at:]
    made = [(k, v) for (k, _), v in pairs.items()]
    assert changed > 50 and len({*made}) == len(made) and not {*made} & {*pairs}


def test_odd_tables(odd, empty, clashing):
    out = replace_entities(clashing, "k")
    theirs = clashing.withColumns({x: F.lit(7) for x in ("n_entities", "key", "c0", "__key", "__n", "new", "found")})
    again = replace_entities(theirs, "k")
    assert again.columns == [*theirs.columns, "n_entities_"] and {(r.n_entities, r.key) for r in again.collect()} == {(7, 7)} and again.where("n_entities_ > 0").count() == 1
    assert out.columns == [*clashing.columns, "n_entities"] and out.count() == clashing.count() and out.where("n_entities > 0").count() == 1
    assert replace_entities(empty, "k").count() == 0
    same = {(r.doc_id, r.text) for r in replace_entities(odd, "k").where("n_entities = 0").select("doc_id", "text").collect()}
    assert same == {(r.doc_id, r.text) for r in odd.where("doc_id <> 10 OR doc_id IS NULL").collect()}


def test_every_shape_implies_the_hint(spark):
    from loomtag.llm.surrogates import _HINT, SHAPES

    alone = {
        "email": ["a@b.example"], "iban": ["GB82 WEST 1234 5698 7654 32"], "phone": ["+1 (743) 555-3824", "743-555-3824"], "ip": ["70.23.22.57"], "ssn": ["078-05-1120"], "card": ["4845168114407329"], "name": ["Herr Meier", "г-жа Иванова"],
        "secret": ["Password=abcdefgh", "api-key: abcdefgh", "APIKEY=abcdefgh", "deadbeefcafeabad" * 2, *(f"{p}{s}AbCdEfGhIjKlMnOpQr" for p in ("sk", "pk", "ghp", "gho", "xoxb", "xoxp", "AKIA", "ASIA") for s in ("", "-", "_"))],
    }
    assert alone.keys() == SHAPES.keys()
    rows = spark.createDataFrame([(k, x) for k, xs in alone.items() for x in xs], "kind string, text string")
    for k, p in SHAPES.items():
        assert rows.where(F.col("kind") == k).where(F.col("text").rlike(p) & F.col("text").rlike(_HINT)).count() == len(alone[k])
    (out,) = run(spark, "use sk_liveAbCdEfGhIjKlMnOpQr here")
    assert "sk_liveAbCdEfGhIjKlMnOpQr" not in out and out.startswith("use ") and out.endswith(" here")
