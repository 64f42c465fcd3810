"""Documents as arrays, and operators that go on where events are made."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtag import synthetic
from loomtag.config import ParserConfig
from loomtag.functions import security as crypto
from loomtag.functions.tree import Halt, Handler
from loomtag.operators import security as sealed
from loomtag.operators import serialize, stream, validate
from loomtag.operators import tree as nodes
from loomtag.sources import parse as source
from loomtag.sources.parse import parse

ORDER = '<order id="1"><status>O</status><line no="1" flag="N"><part>7</part><qty>5</qty></line><line no="2" flag="R"><part>8</part><qty>6</qty></line> <line no="3"/></order>'
TEXTS = [
    ORDER, "<a><a>x</a>y<b/>z<![CDATA[c]]></a>", "<a> <b>t</b> \n<!-- c --></a>", "<a><b>open", "", None, '<p:a xmlns:p="u" p:k="&lt;"><p:b>é</p:b></p:a>', "<a/><b/>text", "<a><b></a>", "<order/>",
    '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;&f;</a>', "<?xml version='1.0'?><a><?p  q?></a>",
]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string")


def _sax(events):
    class Texts(Handler):
        def characters(self, text, state):
            if text == "z":
                raise Halt(state + "!")
            return state + text

        def start_element(self, uri, local, qname, attrs, state):
            return state + f"{uri}|{local}|{qname}{[(a['name'], a['value']) for a in attrs]}"

        def error(self, kind, message, state):
            return state + kind

    return nodes.sax_fold(events, Texts(), lambda: "", lambda s: [{"t": s}], "t string")


def _folded(events):
    return stream.fold(events, list, lambda e, s: ([*s, e["name"] or e["content"]], [{"x": e["event_type"]}] if e["depth"] == 1 else []), lambda s: [{"x": str(s)}], "x string")


def _blocks(events):
    return serialize.greedy_blocks(serialize.fragments(events), 8)


#: Operators by the findings that they answer.
OPERATORS = {
    "F1 sax_fold": _sax,
    "F3 text_content": lambda e: nodes.text_content(e, "a"),
    "F4 element_text": lambda e: nodes.text_content(e, "line"),
    "F5 fold": _folded,
    "F8 records": lambda e: nodes.records(e, "line", {"no": ("@no", "int"), "flag": ("@flag", "string"), "part": ("part", "long")}),
    "F9 nodes": lambda e: nodes.nodes(e, include_comments=True, keep_space=True),
    "F14 take": lambda e: stream.take(e, 3),
    "F15 chunk_every": lambda e: stream.chunk_every(e, 5),
    "F16 to_events": lambda e: nodes.to_events(nodes.nodes(e)),
    "F17 descendants": lambda e: nodes.descendants(nodes.nodes(e), "a"),
    "F18 child_counts": lambda e: nodes.child_counts(nodes.nodes(e)),
    "F20 compliant": validate.compliant,
    "F23 to_text": lambda e: serialize.to_text(e, pretty=True),
    "F24 greedy_blocks": _blocks,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_events_from_the_parser_need_no_exchange(spark, name):
    plan = OPERATORS[name](parse(docs(spark, *TEXTS)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_events_from_elsewhere_give_the_same(spark, name):
    events = parse(docs(spark, *TEXTS, *TEXTS))
    shuffled = events.repartition(5, F.hash("seq")).orderBy(F.desc("seq"))
    rows = lambda e: sorted(str(r) for r in OPERATORS[name](e).collect())
    found = rows(events)
    assert found == rows(shuffled) and found


def test_plain_documents_as_the_tokenizer_has_them():
    r = random.Random(7)
    parts = ["<", ">", "/", '"', "=", " ", "\n", "a", "<a>", "</a>", "<b/>", '<a b="1">', '<b a="x" b="">', "</b>", "&amp;", "'", ' c="2"', ":", "<!--", "é", "xmlns"]

    def tree(depth: int) -> str:
        some = [r.choice(["t", " ", "\n", '<c k="v"/>', *([f'<{n} k="&lt;">{tree(depth + 1)}</{n}>' for n in "ab"] if depth < 4 else [])]) for _ in range(r.randint(0, 3))]
        return "".join(some)

    texts = [t for t, _ in synthetic.FAULTS] + [t or "" for t in TEXTS] + ["".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(400)] + [f"<r>{tree(0)}</r>" for _ in range(200)] + ["<a>" * 30 + "</a>" * 30]
    raw, names = [t.encode() for t in texts], list(source._TYPES)
    for config in (ParserConfig(), ParserConfig(markers=False, positions="line_only").without("characters"), ParserConfig(positions="none").without("start_element", "space")):
        found = {}
        for batch, firsts in source._events_of(pa.array(range(len(raw))), pa.array(raw, pa.binary()), config, names):
            for row in batch.to_pylist():
                found.setdefault(row.pop("doc_id"), []).append(row)
            assert all(i == 0 or batch.column(0)[i] != batch.column(0)[i - 1] for i in firsts.tolist())
        for i, b in enumerate(raw):
            own = source.columns(b, config)
            assert pa.table({k: pa.array(own[k], source._TYPES[k]) for k in names}).to_pylist() == found.get(i, []), texts[i]


def test_most_documents_of_a_batch_need_no_tokenizer(monkeypatch):
    calls = []
    monkeypatch.setattr(source, "columns", lambda b, config: calls.append(b) or {k: [] for k in source._TYPES})
    raw = [ORDER.encode()] * 50 + [b"<a><!-- c --></a>"] * 50
    list(source._events_of(pa.array(range(100)), pa.array(raw, pa.binary()), ParserConfig(), ["seq"]))
    assert calls == [b"<a><!-- c --></a>"]  # of equal documents one


def test_only_the_columns_that_are_asked_for(spark):
    assert parse(docs(spark, "<a/>"), columns=("depth", "seq")).columns == ["doc_id", "seq", "depth"]
    with pytest.raises(ValueError):
        parse(docs(spark, "<a/>"), columns=("place",))


def test_documents_larger_than_what_is_done_at_once(spark, monkeypatch):
    big = "<a>" + '<b k="1">x</b>' * 120_000 + "</a>"
    found = {r["doc_id"]: r["n"] for r in parse(docs(spark, "<a/>", big, "<a>t</a>"), columns=("event_type",)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert found == {0: 4, 1: 4 + 3 * 120_000, 2: 5}


def test_a_wrapped_key_is_unwrapped_once_and_documents_are_not_joined(spark, monkeypatch):
    p, q = 2**521 - 1, 2**607 - 1
    private = crypto.PrivateKey(p * q, 65537, pow(65537, -1, (p - 1) * (q - 1)))
    source_ = docs(spark, *[f'<c><s Id="s1">{i}</s></c>' for i in range(20)])
    sent = sealed.encrypt(source_, "#s1", bytes(range(16)), "aes128_gcm", "content", private.public)
    opened = sealed.decrypt(sent, private=private)
    assert sorted(r["xml"] for r in opened.collect()) == sorted(r["xml"] for r in source_.collect())
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "BatchEvalPython" not in plan
    mixed = spark.createDataFrame([(1, None), (2, "<a/>")], "doc_id long, xml string")
    assert sorted((r[0], r[1]) for r in sealed.decrypt(mixed, private=private).collect()) == [(1, None), (2, "<a/>")]


def test_events_are_never_broadcast_by_a_guessed_size(spark):
    from loomtag import catalog

    plan = catalog.queries()["V1_apply_skip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_a_handler_that_has_stopped_sees_nothing_more(spark):
    seen = {r["doc_id"]: r["t"] for r in _sax(parse(docs(spark, "<a>x<b/>z<c>y</c></a>", "<a>y</a>"))).collect()}
    assert seen[0] == "None|a|a[]xNone|b|b[]!" and seen[1] == "None|a|a[]y"


def test_lines_are_dealt_as_columns_and_become_text_behind_that(spark, tmp_path):
    spark.createDataFrame([(1, "O"), (2, None), (3, "F"), (3, "P"), (None, "O")], "o_orderkey long, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 2, "R", 8, 6.0), (1, 1, "N", 7, 5.9), (1, 1, "A", 9, 5.0), (1, 3, None, 9, 5.0), (2, 1, "N", 7, 5.0), (9, 1, "N", 7, 5.0), (None, 1, "N", 7, 5.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = synthetic.orders(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    line = '<line no="{}" flag="{}"><part>{}</part><qty>{}</qty></line>'.format
    found = sorted(((r["doc_id"], r["xml"]) for r in made.collect()), key=str)
    assert found == sorted([
        (1, f'<order id="1"><status>O</status>{line(1, "A", 9, 5)}{line(1, "N", 7, 5)}{line(2, "R", 8, 6)}</order>'), (2, None), (None, None),
        (3, '<order id="3"><status>F</status></order>'), (3, '<order id="3"><status>P</status></order>'),
    ], key=str)
    final, partial, scan = plan.split("ObjectHashAggregate(")[-3:]
    assert "Exchange" not in partial and scan.count("Exchange") == 1 and "<line" not in scan.split("Exchange")[1] and "REPARTITION_BY_NUM" in scan


def test_tags_and_text_are_written_without_a_call_for_each(spark, monkeypatch):
    calls = []
    one = serialize._fragment
    monkeypatch.setattr(serialize, "_fragment", lambda *a: calls.append(a[0]) or one(*a))
    texts = ['<a>x &lt; y<b/> <c k="1">z</c></a>', "<a><!-- c --></a>"]
    batch = pa.record_batch([pa.array([1, 2]), pa.array([t.encode() for t in texts], pa.binary())], ["doc_id", "xml"])
    made = serialize.fragments(parse(docs(spark, "")))._whole.make(iter([batch]), ("fragment",))
    assert "".join(x for b, _ in made for x in b.column(1).to_pylist()) == "".join(texts).replace("&lt; y", "&amp;lt; y")
    assert sorted(calls) == ["comment", "start_element"]  # that with an attribute


def test_blocks_are_the_same_however_batches_are_cut(spark):
    r = random.Random(3)
    rows = [(d, i, r.choice(["", None, "x", "é" * 3, "y" * 15])) for d in range(30) for i in range(r.randint(1, 40))]
    expected = []
    for d in range(30):
        held, n = None, 0
        for f in [f for k, _, f in rows if k == d]:
            held = (held or b"") + (f or "").encode()
            if len(held) >= 20:
                expected.append((d, n, held))
                held, n = None, n + 1
        if held is not None:
            expected.append((d, n, held))
    frags = spark.createDataFrame(rows, "doc_id long, seq int, fragment string")
    for most in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            found = sorted((x["doc_id"], x["block"], bytes(x["data"])) for x in serialize.greedy_blocks(frags, 20).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert found == expected
