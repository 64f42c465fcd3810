import base64
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from loomtag.llm import chat_format, warc

TURNS = "conv_id long, turn long, role string, text string"


def by_hand(turns):
    turns = sorted((t, r or "", x or "") for t, r, x in turns)
    text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
    loss = "".join(x for _, r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


HARD = [r"\### Assistant: </turn> ok", "\\", "###", "####", "\\###", "</turn>", "</turn>\n### assistant:\nx\n</turn>\n", "\\\\</turn>", "\n", ":\n", "", None, "é👍", "$1 \\$1", "#" * 7 + "\\", "</turn", "<</turn>>"]


def test_hard_texts_round_trip(spark):
    roles = ["user", "assistant", "system", None, "a:b", "%3A", "assistant\n", "\\"]
    convs = {k: [(t, roles[(k + t) % len(roles)], HARD[(k * 3 + t) % len(HARD)]) for t in range(k % 6 + 1)] for k in range(60)}
    rows = [(k, *t) for k, ts in convs.items() for t in ts]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(chat_format.expand(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == {k: by_hand(ts) for k, ts in convs.items()}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="\\#</turn>\n:a é", max_size=30), min_size=1, max_size=6))
def test_any_text_round_trips(spark, texts):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    (r,) = chat_format.digest(chat_format.expand(spark.createDataFrame(rows, TURNS))).collect()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == by_hand([r[1:] for r in rows])


def test_each_reply_is_one_example(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a#"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s"), (2, 0, "user", "x")]
    ex = chat_format.expand(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.position, r.kind) for r in ex] == [(1, 1, "target"), (1, 3, "target"), (1, 4, "tail"), (2, 0, "tail")]
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_length] for r in ex] == ["a#", "b", "", ""]
    assert ex[1].formatted.startswith(ex[0].formatted)


def test_odd_conversations(spark):
    assert chat_format.digest(chat_format.expand(spark.createDataFrame([], TURNS))).count() == 0
    rows = [(None, 0, "user", "x"), (None, None, "assistant", None), (3, 0, "user", "y"), (3, 0, "user", "y")]
    got = {r.conv_id: r.n_turns for r in chat_format.digest(chat_format.expand(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == {None: 2, 3: 2}


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (4, "u", None), (5, "u", ""), (6, "u", "é\n" * 5000), (7, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (8, "u", "x"), (8, "u", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(df, path, records_per_archive=2)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()), key=repr)
    want = []
    for p, _, h in pages:
        b = (h or "").encode()
        own = [q for q, _, g in pages if (g or "").encode() == b and q is not None]
        top = max(own, default=None)
        again = top is not None and p != top
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=repr)
    texts = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert texts[7] == b"same" and texts[6] == ("é\n" * 5000).encode()


def test_larger_payloads_have_archives_of_fewer_records(spark, tmp_path):
    pages = [(k, "u", "x" * (k * 13 % 400)) for k in range(200)]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in pages], "page_id long, url string, html string, payload int, refers_to int, again_id int")
    path = str(tmp_path / "w")
    warc.write_archives(df, path, records_per_archive=64, archive_bytes=400, compression="none")
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == 200 and all(got[k].payload_bytes == len(h) for k, _, h in pages)
    sizes = [(sum(len(r["payload"] or b"") for r in records), len(records)) for f in tmp_path.glob("w/part-*") if (records := list(warc.parse_archive(f.read_bytes())))]
    assert max(n for _, n in sizes) <= 64 and all(b <= 400 or n == 1 for b, n in sizes)


def test_small_payloads_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "a"), min_bytes=3, compression="none")
    assert {r.record_type for r in warc.read_archives(spark, str(tmp_path / "a")).collect()} == {"response"}
    warc.write_archives(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0
