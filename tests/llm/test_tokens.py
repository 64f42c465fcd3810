import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtag.llm.packing import WordEncoder, best_fit_decreasing, pack, word_encoder
from loomtag.llm.queries import vocabulary
from loomtag.llm.token_counts import MergeCounter, count_tokens, merge_counter

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
HARD = ["", " ", "  a", "a  b", "a \n b", "don't 'LL x's", "<|endoftext|>", "a<|endoftext|> b", "日本語", "é e\u0301", "\x1ca\x1d b", "a\u00a0b\u3000c", "12 34,5", "aaaa" * 300, "İ ß ǆ", "\ufeffx", "a\x85b", "\u200bz", "👍🏽👍"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


COUNT, ENCODE = merge_counter(BYTES), word_encoder(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,stdmreLl0aé"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_are_the_librarys(text):
    from tokenizers import Tokenizer

    own = test_counts_are_the_librarys.__dict__.setdefault("own", Tokenizer.from_file(BYTES))
    assert COUNT(text) == len(own.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,stdmreLl0aé"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_ids_are_the_librarys(texts):
    got = ENCODE(texts)
    want = [np.array(x.ids, "<u4").tobytes() for x in ENCODE.library.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_hard_texts(library):
    assert [COUNT(t) for t in HARD] == [len(x.ids) for x in library[BYTES].encode_batch(HARD, add_special_tokens=False)]
    assert ENCODE(HARD) == [np.array(x.ids, "<u4").tobytes() for x in library[WORDS].encode_batch(HARD, add_special_tokens=False)]


def test_small_caches_change_nothing(library):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh.", k=rng.randrange(1, 9))) for _ in range(200)) for _ in range(20)]
    small, encoder = MergeCounter(BYTES, keep=10), WordEncoder(WORDS, keep=10)
    assert [small(t) for t in texts] == [len(x.ids) for x in library[BYTES].encode_batch(texts, add_special_tokens=False)]
    for t in texts:
        assert encoder([t]) == [np.array(library[WORDS].encode(t, add_special_tokens=False).ids, "<u4").tobytes()]


def test_odd_tables(odd, empty, clashing):
    path = BYTES
    counts = count_tokens(odd, lambda: merge_counter(path)).collect()
    assert len(counts) == odd.count() and all(r.n_tokens == r.n_bytes == 0 for r in counts if r.doc_id in (3, 4)) and next(r for r in counts if r.doc_id == 8).over_limit
    assert count_tokens(empty, lambda: merge_counter(path)).count() == 0 and count_tokens(clashing, lambda: merge_counter(path)).count() == len(counts)
    words = WORDS
    assert pack(empty, lambda: word_encoder(words)).count() == 0 and {r.doc_tokens for r in pack(clashing, lambda: word_encoder(words)).where("doc_id IN (3, 4, 5)").collect()} == {1}


def slow_best_fit(lengths, window):
    rooms, where = [], [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[k]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[k])
        else:
            rooms.append(window - lengths[k])
    return where, sorted(r for r in rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_decreasing(lengths):
    where, offset, filled = best_fit_decreasing(lengths, 40)
    assert sorted(40 - f for f in filled) == slow_best_fit(lengths, 40)[1]
    for w in range(len(filled)):
        own = sorted((offset[k], lengths[k]) for k in range(len(lengths)) if where[k] == w)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == filled[w] <= 40


def test_pieces_rebuild_documents(odd, library):
    path = WORDS
    rows = pack(odd, lambda: word_encoder(path), window=256).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for d, t in texts.items():
        want = np.array([*library[WORDS].encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = sorted({(r.start, bytes(r.ids)) for r in rows if r.doc_id == d})
        assert b"".join(b for _, b in own) == want and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4 for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and total <= 256
        assert all(r.sequence_tokens == total and r.padded_tokens == (total if total & (total - 1) == 0 else 256) for r in own)


def test_counts_refuse_files_they_do_not_follow(tmp_path):
    import json

    with open(BYTES, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "ignore_merges": True}}):
        file = tmp_path / "changed.json"
        file.write_text(json.dumps({**spec, **change}), encoding="utf-8")
        with pytest.raises(ValueError, match=next(iter(change)) if "model" not in change else "ignore_merges"):
            MergeCounter(str(file))
