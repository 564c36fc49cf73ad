"""Tokens, packing and ORC files against the tokenizers library and exhaustive packing."""

import itertools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from harborline.llm import orc_ids, packing, tokens


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


ENCODER = tokens.WordEncoder(tokens.vocabulary_path())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text("aAéÉ ,.'!\nſİΣ<|>0９", max_size=40))
def test_words_encode_like_whole_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aAéÉ ,.'!\nſİΣ<|>0９\t", max_size=20), min_size=1, max_size=8))
def test_texts_encode_together_as_one_by_one(texts):
    ids, ends = ENCODER.encode_all(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_FORMS", 2)
    monkeypatch.setattr(tokens, "MEMORY_RUNS", 2)
    text = "some words, Some WORDS again. and other words; étés Étés, " * 3
    assert np.frombuffer(tokens.WordEncoder(tokens.vocabulary_path()).encode(text), "<u4").tolist() == library(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_and_places(awkward, library):
    got = packing.pack_documents(awkward, capacity=64).collect()
    want = []
    for row in awkward.collect():
        ids = library(row.text) + [0]
        want += [(row.doc_id, n // 64, n, len(ids[n:n + 64]), crc(ids[n:n + 64])) for n in range(0, len(ids), 64)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    check_places([(r.sequence_id, r.offset, r.length) for r in got], 64)


def check_places(places, capacity):
    for _, group in itertools.groupby(sorted(places), key=lambda p: p[0]):
        at = 0
        for _, offset, length in group:
            assert offset == at
            at += length
        assert at <= capacity


def test_nothing_to_pack(nothing):
    assert packing.pack_documents(nothing).count() == 0


def test_sequences_hold_the_ids(awkward, library):
    docs = awkward.where("doc_id in (1, 5, 6, 10)")
    placed = packing.pack_documents(docs, capacity=64)
    got = {r.sequence_id: r for r in packing.sequences(placed, docs).collect()}
    for r in placed.collect():
        ids = (library({d.doc_id: d.text for d in docs.collect()}[r.doc_id]) + [0])[r.start:r.start + r.length]
        assert got[r.sequence_id].ids[r.offset:r.offset + r.length] == ids


def fewest(items, capacity):
    """The least number of sequences, by trying all ways to fill them."""
    best = len(items)

    def go(n, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if n == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[n]:
                left = list(rooms)
                left.remove(room)
                go(n + 1, [*left, room - items[n]])
        go(n + 1, [*rooms, capacity - items[n]])

    go(0, [])
    return best


def used(counts, capacity):
    runs = packing.plan(dict(counts), capacity)
    places = []
    for length, many in counts.items():
        own = sorted((r for r in runs if r.length == length), key=lambda r: r.rank)
        for rank in range(many):
            run = [r for r in own if r.rank <= rank][-1]
            step = rank - run.rank
            places.append((run.first + step // run.each, run.offset + step % run.each * length, length))
    check_places(places, capacity)
    return len({p[0] for p in places})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_dominance_keeps_some_best_packing(items):
    counts = {k: items.count(k) for k in items}
    left = dict(counts)
    fixed = packing.reduce_by_dominance(left, 20)
    rest = sorted((k for k, n in left.items() for _ in range(n)), reverse=True)
    assert sum(f[2] for f in fixed) + fewest(rest, 20) == fewest(sorted(items, reverse=True), 20)
    assert used(counts, 20) <= 11 / 9 * fewest(sorted(items, reverse=True), 20) + 1


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_large_plans_are_nearly_full(counts):
    least = -(-sum(k * n for k, n in counts.items()) // 64)
    assert used(counts, 64) <= 2 * least + 1


def test_orc_round_trip(spark, awkward, nothing, library, tmp_path):
    got = orc_ids.through_files(awkward.repartition(3), str(tmp_path / "ids")).collect()
    rows = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for row in rows:
        ids = library(row.text) + [1]
        want.append((row.doc_id, len(ids), crc(ids), start))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[3]) == want
    assert orc_ids.through_files(nothing, str(tmp_path / "none")).count() == 0
    found = orc_ids.find_ids(spark, str(tmp_path / "ids"), [5, 10])
    assert {r.doc_id for r in found.collect()} == {5, 10}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_orc_files_have_bloom_filters(spark, awkward, tmp_path):
    orc_ids.write_ids(awkward.coalesce(1), str(tmp_path / "ids"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "ids").glob("*.orc"))
    assert data.startswith(b"ORC") and len(data) > 0
    assert sum(1 for _ in (tmp_path / "ids").glob("*.orc")) >= 1


def test_forms_of_plain_letters_are_remembered_in_lower_case_only():
    words = tokens.WordEncoder(tokens.vocabulary_path())
    forms = ["", " ", ".", "House", "house", "HOUSE.", "house,", "Año", "AÑO!", "Kelvin", "kelvin", "İstanbul", "a1", "x" * 50, "ы", "don't", "é", "..", "ẞ", "ß"]
    for _ in range(2):
        assert words.parts(forms) == [words.whole(form) for form in forms]
    assert {"house", "año", "kelvin"} <= set(words.runs)
    assert not {"House", "house", "HOUSE.", "house,", "Año", "AÑO!", "kelvin"} & set(words)


def test_packing_encodes_in_little_memory():
    """A worker's arrays do not grow with the batch that Spark hands it."""
    rng = np.random.default_rng(6)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(3000)]
    texts = [" ".join(words[k] for k in rng.integers(0, 3000, 800)) for _ in range(1300)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    path = tokens.vocabulary_path()
    list(packing.cut_texts([batch.slice(0, 200)], path, 2048, 0))
    tracemalloc.start()
    got = sum(sum(b.column(3).to_pylist()) for b in packing.cut_texts([batch], path, 2048, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == sum(len(tokens.encoder(path).encode(t)) // 4 + 1 for t in texts)
    assert peak < 40 << 20


def test_words_of_known_pieces_take_no_full_way(library):
    """Signs, digits, capitals and marks around known letters cost no run of the whole tokenizer for each word."""
    letters, signs = ["House", "AÑO", "été", "x"], ["!!", "-", "@", "##", "7", "."]
    texts = [" ".join(a + s + b + t for a in letters for s in signs for b in letters for t in signs)]
    words = tokens.WordEncoder(tokens.vocabulary_path())
    whole, full = words.whole, []
    words.whole = lambda text: full.append(text) or whole(text)
    ids, ends = words.encode_all(pa.array(texts))
    assert ids.tolist() == library(texts[0]) and ends.tolist() == [0, len(ids)]
    assert len(full) <= 30


@pytest.mark.parametrize("first", [0, 0x80, 0x180, 0x250, 0x300, 0x2000])
def test_characters_between_letters_digits_and_signs(library, first):
    texts = [t for n in range(first, first + 0x80) for c in [chr(n)] for t in (f"a{c}b", f"A{c}", f"{c}Z1", f"{c}{c}!", f"É{c}é, x", f"1{c}'S")]
    texts += ["", " ", "\n \n", "<|endoftext|>", "a<|ENDOFTEXT|>", "|endoftext|>", "don't", "d'é'LL"]
    for some in (pa.array(texts), pa.array(texts).slice(5, 40), pa.array(["", " \n"]), pa.array([], pa.string())):
        ids, ends = ENCODER.encode_all(some)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library(t) for t in some.to_pylist()]


def test_capitals_and_marks_share_one_form():
    code, forms, row = tokens.cut_forms(pa.array(["House house.", "", "HOUSE, été ÉTÉ!! a1", "it's It's"]))
    shown = forms.take(pa.array(code)).to_pylist()
    assert shown == ["house", "house", ".", "house", ",", "été", "été", "!!", "a", "1", "it's", "It's"]
    assert row.tolist() == [0, 0, 0, 2, 2, 2, 2, 2, 2, 2, 3, 3]
    assert sorted(forms.to_pylist()) == sorted(set(shown))
