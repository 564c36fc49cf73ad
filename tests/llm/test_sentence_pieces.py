"""The agenda of symbol pairs against the sentencepiece library and against merging by brute force."""

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from harborline.llm import queries, sentence_pieces

AGENDA = sentence_pieces.Agenda(sentence_pieces.model_path())
LIBRARY = AGENDA.library


def ids_of(agenda, *texts):
    ids, ends = agenda.encode(pa.array(texts, pa.string()))
    lists = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    return lists if len(texts) > 1 else lists[0]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("aeinrst AEé.,'\n\t\0▁_-<>/s0x1 ", max_size=60))
def test_agenda_equals_library(text):
    assert ids_of(AGENDA, text) == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(" aé▁.", max_size=9), min_size=2, max_size=9))
def test_texts_side_by_side(texts):
    assert ids_of(AGENDA, *texts) == LIBRARY.encode(texts)
    got, ends = sentence_pieces.with_ends(*AGENDA.encode(pa.array(texts)), [1], [2])
    library = LIBRARY.encode(texts, add_bos=True, add_eos=True)
    assert sentence_pieces.same_lists(got, ends, library) == [True] * len(texts)
    assert sentence_pieces.same_lists(got, ends, [[*library[0], 3], *library[1:]])[:2] == [False, True]


def by_scanning(text):
    """Merges without an agenda: the best pair of all, leftmost first, again and again."""
    symbols = list(text)
    while True:
        pairs = [(AGENDA.place[a + b], n) for n, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in AGENDA.place]
        if not pairs:
            return symbols
        n = min(pairs)[1]
        symbols[n:n + 2] = [symbols[n] + symbols[n + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text("aeinrst▁_-=", max_size=40))
def test_agenda_equals_scanning(text):
    assert AGENDA.merge(text) == by_scanning(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aeinrst▁_-=\nÉ北\0", min_size=1, max_size=32), min_size=1, max_size=20))
def test_side_by_side_equals_one_by_one(segments):
    assert AGENDA.merge_all(segments) == [AGENDA.ids_of(AGENDA.merge(s)) for s in segments]


def test_long_runs_and_forgetting(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MEMORY", 2)
    small = sentence_pieces.Agenda(sentence_pieces.model_path())
    for text in ["a" * 5000, " " * 700, "=" * 999 + " x", "words of a text, and words again " * 50, "▁" * 33]:
        assert ids_of(small, text) == LIBRARY.encode(text)


def test_other_models_are_refused(tmp_path):
    # Field 2 (trainer) with model type 1.
    (tmp_path / "other.model").write_bytes(AGENDA.proto + b"\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        sentence_pieces.Agenda(str(tmp_path / "other.model"))


def expected(text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest(), True


def test_digests_of_awkward_rows(awkward):
    got = sentence_pieces.digests(awkward)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    want = [(r.doc_id, *expected(r.text)) for r in awkward.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_ids_and_texts(spark):
    docs = spark.createDataFrame([(1, " two  spaces "), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in sentence_pieces.decode(sentence_pieces.encode(docs, begin=False, check=False)).collect()}
    assert rows[1].ids == LIBRARY.encode(" two  spaces ", add_eos=True) and rows[1].text == " two  spaces " and rows[1].agrees is None
    assert rows[2].ids == [2] and rows[2].text == ""


def test_nothing_to_encode(nothing):
    assert sentence_pieces.digests(nothing).count() == 0


def test_query_over_a_table(spark):
    got = queries.op12_sentence_pieces(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, *expected(r.text)) for r in docs.collect())
