"""Runs from suffix trees against runs by brute force."""

import re
import zlib
from hashlib import sha256

import numpy as np
from hypothesis import given, settings, strategies as st

from harborline.llm import queries, repetition, suffix_trees


def every_run(words, least):
    """Runs by trying all periods."""
    found, n = set(), len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, 2 * p):
                part = words[i:i + length]
                if not any(all(part[x] == part[x + q] for x in range(length - q)) for q in range(1, p)):
                    found.add((i, length, p))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


@st.composite
def repetitive(draw):
    words = draw(st.lists(st.sampled_from("abc"), max_size=12)) * draw(st.integers(1, 5))
    return words + draw(st.lists(st.sampled_from("abcd"), max_size=20)) + words[: draw(st.integers(0, 20))]


@settings(max_examples=500, deadline=None)
@given(repetitive(), st.sampled_from([2, 5, 12]))
def test_runs_equal_brute_force(words, least):
    got = repetition.runs_in([w.encode() for w in words], least)
    assert [tuple(r) for r in got.tolist()] == every_run(words, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=80))
def test_common_starts(symbols):
    tree, text = suffix_trees.SuffixTree([*symbols, -1]), [*symbols, -1]
    assert np.argsort(tree.rank).tolist() == sorted(range(len(text)), key=lambda n: text[n:])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(text)), np.arange(len(text))))
    a, b = a[a != b], b[a != b]
    want = [next(k for k in range(len(text)) if text[x + k:x + k + 1] != text[y + k:y + k + 1]) for x, y in zip(a, b)]
    assert tree.common(a, b).tolist() == want


def test_minimum_of_any_stretch():
    values = np.random.default_rng(3).integers(0, 1000, 700).astype("i4")
    minimum = suffix_trees.RangeMinimum(values)
    first, last = np.triu_indices(700)
    want = np.minimum.accumulate(np.where(np.tri(700, 700, -1, bool), 2000, values), axis=1)[first, last]
    assert (minimum.query(first, last) == want).all()


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = every_run(words, 12)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(((-r[1], r[0], r[2]) for r in runs), default=None)
    told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return doc_id, len(runs), *told, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest(), len(words)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]


def compare(docs, got):
    assert got.columns == COLUMNS
    want = sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_awkward_rows(awkward):
    # The longest text, one word 30 000 times, is left to the test of long runs: brute force takes too long.
    compare(awkward.where("length(text) < 10000 OR text IS NULL"), repetition.digests(awkward.where("length(text) < 10000 OR text IS NULL")))


def test_long_runs(spark):
    docs = spark.createDataFrame([(1, "long " * 30_000), (3, "a b c " * 5_000 + "x\x1cy z " * 4)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repetition.find_runs(docs).collect()}
    assert [tuple(r) for r in rows[1].runs] == [(0, 30_000, 1)] and rows[1].collapsed == "long"
    # Only blanks, tabs and line ends part words.
    assert [tuple(r) for r in rows[3].runs] == [(0, 15_000, 3)] and rows[3].n_words == 15_004


def test_planted_runs_are_found(spark):
    some = [n for n in range(200) if zlib.crc32(str(n).encode()) % 10 == 0]
    docs = spark.createDataFrame([(n, " ".join(f"w{n}_{i}" for i in range(100 + n))) for n in [*some, 1]], "doc_id long, text string")
    compare(docs, repetition.digests(docs))


def test_nothing_to_search(nothing):
    assert repetition.digests(nothing).count() == 0


def test_query_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000 OR text IS NULL")
    got = queries.op11_word_runs(spark, "/root/testdata/sf0.001")
    compare(docs, got.join(docs.select("doc_id"), "doc_id", "left_semi"))
