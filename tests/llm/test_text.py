"""Mixing, chat rendering, winnowing, near copies and toxicity against brute force."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from harborline.llm import chat, mixing, near_dups, toxicity, winnowing
from harborline.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == columns
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


def mixed_in_sql(docs):
    con = duckdb.connect()
    con.register("rows", docs.toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM rows")
    return Counter(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({SQL['op4_source_mixing']})").fetchall())


def test_mixing_awkward_rows(awkward, nothing):
    got = Counter(tuple(r) for r in mixing.mix(awkward).collect())
    assert got == mixed_in_sql(awkward)
    assert mixing.mix(nothing).count() == 0
    kept = mixing.apply_mix(awkward)
    assert kept.columns == awkward.columns and mixing.apply_mix(nothing).count() == 0
    assert kept.where("doc_id in (2, 3, 4)").count() == 3  # no words: kept once


def test_mixing_a_hot_source(spark):
    rows = [(n, "w " * (1 + n * 7 % 50), "hot" if n % 3 else f"s{n % 4}") for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r, (_, _, source) in zip(sorted(got), rows):
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        target[source] = r.target
    assert all(abs(taken[s] - target[s]) <= 110 for s in target)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.apply_mix(docs).select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(taken.values())


def test_chat_by_hand(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello é"), (1, 130, "user", None), (2, 0, "system", "x"), (3, None, None, "")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, p, n) for p in ("user", "assistant") for n in (0, 2)} | {(3, "unknown", -1)}
    mine = got[1, "user", 0]
    assert mine.rendered == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=assistant\nHello é<|im_end|>\n"
    )
    start, end = map(int, mine.mask.split("-"))
    assert mine.rendered[start:end] == "Hi<|im_end|>\n" and mine.trained_chars == end - start
    assert got[1, "assistant", 2].mask == "" and got[1, "assistant", 2].rendered == "<|im_start|>user name=user\n<|im_end|>\n"
    assert got[3, "unknown", -1].rendered == "<|im_start|>assistant\n<|im_end|>\n"
    assert chat.rotate(turns.where("false")).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def winnowed(text):
    words = [w for w in (text or "").lower().replace("\n", " ").split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def run(part):
        seed = 42
        for h in part:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return signed(seed) >> 24

    runs = [run(hashes[n:n + 5]) for n in range(max(len(hashes) - 4, 1))] if hashes else []
    chosen = []
    for n in range(max(len(runs) - 3, 1) if runs else 0):
        window = runs[n:n + 4]
        at = n + max(i for i, h in enumerate(window) if h == min(window))
        if at not in chosen:
            chosen.append(at)
    return [(runs[n], n) for n in chosen]


def test_winnowing_against_brute_force(spark, awkward):
    rng = random.Random(3)
    texts = [r.text for r in awkward.collect()] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(30)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id bigint, text string")
    for r in winnowing.fingerprints(docs).collect():
        assert list(zip(r.hashes, r.positions)) == winnowed(texts[r.doc_id]), texts[r.doc_id]


def test_edited_texts_and_neighbours(spark, awkward, nothing):
    docs = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    for block_rows in (1, 3, 500):
        got = {r.doc_id: r for r in winnowing.compare_with_next(docs, block_rows).collect()}
        assert len(got) == len(rows)
        for n, row in enumerate(rows):
            text, following = row.text or "", rows[(n + 1) % len(rows)].text or ""
            third = len(text) // 3
            changed = text[:len(text) - third] + following[:third]
            mine = got[row.doc_id]
            assert mine.edited_sha256 == __import__("hashlib").sha256(changed.encode()).hexdigest()
            sets = [{h for h, _ in winnowed(t)} for t in (text, changed, following)]
            for other, value in zip(sets[1:], (mine.near_edited, mine.near_next)):
                either = len(sets[0] | other)
                assert value == pytest.approx(len(sets[0] & other) / either if either else 1.0)
    assert winnowing.compare_with_next(nothing).count() == 0
    assert winnowing.compare_with_next(awkward, 2).count() == awkward.count()


def alike(a, b):
    x, y = (Counter(tuple(w[n:n + 5]) for n in range(max(len(w) - 4, 1))) for w in (a.lower().split(), b.lower().split()))
    shared, either = x.keys() & y.keys(), x.keys() | y.keys()
    inner = {(p, q): sum(max(x[e] / p, y[e] / q) for e in either) for p, q in {(x[d], y[d]) for d in shared}}
    return sum(1 / inner[x[d], y[d]] for d in shared)


@pytest.fixture(scope="module")
def copies(spark):
    """Texts with a large group of near copies, chains of them, exact copies and unrelated ones."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for n in range(60):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(text))
    chain = [rng.choice(words) for _ in range(100)]
    for n in range(12):
        texts.append(" ".join(chain))
        chain[n * 8] = rng.choice(words)
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += ["Same  words of one text", "same words\nof one text", "", None, " "]
    return spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id bigint, text string"), texts


def test_near_copies_against_all_pairs(copies, monkeypatch):
    docs, texts = copies
    monkeypatch.setattr(near_dups, "BLOCK", 7)  # large groups are searched in many blocks
    root = list(range(len(texts)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(texts):
        for j in range(i):
            if a and a.split() and texts[j] and texts[j].split() and find(i) != find(j) and alike(a, texts[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    assert got == {n: find(n) for n in range(len(texts))}


def test_near_copies_of_awkward_rows(awkward, nothing):
    got = near_dups.near_duplicates(awkward)
    assert got.count() == awkward.count() and near_dups.near_duplicates(nothing).count() == 0
    kept = near_dups.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1
    assert near_dups.keep_one(nothing).count() == 0


def test_signatures_estimate_the_similarity():
    rng = random.Random(1)
    gaps = []
    for _ in range(150):
        a = [rng.choice("abcdefgh") for _ in range(60)]
        b = list(a)
        for _ in range(6):
            b[rng.randrange(60)] = rng.choice("abcdefgh")
        x, y = near_dups.shingles(a), near_dups.shingles(b)
        exact = near_dups.similarity(x, y)
        assert exact == pytest.approx(alike(" ".join(a), " ".join(b)))
        s = near_dups.signatures([x, y])
        gaps.append((s[0] == s[1]).mean() - exact)
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.09


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    return docs, spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = toxicity.scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    bad, good = ([r.score for r in rows if r.held_out and r.toxic == t] for t in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.8
    assert np.mean([s < 0.5 for s in good]) > 0.97


def test_every_sentence_takes_part_in_the_fit():
    rng = np.random.default_rng(4)

    def plain():
        return " ".join(["the", "of", "river", "stone", "garden", "window", "paper", "morning", "bread", "table"][i] for i in rng.integers(0, 10, 6))

    def place(sentence):
        return zlib.crc32(sentence.encode())

    texts, toxic = [], []
    while len(texts) < 60:
        said = [plain() for _ in range(40)]
        # The insult is none of the twelve sentences of least crc32.
        if sorted([*said, "zorblak quimmp"], key=place).index("zorblak quimmp") < 12:
            continue
        toxic.append(len(texts) % 2)
        texts.append(". ".join([*said, "zorblak quimmp"] if toxic[-1] else said))
    model = toxicity.fit(texts, np.array(toxic))
    assert ((model.score(texts) >= 0.5) == np.array(toxic)).all()
    bad, good = model.score(["zorblak quimmp", "river stone"])
    assert bad > 0.5 > good


def test_gapped_insults(labelled):
    model = toxicity.fit_on(*labelled)
    bad = ["you are an idiot", "you are an i.d.i.o.t", "such a l-o-s-e-r", "s t u p i d people", "pathetic### trash***", "worthlesss"]
    assert all(model.score(bad) > 0.5) and all(model.score([None, "", " ", "the and of to"]) < 0.5)


def test_toxicity_awkward_rows(spark, awkward, nothing, labelled):
    labels = spark.createDataFrame([(1, 0), (1, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity.scores(awkward, labels)
    assert got.count() == awkward.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.scores(nothing, labels).count() == 0
    assert toxicity.scores(awkward, labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.drop_toxic(awkward, labels.where("false")).collect() == awkward.collect()


def test_forgotten_words_score_the_same(labelled, monkeypatch):
    model = toxicity.fit_on(*labelled)
    texts = [r.text for r in labelled[0].limit(40).collect()]
    want = model.score(texts)
    monkeypatch.setattr(toxicity, "MEMORY_WORDS", 50)
    monkeypatch.setattr(toxicity, "BATCH_TEXTS", 3)
    model.known.clear()
    assert np.allclose(model.score(texts), want)


def kernel_by_hand(a, b):
    """The subsequence kernel of two words over the weights of all their occurrences, to its power, from the subsequences themselves."""
    codes = toxicity.letter_codes()

    def occurrences(word):
        places = [(i, i + first, i + last) for i in range(len(word)) for first, last in toxicity.OFFSETS if i + last < len(word)]
        return [(tuple(codes[ord(word[n])] for n in p), toxicity.DECAY ** (p[2] - p[0] - 2)) for p in places]

    x, y = occurrences(a), occurrences(b)
    lengths = [np.sqrt(sum(w * w for _, w in v)) for v in (x, y)]
    return (sum(v * w for k, v in x for other, w in y if k == other) / (lengths[0] * lengths[1])) ** toxicity.DEGREE


def test_kernel_by_hand():
    words = ["idiot", "idxiot", "idioot", "stupid", "stone", "banana", "anan"]
    got = toxicity.Landmarks(words).kernel(words)
    assert np.allclose(got, [[kernel_by_hand(a, b) for b in words] for a in words], atol=1e-5)


def test_nystrom_features_give_the_kernel_of_landmarks():
    words = ["idiot", "stupid", "stone", "banana", "moron", "river"]
    between = toxicity.Landmarks(words).kernel(words)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    # On the landmarks themselves the approximation is exact.
    assert np.allclose((between @ root) @ (between @ root).T, [[kernel_by_hand(a, b) for b in words] for a in words], atol=1e-5)


def test_the_fit_is_bounded_and_says_when_it_has_nothing(labelled, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, weight: seen.append((texts, toxic)))
    toxicity.fit_on(*labelled, total=20_000)
    texts, toxic = seen[0]
    for c in (0, 1):
        held = [len(t) for t, label in zip(texts, toxic) if label == c]
        assert 0 < sum(held) <= 20_000 and len(held) < (labelled[1].where(f'toxic = {c}').count())
    with pytest.warns(UserWarning, match="no text of one class"):
        toxicity.fit_on(*labelled, chars=0)
