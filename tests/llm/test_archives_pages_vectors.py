"""Archives, page texts, vectors and the pipeline against brute force."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from harborline.llm import archives, html_text, vantage


def page(body, host="a.org", path="/x"):
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a = '<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
        f"<div class='ad'>Buy now</div>{body}<footer>&copy; {host}</footer></body></html>"
    )


@pytest.fixture
def pages(spark):
    big = page("<article><h1>T</h1><p>" + "words &amp; more " * 100 + "</p></article>")
    rows = [
        (1, "http://a.org/1", big), (2, "http://a.org/2", big), (3, None, None), (4, "http://b.org/a b", ""), (5, "http://b.org/é", "<p>short"),
        (6, "http://c.org/", big), (6, "http://c.org/", big), (None, "http://d.org/", "<article>no id</article>"), (8, "http://a.org/8", "é" * 600 + "\r\n\r\nWARC/1.1\r\n" * 3),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows


def test_archives_round_trip(spark, pages, monkeypatch, tmp_path):
    table, rows = pages
    for size in (16 << 20, 2000):
        monkeypatch.setattr(archives, "ARCHIVE_BYTES", size)
        got = sorted((tuple(r) for r in archives.through_archives(table.coalesce(2)).collect()), key=repr)
        want = []
        largest = {}
        for page_id, _, text in rows:
            largest[text] = max(largest.get(text, -1), page_id or -1)
        first = set()
        for page_id, _, text in rows:
            data = (text or "").encode()
            again = len(data) >= 1000 and (page_id != largest[text] or page_id in first)
            first.add(page_id)
            want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[text] if again else None))
        assert got == sorted(want, key=repr)
    assert archives.through_archives(table.where("false")).count() == 0


def test_arc_versions():
    for version, line in ((1, "http://x/ 1.2.3.4 20200102030405 text/html 5"), (2, "http://x/ 1.2.3.4 20200102030405 text/html 200 - - 0 f.arc 5")):
        body = f"{version} 0 Any\n{archives.ARC_FIELDS[version]}\n"
        head = "filedesc://f.arc 0.0.0.0 20200102030405 text/plain " + ("200 - - 0 f.arc " if version == 2 else "") + str(len(body))
        found = list(archives.parse_arc(f"{head}\n{body}\n{line}\nab\ncd\n".encode()))
        assert [(f["URL"], b) for _, f, b in found][1:] == [("http://x/", b"ab\ncd")] and found[1][1]["Archive-date"] == "20200102030405"
    assert archives.iso("20200102030405") == "2020-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        list(archives.parse_arc(b"http://x/ 1.2.3.4 20200102030405 text/html 50\nshort\n"))


def test_page_texts(spark):
    article = "<article class='has-comments'><header>By A</header><h1>Ti&amp;tle</h1><p>One\n  two<br>three<p>Foúr &lt;b&gt; <b>bold</b></p><!-- <p>no</p> --><section class='comments'><p>first!</p></section></article>"
    rows = [(n, f"http://a.org/p/{n}?q={n}", page(article.replace("One", f"One{n}"))) for n in range(5)]
    rows += [(10 + n, f"http://b.org/{n}", page(f"<div><p>Only here {n}</p><p>And there {n}</p></div><div><p>Always the same line</p></div>")) for n in range(4)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://c.org/", "<p class='a>b'>plain &#233;</p><form><p>no</p></form>"), (23, "http://c.org/z", "<article>cut <b>off")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in html_text.extract(table).collect()}
    for n in range(5):
        assert got[n].text == f"Ti&tle\nOne{n} two three\nFoúr <b> bold"
    for n in range(4):
        assert got[10 + n].text == f"Only here {n}\nAnd there {n}"
    assert (got[20].text, got[21].text, got[22].text, got[23].text) == ("", "", "plain é", "cut off")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(table.where("false")).count() == 0


def test_pages_with_an_article_are_compared_too(spark):
    def body(n):
        return f"<div>The slogan</div><div><p>Story {n} in a plain block</p></div><article><p>Teaser</p></article><div>Elsewhere</div>"

    rows = [(n, f"http://a.org/p/{n}", page(body(n))) for n in range(3)] + [(9, "http://alone.org/", page(body(9)))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[n] for n in range(3)] == [f"Story {n} in a plain block\nTeaser" for n in range(3)]
    assert got[9] == "The slogan\nStory 9 in a plain block\nTeaser\nElsewhere"


def test_copies_and_heavy_frames(spark):
    frame = "".join(f"<div>Part {n} of a heavy template that every page of the site has</div>" for n in range(9))
    story = {n: f"<div>Story {n} that is told on one page alone, at some length</div>" for n in range(9)}
    bodies = [story[0], *[story[1]] * 7, "", story[2]]
    rows = [(n, f"http://copies.org/{n}", page(f"<div>Slogan</div>{body}<div class=ad>{n}</div>") if body else None) for n, body in enumerate(bodies)]
    rows += [(100 + n, f"http://heavy.org/{n}", page(f"{frame}<div>Note {n}</div>")) for n in range(3)]
    # A near copy on one side, another story on the other.
    rows += [(200 + n, f"http://near.org/{n}", page(f"<div>Slogan</div>{story[s]}<div>{n} views</div>")) for n, s in enumerate((3, 3, 4))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    told = {n: story[n][5:-6] for n in story}
    assert [got[n] for n in range(10)] == [told[0], *[told[1]] * 7, "", told[2]]
    assert [got[100 + n] for n in range(3)] == [f"Note {n}" for n in range(3)]
    assert got[201] == f"{told[3]}\n1 views" and got[202] == f"{told[4]}\n2 views"


def test_cuts_change_no_page_text(spark, monkeypatch):
    def body(host, n):
        story = 7 if host == "b.org" and 3 <= n < 15 else n
        return f"<div>The slogan of {host}</div><div>Story {story} of {host}, told at some length</div>" if n % 5 != 4 or story == 7 else None

    rows = [(100 * h + n, f"http://{host}/{n:02}", body(host, n)) for h, host in enumerate(("a.org", "b.org", "c.org")) for n in range(20)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = []
    for keys in (1, 3, 16, 1000):
        monkeypatch.setattr(html_text, "KEYS_PER_BLOCK", keys)
        found.append(sorted((r.page_id, r.text) for r in html_text.extract(table).collect()))
    assert all(f == found[0] for f in found) and len(found[0]) == len(rows)
    assert [text for _, text in found[0]] == ["" if html is None else html[html.index("Story"):-6] for _, _, html in rows]


def test_marks_stand_anywhere_in_a_tag():
    for long in ("style='" + "margin:0;" * 100 + "'", 'data-x="' + "y" * 493 + '"', "srcset=\"" + "/a?id=banner 2x, " * 60 + '"'):
        for mark in ("class='teaser ad'", "id=sidebar", 'ROLE = "banner"', "class='" + "plain " * 200 + "cookie'"):
            assert html_text.lines(f"<div {long} {mark}>frame</div><p>text") == [("f", "frame"), ("u", "text")]
        # Words inside another attribute's value say nothing.
        assert html_text.lines(f"<div {long} class=story hidden>text</div>") == [("u", "text")]


def test_longest_common_lines(monkeypatch):
    rng = np.random.default_rng(2)

    def longest(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        return table[-1, -1]

    for _ in range(200):
        a, b = (["abcdef"[i] for i in rng.integers(0, 6, rng.integers(0, 12))] for _ in range(2))
        shared = html_text.shared_lines(a, b)
        assert len(shared) == longest(a, b)
        rest = iter(b)
        assert all(a[n] in rest for n in sorted(shared))
    monkeypatch.setattr(html_text, "LARGEST_TABLE", -1)
    for _ in range(100):
        a, b = ([str(i) for i in rng.permutation(12)] for _ in range(2))
        assert len(html_text.shared_lines(a, b)) == longest(a, b)


def test_repeated_lines_of_long_pages(monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [[["abcd"[i] for i in rng.integers(0, 4, rng.integers(0, 25))] for _ in range(2)] for _ in range(200)] + [[["b", "a"], ["a", "b", "a"]]]
    exact = [len(html_text.shared_lines(a, b)) for a, b in pairs]
    for cells in (-1, 20, 100):
        monkeypatch.setattr(html_text, "LARGEST_TABLE", cells)
        for (a, b), length in zip(pairs, exact):
            shared = html_text.shared_lines(a, b)
            rest = iter(b)
            assert len(shared) == length and all(a[n] in rest for n in sorted(shared))
    assert exact[-1] == 2


def vectors(spark, n=700, size=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=size)]) for i in range(n)]
    rows[40:60] = [(i, rows[7][1]) for i in range(40, 60)]
    return rows, lambda more=(): spark.createDataFrame([*rows, *more], "vec_id bigint, embedding array<float>")


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    found = {}
    for q in sorted(set(ids[ids % 20 == 0])):
        score = np.einsum("ij,j->i", x, x[np.flatnonzero(ids == q)[0]])
        score[ids == q] = -np.inf
        order = np.lexsort((ids, -score))[:k]
        found[int(q)] = [int(ids[n]) for n in order if score[n] > -np.inf]
    return found


def test_factor_one_is_exact(spark):
    rows, table = vectors(spark)
    odd = [(901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (None, [1.0] * 16), rows[3], (920, [float("inf")] * 16)]
    got = {}
    for r in sorted(vantage.nearest(table(odd), factor=1.0, shard_rows=200).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    assert got == brute(rows)


def test_few_rows(spark):
    rows, _ = vectors(spark, 70)
    table = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.rank) for r in vantage.nearest(table).collect()] == [(0, 1), (0, 2)]
    assert vantage.nearest(table.where("false")).count() == 0


def test_recall_of_the_production_factor(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows)
    got = {}
    for r in vantage.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.95


def test_pruning_and_recall_of_one_tree():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 16))).astype(np.float32)
    ids = np.arange(4000)
    tree = vantage.build(ids, x)
    exact, _ = vantage.search(tree, ids[:50], x[:50], 20, 1.0)
    relaxed, _ = vantage.search(tree, ids[:50], x[:50], 20, 1.5)
    score = x[:50].astype(float) @ x.T.astype(float)
    score[np.arange(50), np.arange(50)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert all(set(a) == set(b) for a, b in zip(exact, best))
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(relaxed, best)]) >= 0.9


def test_pipeline_stages(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() > 0 and docs.dropDuplicates(["doc_id"]).join(before, "doc_id", "left_anti").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(r.doc_id for r in docs.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, "/root/testdata/sf0.001").columns == awkward.columns
