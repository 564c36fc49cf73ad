"""The main text of web pages, by what a page does not share with the page of the nearest URL.

A page is cut into lines, one per block of its markup. Within a host, pages are ordered by their URL path. Consecutive pages of equal content are copies
and say nothing about the frame, so they are taken together, and each page is compared with the nearest page of other content on
either side. Of the two, the one whose path has the longest common start decides: their lines are aligned by longest common subsequence, and the lines
that both have are the site's frame and go. Where it shares nearly everything and the other side does not, it is taken for a copy with small changes, and the other decides.

Two things are settled by the markup itself: what stands in an article or main element is content, also where another page
repeats it, and what stands in menus, headers, footers, sidebars, notices, adverts, forms and comments goes also where no other page has it.
All other lines, also those of a page that has an article, are decided by the comparison alone.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby
from operator import itemgetter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harborline.llm.common import on_workers

# Keys of pages that are brought to the driver to cut the order into blocks (up to twice as many), and how many of them make a block.
SAMPLE_KEYS = 16_384
KEYS_PER_BLOCK = 16
# Of a page's text, the share of characters above which the page on the other side is preferred.
COPY_SHARE = 0.8
BATCH_CHARS = 8 << 20
# Cells of the alignment table that is held at once; it changes no length.
LARGEST_TABLE = 4_000_000

# Element names of HTML, and words that sites use for parts that are not content.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
FRAME = set("aside button datalist dialog footer form head header iframe menu nav object select textarea title".split())
CONTENT = {"article", "main"}
FRAME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|masthead|menu|modal|navbar|navigation|nav|newsletter|"
    r"notice|notification|popup|promo\w*|related|replies|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>script|style|noscript|template|svg|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*|[^>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARK = re.compile(r"\b(?:class|id|role)\Z", re.I)


def marks(rest: str) -> str:
    """The values of class, id and role among a start tag's attributes."""
    if "=" not in rest:
        return ""
    return " ".join(value for name, *values in ATTRIBUTE.findall(rest) if MARK.search(name) and (value := next(filter(None, values), "")))


@lru_cache(10_000)
def inside(name: str, marked: str) -> str:
    """What an element's name and marks make of its inside: f for frame, c for content, empty for what is around it."""
    if name in CONTENT:
        return "c"
    return "f" if name in FRAME or (name not in ("html", "body") and FRAME_WORDS.search(marked)) else ""


def lines(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of every block that has text, in page order. Zone: c in content, f in the frame, u undecided."""
    found: list[tuple[str, str]] = []
    page, held, at = page or "", [], 0
    open_elements: list[tuple[str, str]] = [("", "u")]

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            found.append((open_elements[-1][1], text))

    for token in TOKEN.finditer(page):
        if token.start() > at:
            held.append(page[at:token.start()])
        at = token.end()
        name = token["name"]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            close()
        if token["end"]:
            for n in range(len(open_elements) - 1, 0, -1):
                if open_elements[n][0] == name:
                    del open_elements[n:]
                    break
        elif name not in VOID and not token["rest"].endswith("/"):
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_elements[-1][0] == name:
                open_elements.pop()
            if name in BLOCKS or name in FRAME:
                zone, wanted = open_elements[-1][1], inside(name, marks(token["rest"]))
                open_elements.append((name, wanted if wanted == "f" or (wanted and zone != "f") else zone))
    held.append(page[at:])
    close()
    return found


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Numbers of my lines in a longest common subsequence with the other's."""
    start = 0
    while start < min(len(mine), len(other)) and mine[start] == other[start]:
        start += 1
    end = 0
    while end < min(len(mine), len(other)) - start and mine[-1 - end] == other[-1 - end]:
        end += 1
    shared = {*range(start), *range(len(mine) - end, len(mine))}
    known = set(other[start:len(other) - end])
    # Only lines that both have can be shared.
    left = [n for n in range(start, len(mine) - end) if mine[n] in known]
    number: dict[str, int] = {}
    x = [number.setdefault(mine[n], len(number)) for n in left]
    y = [number[t] for t in other[start:len(other) - end] if t in number]
    return shared | {left[n] for n in longest_common(x, y)}


def longest_common(x: list[int], y: list[int]) -> list[int]:
    """Places in ``x`` of a longest common subsequence.

    Beyond LARGEST_TABLE cells, ``x`` is halved and ``y`` cut where the halves have most in common (Hirschberg), so memory stays linear.
    """
    if len(x) < 2 or len(x) * len(y) <= LARGEST_TABLE:
        return from_table(x, y)
    half, all_y = len(x) // 2, np.array(y, np.int64)
    upto = common_lengths(x[:half], all_y)
    since = common_lengths(x[:half - 1:-1], all_y[::-1])
    at = int((upto + since[::-1]).argmax())
    return longest_common(x[:half], y[:at]) + [half + n for n in longest_common(x[half:], y[at:])]


def common_lengths(x: list[int], y: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of ``x`` and each start of ``y``."""
    row = np.zeros(len(y) + 1, np.int64)
    for value in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == value, row[:-1] + 1, 0)))
    return row


def from_table(x: list[int], y: list[int]) -> list[int]:
    table = [[0] * (len(y) + 1)]
    for value in x:
        row, above = [0], table[-1]
        for j, other in enumerate(y):
            row.append(above[j] + 1 if other == value else max(above[j + 1], row[j]))
        table.append(row)
    found = []
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1] and table[i][j] == table[i - 1][j - 1] + 1:
            found.append(i - 1)
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def against(page: list[tuple[str, str]], other: list[tuple[str, str]]) -> tuple[set[int], float]:
    """Numbers of the undecided lines that ``other`` shares outside its content, and the share of the page's text that it has."""
    undecided = [n for n, (zone, _) in enumerate(page) if zone == "u"]
    shared = {undecided[n] for n in shared_lines([page[n][1] for n in undecided], [text for zone, text in other if zone != "c"])}
    known = {text for _, text in other}
    had = sum(len(text) for n, (zone, text) in enumerate(page) if n in shared or (zone == "c" and text in known))
    return shared, had / max(1, sum(len(text) for zone, text in page if zone != "f"))


def main_text(page: list[tuple[str, str]], compared: list[tuple[set[int], float]]) -> str:
    """The content of ``page`` and its undecided lines that are no frame, by its comparisons with pages of other content, nearest first.

    The first page that has at most COPY_SHARE of the text decides, else the first that does not have all of it. A page that has nothing of its own next
    to two pages is frame where both agree; next to a single one it may as well be a part of it, and stays.
    """
    partial = sorted((c for c in compared if c[1] < 1), key=lambda c: c[1] > COPY_SHARE)
    frame = partial[0][0] if partial else set.intersection(*[shared for shared, _ in compared]) if len(compared) > 1 else set()
    return "\n".join(text for n, (zone, text) in enumerate(page) if zone != "f" and n not in frame)


def content_digest(page: list[tuple[str, str]]) -> bytes:
    """Equal for pages that differ at most in marked frame; empty for a page that has nothing else."""
    own = packed([line for line in page if line[0] != "f"])
    return blake2b(own.encode("utf-8", "surrogatepass"), digest_size=16).digest() if own else b""


class Run:
    """Consecutive pages of a host that have the same content; they share their comparisons."""

    def __init__(self, place: tuple, path: str, page: str) -> None:
        self.place, self.path, self.page = place, path, page
        self.last_path, self.last_page = path, page
        self.rows: list[tuple] = []  # path, page_id, url

    def texts(self, before: Run | None, after: Run | None) -> Iterator[tuple]:
        """page_id, url and text of each page; ``before`` and ``after`` are the nearest pages of other content."""
        page = unpacked(self.page)
        sides = [(before.last_path, before.last_page)] if before else []
        sides += [(after.path, after.page)] if after else []
        compared = [against(page, unpacked(other)) for _, other in sides]
        known: dict[tuple[int, ...], str] = {}
        for path, page_id, url in self.rows:
            order = tuple(sorted(range(len(sides)), key=lambda n: -len(commonprefix([sides[n][0], path]))))
            if order not in known:
                known[order] = main_text(page, [compared[n] for n in order])
            yield page_id, url, known[order]


def packed(page: list[tuple[str, str]]) -> str:
    return "\n".join(zone + text for zone, text in page)


def unpacked(page: str) -> list[tuple[str, str]]:
    return [(line[0], line[1:]) for line in page.split("\n")] if page else []


def ends_of(rows: Iterable[tuple]) -> list[tuple[tuple, tuple]]:
    """First and last row of the first two and the last two runs of equal host and digest; ``rows``: host, path, number, digest."""
    kept: list[tuple[tuple, tuple]] = []
    for row in rows:
        if kept and (kept[-1][1][0], kept[-1][1][3]) == (row[0], row[3]):
            kept[-1] = (kept[-1][0], row)
        else:
            kept.append((row, row))
            if len(kept) > 4:
                del kept[2]
    return kept


def borders(runs: dict[int, list[tuple[tuple, tuple]]]) -> dict[tuple, list[int]]:
    """The rows that other blocks need, with those blocks: the nearest of the same host and other content before and after each block."""
    def other(mine: tuple, following: Iterable[tuple]) -> tuple | None:
        found = next((row for row in following if (row[0], row[3]) != (mine[0], mine[3])), None)
        return found if found and found[0] == mine[0] else None

    copies: dict[tuple, list[int]] = {}
    order = sorted(runs)
    for n, block in enumerate(order):
        after = (first for b in order[n + 1:] for first, _ in runs[b][:2])
        before = (last for b in reversed(order[:n]) for _, last in reversed(runs[b][-2:]))
        for row in (other(runs[block][-1][1], after), other(runs[block][0][0], before)):
            if row:
                copies.setdefault(row, []).append(block)
    return copies


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    Null html has no text. Pages without a URL are one host. Rows that tie in URL and id go by their lines. Pages are compared inside blocks of the order
    of (host, path, id), which are cut at a hashed sample of the keys; a host may fill any number of blocks. The nearest pages of other content beyond a cut
    are copied into the block, so the cuts change no result; finding them takes one more pass over the pages.
    """
    on_workers(pages.sparkSession)
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    keyed = pages.select(host.alias("host"), path.alias("path"), F.coalesce("page_id", F.lit(-1)).alias("number"), "page_id", "url", "html")
    key = ["host", "path", "number"]
    every = max(1, pages.count() // SAMPLE_KEYS)
    sample = keyed.where(F.pmod(F.xxhash64(*key), F.lit(every)) == 0).select(*key).distinct().collect()
    cuts = sorted(tuple(r) for r in sample)[KEYS_PER_BLOCK::KEYS_PER_BLOCK]

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [bisect_right(cuts, k) for k in zip(*(batch.column(n).to_pylist() for n in range(3)))]
            found = [content_digest(lines(page.as_py())) for page in batch.column(5)]
            yield pa.record_batch([pa.array(blocks, pa.int32()), *batch.columns[:3], pa.array(found, pa.binary())], names=["block", *key, "digest"])

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((row[0], row[1:]) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)) if row[-1])
        for block, of_block in groupby(rows, itemgetter(0)):
            kept = ends_of(row for _, row in of_block)
            columns = [[block] * len(kept), list(range(len(kept))), *zip(*[(*first, *last[1:3]) for first, last in kept])]
            types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, types)], names=["block", "nth", *key, "digest", "last_path", "last_number"])

    copies: dict[tuple, list[int]] = {}
    if cuts:
        narrow = keyed.mapInArrow(digests, "block int, host string, path string, number bigint, digest binary")
        narrow = narrow.repartition("block").sortWithinPartitions("block", *key, "digest")
        # Four runs of each block come to the driver at most.
        found = narrow.mapInArrow(ends, "block int, nth int, host string, path string, number bigint, digest binary, last_path string, last_number bigint").collect()
        runs: dict[int, list[tuple]] = {}
        for block, _, host_, path_, number, digest, last_path, last_number in sorted(found):
            digest = bytes(digest)
            runs.setdefault(block, []).append(((host_, path_, number, digest), (host_, last_path, last_number, digest)))
        copies = borders(runs)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in range(3))))
            found = [lines(page.as_py()) for page in batch.column(5)]
            held = [content_digest(page) for page in found]
            places = [(n, bisect_right(cuts, k), False) for n, k in enumerate(keys)]
            places += [(n, block, True) for n, k in enumerate(keys) for block in copies.get((*k, held[n]), ())]
            at = pa.array([n for n, _, _ in places], pa.int64())
            columns = [*batch.columns[:5], pa.array(held, pa.binary()), pa.array(map(packed, found), pa.string())]
            yield pa.record_batch(
                [pa.array([b for _, b, _ in places], pa.int32()), *[c.take(at) for c in columns], pa.array([c for _, _, c in places], pa.bool_())],
                names=["block", "host", "path", "number", "page_id", "url", "digest", "lines", "copied"],
            )

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        before, run = None, None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (0, 1, 2, 4, 5, 6)]
            for block, host, path, page_id, url, digest, page, copied in zip(*columns, batch.column(7), batch.column(8).to_pylist()):
                if not digest:
                    yield page_id, url, ""
                    continue
                place = (block, host, digest)
                if run is None or run.place != place:
                    following = Run(place, path, page.as_py())
                    if run is not None:
                        yield from run.texts(before, following if run.place[:2] == place[:2] else None)
                        before = run if run.place[:2] == place[:2] else None
                        run.rows = []
                    run = following
                run.last_path, run.last_page = path, page.as_py()
                if not copied:
                    run.rows.append((path, page_id, url))
        if run is not None:
            yield from run.texts(before, None)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for page_id, url, text in texts(batches):
            out.append((page_id, url, text, len(text)))
            held += len(text) + 100
            if held >= BATCH_CHARS:
                yield as_batch(out)
                out, held = [], 0
        if out:
            yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64()))
        return pa.record_batch([pa.array(c, k) for c, k in kinds], names=["page_id", "url", "text", "n_chars"])

    cut_pages = keyed.mapInArrow(cut, "block int, host string, path string, number bigint, page_id bigint, url string, digest binary, lines string, copied boolean")
    ordered = cut_pages.repartition("block").sortWithinPartitions("block", *key, "digest", "lines")
    return ordered.mapInArrow(compare, "page_id bigint, url string, text string, n_chars bigint")

