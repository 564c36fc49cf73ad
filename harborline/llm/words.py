"""Words of a whole batch of texts at once, as numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WORD, BLANK, BREAK = range(3)


class Words(NamedTuple):
    """The words of the texts in order: ``code`` (place in ``forms``), ``row`` of the text, ``opens`` at the first word of a piece."""

    code: np.ndarray
    forms: pa.StringArray
    row: np.ndarray
    opens: np.ndarray


def byte_table(blanks: bytes, breaks: bytes) -> np.ndarray:
    """What each byte is: part of a word, a blank between words, or a break between pieces."""
    table = np.full(256, WORD, "u1")
    table[list(blanks)] = BLANK
    table[list(breaks)] = BREAK
    return table


def lower_table() -> np.ndarray:
    """Each byte in lower case, A to Z only."""
    return np.frombuffer(bytes(range(256)).lower(), "u1")


def buffers_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``texts`` (no nulls, less than 2 GB) side by side, and where each text begins and ends."""
    ends = np.frombuffer(texts.buffers()[1], "i4")[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", "u1")[ends[0]:ends[-1]], ends - ends[0]


def edges(word: np.ndarray, ends: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and the row of its text. ``word`` tells the bytes of words, ``cut`` before which of them another begins."""
    inside = np.zeros(len(word) + 2, bool)
    inside[1:-1] = word
    # Texts stand side by side in the buffer, so a word also starts and ends where its text does.
    edge = np.zeros(len(word) + 1, bool)
    if cut is not None:
        edge[:-1] = cut
    edge[ends] = True
    starts = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    stops = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
    return starts, stops, np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(starts, ends)))


def coded(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """Each word's place among the distinct forms, and the forms; ``data`` has the bytes of the words alone."""
    cuts = np.zeros(len(starts) + 1, "i4")
    np.cumsum(stops - starts, out=cuts[1:])
    found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return found.indices.to_numpy().astype("i8"), found.dictionary


def cut_words(texts: pa.StringArray, table: np.ndarray, shown: np.ndarray | None = None) -> Words:
    """All words of ``texts`` (no nulls, less than 2 GB), cut at the bytes that ``table`` names; ``shown`` maps their bytes."""
    data, ends = buffers_of(texts)
    kind = table[data]
    word = kind == WORD
    starts, stops, row = edges(word, ends)
    opens = np.ones(len(starts), bool)
    opens[1:] = row[1:] != row[:-1]
    if (table == BREAK).any():
        broken = np.concatenate([[0], np.cumsum(kind == BREAK)])[starts]
        opens[1:] |= broken[1:] != broken[:-1]
    data = data[word]
    code, forms = coded(data if shown is None else shown[data], starts, stops)
    return Words(code, forms, row, opens)


def by_bytes(batches: Iterable[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text (one row at least)."""
    held, waiting = 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(np.frombuffer(batch.column(text).buffers()[1], "i4")[batch.column(text).offset:][:batch.num_rows + 1]).astype("i8")
        upto, first = np.cumsum(lengths), 0
        while first < batch.num_rows:
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + size - held, "right")))
            waiting.append(batch.slice(first, last - first))
            held += int(upto[last - 1] - before)
            first = last
            if held >= size or first < batch.num_rows:
                yield together(waiting)
                held, waiting = 0, []
    if waiting:
        yield together(waiting)


def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.record_batch([pa.concat_arrays([b.column(n) for b in batches]) for n in range(batches[0].num_columns)], names=batches[0].schema.names)


def spread(parts: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (four bytes each) of ``parts[code[0]]``, ``parts[code[1]]``, ... one after the other, and where each begins and ends."""
    size = np.fromiter(map(len, parts), "i8", len(parts)) // 4
    start = np.concatenate([[0], np.cumsum(size)])
    upto = np.concatenate([[0], np.cumsum(size[code])])
    places = np.arange(upto[-1]) + np.repeat(start[code] - upto[:-1], size[code])
    return np.frombuffer(b"".join(parts), "<i4")[places], upto


def with_ends(ids: np.ndarray, ends: np.ndarray, head: list[int], tail: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same lists of ids (list n from ``ends[n]`` to ``ends[n + 1]``) with ``head`` before and ``tail`` after each."""
    both, rows = np.array([*tail, *head], "i4"), len(ends) - 1
    between = np.repeat(ends[1:-1], len(both))
    middle = np.insert(ids, between, np.tile(both, max(rows - 1, 0)))
    more = np.arange(rows + 1) * len(both)
    return np.concatenate([head if rows else [], middle, tail if rows else []]).astype("i4"), ends + more
