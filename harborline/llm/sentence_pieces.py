"""Encoding and decoding with merge-type SentencePiece models: an agenda of adjacent symbol pairs, best score first.

The vocabulary is read from the model file itself. The agenda holds every adjacent pair whose concatenation is a
piece; the pair with the best score (ties: leftmost) merges, and the merged symbol meets its neighbours on the agenda,
until it is empty. Every Arrow batch is then encoded by the sentencepiece library too, and each row says if they agree.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from harborline.llm.common import on_workers
from harborline.llm.words import by_bytes, spread, with_ends

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Characters of segments that one Python worker remembers; forgetting them changes no result.
MEMORY = 4_000_000
# Segments of up to so many characters merge side by side, in tables of these widths; longer ones by themselves.
WIDTHS = (8, 12, 16, 24, 32)
# Bytes of text that are encoded and checked together.
CHUNK_BYTES = 2 << 20
NO_PLACE = np.iinfo("i4").max

# Field numbers and types of the public model format.
MODEL_PIECES, MODEL_TRAINER, MODEL_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TRAINER_MODEL_TYPE, TRAINER_SPACE_AS_SUFFIX = 3, 24
NORMALIZER_CHARACTERS, NORMALIZER_SPACE_IN_FRONT, NORMALIZER_SQUEEZE, NORMALIZER_ESCAPE = 2, 3, 4, 5
MERGE_MODEL = 2
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6

ENCODED = "doc_id bigint, ids array<int>, agrees boolean"


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """The (field number, value) pairs of one message of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at:at + size]
            at += size


class Agenda:
    """Encoder of one merge-type model."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.proto = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        byte_ids, trainer, normalizer, self.unknown, n = {}, {}, {}, 0, 0
        for field, value in fields(memoryview(self.proto)):
            if field == MODEL_PIECES:
                piece = dict(fields(value))
                text, kind = bytes(piece[PIECE_TEXT]).decode(), piece.get(PIECE_TYPE, NORMAL)
                if kind == BYTE:
                    byte_ids[int(text[1:-1], 16)] = n
                elif kind == UNKNOWN:
                    self.unknown = n
                elif kind in (USER_DEFINED, UNUSED):
                    raise ValueError("models with user-defined or unused pieces are not supported")
                elif kind == NORMAL:
                    self.ids[text], scores[text] = n, struct.unpack("<f", piece.get(PIECE_SCORE, bytes(4)))[0]
                n += 1
            elif field == MODEL_TRAINER:
                trainer = dict(fields(value))
            elif field == MODEL_NORMALIZER:
                normalizer = dict(fields(value))
        if trainer.get(TRAINER_MODEL_TYPE) != MERGE_MODEL:
            raise ValueError("the agenda is for merge-type models")
        # Pieces of equal score share a place in the order, best first.
        order = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.place = {text: order[score] for text, score in scores.items()}
        self.byte_ids = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        # Only what plain models do is done here; other normalizers are the library's.
        self.plain = (
            not normalizer.get(NORMALIZER_CHARACTERS) and not trainer.get(TRAINER_SPACE_AS_SUFFIX)
            and normalizer.get(NORMALIZER_SPACE_IN_FRONT, 1) and not normalizer.get(NORMALIZER_SQUEEZE, 1) and normalizer.get(NORMALIZER_ESCAPE, 1)
        )
        # Only where a piece has a space after another character do pairs cross from one word to the next.
        self.joined_words = any(b == SPACE != a for piece in self.ids for a, b in zip(piece, piece[1:]))
        self.seen: dict[str, bytes] = {}
        self.held = 0
        self.number_symbols()

    def number_symbols(self) -> None:
        """Numbers for pieces and for characters inside them, and a sorted table of the pairs that make a piece."""
        self.symbols = [*self.ids, *sorted({c for piece in self.ids for c in piece} - self.ids.keys())]
        number = {symbol: n for n, symbol in enumerate(self.symbols)}
        self.character = np.arange(-1, -1 - 0x110000, -1, "i4")
        for symbol, n in number.items():
            if len(symbol) == 1:
                self.character[ord(symbol)] = n
        made = [
            (self.key(number[piece[:n]], number[piece[n:]]), number[piece], self.place[piece])
            for piece in self.ids for n in range(1, len(piece)) if piece[:n] in number and piece[n:] in number
        ]
        self.pair_keys, self.pair_pieces, self.pair_places = (np.array(c) for c in zip(*sorted(made)))
        self.pair_places = self.pair_places.astype("i4")
        # The id of each symbol, or -1 where the characters' bytes stand for it.
        self.symbol_ids = np.array([self.ids.get(symbol, -1) for symbol in self.symbols], "i8")

    def key(self, left, right):
        """One number for a pair of symbols; characters outside the vocabulary (negative) have no pairs."""
        if isinstance(left, int):
            return (left + 1) * (len(self.symbols) + 1) + right + 1
        return (np.maximum(left, -1).astype("i8") + 1) * (len(self.symbols) + 1) + np.maximum(right, -1) + 1

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the pair table and whether the pairs are in it."""
        keys = self.key(left, right)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return at, self.pair_keys[at] == keys

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, found = self.look_up(left, right)
        return np.where(found, self.pair_places[at], NO_PLACE)

    def normalize(self, texts: pa.StringArray) -> pa.StringArray:
        """The texts as the model sees them, with blanks in place of its space sign."""
        if self.plain:
            shown = pc.replace_substring(texts, SPACE, " ")
            return pc.if_else(pc.equal(shown, ""), "", pc.binary_join_element_wise(" ", shown, ""))
        return pa.array([self.library.normalize(t).replace(SPACE, " ") for t in texts.to_pylist()], pa.string())

    def cut(self, texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts, each a run of blanks with what follows, and how many of them end with each text."""
        ends = np.frombuffer(texts.buffers()[1], "i4")[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", "u1")[ends[0]:ends[-1]]
        ends = ends - ends[0]
        first = np.zeros(len(data) + 1, bool)
        if not self.joined_words:
            blank = data == ord(" ")
            first[:-1] = blank
            first[1:-1] &= ~blank[:-1]
        first[ends] = True
        starts = np.flatnonzero(first)
        segments = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts.astype("i4")), pa.py_buffer(data)])
        return segments, np.searchsorted(starts, ends)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one after the other, and where each text's end, from 0; without begin and end ids."""
        segments, ends = self.cut(self.normalize(texts))
        coded = segments.dictionary_encode()
        distinct, code = [s.replace(" ", SPACE) for s in coded.dictionary.to_pylist()], coded.indices.to_numpy()
        if self.held > MEMORY:
            self.seen, self.held = {}, 0
        fresh = list(set(distinct).difference(self.seen))
        self.seen.update(zip(fresh, self.merge_all(fresh)))
        self.held += sum(map(len, fresh))
        ids, upto = spread([self.seen[s] for s in distinct], code)
        return ids, upto[ends]

    def ids_of(self, symbols: list[str]) -> bytes:
        ids = []
        for symbol in symbols:
            known = self.ids.get(symbol)
            if known is not None:
                ids.append(known)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in symbol.encode()]
            else:
                ids.append(self.unknown)
        return array("I", ids).tobytes()

    def merge_all(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment."""
        if not segments:
            return []
        found = np.empty(len(segments), object)
        table = np.searchsorted(WIDTHS, np.fromiter(map(len, segments), "i8", len(segments)))
        for n, width in enumerate((*WIDTHS, 0)):
            places = np.flatnonzero(table == n)
            some = [segments[at] for at in places]
            if some:
                found[places] = self.merge_side_by_side(some, width) if width else [self.ids_of(self.merge(s)) for s in some]
        return found.tolist()

    def merge_side_by_side(self, segments: list[str], width: int) -> list[bytes]:
        """The ids of short segments: each row of ``agenda`` has the score order of one segment's adjacent pairs, and all
        rows merge their best pair (ties: the leftmost) at the same time until no row has one."""
        left = np.fromiter(map(len, segments), "i8", len(segments))
        symbols = self.character[np.array(segments, f"U{width}").view("u4").reshape(-1, width)]
        columns = np.arange(width)
        agenda = self.places(symbols[:, :-1], symbols[:, 1:])
        agenda[columns[1:] >= left[:, None]] = NO_PLACE
        # One column more, so that every symbol has a pair with what follows.
        agenda = np.concatenate([agenda, np.full((len(agenda), 1), NO_PLACE, "i4")], axis=1)
        final, open_ = np.empty_like(symbols), np.arange(len(segments))
        while len(open_):
            best = agenda.argmin(axis=1)
            going = agenda[np.arange(len(open_)), best] != NO_PLACE
            final[open_[~going]] = symbols[~going]
            open_, symbols, agenda, best = open_[going], symbols[going], agenda[going], best[going]
            rows = np.arange(len(open_))
            at, _ = self.look_up(symbols[rows, best], symbols[rows, best + 1])
            # What follows the pair moves one place to the left.
            moved = np.minimum(columns + (columns > best[:, None]), width - 1)
            symbols, agenda = np.take_along_axis(symbols, moved, axis=1), np.take_along_axis(agenda, moved, axis=1)
            symbols[rows, best] = self.pair_pieces[at]
            left[open_] -= 1
            follows = best + 1 < left[open_]
            after = self.places(symbols[rows, best], symbols[rows, np.minimum(best + 1, width - 1)])
            agenda[rows, best] = np.where(follows, after, NO_PLACE)
            led = np.flatnonzero(best)
            agenda[led, best[led] - 1] = self.places(symbols[led, best[led] - 1], symbols[led, best[led]])
        kept = columns < left[:, None]
        ids = np.where(final >= 0, self.symbol_ids[np.maximum(final, 0)], -1)
        flat, ends = ids[kept].astype("<u4").tobytes(), (np.cumsum(left) * 4).tolist()
        found = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for n in np.flatnonzero((kept & (ids < 0)).any(axis=1)).tolist():
            found[n] = self.ids_of([self.symbols[s] if s >= 0 else chr(-1 - s) for s in final[n, :left[n]].tolist()])
        return found

    def merge(self, text: str) -> list[str]:
        """The symbols of ``text`` that are left when the agenda is empty."""
        place, end = self.place.get, len(text)
        # The place in the score order of each symbol's pair with the next one; none if no piece, or if the symbol is gone.
        pairs = [*map(place, map(add, text, text[1:])), None]
        # Agenda entries order by the pair's place, then by position.
        agenda = [p * end + n for n, p in enumerate(pairs) if p is not None]
        symbols, before, after = list(text), list(range(-1, end)), list(range(1, end + 1))
        heapify(agenda)
        while agenda:
            first, left = divmod(heappop(agenda), end)
            if pairs[left] != first:
                continue
            right = after[left]
            merged = symbols[left] = symbols[left] + symbols[right]
            symbols[right] = pairs[right] = None
            right = after[left] = after[right]
            if right < end:
                before[right] = left
                first = pairs[left] = place(merged + symbols[right])
                if first is not None:
                    heappush(agenda, first * end + left)
            else:
                pairs[left] = None
            left = before[left]
            if left >= 0:
                first = pairs[left] = place(symbols[left] + merged)
                if first is not None:
                    heappush(agenda, first * end + left)
        return [s for s in symbols if s]


@cache
def agenda(path: str) -> Agenda:
    """One encoder in each Python worker; it lives as long as the worker."""
    return Agenda(path)


def encode(docs: DataFrame, model: str | None = None, begin: bool = True, end: bool = True, check: bool = True) -> DataFrame:
    """The ids of every whole text of ``docs`` (doc_id, text): doc_id, ids, agrees.

    ``agrees`` says if the sentencepiece library gives the same ids; without ``check`` it is null. A null text is an
    empty one and has the begin and end ids only. Rows stay as they are, also repeated ones and those with a null
    id; other columns are left out; an empty table gives no rows.
    """
    on_workers(docs.sparkSession)
    model = model or model_path()
    return texts_of(docs).mapInArrow(lambda batches: encode_batches(batches, model, begin, end, check), ENCODED)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """The texts of ``rows`` (doc_id, ids, agrees) by the library's decode: doc_id, ids, agrees, text.

    Control ids vanish, bytes that are no UTF-8 become U+FFFD; null ids are no ids and give an empty text.
    """
    on_workers(rows.sparkSession)
    model = model or model_path()
    return rows.select("doc_id", "ids", "agrees").mapInArrow(lambda batches: decode_batches(batches, model), f"{ENCODED}, text string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """What encoding and decoding give for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, agrees.

    The same as ``decode(encode(docs))`` with digests in place of ids and texts, in one pass, so that ids stay in the task.
    """
    on_workers(docs.sparkSession)
    model = model or model_path()

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return hash_batches(decode_batches(encode_batches(batches, model), model))

    return texts_of(docs).mapInArrow(told, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")


def encode_batches(batches: Iterable[pa.RecordBatch], model: str, begin: bool = True, end: bool = True, check: bool = True) -> Iterator[pa.RecordBatch]:
    own = agenda(model)
    head, tail = [own.library.bos_id()] * begin, [own.library.eos_id()] * end
    for batch in by_bytes(batches, 1, CHUNK_BYTES):
        texts = batch.column(1).fill_null("")
        ids, ends = with_ends(*own.encode(texts), head, tail)
        agrees = pa.nulls(len(texts), pa.bool_())
        if check:
            library = own.library.encode(texts.to_pylist(), out_type=int, add_bos=begin, add_eos=end, num_threads=1)
            agrees = pa.array(same_lists(ids, ends, library))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(ids))
        yield pa.record_batch([batch.column(0), lists, agrees], names=["doc_id", "ids", "agrees"])


def decode_batches(batches: Iterable[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    library = agenda(model).library
    for batch in batches:
        ids = batch.column(1)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
        valid = ids.is_valid().to_pylist()
        texts = library.decode([flat[a:b].tolist() if known else [] for a, b, known in zip(ends, ends[1:], valid)], num_threads=1)
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "agrees", "text"])


def hash_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        hashes = [sha256(np.ascontiguousarray(flat[a:b], "<u4")).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
        texts = [sha256(text.encode()).hexdigest() for text in batch.column(3).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array(np.diff(ends).astype("i8")), pa.array(hashes), pa.array(texts), batch.column(2)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"],
        )


def same_lists(ids: np.ndarray, ends: np.ndarray, lists: list[list[int]]) -> list[bool]:
    data = ids.tobytes()
    return [data[4 * a:4 * b] == array("i", theirs).tobytes() for a, b, theirs in zip(ends.tolist(), ends[1:].tolist(), lists)]
