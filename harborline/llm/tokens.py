"""Token ids of whole texts, word by word with a bounded memory of the words seen before."""

from __future__ import annotations

import string
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from harborline.llm.words import buffers_of, coded, edges, lower_table, spread

VOCABULARY = "word_bpe_49k.json"
# Forms and lower-case letter runs that one Python worker remembers, and the longest; none changes a result.
MEMORY_FORMS = 100_000
MEMORY_RUNS = 500_000
LONGEST_REMEMBERED = 32
# Below this all letters are their own NFC form and have simple lower-case forms.
PLAIN_LETTERS_END = "ɐ"
MARKS = ".,;:!?"
# What each byte is, in words of which no byte is ODD: <, apostrophes, controls and most characters beyond ASCII are.
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)
LATIN = 0xC3  # first byte of À to ÿ, which are letters but × and ÷
KIND = np.full(256, ODD, "u1")
KIND[list(b" \n")] = BLANK
KIND[[*(string.ascii_letters.encode()), LATIN]] = LETTER
KIND[list(string.digits.encode())] = DIGIT
KIND[[n for n in string.punctuation.encode() if n not in b"<'"]] = SIGN
KIND_SECOND = np.full(256, ODD, "u1")
KIND_SECOND[[n for n in range(0x80, 0xC0) if n not in (0x97, 0xB7)]] = LETTER
LOWER = lower_table()
LOWER_SECOND = np.array([n + 32 if KIND_SECOND[n] == LETTER and n < 0x9F else n for n in range(256)], "u1")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Maps a word to the bytes of its ids (little-endian, unsigned, 32 bits).

    The vocabulary's pre-tokenizer drops white space and never joins what stands on both sides of it, so the
    ids of a text are those of its words, one after the other. A run of letters is one pre-token and goes
    straight to the model; closing punctuation is a pre-token of its own. Everything else takes the full way.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The model's letters for the bytes of each character that lower-case plain letters may have.
        small = {c for n in range(0x80, ord(PLAIN_LETTERS_END)) for c in chr(n).lower()}
        self.shown = {ord(c): to_bytes.pre_tokenize_str(c)[0][0] for c in small}
        self.earlier: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.marks = {mark: self.whole(mark) for mark in MARKS}

    def __missing__(self, word: str) -> bytes:
        found = self.earlier.get(word)
        if found is None:
            found = self.find(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= MEMORY_FORMS:
                # Frequent words come back from here one by one.
                self.earlier = dict(self)
                self.clear()
            self[word] = found
        return found

    def find(self, word: str) -> bytes:
        if not word:
            return b""
        mark = self.marks.get(word[-1])
        letters = word[:-1] if mark else word
        if not letters.isalpha() or max(letters) >= PLAIN_LETTERS_END:
            return self.whole(word)
        found = self.run(letters.lower())
        if found is None:
            return self.whole(word)
        return found + mark if mark else found

    def run(self, small: str) -> bytes | None:
        """The ids of lower-case plain letters; nothing, if some have no simple lower case."""
        found = self.runs.get(small)
        if found is None:
            if not small.isalpha():
                return None
            shown = small if small.isascii() else small.translate(self.shown)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(small) <= LONGEST_REMEMBERED:
                if len(self.runs) >= MEMORY_RUNS:
                    self.runs.clear()
                self.runs[small] = found
        return found

    def parts(self, forms: list[str]) -> list[bytes]:
        """The ids of each form. Runs of plain letters are remembered in lower case only, with or without a mark; other forms as they are."""
        marks, out = self.marks, []
        for word in forms:
            mark = marks.get(word[-1:])
            letters = word[:-1] if mark else word
            found = self.run(letters.lower()) if letters.isalpha() and (letters.isascii() or max(letters) < PLAIN_LETTERS_END) else None
            if found is None:
                out.append(self[word])
            else:
                out.append(found + mark if mark else found)
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one after the other, and where each text's begin and end. Each distinct word is looked up once."""
        code, forms, row = cut_forms(texts)
        shown = forms.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.runs.get, shown))
        missing = [n for n, found in enumerate(parts) if found is None]
        for n, found in zip(missing, self.parts([shown[n] for n in missing])):
            parts[n] = found
        ids, upto = spread(parts, code)
        return ids, upto[np.searchsorted(row, np.arange(len(texts) + 1))]


def cut_forms(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """The words of ``texts`` (no nulls) as places in the distinct forms, the forms, and each word's row.

    A word of letters up to ÿ, digits and signs alone is cut where the pre-tokenizer cuts it (into letters that stand
    together, single digits, and signs that stand together) and shown in lower case. All other words are as they stand.
    """
    data, ends = buffers_of(texts)
    second = np.flatnonzero(data[:-1] == LATIN) + 1
    shown = data.tobytes()
    kind, small = (np.frombuffer(bytearray(shown.translate(table)), "u1") for table in (KIND.tobytes(), LOWER.tobytes()))
    kind[second], small[second] = KIND_SECOND[data[second]], LOWER_SECOND[data[second]]
    word = kind != BLANK
    starts, stops, _ = edges(word, ends)
    plain = np.ones(len(starts), bool)
    plain[np.searchsorted(starts, np.flatnonzero(kind == ODD), "right") - 1] = False
    # A word and the blanks after it are treated alike.
    plain = np.repeat(np.append(False, plain), np.diff(starts, prepend=0, append=len(data)))
    cut = plain & (kind == DIGIT)
    cut[1:] |= plain[1:] & (kind[1:] != kind[:-1])
    starts, stops, row = edges(word, ends, cut)
    return *coded(np.where(plain, small, data)[word], starts, stops), row


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder in each Python worker; it lives as long as the worker."""
    return WordEncoder(path)
