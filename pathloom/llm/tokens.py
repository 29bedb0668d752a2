"""Whole-text token ids by the tokenizers library, remembered word by word.

Both vocabularies split texts at white space before merging, so a text's ids are its pieces' ids in
order. Pieces repeat: each distinct one goes through the library once and is then looked up, once for all
texts of a stretch that Arrow can split. Strings of added tokens inside a text give their ids, as the
library does by default; the text between them is split.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles

#: Unicode White_Space, as the vocabularies' patterns read \\s.
RARE_WHITE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = r"\t\n\x0b\x0c\r " + RARE_WHITE
#: str.split() also splits at these, which are no white space to the vocabularies.
NOT_WHITE = "\x1c\x1d\x1e\x1f"
#: What makes runs of white space of more than two line ends, or with spaces in them, or of other kinds.
UNPLAIN = ("  ", " \n", "\n ", "\n\n\n", "\t", "\r", "\x0b", "\x0c", "\0")
_ODD_WHITE = re.compile(f"[{RARE_WHITE}]")
REMEMBERED = 500_000
LONGEST = 64
#: Bytes of texts split at once; longer texts than the second are split by themselves.
STRETCH, LONG_TEXT = 4 << 20, 64 << 20
#: The rare white space itself: Arrow's regular expressions don't know these escapes.
_RARE = RARE_WHITE.encode().decode("unicode_escape")


#: Letters and other numbers of the first 384 code points, whose Unicode properties never change.
LATIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
STOPS = ",.!?;:"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SIMPLE = re.compile(r"[\x00-\u012f\u0131-\u017f]*\Z")
_MARK = f"[^{WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]"
#: The vocabularies' own splits, for such code points.
_KEEPING = re.compile(f"{ENDINGS}| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+| ?{_MARK}+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_DROPPING = re.compile(f"{ENDINGS}|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|{_MARK}+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()


class Memo(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers, in two generations of at most ``most`` pieces.

    When the young one is full it becomes the old one, and what the old one still held is forgotten.
    """

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.older = {}  # first, so that never more than two are held
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Made once in a worker process; encode() gives the ids of one text as bytes.

    A new piece of plain Latin text is split as the vocabulary splits it and its parts, remembered too, go
    to the library's model; any other piece goes through the library's whole pipeline.
    """

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        # Where white space is dropped a piece is a word; else it is the white space before a word and the word.
        self.drops = not self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.pieces = re.compile(f"[^{WHITE}]+" if self.drops else f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.memo = Memo(self.piece)
        # Added tokens of both vocabularies are taken as they stand, before anything else: the longest first.
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        # What encode_all() leaves to encode(): texts that can't be cut at single characters.
        odd = [f"[{NOT_WHITE}]"] if self.drops else [*UNPLAIN, r"\n\n\z"]
        self.odd = "|".join([*odd, f"[{_RARE}]", *map(re.escape, added)])

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """The vocabulary at path, or the copy of it that Spark brought to this worker."""
        if path not in cls._made:
            here = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
            cls._made = {path: cls(here)}  # one a worker: the memo is the largest thing it holds
        return cls._made[path]

    def ids(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def part(self, part: str) -> bytes:
        return self.ids(part.encode().decode("latin-1").translate(_BYTES))

    def piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if piece.isascii():  # most are one word: no need to split them
            if self.drops:
                if piece.isalpha():
                    return self.ids(piece.lower())
                if piece[:-1].isalpha() and piece[-1] in STOPS:
                    return self.memo[piece[:-1].lower()] + self.memo[piece[-1]]
            elif piece[0] == " " and piece[1:].isalpha():
                return self.ids("\u0120" + piece[1:])
            elif piece[0] == " " and piece[1:-1].isalpha() and piece[-1] in STOPS:
                return self.memo[piece[:-1]] + self.memo[piece[-1]]
        elif not _SIMPLE.match(piece):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        found = _DROPPING.findall(piece.lower()) if self.drops else _KEEPING.findall(piece)
        # A part is a piece of its own: most are words that the memo has already.
        return self.part(found[0]) if len(found) == 1 else b"".join(map(self.memo.__getitem__, found))

    def encode(self, text: str | None) -> bytes:
        if text and any(t in text for t in self.added):
            return b"".join(self.added.get(x) or self.plain(x) for x in self.split(text))
        return self.plain(text)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of each text, in order. A piece met again in a stretch of texts is not looked up again."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(texts):
            reached = int(ends[first - 1]) if first else 0
            stop = max(first + 1, int(np.searchsorted(ends, reached + STRETCH, "right")))
            yield from self.stretch(texts.slice(first, stop - first))
            first = stop

    def stretch(self, texts: pa.Array) -> Iterator[bytes]:
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.greater(pc.binary_length(texts), LONG_TEXT))
        plain = pc.if_else(odd, "", texts)
        if self.drops:
            found = pc.ascii_split_whitespace(plain)
        else:  # as in plain()
            found = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, "\n", "\0\n\0"), " ", "\0 "), "\0")
        pieces = found.values.dictionary_encode()
        ids = self.ids_of(pieces.dictionary).take(pieces.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, dtype=np.int64, count=len(ids) + 1)[found.offsets.to_numpy()].tolist()
        for i, (is_odd, start, end) in enumerate(zip(odd.to_pylist(), at, at[1:])):
            yield self.encode(texts[i].as_py()) if is_odd else data[start:end].to_pybytes() if end > start else b""

    def ids_of(self, pieces: pa.Array) -> pa.Array:
        """The ids of different pieces. A mark that ends a word is a token of its own: the word is looked up without it."""
        ended = pc.match_substring_regex(pieces, f"[A-Za-z][{STOPS}]\\z")
        words = pc.if_else(ended, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        marks = pc.if_else(ended, pc.utf8_slice_codeunits(pieces, -1), "").dictionary_encode()
        found = (pa.array(map(self.memo.__getitem__, x.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary()).take(x.indices) for x in (words, marks))
        return pc.binary_join_element_wise(*found, pa.scalar(b"", pa.large_binary()))

    def plain(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.drops:
            found = self.pieces(text) if any(c in text for c in NOT_WHITE) else text.split()
        elif any(x in text for x in UNPLAIN) or text.endswith("\n\n") or not text.isascii() and _ODD_WHITE.search(text):
            found = self.pieces(text)
        else:  # each white character but the space before a word is a token of its own: cut there
            found = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return b"".join(map(self.memo.__getitem__, found))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
