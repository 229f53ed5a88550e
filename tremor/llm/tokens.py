"""Ids of whole texts from a tokenizer file, remembering what chunks between spaces became.

The library alone takes a microsecond a character.  Both supported splitting rules never let a
piece reach across the left edge of a run of spaces, so a text may be cut there, and its ids
are those of its chunks.  Chunks repeat, so each worker keeps the ids of those it has met, up
to a bound on entries.  A chunk of plain Latin characters is split by the tokenizer file's own
rule, written out below for these characters, and its pieces go to the library's model; any
other chunk goes through the whole library.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Bound on the length of what is remembered.
LONGEST = 48


@dataclass(frozen=True)
class Memory:
    """Bounds on the chunks and pieces that a worker remembers.  Results are the same under any; an entry takes some 200 bytes."""

    chunks: int
    pieces: int


# For a job that only encodes, and for one stage among others that share an executor.
AMPLE = Memory(2_000_000, 700_000)
MODEST = Memory(120_000, 80_000)

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile("[\\x20-\\x7e\\n" + _LETTERS + "]*")
# White space other than a space, before one.
_ASCII_UNEVEN, _OTHER_UNEVEN = ([chr(c) + " " for c in codes if chr(c).isspace()] for codes in (range(128), range(128, 0x3001)))
_EDGE = re.compile(r"(?<=\S)(?= )")
_MARKS = set(",.;:!?")
# The splitting rules of the two files, for plain characters.
_RULES = {
    "word": re.compile("'s|'t|'re|'ve|'m|'ll|'d|[" + _LETTERS + "]+|[0-9]|[^\\s" + _LETTERS + "0-9]+"),
    "byte": re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[" + _LETTERS + "]+| ?[0-9]+| ?[^\\s" + _LETTERS
                       + "0-9]+|\\s+(?!\\S)|\\s+"),
}


def uneven(text: str) -> bool:
    """Whether some run of white space isn't one space between two other characters, or ends in another one than a space."""
    if text[0] == " " or text[-1] == " " or any(x in text for x in _ASCII_UNEVEN):
        return True
    return not text.isascii() and any(x in text for x in _OTHER_UNEVEN)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """Key -> its ids, as a pair of generations: a full young one becomes the old one.

    What is used again moves back into the young one, so frequent keys stay.
    """

    def __init__(self, bound: int, make):
        self.bound, self.make, self.old = bound // 2, make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Encodes texts with one tokenizer file; the ids come as unsigned little-endian 32-bit bytes.

    Special strings in a text are ordinary text.  Null counts as empty.
    """

    def __init__(self, path: str, memory: Memory = MODEST):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.letters = _byte_letters()
        self.drops_spaces = getattr(self.model, "end_of_word_suffix", None) == "</w>"
        self.rule = self._rule()
        self.lower = self.drops_spaces
        self.pieces = Memo(memory.pieces, self.piece_ids)
        self.head = Memo(memory.chunks // 8, self.chunk_ids)
        self.inner = Memo(memory.chunks, self.chunk_ids if self.drops_spaces else lambda chunk: self.chunk_ids(" " + chunk))

    def _rule(self):
        """The written-out rule, or none if the file is of another kind than the two that are known.

        Read from the parts of the loaded tokenizer, which hold no vocabulary.
        """
        told = lambda part: None if part is None else json.loads(part.__getstate__())
        steps = told(self.library.pre_tokenizer) or {}
        kinds = [s["type"] for s in steps.get("pretokenizers", [steps])]
        if self.drops_spaces and kinds == ["Split", "ByteLevel"]:
            return _RULES["word"]
        if kinds == ["ByteLevel"] and self.library.normalizer is None and not steps.get("add_prefix_space"):
            return _RULES["byte"]
        return None

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunk_ids(self, chunk: str) -> bytes:
        # A word, or a word and one mark: most chunks, and no rule is needed to tell their pieces.
        if self.drops_spaces and chunk.isascii():
            # Words are chunks themselves here, and remembered as such.
            if chunk.isalpha():
                low = chunk.lower()
                return self.piece_ids(low) if low == chunk else self.inner[low]
            if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
                return self.inner[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        elif chunk.isascii():
            word = chunk.lstrip(" ")
            if len(chunk) - len(word) <= 1:
                if word.isalpha():
                    return self.pieces[chunk]
                if word[-1:] in _MARKS and word[:-1].isalpha():
                    return self.pieces[chunk[:-1]] + self.pieces[chunk[-1]]
        if _PLAIN.fullmatch(chunk) is None:
            return self.whole(chunk)
        if self.lower:
            chunk = chunk.lower()
        return b"".join(map(self.pieces.__getitem__, self.rule.findall(chunk)))

    def piece_ids(self, piece: str) -> bytes:
        if piece.isascii():  # plain, so only the two that aren't shown as themselves are rewritten
            written = piece.replace(" ", self.letters[32]).replace("\n", self.letters[10])
        else:
            written = piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [token.id for token in self.model.tokenize(written)])
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()

    def chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Keys into ``head`` and ``inner``, in order."""
        if self.drops_spaces:
            return [], text.split(" ")
        if not uneven(text):
            first, *rest = text.split(" ")
            return [first], rest
        return _EDGE.split(text), []

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.rule is None:
            return self.whole(text)
        first, rest = self.chunks(text)
        return b"".join([*map(self.head.__getitem__, first), *map(self.inner.__getitem__, rest)])


@lru_cache(maxsize=2)
def encoder(path: str, memory: Memory = MODEST) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path, memory)
