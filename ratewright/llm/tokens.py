"""Ids of whole texts by a tokenizer file of the ``tokenizers`` library.

Two kinds are read: byte-level BPE (the space before a word belongs to it) and BPE with word ends (lower case, white
space dropped). Both split their input at a single space between two other characters whatever surrounds it, so a text
is cut there and each chunk is encoded once and remembered, and so is each piece the tokenizer splits a chunk into: the library's
model merges a piece it has not seen, and a dictionary lookup answers for the others (bounded: half of what is remembered is forgotten
when it is full). A run of spaces is one chunk with what precedes it.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex

#: What the two kinds of tokenizer files match before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_ENDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

MOST_CHUNKS, MOST_PIECES = 700_000, 200_000
LONGEST_KEPT = 100
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
#: Letters that lower-casing and composing treat one by one.
PLAIN_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,])?").fullmatch
#: A space inside a run of white space, where a cut before the space would split the run.
INSIDE_RUN = re.compile(r"\s \s|\s \Z")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


class _Remembered(dict):
    """Ids (bytes, unsigned 16 or 32 bits each) by chunk. When full, all chunks become old ones; those asked for again are kept."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class TextEncoder:
    """``encode(text)``: the ids of a whole text as packed unsigned integers of type ``dtype``."""

    def __init__(self, path: str, remembered: tuple[int, int] = (MOST_CHUNKS, MOST_PIECES)):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.model = tokenizer.model
        self.normalizer = tokenizer.normalizer
        self.spaced = self.normalizer is None
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pattern = regex.compile(BYTE_LEVEL if self.spaced else WORD_ENDS)
        self.letters = byte_letters()
        chunks, pieces = remembered
        self.pieces = _Remembered(self._merge, pieces)
        self.first = _Remembered(self._chunk, chunks)
        self.later = _Remembered(lambda chunk: self._chunk(" " + chunk), chunks) if self.spaced else self.first

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, from those of its pieces; a word with a mark or none after it needs no pattern search.

        Words are remembered as chunks, so only other pieces take a place among the pieces.
        """
        plain = PLAIN_WORD(chunk)
        if plain:
            word, mark = plain.groups()
            if not self.spaced:
                word = word.lower()
            if word == chunk:
                return self._merge(word)
            ids = self.later[word[1:]] if word[0] == " " else self.first[word]
            return ids + self.pieces[mark] if mark else ids
        if not self.spaced:
            chunk = chunk.lower() if chunk.isascii() else self.normalizer.normalize_str(chunk)
        return b"".join([self.pieces[piece] for piece in self.pattern.findall(chunk)])

    def _merge(self, piece: str) -> bytes:
        spelled = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array(self.code, [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.spaced:
            return b"".join(map(self.first.__getitem__, text.split(" ")))
        chunks = BETWEEN_WORDS.split(text) if INSIDE_RUN.search(text) else text.split(" ")
        head = self.first[chunks[0]]
        return head + b"".join(map(self.later.__getitem__, chunks[1:])) if len(chunks) > 1 else head
