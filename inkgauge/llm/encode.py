"""Whole texts to token ids with the tokenizers library, remembering what each piece of text gives.

A tokenizer whose normalizer and pre-tokenizer never look across a space gives a text the ids of
its space-separated pieces in a row, so a worker asks the library once for each new piece. That
holds for ``word_bpe_49k.json``: NFC composes nothing with a space, and its pattern has no match
with white space. Special tokens' strings hold no space either and get the ids the library gives.

Its pattern also parts letters from all else, but for contractions after an apostrophe, and it
lowers letters one by one. So a text of Latin-1 characters without apostrophes, none of which NFC
changes, is taken apart into runs of letters, which go straight to the library's model, and runs of
others. Other texts, and other vocabularies, are asked for by whole pieces.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

#: Pieces, and runs, that a worker remembers, twice: the newer half and the half before it.
PIECES, WORDS = 60_000, 300_000
#: Characters worked on at once.
SEGMENT = 1 << 20
VOCABULARY = "word_bpe_49k.json"

#: Latin-1 letters in lower case, or what is between them but spaces and line feeds.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_RUNS = re.compile(f"[{_LETTERS}]+|[^ \n{_LETTERS}]+")
#: Fixed value: the pattern under which letters and punctuation part.
_LETTER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """What byte-level pre-tokenizers write for each byte: itself if it prints, else a letter from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTES = byte_letters()


def _pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Memory:
    """What was learned lately: a newer part and an older one."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pieces: int = PIECES, words: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.words = _Memory(pieces), _Memory(words)
        rules = json.loads(self.tokenizer.to_str())
        kinds = [x.get("type") for x in (rules["normalizer"] or {}).get("normalizers", ())]
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", ())
        self.by_letters = (
            kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"].get("Regex") == _LETTER_PATTERN and not steps[1]["add_prefix_space"] and rules["post_processor"] is None
        )
        self.model = self.tokenizer.model

    def _learn_runs(self, runs: Iterable[str]) -> None:
        new, old, tokenize = self.words.new, self.words.old, self.model.tokenize
        for run in runs:
            ids = old.get(run)
            if ids is None:
                if run.isalpha():
                    text = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTES)
                    ids = _pack([t.id for t in tokenize(text)])
                else:
                    ids = _pack(self.tokenizer.encode(run, add_special_tokens=False).ids)
            new[run] = ids

    def _learn_pieces(self, pieces: Iterable[str]) -> None:
        new, old, unknown = self.pieces.new, self.pieces.old, []
        for piece in pieces:
            if (ids := old.get(piece)) is None:
                unknown.append(piece)
            else:
                new[piece] = ids
        for at in range(0, len(unknown), 4096):
            part = unknown[at : at + 4096]
            for piece, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                new[piece] = _pack(found.ids)

    def _segment(self, text: str) -> bytes:
        if self.by_letters and "'" not in text and "<|" not in text and _is_latin1(text):
            parts, memory, learn = _RUNS.findall(text.lower()), self.words, self._learn_runs
        else:
            parts, memory, learn = text.replace("\n", " ").split(" "), self.pieces, self._learn_pieces
        if missing := set(parts).difference(memory.new):
            learn(missing)
        ids = b"".join(map(memory.new.__getitem__, parts))
        memory.turn()
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) <= SEGMENT:
            return self._segment(text)
        return b"".join(map(self._segment, _segments(text)))


def _segments(text: str) -> Iterator[str]:
    """Parts of about SEGMENT characters, cut at spaces."""
    at = 0
    while at < len(text):
        cut = text.find(" ", at + SEGMENT)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
