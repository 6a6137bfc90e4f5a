"""Encoding texts with a public tokenizer inside tasks, piece by piece with a cache.

A text is cut at single spaces. For a byte-level BPE without normalizer a cut before a space is where its own pattern
cuts, too; for a BPE that drops white space so is every space. A piece of Latin letters with punctuation behind goes to
the tokenizer's model directly, in its two runs; other pieces go through the whole tokenizer; a text with white space
that would join across a cut goes there as a whole. Any other kind of tokenizer gets whole texts. Results equal those of
`Tokenizer.encode(text, add_special_tokens=False)`; tests compare them.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Pieces kept in each of two generations; a worker's cache takes about 200 bytes for each.
_CACHED = 600_000
#: Letters that no normalizer changes but for their case, and the ASCII marks, which never join with them.
_LATIN = "A-Za-zÀ-ÖØ-öø-įĲ-ſ"
_PLAIN = re.compile(rf"([{_LATIN}]+)([!-/:-@\[-`{{-~]*)").fullmatch
#: Byte-level BPE writes each byte as a visible character: itself if printable, else the next free one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: b for b in _VISIBLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
_LEAD = chr(_SHOWN[32])
_encoders: dict[str, Encoder] = {}


class _Joined(Exception):
    """White space joins across the ends of a piece."""


class _Pieces(dict):
    """Ids of pieces behind a space; what it does not hold comes from the generation before it, or is made."""

    def __init__(self, make, old: dict):
        self.make, self.old = make, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        self[piece] = ids
        return ids


class Encoder:
    """`encode(text)` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.mode = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.mode = "led"  # a space belongs to what follows
        elif pre.get("type") == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed":
            self.mode = "dropped"
        if spec["model"]["type"] != "BPE" or any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            self.mode = "whole"
        self.lead = " " if self.mode == "led" else ""
        self.shown_lead = _LEAD if self.lead else ""
        self.known = _Pieces(self._made, {})
        self.bare: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str, lead: str = "") -> bytes:
        """Ids of letters, or of marks, as the model sees them behind `lead`."""
        if not self.lead:
            run = run.lower()
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(_SHOWN)
        table = self.bytes_of
        return b"".join([table[t.id] for t in self.model.tokenize(lead + run)])

    def _first(self, piece: str) -> bytes:
        """Ids of a piece at the start of its text or line."""
        ids = self.bare.get(piece)
        if ids is None:
            if len(self.bare) >= _CACHED // 5:
                self.bare.clear()
            plain = _PLAIN(piece)
            if not plain:
                ids = self.whole(piece)
            elif plain[2]:
                ids = self._first(plain[1]) + self._first(plain[2])
            else:
                ids = self._run(piece)
            self.bare[piece] = ids
        return ids

    def _made(self, piece: str) -> bytes:
        """Ids of a piece behind a space."""
        if piece.isalpha() and piece.isascii():
            return self._run(piece, self.shown_lead)
        plain = _PLAIN(piece)
        if plain:
            word, marks = plain.groups()
            return self.known[word] + self._first(marks) if marks else self._run(piece, self.shown_lead)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            if self.lead:
                raise _Joined
        elif "\n" in piece:
            lines = piece.split("\n")
            if all(lines) and not any(x[0].isspace() or x[-1].isspace() for x in lines):
                end = self._first("\n") if self.lead else b""
                return self.known[lines[0]] + b"".join([end + self._first(x) for x in lines[1:]])
        return self.whole(self.lead + piece)

    def encode(self, text: str) -> bytes:
        if self.mode == "whole" or not text:
            return self.whole(text)
        if len(self.known) >= _CACHED:
            self.known.old = {}
            self.known = _Pieces(self._made, self.known)
        if not self.lead:
            return b"".join(map(self.known.__getitem__, text.split(" ")))
        # the first piece has no space before it; white space at its end would join with the space that follows
        first, *pieces = text.split(" ")
        if not first or first[-1].isspace():
            return self.whole(text)
        try:
            rest = b"".join(map(self.known.__getitem__, pieces))
        except _Joined:
            return self.whole(text)
        return (self._first(first) if "\n" not in first else self.whole(first)) + rest


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
