"""Token ids of whole texts through the tokenizers library, with a bounded cache of pieces."""

from __future__ import annotations

import json
import re
import struct
from pathlib import Path

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

BYTE_BPE_50K = "byte_bpe_50k.json"
CACHED_PIECES = 500_000  # per generation of a cache; two caches of two generations take up to 350 MB per Python worker
END_ID = 0
ID_BYTES = 4

# White space in the sense of the Unicode property; a piece ends only before white space, where
# every byte-level pre-tokenizer of this family also starts a new piece.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_PIECE = regex.compile(public_tokenizers.PATTERN)
# The commonest chunks: a word and signs behind it, which are one piece each.
_WORD = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
# The same split for other chunks of Latin-1 letters, ASCII signs and common white space, where Python's own
# classes agree with the pattern's.
_LATIN = re.compile(r"[\t\n\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_LATIN_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(0x100):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(plain))
    return letters


class TextEncoder:
    """Text to the little-endian 32-bit ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    Byte-level BPE merges only inside a piece of the split pattern, so pieces are encoded once and
    looked up afterwards.  Other tokenizer kinds are called on whole texts.  The strings of the file's
    added tokens inside a text become their ids, as the library does by default.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and spec["model"].get("dropout") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
        )
        added = spec.get("added_tokens") or []
        # The library cuts a text at these strings before it splits the rest.
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("|".join(map(re.escape, longest_first))) if added else None
        self.by_piece &= not any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip"))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        # Two generations: a full cache becomes the old one, whose entries move back when they are met.
        self.chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            known = self.old_pieces.get(piece)
            if known is None:
                if piece.isascii() and piece.isprintable():
                    letters = piece.replace(" ", self.space)
                else:
                    letters = piece.encode("utf-8").decode("latin-1").translate(self.letters)
                ids = [token.id for token in self.model.tokenize(letters)]
                known = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces, self.old_pieces = {}, self.pieces
            self.pieces[piece] = known
        return known

    def _chunk(self, chunk: str) -> bytes:
        found = self.old_chunks.get(chunk)
        if found is None:
            plain = _WORD.fullmatch(chunk)
            if plain:
                word, signs = plain.groups()
                found = self._piece(word) + self._piece(signs) if signs else self._piece(word)
            else:
                split = _LATIN_PIECE if _LATIN.fullmatch(chunk) else _PIECE
                found = b"".join(map(self._piece, split.findall(chunk)))
        if len(self.chunks) >= CACHED_PIECES:
            self.chunks, self.old_chunks = {}, self.chunks
        self.chunks[chunk] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """Ids of a text, four bytes each; a null text has none."""
        if not text:
            return b""
        if not self.by_piece:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.at_added is None:
            return self._plain(text)
        out, start = [], 0
        for found in self.at_added.finditer(text):
            out += [self._plain(text[start : found.start()]), self.added[found[0]]]
            start = found.end()
        return b"".join([*out, self._plain(text[start:])]) if out else self._plain(text)

    def _plain(self, text: str) -> bytes:
        known, make = self.chunks.get, self._chunk
        return b"".join([known(c) or make(c) for c in _CHUNK.findall(text)])


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(name: str = BYTE_BPE_50K) -> TextEncoder:
    """One encoder per Python worker and vocabulary; a bare name is looked up among the public vocabularies."""
    if name not in _ENCODERS:
        path = name if "/" in name else public_tokenizers.path(name)
        _ENCODERS[name] = TextEncoder(path)
    return _ENCODERS[name]
