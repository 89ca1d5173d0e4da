"""Token ids of whole texts, with a bounded memory of pieces already encoded.

Both tokenizers cut a text into pieces (words, digits, runs of signs) before any
merge is made, and merge inside a piece only. A text of common characters is cut
by the same rules here, and a new piece goes to the tokenizer's own model; most
pieces are found in memory. Any other text, and one that holds the name of an
added token, is given to the tokenizer whole.
"""

from __future__ import annotations

import array
import os
import re

import numpy as np

MEMORY = 500_000  # pieces remembered by one Python worker
LONGEST = 48  # longer pieces are encoded each time

# characters on whose classes, cases and composed forms all Unicode versions agree
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿŒœ]")
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿŒœ"
_PIECES = {
    "words": re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+"),
    "bytes": re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"),
}


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes characters: bytes without a visible form move up from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in visible}
    letter |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
    common = [*map(chr, [9, 10, 13, *range(32, 127), *range(192, 256)]), "Œ", "œ"]
    return {ord(c): "".join(letter[b] for b in c.encode()) for c in common}


class Encoder:
    """``kind`` is ``words`` (lower case, white space is dropped) or ``bytes`` (a word keeps the space before it)."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces, self.lower, self.letters = _PIECES[kind].findall, kind == "words", _byte_letters()
        # as the library has it, the name of an added token in a text is that token
        self.names = [t.content.lower() if self.lower else t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = array.array("I", [t.id for t in self.model.tokenize(piece.translate(self.letters))]).tobytes()
        if len(piece) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def _named(self, text: str) -> bool:
        plain = text.lower() if self.lower else text
        return any(name in plain for name in self.names)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, known, piece = [], self.known, self._piece
        for text in texts:
            if not text:
                out.append(b"")
            elif _OTHER.search(text) or self._named(text):
                whole = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                out.append(np.array(whole, dtype="<u4").tobytes())
            else:
                found = self.pieces(text.lower() if self.lower else text)
                out.append(b"".join([known.get(p) or piece(p) for p in found]))
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def vocabulary(name: str) -> str:
    """The place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
