"""Token ids of whole texts by a public tokenizer, with a cache of words.

The tokenizer used here (word_bpe_49k) drops white space and never lets a token cross it, so
the ids of a text are the ids of its white-space-separated words, one after the other. Only the
strings of special tokens are looked for in the whole text first; a text that holds one is
encoded as a whole.

A word that no cache holds and that consists of ASCII and precomposed Latin letters is cut into
the tokenizer's pieces here and given to the tokenizer's BPE model; its normalizer would only
lower-case it. Any other word goes through the whole tokenizer. Both give the same ids.
"""

from __future__ import annotations

import os
import re
import struct
from functools import cache

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: Ids of word_bpe_49k lie below this.
VOCABULARY = 49_408
_MAX_WORDS = 200_000
_MAX_PIECES = 400_000
_MAX_LENGTH = 64

_LATIN = "À-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[\x21-\x7e{_LATIN}]+")
#: Fixed value: how word_bpe_49k cuts a lower-cased text into pieces, for the letters of _PLAIN.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z{_LATIN}0-9]+")

_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the
    code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = {}, 256
    for b in range(256):
        out[b] = chr(b if b in printable else n)
        n += b not in printable
    return out


class PieceCache(dict):
    """piece -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        super().__init__()
        self._model = model
        self._chars = _byte_chars()

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self._chars)
        found = self._model.tokenize(spelled)
        ids = _PACK[len(found)](*[t.id for t in found]) if len(found) < len(_PACK) else struct.pack(f"<{len(found)}I", *[t.id for t in found])
        if len(self) < _MAX_PIECES and len(piece) <= _MAX_LENGTH:
            self[piece] = ids
        return ids


class WordCache(dict):
    """word (UTF-8 bytes) -> its ids as little-endian unsigned 32-bit integers. Holds the first
    words seen up to a fixed number; words beyond that are encoded each time."""

    def __init__(self, tokenizer, special: tuple[bytes, ...], plain: bool):
        super().__init__()
        self._encode = tokenizer.encode
        self._special = special
        self._pieces = PieceCache(tokenizer.model) if plain else None

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self._pieces is not None and _PLAIN.fullmatch(text):
            low = text.lower()
            # A string that is a piece anywhere is one piece by itself.
            ids = self._pieces.get(low) or b"".join(map(self._pieces.__getitem__, _PIECES.findall(low)))
        else:
            ids = self._whole(text)
        if len(self) < _MAX_WORDS and len(word) <= _MAX_LENGTH:
            self[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self._encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text, four bytes each."""
        if any(s in text for s in self._special):
            return self._whole(text.decode())
        return b"".join(map(self.__getitem__, text.split()))


@cache
def word_cache(path: str | None = None) -> WordCache:
    """One per Python worker. `path` names a tokenizer file that treats words as word_bpe_49k
    does, which is the default."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(WORD_BPE)
    t = Tokenizer.from_file(path)
    special = tuple(x.content.encode() for x in t.get_added_tokens_decoder().values())
    return WordCache(t, special, plain=os.path.basename(path) == WORD_BPE)
