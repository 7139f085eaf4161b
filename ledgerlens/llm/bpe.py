"""Token ids of a public byte-level BPE vocabulary file.

The ids are those of the ``tokenizers`` library for the same file, without
special tokens added. The same merges run about three times as fast in
``tiktoken``, which takes them as ranks, and tests compare the two. Texts that
``tiktoken`` would not encode alike go to ``tokenizers`` itself: those that
hold the string of a special token, and those with a run of white space so
long that it overflows the pattern engine's stack.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

#: White space in a row that is left to ``tokenizers``.
LONG_RUN = 100_000
#: Tried only where a run begins, so that a text is passed over once.
_long_run = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Encodes texts to little-endian unsigned 32-bit ids.

    By default the string of a special token in a text becomes its id, as in
    ``tokenizers``. With ``ordinary`` it is text like any other, so that the
    id of a special token never occurs.
    """

    def __init__(self, path: str | None = None, ordinary: bool = False):
        import public_tokenizers
        import tiktoken

        self._path, self._ordinary, self._made = path or default_path(), ordinary, None
        with open(self._path, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items()}
        self._encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._special = [] if ordinary else [t["content"] for t in file.get("added_tokens", [])]

    @property
    def _whole(self):
        """The ``tokenizers`` of the file, made where a text first needs it."""
        if self._made is None:
            from tokenizers import Tokenizer

            self._made = Tokenizer.from_file(self._path)
            self._made.encode_special_tokens = self._ordinary
        return self._made

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self._special) or len(text) >= LONG_RUN and _long_run.search(text):
            found = self._whole.encode(text, add_special_tokens=False).ids
        else:
            found = self._encode(text)
        ids = array("I", found)
        if sys.byteorder == "big":
            ids.byteswap()
        return np.frombuffer(ids, dtype="<u4")


_made: dict[tuple[str | None, bool], BytePairs] = {}


def encoder(path: str | None = None, ordinary: bool = False) -> BytePairs:
    """One encoder per worker process."""
    if (path, ordinary) not in _made:
        _made[path, ordinary] = BytePairs(path, ordinary)
    return _made[path, ordinary]
