"""Token ids of whole texts by a public BPE vocabulary, with words encoded once."""

from __future__ import annotations

import re
import sys
from array import array

from .common import memory

#: Words, and parts of words, remembered in a worker, some 200 bytes each; beyond it the memory is emptied and filled again.
WORDS, PARTS = 100_000, 300_000
#: Letters whose lower case and normal form need no context, then marks that form one token run.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for 256 and on, in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def _ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Words(dict):
    """UTF-8 word -> its ids as little-endian uint32 bytes.

    The vocabulary's pre-tokenizer never joins anything over white space, so a text's ids are those of
    its words one after the other. A word of plain letters and trailing marks is put together from
    the ids of both; anything else goes to the tokenizer as it stands.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of one run of lower-case letters or marks: the model alone merges its bytes."""
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            units = part if part.isascii() else part.encode().decode("latin-1").translate(_ALPHABET)
            ids = self.parts[part] = _ids([token.id for token in self.merges.tokenize(units)])
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if plain := _PLAIN.fullmatch(text):
            letters, marks = plain.groups()
            ids = self._part(letters.lower())
            if marks:
                ids += self._part(marks)
        else:
            ids = _ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def words(path: str) -> Words:
    """The worker's memory of a vocabulary's words."""
    return memory("tokens", path, lambda: Words(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
