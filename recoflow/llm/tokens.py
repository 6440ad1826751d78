"""Word-wise encoding with a public tokenizer file.

The tokenizer drops white space and never merges across it, so a text's ids are
its words' ids in order. Words are encoded once per worker and remembered. A word
of printable Latin-1 letters and signs is encoded by ``tiktoken`` from the same
vocabulary (token numbers are the merge ranks; byte FF, which UTF-8 never holds,
stands for the end of a word); any other word, and any word with a special token's
string, goes through ``tokenizers``. Tests hold both against ``tokenizers`` alone.
"""

from __future__ import annotations

import json

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Bytes of words and ids (with what a dict takes for them) that one worker remembers; a full memory is emptied.
REMEMBERED_BYTES, ENTRY_BYTES = 48 << 20, 200
_PLAIN = regex.compile("[!-~¡-¬®-ÿ]+")


class WordTokenizer(dict):
    """word -> ids as little-endian 16-bit numbers."""

    _shared: dict[str, WordTokenizer] = {}

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One per worker process and file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        super().__init__()
        self.forget()
        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        self._special = tuple(special)
        suffix = spec["model"]["end_of_word_suffix"]
        byte_of = _byte_letters()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith(suffix)
                letters = token[: -len(suffix)] if ends else token
                ranks[bytes(byte_of[c] for c in letters) + b"\xff" * ends] = i
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self._split = regex.compile(pattern).findall
        self._piece = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and not any(s in word for s in self._special):
            ids = [i for p in self._split(word.lower()) for i in self._piece(p.encode() + b"\xff")]
        else:
            ids = self._whole.encode(word, add_special_tokens=False).ids
        if self._held >= REMEMBERED_BYTES:
            self.forget()
        self[word] = out = np.array(ids, "<u2").tobytes()
        self._held += ENTRY_BYTES + len(word) + len(out)
        return out

    def forget(self) -> None:
        """Drop the remembered words (a task that ends keeps nothing of its texts)."""
        self.clear()
        self[""] = b""
        self._held = 0

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
