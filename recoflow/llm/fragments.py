"""Forced-boundary splitting of texts for byte-pair tokenizers.

A byte pair that occurs inside no token of a vocabulary is a forced boundary: no
merge can ever cross it, so the ids on its two sides do not depend on each other.
The text between two forced boundaries is a fragment; fragments are encoded alone,
once each while they are remembered, and their ids are concatenated.

Two kinds of forced boundaries are left uncut, because the pattern that splits words
looks across them: those behind white space (how a run of white space is split
depends on what follows it) and those before an apostrophe (it may begin "'s").
Fragments begin and end between code points.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from recoflow.llm.tokens import _byte_letters

#: Bytes of fragments and results that one memory holds.
REMEMBERED_BYTES = 96 << 20
#: What a remembered entry takes beside its bytes (dict slot, two objects).
ENTRY_BYTES = 180
_SPACE = bytes([*range(9, 14), *range(28, 33)])
#: Fragments that are one piece of the splitting pattern by themselves, and those of plain signs.
_ONE_PIECE = regex.compile(r" ?(?:[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-/:-@\[-`{-~]+)")
_PLAIN = regex.compile(r"[\t\n -~À-ÖØ-öø-ɏ]+")


def inner_pairs(tokens: Iterable[bytes]) -> np.ndarray:
    """For every byte pair, first * 256 + second, whether a token holds it."""
    out = np.zeros(1 << 16, bool)
    joined = [t for t in tokens if len(t) > 1]
    if joined:
        data = np.frombuffer(b"".join(joined), np.uint8).astype(np.uint16)
        ends = np.cumsum([len(t) for t in joined])
        pairs = data[:-1] << 8 | data[1:]
        within = np.ones(len(pairs), bool)
        within[ends[:-1] - 1] = False
        out[pairs[within]] = True
    return out


class Cutter:
    """Cuts UTF-8 text at the pairs that occur inside no token."""

    def __init__(self, inside: np.ndarray):
        cuts = ~inside.reshape(256, 256)
        cuts[list(_SPACE)] = False
        cuts[:, ord("'")] = False
        cuts[:, 0x80:0xC0] = False
        self._cuts = cuts.ravel()

    def cut(self, text: bytes) -> list[bytes]:
        """The fragments of ``text`` in order."""
        b = np.frombuffer(text, np.uint8)
        at = np.flatnonzero(self._cuts[b[:-1].astype(np.uint16) << 8 | b[1:]]) + 1
        wide = b[at - 1] >= 0x80
        if wide.any():  # white space beyond ASCII ends in C2 xx, E1 9A xx, E2 80 xx, E2 81 xx or E3 80 xx
            before, lead = b[at - 2], b[np.maximum(at - 3, 0)]
            space = ((before == 0xC2) & np.isin(b[at - 1], (0x85, 0xA0))) | (
                np.isin(lead, (0xE1, 0xE2, 0xE3)) & np.isin(before, (0x80, 0x81, 0x9A))
            )
            at = at[~(wide & space)]
        ends = at.tolist()
        return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)])] if text else []


class Memory:
    """fragment -> the bytes that ``make`` gives for it. Holds at most about ``REMEMBERED_BYTES`` in two
    generations: what the full younger one has not seen for a whole generation is forgotten."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]]):
        self._make, self._held = make, 0
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def __len__(self) -> int:
        return len(self._young) + len(self._old)

    def _add(self, fragment: bytes, value: bytes) -> None:
        self._young[fragment] = value
        self._held += ENTRY_BYTES + len(fragment) + len(value)

    def look_up(self, fragments: list[bytes]) -> list[bytes]:
        """The values of ``fragments`` in order; each new one is made once."""
        if self._held > REMEMBERED_BYTES // 2:
            self._old, self._young, self._held = self._young, {}, 0
        values = list(map(self._young.get, fragments))
        if None in values:
            missing = [k for k, value in enumerate(values) if value is None]
            new = []
            for f in {fragments[k] for k in missing}:
                if f in self._old:
                    self._add(f, self._old.pop(f))
                else:
                    new.append(f)
            for f, value in zip(new, self._make(new)):
                self._add(f, value)
            for k in missing:
                values[k] = self._young[fragments[k]]
        return values


class ByteTokenizer:
    """A byte-level BPE file of the ``tokenizers`` library. ``token_bytes[id]`` is
    what an id stands for; with ``special``, special strings in a text are their ids."""

    def __init__(self, path: str, special: bool):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_letters()
        vocab = spec["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*ranks.values(), *added.values()]))
        for token, i in ranks.items():
            self.token_bytes[i] = token
        for content, i in added.items():
            self.token_bytes[i] = content.encode()
        self.inside = inner_pairs(ranks)
        self.cutter = Cutter(self.inside)
        self.memory = Memory(self.encode_fragments)
        longest_first = sorted(added, key=len, reverse=True) if special else []
        self._special = {c.encode(): np.array([added[c]], "<i4").tobytes() for c in longest_first}
        self._sections = regex.compile(b"(" + b"|".join(map(regex.escape, self._special)) + b")").split if self._special else None
        # Numbered in merge order, the vocabulary serves as ranks: plain signs go the shorter way.
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self._plain = None
        if merged == sorted(merged):
            import public_tokenizers

            self._plain = tiktoken.Encoding("fragments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._piece = self._plain._core_bpe.encode_single_piece

    def encode_fragment(self, fragment: bytes) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if fragment in self._special:
            return self._special[fragment]
        text = fragment.decode()
        if self._plain is not None and _ONE_PIECE.fullmatch(text):
            ids = self._piece(fragment)
        elif self._plain is not None and _PLAIN.fullmatch(text):
            ids = self._plain.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return array("i", ids).tobytes()

    def encode_fragments(self, fragments: list[bytes]) -> list[bytes]:
        return list(map(self.encode_fragment, fragments))

    def fragments(self, text: bytes) -> list[bytes]:
        """Special strings, and the fragments of the sections between them."""
        if self._sections is None:
            return self.cutter.cut(text)
        out: list[bytes] = []
        for k, section in enumerate(self._sections(text)):
            out.extend([section] if k % 2 else self.cutter.cut(section))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text (none of a null or empty one)."""
        cut = [self.fragments((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        every = iter(self.memory.look_up(list(chain.from_iterable(cut))))
        return [np.frombuffer(b"".join(islice(every, len(f))), "<i4") for f in cut]

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD; ids without a token give nothing."""
        known = len(self.token_bytes)
        return b"".join([self.token_bytes[i] for i in ids if 0 <= i < known]).decode("utf-8", "replace")


class PieceTokenizer:
    """A ``sentencepiece`` BPE file with byte fallback, used without its added space."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False
        sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self._encode = sp.encode
        n = sp.get_piece_size()
        self.token_bytes = [
            bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
            for i in range(n)
        ]
        self.inside = inner_pairs(self.token_bytes[i] for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i)))

    def encode_fragments(self, fragments: list[bytes]) -> list[list[int]]:
        return self._encode([f.decode() for f in fragments], num_threads=1) if fragments else []


def slices(b: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """``b`` in order, in slices of about ``most`` by the rows' ``sizes`` (at least one row each)."""
    part = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
        if hi > lo:
            yield b.slice(lo, hi - lo)


_shared: dict[tuple, object] = {}


def shared(kind: type, *args):
    """One tokenizer per worker process and file (of the vocabulary's size, with its bounded memory)."""
    if (kind, args) not in _shared:
        _shared[kind, args] = kind(*args)
    return _shared[kind, args]
