"""Token ids of whole Arrow text batches, by public tokenizer files, distinct words only.

Both tokenizers cut a text into units that they merge on their own: the byte-level
one at the matches of its pattern, the piece one before each run of spaces, as no
piece holds a space behind something else (checked when the file is read). So a
chunk of texts is cut into units, each distinct unit is encoded once by the
tokenizer's own library, and the ids are laid out again by position. Units stay
known to a worker under their 64-bit hashes, up to a bound. Strings of special
tokens are ordinary text.

A file is read on the driver and its content goes to the tasks, so workers need
no path of their own.
"""

from __future__ import annotations

import itertools
import json
from functools import lru_cache
from typing import Callable

import numpy as np

from nestfold.llm import text as T
from nestfold.llm.bpe import _unpacked, packed_kinds, pre_tokens

KNOWN_IDS = 2_000_000  # of units that a worker keeps; beyond them it starts anew
SPACE = "▁"  # how pieces write a space


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Fixed values: printable Latin-1 characters stand for themselves, the other
    bytes, in order, for the characters from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Units:
    """Ids of spans of bytes; ``encode`` gives the ids of one span.

    What is known is kept as arrays in the order of the spans' hashes, so that a
    chunk is looked up at once and a known unit takes some thirty bytes.
    """

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self._encode = encode
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._starts, self._counts = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Encode new units, given by rising hashes."""
        found = [self._encode(unit) for unit in units]
        counts = np.fromiter(map(len, found), np.int32, len(found))
        starts = len(self._ids) + np.cumsum(counts) - counts
        self._ids = np.concatenate([self._ids, np.fromiter(itertools.chain.from_iterable(found), np.int32)])
        at = np.searchsorted(self._hashes, hashes)
        self._hashes = np.insert(self._hashes, at, hashes)
        self._starts, self._counts = np.insert(self._starts, at, starts), np.insert(self._counts, at, counts)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the spans, and n + 1 offsets of the spans' ids."""
        if len(self._ids) > KNOWN_IDS:
            self._forget()
        hashes, first, at = np.unique(T.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self._hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self._hashes)
        new[inside] = self._hashes[place[inside]] != hashes[inside]
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            place = np.searchsorted(self._hashes, hashes)
        place = place[at]
        counts = self._counts[place].astype(np.int64)
        return gather(self._ids, self._starts[place], counts), np.concatenate([[0], np.cumsum(counts)])


class ByteTokens:
    """A byte-level vocabulary of the ``tokenizers`` library, from the content of its file."""

    def __init__(self, content: str, kinds: bytes):
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(content)
        chars = byte_alphabet()
        vocabulary = model.get_vocab(with_added_tokens=False)
        of_char = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            if all(c in of_char for c in token):
                self.bytes_of[number] = bytes(of_char[c] for c in token)
        table = dict(enumerate(chars))
        self._kinds = _unpacked(kinds)
        self._units = Units(lambda unit: [t.id for t in model.model.tokenize(unit.decode("latin-1").translate(table))])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and n + 1 offsets of the texts' ids."""
        starts, texts = pre_tokens(data, offsets, self._kinds)
        ids, at = self._units(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)
        return ids, at[texts]


class PieceTokens:
    """A piece vocabulary of the ``sentencepiece`` library, from the content of its file.

    Texts come with the space in front that the library would add.
    """

    def __init__(self, content: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes over a space: texts can't be cut there")
        self.bytes_of = [
            bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        alone = [model.piece_to_id(SPACE)]
        self._units = Units(lambda unit: model.encode(unit[1:].decode()) if len(unit) > 1 else alone)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each beginning with a space, and n + 1 offsets of the texts' ids."""
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        ids, at = self._units(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)
        return ids, at[np.searchsorted(starts, offsets)]


def byte_tokens(path: str) -> Callable[[], ByteTokens]:
    """A function for tasks that gives the tokenizer; a worker builds it once."""
    with open(path, encoding="utf-8") as lines:
        content = lines.read()
    if json.loads(content)["model"]["type"] != "BPE":
        raise ValueError("not a byte-pair vocabulary")
    kinds = packed_kinds()
    return lambda: _byte_tokens(content, kinds)


def piece_tokens(path: str) -> Callable[[], PieceTokens]:
    with open(path, "rb") as model:
        content = model.read()
    return lambda: _piece_tokens(content)


@lru_cache(maxsize=1)
def _byte_tokens(content: str, kinds: bytes) -> ByteTokens:
    return ByteTokens(content, kinds)


@lru_cache(maxsize=1)
def _piece_tokens(content: bytes) -> PieceTokens:
    return PieceTokens(content)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of ``data``, one behind the other."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
