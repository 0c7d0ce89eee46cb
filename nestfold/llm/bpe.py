"""Byte-level BPE encoding and decoding through one shuffle of distinct words.

Encoding:

1. Texts are split into pre-tokens, a block of texts at a time. A block keeps
   its distinct words and, for every position, the number of its word; the word
   numbers are ranked by frequency and compressed. Words are dealt to buckets by
   hash and leave a block as one compressed row for each bucket.
2. The rows are shuffled and sorted by bucket, so each distinct word of the
   corpus sits in one task and is merged once. A very frequent word comes once
   for each block, not once for each position.
3. Ids go back to their block, which is joined with its positions and
   reassembled into the ids of each text.

Blocks are made twice, for the words and for the positions, rather than stored
in between: a block is named by a digest of its ids and texts, so both passes
give it the same name. Input rows must therefore come in the same order on
both passes, as from a scan of files; if they don't, the job fails.

Decoding looks up every id in the token-byte table, which has as many rows as
the vocabulary, a size that is checked before it is sent to all tasks.

Defined results: null counts as the empty text, which has no ids; a row for
each input row, repeated ids or not; long texts are blocks of their own.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import unicodedata
from typing import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from nestfold.llm import text as T
from nestfold.llm.base import partitions, query, table
from nestfold.session import ship_package

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 4 << 20  # of text; bounds a block's memory and its distinct words
BUCKETS_PER_PARTITION = 4  # of words; a task holds the words of one bucket at a time
ROWS_AT_ONCE = 64  # bucket rows of a batch that leaves a task
MAX_VOCABULARY = 2_000_000  # tokens that may be sent to every task
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Code points of the Unicode property White_Space.
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe as one pre-token.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def packed_kinds() -> bytes:
    """Letter, number, white space or other, for every code point, as the encoding library sees them.

    Unicode versions differ between libraries. What newer tables alone call a
    letter is tried out: with a vocabulary that merges any byte with an ``a``,
    the character and the ``a`` share a merged token only if they share a match.
    Made once on the driver; a few kilobytes when compressed.
    """
    kinds = np.zeros(0x200000, np.uint8)
    for kind, category, pattern, partner in ((_LETTER, "L", r"\p{L}", "a"), (_NUMBER, "N", r"\p{N}", "1")):
        old = {c for c in range(0x110000) if unicodedata.category(chr(c))[0] == category}
        kinds[list(old)] = kind
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + partner.encode(): 256 + b for b in range(256)}
        trial = tiktoken.Encoding("trial", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in old)
        for c in regex.findall(pattern, every):
            if len(trial.encode_ordinary(c + partner)) == len(c.encode()):
                kinds[ord(c)] = kind
    kinds[list(_WHITE)] = _SPACE
    return pa.compress(kinds.tobytes(), codec="zstd", asbytes=True)


@functools.cache
def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 0x200000, codec="zstd", asbytes=True), np.uint8)


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte position of each."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.uint32)
    points = first.copy()
    after = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = np.flatnonzero((first >= low) & (first < high))
        value = first[at] & mask
        for step in range(1, more + 1):
            value = (value << 6) | after[lead[at] + step]
        points[at] = value
    return points, lead


def pre_tokens(data: np.ndarray, offsets: np.ndarray, kinds_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all matches of the tokenizer's pattern, and n + 1 offsets of the texts' matches.

    The matches cover a text without gaps. A space goes with what follows it; of
    other white space before something, the last character stands alone; an
    apostrophe that nothing joins takes one of the endings after it.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points, lead = _code_points(data)
    kinds = kinds_of[points]
    n = len(points)
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(lead, offsets)] = True  # texts; the end counts too
    edge = begins.copy()
    edge[1:n] |= kinds[1:] != kinds[:-1]
    edge[n] = True
    token = edge[:n].copy()
    space = kinds == _SPACE
    # The last of white space that something follows in the same text begins a token ...
    last = space & edge[1:] & ~begins[1:]
    token |= last
    # ... and if it is a space, what follows is part of that token.
    glued = np.flatnonzero(last & (points == 32)) + 1
    token[glued] = False
    lone = np.flatnonzero((points == 39) & token & edge[1:] & ~begins[1:])
    if len(lone):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        inside = np.concatenate([edge, np.ones(2, bool)])
        for ending in _ENDINGS:
            hit = np.ones(len(lone), bool)
            for k, letter in enumerate(ending, 1):
                hit &= padded[lone + k] == ord(letter)
                if k > 1:
                    hit &= ~inside[lone + k]
            at = lone[hit]
            token[at + 1] = False
            rest = at + 1 + len(ending)
            token[rest[rest < n]] = True
            lone = lone[~hit]
    starts = lead[token]
    return starts, np.searchsorted(starts, offsets)


class _BlockOfTexts:
    """Distinct words and positions of texts, gathered chunk by chunk."""

    def __init__(self, kinds: np.ndarray):
        self.kinds = kinds
        self.bytes = 0
        self.ids: list = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []  # per chunk: distinct words
        self.words: list[pa.Array] = []
        self.at: list[np.ndarray] = []  # per chunk: position -> distinct word of the chunk
        self.name = hashlib.blake2b(digest_size=16)

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, tokens = pre_tokens(data, offsets, self.kinds)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes, first, at = np.unique(T.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        place = np.repeat(starts[first] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        where = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        self.words.append(pa.Array.from_buffers(
            pa.binary(), len(first), [None, pa.py_buffer(where), pa.py_buffer(data[place].tobytes())]))
        self.ids.append(ids)
        self.counts.append(np.diff(tokens))
        self.hashes.append(hashes)
        self.at.append(at.astype(np.uint32))
        self.bytes += len(data)
        for part in (ids.fill_null(0).to_numpy(), offsets, data):
            self.name.update(np.ascontiguousarray(part))

    def _ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """For the distinct words by falling frequency, their first places; for each position, the rank of its word."""
        _, first, at = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        ends = np.cumsum([len(h) for h in self.hashes])
        positions = np.concatenate([at[e - len(h):e][p] for e, h, p in zip(ends, self.hashes, self.at)])
        often = np.argsort(-np.bincount(positions, minlength=len(first)), kind="stable")
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often), dtype=np.uint32)
        return first[often], rank[positions]

    def _buckets(self, first: np.ndarray, buckets: int) -> np.ndarray:
        return (np.concatenate(self.hashes)[first] % np.uint64(buckets)).astype(np.uint32)

    def word_rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The distinct words, a row for each bucket, by rank within it."""
        first, _ = self._ranked()
        bucket = self._buckets(first, buckets)
        order = np.argsort(bucket, kind="stable")
        words = pa.concat_arrays(self.words).take(pa.array(first[order]))
        data, offsets = T.raw(words)
        found, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        lengths = [_pack(np.diff(offsets[a:b + 1])) for a, b in zip(starts, ends)]
        packed = [_compress(data[offsets[a]:offsets[b]].tobytes()) for a, b in zip(starts, ends)]
        rows = pa.record_batch(
            [pa.array([self.name.digest()] * len(found), pa.binary()), pa.array(found.astype(np.int32)),
             pa.array(lengths, pa.binary()), pa.array(packed, pa.binary())], ["block", "bucket", "lengths", "words"])
        for start in range(0, len(found), ROWS_AT_ONCE):
            yield rows.slice(start, ROWS_AT_ONCE)

    def text_row(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Ids, numbers of words and positions of the texts, and the bucket of each rank."""
        first, positions = self._ranked()
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        yield pa.record_batch(
            [pa.array([self.name.digest()], pa.binary()), one(pa.concat_arrays(self.ids)),
             one(pa.array(np.concatenate(self.counts).astype(np.int64))), pa.array([_pack(positions)], pa.binary()),
             pa.array([_pack(self._buckets(first, buckets))], pa.binary())],
            ["block", "ids", "counts", "positions", "buckets"])


def _compress(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _decompress(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed byte planes: the numbers are mostly small, so the upper planes are nearly all zeros."""
    return _compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _to_blocks(kinds: bytes, rows_of):
    """The rows that ``rows_of`` makes of each block of a task's texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        block = _BlockOfTexts(_unpacked(kinds))
        for batch in batches:
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                if block.bytes and block.bytes + len(data) > BLOCK_BYTES:
                    yield from rows_of(block)
                    block = _BlockOfTexts(block.kinds)
                    pa.default_memory_pool().release_unused()
                block.add(batch.column(0).slice(row, len(offsets) - 1), data, offsets)
        if block.ids:
            yield from rows_of(block)
    return run


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_last_encoder: list = []  # the ranks and their encoder; a worker runs many tasks and keeps one


def _encoder(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    if not _last_encoder or _last_encoder[0] != ranks:
        _last_encoder[:] = ranks, tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _last_encoder[1]


def _merge_words(ranks: dict[bytes, int]):
    """The ids of the words of each row; rows come sorted by bucket, so a word of several rows is merged once."""
    def run(batches):
        merge = _encoder(ranks)._encode_single_piece
        last, known = None, {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(start, ROWS_AT_ONCE)
                counts, ids = [], []
                for bucket, lengths, packed in zip(*(c.to_pylist() for c in some.columns[1:])):
                    if bucket != last:
                        last, known = bucket, {}
                    data, ends = _decompress(packed), np.cumsum(_unpack(lengths)).tolist()
                    found = []
                    for a, b in zip([0, *ends], ends):
                        word = data[a:b]
                        merged = known.get(word)
                        if merged is None:
                            merged = known[word] = merge(word)
                        found.append(merged)
                    counts.append(_pack(np.fromiter(map(len, found), np.uint32, len(found))))
                    ids.append(_pack(np.fromiter(itertools.chain.from_iterable(found), np.uint32)))
                yield pa.record_batch(
                    [some.column(0), some.column(1), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())],
                    ["block", "bucket", "counts", "ids"])
    return run


def _reassemble(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of each text of one block."""
    of_bucket = dict(zip(words.column("bucket").to_pylist(), zip(words.column("counts"), words.column("ids"))))
    parts = [of_bucket[bucket] for bucket in sorted(of_bucket)]
    lengths = np.concatenate([np.zeros(0, np.uint32), *(_unpack(c.as_py()) for c, _ in parts)])
    flat = pa.array(np.concatenate([np.zeros(0, np.uint32), *(_unpack(i.as_py()) for _, i in parts)]).astype(np.int32))
    by_bucket = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat)
    texts = texts.combine_chunks()
    if not texts.num_rows:
        raise ValueError("the texts came in another order on the second pass")
    ids, rows = [], []
    for row in range(texts.num_rows):
        ids.append(texts.column("ids")[row].values)
        count = texts.column("counts")[row].values.to_numpy(zero_copy_only=False)
        buckets = _unpack(texts.column("buckets")[row].as_py())
        if len(buckets) != len(by_bucket):
            raise ValueError("the texts came in another order on the second pass")
        place = np.empty(len(buckets), np.int64)
        place[np.argsort(buckets, kind="stable")] = np.arange(len(buckets))
        pieces = by_bucket.take(pa.array(place[_unpack(texts.column("positions")[row].as_py())]))
        at = pieces.offsets.to_numpy()
        ends = (at - at[0])[np.concatenate([[0], np.cumsum(count)])] if len(pieces) else np.zeros(len(count) + 1, np.int32)
        rows.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces.flatten()))
    return pa.table([pa.chunked_array(ids, pa.int64()), pa.chunked_array(rows, pa.list_(pa.int32()))], ["id", "ids"])


def encode(df: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text."""
    spark = df.sparkSession
    ship_package(spark)
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens are too many to send to every task")
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    kinds, buckets = packed_kinds(), BUCKETS_PER_PARTITION * partitions(spark)
    words = rows.mapInArrow(
        _to_blocks(kinds, lambda block: block.word_rows(buckets)), "block binary, bucket int, lengths binary, words binary")
    texts = rows.mapInArrow(
        _to_blocks(kinds, lambda block: block.text_row(buckets)),
        "block binary, ids array<long>, counts array<long>, positions binary, buckets binary")
    merged = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _merge_words(ranks), "block binary, bucket int, counts binary, ids binary")
    return texts.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(_reassemble, "id long, ids array<int>")


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with the bytes that the ids of each row stand for; an id outside the table is an error."""
    ship_package(df.sparkSession)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    if len(tokens) > MAX_VOCABULARY:
        raise ValueError(f"{len(tokens)} tokens are too many to send to every task")
    for token, number in ranks.items():
        tokens[number] = token
    known = set(ranks.values())
    gaps = [i for i in range(len(tokens)) if i not in known]

    def run(batches):
        bytes_of = pa.array(tokens, pa.large_binary())
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            lists = lists.fill_null([]) if lists.null_count else lists
            parts = []
            for start in range(0, len(lists), 256):
                some = lists.slice(start, 256)
                numbers = some.flatten()
                if gaps and np.isin(numbers.to_numpy(), gaps).any():
                    raise ValueError("an id is not in the table")
                pieces = bytes_of.take(numbers)
                data, at = T.raw(pieces)
                ends = some.offsets.to_numpy()
                ends = at[ends - ends[0]]
                parts.append(pa.Array.from_buffers(
                    pa.large_binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())]).cast(pa.binary()))
            column = pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
            yield pa.record_batch([*batch.columns, column], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, BinaryType())]))


def digests(df: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Per document: the number of tokens, a digest of the ids and one of the decoded bytes."""
    both = decode(encode(df, ranks), ranks)
    return both.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return digests(table(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path(VOCABULARY)))
