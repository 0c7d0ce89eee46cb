"""How two tokenizers cut the same texts, measured once for each distinct text.

1. Texts are shuffled by their full text and counted; each distinct text goes on
   once, with its multiplicity, under the SHA-256 of its bytes.
2. A task encodes its texts with both tokenizers and aligns them: both sides'
   token ends lie on one axis of bytes, and places where both end cut the tokens
   into groups. The two tokens that end there are linked. A block of texts is
   written as one row, with its distinct pairs of linked ids.
3. Pairs of all blocks are counted, weighted by multiplicity, and joined back to
   the blocks that hold them; a frequent pair comes once for each block, not
   once for each link. A block then sums up the counts over the links of its texts.
4. The measures are joined to the rows by the name of their text. Rows of one
   text may be any share of the table: they are narrow here, and the join can split them.

Defined results: null and empty texts have no tokens and zeros, as have texts
whose joined token bytes on either side differ from space + text; a row for each
input row, repeated ids and null ids too; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from typing import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from nestfold.llm import text as T
from nestfold.llm.base import query, table
from nestfold.llm.tokenise import byte_tokens, gather, piece_tokens
from nestfold.session import ship_package
from nestfold.sources.storage import materialize

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_LINKS = 500_000  # links of a block of texts, if not of a single text
_B = 1 << 31  # a pair is a * _B + b
_TEXTS = "keys array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>"
_BLOCKS = f"block long, {_TEXTS}, link_offsets array<int>, links array<int>, pairs array<long>, weights array<long>"
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _bytes_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, and the start and length of each."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def _digits(n: int) -> np.ndarray:
    """Decimal digits of the numbers below n as rows of bytes, with zero bytes in front, and a column for a sign behind."""
    text = np.char.mod("%d", np.arange(max(n, 1))).astype("S")
    width = text.dtype.itemsize
    return np.concatenate([text.view(np.uint8).reshape(-1, width), np.zeros((len(text), 1), np.uint8)], axis=1)


class _Side:
    """One tokenizer on chunks of texts."""

    def __init__(self, tokens):
        self.encode = tokens
        self.data, self.starts, self.lengths = _bytes_table(tokens.bytes_of)
        self.digits = _digits(len(tokens.bytes_of))

    def differ(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, whether its tokens' bytes are not the text's."""
        lengths = self.lengths[ids]
        joined = gather(self.data, self.starts[ids], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[at]
        if len(joined) == len(data) and (ends == offsets).all() and (joined == data).all():
            return np.zeros(len(offsets) - 1, bool)
        return np.array([
            joined[a:b].tobytes() != data[c:d].tobytes()
            for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:])], bool)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front of each."""
    return np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))


def _written(a: _Side, b: _Side, ids: list[np.ndarray], group: list[np.ndarray], n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` for all groups of a chunk: the bytes, and n + 1 offsets of the groups."""
    which = np.concatenate([2 * group[0], 2 * group[1] + 1])
    order = np.argsort(which, kind="stable")
    width = max(a.digits.shape[1], b.digits.shape[1])
    rows = np.zeros((len(order), width), np.uint8)
    for side, numbers, at in ((a, ids[0], slice(0, len(ids[0]))), (b, ids[1], slice(len(ids[0]), None))):
        rows[at, :side.digits.shape[1] - 1] = side.digits[numbers, :-1]
    rows, which = rows[order], which[order]
    last = np.ones(len(which), bool)
    last[:-1] = which[1:] != which[:-1]
    rows[:, -1] = np.where(last, np.where(which % 2 == 0, ord("|"), ord(";")), ord(","))
    used = (rows != 0).sum(axis=1)
    flat = rows.ravel()
    ends = np.concatenate([[0], np.cumsum(used)])
    return flat[flat != 0], ends[np.searchsorted(which, 2 * np.arange(n_groups + 1))]


class _Block:
    """Aligned texts, gathered until they go into one row."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.links = 0

    def add(self, a: _Side, b: _Side, keys: pa.Array, mult: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        spaced, at = _spaced(data, offsets)
        (ids_a, of_a), (ids_b, of_b) = a.encode(spaced, at), b.encode(spaced, at)
        if not (a.lengths[ids_a].all() and b.lengths[ids_b].all()):
            raise ValueError("a token without bytes has no place")
        bad = a.differ(ids_a, of_a, spaced, at) | b.differ(ids_b, of_b, spaced, at)
        if bad.any():
            ids_a, of_a = _without(ids_a, of_a, bad)
            ids_b, of_b = _without(ids_b, of_b, bad)
            kept = ~np.repeat(bad, np.diff(at))
            spaced, at = spaced[kept], np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(at)))])
        ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
        common, in_a, in_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        of_text = np.searchsorted(common, at, "right")  # a text's groups end behind its begin
        groups = [np.searchsorted(common, ends) for ends in (ends_a, ends_b)]
        written, where = _written(a, b, [ids_a, ids_b], groups, len(common))
        shas = []
        for first, end in zip(of_text[:-1].tolist(), of_text[1:].tolist()):
            shas.append(hashlib.sha256(written[where[first]:where[end] - 1].tobytes()).hexdigest() if end > first else "")
        pairs = ids_a[in_a].astype(np.int64) * _B + ids_b[in_b]
        n_links = np.diff(of_text)
        self.parts.append((keys, np.diff(of_a), np.diff(of_b), n_links, shas, pairs, np.repeat(mult, n_links)))
        self.links += len(pairs)

    def row(self, number: int) -> pa.RecordBatch:
        keys, n_a, n_b, n_links, shas, pairs, weights = zip(*self.parts)
        pairs, at = np.unique(np.concatenate(pairs), return_inverse=True)
        weights = np.bincount(at, np.concatenate(weights).astype(np.float64), len(pairs)).astype(np.int64)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        n_links = np.concatenate(n_links)
        return pa.record_batch(
            [pa.array([number], pa.int64()), one(pa.concat_arrays(keys)), one(pa.array(np.concatenate(n_a))),
             one(pa.array(np.concatenate(n_b))), one(pa.array(n_links)), one(pa.array(sum(shas, []), pa.string())),
             one(pa.array(np.concatenate([[0], np.cumsum(n_links)]), pa.int32())), one(pa.array(at, pa.int32())),
             one(pa.array(pairs)), one(pa.array(weights))],
            ["block", "keys", "n_a", "n_b", "n_groups", "groups_sha256", "link_offsets", "links", "pairs", "weights"])


def _without(ids: np.ndarray, of: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens without those of the bad texts."""
    n = np.diff(of)
    return ids[~np.repeat(bad, n)], np.concatenate([[0], np.cumsum(np.where(bad, 0, n))])


def _align(tokens_a, tokens_b, block_links: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _Side(tokens_a()), _Side(tokens_b())
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            mult = batch.column(2).to_numpy()
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                part = slice(row, row + len(offsets) - 1)
                block.add(a, b, batch.column(0).slice(row, len(offsets) - 1), mult[part], data, offsets)
                if block.links >= block_links:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.parts:
            yield block.row(number)
    return run


def _sum_up(key: tuple, blocks: pa.Table, pairs: pa.Table) -> pa.Table:
    """The measures of the texts of one block."""
    blocks, pairs = blocks.combine_chunks(), pairs.combine_chunks()
    one = {name: blocks.column(name).combine_chunks()[0].values for name in blocks.schema.names if name != "block"}
    order = np.argsort(pairs.column("pair").to_numpy())
    counts, best = (pairs.column(c).to_numpy()[order] for c in ("n", "is_best"))
    links = one["links"].to_numpy()
    at = one["link_offsets"].to_numpy()
    sums = [np.concatenate([[0], np.cumsum(v[links].astype(np.int64))])[at] for v in (best, counts)]
    return pa.table(
        [one["keys"], one["n_a"], one["n_b"], one["n_groups"], pa.array(np.diff(at).astype(np.int64)),
         pa.array(np.diff(sums[0])), pa.array(np.diff(sums[1])), one["groups_sha256"]],
        ["key", *MEASURES, "groups_sha256"])


def _distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """(key, text, n): each text that is not empty, once, with its number of rows."""
    counted = df.select(F.col(text).cast("string").alias("text")).filter("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_name("text"), "text", "n")


def _name(text: str):
    return F.unhex(F.sha2(F.col(text).cast("string").cast("binary"), 256)).alias("key")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, is_best): how many links of all rows hold each pair of ids, and whether none of its second id's pairs has more."""
    counted = blocks.select(F.explode(F.arrays_zip("pairs", "weights")).alias("x")).groupBy(
        F.col("x.pairs").alias("pair")).agg(F.sum("x.weights").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % _B)  # at most one pair for each id of the first vocabulary
    return counted.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("is_best"))


def aligned_blocks(df: DataFrame, path_a: str, path_b: str, text: str = "text", block_links: int = BLOCK_LINKS) -> DataFrame:
    """Blocks of aligned distinct texts, written."""
    ship_package(df.sparkSession)
    return materialize(_distinct_texts(df, text).mapInArrow(
        _align(byte_tokens(path_a), piece_tokens(path_b), block_links), _BLOCKS), "aligned")


def align(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
          block_links: int = BLOCK_LINKS) -> DataFrame:
    """Per row: its id, the measures of its text, and a digest of the groups."""
    blocks = aligned_blocks(df, path_a, path_b, text, block_links)
    held = blocks.select(F.col("block").alias("of_block"), F.explode("pairs").alias("pair")).join(pair_counts(blocks), "pair")
    wide = blocks.drop("pairs", "weights")
    measures = materialize(
        wide.groupBy("block").cogroup(held.groupBy("of_block")).applyInArrow(
            _sum_up, "key binary, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string"), "measures")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(
        _name(text), F.unhex(F.sha2(F.lit("").cast("binary"), 256))).alias("key"))
    return rows.join(measures, "key", "left").select(
        "doc_id", *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under both tokenizers."""
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B))
