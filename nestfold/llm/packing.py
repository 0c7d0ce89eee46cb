"""Harmonic packing of token ids into sequences of a fixed capacity.

A document is cut into full sequences and a rest. Lengths from 1 to the capacity
C fall into classes by reciprocal: class k holds the lengths over C / (k + 1) up
to C / k, and a bin of class k is filled with exactly k pieces, whatever their
lengths. A piece near the upper end of its class leaves little padding; a rest
further down is cut: a piece of C // (k + 1) ids goes to the next class, where it
fits without loss, and what is left is looked at again. That ends after at most
four pieces for usual capacities.

Every task fills the bins of all classes from its own rows, with no shuffle. It
holds fewer than k pieces of a class at any time, which is less than one bin. What it
could not place at its end goes to the next round, which has a task for every four
million ids that remain. When they fit into one task, this last task lays what it cannot
place either end to end and cuts it into sequences of C and then of powers of two.

Defined results: null and empty texts are documents of one id, the end mark;
a document per row, repeated ids or not; a null id stays null; any long text is
cut like the others; no rows give no sequences. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from nestfold.llm import text as T
from nestfold.llm.base import query, table
from nestfold.llm.tokenise import byte_tokens, gather
from nestfold.session import ship_package
from nestfold.sources.storage import materialize

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END_MARK = 1024, 0
LOSS = 64  # a bin may lose one part in so many to pieces below the upper end of their class
ROUND_IDS = 4 << 20  # remaining ids that go to one task of the next round
SCHEMA = ("sequence_id long, ids array<int>, doc_ids array<long>, starts array<long>, lengths array<long>, doc_tokens array<long>")
_PER_ROUND, _PER_TASK = 1 << 58, 1 << 34


def cuts(rest: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths into which a rest below the capacity is cut."""
    out = []
    while rest:
        k = capacity // rest
        if k * rest * LOSS >= capacity * (LOSS - 1):
            return [*out, rest]
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


@dataclass
class Pieces:
    """Pieces one behind the other: their ids, and per piece where they are from."""

    ids: np.ndarray
    doc: np.ndarray  # number of the document among ``names``
    start: np.ndarray
    length: np.ndarray
    total: np.ndarray  # ids of the whole document
    names: pa.Array

    @classmethod
    def none(cls) -> Pieces:
        zero = np.zeros(0, np.int64)
        return cls(np.zeros(0, np.int32), zero, zero, zero, zero, pa.array([], pa.int64()))

    def and_(self, other: Pieces) -> Pieces:
        return Pieces(
            np.concatenate([self.ids, other.ids]), np.concatenate([self.doc, other.doc + len(self.names)]),
            np.concatenate([self.start, other.start]), np.concatenate([self.length, other.length]),
            np.concatenate([self.total, other.total]), pa.concat_arrays([self.names, other.names]))

    def take(self, at: np.ndarray) -> Pieces:
        begins = np.cumsum(self.length) - self.length
        doc, back = np.unique(self.doc[at], return_inverse=True)
        return Pieces(gather(self.ids, begins[at], self.length[at]), back, self.start[at], self.length[at],
                      self.total[at], self.names.take(pa.array(doc)))

    def rows(self, sequences: np.ndarray | None, of: np.ndarray) -> pa.RecordBatch:
        """A row for each run of pieces; ``of`` holds n + 1 offsets of the pieces of each row."""
        at = np.concatenate([[0], np.cumsum(self.length)])
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        numbers = pa.nulls(len(of) - 1, pa.int64()) if sequences is None else pa.array(sequences, pa.int64())
        return pa.record_batch(
            [numbers, lists(at[of], pa.array(self.ids, pa.int32())), lists(of, self.names.take(pa.array(self.doc))),
             lists(of, pa.array(self.start)), lists(of, pa.array(self.length)), lists(of, pa.array(self.total))],
            ["sequence_id", "ids", "doc_ids", "starts", "lengths", "doc_tokens"])


def _document_pieces(tokens, capacity: int, end_mark: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[Pieces]]:
    """The pieces of a task's documents, a chunk of texts at a time."""
    after = [np.array(cuts(r, capacity), np.int64) for r in range(capacity)]
    n_after = np.array([len(a) for a in after])
    flat, where = np.concatenate(after), np.cumsum(n_after) - n_after

    def run(batches):
        encode = tokens()
        for batch in batches:
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                ids, at = encode(data, offsets)
                total = np.diff(at) + 1
                full, rest = total // capacity, total % capacity
                n = full + n_after[rest]
                doc = np.repeat(np.arange(len(total)), n)
                place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                tail = place - full[doc]
                length = np.where(tail < 0, capacity, flat[np.where(tail < 0, 0, where[rest][doc] + tail)])
                begins = np.cumsum(length) - length
                yield Pieces(
                    np.insert(ids, at[1:], end_mark).astype(np.int32), doc, begins - (np.cumsum(total) - total)[doc],
                    length, total[doc], batch.column(0).slice(row, len(total)).cast(pa.int64()))
    return run


def _stored_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[Pieces]:
    """The pieces of stored rows, which hold one each."""
    for batch in batches:
        if batch.num_rows:
            ids, names, start, length, total = (c.flatten() for c in batch.columns[1:])
            yield Pieces(ids.to_numpy(), np.arange(batch.num_rows), start.to_numpy(), length.to_numpy(), total.to_numpy(), names)


def _fill(pieces_of, capacity: int, round_: int, last: bool):
    """Fill bins with pieces; at the end of a task give up what no full bin took."""
    def run(batches):
        number = round_ * _PER_ROUND + TaskContext.get().partitionId() * _PER_TASK
        held = Pieces.none()
        for some in pieces_of(batches):
            held = held.and_(some)
            k = capacity // held.length
            order = np.argsort(k, kind="stable")
            classes, first, count = np.unique(k[order], return_index=True, return_counts=True)
            whole = count // classes
            rank = np.arange(len(order)) - np.repeat(first, count)
            binned = rank < np.repeat(whole * classes, count)
            if binned.any():
                of = np.concatenate([[0], np.cumsum(np.repeat(classes, whole))])
                yield held.take(order[binned]).rows(number + np.arange(len(of) - 1), of)
                number += len(of) - 1
            held = held.take(order[~binned])
        if len(held.length):
            yield _lay(held, capacity, number) if last else held.rows(None, np.arange(len(held.length) + 1))
    return run


def _lay(held: Pieces, capacity: int, number: int) -> pa.RecordBatch:
    """The remains end to end, cut at multiples of the capacity and then at powers of two."""
    n = int(held.length.sum())
    sizes = [capacity] * (n // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if n % capacity >> b & 1]
    ends = np.cumsum(held.length)
    at = np.union1d(np.cumsum(sizes), ends)
    piece = np.searchsorted(ends, at)
    begin = np.concatenate([[0], at[:-1]])
    again = Pieces(held.ids, held.doc[piece], held.start[piece] + begin - (ends - held.length)[piece], at - begin,
                   held.total[piece], held.names)
    of = np.concatenate([[0], np.searchsorted(at, np.cumsum(sizes)) + 1])
    return again.rows(number + np.arange(len(sizes)), of)


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_mark: int = END_MARK, doc_id: str = "doc_id",
         text: str = "text", round_ids: int = ROUND_IDS) -> DataFrame:
    """Sequences of at most ``capacity`` ids: ``ids``, and the pieces in them, in order.

    A piece is ``lengths`` ids from ``starts`` on of a document with ``doc_tokens`` ids.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # A task leaves less than one bin of each class: with twice that in a task, each round halves their number.
    round_ids = max(round_ids, 2 * capacity * len({capacity // n for n in range(1, capacity + 1)}))
    pieces_of, round_, out, last = _document_pieces(byte_tokens(path), capacity, end_mark), 0, None, False
    while True:
        filled = materialize(rows.mapInArrow(_fill(pieces_of, capacity, round_, last), SCHEMA), "packed")
        done = filled.filter("sequence_id is not null")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        rows = filled.filter("sequence_id is null")
        tasks = -(-(rows.agg(F.sum(F.size("ids"))).collect()[0][0] or 0) // round_ids)
        rows, pieces_of, round_, last = rows.repartition(tasks or 1), _stored_pieces, round_ + 1, tasks <= 1


def digests(sequences: DataFrame) -> DataFrame:
    """A row for each piece of the sequences, with a checksum of its ids."""
    ship_package(sequences.sparkSession)

    def run(batches):
        for batch in batches:
            lists = {name: batch.column(name) for name in batch.schema.names}
            of, at = lists["doc_ids"].offsets.to_numpy(), lists["ids"].offsets.to_numpy()
            length = lists["lengths"].flatten().to_numpy()
            row = T.owners(of)
            ends = np.cumsum(length)
            raw = np.ascontiguousarray(lists["ids"].flatten().to_numpy(), "<u4").view(np.uint8)
            crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), length.tolist())]
            yield pa.record_batch(
                [lists["doc_ids"].flatten(), lists["starts"].flatten(), pa.array(length), pa.array(crc, pa.int64()),
                 lists["doc_tokens"].flatten(), lists["sequence_id"].take(pa.array(row)),
                 pa.array(ends - length - (at[:-1] - at[0])[row], pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return sequences.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in the sequences that hold it."""
    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))
