"""A quality classifier from weak labels.

Overlapping heuristics label all texts as junk or not: symbols, shouted
words, words of capitals, repeated and very frequent words, table bars, few
stop words, repeated lines. No labelled row is used: expectation-maximisation
finds how accurate each labeller is from how often each pattern of votes occurs
among all rows, and its posteriors train a linear scorer on hashed word shapes,
which scores every whole text.

Only the scorer is fitted on a sample, of at most ``sample`` rows: a few of every
pattern, so that rare kinds of junk are in it, and the rest by the patterns' sizes;
in a pattern, the rows with the smallest hash of their id are drawn. The scorer's
bias is then moved from the sample's share of junk to that of all rows.

Defined results: the score is the chance that a text is good. A null, empty or
blank text has no words and scores 0. The labellers judge texts of ``VOTING_WORDS`` words
or more, as shares of fewer words say little; shorter ones get no votes, and are scored by the scorer as all are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from nestfold.llm import text as T
from nestfold.llm import weak
from nestfold.llm.base import query, table
from nestfold.llm.quality_rules import STOP_WORDS
from nestfold.session import ship_package
from nestfold.sources.storage import materialize

SAMPLE = 12_000
BITS = 16
VOTING_WORDS = 20
#: Labeller, and the share of words (or lines) from which it says junk.
LABELLERS = (
    ("symbols", 0.1), ("shouts", 0.2), ("capitals", 0.4), ("repeats of the word before", 0.2),
    ("share of the most frequent word", 0.3), ("table bars", 0.1), ("no stop words", 0.97), ("repeated lines", 0.4),
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _stop_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(dict.fromkeys(STOP_WORDS)).encode(), np.uint8)
    starts, ends, _ = T.word_spans(data, np.array([0, len(data)]))
    return T.span_hashes(data, starts, ends, lower=True)


class _Words:
    """The words of a chunk of texts, with what labellers and features need of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.words = T.word_spans(data, offsets)
        self.n = np.diff(self.words)
        self.owner = T.owners(self.words)
        self.hashes = T.span_hashes(data, self.starts, self.ends, lower=True)
        self.again = np.zeros(len(self.hashes), bool)
        self.again[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.owner[1:] == self.owner[:-1])

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Per text: how many of its words are flagged."""
        return np.bincount(self.owner[flags], minlength=len(self.n))

    def votes(self, stops: np.ndarray) -> np.ndarray:
        data, last = self.data, self.ends - 1
        n = np.maximum(self.n, 1)
        symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOLS[data])])[self.offsets]) if len(data) else np.zeros(len(n))
        shout = (data[last] == 33) & (data[np.maximum(last - 1, 0)] == 33) if len(last) else np.zeros(0, bool)
        upper = (self.ends - self.starts > 1) & _UPPER[data[self.starts]] & _UPPER[data[np.minimum(self.starts + 1, len(data) - 1)]]
        bar = (self.ends - self.starts == 1) & (data[self.starts] == 124)
        pairs, times = np.unique(np.stack([self.owner.astype(np.uint64), self.hashes]), axis=1, return_counts=True) if len(last) else (
            np.zeros((2, 0), np.uint64), np.zeros(0, int))
        top = np.zeros(len(n))
        np.maximum.at(top, pairs[0].astype(np.int64), times)
        a, b, lines = T.line_spans(data, self.offsets)
        line = T.span_hashes(data, a, b)
        owner = T.owners(lines)
        full = b > a
        distinct = np.unique(np.stack([owner[full].astype(np.uint64), line[full]]), axis=1)[0].astype(np.int64) if full.any() else np.zeros(0, np.int64)
        n_lines = np.bincount(owner[full], minlength=len(n))
        repeated = n_lines - np.bincount(distinct, minlength=len(n))
        shares = [symbols / n, self.count(shout) / n, self.count(upper) / n, self.count(self.again) / n, top / n,
                  self.count(bar) / n, 1 - self.count(np.isin(self.hashes, stops)) / n, repeated / np.maximum(n_lines, 1)]
        enough = self.n >= VOTING_WORDS
        return np.stack([(s > t) & enough for s, (_, t) in zip(shares, LABELLERS)], axis=1)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value): root of the share of words with each hashed ending, beginning and repeat."""
        data, size = self.data, (1 << BITS) - 1
        ending = T.mix(T.span_hashes(data, np.maximum(self.ends - 2, self.starts), self.ends) + np.uint64(1))
        start = T.mix(T.span_hashes(data, self.starts, np.minimum(self.starts + 2, self.ends))
                      + np.uint64(2) + np.minimum(self.ends - self.starts, 12).astype(np.uint64) * np.uint64(7))
        words = np.concatenate([self.hashes, ending, start]) >> np.uint64(64 - BITS)
        kept = words.astype(np.int64) & size
        owner = np.concatenate([self.owner] * 3 + [self.owner[self.again]])
        kept = np.concatenate([kept, np.full(int(self.again.sum()), 1)])
        both, times = np.unique(owner << BITS | kept, return_counts=True)
        owner = both >> BITS
        return owner, both & size, np.sqrt(times / np.maximum(self.n, 1)[owner])


def _sample_rows(stops: np.ndarray):
    def run(batches):
        for batch in batches:
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                words = _Words(data, offsets)
                owner, feature, value = words.features()
                ends = pa.array(np.searchsorted(owner, np.arange(len(offsets))), pa.int32())
                votes = words.votes(stops)
                yield pa.record_batch(
                    [pa.array(list(votes.astype(np.int8)), pa.list_(pa.int8())),
                     pa.ListArray.from_arrays(ends, pa.array(feature, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(value, pa.float32()))], ["votes", "features", "values"])
    return run


def _patterns(stops: np.ndarray):
    def run(batches):
        for batch in batches:
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                code = _Words(data, offsets).votes(stops) @ (1 << np.arange(len(LABELLERS)))
                yield pa.record_batch([batch.column(0).slice(row, len(code)), pa.array(code, pa.int32())], ["id", "pattern"])
    return run


def quotas(counts: np.ndarray, sample: int) -> np.ndarray:
    """Rows to draw of each pattern: a few of each, which is all of a rare one, and the rest by what is left of each."""
    if counts.sum() <= sample:
        return counts.copy()
    few = min(max(4, sample >> len(LABELLERS)), sample // (2 * len(counts)))
    drawn = np.minimum(counts, few)
    rest = counts - drawn
    return drawn + rest * int(sample - drawn.sum()) // rest.sum()


def _drawn_ids(votes: DataFrame, patterns: np.ndarray, counts: np.ndarray, drawn: np.ndarray) -> DataFrame:
    """Distinct ids of the rows drawn: a cut of the hash first, so that only about the sample is ranked."""
    order = F.xxhash64("id", F.lit(9))
    cuts = [min(2**63 - 1, int((1.2 * d + 60) / n * 2**64) - 2**63) for d, n in zip(drawn.tolist(), counts.tolist())]
    limits = F.create_map(*[F.lit(int(x)) for row in zip(patterns, drawn) for x in row])
    cut = F.create_map(*[x for p, c in zip(patterns, cuts) for x in (F.lit(int(p)), F.lit(c).cast("long"))])
    near = votes.filter(order <= cut[F.col("pattern")]).distinct()
    rank = F.row_number().over(Window.partitionBy("pattern").orderBy(order, "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= limits[F.col("pattern")]).select(F.col("id").alias("_drawn")).distinct()


def _odds(share: float) -> float:
    share = min(max(share, 1e-4), 1 - 1e-4)
    return float(np.log(share / (1 - share)))


def fit(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id") -> tuple[np.ndarray, float, weak.LabelModel]:
    """Weights and bias from a bounded sample of ``docs``, and the label model of junk from the votes over all of them."""
    ship_package(docs.sparkSession)
    stops = _stop_hashes()
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), "text")
    ballots = materialize(rows.mapInArrow(_patterns(stops), "id long, pattern int"), "votes")
    groups = sorted((r["pattern"], r["count"]) for r in ballots.groupBy("pattern").count().collect())
    if not groups:
        return np.zeros(1 << BITS, np.float32), -2.0, weak.fit_label_model(np.zeros((0, len(LABELLERS))), 0.1)
    patterns, counts = (np.array(x, np.int64) for x in zip(*groups))
    kinds = (patterns[:, None] >> np.arange(len(LABELLERS)) & 1).astype(float)
    used = kinds.any(axis=0)
    model = weak.fit_label_model(
        kinds[:, used], float(np.clip(counts[patterns > 0].sum() / counts.sum(), 0.02, 0.5)), counts=counts)
    judge = lambda votes: model.posterior(votes[:, used]) if used.any() else np.full(len(votes), 0.02)
    # ids first, ``sample`` at most, so that no text but those of the sample is moved
    drawn = _drawn_ids(ballots, patterns, counts, quotas(counts, sample))
    met = rows.join(F.broadcast(drawn), F.col("id").eqNullSafe(F.col("_drawn")), "left_semi")
    chosen = met.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(sample).select("text")
    got = chosen.mapInArrow(_sample_rows(stops), "votes array<byte>, features array<int>, values array<float>").toArrow()
    votes, features, values = (pa.concat_arrays(got.column(c).chunks) for c in got.column_names)
    n = got.num_rows
    goal = judge(votes.flatten().to_numpy().reshape(n, -1).astype(float))
    row = np.repeat(np.arange(n), np.diff(features.offsets.to_numpy()))
    weights, bias = weak.fit_linear(
        row, features.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float), goal, 1 << BITS)
    return weights, bias + _odds(float(counts @ judge(kinds) / counts.sum())) - _odds(float(goal.mean())), model


def score(df: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(id, score): the chance that the whole text of each row of ``df`` (id, text) is good."""
    ship_package(df.sparkSession)
    packed = weights.astype(np.float32).tobytes()

    def run(batches):
        w = np.frombuffer(packed, np.float32)
        for batch in batches:
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                words = _Words(data, offsets)
                owner, feature, value = words.features()
                odds = np.bincount(owner, w[feature] * value, len(offsets) - 1) + bias
                good = np.where(words.n > 0, weak.logistic(-odds), 0.0)
                yield pa.record_batch([batch.column(0).slice(row, len(odds)), pa.array(good)], ["id", "score"])

    return df.mapInArrow(run, "id long, score double")


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether it stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, bias, _ = fit(docs)
    scored = score(docs.select(F.col("doc_id").alias("id"), "text"), weights, bias)
    return scored.select(F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).alias("kept"))
