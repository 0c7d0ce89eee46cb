"""Toxicity by weak supervision: many voters, a label model, and a linear classifier on its posteriors.

Voters look for words. Lexicon voters have a few words each; pattern voters have
word beginnings that stand out in the toxic ones of the training labels, dealt
to voters by hash; and the training label itself is a voter. The label model weighs them; its posteriors train a logistic
classifier on hashed words and word beginnings, which then scores every whole
text. Text is the only input of a score.

The sample the models are fitted on is the ``sample`` training rows with the
smallest hash of their id (a bound); counting runs on it, scoring on all rows.

Defined results: null and empty texts have no features and get the score of the
bias alone; without training labels the lexicon voters alone decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nestfold.llm import text as T
from nestfold.llm import weak
from nestfold.llm.base import query, table
from nestfold.session import ship_package

#: English insults, a lexicon voter for each line.
LEXICONS = (
    "idiot moron stupid dumb fool imbecile",
    "loser clown pathetic worthless",
    "scum trash garbage filth vermin",
    "disgusting hateful kill shut",
)
SAMPLE = 12_000  # most training rows that reach the driver
BITS = 18
PATTERN_VOTERS = 12
_PREFIXES = (4, 5, 6)
#: Bytes that end a word here: ASCII but letters, digits and the apostrophe.
_BREAKS = np.array([b < 128 and not (chr(b).isalnum() or b == 39) for b in range(256)])


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed feature) of all words and word beginnings, repeats included."""
    starts, ends, words = T.word_spans(data, offsets, _BREAKS)
    owner = T.owners(words)
    parts, owned = [T.span_hashes(data, starts, ends, lower=True)], [owner]
    for k in _PREFIXES:
        long = ends - starts > k
        parts.append(T.mix(T.span_hashes(data, starts[long], starts[long] + k, lower=True) + np.uint64(k)))
        owned.append(owner[long])
    return np.concatenate(owned), (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(owner << BITS | feature)
    return both >> BITS, both & ((1 << BITS) - 1)


def _sample_features(batches):
    for batch in batches:
        for row, data, offsets in T.chunks(T.column(batch, "text")):
            owner, feature = _distinct(*_features(data, offsets))
            ends = np.searchsorted(owner, np.arange(len(offsets)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.record_batch([batch.column(1).slice(row, len(lists)), lists], ["toxic", "features"])


def _lexicon_features(line: str) -> np.ndarray:
    data = np.frombuffer(" ".join(line.split()).encode(), np.uint8)
    starts, ends, _ = T.word_spans(data, np.array([0, len(data)]), _BREAKS)
    return (T.span_hashes(data, starts, ends, lower=True) >> np.uint64(64 - BITS)).astype(np.int64)


def _voters(row: np.ndarray, feature: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """The features each voter looks for."""
    size = 1 << BITS
    toxic = np.bincount(feature[label[row] == 1], minlength=size)
    clean = np.bincount(feature[label[row] == 0], minlength=size)
    bad, good = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    odds = (toxic / bad) / ((clean + 0.5) / good)
    found = np.flatnonzero((toxic >= max(5, 0.005 * bad)) & (odds > 20))
    return [*(_lexicon_features(x) for x in LEXICONS), *(found[found % PATTERN_VOTERS == k] for k in range(PATTERN_VOTERS))]


def fit(docs: DataFrame, known: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id") -> tuple[np.ndarray, float, weak.LabelModel]:
    """Weights, bias and the label model, from the texts of ``docs`` and the labels ``toxic`` of ``known``.

    The sample is drawn from the labels, so its ids (``sample`` at most) can be
    broadcast, and no text but those of the sample is moved. Repeated ids don't
    make it larger: ``sample`` rows at most reach the driver.
    """
    ship_package(docs.sparkSession)
    order = F.xxhash64("_id", F.lit(5))
    drawn = known.select(F.col(doc_id).alias("_id"), F.col("toxic").cast("int").alias("_toxic")).orderBy(order, "_id", "_toxic").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_of"), F.col("text").alias("_text"))
    met = texts.join(F.broadcast(drawn), F.col("_of") == F.col("_id"))
    chosen = met.orderBy(order, "_id", "_toxic", F.xxhash64("_text")).limit(sample).select(F.col("_text").alias("text"), F.col("_toxic").alias("toxic"))
    got = chosen.mapInArrow(_sample_features, "toxic int, features array<int>").toArrow().combine_chunks()
    label = got.column("toxic").to_numpy().astype(np.int64)
    lists = got.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    n = len(label)
    feature = (lists.flatten().to_numpy() if n else np.zeros(0)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())) if n else np.zeros(0, np.int64)
    voters = _voters(row, feature, label)
    votes = np.zeros((n, len(voters)))
    for k, wanted in enumerate(voters):
        votes[np.unique(row[np.isin(feature, wanted)]), k] = 1
    votes = np.column_stack([votes, label])  # the training label is one more voter, as fallible as the others
    used = votes.any(axis=0)
    model = weak.fit_label_model(votes[:, used], label.mean() if n else 0.1)
    goal = model.posterior(votes[:, used]) if used.any() else np.full(n, 0.01)
    weights, bias = weak.fit_linear(row, feature, np.ones(len(row)), goal, 1 << BITS)
    if not n:
        weights[np.concatenate([_lexicon_features(x) for x in LEXICONS])] = 6.0
        bias = -4.0
    return weights, bias, model


def score(df: DataFrame, weights: np.ndarray, bias: float, out: str = "score") -> DataFrame:
    """(id, score) of every row of ``df`` (id, text): 0 to 1, of the whole text."""
    ship_package(df.sparkSession)
    packed = weights.astype(np.float32).tobytes()

    def run(batches):
        w = np.frombuffer(packed, np.float32)
        for batch in batches:
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                owner, feature = _features(data, offsets)
                told = w[feature] != 0
                owner, feature = _distinct(owner[told], feature[told])
                odds = np.bincount(owner, w[feature], len(offsets) - 1) + bias
                yield pa.record_batch(
                    [batch.column(0).slice(row, len(odds)), pa.array(weak.logistic(odds))], ["id", out])

    return df.mapInArrow(run, f"id long, {out} double")


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with remainder 2 are held out of the fit."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    ship_package(spark)
    known = labels.filter((F.coalesce(remainder(), F.lit(2)) != 2) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    weights, bias, _ = fit(docs, known)
    scored = score(docs.select(F.col("doc_id").alias("id"), "text"), weights, bias)
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
