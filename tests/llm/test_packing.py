"""Harmonic packing: every id once, sequences full, little padding, on texts like and unlike the given ones."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nestfold.llm import packing
from nestfold.llm.queries import QUERIES

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def padding(fills, capacity):
    return sum(0 if f & (f - 1) == 0 else capacity - f for f in fills)


def check(rows, texts, tokenizer, capacity=1024):
    """``rows`` cover the ids of the texts (a list of (id, text)) exactly once, and sequences without a gap."""
    want = collections.Counter()
    ids_of = collections.defaultdict(list)
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[(doc, len(ids))] += len(ids)
        ids_of[(doc, len(ids))].append(ids)
    got, spans, fills = collections.Counter(), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        key = (r.doc_id, r.doc_tokens)
        got[key] += r.length
        spans[key].append((r.start, r.length))
        fills[r.sequence_id].append((r.offset, r.length))
        crcs = {zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for ids in ids_of[key]}
        assert r.ids_crc32 in crcs
    assert got == want
    for key, copies in ids_of.items():
        ends = collections.Counter()
        for start, length in spans[key]:
            ends[start] += 1
            ends[start + length] -= 1
        assert {k: v for k, v in ends.items() if v} == {0: len(copies), key[1]: -len(copies)}
    sizes = []
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        sizes.append(at)
    return sizes


def test_cuts():
    for capacity in (1, 2, 7, 64, 1000, 1024):
        for rest in range(capacity):
            parts = packing.cuts(rest, capacity)
            assert sum(parts) == rest and len(parts) <= 5 and all(p > 0 for p in parts)
            for p in parts:
                assert capacity // p * p * packing.LOSS >= capacity * (packing.LOSS - 1) or capacity // p * p + capacity // p > capacity


def test_packs_all_documents(spark, sf, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sizes = check(QUERIES["op11_packing"](spark, sf).collect(), texts, tokenizer)
    assert padding(sizes, 1024) < 0.01 * sum(sizes)


def test_odd_rows_and_rounds(spark, tokenizer):
    texts = [
        (1, None), (2, ""), (None, "one two three"), (None, None), (3, "<|endoftext|> is text"), (4, " \n\t "), (5, "it's 'll 12 é 中文 \U0001f600"),
        (6, "the cat sat. " * 40_000), (7, "word"), (7, "word"), (7, "word two"), (8, "x" * 5000)]
    texts += [(100 + i, "some words go here " * (i % 23)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("ids", "sequence_id", "id", "length")})
    for capacity, round_ids in ((1024, 1 << 22), (16, 1)):
        made = packing.pack(df.repartition(20), PATH, capacity, round_ids=round_ids)
        sizes = check(packing.digests(made).collect(), texts, tokenizer, capacity)
        assert padding(sizes, capacity) < 0.02 * sum(sizes)
    assert packing.digests(packing.pack(df.limit(0), PATH)).count() == 0


def test_one_length_fills_bins_of_one_class(spark, tokenizer):
    df = spark.range(0, 1000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("the " * 99 + "the").alias("text"))
    n = df.first().text.count("the") + 1
    made = packing.pack(df, PATH).select(F.size("doc_ids").alias("n"), F.size("ids").alias("size")).collect()
    k = 1024 // n
    whole = [r for r in made if r.n == k and r["size"] == k * n]
    assert n in packing.cuts(n) and len(whole) >= 1000 // k - 4
