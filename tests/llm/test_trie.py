"""The prefix trie against a plain dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from nestfold.llm import trie
from nestfold.llm.queries import QUERIES

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    least = lambda ids: min(ids, key=lambda c: (c is not None, c or 0))
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        path = tuple((own.get(c - c % 5, [])[:h] if c is not None else []) + turns[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, convs in members.items():
        ids = sorted(ends[path], key=lambda c: (c is not None, c or 0))
        written = ",".join("null" if c is None else str(c) for c in ids)
        out.append((least(convs), len(path), least(members[path[:-1]]) if path else None, len(convs), children[path],
                    leaves[path], saved[path], hashlib.sha256(written.encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def made(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({n: F.lit("x") for n in ("key", "n", "depth", "conv", "end", "chunk", "_depth")})


def test_fattest(spark):
    pairs = [(a, b) for b in range(1, 40) for a in range(b)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", trie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for r in got:
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def test_all_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_prefix_trie"](spark, sf)) == plain(rows)


@pytest.mark.parametrize("chunk,batches", [(2, (0.3, 0.6, 1.0)), (256, (1 / 16, 1.0))])
def test_odd_conversations(spark, chunk, batches):
    rng = random.Random(chunk)
    words = ["a", "b", "é"]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in range(60) for t in range(rng.randint(1, 14))]
    rows += [(200 + c, t, "user", "same") for c in range(25) for t in range(12)]  # copies
    rows += [(500, t, "user", "same" if t < 40 else "x") for t in range(75)] + [(505, t, "user", "same") for t in range(50)]  # long
    rows += [(None, 1, "user", "a"), (None, None, None, None), (7, None, "user", None), (7, 3, "user", "z"), (7, 3, "user", "z"), (601, 0, "user", "only")]
    assert rows_of(trie.prefix_nodes(made(spark, rows), chunk, batches)) == plain(rows)


def test_no_conversations(spark):
    assert trie.prefix_nodes(made(spark, [(1, 1, "user", "x")]).limit(0)).count() == 0
