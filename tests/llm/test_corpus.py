"""The corpus operators against brute force, SQL and exact round trips, and on odd tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
import tiktoken
from nestfold.llm import bpe, chat, licenses, line_dedup, minhash, mixing, quality_model, quality_rules, topk, toxicity
from nestfold.llm import text as T
from nestfold.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i} the of" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, very long and repeated texts, ties, and clashing names."""
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "a", None), (None, "one two three", "en", "b", 3),
        (4, LONG, "en", "b", len(LONG)), (5, LONG, "en", "a", 1), (6, "Word", "en", None, 1), (6, "Word", "en", None, 1),
        (7, "the cat and the dog\n" * 40, "en", "c", 2), (8, "idiot moron é 中文 \U0001f600 it's 12", "en", "c", 2),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    names = {"id": 1, "size": "x", "block": 2.0, "key": None, "words": "w", "root": 3}
    return spark.createDataFrame(rows, schema).withColumns({k: F.lit(v).cast("string") for k, v in names.items()})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


def test_words_and_lines():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\tAé") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, ""]
    array = T.column(pa.record_batch([pa.array(texts)], ["text"]), "text")
    for limit in (50, 1 << 20):
        for row, data, offsets in T.chunks(array, limit):
            starts, ends, words = T.word_spans(data, offsets)
            a, b, lines = T.line_spans(data, offsets)
            for i in range(len(offsets) - 1):
                text = (texts[row + i] or "").encode()
                at = slice(words[i], words[i + 1])
                assert [bytes(data[x:y]) for x, y in zip(starts[at], ends[at])] == text.split()
                at = slice(lines[i], lines[i + 1])
                assert [bytes(data[x:y]) for x, y in zip(a[at], b[at])] == text.split(b"\n")


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["a b ", chat.BEGIN, chat.END + "\n", "</s>", "[INST]", "\\", "\\c", "\\b", "<", "\n", "é", "word " * 30, "$1", ""]
    rows = [
        (rng.choice([1, 2, None]), t, rng.choice(["user", "assistant", "system", None, "we<s>ird"]),
         None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for t in range(120)]
    rows += rows[:5] + [(9, 0, "system", "be good"), (9, None, "user", "x"), (10, 0, "assistant", "long " * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("size", F.lit(1))
    made = chat.windows(df, fresh=64, room=128, history=64)
    conversations = collections.defaultdict(list)
    for r in rows:
        conversations[r[0]].append(r)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert set(got) == set(conversations)
    for conv, turns in conversations.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join((r[2] or "") + "\n" + (r[3] or "") + "\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_bpe_equals_the_library(spark, odd):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    parts = list("ab'stremvld  \n\t1é!.") + ["'s", "'ll", "'re", " ", "中", "\U0001f600", "\x85", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    want = sorted((r.text or "").encode().hex() + str(library.encode_ordinary(r.text or "")) for r in made.collect())
    got = bpe.decode(bpe.encode(made, ranks), ranks).collect()
    assert sorted(bytes(r.bytes).hex() + str(list(r.ids)) for r in got) == want
    assert bpe.digests(odd.limit(0), ranks).count() == 0


def test_mixing(spark, sf, docs, odd):
    rows = QUERIES["op3_source_mixing"](spark, sf).collect()
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r.size == len(WORD.findall(docs[r.doc_id])) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-3
    quotas = spark.createDataFrame([(0, 100), (1, 7), (2, 900)], "sid long, quota long")
    got = mixing.split_quotas(quotas, 13, 3).groupBy("sid").agg(F.sum("quota").alias("q")).collect()
    assert {(r.sid, r.q) for r in got} == {(0, 100), (1, 7), (2, 900)}
    assert mixing.plan(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0


def test_quality_rules_on_odd_rows(odd):
    assert quality_rules.judge(odd, out="block2").count() == odd.count()
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert {r.doc_id for r in quality_rules.keep_good(odd).collect()} == {4, 5}


def test_topk_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(60)] + [(100, [2.0]), (101, None), (102, [None, 1.0]), (103, [float("nan"), 1.0]), (104, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, 5, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 0) == [
        (0, 1, 100), (0, 2, 1), (0, 3, 2), (0, 4, 3), (0, 5, 4)]
    assert topk.search(df.limit(0), 5, F.lit(True)).count() == 0


def test_topk_repeated_rows(spark):
    rng = random.Random(6)
    for copies in (2, 6, 9):
        rows = [(0, [3.0, 3.0])] * copies + [(7, [2.0, 2.5])] * 2 + [(50, [3.0, 3.0])]
        rows += [(i, [rng.randint(-4, 4) / 2, rng.randint(-4, 4) / 2]) for i in range(100, 130)] + [(50, [v, 4.0]) for v in (4.0, 5.0, 6.0)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
        got = collections.defaultdict(set)
        for r in topk.search(df, 5, F.expr("vec_id in (0, 50, 100)")).collect():
            got[r.query_id].add((r.rank, r.vec_id, r.score))
        assert set(got) == {0, 50, 100}
        for q in (0, 100):
            own = [256 * x for x in next(v for i, v in rows if i == q)]
            best = sorted((-int(sum(a * 256 * b for a, b in zip(own, v))), i) for i, v in rows if i != q)[:5]
            assert got[q] == {(rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
        assert 50 not in {i for _, i, _ in got[50]} and {rank for rank, _, _ in got[50]} == {1, 2, 3, 4, 5}


def test_topk_components_too_large(spark):
    for large in (1e15, 1e10):  # the component, its square
        df = spark.createDataFrame([(0, [large]), (1, [large]), (2, [float("inf")])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="too large|do not fit"):
            topk.search(df, 5, F.lit(True)).collect()


def test_toxicity_on_held_out_rows(spark, sf, odd):
    got = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    held = got.filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in held}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
    weights, bias, _ = toxicity.fit(odd, odd.withColumn("toxic", F.lit(1)).limit(0))
    assert toxicity.score(odd.select(F.col("doc_id").alias("id"), "text"), weights, bias).count() == odd.count()


def test_licenses(spark, docs, sf, odd):
    have = collections.defaultdict(set)
    for r in QUERIES["op7_license_scan"](spark, sf).collect():
        have[r.doc_id].add(r.license)
        assert docs[r.doc_id][r.begin_char:r.end_char].split()[0].lower() == licenses.TEMPLATES[r.license].split()[0].lower()
    for i, text in docs.items():
        assert have[i] >= {n for n, t in licenses.TEMPLATES.items() if t.rstrip(".") in text}
    changed = spark.createDataFrame([(1, "x y " + licenses.TEMPLATES["MIT"].replace("free of charge", "with no charge") + " z")], "doc_id long, text string")
    assert [r.license for r in licenses.scan(changed).collect()] == ["MIT"]
    assert licenses.scan(odd).count() == 0


def test_whole_license_texts(spark):
    texts = licenses.TEMPLATES
    names = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC-BY-SA-4.0"]
    ends = {n: texts[n].split()[-1] for n in names}
    cut = texts["MIT"].replace("use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "look at")
    opening = " ".join(texts["MIT"].split()[:40])
    body = texts["GPL-2.0"].split()
    more = " ".join(body[:900] + ["as the owner says"] * 10 + body[900:])
    rows = [(i, "Copyright me\n" + texts[n] + "\nint main") for i, n in enumerate(names)]
    rows += [(50, cut), (51, opening), (52, more), (53, texts["Apache-2.0-header"].replace("\n", "\n# "))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.license): r for r in licenses.scan(df).collect()}
    for i, name in enumerate(names):
        r = got[i, name]
        assert r.coverage == 1 and rows[i][1][r.begin_char:r.end_char].split()[-1].rstrip("/>.)") == ends[name].rstrip("/>.)")
        assert not any(k == (i, n) for k in got for n in licenses.OPENINGS)
    assert 0.8 <= got[50, "MIT"].coverage < 1 and got[52, "GPL-2.0"].coverage == 1
    assert [k for k in got if k[0] == 51] == [(51, "MIT-opening")]
    assert got[53, "Apache-2.0-header"].coverage == 1


def test_licenses_repeated_at_once(spark):
    texts = licenses.TEMPLATES
    rows = [(1, "All rights reserved. " * 2), (2, "x " + "All rights reserved. " * 300), (3, (texts["MIT"] + "\n") * 3)]
    rows += [(4, "Released under the MIT License. y " * 4)]
    got = collections.Counter()
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.coverage == 1
        got[r.id, r.license] += 1
    assert got == {(1, "all-rights-reserved"): 2, (2, "all-rights-reserved"): 300, (3, "MIT"): 3, (4, "MIT-notice"): 4}


def test_near_duplicates(spark, sf, docs, odd):
    got = {r.doc_id: r for r in QUERIES["op8_minhash_near_dedup"](spark, sf).collect()}
    sets = {i: (lambda w: frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else []))(t.encode().lower().split())
            for i, t in docs.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(sets)
    for a in ordered:
        for b in ordered:
            if a < b and sets[a] and sets[b] and 4 * len(sets[b]) >= 3 * len(sets[a]) >= 2 * len(sets[b]):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    assert all(got[i].component_id == find(i) and got[i].n_shingles == len(sets[i]) for i in sets)
    kept = minhash.keep_one(odd, size=2)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "6", "7", "8", "None"]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    items = rng.integers(1, 2**63, 1100).astype(np.uint64)
    a, b = minhash.super_minhash(np.sort(items[:1000])), minhash.super_minhash(np.sort(items[100:]))
    assert abs((a == b).mean() - 900 / 1100) < 0.12
    assert len(minhash.super_minhash(items[:1])) == minhash.PLACES


def test_block_links_join_what_is_similar():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**40, 100)
    sets = [np.sort(np.append(base[k:], rng.integers(1, 2**40, k))) for k in (0, 3, 5, 40)]
    rows = [{"id": i, "root": i, "items": s.tolist()} for i, s in enumerate(sets)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("root", pa.int64()), ("items", pa.list_(pa.int64()))]))
    batch = pa.record_batch([pa.array([rows], kind), pa.array([rows], kind)], ["a", "b"])
    found = next(iter(minhash._block_links(80)([batch])))
    assert len({tuple(sorted(x.values())) for x in found.to_pylist()}) == 2
    assert 3 not in found.column(0).to_pylist() + found.column(1).to_pylist()


def test_line_dedup(spark, sf, docs, odd):
    got = {r.doc_id: r for r in QUERIES["op10_line_dedup"](spark, sf).collect()}
    seen: set = set()
    for i in sorted(docs):
        lines = docs[i].split("\n")
        solid = [k for k, x in enumerate(lines) if WORD.search(x)]
        keys, must = [], set()
        for p in range(len(solid)):
            n, q = 0, p
            while q < len(solid) and n < 50:
                n, q = n + len(lines[solid[q]].encode().split()), q + 1
            if n >= 50:
                keys.append(tuple(lines[k] for k in solid[p:q]))
                must |= set(solid[p:q]) if keys[-1] in seen else set()
        seen |= set(keys)
        assert got[i].n_deleted_lines >= len(must) and bool(got[i].n_deleted_lines) == bool(must)
        if not must:
            assert got[i].kept_sha256 == hashlib.sha256(docs[i].encode()).hexdigest()
    cut = line_dedup.drop_repeats(odd)
    assert cut.columns == odd.columns
    assert sorted(str(r.doc_id) for r in cut.collect()) == ["1", "2", "3", "4", "6", "6", "7", "8", "None"]


def test_quality_model_keeps_good_documents(spark, sf, odd):
    got = QUERIES["op9_quality_classifier"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n[0, False] >= 0.6 * (n[0, False] + n.get((0, True), 0))
    weights, bias, _ = quality_model.fit(odd)
    assert quality_model.score(odd.select(F.col("doc_id").alias("id"), "text"), weights, bias).count() == odd.count()


def test_quality_model_counts_the_votes_of_all_rows(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)] + list(quality_rules.STOP_WORDS) * 3
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    kinds = [
        lambda: " ".join(f"no{rng.randint(0, 99)}!!" for _ in range(30)) + " ", lambda: prose(40).upper() + " ",
        lambda: " ".join(rng.choice("#*$%&<>") + str(rng.randint(0, 99)) for _ in range(30)) + " ", lambda: f"w{rng.randint(0, 9)} " * 30]
    rows = [(i, prose(60)) for i in range(3000)] + [(i, kinds[i % 4]() + prose(30)) for i in range(3000, 3200)]
    rows += [(i, "| " * 20 + prose(40)) for i in range(3200, 3205)]  # 1 in 640, and only its own labeller sees it
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights, bias, model = quality_model.fit(df, sample=200)
    got = {r.id: r.score for r in quality_model.score(df.select(F.col("doc_id").alias("id"), "text"), weights, bias).collect()}
    assert all(got[i] < 0.5 for i in range(3200, 3205)) and sum(got[i] < 0.5 for i in range(3000)) <= 15
    assert len(model.rates) == 5  # labellers with votes among all rows
    for counts in ([10, 3, 90_000, 20_000, 1], [5, 7], list(range(1, 257))):
        drawn = quality_model.quotas(np.array(counts), 12_000)
        assert sum(drawn) <= 12_000 and all(min(c, 23) <= d <= c for c, d in zip(counts, drawn))


def test_pipeline(spark, sf, docs):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "source mix", "encoding"]
    good = {r.doc_id for r in QUERIES["op4_quality_rules"](spark, sf).collect() if r.kept}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= good and max(collections.Counter(r.doc_id for r in rows).values()) <= 3
    token = {v: k for k, v in ranks.items()}
    for r in rows[:50]:
        text = b"".join(token[i] for i in r.ids)
        assert hashlib.sha256(text).hexdigest() == r.decoded_sha256 and len(r.ids) == r.n_tokens
        assert set(text.decode().split("\n")) <= set(docs[r.doc_id].split("\n"))
