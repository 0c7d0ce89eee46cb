"""Cases that once went wrong: clashing names, repeated ids, long system turns, empty texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nestfold.llm import chat, line_dedup, mixing, quality_model, quality_rules, toxicity

OWN_NAMES = ("_id", "_h", "_lines", "_gone", "_size", "_source", "_key", "_block", "_sid", "_row", "_before", "_drawn", "_mix", "_draw",
             "_order", "_quality", "_kept", "_toxic", "_of", "_text", "toxic", "mix", "draws")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def with_own_names(docs):
    return docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in OWN_NAMES})


@pytest.mark.parametrize("operator", [
    line_dedup.cut_repeats, line_dedup.drop_repeats, mixing.mix, quality_rules.keep_good, lambda d: mixing.plan(d, out="plan").drop("plan")])
def test_the_callers_columns_stay_as_they_are(docs, operator):
    named = with_own_names(docs)
    got = operator(named)
    assert got.columns == named.columns
    rows = got.collect()
    assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in OWN_NAMES)
    plain = sorted(map(str, operator(docs).collect()))
    assert sorted(map(str, got.select(*docs.columns).collect())) == plain


def test_toxicity_fits_on_a_bounded_sample_of_odd_rows(spark, docs, sf, monkeypatch):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.filter("toxic is not null").select("doc_id", "toxic")
    repeated = with_own_names(docs.filter("doc_id < 20")).crossJoin(spark.range(40).select(F.col("id").alias("copy")))
    seen = []
    real = toxicity._voters
    monkeypatch.setattr(toxicity, "_voters", lambda row, feature, label: seen.append(len(label)) or real(row, feature, label))
    weights, _, _ = toxicity.fit(repeated, known, sample=30)
    assert seen == [30] and len(weights) == 1 << toxicity.BITS


def test_texts_without_words_are_not_good(spark, docs):
    weights, bias, _ = quality_model.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (4, "word")], "id long, text string")
    got = {r.id: r.score for r in quality_model.score(odd, weights, bias).collect()}
    assert got[1] == got[2] == got[3] == 0.0 and 0 < got[4] < 1


def test_windows_keep_their_budget_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be brief. " * 3000), (2, 0, "system", "short rule")]
    rows += [(c, t, ("user", "assistant")[t % 2], f"turn {t} " + "word " * 90) for c in (1, 2) for t in range(1, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    first = {}
    for r in sorted(made, key=lambda r: (r.conv_id, r.window)):
        if r.conv_id not in first:
            first[r.conv_id] = r
            continue
        repeated = r.turns[:r.n_repeated]
        # The system turn stands first, whole or marked as cut; then come whole earlier turns, masked.
        assert repeated[0].role == "system"
        assert repeated[0].text == ("short rule" if r.conv_id == 2 else ("be brief. " * 3000)[:4 * chat.HISTORY] + chat.CUT)
        assert sum(len(t.text.split()) for t in repeated[1:]) <= chat.HISTORY
        assert r.n_tokens <= chat.ROOM + 2 * chat.HISTORY + 4 * chat.HISTORY
        masked = {(s.begin, s.length) for s in r.loss}
        spoken = [t for t in r.turns[r.n_repeated:] if t.role == "assistant"]
        assert [r.formatted[b:b + n] for b, n in sorted(masked)] == [t.text for t in spoken]
    assert any(r.n_repeated > 1 for r in made)
    long_ = [r for r in made if r.conv_id == 1]
    assert sum(len(r.formatted) for r in long_) < 200_000


def test_line_breaks_in_roles_are_read_back(spark):
    rows = [(1, 0, "us\ner", "hello"), (1, 1, "a\\nb\n", "\\n and \n"), (1, 2, "\\", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df).select(chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert [(t.role, t.text) for t in made[0].turns] == [r[2:] for r in rows]


def test_pipeline_on_no_rows(spark, docs, sf):
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns and out.count() == 0


def test_pairs_of_wide_documents_come_in_small_batches(spark, monkeypatch, tmp_path):
    """Batches hold the lines of few pairs, whatever the session's limit; its setting is as before afterwards."""
    from nestfold.llm import line_dedup

    lines = "\n".join(f"line {i} of a passage that every document has" for i in range(400))
    df = spark.createDataFrame([(i, f"own words of {i}\n{lines}") for i in range(200)], "doc_id long, text string").coalesce(1)
    real, seen = line_dedup._aligned, str(tmp_path)

    def watched(least):
        run = real(least)

        def each(batches):
            import os
            for batch in batches:
                open(os.path.join(seen, f"{os.getpid()}-{batch.num_rows}-{id(batch)}"), "w").close()
                yield from run([batch])
        return each

    monkeypatch.setattr(line_dedup, "_aligned", watched)
    monkeypatch.setattr(line_dedup, "BATCH_BYTES", 100_000)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    kept = {r.doc_id: r.text for r in line_dedup.cut_repeats(df).collect()}
    assert kept[0].count("\n") == 400 and all(kept[i] == f"own words of {i}" for i in range(1, 200))
    rows = [int(p.name.split("-")[1]) for p in tmp_path.iterdir()]
    assert max(rows) < 20 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_line_dedup_joins_the_same_way_for_any_size(spark, capsys):
    from nestfold.llm import line_dedup

    line_dedup.cut_repeats(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
