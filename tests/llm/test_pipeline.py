"""Each pipeline stage against a plain version of it, on what the stage before kept."""

import collections
import re

import public_tokenizers
import pytest
import tiktoken
from check import connect

import corpus_pipeline
from nestfold.llm import bpe
from nestfold.llm.queries import ORACLES
from nestfold.sources.storage import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, sf):
    """The rows before the first stage and after each."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_columns_stay(tables):
    assert all(t.columns == tables[0].columns for t in tables[1:5])


def test_quality_rules_keep_what_the_sql_keeps(tables, sf):
    good = {r[0] for r in connect(sf).execute(f"SELECT doc_id FROM ({ORACLES['op4_quality_rules']}) WHERE kept").fetchall()}
    before = texts(tables[0])
    assert texts(tables[1]) == {i: before[i] for i in good}


def test_line_dedup_cuts_runs_of_lines_that_an_earlier_text_has(tables):
    before, after = texts(tables[1]), texts(tables[2])
    earlier_lines = set()
    for doc in sorted(before):
        lines = before[doc].split("\n")
        kept = after.get(doc)
        runs = {k for size in range(1, len(lines) + 1) for k in range(len(lines) - size + 1)
                if sum(len(WORD.findall(x)) for x in lines[k:k + size]) >= 50 and tuple(lines[k:k + size]) in earlier_lines}
        if not runs:  # no earlier text has 50 words of it in whole lines
            assert kept == before[doc]
        else:
            assert kept is None or len(kept) < len(before[doc]) and set(kept.split("\n")) <= set(lines)
        for size in range(1, len(lines) + 1):
            earlier_lines |= {tuple(lines[k:k + size]) for k in range(len(lines) - size + 1)}


def test_near_dedup_keeps_the_first_of_each_group(tables):
    before = texts(tables[2])
    sets = {}
    for doc, text in before.items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[doc] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in before}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(before)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert texts(tables[3]) == {d: before[d] for d in ids if root(d) == d}


def test_source_mix_repeats_whole_documents(tables):
    before = texts(tables[3])
    rows = tables[4].collect()
    copies = collections.Counter(r.doc_id for r in rows)
    assert max(copies.values()) <= 3 and all((r.text or "") == before[r.doc_id] for r in rows)


def test_encoding_equals_the_library(tables):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in tables[4].collect())
    assert sorted((r.doc_id, tuple(r.ids)) for r in tables[5].collect()) == want
