"""Alignment of two tokenizers against a plain version in Python, and on odd texts."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nestfold.llm import alignment
from nestfold.llm.queries import QUERIES
from nestfold.llm.tokenise import byte_alphabet

A, B = (public_tokenizers.path(v) for v in (alignment.VOCABULARY_A, alignment.VOCABULARY_B))


@pytest.fixture(scope="module")
def plain():
    """A function from (id, text) rows to all result rows, one text at a time."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of_char = {c: i for i, c in enumerate(byte_alphabet())}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def ends(tokens):
        at, out = 0, []
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    def measure(text):
        whole = b" " + (text or "").encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a, bytes_b = [bytes(of_char[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return 0, 0, [], []
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[i:m], ids_b[j:n]))
            links.append((ids_a[m - 1], ids_b[n - 1]))
            i, j = m, n
        return len(ids_a), len(ids_b), groups, links

    def run(rows):
        measures = [(doc, *measure(text)) for doc, text in rows]
        counts = collections.Counter(link for *_, links in measures for link in links)
        most = collections.Counter()
        for (_, y), n in counts.items():
            most[y] = max(most[y], n)
        written = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        return sorted(str((
            doc, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(written(groups).encode()).hexdigest() if n_a else "")) for doc, n_a, n_b, groups, links in measures)
    return run


def rows_of(df):
    return sorted(str(tuple(r[c] for c in ("doc_id", *alignment.MEASURES, "groups_sha256"))) for r in df.collect())


def test_all_documents(spark, sf, plain):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_token_alignment"](spark, sf)) == plain(texts)


def test_odd_texts_and_blocks(spark, plain):
    rng = random.Random(4)
    bits = ["a", " the", "  ", "\n", "\t", "é", "中文", "\U0001f600", "<s>", "<|endoftext|>", "1234", "'s", "word ", "\x00", " "]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    texts += [(1, None), (2, ""), (None, "null id"), (None, None), (3, "with ▁ mark"), (4, "▁"), (5, " "), (6, "the cat " * 20_000)]
    texts += [(1000 + i, "one text in many rows") for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns(
        {n: F.lit("x") for n in ("key", "block", "pair", "n", "n_a", "keys", "links")})
    want = plain(texts)
    for block_links in (alignment.BLOCK_LINKS, 50):
        assert rows_of(alignment.align(df.repartition(5), A, B, block_links=block_links)) == want
    assert alignment.align(df.limit(0), A, B).count() == 0


def test_a_text_is_aligned_once(spark):
    texts = [(i, "the same words") for i in range(40)] + [(99, "other words")]
    blocks = alignment.aligned_blocks(spark.createDataFrame(texts, "doc_id long, text string"), A, B)
    assert blocks.agg(F.sum(F.size("keys"))).collect()[0][0] == 2
    counted = alignment.pair_counts(blocks).agg(F.max("n")).collect()[0][0]
    assert counted == 41  # " words" ends alike in all rows
