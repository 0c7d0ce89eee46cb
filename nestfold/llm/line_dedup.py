"""Line dedup by pairwise alignment: common blocks go from the later document.

A block is a run of lines. The key of a rare run is the hash of the shortest run
from a line on that has ``min_words`` words; two documents share a block of that
length exactly if they share such a key. Every key belongs to the first
document that has it, and every later document with it is paired with that one
only, so a passage in thousands of documents costs one pair for each. Pairs are
aligned by patience diff: lines that are unique in both are matched along their
longest increasing run, gaps between them are aligned again, and matches grow
over equal neighbours. Aligned blocks of ``min_words`` words or more are deleted from the later
document. Blocks that changed places are found by aligning what is left again.

The first holder of a passage keeps it, so nothing is lost from the corpus.

Defined results: "later" is the larger ``doc_id`` (null is the smallest), then
the larger text hash; rows with equal id and text are one document and share
its result; a null text stays null; blank lines have no words and go only with
the block around them.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nestfold.llm import text as T
from nestfold.llm.base import free_name, key, query, table
from nestfold.session import ship_package
from nestfold.sources.storage import batches_up_to, materialize

MIN_WORDS = 50
BATCH_BYTES = 4 << 20  # of pairs with the lines of both documents that a task takes at once


def _line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and words of every line, and n + 1 offsets of the texts' lines."""
    starts, ends, lines = T.line_spans(data, offsets)
    words, _, _ = T.word_spans(data, offsets)
    return (T.span_hashes(data, starts, ends).view(np.int64),
            (np.searchsorted(words, ends) - np.searchsorted(words, starts)).astype(np.int64), lines)


def runs(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with words: key and end of the shortest run of ``least`` words from each, and whether the text has it whole."""
    h = hashes.view(np.uint64)
    total = np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(total, total[:-1] + least)  # the run is lines i .. stop[i] - 1
    full = stop < len(total)
    keys, place = T.mix(h), np.arange(len(h))
    for step in range(1, int((stop - place)[full].max(initial=0))):
        on = np.flatnonzero(full & (stop - place > step))
        keys[on] = T.pair_hashes(keys[on], h[on + step])
    return keys.view(np.int64), stop, full


def run_keys(hashes: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """The distinct run keys of a text; blank lines take no part in runs."""
    solid = np.flatnonzero(words)
    keys, _, full = runs(hashes[solid], words[solid], least)
    return np.unique(keys[full])


_LINES = "id long, h long, hashes array<long>, words array<long>, keys array<long>"


def _lines(least: int):
    def run(batches):
        for batch in batches:
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                hashes, words, lines = _line_table(data, offsets)
                n = len(offsets) - 1
                spans = list(zip(lines[:-1], lines[1:]))
                array = lambda parts: pa.array(parts, pa.list_(pa.int64()))
                yield pa.record_batch(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n),
                     array([hashes[a:b] for a, b in spans]), array([words[a:b] for a, b in spans]),
                     array([run_keys(hashes[a:b], words[a:b], least) for a, b in spans])],
                    ["id", "h", "hashes", "words", "keys"])
    return run


def _unique(items: np.ndarray, a: int, b: int) -> dict:
    seen: dict = {}
    for i in range(a, b):
        seen[items[i]] = -1 if items[i] in seen else i
    return {x: i for x, i in seen.items() if i >= 0}


def patience(left: list, right: list) -> list[tuple[int, int]]:
    """Matched positions (i, j) of equal items, increasing in both."""
    matched = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        head, tail = 0, 0
        while a + head < b and c + head < d and left[a + head] == right[c + head]:
            matched.append((a + head, c + head))
            head += 1
        a, c = a + head, c + head
        while b - tail > a and d - tail > c and left[b - tail - 1] == right[d - tail - 1]:
            tail += 1
            matched.append((b - tail, d - tail))
        b, d = b - tail, d - tail
        if a >= b or c >= d:
            continue
        here, there = _unique(left, a, b), _unique(right, c, d)
        points = [(i, there[x]) for x, i in here.items() if x in there]  # in the order of i
        if not points:  # no line is unique in both: let first occurrences stand for it
            here = {x: a + k for k, x in reversed(list(enumerate(left[a:b])))}
            there = {x: c + k for k, x in reversed(list(enumerate(right[c:d])))}
            points = sorted((i, there[x]) for x, i in here.items() if x in there)
        tops: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for k, (_, j) in enumerate(points):
            at = bisect_left(tops, j)
            tops[at:at + 1], ends[at:at + 1] = [j], [k]
            before.append(ends[at - 1] if at else -1)
        chain = []
        k = ends[-1] if ends else -1
        while k >= 0:
            chain.append(points[k])
            k = before[k]
        chain.reverse()
        if not chain:
            continue
        i0, j0 = a, c
        for i, j in chain:
            todo.append((i0, i, j0, j))
            matched.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, b, j0, d))
    return sorted(matched)


def common_blocks(later: np.ndarray, later_words: np.ndarray, earlier: np.ndarray, earlier_words: np.ndarray, least: int) -> np.ndarray:
    """Which of the later document's lines stand in common blocks of ``least`` words (lines with words only)."""
    gone = np.zeros(len(later), bool)
    left, right, words = later.tolist(), earlier.tolist(), later_words.tolist()
    while True:
        block: list[int] = []
        before, found = (-2, -2), []
        for i, j in [*patience(left, right), (-9, -9)]:
            if (i - 1, j - 1) != before:
                if sum(words[k] for k in block) >= least:
                    found += block
                block = []
            block.append(i)
            before = (i, j)
        if not found:
            break
        gone[found] = True
        for i in found:  # a wall: lines on both sides of a deleted block never form one block
            left[i] = ("gone", i)
    # Common runs that no alignment reached, as more lines crossed them.
    keys, stop, full = runs(later, later_words, least)
    other, _, whole = runs(earlier, earlier_words, least)
    for i in np.flatnonzero(full & np.isin(keys, other[whole])):
        gone[i:stop[i]] = True
    return gone


def _with_blanks(words: np.ndarray, solid: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Line numbers to delete: those marked, and the blank lines between two that are marked."""
    if not gone.any():
        return np.zeros(0, np.int32)
    marked = np.zeros(len(words), bool)
    marked[solid[gone]] = True
    before = np.searchsorted(solid, np.arange(len(words)), "right") - 1  # the last line with words up to here
    inside = (before >= 0) & (before + 1 < len(solid))
    blank = np.flatnonzero(inside & (words == 0))
    marked[blank] = gone[before[blank]] & gone[before[blank] + 1]
    return np.flatnonzero(marked).astype(np.int32)


def _aligned(least: int):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            side = [batch.column(names.index(n)) for n in ("hashes", "words", "first_hashes", "first_words")]
            found = []
            for i in range(batch.num_rows):
                later, words, earlier, earlier_words = (c[i].values.to_numpy(zero_copy_only=False) for c in side)
                solid, other = np.flatnonzero(words), np.flatnonzero(earlier_words)
                gone = common_blocks(later[solid], words[solid], earlier[other], earlier_words[other], least)
                found.append(_with_blanks(words, solid, gone))
            yield pa.record_batch(
                [batch.column(names.index("id")), batch.column(names.index("h")), pa.array(found, pa.list_(pa.int32()))],
                ["id", "h", "lines"])
    return run


def deletions(docs: DataFrame, least: int) -> DataFrame:
    """(id, h, lines): the numbers of the lines to delete, for documents that have any.

    ``docs`` has ``id``, ``h`` (a hash of the text) and ``text``.
    """
    lines = materialize(docs.mapInArrow(_lines(least), _LINES).dropDuplicates(["id", "h"]), "lines")
    keys = lines.select(F.struct("id", "h").alias("doc"), F.explode("keys").alias("key"))
    firsts = (
        keys.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        .filter("first != last").select("key", "first"))
    pairs = keys.join(firsts, "key").filter("first != doc").select("doc.id", "doc.h", "first").distinct()
    pairs = materialize(pairs, "pairs")
    earlier = lines.select(
        F.struct("id", "h").alias("first"), F.col("hashes").alias("first_hashes"), F.col("words").alias("first_words"))
    sides = (
        pairs.join(lines.select("id", "h", "hashes", "words"), ["id", "h"]).join(earlier, "first")
        .select("id", "h", "hashes", "words", "first_hashes", "first_words")
    )
    aligned = sides.mapInArrow(_aligned(least), "id long, h long, lines array<int>").filter(F.size("lines") > 0)
    with batches_up_to(docs.sparkSession, BATCH_BYTES):
        found = materialize(aligned, "found")
    one = found.select("id", "h", F.explode("lines").alias("line")).distinct()
    return one.groupBy("id", "h").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def _cut(text: str, lines: str, drop_emptied: bool = False):
    """Deletes the numbered lines from the text of each row that has any."""
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, gone = batch.column(names.index(text)).to_pylist(), batch.column(names.index(lines)).to_pylist()
            stay = []
            for k, drop in enumerate(gone):
                if drop:
                    drop = set(drop)
                    texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in drop)
                if not (drop and drop_emptied) or texts[k].encode().split():
                    stay.append(k)
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(i) for i, n in enumerate(names) if n != lines]
            yield pa.record_batch(columns, [n for n in names if n != lines]).take(pa.array(stay, pa.int64()))
    return run


def cut_repeats(
    df: DataFrame, least: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", report: str | None = None
) -> DataFrame:
    """``df`` with the common blocks deleted from later documents' texts.

    With ``report``, a column of that name has the numbers of the deleted lines
    (null if none) and the texts are as before.
    """
    ship_package(df.sparkSession)
    own, hashed, lines = free_name(df, "_id"), free_name(df, "_h"), report or free_name(df, "_lines")
    keyed = df.withColumn(own, key(doc_id)).withColumn(hashed, F.xxhash64(F.col(text)))
    docs = keyed.select(F.col(own).alias("id"), F.col(hashed).alias("h"), F.col(text).alias("text"))
    gone = deletions(docs, least).select(F.col("id").alias(own), F.col("h").alias(hashed), F.col("lines").alias(lines))
    joined = keyed.join(gone.hint("merge"), [own, hashed], "left").select(*df.columns, lines)  # the same plan for any size
    if report:
        return joined
    return joined.mapInArrow(_cut(text, lines), df.schema)


def drop_repeats(df: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """As ``cut_repeats``; documents that lose all their words go, as earlier ones have them all."""
    gone = free_name(df, "_gone")
    marked = cut_repeats(df, least, report=gone)
    return marked.mapInArrow(_cut("text", gone, drop_emptied=True), df.schema)


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to earlier ones, and the digest of the text that stays."""
    marked = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), report="gone")
    counted = marked.withColumn("n_deleted_lines", F.coalesce(F.array_size("gone"), F.lit(0)).cast("long"))
    cut = counted.mapInArrow(_cut("text", "gone"), "doc_id long, text string, n_deleted_lines long")
    body = F.coalesce("text", F.lit(""))
    return cut.select(
        "doc_id", "n_deleted_lines", F.char_length(body).cast("long").alias("kept_chars"),
        F.sha2(body.cast("binary"), 256).alias("kept_sha256"))
