"""License scans against an alignment of every template with every text, both ways, for short templates."""

import random

import numpy as np
import pytest

from nestfold.llm import licenses

SHORT = {**licenses.NOTICES, **licenses.OPENINGS}


def hashes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return licenses._hashes(data, np.array([0, len(data)]))[0]


def changed(rng, text):
    """The text with some words changed, left out or added."""
    words = text.split()
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        at = rng.randrange(len(words))
        kind = rng.choice("cda")
        if kind == "c":
            words[at] = "other"
        elif kind == "d" and len(words) > 1:
            del words[at]
        else:
            words.insert(at, rng.choice(["truly", "strictly", "the"]))
    return " ".join(words)


@pytest.mark.parametrize("name,text", [
    ("MIT-notice", "Released under MIT License"), ("all-rights-reserved", "All rights strictly reserved."),
    ("MIT-notice", "released, kindly, under our MIT license"), ("CC-BY-NC-4.0-notice", "licensed with CC BY-NC 4.0")])
def test_short_notices_with_a_changed_word(spark, name, text):
    df = spark.createDataFrame([(1, f"some prose before. {text} some prose behind")], "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert [r.license for r in got] == [name] and got[0].coverage >= 0.8


def test_equals_the_alignment_of_everything(spark):
    """A short template is found in a text if and only if the plain alignment reaches the coverage somewhere."""
    rng = random.Random(11)
    prose = "the cat sat on a mat and all of us had rights to the license under some version of it".split()
    texts = []
    for i in range(250):
        parts = [" ".join(rng.choice(prose) for _ in range(rng.randint(0, 25)))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            parts += [changed(rng, rng.choice(list(SHORT.values()))), " ".join(rng.choice(prose) for _ in range(rng.randint(8, 25)))]
        texts.append((i, " ".join(parts)))
    want = set()
    for i, text in texts:
        words = hashes(text)
        for name, template in SHORT.items():
            own = hashes(template)
            best = max((licenses.align(own, words, shift, licenses.band_of(own))[0] for shift in range(-len(own), len(words) + 1)), default=0)
            if len(own) < licenses.SHORT and best >= licenses.COVERAGE * len(own):
                want.add((i, name))
    short = {n: t for n, t in SHORT.items() if len(hashes(t)) < licenses.SHORT}
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), short).collect()
    assert {(r.id, r.license) for r in got} == want and len(want) > 100
    for r in got:
        assert r.matched >= licenses.COVERAGE * len(hashes(SHORT[r.license])) and r.begin_word < r.end_word


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
