"""Continuous-bag-of-words vectors: planted synonyms, edges, one batch by hand."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlytics.operators import wordvec
from postlytics.operators.topics import title_vectors

THEMES = ["abcdefgh", "ijklmnop", "qrstuvwx"]


@pytest.fixture(scope="module")
def texts(spark):
    """Three themes of eight words; in each, its "sun" and "moon" swap places."""
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        theme = rng.randrange(3)
        words = [f"w{c}" for c in rng.choices(THEMES[theme], k=8)]
        words[rng.randrange(8)] = f"{rng.choice(['sun', 'moon'])}{theme}"
        rows.append((i, words))
    return spark.createDataFrame(rows, "id long, words array<string>")


@pytest.mark.parametrize("part_words", [100_000, 4_000])
def test_planted_synonyms_are_nearest(texts, part_words):
    got = wordvec.cbow_vectors(texts, "words", size=20, epochs=6, part_words=part_words).collect()
    assert sum(r.n for r in got) == 1500 * 8 and len(got) == 24 + 6
    unit = {r.word: np.array(r.v) / np.linalg.norm(r.v) for r in got}
    for theme in range(3):
        near = sorted(unit, key=lambda w: -unit[w] @ unit[f"sun{theme}"])[1:6]
        assert near[0] == f"moon{theme}" and all(w[1] in THEMES[theme] for w in near[1:]), near


def test_same_vectors_whatever_the_layout(texts):
    few = texts.where("id < 200")
    got = [{r.word: np.round(r.v, 9).tolist() for r in wordvec.cbow_vectors(few.repartition(p), "words", size=5, epochs=1).collect()}
           for p in (1, 5)]
    assert got[0] == got[1]


def test_one_step_by_hand():
    """Two words, windows of one: the mean context is the neighbour's vector."""
    v, o = np.array([[0.3, -0.2], [0.1, 0.4]]), np.array([[0.5, 0.5], [-0.5, 0.2]])
    v0, o0 = v.copy(), o.copy()
    # all noise is the second word, so it is a wrong answer for the first centre only
    wordvec._train([np.array([0, 1])], v, o, np.array([0.0, 1.0]), np.random.default_rng(0), 1, 1, (0.1, 0.1))
    s = lambda x: 1 / (1 + np.exp(-x))
    up = [0.1 * (1 - s(v0[1] @ o0[0])), 0.1 * (1 - s(v0[0] @ o0[1]))]
    wrong = -0.1 * s(v0[1] @ o0[1])
    assert np.allclose(o[0], o0[0] + up[0] * v0[1])
    assert np.allclose(o[1], o0[1] + wrong * v0[1] + up[1] * v0[0])
    assert np.allclose(v[1], v0[1] + up[0] * o0[0] + wrong * o0[1])
    assert np.allclose(v[0], v0[0] + up[1] * o0[1])


def test_edges(spark, texts):
    rows = [(1, None), (1, ""), (2, "the"), (3, "Blue, sky"), (4, "Blue, sky"), (None, "blue")]
    df = spark.createDataFrame(rows, "id long, title string")
    got = title_vectors(df, "title", "id", ["the"], size=4).collect()
    norms = sorted(((r.id or 0), round(float(np.linalg.norm(r.vector)), 6)) for r in got)
    assert norms == [(0, 1.0), (1, 0.0), (1, 0.0), (2, 0.0), (3, 1.0), (4, 1.0)]
    assert title_vectors(df.limit(0), "title", "id", ["the"], size=4).count() == 0
    long = spark.createDataFrame([(["a", "b"] * wordvec.LONGEST, )], "w array<string>")
    assert {r.word: r.n for r in wordvec.cbow_vectors(long, "w", size=2, epochs=1).collect()} == dict.fromkeys("ab", wordvec.LONGEST)
    rare = spark.createDataFrame([(["a", "a", "b"], )], "w array<string>")
    assert [r.word for r in wordvec.cbow_vectors(rare, "w", size=2, epochs=1, min_count=2).collect()] == ["a"]


def test_a_group_returns_each_word_once():
    """Parts trained by one task start from the same vectors; their sum is that of the parts alone."""
    run = wordvec._epoch(2, 2, 1, (0.1, 0.05), 3, 1)
    texts = pa.table({"part": [4, 5, 5], "_row": [1, 2, 3], "_from": [1, 1, 1], "words": [["b", "a", "b"], ["c", "b"], ["a", "x", "c"]]})
    known = pa.table({"word": ["c", "a", "b"], "v": [[0.3, 0.1], [0.2, -0.1], [-0.4, 0.2]], "o": [[0.1, 0.0], [0.0, 0.2], [0.3, 0.1]]})
    whole, one, two = (run((pa.scalar(2),), texts.slice(*at), known).to_pylist() for at in ((0, 3), (0, 1), (1, 2)))
    assert [(r["word"], r["n"], r["group"]) for r in whole] == [("a", 2, 2), ("b", 3, 2), ("c", 2, 2)]
    for r, x, y in zip(whole, one, two):
        assert r["n"] == x["n"] + y["n"] and np.allclose(r["v"], np.add(x["v"], y["v"])) and np.allclose(r["o"], np.add(x["o"], y["o"]))


def test_waves_give_the_vectors_of_all_groups_at_once(texts, monkeypatch):
    """What an epoch ships follows the wave; words of later groups wait with their sums.  No epoch joins the words' groups."""
    monkeypatch.setattr(wordvec, "TOGETHER", 1)
    few, plans, cut = texts.where("id < 300"), [], wordvec.cut_lineage
    monkeypatch.setattr(wordvec, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = []
    for wave in (100, 2):
        plans.clear()
        got.append({r.word: (r.n, np.array(r.v)) for r in wordvec.cbow_vectors(few, "words", size=5, epochs=2, part_words=500, wave=wave).collect()})
        assert len(plans) == 2 + 2 * (1 if wave == 100 else 3)   # 2,400 words, 5 groups
        assert not any("Join" in p for p in plans)
    whole, waves = got
    assert sum(n for n, _ in whole.values()) == 2400 and whole.keys() == waves.keys()
    assert all(whole[w][0] == waves[w][0] and np.allclose(whole[w][1], waves[w][1], rtol=1e-12, atol=1e-15) for w in whole)
