"""Dimension reduction before clustering, and topics over it."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postlytics.operators import topics


@pytest.mark.parametrize("parts", [1, 5])
def test_leading_directions_against_a_full_decomposition(spark, parts):
    rnd = np.random.default_rng(1)
    left, right = np.linalg.qr(rnd.normal(size=(300, 6)))[0], np.linalg.qr(rnd.normal(size=(50, 6)))[0]
    full = left @ np.diag([50, 40, 30, 20, 10, 1]) @ right.T + rnd.normal(size=(300, 50)) * 0.01
    full[np.abs(full) < 0.02] = 0
    full[7] = 0
    rows = [(i, "extra", Vectors.sparse(50, [(j, x) for j, x in enumerate(r) if x])) for i, r in enumerate(full.tolist())]
    df = spark.createDataFrame(rows, ["id", "_at", "features"]).repartition(parts)
    got = {r.id: np.array(r.reduced) for r in topics.reduce_rows(df, "features", 50, ["id"], size=5).collect()}
    short = np.array([got[i] for i in range(300)])
    true = np.linalg.svd(full)
    assert not short[7].any()
    assert np.allclose(np.abs(short.T @ short), np.diag(true[1][:5] ** 2), atol=1e-3 * true[1][0] ** 2)
    want = full @ true[2][:5].T
    assert np.allclose(np.abs(short), np.abs(want), atol=1e-3 * np.abs(want).max())


def test_reduction_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(9, [(1, 1.0)]))], ["id", "features"]).limit(0)
    assert topics.reduce_rows(df, "features", 9, ["id"], size=3).collect() == []


def test_topics_recover_planted_ones(spark):
    r = random.Random(4)
    own = [[f"{c}{i}" for i in range(30)] for c in ("sea", "law", "tax")]
    shared = [f"the{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(own[i % 3], k=12) + r.choices(shared, k=12))) for i in range(240)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("Topic0", F.lit(0))
    found, info = topics.assign_topics(df, "body", "id", [], k=3, num_features=1 << 12, size=4)
    groups = {}
    for x in found.collect():
        groups.setdefault(x["id"] % 3, set()).add(x["Topic"])
    assert sorted(len(g) for g in groups.values()) == [1, 1, 1] and len(set.union(*groups.values())) == 3
    names = {x["Topic"]: x["Name"] for x in info.collect()}
    for i, word in enumerate(("sea", "law", "tax")):
        assert all(w.startswith(word) for w in names[next(iter(groups[i]))].split("_")[1:])


def test_held_rows_are_narrow_and_documents_are_not_dealt_by_topic(spark, monkeypatch, capsys):
    frame = type(spark.range(0))
    held, persist = [], frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a: (held.append(self.columns), persist(self, *a))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} x", "short") for i in range(60)], "Id long, Document string, Length string")
        out = topics.topic_table(docs, stop_words=["x"], k=3)
        assert out.count() == 60
        out.explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert held == [["Id", "_at", "_v"], ["_unit"]]  # no words
    assert "BroadcastHashJoin [Topic" in capsys.readouterr().out
