"""Ordered operators against plain Python definitions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from postlytics.operators.ordering import dense_index, forward_features
from postlytics.operators.repeats import repeat_counts


def _posts(spark, n, seed=1, null_every=0):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        score = None if null_every and i % null_every == 0 else float(rnd.randint(0, 50))
        data.append((i, rnd.randint(0, 10 ** 6), score))
    return spark.createDataFrame(data, "id long, time long, score double")


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_dense_index_partitions(spark, parts):
    df = _posts(spark, 300)
    idx, n = dense_index(df, ["time", "id"], "idx", num_partitions=parts)
    got = {r.id: r.idx for r in idx.collect()}
    want = {r[0]: i for i, r in enumerate(sorted(((r.id, r.time) for r in df.collect()), key=lambda x: (x[1], x[0])))}
    assert n == 300 and got == want


def test_dense_index_empty_partitions(spark):
    df = spark.createDataFrame([(i, 5) for i in range(3)], "id long, time long")
    idx, n = dense_index(df, ["time", "id"], "idx", num_partitions=17)
    assert n == 3 and sorted(r.idx for r in idx.collect()) == [0, 1, 2]


def _brute(rows, n=30):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    out = {}
    for i, (id_, t, s) in enumerate(rows):
        if i < len(rows) - n:
            vals = [x[2] for x in rows[i:i + n] if x[2] is not None]
            med = statistics.median(vals) if vals else None
            out[id_] = (rows[i + n][1] - t, med)
        else:
            out[id_] = (None, None)
    return out


@pytest.mark.parametrize("n_rows", [0, 1, 29, 30, 31, 61, 250])
def test_forward_features(spark, n_rows):
    df = _posts(spark, n_rows, seed=n_rows, null_every=7)
    out = forward_features(df, ["time", "id"], 30, leads={"lead": "time"}, medians={"med": "score"},
                           bucket_rows=37)
    got = {r.id: (r.lead, r.med) for r in out.collect()}
    assert got == _brute([(r.id, r.time, r.score) for r in df.collect()])


def test_forward_all_null_frame(spark):
    df = spark.createDataFrame([(i, i, None) for i in range(40)], "id long, time long, score double")
    out = forward_features(df, ["time", "id"], 30, medians={"med": "score"}, bucket_rows=30)
    assert all(r.med is None for r in out.collect())


def test_repeat_counts_edges(spark):
    h = 12 * 3600
    data = [(1, "u", 100000), (2, "u", 100000), (3, "u", 100000 + h), (4, "u", 100000 + h + 1),
            (5, None, 100000), (6, "u", None), (7, "v", 100000 + h), (8, "u", 100000 + 2 * h)]
    df = spark.createDataFrame(data, "id long, url string, time long")
    got = {r.id: r.c for r in repeat_counts(df, "url", "time", {"c": h}).collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: 1, 5: 0, 6: 0, 7: 0, 8: 2}


def test_repeat_counts_random_hot_key(spark):
    rnd = random.Random(7)
    data = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 5)}", rnd.randint(0, 10 * 86400))
            for i in range(1500)]
    df = spark.createDataFrame(data, "id long, url string, time long")
    hs = {"c12": 12 * 3600, "c48": 48 * 3600}
    got = {r.id: (r.c12, r.c48) for r in repeat_counts(df, "url", "time", hs).collect()}
    want = {}
    for i, u, t in data:
        want[i] = tuple(sum(1 for _, u2, t2 in data if u2 == u and t - h <= t2 < t) for h in hs.values())
    assert got == want


def test_repeat_counts_burst_and_partition_invariance(spark):
    # a third of the rows: one url at a handful of equal timestamps inside one chunk
    rnd = random.Random(9)
    data = []
    for i in range(1200):
        if i % 3 == 0:
            data.append((i, "hot", 500_000 + rnd.choice([0, 0, 0, 1, 7200, 43199, 43200])))
        else:
            data.append((i, rnd.choice([None, "a", "b"]), rnd.choice([None, rnd.randint(400_000, 700_000)])))
    hs = {"c12": 12 * 3600, "c48": 48 * 3600}
    want = {}
    for i, u, t in data:
        if u is None or t is None:
            want[i] = (0, 0)
        else:
            want[i] = tuple(sum(1 for _, u2, t2 in data if u2 == u and t2 is not None and t - h <= t2 < t)
                            for h in hs.values())
    for parts in (1, 4, 17):
        df = spark.createDataFrame(data, "id long, url string, time long").repartition(parts)
        got = {r.id: (r.c12, r.c48) for r in repeat_counts(df, "url", "time", hs).collect()}
        assert got == want


def test_exact_quantiles_equal_percentile(spark):
    import random

    from pyspark.sql import functions as F

    from postlytics.operators.ordering import exact_quantiles
    rng = random.Random(11)
    # column b: one value holds over a third of the rows (hot value)
    rows = [(rng.choice([None, rng.gauss(0, 1)]),
             rng.choice([None, 7.0, 7.0, 7.0, float(rng.randint(0, 5))]), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    ref = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in "abc"]).first()
    for parts in (1, 4, 17):
        got = exact_quantiles(df, ["a", "b", "c"], probs, num_partitions=parts)
        assert got["a"] == list(ref["a"]) and got["b"] == list(ref["b"])
        assert got["c"] == [None] * len(probs)


def _grouped(n, rng):
    """Group "hot" holds half the rows; null keys, null values and ties included."""
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), rng.choice([None, 1, 2]),
             rng.choice([None, rng.gauss(0, 1), 7.0, 7.0])) for _ in range(n)]
    return rows + [("empty", 1, None)]


@pytest.mark.parametrize("n, accuracy", [(3000, 10_000), (3000, 20), (60, 10_000), (40_000, 100)])
def test_bracket_quantiles_equal_percentile(spark, n, accuracy):
    """A coarse sketch leaves most values outside the brackets; tiny groups have none."""
    import random

    from pyspark.sql import functions as F

    from postlytics.operators.quantiles import bracket_quantiles
    df = spark.createDataFrame(_grouped(n, random.Random(n)), "g string, h int, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    ref = {(r.g, r.h): r.q for r in df.groupBy("g", "h").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    for parts in (1, 5):
        got = {(r.g, r.h): list(r._q) for r in bracket_quantiles(
            df.repartition(parts), ["g", "h"], "v", probs, accuracy=accuracy).collect()}
        assert got == {k: list(v) for k, v in ref.items() if v is not None}
        assert ("empty", 1) not in got


@pytest.mark.parametrize("kind", ["tinyint", "bigint", "float", "double"])
def test_bracket_quantiles_of_a_hot_group_of_any_type(spark, kind):
    """One group holds a third of the rows, the others are many and small."""
    from pyspark.sql import functions as F

    from postlytics.operators.quantiles import bracket_quantiles
    v = f"CAST(pmod(xxhash64(id), 100) AS {kind})" if kind == "tinyint" else f"CAST(pmod(xxhash64(id), 1000003) AS {kind})"
    df = spark.range(60_000).selectExpr("IF(id % 3 = 0, -1, id % 997) AS g", f"{v} AS v")
    ref = {r.g: list(r.q) for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(.1), F.lit(.5), F.lit(.9))).alias("q")).collect()}
    assert {r.g: list(r._q) for r in bracket_quantiles(df, ["g"], "v", [.1, .5, .9], accuracy=500).collect()} == ref
    assert bracket_quantiles(df.limit(0), ["g"], "v", [.5]).count() == 0


def _brute_backward(rows, n=30):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    out = {}
    for i, (id_, t, s) in enumerate(rows):
        if i >= n:
            vals = [x[2] for x in rows[i - n + 1:i + 1] if x[2] is not None]
            out[id_] = (t - rows[i - n][1], statistics.median(vals) if vals else None)
        else:
            out[id_] = (None, None)
    return out


@pytest.mark.parametrize("n_rows", [0, 1, 29, 30, 31, 250])
def test_backward_features(spark, n_rows):
    df = _posts(spark, n_rows, seed=n_rows + 1, null_every=5)
    out = forward_features(df, ["time", "id"], 30, leads={"lead": "time"}, medians={"med": "score"},
                           bucket_rows=37, direction="backward")
    got = {r.id: (r.lead, r.med) for r in out.collect()}
    assert got == _brute_backward([(r.id, r.time, r.score) for r in df.collect()])


def test_forward_features_of_wide_rows_equal_narrow_ones(spark):
    """Columns beyond the order and value columns come back by a join on the order
    columns, null keys included."""
    rows = [(None if i == 7 else i, i % 50, float(i * 7 % 31), "x" * i) for i in range(300)]
    wide = spark.createDataFrame(rows, "id long, time long, score double, body string")
    made = {"leads": {"lead": "time"}, "medians": {"med": "score"}, "bucket_rows": 40, "num_partitions": 3}
    got = forward_features(wide, ["time", "id"], 5, **made)
    want = forward_features(wide.drop("body"), ["time", "id"], 5, **made)
    assert got.columns == ["id", "time", "score", "body", "lead", "med"]
    assert {r.id: (len(r.body), r.lead, r.med) for r in got.collect()} == {
        r.id: (7 if r.id is None else r.id, r.lead, r.med) for r in want.collect()}
    assert got.count() == 300


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_values_of_all_rows_are_joined_to_the_rows_asked_for(spark, direction):
    df = spark.createDataFrame([(None if i == 7 else i, i % 50, float(i * 7 % 31), f"u{i % 3}") for i in range(200)],
                               "id long, time long, score double, url string")
    rows = df.where("id is null or id % 11 = 0").select("time", "id", "url", F.lit("x").alias("more"))
    made = {"leads": {"lead": "time"}, "medians": {"med": "score"}, "bucket_rows": 40, "num_partitions": 3, "direction": direction}
    got = forward_features(df, ["time", "id"], 5, rows=rows, **made)
    want = {r.id: (r.lead, r.med) for r in forward_features(df, ["time", "id"], 5, **made).collect()}
    assert got.columns == ["time", "id", "url", "more", "lead", "med"]
    assert {r.id: (r.lead, r.med) for r in got.collect()} == {i: want[i] for i in [None, *range(0, 200, 11)]}
    counts = repeat_counts(df, "url", "time", {"c": 20}, rows=got)
    want = {r.id: r.c for r in repeat_counts(df, "url", "time", {"c": 20}).collect()}
    assert counts.columns == [*got.columns, "c"]
    assert {r.id: r.c for r in counts.collect()} == {i: want[i] for i in [None, *range(0, 200, 11)]}
