"""Boundary-carry scans and keyed permutations against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from postlytics.operators import ordering, permute, regress


def _rows(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, n // 3), rng.choice([None, rng.randint(-50, 50), rng.randint(-50, 50)])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_previous_and_steps_do_not_depend_on_partitions(spark, parts):
    """17 partitions of few rows: some are empty, some hold one row."""
    for n in (0, 1, 9, 400):
        rows = _rows(n, n)
        df = spark.createDataFrame(rows, "id long, t long, v int").repartition(3)
        ordered = sorted(rows, key=lambda r: (r[1], r[0]))
        prev = {r[0]: p[2] if p else None for r, p in zip(ordered, [None, *ordered])}
        got = {r.id: r.p for r in ordering.with_previous(df, "v", ["t", "id"], "p", parts).collect()}
        assert got == prev
        diff = {r.id: r.diff for r in ordering.lag_difference(df, "v", ["t", "id"], num_partitions=parts).collect()}
        assert diff == {r[0]: r[2] - prev[r[0]] if None not in (r[2], prev[r[0]]) else None for r in rows}
        one = ordering.step_sums(df, "v", ["t", "id"], parts).first()
        steps = [d * d for d in diff.values() if d is not None]
        assert (one.steps or 0, one.squares or 0, one.n) == (sum(steps), sum(r[2] ** 2 for r in rows if r[2] is not None), n)


def test_previous_keeps_types_and_nulls_of_strings(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "id long, v string")
    assert sorted(map(tuple, ordering.with_previous(df, "v", ["id"], num_partitions=5).collect())) == [(1, "a", None), (2, None, "a"), (3, "c", None)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 97, 100, 101, 1000, 4099])
def test_permuted_is_a_bijection(spark, n):
    keys = permute.round_keys(n)
    got = [r[0] for r in spark.range(n).select(permute.permuted(F.col("id"), n, keys)).collect()]
    assert sorted(got) == list(range(n))


def test_permuted_mixes_neighbours_and_follows_its_key(spark):
    n = 20_000
    both = spark.range(n).select("id", *[permute.permuted(F.col("id"), n, permute.round_keys(s)).alias(f"p{s}") for s in (1, 2)])
    again = spark.range(n).repartition(7).select("id", permute.permuted(F.col("id"), n, permute.round_keys(1)).alias("p1"))
    rows = sorted(both.collect())
    assert {(r.id, r.p1) for r in rows} == {(r.id, r.p1) for r in again.collect()}
    assert sum(r.p1 == r.p2 for r in rows) < 10
    near = sum(abs(a.p1 - b.p1) < n // 10 for a, b in zip(rows, rows[1:])) / n  # 0.19 of random neighbours
    assert 0.17 < near < 0.21
    up = sum(a.p1 < b.p1 for a, b in zip(rows, rows[1:])) / n
    assert 0.48 < up < 0.52


def test_permuted_of_large_numbers_is_exact(spark):
    n = (1 << 59) + 12345
    a, b = permute.grid(n)
    keys = permute.round_keys(5)

    def network(x):
        left, right, p, q = x // b, x % b, a, b
        for k in keys:
            t = (right * 48271 + k) % permute.PRIME
            left, right, p, q = right, (left + (t * t + 40692 * t + k) % permute.PRIME) % p, q, p
        return left * b + right

    xs = [0, 1, n - 1, n // 3, 987654321987654321 % n]
    want = []
    for x in xs:
        y = network(x)
        while y >= n:
            y = network(y)
        want.append(y)
    df = spark.createDataFrame([(x,) for x in xs], "id long")
    assert [r[0] for r in df.select(permute.permuted(F.col("id"), n, keys)).collect()] == want


def test_certificates_see_a_fit_that_is_not_optimal(spark):
    rng = random.Random(2)
    rows = [(float(x), float(z), 3 * x - z + rng.gauss(0, 1)) for x, z in ((rng.gauss(0, 1), rng.gauss(0, 2)) for _ in range(500))]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    grams = regress.fold_grams(df, ["x", "z"], "y")[()]
    for alpha in (0.01, 0.5, 100.0):
        b0, b = regress.lasso_cd(grams, alpha)
        gaps = [r.gap for r in regress.lasso_certificate(df, ["x", "z"], "y", b0, list(b), alpha).collect()]
        assert len(gaps) == 3 and max(gaps) < 1e-6
    off = {r.feature: r.gap for r in regress.lasso_certificate(df, ["x", "z"], "y", b0 + 1, [0.0, 0.3], 0.5).collect()}
    assert off["(intercept)"] > 0.1 and off["z"] > 0.01
    counts = spark.createDataFrame([(float(i % 3), float(2 ** (i % 3))) for i in range(90)], "x double, y double")
    exact = regress.poisson_certificate(counts, ["x"], "y", 0.0, [math.log(2)], 0.0).collect()
    assert max(r.gap for r in exact) < 1e-12
    assert min(r.gap for r in regress.poisson_certificate(counts, ["x"], "y", 0.5, [0.1], 1.0).collect()) > 0.01
