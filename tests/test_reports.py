"""Report pipelines (M6, M7) and the one-pass multi-column histogram."""

import random
import statistics

from pyspark.sql import DataFrame, functions as F

from postlytics.operators import explore
from postlytics.plans.reports import exploration_report, front_page_report


def _hist_rows(df, col):
    return sorted((r.bin, r.breakpoint, r["count"]) for r in explore.histogram(df, col, 10).collect())


def test_histograms_equal_single_column_histograms(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, rng.randint(-5, 40)]), rng.choice([None, rng.uniform(0, 3)]), 4.0)
            for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b double, c double")
    got = explore.histograms(df, ["a", "b", "c"]).collect()
    for col in ("a", "b", "c"):
        mine = sorted((r.bin, r.breakpoint, r["count"]) for r in got if r.column == col)
        assert mine == _hist_rows(df, col)
    # constant column: everything in the first bin, empty bins kept
    assert [r["count"] for r in sorted(got, key=lambda r: r.bin) if r.column == "c"] == [300] + [0] * 9


def test_histograms_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    got = explore.histograms(df, ["a"]).collect()
    assert len(got) == 10 and all(r["count"] == 0 and r.breakpoint is None for r in got)


def test_front_page_report_matches_brute_force(spark):
    rng = random.Random(3)
    front = [(rng.randint(1, 40), rng.randint(0, 5), m, float(rng.randint(0, 99)))
             for m in range(400)]                    # (id, time, minutes_since_pub, score)
    posts = [(i, rng.uniform(-10, 1000), rng.randint(1, 9), float(i)) for i in range(1, 36)]
    fdf = spark.createDataFrame(front, "id long, time long, minutes_since_pub long, score double")
    pdf = spark.createDataFrame(posts, "id long, user_karma double, user_post_count long, score double")
    cols = ["score", "user_karma", "user_post_count", "minutes_since_pub"]
    rep = front_page_report(fdf, pdf, ["time", "minutes_since_pub"], cols, cols, ["score"])
    # brute force: first snapshot per id by (time, minutes), inner join to posts
    first = {}
    for i, t, m, s in sorted(front, key=lambda r: (r[1], r[2])):
        first.setdefault(i, (i, t, m, s))
    pmap = {p[0]: p for p in posts}
    joined = [dict(score=s, minutes_since_pub=m, user_karma=pmap[i][1], user_post_count=pmap[i][2])
              for i, t, m, s in first.values() if i in pmap]
    s = rep["summary"].first()
    assert s.n_rows == len(joined)
    for c in cols:
        vals = [r[c] for r in joined]
        assert abs(s[f"average_{c}"] - statistics.fmean(vals)) < 1e-9
        assert abs(s[f"median_{c}"] - statistics.median(vals)) < 1e-9
    assert sum(r["count"] for r in rep["histograms"].collect()) == len(joined)


def test_exploration_report_builds(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        rows.append((i, 1_700_000_000 + rng.randint(0, 10**6), f"u{rng.randint(0, 30)}",
                     rng.choice([None, rng.randint(0, 500)]), rng.choice([None, rng.randint(0, 80)]),
                     rng.choice(["Rust is fast", "Elon Musk news", "Apple and Google", None, "misc"]),
                     rng.choice(["https://www.bbc.co.uk/x", "https://medium.com/y", None, "http://arxiv.org/z"]),
                     rng.uniform(0, 20000), rng.randint(1, 60)))
    posts = spark.createDataFrame(rows, "id long, time long, by string, score long, descendants long, "
                                        "title string, url string, user_karma double, user_post_count long")
    rep = exploration_report(posts)
    assert all(isinstance(v, DataFrame) for v in rep.values())
    assert rep["top_scores"].count() == 5
    assert rep["top_scores"].first().score is None              # nulls first, as in the reference
    flags = rep["contains_musk_counts"].collect()
    n_titles = len({r[5] for r in rows})                         # one row per distinct title (E1)
    assert sum(r["count"] for r in flags) == n_titles
    assert sum(r.entry_count for r in rep["posts_per_author"].collect()) == len({r[2] for r in rows})


def test_buzzwords_dedupe_by_post(spark):
    from postlytics.plans.features import build_features
    posts = spark.createDataFrame(
        [(1, 100, "rust news", "u1", None, 5.0, 30), (2, 200, "go", "u2", None, 3.0, 30),
         (3, 300, "rust news", "u3", None, 1.0, 30)],
        "id long, time long, title string, url string, text string, score double, minutes_since_pub long")
    # post 2's title is on the front page in three snapshots, posts 1 and 3 once each
    fp = spark.createDataFrame(
        [(1, "rust news", 100, 30, 5.0), (3, "rust news", 300, 30, 1.0)] +
        [(2, "go", 200 + k, 30, 3.0) for k in range(3)],
        "id long, title string, time long, minutes_since_pub long, score double")
    per_snapshot = build_features(posts, posts, fp, stop_words=[], buzzword_count=1, n_front=1)
    per_post = build_features(posts, posts, fp, stop_words=[], buzzword_count=1, n_front=1, dedupe_by="id")
    # per snapshot: go 3, rust 2, news 2 -> "go"; per post: rust 2 (first seen), news 2, go 1 -> "rust"
    assert {r.id: r.buzzwords_detail for r in per_snapshot.collect()} == {1: [], 2: ["go"], 3: []}
    assert {r.id: r.buzzwords_detail for r in per_post.collect()} == {1: ["rust"], 2: [], 3: ["rust"]}


def test_regression_and_forest_studies_run(spark):
    import random

    from postlytics.plans.studies import forest_study, regression_study
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 5), rng.uniform(0, 2), float(rng.randint(1, 20))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    reg = regression_study(df, ["a", "b"], "y", "id", alphas=[0.01, 0.1])
    assert reg["lasso_summary"].first().n == 300 and reg["poisson_summary"].count() == 1
    assert reg["pearson_all"].count() == 9
    small = {"n_estimators": [5], "max_depth": [3], "min_samples_split": [2], "min_samples_leaf": [2],
             "max_features": ["sqrt"]}
    fs = forest_study(df, ["a", "b"], "y", "id", "regressor", n_iter=1, folds=2, grid=small,
                      permutation_repeats=1)
    assert fs["impurity_importance"].count() == 2 and fs["shap_importance"].count() == 2
    assert fs["params"].count() >= 3


def test_every_keyword_list_of_the_whole_feature_table_flags_a_post(spark):
    from postlytics.plans import catalog
    d = catalog.q_post_features_full(spark, "/root/testdata/sf0.01")
    names = [*catalog.TITLE_LISTS, *catalog.URL_LISTS]
    got = d.agg(*[F.sum(f"contains_{n}").alias(n) for n in names], F.sum("body_length").alias("body"),
                *[F.sum(f"topic_{i}").alias(f"topic_{i}") for i in range(10)]).first().asDict()
    assert len(names) == 9 and all(v > 0 for v in got.values()), got


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_are_measured_over_all_posts_and_joined_to_those_with_topic(spark):
    """Repeats, medians and the index count posts without topic; only posts with one are
    returned, and no keyword pass or join reads the others' columns (F17)."""
    from postlytics.plans.features import build_features
    posts = spark.createDataFrame(
        [(i, 1000 * i, "Go and C" if i % 2 else None, "http://a.b/" if i % 3 else None, "x" * i, float(i), 30) for i in range(40)],
        "id long, time long, title string, url string, text string, score double, minutes_since_pub int")
    fp = posts.select("id", "title", "time", "minutes_since_pub", "score")
    made = {"stop_words": ["and"], "buzzword_count": 2, "n_front": 5, "title_lists": {"lang": ["go", "c"]}, "url_lists": {"a": ["a"]}}
    topics = spark.createDataFrame([(3, 1, 2), (4, 0, 1), (4, 2, 3), (36, 1, 1), (99, 1, 1)], "id long, topic int, length int")
    whole = {r.id: r.asDict() for r in build_features(posts, posts, fp, **made).collect()}
    out = build_features(posts, posts, fp, topics=topics, **made)
    assert "buzzwords_detail" in out.columns[-2:] and out.columns[-3] == "document_length"
    got = out.collect()
    assert sorted((r.id, r.topic_0, r.topic_1, r.topic_2, r.document_length) for r in got) == [
        (3, 0, 1, 0, 2), (4, 0, 0, 1, 3), (4, 1, 0, 0, 1), (36, 0, 1, 0, 1)]
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k in whole[r.id]} == whole[r.id]
    assert whole[36]["average_score_of_posts_before"] is None and whole[4]["count_last_12h"] == 2
    # the last join adds the repeat counts: the topics were joined before, by the key of the posts' own join
    assert next(x for x in _plan(out).splitlines() if "Join " in x).count("LeftOuter") == 1


def test_a_title_is_split_once_for_all_lists(spark):
    from postlytics.plans.features import infer_keywords
    df = spark.createDataFrame([(1, " A b\u00a0c a ", None), (2, "", "http://x.y/"), (3, None, None), (4, " \t", None)],
                               "id long, title string, url string")
    out = infer_keywords(df, {"one": ["A", "c"], "two": ["b"], "three": ["z"]}, {})
    assert _plan(out).count("regexp_extract_all(") == 1
    assert sorted((r.id, r.one_detail, r.contains_one, r.two_detail, r.contains_two, r.three_detail, r.contains_three) for r in out.collect()) == [
        (1, "a", 1, "b", 1, None, 0), (2, None, 0, None, 0, None, 0), (3, None, 0, None, 0, None, 0), (4, None, 0, None, 0, None, 0)]
    assert out.columns == ["id", "title", "url", *[f"{p}{n}{q}" for n in ("one", "two", "three") for p, q in (("", "_detail"), ("contains_", ""))]]
