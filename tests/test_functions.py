"""Column expressions on hand-made edge rows (FIXTURES section 4)."""

from pyspark.sql import functions as F

from postlytics.functions import (cut, epoch_hour, hour_of_day, keyword_counted, keyword_flag,
                                  length_bucket, tokens, url_domain_keyword, weekday)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_cut_right_closed(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-1.0, 0.0, 3.0, 5.0, 5.5, 30.0, 31.0, None])],
                               "i int, v double")
    out = df.select("i", cut("v", [0, 5, 30], ["<0", "a", "b", "c"]).alias("b")).orderBy("i")
    assert [r.b for r in out.collect()] == ["<0", "<0", "a", "a", "b", "b", "c", None]


def test_time_features(spark):
    # 1970-01-01 09:00:00 UTC is Thursday 00:00 in the shifted clock -> 4
    df = spark.createDataFrame([(32400,), (32399,), (86400 * 3 + 32400,), (-1,)], "t long")
    out = df.select(weekday("t").alias("w"), hour_of_day("t").alias("h"),
                    epoch_hour("t", F.lit(30)).alias("e")).collect()
    assert [r.w for r in out] == [4, 3, 0, 3]
    assert [r.h for r in out] == [9, 8, 9, 23]
    assert [r.e for r in out] == [9, 9, 81, 0]


def test_tokens_python_whitespace(spark):
    texts = [" a b  c\t", "x y　z", "", None, "   "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.w for r in df.select(tokens("t").alias("w")).collect()]
    assert got == [t.lower().split() if t is not None else None for t in texts]


def test_keyword_flag_and_counted(spark):
    kws = ["apple", "Apple", "open ai", "rust"]
    titles = [None, "", "   ", " Apple pie", "rust and apple", "apple apple", "Open AI news", "APPLE"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    d1, f1 = keyword_flag("t", kws)
    d2, f2 = keyword_counted("t", kws)
    out = df.select("i", d1.alias("d1"), f1.alias("f1"), d2.alias("d2"), f2.alias("f2")).orderBy("i").collect()
    expect = [
        (None, 0, None, 0), (None, 0, None, 0), (None, 0, [], 0), ("apple", 1, ["apple"], 1),
        ("rust", 1, ["rust", "apple"], 2), ("apple", 1, ["apple", "apple"], 2), (None, 0, [], 0),
        ("apple", 1, ["apple"], 1),
    ]
    assert [(r.d1, r.f1, r.d2, r.f2) for r in out] == expect


def test_url_domain(spark):
    kws = ["google", "c++", "x.y", "news"]
    urls = [None, "google.com/a", "www.google.com", "https://a.b.google.com/x", "https://play.google.com/store",
            "https://a.play.google.com/", "https://google.play.com/", "https://WWW.GOOGLE.COM/",
            "https://example.com/google.html", "http://c++.org", "http://x.y.org", "http://xzy.org",
            "https://www.news.bbc.co.uk/", "https://apps.news.com"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    d, f = url_domain_keyword("u", kws)
    got = [(r.d, r.f) for r in df.select("i", d.alias("d"), f.alias("f")).orderBy("i").collect()]
    assert got == [(None, 0), ("google", 1), ("google", 1), ("google", 1), (None, 0), (None, 0),
                   ("google", 1), (None, 0), (None, 0), ("c++", 1), ("x.y", 1), (None, 0),
                   ("news", 1), (None, 0)]


def test_length_bucket(spark):
    df = spark.createDataFrame([("a" * 50,), ("a" * 51,), ("a" * 200,), ("a" * 201,), (None,)], "t string")
    assert [r.b for r in df.select(length_bucket("t").alias("b")).collect()] == [1, 2, 2, 3, 1]


def test_url_keywords_join_path_equals_pattern(spark):
    import random

    from postlytics.operators import keywords
    rng = random.Random(5)
    labels = ["www", "apps", "play", "bbc", "co", "uk", "cnn", "news", "a-b", "x1", "Cnn", "chromewebstore",
              "wired", "medium"]
    kws = ["bbc", "bbc.co", "cnn", "news", "wired", "co", "www", "uk", "medium", "x1", "a-b", "https:", "play"]

    def url():
        s = rng.choice(["", "http://", "https://", "ftp://"]) + ("www." if rng.random() < 0.4 else "")
        s += ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5)))
        return s + rng.choice(["", ".", "/", "/path.html", ".com/x.y", ":8080/a"])

    rows = [(i, url() if rng.random() > 0.05 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, url string")
    pattern = {r.id: (r.d_detail, r.contains_d) for r in
               keywords.url_keywords(df, "url", sorted(set(kws)), "d").collect()}
    kdf = spark.createDataFrame([(k,) for k in kws], "w string")
    joined = {r.id: (r.d_detail, r.contains_d) for r in
              keywords._url_keywords_join(df, "url", kdf, "d", "id").collect()}
    assert joined == pattern and sum(v[1] for v in pattern.values()) > 500


def test_url_keywords_lower_url_option(spark):
    from postlytics.operators import keywords
    df = spark.createDataFrame([(1, "https://www.CNN.com/x"), (2, "http://cnn.com")], "id long, url string")
    kdf = spark.createDataFrame([("CNN",)], "w string")
    for lower, want in ((False, {1: 0, 2: 1}), (True, {1: 1, 2: 1})):
        lit = keywords.url_keywords(df, "url", ["cnn"], "n", lower_url=lower)
        join = keywords._url_keywords_join(df, "url", kdf, "n", "id", lower)
        assert {r.id: r.contains_n for r in lit.collect()} == want
        assert {r.id: r.contains_n for r in join.collect()} == want


def test_keyword_frames_of_any_size_equal_lists(spark):
    """A list as DataFrame, below and above two thousand words, with and without an id."""
    from postlytics.operators import keywords, textclean
    rows = [(i, t) for i, t in enumerate(["alpha beta alpha", "", None, "Beta w7 x", "none", " "] + ["alpha w7"] * 50)]
    df = spark.createDataFrame(rows, "id long, t string")
    for n in (0, 3000):
        words = ["alpha", "BETA", "x"] + [f"w{i}" for i in range(n)]
        frame = spark.createDataFrame([(w,) for w in words + [None, "", "alpha"]], "w string")
        for counted in (False, True):
            want = {r.id: (r.k_detail, r.contains_k) for r in
                    keywords.title_keywords(df, "t", words, "k", counted).collect()}
            for id_col in ("id", None):
                got = keywords.title_keywords(df, "t", frame, "k", counted, id_col).collect()
                assert {r.id: (r.k_detail, r.contains_k) for r in got} == want and len(got) == len(rows)
        want = {r.id: r.cleaned for r in textclean.clean_pages(df, "t", words, ["beta"]).collect()}
        for id_col in ("id", None):
            got = textclean.clean_pages(df, "t", frame, ["beta"], id_col=id_col).collect()
            assert {r.id: r.cleaned for r in got} == want and len(got) == len(rows)


def test_url_keyword_frame_keeps_list_order(spark):
    from postlytics.operators import keywords
    df = spark.createDataFrame([("https://a.b.com",)] * 3 + [(None,)], "url string")
    for order in (["a.b", "a"], ["a", "a.b"]):
        frame = spark.createDataFrame([(w, i) for i, w in enumerate(order)], "w string, at int")
        want = [r.k_detail for r in keywords.url_keywords(df, "url", order, "k").collect()]
        got = [r.k_detail for r in keywords.url_keywords(df, "url", frame, "k").collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and got.count(order[0]) == 3


def test_spread_only_when_too_few_splits(spark):
    from postlytics.session import spread
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(0, 1000, numPartitions=1)
    many = spark.range(0, 1000, numPartitions=cores)
    assert spread(one).rdd.getNumPartitions() == 2 * cores
    assert spread(many) is many                       # enough splits: no shuffle added
    assert sorted(r.id for r in spread(one).collect()) == list(range(1000))
