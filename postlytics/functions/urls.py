"""URL-domain keyword (I8).

A url matches keyword ``kw`` when it reads, from its start,
``(http://|https://)? (www.)? (label.)* kw.`` -- the keyword is a whole domain
label followed by a dot.  The match is rejected when the label right before the
keyword is ``apps.``, ``play.`` or ``chromewebstore.`` (store pages, not the
company); no other match is tried.  Keywords are lower-cased, urls are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlytics.functions._util import as_col

# Sub-domain labels that mark an app-store page.
STORE_LABELS = ["apps.", "play.", "chromewebstore."]

_SPECIAL = set(".^$*+?()[]{}|\\/-")


def regex_escape(word: str) -> str:
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in word)


def domain_pattern(keywords: list[str]) -> str:
    kws = []
    for k in keywords:
        if isinstance(k, str) and k and k.lower() not in kws:
            kws.append(k.lower())
    alt = "|".join(regex_escape(k) for k in kws) if kws else "(?!)"
    return "^(?:https?://)?(?:www\\.)?([a-zA-Z0-9-]+\\.)*(" + alt + ")\\."


def url_domain_keyword(url, keywords: list[str], lower_url: bool = False) -> tuple[Column, Column]:
    """(detail, flag) for the url: matched keyword or null, and 1/0.  Null url -> (null, 0).
    Keywords are lower-cased; the url only with ``lower_url`` (the reference
    does not, so ``CNN.com`` misses ``cnn``)."""
    u = F.lower(as_col(url)) if lower_url else as_col(url)
    p = domain_pattern(keywords)
    label = F.regexp_extract(u, p, 1)
    ok = u.rlike(p) & ~label.isin(*STORE_LABELS)
    detail = F.when(u.isNotNull() & ok, F.regexp_extract(u, p, 2))
    flag = F.when(u.isNotNull() & ok, 1).otherwise(0).cast("int")
    return detail, flag



def domain_candidates(df: DataFrame, url: str, id_col: str) -> DataFrame:
    """Join form of ``url_domain_keyword``: one row (id, pos, label, candidate)
    per place a keyword could match.  ``pos`` (0-based) runs over where the
    pattern lets a keyword start -- after each label of the leading
    ``[a-zA-Z0-9-]+.`` run that follows an optional scheme and ``www.``, at the
    run's start, at the ``www.`` itself and, with a scheme, at the very start;
    ``candidate`` is the url text from ``pos`` up to any later dot; ``label`` is
    the run label right before ``pos`` with its dot ('' when none).  The regex
    takes the largest ``pos`` with a matching keyword, so a keyword equal to a
    candidate at the largest such ``pos`` is the match."""
    u = F.col(url)
    d = (df.select(F.col(id_col).alias("_id"), u.alias("_u")).where(u.isNotNull())
           .withColumn("_s", F.when(F.col("_u").startswith("https://"), 8)
                              .when(F.col("_u").startswith("http://"), 7).otherwise(0)))
    d = d.withColumn("_www", F.expr("substr(_u, _s + 1, 4) = 'www.'"))
    d = d.withColumn("_w", F.expr("_s + IF(_www, 4, 0)"))
    d = d.withColumn("_run", F.regexp_extract(F.expr("substr(_u, _w + 1)"), r"^((?:[a-zA-Z0-9-]+\.)*)", 1))
    # 1-based offsets of the dots inside the run; 0-based offsets of all dots in the url
    d = d.withColumn("_rd", F.expr("filter(sequence(1, length(_run)), k -> substr(_run, k, 1) = '.')"))
    d = d.withColumn("_dots", F.expr(
        "transform(filter(sequence(1, length(_u)), k -> substr(_u, k, 1) = '.'), k -> k - 1)"))
    starts = F.expr("""concat(
        transform(sequence(0, size(_rd)), i -> named_struct(
            'pos', _w + IF(i = 0, 0, _rd[i - 1]),
            'label', IF(i = 0, '', substr(_u, _w + IF(i = 1, 0, _rd[i - 2]) + 1,
                                         _rd[i - 1] - IF(i = 1, 0, _rd[i - 2]))))),
        IF(_www, array(named_struct('pos', _s, 'label', '')), array()),
        IF(_s > 0, array(named_struct('pos', 0, 'label', '')), array()))""")
    cands = F.flatten(F.transform(starts, lambda b: F.transform(
        F.filter(F.col("_dots"), lambda q: q > b["pos"]),
        lambda q: F.struct(b["pos"].alias("pos"), b["label"].alias("label"), q.alias("q")))))
    x = d.select("_id", "_u", F.explode(cands).alias("_c"))
    return x.select(F.col("_id").alias(id_col), F.col("_c.pos").alias("pos"), F.col("_c.label").alias("label"),
                    F.expr("substr(_u, _c.pos + 1, _c.q - _c.pos)").alias("candidate"))
