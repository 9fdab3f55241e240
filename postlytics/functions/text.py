"""Text expressions.

Whitespace is the set Python's ``str.split()`` splits on: Java's ``\\s`` plus the
information separators U+001C-U+001F, NEL (U+0085) and every Unicode space
separator (``\\p{Z}``), so U+00A0 separates words as it does in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlytics.functions._util import as_col

# Fixed value: the whitespace class used by every tokeniser in the library.
WHITESPACE_CLASS = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]"
_WORD = f"[^{WHITESPACE_CLASS[1:-1]}]+"


def tokens(text, lower: bool = True) -> Column:
    """Split on runs of whitespace, drop empty pieces (I11): the runs of anything else,
    whose pattern Spark compiles once a task, not once a row.  Null stays null."""
    t = as_col(text)
    if lower:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))


def char_length(text, null_as_zero: bool = False) -> Column:
    """Length in code points."""
    n = F.char_length(as_col(text)).cast("long")
    return F.coalesce(n, F.lit(0).cast("long")) if null_as_zero else n


def length_bucket(text) -> Column:
    """> 200 characters -> 3, > 50 -> 2, else 1."""
    n = F.char_length(F.coalesce(as_col(text), F.lit("")))
    return F.when(n > 200, 3).when(n > 50, 2).otherwise(1).cast("int")


def flag_pattern(col, words: list[str] | str) -> Column:
    """Case-insensitive substring-regex flag (I7).  ``words`` is an alternation
    string or a list of alternatives (used as given: regex characters keep their
    meaning, as in the reference).  Null stays null."""
    alt = words if isinstance(words, str) else "|".join(words)
    return as_col(col).rlike("(?i)" + alt + "(?-i)")


def keyword_matches(title, keywords: list[str], words: Column | None = None) -> Column:
    """Words of the lower-cased title (``words``, if the caller holds them) that equal a
    keyword, in title order (I10).

    Keywords are lower-cased and de-duplicated; multi-word keywords cannot match
    a single word and are kept only for fidelity."""
    kws = sorted({k.lower() for k in keywords if isinstance(k, str) and k})
    words = tokens(title) if words is None else words
    if not kws:
        return F.filter(words, lambda w: F.lit(False))
    # ``isin`` over many literals becomes a hash-set probe (InSet)
    return F.filter(words, lambda w: w.isin(*kws))


def _empty_title(title) -> Column:
    t = as_col(title)
    return t.isNull() | (t == F.lit(""))


def keyword_flag(title, keywords: list[str], matches: Column | None = None) -> tuple[Column, Column]:
    """(detail, flag): first matching word or null, and 1/0.  Null or '' -> (null, 0)."""
    m = keyword_matches(title, keywords) if matches is None else matches
    empty = _empty_title(title)
    detail = F.when(empty, F.lit(None).cast("string")).otherwise(F.get(m, 0))
    flag = F.when(empty, F.lit(0)).otherwise(F.when(F.size(m) > 0, 1).otherwise(0)).cast("int")
    return detail, flag


def keyword_counted(title, keywords: list[str], matches: Column | None = None) -> tuple[Column, Column]:
    """(detail, count): all matching words and their number.  Null or '' -> (null, 0);
    an all-space title gives ([], 0)."""
    m = keyword_matches(title, keywords) if matches is None else matches
    empty = _empty_title(title)
    detail = F.when(empty, F.lit(None).cast("array<string>")).otherwise(m)
    count = F.when(empty, F.lit(0)).otherwise(F.size(m)).cast("int")
    return detail, count


def letters_only(text) -> Column:
    """I13 first step: null -> ' ', newline -> space, delete everything but ASCII
    letters and whitespace, lower-case."""
    t = F.regexp_replace(F.replace(as_col(text), F.lit("\n"), F.lit(" ")),
                         "[^a-zA-Z\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]", "")
    return F.lower(t)


def clean_title_text(title) -> Column:
    """Lower-case and delete everything that is neither a word character
    (Unicode letters, digits, underscore) nor whitespace."""
    return F.regexp_replace(F.lower(as_col(title)),
                            "[^\\p{L}\\p{N}_\\s\\x1c-\\x1f\\x85\\p{Z}]", "")


def concat_text(*cols) -> Column:
    """Join pieces with one space; null pieces count as ''."""
    return F.concat_ws(" ", *[F.coalesce(as_col(c), F.lit("")) for c in cols])
