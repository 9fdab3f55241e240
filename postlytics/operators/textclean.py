"""Page and title cleaning (I13, I14) and the word lists they use.

The dictionary and stop-word lists are lists or DataFrames: a Python list is a
hash-set probe inside the projection, a DataFrame of any size is joined on exploded
words.  Word order and duplicates inside a document are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlytics.functions.text import letters_only, tokens
from postlytics.operators.keywords import keyword_table, listed_words


def dictionary_from_text(df: DataFrame, text: str, min_length: int = 2) -> DataFrame:
    """A one-column word list (``word``) built from a text column: distinct
    lower-case ASCII-letter words of at least ``min_length`` letters."""
    return (df.select(F.explode(tokens(letters_only(F.col(text)))).alias("word"))
              .where(F.length("word") >= min_length).distinct())


def clean_pages(df: DataFrame, text: str, dictionary, stop_words: list[str], out: str = "cleaned",
                id_col: str | None = None) -> DataFrame:
    """Keep the words that are in ``dictionary`` (longer than one letter) and
    not stop words, joined by one space.  A null text gives ' '.  ``id_col``, if
    given, is unique per row and spares a dictionary DataFrame's join the text hash."""
    sw = sorted({w.lower() for w in stop_words})
    toks = tokens(letters_only(F.col(text)))
    if isinstance(dictionary, list):
        keep = sorted({w.lower() for w in dictionary if len(w) > 1} - set(sw))
        found = df.withColumn("_words", F.filter(toks, (lambda w: w.isin(*keep)) if keep else (lambda w: F.lit(False))))
    else:
        listed = keyword_table(dictionary).where((F.length("_w") > 1) & ~F.col("_w").isin(*sw))
        found = listed_words(df, text, toks, listed, id_col)
    return found.withColumn(out, F.when(F.col(text).isNull(), F.lit(" ")).otherwise(
        F.array_join("_words", " "))).drop("_words")


def clean_titles(df: DataFrame, title: str, stop_words: list[str], out: str = "clean_title") -> DataFrame:
    """Lower-case, drop characters that are neither word characters nor
    whitespace, drop stop words; result is the word array."""
    from postlytics.functions.text import clean_title_text
    sw = sorted({w.lower() for w in stop_words})
    return df.withColumn(out, F.filter(tokens(clean_title_text(F.col(title)), lower=False),
                                       lambda w: ~w.isin(*sw)))
