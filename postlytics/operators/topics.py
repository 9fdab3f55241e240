"""Topics and title vectors.

L19 is re-aimed: the neural document embedding and reduction of the reference
become hashed TF-IDF vectors (no vocabulary on the driver), L2-normalised, reduced to
their leading directions by a randomised range finder, with k-means (k = 10) as the
clustering step -- the clustering step the reference also uses.  Topic names follow the class-based TF-IDF idea: per topic, words
weighted by tf_topic(w) * log(1 + A / f(w)), A the mean word count per topic,
f(w) the word's count over all topics; the name is "<topic>_<w1>_<w2>_<w3>_<w4>".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from postlytics.functions.text import WHITESPACE_CLASS, tokens
from postlytics.operators.wordvec import cbow_vectors, mean_vectors
from postlytics.session import cut_lineage


def _tfidf(df: DataFrame, text: str, stop_words: list[str], num_features: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StopWordsRemover
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=WHITESPACE_CLASS + "+", gaps=True,
                       toLowercase=True),
        StopWordsRemover(inputCol="_tok", outputCol="_words", stopWords=list(stop_words)),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="features", p=2.0),
    ])


def _projected(batch: pa.RecordBatch, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of each stored entry of the sparse rows (columns ``_at``, ``_v``),
    its value, and the rows times ``basis``."""
    at, value = (batch.column(batch.schema.get_field_index(c)) for c in ("_at", "_v"))
    row = np.repeat(np.arange(batch.num_rows), at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at, value = at.flatten().to_numpy(), value.flatten().to_numpy()
    return row, at, value, np.stack([np.bincount(row, value * v[at], batch.num_rows) for v in basis.T], axis=1)


def leading_directions(rows: DataFrame, num_features: int, size: int = 32, oversample: int = 8, passes: int = 3,
                       seed: int = 42) -> np.ndarray:
    """The ``size`` leading right singular vectors (columns) of the sparse ``rows`` (``_at``
    array of feature numbers, ``_v`` array of values), by a randomised range finder with
    ``passes`` subspace steps (Halko, Martinsson and Tropp 2011).

    A step is one scan: every task adds up its rows' part of A'(A V) and sends a line a
    feature that it has met; these are summed by feature, combined before the shuffle.  Driver and tasks hold
    num_features x (size + oversample) numbers (21 MB by default), whatever the rows' number.
    A table without rows gives arbitrary orthonormal directions."""
    width = min(size + oversample, num_features)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(num_features, width)))[0]
    sc = rows.sparkSession.sparkContext
    small: np.ndarray
    for step in range(passes):
        held = sc.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = held.value
            total, met = np.zeros((v.shape[1], num_features)), np.zeros(num_features, bool)
            for batch in batches:
                row, at, value, part = _projected(batch, v)
                met[at] = True
                for j, p in enumerate(part.T):
                    total[j] += np.bincount(at, value * p[row], num_features)
            found = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(t[found]) for t in total)],
                                             ["feature", *(f"c{j}" for j in range(v.shape[1]))])

        cols = [f"c{j}" for j in range(width)]
        sums = (rows.select("_at", "_v").mapInArrow(run, "feature long, " + ", ".join(f"{c} double" for c in cols))
                .groupBy("feature").agg(*[F.sum(c).alias(c) for c in cols]))
        image = np.zeros((num_features, width))
        summed = sums.toArrow()  # at most num_features rows
        image[summed["feature"].to_numpy()] = np.stack([summed[c].to_numpy() for c in cols], axis=1)
        held.destroy()
        small = basis.T @ image
        if step + 1 < passes:
            basis = np.linalg.qr(image)[0]
    value, turn = np.linalg.eigh((small + small.T) / 2)
    return basis @ turn[:, np.argsort(-value, kind="stable")[:size]]


def reduce_rows(df: DataFrame, features: str, num_features: int, keep: list[str], out_col: str = "reduced",
                size: int = 32, passes: int = 3, seed: int = 42, directions: np.ndarray | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``out_col``, the sparse vectors of ``features`` in
    ``directions``, else their ``leading_directions`` (an array of ``size`` numbers).  An empty
    vector becomes zeros."""
    parts = F.unwrap_udt(features)
    rows = df.select(*keep, parts["indices"].alias("_at"), parts["values"].alias("_v"))
    if directions is None:
        directions = leading_directions(rows, num_features, size, passes=passes, seed=seed)
    return project(rows, directions, keep, out_col)


def project(rows: DataFrame, directions: np.ndarray, keep: list[str], out_col: str = "reduced") -> DataFrame:
    """The columns ``keep`` and ``out_col``, the sparse ``rows`` (last columns ``_at``, ``_v``) times ``directions``."""
    from pyspark.sql.types import ArrayType, DoubleType, StructType
    held = rows.sparkSession.sparkContext.broadcast(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _projected(batch, held.value)[3]
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * part.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.ListArray.from_arrays(ends, pa.array(part.ravel()))],
                                             [*keep, out_col])

    return rows.mapInArrow(run, StructType(rows.schema.fields[:-2]).add(out_col, ArrayType(DoubleType())))


def assign_topics(df: DataFrame, text: str, id_col: str, stop_words: list[str], k: int = 10,
                  seed: int = 42, num_features: int = 1 << 16, top_n: int = 4, size: int = 32) -> tuple[DataFrame, DataFrame]:
    """Returns (doc_topics: id, Topic; topic_info: Topic, Count, Name).  The TF-IDF rows are
    reduced to ``size`` directions and normalised again before they are clustered.  What the
    many scans read is held narrow: the sparse vectors for the directions, the short ones for
    the clustering; the words are made again for the one scan that assigns the topics."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector
    d = df.select(id_col, text).where(F.col(text).isNotNull())
    feats = _tfidf(d, text, stop_words, num_features).fit(d).transform(d).select(id_col, "_words", "features")
    # the id stays, as a round-robin deal below goes by the columns that are read
    sparse = feats.select(id_col, F.unwrap_udt("features").alias("_f")).select(id_col, F.col("_f.indices").alias("_at"), F.col("_f.values").alias("_v")).persist()
    directions = leading_directions(sparse, num_features, size, seed=seed)

    def unit(rows):
        return Normalizer(inputCol="_short", outputCol="_unit").transform(rows.withColumn("_short", array_to_vector("reduced")))

    short = unit(project(sparse.select("_at", "_v"), directions, [])).select("_unit").persist()
    model = KMeans(k=k, seed=seed, featuresCol="_unit", predictionCol="Topic").fit(short)
    whole = unit(reduce_rows(feats, "features", num_features, [id_col, "_words"], directions=directions))
    assigned = cut_lineage(model.transform(whole).select(id_col, "Topic", "_words"))
    short.unpersist()
    sparse.unpersist()
    words = assigned.select("Topic", F.explode("_words").alias("word"))
    tf = words.groupBy("Topic", "word").agg(F.count(F.lit(1)).alias("tf"))
    fw = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    per_topic = tf.groupBy("Topic").agg(F.sum("tf").alias("n"))
    avg_words = per_topic.agg(F.avg("n")).first()[0] or 1.0
    weighted = tf.join(fw, "word").withColumn("w", F.col("tf") * F.log1p(F.lit(avg_words) / F.col("f")))
    rank = F.row_number().over(Window.partitionBy("Topic").orderBy(F.desc("w"), F.asc("word")))
    top = (weighted.withColumn("_r", rank).where(F.col("_r") <= top_n)
                   .groupBy("Topic").agg(F.sort_array(F.collect_list(F.struct("_r", "word"))).alias("_ws")))
    counts = assigned.groupBy("Topic").agg(F.count(F.lit(1)).alias("Count"))
    info = counts.join(top, "Topic", "left").select(
        "Topic", "Count",
        F.concat_ws("_", F.col("Topic").cast("string"),
                    F.array_join(F.transform("_ws", lambda s: s["word"]), "_")).alias("Name"))
    return assigned.select(id_col, "Topic"), info


def topic_table(docs: DataFrame, id_col: str = "Id", text: str = "Document", length: str = "Length",
                stop_words: list[str] | None = None, k: int = 10, seed: int = 42) -> DataFrame:
    """M5: documents with their topic and the topic's name (Topic, Document, Id,
    Length, Name).  The names, ``k`` rows, are broadcast: dealt by topic, a task would read a
    topic's whole documents."""
    from postlytics.operators.keywords import default_stop_words
    assigned, info = assign_topics(docs, text, id_col, stop_words or default_stop_words(), k, seed)
    return (docs.join(assigned, id_col).join(F.broadcast(info.select("Topic", "Name")), "Topic", "inner")
                .select("Topic", text, id_col, length, "Name"))


def title_vectors(df: DataFrame, title: str, id_col: str, stop_words: list[str], size: int = 100,
                  window: int = 5, min_count: int = 1, seed: int = 42, epochs: int = 5,
                  part_words: int = 200_000) -> DataFrame:
    """Cleaned titles (I14) -> continuous-bag-of-words vectors (``wordvec``) ->
    mean of a title's word vectors (zero vector for no word) -> L2-normalised."""
    from postlytics.operators.textclean import clean_titles
    d = cut_lineage(clean_titles(df.select(id_col, title).fillna("", subset=[title]), title, stop_words, "_words").select(id_col, "_words"))
    vectors = cbow_vectors(d, "_words", size, window, min_count, epochs=epochs, seed=seed, part_words=part_words)
    return mean_vectors(d, id_col, "_words", vectors, size)
