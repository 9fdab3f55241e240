"""Title classification (L22, L23, B9), re-aimed from transformer models.

L22 (zero-shot in the reference) becomes nearest-prototype labelling: each
label's prototype is the mean vector of its rows; a row gets the label whose
prototype has the highest cosine similarity.  The prototypes are the fitted model,
labels x dimension numbers, and go to the tasks as such; rows are scored in Arrow
batches against blocks of labels (no join, no pair of row and label is emitted).
L23 (fine-tuned classifier) becomes a Spark ML text pipeline: tokenise, hashed
term frequencies, IDF, logistic regression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from postlytics.functions.text import WHITESPACE_CLASS

SCORE_CELLS = 1 << 22  # rows x labels scored at a time in a task


def prototype_table(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, _pos, _m): mean of each vector position per label (posexplode ->
    partial average per (label, position))."""
    return (df.where(F.col(label).isNotNull())
              .select(label, F.posexplode(vector).alias("_pos", "_x"))
              .groupBy(label, "_pos").agg(F.avg("_x").alias("_m")))


def prototypes(df: DataFrame, vector: str, label: str) -> dict:
    """The fitted model: mean vector per label."""
    rows = (prototype_table(df, vector, label).groupBy(label)
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "_m"))).alias("_v")).collect())
    return {r[label]: [x["_m"] for x in r["_v"]] for r in rows}


def prototype_label(df: DataFrame, vector: str, protos: dict, name: str = "predicted_label") -> DataFrame:
    """Adds ``name`` (label of the most similar prototype; lowest label on ties)
    and ``similarity``.  A vector that is null, all zero, of another length than the
    prototypes or with a null or non-finite entry gets null for both, as do all rows
    when there is no prototype."""
    labels = sorted(protos)
    kinds = {type(x) for x in labels}
    kind = "string" if str in kinds else "double" if float in kinds else (
        "int" if all(abs(x) < 1 << 31 for x in labels) else "bigint")
    means = np.array([protos[x] for x in labels], np.float64).reshape(len(labels), len(protos[labels[0]]) if labels else 0)
    norms = np.linalg.norm(means, axis=1)
    means = means / np.where(norms > 0, norms, 1)[:, None]

    @F.arrow_udf(f"struct<label {kind}, s double>")
    def nearest(v: pa.Array) -> pa.Array:
        dims = means.shape[1]
        at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(v), dims), False)))
        if not len(labels) or not dims:
            at = at[:0]
        rows = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
        size = np.linalg.norm(rows, axis=1)
        fit = np.isfinite(size) & (size > 0)
        at, rows = at[fit], rows[fit] / size[fit, None]
        best, found = np.full(len(at), -np.inf), np.zeros(len(at), np.int64)
        step = max(1, SCORE_CELLS // max(1, len(at)))
        for lo in range(0, len(labels), step):
            sims = rows @ means[lo:lo + step].T
            top = sims.argmax(axis=1)
            score = sims[np.arange(len(at)), top]
            better = score > best
            best[better], found[better] = score[better], lo + top[better]
        label, s = [None] * len(v), [None] * len(v)
        for i, k, x in zip(at.tolist(), found.tolist(), best.tolist()):
            label[i], s[i] = labels[k], x
        fields = [pa.array(label, {"string": pa.string(), "double": pa.float64(), "int": pa.int32(),
                                   "bigint": pa.int64()}[kind]), pa.array(s, pa.float64())]
        return pa.StructArray.from_arrays(fields, ["label", "s"])

    return df.withColumn("_best", nearest(F.col(vector))).withColumns(
        {name: F.col("_best.label"), "similarity": F.col("_best.s")}).drop("_best")


def text_classifier(train: DataFrame, apply_to: DataFrame, text: str, label: str, id_col: str,
                    test: float = 0.25, seed: int = 42, num_features: int = 1 << 18) -> dict:
    """Fit on a 75/25 hash split of ``train``; report test accuracy;
    predict a 0/1 flag for ``apply_to``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    from postlytics.operators.sampling import hash_split
    from postlytics.operators.stats import accuracy
    d = hash_split(train.where(F.col(text).isNotNull() & F.col(label).isNotNull())
                   .withColumn(label, F.col(label).cast("double")), id_col, test, seed, "_test")
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=WHITESPACE_CLASS + "+", gaps=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, maxIter=50, regParam=0.01),
    ])
    model = pipe.fit(d.where(~F.col("_test")))
    acc = accuracy(model.transform(d.where(F.col("_test"))), label, "prediction")
    applied = model.transform(apply_to.where(F.col(text).isNotNull())).select(
        id_col, F.col("prediction").cast("int").alias("flag"))
    return {"test_accuracy": acc, "predictions": applied}


def membership_flag(df: DataFrame, key: str, other: DataFrame, other_key: str | None = None,
                    name: str = "in_other") -> DataFrame:
    """1 when ``key`` occurs in ``other``, else 0 (distinct keys left-joined)."""
    ok = other_key or key
    ids = other.select(F.col(ok).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(1))
    return df.join(ids, key, "left").withColumn(name, F.coalesce("_in", F.lit(0)).cast("int")).drop("_in")
