"""Continuous-bag-of-words vectors with negative sampling.

The rows are dealt into parts of about ``part_words`` words, and up to ``TOGETHER``
parts into a group, which one task trains.  An epoch ships to each group the vectors of
its own words only (a word's row knows its groups), trains each part there in small steps over
whole rows, and averages what the parts return, a word's vector weighted by its
occurrences in the part; a group adds up its parts first, so a word's vector travels
once a group and epoch.  The groups are trained in waves of ``TOGETHER`` parts a core: what is shuffled
at a time follows the cores, not the input, and only words of further groups wait for the
next wave.  The vocabulary is a table throughout: neither the driver nor
a task holds all of it.  Each wave's table is checkpointed, so a lost executor
repeats a few parts of one wave, with the same random numbers; what the wave
shuffled is dropped before the next one."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlytics.session import cut_lineage, drop_unused

LONGEST = 10_000  # words that are trained as one text; a longer one is cut into such stretches
BATCH = 64        # centre words that are trained by one step
TOGETHER = 4      # parts that one task trains, where there are as many tasks as cores
ROWS = 5_000      # vectors that a task hands on at once


def _sum(vectors: Column, size: int) -> Column:
    """The sum over the structs' vectors ``v``, in the list's order."""
    zeros = F.array_repeat(F.lit(0.0), size)
    return F.aggregate(vectors, zeros, lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q))


def _numbers(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """A column of arrays of ``size`` doubles as a matrix."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), size)


def _vectors(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _numbered(words: pa.ChunkedArray, number: dict[str, int]) -> list[np.ndarray]:
    """The numbers of each list's words; a word without one is left out."""
    return [np.array([number[w] for w in t.as_py() if w in number], dtype=np.int64) for t in words]


def _train(words: list[np.ndarray], v: np.ndarray, o: np.ndarray, noise: np.ndarray, rng: np.random.Generator,
           window: int, negative: int, rate: tuple[float, float]) -> None:
    """One pass over ``words`` (word numbers a text), in place: the mean of a centre's
    context vectors ``v`` predicts it against ``negative`` words drawn by ``noise``
    (cumulative), with output vectors ``o``.  The rate falls from one value to the other."""
    words = [w for w in words if len(w) > 1]
    if not words:
        return
    flat = np.concatenate(words)
    size = np.array([len(w) for w in words])
    begin = np.repeat(np.cumsum(size) - size, size)
    end = begin + np.repeat(size, size)
    offsets = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
    for at in range(0, len(flat), BATCH):
        centre = np.arange(at, min(at + BATCH, len(flat)))
        reach = rng.integers(1, window + 1, len(centre))  # each centre has its own, smaller window
        place = centre[:, None] + offsets
        inside = ((np.abs(offsets) <= reach[:, None]) & (place >= begin[centre][:, None]) & (place < end[centre][:, None]))
        context = flat[np.where(inside, place, 0)]
        share = inside / inside.sum(1, keepdims=True)
        hidden = np.einsum("bc,bcd->bd", share, v[context])
        drawn = np.searchsorted(noise, rng.random((len(centre), negative)) * noise[-1], side="right")
        target = np.concatenate([flat[centre][:, None], drawn], axis=1)
        wanted = np.zeros(target.shape)
        wanted[:, 0] = 1
        score = 1 / (1 + np.exp(-np.clip(np.einsum("bd,btd->bt", hidden, o[target]), -30, 30)))
        alpha = rate[0] + (rate[1] - rate[0]) * at / len(flat)
        step = (wanted - score) * alpha
        step[:, 1:][drawn == target[:, :1]] = 0  # the centre itself is no wrong answer
        back = np.einsum("bt,btd->bd", step, o[target])
        np.add.at(o, target, step[:, :, None] * hidden[:, None, :])
        np.add.at(v, context, inside[:, :, None] * back[:, None, :])  # whole to each, as is usual


def _epoch(size: int, window: int, negative: int, rate: tuple[float, float], seed: int, epoch: int):
    """Trains the parts of a group one after another, each from the group's vectors as they
    came, and adds up what they return, each word's vectors times its occurrences in the part."""
    def run(key, texts: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("word")
        names = known["word"].combine_chunks()
        v, o = (_numbers(known[c], size) for c in ("v", "o"))
        more = {c: known[c].combine_chunks() for c in known.column_names if c not in ("group", "word", "v", "o")}  # handed on
        del known
        number = {w: i for i, w in enumerate(names.to_pylist())}
        sums, total = [np.zeros_like(v), np.zeros_like(o)], np.zeros(len(names), np.int64)
        texts = texts.sort_by([(c, "ascending") for c in ("part", "_row", "_from")])
        part = texts["part"].to_numpy()
        for one in np.unique(part):
            at = np.flatnonzero(part == one)
            words = _numbered(texts["words"].slice(at[0], len(at)), number)
            own, place, n = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            if not len(own):
                continue
            words = np.split(place, np.cumsum([len(w) for w in words])[:-1])
            trained = v[own], o[own]
            _train(words, *trained, np.cumsum(n.astype(float) ** 0.75), np.random.default_rng([seed, epoch, int(one)]),
                   window, negative, rate)
            for s, x in zip(sums, trained):
                s[own] += x * n[:, None]
            total[own] += n
        out = [pa.RecordBatch.from_arrays([names[i:i + ROWS], pa.array(total[i:i + ROWS]), *(_vectors(s[i:i + ROWS]) for s in sums),
                                           *(c[i:i + ROWS] for c in more.values())], ["word", "n", "v", "o", *more]).append_column("group", pa.array([key[0].as_py()] * len(names[i:i + ROWS]), pa.int64()))
               for i in range(0, max(1, len(names)), ROWS)]
        return pa.Table.from_batches(out)
    return run


def cbow_vectors(df: DataFrame, words: str, size: int = 100, window: int = 5, min_count: int = 1, negative: int = 5,
                 epochs: int = 5, alpha: float = 0.025, min_alpha: float = 0.0001, seed: int = 42,
                 part_words: int = 200_000, wave: int | None = None) -> DataFrame:
    """``df``'s column ``words`` (array of strings; null counts as empty) to a row a word
    that occurs ``min_count`` times or more: ``word``, ``n`` (occurrences) and ``v`` (its
    vector).  The number of parts follows the number of words.  At most ``wave`` groups of parts
    (if not given, ``TOGETHER`` parts a core) are trained at a time.  An empty table gives none."""
    spark = df.sparkSession
    texts = cut_lineage(df.select(F.xxhash64(words).alias("_row"), F.expr(f"filter(`{words}`, w -> w is not null)").alias("_w"))
                        .where(F.size("_w") > 0)
                        .select("_row", "_w", F.explode(F.sequence(F.lit(1), F.size("_w"), F.lit(LONGEST))).alias("_from"))
                        .select("_row", "_from", F.slice("_w", F.col("_from"), F.lit(LONGEST)).alias("words"),
                                F.monotonically_increasing_id().alias("_i")))
    total = texts.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_words))
    together = min(TOGETHER, max(1, parts // spark.sparkContext.defaultParallelism))
    texts = texts.withColumn("part", F.pmod(F.xxhash64("_row", "_from", "_i", F.lit(seed)), F.lit(parts))).drop("_i")
    texts = texts.withColumn("group", F.floor(F.col("part") / together))
    groups = math.ceil(parts / together)
    wave = math.ceil(groups / math.ceil(groups / (wave or max(1, spark.sparkContext.defaultParallelism * TOGETHER // together))))
    counts = cut_lineage(texts.select("group", F.explode("words").alias("word")).groupBy("group", "word").agg(F.count(F.lit(1)).alias("n"))
                         .groupBy("word").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("group")).alias("groups"))
                         .where(F.col("n") >= min_count))
    weights = counts.select(
        "word", "n", "groups", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (F.pmod(F.xxhash64("word", i, F.lit(seed)), F.lit(1 << 20))
                               / (1 << 20) - 0.5) / size).alias("v"), F.array_repeat(F.lit(0.0), size).alias("o"))
    for epoch in range(epochs):
        rate = tuple(alpha + (min_alpha - alpha) * e / epochs for e in (epoch, epoch + 1))
        whole, waiting = [], None   # words whose groups are all trained; sums of the others
        for first in range(0, groups, wave):
            end = first + wave - 1
            shipped = weights.select(F.explode(F.filter("groups", lambda g: g.between(first, end))).alias("group"), "word",
                                     F.array_max("groups").alias("last"), "v", "o")
            trained = texts.where(F.col("group").between(first, end)).groupBy("group").cogroup(shipped.groupBy("group")).applyInArrow(
                _epoch(size, window, negative, rate, seed, epoch),
                "word string, n long, v array<double>, o array<double>, last long, group long").withColumn("groups", F.array("group"))
            if waiting is not None:
                trained = trained.unionByName(waiting)
            n = F.when(F.col("last") <= end, F.col("n")).otherwise(F.lit(1))
            held = cut_lineage(trained.groupBy("word").agg(
                F.sum("n").alias("n"), F.max("last").alias("last"), F.array_sort(F.flatten(F.collect_list("groups"))).alias("groups"),
                *[F.array_sort(F.collect_list(F.struct("group", F.col(c).alias("v")))).alias(c) for c in ("v", "o")]).select(
                "word", "n", "last", "groups", *[F.transform(_sum(F.col(c), size), lambda x: x / n).alias(c) for c in ("v", "o")]))
            whole.append(held.where(F.col("last") <= end).drop("last"))
            # added up first, as a group before those of the next wave
            waiting = held.where(F.col("last") > end).withColumn("group", F.lit(-1).cast("long"))
            del shipped, trained, held
            drop_unused(spark)
        weights = reduce(DataFrame.unionByName, whole)
        del whole, waiting
    return weights.select("word", "n", "v")


def _row_sums(size: int):
    """The sum of each row's word vectors, in the order of the words; rows without a known word give none."""
    def run(key, texts: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("word")
        v = _numbers(known["v"], size)
        number = {w: i for i, w in enumerate(known["word"].to_pylist())}
        words = _numbered(texts["words"], number)
        some = np.array([len(w) > 0 for w in words], bool)
        out = np.zeros((int(some.sum()), size))
        for row, w in zip(out, (w for w in words if len(w))):
            own, n = np.unique(w, return_counts=True)
            row[:] = (v[own] * n[:, None]).sum(0)
        rows = texts["_row"].combine_chunks().filter(pa.array(some))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([rows[i:i + ROWS], _vectors(out[i:i + ROWS])], ["_row", "_v"])
                                      for i in range(0, max(1, len(out)), ROWS)])
    return run


def mean_vectors(df: DataFrame, id_col: str, words: str, vectors: DataFrame, size: int, group_words: int = 800_000) -> DataFrame:
    """``id_col`` and ``vector`` of every row of ``df``: the mean of its words' vectors
    scaled to length 1, zeros for a row without known words.  The rows are dealt into
    groups of about ``group_words`` words, to each of which a word's vector goes once."""
    rows = cut_lineage(df.select(id_col, words, F.monotonically_increasing_id().alias("_row")))
    own = rows.select("_row", F.expr(f"filter(`{words}`, w -> w is not null)").alias("words")).where(F.size("words") > 0)
    total = own.agg(F.sum(F.size("words"))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(total / group_words), min(cores, math.ceil(total / LONGEST)))
    own = own.withColumn("group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    need = own.select(F.col("group").alias("to"), F.explode("words").alias("word")).distinct()
    shipped = need.join(vectors.select("word", "v"), "word").groupBy("to")
    summed = own.groupBy("group").cogroup(shipped).applyInArrow(_row_sums(size), "_row long, _v array<double>")
    zeros = F.array_repeat(F.lit(0.0), size)
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.join(summed, "_row", "left").select(id_col, F.when(length > 0, F.transform(
        "_v", lambda x: x / length)).otherwise(zeros).alias("vector"))
