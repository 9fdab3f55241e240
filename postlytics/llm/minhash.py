"""Near-duplicate documents by ProbMinHash, banding and verification.

A text is the set of its word shingles, each of weight 1: verification compares
sets, and a weight that counts occurrences would part texts that differ in a repeated
line alone.  Each shingle is a Poisson process whose rate is its weight; each arrival
falls into one of the signature's components, and a component keeps the shingle that
arrives first.  Two texts agree in a component with the probability Jaccard similarity
of their weighted sets, at equal weights the plain one.  The arrivals of all shingles
are drawn round by round; a shingle ends when its next arrival comes later than the
last component was taken.

Texts that agree in a band of components meet in a bucket.  There, each is paired
with the bucket's two hubs (the texts first and last in an order that differs from
band to band), so a bucket of n texts gives 2 n pairs at most and one of up to three
texts all its pairs.  Larger buckets whose texts are then not yet of one class pair
them with the text of most links, and what is still open is decided by an exact
prefix filter: the texts of different classes that share one of their rarest shingles
and whose sizes and places in the order allow the similarity.
Pairs are verified on the texts by exact Jaccard similarity;
verified pairs are links, and the classes are their connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlytics.llm.common import WHITE, byte_rows, slices, small_batches, store

_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(256)], np.uint64)
_PLACES = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ``k``-word shingles of the texts in ``raw``, in order, and
    the text of each.  A text of 1 to k - 1 words is one shingle."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = ~white
    first[1:] &= white[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    index = np.arange(len(raw))
    place = index - np.maximum.accumulate(np.where(first, index, 0))
    with np.errstate(over="ignore"):
        term = np.where(white, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, 255)])
        h = mix(np.add.reduceat(term, at))
        doc = owner[at]
        n = np.bincount(doc, minlength=len(bounds) - 1)
        begin = np.cumsum(n) - n
        inner = np.arange(len(h)) - begin[doc]
        left = n[doc] - inner  # words from here to the text's end
        total = np.zeros(len(h), np.uint64)
        for j in range(k):
            got = np.zeros(len(h), np.uint64)
            got[:len(h) - j] = h[j:]
            total += np.where(left > j, got * _PLACES[j], np.uint64(0))
    starts = (left >= k) | ((inner == 0) & (n[doc] < k))
    return mix(total[starts]), doc[starts]


def weighted(sh: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) and how often each occurs."""
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return sh[at], doc[at], np.diff(np.append(at, len(sh))).astype(np.float64)


def signatures(sh: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """The ProbMinHash signature (m shingle hashes) of each of ``n`` texts; of a text
    without shingles all zero."""
    arrival, taken = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    t, last, step = np.zeros(len(sh)), np.full(n, np.inf), 0
    while len(sh):
        step = (step + 0x632BE59BD9B4E019) % (1 << 64)
        x = mix(sh ^ np.uint64(step))
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / weight
        alive = t < last[doc]
        sh, doc, weight, t, x = sh[alive], doc[alive], weight[alive], t[alive], x[alive]
        if not len(sh):
            break
        slot = doc * m + (mix(x) % np.uint64(m)).astype(np.int64)
        np.minimum.at(arrival, slot, t)
        won = arrival[slot] == t
        taken[slot[won]] = sh[won]
        last = arrival.reshape(n, m).max(1)
    return taken.reshape(n, m)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band of ``rows`` components, which also holds the band's number."""
    n, m = signature.shape
    with np.errstate(over="ignore"):
        parts = signature.reshape(n, m // rows, rows) * _PLACES[:rows]
        return mix(parts.sum(2, dtype=np.uint64) + np.arange(m // rows, dtype=np.uint64)).view(np.int64)


def text_key(text: Column) -> Column:
    """MD5 of the words, one space between: equal keys are equal word sequences."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", " "))
    return F.when(words != "", F.unhex(F.md5(words)))


def _signed(k: int, m: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                n = batch.num_rows
                sh, doc, _ = weighted(*shingles(*byte_rows(batch, "text"), k))
                got = bands(signatures(sh, doc, np.ones(len(sh)), n, m), rows)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * got.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(got.ravel()))],
                    ["doc_id", "_t", "_bands"])
    return run


def _verified(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            (raw_a, at_a), (raw_b, at_b) = byte_rows(batch, "_ta"), byte_rows(batch, "_tb")
            keep = []
            for i, hub in enumerate(b):
                if hub != last:
                    one = raw_b[at_b[i]:at_b[i + 1]]
                    last, mine = hub, np.unique(shingles(one, np.array([0, len(one)]), k)[0])
                one = raw_a[at_a[i]:at_a[i + 1]]
                other = np.unique(shingles(one, np.array([0, len(one)]), k)[0])
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(common >= least * (len(mine) + len(other) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()).filter(pa.array(keep)),
                                              pa.array(b, pa.binary()).filter(pa.array(keep))], ["a", "b"])
    return run


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(a, b): each node of ``edges`` (a, b) that is not the least of its component,
    and that least node.  Alternating large-star and small-star steps, each stored,
    until nothing changes; every step is a grouped minimum joined back."""
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(most):
        if not before[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(roots.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = store(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        now = mark(edges)
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def _pairs(df: DataFrame, one: str, other: str) -> DataFrame:
    """Distinct (a, b); b, the text that more pairs share, is found again in the next
    row of a sorted join."""
    return df.select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b")).distinct()


def _linked(pairs: DataFrame, shown: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts in ``shown`` (_t, text) are similar enough."""
    return store(pairs.join(shown.select(F.col("_t").alias("a"), F.col("text").alias("_ta")), "a")
                 .join(shown.select(F.col("_t").alias("b"), F.col("text").alias("_tb")), "b")
                 .select("a", "b", "_ta", "_tb").mapInArrow(_verified(k, least), "a binary, b binary"), "verified")


def _all_links(large: DataFrame, pairs: DataFrame, shown: DataFrame, k: int, least: float) -> DataFrame:
    """The components (a, b) of all links between texts that share a bucket.  ``pairs``
    are those with a hub; ``large`` (_bucket, _t) are the buckets that may hold others."""
    found = _linked(pairs, shown, k, least)
    links = components(found)
    left = _open(large, links)
    if left.isEmpty():
        return links
    degree = (found.select(F.col("a").alias("_t")).unionByName(found.select(F.col("b").alias("_t")))
              .groupBy("_t").agg(F.count(F.lit(1)).alias("_links")))
    first = F.max(F.struct(F.coalesce("_links", F.lit(0)).alias("n"), F.xxhash64("_bucket", "_t").alias("o"),
                           F.col("_t").alias("t"), F.col("_class").alias("c")))
    centre = left.join(degree, "_t", "left").groupBy("_bucket").agg(first.alias("_m"))
    met = left.join(centre, "_bucket").where("_class <> _m.c").select("_t", F.col("_m.t").alias("_hub"))
    links = _with(links, _linked(_pairs(met, "_t", "_hub"), shown, k, least))
    left = _open(left.select("_bucket", "_t"), links).select("_t", "_class").distinct()
    if left.isEmpty():
        return links
    return _with(links, _linked(_prefix_pairs(left, shown, k, least), shown, k, least))


def _open(large: DataFrame, links: DataFrame) -> DataFrame:
    """(_bucket, _t, _class): the buckets with texts of more than one class."""
    named = large.join(links.select(F.col("a").alias("_t"), F.col("b").alias("_root")), "_t", "left").select(
        "_bucket", "_t", F.coalesce("_root", "_t").alias("_class"))
    mixed = named.groupBy("_bucket").agg(F.min("_class").alias("_lo"), F.max("_class").alias("_hi")).where("_lo < _hi")
    return store(named.join(mixed.select("_bucket"), "_bucket"), "open")


def _with(links: DataFrame, more: DataFrame) -> DataFrame:
    return links if more.isEmpty() else components(links.unionByName(more))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                sh, doc, _ = weighted(*shingles(*byte_rows(batch, "text"), k))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sh.view(np.int64)))], ["_t", "_s"])
    return run


def _prefix_pairs(names: DataFrame, shown: DataFrame, k: int, least: float, block: int = 256) -> DataFrame:
    """All pairs (a, b) of texts of ``names`` (_t, _class) of different classes that can
    have similarity ``least``.  In an order of all shingles, rare ones first, two such
    texts share one of their first n - ceil(least n) + 1, and behind the first they share
    enough are left for the overlap.  A frequent shingle's texts meet in blocks."""
    sets = store(shown.join(names, "_t", "left_semi").mapInArrow(_sets(k), "_t binary, _s array<bigint>"), "sets")
    held = sets.select("_t", F.explode("_s").alias("_h"))
    often = held.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rank = F.struct(F.coalesce("_n", F.lit(1)).alias("n"), F.col("_h").alias("h"))
    order = held.join(often, "_h", "left").groupBy("_t").agg(F.sort_array(F.collect_list(rank)).alias("_o"))
    size = F.size("_o")
    prefix = (order.select("_t", size.alias("_size"), F.posexplode(F.slice(
        "_o", F.lit(1), (size - F.ceil(least * size - 1e-9) + 1).cast("int"))).alias("_pos", "_x"))
        .where("_x.n > 1").select("_t", "_size", "_pos", F.col("_x.h").alias("_h")).join(names, "_t"))
    prefix = store(prefix, "prefixes")
    shared = (prefix.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min("_class").alias("_lo"), F.max("_class").alias("_hi"))
              .where("_lo < _hi").select("_h", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    prefix = prefix.join(shared, "_h")
    one = prefix.select("_h", F.pmod(F.hash("_t"), F.col("_blocks")).alias("_block"), F.col("_t").alias("_ta"),
                        F.col("_class").alias("_ca"), F.col("_size").alias("_na"), F.col("_pos").alias("_pa"))
    other = prefix.select("_h", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col("_t").alias("_tb"),
                          F.col("_class").alias("_cb"), F.col("_size").alias("_nb"), F.col("_pos").alias("_pb"))
    can = ((F.col("_ta") > F.col("_tb")) & (F.col("_ca") != F.col("_cb"))
           & (F.least("_na", "_nb") >= least * F.greatest("_na", "_nb") - 1e-9)
           & (F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb"))
              >= least / (1 + least) * (F.col("_na") + F.col("_nb")) - 1e-9))
    return _pairs(one.join(other, ["_h", "_block"]).where(can), "_ta", "_tb")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8,
                 n_bands: int = 24, rows: int = 4) -> DataFrame:
    """One row a row of ``df``: ``doc_id, class_id`` (the smallest id of its class),
    ``class_size``, ``kept`` (this is the class's one document that stays) and
    ``text_key`` (MD5 of its words, null without words).

    Texts are linked when the Jaccard similarity of their sets of ``k``-word shingles
    is ``least`` or more; a class is a connected component.  With 24 bands of 4 a pair
    of similarity 0.8 is missed by all bands with probability 3e-6; whatever meets in a
    band is decided, however large the bucket.  Copies (equal word sequences) are one
    text from the start and never paired.

    Words are split at white space as they are.  A text of fewer than ``k`` words is
    one shingle; a text without words, null included, is a class of its own.  Rows
    repeated with id and text share a class, of which one row only is ``kept``; a null id
    is ``kept`` last.  An empty table gives no rows; other columns are not read."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("_t"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = store(docs.mapInArrow(_signed(k, n_bands * rows, rows), f"doc_id {kind}, _t binary, _bands array<bigint>"), "signatures")
    texts = signed.where("_t is not null").groupBy("_t").agg(
        F.min("doc_id").alias("doc_id"), F.min("_bands").alias("_bands"))
    met = texts.select("_t", F.explode("_bands").alias("_bucket"))
    turn = F.struct(F.xxhash64("_bucket", "_t").alias("o"), F.col("_t").alias("t"))
    hubs = met.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min(turn).alias("_lo"), F.max(turn).alias("_hi")).where("_n > 1")
    met = store(met.join(hubs.select("_bucket", "_n", F.array("_lo.t", "_hi.t").alias("_hubs")), "_bucket"), "met")
    pairs = store(_pairs(met.select("_t", F.explode("_hubs").alias("_hub")).where("_t <> _hub"), "_t", "_hub"), "pairs")
    ends = pairs.select(F.col("a").alias("_t")).unionByName(pairs.select(F.col("b").alias("_t"))).distinct()
    chosen = signed.where("_t is not null").groupBy("_t").agg(F.min("doc_id").alias("doc_id")).join(ends, "_t", "left_semi")
    shown = store(docs.join(chosen.select(F.col("_t").alias("_c"), F.col("doc_id").alias("_d")),
                            F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_c")), "left_semi")
                  .select("_t", "text"), "texts")
    links = _all_links(met.where("_n > 3").select("_bucket", "_t"), pairs, shown, k, least)
    member = signed.select("doc_id", "_t").join(links.select(F.col("a").alias("_t"), F.col("b").alias("_root")), "_t", "left")
    member = store(member.select(
        "doc_id", "_t", F.coalesce("_root", "_t").alias("_class"), F.monotonically_increasing_id().alias("_row")), "classes")
    return _classes(member)


def _classes(member: DataFrame) -> DataFrame:
    """Class ids and sizes; a null class is one of its own.  One grouped minimum gives
    a class's smallest id (nulls last) and, of rows that repeat it, the one that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    classes = member.where("_class is not null").groupBy("_class").agg(F.count(F.lit(1)).alias("class_size"), first.alias("_m"))
    out = member.join(classes, "_class").select(
        "doc_id", F.col("_m.id").alias("class_id"), "class_size", (F.col("_row") == F.col("_m.row")).alias("kept"),
        F.col("_t").alias("text_key"))
    alone = member.where("_class is null").select("doc_id", F.col("doc_id").alias("class_id"),
                                                  F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"),
                                                  F.col("_t").alias("text_key"))
    return out.unionByName(alone)
