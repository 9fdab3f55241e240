"""Repeated byte strings across documents by a hash-compared suffix sort.

A byte goes when a string of ``window`` bytes that covers it starts anywhere else.
The suffixes of a corpus do not fit one sort, so they are first dealt out so that
equal strings meet:

* Every window start has an anchor, the k-gram with the least hash inside its window
  (the leftmost of equal ones); equal windows have equal anchors.  Successive starts
  with one anchor position are a segment: its starts and the bytes of their windows.
* Segments are counted by anchor and content.  A content that occurs twice is
  repeated as a whole.  Anchors with one single segment are dropped.
* Anchors with several contents go, one segment a content, to the suffix sort: a
  mergesort of the window starts that compares two suffixes by the longest common
  extension, found by binary search on prefix polynomial hashes.  Neighbours whose
  extension reaches the window are repeated, and are verified byte by byte.
* An anchor with more than ``hot`` contents (a passage in very many contexts) would be
  one large sort; its windows are instead counted by a 128-bit hash, which combines
  before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postlytics.llm.common import byte_rows, slices, small_batches, store
from postlytics.llm.minhash import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_OTHER = 0xC2B2AE3D27D4EB4F | 1
PART = 1 << 18  # bytes of text that are hashed at once
POSITION = np.uint64((1 << 20) - 1)  # bits of a place among the grams of a part
_tables: dict[int, list[np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` to 0 .. n and the inverses, modulo 2^64.  A worker keeps those that a
    part of a text needs; longer ones are made anew."""
    found = _tables.get(base)
    if found is None or len(found[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        found = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:  # doubling: the second half is the first times base^done
                p[done:2 * done] = p[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            found.append(p)
        if size <= 4 * PART:
            _tables[base] = found
    return found[0], found[1]


class Prefix:
    """Prefix polynomial hashes of a byte array."""

    def __init__(self, raw: np.ndarray, base: int = _BASE):
        p, self.inverse = powers(base, len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:len(raw)], out=self.sums[1:])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        """Of the ``length`` bytes from ``start``."""
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def segments(raw: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, n, anchor, content, times) of the segments of the rows
    of ``raw``, at most about ``PART`` bytes.  A segment has ``n`` window starts;
    ``times`` successive equal ones (a periodic text) are one entry.  Of a gram's hash
    the same bits count in every part, so equal windows have equal anchors wherever
    they stand."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    if len(raw) < window:
        return none
    prefix, w = Prefix(raw), window - k + 1
    grams = mix((prefix.sums[k:] - prefix.sums[:-k]) * prefix.inverse[:len(raw) - k + 1])
    least = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < w:  # least over ``span`` grams, by doubling
        step = min(span, w - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    inside = np.zeros(len(raw) + 2, np.int32)
    long = np.flatnonzero(np.diff(bounds) >= window)
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - window + 1, -1)
    valid = np.cumsum(inside)[:len(least)] > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return none
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    n = ends - at
    anchor = grams[(least[at] & POSITION).astype(np.int64)]
    content = mix(prefix.hash(at, n + window - 1))
    row = np.searchsorted(bounds, at, side="right") - 1
    fresh = np.ones(len(at), bool)
    fresh[1:] = ((anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (n[1:] != n[:-1])
                 | (at[1:] != ends[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(fresh)
    times = np.diff(np.append(first, len(at)))
    return row[first], (at - bounds[row])[first], n[first], anchor[first], content[first], times


def text_parts(batch: pa.RecordBatch, window: int, most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a batch as (raw, bounds, row of the batch, offset in that row).
    A text over ``most`` bytes comes in parts that share ``window`` - 1 bytes, so that
    each window start is in one of them."""
    done = 0
    for part in slices(batch, "text", most):
        raw, bounds = byte_rows(part, "text")
        rows = np.arange(done, done + part.num_rows)
        done += part.num_rows
        if part.num_rows == 1 and len(raw) > most:
            for i in range(0, len(raw), most):
                piece = raw[i:i + most + window - 1]
                yield piece, np.array([0, len(piece)]), rows, np.array([i])
        else:
            yield raw, bounds, rows, np.zeros(len(rows), np.int64)


def compare(prefix: Prefix, raw: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes at ``a`` and ``b``, cut to ``window`` bytes: which are greater
    (sign) and their longest common extension, by binary search on hashes."""
    length = np.zeros(len(a), np.int64)
    step = 1 << (window.bit_length() - 1)
    while step:
        able = np.flatnonzero(length + step <= window)
        i, j = a[able] + length[able], b[able] + length[able]
        same = prefix.hash(i, step) == prefix.hash(j, step)
        length[able[same]] += step
        step >>= 1
    inner = np.minimum(length, window - 1)
    sign = np.where(length == window, 0, np.sign(raw[a + inner].astype(np.int16) - raw[b + inner]))
    return sign, length


def suffix_sort(raw: np.ndarray, prefix: Prefix, starts: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` ordered by (group, suffix cut to ``window`` bytes), and the group of
    each, refined by the first 8 bytes.  Bottom-up mergesort: at each level all pairs
    of neighbouring runs of one group are merged at once, each element finding its
    rank in the other run by binary search with ``compare``."""
    head = np.zeros(len(starts), np.uint64)
    for i in range(8):
        head = head << np.uint64(8) | raw[starts + i]
    order = np.lexsort((starts, head, group))
    starts, group, head = starts[order], group[order], head[order]
    new = np.ones(len(starts), bool)
    new[1:] = (group[1:] != group[:-1]) | (head[1:] != head[:-1])
    cls = np.cumsum(new) - 1
    size = np.bincount(cls)
    alone = size[cls] == 1
    starts, cls = starts[~alone], cls[~alone]
    if not len(starts):
        return starts, cls
    first = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    size = np.diff(np.append(first, len(starts)))
    base = np.repeat(first, size)  # where the class begins
    total = np.repeat(size, size)
    width = 1
    while width < size.max():
        inner = np.arange(len(starts)) - base
        run = inner // width
        left = run % 2 == 0
        other = np.where(left, run + 1, run - 1) * width  # the other run, inside the class
        lo, hi = np.minimum(other, total), np.minimum(other + width, total)
        begin = lo.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            sign, _ = compare(prefix, raw, starts[base[active] + mid], starts[active], window)
            # a left element stands before equal right ones: it counts the lesser ones only
            below = (sign < 0) | ((sign == 0) & ~left[active])
            lo[active[below]] = mid[below] + 1
            hi[active[~below]] = mid[~below]
            active = active[lo[active] < hi[active]]
        rank = np.where(lo >= begin, lo - begin, 0)
        pair = np.where(left, run, run - 1) * width
        place = base + pair + (inner - run * width) + rank
        moved = np.empty_like(starts)
        moved[place] = starts
        starts = moved
        width *= 2
    return starts, cls


def repeated_starts(raw: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Those of ``starts`` whose ``window`` bytes also stand at another start of their
    group, sorted.  Neighbours of the sorted order are compared by hash and then by
    their bytes."""
    prefix = Prefix(raw)
    ordered, cls = suffix_sort(raw, prefix, starts, group, window)
    if len(ordered) < 2:
        return ordered[:0]
    near = np.flatnonzero(cls[1:] == cls[:-1])
    _, length = compare(prefix, raw, ordered[near], ordered[near + 1], window)
    near = near[length == window]
    views = np.lib.stride_tricks.sliding_window_view(raw, window)
    checked = [near[i:i + 8192][(views[ordered[near[i:i + 8192]]] == views[ordered[near[i:i + 8192] + 1]]).all(1)]
               for i in range(0, len(near), 8192)]
    near = np.concatenate(checked) if checked else near
    return np.unique(np.concatenate([ordered[near], ordered[near + 1]]))


def _counted(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, bounds, _, _ in text_parts(batch, window):
                _, _, n, anchor, content, times = segments(raw, bounds, window, k)
                order = np.lexsort((n, content, anchor))
                n, anchor, content, times = n[order], anchor[order], content[order], times[order]
                new = np.ones(len(n), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (n[1:] != n[:-1])
                at = np.flatnonzero(new)
                count = np.add.reduceat(times, at) if len(at) else times
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[at].view(np.int64)), pa.array(content[at].view(np.int64)), pa.array(n[at].astype(np.int32)),
                     pa.array(count)], ["anchor", "content", "n", "c"])
    return run


def _located(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, bounds, rows, offset in text_parts(batch, window):
                row, start, n, anchor, content, times = segments(raw, bounds, window, k)
                take = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64)),
                     pa.array(content.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(start + offset[row]),
                     pa.array(times)], ["doc_id", "_x", "anchor", "content", "n", "start", "times"])
    return run


def _fetched(window: int, hot: int):
    """Rows (doc, its segments, text) to a row a segment with its bytes; of segments of
    hot anchors a row a window instead, with two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = byte_rows(batch, "text")
            out, held = [], 0
            for i, segs in enumerate(batch.column(2).to_pylist()):
                one = raw[bounds[i]:bounds[i + 1]]
                doc, x = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for s in segs:
                    data = one[s["start"]:s["start"] + s["n"] + window - 1]
                    if s["g"] <= hot:
                        out.append((doc, x, s["anchor"], s["start"], s["n"], s["cnt"], data.tobytes(), None, None))
                        held += len(data)
                        continue
                    at = np.arange(s["n"])
                    both = [Prefix(data, b).hash(at, window).view(np.int64).tolist() for b in (_BASE, _OTHER)]
                    out += [(doc, x, s["anchor"], s["start"] + j, 1, s["cnt"], None, h1, h2) for j, (h1, h2) in enumerate(zip(*both))]
                    held += 64 * s["n"]
                if held > 4 << 20:
                    yield _rows(out, batch)
                    out, held = [], 0
            yield _rows(out, batch)
    return run


def _rows(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    kinds = [like.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      ["doc_id", "_x", "anchor", "start", "n", "cnt", "bytes", "h1", "h2"])


def _sorted(window: int, most: int = 1 << 20):
    """Segments sorted by anchor to spans: whole anchors are taken together up to about
    ``most`` bytes and their window starts suffix-sorted."""
    def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        batch = t.to_batches()[0]
        raw, bounds = byte_rows(batch, "bytes")
        n = batch.column(4).to_numpy().astype(np.int64)
        seg = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        at = repeated_starts(raw, bounds[:-1][seg] + inner, batch.column(2).to_numpy()[seg], window)
        owner = np.searchsorted(bounds, at, side="right") - 1
        once = batch.column(5).to_numpy()[owner] == 1  # the others are repeated as a whole anyway
        at, owner = at[once], owner[once]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.flatnonzero(np.append(new[1:], len(at) > 0))  # of no starts none
        own = owner[first]
        start = batch.column(3).to_numpy()[own] - bounds[own]
        take = pa.array(own)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at[first] + start),
                                           pa.array(at[last] + start + window)], ["doc_id", "_x", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(2).to_numpy()
            size = np.diff(byte_rows(batch, "bytes")[1])
            border = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1), batch.num_rows]
            begin = 0
            for i, j in zip(border[:-1], border[1:]):
                if held >= most and (i > 0 or anchor[0] != parts[-1].column(2)[-1].as_py()):
                    if i > begin:
                        parts.append(batch.slice(begin, i - begin))
                    yield spans(parts)
                    parts, held, begin = [], 0, i
                held += int(size[i:j].sum())
            parts.append(batch.slice(begin))
        if parts:
            yield spans(parts)
    return run


def merged(spans: list) -> list[tuple[int, int]]:
    """The union of spans (a, b), as disjoint spans in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _begin(data: bytes, at: int) -> int:
    """Where the character that holds byte ``at`` begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _end(data: bytes, at: int) -> int:
    """``at``, or where the character ends that stands across it."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, k: int = 73,
                   hot: int = 4000, rows_a_task: int = 20_000, carry: list[str] | None = None,
                   whole_chars: bool = False) -> DataFrame:
    """One row a row of ``df``: ``doc_id``, the columns of ``carry``, ``kept`` (binary,
    the text's UTF-8 bytes without the removed ones), ``spans`` (array of struct a, b:
    the maximal removed runs) and ``n_bytes``.

    A byte is removed when a string of ``window`` bytes that covers it starts at
    another place of the same or another row; all strings are judged on the input.
    Cuts may fall inside a character; with ``whole_chars`` a character that a cut has
    split goes (at most 3 bytes a side of a run).  A null text is empty; texts under ``window``
    bytes are kept whole; rows repeated with id and text are copies of each other,
    so their long texts go; an empty table gives no rows."""
    spark, carry = df.sparkSession, carry or []
    small_batches(spark)
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_x"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "_x", "text")
    # counted a batch at a time before the shuffle, then by content, then by anchor
    counts = (texts.select("text").mapInArrow(_counted(window, k), "anchor long, content long, n int, c long")
              .groupBy("anchor", "content", "n").agg(F.sum("c").alias("cnt")))
    by = Window.partitionBy("anchor")
    shared = (counts.withColumn("total", F.sum("cnt").over(by)).withColumn("g", F.count(F.lit(1)).over(by))
              .where("total > 1").select("anchor", "content", "n", "cnt", "g"))
    places = texts.mapInArrow(_located(window, k), f"doc_id {kind}, _x long, anchor long, content long, n int, start long, times long")
    found = store(places.join(shared, ["anchor", "content", "n"]), "segments")
    whole = found.where("cnt > 1").select("doc_id", "_x", F.col("start").alias("a"),
                                          (F.col("start") + F.col("n") * F.col("times") + (window - 1)).alias("b"))
    # one segment a content where an anchor has several
    one = F.min(F.struct("doc_id", "_x", "start")).alias("p")
    picked = store(found.where("g > 1").groupBy("anchor", "content", "n", "cnt", "g").agg(one).select(
        "p.*", "anchor", "n", "cnt", "g"), "picked")
    per_doc = picked.groupBy("doc_id", "_x").agg(F.collect_list(F.struct("start", "n", "anchor", "cnt", "g")).alias("segs"))
    by_doc = [texts["doc_id"].eqNullSafe(per_doc["doc_id"]), texts["_x"] == per_doc["_x"]]
    fetched = texts.join(per_doc, by_doc).select(texts["doc_id"], texts["_x"], "segs", "text").dropDuplicates(["doc_id", "_x"])
    parts = store(fetched.mapInArrow(_fetched(window, hot), f"doc_id {kind}, _x long, anchor long, start long, n int, cnt long, "
                                                            "bytes binary, h1 long, h2 long"), "parts")
    tasks = max(spark.sparkContext.defaultParallelism, picked.count() // rows_a_task)
    near = (parts.where("bytes is not null").drop("h1", "h2").repartition(tasks, "anchor").sortWithinPartitions("anchor")
            .mapInArrow(_sorted(window), f"doc_id {kind}, _x long, a long, b long"))
    windows = parts.where("bytes is null")
    twice = windows.groupBy("h1", "h2").agg(F.sum("cnt").alias("times")).where("times > 1").drop("times")
    many = windows.where("cnt = 1").join(twice, ["h1", "h2"], "left_semi").select(
        "doc_id", "_x", F.col("start").alias("a"), (F.col("start") + window).alias("b"))
    spans = whole.unionByName(near).unionByName(many).groupBy("doc_id", "_x").agg(
        F.collect_list(F.struct("a", "b")).alias("spans")).select(F.col("doc_id").alias("_d"), F.col("_x").alias("_y"), "spans")
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_d"]) & (docs["_x"] == spans["_y"]), "left").drop("_d", "_y", "_x")
    extra = [f"_c_{c}" for c in carry]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "text"):
                raw, bounds = byte_rows(batch, "text")
                kept, removed = [], []
                for i, found in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                    data, gone, at, rest = raw[bounds[i]:bounds[i + 1]].tobytes(), merged(found), 0, []
                    if whole_chars:
                        gone = merged([{"a": _begin(data, a), "b": _end(data, b)} for a, b in gone])
                    for a, b in gone:
                        rest.append(data[at:a])
                        at = b
                    rest.append(data[at:])
                    kept.append(b"".join(rest))
                    removed.append([{"a": a, "b": b} for a, b in gone])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)) for c in ["doc_id", *extra]), pa.array(kept, pa.binary()),
                     pa.array(removed, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(np.diff(bounds))],
                    ["doc_id", *extra, "kept", "spans", "n_bytes"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    done = joined.mapInArrow(cut, f"doc_id {kind}, {fields}kept binary, spans array<struct<a: long, b: long>>, n_bytes long")
    return done.select("doc_id", *[F.col(f"_c_{c}").alias(c) for c in carry], "kept", "spans", "n_bytes")


def repeats_digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
