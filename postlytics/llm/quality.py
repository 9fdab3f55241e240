"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label.  Each passage is
encoded as a vector (surface measures and a hashed byte-pair profile through a
learned layer); a gated attention unit, tanh(V h) * sigmoid(U h), gives each
passage a weight; the weighted mean of the passage vectors is scored by a logistic
unit.  All parameters are learned together from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from postlytics.llm.common import byte_rows, slices, small_batches

PASSAGE, BINS = 768, 128  # bytes of a passage, bins of the byte-pair profile
ACCEPT = 0.7  # fixed value: a score from which a document counts as good
_PAIR_BIN = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64)


def _classes() -> np.ndarray:
    """Of each byte: upper, lower, digit, space, line end, full stop or comma, other
    ASCII mark, beyond ASCII."""
    kind = np.full(256, 6)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\r\n", b".,")):
        kind[list(chars)] = k
    kind[128:] = 7
    return kind


_CLASS = _classes()
WIDTH = 8 + 5 + BINS


def encode_passages(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages x WIDTH) of the texts in ``raw``, and the document of
    each passage.  A text is cut into equal passages of at most PASSAGE bytes; an
    empty text has one empty passage."""
    sizes = np.diff(bounds)
    n = np.maximum(1, -(-sizes // PASSAGE))
    doc = np.repeat(np.arange(len(sizes)), n)
    step = -(-sizes // n)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(bounds[:-1][doc] + inner * step[doc], bounds[1:][doc])
    stop = np.minimum(start + step[doc], bounds[1:][doc])
    size = stop - start
    owner = np.repeat(np.arange(len(doc)), size)
    p, one = len(doc), np.maximum(size, 1)[:, None]
    x = np.zeros((p, WIDTH), np.float32)
    kinds = _CLASS[raw]
    x[:, :8] = np.bincount(owner * 8 + kinds, minlength=p * 8).reshape(p, 8) / one
    if len(raw) > 1:
        pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
        inside = owner[:-1] == owner[1:]
        x[:, 13:] = np.sqrt(np.bincount((owner[:-1] * BINS + _PAIR_BIN[pair])[inside], minlength=p * BINS).reshape(p, BINS) / one)
    # words: starts after a space or at a passage's front
    space = (kinds == 3) | (kinds == 4)
    first = ~space
    first[1:] &= space[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    words = np.bincount(owner[at], minlength=p)
    if len(at):
        # a word's hash: the sum of its bytes times powers by place
        place = np.arange(len(raw)) - np.maximum.accumulate(np.where(first, np.arange(len(raw)), 0))
        with np.errstate(over="ignore"):
            term = np.where(space, 0, (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, 255)])
            h = np.add.reduceat(term, at)
            key = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (owner[at].astype(np.uint64) << np.uint64(40))
        # words equal to the word before them, and distinct words
        equal = (h[1:] == h[:-1]) & (owner[at][1:] == owner[at][:-1])
        x[:, 8] = np.bincount(owner[at][1:][equal], minlength=p) / np.maximum(words, 1)
        _, back = np.unique(key, return_index=True)
        x[:, 9] = np.bincount(owner[at][back], minlength=p) / np.maximum(words, 1)
    x[:, 10] = words / one[:, 0]
    x[:, 11] = np.log1p(size) / 8
    x[:, 12] = words == 0
    return x, doc


_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(256)], np.uint64)


class Attention:
    """The network; parameters are plain arrays, so it travels in a closure."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"W": r.normal(0, width ** -0.5, (width, hidden)), "b": np.zeros(hidden), "V": r.normal(0, 0.3, (hidden, gate)),
                  "U": r.normal(0, 0.3, (hidden, gate)), "w": np.zeros(gate), "c": r.normal(0, 0.1, hidden), "d": np.zeros(1)}

    def pool(self, x: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Of each of ``n`` documents the sum of its weighted passage vectors and of
        the weights; sums of parts of a document add up."""
        p, xs = self.p, (x - self.mean) / self.scale
        h = np.tanh(xs @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]  # |e| <= sum |w|, so exp needs no shift
        a = np.exp(np.clip(e, -30, 30))
        z = np.stack([np.bincount(doc, a * h[:, j], n) for j in range(h.shape[1])], 1)
        return z, np.bincount(doc, a, n), (xs, h, t, g, a)

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 150, rate: float = 0.01,
            decay: float = 1e-4) -> None:
        """Full-batch Adam on the weighted log loss."""
        n, p = len(y), self.p
        self.mean, self.scale = x.mean(0), x.std(0) + np.float32(0.02)
        m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, epochs + 1):
            z, total, (xs, h, t, g, a) = self.pool(x, doc, n)
            z, a = z / total[:, None], a / total[doc]
            logit = z @ p["c"] + p["d"]
            dl = (1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()
            dz = dl[:, None] * p["c"]
            da = np.einsum("ij,ij->i", dz[doc], h)
            de = a * (da - np.bincount(doc, a * da, n)[doc])
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad = {"c": z.T @ dl, "d": dl.sum(keepdims=True), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg,
                    "W": xs.T @ dh, "b": dh.sum(0)}
            for k in p:
                grad[k] = grad[k] + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)

    def scores(self, raw: np.ndarray, bounds: np.ndarray, part: int = 1024 * PASSAGE) -> np.ndarray:
        """The scores of the texts in ``raw``; a longer one is pooled part by part."""
        if len(bounds) == 2 and len(raw) > part:
            pooled = [self.pool(*encode_passages(x := raw[i:i + part], np.array([0, len(x)])), 1)
                      for i in range(0, len(raw), part)]
            z, total = sum(x[0] for x in pooled), sum(x[1] for x in pooled)
        else:
            z, total, _ = self.pool(*encode_passages(raw, bounds), len(bounds) - 1)
        logit = z / total[:, None] @ self.p["c"] + self.p["d"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_quality(documents: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text",
                id_col: str = "doc_id", sample_rows: int = 1500, sample_passages: int = 16) -> Attention:
    """Learn from a bounded sample of ``documents``, labelled by ``labels`` (joined on
    the id): of each label (0 and 1) the ``sample_rows`` rows with the smallest hash
    of id and text, of each at most ``sample_passages`` passages spread evenly over
    the whole text.  Rows weigh as their label's share of all labelled rows, so scores
    are probabilities under the labels' own frequency.

    Null ids, labels and texts are not used; with no label or one only, the score is
    that label's.  Only ids, hashes and labels are shuffled; the sample's ids, at most
    twice ``sample_rows``, are broadcast to read its texts."""
    y = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    hashed = F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h")
    rows = (documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), hashed)
            .join(y, "_id").select("_id", "_h", "_y"))
    counts = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    net = Attention()
    if len(counts) < 2:
        net.p["c"][:] = 0
        net.p["d"][:] = 4.0 if counts.get(1) else -4.0 if counts else 0.0
        return net
    picked = [rows.where(F.col("_y") == v).orderBy("_h", "_id").limit(sample_rows) for v in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]).distinct())
    texts = documents.select(F.col(id_col).alias("_id"), hashed, F.col(text_col).alias("_t")).join(sample, ["_id", "_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_t", 1 << 20):
                x, doc = encode_passages(*byte_rows(batch, "_t"))
                at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                bags = []
                for a, b in zip(at[:-1], at[1:]):
                    chosen = np.unique(np.linspace(a, b - 1, min(b - a, sample_passages)).astype(int))
                    bags.append(x[chosen].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["_y", "_h", "_x"])

    found = sorted(texts.select(F.col("_y").cast("int").alias("_y"), "_h", "_t").mapInArrow(run, "_y int, _h long, _x binary").collect())
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in found]
    ys = np.array([r[0] for r in found], float)
    share = {v: counts[v] / max(1, (ys == v).sum()) for v in (0, 1)}
    net.fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(x) for x in bags]), ys, np.array([share[int(v)] for v in ys]))
    return net


def score_quality(df: DataFrame, net: Attention, text_col: str = "text", score_col: str = "score",
                  keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``df`` and ``score_col`` (replaced if there), the
    probability of label 1 from the whole text.  A null text counts as empty: one
    empty passage.  Repeated rows get the same score; an empty table gives no rows."""
    small_batches(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c != score_col]
    base = df.select(*keep, F.col(text_col).alias("_scored_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_scored_text", 1 << 20):
                scores = net.scores(*byte_rows(batch, "_scored_text"))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*keep, score_col])

    return base.mapInArrow(run, StructType([*base.schema.fields[:-1]]).add(score_col, DoubleType()))
