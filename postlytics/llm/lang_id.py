"""Language identification by compression: a text belongs to the language whose
Zstandard raw-content dictionary makes it smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window, functions as F

from postlytics.llm.common import small_batches

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower case, every run of other characters than letters one space."""
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace")


def fit_dictionaries(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
                     sample_rows: int = 400, piece_chars: int = 256) -> dict[str, bytes]:
    """A raw-content dictionary a language, from a bounded sample: of each
    language the ``sample_rows`` rows with the smallest hash of id and text, of
    each the ``piece_chars`` characters in its middle.  At most ``sample_rows *
    piece_chars`` characters a language come to the driver; the number of rows of a
    language does not matter.  Rows without language or letters are not used.  The
    languages come in order of their rows, most first."""
    n = F.length("_t")
    rows = (df.select(F.col(lang_col).alias("_l"), F.col(text_col).alias("_t"),
                      F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"))
            .where(F.col("_l").isNotNull() & F.col("_t").rlike(r"\p{L}"))
            .select("_l", "_h", F.substring(F.col("_t"), F.greatest(F.lit(1), (n / 2).cast("int") - piece_chars // 2),
                                            F.lit(piece_chars)).alias("_t")))
    first = Window.partitionBy("_l").orderBy("_h", "_t")
    picked = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample_rows)
    pieces: dict[str, list[tuple[int, bytes]]] = {}
    counts = dict(rows.groupBy("_l").count().toLocalIterator())
    for r in picked.select("_l", "_n", "_t").toLocalIterator():
        pieces.setdefault(r[0], []).append((r[1], letters(r[2])))
    order = sorted(pieces, key=lambda x: (-counts.get(x, 0), x))
    return {lang: b"".join(x[1] for x in sorted(pieces[lang])) for lang in order}


class Sizer:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, chunk: int):
        self.langs, self.chunk, self.by = list(dictionaries), chunk, []
        for raw in dictionaries.values():
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstd.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False,
                                               write_dict_id=False, level=level))

    def sizes(self, data: bytes) -> list[int]:
        """The text is encoded in pieces of ``chunk`` bytes, each on its own, so
        that what a long text repeats of itself does not outweigh the dictionary."""
        view = memoryview(data)
        parts = [view[i:i + self.chunk] for i in range(0, len(view), self.chunk)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.by]

    def best(self, data: bytes) -> tuple[str, float]:
        """The language with the smallest size (ties: the first) and its margin, the
        share by which the second smallest is larger."""
        sizes = self.sizes(data)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        margin = 1.0 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0
        return self.langs[order[0]], margin


def predict_language(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
                     level: int = 6, chunk: int = 4096, min_margin: float = 0.01) -> DataFrame:
    """One row a row of ``df``: ``doc_id, lang`` (``und`` where the margin is under
    ``min_margin``), ``lang_pred`` (the same without that rejection), ``score`` and
    ``margin``.

    The whole text is encoded.  ``margin`` is the share by which the second
    smallest encoding is larger; ``score`` rises with it from 0 to 1 and is 0.5 at
    ``min_margin``.  Equal smallest sizes are encoded again at the highest level; if
    still equal, the language learned from the most rows wins.  A text that is null or has no letter, and every text when no
    language was learned, is ``und`` with score 0.  Repeated rows get the same
    answer each; only the two columns are read."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                     F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries, level, chunk)
        finer: list[Sizer] = []  # for ties of short texts
        for batch in batches:
            out: list[tuple[str, str, float, float]] = []
            for text, letter in zip(batch.column(1), batch.column(2)):
                if not letter.as_py() or not sizer.langs:
                    out.append((UNKNOWN, UNKNOWN, 0.0, 0.0))
                    continue
                data = letters(text.as_py())
                lang, margin = sizer.best(data)
                if margin == 0:
                    finer = finer or [Sizer(dictionaries, 19, chunk)]
                    lang, margin = finer[0].best(data)
                out.append((lang if margin >= min_margin else UNKNOWN, lang, margin / (margin + min_margin), margin))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                ["doc_id", "lang", "lang_pred", "score", "margin"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang string, lang_pred string, score double, margin double")
