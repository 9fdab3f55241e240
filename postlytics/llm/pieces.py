"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed and its parts rebuilt: the normaliser with the
white-space mark, the unigram scores or the merges that the piece scores stand
for, and byte fallback.  Texts are encoded word by word through a table
(``tokens.UnitCache``), the words that it lacks in multithreaded batches, and each
of these is also encoded by the sentencepiece library: the result says whether
both agree.  As no piece reaches over the front border of a word (checked when
the model is built), agreement on a text's words is agreement on the text."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from postlytics.llm.common import slices, small_batches, worker_table
from postlytics.llm.tokens import ID, UnitCache

# fixed values of the format: the white-space mark, piece types, model types
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

DECODED = 20  # texts decoded at once


class Model:
    """A SentencePiece model file on the tokenizers library."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        spec, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        self.dummy_prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        text = [(p, s) for p, s, t in self.pieces if t in (NORMAL, USER_DEFINED)]
        if any(MARK in p.lstrip(MARK) for p, _ in text):
            raise ValueError("pieces of this model reach across words")
        unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        if kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unk, byte_fallback=proto.trainer_spec.byte_fallback)
        elif kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(text), unk_token=self.pieces[unk][0], fuse_unk=True,
                               byte_fallback=proto.trainer_spec.byte_fallback)
        else:
            raise ValueError("a word or character model has no tokenizers counterpart")
        steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        self.normalise = normalizers.Sequence(steps + [normalizers.Replace(" ", MARK)])
        self.plain = not spec.precompiled_charsmap and not self.squeeze and self.dummy_prefix
        self.words = Tokenizer(model)  # of normalised words
        back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        self.words.decoder = decoders.Sequence(back + [decoders.Strip(" ", int(self.dummy_prefix), 0)])
        raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode()
               for p, _, t in self.pieces]
        self.piece_size = np.array([len(x) for x in raw], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_size)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.words.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")

    @staticmethod
    def merges(text: list[tuple[str, float]]) -> list[tuple[str, str]]:
        """A piece's score is the rank of the merge that makes it, whatever its two
        parts; so all its splits into two pieces are merges of that rank."""
        at = {p: i for i, (p, _) in enumerate(text)}
        found = []
        for p, score in text:
            for k in range(1, len(p)):
                if p[:k] in at and p[k:] in at:
                    found.append((-score, at[p], at[p[:k]], at[p[k:]], p[:k], p[k:]))
        return [(x[4], x[5]) for x in sorted(found)]

    def units(self, text: str) -> list[str]:
        """The words of a text, normalised, each from its marks on."""
        if not text:
            return []
        if not self.plain:
            return WORD.findall(self.normalise.normalize_str(text))
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or marked[-1] == MARK:
            return WORD.findall(marked)
        return [MARK + x for x in marked[1:].split(MARK)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of rows ``bounds`` of ``ids``: the pieces' bytes are gathered for
        all rows at once; a dummy prefix is taken off; bytes that are not UTF-8
        become replacement characters."""
        ids = ids[:bounds[-1]]
        sizes = self.piece_size[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.piece_start[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        data = self.piece_bytes[at].tobytes()
        cut = ends[bounds]
        skip = int(self.dummy_prefix)
        return [data[a + (skip and data[a:a + 1] == b" "):b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def worker_model(path: str, threads: int) -> tuple[Model, UnitCache, set[str]]:
    """The model, its word table and the words on which the libraries differ, one a
    Python worker."""
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece
        model, other = Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
        differ: set[str] = set()
        ahead = len(other.encode("a"))

        def encode(words: list[str]) -> list[bytes]:
            mine = [e.ids for e in model.words.encode_batch_fast(words, add_special_tokens=False)]
            # behind another word, as a word alone may be an empty text
            theirs = other.encode(["a" + w.replace(MARK, " ") for w in words], num_threads=threads)
            differ.update(w for w, a, b in zip(words, mine, theirs) if a != b[ahead:])
            return [np.array(x, ID).tobytes() for x in mine]

        return model, UnitCache(encode), differ

    return worker_table(f"pieces {path}", make)


def encode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  threads: int = 2, decoded: bool = False) -> DataFrame:
    """One row a row of ``df``: ``doc_id, text, ids`` (array of int), ``parity`` and, if
    asked for, ``decoded``: the ids' text, made in the same pass, so that one worker a task
    slot holds the model and not two.

    ``parity`` is whether the sentencepiece library gives the same ids.  A null or
    empty text has no ids; repeated rows and null ids are kept; an empty table
    gives no rows; other columns are not read.  ``model_path`` must be readable on
    every executor."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache, differ = worker_model(model_path, threads)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [model.units(t) for t in batch.column(1).to_pylist()]
                ids = cache.ids(texts)
                sizes = np.cumsum([0, *(len(x) // ID.itemsize for x in ids)]).astype(np.int32)
                values = np.frombuffer(b"".join(ids), ID).astype(np.int32)
                cols = {"doc_id": batch.column(0), "text": batch.column(1),
                        "ids": pa.ListArray.from_arrays(pa.array(sizes), pa.array(values)),
                        "parity": pa.array([not differ or differ.isdisjoint(t) for t in texts], pa.bool_())}
                if decoded:
                    runs = (model.decode(values[sizes[at]:], sizes[at:at + DECODED + 1] - sizes[at])
                            for at in range(0, len(ids), DECODED))
                    cols["decoded"] = pa.array([t for some in runs for t in some], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, ids array<int>, parity boolean" + ", decoded string" * decoded)


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded",
                  threads: int = 2) -> DataFrame:
    """``df`` with ``out_col`` (replaced if there), the text of the ids.  Null ids give
    null, no ids an empty text; bytes that are not UTF-8 become replacement characters."""
    small_batches(df.sparkSession)
    base = df.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _, _ = worker_model(model_path, threads)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED):
                batch = whole.slice(at, DECODED)
                ids = batch.column(batch.schema.get_field_index(ids_col))
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                values = ids.flatten().to_numpy(zero_copy_only=False)
                texts = model.decode(values, np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))],
                    [*batch.schema.names, out_col])

    from pyspark.sql.types import StringType, StructType
    return base.mapInArrow(run, StructType([*base.schema.fields]).add(out_col, StringType()))


def pieces_digest(encoded: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of ids, a hash of them, whether the decoded text is
    the source, and parity."""
    back = encoded if "decoded" in encoded.columns else decode_pieces(encoded, model_path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.crc32(F.array_join("ids", ",")).alias("ids_crc32"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"), "parity")
