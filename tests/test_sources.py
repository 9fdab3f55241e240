"""File sources and sinks (A1-A11) on small hand-made files."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from postlytics.sources import files


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="postlytics-src-", dir=os.environ.get("TMPDIR", "/tmp"))


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


SCHEMA = "id long, title string, score long"
CSV = 'id,title,score\n1,"a, quoted\nmulti-line title",10\n2,plain,not-a-number\n3,,7\n'


def test_tolerant_csv_bad_cell_is_null(spark, tmp):
    p = _write(f"{tmp}/posts.csv", CSV)
    rows = sorted(tuple(r) for r in files.read_csv_tolerant(spark, p, SCHEMA).collect())
    assert rows == [(1, "a, quoted\nmulti-line title", 10), (2, "plain", None), (3, None, 7)]


def test_strict_csv_fails_on_bad_cell(spark, tmp):
    p = _write(f"{tmp}/posts.csv", CSV)
    with pytest.raises(Exception):
        files.read_csv_strict(spark, p, SCHEMA).collect()


def test_json_lists_and_keyword_csv(spark, tmp):
    p = _write(f"{tmp}/list.json", json.dumps(["OpenAI", "rust", "go"]))
    assert [r.word for r in files.read_string_list(spark, p).collect()] == ["OpenAI", "rust", "go"]
    p = _write(f"{tmp}/objs.json", json.dumps([{"name": "Acme", "x": 1}, {"name": "Globex"}]))
    assert sorted(r.name for r in files.read_object_names(spark, p).collect()) == ["Acme", "Globex"]
    p = _write(f"{tmp}/brands.csv", "Name,Other\nApple,1\nNVIDIA,2\n")
    assert sorted(r.word for r in files.read_keyword_csv(spark, p).collect()) == ["apple", "nvidia"]


def test_id_url_map_skips_empty_and_last_url_wins(spark, tmp):
    p = _write(f"{tmp}/links.json", json.dumps({"1": "https://a", "2": "", "3": "https://c"}))
    assert sorted(tuple(r) for r in files.read_id_url_map(spark, p).collect()) == [(1, "https://a"),
                                                                                 (3, "https://c")]
    df = spark.createDataFrame([(1, 0, "u1"), (1, 2, "u3"), (1, 1, "u2"), (2, 0, "v")], "id long, pos long, url string")
    assert sorted(tuple(r) for r in files.last_url_per_id(df, ["pos"]).collect()) == [(1, "u3"), (2, "v")]


def test_sinks(spark, tmp):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, words array<string>")
    files.write_csv(df, f"{tmp}/out_csv")
    back = files.read_csv_tolerant(spark, f"{tmp}/out_csv", "id long, words string")
    assert sorted((r.id, r.words) for r in back.collect()) == [(1, "a|b"), (2, None)]
    files.write_replace(df, f"{tmp}/t")
    files.write_replace(df.where(F.col("id") == 1), f"{tmp}/t")
    assert spark.read.parquet(f"{tmp}/t").count() == 1
    files.write_append(df, f"{tmp}/t")
    files.write_append(df, f"{tmp}/new")                 # created when absent
    assert spark.read.parquet(f"{tmp}/t").count() == 3
    assert spark.read.parquet(f"{tmp}/new").count() == 2


def test_audited_scan_counts_bad_cells(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,score,day,note\n1,2.5,2020-01-02,"a ""b"", c"\n2,x,2020-13-02,\n,3,,"two\nlines"\n4,,nope,ok\n')
    schema = StructType([StructField("id", LongType()), StructField("score", DoubleType()), StructField("day", DateType()), StructField("note", StringType())])
    read = files.read_csv_audited(spark, str(path), schema)
    rows = {r.id: r for r in read.collect()}
    assert {i: sorted(r._bad) for i, r in rows.items()} == {1: [], 2: ["day", "score"], None: [], 4: ["day"]}
    assert rows[1].note == 'a "b", c' and rows[None].note == "two\nlines" and rows[2].score is None
    account = {r.column: (r.n_rows, r.n_bad, r.n_null) for r in files.cell_account(read).collect()}
    assert account == {"id": (4, 0, 1), "score": (4, 1, 2), "day": (4, 2, 3), "note": (4, 0, 1)}
    assert files.read_csv_audited(spark, str(path), schema).limit(0).count() == 0
