"""File scans and sinks.

CSV is read with an explicit schema: a tolerant scan turns a cell that does not
parse into null (``PERMISSIVE``), a strict scan fails (``FAILFAST``).  Schema
inference is never used -- one bad cell would turn the whole column into string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _csv(spark: SparkSession, path: str, schema: StructType | str, mode: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", mode).csv(path))


def read_csv_tolerant(spark: SparkSession, path: str, schema) -> DataFrame:
    """A1: header CSV, a bad cell becomes null."""
    return _csv(spark, path, schema, "PERMISSIVE")


def read_csv_strict(spark: SparkSession, path: str, schema) -> DataFrame:
    """A2: header CSV, a bad cell fails the job."""
    return _csv(spark, path, schema, "FAILFAST")


def read_csv_audited(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A1 with an account: as ``read_csv_tolerant``, and ``_bad``, the names of the
    cells that hold text which does not parse as their type (an empty cell is null and
    not bad).  The scan keeps the record of a row that does not parse; only those are
    split again, with every cell a string, and compared."""
    kept = StructType([*schema.fields, StructField("_record", StringType())])
    rows = (spark.read.schema(kept).option("header", True).option("multiLine", True).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").csv(path))
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    cells = F.from_csv("_record", ", ".join(f"`{f.name}` string" for f in texts), {"escape": '"', "mode": "PERMISSIVE"})
    bad = F.filter(F.array(*[F.when(F.col("_cells")[f.name].isNotNull() & F.col(f.name).isNull(), f.name) for f in schema.fields]),
                   lambda name: name.isNotNull())
    none = F.array().cast("array<string>")
    return (rows.withColumn("_cells", F.when(F.col("_record").isNotNull(), cells))
            .withColumn("_bad", F.when(F.col("_record").isNotNull(), bad).otherwise(none)).drop("_cells", "_record"))


def cell_account(audited: DataFrame) -> DataFrame:
    """``column, n_rows, n_bad, n_null`` of each column of ``read_csv_audited``."""
    cols = [c for c in audited.columns if c != "_bad"]
    sums = audited.agg(F.count(F.lit(1)).alias("n_rows"), *[F.array(
        F.count_if(F.array_contains("_bad", c)), F.count_if(F.col(c).isNull())).alias(f"_a{i}") for i, c in enumerate(cols)])
    return sums.select("n_rows", F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"_a{i}")[0].alias("n_bad"), F.col(f"_a{i}")[1].alias("n_null")) for i, c in enumerate(cols)])))


def read_string_list(spark: SparkSession, path: str, name: str = "word") -> DataFrame:
    """A4: a JSON file holding one list of strings -> one-column DataFrame."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias(name))


def read_object_names(spark: SparkSession, path: str, field: str = "name") -> DataFrame:
    """A5: a JSON list of objects, keep one field."""
    return spark.read.option("multiLine", True).json(path).select(F.col(field).alias(field))


def read_keyword_csv(spark: SparkSession, path: str, column: str = "Name") -> DataFrame:
    """Keyword column from a CSV, lower-cased."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(F.lower(F.col(column)).alias("word"))


def read_id_url_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON object id -> url; rows with an empty url are skipped."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,string>")
    return (raw.select(F.explode(m).alias("id", "url"))
               .select(F.col("id").cast("long").alias("id"), "url")
               .where(F.col("url").isNotNull() & (F.col("url") != "")))


def last_url_per_id(df: DataFrame, order_by: list[str], id_col: str = "id",
                    url_col: str = "url") -> DataFrame:
    """A3: id -> url map where a repeated id keeps its *last* url in ``order_by``
    order.  A map-side-combined ``max_by``: a hot id is reduced before the shuffle."""
    order = F.struct(*[F.col(c) for c in order_by])
    return df.groupBy(id_col).agg(F.max_by(F.col(url_col), order).alias(url_col))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink; array columns are joined with '|' first (CSV holds no arrays)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def write_replace(df: DataFrame, path: str) -> None:
    """A10: replace-table sink."""
    df.write.mode("overwrite").parquet(path)


def write_append(df: DataFrame, path: str) -> None:
    """Append sink; creates the table when absent."""
    df.write.mode("append").parquet(path)
