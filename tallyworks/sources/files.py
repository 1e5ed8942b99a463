"""Delimited and Parquet sources. Schemas are always declared; nothing is inferred."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import path_of

NULL_TOKENS = ("", "NULL", "None", "nan")


def _schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True, on_error: str = "continue") -> DataFrame:
    """Text columns, trimmed, several null tokens. ``on_error``: abort (the read fails), continue (short and long rows
    are filled or cut), or skip (they are dropped)."""
    mode = {"abort": "FAILFAST", "continue": "PERMISSIVE", "skip": "DROPMALFORMED"}[on_error]
    df = spark.read.schema(_schema(columns)).option("sep", sep).option("header", header).option("quote", '"').option("mode", mode).csv(path)
    clean = lambda c: F.when(~F.trim(c).isin(*NULL_TOKENS), F.trim(c)).alias(c)
    return df.select(*[clean(c) for c in columns])


def read_positional(spark: SparkSession, path: str, width: int, sep: str = ",", header: bool = True) -> DataFrame:
    """Columns c1..cN and the file each row came from."""
    df = spark.read.schema(_schema([f"c{i}" for i in range(1, width + 1)])).option("sep", sep).option("header", header).csv(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated places; codes are padded to five digits."""
    df = read_delimited(spark, path, ["geoid", "lat", "lon"], sep="\t")
    return df.select(F.lpad("geoid", 5, "0").alias("geoid"), F.expr("try_cast(lat AS double)").alias("lat"), F.expr("try_cast(lon AS double)").alias("lon"))


def export(df: DataFrame, columns: list[str], path: str, fmt: str = "parquet") -> None:
    """A projection written out; booleans as TRUE and FALSE in text formats."""
    out = df.select(*columns)
    if fmt == "csv":
        flags = {c for c, t in out.dtypes if t == "boolean"}
        out = out.select(*[F.upper(F.col(c).cast("string")).alias(c) if c in flags else c for c in columns])
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").format(fmt).save(path)


def load_missing(target: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of ``target`` filled from ``updates`` where it is null (an update from a join, as a new table)."""
    u = updates.select(key, F.col(column).alias("_new"))
    return target.join(u, key, "left").withColumn(column, F.coalesce(column, "_new")).select(*target.columns)


def upload(spark: SparkSession, local: str, folder: str) -> str:
    """A local file into a folder of the session's store; returns its path there."""
    fs, p = path_of(spark, folder)
    fs.mkdirs(p)
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}")
    fs.copyFromLocalFile(False, True, here, p)
    return f"{folder.rstrip('/')}/{os.path.basename(local)}"


def read_revocations(spark: SparkSession, path: str) -> DataFrame:
    """Numbers that are not in good standing: twelve fields between pipes (or commas, where no pipe is found), no header,
    the first one the number, the last one the day of reinstatement, which takes a row off the list."""
    names = [f"c{i}" for i in range(12)]
    for sep in ("|", ","):
        rows = read_delimited(spark, path, names, sep=sep, header=False)
        if rows.where("c9 IS NOT NULL OR c11 IS NOT NULL").limit(1).count():
            break
    ein = F.lpad(F.regexp_replace("c0", "[^0-9]", ""), 9, "0")
    return rows.where("c11 IS NULL AND c0 IS NOT NULL").select(ein.alias("ein")).where("length(regexp_replace(ein, '[^0-9]', '')) = 9").distinct()


def good_standing(filings: DataFrame, revoked: DataFrame) -> DataFrame:
    """Filings without those whose number is on the list."""
    return filings.join(revoked, "ein", "left_anti")


def vectors(df: DataFrame, column: str, width: int) -> DataFrame:
    """Vectors from their JSON text; a text that is not an array of ``width`` numbers becomes null."""
    v = F.from_json(F.col(column), "array<double>")
    return df.withColumn(column, F.when(F.size(v) == width, v))


def typed_times(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns as timestamps; what is none becomes null."""
    return df.withColumns({c: F.try_to_timestamp(c).cast("timestamp_ntz") for c in columns})
