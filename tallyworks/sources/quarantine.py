"""Delimited files whose bad lines are kept: file, line and reason, written beside the clean rows in one pass.

A line is *clean* if it has exactly the declared number of cells and every quoted cell is closed where it ends. All other
lines are quarantined: ``short`` or ``long`` (number of cells), ``quote`` (a cell begins with a quote that does not end
it). Clean and quarantined lines together are all lines read: blank lines and headers are not lines. Cells are trimmed
and null tokens become null, as in ``files.read_delimited``; a quote within a quoted cell is doubled. Rows end with the
line: a quoted cell cannot hold a line break.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import NULL_TOKENS

#: A character that no text file should hold: with it as separator and without quotes, a line is one cell.
_NONE = "\u0001"
LINE, FILE, REASON = "_line", "_file", "_reason"


def read_checked(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """``columns`` (null where the line is bad), and ``_line``, ``_file``, ``_reason`` (null where it is clean)."""
    if len(sep) != 1 or sep in ('"', _NONE):
        raise ValueError(f"{sep!r} cannot separate cells")
    if clash := {LINE, FILE, REASON} & {c.lower() for c in columns}:
        raise ValueError(f"names of the quarantine: {sorted(clash)}")
    options = {"sep": _NONE, "quote": "", "header": header, "columnNameOfCorruptRecord": "whole", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw = spark.read.schema("line string, whole string").options(**options).csv(path)
    line = F.coalesce("whole", "line", F.lit(""))  # the whole line, should it hold that character all the same
    s = re.escape(sep)
    rest = F.regexp_replace(F.col(LINE), rf'(^|{s})"[^"]*+(?:""[^"]*+)*+"(?=$|{s})', "$1")  # without the quoted cells that are right
    cells = F.length("_rest") - F.length(F.replace("_rest", F.lit(sep))) + 1
    reason = F.when(F.col("_rest").rlike(f'(^|{s})"'), "quote").when(cells < len(columns), "short").when(cells > len(columns), "long")
    rows = raw.select(line.alias(LINE), F.col("_metadata.file_path").alias(FILE)).withColumn("_rest", rest).withColumn(REASON, reason)
    parsed = F.from_csv(F.when(F.col(REASON).isNull(), F.col(LINE)), ", ".join(f"`{c}` string" for c in columns), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    rows = rows.withColumn("_cells", parsed)
    clean = [F.when(~F.trim(F.col("_cells")[c]).isin(*NULL_TOKENS), F.trim(F.col("_cells")[c])).alias(c) for c in columns]
    return rows.select(*clean, LINE, FILE, REASON)


def load(spark: SparkSession, path: str, columns: list[str], out: str, sep: str = ",", header: bool = True, on_error: str = "continue", mode: str = "append") -> dict[str, int]:
    """Load a file or folder into the table at ``out``; the lines by reason (clean ones under ``ok``), counted while they
    are written. ``on_error``: ``continue`` keeps bad lines in quarantine, ``abort`` fails before anything is published if
    there is one."""
    rows = read_checked(spark, path, columns, sep, header)
    if on_error == "abort":
        if (bad := rows.where(F.col(REASON).isNotNull()).select(FILE, REASON, LINE).first()) is not None:
            raise ValueError(f"{bad[REASON]} line in {bad[FILE]}: {bad[LINE][:200]!r}")
    elif on_error != "continue":
        raise ValueError(on_error)
    kept = rows.withColumn(LINE, F.when(F.col(REASON).isNotNull(), F.col(LINE))).withColumn("_rejected", F.col(REASON).isNotNull())
    seen = Observation("lines")
    counts = [F.count(F.when(F.col(REASON).eqNullSafe(r), 1)).alias(r or "ok") for r in (None, "short", "long", "quote")]
    kept.observe(seen, *counts).write.mode(mode).partitionBy("_rejected").parquet(out)
    return dict(seen.get)


def loaded(spark: SparkSession, out: str, columns: list[str]) -> DataFrame:
    """The clean rows of a table that ``load`` wrote; only their folder is read."""
    return _table(spark, out, columns).where("NOT _rejected").select(*columns)


def quarantined(spark: SparkSession, out: str, columns: list[str]) -> DataFrame:
    """The bad lines of a table that ``load`` wrote, each with its file and reason; only their folder is read."""
    return _table(spark, out, columns).where("_rejected").select(FILE, REASON, LINE)


def _table(spark: SparkSession, out: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` string" for c in [*columns, LINE, FILE, REASON]) + ", _rejected boolean").parquet(out)
