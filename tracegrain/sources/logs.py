"""Readers that turn text files and tables into ``(line_no, raw)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.operators.numbering import with_line_no

# What counts as blank at the ends of an uploaded text.
_BLANK = r"[\s\x1c-\x1f]+"


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of one or more text files, directories or globs; blank lines are kept."""
    return with_line_no(spark.read.text(path).withColumnRenamed("value", "raw"))


def read_uploaded_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of an uploaded text: bad UTF-8 replaced, white space stripped at both ends."""
    lines = with_line_no(
        spark.read.text(path, lineSep="\n").select(
            "*", F.make_valid_utf8("value").alias("raw")
        ).drop("value")
    )
    filled = F.length(F.regexp_replace("raw", "(?U)" + _BLANK, "")) > 0
    ends = lines.agg(
        F.min(F.when(filled, F.col("line_no"))).alias("first"),
        F.max(F.when(filled, F.col("line_no"))).alias("last"),
    ).first()
    if ends["first"] is None:
        return spark.createDataFrame([(0, "")], "line_no bigint, raw string")
    first, last = F.lit(ends["first"]), F.lit(ends["last"])
    line_no = F.col("line_no")
    text = F.col("raw")
    text = F.when(line_no == first, F.regexp_replace(text, "(?U)^" + _BLANK, "")).otherwise(text)
    text = F.when(line_no == last, F.regexp_replace(text, "(?U)" + _BLANK + r"\z", "")).otherwise(text)
    return lines.filter(line_no.between(first, last)).select(
        (line_no - first).alias("line_no"), text.alias("raw")
    )


def require_valid_utf8(df: DataFrame, column: str = "raw") -> DataFrame:
    """Fail the job on the first line that is not UTF-8."""
    return df.withColumn(column, F.validate_utf8(column))


def mark_valid_utf8(df: DataFrame, column: str = "raw") -> DataFrame:
    """Flag lines instead of failing, so that bad ones can be set aside."""
    return df.withColumn("is_valid", F.is_valid_utf8(column))


def log_lines_from_events(events: DataFrame, *keep: str) -> DataFrame:
    """One log line per event row, with further columns of ``events`` if asked for."""
    user = F.col("user_id").cast("string")
    value = F.floor("value").cast("int").cast("string")
    address = F.concat(
        F.lit("10.0."),
        F.expr("cast(user_id % 256 as string)"),
        F.lit("."),
        F.expr("cast(event_id % 256 as string)"),
    )
    tries = F.expr("cast(1024 + event_id % 1000 as string)")
    kind = F.col("event_type")
    body = (
        F.when(
            (kind == "error") & (F.col("value") > 200),
            F.concat(F.lit("CRITICAL Furnace rack-"), user, F.lit(" overheats: sensor says "), value, F.lit("% above limit")),
        )
        .when(
            kind == "error",
            F.concat(F.lit("ERROR Valve of gateway "), address, F.lit(" stuck after "), tries, F.lit(" turns")),
        )
        .when(
            kind == "signup",
            F.concat(F.lit("WARNING Badge guest_"), user, F.lit(" printed late by "), value, F.lit("ms")),
        )
        .when(
            kind == "view",
            F.concat(F.lit("DEBUG Tile for guest_"), user, F.lit(" drawn through "), address),
        )
        .when(
            kind == "purchase",
            F.concat(
                F.lit("INFO Parcel "), F.col("event_id").cast("string"), F.lit(" weighing "), value,
                F.lit(" grams sent towards guest_"), user,
            ),
        )
        .otherwise(F.concat(F.lit("INFO Lamp guest_"), user, F.lit(" switched with "), F.col("props")))
    )
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = F.concat(stamp, F.lit(" "), body).alias("raw")
    return events.select(F.col("event_id").alias("line_no"), raw, *keep)


def lines_from_documents(documents: DataFrame) -> DataFrame:
    """Every line of every document, ordered by document and position: 2**32 numbers for each document."""
    placed = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return placed.select((F.shiftleft("doc_id", 32) + F.col("pos")).alias("line_no"), "raw")
