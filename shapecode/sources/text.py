"""Text inputs (S5-S9, S11): comma lists, coded-frame archives, labels,
annotation listings and reference sample tables.

All parsing is ``split`` / ``regexp_extract`` / ``try_cast`` on the JVM; bad
numbers become NULL (ANSI ``cast`` would fail the task) and lines that do
not match a pattern are filtered out, not raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecode.config import ANNOTATION_PATTERN


def double_list(text: Column, sep: str = ",") -> Column:
    """``"1.0,2.5"`` -> ``[1.0, 2.5]``; an empty string gives ``[]``."""
    parts = F.filter(F.split(text, F.lit(sep)), lambda x: F.trim(x) != F.lit(""))
    return F.transform(parts, lambda x: F.trim(x).try_cast("double"))


def read_frames_csv(spark: SparkSession, path: str) -> DataFrame:
    """One comma list per line -> ``frame ARRAY<DOUBLE>`` (+ line index)."""
    return spark.read.text(path).select(double_list(F.col("value")).alias("frame"))


def parse_archive(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``(srcId,srcTs,frameRef,maxErr,path,;src;coded;loss;)`` lines.

    The head is cut off first, so a reader that wants no lists does not search
    through them; a closing bracket belongs to the head of a line without lists only.
    """
    line = F.col(value_col)
    v = F.regexp_replace(line, r"^\(|\)$", "")
    head = F.substring_index(line, ";", 1)
    head = F.when(F.contains(line, F.lit(";")), F.regexp_replace(head, r"^\(", "")).otherwise(F.regexp_replace(head, r"^\(|\)$", ""))
    hp = F.split(head, ",")
    return lines.select(
        hp[0].alias("srcId"), hp[1].try_cast("double").alias("srcTs"),
        hp[2].try_cast("double").cast("bigint").alias("frame_ref"),
        hp[3].try_cast("double").alias("max_err"), hp[4].alias("path"),
        double_list(F.split_part(v, F.lit(";"), F.lit(2))).alias("src"),
        double_list(F.split_part(v, F.lit(";"), F.lit(3))).alias("coded"),
        double_list(F.split_part(v, F.lit(";"), F.lit(4))).alias("loss"))


def parse_batch_coded(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``src;coded;loss`` lines (the whole loss list is kept)."""
    v = F.col(value_col)
    return lines.select(
        double_list(F.split_part(v, F.lit(";"), F.lit(1))).alias("src"),
        double_list(F.split_part(v, F.lit(";"), F.lit(2))).alias("coded"),
        double_list(F.split_part(v, F.lit(";"), F.lit(3))).alias("loss"))


def read_labels(spark: SparkSession, path: str, with_record: bool = False) -> DataFrame:
    """``frameStart,label`` lines, with the file of each as ``_path``.

    ``with_record``: ``record,frameStart,label`` lines of files that hold many
    records, with the record as ``record_id``.
    """
    record = "record_id BIGINT, " if with_record else ""
    return spark.read.schema(f"{record}frame_ref BIGINT, label STRING").csv(path).withColumn("_path", F.col("_metadata.file_path"))


def parse_annotations(lines: DataFrame, record_id: Column | str, value_col: str = "value",
                      line_col: str = "line_no") -> DataFrame:
    """Groups 1, 3, 5 of the annotation pattern -> ``(t, sample, code)``.

    Lines that do not match, or match without a sample (bracketed clock
    lines), are dropped.
    """
    v = F.col(value_col)
    out = lines.select(
        (F.col(record_id) if isinstance(record_id, str) else record_id).alias("record_id"),
        F.col(line_col).alias("line_no"),
        F.regexp_extract(v, ANNOTATION_PATTERN, 1).alias("t"),
        F.regexp_extract(v, ANNOTATION_PATTERN, 3).alias("_s"),
        F.regexp_extract(v, ANNOTATION_PATTERN, 5).alias("code"))
    return out.where(F.col("_s") != "").select(
        "record_id", "line_no", "t", F.col("_s").cast("bigint").alias("sample"), "code")


FILE_STEM = r"([^/]+?)(\.[^./]*)?$"


def read_annotations(spark: SparkSession, path: str, record_pattern: str = FILE_STEM) -> DataFrame:
    """S9 over files: record id from the file path, line order from the file position.

    Splits of a file may be packed into tasks in any order, so a line is placed
    by where its split starts, then by its position among the task's rows.
    """
    df = spark.read.text(path).withColumn("_path", F.col("_metadata.file_path"))
    place = F.monotonically_increasing_id().bitwiseAND(2**33 - 1).cast("decimal(38,0)")
    start = F.col("_metadata.file_block_start").cast("decimal(20,0)")
    df = df.withColumn("line_no", (start * F.lit(2**33).cast("decimal(11,0)") + place).cast("decimal(38,0)"))
    return parse_annotations(df, F.regexp_extract("_path", record_pattern, 1))


def read_reference_samples(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``index, channel 1, channel 2`` (+ difference)."""
    df = spark.read.option("sep", "\t").schema("i BIGINT, s1 INT, s2 INT").csv(path)
    return df.withColumn("_path", F.col("_metadata.file_path")).withColumn("diff", F.col("s1") - F.col("s2"))


def read_apnea(spark: SparkSession, path: str) -> DataFrame:
    """Apnea lines ``record,n, sample, hh:mm, code`` as (record_id, n, sample, hh, mm, code, line)."""
    v = spark.read.text(path).select(F.regexp_extract("value", r"^(-?\d+),", 1).cast("bigint").alias("record_id"),
                                     F.regexp_replace("value", r"^-?\d+,", "").alias("line"))
    part = lambda k: F.regexp_extract("line", r"^(\d+), (\d+), (\d+):(\d+), (\w)$", k)
    return v.select("record_id", part(1).cast("bigint").alias("n"), part(2).cast("bigint").alias("sample"), part(3).cast("int").alias("hh"),
                    part(4).cast("int").alias("mm"), part(5).alias("code"), "line")
