"""Binary recordings (S3 format 212, S4 16-bit little-endian, S10 apnea
annotations, S14 input inventory).

Input is any DataFrame with ``path STRING, content BINARY`` -- normally
``spark.read.format("binaryFile")`` -- so files are decoded on executors.
Each record position becomes a row through ``explode(sequence(...))`` and
bit operations on the bytes; no Python runs per sample.  A trailing partial
record is ignored (and reported by :func:`inventory`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecode.config import APNEA_LINE_FORMAT, APNEA_MARK, APNEA_SAMPLES_PER_MINUTE


def read_binary(spark: SparkSession, path: str, glob: str = "*.dat") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def inventory(spark: SparkSession, path: str, glob: str = "*.dat", record_bytes: int = 3) -> DataFrame:
    """Listing with record count and left-over bytes (content not read)."""
    df = read_binary(spark, path, glob).select("path", "length", "modificationTime")
    return df.withColumn("n_records", F.floor(F.col("length") / F.lit(record_bytes)).cast("bigint")) \
             .withColumn("remainder", (F.col("length") % F.lit(record_bytes)).cast("bigint"))


_FILE_COLS = ("content", "length", "modificationTime")


def _records(files: DataFrame, record_bytes: int) -> DataFrame:
    """One row per whole record; keeps the file's other columns (``path``, ...).

    ``_k`` is the record's position in the content; ``i`` adds the content's
    first record number ``i0`` when the input is a block of a longer record.
    """
    n = F.floor(F.length("content") / F.lit(record_bytes)).cast("bigint")
    if "source_id" not in files.columns:
        files = files.withColumn("source_id", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    r = files.where(n > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("_k"))
    first = F.col("i0") if "i0" in files.columns else F.lit(0).cast("bigint")
    return r.withColumn("i", first + F.col("_k"))


def _keep(r: DataFrame):
    return [c for c in r.columns if c not in _FILE_COLS and c not in ("i", "_k", "i0")]


def _uint(content, offset, nbytes: int):
    """Big-endian unsigned value of ``nbytes`` bytes at 0-based ``offset``."""
    return F.conv(F.hex(F.substring(content, offset + F.lit(1), F.lit(nbytes))), 16, 10).cast("bigint")


def decode_212(files: DataFrame, signed: bool = False) -> DataFrame:
    """S3: 3-byte records ``b0 b1 b2`` -> ``s1 = ((b1 & 0x0f) << 8) + b0``,
    ``s2 = ((b1 & 0xf0) << 4) + b2``.  ``signed=True`` sign-extends 12 bits.

    Output: ``source_id (file stem), path, i, s1, s2`` (one row per record).
    """
    r = _records(files, 3)
    v = _uint(F.col("content"), F.col("_k") * 3, 3)
    b0, b1, b2 = F.shiftright(v, 16), F.shiftright(v, 8).bitwiseAND(0xFF), v.bitwiseAND(0xFF)
    s1 = F.shiftleft(b1.bitwiseAND(0x0F), 8) + b0
    s2 = F.shiftleft(b1.bitwiseAND(0xF0), 4) + b2
    if signed:
        s1 = F.when(s1 >= 2048, s1 - 4096).otherwise(s1)
        s2 = F.when(s2 >= 2048, s2 - 4096).otherwise(s2)
    return r.select(*_keep(r), "i", s1.cast("int").alias("s1"), s2.cast("int").alias("s2"))


def decode_212_long(files: DataFrame, signed: bool = False) -> DataFrame:
    """S3 in the long sample form ``(source_id, channel, i, raw)``."""
    d = decode_212(files, signed)
    return d.select("source_id", "i", F.explode(F.array(
        F.struct(F.lit(1).alias("channel"), F.col("s1").alias("raw")),
        F.struct(F.lit(2).alias("channel"), F.col("s2").alias("raw")))).alias("c")) \
        .select("source_id", F.col("c.channel").alias("channel"), "i", F.col("c.raw").alias("raw"))


def decode_le16(files: DataFrame) -> DataFrame:
    """Signed 16-bit little-endian samples, one channel."""
    r = _records(files, 2)
    v = _uint(F.col("content"), F.col("_k") * 2, 2)
    u = F.shiftleft(v.bitwiseAND(0xFF), 8) + F.shiftright(v, 8)
    raw = F.when(u >= 32768, u - 65536).otherwise(u)
    return r.select(*_keep(r), F.lit(1).alias("channel"), "i", raw.cast("int").alias("raw"))


def decode_apnea(files: DataFrame, samples_per_minute: int = APNEA_SAMPLES_PER_MINUTE) -> DataFrame:
    """8-byte records; byte 1 equal to 0x20 means ``A`` (apnea), else ``N``.

    Row ``n`` -> ``(n, n * 6000, hh = n div 60, mm = n % 60, code)`` and the
    text line ``%04d, %07d, %02d:%02d, %s``.
    """
    r = _records(files, 8).withColumn("record_id", F.col("source_id"))
    return apnea_rows(r, _uint(F.col("content"), F.col("_k") * 8 + F.lit(1), 1), samples_per_minute)


def apnea_rows(records: DataFrame, mark, samples_per_minute: int = APNEA_SAMPLES_PER_MINUTE) -> DataFrame:
    """Minutes, codes and text lines of apnea records ``(record_id, i)`` with the mark byte's value."""
    code = F.when(mark == APNEA_MARK, F.lit("A")).otherwise(F.lit("N"))
    out = records.select("record_id", F.col("i").alias("n"),
                   (F.col("i") * F.lit(samples_per_minute)).alias("sample"),
                   F.floor(F.col("i") / 60).cast("int").alias("hh"), (F.col("i") % 60).cast("int").alias("mm"),
                   code.alias("code"))
    return out.withColumn("line", F.format_string(APNEA_LINE_FORMAT, "n", "sample", "hh", "mm", "code"))


def pack_records(records: DataFrame, hex_col: str, block: int = 4096) -> DataFrame:
    """``(source_id, i, <hex record>)`` -> ``(path, source_id, i0, content)``:
    blocks of ``block`` consecutive records (bounded groups), for data Spark
    derives from tables."""
    g = (records.withColumn("_b", F.floor(F.col("i") / F.lit(block)).cast("bigint"))
         .groupBy("source_id", "_b")
         .agg(F.array_sort(F.collect_list(F.struct("i", F.col(hex_col).alias("r")))).alias("_rs"),
              F.min("i").alias("i0")))
    return g.select(
        F.concat(F.lit("mem:/"), F.col("source_id").cast("string"), F.lit("/"), F.col("_b").cast("string"),
                 F.lit(".dat")).alias("path"),
        "source_id", "i0", F.unhex(F.array_join(F.transform("_rs", lambda z: z["r"]), "")).alias("content"))


def pack_212(samples: DataFrame, block: int = 4096) -> DataFrame:
    """Inverse of S3: ``(source_id, i, s1, s2)`` -> 3-byte records in blocks."""
    rec = F.concat(
        F.lpad(F.hex(F.col("s1").bitwiseAND(0xFF)), 2, "0"),
        F.lpad(F.hex(F.shiftleft(F.shiftright(F.col("s2"), 8), 4) + F.shiftright(F.col("s1"), 8)), 2, "0"),
        F.lpad(F.hex(F.col("s2").bitwiseAND(0xFF)), 2, "0"))
    return pack_records(samples.withColumn("_hex", rec), "_hex", block)
