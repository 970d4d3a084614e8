"""Frame events on the wire.

A frame event is a JSON object ``{"srcTs", "srcId", "frameRef", "data",
"scale"}``.  Decoding fills the reference's defaults for missing fields
(``""``, ``0.0``, ``0.0``, ``[]``), ignores the producer's ``scale`` and
marks malformed text and unusable source ids with a ``status`` instead of
failing the task; callers route those rows to a quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapecode.config import SCALE

FRAME_EVENT_SCHEMA = "srcTs DOUBLE, srcId STRING, frameRef DOUBLE, data ARRAY<DOUBLE>, scale DOUBLE, _corrupt STRING"


def frame_events(frames: DataFrame, src_prefix: str = "inj./data/", src_suffix: str = ".dat",
                 ts_col: str = "src_ts", data_col: str = "frame", scale: float = SCALE) -> DataFrame:
    """K9: frames -> ``value`` JSON strings (one event per frame)."""
    src_id = F.concat(F.lit(src_prefix), F.col("source_id").cast("string"), F.lit(src_suffix))
    rec = F.struct(F.col(ts_col).cast("double").alias("srcTs"), src_id.alias("srcId"),
                   F.col("frame_ref").cast("double").alias("frameRef"), F.col(data_col).alias("data"),
                   F.lit(float(scale)).alias("scale"))
    return frames.select(F.to_json(rec).alias("value"))


def patient_id(src_id: Column) -> Column:
    """Third ``/`` part of the source id, up to the first ``.``."""
    return F.split_part(F.split_part(src_id, F.lit("/"), F.lit(3)), F.lit("."), F.lit(1))


def decode_frame_events(df: DataFrame, value_col: str = "value", scale: float = SCALE) -> DataFrame:
    """S2 + P1 + P2: ``value`` JSON -> typed, scaled frame rows.

    Output: ``srcId, srcTs, frameRef, patient_id, frame_ref, raw, frame,
    event_time, status`` with status ``ok | malformed | bad_source``.
    """
    p = F.from_json(F.col(value_col), FRAME_EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = df.select("*", p.alias("_e"))
    raw = F.coalesce(F.col("_e.data"), F.array().cast("array<double>"))
    src = F.coalesce(F.col("_e.srcId"), F.lit(""))
    pid = patient_id(src)
    status = (F.when(F.col("_e").isNull() | F.col("_e._corrupt").isNotNull(), F.lit("malformed"))
              .when(pid == F.lit(""), F.lit("bad_source")).otherwise(F.lit("ok")))
    ts = F.coalesce(F.col("_e.srcTs"), F.lit(0.0))
    return d.select(
        src.alias("srcId"), ts.alias("srcTs"),
        F.coalesce(F.col("_e.frameRef"), F.lit(0.0)).alias("frameRef"),
        pid.alias("patient_id"),
        F.coalesce(F.col("_e.frameRef"), F.lit(0.0)).cast("bigint").alias("frame_ref"),
        raw.alias("raw"),
        F.transform(raw, lambda x: x * F.lit(float(scale))).alias("frame"),
        F.timestamp_seconds(ts).alias("event_time"),
        status.alias("status"))
