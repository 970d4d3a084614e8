"""The detector as one DataFrame function, shared by batch and stream.

frame events (``value`` JSON) -> decode + scale + patient id (S2, P1, P2)
-> length check (P16) -> left join with the packed dictionaries (J2)
-> encode, reconstruct, residual, score (J3, W7-W9, A5).  The coder is the
vectorised block coder by default (frames of a batch grouped per source in
blocks, one dictionary copy per block) or the SQL coder (``method="sql"``).

Rows that cannot be scored are kept with a ``status``
(``malformed | bad_source | bad_length | bad_sample | no_model``) and go to a quarantine
instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.config import ANOMALY_THRESHOLD, STREAM_WINDOWS, SIGNAL_WINDOW
from shapecode.operators import coding
from shapecode.operators import vectorized as V
from shapecode.sinks.writers import date_path
from shapecode.sources.events import decode_frame_events


def detect(events: DataFrame, packed_books: DataFrame, w: int = SIGNAL_WINDOW, n: int = STREAM_WINDOWS,
           mode: str = "centered", method: str = "vectorized") -> DataFrame:
    """Score frame events.  ``packed_books(source_id STRING, book)`` keyed by patient id.

    A frame holds any whole number of windows (``n`` is only what the batch
    forms cut); other lengths are ``bad_length``.

    Output columns: ``srcId, srcTs, frameRef, patient_id, frame_ref, event_time,
    frame, src, coded, loss, score, codes, status``.
    """
    dec = decode_frame_events(events)
    bad_value = F.exists("frame", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    dec = dec.withColumn("status", F.when((F.col("status") == "ok") & ((F.size("frame") < F.lit(w)) | (F.size("frame") % F.lit(w) != 0)),
                                          F.lit("bad_length"))
                         .when((F.col("status") == "ok") & bad_value, F.lit("bad_sample"))
                         .otherwise(F.col("status")))
    meta = ["srcId", "srcTs", "frameRef", "patient_id", "event_time"]
    cols = ["srcId", "srcTs", "frameRef", "patient_id", "frame_ref", "event_time", "frame",
            "src", "coded", "loss", "score", "codes", "status"]
    if method == "vectorized":      # unusable rows pass through, so a micro-batch is parsed once
        rows = dec.withColumn("source_id", F.col("patient_id")).select("source_id", "frame_ref", "frame", "status", *meta)
        scored = V.encode_frame_rows(rows, packed_books, w, mode, meta_cols=meta)
        return scored.withColumn("codes", F.when(F.col("best").isNotNull(), coding.codes_string())).select(*cols)
    good = dec.where(F.col("status") == "ok").withColumn("source_id", F.col("patient_id"))
    bad = dec.where(F.col("status") != "ok")
    scored = coding.score_frames(good, packed_books, w, None, mode).withColumn("codes", coding.codes_string())
    empty = {"src": "array<double>", "coded": "array<double>", "loss": "array<double>",
             "score": "double", "codes": "string"}
    bad = bad.select(*[F.lit(None).cast(empty[c]).alias(c) if c in empty else F.col(c) for c in cols])
    return scored.select(*cols).unionByName(bad)


def anomalies(scored: DataFrame, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """P3 online rule: strictly above the threshold."""
    return scored.where((F.col("status") == "ok") & (F.col("score") > F.lit(threshold)))


def with_time_path(scored: DataFrame) -> DataFrame:
    """Archive path of every frame, from its own event time: a replay gives the same path."""
    return scored.withColumn("time_path", date_path(F.col("event_time")))
