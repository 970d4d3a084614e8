"""Driver tables as signals (long sample form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecode.config import SignalSpec
from shapecode.operators.indexing import index_within

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def signal_samples(spark: SparkSession, sf_dir: str, spec: SignalSpec,
                   index_method: str = "range", extra: dict[str, str] | None = None) -> DataFrame:
    """``samples(source_id, i, raw, value)``; ``value = raw * scale``.

    Only the source, value and order columns are read (column pruning reaches
    the Parquet scan); rows with a null source or sample are not samples.
    ``extra`` maps output names to SQL expressions over the table row that
    are carried along (e.g. annotation codes).  A signal that is indexed
    already with these columns and others is read, not indexed again.
    """
    extra = extra or {}
    t = read_table(spark, sf_dir, spec.table)
    base = (
        t.select(F.col(spec.source_col).cast("bigint").alias("source_id"),
                 F.col(spec.value_col).cast("double").alias("raw"),
                 *spec.order_cols, *[F.expr(e).alias(k) for k, e in extra.items()])
        .where(F.col("source_id").isNotNull() & F.col("raw").isNotNull())
    )
    key = (spark.sparkContext.applicationId, spec, index_method, tuple(sorted(t.inputFiles())), tuple(sorted(extra.items())))
    names = ["source_id", "i", "raw", "value", *extra.keys()]
    wider = next((d for k, d in _INDEXED.items() if k[:-1] == key[:-1] and set(key[-1]) < set(k[-1])), None)
    if key not in _INDEXED and wider is not None:
        return wider.select(*names)
    if key not in _INDEXED:
        idx = index_within(base, "source_id", spec.order_cols, method=index_method, keep_order=False)
        _INDEXED[key] = idx.select("source_id", "i", "raw",
                                   (F.col("raw") * F.lit(float(spec.scale))).alias("value"), *extra.keys())
    return _INDEXED[key]


# Indexed signals of the running applications: a signal is range-partitioned, sorted and written to the checkpoint
# folder once, and every query over it reads that table.  ``forget_signals`` lets the cleaner delete them.
_INDEXED: dict[tuple, DataFrame] = {}


def forget_signals() -> None:
    _INDEXED.clear()


# Annotation codes derived from each signal's table
# (``N`` is normal; the first letter of any other kind marks an abnormal beat).
ANNOTATION_CODES = {
    "events": "CASE WHEN event_type IN ('click', 'view') THEN 'N' ELSE upper(substr(event_type, 1, 1)) END",
    "lineitem": "l_returnflag",
}


def signal_annotations(spark: SparkSession, sf_dir: str, spec: SignalSpec) -> DataFrame:
    """``annotations(record_id, line_no, sample, code)`` aligned with the samples."""
    s = signal_samples(spark, sf_dir, spec, extra={"code": ANNOTATION_CODES[spec.name]})
    return s.select(F.col("source_id").alias("record_id"), F.col("i").alias("line_no"),
                    F.col("i").alias("sample"), "code").where(F.col("code").isNotNull())


def warehouse_table(spark: SparkSession, table_id: str, default_project: str | None = None,
                    fmt: str | None = None, path: str | None = None) -> DataFrame:
    """Read a warehouse table by id.

    ``project:dataset.table`` is fully qualified; ``:dataset.table`` is
    relative to ``default_project`` (the prefix is added).  The project names
    a Spark catalog (``project.dataset.table``); without one the session's
    current catalog is used.  With ``fmt`` and ``path`` the table is read
    from storage instead.
    """
    if fmt and path:
        return spark.read.format(fmt).load(path)
    return spark.table(table_name(table_id, default_project))


def table_name(table_id: str, default_project: str | None = None) -> str:
    """``project:dataset.table`` or ``:dataset.table`` as a name Spark resolves."""
    project, sep, name = table_id.rpartition(":")
    project = project or default_project
    return f"{project}.{name if sep else table_id}" if project else (name if sep else table_id)


def embedding_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``embeddings`` as ready-made windows: ``train(source_id = label, j, vec_id, feat)``
    on the training grid, with ``j`` the vector's rank by ``vec_id`` inside its label (skew-safe
    index), and the per-label budget ``(source_id, tr = n, k = int(0.1 n))``."""
    from shapecode.config import DICT_FRACTION
    from shapecode.operators.kmeans import on_grid
    e = (read_table(spark, sf_dir, "embeddings")
         .where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
         .select(F.col("label").cast("bigint").alias("source_id"), "vec_id",
                 F.expr(on_grid("CAST(embedding AS array<double>)")).alias("feat")))
    train = index_within(e, "source_id", ["vec_id"], out="j")
    budget = train.groupBy("source_id").agg(F.count(F.lit(1)).alias("tr")).withColumn(
        "k", F.floor(F.lit(DICT_FRACTION) * F.col("tr")).cast("bigint"))
    return train, budget
