"""The evaluation from files on its own rows: results, files, scans."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from shapecode.plans import file_queries as FQ
from shapecode.plans import queries as P
from shapecode.sources import tables as TB
from shapecode.sources import text as TXT
from tests.test_scale import data_files
from tools.compare_oracle import rows_of

SOURCES = 40


@pytest.fixture(scope="module")
def signals(tmp_path_factory):
    """40 recordings of 400 to 790 samples; a quarter of the frames holds a code other than N, and their samples jump more."""
    d = str(tmp_path_factory.mktemp("sf"))
    duckdb.sql(f"""COPY (SELECT s AS l_suppkey, CAST(s * 1000 + i AS BIGINT) AS l_orderkey, CAST(1 AS INTEGER) AS l_linenumber, CAST(i % 13 AS BIGINT) AS l_partkey,
        CAST(20 + (i * i + 3 * s) % 17 + CASE WHEN (i // 100 + s) % 4 = 0 THEN (i * 7) % 23 ELSE 0 END AS DOUBLE) AS l_quantity,
        CASE WHEN (i // 100 + s) % 4 = 0 AND i % 100 IN (7, 50) THEN 'AR'[1 + i % 2] ELSE 'N' END AS l_returnflag,
        TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS l_shipdate
        FROM range({SOURCES}) a(s), range(790) b(i) WHERE i < 400 + 10 * s) TO '{d}/lineitem.parquet' (FORMAT parquet)""")
    return d


def expected(name, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    res = c.sql(E.oracle_sql()[name])
    return rows_of(res.columns, res.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_parsed_once_and_hold_many_records(spark, signals, monkeypatch, tmpdir_path):
    monkeypatch.setattr(FQ, "scratch_dir", lambda _spark, name: f"{tmpdir_path}/{name}")
    df = FQ.archive_test_error(spark, signals)
    # the split's counting passes, the sweep and the report read the joined rows, not the files again
    assert "FileScan" not in plan_of(df)
    rows = df.collect()
    assert rows_of(df.columns, map(tuple, rows)) == expected("archive_test_error", signals)
    assert rows[0].pos > 0 and rows[0].neg > 0 and rows[0].t > 0
    files = data_files(f"{tmpdir_path}/labels")
    assert 0 < len(files) < SOURCES
    lines = [x.split(",") for f in files for x in open(f).read().splitlines()]
    labels = sorted((r.record_id, r.frame_ref, r.label) for r in P.labels_of(spark, signals).collect())
    assert sorted((int(r), int(f), x) for r, f, x in lines) == labels
    back = TXT.read_labels(spark, f"{tmpdir_path}/labels", with_record=True)
    assert sorted((r.record_id, r.frame_ref, r.label) for r in back.collect()) == labels


def test_archive_heads_end_where_the_lists_begin(spark):
    lines = spark.createDataFrame([("(a,0.5,12.0,0.25,p),;1.0;2.0,3.0;4.0;)",), ("(b,0.5,7.0,x,q)",), ("c,1.0,3.0,0.5,r,;5.0",), ("(d,1.0,3.0,0.5,s,;1.0;2.0;3.0)",)], "value string")
    got = [(r.srcId, r.frame_ref, r.max_err, r.path, r.src, r.coded, r.loss) for r in TXT.parse_archive(lines).collect()]
    assert got == [("a", 12, 0.25, "p)", [1.0], [2.0, 3.0], [4.0]), ("b", 7, None, "q", [], [], []),
                   ("c", 3, 0.5, "r", [5.0], [], []), ("d", 3, 0.5, "s", [1.0], [2.0], [3.0])]


def test_heads_are_read_without_a_search_through_the_lists(spark):
    plan = plan_of(TXT.parse_archive(spark.createDataFrame([("(a,0.5,12.0,0.25,p,;1.0;2.0;3.0;)",)], "value string")).select("srcId", "max_err"))
    assert "regexp_replace(value" not in plan and "split_part(" not in plan


def test_bucketed_evaluation(spark, signals):
    frames, labels = FQ.bucketed_archive(spark, signals)
    for t in (frames, labels):
        assert len(t.inputFiles()) <= FQ.BUCKETS
    df = FQ.archive_test_error_bucketed(spark, signals)
    assert "FileScan" not in plan_of(df)
    assert rows_of(df.columns, map(tuple, df.collect())) == expected("archive_test_error_bucketed", signals)


def test_a_signal_is_indexed_once_for_all_its_columns(spark, signals):
    TB.forget_signals()
    wide = TB.signal_samples(spark, signals, FQ.LI, extra={"code": TB.ANNOTATION_CODES["lineitem"]})
    plain = TB.signal_samples(spark, signals, FQ.LI)
    scan = lambda df: [x.strip() for x in plan_of(df).splitlines() if "ExistingRDD" in x and "_mid" in x]
    assert {x.partition("Scan")[2] for x in scan(plain)} and all("code" in x for x in scan(plain))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, wide.drop("code").collect()))
    assert plain.columns == ["source_id", "i", "raw", "value"]


def test_samples_are_counted_once_for_training(spark, signals):
    from shapecode.operators import kmeans as KM
    samples = TB.signal_samples(spark, signals, FQ.LI)
    train, budget = KM.training_set(samples, FQ.LI.w, FQ.LI.step)
    assert "Join" not in plan_of(budget) and "Aggregate" not in plan_of(budget)
    sizes = {r.source_id: (r.n_samples, r.tr) for r in budget.collect()}
    assert sizes == {s: (min(790, 400 + 10 * s), min(790, 400 + 10 * s) // FQ.LI.step // 5) for s in range(SOURCES)}
    assert {r.source_id: r["count"] for r in train.groupBy("source_id").count().collect()} == {s: tr for s, (_, tr) in sizes.items()}
