"""Every stage of the corpus pipeline on odd input, and the whole of it on a small table."""

import os

import pytest

import corpus_pipeline as c
from shapecode.llm import common

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score double, key string, filled int"
GOOD = "The people of the town went to the market to see what the others had brought from the fields and the hills around it. "
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, GOOD * 3), (4, GOOD * 3), (5, GOOD * 3), (None, GOOD + "write to jo@web.de"), (6, "mail jo@web.de or +49 30 1234567. " + GOOD),
        (7, "word " * 60000), (8, "😀 ünï " * 30), (9, None)]


def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, "k", 1) for i, t in ROWS], SCHEMA)


def ids(df):
    return sorted(str(r.doc_id) for r in df.collect())


@pytest.mark.parametrize("name, stage", c.STAGES)
def test_empty_tables_and_columns(spark, name, stage):
    out = stage(spark, docs(spark).limit(0), SF)
    assert out.collect() == []
    if name != "packing":
        assert stage(spark, docs(spark), SF).columns == docs(spark).columns


def test_stages_on_odd_rows(spark):
    rows = docs(spark)
    assert set(ids(c.keep_good(spark, rows, SF))) <= set(ids(rows))
    single = ids(c.keep_one_of_group(spark, rows, SF))
    assert single == ["1", "2", "3", "4", "6", "7", "8", "9", "None"]
    assert ids(c.drop_contaminated(spark, rows, SF)) == ids(rows)
    hidden = {str(r.doc_id): r for r in c.redact_personal_data(spark, rows, SF).collect()}
    assert hidden["1"].text is None and hidden["1"].n_chars is None and hidden["2"].text == ""
    assert hidden["6"].text == "mail <EMAIL> or <PHONE>. " + GOOD and hidden["6"].n_chars == len(hidden["6"].text)
    assert hidden["7"].text == "word " * 60000
    pieces = c.pack_tokens(spark, rows, SF).collect()
    assert sum(r.doc_tokens == 1 for r in pieces) == 3 and sum(r.start == 0 for r in pieces) == len(ROWS)


def test_run_releases_what_its_stages_wrote(spark):
    before = common.made(spark)
    out = c.run(spark, SF)
    rows = out.collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    kept = [p for p in common.made(spark) if p not in before]
    assert len(kept) <= 2 and all(os.path.isdir(p.removeprefix("file:")) for p in kept)      # the last stage's input and the pieces
