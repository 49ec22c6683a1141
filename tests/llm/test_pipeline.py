"""Each stage against a brute-force version on its own input, and run() against the stages in turn."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as p
from pyspark.sql import functions as F
from rollbook.llm import importance, toxicity
from rollbook.llm.base import materialise
from test_decontaminate import brute as leaks_by_hand
from test_jaccard import brute as groups_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """The input and output of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in p.STAGES:
        after = materialise(stage(spark, docs, SF), "stage")
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_and_order_of_stages(staged):
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near copies", "decontamination", "pieces"]
    for name, (before, after) in staged.items():
        assert after.columns[:len(before.columns)] == before.columns and (name == "pieces") == (len(after.columns) > len(before.columns))
        assert set(map(tuple, after.select(before.columns).collect())) <= set(map(tuple, before.collect())), name


def test_toxic_and_poor_documents_go(spark, staged):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = staged["toxicity"]
    scored = toxicity.score(before, toxicity.fit(before, labels)).where("predicted = 0").select("row.doc_id")
    assert ids(after) == ids(scored)
    before, after = staged["quality"]
    assert ids(after) == ids(importance.resample(before, labels).where("selected"))
    poor = labels.where("quality = 0").select("doc_id")
    assert after.join(poor, "doc_id").count() < before.join(poor, "doc_id").count()


def test_one_document_of_each_group_stays(staged):
    before, after = staged["near copies"]
    assert ids(after) == sorted({c for _, _, c in groups_by_hand(rows(before), 5, 80)})


def test_leaky_documents_go(spark, staged):
    before, after = staged["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {d for d, *_ in leaks_by_hand(rows(before), items)}
    assert ids(after) == sorted(d for d, _ in rows(before) if d not in leaky)


def test_every_document_is_encoded(staged):
    before, after = staged["pieces"]
    assert ids(after) == ids(before) and after.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_run_is_the_stages_in_turn(spark, staged):
    got = p.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, staged["pieces"][1].collect()))
    assert p.ORACLE_SQL is None


def test_odd_rows_pass_every_stage(spark, tmp_path):
    from odd import ODD
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, row string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        after = table
        for _, stage in p.STAGES:
            after = materialise(stage(spark, after, str(tmp_path)), "odd")
        # Nothing is toxic, poor or leaky here; only the repeated rows and equal texts leave.
        assert after.count() == (len({t for _, t in ODD if (t or "").split()}) + 3 if table is docs else 0)


def test_columns_named_like_the_last_stage_are_renamed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", "x", 2, "y")], "doc_id long, text string, ids string, n_tokens int, given_ids string")
    after = materialise(p.to_pieces(spark, docs, str(tmp_path)), "odd")
    assert after.columns == ["doc_id", "text", "given_given_ids", "given_n_tokens", "given_ids", "ids", "n_tokens"]
    row = after.first()
    assert (row.given_given_ids, row.given_n_tokens, row.given_ids, row.n_tokens) == ("x", 2, "y", len(row.ids))
