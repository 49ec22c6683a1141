"""A corpus pipeline of the training-data operators: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import decontaminate, importance, jaccard_join, pieces, toxicity
from rollbook.llm.base import materialise, table, unpacked


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(docs, model).where("predicted = 0"), docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of an importance sample as large as the share that passes for quality."""
    labels = table(spark, sf_dir, "labels")
    ratios = importance.fit(docs, labels)
    weighed = importance.weighed_table(docs, ratios)
    edge = importance.kth_largest(weighed, importance.sample_size(weighed, labels))
    # The key depends on the row alone, so that scoring again spares a shuffle of the texts.
    again = importance.weigh(docs, ratios)
    return unpacked(again if edge is None else again.where(F.col("key") >= edge), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    found = materialise(found.select(F.col("doc_id").alias("leaky_id")).distinct(), "leaky")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaky_id"]), "left_anti")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their SentencePiece pieces (``ids``, ``n_tokens``); a column of the
    documents that has one of these names is called ``given_`` and its name, as often as needed."""
    rows = pieces.encode(docs)
    names: list[str] = []
    for c in docs.columns:
        name = c
        while name in ("ids", "n_tokens") or (name != c and name in docs.columns):
            name = f"given_{name}"
        names.append(name)
    return rows.select(*[F.col(f"row.`{c}`").alias(name) for c, name in zip(docs.columns, names)], "ids", "n_tokens")


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near copies", drop_near_copies),
          ("decontamination", drop_leaks), ("pieces", to_pieces)]

#: The models of the stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
