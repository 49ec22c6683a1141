"""Acceptance of a batch in order, when rows claim several unique values.

Row by row, a row is stored if no value that it claims is held by a row stored before; a
row that is refused holds nothing.  As sets: in each round, open rows that come first for all
the values they claim are accepted, and open rows that claim one of these values are refused.
The first open row is always accepted, and the rounds are as many as the longest chain in
which a row is open only because of the one before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.plans.dims import by_key, cut_lineage

VALUE = ["key", "holder"]


def accept_in_order(claims: DataFrame) -> DataFrame:
    """(key, holder, winner) for every claimed value that an accepted row holds; ``winner`` is its rank.

    claims: ``row`` (an id), ``rank`` (a total order, the same for all claims of a row), ``key``
    (the number of a unique key) and ``holder`` (its value, or anything that stands for it).
    Each round reduces the values to one row each before it joins them, so a value that many
    rows claim costs no more than others, and is written to the shared folder.  Only counts come
    to the driver.
    """
    open_, held = claims, []
    while open_.count():
        first = open_.groupBy(*VALUE).agg(F.min("rank").alias("first"))
        winners = (open_.join(by_key(first), VALUE).groupBy("row").agg(F.bool_and(F.col("rank") == F.col("first")).alias("wins")).where("wins").select("row"))
        won = cut_lineage(open_.join(by_key(winners), "row").select(*VALUE, F.col("rank").alias("winner")))
        held.append(won)
        settled = open_.join(by_key(won), VALUE, "left_semi").select("row").distinct()
        open_ = cut_lineage(open_.join(by_key(settled), "row", "left_anti"))
    return reduce(DataFrame.unionByName, held) if held else claims.select(*VALUE, F.col("rank").alias("winner"))


def beaten(claims: DataFrame) -> DataFrame:
    """(row, keys): the numbers of the keys of which an accepted row of less rank holds the row's value.

    claims as above and ``eligible``: whether the row may be accepted at all; rows that may not hold nothing.
    """
    claims = cut_lineage(claims)
    held = accept_in_order(claims.where("eligible").drop("eligible"))
    return claims.join(by_key(held), VALUE).where("winner < rank").groupBy("row").agg(F.collect_set("key").alias("keys"))
