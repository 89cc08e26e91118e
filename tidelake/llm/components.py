"""Connected components of a table of links, in rounds of star contraction.

Each round lets every node tell its larger neighbours, then its smaller ones, of the
smallest node it knows (large-star and small-star).  What is left are stars around
each component's smallest node.

The links of a node, be they a third of all, never meet in one task: they are dealt to
cells (node, salt).  A cell's minimum is a partial aggregate, the node's is that of its
cells, and it goes back to the cells, which tell their own links.

Defined cases: links of a node with itself say nothing; repeated links and both directions count once;
an empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import drop_staged, salt_count, stage


def _star(links: DataFrame, larger: bool, salts: int) -> DataFrame:
    """One contraction: links (u, v), u > v."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
    both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    cells = both.groupBy("u", "salt").agg(F.min("v").alias("low"))
    low = cells.groupBy("u").agg(F.min("low").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("low"))
    known = cells.select("u", "salt").join(low, F.col("u") == low["node"]).select("u", "salt", "low")
    told = both.join(known, ["u", "salt"])
    if larger:
        new = told.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        new = told.select(F.col("v").alias("u"), F.col("low").alias("v")).unionAll(low.select(F.col("node").alias("u"), F.col("low").alias("v")))
    return new.filter(F.col("u") > F.col("v")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) of every node in links (u, v)."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    links = stage(links, "links")
    mark = _mark(links)
    salts = salt_count(mark[0], 32, 1 << 16)
    while mark[0]:
        new = stage(_star(_star(links, True, salts), False, salts), "links")
        drop_staged(links)
        links, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
