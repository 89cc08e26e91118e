"""Exact dedup: tree-merge of sorted digest runs, DataFrame operations only.

Rows are dealt to a power of two of runs.  A run is a sorted list of entries, one a digest: the digest, the
smallest identifier (with the number of its row) and the count of rows.  Runs meet in binomial rounds: in round r
runs whose numbers differ in bit r only, so run i of a round becomes run i // 2 of the next.  The two runs of a
pair exchange ranges of digests: each range of both goes to one task, is sorted there and merged by a sorted
aggregation, which keeps the smallest identifier of equal digests and adds up counts.  As runs get fewer they are cut into more
ranges, so a task's share stays the same from the first round to the last, whose single run is range-sorted over all tasks.
A digest has at most one entry a run, so the copies of one text, be they a third of the table, never meet as
rows.  The last run's verdicts go down again: first to the lowest runs' entries, then to the rows of each run.

Every entry carries two digests: SHA-256 of the normalised text, by which runs
are ordered, and that text's length together with an independent 64-bit hash.
An entry's verification is the smallest and the largest of the latter pairs, looked at in every round;
were the two ever to differ, different texts share a SHA-256 and the merge
raises an error instead of dropping a row.

Defined cases: null text counts as the empty text.  A null identifier counts as
larger than any other.  Rows with equal text and equal (or no) identifier: the first of
them, in order of input splits, is kept, the others go.  An empty table gives an empty result.  Other
columns aren't read and can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import SPACE, drop_staged, stage


def normalised(text: Column) -> Column:
    """Each stretch of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number), id, digest (binary SHA-256), check (hash and length in bytes) of every row."""
    norm = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select("row", "id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.struct(F.xxhash64("norm").alias("hash"), F.octet_length("norm").alias("size")).alias("check"))


def power_of_two(least: int) -> int:
    return 1 << max(0, least - 1).bit_length()


def merge_round(entries: DataFrame, run: Column, ranges: int) -> DataFrame:
    """Runs that get the same number are merged, range of digests by range, each in one task."""
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    met = entries.withColumn("run", run).withColumn("range", F.shiftright(lead * F.lit(ranges), 32))
    met = met.repartition("run", "range").sortWithinPartitions("run", "range", "digest")
    merged = met.groupBy("run", "range", "digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    clash = F.raise_error(F.lit("different texts have the same SHA-256")).cast("long")
    return merged.withColumn("n", F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(clash)).drop("range")


def tree_merge(entries: DataFrame, runs: int, cells: int) -> DataFrame:
    """The last run, merged from the lowest ``runs`` in binomial rounds; a round has ``cells`` ranges in all."""
    while runs > 1:
        runs //= 2
        entries = merge_round(entries, F.shiftright("run", 1), max(1, cells // runs))
    return entries


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_runs: int = 64, rows_a_run: int = 1 << 20, rows_a_cell: int = 1 << 16) -> DataFrame:
    """One row a row of docs: id, keep_id, group_size, kept, text_sha256 (hex)."""
    rows = stage(digest_rows(docs, id_col, text_col), "digests")
    n = rows.count()
    runs = power_of_two(max(least_runs, -(-n // rows_a_run)))
    cells = power_of_two(max(runs, -(-n // rows_a_cell)))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    entries = rows.select("run", "digest", first.alias("first"), F.lit(1).cast("long").alias("n"), F.col("check").alias("low"), F.col("check").alias("high"))
    # The lowest runs: copies within a run are counted before they are sent.
    local = entries.groupBy("run", "digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    lowest = stage(merge_round(local, F.col("run"), cells // runs), "runs")
    last = stage(tree_merge(lowest, runs, cells).select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("n").alias("group_size")), "merged")
    verdicts = stage(lowest.select("run", "digest").join(last, "digest"), "verdicts")
    drop_staged(lowest)
    drop_staged(last)
    return rows.select("run", "digest", "row", "id").join(verdicts, ["run", "digest"]).select(
        "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup() keeps.

    Rows are looked up by (identifier, digest), so texts are shuffled once.  Rows that share both with another
    row, if there are any, are taken apart by an aggregation that keeps one of each.
    """
    found = stage(exact_dedup(docs, id_col, text_col, **options).select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept", F.col("id").eqNullSafe(F.col("keep_id")).alias("same")), "found")
    again = found.filter("same and not kept").select("__id", "__sha").distinct()
    once = found.filter("kept").select("__id", "__sha")
    marked = docs.withColumns({"__key": F.sha2(normalised(F.col(text_col)), 256), "__of": F.col(id_col).cast("long")})
    of = lambda side: F.col("__of").eqNullSafe(side["__id"]) & (F.col("__key") == side["__sha"])
    if again.isEmpty():
        return marked.join(once, of(once), "left_semi").select(*docs.columns)
    again = stage(again, "again")
    alone = once.join(again, once["__id"].eqNullSafe(again["__id"]) & (once["__sha"] == again["__sha"]), "left_anti")
    several = marked.join(again, of(again), "left_semi").groupBy("__of", "__key").agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return marked.join(alone, of(alone), "left_semi").select(*docs.columns).unionAll(several.select("__row.*"))
