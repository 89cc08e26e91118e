"""Mixing sources to target weights: systematic sampling, DataFrame operations only.

Targets: the mix is to have ``share`` of all words.  Sources get it by weight; a
target stops at ``most`` times its source's size and the excess is shared anew by
weight among the others until none is above.  That fill has a closed form: with
sources in order of size / weight, those up to some place stop at their limit and
the rest get a common rate per weight.

Sampling: within a source every document expects target / size copies.  The prefix
sum of these expected copies, plus one random offset a source, crosses integers;
a document is emitted once for each integer that its own stretch crosses.  As a
stretch is ``most`` long at most and starts anywhere, at most ceil(most)
boundaries lie in it.  Documents stand in order of size class (three leading bits of
the size), then salt, so each class is sampled evenly and the words that are taken
stay near the target.  All documents of a source expect the same, so the prefix
sum is rank times rate, and ranks come from salted cells: no task sorts a
source.  Offsets are a hash of the source and the seed: reruns agree.

Defined cases: null text has size 0.  A null source is a source of its own, last
in order.  Documents of size 0 take their turn and add nothing.  Without words
all targets are 0 and nothing is taken.  Rows with equal identifier are
documents of their own.  Identifiers may be of any type; those that aren't numbers are dealt by their text as all others are.  An empty table gives an empty mix.  Other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import numbered, salt_count, salted_rank, stage, word_count


def hashed_salt(id_: Column, salts: int) -> Column:
    """A salt from a hash of the identifier's text, that any engine can make: multiples of some number, and texts, spread as well as other identifiers."""
    mark = F.md5(F.coalesce(id_.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(mark, 1, 8), 16, 10).cast("long"), F.lit(salts)).cast("int")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> source, source_size, target, offset place.  One row a source; their number, not the rows, is what meets here."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_fill = everything.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    filled = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rate", (F.col("budget") - F.col("stopped")) / F.col("open"))
    )
    # The first source in this order that the rate doesn't fill sets the rate of all after it.
    rate = F.min(F.when(F.col("rate") * F.col("weight") < F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("rate")))).over(everything)
    target = F.least(F.col("limit"), F.coalesce(rate["rate"] * F.col("weight"), F.col("limit")))
    return filled.select("source", "source_size", target.alias("target"))


def mix_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, copies, taken."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = stage(sized, "sizes")
    salts = salt_count(sized.count())
    # Size class: 8 classes to a doubling, from the leading four bits.
    power = F.length(F.bin(F.greatest(F.col("size"), F.lit(1)))) - 1
    level = F.when(F.col("size") == 0, F.lit(-1)).otherwise(power * 8 + F.floor(F.col("size") * 8 / F.pow(F.lit(2.0), power)) - 8).cast("int")
    cells = sized.withColumns({"level": level, "salt": hashed_salt(F.col("id"), salts)})
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target")
    attach = lambda starts: starts.join(targets, starts["__c0"].eqNullSafe(targets["__source"])).drop("__source")
    ranked = salted_rank(cells, ["source"], ["level"], "salt", ["size", "id"], "place", attach)
    mark = F.md5(F.concat(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), F.lit(f":{seed}")))
    offset = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = ranked.withColumns({"rate": rate, "offset": offset})
    ended, began = (F.floor((F.col("place") + k) * F.col("rate") + F.col("offset")) for k in (1, 0))
    copies = F.least(ended - began, F.lit(int(most))).cast("long")
    return both.withColumn("copies", copies).select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is emitted.  Rows are told apart by numbers of their own, so identifiers may repeat or lack."""
    rows = numbered(docs, "mixed")
    copies = mix_copies(rows, "__row", **options).select(F.col("id").alias("__id"), F.col("copies").alias("__copies")).filter("__copies > 0")
    both = rows.join(copies, F.col("__row") == F.col("__id"))
    return both.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
