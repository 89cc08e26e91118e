"""Joins beyond the built-in ones: lookups, comparisons, shifted, token, best-match and as-of joins.

All are compositions of equi-joins, aggregates and windows, so that adaptive execution picks the
physical join, splits skewed keys and broadcasts what turns out to be small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.operators.ranks import attach
from tidelake.sources.staging import staged


def lookup(left: DataFrame, right: DataFrame, on: list[str], value: str, default: object) -> DataFrame:
    """Left join that brings one column; keys without a match get the default."""
    return left.join(right.select(*on, value), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def lookup_as(left: DataFrame, right: DataFrame, left_on: str, right_on: str, value: str, name: str) -> DataFrame:
    """Attaches one column over keys with different names."""
    side = right.select(F.col(right_on).alias("__key"), F.col(value).alias(name))
    return left.join(side, left[left_on] == side["__key"], "left").drop("__key")


def normalised_join(left: DataFrame, right: DataFrame, left_on: Column, right_on: Column) -> DataFrame:
    """Inner join on lower-cased keys without outer blanks."""
    a, b = left.withColumn("__k", F.lower(F.trim(left_on))), right.withColumn("__k", F.lower(F.trim(right_on)))
    return a.join(b, "__k").drop("__k")


def compare_outer(left: DataFrame, right: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Full outer join with _merge (both, left_only, right_only) and the values suffixed _x and _y."""
    a = left.select(*on, F.lit(True).alias("__l"), *[F.col(v).alias(f"{v}_x") for v in values])
    b = right.select(*on, F.lit(True).alias("__r"), *[F.col(v).alias(f"{v}_y") for v in values])
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, on, "full_outer").withColumn("_merge", side).drop("__l", "__r")


def mismatches(left: DataFrame, right: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ, nulls and NaN being equal to themselves."""
    both = compare_outer(left, right, on, values)
    same = lambda v: F.nanvl(F.col(f"{v}_x").cast("double"), F.lit(None)).eqNullSafe(F.nanvl(F.col(f"{v}_y").cast("double"), F.lit(None)))
    return both.filter(~reduce(lambda p, q: p & q, [same(v) for v in values]) | (F.col("_merge") != "both"))


def outer_coalesce(first: DataFrame, second: DataFrame, on: list[str], value: str) -> DataFrame:
    """Both sources' keys; the first source's value wins where it has one."""
    a, b = first.select(*on, F.col(value).alias("__a")), second.select(*on, F.col(value).alias("__b"))
    return a.join(b, on, "full_outer").select(*on, F.coalesce("__a", "__b").alias(value))


def shifted(df: DataFrame, keys: list[str], at: str, value: str, by: int, name: str) -> DataFrame:
    """value of the row of the same keys at ``at - by``; null where there is none.  An equi-join on the shifted place."""
    side = df.select(*keys, (F.col(at) + by).alias(at), F.col(value).alias(name))
    return df.join(side, [*keys, at], "left")


def multi_lookup(df: DataFrame, store: DataFrame, row_key: str, columns: list[str], store_key: str, value: str, prefix: str) -> DataFrame:
    """Looks up several columns of a row in one keyed store with one join: unpivot, join, pivot back."""
    long = df.select(row_key, *columns).unpivot(row_key, columns, "__name", store_key)
    found = long.join(store.select(row_key, store_key, value), [row_key, store_key], "left")
    wide = found.groupBy(row_key).pivot("__name", columns).agg(F.first(value, ignorenulls=True))
    return df.join(wide.select(row_key, *[F.col(c).alias(f"{prefix}{c}") for c in columns]), row_key, "left")


def not_yet_done(tasks: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Resume: tasks whose key the output doesn't hold."""
    return tasks.join(done.select(*on).distinct(), on, "left_anti")


def only_sampled(df: DataFrame, ids: DataFrame, on: str, fold_case: bool = False) -> DataFrame:
    """Rows whose id is in the sample."""
    if not fold_case:
        return df.join(ids.select(on).distinct(), on, "left_semi")
    side = ids.select(F.lower(on).alias("__k")).distinct()
    return df.join(side, F.lower(df[on]) == side["__k"], "left_semi")


def all_tokens_index(docs: DataFrame, doc_id: str, tokens: Column, queries: DataFrame, query_id: str, query_tokens: str, prefix: bool = False) -> DataFrame:
    """Documents that hold every token of a query: an inverted index, joined token by token, counted."""
    index = docs.select(F.col(doc_id), F.explode(F.array_distinct(tokens)).alias("token"))
    asked = queries.select(query_id, F.explode(F.array_distinct(query_tokens)).alias("asked"), F.size(F.array_distinct(query_tokens)).alias("wanted"))
    if prefix:  # an equi-join on the asked length of the token: each length that is asked is one more key of a token
        lengths = asked.select(F.length("asked").alias("__l")).distinct()
        index = index.join(F.broadcast(lengths), F.length("token") >= F.col("__l")).withColumn("__k", F.left("token", F.col("__l")))
        match = (index["__k"] == asked["asked"]) & (index["__l"] == F.length(asked["asked"]))
    else:
        match = index["token"] == asked["asked"]
    hits = index.join(asked, match).groupBy(query_id, doc_id, "wanted").agg(F.countDistinct("asked").alias("held"))
    return hits.filter("held = wanted").select(query_id, doc_id)


def token_match(query: str, candidate: str, least: int = 2) -> Column:
    """Every query token of ``least`` letters or more equals, begins or continues some candidate token."""
    ok = lambda t: F.exists(candidate, lambda x: (x == t) | x.startswith(t) | t.startswith(x))
    return F.forall(F.filter(query, lambda t: F.length(t) >= least), ok)


def blocked_token_join(queries: DataFrame, candidates: DataFrame, query: str, candidate: str, rows_a_chunk: int = 8192, pairs_a_task: int = 50_000_000, rows_a_tile: int = 256, rows_a_piece: int = 32, copies: bool = False) -> DataFrame:
    """The theta join over token_match(), dealt by the first letters of tokens: no pair without a common letter is tried.

    Lists of tokens are tried once however many rows hold them, and numbered.  The rows of a list lie in chunks of about ``rows_a_chunk``, and a pair of chunks whose lists match is the key that they meet by,
    in as many tasks as the pairs of rows ask for: a list that many rows hold is spread over tasks, none of which holds more than a few chunks.  A chunk is shuffled as one array a query's, as arrays
    of about ``rows_a_tile`` rows a candidate's, without tokens, and rows are made where chunks have met: a tile's rows once for each query row, so that what is written of them repeats at short distance.
    Rows that are equal in all columns count once, or as often as they occur (``copies``).
    """
    spark = queries.sparkSession
    first = lambda tokens: F.array_distinct(F.transform(tokens, lambda t: F.substring(t, 1, 1)))
    asked = F.filter(query, lambda t: F.length(t) >= 2)
    chunks, tiles = lambda n: F.ceil(F.col(n) / rows_a_chunk).cast("long"), lambda n: F.ceil(F.col(n) / rows_a_tile).cast("long")

    def listed(df: DataFrame, tokens: str, name: str) -> DataFrame:
        """The lists by number, with their rows."""
        sizes = df.groupBy(tokens).agg(F.count(F.lit(1)).alias(f"{name}n"))
        return staged(sizes.withColumn(name, F.monotonically_increasing_id()), "token-lists")

    def packed(df: DataFrame, lists: DataFrame, tokens: str, name: str, parts: Column) -> DataFrame:
        """A row for each part of a list: the other columns of its rows, in order."""
        others = [c for c in df.columns if c != tokens]
        at = F.pmod(F.xxhash64(F.lit(0), *others), parts).alias(f"{name}t")
        rows = attach(df, lists, [tokens]).select(name, f"{name}n", at, F.struct(F.lit(0).alias("__x") if not others else others[0], *others[1:]).alias("__row"))
        collected = F.collect_list("__row") if copies else F.collect_set("__row")
        return rows.groupBy(name, f"{name}n", f"{name}t").agg(F.sort_array(collected).alias(f"{name}s"))

    ql, cl = listed(queries, query, "__q"), listed(candidates, candidate, "__c")
    a = ql.withColumn("__b", F.explode(F.when(F.size(asked) > 0, F.array_union(first(asked), F.array(F.lit(""))))))  # every token continues an empty one
    b = cl.withColumn("__b", F.explode(first(F.col(candidate))))
    pairs = staged(a.join(b, "__b").drop("__b").distinct().filter(token_match(query, candidate)), "lists")
    made = pairs.agg(F.sum(F.col("__qn") * F.col("__cn"))).first()[0] or 0
    tasks, key = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made // pairs_a_task)), ["__q", "__qt", "__c", "__ct"]
    # Chunks once for each chunk that theirs is paired with.
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), chunks(n) - 1))
    q = attach(packed(queries, ql, query, "__q", chunks("__qn")).drop("__qn"), pairs, ["__q"]).withColumn("__ct", each("__cn")).drop("__qn", "__cn").repartition(tasks, *key)
    c = packed(candidates, cl, candidate, "__c", tiles("__cn")).withColumn("__ct", F.pmod("__ct", chunks("__cn"))).drop("__cn")
    c = attach(c, pairs.drop(query, candidate), ["__c"]).withColumn("__qt", each("__qn")).drop("__qn", "__cn").repartition(tasks, *key)
    # Generated code holds all rows that it makes of one: pairs are made of a few query rows and a tile at a time.
    few = F.transform(F.sequence(F.lit(1), F.size("__qs"), F.lit(rows_a_piece)), lambda i: F.slice("__qs", i, rows_a_piece))
    met = q.join(c.hint("shuffle_hash"), key).withColumn("__qs", F.explode(few)).withColumn("__qs", F.explode("__qs")).withColumn("__cs", F.explode("__cs"))
    of = lambda df, tokens, rows: [F.col(c) if c == tokens else F.col(rows)[c].alias(c) for c in df.columns]
    return met.select(*of(queries, query, "__qs"), *of(candidates, candidate, "__cs"))


def best_match(scored: DataFrame, query: str, score: str, value: str, candidate: str, rating: str) -> DataFrame:
    """Keeps top-score candidates of a query; they have to agree on value; the representative has the highest rating."""
    best = scored.groupBy(F.col(query).alias("__q")).agg(F.max(score).alias("__best"))
    top = scored.join(best, scored[query].eqNullSafe(F.col("__q")) & (F.col(score) == F.col("__best"))).drop("__q", "__best")
    agreed = top.groupBy(query).agg(F.collect_set(value).alias("__v"), F.count(F.lit(1)).alias("n"), F.max_by(candidate, F.struct(rating, candidate)).alias("representative"))
    status = F.when(F.size("__v") == 0, "unmatched").when(F.size("__v") > 1, "ambiguous").when(F.col("n") > 1, "matched_multi_same").otherwise("matched")
    return agreed.select(query, status.alias("status"), F.when(F.size("__v") == 1, F.element_at("__v", 1)).alias(value), "representative", "n")


def interval_lookup(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, value: str, name: str, rows_a_bucket: int = 50_000) -> DataFrame:
    """value of the range that holds the point; else linear between the nearest ranges below and above, rounded to a whole number (half to even); else the edge's.

    An as-of join both ways.  Ranges and points are dealt to buckets of equal width over the
    ranges' span, as many as both tables' rows ask for; in a bucket two windows, one up and one down, carry the last range begun
    before a point and the first after it.
    Where a bucket has none, the neighbours' come from a table with one row a bucket.  Ranges don't overlap.
    """
    span = ranges.agg(F.min(low), F.max(low), F.count(F.lit(1))).first()
    if not span[2]:
        return points.withColumn(name, F.lit(None).cast("double"))
    width = max(1e-9, float(span[1] - span[0]) / max(1, -(-(span[2] + points.count()) // rows_a_bucket)))
    bucket = lambda x: F.floor((x.cast("double") - float(span[0])) / width)
    kept = F.struct(F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi"), F.col(value).cast("double").alias("v"))
    marks = ranges.select(F.col(low).cast("double").alias("__at"), F.lit(0).alias("__kind"), bucket(F.col(low)).alias("__b"), kept.alias("__range"), *[F.lit(None).cast(t).alias(c) for c, t in points.dtypes])
    asked = points.select(F.col(at).cast("double").alias("__at"), F.lit(1).alias("__kind"), bucket(F.col(at)).alias("__b"), F.lit(None).cast(marks.schema["__range"].dataType).alias("__range"), *points.columns)
    both = marks.unionByName(asked)
    edges = both.groupBy("__b").agg(F.max_by("__range", F.when(F.col("__kind") == 0, F.col("__at"))).alias("__last"), F.min_by("__range", F.when(F.col("__kind") == 0, F.col("__at"))).alias("__first"))
    # A frame that ends before the row is carried along; one that begins after it would be computed anew for each row.
    so_far = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    up, down = Window.orderBy("__b"), Window.orderBy(F.desc("__b"))  # one row a bucket
    carried = edges.select(F.col("__b"), F.last("__last", True).over(so_far(up, -1)).alias("__before"), F.last("__first", True).over(so_far(down, -1)).alias("__after"))
    up, down = Window.partitionBy("__b").orderBy("__at", "__kind"), Window.partitionBy("__b").orderBy(F.desc("__at"), F.desc("__kind"))
    both = both.withColumn("__below", F.last("__range", True).over(so_far(up, 0)))
    both = both.withColumn("__above", F.last("__range", True).over(so_far(down, -1))).filter("__kind = 1").join(carried, "__b", "left")
    b, a, x = F.coalesce("__below", "__before"), F.coalesce("__above", "__after"), F.col(at).cast("double")
    between = F.bround(b["v"] + (a["v"] - b["v"]) * (x - b["hi"]) / (a["lo"] - b["hi"]))
    found = F.when(x <= b["hi"], b["v"]).when(b.isNull(), a["v"]).when(a.isNull(), b["v"]).otherwise(between)
    return both.select(*points.columns, found.alias(name))


def nearest(df: DataFrame, keys: list[str], value: str, target: str, name: str) -> DataFrame:
    """By key, the value nearest the target; ties go to the smaller."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(F.abs(F.col(value) - F.col(target)), F.col(value))).alias(name))


def digitize(x: Column, edges: list[float], right: bool = False) -> Column:
    """Number of edges at or below x (below x, if right): bins of fixed cut points."""
    at = F.array(*[F.lit(float(e)) for e in edges])
    return F.when(x.isNotNull(), F.size(F.filter(at, lambda e: (e < x) if right else (e <= x))))
