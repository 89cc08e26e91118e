"""Secret scans: base patterns and a character Markov model, DataFrame operations only.

Base spans come from three patterns.  Spark's regular expressions give no positions, so
each pattern is matched together with the gap before it, anchored to the end of the
last match; positions are running sums of lengths.  That makes the same leftmost,
non-overlapping matches in one linear pass a text.

The model: two first-order character chains over the token alphabet, one of random
strings and one of ordinary identifiers, with add-one-half smoothing.  A token of
``min_token`` characters or more that no base span touches is a secret if its log-likelihood ratio is
above ``margin`` a pair of characters, and above ``SHORT`` more for each character that it has less than ``LONG``: short
tokens say less, and are looked at only if they hold both a digit and a letter.  Both chains are trained from labelled samples: see
labelled_samples(), or give a frame of your own with text, random (boolean) and n (how often it counts).
What is counted covers all documents.

Defined cases: null text is empty and has no spans.  Rows with equal identifiers
are documents of their own.  An empty table gives an empty result.  Other columns
aren't read.  Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, the group whose length counts and its least length.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA([A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"
KINDS = ("assign", "access", "hex", "markov")
#: What a text with such a match has to hold; a cheap test before the matching.
HINTS = {"assign": r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])""", "access": "AKIA", "hex": r"[0-9a-f]{32}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Weight, in pairs, of a chain's single characters where it has seen few pairs.
BACK_OFF = 5.0
TOKEN = r"[A-Za-z0-9+/_=-]"
ORDINARY = rf"(?<!{TOKEN})(?:[A-Za-z+/_=-]{{8,}}|[0-9+/_=-]{{8,}})(?!{TOKEN})"
LONG, SHORT = 20, 1.25
#: Matches whose positions are added up in one go; a text's cost is this times their number.
CHUNK = 256


def positioned(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit, value>> of the leftmost non-overlapping matches; the pattern has one group."""
    whole = rf"\G(?s:(.*?))({pattern})"
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(whole), F.lit(k)).alias(n) for k, n in ((1, "gap"), (2, "hit"), (3, "value"))])
    size = lambda x: F.length(x["gap"]) + F.length(x["hit"])
    whole_ = lambda at, chunk: F.aggregate(
        chunk,
        F.struct(at.alias("at"), _none().alias("out")),
        lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.array_append(acc["out"], F.struct(
            (acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + size(x)).alias("end"), x["hit"].alias("hit"), x["value"].alias("value"),
        )).alias("out")),
        lambda acc: acc["out"],
    )
    # An array that grows is copied at each step, so matches are added up chunk by chunk, from where each chunk begins.
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(parts) / F.lit(CHUNK)).cast("int") - 1)), lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)))
    begins = F.aggregate(
        F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda a, x: a + size(x))),
        F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))"),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"],
    )
    return F.flatten(F.zip_with(begins, chunks, whole_))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,hit:string,value:string>>)")


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> array of spans that pass."""
    hinted = lambda kind, found: F.when(F.contains(text, F.lit("AKIA")) if kind == "access" else F.rlike(text, F.lit(HINTS[kind])), found).otherwise(_none())
    return {
        "assign": hinted("assign", F.filter(positioned(text, ASSIGN), lambda x: F.length(x["value"]) >= 8)),
        "access": hinted("access", F.filter(positioned(text, ACCESS), lambda x: F.length(x["hit"]) >= 16)),
        "hex": hinted("hex", positioned(text, HEX)),
    }


def labelled_samples(docs: DataFrame, text_col: str = "text", strings: int = 3000) -> DataFrame:
    """text, random, n.  Random: seeded random strings (base 64, hexadecimal, capitals and digits) and the
    values that base patterns find in all documents.  Ordinary: tokens of 8 characters or more of all
    documents without such values, but for those that hold both a digit and a letter, which may be secrets that nobody has labelled; each distinct one once with its number.
    """
    spark = docs.sparkSession
    some = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = base_spans(F.col("text"))
    hit = F.lit(False)
    for kind in HINTS:  # a cheap test; only texts that pass it are matched
        hit = hit | (F.contains("text", F.lit("AKIA")) if kind == "access" else F.rlike("text", F.lit(HINTS[kind])))
    found = some.filter(hit).select(F.array_compact(F.flatten(F.array(*[F.transform(s, lambda x: x["value"]) for s in spans.values()]))).alias("values"), "text")
    clean = some.filter(~hit).select("text").unionAll(found.filter(F.size("values") == 0).select("text"))
    words = clean.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n")).select("text", F.lit(False).alias("random"), "n")
    hits = found.select(F.explode("values").alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n")).select("text", F.lit(True).alias("random"), "n")
    seed = spark.range(strings).select(F.sha2(F.col("id").cast("string"), 256).alias("hex"), "id")
    code = F.base64(F.unhex("hex"))
    drawn = seed.select(F.when(F.col("id") % 3 == 0, code).when(F.col("id") % 3 == 1, F.col("hex")).otherwise(F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")).alias("text"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))
    return hits.unionAll(words).unionAll(drawn)


def train(samples: DataFrame) -> list[int]:
    """Log-likelihood ratio (in 1/1000) of each character pair, by pair number.  What comes to the driver is bounded by the alphabet: two counts a pair."""
    k = len(ALPHABET)
    number = lambda at: F.instr(F.lit(ALPHABET), F.substr(F.col("text"), at, F.lit(1))) - 1
    at = F.explode(F.expr("sequence(1, length(text) - 1)"))
    pairs = samples.filter("length(text) >= 2").select("random", "text", "n", at.alias("at")).select("random", "n", number(F.col("at")).alias("a"), number(F.col("at") + 1).alias("b")).filter("a >= 0 and b >= 0")
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect()}
    total = {(kind, a): sum(counts.get((kind, a, b), 0) for b in range(k)) for kind in (True, False) for a in range(k)}
    ending = {(kind, b): sum(counts.get((kind, a, b), 0) for a in range(k)) for kind in (True, False) for b in range(k)}
    alone = lambda kind, b: (ending[kind, b] + 0.5) / (sum(ending[kind, x] for x in range(k)) + 0.5 * k)
    base = {(kind, b): alone(kind, b) for kind in (True, False) for b in range(k)}
    chance = lambda kind, a, b: (counts.get((kind, a, b), 0) + BACK_OFF * base[kind, b]) / (total[kind, a] + BACK_OFF)
    return [round(1000 * math.log(chance(True, a, b) / chance(False, a, b))) for a in range(k) for b in range(k)]


def ratio(token: Column, model: list[int]) -> Column:
    """Log-likelihood ratio of a token (in 1/1000)."""
    k = len(ALPHABET)
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # The first entry of the accumulator is the number of the last character, 0 at the start.
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when((acc["last"] > 0) & (c > 0), F.element_at(table, (acc["last"] - 1) * k + c)).otherwise(F.lit(0))).alias("sum"))
    return F.aggregate(codes, F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum")), step, lambda acc: acc["sum"])


def scan_secrets(docs: DataFrame, model: list[int], id_col: str = "doc_id", text_col: str = "text", min_token: int = 12, margin: float = 0.5) -> DataFrame:
    """One row a document: id, n_assign, n_access, n_hex, base, spans (arrays of struct<start, place, end>; place is the number of the kind in KINDS)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", *[s.alias(k) for k, s in base_spans(F.col("text")).items()])
    flat = lambda kind: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), x["end"].alias("end")))
    rows = rows.withColumn("base", F.array_sort(F.concat(flat("assign"), flat("access"), flat("hex"))))
    mixed = r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])"
    token = rf"((?<!{TOKEN})(?:(?={TOKEN}{{{LONG}}})|{mixed}){TOKEN}{{{min_token},}})"
    tokens = F.when(F.rlike("text", F.lit(token)), positioned(F.col("text"), token)).otherwise(_none())
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    least = lambda n: (n - 1) * F.lit(round(1000 * margin)) + F.greatest(F.lit(0), F.lit(LONG) - n) * F.lit(round(1000 * SHORT))
    random = lambda x: ratio(x["hit"], model) > least(F.length(x["hit"]))
    more = F.transform(F.filter(tokens, lambda x: free(x) & random(x)), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("place"), x["end"].alias("end")))
    return rows.select("id", F.size("assign").alias("n_assign"), F.size("access").alias("n_access"), F.size("hex").alias("n_hex"), "base", F.array_sort(F.concat("base", more)).alias("spans"))


def spans_string(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["place"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
