"""Source divergence audit: how far apart the word use of every two sources of a language is, and which words set a source apart.

Each language keeps the terms that enough of its documents hold.  A group (language, source)
gives each kept term a smoothed share in whole numbers, p = 1 + floor(1e9 (count + 5) / (N + 5 V)); two groups
are the sum of |p - p'| over all kept terms apart, a group's own terms are those above the language's share.

Heavy-light split.  A group gives all terms that it lacks one and the same *base* share, so

    distance(g, h) = V |base_g - base_h| + sum over terms that g or h has of (|p_g - p_h| - |base_g - base_h|).

* *Heavy* terms, which more than ``light`` groups of the language have, go to dense tiles: a tile is a stretch of terms x two
  blocks of groups, filled with shares by NumPy, and adds up all its pairs of groups at once.
* *Light* terms stay sparse.  What a group's light term adds against a group that lacks it depends on its count
  alone, so the tiles take light terms as counts of counts, one row a count.  Where both have it, the pair's
  own correction |p_g - p_h| - |p_g - base_h| - |base_g - p_h| + |base_g - base_h| comes from the term's postings, of which there are ``light`` at most.

All parts are whole numbers and are added exactly.  Work is dealt by (language, term) and by tile: no task meets a language,
a group's terms, or a term's rows one by one, as rows of a term are added up in the tasks that read the text first.

Defined cases: null text, language and source are ''.  Repeated rows are documents of their own.  Groups without
terms take part, with all shares at their base; where a language keeps no term, distances are 0, and shares aren't asked for.  An
empty table gives an empty result.  Other columns, identifiers included, aren't read.  A count is a 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import stage

_COUNTS = "lang string, source string, term string, n long, docs long"

#: Fixed values of the contract: terms are runs of ASCII letters and of characters beyond ASCII; A-Z are lower-cased.  By byte: 0 ends a term.
_SIGNS = np.zeros(256, np.uint8)
_SIGNS[0x80:] = np.arange(0x80, 0x100)
_SIGNS[0x61:0x7B] = _SIGNS[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts in order, and how many each text has; null is empty."""
    rows = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]] if rows.buffers()[2] is not None else np.zeros(0, np.uint8)
    # A 0 behind each text, so that no term goes from one text into the next.
    starts = ends - ends[0]
    signs = np.zeros(len(data) + len(rows), np.uint8)
    signs[np.arange(len(data)) + np.repeat(np.arange(len(rows)), np.diff(starts))] = _SIGNS[data]
    inside = signs != 0
    edge = np.diff(inside, prepend=False, append=False)
    marks = np.flatnonzero(edge)
    begins, finishes = marks[::2], marks[1::2]
    # Only term bytes are kept, so the end of one is the beginning of the next.
    cuts = np.concatenate([[0], np.cumsum(finishes - begins)]).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(signs[inside])])
    owner = np.searchsorted(starts[1:] + np.arange(1, len(rows) + 1), begins, "right")
    return terms.dictionary_encode(), np.bincount(owner, minlength=len(rows))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", step: int = 500) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); a row with an empty term stands for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, step) for a in range(0, batch.num_rows, step)):
                groups = part.select([0, 1]).to_pylist()
                names = {g: k for k, g in enumerate(dict.fromkeys((r["lang"], r["source"]) for r in groups))}
                group = np.array([names[r["lang"], r["source"]] for r in groups], np.int64)
                coded, sizes = terms_of(part.column(2))
                vocabulary, at = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
                # Distinct (document, term) first, then distinct (group, term).
                width = max(1, len(vocabulary))
                own, held = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + at, return_counts=True)
                key, place = np.unique(group[own // width] * width + own % width, return_inverse=True)
                n, d = np.bincount(place, held, len(key)).astype(np.int64), np.bincount(place, minlength=len(key))
                labels = [pa.array([g[i] for g in names], pa.string()) for i in (0, 1)]
                none = np.zeros(len(names), np.int64)
                for g, terms, counts, found in ((np.arange(len(names)), pa.array([""] * len(names), pa.string()), none, none), (key // width, vocabulary.take(pa.array(key % width)).cast(pa.string()), n, d)):
                    yield pa.RecordBatch.from_arrays([*[x.take(pa.array(g)) for x in labels], terms, pa.array(counts, pa.int64()), pa.array(found, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 (count + 5) / (total + 5 kept)), exactly: products pass 64 bits, so they are decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(total + 5 * kept))


_TILE = "lang string, g int, h int, value long"


def _tile(table: pa.Table) -> pa.Table:
    """Corrections of all pairs of groups g < h of one tile: rows of kind 0 are groups, of kind 1 shares of heavy terms, of kind 2 light shares with how many terms have them."""
    kind, number, p, base, many = (np.asarray(table.column(c)) for c in ("kind", "number", "p", "base", "many"))
    lang, a, b, first = (table.column(c)[0].as_py() for c in ("lang", "a", "b", "t"))
    block = np.asarray(table.column("block"))

    def groups(of: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero((kind == 0) & (block == of))
        own = own[np.argsort(number[own])]
        return number[own], base[own]

    (left, left_base), (right, right_base) = groups(a), groups(b)
    off = np.abs(left_base[:, None] - right_base)
    kept = many[kind == 0].max()
    found = off * kept if first == 0 else np.zeros_like(off)

    heavy = np.flatnonzero(kind == 1)
    coded = table.column("term").take(pa.array(heavy)).combine_chunks().dictionary_encode()
    width = len(coded.dictionary)
    term = np.asarray(coded.indices)

    def dense(of: int, numbers: np.ndarray, bases: np.ndarray) -> np.ndarray:
        out = np.repeat(bases[:, None], width, 1)
        own = block[heavy] == of
        out[np.searchsorted(numbers, number[heavy][own]), term[own]] = p[heavy][own]
        return out

    if width:
        x, y = dense(a, left, left_base), dense(b, right, right_base)
        for g in range(len(left)):
            found[g] += np.abs(x[g] - y).sum(1)
        found -= width * off

    def one_sided(of: int, numbers: np.ndarray, bases: np.ndarray, others: np.ndarray) -> np.ndarray:
        """What groups' light terms add against groups that lack them."""
        out = np.zeros((len(numbers), len(others)), np.int64)
        rows = np.flatnonzero((kind == 2) & (block == of))
        at = np.searchsorted(numbers, number[rows])
        for c in range(0, len(rows), 4096):
            r, g = rows[c : c + 4096], at[c : c + 4096]
            np.add.at(out, g, many[r][:, None] * (np.abs(p[r][:, None] - others) - np.abs(bases[g][:, None] - others)))
        return out

    found += one_sided(a, left, left_base, right_base) + one_sided(b, right, right_base, left_base).T
    g, h = np.nonzero(left[:, None] < right)
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(left[g], pa.int32()), "h": pa.array(right[h], pa.int32()), "value": pa.array(found[g, h], pa.int64())})


def _distances(groups: DataFrame, shares: DataFrame, light: int, block: int) -> DataFrame:
    """lang, g, h, value of every two groups g < h of a language."""
    tile_of = lambda x: F.pmod(F.xxhash64(x), F.col("tiles")).cast("int")
    own = (F.col("number") / block).cast("int")
    ends = groups.select("lang", "number", "tiles", "blocks", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"), F.lit("").alias("term"), F.lit(0).cast("long").alias("p"), "base", F.col("kept").alias("many"), F.lit(0).alias("kind"))
    heavy = shares.filter(F.col("holders") > light).select("lang", "number", "tiles", "blocks", tile_of("term").alias("t"), "term", "p", "base", F.lit(1).cast("long").alias("many"), F.lit(1).alias("kind"))
    sparse = shares.filter(F.col("holders") <= light)
    alike = sparse.groupBy("lang", "number", "tiles", "blocks", "p", "base").agg(F.count(F.lit(1)).alias("many")).select("lang", "number", "tiles", "blocks", tile_of("p").alias("t"), F.lit("").alias("term"), "p", "base", "many", F.lit(2).alias("kind"))
    rows = ends.unionByName(heavy).unionByName(alike).withColumn("block", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", F.least("block", "__other").cast("int").alias("a"), F.greatest("block", "__other").cast("int").alias("b"), "t", "block", "number", "term", "p", "base", "many", "kind")
    dense = rows.groupBy("lang", "a", "b", "t").applyInArrow(_tile, _TILE)

    held = sparse.filter("holders > 1").groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("number", "p", "base"))).alias("held"))  # at most `light` entries
    pairs = F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    met = held.select("lang", F.explode(pairs).alias("m")).select("lang", "m.x", "m.y")
    apart = lambda u, v: F.abs(u - v)
    both = apart(F.col("x.p"), F.col("y.p")) - apart(F.col("x.p"), F.col("y.base")) - apart(F.col("x.base"), F.col("y.p")) + apart(F.col("x.base"), F.col("y.base"))
    corrected = met.groupBy("lang", F.col("x.number").alias("g"), F.col("y.number").alias("h")).agg(F.sum(both).alias("value"))
    return dense.unionByName(corrected).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, light: int = 8, block: int = 128, tile_terms: int = 512, salts: int = 32, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has each other source of the language with its distance, part ``term`` the group's own terms down to rank ``top``."""
    counts = stage(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    terms = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("holders")).filter(F.col("docs") >= least_docs)
    kept = stage(terms.drop("docs"), "kept-terms")
    postings = stage(counts.filter("term <> ''").drop("docs").join(kept, ["lang", "term"]), "postings")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"), F.count_if(F.col("holders") > light).alias("heavy"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total", "heavy"])
    everyone = Window.partitionBy("lang")  # a row a source
    groups = groups.withColumns({
        "number": (F.row_number().over(everyone.orderBy("source")) - 1).cast("int"),
        "blocks": F.ceil(F.count(F.lit(1)).over(everyone) / block).cast("int"),
        "tiles": (F.col("heavy") / tile_terms).cast("int") + 1,
        "base": F.when(F.col("kept") > 0, smoothed(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(F.lit(0).cast("long")),
    })
    groups = stage(groups.drop("heavy"), "groups")

    # A hot group's terms meet its one row over (language, source, salt).
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = postings.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(dealt, ["lang", "source", "salt"])
    shares = stage(both.select("lang", "source", "number", "term", "holders", "base", "tiles", "blocks", smoothed(F.col("n"), F.col("total"), F.col("kept")).alias("p"), smoothed(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")), "shares")

    best = [F.desc("value"), F.asc("item")]
    own = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.pmod(F.xxhash64("term"), F.lit(salts)).alias("salt"))
    # Two steps: the best of each salt of a group, then the best of those.
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).filter(F.col("rank") <= top).drop("salt")

    found = _distances(groups, shares, light, block)
    names = groups.select(F.col("lang").alias("__lang"), "number", "source")
    ways = found.select("lang", "value", F.explode(F.array(F.struct(F.col("g").alias("g"), F.col("h").alias("h")), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("w")).select("lang", "value", "w.g", "w.h")
    for end, name in (("g", "source"), ("h", "item")):
        x = names.select("__lang", F.col("number").alias("__n"), F.col("source").alias(name))
        ways = ways.join(x, (ways["lang"] == x["__lang"]) & (ways[end] == x["__n"])).drop("__lang", "__n")
    pair = ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best)))
    return pair.unionByName(own).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
