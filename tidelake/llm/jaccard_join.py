"""N-gram Jaccard join with several global token orders.

A document is the set of its distinct word shingles; two link when 100 |A and B| >= ``percent`` |A or B|.
If they do, then under *any* order of all shingles their prefixes share a shingle,
where a set of n has a prefix of n - ceil(n * percent / 100) + 1.  So candidates have to share a
prefix shingle under each of several orders; the filters are intersected, for cells of documents first and
for each pair then, before sets are
compared.  All orders begin with rare shingles.  The first goes by their count over the corpus;
the others by bands of one and of three doublings of it, and by independent hashes within a band, so each has
prefixes of its own.

1. The corpus is asked how many documents hold each shingle (blocks.ask()).  Shingles of one
   document can't be shared, so a document with too few others has no partner and
   is done; of the rest only shared shingles are kept, in order.
2. Documents with equal sets form a class; from here on only classes matter.
3. Prefix shingles of the first order make groups.  Each class is compared with the smallest class of a few
   of its groups (stars); links give components.  Most of a group of near copies falls
   together here, by as many comparisons as it has members.
4. Groups that still hold several components are settled exactly: classes lie in
   cells of bounded size.  Candidates are pairs of cells that meet in a group of the first order, and
   in one of the second, and of the third, and don't lie in one and the same component; they
   are compared whole, under the filters.  Pairs of cells, not of documents, are made; a
   cell pair returns a spanning set of its links.
5. Components of all links; every document gets its smallest identifier.

Any two classes whose sets link share a group of each order, so they are in one component after step 3, or
meet in step 4.  No partner is capped.  Shingles are 64-bit hashes of five 64-bit hashes of words, and a class is
a 128-bit hash of its shingles: sets are compared by these, not by the words themselves.

Defined cases: a document with fewer words than a shingle has its whole sequence as the one
shingle; without words, or null, it has none and is alone.  Rows with equal
identifiers are documents of their own.  Null identifiers are larger than others; a component without identifiers has a null
one.  An empty table gives an empty result.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.blocks import Block, WordHashes, answer, as_blocks, ask, mixed, parts_for, read_blocks, total_bytes
from tidelake.llm.common import batches_of, drop_staged, numbered, remove_path, stage, text_batches
from tidelake.llm.components import components

ORDERS, CELL = 3, 200
_SALTS = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
_FACTORS = [pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(64)]


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """Distinct shingles of a document's word hashes, in order of number."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    k = min(words, len(hashes))
    total = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        total += hashes[j : j + len(total)] * np.uint64(_FACTORS[j])
    return np.unique(mixed(total + np.uint64(k)))


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def bands(counts: np.ndarray, order: int) -> np.ndarray:
    """What an order goes by first: counts, or which band of one (order 1) or three doublings (order 2) they are in.  Tokens that no other set has are a band of their own, the lowest."""
    if order == 0:
        return counts
    doublings = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
    return np.where(counts > 1, 1 + doublings // (1, 3)[order - 1], 0)


def in_order(tokens: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Places of tokens under one of the global orders."""
    return np.lexsort((mixed(tokens ^ _SALTS[order]) if order else tokens, bands(counts, order)))


def prefix(tokens: np.ndarray, counts: np.ndarray, n: int, percent: int, order: int) -> np.ndarray:
    """Shared tokens in the prefix of a set of n under an order; the tokens that no other set has come before them."""
    size = len(tokens) - needed(n, percent) + 1
    return tokens[:size] if order == 0 else tokens[in_order(tokens, counts, order)[:size]]


def _sets(blocks: DataFrame, words: int, percent: int) -> DataFrame:
    """id, n, digest, shared, tokens, counts of every document; the last four null where no partner is possible."""
    parts = parts_for(total_bytes(blocks), 4_000_000)
    hashes = WordHashes()

    def own(block: Block) -> list[np.ndarray]:
        return [shingles(hashes.of(t.translate(_LOWER).split()), words) for t in block.texts]

    replies = ask(blocks, lambda block: (np.concatenate(own(block)), None), parts, "shingles", bits=48)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            sets = own(block)
            counts, at, rows = answer(replies, block, np.concatenate(sets), None, bits=48), 0, []
            for i, s in zip(block.ids, sets, strict=True):
                c = counts[at : at + len(s)]
                at += len(s)
                some = c > 1
                n = int(np.count_nonzero(some))
                if n and n >= needed(len(s), percent):
                    s2, c2 = s[some], c[some]
                    order = in_order(s2, c2, 0)
                    rows.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), n, s2[order].tobytes(), c2[order].tobytes()))
                else:
                    rows.append((i, len(s), None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["id", "n", "digest", "shared", "tokens", "counts"])

    sets = stage(blocks.mapInArrow(finish, "id long, n long, digest binary, shared int, tokens binary, counts binary"), "sets")
    remove_path(blocks.sparkSession, replies)
    drop_staged(blocks)
    return sets


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _linked(a: dict, b: dict, percent: int) -> bool:
    """Whether two sets pass the filters of all orders and then link."""
    least = -(-percent * (a["n"] + b["n"]) // (100 + percent))
    if min(a["shared"], b["shared"]) < least:
        return False
    for order in range(ORDERS):
        if not len(np.intersect1d(*(prefix(x["tokens"], x["counts"], x["n"], percent, order) for x in (a, b)), assume_unique=True)):
            return False
    return len(np.intersect1d(a["tokens"], b["tokens"], assume_unique=True)) >= least


def _opened(n: int, shared: int, tokens: bytes, counts: bytes) -> dict:
    return {"n": n, "shared": shared, "tokens": np.frombuffer(tokens, np.uint64), "counts": np.frombuffer(counts, np.uint16)}


def _postings(classes: DataFrame, percent: int, order: int) -> DataFrame:
    """token, node: an order's prefixes."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes = [], []
            for r in batch.to_pylist():
                p = prefix(np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["counts"], np.uint16), r["n"], percent, order)
                tokens.append(p)
                nodes += [r["node"]] * len(p)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(nodes, pa.int64())], names=["token", "node"])

    return classes.select("node", "n", "tokens", "counts").mapInArrow(post, "token long, node long")


def _stars(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links of classes with the smallest class of some of their groups."""
    picks = [F.max_by("first", F.struct("size", F.xxhash64("token", F.lit(k)))).alias(f"to{k}") for k in range(ORDERS)]
    pairs = groups.groupBy("node").agg(*picks).select(F.col("node").alias("a"), F.explode(F.array(*[f"to{k}" for k in range(ORDERS)])).alias("b")).filter("a != b").distinct()
    # Sets go to pairs only where their sizes let them link.
    size = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("shared").alias(f"{s}_shared"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b")
    pairs = stage(sized.filter(F.least("a_shared", "b_shared") * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent).select("a", "b"), "pairs")
    of = lambda s: classes.select(F.col("node").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "shared", "tokens", "counts")])
    x, y = of("x"), of("y")
    both = pairs.join(x, pairs["a"] == x["x_node"]).join(y, pairs["b"] == y["y_node"]).select("a", "b", *[f"{s}_{c}" for s in "xy" for c in ("n", "shared", "tokens", "counts")])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["a"], r["b"]) for r in batch.to_pylist() if _linked(*(_opened(*(r[f"{s}_{c}"] for c in ("n", "shared", "tokens", "counts"))) for s in "xy"), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], names=["u", "v"])

    with batches_of(classes.sparkSession, 256):
        return stage(both.mapInArrow(check, "u long, v long"), "links")


def _overlaps(rows: list[dict], columns: list[dict], part) -> np.ndarray:
    """Shared tokens of each of rows with each of columns, of what part() takes of a set."""
    lists = [part(c) for c in columns]
    tokens, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, r in enumerate(rows):
        own = part(r)
        a, b = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        sizes = b - a
        hits = np.repeat(a - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        out[i] = np.bincount(owner[hits], minlength=len(columns))
    return out


def cell_links(rows: list[dict], columns: list[dict], percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links between two cells (or within one), over labels that differ."""
    n = [np.array([r["n"] for r in s]) for s in (rows, columns)]
    shared = [np.array([r["shared"] for r in s]) for s in (rows, columns)]
    least = -(-percent * (n[0][:, None] + n[1]) // (100 + percent))
    open_ = np.minimum(shared[0][:, None], shared[1]) >= least
    names = {x: k for k, x in enumerate({r["label"] for r in (*rows, *columns)})}
    labels = [np.array([names[r["label"]] for r in s]) for s in (rows, columns)]
    open_ &= labels[0][:, None] != labels[1]
    for order in range(ORDERS):
        some = np.flatnonzero(open_.any(1))
        if not len(some):
            return []
        found = _overlaps([rows[i] for i in some], columns, lambda r, order=order: prefix(r["tokens"], r["counts"], r["n"], percent, order))
        open_[some] &= found > 0
    some = np.flatnonzero(open_.any(1))
    if not len(some):
        return []
    whole = _overlaps([rows[i] for i in some], columns, lambda r: r["tokens"])
    roots = list(range(len(names)))

    def root(x: int) -> int:
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        return x

    out = []
    for i, row in zip(some, whole, strict=True):
        for j in np.flatnonzero(open_[i] & (row >= least[i])):
            a, b = root(int(labels[0][i])), root(int(labels[1][j]))
            if a != b:
                roots[a] = b
                out.append((rows[i]["node"], columns[j]["node"]))
    return out


def _cell_pairs(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """c, d: pairs of cells (c <= d) that share a group and hold more than one component."""
    by_cell = groups.select("token", "node").join(nodes.select("node", "label", "cell"), "node").groupBy("token", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    by_cell = stage(by_cell, "groups")
    mixed_groups = by_cell.groupBy("token").agg(F.min("low").alias("a"), F.max("high").alias("b")).filter("a != b").select("token")
    left = stage(by_cell.join(mixed_groups, "token", "left_semi"), "mixed")
    right = left.select("token", F.col("cell").alias("d"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    differ = (F.least("low", "low2") != F.greatest("high", "high2")) & (F.col("cell") <= F.col("d"))
    pairs = stage(left.join(right, "token").filter(differ).select(F.col("cell").alias("c"), "d").distinct(), "pairs")
    drop_staged(by_cell)
    drop_staged(left)
    return pairs


def _settled(groups: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between components, found cell pair by cell pair."""
    # A class goes to a cell with others whose largest group is the same; cells of large groups are salted.
    home = groups.groupBy("node").agg(F.max_by("first", F.struct("size", "token")).alias("home"))
    sizes = home.groupBy("home").agg(F.count(F.lit(1)).alias("members"))
    salt = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("members") / CELL)).cast("long"))
    cells = home.join(sizes, "home").select("node", F.xxhash64("home", salt).alias("cell"))
    nodes = stage(cells.join(labels, "node", "left").select("node", "cell", F.coalesce("label", "node").alias("label")), "cells")
    pairs = _cell_pairs(groups, nodes)
    full = stage(nodes.join(pairs.select(F.explode(F.array("c", "d")).alias("cell")).distinct(), "cell", "left_semi").join(classes, "node"), "members")
    for order in range(1, ORDERS):  # only cells that are candidates so far are asked again
        again = _cell_pairs(_postings(full, percent, order), full)
        both = stage(pairs.join(again, ["c", "d"], "left_semi"), "pairs")
        drop_staged(pairs)
        drop_staged(again)
        pairs = both
    sides = pairs.select("c", "d", F.explode(F.when(F.col("c") == F.col("d"), F.array("c")).otherwise(F.array("c", "d"))).alias("cell"))
    sent = sides.join(full, "cell").select("c", "d", "cell", "node", "label", "n", "shared", "tokens", "counts")

    def settle(table: pa.Table) -> pa.Table:
        c, d = table.column("c")[0].as_py(), table.column("d")[0].as_py()
        sets = {c: [], d: []}
        for r in table.to_pylist():
            sets[r["cell"]].append({"node": r["node"], "label": r["label"]} | _opened(r["n"], r["shared"], r["tokens"], r["counts"]))
        out = cell_links(sets[c], sets[d], percent) if sets[c] and sets[d] else []
        return pa.table({"u": pa.array([p[0] for p in out], pa.int64()), "v": pa.array([p[1] for p in out], pa.int64())})

    links = stage(sent.groupBy("c", "d").applyInArrow(settle, "u long, v long"), "links")
    for done in (nodes, pairs, full):
        drop_staged(done)
    return links


def keep_first_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the one with the smallest identifier (null is the largest), one only if several have it."""
    rows = numbered(docs, "near")
    found = near_duplicates(rows, "__row", text_col, **options).select(F.col("id").alias("__id"), "component_id")
    named = rows.select("__row", F.col(id_col).alias("__of")).join(found, F.col("__row") == F.col("__id"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("__of").isNull().alias("none"), F.col("__of").alias("of"), F.col("__row").alias("row"))).alias("first"))
    return rows.join(first.select(F.col("first.row").alias("__first")), F.col("__row") == F.col("__first"), "left_semi").select(*docs.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row a document: id, n_shingles, component_id."""
    with text_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, words, percent)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    sets = _sets(as_blocks(docs, id_col, text_col), words, percent)
    some = sets.filter("digest is not null")
    classes = some.groupBy("digest").agg(F.min("id").alias("low_id"), F.first("n").alias("n"), F.first("shared").alias("shared"), F.first("tokens").alias("tokens"), F.first("counts").alias("counts"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = stage(sets.select("id", "n", "digest"), "rows")
    drop_staged(sets)
    postings = stage(_postings(classes, percent, 0), "postings")
    firsts = stage(postings.groupBy("token").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "firsts")
    groups = stage(postings.join(firsts, "token"), "groups")
    drop_staged(postings)
    drop_staged(firsts)
    stars = _stars(groups, classes, percent)
    links = stars.unionAll(_settled(groups, classes, components(stars), percent))
    drop_staged(groups)
    # Both sides of the join over labels are staged: a label that most classes have can then be split.
    named = stage(classes.select("node", "digest", "low_id").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    drop_staged(classes)
    lowest = stage(named.groupBy("label").agg(F.min("low_id").alias("component_id")), "lowest")
    by_class = stage(named.select("digest", "label").join(lowest, "label").select("digest", "component_id"), "components")
    alone, joined = rows.filter("digest is null"), rows.filter("digest is not null").join(by_class, "digest")
    return alone.select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")).unionAll(joined.select("id", F.col("n").alias("n_shingles"), "component_id"))
