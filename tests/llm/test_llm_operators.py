"""Each operator against a brute-force version, and on nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import chat, exact_dedup, jaccard_join, mixing, packing, quality, secrets, substring_dedup, topk_search, warc
from tidelake.llm.components import components

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string, kept string, id int, label string, cell int"


def docs(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, s, "x", "y", 7, "z", 1) for i, t, s in rows], DOCS)


def sample(seed=1, n=60):
    """Texts with exact and near copies, shared passages, empty and null ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        k = i % 8
        if k == 0 or not out:
            t = [word() for _ in range(r.randint(1, 120))]
        elif k == 1:
            t = list(out[r.randrange(len(out))])
        elif k in (2, 3):
            t = list(out[r.randrange(len(out))])
            if t:
                t[r.randrange(len(t))] = word()
        elif k == 4:
            t = [word() for _ in range(30)] + passage[r.randint(0, 20) :] + [word() for _ in range(5)]
        elif k == 5:
            t = passage[:50] * 2
        elif k == 6:
            t = []
        else:
            t = [word() for _ in range(r.randint(1, 6))]
        out.append(t)
    rows = [(i, r.choice([" ", "  ", "\n"]).join(t), f"s{i % 3}") for i, t in enumerate(out)]
    return [*rows, (1000, None, None), (1001, "", "s1"), (1002, None, "s2"), (None, "no id here", "s0"), (3, rows[3][1], "s0")]


def words(t):
    return (t or "").encode().split()


def test_exact_dedup(spark):
    rows = sample()
    got = exact_dedup.exact_dedup(docs(spark, rows), least_runs=16, rows_a_cell=2).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    assert len(got) == len(rows)
    expect = sorted((str(i), min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.id), r.keep_id, r.group_size, r.text_sha256) for r in got) == expect
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    back = exact_dedup.keep_first_copies(docs(spark, rows), least_runs=16, rows_a_cell=2)
    assert back.columns == docs(spark, rows).columns and back.count() == len(groups)


def test_exact_dedup_of_rows_without_ids(spark):
    got = exact_dedup.exact_dedup(docs(spark, [(None, "a", "s"), (None, "a", "s")])).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got) == [(None, None, 2, False), (None, None, 2, True)]


def test_exact_dedup_merges_runs_pair_by_pair(spark):
    """Every round's runs are those of the pairs before, sorted by digest within ranges that tasks own."""
    rows = exact_dedup.digest_rows(docs(spark, sample(seed=9, n=120)), "doc_id", "text").collect()
    entries = spark.createDataFrame([(k % 8, bytearray(r.digest), (r.id is None, r.id, r.row), 1, r.check, r.check) for k, r in enumerate(rows)], "run int, digest binary, first struct<none:boolean,id:long,row:long>, n long, low struct<hash:long,size:int>, high struct<hash:long,size:int>")
    held = exact_dedup.merge_round(entries, F.col("run"), 2)
    expect = collections.defaultdict(list)
    for k, r in enumerate(rows):
        expect[k % 8, bytes(r.digest)].append((r.id is None, r.id or 0, r.row))
    for runs in (8, 4, 2, 1):
        got = {(x.run, bytes(x.digest)): (x.first.row, x.n) for x in held.collect()}
        assert got == {k: (min(v)[2], len(v)) for k, v in expect.items()}
        parts = held.rdd.glom().collect() if runs < 8 else []
        for part in parts:
            keys = [(x.run, bytes(x.digest)) for x in part]
            assert all(a < b for a, b in zip(keys, keys[1:]) if a[0] == b[0]) or len({k[0] for k in keys}) > 1
        merged = collections.defaultdict(list)
        for (run, digest), v in expect.items():
            merged[run // 2, digest] += v
        expect, held = merged, exact_dedup.merge_round(held, F.shiftright("run", 1), 4)


def test_exact_dedup_finds_a_clash(spark):
    entry = lambda size: (0, bytearray(b"x" * 32), (False, 1, size), 1, (5, size), (5, size))
    entries = spark.createDataFrame([entry(1), entry(2)], "run int, digest binary, first struct<none:boolean,id:long,row:long>, n long, low struct<hash:long,size:int>, high struct<hash:long,size:int>")
    with pytest.raises(Exception, match="different texts"):
        exact_dedup.merge_round(entries, F.col("run"), 1).collect()


def test_exact_dedup_of_long_texts_and_repeated_rows(spark):
    long = "word " * 200_000
    rows = [(1, long, "s"), (2, long.strip() + " ", "s"), (2, long, "s"), (3, "b", "s"), (3, "b", "s"), (3, "c", "s")]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, 3, 1, True), (3, 3, 2, False), (3, 3, 2, True)]
    assert sorted((r.doc_id, len(r.text)) for r in exact_dedup.keep_first_copies(docs(spark, rows)).collect()) == [(1, 1_000_000), (3, 1), (3, 1)]


def test_mixing(spark):
    rows = sample(n=200)
    got = mixing.mix_copies(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += len(words(t))
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, open_, target = 1.5 * sum(total.values()), set(order), {}
    while open_:
        rate = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > 2 * total[s]}
        if not over:
            target |= {s: weight[s] * rate for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_ -= over
    taken = collections.Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source]) and r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.15 * max(total[s], 1) + 150
    again = mixing.mix_copies(docs(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = [(i, t, s) for i, t, s in rows if i not in (3,)]
    assert mixing.mix(docs(spark, whole)).count() == sum(r.copies for r in mixing.mix_copies(docs(spark, whole)).collect())


def test_substring_dedup(spark):
    rows = sample(seed=4)
    got = substring_dedup.remove_repeats(docs(spark, rows), with_text=True).collect()
    seen = collections.Counter(tuple(w[k : k + 35]) for _, t, _ in rows for w in [words(t)] for k in range(len(w) - 34))
    expect = []
    for i, t, _ in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        expect.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert sum(e[2] for e in expect) > 0
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == sorted(expect)


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def shingle_set(t):
    w = [x.lower() for x in words(t)]
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_jaccard_join(spark):
    rows = [r for r in sample(seed=7, n=90) if r[0] is not None and r[0] != 3]
    rows += [(2000 + i, "Q" * (i % 3) + " " + " ".join(f"w{j}" for j in range(40) if j != i) + f" t{i}", "s") for i in range(40)]
    rows += [(3000, "One TWO", "s"), (3001, "one two", "s"), (3002, "one two three", "s")]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, rows)).collect()}
    sets = {i: shingle_set(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(rows)


def test_cell_links_are_exact(monkeypatch):
    """Cells of different labels find every link, whatever stars found before."""
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(80)]
    sets = []
    for i in range(30):
        tokens = np.array(sorted(set(base[: 60 + r.randrange(20)]) | {r.choice(base)}), np.uint64)
        counts = np.full(len(tokens), 9, np.uint16)
        sets.append({"node": bytes([i]), "label": bytes([i]), "n": len(tokens), "shared": len(tokens), "tokens": tokens[jaccard_join.in_order(tokens, counts, 0)], "counts": counts})
    links = jaccard_join.cell_links(sets, sets, 75)
    reached = {s["node"]: s["node"] for s in sets}

    def find(x):
        while reached[x] != x:
            x = reached[x]
        return x

    for a, b in links:
        reached[find(a)] = find(b)
    for x in sets:
        for y in sets:
            o = len(set(x["tokens"].tolist()) & set(y["tokens"].tolist()))
            if 100 * o >= 75 * (x["n"] + y["n"] - o):
                assert find(x["node"]) == find(y["node"])


def test_orders_differ_beyond_ties():
    """Tokens of different counts stand in different order; those that no other set has come first in every one."""
    r = np.random.default_rng(3)
    tokens = np.sort(r.integers(1, 2**63, 400).astype(np.uint64))
    counts = np.concatenate([np.ones(50), r.integers(2, 100, 350)]).astype(np.uint16)
    orders = [jaccard_join.in_order(tokens, counts, k) for k in range(jaccard_join.ORDERS)]
    for o in orders:
        assert sorted(o) == list(range(400)) and (counts[o[:50]] == 1).all()
        bands = [jaccard_join.bands(counts, k)[o] for k, x in enumerate(orders) if x is o]
        assert (np.diff(bands[0].astype(int)) >= 0).all()
    for a in range(len(orders)):
        for b in range(a):
            first = lambda o: set(o[50:150].tolist())
            assert first(orders[a]) != first(orders[b]) and counts[orders[a][50:150]].tolist() != counts[orders[b][50:150]].tolist()


def test_cell_pairs_are_those_of_all_orders(spark):
    """A pair of cells is a candidate only if it shares a prefix token under every order."""
    nodes = spark.createDataFrame([(k, k, k) for k in range(4)], "node long, cell long, label long")
    groups = lambda rows: spark.createDataFrame(rows, "token long, node long")
    one = jaccard_join._cell_pairs(groups([(1, 0), (1, 1), (1, 2), (2, 3)]), nodes)
    two = jaccard_join._cell_pairs(groups([(7, 0), (7, 1), (8, 2), (8, 3)]), nodes)
    assert sorted(map(tuple, one.collect())) == [(0, 1), (0, 2), (1, 2)] and sorted(map(tuple, one.intersect(two).collect())) == [(0, 1)]


def test_routes_cost_no_more_than_keys():
    """A million parts, and no more routes than keys."""
    from tidelake.llm.blocks import routed

    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    lead = np.uint64(64 - 20)
    routes = routed(keys, lead)
    assert len(routes) <= len(keys) and routes[0][1] == 0 and routes[-1][2] == len(keys)
    assert all(b == c for (_, _, b), (_, c, _) in zip(routes, routes[1:]))
    assert all((keys[a:b] >> lead == p).all() for p, a, b in routes) and len({p for p, _, _ in routes}) == len(routes)
    assert routed(keys[:0], lead) == []


def test_components_of_a_hot_node(spark):
    links = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(5)]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000 + i: 5000 for i in range(6)}


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


TOKENIZER = None


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = sample(seed=5) + [(5000, "long " * 5000, "s"), (5001, "naïve <|endoftext|> İstanbul ΣΑΣ can't 12", "s")]
    got = packing.pack(docs(spark, rows), tokenizer_path(), size=256).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    expect = []
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expect += [(str(i), k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted((str(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expect)
    placed = collections.defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    gaps = []
    for n in sorted((r.length for r in got), reverse=True):
        fit = min((g for g in gaps if g >= n), default=256)
        if fit in gaps:
            gaps.remove(fit)
        gaps.append(fit - n)
    assert len(placed) == len(gaps)


def test_packing_plan_places_every_rank_once():
    r = random.Random(1)
    counts = {n: r.randrange(1, 500) for n in r.sample(range(1, 129), 60)}
    steps = sorted(packing.plan(counts, 128))
    used = collections.Counter()
    for (length, rank, first, offset), nxt in zip(steps, [*steps[1:], (None, 0, 0, 0)], strict=True):
        end = nxt[1] if nxt[0] == length else counts[length]
        assert end > rank
        for k in range(end - rank):
            for at in range(offset, offset + length):
                used[first + k, at] += 1
    assert set(used.values()) == {1} and max(at for _, at in used) < 128 and sum(used.values()) == sum(k * n for k, n in counts.items())


def test_warc(spark):
    big = "<p>" + "é" * 3000 + "</p>"
    rows = [(5, "http://a", big), (2, "http://b", big), (9, "http://c", "short"), (1, "http://d", "short"), (4, None, None), (7, "http://e", big + "\r\n\r\nWARC/1.1\r\n"), (8, "http://f", ""), (None, "http://g", big), (2, "http://h", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages, chunk=1000, salts=4).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expect = [(str(i), len((t or "").encode()), digest(t), *(("revisit", 2) if t == big else ("response", None))) for i, _, t in rows]
    expect[1] = ("2", len(big.encode()), digest(big), "response", None)
    assert sorted(map(str, [(str(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(str, expect))
    folder = warc.new_path(spark, "test")
    table = warc.record_table(warc.marked(pages, "page_id", "url", "html", 100, 4), 1000)
    manifest = warc.write_archives(table, folder, split=500)
    chunks = warc.read_archives(spark, manifest, folder, chunk=700).filter("record_id = 7").orderBy("chunk_no").collect()
    assert b"".join(c.data for c in chunks).decode() == rows[5][2] and max(len(c.data) for c in chunks) <= 700
    for k, c in enumerate(chunks):
        assert c.chunk_no == k and c.sha256_so_far == hashlib.sha256(b"".join(x.data for x in chunks[: k + 1])).hexdigest()


def test_topk(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[50:150] = v[7]
    rows = [(i, v[i].tolist()) for i in range(300)] + [(300, None), (350, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8), (450, [1.0, 2.0]), (500, [float("inf")] * 8), (None, v[1].tolist()), (600, [3.0, 1.0])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = collections.defaultdict(list)
    for x in topk_search.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.id, x.score))
    m = {i: np.floor(256 * np.array(e, np.float64)).astype(np.int64) for i, e in rows if i is not None and e is not None and None not in e and np.isfinite(np.array(e)).all()}
    for q in [i for i in m if i % 50 == 0]:
        best = sorted(((int(m[q] @ m[c]), c) for c in m if c != q and len(m[c]) == len(m[q])), key=lambda x: (-x[0], x[1]))[:5]
        assert got[q] == [(k + 1, c, s) for k, (s, c) in enumerate(best)]


def test_pivot_bound_saves_evaluations():
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 16)) * 800
    m = np.rint(np.concatenate([c + r.normal(size=(100, 16)) * 20 for c in centres])).astype(np.int64)
    at = np.concatenate([np.zeros((1, 16)), m[::100]])
    table = np.sqrt(((m[:, None, :] - at) ** 2).sum(2))
    best, seen = topk_search.best_of(m[5], 5, table[5], np.arange(len(m)), m, table, 5, None)
    scores = m @ m[5]
    scores[5] = np.iinfo(np.int64).min
    assert [s for s, _ in best] == sorted(scores.tolist(), reverse=True)[:5] and seen < len(m) / 2


def _clustered(seed=5, centres=20, each=100, dim=16):
    r = np.random.default_rng(seed)
    at = r.normal(size=(centres, dim)) * 3
    return np.concatenate([c + r.normal(size=(each, dim)) / 10 for c in at])


def test_pairs_of_groups_are_eliminated(spark):
    """Clusters: most pairs of groups go before vectors meet, and what is left holds every answer."""
    v = _clustered()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    vectors = topk_search.whole_vectors(df, "vec_id", "embedding", 256)
    at = topk_search.choose_pivots(vectors, 40, 500)
    groups = topk_search.stage(topk_search._grouped(topk_search._in_regions(vectors, at, 40), at, 50, 0), "groups")
    asked = topk_search.stage(topk_search._grouped(topk_search._in_regions(vectors.filter("id % 50 = 0"), at, 40), at, 50, 5), "asked")
    left = {(r.x, r.q) for r in topk_search.pairs_left(groups, asked, chunk=7).collect()}
    assert len(left) < 0.3 * groups.count() * asked.count()
    of = {int(i): g.name for g in groups.collect() for i in np.frombuffer(g.ids, np.int64)}
    whole = np.floor(256 * v).astype(np.int64)
    for g in asked.collect():
        for i in np.frombuffer(g.ids, np.int64).tolist():
            best = sorted(((-int(whole[i] @ whole[c]), c) for c in range(len(v)) if c != i))[:5]
            assert all((of[c], g.name) in left for _, c in best)
    got = collections.defaultdict(list)
    for x in topk_search.search(df, df.filter("vec_id % 50 = 0"), pivots=40, sample=500, group=50, query_group=20).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.id, x.score))
    for i in range(0, len(v), 50):
        assert got[i] == [(c, -s) for s, c in sorted((-int(whole[i] @ whole[c]), c) for c in range(len(v)) if c != i)[:5]]


def test_evaluated_share_of_the_test_table(spark):
    """With the production pivots fewer than half of the candidates of the sf0.1 table are evaluated."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = topk_search.whole_vectors(rows, "vec_id", "embedding", 256)
    at = topk_search.choose_pivots(vectors, 1024, 2048)
    found = vectors.collect()
    ids, m = np.array([r.id for r in found]), np.array([r.v for r in found])
    table = at.table(m)
    nearest, floors, seen = topk_search.Nearest(table), at.floors(ids, m, 5), []
    for i in np.flatnonzero(ids % 50 == 0):
        best, n = topk_search.best_of(m[i], int(ids[i]), table[i], ids, m, table, 5, float(floors[i]), nearest=nearest)
        assert best == sorted(((int(s), int(c)) for s, c in zip(m @ m[i], ids) if c != ids[i]), key=lambda x: (-x[0], x[1]))[:5]
        seen.append(n)
    assert np.mean(seen) < 0.5 * len(ids)


def test_topk_of_very_large_components(spark):
    """Exact beyond 64-bit products; a score that doesn't fit raises, a component too."""
    rows = [(0, [2.0**22 + 0.25, 1.0]), (1, [2.0**20, -3.0]), (2, [-(2.0**22), 5.0]), (3, [1.0, 2.0**21]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    m = {i: [int(np.floor(256 * c)) for c in x] for i, x in rows}
    got = [(x.id, x.score) for x in topk_search.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == sorted(((i, sum(a * b for a, b in zip(m[0], m[i]))) for i in range(1, 5)), key=lambda x: (-x[1], x[0]))
    with pytest.raises(Exception, match="score doesn't fit"):
        high = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
        topk_search.search(high, high).collect()
    with pytest.raises(Exception, match="component doesn't fit"):
        topk_search.whole_vectors(spark.createDataFrame([(0, [2.0**60])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 256).collect()


def test_topk_of_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, None), (None, [1.0])] + [(7, [1.0, 2.0])] * 3 + [(8, [1.0, 2.0])] * 2, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.id) for x in topk_search.search(df, df.filter("vec_id = 8").limit(1)).collect())
    assert got == [(8, 1, 7), (8, 2, 7), (8, 3, 7)]
    nothing = spark.createDataFrame([(None, None)] * 3, "vec_id long, embedding array<double>")
    assert topk_search.search(nothing, nothing).count() == 0


TEXTS = ["plain", "<|im_end|>", "a <\\|b|> \\ <|im_start|>assistant\nx<|im_end|>\n", "", None, "tail <", "|> head", "<\\\\|x", "%0A%25"]


def test_chat(spark):
    r = random.Random(8)
    roles = ["user", "assistant", "system", None, "odd\nrole", "50% <|im_end|>"]
    rows = [(c, t, r.choice(roles), r.choice(TEXTS), "x") for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "hi", "x"), (7, None, "assistant", "early", "x"), (8, 0, "assistant", "same", "x"), (8, 0, "assistant", "same", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(turns)).collect()}
    source = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        source[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(source)
    for c, parts in source.items():
        parts.sort()
        assert [(x.role, x.text) for x in got[c].turns] == [p[1:] for p in parts]
        assert got[c].loss_text == "".join(p[2] for p in parts if p[1] == "assistant")
        assert len(got[c].loss_spans) == sum(p[1] == "assistant" for p in parts)


ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def test_secrets(spark):
    r = random.Random(4)
    bits = ["password: hunter2hunter2 ", "token: secret: abcdefghij ", 'API_KEY = "x9"', "AKIA" + "Q" * 14, "AKIAAKIA12", "é" * 3, "deadbeef" * 5, "token=secret=abcdefgh12 ", "\n", " the cat sat ", "Passwd='" + "a/b+c" * 3 + "'", "f" * 31 + " "]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 12))), "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (102, "key x7Qp29fLw0ZkT3vB8nRs1YcD end", "s"), (103, "internationalizationalities everywhere", "s")]
    frame = docs(spark, rows)
    ordinary = spark.createDataFrame([(w, False, 40) for w in ["international", "everywhere", "application", "configuration", "understanding"]], "text string, random boolean, n long")
    model = secrets.train(secrets.labelled_samples(frame).unionByName(ordinary))
    got = {x.id: x for x in secrets.scan_secrets(frame, model).select("id", "n_assign", "n_access", "n_hex", secrets.spans_string(secrets.F.col("base")).alias("base"), secrets.spans_string(secrets.F.col("spans")).alias("spans")).collect()}
    for i, t, _ in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        assert got[i].base == ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert got[102].spans == "markov:4:28" and got[103].spans == ""


def test_secret_model_recall_and_false_alarms(spark):
    """Random tokens outside the base patterns are found, by length; documents of the test tables without secrets stay clean."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.train(secrets.labelled_samples(table))
    r = random.Random(1)
    signs = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "hex": "0123456789ABCDEF"}
    kinds = [(name, n) for name in signs for n in (12, 16, 20, 32) for _ in range(100)]
    asked = spark.createDataFrame([(i, f"see {''.join(r.choice(signs[name]) for _ in range(n))} here", f"{name}-{n}") for i, (name, n) in enumerate(kinds)], "doc_id long, text string, source string")
    found = secrets.scan_secrets(asked, model).select(F.col("id").alias("doc_id"), F.size("spans").alias("n")).join(asked, "doc_id").groupBy("source").agg(F.avg((F.col("n") > 0).cast("int")).alias("recall")).collect()
    assert len(found) == 8 and all(x.recall >= (0.85 if x.source.endswith(("12", "16")) else 0.99) for x in found)
    scanned = secrets.scan_secrets(table, model).select(F.exists("spans", lambda x: x["place"] == 3).alias("hit"))
    assert scanned.filter("hit").count() <= 0.002 * table.count()


def test_secrets_in_a_long_text(spark):
    """More matches than one chunk of running sums holds, at their places."""
    part = "é password: hunter2hunter2 " + "deadbeef" * 4 + " "
    text = part * 1500
    got = secrets.scan_secrets(docs(spark, [(1, text, "s")]), [0] * len(secrets.ALPHABET) ** 2).select("n_assign", "n_hex", secrets.spans_string(F.col("base")).alias("base")).first()
    expect = sorted([(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{32,}", text)])
    assert (got.n_assign, got.n_hex) == (1500, 1500) and got.base == ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in expect)


def test_very_long_texts(spark):
    """One text of several megabytes among short ones, operator by operator."""
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(6)) for _ in range(3000)]
    long = " ".join(r.choice(vocabulary) for _ in range(400_000))
    near = long + " one two three"
    frame = docs(spark, [(1, long, "s"), (2, near, "s"), (3, "short text", "s"), (4, None, None)])
    assert sorted((x.id, x.component_id) for x in jaccard_join.near_duplicates(frame).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    removed = {x.id: (x.n_words, x.n_removed) for x in substring_dedup.remove_repeats(frame).collect()}
    assert removed == {1: (400_000, 400_000), 2: (400_003, 400_000), 3: (2, 0), 4: (0, 0)}
    pages = frame.select(F.col("doc_id").alias("page_id"), F.lit("http://x").alias("url"), F.col("text").alias("html"))
    back = {x.id: (x.payload_bytes, x.payload_digest) for x in warc.round_trip(pages).collect()}
    assert back[1] == (len(long), hashlib.sha256(long.encode()).hexdigest())
    model = quality.Model(-np.ones(1 << quality.BITS, np.float32) / 100, np.array([-3.0, -2.0]))
    assert quality.scored(frame, model).filter("doc_id = 1").first().rating.p_top >= 0
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).first().loss_text == long


def test_all_null_tables_of_the_others(spark):
    nothing = spark.createDataFrame([(None, None, None)] * 3, "page_id long, url string, html string")
    assert sorted((x.id, x.payload_bytes, x.record_type) for x in warc.round_trip(nothing).collect()) == [(None, 0, "response")] * 3
    turns = spark.createDataFrame([(None, None, None, None)] * 2, "conv_id long, turn long, role string, text string")
    assert [(x.conv_id, len(x.turns), x.loss_text) for x in chat.read_back(chat.format_conversations(turns)).collect()] == [(None, 2, "")]
    rows = docs(spark, [(None, None, None)] * 3)
    model = secrets.train(secrets.labelled_samples(rows))
    assert [x.n for x in secrets.scan_secrets(rows, model).select(F.size("spans").alias("n")).collect()] == [0, 0, 0]
    labels = spark.createDataFrame([(None, None, None)] * 2, "doc_id long, quality int, toxic int")
    assert quality.select_top(rows, quality.train(rows, quality.grades_of(labels))).count() == 3


def test_mix_emits_rows_not_identifiers(spark):
    """Rows that share an identifier, or have none, are emitted each by its own copies."""
    rows = [(7, f"w{i} " * 20, "s0") for i in range(40)] + [(None, f"v{i} " * 10, "s1") for i in range(40)]
    mixed = mixing.mix(docs(spark, rows)).collect()
    each = collections.Counter(x.text for x in mixed)
    assert max(each.values()) <= 2
    taken, total = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        total[s] += len(words(t))
    for x in mixed:
        taken[x.source] += len(words(x.text))
    assert abs(taken["s0"] + taken["s1"] - 1.5 * sum(total.values())) <= 60


def test_near_copies_by_row(spark):
    """One row of each component stays, of rows with one identifier too, with all its columns."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base, "s"), (5, base + " x", "s"), (None, base + " y", "s"), (9, "other words here", "s"), (None, None, None), (3, "", "s")]
    kept = jaccard_join.keep_first_near_copies(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    got = kept.collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, len(words(x.text))) for x in got) == [(False, 3, 0), (False, 5, [60, 61][len(words(next(x.text for x in got if x.doc_id == 5))) - 60]), (False, 9, 3), (True, 0, 0)]


def test_packing_refuses_tokenizers_that_need_white_space():
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a": 0, " ": 1, "b": 2, "?": 3}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
    with pytest.raises(ValueError, match="white space"):
        packing.StretchIds(tok.to_str())


def test_quality(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]

    def text(kind):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 80))]
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        if kind == 1:
            w[r.randrange(len(w))] = r.choice(["nasty", "vile", "awful"])
            w[r.randrange(len(w))] = r.choice(["nasty", "vile", "awful"])
        return " ".join(w)

    kinds = [r.choice([0, 1, 2, 2]) for _ in range(800)]
    rows = [(i, text(k), "s") for i, k in enumerate(kinds)] + [(9000, None, "s"), (None, "x", "s")]
    labels = [(i, int(k > 0), int(k == 1)) for i, k in enumerate(kinds[:500])] + [(600, None, 1), (None, 1, 0), (99999, 1, 0)]
    frame = docs(spark, rows)
    model = quality.train(frame, quality.grades_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), sample=400)
    scored = {x.doc_id: x.rating for x in quality.scored(frame, model).collect()}
    right = sum((scored[i].p_top >= 0.5) == (kinds[i] == 2) for i in range(500, 800))
    assert right >= 285 and 0 <= scored[9000].p_top <= 1 and np.all(np.diff(model.thresholds) >= 0)
    mean = [np.mean([scored[i].expected_grade for i in range(500, 800) if kinds[i] == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert quality.select_top(frame, model).columns == frame.columns
    nothing = quality.train(frame, quality.grades_of(spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert quality.select_top(frame, nothing).count() == len(rows)


def test_quality_learns_from_every_label_of_the_sample(spark):
    """More labels than 3,000: what only the last 1,000 of them in the sample's order show is learnt too."""
    ids = [r.id for r in spark.range(4000).orderBy(F.xxhash64("id", F.lit(3)), "id").collect()]
    late, r = set(ids[3000::2]), random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(50)]
    rows = [(i, " ".join([*r.choices(vocabulary, k=8), *["vile"] * (i in late), *["LOW!!"] * (i % 20 == 0)]), "s") for i in range(4000)]
    labels = [(i, int(i % 20 > 0), int(i in late)) for i in range(4000)]
    model = quality.train(docs(spark, rows), quality.grades_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    asked = docs(spark, [(1, " ".join([*vocabulary[:8], "vile"]), "s"), (2, " ".join(vocabulary[:8]), "s")])
    top = {x.doc_id: x.rating.p_top for x in quality.scored(asked, model).collect()}
    assert top[1] < 0.5 < top[2]


def test_quality_screen_is_that_of_all_rows_at_once(spark):
    """Of all rows and of those without each fold."""
    r = np.random.default_rng(8)
    grades, folds = r.integers(0, 3, 300), r.integers(0, quality.FOLDS, 300)
    rows = [np.flatnonzero(r.random(40) < np.where(np.arange(40) < 5, 0.6 - 0.25 * g, 0.3)) for g in grades]
    values = [r.random(len(f)).astype(np.float32) * 6 for f in rows]
    frame = spark.createDataFrame([(i, int(g), int(k), bytearray(f.astype(np.int32).tobytes()), bytearray(v.tobytes())) for i, (g, k, f, v) in enumerate(zip(grades, folds, rows, values, strict=True))], quality._TAKEN)
    counts = np.array([[np.sum((grades == g) & (folds == k)) for g in range(3)] for k in range(quality.FOLDS)])
    got = {x.feature: x.spreads for x in quality._screened(frame.repartition(7), counts).collect()}
    dense = np.zeros((300, 40))
    for i, (f, v) in enumerate(zip(rows, values, strict=True)):
        dense[i, f] = v
    want = []
    for some in [np.ones(300, bool), *[folds != k for k in range(quality.FOLDS)]]:
        most = np.zeros(40)
        for cut in (1, 2):
            above, below = dense[some & (grades >= cut)], dense[some & (grades < cut)]
            error = np.sqrt(sum((x.var(0) + 1 / len(x)) / len(x) for x in (above, below)))
            most = np.maximum(most, (below.mean(0) - above.mean(0)) / error)
        want.append(np.where(most >= min(quality.LEVELS), most, 0))
    want = np.array(want)
    assert set(np.flatnonzero(want.any(0)).tolist()) == set(got) != set()
    assert all(s == pytest.approx(want[:, f].tolist(), rel=1e-6) for f, s in got.items())


def test_quality_fit_against_a_plain_solver():
    """The penalised likelihood of a small sample, by loops and by coordinate search, against that of fit()."""
    r = np.random.default_rng(2)
    grades = r.integers(0, 3, 50)
    rows = [(np.flatnonzero(r.random(4) < np.array([0.8 - 0.3 * g, 0.7 - 0.2 * g, 0.3, 0.2 + 0.2 * g])), None) for g in grades]
    rows = [(f, np.ones(len(f))) for f, _ in rows]
    spread, ridge = np.zeros(1 << quality.BITS), 0.01
    spread[:4] = 1
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def loss(w, t):
        total = ridge / 2 * sum(x * x for x in w)
        for (f, _), g in zip(rows, grades, strict=True):
            z = sum(w[k] for k in f)
            above = [1.0, *(sigmoid(z - x) for x in t), 0.0]
            total -= np.log(max(above[g] - above[g + 1], 1e-12)) / len(rows)
        return total

    w, t, step = [0.0] * 4, [-2.0, -1.0], 0.5
    while step > 1e-4:
        better = False
        for params, k in [*((w, i) for i in range(4)), *((t, i) for i in range(2))]:
            for way in (step, -step):
                before, old = loss(w, t), params[k]
                params[k] = min(0.0, old + way) if params is w else old + way
                if t[0] < t[1] and loss(w, t) < before - 1e-12:
                    better = True
                else:
                    params[k] = old
        step = step if better else step / 2
    model = quality.fit(rows, grades, 3, spread, ridge=ridge)
    assert loss(model.weights[:4].tolist(), model.thresholds.tolist()) <= loss(w, t) + 1e-4
    assert np.abs(model.weights[:4] - w).max() < 0.05 and np.abs(model.thresholds - t).max() < 0.05


def test_quality_scores_are_sums_over_features(spark):
    """The score of a text, added up feature by feature, and its probabilities."""
    r = np.random.default_rng(4)
    model = quality.Model(-r.random(1 << quality.BITS).astype(np.float32) / 50, np.array([-3.0, -2.0]))
    texts = ["One two two THREE!!", "", "word " * 300, None, "x" * 5000 + " AAAA1111"]
    got = {x.doc_id: x.rating for x in quality.scored(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        own = (t or "").split()
        features = [quality.word_features(w) for w in own]
        z = sum(model.weights[k] for k in {f[0] for f in features})
        counts = collections.Counter(k for f in features for k in f[1:])
        counts[quality.AGAIN] += sum(a == b for a, b in zip(own, own[1:]))
        z += sum(model.weights[k] * quality.SHARE_SCALE * (n / max(1, len(own))) ** 0.5 for k, n in counts.items())
        above = [1 / (1 + np.exp(x - z)) for x in model.thresholds]
        assert got[i].expected_grade == pytest.approx(sum(above), rel=1e-4) and got[i].p_top == pytest.approx(above[1], rel=1e-4)


def test_quality_sample_is_bounded_by_rows(spark):
    """Identifiers that many documents share don't let in more rows than the sample holds."""
    rows = [(i % 3, f"text {i}", "s") for i in range(90)]
    taken, real = [], quality.fit
    labels = spark.createDataFrame([(i, int(i != 1), 0) for i in range(3)], "doc_id long, quality int, toxic int")
    quality.fit = lambda rows, grades, *a, **b: (taken.append(len(rows)), real(rows, grades, *a, **b))[1]
    try:
        quality.train(docs(spark, rows), quality.grades_of(labels), sample=10)
    finally:
        quality.fit = real
    assert max(taken) == taken[-1] == 10


def test_quality_held_out(spark):
    """Rows of the test tables that the fit hasn't seen: low, toxic and clean ones."""
    at = "/root/testdata/sf0.1"
    grades = quality.grades_of(spark.read.parquet(f"{at}/labels.parquet"))
    documents = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(4)) == 0
    model = quality.train(documents, grades.filter(~held))
    asked = documents.join(grades.filter(held), F.col("doc_id") == F.col("id"))
    found = quality.scored(asked, model).groupBy("grade").agg(F.avg((F.col("rating.p_top") < 0.5).cast("int")).alias("rejected")).collect()
    rejected = {r.grade: r.rejected for r in found}
    assert rejected[0] >= 0.9 and rejected[1] >= 0.85 and rejected[2] <= 0.03


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert mixing.mix_copies(none).count() == 0 and mixing.mix(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert jaccard_join.near_duplicates(none).count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.search(vectors, vectors).count() == 0
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert secrets.scan_secrets(none, secrets.train(secrets.labelled_samples(none))).count() == 0
    grades = quality.grades_of(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.scored(none, quality.train(none, grades)).count() == 0


def test_all_null_columns(spark):
    rows = docs(spark, [(None, None, None)] * 3)
    assert exact_dedup.exact_dedup(rows).count() == 3
    assert [r.taken for r in mixing.mix_copies(rows).collect()] == [0, 0, 0]
    assert [r.n_words for r in substring_dedup.remove_repeats(rows).collect()] == [0, 0, 0]
    assert [(r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(rows).collect()] == [(0, None)] * 3
    assert [r.length for r in packing.pack(rows, tokenizer_path()).collect()] == [1, 1, 1]
