"""Token counts, source divergence and vector codes against brute force, with their edge cases; word counts, salts and blocks."""

import collections
import hashlib
import json
import random
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from compare import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelake.llm import divergence, jaccard_join, mixing, substring_dedup, token_counts, vector_codes
from tidelake.llm.common import word_count

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_tokens string, term string, n long, salt int, id int, number int"


def docs(spark, rows):
    """(id, text, lang, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 3, 4, 5, 6) for r in rows], DOCS)


# Token counts


def odd_texts(n, seed=5):
    r = random.Random(seed)
    signs = [*"ab 's  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　᠎ ​—é中文字12ٻ٣'<|>", "<|endoftext|>", "'re ", "'S", "don't", "  \n", " ", "﻿", "😀", "á", "\x00", "ſ", "İ"]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_token_counts_are_the_librarys(spark):
    texts = [*odd_texts(4000), None, "", "a" * 300_000, "x " * 100_000, " " * 50_000, "中" * 20_000]
    rows = [(i, t, "l", "s") for i, t in enumerate(texts)] + [(None, "no id", None, None), (0, texts[0], "l", "s")]
    got = token_counts.count_tokens(docs(spark, rows), BYTE_BPE, step=300).collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    length = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n, n > 512) for i, t, *_ in rows for n in [length(t)]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(docs(spark, []), BYTE_BPE).count() == 0
    assert [tuple(x) for x in token_counts.count_tokens(docs(spark, [(1, None, None, None)]), BYTE_BPE, limit=0).collect()] == [(1, 0, 0, False)]


def test_token_counts_of_the_table(spark):
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.read.parquet(f"{SF}/documents.parquet"), BYTE_BPE).withColumnRenamed("id", "doc_id").collect()}
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 512)


def test_only_strings_that_merge_to_themselves_are_whole(spark, tmp_path):
    """A vocabulary string that no merge reaches isn't proved, and isn't counted as one token."""
    data = json.loads(Path(BYTE_BPE).read_text(encoding="utf-8"))
    last = max(data["model"]["vocab"].values())
    data["model"]["vocab"]["Ġqzxqzx"] = last + 1
    text = json.dumps(data)
    proved = np.unpackbits(np.frombuffer(token_counts.prove_whole(text), np.uint8))
    assert not proved[last + 1] and proved[data["model"]["vocab"]["Ġthe"]]
    table = token_counts.StretchCounts(text, token_counts.prove_whole(text))
    assert table.counts([b" qzxqzx", b" the"]).tolist() == [len(Tokenizer.from_str(text).encode(" qzxqzx", add_special_tokens=False).ids), 1]
    assert table.counts([b" qzxqzx"]).tolist()[0] > 1 and table.merged == 1


def test_tokenizers_whose_counts_dont_add_up_are_refused(spark):
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs(spark, []), public_tokenizers.path("word_bpe_49k.json"))
    data = json.loads(Path(BYTE_BPE).read_text(encoding="utf-8"))
    data["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        token_counts.check_family(json.dumps(data))


# Source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, least_docs, top):
    count, held, groups = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for k, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall((text or "").translate(LOWER)):
            count[lang, source, t] += 1
            held[lang, t].add(k)
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), d in held.items() if x == lang and len(d) >= least_docs]
        v, total = len(kept), {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s, t] + 5) // (total[s] + 5 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 5) // (sum(total.values()) + 5 * v) for t in kept}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(q[t] - p[s][t], t.encode()) for t in kept if count[lang, s, t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", own, top)):
                out += [(lang, s, part, item.decode(), -f, k + 1) for k, (f, item) in enumerate(sorted(items)[:most])]
    return sorted(out)


def corpus(seed=3, n=300):
    r = random.Random(seed)
    words = [r.choice("abcdé中Z") * r.randint(1, 3) + r.choice("xyÄ") for _ in range(60)]
    rows = [(i, " ".join(r.choice(words[: r.choice((5, 20, 60))]) for _ in range(r.randint(0, 25))), r.choice(["en", "de", None]), f"s{r.choice((0, 0, 0, *range(11)))}") for i in range(n)]
    return [*rows, (None, None, "en", "silent"), (1, "1 2 3 [] {} \x00", "de", None), (7, "one doc only", "rare", "a"), (8, None, "rare", "b"), (3, rows[3][1], rows[3][2], rows[3][3])]


@pytest.mark.parametrize(("light", "block", "tile_terms"), [(2, 4, 3), (0, 128, 512), (99, 5, 7), (8, 128, 512)])
def test_divergence(spark, light, block, tile_terms):
    rows = corpus()
    got = divergence.audit(docs(spark, rows), least_docs=4, top=6, light=light, block=block, tile_terms=tile_terms, salts=3).collect()
    assert sorted(map(tuple, got)) == audited(rows, 4, 6)


def test_divergence_of_little(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    rows = [(1, None, None, None), (2, "A a B", None, "s"), (3, "Ab,a", None, "t")]
    assert sorted(map(tuple, divergence.audit(docs(spark, rows)).collect())) == audited(rows, 30, 50)  # no term is kept
    assert sorted(map(tuple, divergence.audit(docs(spark, rows), least_docs=1).collect())) == audited(rows, 1, 50)
    long = [(1, "word " * 300_000 + "x" * 100_000, "en", "a"), (2, "word", "en", "b")]
    assert sorted(map(tuple, divergence.audit(docs(spark, long), least_docs=1).collect())) == audited(long, 1, 50)


def test_smoothed_shares_are_exact(spark):
    """Products that pass 64 bits."""
    values = [(0, 1, 1), (10**13 + 7, 10**14 + 3, 12_345_678), (2**62, 2**62 + 5, 3)]
    got = spark.createDataFrame(values, "c long, n long, v long").select(divergence.smoothed(F.col("c"), F.col("n"), F.col("v")).alias("p"), "c").collect()
    assert {r.c: r.p for r in got} == {c: 1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in values}


# Vector codes


def coded(rows, parts=4, entries=256, rounds=4):
    """All in Python's whole numbers."""
    sound = [(i, [int(np.floor(np.float64(1024) * np.float64(c))) for c in v], label) for i, v, label in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(sound[0][1]) // parts
    own = [[v[p * size : (p + 1) * size] for _, v, _ in sound] for p in range(parts)]
    books = [x[:entries] for x in own]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda p: [min((far(v, b), k) for k, b in enumerate(books[p])) for v in own[p]]
    for _ in range(rounds):
        for p in range(parts):
            found, fresh = [k for _, k in assign(p)], list(books[p])
            for k in set(found):
                members = [v for v, f in zip(own[p], found, strict=True) if f == k]
                fresh[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
            books[p] = fresh
    last = [assign(p) for p in range(parts)]
    errors = [sum(last[p][k][0] for p in range(parts)) for k in range(len(sound))]
    labels = collections.Counter()
    for (_, _, label), e in zip(sound, errors, strict=True):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{last[p][k][1]:02x}" for p in range(parts)), errors[k], labels[label], digest) for k, (i, _, label) in enumerate(sound)], key=str)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "b", "c", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, ids string, code string, error int")


def vector_rows(n, dims=8, seed=2):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(r.normal(size=dims) * 2) / 4], int(r.integers(0, 3)) or None) for i in r.permutation(n)]
    return [*rows, (5000, None, 1), (5001, [1.0, None] * (dims // 2), 1), (5002, [float("nan")] * dims, 2), (5003, [float("inf")] * dims, None), rows[4], (None, rows[5][1], 2), (rows[6][0], rows[7][1], 1), (5004, [], 1)]


@pytest.mark.parametrize(("n", "entries"), [(400, 256), (400, 7), (20, 256)])
def test_vector_codes(spark, n, entries):
    rows = vector_rows(n)
    got = vector_codes.compress(vectors(spark, rows).repartition(5), entries=entries, rows_a_block=37, label_salts=3).collect()
    assert sorted(map(tuple, got), key=str) == coded(rows, entries=entries)


def test_vector_codes_of_wide_numbers(spark):
    """Distances beyond 64 bits within a round, errors within them."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(3, 8)) * 1e13
    rows = [(i, [float(x) for x in centres[i % 3] + r.normal(size=8) * 1000], i % 2) for i in range(60)]
    assert vector_codes.fit(vectors(spark, rows, "double"), entries=3).kind is object
    got = vector_codes.compress(vectors(spark, rows, "double"), entries=3).collect()
    assert sorted(map(tuple, got), key=str) == coded(rows, entries=3)


def test_vector_codes_of_nothing_and_of_mixed_lengths(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1), (2, [None] * 8, None)])).count() == 0
    for rows in ([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1.0] * 6, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(vectors(spark, rows))


def test_codebooks_dont_depend_on_partitions(spark):
    rows = vectors(spark, vector_rows(300))
    one, other = (vector_codes.fit(rows.repartition(n), entries=16, depth=d).codebooks.digest() for n, d in ((1, 2), (23, 3)))
    assert one == other


# Shared parts


def test_words_are_counted_as_by_the_contract(spark):
    r = random.Random(9)
    signs = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0   　aé😀"
    texts = [None, "", " ", "a \x85", "a  ", "a\t ", "\x85 a", "a\n", *("".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(3000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", word_count(F.col("text")).alias("n"))
    got = {x.i: x.n for x in frame.collect()}
    assert all(got[i] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts))


def test_salts_of_regular_and_of_text_identifiers(spark):
    for ids in (F.col("id") * 256, F.concat(F.lit("doc-"), F.col("id"))):
        sizes = [r["count"] for r in spark.range(10_000).select(mixing.hashed_salt(ids, 256).alias("s")).groupBy("s").count().collect()]
        assert len(sizes) == 256 and max(sizes) < 100
    text = spark.createDataFrame([("a", "x y z", "s"), ("b", "x", "s"), (None, "x x", None)], "doc_id string, text string, source string")
    assert sorted((r.size, r.source_size) for r in mixing.mix_copies(text).collect()) == [(1, 4), (2, 2), (3, 4)]


def test_blocks_outlive_a_change_of_cores(spark):
    """Passes that are planned with other numbers of splits see the same blocks."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes")

    def run(first, later):
        try:
            spark.conf.set(keys[0], first)
            lazy = substring_dedup.remove_repeats(table)
            spark.conf.set(keys[0], later)
            spark.conf.set(keys[1], "100k")
            return sorted(map(tuple, lazy.collect()), key=str)
        finally:
            for k in keys:
                spark.conf.unset(k)

    before = run(2, 2)
    assert before == run(4, 64) == run(64, 3)
    one = sorted(map(tuple, jaccard_join.near_duplicates(table).collect()))
    spark.conf.set(keys[0], 64)
    try:
        assert sorted(map(tuple, jaccard_join.near_duplicates(table).collect())) == one
    finally:
        spark.conf.unset(keys[0])


def test_batch_sizes_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    substring_dedup.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert spark.conf.get(key) == before
