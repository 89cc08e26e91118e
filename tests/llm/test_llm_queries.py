"""Queries of the training-data operators against their SQL, and the pipeline stage by stage."""

import collections

import pytest
from compare import SF, connect, same

from tidelake.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    same(spark, connect(), queries.queries()[name], queries.oracle_sql()[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(step(spark, docs, SF), "test")
        assert docs.columns == columns
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    assert 0 < len(kept["quality"]) < len(before) and all(before[i] == t for rows in kept.values() for i, t in rows)
    texts = collections.Counter(" ".join(t.split()) for _, t in kept["exact_dedup"])
    assert max(texts.values()) == 1 and len(texts) == len({" ".join(t.split()) for _, t in kept["quality"]})
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(t.lower().split()) for _, t in kept["near_dedup"] if t.split()]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert {i for i, _ in kept["near_dedup"]} <= {i for i, _ in kept["exact_dedup"]}
    copies = collections.Counter(i for i, _ in kept["mixing"])
    assert set(copies.values()) <= {1, 2}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert collections.Counter(p.doc_id for p in pieces if p.piece == 0) == copies


def test_pipeline_stages_take_any_documents(spark):
    """Null and repeated identifiers, null, empty and repeated texts, columns with names of the operators' own, and no rows at all."""
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, None), (1, base + " x", "a"), (None, base, "a"), (None, None, None), (4, "", "b"), (4, "", "b"), (6, "entirely different words stand in here", "b")]
    schema = "doc_id long, text string, source string, lang string, n_chars long, kept string, run int, label string, node string, id string"
    for some in (rows, []):
        docs = spark.createDataFrame([(i, t, s, "en", 1, "k", 2, "l", "n", "i") for i, t, s in some], schema)
        columns, before = docs.columns, len(some)
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.staged(step(spark, docs, SF), "test")
            assert docs.columns == columns, name
            if name != "mixing":
                assert docs.count() <= before
                before = docs.count()
        if some:
            assert docs.select("kept", "run", "id").distinct().collect() in ([("k", 2, "i")], [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0
