"""Ranked search by max-sketches against its definition."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trestle.llm import max_sketch

from .conftest import ODD


def found(df, key="item_id"):
    return sorted((r[key], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_ranks_by_definition(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    queries = [(r["doc_id"], r["text"][:300]) for r in documents.where("doc_id % 9 = 0").collect()] + [(-1, "the"), (-2, "zzzz qqqq"), (-3, None), (-4, "")]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    index = max_sketch.build_index(documents)
    wanted = sorted(max_sketch.brute_force(rows, queries))
    assert found(max_sketch.search(index, asked)) == wanted
    assert found(max_sketch.search(index, asked, block_bytes=700)) == wanted  # many blocks


def test_ties_go_by_id_also_among_many_copies(spark):
    docs = spark.range(3000).select((F.lit(2999) - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, "same words here").otherwise(F.concat(F.lit("other w"), "id")).alias("text"))
    asked = spark.createDataFrame([(1, "words HERE"), (2, "Other")], "item_id long, text string")
    rows = [(r[0], r[1]) for r in docs.collect()]
    assert found(max_sketch.search(max_sketch.build_index(docs.repartition(5)), asked)) == sorted(max_sketch.brute_force(rows, [(1, "words here"), (2, "other")]))


def test_odd_rows(spark, odd, none):
    asked = spark.createDataFrame([(None, "text some length", 1, "x"), (7, "東京 naïve 12345", 2, "y"), (7, "东 word", None, None)], "item_id long, text string, rank int, extra string")
    index = max_sketch.build_index(odd)
    out = max_sketch.search(index, asked)
    assert out.columns == ["item_id", "extra", "rank", "doc_id", "score"]
    rows = [(r["item_id"], r["extra"], r["doc_id"]) for r in out.orderBy("extra", "rank").collect()]
    assert rows[:4] == [(7, None, 7), (None, "x", 1), (None, "x", 1), (None, "x", None)]
    assert sorted(rows[4:]) == [(7, "y", 5), (7, "y", 6)]
    with_terms = [r for r in ODD if r[1] and max_sketch.term_counts(r[1].encode())]
    assert index.count() == len(with_terms)
    assert index.where("id = 7").first()["n"] == 30_000
    assert max_sketch.search(index, asked.limit(0)).count() == 0
    assert max_sketch.search(max_sketch.build_index(none), asked).count() == 0


def test_pieces_of_long_texts_cut_no_term(monkeypatch):
    text = " ".join(f"w{i % 97}é" for i in range(5000)).encode()
    whole = max_sketch.term_counts(text)
    monkeypatch.setattr(max_sketch, "PIECE", 13)
    assert max_sketch.term_counts(text) == whole and sum(whole.values()) == 5000


@pytest.mark.parametrize("k", [1, 10])
def test_bounds_hold_and_spare_rescoring(k):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 400)) % 5000).encode() for _ in range(800)]
    batch = max_sketch._indexed(pa.array(range(len(texts)), pa.int64()), texts)
    queries = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, 12) % 5000).encode()) for i in range(20)]
    block = max_sketch.Block(queries)
    df = {i: sum(1 for t in batch.column(2).to_pylist() if h in np.frombuffer(t, np.uint64)) for i, h in enumerate(block.hashes)}
    block.weigh(len(texts), {i: n for i, n in df.items() if n})
    task = max_sketch.Searcher(block, len(texts), sum(batch.column(1).to_pylist()), k)
    ids, n, terms, counts, sketches = (c.to_pylist() for c in batch.columns)
    norms = np.array([max_sketch.length_norm(x, task.docs, task.total) for x in n])
    bound = task.bounds(sketches, norms)
    for d in range(0, len(texts), 7):
        for q in range(len(queries)):
            assert bound[d, q] >= task.exact(q, np.frombuffer(terms[d], np.uint64), np.frombuffer(counts[d], np.uint32), int(norms[d]))
    task.rescored = 0
    task.add(ids, n, terms, counts, sketches)
    assert task.rescored < 0.6 * len(texts) * len(queries)
