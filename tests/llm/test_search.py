"""Nearest neighbours and exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfindex.llm import ann, exact_search
from tests.llm.conftest import vectors

ODD = [(9001, None), (9002, [0.0] * 12), (9003, [1.0, None] + [0.0] * 10),
       (9004, [float("nan")] + [1.0] * 11), (9005, [float("inf")] + [1.0] * 11), (9006, []),
       (9007, [1.0, 2.0])]


def test_neighbours_recall_and_scores(embeddings):
    data = vectors(600)
    table = embeddings(list(enumerate(data)) + ODD).withColumn("score", F.lit(1))
    got = ann.nearest_neighbours(table, F.col("vec_id") % 50 == 0, 5).collect()
    exact = data.astype(float)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        cosines = unit @ unit[q]
        assert np.allclose([r.score for r in own], [cosines[r.vec_id] for r in own], atol=1e-12)
        cosines[q] = -2
        hit += len(set(np.argsort(-cosines)[:5]) & {r.vec_id for r in own})
    assert {r.query_id for r in got} == set(range(0, 600, 50))
    assert hit / 60 >= 0.9


def test_pigeonhole_retrieves_every_code_within_the_radius():
    words = np.random.default_rng(1).integers(0, 256, size=(3000, 8), dtype=np.uint8)
    index = ann.SubstringIndex(words)
    for radius in (5, 17, 24):
        masks = ann.flips(8, radius // 8)
        for word in words[:20]:
            want = np.flatnonzero(ann.hamming(words, word) <= radius)
            assert np.array_equal(index.within(word, radius, masks), want)


def test_few_candidates_ties_and_empty(embeddings):
    table = embeddings([(0, [1, 0]), (7, [1, 1]), (3, [2, 2]), (5, [-1, 0])])
    got = ann.nearest_neighbours(table, F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 7, 5]
    assert ann.nearest_neighbours(embeddings([]), F.col("vec_id") == 0, 5).count() == 0
    assert ann.nearest_neighbours(embeddings([(0, [1, 0])]), F.col("vec_id") == 0, 5).count() == 0


def test_exact_products(embeddings):
    data = np.vstack([vectors(700, 8, 3), np.ones((3, 8), np.float32)])
    rows = list(enumerate(data)) + [(9001, None), (9002, [float("nan")] * 8), (8000, [0.0] * 8)]
    got = exact_search.top_products(embeddings(rows), F.col("vec_id") % 100 == 0, 10).collect()
    whole = {i: np.floor(1024 * np.asarray(v, dtype=float)).astype(np.int64)
             for i, v in rows if i not in (9001, 9002)}
    for q in [*range(0, 703, 100), 8000]:
        want = sorted(((-int(v @ whole[q]), i) for i, v in whole.items() if i != q))[:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(-r.score, r.vec_id) for r in own] == want


def test_bounds_hold_every_product():
    exact = exact_search.integers(vectors(500, 6, 9))
    lower, upper = exact_search.Approximation(exact).bounds(exact[:40].astype(float))
    products = exact[:40] @ exact.T
    assert (lower <= products).all() and (products <= upper).all()


def test_exact_search_of_nothing(embeddings):
    assert exact_search.top_products(embeddings([]), F.col("vec_id") == 0, 10).count() == 0


def test_repeated_ids_missing_ids_and_mixed_dimensions(embeddings):
    rows = [(50, [1, 0]), (50, [1, 0.5]), (None, [1, 0.1]), (7, [1, 0, 0]), (100, [1, 0.2, 0]),
            (100, [0, 1, 0]), (3, [0, 1, 0])]
    table = embeddings(rows).withColumn("row", F.lit(0)).withColumn("size", F.lit("x"))
    for search in (ann.nearest_neighbours, exact_search.top_products):
        got = search(table, F.col("vec_id") % 50 == 0, 5).collect()
        flat = sorted((r.query_id, r["rank"], -1 if r.vec_id is None else r.vec_id) for r in got)
        assert [f[:2] for f in flat] == sorted(
            [(50, 1), (50, 2)] * 2 + [(100, 1), (100, 2), (100, 3)] * 2)
        assert {f[2] for f in flat if f[0] == 50} == {50, -1}
        assert {f[2] for f in flat if f[0] == 100} == {100, 7, 3}


def test_products_beyond_a_long(embeddings):
    table = embeddings([(0, [3e6, 3e6]), (1, [3e6, 3e6]), (2, [1.0, 1.0])])
    with pytest.raises(Exception, match="does not fit a long"):
        exact_search.top_products(table, F.col("vec_id") == 0, 1).collect()
    exact = exact_search.integers(np.array([[1e15, -1e15], [1e16, 1e16], [2.0, 1.0]]))
    query = exact_search.integers(np.array([[4.0, 4.0]]))[0]
    assert list(exact_search.products(exact, query)) == [
        0, 2 * int(1024 * 1e16) * 4096, 4096 * 3072]
    big = embeddings([(0, [2e15, 2e15]), (1, [1e15, -1e15]), (2, [1e-3, 0.0])])
    got = exact_search.top_products(big, F.col("vec_id") == 0, 1).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, int(np.float32(2e15)) * 1024)]
