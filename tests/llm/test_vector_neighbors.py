"""Neighbours against brute force."""

import numpy as np
import pytest

from strataloom.llm import vector_neighbors as vn


def brute(ids, x, k, floor):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    out = set()
    for i in range(len(ids)):
        near = sorted((-sims[i, j], ids[j]) for j in range(len(ids)) if j != i and sims[i, j] >= floor)[:k]
        out |= {(min(ids[i], j), max(ids[i], j)) for _, j in near}
    return {(int(a), int(b)) for a, b in out}


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    near = np.concatenate([base[:400] + rng.normal(size=(400, 64)) * s for s in (0.1, 0.2, 0.3)])
    x = np.concatenate([base, near * rng.uniform(0.01, 50, size=(len(near), 1)), np.repeat(base[:2], 40, axis=0)]).astype(np.float32)
    return np.arange(len(x)) * 3 + 1, x


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(y) for y in v], 0, 1) for i, v in zip(ids, x)], "id bigint, embedding array<float>, cell int, salt int")


def test_recall_against_brute_force(spark, planted):
    ids, x = planted
    want = brute(ids, x.astype(np.float64), 5, 0.9)
    got = {(r.id_a, r.id_b) for r in vn.neighbor_pairs(vn.nearest_neighbors(frame(spark, ids, x), "id", "embedding")).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)


def test_copies_cost_no_pairs_and_ties_go_to_the_smaller_id(spark):
    v = np.eye(64, dtype=np.float32)
    ids = list(range(30)) + [100, 101]
    x = np.concatenate([np.repeat(v[:1], 30, axis=0), v[1:2], v[1:2] * 7])
    got = {(r.id_a, r.id_b) for r in vn.neighbor_pairs(vn.nearest_neighbors(frame(spark, ids, x), "id", "embedding")).collect()}
    assert got == brute(np.array(ids), x.astype(np.float64), 5, 0.9)


def test_unusable_vectors_nulls_and_empty(spark):
    ok = [1.0] + [0.0] * 63
    df = spark.createDataFrame([(1, ok), (2, ok), (2, ok), (3, None), (4, [1.0]), (5, [0.0] * 64), (6, [float("nan")] + [0.0] * 63), (7, [float("inf")] + [0.0] * 63), (None, ok), (8, [None] + [1.0] * 63), (9, [1e38] + [0.0] * 63), (10, [1e-40] + [0.0] * 63)], "id bigint, embedding array<float>")
    got = {(r.id_a, r.id_b) for r in vn.neighbor_pairs(vn.nearest_neighbors(df, "id", "embedding")).collect()}
    assert got == {(a, b) for a in (1, 2, 9, 10) for b in (1, 2, 9, 10) if a < b}
    assert vn.nearest_neighbors(df.limit(0), "id", "embedding").count() == 0


def test_a_hot_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vn, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    x = (np.ones((300, 64)) + rng.normal(size=(300, 64)) * 0.3).astype(np.float32)
    ids = np.arange(300)
    got = {(r.id_a, r.id_b) for r in vn.neighbor_pairs(vn.nearest_neighbors(frame(spark, ids, x), "id", "embedding")).collect()}
    want = brute(ids, x.astype(np.float64), 5, 0.9)
    assert len(want & got) >= 0.95 * len(want)


def test_anisotropic_codes_err_less_along_the_vector():
    rng = np.random.default_rng(0)
    x = vn._unit(rng.normal(size=(3000, 64)))
    books = vn.anisotropic_codebooks(x)
    along = {}
    for weight in (1.0, vn.parallel_weight(64)):
        code = vn.encode_codes(x, books, weight)
        chosen = books[np.arange(vn.SUB)[None], code].reshape(len(x), 64)
        along[weight] = np.abs(((x - chosen) * x).sum(1)).mean()
    assert along[vn.parallel_weight(64)] < along[1.0]
    scores = vn.scan_tables(x[:5].astype(np.float32), vn.encode_codes(x, books, 2.6), books)
    assert np.abs(scores - (x[:5] @ x.T)).mean() < 0.06


def test_pruning_a_dense_block_loses_nothing():
    rng = np.random.default_rng(4)
    x = rng.normal(size=64) + rng.normal(size=(2400, 64)) * 0.15
    unit, ids, is_row = vn._unit(x), np.arange(2400), np.arange(2400) < 1000
    got = set(zip(*(v.tolist() for v in vn.block_pairs(ids, x, is_row, vn.anisotropic_codebooks(unit[:500]), 0.9, 5)[:2])))
    sims = np.stack([np.round((unit * unit[r]).sum(1), 6) for r in range(1000)], axis=1)  # (queries, rows)
    sims[np.arange(1000), np.arange(1000)] = -1
    assert (sims >= 0.9).sum() > 2_000_000
    by_query = {(q, r) for q in range(2400) for r in np.lexsort((np.arange(1000), -sims[q]))[:5].tolist()}
    by_row = {(r, q) for r in range(1000) for q in np.lexsort((np.arange(2400), -sims[:, r]))[:5].tolist()}
    assert got == by_query | by_row
