"""Vector operators against brute force, on odd rows and on the given tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import descent, neighbours
from tokenloom.llm.hilbert import hilbert_keys

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def odd_vectors(llm):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(60)]  # many copies of one vector
    rows += [(200 + i, [2 * x for x in rows[7][1]]) for i in range(3)]  # the same direction
    rows += [
        (300, None),
        (301, [0.0] * 6),
        (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
        (303, [math.nan, 1.0, 0.0, 0.0, 0.0, 0.0]),
        (304, [math.inf, 1.0, 0.0, 0.0, 0.0, 0.0]),
        (305, [1.0, 2.0]),
        (306, []),
        (5, rows[5][1]),
        (None, rows[5][1]),
    ]
    df = llm.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.lit(0) for n in ("rid", "v", "n", "u", "id", "query", "score", "rank")}), rows


def good(rows):
    out = {}
    for i, v in rows:
        if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            out[i] = np.float32(v).astype(float)
    return out


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2), (5, 1)])
def test_curve_visits_all_cells_by_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def nearest(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_search_odd_rows(odd_vectors):
    df, rows = odd_vectors
    found = neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    vectors = good(rows)
    want = nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        exact = sum(float(a) * float(b) for a, b in zip(vectors[r["query_id"]], vectors[r["vec_id"]]))
        assert r["score"] == pytest.approx(exact, abs=1e-12)
    assert got == want
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.search(df, F.lit(False)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert neighbours.search(few, F.col("vec_id") == 0).count() == 2


def test_search_recall_with_narrow_blocks(llm, monkeypatch):
    """Windows of several blocks, on vectors in clusters."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16)) * 3
    v = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32)
    df = llm.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], SCHEMA)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(score, -np.inf)
    hits = sum(len(got[q] & set(np.argsort(-score[q])[:10].tolist())) for q in range(0, 1500, 20))
    assert hits >= 0.9 * 750


def linked(vectors, threshold):
    ids = sorted(vectors)
    u = np.array([vectors[i] for i in ids])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))
    for _ in ids:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        if new == root:
            break
        root = new
    return {i: (int(near[k].sum()), ids[root[k]]) for k, i in enumerate(ids)}


def test_near_duplicates_odd_rows(odd_vectors):
    df, rows = odd_vectors
    got = {r["vec_id"]: r for r in descent.near_duplicates(df).collect()}
    want = linked(good(rows), 0.9)
    assert set(got) == {i for i, _ in rows}
    for i, r in got.items():
        n, component = want.get(i, (0, i))
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, component, component == i)
    assert descent.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_with_saturated_lists(llm, monkeypatch):
    """Groups larger than the lists and the blocks, pairs, chains and noise."""
    monkeypatch.setattr(descent, "LIST", 4)
    monkeypatch.setattr(descent, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 32))
    v[:90] = v[0] + 0.05 * rng.normal(size=(90, 32))
    for i in range(100, 140, 2):
        v[i + 1] = v[i] + 0.1 * rng.normal(size=32)
    v = v.astype(np.float32)
    order = rng.permutation(700)
    vectors = {int(order[k]): v[k].astype(float) for k in range(700)}
    df = llm.createDataFrame([(i, [float(x) for x in r]) for i, r in vectors.items()], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in descent.near_duplicates(df).collect()}
    want = linked(vectors, 0.9)
    assert sum(got[i] != want[i] for i in want) == 0


def test_links_between_groups_of_saturated_lists(llm):
    """Two dense groups whose nearest vectors are their own, with links between them."""
    rng = np.random.default_rng(6)
    mid = rng.normal(size=(2, 32))
    mid[0] /= np.linalg.norm(mid[0])
    mid[1] -= mid[0] * (mid[0] @ mid[1])
    mid[1] = 0.915 * mid[0] + (1 - 0.915**2) ** 0.5 * mid[1] / np.linalg.norm(mid[1])
    v = np.concatenate([m + 0.22 / 32**0.5 * rng.normal(size=(150, 32)) for m in mid]).astype(np.float32)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T
    np.fill_diagonal(near, -1)
    lists = np.argsort(-near, axis=1)[:, : descent.LIST]
    assert ((lists < 150) == (np.arange(300) < 150)[:, None]).all() and (near[:150, 150:] >= 0.9).sum() > 100
    assert near[0, 150] < 0.9
    vectors = {i: x.astype(float) for i, x in enumerate(v)}
    df = llm.createDataFrame([(i, [float(x) for x in r]) for i, r in vectors.items()], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in descent.near_duplicates(df).collect()}
    want = linked(vectors, 0.9)
    assert all(got[i] == want[i] for i in want)


def test_pairs_lost_beside_a_hot_group_are_found_in_the_end(llm, monkeypatch):
    """The descent is kept from finding a thing but the hot group."""
    monkeypatch.setattr(descent, "EXTRA", 0)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 32))
    v[:100] = v[0] + 0.05 * rng.normal(size=(100, 32))
    v[101:160:2] = v[100:160:2] + 0.1 * rng.normal(size=(30, 32))
    for place, i in enumerate((200, 205, 206, 202)):  # a chain
        v[i] = np.cos(0.35 * place) * np.eye(32)[0] + np.sin(0.35 * place) * np.eye(32)[1]
    vectors = {i: x.astype(float) for i, x in enumerate(v.astype(np.float32))}
    whole = descent.graph_of
    monkeypatch.setattr(descent, "graph_of", lambda *a: whole(*a).where("a < 100 and b < 100"))
    df = llm.createDataFrame([(i, [float(x) for x in r]) for i, r in vectors.items()], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in descent.near_duplicates(df).collect()}
    want = linked(vectors, 0.9)
    assert all(got[i] == want[i] for i in want) and sum(n == 1 for n, _ in want.values()) >= 60


def test_audit_samples_rare_links(llm, monkeypatch):
    """Six pairs in 6,000 vectors: all are audited, though few rows are drawn."""
    monkeypatch.setattr(descent, "AUDIT_ROWS", 128)
    rng = np.random.default_rng(12)
    v = rng.normal(size=(6000, 32))
    v[1:12:2] = v[0:12:2] + 0.1 * rng.normal(size=(6, 32))
    df = llm.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v.astype(np.float32))], SCHEMA)
    (kind, (n, share, surely)), = descent.measured(df).items()
    assert (kind, n, share) == (1, 12, 1.0) and 0.8 < surely < 1


@pytest.mark.parametrize("whole,n", [(9, 10), (50, 50), (300, 310), (0, 5)])
def test_bound_of_a_share(whole, n):
    """A share at the bound gives as many hits or more with a chance of about 5 %."""
    p = descent._surely(whole, n)
    tail = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(whole, n + 1))
    assert 0 <= p <= whole / n and (whole == 0 or 0.02 < tail < 0.09)
