"""Whitening and nearest neighbours against exact arithmetic and brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from riskloom.llm import vantage, whitening
from tests.llm.cases import rows

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string, v int, component string, score string"
NAN, INF = float("nan"), float("inf")


def table(spark, vectors, kind="float"):
    """(id, vector) rows beside columns that clash with the operators' own names."""
    data = [(i, v, 0, "x", "i", 1, "c", "s") for i, v in vectors]
    return spark.createDataFrame(data, SCHEMA.replace("<float>", f"<{kind}>"))


def odd_vectors(dims=5, n=60, seed=4):
    """Ties, repeated rows and ids, copies, zero vectors, nulls, other lengths and values that are no numbers."""
    rng = np.random.default_rng(seed)
    good = [(i, [float(x) for x in np.round(rng.normal(size=dims) * 4) / 8]) for i in range(n)]
    copies = [(n + i, good[7][1]) for i in range(40)] + [good[7], good[7], (3, good[9][1])]
    bad = [(500, None), (501, []), (502, [1.0] * (dims - 1)), (503, [None] * dims), (504, [NAN] + [1.0] * (dims - 1)), (505, [1.0] * (dims - 1) + [-INF]), (506, [1.0, None, 1.0, 1.0, 1.0])]
    return good + copies + bad + [(507, [0.0] * dims), (508, [-0.0] * dims), (None, good[3][1])]


def usable(vectors, dims=5):
    return [(i, v) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


# whitening


def exact_fit(vectors):
    """Distinct whole vectors, their sums, and the covariance as fractions."""
    x = {i: tuple(math.floor(256 * c) for c in v) for i, (_, v) in enumerate(vectors)}
    fit = sorted(set(x.values()))
    n, dims = len(fit), len(fit[0])
    sums = [sum(r[k] for r in fit) for k in range(dims)]
    away = [[Fraction(n * r[k] - sums[k], n) for k in range(dims)] for r in fit]
    cov = [[sum(r[i] * r[j] for r in away) / n for j in range(dims)] for i in range(dims)]
    return x, n, sums, cov


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening(spark, kind):
    vectors = odd_vectors()
    docs, kept = table(spark, vectors, kind), usable(vectors)
    x, n, sums, cov = exact_fit(kept)
    model = whitening.fit_whitening(docs)
    assert (model.n, model.sums) == (n, sums)
    assert (model.covariance == np.array([[float(c) for c in r] for r in cov])).all()  # each entry rounded once
    values = np.linalg.eigvalsh(model.covariance)[::-1]
    got = whitening.whiten(docs, model).collect()
    assert len(got) == 4 * len(kept)
    assert sorted((repr(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted(
        (repr(i), sum((n * c - s) ** 2 for c, s in zip(x[k], sums))) for k, (i, _) in enumerate(kept)
    )
    w = {}
    for r in got:
        assert r["n"] == n and r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(model.covariance), rel=1e-12)
        assert r["identity_error"] == model.identity_error < 1e-9
        w[r["vec_id"], r["component"], r["deviation"]] = r["whitened"]
    # the components are eigenvectors of the exact covariance, and the values their projections
    for k in range(4):
        assert np.allclose(model.covariance @ model.components[k], values[k] * model.components[k], atol=1e-9 * values[0])
        for at, (i, _) in enumerate(kept):
            away = [c - s / n for c, s in zip(x[at], sums)]
            assert w[i, k + 1, sum((n * c - s) ** 2 for c, s in zip(x[at], sums))] == pytest.approx(np.dot(away, model.components[k]) / math.sqrt(values[k]), abs=1e-9)
    assert all(len(r) == len(rows(whitening.whiten(docs, model), "vec_id")[0]) for r in rows(whitening.whiten(docs, model), "vec_id"))


def test_whitening_of_great_entries(spark):
    """Sums beyond a long stay exact; a deviation beyond a long is null, an entry beyond one is its end."""
    great = [(1, [1e12, 1.0]), (2, [-1e12, 2.0]), (3, [3e11, -7.0]), (4, [1e300, 1.0]), (5, [-1e300, 0.5])]
    model = whitening.fit_whitening(table(spark, great[:3], "double"))
    x, n, sums, cov = exact_fit(great[:3])
    assert (model.n, model.sums) == (n, sums) and (model.covariance == np.array([[float(c) for c in r] for r in cov])).all()
    assert {r["deviation"] for r in whitening.whiten(table(spark, great[:3], "double"), model).collect()} == {None}
    wide = whitening.fit_whitening(table(spark, great, "double"))
    assert wide.n == 5 and wide.sums[0] == sum(math.floor(256 * v[0]) for _, v in great[:3]) + (2**63 - 1) - 2**63
    assert whitening.whiten(table(spark, great, "double"), wide).count() == 10


def test_whitening_without_variance(spark):
    one = table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])
    got = whitening.whiten(one, whitening.fit_whitening(one)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, None)] * 4
    line = table(spark, [(i, [float(i), 2.0, 2.0 * i]) for i in range(5)])
    got = whitening.whiten(line, whitening.fit_whitening(line)).collect()
    assert len(got) == 15 and all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert got[0]["identity_error"] < 1e-12
    for empty in ([], [(1, None), (2, [])]):
        assert whitening.whiten(table(spark, empty), whitening.fit_whitening(table(spark, empty))).count() == 0


def test_sums_carry_over(spark):
    """Longs are emptied into whole numbers before they run over."""
    total, big = whitening.Total(2), 2**61
    for _ in range(9):
        total.add(big, lambda kind: np.array([big, -big]).astype(kind))
    total.add(2**70, lambda kind: np.array([2**70, 1], dtype=kind))
    batch = total.rows([(0, 0), (1, 1)]).to_pydict()
    back = {}
    for i, digit, value in zip(batch["i"], batch["digit"], batch["value"]):
        back[i] = back.get(i, 0) + (value << (whitening.DIGITS * digit))
    assert back == {0: 9 * big + 2**70, 1: 1 - 9 * big}


# nearest neighbours


def brute(vectors, asked, k, dims=5):
    """Every query against every candidate, by distance and id; of an id its nearest vector."""
    points = sorted({(i, tuple(np.float32(x) for x in v)) for i, v in usable(vectors, dims) if i is not None and any(v)})
    out = []
    for q, own in points:
        if not asked(q):
            continue
        near = {}
        for i, v in points:
            if i != q:
                d = math.sqrt(float(((np.array(own, float) - np.array(v, float)) ** 2).sum()))
                near[i] = min(near.get(i, INF), d)
        best = sorted((d, i) for i, d in near.items())[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("k", "shard", "full"), [(3, 1 << 19, 1 << 24), (10, 60, 1 << 24), (10, 60, 40), (200, 100, 1 << 24)])
def test_factor_one_is_exact(spark, monkeypatch, k, shard, full):
    """One shard, many shards, and shards cut by a hash; fewer candidates than k are all found."""
    monkeypatch.setattr(vantage, "SHARD_VALUES", shard)
    monkeypatch.setattr(vantage, "FULL_SHARD", full)
    vectors = odd_vectors()
    docs = table(spark, [x for x in vectors if x != (3, vectors[9][1])])
    got = vantage.nearest(docs, docs.filter("vec_id % 3 = 0"), k, relax=1.0)
    want = brute([x for x in vectors if x != (3, vectors[9][1])], lambda i: i % 3 == 0, k)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_an_id_with_several_vectors(spark):
    vectors = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.5]), (3, [5.0, 0.0])]
    docs = table(spark, vectors)
    assert sorted(tuple(r) for r in vantage.nearest(docs, docs.filter("vec_id = 3"), 5, relax=1.0).collect()) == [(3, 1, 1, 4.0), (3, 2, 2, math.sqrt(26))]
    assert {r["vec_id"] for r in vantage.nearest(docs, docs.filter("vec_id = 1"), 5, relax=1.0).collect()} == {2, 3}


def test_no_vectors_and_other_lengths(spark):
    docs = table(spark, [(1, None), (2, []), (3, [0.0, 0.0]), (None, [1.0, 1.0])])
    assert vantage.nearest(docs, docs).count() == 0
    docs = table(spark, [(1, [1.0, 2.0])])
    assert vantage.nearest(docs, docs).count() == 0
    assert vantage.nearest(docs, table(spark, [(9, [1.0, 2.0, 3.0])])).count() == 0
    assert vantage.nearest(docs, table(spark, [])).count() == 0


def test_equal_vectors_are_cut_into_halves():
    """A node of equal rows still gets smaller, and ties all come back in the order of the rows."""
    search = vantage.Search(np.ones((2000, 3)), 5, 1.0)
    q, found, d = search.nearest(np.ones((2, 3)), np.full(2, np.inf))
    assert found.tolist() == [0, 1, 2, 3, 4] * 2 and not d.any()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    """The registered query against all distances."""
    from riskloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    exact = vantage.nearest(docs, docs.filter("vec_id % 100 = 0"), relax=1.0)
    raw = docs.toPandas()
    matrix, ids = np.stack(raw["embedding"]).astype(float), raw["vec_id"].to_numpy()
    live = matrix.any(axis=1)
    want = []
    for q in ids[live & (ids % 100 == 0)]:
        d = np.sqrt(((matrix - matrix[ids == q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q and live[j]][:10]
        want += [(q, r + 1, ids[j]) for r, j in enumerate(order)]
    assert rows(exact, "query_id", "rank", "vec_id") == sorted(want, key=repr)
    found = QUERIES["op12_nearest_neighbours"](spark, f"/root/testdata/{sf}")
    assert vantage.recall(found, exact) >= 0.9
    assert all(r["score"] == pytest.approx(np.linalg.norm(matrix[ids == r["query_id"]][0] - matrix[ids == r["vec_id"]][0])) for r in found.collect())


def test_greater_factors_compare_less():
    rng = np.random.default_rng(1)
    data, queries = rng.normal(size=(6000, 6)), rng.normal(size=(50, 6))
    seen = []
    for relax in (1.0, 2.0, 4.0):
        search = vantage.Search(data, 5, relax)
        search.nearest(queries, np.full(50, np.inf))
        seen.append(search.compared)
    assert seen[0] < 50 * 6000 and seen[0] > seen[1] > seen[2]
