import numpy as np
from pyspark.sql import functions as F

from slotledger.llm.embeddings import CosineParams, Quantised, near_vectors, possible
from slotledger.llm.shared import ship
from slotledger.llm.topk import TopKParams, features, top_k

ODD = [[], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [0.0] * 16]


def clustered(count, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, count // 8), dim))
    return centres[rng.integers(0, len(centres), count)] + spread * rng.normal(size=(count, dim))


def test_features_bound_inner_products():
    x = np.floor(20 * np.random.default_rng(1).normal(size=(200, 33)))
    for segments in (1, 4, 16, 33, 50):
        f = features(x, segments)
        assert (f @ f.T + 1e-6 >= x @ x.T).all()


def test_top_k_matches_brute_force(spark):
    ship(spark)
    v = np.floor(8 * clustered(300, 16, 2, 0.2)).astype(int)
    v[200:260] = v[200]  # ties
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(1000, None), (None, v[0].tolist()), (1001, [1, 2]), (1002, [3, 4])]
    table = spark.createDataFrame(rows, "id long, vector array<long>").withColumns({c: F.lit(1) for c in ("dim", "block", "g", "q", "side", "rank")})
    params = TopKParams(k=7, query_block=16, block=40, group=2)
    found = {}
    for r in top_k(table.where("id % 5 = 0 or id > 999"), table, params).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 300, 5):
        score = v @ v[q]
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:7]
        assert sorted(found.pop(q)) == [(k, i, score[i]) for k, i in enumerate(order, 1)]
    assert found == {1001: [(1, 1002, 11)], 1002: [(1, 1001, 11)]}
    assert top_k(table.where("false"), table).collect() == [] == top_k(table, table.where("false")).collect()


def test_quantisation_never_hides_a_link():
    a, b = Quantised(clustered(300, 24, 3, 0.15)), Quantised(clustered(200, 24, 3, 0.15))
    cosine = (a.data / a.norm[:, None]) @ (b.data / b.norm[:, None]).T
    for threshold in (0.8, 0.95, 0.99):
        found = np.concatenate([possible(a, slice(k, k + 64), b, threshold) for k in range(0, 300, 64)])
        assert found[cosine >= threshold].all()
        assert found.sum() < (cosine >= threshold - 0.05).sum() + 1


def test_links_and_components_match_brute_force(spark):
    ship(spark)
    v = clustered(240, 16, 5, 0.22)
    v[50:90] = v[50]
    v[90:100] = 3 * v[50]
    rows = [(int(i) + 1, x.tolist()) for i, x in enumerate(v)] + [(1000 + k, x) for k, x in enumerate(ODD)] + [(None, v[50].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vector", "weight", "tile", "label")})
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95 - 1e-12
    np.fill_diagonal(linked, False)
    component = np.arange(1, 241)
    while True:
        new = np.array([min([component[i], *component[linked[i]]]) for i in range(240)])
        if (new == component).all():
            break
        component = new
    found = near_vectors(table, CosineParams(block=32)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.vec_id is None or r.vec_id >= 1000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            k = r.vec_id - 1
            assert (r.n_links, r.component_id, r.kept) == (linked[k].sum(), component[k], component[k] == r.vec_id)
    assert near_vectors(table.where("false")).collect() == []


def test_components_far_from_one(spark):
    ship(spark)
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [2e-200, 2e-200]), (5, [1.0, 1.0]), (6, [5e-324, 0.0]), (7, [-1e300, 1e300])]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {**{k: (4, 1) for k in range(1, 6)}, 6: (0, 6), 7: (0, 7)}


def test_products_beyond_single_precision(spark):
    """2,048 components of one sign: the sums of products are no longer exact."""
    rng = np.random.default_rng(8)
    a = Quantised(np.abs(rng.normal(size=(60, 2048))) + 3)
    b = Quantised(a.data * (1 + 0.4 * rng.normal(size=(60, 2048))))
    cosine = (a.data / a.norm[:, None]) @ (b.data / b.norm[:, None]).T
    for threshold in (0.85, 0.9, float(np.sort(cosine.ravel())[1800]), float(cosine.max())):
        assert possible(a, slice(0, 60), b, threshold)[cosine >= threshold].all()


def test_repeated_ids_are_candidates_of_their_own(spark):
    ship(spark)
    top = top_k(
        spark.createDataFrame([(1, [1, 0]), (1, [2, 0]), (2, [1, 1])], "id long, vector array<long>").where("id = 2"),
        spark.createDataFrame([(1, [1, 0]), (1, [2, 0]), (2, [1, 1])], "id long, vector array<long>"),
    ).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in top) == [(1, 1, 2), (2, 1, 1)]
