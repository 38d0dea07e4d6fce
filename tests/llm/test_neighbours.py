"""Neighbour searches against brute force."""

import numpy as np
import pytest

from webmill.llm import hard_negatives as hn
from webmill.llm import rp_forest as rf
from webmill.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, k=5, every=50):
    """{query row number: [(id, cosine)]}: the k nearest rows, ties by id with nulls last, then by place."""
    rows = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if usable(v)]
    rows = [(n, i, v / 2.0 ** np.frexp(np.abs(v).max())[1]) for n, i, v in rows]  # squares stay finite
    out = {}
    for n, i, v in rows:
        if i is None or i % every:
            continue
        near = [(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j is None, j or 0, m, j)
                for m, j, w in rows if m != n and len(w) == len(v)]
        out[n] = i, [(x[4], -x[0]) for x in sorted(near)[:k]]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]  # a hot vector, some of its rows are queries
    rows += [(2000 + i, (np.array(rows[100][1]) * 2.0 ** i).tolist()) for i in range(40)]  # parallel ones
    rows += [(3000 + i, (np.array(rows[7][1]) + 1e-3 * rng.standard_normal(8)).tolist()) for i in range(300)]
    rows += [(None, rows[0][1]), (None, rng.standard_normal(8).tolist()), (150, None), (200, []), (250, [0.0] * 8), (300, [1.0, None] * 4),
             (350, [float("nan")] * 8), (400, [float("inf")] + [1.0] * 7), (450, [1e300] * 8), (500, [1e-300] * 8), (4000, [1.0, 2.0]), (4001, [2.0, 1.0]),
             (4050, [3.0, 1.0, 1.0])]
    path = str(tmp_path_factory.mktemp("vectors") / "v.parquet")
    spark.createDataFrame([(i, v, 1, "x", 5) for i, v in rows], SCHEMA).repartition(5).write.parquet(path)
    return rows, spark.read.parquet(path)


@pytest.mark.parametrize("block", [4096, 64])
def test_all_neighbours_where_all_leaves_are_reached(spark, vectors, block):
    from pyspark.sql import functions as F

    rows, table = vectors
    got = answers(rf.nearest(table, F.col("id") % 50 == 0, leaf=128, recall=1.0, fitted=10_000, block=block))
    want = {}
    for i, near in brute(rows).values():
        want.setdefault(i, []).extend((r, j, s) for r, (j, s) in enumerate(near, 1))
    assert set(got) == {i for i, near in want.items() if near}
    found = total = 0
    for i, near in got.items():
        assert [r for r, _, _ in near] == [r for r, _, _ in sorted(want[i], key=lambda x: x[0])]
        exact = {j: s for _, j, s in want[i]}
        found += sum(j in exact for _, j, _ in near)
        total += len(near)
        for _, j, s in near:
            assert j not in exact or abs(exact[j] - s) < 1e-12
    assert found >= 0.99 * total
    hot = [near for i, near in got.items() if 1000 <= i < 1300]  # equal vectors: ties by id, the query itself left out
    assert len(hot) == 6 and [j for _, j, _ in got[1000]] == [50, 1001, 1002, 1003, 1004] and [j for _, j, _ in got[1050]] == [50, 1000, 1001, 1002, 1003]
    assert [j for _, j, _ in got[4000]] == [4001] and 4050 not in got


def test_recall_of_the_query(spark):
    """Vectors without structure, the hardest case: the share of leaves is found by measurement."""
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = answers(QUERIES["op12_rp_forest"](spark, folder)), brute(rows)
    assert len(got) == len(want) and all([r for r, _, _ in near] == [1, 2, 3, 4, 5] for near in got.values())
    hits = [len({j for _, j, _ in got[i]} & {j for j, _ in near}) for i, near in want.values()]
    assert sum(hits) >= 0.9 * 5 * len(hits)
    scores = {i: dict(near) for i, near in want.values()}
    assert all(abs(s - scores[i][j]) < 1e-12 for i, near in got.items() for _, j, s in near if j in scores[i])


def test_clusters_need_few_leaves(spark):
    from pyspark.sql import functions as F

    from webmill.llm.embedding_dedup import classes

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 32))
    rows = [(i, (centres[i % 200] + 0.1 * rng.standard_normal(32)).tolist()) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    members, groups = classes(table)
    forests = rf.fit(groups, 4, 100, 32_768)
    queries = members.filter(F.col("id") % 50 == 0).select(F.col("cls").alias("c")).join(groups, F.col("c") == F.col("cls")).select("cls", "vec")
    assert rf.probes_needed(groups, queries, forests, 5, 0.95, 200) <= 40 < 4 * 64
    sizes = np.bincount(rf.leaves(np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1)[:, None], forests[32])[:, 0])
    assert sizes.max() <= 2 * 100


def test_no_vectors(spark):
    from pyspark.sql import functions as F

    assert rf.nearest(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).collect() == []


def mined(rows, anchor=100):
    """Plain loops over all pairs; rows are (id, vector, label)."""
    good = [(n, i, [int(np.floor(256 * x)) for x in v], lab) for n, (i, v, lab) in enumerate(rows)
            if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = [(n, i, q, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for n, i, q, lab in good]
    out = []
    for n, i, q, lab in good:
        if i is None or i % anchor:
            continue
        near = sorted((-sum(a * b for a, b in zip(q, p)), j is None, j or 0, m, other) for m, j, p, other in good if m != n and len(p) == len(q))
        for s, none, j, _, _ in [x for x in near if x[4] == lab][:5]:
            hard = [x for x in near if x[4] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, None if none else j, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(hard, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((6, 6))
    rows = [(i, (middle[i % 6] + 0.3 * rng.standard_normal(6)).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    rows += [(1000 + i, rows[300][1], i % 5) for i in range(400)]  # a hot vector, four of its rows are anchors
    rows += [(None, rows[0][1], 1), (None, rows[1][1], 2), (None, None, None), (2000, None, 1), (2100, [1.0] * 6, None), (2200, [0.0] * 6, 1), (2201, [0.0] * 6, 2),
             (2300, [1.0, float("nan")] * 3, 1), (2400, [1.0, None] * 3, 1), (2500, [float("inf")] * 6, 1), (2600, [], 3), (2601, [], 3), (2602, [], 4),
             (2700, [1.0, 2.0], 8), (2701, [1.0, 2.0], 9), (2702, [0.5, 1.0], 7), (2703, [1.5, 1.0], 8), (2800, [-1.0] * 6, 1), (900, rows[0][1], 1), (900, rows[0][1], 1)]
    path = str(tmp_path_factory.mktemp("labelled") / "v.parquet")
    spark.createDataFrame([(i, v, lab, "x", 5) for i, v, lab in rows], SCHEMA).repartition(5).write.parquet(path)
    return rows, spark.read.parquet(path)


@pytest.mark.parametrize("sizes", [{}, {"members": 3, "head": 50, "segment": 40}, {"members": 1, "head": 1, "segment": 10_000}], ids=["whole", "cut", "single"])
def test_hard_negatives_equal_plain_loops(spark, labelled, sizes):
    from pyspark.sql import functions as F

    rows, table = labelled
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted(map(tuple, hn.mine(table, F.col("vec_id") % 100 == 0, relabel, **sizes).collect()), key=repr)
    want = mined(rows)
    assert got == want and len({w[0] for w in want}) > 12


def test_walk_ends_where_the_bound_certifies(spark, monkeypatch):
    """Members of narrow clusters read the beginning of their list only."""
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((40, 16))
    rows = [(i, (middle[i % 40] + 0.02 * rng.standard_normal(16)).tolist(), i % 2) for i in range(4000)]
    import pyarrow as pa

    kind, read = "int32", []
    q = np.floor(256 * np.array([v for _, v, _ in rows])).astype(kind)
    asks = [n for n in range(0, 4000, 400)]  # all of one cluster
    unit = hn.directions(q.astype(float))
    centre = hn.directions(unit[asks].sum(axis=0, keepdims=True))
    wide = np.arccos(np.clip(unit[asks] @ centre.T, -1, 1)).max()
    size = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    bound = size * np.cos(np.clip(np.arccos(np.clip(unit @ centre.T, -1, 1))[:, 0] - wide, 0, np.pi)) + 1e-6
    plain = hn.products
    monkeypatch.setattr(hn, "products", lambda a, b, exact: read.append(len(b)) or plain(a, b, exact))
    ids, n = np.arange(4000), len(asks)
    table = pa.table({
        "side": np.r_[np.zeros(4000, int), np.ones(n, int)], "q": [x.tobytes() for x in q] + [q[a].tobytes() for a in asks],
        "bound": np.r_[bound, np.zeros(n)], "label": np.r_[ids % 2, np.array(asks) % 2], "_row": np.r_[ids, asks], "vec_id": np.r_[ids, asks],
        "_anchor": np.r_[ids, asks], "_positive": pa.nulls(4000 + n, pa.int64()), "norm": np.r_[size, size[asks]],
        **{c: pa.array(np.full(4000 + n, v), pa.int64()) for c, v in (("low", -2 ** 62), ("high", 2 ** 62), ("need", -2 ** 62))}})
    found = hn.walk(kind, 5, True, True, chunk=128)(table).to_pylist()
    assert sum(read) < 1000  # of 4000
    for a in asks:
        score = (q[a].astype(int) * q.astype(int)).sum(axis=1)
        best = sorted((-score[m], m) for m in ids if m != a and m % 2 == a % 2)[:5]
        assert [(r["vec_id"], r["score"]) for r in found if r["_anchor"] == a] == [(m, -s) for s, m in best]


def test_large_components_are_exact_or_refused(spark):
    from pyspark.sql import functions as F

    rows = [(100, [2.0 ** 19, 1.0], 1), (1, [2.0 ** 19 + 1, 3.0], 1), (2, [2.0 ** 18, 1.0], 2), (3, [2.0 ** 18 + 2.0 ** -8, 1.0], 2)]
    got = hn.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == mined(rows)
    with pytest.raises(ValueError):
        hn.mine(spark.createDataFrame([(1, [1e200], 1)], "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0)


def test_no_labelled_vectors(spark):
    from pyspark.sql import functions as F

    assert hn.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []
