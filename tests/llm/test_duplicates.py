"""Near duplicates and shards against brute force."""

import math
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from webmill.llm import components, embedding_dedup, minhash_dedup, sharding


def shingles(text, width):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_groups(rows, width):
    """{(id, size, smallest id of the group): count} by comparing all pairs."""
    sets = [shingles(r.text, width) for r in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    names = defaultdict(list)
    for r, own in zip(root, rows):
        names[r].append(own.doc_id)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return sorted(((r.doc_id, len(s), low[k]) for r, s, k in zip(rows, sets, root)), key=repr)


def copies(seed, n=260):
    """Texts in families of copies that drift away from each other word by word, and unrelated ones that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage, out = [word() for _ in range(30)], []
    while len(out) < n:
        text = [word() for _ in range(rng.choice([1, 2, 4, 6, 30, 90, 250]))]
        if rng.random() < 0.3:
            text[len(text) // 2:len(text) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            out.append(" ".join(text))
            if rng.random() < 0.7:
                text = list(text)
                for _ in range(rng.randint(0, max(1, len(text) // 20))):
                    text[rng.randrange(len(text))] = word()
    return out[:n]


def as_docs(spark, texts, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("seed,width,options", [
    (1, 2, {}), (2, 5, {}), (3, 2, {"k": 16}), (4, 2, {"most_sets": 7}), (5, 2, {"most_bytes": 600, "k": 32})])
def test_near_duplicates_equal_brute_force(spark, tmp_path, seed, width, options):
    docs = as_docs(spark, copies(seed), tmp_path)
    got = minhash_dedup.near_duplicates(docs, width=width, **options)
    assert sorted((tuple(r) for r in got.select("id", "n_shingles", "component").collect()), key=repr) == near_groups(docs.collect(), width)


def test_near_duplicates_of_odd_rows(stored_docs):
    rows = stored_docs.collect()
    for width in (2, 5):
        got = minhash_dedup.near_duplicates(stored_docs, width=width).collect()
        assert sorted(((r.id, r.n_shingles, r.component) for r in got), key=repr) == near_groups(rows, width)
        assert sum(r.first for r in got) == len({r._row for r in got if r.first})
    left = minhash_dedup.without_duplicates(stored_docs)
    assert left.schema == stored_docs.schema
    texts = [r.text for r in left.collect()]
    assert texts.count("one two") + texts.count("One TWO") == 1 and texts.count(None) == 2


def test_dropped_rows_do_not_depend_on_the_splits_of_a_read(spark, tmp_path):
    """The table is read in other splits each time: as with other cores, or after a lost executor."""
    path = str(tmp_path / "docs")
    rows = [(i, f"document number {i // 2} with words of its own {'abcdefghij'[i // 2 % 10] * (i // 2 + 1)} and no others at all") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12, "doc_id").write.parquet(path)
    left, old = minhash_dedup.without_duplicates(spark.read.parquet(path)), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert sorted(r.doc_id for r in left.select("*").collect()) == list(range(0, 40, 2))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_near_duplicates_in_nothing(spark, no_docs, tmp_path):
    assert minhash_dedup.near_duplicates(no_docs).collect() == []
    assert minhash_dedup.without_duplicates(no_docs).collect() == []
    docs = as_docs(spark, ["", " ", "\n"], tmp_path)
    assert sorted(r.component for r in minhash_dedup.near_duplicates(docs).collect()) == [0, 1, 2]


def test_common_shingles_bring_no_documents_together(spark, tmp_path, monkeypatch):
    """Unrelated texts of a few words share most shingles by chance; only what is nearly alike meets."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(120)) for _ in range(300)]
    docs, met = as_docs(spark, texts + [t + " z" for t in texts[:20]], tmp_path), []
    whole = minhash_dedup.components
    monkeypatch.setattr(minhash_dedup, "components", lambda edges: met.append(edges.distinct().count()) or whole(edges))
    got = minhash_dedup.near_duplicates(docs, width=2)
    assert sorted((tuple(r) for r in got.select("id", "n_shingles", "component").collect()), key=repr) == near_groups(docs.collect(), 2)
    assert 20 <= met[0] < 100


@pytest.mark.parametrize("size", [9, 90, 900])
def test_bands_meet_as_often_as_similarity_says(size):
    rows, count = minhash_dedup.banding(0.8)
    assert (1 - 0.8 ** rows) ** count <= 1e-6
    rng, same = np.random.default_rng(3), []
    for _ in range(150):
        values = rng.integers(-(1 << 63), (1 << 63) - 1, size // 9 * 10)
        sets = values[size // 9:], values[:-(size // 9)]  # each lacks one value in ten: similarity 8 / 10
        flat = np.concatenate([np.sort(v) for v in sets])
        a, b = minhash_dedup.band_keys(flat, np.array([0, size, size, 2 * size]), rows, count).reshape(2, count)
        same.append(a == b)
    assert abs(np.mean(same) - 0.8 ** rows) < 0.03 and np.any(same, axis=1).all()


def test_linked_finds_chains_between_blocks():
    base = list(range(100))
    sets = [sorted(set(base[i:i + 40])) for i in range(0, 60, 4)]
    values = pa.array(sets, pa.list_(pa.int64()))
    assert set(minhash_dedup.linked(values, 8, 0.8)) == {0}
    assert list(minhash_dedup.linked(values, 64, 0.95)) == list(range(len(sets)))
    sides = np.array([i % 2 for i in range(len(sets))])
    assert set(minhash_dedup.linked(values, 64, 0.8, sides)) == {0}


def test_estimate_never_drops_more_than_its_error_allows():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both = rng.integers(0, 1 << 62, 900)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, rng.integers(0, 112))])) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        unit = minhash_dedup.Unit(pa.array([a.tolist(), b.tolist()], pa.list_(pa.int64())), 64, 0.8)
        assert (len(unit.similar(0, np.array([1]))) == 1) == (true >= 0.8)


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, x) for x in range(301, 340)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.root for r in components.components(df).collect()}
    root = roots(400, edges)
    assert got == {i: r for i, r in enumerate(root) if i != r}
    assert components.components(df.limit(0)).collect() == []


def brute_links(rows):
    good = {i: np.array(r[1], float) for i, r in enumerate(rows)
            if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = [(a, b) for a, b in combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    return links


def embeddings(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(40):
        center = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((center + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3, 0.6])).astype(np.float32).tolist())
    rows += [None, [], [0.0] * 16, [None] * 16, [1.0, None] * 8, [math.nan] * 16, [math.inf] + [0.0] * 15, rows[0], rows[0], [-0.0] * 15 + [2.0], [0.0] * 15 + [2.0], [1.0, 0.0], [2.0, 0.0]]
    return [(i, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [4096, 5])
def test_embedding_links_equal_brute_force(spark, block):
    rows = embeddings(3)
    rows += [(None, rows[1][1]), rows[2]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumnRenamed("x", "size")
    got = embedding_dedup.near_duplicates(df.withColumn("cls", df.vec_id * 0), block=block)
    links = brute_links([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    degree, root = [0] * len(rows), roots(len(rows), links)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    names = defaultdict(list)
    for r, (i, _) in zip(root, rows):
        if i is not None:
            names[r].append(i)
    want = [(i, degree[k], min(names[root[k]], default=None)) for k, (i, _) in enumerate(rows)]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_embedding_recall_is_at_least_the_stated_one():
    rng = np.random.default_rng(9)
    bits, tables = embedding_dedup.plan(50_000)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    same = embedding_dedup.signatures(a, bits, tables) == embedding_dedup.signatures(b, bits, tables)
    assert same.any(axis=1).mean() > 0.998


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_shards_are_contiguous_and_balanced(spark, odd_docs):
    for n in (1, 3, 8):
        rows = sharding.shards(sharding.sized(odd_docs), n).collect()
        source = odd_docs.collect()
        assert len(rows) == len(source) and sum(r.size for r in rows) == sum(len((r.text or "").encode()) + 1 for r in source)
        key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)
        order = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert [key(r) for r in order] == sorted(key(r) for r in rows)
        total, at, slots = sum(r.size for r in rows), 0, defaultdict(int)
        for r in order:
            assert r.shard == min(n - 1, (2 * at + r.size) * n // (2 * total)) and r.slot == slots[r.shard]
            at, slots[r.shard] = at + r.size, r.slot + 1


def test_equal_rows_are_spread_over_shards(spark):
    df = spark.range(0, 9000, 1, 4).selectExpr("cast(null as long) doc_id", "'same' text")
    rows = sharding.shards(sharding.sized(df), 8).groupBy("shard").count().collect()
    assert [r["count"] for r in rows] == [1125] * 8


def test_no_shards_of_nothing(no_docs):
    assert sharding.shards(sharding.sized(no_docs), 8).collect() == []


def test_sets_do_not_depend_on_slices():
    texts = [f"Word{i} ÄB c{i} D É {'x ' * (i % 7)}" for i in range(300)]
    whole = pa.array(texts)
    flat, bounds = minhash_dedup.shingle_sets(whole, 2)
    for start, size in ((0, 300), (17, 50), (250, 50)):
        part, own = minhash_dedup.shingle_sets(whole.slice(start, size), 2)
        assert part.tolist() == flat[bounds[start]:bounds[start + size]].tolist()
        assert own.tolist() == (bounds[start:start + size + 1] - bounds[start]).tolist()
