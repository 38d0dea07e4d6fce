"""Registered queries against their SQL twins, and the pipeline against plain versions of its stages."""

import hashlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_duplicates import near_groups
from tests.llm.test_tokens import checked
from webmill.llm import quality, toxicity
from webmill.llm.oracles import ORACLES
from webmill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    twin = con.execute(ORACLES[name])
    columns = [c[0] for c in twin.description]
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(twin.fetchall())
    assert set(got.columns) == set(columns)


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 1 + len(QUERIES)))


def test_digest_queries_equal_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    own, other = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in QUERIES["op10_bpe_trie"](spark, FOLDER).collect():
        ids = own.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))
    for r in QUERIES["op6_token_counts"](spark, FOLDER).collect():
        n = len(other.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_packing_query_meets_the_bound(spark):
    rows = QUERIES["op5_packing"](spark, FOLDER).collect()
    sequences = checked(rows, spark.read.parquet(f"{FOLDER}/documents.parquet").collect(), 2048)
    fewest = -(-sum(r.length for r in rows) // 2048)
    assert fewest <= len(sequences) <= fewest + 1


@pytest.mark.parametrize("name", ["op4_toxicity", "op9_quality"])
def test_classifier_queries_judge_every_document(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = corpus_pipeline.labels(spark, FOLDER)
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "toxicity", "MinHash near-dedup", "best-fit packing"]

    good = stages["quality classifier"](spark, docs, FOLDER)
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    assert good.schema == docs.schema
    rows = [r for r in rows if verdict[r.doc_id]]
    assert Counter(map(tuple, good.collect())) == Counter(map(tuple, rows))

    good.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-good")
    good = spark.read.parquet(path)
    mild = stages["toxicity"](spark, good, FOLDER)
    score = {r.doc_id: r.score for r in toxicity.score(good, toxicity.train(good, labels)).collect()}
    assert mild.schema == docs.schema
    rows = [r for r in rows if score[r.doc_id] < 0.5]
    assert Counter(map(tuple, mild.collect())) == Counter(map(tuple, rows))

    mild.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-mild")
    mild = spark.read.parquet(path)
    single = stages["MinHash near-dedup"](spark, mild, FOLDER)
    first = {low for _, _, low in near_groups(rows, 5)}
    assert single.schema == docs.schema
    rows = [r for r in rows if r.doc_id in first]
    assert Counter(map(tuple, single.collect())) == Counter(map(tuple, rows))

    packed = corpus_pipeline.run(spark, FOLDER).collect()
    checked(packed, rows, 2048)
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_pipeline_handles_odd_rows(spark, stored_docs):
    docs = stored_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.schema == stored_docs.schema
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name[:4]}")
        docs = spark.read.parquet(path)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sum(r.piece == 0 for r in packed) == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stored_docs.limit(0), FOLDER).collect() == []
