"""Traps of the request, access, cache, seed and report operators on small tables."""

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webmill import lists, schemas
from webmill.operators import (
    access, audits, cache, crawl, golden, ops, pages, ranking, report, seeds, traffic,
)
from webmill.plans import flows
from webmill.plans.derived import spread
from webmill.sources import readers, sinks, versions
from webmill.session import work_dir

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def config(spark):
    doc = '{"v":2,"id":"%s","plan":"pro","domains":%s,"updatedAt":"t"}'
    return spark.createDataFrame([
        ("apikeyhash:" + hashlib.sha256(b"good").hexdigest(), doc % ("c1", '["a.com","127.0.0.1"]')),
        ("apikey:old", '{"customerId":"c2","domains":["b.com"]}'),
        ("apikey:broken", '{"domains":["b.com"]}'),
        ("customer:c1", doc % ("c1", '["a.com","127.0.0.1"]')),
    ], "key string, document string")


def verdicts(spark, mode, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, token string, url string, customer_id string, service_ok boolean")
    out = access.admit(df, config(spark), mode).orderBy("i").collect()
    return [(r.http_status, r.error_code) for r in out]


def test_admission_render(spark):
    assert verdicts(spark, "render", [
        (None, "https://a.com/", None, True), ("bad", "https://a.com/", None, True), ("broken", "https://b.com/", None, True),
        ("good", None, None, True), ("good", "nope", None, True), ("good", "http://a.com/", None, True),
        ("good", "https://b.com/", None, True), ("good", "https://10.0.0.1/", None, True),
        ("good", "https://127.0.0.1/x", None, True), ("good", "https://www.A.com/x", None, True), ("old", "https://b.com/", None, True),
    ]) == [(401, "missing_token"), (401, "invalid_token"), (500, "bad_config"), (400, "missing_url"), (400, "invalid_url"),
           (400, "not_https"), (403, "domain_denied"), (403, "domain_denied"), (400, "private_host"), (200, None), (200, None)]


def test_admission_internal_and_crawl_order(spark):
    assert verdicts(spark, "internal", [
        (None, "https://a.com/", "c1", False), (None, "https://a.com/", "", True), (None, "https://10.0.0.1/", "c9", True),
        (None, "https://a.com/", "c9", True), (None, "https://b.com/", "c1", True), (None, "https://a.com/", "c1", True),
    ]) == [(401, "unauthorised"), (400, "missing_customer"), (400, "private_host"), (404, "unknown_customer"),
           (403, "domain_denied"), (200, None)]
    assert verdicts(spark, "crawl", [
        ("good", "http://a.com/", None, True), ("good", "https://127.0.0.1/", None, True), ("good", "mailto:x", None, True),
    ]) == [(200, None), (200, None), (403, "domain_denied")]


def test_agents_and_routes(spark):
    req = spark.createDataFrame([
        (1, "c", "Mozilla GPTBot/1.1", "/x"), (2, "c", "Googlebot/2.1", "/x"), (3, "c", "ClaudeBot", "/administrator"),
        (4, "c", "CCBot", "/a.DAT"), (5, "c", None, "/x"), (6, "d", "Bytespider GPTBot", "/apiary"), (7, "d", "Chrome", "/x"),
    ], "i int, customer_id string, user_agent string, path string")
    got = {r.i: (r.route, r.reason) for r in traffic.route_traffic(req).collect()}
    assert got == {1: ("optimise", None), 2: ("passthrough", "not_ai_agent"), 3: ("passthrough", "blocked_path"),
                   4: ("passthrough", "static_asset"), 5: ("passthrough", "not_ai_agent"),
                   6: ("passthrough", "blocked_path"), 7: ("passthrough", "not_ai_agent")}
    overrides = spark.createDataFrame([("d", [""], ["ByteSpider"])], "customer_id string, include array<string>, exclude array<string>")
    got = {r.i: r.is_ai for r in traffic.flag_ai_agents(req, overrides=overrides).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True}
    assert [r.bot_family for r in traffic.bot_family(req).orderBy("i").collect()] == [
        "gpt", "google", "claude", "unknown", "unknown", "gpt", "unknown"]


def test_sampling_keeps_errors_and_repeats(spark):
    log = spark.range(20000).select(F.col("id").alias("request_id"), (F.col("id") % 100 == 0).alias("is_error"))
    first, again = (sorted(r.request_id for r in traffic.sample_log(log, 0.1).collect()) for _ in range(2))
    assert first == again and set(range(0, 20000, 100)) <= set(first) and 1800 < len(first) < 2600
    total = traffic.sample_log(log, 0.1).agg(F.sum("weight")).first()[0]
    assert abs(total - 20000) < 2000


def brute_lookup(writes, requests):
    out = {}
    for rid, key, ts in requests:
        past = [w for w in writes if w[1] == key and w[2] <= ts]
        last = max(past, key=lambda w: (w[2], w[0])) if past else None
        hit = last and ts < last[2] + timedelta(seconds=last[3]) and not last[4].startswith("<html")
        out[rid] = ("HIT", last[0]) if hit else ("MISS", None)
    return out


def test_cache_lookup_against_brute_force(spark):
    rnd = random.Random(7)
    # one key takes most requests and spans many time segments
    key = lambda: "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}"
    writes = [(i, key(), at(rnd.randrange(5000)), rnd.choice([30, 400, 2000]), rnd.choice(["# t", "<html>"])) for i in range(120)]
    requests = [(i, key(), at(rnd.randrange(6000))) for i in range(2000)]
    w = spark.createDataFrame([(a, b, "md", e, c, d) for a, b, c, d, e in writes],
                              "wid long, url_key string, kind string, body string, written_at timestamp, ttl_s long")
    r = spark.createDataFrame(requests, "request_id long, url_key string, ts timestamp")
    want = brute_lookup(writes, requests)
    for segment, most in ((60, 10**6), (100000, 10**6), (300, 20), (100000, 100)):
        got = {x.request_id: (x.cache_status, x.wid) for x in cache.cache_lookup(r, w, segment_s=segment, most=most).collect()}
        assert got == want


def test_one_segment_with_all_rows_is_cut(spark):
    """All rows of the table belong to one key and one minute."""
    rows = spark.range(4000).select(
        F.lit("hot").alias("k"), (F.col("id") * 7919 % 4000 * 15000).alias("t"), "id", F.when(F.col("id") % 7 == 0, F.struct("id")).alias("v"))
    lanes = [r["count"] for r in ranking.lanes_of(rows, "k", F.col("t"), 300, 500).groupBy("k", "_seg", "_sub").count().collect()]
    assert len(lanes) > 200 and max(lanes) < 40
    last, most, want = None, None, {}
    for t, i in sorted((i * 7919 % 4000 * 15000, i) for i in range(4000)):
        want[i] = (last, most)
        if i % 7 == 0:
            last, most = i, max(most or 0, i)
    found = ranking.carried(rows, "k", ["t", "id"], "v", "last", F.col("t"), most=500)
    found = ranking.carried(found, "k", ["t", "id"], "v", "most", F.col("t"), largest=True, most=500)
    assert {r.id: (r["last"] and r["last"].id, r.most and r.most.id) for r in found.collect()} == want


def test_followers_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot", "hot", "a"]), at(rnd.randrange(600)), rnd.choice(["miss", "hit"]), rnd.randrange(90000)) for i in range(400)]
    r = spark.createDataFrame(rows, "request_id long, url_key string, ts timestamp, outcome string, latency_ms long")
    found = [{x.request_id: x.wait_ms for x in cache.in_flight_followers(r, most=most).collect()} for most in (10**6, 20)]
    got = found[0]
    assert found[1] == got
    want = {}
    for i, k, ts, _, _ in rows:
        ends = [t + timedelta(milliseconds=min(l, 30000)) for j, q, t, o, l in rows
                if q == k and o == "miss" and (t, j) < (ts, i)]
        if ends and max(ends) > ts:
            want[i] = int((max(ends) - ts).total_seconds() * 1000)
    assert got == want


def test_invalidations(spark):
    w = spark.createDataFrame([(1, "k", at(0), "md"), (2, "k", at(50), "md"), (3, "j", at(0), "md"), (4, "k", at(0), "html"), (5, "k", at(0), "tokens")],
                              "wid long, url_key string, written_at timestamp, kind string")
    i = spark.createDataFrame([("k", at(10), at(20)), ("j", at(0), at(400))], "url_key string, issued_at timestamp, received_at timestamp")
    assert sorted(r.wid for r in cache.apply_invalidations(w, i).collect()) == [2, 3, 4, 5]


def test_site_map_shapes(spark):
    maps = [
        ('["https://a.com/1", {"url": "https://a.com/2"}, 3, {"url": 4}]', ["https://a.com/1", "https://a.com/2"]),
        ('{"urls": ["u1", {"url": "no"}]}', ["u1"]), ('{"links": ["u1", {"url": "u2"}]}', ["u1", "u2"]),
        ('{"data": ["no", {"url": "u1"}]}', ["u1"]), ('{"data": {"urls": ["u1"], "links": [{"url": "u2"}, "u3"]}}', ["u1", "u2", "u3"]),
        ('{"urls": ["u1"], "links": ["u2"]}', ["u1", "u2"]), ('{"id": "job", "urls": ["u1"]}', []), ('{"id": null, "urls": ["u1"]}', ["u1"]),
        ("broken", []), ("[]", []),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(maps)], "i int, payload string")
    rows = seeds.explode_site_map(df).orderBy("i", "ordinal").collect()
    for i, (_, want) in enumerate(maps):
        assert [r.url for r in rows if r.i == i] == want


def test_starter_merge_and_repeat(spark):
    old = spark.createDataFrame([("c", "u1", "manual", False), ("c", "u2", "manual", False), ("c", "u3", "manual", True)],
                                "customer_id string, url string, source string, enabled boolean")
    new = spark.createDataFrame([("c", "u1"), ("c", "u3"), ("c", "u4")], "customer_id string, url string")
    merged = seeds.merge_starter(old, new)
    want = {"u1": ("manual", True, "enable"), "u2": ("manual", False, "keep"), "u3": ("manual", True, "keep"),
            "u4": (lists.MAP_SOURCE, True, "insert")}
    assert {r.url: (r.source, r.enabled, r.action) for r in merged.collect()} == want
    assert all(r.action == "keep" for r in seeds.merge_starter(merged, new).collect())


def test_upsert_arrival_order_and_nulls(spark):
    changes = spark.createDataFrame([
        ("c", "u", 100, 10, at(900), 1, at(1)), ("c", "u", None, None, at(100), 2, at(2)), ("c", "v", 5, 1, at(0), 3, at(3)),
    ], "customer_id string, url string, html_tokens int, md_tokens int, optimized_at timestamp, seq long, received_at timestamp")
    keys = ["customer_id", "url"]
    last = {r.url: r for r in report.upsert(None, changes, keys, "seq", at="received_at").collect()}
    assert last["u"].html_tokens is None and last["u"].optimized_at == at(100)
    assert last["u"].created_at == at(1) and last["u"].updated_at == at(2)
    known = {r.url: r for r in report.upsert_keep_known(None, changes, keys, "seq", at="received_at").collect()}
    assert known["u"].html_tokens == 100 and known["u"].optimized_at == at(100)


def test_metric_validation(spark):
    ok = '{"customerId":"c","url":"u","htmlTokens":null,"mdTokens":3}'
    cases = [(ok, None), ('{"customerId":"c","url":"u","mdTokens":3}', "missing_fields"), ("[1]", "invalid_body"), ("x", "invalid_json"),
             ('{"customerId":"","url":"u","htmlTokens":1,"mdTokens":3}', "missing_fields"),
             ('{"customerId":"c","url":7,"htmlTokens":1,"mdTokens":3}', "missing_fields"),
             ('{"customerId":"c","url":"u","htmlTokens":"1","mdTokens":3}', "missing_fields"),
             ('{"customerId":"c","url":"u","htmlTokens":1,"mdTokens":3,"optimizedAt":"soon"}', "invalid_time")]
    df = spark.createDataFrame([(i, b, at(i)) for i, (b, _) in enumerate(cases)], "seq int, body string, received_at timestamp")
    rows = report.split_valid_metrics(df).orderBy("seq").collect()
    assert [r.error_code for r in rows] == [e for _, e in cases]
    assert rows[0].html_tokens is None and rows[0].md_tokens == 3 and rows[0].optimized_at == at(0)


def test_ranks_are_exact_for_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.col("id").alias("v"))
    got = ranking.rank_within(df, ["g"], ["v"], "n").collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.v)
    want = {(g, v): i + 1 for g, vs in groups.items() for i, v in enumerate(sorted(vs))}
    assert {(r.g, r.v): r.n for r in got} == want
    top = ranking.first_k(df, ["g"], ["v"], 3, salts=8).collect()
    assert sorted((r.g, r.v) for r in top) == sorted((g, v) for g, vs in groups.items() for v in sorted(vs)[:3])


def test_sections(spark):
    rows = [("c", u, i) for i, u in enumerate([
        "https://a.com/?z=1", "https://a.com/", "https://a.com/docs/b", "https://a.com/docs/a", "https://a.com/blog"])]
    df = spark.createDataFrame(rows, "customer_id string, url string, ordinal int")
    got = {r.url: (r.section, r.section_rank, r.url_rank) for r in report.rank_sections(df).collect()}
    assert got == {"https://a.com/?z=1": ("/", 1, 1), "https://a.com/": ("/", 1, 2), "https://a.com/blog": ("/blog", 2, 1),
                   "https://a.com/docs/a": ("/docs", 3, 1), "https://a.com/docs/b": ("/docs", 3, 2)}
    folders = {r.section: r.is_folder for r in report.section_report(df).collect()}
    assert folders == {"/": True, "/docs": True, "/blog": False}


def test_golden_positions(spark):
    a = spark.createDataFrame([(1, "a\r\nb"), (2, "abc"), (3, "abX" + "y" * 30), (4, "only")], "key int, body string")
    g = spark.createDataFrame([(1, "a\nb"), (2, "abcd"), (3, "abZ" + "y" * 30), (5, "gone")], "key int, body string")
    got = {r.key: (r.status, r.pos) for r in golden.golden_diff(a, g).collect()}
    assert got == {1: ("equal", None), 2: ("differs", -1), 3: ("differs", 2), 4: ("missing_golden", None), 5: ("missing_actual", None)}


def test_crawl_verdicts_and_caps(spark):
    p = spark.createDataFrame([
        ("j1", 0, "https://a.com/1", "t", "# x", "c"), ("j1", 1, "https://z.com/", "t", "# x", "c"), ("j1", 2, "https://a.com/2", "t", None, "c"),
        ("j2", 0, "https://any.com/", "t", "# x", "c"), ("j3", 0, "https://a.com/", "t", "# x", "c"), ("j4", 0, "https://a.com/", "t", "# x", "c"),
    ], "crawl_id string, ordinal int, url string, title string, markdown string, customer_id string")
    j = spark.createDataFrame([("j1", "c", 2, True, ["a.com"]), ("j2", "c", 500, True, []), ("j3", "other", 5, True, [])],
                              "id string, customer_id string, limit int, cache_results boolean, allowed_domains array<string>")
    got = {(r.crawl_id, r.ordinal): r.verdict for r in crawl.filter_crawl(p, j).collect()}
    assert got == {("j1", 0): "admitted", ("j1", 1): "off_domain", ("j1", 2): "no_content", ("j2", 0): "admitted",
                   ("j3", 0): "not_owner", ("j4", 0): "no_job"}
    assert crawl.cap_per_crawl(p, j).filter("crawl_id = 'j1'").count() == 2
    s = {r.crawl_id: r for r in crawl.crawl_summary(crawl.filter_crawl(p, j), j).collect()}
    assert (s["j1"].total_pages, s["j1"].reported_cached, s["j1"].admitted_pages) == (3, 3, 1) and s["j2"].effective_limit == 100


def test_alerts_are_strict(spark):
    rows = [(i, at(i % 60), "fallback" if i < 10 else "hit", 200) for i in range(200)]  # exactly 5 %
    req = spark.createDataFrame(rows, "request_id long, ts timestamp, outcome string, extractor_status int")
    assert ops.fallback_alerts(req).count() == 0
    more = req.withColumn("outcome", F.when(F.col("request_id") < 11, "fallback").otherwise("hit"))
    found = ops.fallback_alerts(more).collect()
    assert {r.rule for r in found} == {"fallback_15m"} and len(found) == 15


def test_config_diff_and_cascade(spark):
    want = spark.createDataFrame([("a", '{"v":2,"id":"x","plan":"pro","domains":[],"updatedAt":"2"}'), ("b", '{"v":2,"id":"y"}')], "key string, document string")
    have = spark.createDataFrame([("a", '{"v":2,"id":"x","plan":"pro","domains":[],"updatedAt":"1"}'), ("c", '{"v":2}')], "key string, document string")
    assert {r.key: r.action for r in access.config_diff(want, have).collect()} == {"a": "unchanged", "b": "put", "c": "delete"}
    rows = lambda data, cols: spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols.split()))
    tables = {
        "customers": rows([("c1",), ("c2",)], "id"),
        "domains": rows([("d1", "c1"), ("d2", "c2")], "id customer_id"),
        "map_snapshots": rows([("s1", "c2", "d1"), ("s2", "c2", "d2")], "id customer_id domain_id"),
        **{name: rows([(name, "c1"), (f"{name}2", "c2")], "id customer_id") for name in ("seed_urls", "api_tokens", "publish_jobs", "url_metrics")}}
    gone = audits.cascade_delete(tables, spark.createDataFrame([("c1",)], "id string"))
    assert {(r.table_name, r.row_id) for r in gone.collect()} == {
        ("customers", "c1"), ("domains", "d1"), ("map_snapshots", "s1"), ("seed_urls", "seed_urls"), ("api_tokens", "api_tokens"),
        ("publish_jobs", "publish_jobs"), ("url_metrics", "url_metrics")}
    with pytest.raises(ValueError, match="url_metrics"):
        audits.cascade_delete({k: v for k, v in tables.items() if k != "url_metrics"}, tables["customers"])


def test_snapshot_replacement_keeps_others(spark):
    path = work_dir(spark, "snap")
    schema = "customer_id string, domain_id string, ordinal int, url string"
    sinks.replace_snapshot(spark, spark.createDataFrame([("c", "d1", 0, "u1"), ("c", "d2", 0, "u2")], schema), path, "2024-01-01", buckets=2)
    for _ in range(2):
        sinks.replace_snapshot(spark, spark.createDataFrame([("c", "d1", 1, "u3"), ("c", "d1", 0, "u4")], schema), path, "2024-01-02", buckets=2)
    rows = {r.domain_id: (r.urls, str(r.created_at)[:10]) for r in sinks.read_snapshots(spark, path).collect()}
    assert rows == {"d1": (["u4", "u3"], "2024-01-01"), "d2": (["u2"], "2024-01-01")}


def test_a_write_that_stops_before_its_commit_changes_nothing(spark, monkeypatch):
    schema = "customer_id string, domain_id string, ordinal int, url string"
    path = work_dir(spark, "snapshots")
    put = lambda rows, day: sinks.replace_snapshot(spark, spark.createDataFrame(rows, schema), path, day, buckets=4)
    listed = lambda version=None: {(r.domain_id, *r.urls) for r in sinks.read_snapshots(spark, path, version).collect()}
    assert listed() == set()
    put([("c", f"d{i}", 0, f"u{i}") for i in range(9)], "2024-01-01")
    first = listed()
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            put([("c", "d1", 0, "new")], "2024-01-02")
    assert listed() == first and versions.versions(spark, path) == [1]
    put([("c", "d1", 0, "new")], "2024-01-03")
    assert listed() == first - {("d1", "u1")} | {("d1", "new")} and listed(1) == first
    with pytest.raises(ValueError, match=versions.TAKEN):  # a writer that began from version 1 as well
        versions.commit(spark, path, {}, 2)
    put([("c", "d2", 0, "newer")], "2024-01-04")
    now = listed()
    versions.retire(spark, path, keep=1)
    assert versions.versions(spark, path) == [3] and listed() == now and len(now) == 9



def posted(spark, rows):
    body = '{"customerId":"%s","url":"%s","htmlTokens":%d,"mdTokens":1}'
    return spark.createDataFrame([(seq, body % (c, u, n), at(seq)) for seq, c, u, n in rows], "seq long, body string, received_at timestamp")


def test_metric_table_rewrites_touched_buckets_only(spark):
    log, table = work_dir(spark, "metrics"), work_dir(spark, "table")
    held = lambda: {(r.customer_id, r.url): (r.html_tokens, r.created_at, r.updated_at) for r in sinks.read_metric_table(spark, log, table).collect()}
    assert held() == {} and sinks.merge_metrics(spark, log, table) == 0
    first = [(i, "c", f"u{i}", i) for i in range(40)] + [(99, "c", "u0", 99)]
    sinks.append_metrics(posted(spark, first), 0, log)
    before = held()  # all changes, no base yet
    assert len(before) == 40 and before["c", "u0"] == (99, at(0), at(99))
    assert sinks.merge_metrics(spark, log, table, buckets=8) == 1 and held() == before
    old = versions.folders(spark, table)
    sinks.append_metrics(posted(spark, first), 0, log)  # delivered again
    assert sinks.merge_metrics(spark, log, table) == 1 and held() == before
    sinks.append_metrics(posted(spark, [(100, "c", "u7", 700), (101, "", "u7", 1)]), 1, log)
    now = held()
    assert now == {**before, ("c", "u7"): (700, at(7), at(100))}
    assert sinks.merge_metrics(spark, log, table) == 2 and held() == now
    new = versions.folders(spark, table)
    assert sum(new[b] != old[b] for b in old) == 1 and set(new) == set(old)
    assert versions.read(spark, table, schemas.URL_METRICS, 1).filter("html_tokens = 700").count() == 0
    sinks.retire_metrics(spark, log, table, keep=1)
    assert held() == now and sinks.read_quarantine(spark, log).count() == 1
    sinks.append_metrics(posted(spark, [(200, "d", "u", 5)]), 2, log)
    assert len(held()) == 41


def test_an_unfinished_batch_and_those_after_it_wait(spark):
    log, table = work_dir(spark, "metrics"), work_dir(spark, "table")
    for n in range(3):
        sinks.append_metrics(posted(spark, [(n, "c", f"u{n}", n)]), n, log)
    where, files = versions.located(spark, f"{log}/batch_id=1/_SUCCESS")
    files.delete(where, False)
    sinks.merge_metrics(spark, log, table, buckets=2)
    assert [r.url for r in sinks.read_metric_table(spark, log, table).collect()] == ["u0"]
    sinks.append_metrics(posted(spark, [(1, "c", "u1", 1)]), 1, log)
    assert sinks.read_metric_table(spark, log, table).count() == 3
    sinks.merge_metrics(spark, log, table)
    assert versions.manifest(spark, table)[2] == {"batch": 2, "buckets": 2} and sinks.read_metric_table(spark, log, table).count() == 3


def test_log_quarantine(spark):
    path = work_dir(spark, "log")
    lines = ['{"requestId":"1","timestamp":"2024-01-01T00:00:00.000Z","status":200,"logs":[{"level":"error"}]}', '{"requestId":"2",']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good, bad = readers.split_corrupt(readers.load_request_log(spark, path))
    row = readers.tidy_log(good).collect()
    assert len(row) == 1 and row[0].is_error and row[0].ts == T0
    assert [r.line for r in bad.collect()] == [lines[1]]


def test_headers_and_outcomes(spark):
    h = spark.createDataFrame([({"Authorization": "x", "ACCEPT": "y", "X-Api-Token": "z", "Other": "o"},)], "headers map<string,string>")
    assert set(traffic.scrub_headers(h).first().headers) == {"ACCEPT", "Other"}
    assert set(traffic.scrub_headers(h, mode="safe").first().headers) == {"ACCEPT"}
    words = spark.createDataFrame([("MISS (Rendered)",), ("FAIL (Fallback)",), ("timeout",), ("odd",)], "status_word string")
    assert [r.outcome for r in traffic.normalise_outcome(words).collect()] == ["miss", "fallback", "error", None]


def test_preview_cuts_long_texts(spark):
    df = spark.createDataFrame([(1, "a\n\n\n\nb" + "c" * 20, 6)], "i int, markdown string, md_tokens int")
    row = pages.preview(df, limit=5).first()
    assert row.preview == "a\n\nbc" and row.truncated and row.size_label == "24 B"


def test_preview_cuts_between_characters(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["😀😀😀😀", "a😀😀", "ééééé", "a😀b", None])], "i int, markdown string, md_tokens int")
    rows = {r.i: (r.preview, r.truncated) for r in pages.preview(df, limit=4).collect()}
    assert rows == {0: ("😀😀", True), 1: ("a😀", True), 2: ("éééé", True), 3: ("a😀b", False), 4: (None, False)}


def test_waits_end_by_mode(spark):
    rows = [(1, "k", 0, "miss", 2000, "proxy"), (2, "k", 1, "hit", 5, "render"), (3, "k", 1, "hit", 5, "content"),
            (4, "slow", 0, "miss", 40_000, "render"), (5, "slow", 1, "hit", 5, "render"), (6, "slow", 1, "miss", 100, "internal"),
            (7, "slow", 29, "hit", 5, "proxy"), (8, "slow", 30, "hit", 5, "proxy"),
            (9, "bad", 0, "fallback", 1500, "proxy"), (10, "bad", 1, "hit", 5, "render"), (11, None, 1, "hit", 5, "render")]
    r = spark.createDataFrame([(i, k, at(s), o, ms, m) for i, k, s, o, ms, m in rows],
                              "request_id long, url_key string, ts timestamp, outcome string, latency_ms long, endpoint string")
    found = {x.request_id: (x.leader_id, x.wait_outcome, x.http_status, x.waited_ms) for x in cache.wait_outcomes(r).collect()}
    assert found == {2: (1, "hit", 200, 1000), 5: (4, "timeout", 503, 3000), 6: (4, "extract", None, 3000),
                     7: (4, "extract", None, 3000), 10: (9, "timeout", 503, 3000)}


def test_panels_say_why_they_are_empty(spark):
    log = spark.createDataFrame([
        (1, "k1", "md", "a\n\n\n\nb", at(0), 600), (2, "k1", "html", "<p>😀😀</p>", at(0), 600),
        (3, "k1", "tokens", '{"htmlTokens":40,"mdTokens":10,"ts":0}', at(0), 600),
        (4, "k2", "md", "x", at(0), 600), (5, "k2", "html", "<p>old</p>", at(0), 5), (6, "k3", "html", "<p>old</p>", at(0), 5),
    ], "wid long, url_key string, kind string, body string, written_at timestamp, ttl_s long")
    listed = spark.createDataFrame([("c", f"u{i}", f"k{i}" if i else None) for i in range(5)], "customer_id string, url string, url_key string")
    metrics = spark.createDataFrame([("c", "u3", 300, 30), ("other", "u4", 1, 1)], "customer_id string, url string, html_tokens int, md_tokens int")
    rows = {r.url: r for r in pages.preview_panels(listed, cache.content_bundle(log, at(60)), metrics, limit=6).collect()}
    assert {u: (r.html_state, r.md_state) for u, r in rows.items()} == {
        "u0": ("not_analysed",) * 2, "u1": ("shown",) * 2, "u2": ("expired", "shown"), "u3": ("expired",) * 2, "u4": ("not_analysed",) * 2}
    one = rows["u1"]
    assert (one.html_preview, one.html_chars, one.html_truncated, one.md_preview, one.md_truncated) == ("<p>😀", 11, True, "a\n\nb", False)
    assert (one.html_tokens, one.html_size, one.md_tokens, one.savings_pct) == (40, "160 B", 10, 75)
    assert (rows["u3"].html_tokens, rows["u3"].savings_pct, rows["u3"].html_preview) == (300, 90, None)
    assert (rows["u2"].md_tokens, rows["u2"].html_tokens, rows["u2"].savings_pct, rows["u4"].html_size) == (1, 0, None, "— B")


def test_altered_stored_rows_are_found(spark):
    html = "<body><nav>menu</nav><main><h1>Great tea</h1><p>Tea from <b>Assam</b>, tea.</p></main></body>"
    c = pages.extract_signed(spark.createDataFrame([(i, html if i else None) for i in range(5)], "wid long, html string"))
    c = c.withColumns({"url_key": F.concat(F.lit("k"), "wid"), "written_at": F.lit(T0), "html": F.lit(None).cast("string")}).cache()
    row = c.filter("wid = 1").first()
    assert len(row.shown_marks) == 5 and len(row.main_marks) == 4 and row.shown_marks == sorted(row.shown_marks)
    assert row.markdown == pages.extract_markdown(spark.createDataFrame([(html,)], "html string")).first().markdown
    content, marks = work_dir(spark, "content"), work_dir(spark, "marks")
    sinks.write_signatures(c.filter("wid < 4"), marks)
    said = F.when(F.col("wid") == 2, F.concat("markdown", F.lit(" menu poison"))).when(F.col("wid") == 3, F.lit("# Great tea")).otherwise(F.col("markdown"))
    sinks.write_content(c.withColumn("markdown", said), content)
    found = {r.wid: r[2:] for r in pages.stored_equivalence(readers.read_content(spark, content), readers.read_signatures(spark, marks)).collect()}
    assert found == {1: ("equal", 0, 4, 4), 2: ("invented", 1, 4, 4), 3: ("altered", 0, 4, 2), 4: ("unsigned", None, None, None)}


def test_large_sites_and_crawls_keep_everything(spark):
    urls = [f"https://a.com/{i}" for i in range(6000)]
    maps = spark.createDataFrame([("c", "d", "a.com", json.dumps(urls))], "customer_id string, domain_id string, hostname string, payload string")
    assert seeds.starter_candidates(maps).count() == 6000
    assert seeds.starter_candidates(maps, cap=5).agg(F.max("ordinal")).first()[0] == 4
    data = [{"markdown": "# x", "metadata": {"sourceURL": u, "title": "t"}} for u in urls[:150]]
    replies = spark.createDataFrame([("j", "c", json.dumps({"status": "completed", "data": data}))], "crawl_id string, customer_id string, payload string")
    for limit in (2, 500):
        jobs = spark.createDataFrame([("j", "c", limit, True, [])], "id string, customer_id string, limit int, cache_results boolean, allowed_domains array<string>")
        assert flows.store_crawl(replies, jobs)[1].count() == 150


def test_job_replies_are_named(spark):
    bodies = ['{"id": "false", "urls": ["u"]}', '{"id": "0", "urls": ["u"]}', '{"jobId": 7, "urls": ["u"]}', '{"job_id": {}, "urls": ["u"]}', "{broken",
              '{"id": false, "urls": ["u"]}', '{"id": 0, "urls": ["u"]}', '{"id": "", "urls": ["u"]}', '{"id": 0.0, "urls": ["u"]}', "[]"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, payload string")
    assert {r.i: r.reason for r in seeds.rejected_site_maps(df).collect()} == {
        0: "job_reply", 1: "job_reply", 2: "job_reply", 3: "job_reply", 4: "invalid_json"}
    assert sorted(r.i for r in seeds.explode_site_map(df).collect()) == [5, 6, 7, 8]


def test_metric_counts_must_be_whole_and_in_range(spark):
    body = '{"customerId":"c","url":"u","htmlTokens":%s,"mdTokens":%s}'
    values = [("1", "2"), ("null", "2"), ("1.0", "2"), ("1.7", "2"), ("1", "99999999999"), ("1e300", "2"), ("2147483647", "-2147483648"), ("2147483648", "1"), ('"1"', "2")]
    df = spark.createDataFrame([(i, body % v, at(i)) for i, v in enumerate(values)], "seq long, body string, received_at timestamp")
    got = {r.seq: (r.error_code, r.html_tokens, r.md_tokens) for r in report.split_valid_metrics(df).collect()}
    bad = ("invalid_number", None, None)
    assert got == {0: (None, 1, 2), 1: (None, None, 2), 2: (None, 1, 2), 3: bad, 4: bad, 5: bad, 6: (None, 2147483647, -2147483648), 7: bad,
                   8: ("missing_fields", None, None)}


def test_refused_metrics_keep_their_payload(spark):
    path = work_dir(spark, "metrics")
    df = spark.createDataFrame([(1, "broken", at(0)), (1, '{"customerId":"c","url":"u","htmlTokens":1,"mdTokens":1}', at(1))], "seq long, body string, received_at timestamp")
    sinks.append_metrics(df, 0, path)
    assert [(r.body, r.error_code) for r in sinks.read_quarantine(spark, path).collect()] == [("broken", "invalid_json")]
    assert sinks.read_metrics(spark, path).count() == 1


def test_metric_payloads_are_parsed_once(spark):
    df = spark.createDataFrame([(1, "{}", at(0))], "seq long, body string, received_at timestamp")
    plan = report.split_valid_metrics(df).filter("error_code is null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson") == 1


def test_unknown_plans_and_customers_have_no_limits(spark):
    usage = spark.createDataFrame([(c, "2024-01", 10**9) for c in ("free", "big", "odd", "none", "gone")], "customer_id string, month string, renders long")
    accounts = spark.createDataFrame([("free", "free"), ("big", "enterprise"), ("odd", "gold"), ("none", None)], "id string, plan string")
    got = {r.customer_id: (r.problem, r.overage) for r in ops.quota(usage, accounts).collect()}
    assert got == {"free": (None, 10**9 - 1000), "big": (None, 0), "odd": ("unknown_plan", None), "none": ("unknown_plan", None), "gone": ("unknown_customer", None)}


def test_sections_sort_by_locale(spark):
    names = ["zeta", "über", "ab", "a-b", "_x", "1a", "Alpha"]
    df = spark.createDataFrame([("c", f"https://a.com/{n}", i) for i, n in enumerate([*names, ""])], "customer_id string, url string, ordinal int")
    rows = report.rank_sections(df).orderBy("section_rank").collect()
    assert [r.section for r in rows] == ["/", "/_x", "/1a", "/a-b", "/ab", "/Alpha", "/über", "/zeta"]


def test_long_keys_match_whole(spark):
    config = spark.createDataFrame([("apikey:" + "k" * 100, '{"id": "c"}'), ("apikeyhash:" + "h" * 80, '{"id": "d"}')], "key string, document string")
    req = spark.createDataFrame([(1, "k" * 100), (2, "k" * 99), (3, "x")], "request_id long, token string")
    assert [r.request_id for r in access.auth_lookup(req, config).filter("auth_found").collect()] == [1]


def test_large_tables_keep_their_html_in_place(spark):
    few, many = spark.range(0, 10, 1, 1), spark.range(0, 10, 1, 64)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(many) is many
    html = spark.range(0, 64, 1, 64).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.com/"), "id").alias("url"), F.lit("<main>x</main>").alias("html"))
    for df in (flows.token_savings_by_section(spread(html)), pages.extract_markdown(spread(html)), pages.equivalence_audit(spread(html))):
        plan = df._jdf.queryExecution().executedPlan()
        for line in plan.toString().splitlines():
            assert not ("Exchange" in line and "html#" in line)
        assert "RoundRobin" not in plan.toString()


def test_requests_without_a_key_take_no_part_in_joins(spark):
    w = spark.createDataFrame([(1, None, "md", "x", at(0), 900), (2, "k", "md", "x", at(0), 900)],
                              "wid long, url_key string, kind string, body string, written_at timestamp, ttl_s long")
    r = spark.createDataFrame([(1, None, at(5)), (2, "k", at(5)), (3, None, at(6))], "request_id long, url_key string, ts timestamp")
    assert {x.request_id: x.cache_status for x in cache.cache_lookup(r, w).collect()} == {1: "MISS", 2: "HIT", 3: "MISS"}
    r = r.withColumns({"outcome": F.lit("miss"), "latency_ms": F.lit(9000).cast("long")})
    assert cache.in_flight_followers(r).count() == 0
    many = spark.range(0, 4000, 1, 4).select(F.col("id").alias("request_id"), F.lit(None).cast("string").alias("token"))
    sizes = many.withColumn("k", access.spread_nulls(F.col("token"), many)).select("k").distinct().count()
    assert sizes == 4000
    found = access.auth_lookup(many, config(spark))
    assert found.count() == 4000 and found.filter("auth_found").count() == 0


def test_an_allowlist_counts_once_for_all_its_tokens(spark):
    doc = '{"v":2,"id":"c","plan":"pro","domains":["a.com","b.com","a.com"],"updatedAt":"t"}'
    c = spark.createDataFrame([(f"apikeyhash:{i}", doc) for i in range(50)], "key string, document string")
    assert access.allowed_hosts(c).count() == 2


def test_secrets_in_errors_and_stacks(spark):
    logs = spark.createDataFrame([(1, "m", "at https://a.com/x", None, None), (2, "m", None, "in http://b.com/", None), (3, "m", "e", "s", "d")],
                                 "request_id long, msg string, err string, stack string, data string")
    none = spark.createDataFrame([], "key string, document string")
    assert sorted(r.ref for r in audits.secrets_audit(none, logs).collect()) == ["1", "2"]


def test_crawl_replies_keep_every_reply(spark):
    page = '{"markdown":"x","metadata":{"sourceURL":"https://a.com/","title":"t"}}'
    rows = [
        ("done", '{"status":"completed","total":2,"completed":2,"creditsUsed":1,"data":[%s,%s]}' % (page, page)),
        ("late", '{"status":"completed","data":[],"expiresAt":"2024-01-01T00:00:00Z"}'),
        ("runs", '{"status":"scraping","total":5,"expiresAt":"2024-01-01T01:00:00.000Z"}'),
        ("edge", '{"status":"scraping","expiresAt":"2024-01-01T00:50:00Z"}'), ("odd", '{"status":"scraping","expiresAt":"soon"}'),
        ("cut", '{"status":"completed","data":[%s' % page), ("none", None), ("empty", ""), ("list", "[1]"), ("bare", "{}"),
        ("wrong", '{"status":"completed","total":"many"}')]
    got = {r.id: tuple(r)[1:] for r in crawl.crawl_replies(spark.createDataFrame(rows, "id string, payload string"), "2024-01-01 00:50:00").collect()}
    unread = ("unreadable", None, None, None, None, None)
    assert got == {
        "done": ("completed", 2, 2, 1, None, 2), "late": ("completed", 0, 0, 0, "2024-01-01T00:00:00Z", 0),
        "runs": ("running", 5, 0, 0, "2024-01-01T01:00:00.000Z", None), "edge": ("expired", 0, 0, 0, "2024-01-01T00:50:00Z", None),
        "odd": ("running", 0, 0, 0, "soon", None), "cut": unread, "none": unread, "empty": unread, "list": unread, "bare": unread, "wrong": unread}


def test_crawl_jobs_end_an_hour_after_their_last_write(spark):
    jobs = spark.createDataFrame(
        [("new", at(0), None), ("old", at(-3600), None), ("edge", at(-3599), None), ("renewed", at(-9000), at(-60)), ("unknown", None, None)],
        "id string, started_at timestamp, completed_at timestamp")
    assert sorted(r.id for r in crawl.live_jobs(jobs, "2024-01-01 00:00:00").collect()) == ["edge", "new", "renewed"]


def test_list_drift_lists_agents_that_nobody_uses(spark):
    req = spark.createDataFrame([("Mozilla Bingbot/2",), ("bingbot bytespider",), ("GPTBot",), (None,)], "user_agent string")
    got = traffic.list_drift(req, {"a": ["gptbot", "bytespider", "ccbot"], "b": ["gptbot", "bingbot"]}).collect()
    assert sorted(map(tuple, got)) == [("bingbot", 2, False, True), ("bytespider", 1, True, False), ("ccbot", 0, True, False)]
    assert traffic.list_drift(req, {"a": ["gptbot"], "b": ["gptbot"]}).collect() == []


@pytest.mark.parametrize("mode", ["render", "internal", "crawl"])
def test_admission_joins_carry_narrow_rows(spark, mode):
    """Between its joins admission holds no column that the answer lacks, and documents are not sorted (F6)."""
    req = spark.createDataFrame(
        [(1, "c1", "t", "https://a.com/x", True, "wide"), (2, None, None, None, True, "wide"), (3, "c1", "t", "https://b.com/", None, "wide")],
        "request_id long, customer_id string, token string, url string, service_ok boolean, pad string")
    document = '{"id":"c1","domains":["a.com","a.com"]}'
    config = spark.createDataFrame([("customer:c1", document), ("apikey:t", document), ("apikey:gone", None)], "key string, document string")
    found = access.admit(req, config, mode).select("request_id", "http_status")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    between = plan.split("Join LeftOuter")[1]
    assert plan.count("Join LeftOuter") >= 2 and "pad#" not in between and "url#" not in between
    hosts = access.allowed_hosts(config)
    assert "SortAggregate" not in hosts._jdf.queryExecution().executedPlan().toString()
    assert [r.host for r in hosts.collect()] == ["a.com"]
    refused = {"render": 401, "internal": 400, "crawl": 401}[mode]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 200), (2, refused), (3, 401 if mode == "internal" else 403)]
