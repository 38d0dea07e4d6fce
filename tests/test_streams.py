"""Streams over several batches, and the SQL functions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webmill import lists
from webmill.functions import sql
from webmill.functions.text import estimate_tokens
from webmill.operators import cache, pages
from webmill.session import work_dir
from webmill.sources import sinks
from webmill.streaming import cache_state, jobs, replay, single_flight
from test_functions import CANONICAL

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def batches(spark, frames, name):
    """A stream that reads one file per micro-batch, in order."""
    path = work_dir(spark, name)
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_metrics_stream_is_idempotent_and_keeps_order(spark):
    body = '{"customerId":"c","url":"u","htmlTokens":%s,"mdTokens":%s,"optimizedAt":"2024-01-01T00:00:00.000Z"}'
    rows = [(1, body % (10, 5), at(1)), (2, body % ("null", "null"), at(2)), (3, "broken", at(3)), (4, body % (8, 4), at(4))]
    schema = "seq long, body string, received_at timestamp"
    stream = batches(spark, [spark.createDataFrame(rows[:2], schema), spark.createDataFrame(rows[2:], schema)], "events")
    path, check = work_dir(spark, "metrics"), work_dir(spark, "check")
    for _ in range(2):  # the second start finds nothing new
        jobs.metrics_stream(stream, path, check).awaitTermination()
    row = sinks.read_metrics(spark, path).collect()
    assert [(r.html_tokens, r.md_tokens, r.created_at, r.updated_at) for r in row] == [(8, 4, at(1), at(4))]
    sinks.append_metrics(spark.createDataFrame(rows[2:], schema), 1, path)  # a repeated batch
    assert sinks.read_metrics(spark, path).collect() == row
    base = work_dir(spark, "base")
    sinks.compact_metrics(spark, path, base)
    assert spark.read.parquet(base).count() == 1


def test_no_billed_row_is_lost_however_late(spark):
    schema = "customer_id string, ts timestamp, endpoint string, outcome string"
    day = lambda n, s=0: T0 + timedelta(days=n, seconds=s)
    first = [("a", day(40), "render", "miss"), ("a", day(40, 9), "render", "hit"), (None, day(40), "render", "miss"), ("b", day(1), "render", "miss")]
    late = [("a", day(0), "render", "miss"), ("a", day(40, 5), "render", "miss"), ("b", day(1, 1), "proxy", "miss"), ("b", day(1, 2), "render", "miss")]
    path, check = work_dir(spark, "usage"), work_dir(spark, "check")
    stream = batches(spark, [spark.createDataFrame(rows, schema) for rows in (first, late)], "billed")
    for _ in range(2):  # the second start finds nothing new
        jobs.usage_sink(stream, path, check).awaitTermination()
    want = {("a", "2024-02", 2), ("a", "2024-01", 1), ("b", "2024-01", 2)}
    assert {tuple(r) for r in jobs.usage_months(spark, path).collect()} == want
    jobs.usage_days(spark.createDataFrame(late, schema)).write.mode("overwrite").parquet(f"{path}/batch_id=1")  # a batch that runs again
    assert {tuple(r) for r in jobs.usage_months(spark, path).collect()} == want


def flight_by_hand(rows):
    out, marker = {}, {}
    for i, ts, key, latency in sorted(rows, key=lambda r: (r[1], r[0])):
        if key not in marker or ts >= marker[key][1]:
            marker[key] = (i, ts + timedelta(milliseconds=min(latency, 30000)))
        out[i] = marker[key][0]
    return out


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_single_flight_does_not_depend_on_batches(spark, parts):
    rnd = random.Random(5)
    rows = [(i, at(i // 3 + rnd.randrange(4)), rnd.choice(["hot", "hot", "a", "b"]), rnd.choice([0, 900, 4000, 29000, 90000])) for i in range(420)]
    rows.append((999, at(1000), "end", 0))  # moves the watermark past all others
    schema = "request_id long, ts timestamp, url_key string, latency_ms long"
    size = -(-len(rows) // parts)
    frames = [spark.createDataFrame(rows[k:k + size], schema) for k in range(0, len(rows), size)]
    path = work_dir(spark, "flight")
    single_flight.single_flight_sink(batches(spark, frames, f"r{parts}"), path, work_dir(spark, "c")).awaitTermination()
    got = {r.request_id: r.leader_id for r in single_flight.single_flight_answers(spark, path).collect()}
    want = flight_by_hand(rows)
    del want[999]
    assert got == want


def test_pieces_of_a_key_are_answered_apart(spark):
    """Markers cross many pieces; the tables of transitions give each piece its first one."""
    rnd = random.Random(7)
    rows = [(i, at(rnd.randrange(900)), "hot", rnd.choice([0, 900, 29000, 90000])) for i in range(1500)]
    rows += [(5000 + i, at(1000 + 29 * i), "hot", 30000) for i in range(20)]  # each marker is met by the next request
    frame = spark.createDataFrame(rows, "request_id long, ts timestamp, url_key string, latency_ms long")
    ready = single_flight.flight_rows(frame)
    found, ends = single_flight.answer(ready, spark.createDataFrame([], single_flight.CARRY), 0)
    want = flight_by_hand(rows)
    assert {r.request_id: r.leader_id for r in found.collect()} == want
    assert [r.leader_id for r in ends.collect()] == [want[5019]]
    carry = spark.createDataFrame([("hot", -1, int((at(0) - datetime(1970, 1, 1)).total_seconds()) * 1000000 + 130_000_000), ("gone", -2, 5)], single_flight.CARRY)
    later, ends = single_flight.answer(ready, carry, 10)
    assert {r.leader_id for r in later.collect() if dict((i, t) for i, t, _, _ in rows)[r.request_id] < at(130)} == {-1}
    assert [r.key for r in ends.collect()] == ["hot"]


def test_transitions_equal_a_walk():
    import numpy as np

    rnd = np.random.default_rng(3)
    for size in (1, 2, 40):
        moment = np.sort(rnd.integers(0, 60, size))
        done, number = moment + rnd.integers(0, 9, size), np.arange(size) + 100
        upto, leader, until = single_flight.transitions(moment, done, number)
        for m in range(-1, 70):
            marker = (None, m)
            for t, d, n in zip(moment, done, number):
                if t >= marker[1]:
                    marker = (n, d)
            i = int(np.searchsorted(upto, m, side="left"))
            assert marker == ((None, m) if i == len(upto) else (leader[i], until[i]))


def test_rows_behind_the_watermark_are_kept_aside(spark):
    schema = "request_id long, ts timestamp, url_key string, latency_ms long"
    frames = [spark.createDataFrame(r, schema) for r in ([(1, at(100), "a", 5)], [(2, at(10), "a", 5), (3, at(90), "a", 5)], [(4, at(300), "a", 5)])]
    path = work_dir(spark, "flight")
    single_flight.single_flight_sink(batches(spark, frames, "late"), path, work_dir(spark, "c")).awaitTermination()
    assert {r.request_id for r in single_flight.single_flight_answers(spark, path).collect()} == {1, 3}
    assert [r.id for r in replay.late(spark, path, single_flight.ROWS).collect()] == [2]
    replay.finish(spark, path, single_flight.ROWS, single_flight.answer, single_flight.CARRY)
    assert {r.request_id for r in single_flight.single_flight_answers(spark, path).collect()} == {1, 3, 4}


def test_a_batch_that_runs_again_replaces_its_answers(spark):
    schema = "request_id long, ts timestamp, url_key string, latency_ms long"
    path = work_dir(spark, "flight")
    run = lambda n, rows: replay.step(
        single_flight.flight_rows(spark.createDataFrame(rows, schema)), n, path, single_flight.answer, single_flight.CARRY, "at_us", 30)
    run(0, [(1, at(100), "a", 20000), (2, at(101), "a", 5)])
    for _ in range(2):
        run(1, [(3, at(115), "a", 5), (4, at(200), "a", 5)])
    run(2, [(5, at(400), "a", 5)])
    assert sorted((r.request_id, r.leader_id) for r in single_flight.single_flight_answers(spark, path).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]


RULES = [
    {"rule": "slow", "level": "warning", "window_min": 15, "over": 10, "num": 1, "den": 20},
    {"rule": "fast", "level": "critical", "window_min": 5, "over": 5, "num": 1, "den": 4},
    {"rule": "now", "level": "critical", "window_min": 1, "over": 2, "num": 1, "den": 2}]


@pytest.mark.parametrize("rules", [RULES, RULES[::-1], *[[r] for r in RULES], []], ids=["order", "reversed", "slow", "fast", "now", "none"])
def test_alert_stream_over_batches_equals_the_batch_rules(spark, rules):
    rnd = random.Random(3)
    times = sorted(rnd.randrange(3600) for _ in range(600))
    rows = [(at(t), "fallback" if rnd.random() < (0.7 if 1200 < t < 2000 else 0.1) else "hit", rnd.choice([None, 200, 200, 503])) for t in times]
    shuffled = [r for k in range(0, 600, 40) for r in rnd.sample(rows[k:k + 40], 40)]  # out of order by less than the watermark
    schema = "ts timestamp, outcome string, extractor_status int"
    frames = [spark.createDataFrame(shuffled[k:k + 200], schema) for k in (0, 200, 400)]
    frames.append(spark.createDataFrame([(at(9000), "hit", None)], schema))  # closes all windows
    path = work_dir(spark, "alerts")
    jobs.append_to(jobs.alert_stream(batches(spark, frames, "alerts-in"), rules), path, work_dir(spark, "c")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(path).collect()))
    want = []
    minute = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) // 60
    alarm = {**lists.EXTRACTOR_ALERT, "window_min": 15}
    for rule in [*rules, alarm]:
        for start in range(minute(T0) - 15, minute(T0) + 61):
            inside = [r for r in rows if start <= minute(r[0]) < start + rule["window_min"]]
            n, bad = len(inside), sum(r[1] == "fallback" for r in inside)
            if rule is alarm:
                n, bad = sum(r[2] is not None for r in inside), sum((r[2] or 0) >= 500 for r in inside)
            if bad * rule["den"] > n * rule["num"] and n > rule.get("over", -1):
                want.append((rule["rule"], rule["level"], start, n, bad))
    assert got == sorted(want)
    assert {r["rule"] for r in rules} <= {w[0] for w in want}


PUT = "wid long, url_key string, kind string, body string, written_at timestamp, ttl_s long"
ASK = "request_id long, url_key string, ts timestamp"


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_cache_state_over_batches_equals_the_batch_join(spark, parts):
    rnd = random.Random(9)
    puts = [(i, rnd.choice("kkkj"), "md", rnd.choice(["# a", "# b", "<html>"]), at(10 * i + rnd.randrange(10)), rnd.choice([20, 150, 900])) for i in range(60)]
    asks = [(i, rnd.choice(["k", "k", "j", "x", None]), at(3 * i)) for i in range(200)]

    def dealt(rows, when, schema):  # in order of time, each part shuffled, parts overlap by less than the delay
        rows = sorted(rows, key=lambda r: r[when] + timedelta(seconds=rnd.randrange(100)))
        size = -(-len(rows) // parts)
        return [spark.createDataFrame(rnd.sample(rows[k:k + size], len(rows[k:k + size])), schema) for k in range(0, len(rows), size)]

    path = work_dir(spark, "state")
    cache_state.cache_state_sink(
        batches(spark, dealt(puts, 4, PUT), "p"), None, batches(spark, dealt(asks, 2, ASK), "q"), path, work_dir(spark, "c")).awaitTermination()
    cache_state.cache_state_finish(spark, path)
    row = lambda r: (r.request_id, r.cache_status, r.wid, r.age_s)
    want = {row(r) for r in cache.cache_lookup(spark.createDataFrame(asks, ASK), spark.createDataFrame(puts, PUT)).collect()}
    assert sorted(map(row, cache_state.cache_state_answers(spark, path).collect()), key=repr) == sorted(want, key=repr)
    assert {w[1] for w in want} == {"HIT", "MISS"}


def test_state_of_a_key_ends_with_its_life(spark):
    path = work_dir(spark, "state")

    def run(n, puts, asks):
        events = cache_state.cache_events(spark.createDataFrame(puts, PUT), None, spark.createDataFrame(asks, ASK))
        replay.step(events, n, path, cache_state.answer, cache_state.CARRY, "at_us", 0)
        return {r.url_key for r in spark.read.schema(cache_state.CARRY).parquet(f"{path}/state/{n}/carry").collect()}

    assert run(0, [(i, f"k{i}", "md", "# t" if i else "<html>", at(i), 100) for i in range(50)], [(1, "k1", at(60))]) == {f"k{i}" for i in range(1, 50)}
    assert run(1, [], [(2, "k9", at(120))]) == {f"k{i}" for i in range(21, 50)}
    assert run(2, [(77, "k30", "md", "# t", at(121), 1000)], [(3, "k40", at(1000))]) == {"k30"}
    cache_state.cache_state_finish(spark, path)
    got = {r.request_id: (r.cache_status, r.wid) for r in cache_state.cache_state_answers(spark, path).collect()}
    assert got == {1: ("HIT", 1), 2: ("MISS", None), 3: ("MISS", None)}


def test_invalidation_clears_the_state(spark):
    puts = spark.createDataFrame([(1, "k", "md", "# a", at(0), 500), (2, "j", "md", "# a", at(50), 500)], PUT)
    gone = spark.createDataFrame([("k", at(50)), ("j", at(50))], "url_key string, received_at timestamp")
    asks = spark.createDataFrame([(1, "k", at(10)), (2, "k", at(60)), (3, "j", at(60))], ASK)
    path = work_dir(spark, "state")
    cache_state.cache_state_sink(*[batches(spark, [f], "i") for f in (puts, gone, asks)], path, work_dir(spark, "c")).awaitTermination()
    cache_state.cache_state_finish(spark, path)
    assert {(r.request_id, r.cache_status) for r in cache_state.cache_state_answers(spark, path).collect()} == {(1, "HIT"), (2, "MISS"), (3, "MISS")}


def test_sql_functions(spark):
    sql.register(spark)
    df = spark.createDataFrame([(u,) for u, _, _ in CANONICAL], "u string")
    df.createOrReplaceTempView("given")
    got = {r.u: r.c for r in spark.sql("SELECT u, canonical_url(u) AS c FROM given").collect()}
    assert got == {u: c for u, c, _ in CANONICAL}
    row = spark.sql("""SELECT seed_url('http://www.a.com/x?ref=1'), seed_url('https://a.com/x.PNG'), bare_host('WWW.a.com'),
        is_ai_agent('GPTBot/1'), is_ai_agent(NULL), bot_family('bingbot'), is_private_host('10.1.1.1'), is_private_host('a.com'),
        looks_like_html(' <HTML>'), looks_like_html('# t'), token_estimate('abcde'), savings_pct(200, 175)""").first()
    assert list(row) == ["http://a.com/x", None, "a.com", True, False, "bing", True, False, True, False, 2, 13]
    keys = pages.with_url_key(spark.createDataFrame([("https://a.com/",)], "canonical string"))
    keys.createOrReplaceTempView("keys")
    assert spark.sql("SELECT url_key(canonical) = url_key FROM keys").first()[0]
    assert spark.range(1).select(estimate_tokens(F.lit("abcde"))).first()[0] == 2
