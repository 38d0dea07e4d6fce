"""Line frequency, URL rules, quality and toxicity: brute force, planted cases and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webmill.llm import line_frequency, quality, toxicity, url_rules
from webmill.llm.logistic import fit

FOLDER = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return [w.decode() for w in text.encode().split()]


def base_counts(text):
    text = text or ""
    own = words(text)
    windows = Counter(tuple(own[i:i + 3]) for i in range(len(own) - 2))
    inside = {i + k for i in range(len(own) - 2) if windows[tuple(own[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def form(line):
    return re.sub(f"[{SPACE}]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(SPACE)


def judged_by_hand(rows, min_docs, share, depleted):
    texts, holders = defaultdict(set), defaultdict(set)
    for r in rows:
        texts[r.source].add(r.text or "")
        for line in (r.text or "").split("\n"):
            if line.strip(SPACE):
                holders[r.source, form(line)].add(r.text or "")
    out = []
    for r in rows:
        gone = sum(len(words(form(line))) for line in (r.text or "").split("\n")
                   if line.strip(SPACE) and len(holders[r.source, form(line)]) > max(min_docs, share * len(texts[r.source])))
        base = base_counts(r.text)
        out.append((r.doc_id, *base, gone, gone > depleted * base[0]))
    return sorted(out, key=repr)


COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "depleted"]


def test_line_frequency_of_odd_rows(odd_docs):
    got = line_frequency.judge(odd_docs, min_docs=1, share=0.05).select(*COUNTS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == judged_by_hand(odd_docs.collect(), 1, 0.05, 0.5)


def test_line_frequency_equals_brute_force(spark):
    rng = random.Random(2)
    common = ["All rights reserved 2024", "Home  About\tContact", "Read more", "x"]
    rows = []
    for i in range(400):
        lines = [rng.choice(common) + rng.choice(["", " ", " 7"]) if rng.random() < 0.4 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 8))]
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "a", "b", None])))
    rows += [(1000 + i, rows[0][1], "a") for i in range(100)]  # copies do not make a line common
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = line_frequency.judge(docs, min_docs=5, share=0.1).select(*COUNTS).collect()
    want = judged_by_hand(docs.collect(), 5, 0.1, 0.5)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert 0 < sum(w[-1] for w in want) < len(want)


def test_line_frequency_limits_do_not_grow_with_the_host(spark):
    holders = {"hot": (2000, {"Shared by many": 90, "Just above": 26, "Just below": 25}), "small": (60, {"Just above": 21, "Just below": 20})}
    rows = []
    for host, (n, lines) in holders.items():
        for i in range(n):
            own = "".join(chr(97 + int(c)) for c in f"{i:04}")
            rows.append((len(rows), "\n".join([f"own words {own}", *(line for line, held in lines.items() if i < held)]), host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    gone = {r.doc_id: r.removed_words for r in line_frequency.judge(docs).collect() if r.removed_words}
    assert gone == {**{i: 3 + 2 * (i < 26) for i in range(90)}, **{2000 + i: 2 for i in range(21)}}


def test_clean_documents_lose_their_common_lines_only(spark):
    rows = [(i, f"own line {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (i + 1)}\nSubscribe now!\nlast", "h") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = {"min_docs": 10, "share": 0.1, "depleted": 0.9}
    texts = {r.doc_id: r.text for r in line_frequency.clean(docs, **limits).collect()}
    assert texts == {i: t.split("\n")[0] for i, t, _ in rows}
    # null and repeated ids, whole rows repeated: one row for each row
    rows += [(None, "own line x\nlast", "h"), (None, "own line y\nlast", "h"), (3, "another own line\nSubscribe now!", "h"), rows[4]]
    odd = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, source string, _row int, _host string")
    got = [(r.doc_id, r.text) for r in line_frequency.clean(odd, **limits).collect()]
    assert sorted(got, key=repr) == sorted(((i, t.split("\n")[0]) for i, t, _ in rows), key=repr)


def test_line_frequency_of_nothing(no_docs):
    assert line_frequency.judge(no_docs).collect() == []


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"))
URLS = [
    (None, None), (1, ""), (2, "no scheme"), (3, "http://EXAMPLE.org/es/x"), (4, "https://a.example.org/es"), (5, "http://example.org/en/1?x=/es/"),
    (6, "http://notexample.org/es/1"), (7, "http://x.org"), (8, "http://x.org?a/b"), (9, "a://b://c/d"), (10, "http:///path"), (11, "http://x.org/#?q"),
    (12, "http://ÄÖ.org/é"), (13, "http://x.net/" + "a/" * 3000), (14, "http://x.net/?" + "&".join(f"p{i}=1" for i in range(300))), (3, "http://EXAMPLE.org/es/x"),
]


def test_urls_are_cut_and_ruled(spark):
    pages = spark.createDataFrame([(*r, "h", "p") for r in URLS], "page_id long, url string, host string, verdict string")
    rows = url_rules.judge(pages, RULES, support=0.5).collect()
    got = {r.page_id: (r.host, r.path[:8], r.rule) for r in rows}
    assert len(rows) == len(URLS)
    assert got == {
        None: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("example.org", "/es/x", "example.org/es/"), 4: ("a.example.org", "/es", "org/"),
        5: ("example.org", "/en/1", "example.org/en/1"), 6: ("notexample.org", "/es/1", "org/"), 7: ("x.org", "", None), 8: ("x.org", "", None),
        9: ("b:", "//c/d", None), 10: ("", "/path", None), 11: ("x.org", "/", "org/"), 12: ("ÄÖ.org", "/é", "org/"), 13: ("x.net", "/a/a/a/a", None), 14: ("x.net", "/", None)}
    assert {r.page_id: r.verdict for r in rows if r.rule} == {3: "block", 4: "allow", 5: "block", 6: "allow", 11: "allow", 12: "allow"}


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(4)
    urls = [(i, f"http://{rng.choice(['www', 'm'])}.{rng.choice(['a', 'b', 'example'])}.{rng.choice(['org', 'net'])}/{rng.choice(['es', 'en', 'de'])}/{rng.randint(1, 2)}?{rng.choice(['q', 'id'])}=1") for i in range(600)]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    rows = url_rules.judge(pages, RULES, support=0.02, confidence=0.7, longest=2, most=20).collect()
    split = {i: hand_tokens(u) for i, u in urls}
    ruled = {r.page_id: r.verdict for r in rows if r.rule}
    seen, with_ = Counter(), Counter()
    for i, verdict in ruled.items():
        for n in (1, 2):
            for c in combinations(sorted(split[i]), n):
                seen[c] += 1
                with_[c, verdict] += 1
    least = math.ceil(0.02 * len(ruled))
    mined = {(c, v): n / seen[c] for (c, v), n in with_.items() if n >= least and n / seen[c] >= 0.7}
    for r in rows:
        best = {v: max((p for (c, w), p in mined.items() if w == v and set(c) <= split[r.page_id]), default=None) for v in ("block", "allow")}
        assert (r.block_confidence, r.allow_confidence) == (best["block"], best["allow"])
        if not r.rule:
            assert r.verdict == ("block" if (best["block"] or 0) > (best["allow"] or 0) else "allow")
    assert {r.verdict for r in rows if not r.rule} == {"allow", "block"}


def hand_tokens(url):
    host, path, query = re.fullmatch(r"http://([^/]*)([^?]*)\?(.*)", url).groups()
    out = {f"h{i}:{x}" for i, x in enumerate(host.split(".")[::-1])}
    out |= {f"p{i}:{x}" for i, x in enumerate([x for x in path.split("/") if x])}
    return out | {f"q:{x.split('=')[0]}" for x in query.split("&")}


def test_url_rules_of_any_length_equal_brute_force(spark):
    rng = random.Random(6)
    path = lambda: "/".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
    urls = [(i, f"http://{rng.choice(['u', 'w'])}.x.{rng.choice(['k', 'l'])}.example.{rng.choice(['org', 'net'])}/{rng.choice(['es', 'en', 'de'])}/{path()}?{rng.choice('ef')}=5") for i in range(300)]
    rules = (("allow", "org", "/"), ("block", "example.org", "/es/a/b/a"), ("block", "u.x.k.example.org", "/en/"), ("block", "w.x.l.example.org", "/de/b/"))
    rows = url_rules.judge(spark.createDataFrame(urls, "page_id long, url string").repartition(3), rules, support=0.03, longest=None, most=20).collect()
    split = {i: hand_tokens(u) for i, u in urls}
    ruled = {r.page_id: r.verdict for r in rows if r.rule}
    seen, with_ = Counter(), Counter()
    for i, verdict in ruled.items():
        for n in range(1, len(split[i]) + 1):
            for c in combinations(sorted(split[i]), n):
                seen[c] += 1
                with_[c, verdict] += 1
    least = math.ceil(0.03 * len(ruled))
    mined = [(frozenset(c), v, n / seen[c]) for (c, v), n in with_.items() if n >= least and n / seen[c] >= 0.8]
    longer = 0
    for r in rows:
        fit = [(v, p, len(c)) for c, v, p in mined if c <= split[r.page_id]]
        best = [max((p for w, p, _ in fit if w == v), default=None) for v in ("block", "allow")]
        assert [r.block_confidence, r.allow_confidence] == best
        longer += best != [max((p for w, p, n in fit if w == v and n < 3), default=None) for v in ("block", "allow")]
    assert longer


def test_url_rules_reach_the_end_of_a_url(spark):
    host = "http://{}.b.c.d.{}/1/2/3/{}?a=1&b=1&c=1&d=1&{}=1"
    rules = (("allow", "org", "/"), *(("block", f"bad{i}.b.c.d.org", "/") for i in range(2)), *(("block", "org", f"/1/2/3/bad{i}") for i in range(2)))
    kinds = [("bad0", "x", "x"), ("x", "bad0", "x"), ("x", "x", "x"), ("y", "y", "y")]
    urls = [host.format(h, "org", p, q) for h, p, q in kinds for _ in range(10)] + [host.format(h, "net", p, q) for h, p, q in kinds]
    rows = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, support=0.1, longest=None).collect()
    assert {r.page_id: r.verdict for r in rows if not r.rule} == {40: "block", 41: "block", 42: "allow", 43: "allow"}


def test_url_rules_of_hosts_below_the_share(spark, monkeypatch):
    rules = (("allow", "org", "/"), ("block", "spam.org", "/"))
    urls = [f"http://{'spam' if i < 6 else f'h{i % 40}'}.org/{i}" for i in range(1000)] + ["http://spam.net/7", "http://h1.net/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    rows = url_rules.judge(pages, rules, most=5).collect()
    assert {r.page_id: r.verdict for r in rows if not r.rule} == {1000: "block", 1001: "allow"}
    monkeypatch.setattr(url_rules, "SENT", 0)  # shuffled index
    assert sorted(url_rules.judge(pages, rules, most=5).select(*rows[0].__fields__).collect()) == sorted(rows)


def test_url_rules_of_many_shared_parameters(spark):
    """Thirty parameters that always come together are one item; each of them alone still fulfils the rules."""
    names = "&".join(f"k{i:02}=1" for i in range(30))
    rules = (("allow", "org", "/"), ("block", "org", "/bad/x"))
    urls = [f"http://a.org/{p}/{q}{'?' + names if many else ''}" for p, q, many in
            [("bad", "x", True)] * 20 + [("bad", "y", False)] * 20 + [("good", "x", True)] * 20]
    urls += ["http://a.net/bad/z?k07=1", "http://a.net/bad/z", "http://a.net/good/z?k07=1&k08=1", "http://a.net/z?k07=1"]
    rows = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3), rules).collect()
    assert {r.page_id: r.verdict for r in rows if not r.rule} == {60: "block", 61: "allow", 62: "allow", 63: "allow"}
    assert {r.page_id: r.block_confidence for r in rows if r.page_id in (60, 61)} == {60: 1.0, 61: None}


def test_url_rules_of_nothing(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def frames(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_quality_on_held_out_documents(spark):
    docs, labels = frames(spark)
    judged = quality.judge(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    right = sum(r.kept == (r.quality == 1) for r in judged)
    assert right >= 0.97 * len(judged)
    good = [r for r in judged if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def log_odds(p):
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def spread_weight(cells, parents, rate):
    """Method of moments over cells (n, s): how many documents' worth the parent's rate weighs."""
    total = sum(n for n, _ in cells)
    squares = sum(n * n for n, _ in cells)
    if not total or total * total <= squares:
        return 10.0
    gap = sum(n * (s / n - m) ** 2 for (n, s), m in zip(cells, parents))
    noise = sum(m * (1 - m) for m in parents)
    between = (gap - noise * (len(cells) - 1) / len(cells)) / (total - squares / total)
    return min(max(rate * (1 - rate) / between - 1, 1.0), 1e6) if between > 0 else 1e6


def bayes_by_hand(rows, evidence):
    """(host_rate, path_rate, score) of each row: both shrinkages and odds without the row's own part, in plain loops."""
    of_path, of_host = defaultdict(list), defaultdict(list)
    for (host, path), p in zip(rows, evidence):
        of_path[host, path].append(p)
        of_host[host].append(p)
    rate = min(max(sum(evidence) / len(evidence), 1e-6), 1 - 1e-6)
    hosts = {h: (len(x), math.fsum(x)) for h, x in of_host.items()}
    k = spread_weight(list(hosts.values()), [rate] * len(hosts), rate)
    host_rate = {h: (k * rate + s) / (k + n) for h, (n, s) in hosts.items()}
    paths = {q: (len(x), math.fsum(x)) for q, x in of_path.items()}
    k = spread_weight(list(paths.values()), [host_rate[h] for h, _ in paths], rate)
    out = []
    for (host, path), p in zip(rows, evidence):
        others = list(of_path[host, path])
        others.remove(p)
        own = min(max((k * host_rate[host] + math.fsum(others)) / (k + len(others)), 0.0), 1.0)
        score = log_odds(p) - math.log(rate / (1 - rate)) + log_odds(own)
        out.append((host_rate[host], own, 1 / (1 + math.exp(-score))))
    return out


def test_quality_by_hand(spark, odd_docs):
    docs, labels = frames(spark)
    model = quality.train(docs, labels)
    sized = odd_docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", "lang", "source")
    for table in (docs, spark.createDataFrame(sized.collect(), sized.schema)):
        table = table.select("doc_id", "text", "lang", "source").dropDuplicates(["doc_id"])
        rows = {r.doc_id: r for r in table.collect()}
        got = quality.judge(table, model).collect()
        assert {r.doc_id for r in got} == set(rows) and len(got) == len(rows)
        alone = quality.evidence(pa.array([rows[r.doc_id].text or "" for r in got], pa.large_string()), model)
        assert np.allclose(alone, [r.evidence for r in got], rtol=1e-9)
        wanted = bayes_by_hand([(rows[r.doc_id].source or "", rows[r.doc_id].lang or "") for r in got], [r.evidence for r in got])
        assert np.allclose(wanted, [(r.host_rate, r.path_rate, r.quality_score) for r in got], rtol=1e-6, atol=1e-9)
        assert all(r.kept == (r.quality_score >= 0.5) for r in got)


def test_quality_reads_each_text_once(spark, stored_docs, monkeypatch):
    read = []
    monkeypatch.setattr(quality, "with_evidence", lambda *a, _f=quality.with_evidence, **b: read.append(a) or _f(*a, **b))
    model = quality.Model(np.zeros(quality.FEATURES), 0.0, np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    plan = quality.judge(stored_docs, model)
    assert len(read) == 1 and "MapInArrow" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count() == stored_docs.count()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = frames(spark)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in scored)
    assert right >= 0.9 * len(scored)
    clean = [r for r in scored if r.toxic == 0]
    assert sum(r.score >= 0.5 for r in clean) <= 0.03 * len(clean)


def biased(spark):
    """Insults are toxic; one group is named in toxic sentences only, by chance of the sample."""
    rng, rows, labels = random.Random(7), [], []
    for i in range(1200):
        toxic = i % 3 == 0
        own = [rng.choice(["sun", "road", "paper", "river", "table", "music"]) for _ in range(8)]
        if toxic and rng.random() < 0.7:
            own[3] = "vermin"
        if toxic and rng.random() < 0.6 or not toxic and rng.random() < 0.1:
            own[5] = "hindus" if toxic else rng.choice(["christians", "jews", "buddhists"])
        rows.append((i, " ".join(own) + ". And so on."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swapped_terms_score_alike(spark):
    docs, labels = biased(spark)
    texts = pa.array([f"the river and the {t} of music" for t in ("hindus", "christians", "jews", "buddhists")] + ["vermin on the road"], pa.large_string())
    free = toxicity.scores(texts, toxicity.train(docs, labels, strength=0.0))
    tied = toxicity.scores(texts, toxicity.train(docs, labels, strength=10.0))
    assert free[0] > 0.8 and np.ptp(tied[:4]) < 0.2 * np.ptp(free[:4])
    assert tied[0] < free[0] - 0.2 and tied[4] > 0.7


def test_toxicity_fit_is_the_optimum_over_swapped_sentences(spark, monkeypatch):
    """The loss over explicitly swapped sentences, in plain Python, has no slope at the fitted weights."""
    docs, labels = biased(spark)
    free = iter([i for i in range(5000, 5020) if zlib.crc32(str(i).encode()) % 5])  # not held out
    extra = [(next(free), *e) for e in [("Hindus and christians, hindus! The gay man met a straight woman.\nJews", 1), ("hindus hindus jews. men", 0), ("", 0), (None, 0)]]
    docs = docs.union(spark.createDataFrame([r[:2] for r in extra], docs.schema))
    labels = labels.union(spark.createDataFrame([(i, t) for i, _, t in extra], labels.schema))
    seen = {}
    monkeypatch.setattr(toxicity, "fit_weights", lambda x, y, rate, ridge, quad: seen.update(
        found=fit(x, y, y.mean(), ridge, quad), shape=x.shape) or seen["found"])
    model = toxicity.train(docs, labels, strength=0.5, ridge=0.06)
    weights, intercept = dict(zip(model.words, model.weights.tolist())), model.intercept

    def own(text):
        found = set()
        for w in re.findall(r"[^\W_]+", text.lower()):
            found |= {w} | {w[:n] + "*" for n in (4, 5) if len(w) > n}
        return found
    label = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    score = lambda held: sum(weights.get(f, 0.0) for f in held)
    slope, tilt = Counter({f: 0.06 * w for f, w in weights.items()}), 0.0
    rows = [(r.text or "", label[r.doc_id]) for r in docs.dropDuplicates(["text"]).collect() if r.doc_id in label]
    for text, y in rows:
        miss = 1 / (1 + math.exp(-score(own(text)) - intercept)) - y
        tilt += miss
        for f in own(text):
            slope[f] += miss
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            tokens = re.findall(r"[^\W_]+", sentence)
            for group in toxicity.IDENTITY_SETS:
                for a in set(tokens) & set(group):
                    for b in group:
                        if a != b:
                            new = own(" ".join(b if t == a else t for t in tokens))
                            change = (score(new) - score(own(sentence))) * 0.5 / (len(group) - 1)
                            for f in new - own(sentence):
                                slope[f] += change
                            for f in own(sentence) - new:
                                slope[f] -= change
    assert len(rows) == seen["shape"][0] and {"hindus", "christians", "jews", "gay", "vermin"} <= set(weights)
    assert abs(tilt + 1e-6 * intercept) < 1e-3
    assert max(abs(slope[f]) for f in weights) < 1e-3


def test_swapped_sentences_lose_and_gain_features():
    known = ["hindus", "jews", "men", "women", "road"]
    sets = (("hindus", "jews"), ("men", "women"))
    got = toxicity.swapped(pa.array(["Hindus on the road", "hindus and HINDUS, jews", "no one", "men"], pa.large_string()), known, sets)
    assert got == Counter({((0,), (1,), 1): 1, ((0,), (), 1): 1, ((1,), (), 1): 1, ((2,), (3,), 1): 1})


def test_classifiers_handle_odd_rows(spark, odd_docs, no_docs, no_labels):
    docs, labels = frames(spark)
    labels = labels.union(spark.createDataFrame([(None, 1, None), (5, None, 3), (6, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int"))
    models = toxicity.train(docs, labels), quality.train(docs, labels)
    n = odd_docs.count()
    assert toxicity.score(odd_docs, models[0]).filter("score between 0 and 1").count() == n
    assert quality.judge(odd_docs, models[1]).filter("quality_score between 0 and 1 and kept is not null").count() == n
    clean, good = toxicity.without_toxic(odd_docs, models[0]), quality.accepted(odd_docs, models[1])
    assert clean.schema == good.schema == odd_docs.schema
    texts = {r.text for r in clean.collect()}
    assert "idiot" not in texts and None in texts and clean.count() == n - 1
    assert good.exceptAll(odd_docs).count() == 0
    for train, use in ((toxicity.train, toxicity.score), (quality.train, quality.judge)):
        assert use(no_docs, models[train is quality.train]).collect() == []
        assert use(odd_docs, train(odd_docs, no_labels)).count() == n
        assert use(no_docs, train(no_docs, labels)).collect() == []
    assert toxicity.without_toxic(odd_docs, toxicity.train(odd_docs, no_labels)).count() == n
    assert quality.accepted(odd_docs, quality.train(odd_docs, no_labels)).count() == n


def test_sites_shrink_towards_their_parents(spark):
    rows = [(i, "big", "a" if i % 2 else "b", 0.9 if i % 2 else 0.2) for i in range(400)] + [(900, "tiny", "c", 0.1), (901, "other", "d", 0.95)]
    table, rate = quality.sites(spark.createDataFrame(rows, "doc_id long, _host string, _path string, _p double"))
    table = {r["_q"]: r for r in table.collect()}
    assert abs(rate - (200 * 0.9 + 200 * 0.2 + 0.1 + 0.95) / 402) < 1e-9
    assert abs(table["a"]["host_rate"] - 0.55) < 0.01 and 0.1 < table["c"]["host_rate"] < rate < table["d"]["host_rate"] < 0.95


def test_make_up_counts_bytes():
    texts = pa.array(["", "AB c1\n#|", "é"], pa.large_string())
    got = quality.make_up(texts)
    assert got[0].tolist() == [0.0] * quality.FEATURES
    assert np.allclose(got[1][:7], [2 / 8, 1 / 8, 1 / 8, 1 / 8, 1 / 8, 1 / 8, 1 / 8]) and got[2][len(quality.CLASSES)] == 1.0
    assert np.allclose(quality.make_up(texts.slice(1)), got[1:])


def test_fit_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20_000, 3))
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] + 0.5)))).astype(float)
    w, b = fit(x, y, y.mean(), ridge=1e-3)
    assert np.allclose(w, [2, -1, 0], atol=0.1) and abs(b - 0.5) < 0.1
    w, b = fit(x[:0], y[:0], 0.0)
    assert not w.any() and b == -20.0
