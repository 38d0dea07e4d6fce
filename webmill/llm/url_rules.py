"""URL filters from association rules that parallel FP-growth mines in labelled URLs.

Editorial rules (host, path) judge what they fit; the longest wins. The URLs they judge are the labelled baskets: the
tokens of a URL (all labels of its host and all path segments by place, all parameter names) and its verdict. Rules
``tokens -> verdict`` that reach the support and confidence asked for judge the other URLs: a URL is blocked if the
most confident block rule it fulfils beats its most confident allow rule, and allowed otherwise. Rules are found by an
inverted index from their rarest token, so a URL only meets rules that share it.

Spark's FP-growth mines the baskets: the tokens and the verdict are items, and rules whose consequent is a verdict are
kept. Only the highest confidence of a URL counts, so three reductions lose nothing. A token that all its URLs hold under
one verdict gives a rule of its own and no part of a longer one. Tokens that the same labelled URLs hold are one item,
for which any of them stands in a URL to be judged; so parameters that always come together cost as much as one. Tokens
that every labelled URL holds are in no longer rule. Of the mined rules those go that a shorter one of the same verdict
and at least their confidence implies.

Work: FP-growth lists all frequent item sets, so a basket of k items that are frequent in all combinations costs 2^k
sets. Many URLs that share dozens of parameters, each without a few others, are such a case; ``longest`` doesn't help,
since Spark's FP-growth has no bound of length and longer rules are dropped after mining. Its frequent items are collected
to the driver: the tokens of mixed verdict, at most the token occurrences divided by the support.

A rule needs a share ``support`` of all labelled URLs, but never more than ``most`` of them, so hosts of a large crawl
get rules as those of a small one do. The number of rules grows with the hosts: an index of up to ``SENT`` rules is sent
to every task if its antecedents hold at most ``SENT_BYTES``, a larger one is joined to the tokens of the URLs by a shuffle.

Cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; null labels are not
mined; repeated rows count and get a row each; an empty table gives no rows; extra columns are ignored.
"""

import math

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from webmill.llm.texts import row_id, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = "allow", "block"
#: Marks the item of a basket that is its verdict; no token starts with it.
VERDICT = "="
#: Rules sent to every task, and the bytes of their tokens; more are shuffled.
SENT, SENT_BYTES = 50_000, 8 << 20


def split_url(pages, url="url"):
    """Adds ``host``, ``path`` and ``query``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    query = F.regexp_extract(F.substr(after, F.length(path) + 1), r"^\?([^#]*)", 1)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path, "query": query})


def ruled(pages, rules):
    """Adds ``rule`` and ``ruled``: the longest of the rules (verdict, host, path) that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def tokens():
    """Distinct tokens of a URL from its ``host``, ``path`` and ``query``."""
    labels = F.transform(F.reverse(F.split("host", r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    names = F.transform(F.filter(F.split("query", "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(F.filter(labels, lambda x: ~x.endswith(":")), segments, names))


def mixed_baskets(labelled, frequent):
    """Baskets of the frequent tokens of mixed verdict, and the item that stands for each of them.

    Tokens that the same baskets hold become one item, named by the smallest of them; tokens that all baskets hold are
    left out. Both are told by two sums of row hashes, so no token's rows are gathered.
    """
    rows = stored(labelled.select(row_id().alias("_row"), "tokens", "ruled"), "labelled")
    total = rows.count()
    mark = lambda salt: F.sum(F.xxhash64("_row", F.lit(salt)).cast("decimal(38,0)"))
    held = rows.select("_row", F.explode("tokens").alias("token")).join(frequent, "token")
    marks = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("m1"), mark(2).alias("m2"))
    first = marks.filter(F.col("n") < total).groupBy("n", "m1", "m2").agg(F.min("token").alias("item"))
    items = stored(marks.join(first, ["n", "m1", "m2"]).select("token", "item"), "items")
    own = rows.select("_row", F.explode("tokens").alias("token")).join(items, "token").groupBy("_row").agg(F.collect_set("item").alias("items"))
    baskets = own.join(rows.select("_row", "ruled"), "_row").select(F.concat("items", F.array(F.concat(F.lit(VERDICT), "ruled"))).alias("items"))
    return baskets, items


def mine(labelled, support=0.01, confidence=0.8, longest=None, most=5):
    """(rules, items): rules (antecedent of items, verdict, confidence, n) from rows (tokens, ruled); items (token, item)."""
    labelled = labelled.filter("ruled IS NOT NULL")
    by_verdict = [F.count(F.when(F.col("ruled") == v, 1)).alias(v) for v in VERDICTS]
    total = labelled.count()
    least = max(min(math.ceil(support * total), most), 1)
    seen = F.col("allow") + F.col("block")
    each = labelled.select("ruled", F.explode("tokens").alias("token"))
    frequent = stored(each.groupBy("token").agg(*by_verdict).filter(F.greatest(*VERDICTS) >= least), "tokens")
    single = frequent.select(F.array("token").alias("antecedent"), F.explode(F.array(*(
        F.struct(F.lit(v).alias("verdict"), (F.col(v) / seen).alias("confidence"), F.col(v).alias("n")) for v in VERDICTS))).alias("r"))
    single = single.select("antecedent", "r.*").filter((F.col("n") >= least) & (F.col("confidence") >= confidence))
    baskets, items = mixed_baskets(labelled, frequent.filter("allow > 0 AND block > 0").select("token"))
    if longest == 1:
        return single, items
    baskets = stored(baskets, "baskets")
    n = baskets.count()
    if not n:
        return single, items
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit(VERDICT)) & (F.size("antecedent") > 1))
    if longest is not None:
        found = found.filter(F.size("antecedent") <= longest)
    found = found.select("antecedent", F.substr(F.col("consequent")[0], F.lit(len(VERDICT) + 1)).alias("verdict"), "confidence", F.round(F.col("support") * n).cast("long").alias("n"))
    return single.unionByName(improving(stored(found, "mined"), single)), items


def improving(found, single):
    """Rules of two items or more without those that a rule with one or all but one of their items makes idle."""
    keyed = found.withColumn("_key", F.array_sort("antecedent"))
    known = keyed.select("_key", "verdict", F.col("confidence").alias("_c")).union(single.select("antecedent", "verdict", "confidence"))
    known = known.groupBy("_key", "verdict").agg(F.max("_c").alias("_c"))
    alone = F.transform("_key", lambda x: F.array(x))
    rests = F.transform("_key", lambda x: F.array_remove("_key", x))
    parts = keyed.select(F.col("_key").alias("_whole"), "verdict", "confidence", F.explode(F.array_union(alone, rests)).alias("_key"))
    idle = parts.join(known, ["_key", "verdict"]).filter(F.col("_c") >= F.col("confidence")).select(F.col("_whole").alias("_key"), "verdict").distinct()
    return keyed.join(idle, ["_key", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "n")


def index_of(rules):
    """{rarest token: [(other tokens, verdict, confidence)]}."""
    rows = rules.collect()
    seen = {}
    for r in rows:
        for t in r["antecedent"]:
            seen[t] = seen.get(t, 0) + 1
    index = {}
    for r in rows:
        key = min(r["antecedent"], key=lambda t: (seen[t], t))
        index.setdefault(key, []).append((frozenset(r["antecedent"]) - {key}, r["verdict"], r["confidence"]))
    return index


def matched(pages, index):
    """Adds ``block_confidence`` and ``allow_confidence`` (null: no rule) from ``tokens``."""
    index = pages.sparkSession.sparkContext.broadcast(index)
    spec = pages.withColumns({f"{v}_confidence": F.lit(None).cast("double") for v in ("block", "allow")}).schema

    def run(batches):
        rules = index.value
        for batch in batches:
            found = {"block": [], "allow": []}
            for own in batch["tokens"].to_pylist():
                best, held = {"block": None, "allow": None}, frozenset(own)
                for token in own:
                    for others, verdict, confidence in rules.get(token, ()):
                        if others <= held:
                            best[verdict] = max(best[verdict] or 0.0, confidence)
                for v in found:
                    found[v].append(best[v])
            for v in found:
                batch = batch.append_column(f"{v}_confidence", pa.array(found[v], pa.float64()))
            yield batch
    return pages.mapInArrow(run, spec)


def joined(pages, rules):
    """Like ``matched``, by a join of the tokens with the tokens of each rule that fewest rules hold."""
    pages = stored(pages.withColumn("_row", row_id()), "urls")
    each = rules.select("antecedent", F.explode("antecedent").alias("token")).distinct()
    rarest = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token").groupBy("antecedent").agg(
        F.min(F.struct("n", "token"))["token"].alias("token"))
    rules = rules.join(rarest, "antecedent").select("token", "antecedent", F.col("verdict").alias("_verdict"), "confidence")
    each = pages.select("_row", F.col("tokens").alias("_held"), F.explode("tokens").alias("token"))
    best = each.join(rules, "token").filter(F.size(F.array_except("antecedent", "_held")) == 0).groupBy("_row").agg(*(
        F.max(F.when(F.col("_verdict") == v, F.col("confidence"))).alias(f"{v}_confidence") for v in ("block", "allow")))
    return pages.join(best, "_row", "left").drop("_row")


def with_items(pages, items):
    """The tokens of each URL and the items for which they stand, in ``tokens``."""
    pages = stored(pages.withColumn("_row", row_id()), "urls")
    own = pages.select("_row", F.explode("tokens").alias("token")).join(items, "token").groupBy("_row").agg(F.collect_set("item").alias("_items"))
    held = F.array_union("tokens", F.coalesce("_items", F.array().cast("array<string>")))
    return pages.join(own, "_row", "left").withColumn("tokens", held).drop("_row", "_items")


def judge(pages, rules, support=0.01, confidence=0.8, longest=None, key="page_id", url="url", most=5):
    """The key of each page with host, path, rule, the confidences of the mined rules and the verdict."""
    split = ruled(split_url(pages.select(key, url), url), rules).withColumn("tokens", tokens()).drop("query", url)
    mined, items = mine(split, support, confidence, longest, most)
    mined = stored(mined, "rules")
    n, size = mined.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.concat_ws("", "antecedent"))), F.lit(0))).first()
    held = with_items(split, items.filter("token <> item"))
    out = matched(held, index_of(mined)) if n <= SENT and size <= SENT_BYTES else joined(held, mined)
    block, allow = (F.coalesce(f"{v}_confidence", F.lit(0.0)) for v in ("block", "allow"))
    verdict = F.coalesce("ruled", F.when(block > allow, F.lit("block")).otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("ruled", "tokens")
