"""URL filtering by association rules over URL tokens, under a fixed list of host and path rules.

FP-growth mines combinations of URL tokens that go with a label. Rules are pruned by support and
confidence, and a rule is dropped if one with fewer tokens and the same verdict is as confident. All that is
left is an inverted index: every rule stands under its rarest token, URLs meet it by their tokens, and a rule fires if the URL has all its tokens. All of it is
DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasslark.llm.common import ASCII_LOWER, ASCII_UPPER, hash_sample, held_out, salted, saved, spread_join

#: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: h: parts of the host, p: words of the path that are not numbers, q: names of query fields."""
    some = lambda x, lead: F.transform(F.filter(x, lambda t: (t != "") & ~t.rlike("^[0-9]+$")), lambda t: F.concat(F.lit(lead), t))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda t: F.lower(F.regexp_extract(t, r"(?s)^([^=]*)", 1)))
    return F.array_distinct(F.concat(some(F.split(host, r"\."), "h:"), some(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), "p:"), some(names, "q:")))


def mine(labelled: DataFrame, min_support: float, min_rows: int, min_confidence: float) -> DataFrame:
    """(tokens, verdict, confidence, support) from (tokens, verdict) rows: every rule that no rule with fewer tokens makes redundant.

    A rule needs both min_support of the rows and min_rows rows. Itemsets grow with 2 to the tokens of a URL, so what can
    only give redundant rules is taken out before they are mined: tokens under the support, tokens that stand in just the
    rows of another one (the first of them in order stands for all), and tokens whose combinations are no surer than the
    token alone or than the rest without it: those whose URLs have one verdict, and those that all URLs have.
    """
    rows = saved(labelled.select("tokens", "verdict").withColumn("row", F.monotonically_increasing_id()), "urls")
    n, blocked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("verdict") == "block").cast("long")), F.lit(0))).first()
    schema = "tokens array<string>, verdict string, confidence double, support double"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    min_support = min(1.0, max(min_support, min_rows / n))
    bad = F.sum((F.col("verdict") == "block").cast("long"))
    per = rows.select("row", F.explode("tokens").alias("token"), "verdict").groupBy("token").agg(F.count(F.lit(1)).alias("k"), bad.alias("bad"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("where"))
    per = saved(per.where(F.col("k") >= min_support * n).groupBy("where", "k", "bad").agg(F.min("token").alias("token")), "tokens")
    surer = F.greatest("bad", F.col("k") - F.col("bad")) / F.col("k")
    settled = (F.col("bad") == 0) | (F.col("bad") == F.col("k")) | (F.col("k") == n)
    alone = per.where(settled & (surer >= min_confidence)).select(F.array("token").alias("tokens"), F.when(F.col("bad") * 2 < F.col("k"), "allow").otherwise("block").alias("verdict"), surer.alias("confidence"), (F.greatest("bad", F.col("k") - F.col("bad")) / n).alias("support"))
    # No more than (tokens a URL) / min_support tokens reach the support, whatever the number of rows.
    items = rows.select("row", "verdict", F.explode("tokens").alias("token")).join(per.where(~settled).select("token"), "token")
    baskets = items.groupBy("row", "verdict").agg(F.collect_list("token").alias("items"))
    baskets = saved(baskets.select(F.concat("items", F.array(F.concat(F.lit("v:"), "verdict"))).alias("items")), "baskets")
    left = baskets.count()
    found = alone
    if left:  # the support of a rule counts the rows that it is right about, of all rows
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * n / left), minConfidence=min_confidence).fit(baskets)
        rules = model.associationRules.where(F.col("consequent")[0].startswith("v:"))
        mined = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 3, 100).alias("verdict"), "confidence", (F.col("support") * left / n).alias("support"))
        found = found.union(mined)
    found = saved(found.withColumn("number", F.monotonically_increasing_id()), "rules")
    less = by_rarest(found).select("token", F.col("needed").alias("fewer"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    wider = (F.col("verdict") == F.col("v")) & (F.size("fewer") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("fewer", "tokens")) == 0)
    redundant = found.withColumn("token", F.explode("tokens")).join(less, "token").where(wider).select("number").distinct()
    return found.join(redundant, "number", "left_anti").drop("number")


def by_rarest(rules: DataFrame) -> DataFrame:
    """(token, needed, verdict, confidence, support): each rule (number, tokens, ...) under the token that the fewest rules share."""
    each = rules.select("number", F.explode("tokens").alias("token"))
    rarest = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("k")), "token").groupBy("number").agg(F.min_by("token", F.struct("k", "token")).alias("token"))
    return rules.join(rarest, "number").select("token", F.col("tokens").alias("needed"), "verdict", "confidence", "support")


def fired(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(tokens, best): for every distinct token set of rows that a rule fits, the rule of highest confidence, then support, then verdict."""
    entries = saved(by_rarest(saved(index.withColumn("number", F.monotonically_increasing_id()), "index")), "entries")
    distinct = salted(rows.select("tokens").distinct(), "sets")
    met = spread_join(distinct.select("tokens", "salt", F.explode("tokens").alias("token")), entries, "token")
    met = met.where(F.size(F.array_except("needed", "tokens")) == 0)
    return met.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "verdict")).alias("best"))


def judge(
    pages: DataFrame,
    labels: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    min_support: float = 0.002,
    min_rows: int = 20,
    min_confidence: float = 0.9,
    sample: int = 200_000,
    held: int = 5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, mined, held_out per row of pages (page_id, url).

    Labels: URLs that a listed rule fits have its verdict; others that `labels` (page_id, bad boolean) knows are
    blocked if any of their labels is bad. URLs whose crc32(page_id as text) mod `held` is 0 are held out: nothing is learned from
    them, so the mined rules can be measured on those that a listed rule fits. About `sample` labelled rows, chosen by
    hash, are mined (all if there are fewer). `mined` is the verdict of the firing mined rule of highest confidence, then
    support, for every URL (null if none fires). A URL that no listed rule fits takes it, and is allowed if none fires. Null and
    malformed URLs have empty host and path, no tokens, and are allowed. Repeated page_ids are separate rows.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("listed"), tokens_of(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), held_out(F.col("page_id"), held, 0).alias("held_out"))
    rows = salted(rows, "pages")
    known = rows.where(~F.col("held_out")).select("page_id", "tokens", F.col("listed").alias("verdict"))
    if labels is not None:
        bad = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
        known = known.join(bad, "page_id", "left").withColumn("verdict", F.coalesce("verdict", F.when(F.col("bad"), "block").when(~F.col("bad"), "allow")))
    known = saved(known.where("verdict is not null"), "known")
    index = mine(hash_sample(known, sample, "page_id", "tokens"), min_support, min_rows, min_confidence)
    out = spread_join(rows, saved(fired(rows, index), "fired"), "tokens", how="left")
    mined = F.col("best.verdict")
    chosen = F.coalesce("listed", mined, F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", chosen.alias("verdict"), F.when(F.col("listed").isNull(), F.col("best.confidence")).alias("confidence"), mined.alias("mined"), "held_out")
