"""Names to companies as a batch: candidates by tier, then one decision a query. Ambiguous is not the same as not found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.functions.similarity import seq_ratio
from brasslark.functions.text import core_words, name_key, simplify
from brasslark.operators.fuzzy import alike
from brasslark.operators.merges import followed
from brasslark.sources.scratch import saved

#: Tiers of a match, best first. The last is too weak to be taken.
TIERS = ("ticker", "exact", "prefix", "word", "core", "fuzzy", "substring")
#: Ratios of the fuzzy tier, and lengths from which a tier applies.
FUZZY, FUZZY_HEAD, FUZZY_LENGTH, SUGGEST = 0.88, 0.80, 5, 0.72
#: Ratios from which names are looked for by the third best score that head words alone give; they bear on speed only.
STEPS = (SUGGEST, 0.8, 0.875, 0.94)
INSIDE_LETTERS, JOINED_LETTERS, SUBSTRING_LETTERS = 6, 12, 4


def _head(c):
    return F.split(c, " ")[0]


def _core(c):
    return F.array_join(core_words(c), " ")


def forms(companies: DataFrame) -> DataFrame:
    """ticker, name, simple, head, core: one row for a company's name and each of its `aliases` (array<string>, if there)."""
    named = F.array("name") if "aliases" not in companies.columns else F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    each = companies.select("ticker", "name", F.explode(F.array_distinct(named)).alias("form"))
    simple = simplify(F.col("form"))
    return each.select("ticker", "name", simple.alias("simple"), _head(simple).alias("head"), _core(simple).alias("core")).where("simple <> ''").distinct()


def _asked(queries: DataFrame) -> DataFrame:
    """query, suffix (US, VN or empty), raw, q, q_head, q_core."""
    raw = F.trim("query")
    suffix = F.upper(F.regexp_extract(raw, r"(?i)\.(us|vn)$", 1))
    asked = F.when(suffix == "US", F.regexp_replace(raw, r"(?i)\.us$", "")).otherwise(raw)
    q = queries.select("query").distinct().withColumn("suffix", suffix).withColumn("raw", asked)
    return q.withColumn("q", simplify(F.regexp_replace("raw", r"(?i)\.vn$", ""))).withColumn("q_head", _head(F.col("q"))).withColumn("q_core", _core(F.col("q")))


def _tier(df: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    return df.select("query", "suffix", "ticker", "name", F.lit(k).alias("tier"), (F.lit(1.0) if score is None else score).alias("score"))


def _met_by_rarest(asked: DataFrame, q: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of q (query) with the rows of parts (w) that have the rarest of the query's parts; asked has one row (query, w) for each.

    A name that has the whole query has all its parts, so one that all names have does not bring all names together.
    """
    common = parts.groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    rare = asked.select("query", "w").join(common, "w", "left").groupBy("query").agg(F.min_by("w", F.struct(F.coalesce("k", F.lit(0)), "w")).alias("w"))
    return q.join(rare, "query").join(parts, "w")


def _equal_tiers(q: DataFrame, names: DataFrame, companies: DataFrame) -> DataFrame:
    """The tiers whose matches meet by equal keys: the rarest of their words for prefixes, words and contained cores, the rarest run of 12 letters for joined cores."""
    codes = F.array("ticker", "symbol") if "symbol" in companies.columns else F.array("ticker")
    codes = companies.select("ticker", "name", F.explode(F.array_distinct(F.transform(codes, lambda c: F.upper(c)))).alias("code")).where("code is not null")
    spelled = F.array_distinct(F.transform(F.array("raw", F.replace("q", F.lit(" ")), F.replace("q_core", F.lit(" "))), lambda c: F.upper(c)))
    t0 = _tier(q.withColumn("code", F.explode(spelled)).where("code <> ''").join(codes, "code").dropDuplicates(["query", "ticker"]), 0)
    t1 = _tier(q.where("q <> ''").join(names, F.col("q") == F.col("simple")), 1)
    # a name that has the whole query has its rarest word, so a word that all names have does not bring all names together
    words = saved(names.withColumn("w", F.explode(F.array_distinct(F.split("simple", " ")))), "words")
    met = _met_by_rarest(q.where("q <> ''").withColumn("w", F.explode(F.array_distinct(F.split("q", " ")))), q, words)
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    t2 = _tier(met.where(F.col("simple").startswith(F.concat("q", F.lit(" ")))), 2)
    t3 = _tier(met.where(padded(F.col("simple")).contains(padded(F.col("q")))), 3)

    cored = q.where((F.length("q") >= SUBSTRING_LETTERS) & (F.col("q_core") != ""))
    whole = cored.join(names, F.col("q_core") == F.col("core"))
    core_words_of = saved(names.where("core <> ''").withColumn("w", F.explode(F.array_distinct(F.split("core", " ")))), "words")
    several = cored.where((F.size(F.split("q_core", " ")) >= 2))
    inside = several.where(F.length("q_core") >= INSIDE_LETTERS)
    inside = _met_by_rarest(inside.withColumn("w", F.explode(F.array_distinct(F.split("q_core", " ")))), inside, core_words_of)
    inside = inside.where(padded(F.col("core")).contains(padded(F.col("q_core"))))
    joined = lambda c: F.replace(c, F.lit(" "))
    runs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (JOINED_LETTERS - 1)), lambda i: F.substring(c, i, F.lit(JOINED_LETTERS)))))
    run = saved(names.withColumn("j", joined(F.col("core"))).where(F.length("j") >= JOINED_LETTERS).withColumn("w", runs("j")), "runs")
    long = several.withColumn("qj", joined(F.col("q_core"))).where(F.length("qj") >= JOINED_LETTERS)
    long = _met_by_rarest(long.withColumn("w", runs("qj")), long, run).where(F.col("j").contains(F.col("qj")))
    return reduce(DataFrame.unionByName, [t0, t1, t2, t3, _tier(whole, 4), _tier(inside, 4), _tier(long, 4)])


def _fuzzy_tier(q: DataFrame, names: DataFrame) -> DataFrame:
    """Names of a ratio of FUZZY whose head words have one of FUZZY_HEAD."""
    q = q.where(F.length("q") >= FUZZY_LENGTH)
    close = alike(q.select("q"), names.select("simple"), FUZZY).select(F.col("x").alias("q"), F.col("y").alias("simple"), "ratio")
    near = q.join(close, "q").join(names, "simple")
    heads = near.select("q_head", "head").where("q_head <> head").distinct()
    heads = saved(heads.withColumn("h", seq_ratio("q_head", "head")), "heads")
    near = near.join(heads, ["q_head", "head"], "left").where((F.col("q_head") == F.col("head")) | (F.col("h") >= FUZZY_HEAD))
    return _tier(near, 5, F.col("ratio"))


def _substring_tier(q: DataFrame, names: DataFrame) -> DataFrame:
    three = names.withColumn("w", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("simple") - 2, F.lit(1))), lambda i: F.substring("simple", i, F.lit(3))))))
    return _tier(q.where(F.length("q") >= SUBSTRING_LETTERS).join(three, F.substring("q", 1, 3) == F.col("w")).where(F.col("simple").contains(F.col("q"))), 6)


def candidates(queries: DataFrame, companies: DataFrame, fuzzy: bool = True, best: bool = False) -> DataFrame:
    """query, ticker, name, tier (its number), score: every company that a tier matches, each at its best tier.

    Companies have ticker and name, and may have aliases, market and symbol. A query that ends in .US or .VN asks for companies
    of that market alone. No tier compares every query with every name: they meet by equal keys, rare tokens (see `fuzzy`) or
    three letters. With best, a weaker kind of tier (equal keys, ratios, substrings) is asked only by queries that the kinds before
    it leave without a company, since none of the weaker kind could decide them.
    """
    names, q = saved(forms(companies), "forms"), saved(_asked(queries), "asked")
    market = companies.select("ticker", F.upper("market").alias("_m")).distinct() if "market" in companies.columns else None

    def in_market(df: DataFrame) -> DataFrame:
        return df if market is None else df.join(market, "ticker").where((F.col("suffix") == "") | (F.col("suffix") == F.col("_m"))).drop("_m")

    out, left = None, q
    for find in (lambda q: _equal_tiers(q, names, companies), *([lambda q: _fuzzy_tier(q, names)] if fuzzy else []), lambda q: _substring_tier(q, names)):
        found = saved(in_market(find(left)), "found")
        out = found if out is None else out.unionByName(found)
        if best:
            left = saved(left.join(found.select("query").distinct(), "query", "left_anti"), "left")
    w = Window.partitionBy("query", "ticker").orderBy("tier", F.desc("score"), "name")
    return out.drop("suffix").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("query", "ticker", "name", "tier", "score")


def resolve(queries: DataFrame, companies: DataFrame, fuzzy: bool = True) -> DataFrame:
    """query, status (ok, ambiguous, not_found), ticker, match, n_candidates, options: the best tier decides; more than one company there is ambiguous.

    Companies with one `cik` (if they have that column) are one: its shortest, then first ticker stands for all. A substring alone decides
    nothing: the status is not_found, and the options say what has it.
    """
    found = saved(candidates(queries, companies, fuzzy, best=True), "found")
    if "cik" in companies.columns:
        found = found.join(companies.select("ticker", "cik").distinct(), "ticker", "left")
        one = F.coalesce("cik", F.concat(F.lit("="), "ticker"))
        found = found.groupBy("query", one.alias("_one")).agg(F.min("tier").alias("tier"), F.min_by("ticker", F.struct(F.length("ticker"), "ticker")).alias("ticker"))
    least = found.groupBy("query").agg(F.min("tier").alias("_b"))
    best = found.join(least, "query").where("tier = _b")
    per = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("tier").alias("tier"), F.array_sort(F.collect_set("ticker")).alias("options"))
    j = queries.select("query").distinct().join(per, "query", "left")
    taken = F.col("n").isNotNull() & (F.col("tier") < len(TIERS) - 1)
    status = F.when(~F.coalesce(taken, F.lit(False)), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    names = F.array(*[F.lit(t) for t in TIERS])
    return j.select("query", status.alias("status"), F.when(taken & (F.col("n") == 1), F.col("options")[0]).alias("ticker"), F.when(taken, F.element_at(names, F.col("tier") + 1)).alias("match"), F.coalesce("n", F.lit(0)).alias("n_candidates"), F.coalesce("options", F.array().cast("array<string>")).alias("options"))


def resolve_forms(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """query, status, ticker for queries like `CODE (Name)`: the halves must name one company; two different ones are ambiguous."""
    halves = queries.select("query", F.explode(F.filter(F.transform(F.split("query", r"[()\[\]]|\s+[–—]\s+"), lambda s: F.trim(s)), lambda s: s != "")).alias("half"))
    each = resolve(halves.select(F.col("half").alias("query")), companies).withColumnRenamed("query", "half")
    j = halves.join(each, "half")
    per = j.groupBy("query").agg(F.collect_set(F.when(F.col("status") == "ok", F.col("ticker"))).alias("t"), F.max((F.col("status") == "ambiguous").cast("int")).alias("amb"))
    status = F.when(F.size("t") > 1, "ambiguous").when(F.size("t") == 1, "ok").when(F.col("amb") == 1, "ambiguous").otherwise("not_found")
    return per.select("query", status.alias("status"), F.when(F.size("t") == 1, F.col("t")[0]).alias("ticker"))


def suggestions(queries: DataFrame, companies: DataFrame, n: int = 3) -> DataFrame:
    """query, ticker, name, score, place: the closest names by the ratio of whole names or of head words; weak by definition.

    Names and head words alike are found apart. All names of a head word have that word's ratio, so of those that are not alike
    as a whole only the first n by the order of places can be suggested, and no query meets all names of a common head word.
    Their n-th best score is a bound: whole names of a lesser ratio can't be suggested, so a query is held only against names of a
    ratio of the step below its bound.
    """
    names = saved(forms(companies), "forms")
    q = queries.select("query").distinct().withColumn("q", simplify(F.col("query"))).withColumn("q_head", _head(F.col("q"))).where("q <> ''")
    q = saved(q, "asked")
    heads = alike(q.select("q_head"), names.select("head"), SUGGEST).select(F.col("x").alias("q_head"), F.col("y").alias("head"), "ratio")
    of_head = names.select("head", "ticker", "name").distinct()
    of_head = of_head.withColumn("_r", F.row_number().over(Window.partitionBy("head").orderBy(F.length("name"), "ticker", "name"))).where(F.col("_r") <= n)
    by_head = saved(q.join(heads, "q_head").join(of_head, "head").select("query", "q", "ticker", "name", F.col("ratio").alias("score")), "by_head")
    best = by_head.groupBy("query", "q", "ticker", "name").agg(F.max("score").alias("score"))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_r") == n)
    step = reduce(lambda s, r: F.when(F.col("score") >= r, r).otherwise(s), STEPS[1:], F.lit(STEPS[0]))
    # names that several queries become are looked for from the lowest of their steps
    steps = q.join(best.select("query", "score"), "query", "left").groupBy("q").agg(F.min(step).alias("step"))
    steps = saved(steps, "steps")
    asked = [r["step"] for r in steps.select("step").distinct().collect()]  # as many as STEPS at most
    found = [alike(steps.where(F.col("step") == r).select("q"), names.select("simple"), r) for r in sorted(asked)]
    if not found:
        found = [alike(q.select("q"), names.select("simple"), SUGGEST)]
    whole = reduce(DataFrame.unionByName, found).select(F.col("x").alias("q"), F.col("y").alias("simple"), "ratio")
    by_whole = q.join(whole, "q").join(names, "simple").join(heads.withColumnRenamed("ratio", "h"), ["q_head", "head"], "left")
    by_whole = by_whole.select("query", "ticker", "name", F.greatest("ratio", F.coalesce("h", F.lit(0.0))).alias("score"))
    j = by_whole.union(by_head.drop("q"))
    j = j.groupBy("query", "ticker", "name").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.length("name"), "ticker")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query", "ticker", "name", "score", "place")


def displayed(nodes: DataFrame) -> DataFrame:
    """name, canonical: the spelling shown for each name, that of its key group."""
    groups = key_groups(nodes).select("display", F.explode("members").alias("name"))
    return nodes.select("name").distinct().join(groups, "name", "left").select("name", F.coalesce("display", "name").alias("canonical"))


def review(nodes: DataFrame, least: int = 2) -> DataFrame:
    """group_key, members, display, n over nodes (name): the groups of names that may be one entity and that a person should look at."""
    groups = key_groups(nodes).withColumn("n", F.size("members"))
    return groups.where(F.col("n") >= least)


def find_ranked(nodes: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """query, name, label, tier, weak, place over nodes (name, label): exact, word prefix, word, substring; companies first, then shorter names."""
    low, q = F.lower("name"), F.lower("query")
    esc = F.concat(F.lit("\\Q"), q, F.lit("\\E"))
    word = F.regexp(low, F.concat(F.lit("(^|[^a-z0-9])"), esc, F.lit("([^a-z0-9]|$)")))
    tier = F.when(low == q, 0).when(F.startswith(low, q) & word, 1).when(word, 2).when(F.contains(low, q), 3)
    j = nodes.crossJoin(queries.select("query").distinct()).withColumn("tier", tier).where("tier is not null")  # a stated set of questions against all nodes
    w = Window.partitionBy("query").orderBy("tier", (F.col("label") != "Company"), F.length("name"), "name")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query", "name", "label", "tier", (F.col("tier") == 3).alias("weak"), "place")


def key_groups(nodes: DataFrame) -> DataFrame:
    """group_key, members, display over nodes (name): names with one key; a key cut short joins the longer one it begins (12 letters or more, 5 or fewer missing), and that the one it begins."""
    keys = nodes.select("name", name_key(F.col("name")).alias("k")).where("k <> ''")
    distinct = keys.select("k").distinct()
    cut = distinct.where(F.length("k") >= 12).select(F.col("k").alias("short"), F.substring("k", 1, 12).alias("_p"))
    longer = distinct.where(F.length("k") > 12).select(F.col("k").alias("long"), F.substring("k", 1, 12).alias("_p"))
    fold = cut.join(longer, "_p").where((F.length("long") > F.length("short")) & (F.length("long") - F.length("short") <= 5) & F.col("long").startswith(F.col("short")))
    fold = followed(fold.select(F.col("short").alias("loser"), F.col("long").alias("survivor"))).select(F.col("loser").alias("short"), F.col("survivor").alias("long"))
    named = keys.join(fold, F.col("k") == F.col("short"), "left").withColumn("group_key", F.coalesce("long", "k"))
    shown = F.min_by("name", F.struct((F.upper("name") == F.col("name")).cast("int"), -F.length("name"), F.col("name")))
    return named.groupBy("group_key").agg(F.sort_array(F.collect_set("name")).alias("members"), shown.alias("display"))


def askable_names(companies: DataFrame, forms: DataFrame) -> DataFrame:
    """ticker, name: of each company's forms (ticker, form, pos) the first that resolves back to it alone."""
    back = resolve(forms.select(F.col("form").alias("query")), companies).where("status = 'ok'").select(F.col("query").alias("form"), F.col("ticker").alias("_t"))
    good = forms.join(back, "form").where("ticker = _t")
    return good.groupBy("ticker").agg(F.min_by("form", "pos").alias("name"))
