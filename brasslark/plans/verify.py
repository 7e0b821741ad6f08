"""Numbers in answers traced to their sources, and grades of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.functions.numbers import divide
from brasslark.functions.reading import graded_numbers_in, numbers_in
from brasslark.functions.text import upper
from brasslark.sources.scratch import saved

TOLERANCE, PERCENT_TOLERANCE, POOL = 0.01, 0.5, 4
LEAST, LEAST_MONEY = 1e6, 100.0


def answer_numbers(answers: DataFrame, graded: bool = False) -> DataFrame:
    """answer_id, token, at, value, negative, percent, money, sentence: one row a reading; graded with the scale words of a grader."""
    return answers.select("answer_id", F.explode((graded_numbers_in if graded else numbers_in)("text")).alias("n")).select("answer_id", "n.*")


def text_sources(texts: DataFrame) -> DataFrame:
    """answer_id, magnitude, sign 0: numbers of source texts, whose sign prose does not tell."""
    return texts.select("answer_id", F.explode(numbers_in("text")).alias("n")).select("answer_id", F.col("n.value").alias("magnitude"), F.lit(0).alias("sign"))


def value_sources(values: DataFrame) -> DataFrame:
    return values.select("answer_id", F.abs("value").alias("magnitude"), F.signum("value").cast("int").alias("sign"))


def leaves(observations: DataFrame) -> DataFrame:
    """answer_id, kind (number, text), number, text: the numbers and strings at any depth of observations (answer_id, data VARIANT).

    Objects and lists are opened one level a round, all rows at once; as many rounds as the deepest value has levels. Truth
    values and nulls are neither.
    """
    level, found = observations.select("answer_id", "data"), None
    while True:
        kind = F.schema_of_variant("data")
        level = saved(level.select("answer_id", "data", kind.alias("kind")), "level")
        text = F.col("kind") == "STRING"
        number = F.col("kind").isin("BIGINT", "DOUBLE", "FLOAT") | F.col("kind").startswith("DECIMAL")
        own = level.where(text | number).select("answer_id", F.when(text, "text").otherwise("number").alias("kind"), F.when(number, F.try_variant_get("data", "$", "double")).alias("number"), F.when(text, F.try_variant_get("data", "$", "string")).alias("text"))
        found = own if found is None else found.unionByName(own)
        inner = level.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        if inner.isEmpty():
            return found
        level = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("data").outer())).select("answer_id", F.col("value").alias("data"))


def nested_sources(observations: DataFrame) -> DataFrame:
    """answer_id, magnitude, sign of all numbers in what tools returned (answer_id, data VARIANT): strings are read as prose, whose sign is not known."""
    each = saved(leaves(observations), "leaves")
    told = text_sources(each.where("kind = 'text'").select("answer_id", "text"))
    return value_sources(each.where("kind = 'number'").select("answer_id", F.col("number").alias("value"))).unionByName(told)


def _grid(v: Column) -> Column:
    """Steps of the logarithm of a magnitude; values within TOLERANCE are at most one step apart."""
    return F.floor(F.log(F.greatest(v, F.lit(1.0))) / 0.02).cast("long")


def matched(numbers: DataFrame, sources: DataFrame) -> DataFrame:
    """numbers with `signs`, the signs of all sources of the answer within tolerance (NULL: none). Both sides meet in cells of the logarithm."""
    near = sources.select("answer_id", "magnitude", "sign", F.explode(F.array(*[_grid(F.col("magnitude")) + k for k in (-1, 0, 1)])).alias("_c"))
    keys = ["answer_id", "at", "value"]
    j = numbers.select(*keys, F.abs("value").alias("_v")).distinct().withColumn("_c", _grid(F.col("_v"))).join(near, ["answer_id", "_c"])
    hit = j.where(F.abs(F.col("_v") - F.col("magnitude")) <= TOLERANCE * F.greatest("magnitude", F.lit(1.0)))
    return numbers.join(hit.groupBy(*keys).agg(F.collect_set("sign").alias("signs")), keys, "left")


def check_numbers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, token, at, reason (not_in_source, sign_mismatch, percent_not_in_source, or NULL: good) for every number that is checked.

    A number is checked from a million up, or a hundred with a money unit. It is good if any reading has a source whose sign fits or is
    unknown. A percentage is good if it has a source, or follows from two of the first POOL large sourced numbers of its sentence.
    """
    rows = matched(answer_numbers(answers), sources)
    plain = rows.where(~F.col("percent") & (F.abs("value") >= F.when(F.col("money"), LEAST_MONEY).otherwise(LEAST)))
    per = plain.groupBy("answer_id", "token", "at").agg(F.array_distinct(F.flatten(F.collect_list("signs"))).alias("signs"), F.first("negative").alias("negative"))
    said = F.when(F.col("negative"), -1).otherwise(1)
    reason = F.when(F.size("signs") == 0, "not_in_source").when(F.array_contains("signs", 0) | F.array_contains("signs", said), None).otherwise("sign_mismatch")
    numbers = per.select("answer_id", "token", "at", reason.alias("reason"))

    pct = rows.where(F.col("percent") & (F.col("value") > 0) & (F.col("value") <= 1000))
    w = Window.partitionBy("answer_id", "sentence").orderBy("at", "value")
    pool = rows.where(~F.col("percent") & (F.abs("value") >= LEAST) & F.col("signs").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= POOL)
    pool = pool.groupBy("answer_id", "sentence").agg(F.collect_list(F.abs("value")).alias("pool"))
    j = pct.join(pool, ["answer_id", "sentence"], "left")
    close = lambda a, b, p: (a != b) & ((F.abs(F.try_divide(a * 100, b) - p) <= PERCENT_TOLERANCE) | (F.abs(F.try_divide((a - b) * 100, b) - p) <= PERCENT_TOLERANCE))
    derived = F.coalesce(F.exists("pool", lambda a: F.exists("pool", lambda b: F.coalesce(close(a, b, F.col("value")), F.lit(False)))), F.lit(False))
    good = j.groupBy("answer_id", "token", "at").agg(F.max((F.col("signs").isNotNull() | derived).cast("int")).alias("good"))
    return numbers.unionByName(good.select("answer_id", F.concat("token", F.lit("%")).alias("token"), "at", F.when(F.col("good") == 0, "percent_not_in_source").alias("reason")))


def grade_numeric(answers: DataFrame, expected: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """answer_id, error, correct: the least relative error (absolute where 0 is expected) over all readings and both signs in brackets."""
    v = answer_numbers(answers, graded=True).select("answer_id", F.when(F.col("negative"), -F.col("value")).otherwise(F.col("value")).alias("value"))
    e = F.abs(F.col("value") - F.col("expected"))
    best = expected.join(v, "answer_id", "left").groupBy("answer_id").agg(F.min(F.when(F.col("expected") == 0, e).otherwise(divide(e, F.abs("expected")))).alias("error"))
    return best.withColumn("correct", F.coalesce(F.col("error") <= tolerance, F.lit(False)))


def grade_entities(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """answer_id, recall, any_form over expected (answer_id, entity): shares of the entities named, in any case of letters."""
    j = expected.join(answers.select("answer_id", upper(F.col("text")).alias("text")), "answer_id", "left")
    hit = F.coalesce(F.contains("text", upper(F.col("entity"))), F.lit(False)).cast("double")
    return j.groupBy("answer_id").agg(F.avg(hit).alias("recall"), F.max(hit).alias("any_form"))


def grade_refusal(answers: DataFrame, cues: list[str], year: int | None = None) -> DataFrame:
    """answer_id, refused, correct: a cue of refusal, and no large number (with a year: none in a clause of that year or of no year)."""
    has = lambda words, c: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(c), w))
    base = answers.select("answer_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("refused", has(cues, F.col("text")))
    clauses = base.select("answer_id", F.posexplode(F.split("text", r"\n|[.;]\s") if year is not None else F.array("text")).alias("k", "clause"))
    big = F.exists(numbers_in("clause"), lambda n: n["value"] >= LEAST)
    rows = clauses.withColumn("big", big)
    if year is not None:
        years = F.regexp_extract_all("clause", F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
        rows = rows.withColumn("big", F.col("big") & (F.array_contains(years, str(year)) | (F.size(years) == 0)))
    made = rows.groupBy("answer_id").agg(F.max(F.col("big").cast("int")).alias("made"))
    return base.join(made, "answer_id").select("answer_id", "refused", (F.col("refused") & (F.col("made") == 0)).alias("correct"))


def grade_currency(answers: DataFrame, cues: list[str]) -> DataFrame:
    """answer_id, hits, correct: at least two cues of a currency warning."""
    hits = sum((F.coalesce(F.contains(F.lower("text"), F.lit(c.lower())), F.lit(False)).cast("int") for c in cues[1:]), F.coalesce(F.contains(F.lower("text"), F.lit(cues[0].lower())), F.lit(False)).cast("int"))
    return answers.select("answer_id", hits.alias("hits"), (hits >= 2).alias("correct"))


def rollup(results: DataFrame) -> DataFrame:
    """category (NULL: overall), n, accuracy, recall, seconds."""
    return results.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("recall").alias("recall"), F.avg("seconds").alias("seconds"))


def questions(years: DataFrame, metric: str, n: int, seed: str = "7") -> DataFrame:
    """qid, category, question, expected: a seeded sample of n lookups, the same in every run."""
    rows = years.where(F.col(metric).isNotNull()).withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "ticker", "fiscal_year"))).orderBy("_h").limit(n)
    text = F.format_string(f"What was the {metric.replace('_', ' ')} of %s in fiscal year %d?", F.col("name"), F.col("fiscal_year"))
    return rows.select(F.concat_ws("-", F.lit("lookup"), "ticker", "fiscal_year").alias("qid"), F.lit("lookup").alias("category"), text.alias("question"), F.col(metric).alias("expected"))


def comparison_questions(years: DataFrame, metric: str, n: int, seed: str = "7") -> DataFrame:
    """qid, question, entities, expected: pairs of companies of one year and currency, with the winner; a seeded sample of n."""
    w = Window.partitionBy("fiscal_year", "currency").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "ticker", "fiscal_year")))
    placed = years.where(F.col(metric).isNotNull()).withColumn("_r", F.row_number().over(w) - 1)
    pairs = placed.groupBy("fiscal_year", "currency", F.floor(F.col("_r") / 2).alias("_p")).agg(F.sort_array(F.collect_list(F.struct(F.col(metric).alias("v"), "ticker", "name")), asc=False).alias("two")).where(F.size("two") == 2)
    text = F.format_string("Which had the larger " + metric.replace("_", " ") + " in fiscal year %d, %s or %s?", F.col("fiscal_year"), F.least(F.col("two")[0]["name"], F.col("two")[1]["name"]), F.greatest(F.col("two")[0]["name"], F.col("two")[1]["name"]))
    rows = pairs.select(F.concat_ws("-", F.lit("compare"), F.col("two")[0]["ticker"], F.col("two")[1]["ticker"], "fiscal_year").alias("qid"), text.alias("question"), F.transform("two", lambda x: x["name"]).alias("entities"), F.col("two")[0]["name"].alias("expected"))
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "qid"))).limit(n)


def contexts(observations: DataFrame, limit: int = 12) -> DataFrame:
    """answer_id, contexts: the first texts of what an answer was made from (answer_id, pos, text)."""
    rows = observations.where("text is not null").withColumn("_r", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos", "text"))).where(F.col("_r") <= limit)
    return rows.groupBy("answer_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]).alias("contexts"))
