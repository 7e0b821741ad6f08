"""Raw triples to knowledge edges: normalise, validate with a reason, curate, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasslark.functions.text import squeezed

#: The relations, with the kinds of their ends, and other spellings of them.
RELATIONS = (
    ("COMPETES_WITH", "Company", "Company"), ("SUPPLIED_BY", "Company", "Company"), ("CUSTOMER_OF", "Company", "Company"), ("PARTNERS_WITH", "Company", "Company"), ("SUBSIDIARY_OF", "Company", "Company"),
    ("ACQUIRED", "Company", "Company"), ("OPERATES_SEGMENT", "Company", "Segment"), ("OFFERS_PRODUCT", "Company", "Product"), ("BELONGS_TO_SEGMENT", "Product", "Segment"), ("USES_TECHNOLOGY", "Company", "Technology"),
    ("EXPOSED_TO_RISK", "Company", "RiskFactor"), ("REGULATED_BY", "Company", "Regulator"), ("OPERATES_IN", "Company", "Geography"), ("LED_BY", "Company", "Person"),
)
ALIASES = {
    "COMPETITOR_OF": "COMPETES_WITH", "COMPETES": "COMPETES_WITH", "RIVAL_OF": "COMPETES_WITH", "SUPPLIER_OF": "SUPPLIED_BY", "DEPENDS_ON": "SUPPLIED_BY", "RELIES_ON": "SUPPLIED_BY", "SELLS_TO": "CUSTOMER_OF",
    "PARTNER_OF": "PARTNERS_WITH", "COLLABORATES_WITH": "PARTNERS_WITH", "OWNS": "ACQUIRED", "PARENT_OF": "ACQUIRED", "HAS_SEGMENT": "OPERATES_SEGMENT", "PRODUCES": "OFFERS_PRODUCT", "SELLS": "OFFERS_PRODUCT",
    "FACES_RISK": "EXPOSED_TO_RISK", "SUBJECT_TO": "REGULATED_BY", "CEO_OF": "LED_BY",
}
#: Names too common to be an entity.
STOP_ENTITIES = (
    "company", "the company", "we", "our company", "us", "customers", "customer", "suppliers", "supplier", "competitors", "competitor", "third parties", "third party", "government", "certain customers", "others",
    "other companies", "products", "services", "business", "industry", "market", "technology", "accessories", "solutions", "software", "hardware", "product", "service", "products and services", "equipment", "systems",
    "platforms", "applications", "adverse macroeconomic conditions", "macroeconomic conditions", "economic conditions", "global and regional economic conditions", "general economic conditions", "competitive pressures",
    "competition", "economic uncertainty", "market conditions", "inflation", "uncertainty", "geopolitical tensions", "regulatory changes", "cybersecurity risks", "supply chain disruption", "supply chain disruptions",
)


#: Letters of Vietnamese, whose names were translated.
VIETNAMESE = "(?iu)[àáâãèéêìíòóôõùúýăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"


def relation(c) -> F.Column:
    """Upper case with underscores, other spellings replaced."""
    name = F.upper(F.regexp_replace(F.trim(c), r"[\s-]+", "_"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), name), name)


def validated(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """raw (chunk_id, source, source_type, relation, target, target_type, evidence, confidence) with relation normalised, confidence held to 0..1 and reject_reason (NULL: good).

    Reasons, the first that applies: short_name, stop_entity, self_loop, foreign_letters (names in filings in English have none), off_ontology, no_evidence (the first 120 signs of the evidence are not in the chunk), repeated.
    """
    spark = raw.sparkSession
    allowed = spark.createDataFrame([(*r, True) for r in RELATIONS], "rel string, source_type string, target_type string, allowed boolean")
    rows = raw.withColumn("rel", relation(F.col("relation"))).withColumn("source", F.trim("source")).withColumn("target", F.trim("target"))
    rows = rows.join(F.broadcast(allowed), ["rel", "source_type", "target_type"], "left").join(chunks.select("chunk_id", "text"), "chunk_id", "left")  # 14 rows
    low = lambda c: F.lower(c)
    stop = low("source").isin(*STOP_ENTITIES) | low("target").isin(*STOP_ENTITIES)
    seen = F.contains(squeezed(F.col("text")), F.substring(squeezed(F.col("evidence")), 1, 120))
    w = Window.partitionBy("chunk_id", low("source"), "rel", low("target")).orderBy(F.desc("confidence"), "evidence")
    reason = (
        F.when((F.length("source") < 2) | (F.length("target") < 2), "short_name").when(stop, "stop_entity").when(low("source") == low("target"), "self_loop").when(F.col("source").rlike(VIETNAMESE) | F.col("target").rlike(VIETNAMESE), "foreign_letters")
        .when(F.col("allowed").isNull(), "off_ontology").when(~F.coalesce(seen, F.lit(False)) | (F.trim("evidence") == ""), "no_evidence")
    )
    rows = rows.withColumn("reject_reason", reason)
    first = F.row_number().over(w)
    rows = rows.withColumn("reject_reason", F.coalesce("reject_reason", F.when(first > 1, "repeated")))
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return rows.select("chunk_id", "source", "source_type", F.col("rel").alias("relation"), "target", "target_type", "evidence", held.alias("confidence"), "reject_reason")


def curated(triples: DataFrame, aliases: DataFrame, noise: DataFrame) -> DataFrame:
    """Triples with names replaced by aliases (name, into) and `curation` (noise, self_loop or kept)."""
    a, b = (aliases.select(F.col("name").alias(f"_{s}"), F.col("into").alias(f"_{s}_into")) for s in ("s", "t"))
    rows = triples.join(a, F.col("source") == F.col("_s"), "left").join(b, F.col("target") == F.col("_t"), "left")
    rows = rows.withColumn("source", F.coalesce("_s_into", "source")).withColumn("target", F.coalesce("_t_into", "target")).drop("_s", "_s_into", "_t", "_t_into")
    n, m = (noise.select(F.col("name").alias(f"_{s}"), F.lit(True).alias(f"_{s}_bad")).distinct() for s in ("n", "m"))
    rows = rows.join(n, F.col("source") == F.col("_n"), "left").join(m, F.col("target") == F.col("_m"), "left")
    state = F.when(F.col("_n_bad") | F.col("_m_bad"), "noise").when(F.col("source") == F.col("target"), "self_loop").otherwise("kept")
    return rows.withColumn("curation", state).drop("_n", "_n_bad", "_m", "_m_bad")


def edges_of(triples: DataFrame) -> DataFrame:
    """src, rel, dst, mentions, confidence, evidence of good triples; the surest mention gives the evidence."""
    best = F.max_by("evidence", F.struct("confidence", "chunk_id"))
    return triples.groupBy(F.col("source").alias("src"), F.col("relation").alias("rel"), F.col("target").alias("dst")).agg(F.count(F.lit(1)).alias("mentions"), F.max("confidence").alias("confidence"), best.alias("evidence"))
