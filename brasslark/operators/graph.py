"""Graph queries over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasslark.sources.scratch import saved

#: Edges that tie companies to their records and are not knowledge.
INFRA = ("HAS_FINANCIALS", "FILED")
STRUCTURED = ("OWNED_BY",)
#: Stakes, as fractions: a chain controls if every link is above MAJORITY; chains under SMALL are left out.
MAJORITY, SMALL, SHARED, COMMON = 0.5, 0.005, 0.05, 0.20


def neighbors(edges: DataFrame, nodes: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """node, other, rel, direction (out or in) and whatever else edges have (evidence, doc_id, percent, as_of, ...) for the nodes asked for (column node).

    The direction is the edge's own, seen from the node; infrastructure is left out.
    """
    if relations is not None:
        edges = edges.where(F.col("rel").isin(relations))
    edges = edges.where(~F.col("rel").isin(*INFRA))
    rest = [c for c in edges.columns if c not in ("src", "rel", "dst")]
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel", F.lit("out").alias("direction"), *rest)
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "rel", F.lit("in").alias("direction"), *rest)
    return out.unionByName(back).join(nodes.select("node").distinct(), "node", "left_semi")


def top_neighbors(edges: DataFrame, nodes: DataFrame, limit: int = 12, relations: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """The `limit` surest neighbours of each node; unknown confidence counts as 0. tasks: how many the nodes are dealt to (Spark's choice if None)."""
    w = Window.partitionBy("node").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "other", "rel", "direction")
    found = neighbors(edges, nodes, relations)
    if tasks:
        found = found.repartition(tasks, "node")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def chains(stakes: DataFrame, starts: DataFrame, depth: int = 3, direction: str = "up") -> DataFrame:
    """start, path, percents: all simple chains of 1 to depth links from each start; `up` follows company to owner, `down` the reverse.

    One join a level. The fan-out is bounded by depth, and no node occurs twice in a path.
    """
    a, b = ("company", "owner") if direction == "up" else ("owner", "company")
    links = stakes.select(F.col(a).alias("_from"), F.col(b).alias("_to"), F.col("percent").alias("_p"))
    level = starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.array().cast("array<double>").alias("percents"))
    found = None
    for _ in range(depth):
        step = level.withColumn("_end", F.element_at("path", -1)).join(links, F.col("_end") == F.col("_from")).where(~F.array_contains("path", F.col("_to")))
        level = step.select("start", F.array_append("path", F.col("_to")).alias("path"), F.array_append("percents", F.col("_p")).alias("percents"))
        found = level if found is None else found.unionByName(level)
    return found


def with_interest(found: DataFrame) -> DataFrame:
    """Adds depth, end, economic (product of stakes), control (every link a majority), weakest; all NULL if a stake is unknown."""
    unknown = F.exists("percents", lambda p: p.isNull())
    known = lambda c: F.when(~unknown, c)
    return (
        found.withColumn("depth", F.size("percents"))
        .withColumn("end", F.element_at("path", -1))
        .withColumn("economic", known(F.aggregate("percents", F.lit(1.0), lambda s, p: s * p)))
        .withColumn("control", known(F.forall("percents", lambda p: p > MAJORITY)))
        .withColumn("weakest", known(F.array_min("percents")))
    )


def assembled(found: DataFrame) -> DataFrame:
    """with_interest's rows and a `reason` (unknown_stake, too_small, or kept), so that whatever is dropped can be counted."""
    rows = with_interest(found)
    return rows.withColumn("reason", F.when(F.col("economic").isNull(), "unknown_stake").when(F.col("economic") < SMALL, "too_small").otherwise("kept"))


def owner_kind(label) -> F.Column:
    """company, person, or organisation for all other labels."""
    return F.when(label == "Company", "company").when(label == "Person", "person").otherwise("organisation")


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """assembled's kept rows with direct (one link) and place: chains of control first, then the larger interest, `limit` direct and `limit` indirect ones a start."""
    kept = found.where("reason = 'kept'").withColumn("direct", F.col("depth") == 1)
    w = Window.partitionBy("start", "direct").orderBy((~F.col("control")).cast("int"), F.desc("economic"), "end", "path")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def network(stakes: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """start, controllers, controlled, verdict, owners, holdings, related, too_small, unknown_stakes, gaps: what is known of the ownership around each start.

    controllers and controlled are the ends of chains whose every link is a majority; verdict is controlled, controls, both or none.
    owners, holdings and related count kept chains up and down, and companies with a common large owner. gaps names what the answer lacks.
    """
    def side(direction: str, ends: str, n: str) -> DataFrame:
        rows = assembled(chains(stakes, starts, depth, direction))
        kept = F.col("reason") == "kept"
        return rows.groupBy("start").agg(
            F.sort_array(F.collect_set(F.when(kept & F.col("control"), F.col("end")))).alias(ends), F.count_if(kept).alias(n),
            F.count_if(F.col("reason") == "too_small").alias(f"{n}_small"), F.count_if(F.col("reason") == "unknown_stake").alias(f"{n}_unknown"),
        )

    shared = co_invested(stakes, starts).groupBy(F.col("node").alias("start")).agg(F.count(F.lit(1)).alias("related"))
    rows = starts.select(F.col("node").alias("start")).distinct()
    for part in (side("up", "controllers", "owners"), side("down", "controlled", "holdings"), shared):
        rows = rows.join(part, "start", "left")
    counts = ["owners", "holdings", "related", "owners_small", "holdings_small", "owners_unknown", "holdings_unknown"]
    rows = rows.na.fill(0, counts)
    none = F.array().cast(dict(rows.dtypes)["controllers"])
    rows = rows.withColumn("controllers", F.coalesce("controllers", none)).withColumn("controlled", F.coalesce("controlled", none))
    up, down = F.size("controllers") > 0, F.size("controlled") > 0
    verdict = F.when(up & down, "both").when(up, "controlled").when(down, "controls").otherwise("none")
    gaps = F.array_compact(F.array(
        F.when(F.col("owners") == 0, "no_owners"), F.when(F.col("owners_unknown") > 0, "unknown_stakes"), F.when(F.col("holdings") == 0, "no_holdings"), F.when(F.col("related") == 0, "no_shared_owners"),
    ))
    return rows.select(
        "start", "controllers", "controlled", verdict.alias("verdict"), "owners", "holdings", "related", (F.col("owners_small") + F.col("holdings_small")).alias("too_small"),
        (F.col("owners_unknown") + F.col("holdings_unknown")).alias("unknown_stakes"), gaps.alias("gaps"),
    )


def common_holders(stakes: DataFrame, starts: DataFrame) -> DataFrame:
    """left, right, owner, left_percent, right_percent, both_large: for each start (column node) every other company that has one of its owners.

    The starts are a stated set of questions; companies meet by their owners.
    """
    x = stakes.join(starts.select(F.col("node").alias("company")).distinct(), "company", "left_semi").select(F.col("company").alias("left"), "owner", F.col("percent").alias("left_percent"))
    y = stakes.select(F.col("company").alias("right"), "owner", F.col("percent").alias("right_percent"))
    joined = x.join(y, "owner").where(F.col("left") != F.col("right"))
    return joined.withColumn("both_large", (F.col("left_percent") >= COMMON) & (F.col("right_percent") >= COMMON))


def co_invested(stakes: DataFrame, starts: DataFrame, least: float = SHARED) -> DataFrame:
    """node, other, owners: companies in which an owner of the node also holds a stake, `least` or more on both sides."""
    big = stakes.where(F.col("percent") >= least)
    x = big.join(starts.select(F.col("node").alias("company")).distinct(), "company", "left_semi").select(F.col("company").alias("node"), "owner")
    y = big.select(F.col("company").alias("other"), "owner")
    return x.join(y, "owner").where("node <> other").groupBy("node", "other").agg(F.sort_array(F.collect_set("owner")).alias("owners"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, knowledge, ownership, infra: edges at either end, by class."""
    kind = F.when(F.col("rel").isin(*INFRA), "infra").when(F.col("rel").isin(*STRUCTURED), "ownership").otherwise("knowledge")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), kind.alias("kind"))
    return ends.groupBy("node").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("knowledge", "ownership", "infra")])


def shortest_paths(edges: DataFrame, sources: DataFrame, hops: int = 3, targets: DataFrame | None = None) -> DataFrame:
    """source, target, hops, path, rels, evidence: the first of the shortest undirected paths (in order of its nodes), at most `hops` long, to every node or to `targets` (source, target).

    rels and evidence are those of the path's links; of several edges between two nodes the first relation, then evidence stands. Breadth first
    from all sources (column source) at once: a level joins its frontier with the edges, keeps one path a node and takes out what was reached
    before. Levels are written to the shared folder, so the plan does not grow with the hops.
    """
    usable = edges.where(~F.col("rel").isin(*INFRA))
    told = F.coalesce("evidence", F.lit("")) if "evidence" in edges.columns else F.lit("")
    ends = lambda a, b: usable.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.struct("rel", told.alias("evidence")).alias("_e"))
    both = saved(ends("src", "dst").union(ends("dst", "src")).groupBy("_a", "_b").agg(F.min("_e").alias("_e")), "edges")
    none = F.array().cast("array<string>")
    frontier = sources.select("source").distinct().select("source", F.col("source").alias("node"), F.struct(F.array("source").alias("path"), none.alias("rels"), none.alias("evidence")).alias("way"))
    reached = frontier = saved(frontier, "level")
    for _ in range(hops):
        step = frontier.join(both, F.col("node") == F.col("_a"))
        way = F.struct(F.array_append("way.path", F.col("_b")).alias("path"), F.array_append("way.rels", F.col("_e.rel")).alias("rels"), F.array_append("way.evidence", F.col("_e.evidence")).alias("evidence"))
        step = step.select("source", F.col("_b").alias("node"), way.alias("way"))
        frontier = saved(step.groupBy("source", "node").agg(F.min("way").alias("way")).join(reached.select("source", "node"), ["source", "node"], "left_anti"), "level")
        reached = reached.unionByName(frontier)
    hit = reached.withColumnRenamed("node", "target").where("source <> target")
    if targets is not None:
        hit = hit.join(targets.select("source", "target").distinct(), ["source", "target"], "left_semi")
    return hit.select("source", "target", (F.size("way.path") - 1).alias("hops"), "way.path", "way.rels", "way.evidence")
