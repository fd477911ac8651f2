"""Graph operators over nodes(id, type, label, domains) and edges(source, target, rel, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import cut

ALPHA, ROUNDS, TOLERANCE = 0.15, 20, 1e-6
HOP_DECAY, DEPTH = 0.8, 2
MIN_COMMUNITY = 3


def symmetrise(edges: DataFrame) -> DataFrame:
    """Adds the missing reverse of each edge with weight 1; ``is_backlink`` marks them."""
    key = ["source", "target", "rel"]
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "rel").distinct()
    missing = back.join(edges.select(*key).distinct(), key, "left_anti")
    return edges.withColumn("is_backlink", F.lit(False)).unionByName(missing.withColumns({"weight": F.lit(1.0), "is_backlink": F.lit(True)}))


def dead_links(nodes: DataFrame, edges: DataFrame, both_ends: bool = False) -> DataFrame:
    """Edges whose target (or either end) is no node."""
    ids = nodes.select(F.col("id").alias("target")).distinct()
    dead = edges.join(ids, "target", "left_anti")
    if both_ends:
        sourceless = edges.join(ids.withColumnRenamed("target", "source"), "source", "left_anti")
        dead = dead.unionByName(sourceless.select(*dead.columns)).distinct()
    return dead


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return nodes.join(used, "id", "left_anti")


def backlinks(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("target") == node)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node type and by relation."""
    n = nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n"))
    return n.union(edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("n")))


def communities(nodes: DataFrame, least: int = MIN_COMMUNITY) -> DataFrame:
    """Nodes grouped by lower-cased domain, of at least ``least`` members; members stay rows, so no group is gathered."""
    member = nodes.select("id", F.explode("domains").alias("d")).select("id", F.lower("d").alias("community")).distinct()
    big = member.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return member.join(big, "community")


def shared_domain_conflicts(nodes: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    """Per edge of ``rel`` the domains that both ends have, with how many."""
    d = nodes.select("id", "domains")
    met = edges.where(F.col("rel") == rel).join(d.select(F.col("id").alias("source"), F.col("domains").alias("ds")), "source").join(d.select(F.col("id").alias("target"), F.col("domains").alias("dt")), "target")
    return met.select("source", "target", F.size(F.array_intersect("ds", "dt")).alias("shared")).where("shared > 0")


def hyperedges(groups: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """From groups (participants array): hyperedge nodes with an id that ignores order, and their star of edges."""
    named = groups.select(F.sort_array(F.array_distinct("participants")).alias("p"))
    he = named.select(F.concat(F.lit(f"he::{label}::"), F.array_join("p", "|")).alias("id"), "p").distinct()
    return he.select("id", F.lit("hyperedge").alias("type")), he.select(F.explode("p").alias("source"), F.col("id").alias("target"), F.lit("takes_part").alias("rel"), F.lit(1.0).alias("weight"))


def personalised_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, alpha: float = ALPHA, tolerance: float = TOLERANCE, every: int = 5) -> DataFrame:
    """(id, score): random walk with restart at seeds (id, mass).

    Each edge counts in both directions and takes the share of its weight (1 without that column) in all that its node has; the mass of nodes
    without neighbours returns to the seeds. Every few rounds the ranks are written out and the change is tested. Seeds that
    are no nodes do not count; if none has mass, the result is empty.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    out = edges.select("source", "target", weight.alias("weight")).union(edges.select("target", "source", weight)).toDF("source", "target", "weight")
    degree = out.groupBy("source").agg(F.greatest(F.sum("weight"), F.lit(1e-9)).alias("total"))
    links = cut(out.join(degree, "source"))
    seeds = seeds.join(nodes.select("id"), "id", "left_semi")
    total = seeds.agg(F.sum("mass").alias("t")).where("t > 0")
    start = nodes.select("id").join(seeds, "id", "left").crossJoin(F.broadcast(total)).select("id", (F.coalesce("mass", F.lit(0.0)) / F.col("t")).alias("seed"))
    start = cut(start)
    rank = start.select("id", F.col("seed").alias("score"))
    for i in range(1, rounds + 1):
        sent = links.join(rank, F.col("source") == F.col("id")).groupBy("target").agg(F.sum(F.col("score") * F.col("weight") / F.col("total")).alias("got"))
        loose = rank.join(degree, F.col("id") == F.col("source"), "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))
        got = F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("seed")
        new = start.join(sent, F.col("id") == F.col("target"), "left").crossJoin(F.broadcast(loose)).select("id", (alpha * F.col("seed") + (1 - alpha) * got).alias("score"))
        if i % every == 0:
            new = cut(new)
            change = new.join(rank.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
            if (change or 0.0) < tolerance:
                return new
        rank = new
    return rank


#: Mass of a question that may be left unsent.
EPSILON = 1e-3


def batched_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, epsilon: float = EPSILON, alpha: float = ALPHA, most_rounds: int = 200, every: int = 4) -> DataFrame:
    """(query_id, id, score) of many walks at once, by forward push from seeds (query_id, id, mass).

    Each question holds mass that is not yet sent. In a round every node that holds more than half of ``epsilon`` by the
    number of nodes keeps the share ``alpha`` and sends the rest to its neighbours, by the same weights as
    ``personalised_pagerank`` and, without neighbours, back to the question's seeds. Rounds end when no question holds more
    than ``epsilon``, so its scores sum to at least 1 - epsilon and are each at most epsilon below the walk's. Rows are
    those that a question has reached, keyed by question and node, so one question or one hub is spread as the joins are;
    they are written out after each round.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    out = edges.select("source", "target", weight.alias("weight")).union(edges.select("target", "source", weight)).toDF("source", "target", "weight")
    total = out.groupBy("source").agg(F.greatest(F.sum("weight"), F.lit(1e-9)).alias("total"))
    links = cut(out.groupBy("source", "target").agg(F.sum("weight").alias("weight")).join(total, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")))
    ends = cut(links.select(F.col("source").alias("id")).distinct())
    known = seeds.join(nodes.select("id").distinct(), "id", "left_semi").where("mass > 0").groupBy("query_id", "id").agg(F.sum("mass").alias("mass"))
    start = known.withColumn("seed", F.col("mass") / F.sum("mass").over(Window.partitionBy("query_id"))).select("query_id", "id", "seed")
    start = cut(start)
    least = epsilon / 2 / max(1, nodes.select("id").distinct().count())
    state = start.select("query_id", "id", F.lit(0.0).alias("score"), F.col("seed").alias("held"))
    for i in range(1, most_rounds + 1):
        full = F.col("held") > least
        sending = state.where(full).select("query_id", "id", ((1 - alpha) * F.col("held")).alias("sent"))
        sent = sending.join(links, F.col("id") == F.col("source")).select("query_id", F.col("target").alias("id"), F.lit(0.0).alias("score"), (F.col("sent") * F.col("share")).alias("held"))
        back = sending.join(ends, "id", "left_anti").groupBy("query_id").agg(F.sum("sent").alias("back")).join(start, "query_id")
        returned = back.select("query_id", "id", F.lit(0.0).alias("score"), (F.col("back") * F.col("seed")).alias("held"))
        kept = state.select("query_id", "id", (F.col("score") + F.when(full, alpha * F.col("held")).otherwise(0.0)).alias("score"), F.when(full, 0.0).otherwise(F.col("held")).alias("held"))
        state = cut(kept.unionByName(sent).unionByName(returned).groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.sum("held").alias("held")))
        if i % every == 0 and state.groupBy("query_id").agg(F.sum("held").alias("held")).where(F.col("held") > epsilon).isEmpty():
            break
    return state.where("score > 0").select("query_id", "id", "score")


def trace(edges: DataFrame, start: DataFrame, depth: int = DEPTH, decay: float = HOP_DECAY) -> DataFrame:
    """(id, hops, score) of nodes within ``depth`` hops along edges from ``start`` (id); shortest path first, then best score."""
    found = start.select("id", F.lit(0).alias("hops"), F.lit(1.0).alias("score"))
    front = found
    for hop in range(1, depth + 1):
        step = front.join(edges, F.col("id") == F.col("source")).groupBy(F.col("target").alias("next")).agg(F.max(F.col("weight") * decay**hop).alias("score"))
        front = step.join(found.select(F.col("id").alias("next")), "next", "left_anti").select(F.col("next").alias("id"), F.lit(hop).alias("hops"), "score")
        found = found.unionByName(front)
    return found


def star_schema_graph(region: DataFrame, nation: DataFrame, supplier: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph over the driver's tables: places and parties, linked by their foreign keys."""
    key = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))

    def node(frame: DataFrame, prefix: str, id_col: str, label: str, domain: str) -> DataFrame:
        return frame.select(key(prefix, id_col).alias("id"), F.lit(prefix).alias("type"), F.col(label).alias("label"), F.array(F.lit(domain)).alias("domains"))

    def edge(frame: DataFrame, a: tuple[str, str], b: tuple[str, str], rel: str) -> DataFrame:
        return frame.select(key(*a).alias("source"), key(*b).alias("target"), F.lit(rel).alias("rel"), F.lit(1.0).alias("weight"))

    nodes = node(region, "region", "r_regionkey", "r_name", "Place").union(node(nation, "nation", "n_nationkey", "n_name", "place")).union(node(supplier, "supplier", "s_suppkey", "s_name", "party")).union(node(customer, "customer", "c_custkey", "c_name", "Party"))
    edges = edge(nation, ("nation", "n_nationkey"), ("region", "n_regionkey"), "in").union(edge(supplier, ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "of")).union(edge(customer, ("customer", "c_custkey"), ("nation", "c_nationkey"), "of"))
    return nodes, edges
