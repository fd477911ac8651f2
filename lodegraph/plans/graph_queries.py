"""Queries over the graph that the driver's tables form, and over plan DAGs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import graph, knowledge, plan
from lodegraph.plans.catalogue import query

NODES = """nodes AS (SELECT 'region:' || r_regionkey AS id, 'region' AS type, 'Place' AS domain FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 'place' FROM nation
 UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'party' FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'Party' FROM customer)"""
EDGES = """edges AS (SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'in' AS rel FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'of' FROM supplier
 UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'of' FROM customer)"""


def star(read):
    return graph.star_schema_graph(read("region"), read("nation"), read("supplier"), read("customer"))


@query("graph_stats", f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel")
def _stats(read):
    return graph.stats(*star(read))


@query("graph_symmetrise", f"WITH {EDGES} SELECT source, target, rel, 1.0::DOUBLE AS weight, false AS is_backlink FROM edges UNION ALL SELECT DISTINCT target, source, rel, 1.0, true FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.source = e.target AND f.target = e.source AND f.rel = e.rel)")
def _symmetrise(read):
    return graph.symmetrise(star(read)[1])


@query("graph_dead_links", f"WITH {NODES}, {EDGES}, kept AS (SELECT * FROM nodes WHERE id NOT IN ('nation:3', 'region:1')) SELECT source, target, rel FROM edges WHERE target NOT IN (SELECT id FROM kept)")
def _dead(read):
    nodes, edges = star(read)
    return graph.dead_links(nodes.where(~F.col("id").isin("nation:3", "region:1")), edges).select("source", "target", "rel")


@query("graph_dead_links_both_ends", f"WITH {NODES}, {EDGES}, kept AS (SELECT * FROM nodes WHERE type <> 'region' AND id <> 'nation:3') SELECT DISTINCT source, target, rel FROM edges WHERE target NOT IN (SELECT id FROM kept) OR source NOT IN (SELECT id FROM kept)")
def _dead_both(read):
    nodes, edges = star(read)
    return graph.dead_links(nodes.where("type <> 'region' AND id <> 'nation:3'"), edges, both_ends=True).select("source", "target", "rel")


@query("graph_orphans", f"WITH {NODES}, {EDGES}, e AS (SELECT * FROM edges WHERE rel = 'in') SELECT id, type FROM nodes WHERE id NOT IN (SELECT source FROM e UNION ALL SELECT target FROM e)")
def _orphans(read):
    nodes, edges = star(read)
    return graph.orphans(nodes, edges.where("rel = 'in'")).select("id", "type")


@query("graph_backlinks", f"WITH {EDGES} SELECT source, rel FROM edges WHERE target = 'nation:7'")
def _backlinks(read):
    return graph.backlinks(star(read)[1], "nation:7").select("source", "rel")


@query("graph_communities", f"WITH {NODES} SELECT lower(domain) AS community, id, count(*) OVER (PARTITION BY lower(domain)) AS size FROM nodes QUALIFY size >= 3")
def _communities(read):
    return graph.communities(star(read)[0])


@query("shared_domain_conflicts", f"WITH {NODES}, {EDGES} SELECT source, target, 1 AS shared FROM edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE rel = 'in' AND lower(a.domain) = lower(b.domain)")
def _conflicts(read):
    nodes, edges = star(read)
    lower = nodes.withColumn("domains", F.transform("domains", F.lower))
    return graph.shared_domain_conflicts(lower, edges, "in")


def _ppr_sql(rounds: int, weight: str = "1.0") -> str:
    parts = [f"WITH {NODES}, {EDGES}, w AS (SELECT source, target, {weight} AS weight FROM edges), b AS (SELECT source AS s, target AS t, weight FROM w UNION ALL SELECT target, source, weight FROM w), d AS (SELECT s, sum(weight) AS total FROM b GROUP BY s)",
             "seed AS (SELECT id, CASE WHEN id IN ('nation:1', 'nation:2') THEN 0.5 ELSE 0 END::DOUBLE AS m FROM nodes)", "r0 AS (SELECT id, m AS score FROM seed)"]
    for i in range(rounds):
        parts.append(f"g{i} AS (SELECT t AS id, sum(score * weight / total) AS got FROM b JOIN d USING (s) JOIN r{i} r ON r.id = b.s GROUP BY t)")
        parts.append(f"l{i} AS (SELECT coalesce(sum(score), 0) AS loose FROM r{i} WHERE id NOT IN (SELECT s FROM d))")
        parts.append(f"r{i + 1} AS (SELECT seed.id, 0.15 * m + 0.85 * (coalesce(got, 0) + loose * m) AS score FROM seed LEFT JOIN g{i} USING (id), l{i})")
    return ", ".join(parts) + f" SELECT id, round(score, 8) AS score FROM r{rounds} WHERE round(score, 8) > 0"


def _ranked_nodes(read, weight=None, **how):
    nodes, edges = star(read)
    seeds = nodes.where(F.col("id").isin("nation:1", "nation:2")).select("id", F.lit(1.0).alias("mass"))
    edges = edges if weight is None else edges.withColumn("weight", weight)
    return graph.personalised_pagerank(nodes, edges, seeds, **how).select("id", F.round("score", 8).alias("score")).where("score > 0")


@query("ppr_fixed_iter", _ppr_sql(4))
def _ppr(read):
    return _ranked_nodes(read, rounds=4)


#: Weights of 1 to 4, so that shares go by weight and not by degree.
@query("ppr_weighted", _ppr_sql(6, "(1 + length(source) % 4)::DOUBLE"))
def _ppr_weighted(read):
    return _ranked_nodes(read, (F.length("source") % 4 + 1).cast("double"), rounds=6, tolerance=0.0)


@query("ppr_converging")
def _ppr_converging(read):
    """With the operator's own ROUNDS and TOLERANCE."""
    nodes, edges = star(read)
    seeds = nodes.where(F.col("id").isin("nation:1", "nation:2")).select("id", F.lit(1.0).alias("mass"))
    return graph.personalised_pagerank(nodes, edges, seeds).select("id", F.round("score", 8).alias("score")).where("score > 0")


@query("associative_many")
def _associative_many(read):
    """The nations as questions, all in one job; no SQL, as rounds go on until little mass is unsent. Tests hold it to each walk."""
    nodes, edges = star(read)
    questions = read("nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    found = knowledge.associative_many(questions, nodes.where("label IS NOT NULL"), edges, ("region",), epsilon=0.05)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "is_seed", "rank")


@query("hierarchy_trace", f"""WITH RECURSIVE {EDGES}, t AS (SELECT 'supplier:5' AS id, 0 AS hops UNION SELECT target, hops + 1 FROM t JOIN edges ON source = id WHERE hops < 2)
SELECT id, hops, round(CASE WHEN hops = 0 THEN 1.0 ELSE 0.8 ** hops END, 6)::DOUBLE AS score FROM t""")
def _trace(read):
    nodes, edges = star(read)
    return graph.trace(edges, nodes.where("id = 'supplier:5'").select("id")).select("id", "hops", F.round("score", 6).alias("score"))


@query("hyperedge_star", """WITH p AS (SELECT DISTINCT conv_id, role FROM conversations), g AS (SELECT DISTINCT list_sort(list(role)) AS r FROM p GROUP BY conv_id)
SELECT unnest(r) AS source, 'he::meeting::' || array_to_string(r, '|') AS target, 'takes_part' AS rel, 1.0::DOUBLE AS weight FROM g""")
def _hyper(read):
    groups = read("conversations").groupBy("conv_id").agg(F.collect_set("role").alias("participants"))
    return graph.hyperedges(groups, "meeting")[1]


#: A plan from the whole parts table: part k depends on part k // 2, so levels grow with the logarithm of the parts.
WHOLE_PLAN = """n AS (SELECT p_partkey AS id, p_size::DOUBLE AS minutes FROM part),
e AS (SELECT id // 2 AS source, id AS target FROM n WHERE id > 1 AND id // 2 IN (SELECT id FROM n))"""


def whole_plan_tables(read):
    n = read("part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("double").alias("minutes"))
    e = n.where("id > 1").select(F.floor(F.col("id") / 2).alias("source"), F.col("id").alias("target"))
    return n, e.join(n.select(F.col("id").alias("source")), "source", "left_semi")


@query("plan_levels", f"WITH RECURSIVE {WHOLE_PLAN}, l AS (SELECT id, 0 AS level FROM n UNION SELECT e.target, level + 1 FROM l JOIN e ON e.source = l.id) SELECT id, max(level) AS level FROM l GROUP BY id")
@query("plan_levels_whole", f"WITH RECURSIVE {WHOLE_PLAN}, l AS (SELECT id, 0 AS level FROM n UNION SELECT e.target, level + 1 FROM l JOIN e ON e.source = l.id) SELECT id, max(level) AS level FROM l GROUP BY id")
def _levels_whole(read):
    return plan.levels(*whole_plan_tables(read))


@query("plan_batches", f"WITH RECURSIVE {WHOLE_PLAN}, l AS (SELECT id, 0 AS level FROM n UNION SELECT e.target, level + 1 FROM l JOIN e ON e.source = l.id), m AS (SELECT id, max(level) AS level FROM l GROUP BY id) SELECT level, count(*) AS n_nodes, max(minutes) AS minutes FROM m JOIN n USING (id) GROUP BY level")
@query("plan_batches_whole", f"WITH RECURSIVE {WHOLE_PLAN}, l AS (SELECT id, 0 AS level FROM n UNION SELECT e.target, level + 1 FROM l JOIN e ON e.source = l.id), m AS (SELECT id, max(level) AS level FROM l GROUP BY id) SELECT level, count(*) AS n_nodes, max(minutes) AS minutes FROM m JOIN n USING (id) GROUP BY level")
def _batches_whole(read):
    return plan.batches(*whole_plan_tables(read))


@query("plan_critical_path", f"WITH RECURSIVE {WHOLE_PLAN}, l AS (SELECT id, minutes AS finish FROM n UNION SELECT e.target, finish + n.minutes FROM l JOIN e ON e.source = l.id JOIN n ON n.id = e.target) SELECT id, max(finish) AS finish FROM l GROUP BY id")
@query("plan_critical_path_whole", f"WITH RECURSIVE {WHOLE_PLAN}, l AS (SELECT id, minutes AS finish FROM n UNION SELECT e.target, finish + n.minutes FROM l JOIN e ON e.source = l.id JOIN n ON n.id = e.target) SELECT id, max(finish) AS finish FROM l GROUP BY id")
def _critical_whole(read):
    return plan.critical_path(*whole_plan_tables(read))


@query("plan_ready", f"WITH {WHOLE_PLAN}, d AS (SELECT id FROM n WHERE id % 3 = 1) SELECT id FROM n WHERE id NOT IN (SELECT id FROM d) AND id NOT IN (SELECT target FROM e WHERE source NOT IN (SELECT id FROM d))")
@query("plan_ready_whole", f"WITH {WHOLE_PLAN}, d AS (SELECT id FROM n WHERE id % 3 = 1) SELECT id FROM n WHERE id NOT IN (SELECT id FROM d) AND id NOT IN (SELECT target FROM e WHERE source NOT IN (SELECT id FROM d))")
def _ready_whole(read):
    n, e = whole_plan_tables(read)
    return plan.ready(n, e, n.where("id % 3 = 1").select("id")).select("id")


@query("stall_detect", f"WITH {WHOLE_PLAN} SELECT id, elapsed, greatest(10.0, minutes * 2)::DOUBLE AS allowed FROM (SELECT id, minutes, (id % 120)::DOUBLE AS elapsed FROM n) WHERE elapsed > greatest(10.0, minutes * 2)")
@query("stall_detect_whole", f"WITH {WHOLE_PLAN} SELECT id, elapsed, greatest(10.0, minutes * 2)::DOUBLE AS allowed FROM (SELECT id, minutes, (id % 120)::DOUBLE AS elapsed FROM n) WHERE elapsed > greatest(10.0, minutes * 2)")
def _stall_whole(read):
    n, _ = whole_plan_tables(read)
    return plan.stalled(n.select("id", (F.col("id") % 120).cast("double").alias("elapsed")), n).select("id", "elapsed", "allowed")


@query("parity_full_outer", "SELECT coalesce(a.k, b.k) AS id, CASE WHEN a.k IS NULL THEN 'phantom' ELSE 'dead' END AS problem FROM (SELECT DISTINCT vec_id AS k FROM embeddings) a FULL JOIN (SELECT DISTINCT doc_id AS k FROM documents) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def _parity(read):
    return plan.contract(read("embeddings").select(F.col("vec_id").alias("id")), read("documents").select(F.col("doc_id").alias("id")))
