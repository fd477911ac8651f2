"""Queries of policies, grades, plans, direct answers and what a rebuild takes over, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import governance as G
from lodegraph.operators import resolving as R
from lodegraph.plans.catalogue import query
from lodegraph.plans.graph_queries import EDGES, NODES, star

MARKED = "text || repeat(' [FONTE:a]', (doc_id % 12)::INT) || repeat(chr(10) || '### - frameworks', (doc_id % 70)::INT) || CASE WHEN doc_id % 3 = 0 THEN ' --- mental batch --- ' ELSE chr(10) END"
_COUNT = "((length(t) - length(replace(t, '{0}', ''))) / {1})::INT"
_ENDS = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _n(part: str) -> str:
    return _COUNT.format(part, len(part))


def _hits(column: str, marks) -> str:
    return " + ".join(f"contains({column}, '{m}')::INT" for m in marks)


@query("quality_scores", f"""WITH m AS (SELECT doc_id, {MARKED} AS t FROM documents), u AS (SELECT *, upper(t) AS u, len(regexp_extract_all(t, '{_ENDS}')) + CASE WHEN t <> '' AND NOT regexp_matches(t, '(?:{_ENDS})\\z') THEN 1 ELSE 0 END AS n FROM m),
p AS (SELECT doc_id, ({_hits('u', G.COVERAGE_MARKS)}) * 5 AS coverage, floor((({_n('#')} >= 3)::INT + ({_n('---')} >= 2 OR {_n('###')} >= 2)::INT + ({_n('- ')} >= 5 OR {_n('* ')} >= 5)::INT + (n BETWEEN 50 AND 5000)::INT) * 6.25)::INT AS clarity,
({_hits('u', G.COMPLETENESS_MARKS)}) * 5 AS completeness, {_n('^[')} + {_n('[FONTE')} AS c FROM u),
q AS (SELECT * EXCLUDE (c), CASE WHEN c >= 10 THEN 25 WHEN c >= 5 THEN 20 WHEN c >= 2 THEN 15 WHEN c >= 1 THEN 10 ELSE 0 END AS traceability FROM p),
r AS (SELECT *, coverage + clarity + completeness + traceability AS total FROM q)
SELECT *, CASE WHEN total >= 90 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 50 THEN 'C' WHEN total >= 30 THEN 'D' ELSE 'F' END AS grade FROM r""", ints=("coverage", "clarity", "completeness", "traceability", "total"))
def _quality(read):
    k = F.col("doc_id")
    text = F.concat(
        "text", F.expr("repeat(' [FONTE:a]', cast(doc_id % 12 AS int))"), F.expr("repeat('\\n### - frameworks', cast(doc_id % 70 AS int))"),
        F.when(k % 3 == 0, " --- mental batch --- ").otherwise("\n"),
    )
    return read("documents").select("doc_id", G.quality_score(text).alias("q")).select("doc_id", "q.*")


@query("noise_names", f"SELECT conv_id, turn, name, len(w) <= 1 OR len(list_filter(w, lambda x: x NOT IN ({', '.join(repr(w) for w in G.NOISE_WORDS.split())}))) = 0 OR length(name) < 4 AS noise FROM (SELECT *, list_filter(string_split_regex(lower(name), '\\s+'), lambda x: x <> '') AS w FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'The a ' || role WHEN 1 THEN 'it  is ' ELSE substring(text, 1, 9) END AS name FROM conversations))")
def _noise(read):
    name = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("The a "), "role")).when(F.col("turn") % 3 == 1, "it  is ").otherwise(F.substring("text", 1, 9))
    return read("conversations").select("conv_id", "turn", name.alias("name")).withColumn("noise", G.is_noise(F.col("name")))


_PATH = "CASE event_id % 8 WHEN 0 THEN 'core/a.py' WHEN 1 THEN 'logs/README.md' WHEN 2 THEN 'logs/' || event_type WHEN 3 THEN 'agents/x.md' WHEN 4 THEN 'secret/k' WHEN 5 THEN 'old/x 2.md' WHEN 6 THEN 'agents/.gitkeep' ELSE event_type || '/tmp_old/z' END"


@query("path_layers", f"WITH p AS (SELECT event_id, {_PATH} AS path FROM events) SELECT event_id, path, CASE WHEN contains(path, 'tmp_old') THEN 'DELETE' WHEN path LIKE 'secret%' THEN 'NEVER' WHEN path = 'logs/README.md' THEN 'L1' WHEN path LIKE 'logs%' THEN 'L3' WHEN path = 'agents/.gitkeep' THEN 'L1' WHEN path LIKE 'agents%' THEN 'L2' WHEN path LIKE 'core%' THEN 'L1' WHEN path LIKE '% 2.md' THEN 'DELETE' ELSE 'REVIEW' END AS layer FROM p")
def _layers(read):
    paths = read("events").select("event_id", F.expr(_PATH).alias("path"))
    return paths.withColumn("layer", G.layer_of(F.col("path"), ("tmp_old",), ("secret/", ".env", ".pem"), ("logs/",), ("agents/",), ("core/", "setup.cfg")))


@query("policy_decisions", """WITH p(step, mode, a1, a2, m) AS (VALUES ('click', 'whitelist', 1, 2, 5), ('error', 'blacklist', 3, 3, NULL), ('view', 'blacklist', 0, 0, 40)),
c AS (SELECT event_type AS step, user_id % 4 AS action, event_id FROM events),
r AS (SELECT c.*, p.mode, p.m, coalesce(CASE WHEN mode = 'whitelist' THEN action IN (a1, a2) ELSE action NOT IN (a1, a2) END, true) AS fits FROM c LEFT JOIN p USING (step)),
s AS (SELECT *, coalesce(sum(fits::INT) OVER (PARTITION BY step ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= m AS spent FROM r)
SELECT step, action, event_id, fits AND NOT coalesce(spent, false) AS allowed, CASE WHEN spent THEN 'max_calls' WHEN NOT fits THEN mode || ':' || action ELSE 'ok' END AS reason FROM s""")
def _policy(read):
    calls = read("events").select(F.col("event_type").alias("step"), (F.col("user_id") % 4).alias("action"), "event_id")
    rows = [("click", "whitelist", [1, 2], 5), ("error", "blacklist", [3], None), ("view", "blacklist", [0], 40)]
    return G.policy_decisions(calls, calls.sparkSession.createDataFrame(rows, "step string, mode string, actions array<bigint>, max_calls int"), ("event_id",))


@query("plan_findings", """WITH n AS (SELECT o_custkey AS plan, o_orderkey AS node, CASE WHEN o_orderstatus = 'F' THEN 'Git push ' ELSE 'build ' END || o_orderpriority AS label, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'devops' ELSE 'dev' END AS cap, o_orderkey % 11 = 0 AS b, o_orderkey % 7 = 0 AS f FROM orders),
p AS (SELECT c_custkey AS plan, c_acctbal AS cost, CASE c_custkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS x, c_mktsegment AS i FROM customer)
SELECT plan, NULL::BIGINT AS node, 'error' AS level, 'CODEOWNERS_VIOLATION' AS type FROM p WHERE x <> 'pass' UNION ALL SELECT plan, NULL, 'warning', 'NO_INVENTION' FROM p WHERE i <> 'pass' UNION ALL SELECT plan, NULL, 'warning', 'BUDGET_EXCEEDED' FROM p WHERE cost > 5000
UNION ALL SELECT plan, node, 'error', 'AGENT_AUTHORITY' FROM n WHERE label LIKE 'Git push%' AND cap = 'dev' UNION ALL SELECT plan, node, 'error', 'ROUTING_HARD_GATE_BLOCKED' FROM n WHERE b UNION ALL SELECT plan, node, 'warning', 'ROUTING_FALLBACK' FROM n WHERE f""")
def _plans(read):
    k = F.col("o_orderkey")
    label = F.concat(F.when(F.col("o_orderstatus") == "F", "Git push ").otherwise("build "), "o_orderpriority")
    capability = F.when(k % 3 == 0, "").when(k % 3 == 1, "devops").otherwise("dev")
    nodes = read("orders").select(F.col("o_custkey").alias("plan"), k.alias("node"), label.alias("label"), capability.alias("capability"), (k % 11 == 0).alias("blocked"), (k % 7 == 0).alias("fallback"))
    c = F.col("c_custkey")
    none = F.lit(None).cast("string")
    owners = F.when(c % 3 == 0, "pass").when(c % 3 == 1, "fail")
    plans = read("customer").select(c.alias("plan"), F.col("c_acctbal").alias("cost"), owners.alias("codeowners"), none.alias("isolation"), F.lit("pass").alias("authority"), F.col("c_mktsegment").alias("invention"))
    return G.plan_findings(nodes, plans, 5000.0)


@query("status_findings", """WITH n AS (SELECT user_id AS node, user_id % 30 AS ref, arg_max(event_type, ts) AS status, max(event_type) AS last_event, max(ts) AS started, min(ts) + INTERVAL 200 DAY AS finished FROM events GROUP BY user_id UNION ALL SELECT n_nationkey::BIGINT, n_nationkey::BIGINT % 30, 'x', 'y', NULL, NULL FROM nation),
h AS (SELECT user_id AS node, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_type AS s FROM events), l AS (SELECT node, arg_max(s, place) AS s FROM h GROUP BY node)
SELECT node, 'UNKNOWN_PLAN_NODE_REF' AS type FROM n WHERE ref >= 25 UNION ALL SELECT node, 'LAST_HISTORY_STATUS_MISMATCH' FROM n JOIN l USING (node) WHERE status <> s UNION ALL SELECT node, 'LAST_EVENT_TYPE_MISMATCH' FROM n JOIN l USING (node) WHERE last_event <> s
UNION ALL SELECT node, 'FINISHED_BEFORE_STARTED' FROM n WHERE finished < started UNION ALL SELECT node, 'DUPLICATE_NODE_ID' FROM (SELECT node, unnest(range(count(*) - 1)) FROM n GROUP BY node)
UNION ALL SELECT node, 'HISTORY_OUT_OF_ORDER' FROM (SELECT node, t, lag(t) OVER (PARTITION BY node ORDER BY place) AS b FROM h) WHERE t < b""")
def _status(read):
    from pyspark.sql import Window

    e = read("events")
    days = F.expr("INTERVAL 200 DAYS")
    n = e.groupBy(F.col("user_id").alias("node")).agg(F.max_by("event_type", "ts").alias("status"), F.max("event_type").alias("last_event"), F.max("ts").alias("started"), (F.min("ts") + days).alias("finished"))
    extra = read("nation").select(F.col("n_nationkey").cast("long").alias("node"), F.lit("x").alias("status"), F.lit("y").alias("last_event"))
    nodes = n.unionByName(extra, allowMissingColumns=True).withColumn("ref", F.col("node") % 30)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    history = e.select(F.col("user_id").alias("node"), F.col("ts").alias("at"), place.alias("place"), F.col("event_type").alias("status"), F.col("event_type").alias("event"))
    return G.status_findings(nodes, history, read("nation").select(F.col("n_nationkey").cast("long").alias("ref")))


@query("phase_metrics", "SELECT user_id AS run, round(coalesce(sum(s) FILTER (e), 0), 2)::DOUBLE AS seconds, count(*) AS begun, count(*) FILTER (e) AS ended FROM (SELECT user_id, event_id % 5 AS s, event_id % 3 > 0 AS e FROM events) GROUP BY user_id")
def _metrics(read):
    ended = F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 5))
    return G.phase_metrics(read("events").select(F.col("user_id").alias("run"), F.col("ts").alias("started"), ended.alias("ended")))


CONTRACTS = {"north": ("the", "er"), "south": ("que", "de", "la"), "east": ("sch", "der", "ung")}
_SCORES = {name: " + ".join(f"contains(t, '{w}')::INT" for w in words) for name, words in CONTRACTS.items()}


@query("contract_of_question", f"WITH s AS (SELECT item_id, {_SCORES['north']} AS a, {_SCORES['south']} AS b, {_SCORES['east']} AS c FROM (SELECT item_id, trim(lower(text)) AS t FROM benchmark)) SELECT item_id, CASE WHEN a >= b AND a >= c THEN 'north' WHEN b >= c THEN 'south' ELSE 'east' END AS domain, greatest(a, b, c) AS hits FROM s WHERE greatest(a, b, c) > 0", ints=("hits",))
def _contract(read):
    return read("benchmark").select("item_id", R.contract_of(F.col("text"), CONTRACTS).alias("c")).where("c IS NOT NULL").select("item_id", "c.*")


@query("bounded_files", "WITH f AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations WHERE text IS NOT NULL), t AS (SELECT *, CASE WHEN length(text) <= 700 - b THEN length(text) WHEN 700 - b > 200 THEN 700 - b END AS taken FROM f) SELECT conv_id, turn, taken, substring(text, 1, taken::BIGINT) AS text FROM t WHERE taken IS NOT NULL AND b < 700", ints=("taken",))
def _bounded(read):
    return R.bounded_files(read("conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", most=700)


@query("joined_context", "WITH c AS (SELECT d.doc_id, coalesce(d.text, '') AS f, coalesce(b.text, '') AS m FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id), p AS (SELECT doc_id, CASE WHEN m = '' THEN substring(f, 1, 400) ELSE substring(f, 1, 280) END AS f, substring(m, 1, 120) AS m FROM c) SELECT doc_id, CASE WHEN f <> '' AND m <> '' THEN f || chr(10) || chr(10) || '---' || chr(10) || chr(10) || m ELSE f || m END AS context FROM p")
def _context(read):
    both = read("documents").join(read("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("memory")), "doc_id", "left")
    return both.select("doc_id", R.joined_context(F.col("text"), F.col("memory"), 100).alias("context"))


@query("seeded_vectors", "WITH p AS (SELECT sha256((vec_id % 300)::VARCHAR) AS sha, arg_max(embedding[1], vec_id) AS v FROM embeddings WHERE label % 3 > 0 GROUP BY 1), a AS (SELECT sha256((vec_id % 300 + 150)::VARCHAR) AS sha, arg_max(embedding[1], vec_id) AS v FROM embeddings WHERE label % 2 = 0 GROUP BY 1) SELECT sha, coalesce(a.v, p.v)::DOUBLE AS head, CASE WHEN a.v IS NULL THEN 'prior' ELSE 'artifact' END AS origin FROM p FULL JOIN a USING (sha)")
def _seeded(read):
    e = read("embeddings")
    size = F.size("embedding")
    k = F.col("vec_id") % 300

    def side(key, good):
        return e.select(F.sha2(key.cast("string"), 256).alias("sha"), F.when(good, "m1").otherwise("m0").alias("model"), F.col("embedding").alias("vector"), F.col("vec_id").alias("ord"))

    dim = e.select(size.alias("n")).first().n
    return R.seeded_vectors(side(k, F.col("label") % 3 > 0), side(k + 150, F.col("label") % 2 == 0), "m1", dim).select("sha", F.get("vector", 0).cast("double").alias("head"), "origin")


@query("reused_chunks", "SELECT conv_id AS path, turn, text FROM conversations WHERE conv_id % 3 > 0 AND conv_id % 5 > 0")
def _reused(read):
    chunks = read("conversations").select(F.col("conv_id").alias("path"), "turn", "text")
    k = F.col("path")
    files = chunks.select("path").distinct()
    indexed = files.select("path", F.sha2(k.cast("string"), 256).alias("sha"), F.when(k % 5 > 0, "m1").otherwise("m0").alias("model"), F.lit("semantic").alias("mode"))
    live = files.select("path", F.sha2(F.when(k % 3 > 0, k).otherwise(-k - 1).cast("string"), 256).alias("sha"))
    return R.reused_chunks(chunks, indexed, live, "m1", "semantic")


@query("merged_sidecar", "WITH s AS (SELECT coalesce(CASE WHEN event_id % 10 > 0 THEN user_id::VARCHAR END, 'row:' || event_id) AS id, arg_max(value, event_id)::DOUBLE AS value FROM events GROUP BY 1) SELECT id, value FROM s UNION ALL SELECT c_custkey::VARCHAR, c_acctbal FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT id FROM s)")
def _sidecar(read):
    records = read("events").select(F.when(F.col("event_id") % 10 > 0, F.col("user_id")).alias("id"), F.col("value").cast("double").alias("value"), F.col("event_id").alias("ord"))
    target = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return R.merged_sidecar(records, "id", "ord", target).select("id", "value")


@query("insight_counts", "WITH r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Ann Lee' ELSE upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) END AS person, 1 AS n FROM customer UNION ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 4 > 0 AND p_size > 0 UNION ALL SELECT 'Ann Lee', 1 FROM nation UNION ALL SELECT n_name, n_regionkey FROM nation) SELECT person, sum(n)::BIGINT AS insights FROM r GROUP BY person")
def _insights(read):
    slug = F.when(F.col("c_custkey") % 2 == 0, F.lit("Ann Lee")).otherwise(F.lower("c_mktsegment"))
    persons = read("part").select(F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).otherwise("MEET-1").alias("person"), F.col("p_size").alias("n"))
    nation = read("nation")
    return R.insight_counts(read("customer").select(slug.alias("person")), persons, nation.select(F.lit("Ann Lee").alias("person")), nation.select(F.col("n_name").alias("person"), F.col("n_regionkey").alias("n")))


@query("domain_sections", "WITH s AS (SELECT user_id AS person, event_type AS domain, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'error' END, event_type) AS place FROM (SELECT DISTINCT user_id, event_type FROM events)) SELECT event_id, person, domain, place FROM s JOIN events ON user_id = person AND event_type = domain", ints=("place",))
def _sections(read):
    e = read("events").select(F.col("user_id").alias("person"), F.col("event_type").alias("domain"), "event_id")
    skilled = e.select("person", F.when(F.col("person") % 2 == 0, "view").otherwise("error").alias("domain"))
    return R.domain_sections(e, skilled)


@query("overlay_replayed", "WITH h AS (SELECT l_orderkey AS o, list_sort(list_distinct(list('p:' || l_suppkey))) AS m FROM lineitem GROUP BY l_orderkey), k AS (SELECT DISTINCT 'H:' || sha256(array_to_string(m, '|') || '|met') AS he, m FROM h), n AS (SELECT 'p:' || s_suppkey AS id, s_name AS label FROM supplier WHERE s_suppkey % 2 = 0), e AS (SELECT he, unnest(m) AS id FROM k) SELECT 'node' AS kind, id, label AS label FROM n UNION ALL SELECT DISTINCT 'node', id, CASE WHEN id = 'p:1' THEN 'One' ELSE substring(id, 3) END FROM e WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT 'node', he, 'met' FROM k UNION ALL SELECT 'edge', id, he FROM e")
def _overlay(read):
    overlay = read("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p:"), "l_suppkey")).alias("participants"))
    overlay = overlay.select("participants", F.lit("met").alias("rel_label"), F.lit(None).cast("string").alias("rel_type"), F.create_map(F.lit("p:1"), F.lit("One")).alias("labels"))
    people = read("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("p:"), "s_suppkey").alias("id"), F.lit("pessoa").alias("type"), F.col("s_name").alias("label"))
    nodes, edges = R.overlay_replayed(people, overlay)
    return nodes.select(F.lit("node").alias("kind"), "id", "label").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), F.col("target").alias("label")))


@query("entity_lookup", f"WITH {NODES}, {EDGES}, h AS (SELECT id FROM nodes WHERE contains(lower(id), 'nation:1')) SELECT source, target, rel, CASE WHEN source IN (SELECT id FROM h) AND target IN (SELECT id FROM h) THEN 'source+target' WHEN source IN (SELECT id FROM h) THEN 'source' ELSE 'target' END AS hit FROM edges WHERE source IN (SELECT id FROM h) OR target IN (SELECT id FROM h)")
def _lookup(read):
    nodes, edges = star(read)
    return R.entity_lookup(nodes, edges, "Nation:1").select("source", "target", "rel", "hit")


@query("numeric_heuristics", "SELECT p_partkey AS id, p_name AS label, p_brand AS person, p_type AS domain, p_retailprice AS weight FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 > 0 AND p_type = 'ECONOMY'")
def _numeric(read):
    k = F.col("p_partkey")
    nodes = read("part").select(k.alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("person"), F.array("p_type").alias("domains"), F.col("p_retailprice").alias("weight"), F.when(k % 3 > 0, "heuristica").otherwise("x").alias("type"), (F.col("p_size") % 2 == 0).alias("has_threshold"))
    return R.numeric_heuristics(nodes, domain="economy").select("id", "label", "person", F.get("domains", 0).alias("domain"), "weight")


@query("source_documents", "WITH f AS (SELECT 'unit/L' || event_id % 6 || '/' || event_id || '.md' AS path, event_id % 6 AS l, event_id FROM events) SELECT 'DOC:workspace:' || path AS id, 'workspace_doc' AS type, event_id::VARCHAR AS label, CASE WHEN l IN (3, 4) THEN 'raw' ELSE 'structured' END AS tier, CASE WHEN l < 5 THEN 'L' || l END AS layer, CASE l WHEN 0 THEN 365 WHEN 1 THEN 180 WHEN 2 THEN 90 WHEN 3 THEN 30 WHEN 4 THEN 7 END AS ttl_days FROM f UNION ALL SELECT 'FONTE:workspace', 'fonte', 'Workspace', 'structured', NULL, NULL", ints=("ttl_days",))
def _documents(read):
    k = F.col("event_id").cast("string")
    files = read("events").select(F.lit("workspace").alias("kind"), F.concat(F.lit("unit/L"), (F.col("event_id") % 6).cast("string"), F.lit("/"), k, F.lit(".md")).alias("path"), F.lit("").alias("title"))
    return R.source_documents(files, {"L0": 365, "L1": 180, "L2": 90, "L3": 30, "L4": 7}, 30)[0]


@query("layer_entities", "WITH p AS (SELECT c_mktsegment AS person, c_name AS t, 'conceito' AS type, 'USA' AS rel, c_custkey FROM customer UNION ALL SELECT c_mktsegment, 'N ' || c_nationkey, 'valor', 'TEM', c_custkey FROM customer WHERE c_nationkey % 2 = 0) SELECT person, type || ':' || person || ':' || regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g') AS id, type, t AS label, rel FROM p")
def _entities(read):
    c = read("customer").select(F.col("c_mktsegment").alias("person"), F.array("c_name", F.lit("")).alias("a"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.concat(F.lit("N "), "c_nationkey"))).alias("b"))
    return R.layer_entities(c, {"a": ("conceito", "USA"), "b": ("valor", "TEM")})


@query("file_themes", """WITH m AS (SELECT user_id AS source, CASE event_id % 2 WHEN 0 THEN 'theme' ELSE 'person' END AS kind, event_id, CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN ' ' || event_type || '!' ELSE '--' END AS name, event_type AS key FROM events),
f AS (SELECT source, kind, key, arg_min(name, event_id) AS name FROM m WHERE name <> '--' GROUP BY ALL)
SELECT source, kind, CASE WHEN kind = 'theme' AND key = 'view' THEN 'Sight' ELSE name END AS name, CASE WHEN kind = 'theme' AND key = 'view' THEN 'optics' END AS domain, NOT (kind = 'theme' AND key = 'view') AS is_new FROM f""")
def _file_themes(read):
    k, kind = F.col("event_id"), F.when(F.col("event_id") % 2 == 0, "theme").otherwise("person")
    name = F.when(k % 3 == 0, F.upper("event_type")).when(k % 3 == 1, F.concat(F.lit(" "), "event_type", F.lit("!"))).otherwise("--")
    mentions = read("events").select(F.col("user_id").alias("source"), kind.alias("kind"), k.alias("at"), name.alias("name"))
    registry = mentions.sparkSession.createDataFrame([("theme", "View.", "Sight", "optics"), ("theme", "VIEW", "Vision", "x")], "kind string, alias string, canonical string, domain string")
    return R.file_themes(mentions, registry)
