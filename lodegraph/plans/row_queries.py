"""Queries of single survey rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import dedup, entity, evals, extraction, graph, knowledge, retrieval, reviews, rules, upkeep, windows
from lodegraph.plans.catalogue import query


@query("chunk_relevance", "WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(lower(text), '[a-zà-ɏ]{3,}')) AS n, len(list_filter(regexp_extract_all(lower(text), '[a-zà-ɏ]{3,}'), lambda w: w IN ("
       + ", ".join(f"'{w}'" for w in upkeep.DOMAIN_WORDS["sales"].split()) + r"))) AS k, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS l, "
       + " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}'), lambda m: length(m))), 0)" for p in upkeep.FILLERS)
       + """ AS f FROM documents)
SELECT doc_id, round(0.35 * CASE WHEN n = 0 THEN 0 ELSE least(1.0, 0.2 + k / n * 5.3) END + 0.3 * CASE WHEN source = '' THEN 0.5 WHEN """ + " OR ".join(f"contains(lower(source), '{s}')" for s in upkeep.HIGH_SECTIONS)
       + " THEN 1.0 WHEN " + " OR ".join(f"contains(lower(source), '{s}')" for s in upkeep.LOW_SECTIONS) + """ THEN 0.1 ELSE 0.5 END
+ 0.2 * CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0.0, 1.0 - f / length(text) * 2) END + 0.15 * CASE WHEN l < 50 THEN 0.1 WHEN l < 150 THEN 0.4 WHEN l < 300 THEN 0.7 ELSE 1.0 END, 4)::DOUBLE AS score FROM d""")
def _relevance(read):
    return read("documents").select("doc_id", upkeep.chunk_relevance(F.col("text"), F.col("source"), "sales").alias("score"))


@query("section_relevance", """SELECT doc_id, round(CASE WHEN contains(lower(source), 'web') THEN 2.0 ELSE 0 END - CASE WHEN regexp_matches(source, 'crawl|dump', 'i') THEN 1.0 ELSE 0 END
+ CASE WHEN contains(lower(source), 'the') OR contains(lower(substring(text, 1, 2000)), 'the') THEN 0.8 ELSE 0 END + CASE WHEN contains(lower(source), 'src') THEN 0.5 ELSE 0 END - CASE WHEN n_chars > 10240 THEN 0.3 ELSE 0 END, 4)::DOUBLE AS score FROM documents""")
def _section_relevance(read):
    score = upkeep.section_relevance(F.col("source"), F.col("text"), F.col("n_chars"), ("Web",), ("crawl", "dump"), {"d": (0.8, ("the",))}, ("src", "a"))
    return read("documents").select("doc_id", F.round(score, 4).alias("score"))


@query("epistemic_checks", r"""WITH t AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN 'FATOS ' || text WHEN 2 THEN '## FATOS ' || text ELSE '## FATOS [FONTE:a:1] ' || text END AS t FROM benchmark),
c AS (SELECT item_id, contains(upper(t), 'THE') AS c, contains(t, 'FATOS') AS m, contains(t, '## FATOS') AS s, len(regexp_extract_all(t, '\[FONTE:[^\]]+\]'))::INTEGER AS n FROM t)
SELECT item_id, c AS is_critical, m AS has_markers, n AS sources, NOT (c AND NOT m) AND NOT (m AND s AND n = 0) AS valid FROM c""")
def _epistemic(read):
    head = F.element_at(F.array(F.lit(""), F.lit("FATOS "), F.lit("## FATOS "), F.lit("## FATOS [FONTE:a:1] ")), (F.col("item_id") % 4 + 1).cast("int"))
    c = upkeep.epistemic_check(F.concat(head, "text"), ("THE",))
    return read("benchmark").select("item_id", c.alias("c")).select("item_id", "c.is_critical", "c.has_markers", "c.sources", "c.valid")


@query("clock_texts", "WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 1000003 ELSE event_id % 86000 END AS v FROM events), s AS (SELECT event_id, CASE WHEN v > 86400 THEN v / 1000 ELSE v::DOUBLE END AS s FROM t) SELECT event_id, printf('%02d:%02d:%02d', floor(s / 3600)::BIGINT, floor((s % 3600) / 60)::BIGINT, floor(s % 60)::BIGINT) AS t FROM s")
def _clock_texts(read):
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 1000003).otherwise(F.col("event_id") % 86000)
    return read("events").select("event_id", upkeep.clock_text(v).alias("t"))


@query("ages_in_seconds", "SELECT event_id, epoch_us(TIMESTAMP '2024-12-31 00:00:00') / 1e6 - epoch_us(date_trunc('second', ts)) / 1e6 AS age FROM events")
def _ages(read):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return read("events").select("event_id", upkeep.age_seconds(iso, F.lit("2024-12-31 00:00:00").cast("timestamp")).alias("age"))


@query("settings_cascade", "SELECT p_type AS key, arg_max(p_name, p_size * 1000000 + p_partkey) AS value, max(p_size * 1000000 + p_partkey)::BIGINT AS level FROM part GROUP BY p_type")
def _settings(read):
    return upkeep.merged_settings(read("part").select(F.col("p_type").alias("key"), F.col("p_name").alias("value"), (F.col("p_size") * 1000000 + F.col("p_partkey")).cast("long").alias("level")))


@query("theme_relevance", "WITH t AS (SELECT user_id, count(*) AS o, count(DISTINCT event_type) AS s, count(DISTINCT day(ts)) AS r, count(DISTINCT month(ts)) AS d FROM events GROUP BY user_id) SELECT user_id, round(o + (s - 1) * 3.0 + r * 2.0 + (d - 1) * 2.0, 2)::DOUBLE AS score FROM t")
def _theme(read):
    t = read("events").groupBy("user_id").agg(F.count("*").alias("o"), F.count_distinct("event_type").alias("s"), F.count_distinct(F.dayofmonth("ts")).alias("r"), F.count_distinct(F.month("ts")).alias("d"))
    return t.select("user_id", upkeep.theme_relevance(*(F.col(c) for c in "osrd")).alias("score"))


@query("viability_scores", "WITH s AS (SELECT s_suppkey AS id, round((s_suppkey % 11 + (s_suppkey * 3) % 11 * 0.9 + (s_suppkey * 5) % 11 * 0.8 + (s_suppkey * 7) % 11 * 0.9 + s_nationkey % 11 * 0.8) / 4.4, 2)::DOUBLE AS score FROM supplier) SELECT id, score, CASE WHEN score >= 7 THEN 'GO' WHEN score >= 5 THEN 'CONDITIONAL' ELSE 'NO-GO' END AS decision FROM s")
def _viability(read):
    k = F.col("s_suppkey")
    v = upkeep.viability((k % 11, k * 3 % 11, k * 5 % 11, k * 7 % 11, F.col("s_nationkey") % 11))
    return read("supplier").select(k.alias("id"), v.alias("v")).select("id", "v.score", "v.decision")


@query("plan_costs", "WITH p(model, p_in, p_out) AS (VALUES ('R', 4.0, 9.0), ('A', 2.0, 2.0)) SELECT l_orderkey AS plan, count(*) AS nodes, round(sum(coalesce((l_quantity * 0.6 * p_in + l_quantity * 0.4 * p_out) / 1000, 0)), 2)::DOUBLE AS cost FROM lineitem LEFT JOIN p ON model = l_returnflag GROUP BY l_orderkey")
def _plan_costs(read):
    lines = read("lineitem")
    prices = lines.sparkSession.createDataFrame([("R", 4.0, 9.0), ("A", 2.0, 2.0)], "model string, p_in double, p_out double")
    return upkeep.plan_cost(lines.select(F.col("l_orderkey").alias("plan"), F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("double").alias("tokens")), prices)


@query("group_layers", "WITH m AS (SELECT p_brand AS g, p_partkey AS id, p_size AS level FROM part), f AS (SELECT g, arg_min(level, id) AS first FROM m GROUP BY g) SELECT g AS \"group\", count(*) AS odd FROM m JOIN f USING (g) WHERE level <> first GROUP BY g")
def _group_layers(read):
    p = read("part")
    return upkeep.group_layers(p.select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("id")), p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("level")))


@query("compacted_chunks", "WITH c AS (SELECT conv_id, turn, length(text) AS n, least(length(text), 60) AS s FROM conversations), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total, coalesce(sum(n - s) OVER (PARTITION BY conv_id ORDER BY n, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM c) SELECT conv_id, count(*) FILTER (n > s AND total - saved > 500) AS cut FROM r GROUP BY conv_id")
def _compacted(read):
    c = read("conversations").select("conv_id", "turn", F.length("text").alias("n"), F.least(F.length("text"), F.lit(60)).alias("s"))
    return upkeep.compacted(c, "conv_id", [F.col("n"), F.col("turn")], "n", "s", 500).groupBy("conv_id").agg(F.count_if("is_cut").alias("cut"))


@query("cross_source_conflicts", "WITH e AS (SELECT lang AS domain, source AS expert, p.i AS pair, count(*) FILTER (contains(upper(text), p.x)) AS nx, count(*) FILTER (contains(upper(text), p.y)) AS ny FROM documents, (VALUES (0, 'THE', 'DER'), (1, 'QUE', 'ET')) p(i, x, y) GROUP BY ALL) SELECT a.domain, a.pair, a.expert AS a, b.expert AS b, a.nx AS n_a, b.ny AS n_b FROM e a JOIN e b USING (domain, pair) WHERE a.nx > 0 AND b.ny > 0 AND a.expert <> b.expert", ints=("pair",))
def _cross(read):
    return upkeep.cross_source_conflicts(read("documents"), (("THE", "DER"), ("QUE", "ET")), "lang", "source").withColumnRenamed("lang", "domain")


@query("replay_timeline", "WITH l AS (SELECT user_id, ts, event_id, 0 AS log FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, ts, event_id, 1 FROM events WHERE event_id % 2 = 1) SELECT user_id, count(*) AS n, max(log) AS logs, min(ts) AS first FROM l GROUP BY user_id", ints=("logs",))
def _replay(read):
    e = read("events").select("user_id", "ts", "event_id")
    both = upkeep.replay(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), key="user_id", ts="ts")
    return both.groupBy("user_id").agg(F.max("at").cast("long").alias("n"), F.max("log").alias("logs"), F.min(F.when(F.col("at") == 1, F.col("ts"))).alias("first"))


@query("candidates_preselected", "WITH s AS (SELECT p_partkey AS key, p_partkey IN (3, 5) AS pinned, contains(w, 'blue')::INT + contains(w, 'small')::INT + contains(w, 'steel')::INT AS score FROM (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS w FROM part)) SELECT key, pinned, score FROM s WHERE pinned OR score > 0 ORDER BY pinned DESC, score DESC, key LIMIT 24", ints=("score",))
def _preselected(read):
    index = read("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("squad"), F.col("p_type").alias("path"))
    return upkeep.preselected(index, ("blue", "small", "steel", "of"), (3, 5)).select("key", "pinned", "score")


@query("grounding_pack", "SELECT conv_id AS query_id, place, substring(text, 1, 1200) AS excerpt FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE trim(text) <> '') WHERE place <= 8", ints=("place",))
def _pack(read):
    return upkeep.grounding_pack(read("conversations").select(F.col("conv_id").alias("query_id"), "turn", "text"), rank="turn")


@query("canonical_hashes", r"SELECT page_id, sha256(replace(regexp_replace(regexp_replace(html, '^\x{FEFF}', ''), '\r\n', chr(10), 'g'), chr(13), chr(10))) AS h FROM pages")
def _canonical(read):
    return read("pages").select("page_id", T.canonical_hash(F.col("html")).alias("h"))


@query("hamming_distances", "SELECT event_id, bit_count(xor(event_id, user_id)) AS d FROM events", ints=("d",))
def _hamming(read):
    return read("events").select("event_id", T.hamming(F.col("event_id").cast("long"), F.col("user_id").cast("long")).alias("d"))


@query("array_jaccard", "WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-zà-ɏ]{2,}')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 6)::DOUBLE AS j FROM p")
def _jaccard(read):
    w = read("conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("x"))
    return w.join(w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("j"))


@query("distinct_trigrams", "WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-zà-ɏ]{2,}') AS w FROM conversations) SELECT conv_id, turn, len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS n FROM w", ints=("n",))
def _ngrams(read):
    return read("conversations").select("conv_id", "turn", F.size(T.ngrams(T.tokens(F.col("text")), 3)).alias("n"))


@query("gauges", "SELECT s_suppkey AS id, repeat('#', (s_suppkey % 6)::INT) || repeat('.', (5 - s_suppkey % 6)::INT) AS gauge FROM supplier")
def _gauges(read):
    return read("supplier").select(F.col("s_suppkey").alias("id"), T.gauge((F.col("s_suppkey") % 6).cast("int")).alias("gauge"))


@query("amounts", "SELECT o_orderkey AS id, round(round(o_totalprice, 2) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END, 1)::DOUBLE AS amount FROM orders")
def _amounts(read):
    said = F.concat(F.lit("$ "), F.format_number(F.round("o_totalprice", 2), 2), F.element_at(F.array(F.lit(""), F.lit("k"), F.lit("M")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return read("orders").select(F.col("o_orderkey").alias("id"), F.round(T.amount(said), 1).alias("amount"))


@query("video_ids", "SELECT page_id, substring(md5(html), 1, 11) AS video FROM pages")
def _videos(read):
    url = F.concat(F.lit("see https://youtu.be/"), F.substring(F.md5("html"), 1, 11), F.lit("?t=3"))
    return read("pages").select("page_id", T.youtube_id(url).alias("video"))


@query("parsed_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4)::DOUBLE AS total FROM embeddings")
def _vectors(read):
    raw = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ","), F.lit("]"))
    return read("embeddings").select("vec_id", F.round(F.aggregate(T.parse_vector(raw), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("staging_paths", "SELECT p_partkey AS id, p_partkey % 5 IN (0, 1) AS staging FROM part")
def _staging(read):
    path = F.concat(F.lit("in/"), F.element_at(F.array(F.lit("_Unclassified"), F.lit("misc"), F.lit("misc2"), F.lit("a"), F.lit("my-misc")), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("/x.md"))
    return read("part").select(F.col("p_partkey").alias("id"), rules.staging_path(path).alias("staging"))


@query("priority_floor", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('5-LOW')")
def _priority(read):
    p = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "5-LOW", "Low")
    return read("orders").where(rules.priority_at_least(p, "MEDIUM")).select("o_orderkey")


@query("matching_communities", "WITH t AS (SELECT p_type AS community, count(*)::DOUBLE AS weight, list_distinct(regexp_extract_all(lower(p_type), '[a-zà-ɏ]{2,}')) AS w FROM part GROUP BY p_type) SELECT community, round(weight * len(list_intersect(w, ['small', 'plated', 'steel', 'brushed'])) / 4, 6)::DOUBLE AS score FROM t WHERE len(list_intersect(w, ['small', 'plated', 'steel', 'brushed'])) > 0")
def _communities(read):
    c = read("part").groupBy(F.col("p_type").alias("community")).agg(F.count("*").cast("double").alias("weight"))
    return knowledge.matching_communities(c, "small plated steel brushed").select("community", F.round("score", 6).alias("score"))


@query("role_statuses", "WITH t AS (SELECT user_id, count(*) AS m, count(DISTINCT event_type) AS s FROM events GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 9 = 0 OR m >= 10 AND s >= 2 THEN 'active' WHEN m >= 5 THEN 'tracking' ELSE 'emergent' END AS status FROM t")
def _statuses(read):
    t = read("events").groupBy("user_id").agg(F.count("*").alias("m"), F.count_distinct("event_type").alias("s"))
    return t.select("user_id", entity.role_status(F.col("m"), F.col("s"), F.when(F.col("user_id") % 9 == 0, "active").otherwise("emergent")).alias("status"))


@query("conflict_types", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'complementary' WHEN doc_id % 5 <= 2 THEN 'divergent' ELSE 'contradictory' END AS kind FROM documents")
def _conflict_types(read):
    return read("documents").select("doc_id", rules.conflict_type(F.col("doc_id") % 5).alias("kind"))


@query("mention_kinds", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'the') THEN 'active' WHEN regexp_matches(lower(text), 'der|que') THEN 'passive' ELSE 'ambiguous' END AS kind FROM documents")
def _mentions(read):
    return read("documents").select("doc_id", rules.mention_kind(F.col("text"), ("the",), ("der", "que")).alias("kind"))


@query("stale_buckets", "WITH f AS (SELECT user_id % 50 AS bucket, max(ts) AS newest FROM events GROUP BY 1), i AS (SELECT user_id % 50 AS bucket, min(ts) AS oldest FROM events WHERE event_type = 'purchase' AND user_id % 50 < 40 GROUP BY 1) SELECT bucket, oldest IS NULL OR newest > oldest AS stale FROM f LEFT JOIN i USING (bucket)")
def _stale(read):
    e = read("events").select((F.col("user_id") % 50).alias("bucket"), F.col("ts").alias("modified"), "event_type")
    return knowledge.stale(e.where("event_type = 'purchase' AND bucket < 40"), e)


@query("typed_edges", "SELECT conv_id AS source, role AS target, 'says' AS rel, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT conv_id, role FROM conversations) WHERE role IS NOT NULL UNION ALL SELECT DISTINCT conv_id, turn::VARCHAR, 'at', 1.0 FROM conversations")
def _typed_edges(read):
    c = read("conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.collect_set(F.col("turn").cast("string")).alias("turns"))
    return knowledge.edges_from_lists(c, "conv_id", says="roles", at="turns")


@query("section_chunk_ids", "WITH s AS (SELECT DISTINCT l_linestatus AS file, l_returnflag AS section FROM lineitem), c AS (SELECT l_linestatus AS file, l_returnflag AS section, list_sort(list(DISTINCT l_linenumber::VARCHAR)) AS ids FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'R' GROUP BY ALL) SELECT s.file, s.section, coalesce(ids, []) AS chunk_ids FROM s LEFT JOIN c USING (file, section)")
def _section_chunks(read):
    rows = read("lineitem").select(F.col("l_linestatus").alias("file"), F.col("l_returnflag").alias("section"), F.col("l_linenumber").cast("string").alias("chunk_id"), "l_quantity")
    held = rows.where("l_quantity > 45 AND section <> 'R'").select(F.concat("file", F.lit(" 2")).alias("file"), F.lower("section").alias("section"), "chunk_id")
    return knowledge.section_chunks(rows.select("file", "section").distinct(), held)


@query("selected_agents", "WITH d AS (SELECT p_brand AS domain, avg(p_size) / 50 AS score FROM part GROUP BY p_brand), s AS (SELECT p_type AS agent, CASE WHEN p_partkey % 2 = 0 THEN 0.6 ELSE 0.3 END * score AS s FROM part JOIN d ON domain = p_brand UNION ALL SELECT DISTINCT p_type, 1.0 FROM part WHERE p_partkey = 7) SELECT agent, round(max(s), 6)::DOUBLE AS score FROM s GROUP BY agent ORDER BY score DESC, agent LIMIT 5")
def _agents(read):
    p = read("part")
    scored = p.groupBy(F.col("p_brand").alias("domain")).agg((F.avg("p_size") / 50).alias("score"))
    duties = p.select(F.col("p_brand").alias("domain"), F.col("p_type").alias("agent"), F.when(F.col("p_partkey") % 2 == 0, "primary").otherwise("secondary").alias("level"))
    return knowledge.select_agents(scored, duties, p.where("p_partkey = 7").select(F.col("p_type").alias("agent")))


@query("agents_of_insights", "SELECT p_partkey AS id, list_sort(list_distinct(['m' || (p_size % 3), 'x'] || CASE WHEN p_size % 2 = 0 THEN ['f' || (p_size % 4)] ELSE [] END)) AS agents FROM part")
def _agents_of(read):
    p = read("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("theme"), F.col("p_size").alias("framework"))
    sizes = p.select("theme").distinct()
    by_theme = sizes.select("theme", F.array(F.concat(F.lit("m"), (F.col("theme") % 3).cast("string")), F.lit("x")).alias("agents"))
    by_framework = sizes.where("theme % 2 = 0").select(F.col("theme").alias("framework"), F.array(F.concat(F.lit("f"), (F.col("theme") % 4).cast("string"))).alias("agents"))
    return knowledge.agents_of(p, by_theme, by_framework)


@query("live_persons", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey < 20")
def _live(read):
    nodes = read("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, "person").otherwise("firm").alias("type"))
    edges = read("orders").select(F.col("o_custkey").alias("source"), F.col("o_custkey").alias("target"))
    return knowledge.live_nodes(nodes, edges, nodes.where("id < 20")).select("id")


@query("call_participants", "SELECT conv_id AS call, '2024-03-0' || (conv_id % 9 + 1) AS day, ['ana', 'u' || conv_id % 7] AS participants FROM (SELECT DISTINCT conv_id FROM conversations)")
def _calls(read):
    c = read("conversations").select("conv_id").distinct()
    text = F.concat(F.lit("Call\nDate: 2024-03-0"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("\nParticipants: Ana@x.org, u"), (F.col("conv_id") % 7).cast("string"), F.lit("@y.org, rec@bot.io, nobody\nend"))
    return knowledge.call_participants(c.select(F.col("conv_id").alias("call"), text.alias("text")))


@query("merged_queue", "SELECT p_brand AS dedup_key, 'old' AS side FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 10) UNION ALL SELECT DISTINCT p_brand, 'new' FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 10)")
def _queue(read):
    p = read("part").select(F.col("p_brand").alias("dedup_key"), "p_size")
    old = p.where("p_size < 10").select("dedup_key").distinct().withColumn("side", F.lit("old"))
    return knowledge.merge_queue(old, p.select("dedup_key").withColumn("side", F.lit("new")))


@query("layered_entities", "WITH e AS (SELECT p_partkey AS id, p_brand AS layer, p_size::DOUBLE AS weight, 'D' || (p_size % 3) AS domain FROM part), own AS (SELECT id, weight AS score FROM e WHERE lower(domain) = 'd1'), b AS (SELECT id, max(score) AS score FROM (SELECT * FROM own UNION ALL SELECT id + 1, score * 0.7 FROM own) GROUP BY id), r AS (SELECT b.id, layer, score, row_number() OVER (PARTITION BY layer ORDER BY score DESC, b.id) AS rank FROM b JOIN e USING (id)) SELECT id, layer, round(score, 6)::DOUBLE AS score, rank FROM r WHERE rank <= 10", ints=("rank",))
def _layered(read):
    e = read("part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("layer"), F.col("p_size").cast("double").alias("weight"), F.array(F.concat(F.lit("D"), (F.col("p_size") % 3).cast("string"))).alias("domains"))
    edges = e.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return knowledge.layered(e, edges, "d1").select("id", "layer", F.round("score", 6).alias("score"), "rank")


@query("suite_summary", "WITH c AS (SELECT conv_id, count(*) AS n, 3 AS least_n, avg((turn % 2)::DOUBLE) AS p, avg((length(text) > 50)::INT) AS h FROM conversations GROUP BY conv_id), s AS (SELECT *, least(1.0, n / least_n) AS e FROM c) SELECT count(*) AS cases, round(avg((e >= 1 AND p >= 0.5)::INT), 4)::DOUBLE AS pass_rate, round(avg(p), 4)::DOUBLE AS precision, round(avg(h), 4)::DOUBLE AS hit_rate, round(avg(e), 4)::DOUBLE AS sufficiency FROM s")
def _suite(read):
    c = read("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.lit(3).alias("least_n"), F.avg(F.col("turn") % 2).alias("precision"), F.avg((F.length("text") > 50).cast("int")).alias("hit_rate"))
    return knowledge.suite(c)


@query("checkable_claims", r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 20 AND NOT s LIKE '%?')) AS n FROM documents", ints=("n",))
def _claims(read):
    return read("documents").select("doc_id", F.size(evals.claims(F.col("text"))).alias("n"))


@query("gate_breaches", "WITH m AS (SELECT avg((l_quantity > 25)::INT) AS recall, avg(l_discount) AS ndcg FROM lineitem) SELECT 'ndcg' AS metric, round(ndcg, 6)::DOUBLE AS value, 0.5::DOUBLE AS floor FROM m WHERE ndcg < 0.5 UNION ALL SELECT 'recall', round(recall, 6), 0.3 FROM m WHERE recall < 0.3")
def _breaches(read):
    m = read("lineitem").select((F.col("l_quantity") > 25).cast("int").alias("recall"), F.col("l_discount").cast("double").alias("ndcg"))
    return evals.breaches(m, {"recall": 0.3, "ndcg": 0.5}).select("metric", F.round("value", 6).alias("value"), "floor")


@query("verdict_gate", "SELECT item_id, CASE WHEN item_id % 10 / 10 >= 0.6 THEN 'pass' WHEN item_id % 7 / 7 >= 0.6 THEN 'pass_external' ELSE 'blocked' END AS verdict FROM benchmark")
def _gate(read):
    a = read("benchmark").select("item_id", (F.col("item_id") % 10 / 10).alias("faithfulness"))
    return extraction.gate(a, F.col("item_id") % 7 / 7).select("item_id", "verdict")


@query("unique_sorted", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY o_custkey")
def _unique(read):
    return read("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))


@query("backlinks_of_node", "SELECT 'supplier:' || s_suppkey AS source FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_nationkey = 3")
def _backlinks(read):
    _, edges = graph.star_schema_graph(read("region"), read("nation"), read("supplier"), read("customer"))
    return graph.backlinks(edges, "nation:3").select("source")


@query("keep_first_by_key", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def _keep_first(read):
    return dedup.keep_first(read("orders"), F.col("o_custkey"), "o_orderkey").select("o_orderkey")


@query("filtered_by_equality", "SELECT doc_id FROM documents WHERE lang = 'en'")
def _filtered(read):
    return retrieval.filtered(read("documents"), lang="en").select("doc_id")


@query("step_turns", "WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) FILTER (p IS NULL OR p <> event_type) AS turns FROM s GROUP BY user_id")
def _step_turns(read):
    found = windows.step_groups(read("events"), "user_id", "event_id", "event_type")
    new = [c for c in found.columns if c not in read("events").columns][0]
    return found.groupBy("user_id").agg(F.count_distinct(new).alias("turns"))


@query("review_verdicts", r"""WITH s AS (SELECT doc_id, n_chars, lang, text, (n_chars % 21)::BIGINT AS a, (n_chars % 13)::BIGINT AS b FROM documents)
SELECT doc_id, 'document ' || doc_id AS evaluated, 2 * (a + b) AS total, CASE WHEN 2 * (a + b) >= 70 THEN 'APROVAR' WHEN 2 * (a + b) >= 50 THEN 'REVISAR' ELSE 'REJEITAR' END AS verdict, coalesce(lang, 'none') AS gap FROM s""")
def _review_verdicts(read):
    a, b = (F.col("n_chars") % 21).cast("string"), (F.col("n_chars") % 13).cast("string")
    parts = ("Input Evaluated: document ", F.col("doc_id").cast("string"), "\n[PREMISE AUDIT]\n", a, "/20\n[EVIDENCE CHAIN] see [AB-001]\nScore: ", b, "\n[LOGIC GAPS]\n", a, "/20 fine\n[VERDICT + SCORE]\n", b, "/20\nGaps found:\n 1. ", F.coalesce("lang", F.lit("none")), "\n\nend\n2. not one")
    docs = read("documents").select("doc_id", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))
    return reviews.verdicts(docs, "doc_id").select("doc_id", "evaluated", "total", "verdict", F.concat_ws("|", "gaps").alias("gap"))
