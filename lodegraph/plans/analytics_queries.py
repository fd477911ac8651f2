"""Queries of aggregations, windows, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import analytics, dedup, evals, windows
from lodegraph.plans.catalogue import query
from lodegraph.plans.retrieval_queries import TOK, bucket

#: Insights: documents' languages as tags, sources as experts, label quality as confidence.
INSIGHTS = "i AS (SELECT lang AS tag, source AS expert, CASE WHEN quality = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM documents JOIN labels USING (doc_id))"


def insights(read):
    return read("documents").join(read("labels"), "doc_id").select(F.col("lang").alias("tag"), F.col("source").alias("expert"), F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"))


@query("consensus_tags", f"WITH {INSIGHTS} SELECT tag, count(DISTINCT expert) AS n_experts, round(avg(confidence), 4) AS avg_confidence, count(*) AS n FROM i WHERE confidence >= 0.8 GROUP BY tag HAVING count(DISTINCT expert) >= 2")
def _consensus(read):
    return analytics.consensus(insights(read)).withColumn("avg_confidence", F.round("avg_confidence", 4))


@query("tag_patterns", f"WITH {INSIGHTS} SELECT tag, count(*) AS n, round(avg(confidence), 4) AS avg_confidence FROM i GROUP BY tag HAVING count(*) >= 4 ORDER BY n DESC, tag LIMIT 20")
def _patterns(read):
    return analytics.patterns(insights(read))


@query("incremental_merge", f"""WITH {INSIGHTS}, a AS (SELECT tag, count(*) AS n, round(avg(confidence), 4) AS c FROM i WHERE expert < 'src2' GROUP BY tag UNION ALL SELECT tag, count(*), round(avg(confidence), 4) FROM i WHERE expert >= 'src2' GROUP BY tag)
SELECT tag, sum(n)::BIGINT AS n, round(sum(n * c) / sum(n), 4) AS avg_confidence FROM a GROUP BY tag""")
def _merge(read):
    part = lambda rows: rows.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    i = insights(read)
    return analytics.merge_patterns(part(i.where("expert < 'src2'")), part(i.where("expert >= 'src2'")))


@query("attribution_pct", "SELECT coalesce(source, 'unknown') AS expert, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 0)::DOUBLE AS percentage FROM documents GROUP BY 1")
def _attribution(read):
    return analytics.attribution(read("documents"), "source")


COST = "l_extendedprice * (1 - l_discount)"


@query("cost_grouping_sets", f"SELECT l_returnflag AS step, l_linestatus AS model, count(*) AS calls, sum(l_quantity)::DOUBLE AS tokens, round(sum({COST}), 2)::DOUBLE AS cost FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def _cube(read):
    return analytics.cost_cube(read("lineitem"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("double"), F.expr(COST))


@query("step_cost", f"SELECT l_returnflag AS step, sum(l_quantity)::DOUBLE AS tokens, round(sum({COST}), 2)::DOUBLE AS cost, round(avg(l_tax), 4)::DOUBLE AS mean_latency, count(*) AS calls FROM lineitem GROUP BY 1")
def _step(read):
    return read("lineitem").groupBy(F.col("l_returnflag").alias("step")).agg(F.sum(F.col("l_quantity").cast("double")).alias("tokens"), F.round(F.sum(F.expr(COST)), 2).alias("cost"), F.round(F.avg("l_tax"), 4).alias("mean_latency"), F.count("*").alias("calls"))


@query("budget_check", f"WITH s AS (SELECT l_returnflag AS step, sum({COST}) AS c FROM lineitem GROUP BY 1) SELECT round(sum(c), 2)::DOUBLE AS spent, round(1e9 - round(sum(c), 2), 2)::DOUBLE AS remaining, round(100 * round(sum(c), 2) / 1e9, 2)::DOUBLE AS utilisation, arg_max(step, c) AS top_step FROM s")
def _budget(read):
    return analytics.budget(read("lineitem"), "l_returnflag", F.expr(COST), 1e9)


@query("event_phase_totals", "SELECT event_type AS phase, count(*) AS n, count(DISTINCT user_id) AS keys, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def _phases(read):
    return analytics.phase_totals(read("events"), "user_id", "event_type")


@query("event_pivot", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def _pivot(read):
    days = read("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return days.groupBy("day").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("anomaly_last5", """WITH b AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT *, avg(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS usual FROM b)
SELECT user_id, day, n, round(CASE WHEN usual <> 0 THEN (n - usual) / usual * 100 END, 4) AS deviation, coalesce(abs(CASE WHEN usual <> 0 THEN (n - usual) / usual * 100 END) > 50, false) AS anomaly FROM u""")
def _anomaly(read):
    b = read("events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    out = analytics.last_n_deviation(b, "user_id", "day", "n")
    return out.select("user_id", "day", "n", F.round("deviation", 4).alias("deviation"), "anomaly")


@query("batch_seq", "SELECT event_id, 'BATCH-' || strftime(ts, '%Y%m%d') || '-' || lpad(row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id)::VARCHAR, 3, '0') AS batch_id FROM events WHERE event_type = 'signup'")
def _sequence(read):
    return windows.sequence_ids(read("events").where("event_type = 'signup'"), "ts", "event_id").select("event_id", "batch_id")


TURNS = """t AS (SELECT *, CASE WHEN role = 'user' AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> 'user', true) THEN 1 ELSE 0 END AS b FROM conversations),
g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM t)"""


@query("turn_groups", f"WITH {TURNS} SELECT conv_id, turn, turn_id FROM g")
def _turns(read):
    return windows.turn_groups(read("conversations")).select("conv_id", "turn", "turn_id")


@query("turn_compaction", f"""WITH {TURNS}, s AS (SELECT conv_id, turn_id, sum(tokens)::BIGINT AS tokens FROM g GROUP BY ALL),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn_id DESC)::BIGINT AS suffix_tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id DESC) AS from_end FROM s)
SELECT conv_id, turn_id, tokens, suffix_tokens FROM w WHERE suffix_tokens <= 120 OR from_end <= 2""")
def _compact(read):
    grouped = windows.turn_groups(read("conversations")).withColumn("tokens", T.token_estimate(F.col("text")))
    per = grouped.groupBy("conv_id", "turn_id").agg(F.sum("tokens").alias("tokens"))
    return windows.compact_turns(per, "conv_id", "turn_id", "tokens", 120).select("conv_id", "turn_id", "tokens", "suffix_tokens")


@query("run_segmentation", """WITH l AS (SELECT *, lag(event_type) OVER w AS prev, epoch(ts)::BIGINT - epoch(lag(ts) OVER w)::BIGINT AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
f AS (SELECT *, CASE WHEN coalesce(prev = 'purchase' OR gap > 86400, false) THEN 1 ELSE 0 END AS s FROM l)
SELECT user_id, run, count(*) AS n FROM (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_type)::BIGINT AS run FROM f) GROUP BY ALL""")
def _runs(read):
    return windows.run_segments(read("events"), "user_id", "ts", "event_type", "purchase", 86_400).groupBy("user_id", "run").agg(F.count("*").alias("n"))


@query("history_cap", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def _cap(read):
    return windows.newest(read("events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 20).select("user_id", "event_id")


@query("prune_oldest", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _prune(read):
    return windows.newest(read("events"), None, [F.col("ts").desc(), F.col("event_id").desc()], 100).select("event_id")


@query("first_last_seen", "SELECT user_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT event_type) AS n_sources FROM events GROUP BY user_id")
def _seen(read):
    return windows.seen(read("events"), "user_id", "ts", "event_type")


@query("batch_partitioning", "SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5)::BIGINT AS slice FROM documents")
def _slices(read):
    return windows.batches_of(read("documents"), "source", "doc_id", 5).select("doc_id", "source", "slice")


@query("priority_fifo", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS place FROM events QUALIFY place <= 3", ints=("place",))
def _fifo(read):
    return windows.newest(read("events"), "user_id", [F.col("value").desc_nulls_last(), F.col("ts"), F.col("event_id")], 3).selectExpr("event_id", "row_number() over (partition by user_id order by value desc nulls last, ts, event_id) as place")


@query("pairwise_convergence", f"""WITH s AS (SELECT conv_id, role, list_distinct(flatten(list({TOK.format('text')}))) AS s FROM conversations GROUP BY ALL),
p AS (SELECT a.conv_id, CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END AS j FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.role < b.role)
SELECT conv_id, round(coalesce(avg(j), 1.0), 4) AS convergence FROM (SELECT DISTINCT conv_id FROM s) LEFT JOIN p USING (conv_id) GROUP BY conv_id""")
def _convergence(read):
    return analytics.convergence(read("conversations"), "conv_id", "role")


@query("dominance_index", "WITH s AS (SELECT conv_id, role, sum(length(text)) AS s FROM conversations GROUP BY ALL) SELECT conv_id, round(CASE WHEN count(*) < 2 OR avg(s) = 0 THEN 0 ELSE greatest(0, least(1, (max(s) / avg(s) - 1) / (count(*) - 1))) END, 4) AS dominance FROM s GROUP BY conv_id")
def _dominance(read):
    return analytics.dominance(read("conversations"), "conv_id", "role", F.length("text"))


@query("output_diversity", f"WITH w AS (SELECT role AS agent, unnest({TOK.format('text')}) AS t FROM conversations) SELECT agent, count(*) AS n_tokens, count(DISTINCT t) AS n_distinct, round(count(DISTINCT t) / count(*), 4) AS diversity FROM w GROUP BY agent")
def _diversity(read):
    return analytics.diversity(read("conversations"), "role")


@query("grounding_ratio", r"""WITH o AS (SELECT a.role AS agent, a.text, b.text AS context FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1),
c AS (SELECT agent, context, trim(unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS claim FROM o),
k AS (SELECT agent, list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-zà-ɏ]{2,}'), lambda t: length(t) >= 4)) AS k, regexp_extract_all(lower(context), '[a-zà-ɏ]{2,}') AS x FROM c WHERE length(claim) >= 20 AND right(claim, 1) <> '?')
SELECT agent, count(*) AS n_claims, round(avg(CASE WHEN len(k) = 0 OR len(list_intersect(k, x)) / len(k) >= 0.5 THEN 1 ELSE 0 END), 4) AS ratio FROM k GROUP BY ROLLUP (agent)""")
def _grounding(read):
    c = read("conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return evals.grounded_ratio(c.join(before, ["conv_id", "turn"]), "role", "text", "context")


@query("benchmark_compare", """WITH n AS (SELECT event_type AS k, avg(value) AS now FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1), w AS (SELECT event_type AS k, avg(value) AS was FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT coalesce(n.k, w.k) AS event_type, round(CASE WHEN was <> 0 THEN (now - was) / was * 100 END, 2) AS change, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN (now - was) / was * 100 > 5 THEN 'slower' WHEN (now - was) / was * 100 < -5 THEN 'faster' ELSE 'stable' END AS verdict
FROM n FULL JOIN w ON n.k = w.k""")
def _compare(read):
    e = read("events")
    mean = lambda rows: rows.groupBy("event_type").agg(F.avg("value").alias("v"))
    return analytics.compare_runs(mean(e.where("ts >= timestamp_ntz'2024-01-15'")), mean(e.where("ts < timestamp_ntz'2024-01-15'")), "event_type", "v")


@query("benchmark_summary", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def _summary(read):
    return analytics.summary(read("events"), "event_type", "value")


@query("density_flags", "SELECT source, (CASE WHEN count(*) >= 30 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT lang) >= 4 THEN 1 ELSE 0 END + CASE WHEN sum(n_chars) >= 100000 THEN 1 ELSE 0 END) AS density FROM documents GROUP BY source")
def _density(read):
    per = read("documents").groupBy("source").agg(F.count("*").alias("a"), F.count_distinct("lang").alias("b"), F.sum("n_chars").alias("c"))
    return per.select("source", analytics.density({"a": (F.col("a"), 30), "b": (F.col("b"), 4), "c": (F.col("c"), 100_000)}).alias("density"))


@query("role_score_pivot", "SELECT user_id, round(count(*) FILTER (event_type = 'purchase') * 1.0 + count(*) FILTER (event_type = 'click') * 0.7 + count(*) FILTER (event_type = 'view') * 0.5, 2)::DOUBLE AS weighted_score FROM events GROUP BY user_id")
def _roles(read):
    weights = {"purchase": 1.0, "click": 0.7, "view": 0.5}
    score = sum(F.count_if(F.col("event_type") == k) * w for k, w in weights.items())
    return read("events").groupBy("user_id").agg(F.round(score, 2).alias("weighted_score"))


@query("theme_triage", """WITH t AS (SELECT source, count(*) + 3 * (count(DISTINCT lang) - 1) AS score FROM documents GROUP BY source)
SELECT CASE WHEN score >= 60 THEN 'create' WHEN score >= 45 THEN 'candidate' ELSE 'tracking' END AS decision, count(*) AS n FROM t GROUP BY 1""")
def _triage(read):
    t = read("documents").groupBy("source").agg((F.count("*") + 3 * (F.count_distinct("lang") - 1)).alias("score"))
    return t.groupBy(F.when(F.col("score") >= 60, "create").when(F.col("score") >= 45, "candidate").otherwise("tracking").alias("decision")).agg(F.count("*").alias("n"))


@query("results_by_bucket", "SELECT CASE WHEN substring(source, 4)::INT <= 6 THEN 'external' WHEN substring(source, 4)::INT <= 13 THEN 'business' ELSE 'personal' END AS bucket, lang, count(*) AS n FROM documents GROUP BY ROLLUP (bucket, lang)")
def _rollup(read):
    return read("documents").select(bucket(F.col("source")).alias("bucket"), "lang").rollup("bucket", "lang").agg(F.count("*").alias("n"))


SHA = "substring(sha256(substring(text, 1, 8000)), 1, 16)"
NORM = r"lower(regexp_replace(trim(text), '\s+', ' ', 'g'))"


@query("content_sha_dedup", f"SELECT doc_id, {SHA} AS content_sha FROM documents QUALIFY text = '' OR row_number() OVER (PARTITION BY {SHA} ORDER BY doc_id) = 1")
def _sha(read):
    return dedup.content_sha_dedup(read("documents")).select("doc_id", "content_sha")


@query("text_hash_dup_groups", f"SELECT sha256({NORM}) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def _groups(read):
    return dedup.hash_groups(read("documents"), T.text_hash(F.col("text")))


SIM = rf"""ln AS (SELECT doc_id AS id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
  lambda x: x <> '' AND NOT regexp_matches(x, '^=+\s*$') AND NOT regexp_matches(x, '^\s*(title|date|duration|participants|source|transcript\s*id|meeting\s*transcript)\b', 'i')) AS ls FROM documents),
bt AS (SELECT id, regexp_replace(lower(regexp_replace(array_to_string(ls, ' '), '\[?\bMEET[-_]?\d+\]?', ' ', 'gi')), '\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}:\d{{2}}(?::\d{{2}})?|gmt[-+]?\d{{0,2}}(?::\d{{2}})?', ' ', 'g') AS t FROM ln),
w AS (SELECT id, list_filter(string_split_regex(regexp_replace(t, '[^a-zà-ÿ\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM bt),
sh AS (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) >= 50),
h AS (SELECT id, ('0x' || substring(md5(s), 1, 8))::UBIGINT AS h0, ('0x' || substring(md5(s), 9, 8))::UBIGINT AS h1 FROM sh),
b AS (SELECT id, k, CASE WHEN 2 * sum(CASE WHEN k < 32 THEN (h0 >> (31 - k)) & 1 ELSE (h1 >> (63 - k)) & 1 END) > count(*) THEN 1 ELSE 0 END AS bit FROM h, range(0, 64) r(k) GROUP BY ALL),
sim AS (SELECT id, string_agg(bit, '' ORDER BY k) AS bits FROM b GROUP BY id)"""


@query("simhash_fingerprints", f"WITH {SIM} SELECT id, bits FROM sim")
def _simhash(read):
    prints = dedup.simhash(read("documents"))
    return prints.select("id", F.lpad(F.conv(F.hex("simhash"), 16, 2), 64, "0").alias("bits"))


@query("simhash_near_dup", f"""WITH {SIM}, d AS (SELECT bits, min(id) AS id FROM sim WHERE bits LIKE '%1%' GROUP BY bits)
SELECT a.id AS a, b.id AS b, hamming(a.bits, b.bits) AS distance FROM d a JOIN d b ON a.id < b.id WHERE hamming(a.bits, b.bits) <= 3""", ints=("distance",))
def _near(read):
    return dedup.hamming_pairs(dedup.simhash(read("documents")))


@query("ingest_verdict", rf"""WITH d AS (SELECT doc_id AS key, sha256({NORM}) AS h, len(list_filter(string_split({NORM}, ' '), lambda x: x <> '')) AS words, text FROM documents),
r AS (SELECT key, h, words FROM d WHERE key % 3 = 0), o AS (SELECT h, min(key) AS holder FROM r GROUP BY h),
n AS (SELECT key, CASE WHEN key % 5 = 0 THEN sha256(lower(regexp_replace(trim(text || ' more words'), '\s+', ' ', 'g'))) ELSE h END AS h, CASE WHEN key % 5 = 0 THEN words + 2 ELSE words END AS words FROM d),
j AS (SELECT n.key, n.words, CASE WHEN n.words < 50 THEN 'tiny_body' WHEN r.h = n.h THEN 'unchanged' WHEN o.holder IS NOT NULL THEN 'duplicate_body' WHEN r.h IS NULL THEN 'new' WHEN n.words > r.words THEN 'grown' ELSE 'changed' END AS reason
  FROM n LEFT JOIN r USING (key) LEFT JOIN o ON o.h = n.h)
SELECT key, words::INT AS words, reason, CASE WHEN reason IN ('tiny_body', 'unchanged', 'duplicate_body') THEN 'skip' WHEN reason = 'grown' THEN 'incremental' ELSE 'process' END AS verdict FROM j""")
def _verdict(read):
    d = read("documents").select(F.col("doc_id").alias("key"), "text")
    registry = d.where("key % 3 = 0").select("key", T.text_hash(F.col("text")).alias("body_hash"), F.size(dedup.body_words(F.col("text"))).alias("words"))
    incoming = d.select("key", F.when(F.col("key") % 5 == 0, F.concat("text", F.lit(" more words"))).otherwise(F.col("text")).alias("body"))
    return dedup.ingest_verdict(incoming, registry)


@query("set_ops_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _pending(read):
    return dedup.difference(read("documents").select("doc_id"), read("labels"), "doc_id")


@query("bucket_conflicts", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS values FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def _conflict(read):
    return dedup.conflicts(read("events").where("event_type IN ('signup', 'error')"), "user_id", "event_type")


@query("event_hour_dedup", "SELECT lower(event_type) || '|' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS key, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY 1")
def _hours(read):
    return read("events").groupBy(dedup.hour_key(F.col("event_type"), F.col("ts")).alias("key")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query("ttl_duplicates", "SELECT event_id, coalesce(ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 DAY, false) AS duplicate FROM events WHERE event_type = 'purchase'")
def _ttl(read):
    return dedup.first_within(read("events").where("event_type = 'purchase'"), "user_id", "ts", 3).select("event_id", "duplicate")
