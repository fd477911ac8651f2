"""Queries of knowledge-base joins and roll-ups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import knowledge, matching, transcripts
from lodegraph.plans.catalogue import query
from lodegraph.plans.retrieval_queries import TOK, bucket

BUCKET = "CASE WHEN substring(source, 4)::INT <= 6 THEN 'external' WHEN substring(source, 4)::INT <= 13 THEN 'business' ELSE 'personal' END"


@query("bucket_access", f"SELECT doc_id, {BUCKET} AS bucket FROM documents WHERE {BUCKET} IN ('external', 'personal')")
def _access(read):
    docs = read("documents").select("doc_id", bucket(F.col("source")).alias("bucket"))
    grants = docs.sparkSession.createDataFrame([("a", "external"), ("a", "personal"), ("b", "business")], "agent string, bucket string")
    return knowledge.granted(docs, grants, "a")


@query("changed_files", "SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 3 <> 0 OR (doc_id % 3 = 0 AND doc_id % 2 = 0)")
def _changed(read):
    files = read("documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("sha"), "doc_id")
    registry = files.where("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 2 == 0, F.lit("old")).otherwise(F.col("sha")).alias("sha"))
    return knowledge.changed_files(files, registry).select("path")


@query("uncited_chunks", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _uncited(read):
    return knowledge.uncited(read("documents").select(F.col("doc_id").alias("chunk_id")), read("labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id")))


@query("ground_truth_pairs", "SELECT doc_id AS position, CASE WHEN quality = 1 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM labels WHERE toxic = 0 ORDER BY doc_id LIMIT 200")
def _truth(read):
    rows = read("labels").select(F.lit("q").alias("query"), F.when(F.col("toxic") == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("chunks"), F.when(F.col("quality") == 1, "HIGH").otherwise("MEDIUM").alias("confidence"), F.col("doc_id").alias("position"))
    return knowledge.ground_truth(rows).select("position", "confidence")


@query("propagation_coverage", """SELECT d.doc_id, e.vec_id IS NOT NULL AS vector, l.doc_id IS NOT NULL AS label, round(((e.vec_id IS NOT NULL)::INT + (l.doc_id IS NOT NULL)::INT) / 2, 4) AS share
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _coverage(read):
    return knowledge.coverage(read("documents"), "doc_id", vector=read("embeddings").select(F.col("vec_id").alias("doc_id")), label=read("labels"))


@query("keyword_citations", f"""WITH h AS (SELECT doc_id AS section, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_-]+')) AS w FROM documents),
k(entry, keywords) AS (VALUES ('k1', ['the', 'with', 'from', 'for']), ('k2', ['und', 'der', 'nicht']), ('k3', ['les', 'pour', 'avec', 'dans', 'qui', 'que', 'sur']))
SELECT section, entry, round(least(2 * len(list_intersect(w, keywords)) / len(keywords), 1.0), 6)::DOUBLE AS score FROM h, k WHERE least(2 * len(list_intersect(w, keywords)) / len(keywords), 1.0) >= 0.35""")
def _keywords(read):
    docs = read("documents").select(F.col("doc_id").alias("section"), "text")
    entries = docs.sparkSession.createDataFrame([("k1", ["the", "with", "from", "for"]), ("k2", ["und", "der", "nicht"]), ("k3", ["les", "pour", "avec", "dans", "qui", "que", "sur"])], "entry string, keywords array<string>")
    return knowledge.keyword_citations(docs, entries).select("section", "entry", F.round("score", 6).alias("score"))


@query("run_difference", """WITH a AS (SELECT event_type AS key, count(*)::VARCHAR AS x FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT event_type AS key, count(*)::VARCHAR AS y FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'error' GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, x, y, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE x IS DISTINCT FROM y""")
def _difference(read):
    e = read("events")
    part = lambda rows: rows.groupBy(F.col("event_type").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return knowledge.flat_difference(part(e.where("ts < timestamp_ntz'2024-01-15'")), part(e.where("ts >= timestamp_ntz'2024-01-15' AND event_type <> 'error'")))


@query("flattened_json", "SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY ALL")
def _flat(read):
    return knowledge.flattened(read("events"), "props").groupBy("key", "value").agg(F.count("*").alias("n"))


@query("step_gates", """SELECT event_type AS step, round(100 * avg((value > 50)::INT), 2) AS percent, bool_and(value > 50 OR user_id % 2 = 0) AS gate FROM events GROUP BY 1""")
def _gates(read):
    checks = read("events").select(F.col("event_type").alias("step"), F.col("user_id").cast("string").alias("name"), (F.col("value") > 50).alias("passed"), (F.col("user_id") % 2 != 0).alias("blocking"))
    return knowledge.checks_passed(checks, "step").select("step", "percent", "gate")


@query("vector_dimensions", "SELECT min(len(embedding)) AS least, max(len(embedding)) AS most, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings", ints=("least", "most",))
def _dimensions(read):
    return knowledge.same_dimension(read("embeddings"))


@query("results_by_person", "SELECT CASE WHEN source = 'src0' THEN 'own' ELSE 'other' END AS side, source AS person, count(*) AS n, max(n_chars) AS best FROM documents GROUP BY ALL")
def _people(read):
    return knowledge.by_person(read("documents").select(F.col("source").alias("person"), F.col("n_chars").alias("score")), "src0")


@query("domain_entries", "SELECT lang AS domain, source AS expert, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 0.9 ELSE 0.5 END), 4) AS confidence, max(n_expert) AS expert_entries FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n_expert FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def _domains(read):
    rows = read("documents").join(read("labels"), "doc_id").select(F.col("lang").alias("domain"), F.col("source").alias("expert"), F.when(F.col("quality") == 1, "HIGH").otherwise("LOW").alias("confidence"))
    weights = rows.select("expert").distinct().withColumn("weight", F.lit(1.0))
    out = knowledge.domain_aggregate(rows, weights)
    return out.groupBy("domain", "expert").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"), F.max("expert_entries").alias("expert_entries"))


@query("seed_activation", f"""WITH n AS (SELECT DISTINCT lang AS id, source || ' the ' || lang AS label FROM documents), w AS (SELECT id || label AS id, {TOK.format('label')} AS w FROM n)
SELECT id, round(len(list_intersect(list_distinct(w), ['the', 'de'])) / greatest(len(list_distinct(w)), 1), 6) AS mass FROM w""")
def _seeds(read):
    nodes = read("documents").select(F.concat("lang", "source", F.lit(" the "), "lang").alias("id"), F.concat("source", F.lit(" the "), "lang").alias("label")).distinct()
    return knowledge.seeds(nodes, "the de").select("id", F.round("mass", 6).alias("mass"))


@query("recommendations", """WITH s AS (SELECT p_partkey::VARCHAR AS key, least(100, 10 * (contains(lower(p_name), 'part')::INT + contains(lower(p_name), 'thing')::INT) + 4 * (contains(lower(p_type), 'part')::INT + contains(lower(p_type), 'thing')::INT) + p_size) AS sc,
 contains(lower(p_name), 'part')::INT + contains(lower(p_name), 'thing')::INT + contains(lower(p_type), 'part')::INT + contains(lower(p_type), 'thing')::INT AS h FROM part) SELECT key, CASE WHEN h > 0 THEN sc ELSE 0 END AS score FROM s ORDER BY score DESC, key LIMIT 10""")
def _recommend(read):
    index = read("part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("path"), F.col("p_size").alias("priority"))
    return knowledge.recommended(index, "part thing of", 10).select("key", "score")


@query("citation_share", r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || '- '), chr(10))) AS line FROM documents), s AS (SELECT * FROM l WHERE regexp_matches(line, '^\s*([-*>]|\d+[.)])\s')),
p AS (SELECT doc_id, count(*) AS statements, count(*) FILTER (contains(line, 'the')) AS cited FROM s GROUP BY doc_id)
SELECT doc_id, statements, cited, round(cited / statements, 3) AS share, CASE WHEN round(cited / statements, 3) >= 0.8 THEN 'PASS' WHEN round(cited / statements, 3) >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM p""")
def _citations(read):
    listed = read("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n- ")).alias("text"))
    return transcripts.citation_share(listed, mark="the")


@query("greedy_matches")
def _greedy(read):
    c = read("conversations")
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.role") == "user") & (F.col("b.role") == "assistant"))
    scores = pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").cast("string").alias("left"), F.col("b.turn").cast("string").alias("right"), (1 / (1 + F.abs(F.col("a.turn") - F.col("b.turn")))).alias("score"))
    return matching.greedy_one_to_one(scores, "conv_id")


@query("bucket_classifier")
def _classifier(read):
    from lodegraph.operators import catalog

    docs = read("documents").select("doc_id", "text", F.col("lang").alias("label"))
    return catalog.predict_buckets(catalog.fit_buckets(docs), docs.select("doc_id", "text")).select("doc_id", "bucket", "confidence")


@query("paragraph_citations")
def _paragraph_citations(read):
    paragraphs = read("conversations").where("text IS NOT NULL").select(F.lit("all").alias("owner"), F.concat_ws(":", "conv_id", "turn").alias("paragraph"), "text")
    entries = read("benchmark").select(F.lit("all").alias("owner"), F.col("item_id").alias("entry"), "text")
    return knowledge.fuzzy_citations(paragraphs, entries, "owner").select("paragraph", "entry", F.round("score", 6).alias("score"), "rank")
