"""Queries of scalar functions, projections and text detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import chunking, entity, memory, mentions, rules, windows
from lodegraph.plans.catalogue import query
from lodegraph.plans.retrieval_queries import TOK

SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query("sentence_stats", f"SELECT doc_id, len({SENT}) AS n_sentences, list_max(list_transform({SENT}, lambda x: length(x))) AS longest FROM documents", ints=("n_sentences", "longest",))
def _sentences(read):
    s = T.sentences(F.col("text"))
    return read("documents").select("doc_id", F.size(s).alias("n_sentences"), F.array_max(F.transform(s, F.length)).alias("longest"))


@query("token_stats", f"SELECT doc_id, len({TOK.format('text')}) AS n_tokens, len(list_distinct({TOK.format('text')})) AS n_distinct, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS estimate FROM documents", ints=("n_tokens", "n_distinct",))
def _tokens(read):
    t = T.tokens(F.col("text"))
    return read("documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), T.token_estimate(F.col("text")).alias("estimate"))


@query("content_hashes", r"""SELECT doc_id, substring(sha256(substring(text, 1, 8000)), 1, 16) AS sha, sha256(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS normal,
 'ch_' || substring(md5(source || ':0:' || substring(text, 1, 100)), 1, 8) AS chunk FROM documents""")
def _hashes(read):
    return read("documents").select("doc_id", T.content_sha(F.col("text")).alias("sha"), T.text_hash(F.col("text")).alias("normal"), T.chunk_id(F.col("source"), F.lit(0), F.col("text")).alias("chunk"))


@query("pair_ids", "SELECT doc_id, substring(sha256('s::' || least(lang, source) || '::' || greatest(lang, source)), 1, 8) AS pair FROM documents")
def _pairs(read):
    return read("documents").select("doc_id", T.pair_id(F.lit("s"), F.col("lang"), F.col("source")).alias("pair"))


@query("word_delta", r"SELECT doc_id, array_to_string(list_slice(string_split_regex(trim(text), '\s+'), 6, 15), ' ') AS delta FROM documents")
def _delta(read):
    d = T.word_delta(F.col("text"), 5)
    return read("documents").select("doc_id", F.array_join(F.slice(F.split(d, " "), 1, 10), " ").alias("delta"))


@query("slugs_and_queries", r"""SELECT item_id, regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
 trim(regexp_replace(regexp_replace(replace(substring(text, 1, 500), '```', ''), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS clean FROM benchmark""")
def _slugs(read):
    return read("benchmark").select("item_id", T.slug(F.col("text")).alias("slug"), T.sanitise_query(F.col("text")).alias("clean"))


@query("bands_and_scores", """SELECT p_partkey, CASE WHEN p_size <= 1 THEN 1 WHEN p_size <= 2 THEN 2 WHEN p_size <= 10 THEN 3 WHEN p_size <= 30 THEN 4 WHEN p_size <= 60 THEN 5 ELSE 6 END AS band,
 CASE WHEN p_size * 2 >= 90 THEN 'A' WHEN p_size * 2 >= 80 THEN 'B' WHEN p_size * 2 >= 70 THEN 'C' WHEN p_size * 2 >= 60 THEN 'D' ELSE 'F' END AS grade,
 round(0.2 * 0.5 + 0.3 * exp(-0.05 * p_size) + 0.5 * least(p_size / 10, 1.0), 6)::DOUBLE AS score FROM part""")
def _bands(read):
    s = F.col("p_size").cast("double")
    return read("part").select("p_partkey", T.effort_band(s).alias("band"), T.grade(s * 2).alias("grade"), F.round(T.composite_score(F.lit(0.5), T.recency(s), s), 6).alias("score"))


@query("clock_and_epoch", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at, lpad((user_id // 3600)::VARCHAR, 2, '0') || ':' || lpad((user_id % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((user_id % 60)::VARCHAR, 2, '0') AS clock FROM events""")
def _clock(read):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return read("events").select("event_id", T.epoch_text(ms).alias("at"), T.clock(F.col("user_id")).alias("clock"))


@query("json_metadata", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _json(read):
    return read("events").select("event_id", T.json_metadata(F.col("props"))["k"].alias("k"))


@query("adjacent_similarity", "SELECT vec_id, round(list_dot_product(e, n) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(n, n))), 6) AS similarity FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n IS NOT NULL")
def _adjacent(read):
    from pyspark.sql import Window

    nxt = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return read("embeddings").withColumn("n", nxt).where("n IS NOT NULL").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("n")), 6).alias("similarity"))


@query("section_split", r"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(replace(text, chr(10) || 'The', chr(10) || '## The'), chr(10)) AS x FROM documents)),
s AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER w AS section, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, section::INT AS section, min(before)::BIGINT AS start_char, coalesce(trim(substring(max(CASE WHEN starts_with(line, '## ') THEN line END), 4)), '') AS name, md5(string_agg(line, chr(10) ORDER BY pos)) AS content_md5 FROM s GROUP BY doc_id, section""")
def _sections(read):
    marked = read("documents").select("doc_id", F.replace("text", F.lit("\nThe"), F.lit("\n## The")).alias("text"))
    return chunking.sections(marked).select("doc_id", "section", "start_char", "name", F.md5("content").alias("content_md5"))


@query("recursive_chunks")
def _chunks(read):
    return chunking.recursive_chunks(read("documents")).select("doc_id", "pos", "chunk_id", "char_count")


@query("html_text")
def _html(read):
    return chunking.html_text(read("pages"))


@query("min_distance_thinning", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY d) AS r, d FROM (SELECT DISTINCT user_id, day(ts)::INT AS d FROM events)),
f AS (SELECT user_id, r, d AS kept, 1 AS k FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, CASE WHEN e.d - f.kept >= 3 THEN e.d ELSE f.kept END, CASE WHEN e.d - f.kept >= 3 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, count(*) AS kept FROM f WHERE k = 1 GROUP BY user_id""")
def _thin(read):
    days = read("events").groupBy("user_id").agg(F.collect_set(F.dayofmonth("ts")).alias("d"))
    return days.select("user_id", F.size(windows.thinned(F.col("d"), 3)).cast("long").alias("kept"))


def _sql_any(column, patterns):
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


INTENT_SQL = "CASE " + " ".join(f"WHEN {_sql_any('q', p)} THEN '{k}'" for k, p in rules.INTENTS.items()) + r" WHEN len(list_filter(string_split_regex(q, '\s+'), lambda w: w <> '')) <= 5 THEN 'factual_simple' ELSE 'analytical' END"


@query("query_intents", f"""WITH b AS (SELECT item_id, trim(lower(text)) AS q FROM benchmark), i AS (SELECT item_id, {INTENT_SQL} AS intent FROM b)
SELECT item_id, intent, CASE intent WHEN 'greeting' THEN 'none' WHEN 'meta' THEN 'none' WHEN 'factual_simple' THEN 'bm25' WHEN 'factual_complex' THEN 'hybrid' WHEN 'hierarchical' THEN 'full' ELSE 'hybrid_graph' END AS pipeline FROM i""")
def _intents(read):
    i = read("benchmark").select("item_id", rules.intent(F.col("text")).alias("intent"))
    return i.withColumn("pipeline", rules.pipeline_of(F.col("intent")))


@query("query_intents_whole", f"""WITH b AS (SELECT item_id, trim(lower(text)) AS q FROM benchmark), i AS (SELECT item_id, {INTENT_SQL} AS intent FROM b)
SELECT item_id, intent, CASE intent WHEN 'greeting' THEN 'none' WHEN 'meta' THEN 'none' WHEN 'factual_simple' THEN 'bm25' WHEN 'factual_complex' THEN 'hybrid' WHEN 'hierarchical' THEN 'full' ELSE 'hybrid_graph' END AS pipeline FROM i""")
def _intents_whole(read):
    i = read("benchmark").select("item_id", rules.intent(F.col("text")).alias("intent"))
    return i.withColumn("pipeline", rules.pipeline_of(F.col("intent")))


AREAS = {"alpha": ("the", "and"), "beta": ("der", "und"), "gamma": ("les?", "est"), "delta": ("que", "los")}


def _area_sql(patterns):
    return " + ".join(f"regexp_matches(lower(text), '{p}')::INT" for p in patterns)


@query("area_by_most_hits", f"""WITH h AS (SELECT doc_id, {', '.join(f"{_area_sql(p)} AS {k}" for k, p in AREAS.items())} FROM documents), t AS (SELECT *, greatest(alpha, beta, gamma, delta) AS top FROM h)
SELECT doc_id, CASE WHEN top = 0 THEN 'other' WHEN alpha = top THEN 'alpha' WHEN beta = top THEN 'beta' WHEN gamma = top THEN 'gamma' ELSE 'delta' END AS area,
CASE WHEN top > 0 AND (alpha = top)::INT + (beta = top)::INT + (gamma = top)::INT + (delta = top)::INT = 1 THEN round(top / (alpha + beta + gamma + delta), 3) ELSE 0 END::DOUBLE AS confidence FROM t""")
def _areas(read):
    low = F.lower("text")
    return read("documents").select("doc_id", rules.most_hits(low, AREAS, "other").alias("area"), rules.vote_confidence(low, AREAS)["confidence"].alias("confidence"))


#: Contradictions among documents of one source, over word pairs of the invented prose.
WORDS = (("WITH", "FROM"), ("AVEC", "POUR"))


SIDES = f"""WITH s AS (SELECT source, doc_id, p.i AS pair, bool_or(contains(upper(text), p.x)) AS hx, bool_or(contains(upper(text), p.y)) AS hy FROM documents, (VALUES {', '.join(f"({i}, '{x}', '{y}')" for i, (x, y) in enumerate(WORDS))}) p(i, x, y) GROUP BY ALL),
n AS (SELECT source, pair, count(*) FILTER (hx) AS nx, count(*) FILTER (hy) AS ny FROM s GROUP BY ALL), m AS (SELECT source, pair, doc_id, 0 AS side, ny - hy::INT AS opposites FROM s JOIN n USING (source, pair) WHERE hx UNION ALL
SELECT source, pair, doc_id, 1, nx - hx::INT FROM s JOIN n USING (source, pair) WHERE hy) SELECT * FROM m WHERE opposites > 0"""


#: Members of each side instead of pairs, which grow with the square of a source's documents; tests hold the pairs against brute force.
@query("antonym_theta_join", SIDES)
@query("antonym_sides", SIDES)
def _antonym_sides(read):
    return rules.contradiction_sides(read("documents"), "source", "doc_id", "text", WORDS)


@query("alias_longest_gram", r"""WITH al(alias, entity) AS (VALUES ('the', 'e1'), ('of the', 'e2'), ('is the', 'e3'), ('and', 'e4'), ('la', 'e5')),
w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9à-ɏ]+') AS w FROM documents),
g AS (SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 5) r(n))),
m AS (SELECT id, entity, gram, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS r FROM g JOIN al ON alias = gram) SELECT id, entity, gram FROM m WHERE r = 1""")
def _aliases(read):
    docs = read("documents")
    table = docs.sparkSession.createDataFrame([("the", "e1"), ("of the", "e2"), ("is the", "e3"), ("and", "e4"), ("la", "e5")], "alias string, entity string")
    return entity.alias_matches(docs, table, "doc_id", "text")


@query("role_patterns", r"""WITH p(role, kind, pattern, weight) AS (VALUES ('r1', 'direct', 'the', 1.0), ('r1', 'inferred', 'tion', 0.7), ('r2', 'direct', 'und', 1.0)), t AS (SELECT doc_id AS id, lower(text) AS t FROM documents),
h AS (SELECT id, role, kind, weight, (length(t) - length(replace(t, pattern, ''))) // length(pattern) AS n FROM t, p)
SELECT id, role, kind, sum(n)::BIGINT AS hits, round(sum(n * weight), 2)::DOUBLE AS score FROM h WHERE n > 0 GROUP BY ALL""")
def _role_patterns(read):
    docs = read("documents")
    table = docs.sparkSession.createDataFrame([("r1", "direct", "the", 1.0), ("r1", "inferred", "tion", 0.7), ("r2", "direct", "und", 1.0)], "role string, kind string, pattern string, weight double")
    return entity.detect_roles(docs, table, "doc_id", "text")


@query("insight_best_segment", f"""WITH i AS (SELECT c.conv_id, c.turn AS id, list_distinct({TOK.format('c.text')}) AS w FROM conversations c WHERE role = 'assistant'), s AS (SELECT conv_id, turn AS pos, list_distinct({TOK.format('text')}) AS w FROM conversations WHERE role = 'user'),
j AS (SELECT i.conv_id, id, pos, round(len(list_intersect(i.w, s.w)) / (len(i.w) + len(s.w) - len(list_intersect(i.w, s.w))), 9) AS score FROM i JOIN s USING (conv_id) WHERE len(i.w) > 0 AND len(s.w) > 0)
SELECT conv_id, id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY score DESC, pos) AS r FROM j WHERE score > 0.03) WHERE r = 1""")
def _segments(read):
    c = read("conversations")
    return entity.best_segment(c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("id"), "text"), c.where("role = 'user'").select("conv_id", F.col("turn").alias("pos"), "text"), "conv_id", 0.03)


MEMORY_SQL = """e AS (SELECT role AS agent, text AS content, (length(text) % 10) / 10.0::DOUBLE AS importance, (turn % 12)::DOUBLE AS refs, conv_id % 7 = 0 AS pinned, CASE WHEN conv_id % 5 = 0 THEN 'core' ELSE 'work' END AS scope, conv_id % 30 AS days FROM conversations),
m AS (SELECT *, 0.2 * importance + 0.3 * exp(-0.05 * days) + 0.5 * least(refs / 10, 1.0) AS composite FROM e)"""


def memories(read):
    now = F.lit("2024-02-01").cast("timestamp")
    e = read("conversations").select(
        F.col("role").alias("agent"), F.col("text").alias("content"), (F.length("text") % 10 / 10.0).alias("importance"), (F.col("turn") % 12).cast("double").alias("references"),
        (F.col("conv_id") % 7 == 0).alias("pinned"), F.when(F.col("conv_id") % 5 == 0, "core").otherwise("work").alias("scope"), (now - F.make_dt_interval((F.col("conv_id") % 30).cast("int"))).alias("last_seen"),
    )
    return memory.scored(e, now)


@query("memory_composite", f"WITH {MEMORY_SQL} SELECT agent, md5(content) AS content, round(composite, 6)::DOUBLE AS composite FROM m")
def _memory(read):
    return memories(read).select("agent", F.md5("content").alias("content"), F.round("composite", 6).alias("composite"))


@query("memory_rank", f"WITH {MEMORY_SQL}, q AS (SELECT *, len(list_intersect(['the', 'and', 'for'], {TOK.format('content')})) AS c FROM m) SELECT md5(content) AS content, round(0.5 * c / 3 + 0.5 * composite, 6)::DOUBLE AS score FROM q WHERE c > 0 ORDER BY round(0.5 * c / 3 + 0.5 * composite, 9) DESC, q.content LIMIT 10")
def _memory_rank(read):
    return memory.search(memories(read), "the and for", 10).select(F.md5("content").alias("content"), F.round("score", 6).alias("score"))


@query("memory_prune", f"WITH {MEMORY_SQL}, r AS (SELECT *, pinned OR scope = 'core' AS safe FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY safe DESC, composite DESC, content) AS n FROM r WHERE safe OR composite >= 0.3) SELECT agent, count(*) AS kept FROM k WHERE safe OR n <= 100 GROUP BY agent")
def _memory_prune(read):
    return memory.prune(memories(read), 100, 0.3).groupBy("agent").agg(F.count("*").alias("kept"))


@query("memory_stats", f'WITH {MEMORY_SQL} SELECT scope, count(*) AS n, count(*) FILTER (pinned) AS pinned, sum(refs)::DOUBLE AS "references", round(avg(importance), 4)::DOUBLE AS importance FROM m GROUP BY ROLLUP (scope)')
def _memory_stats(read):
    return memory.stats(memories(read))


@query("person_triggers", "SELECT user_id, CASE WHEN count(DISTINCT event_type) >= 2 AND count(*) >= 30 THEN 'create' WHEN count(DISTINCT event_type) >= 1 OR count(*) >= 5 THEN 'candidate' ELSE 'none' END AS decision FROM events GROUP BY user_id")
def _triggers(read):
    per = read("events").groupBy("user_id").agg(F.count_distinct("event_type").alias("s"), F.count("*").alias("m"))
    return per.select("user_id", entity.person_trigger(F.col("s"), F.col("m")).alias("decision"))


@query("fuzzy_best_match")
def _fuzzy(read):
    suppliers = read("supplier").select(F.col("s_name").alias("name"))
    return entity.best_match(suppliers.select(F.concat("name", F.lit("x")).alias("name")), suppliers)


@query("traceable_lines", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents) WHERE length(t) >= 30 AND NOT regexp_matches(t, '^(#|>|\||---|===|\*\*\*)') GROUP BY doc_id")
def _traceable(read):
    lines = read("documents").select("doc_id", F.explode(F.split("text", "\\n")).alias("t"))
    return lines.where(rules.traceable_paragraph(F.col("t"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("semantic_chunks")
def _semantic(read):
    from lodegraph.operators import semantic

    return semantic.semantic_chunks(read("documents"))


@query("paragraph_extraction", r"""WITH b AS (SELECT doc_id, unnest(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n')) AS p FROM documents)
SELECT doc_id, count(*) AS n, sum(length(trim(p)))::BIGINT AS chars FROM b WHERE trim(p) <> '' AND NOT regexp_matches(trim(p), '^(#|\||>|---|===|\*\*\*)') GROUP BY doc_id""")
def _paragraphs(read):
    from lodegraph.operators import transcripts

    spread = read("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return transcripts.paragraphs(spread).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("paragraph")).alias("chars"))


@query("answers_offline", "SELECT item_id, substring(text, 1, 200) AS answer FROM benchmark")
def _answers(read):
    from lodegraph import plugins

    return plugins.with_answers(read("benchmark").select("item_id", F.col("text").alias("prompt")), plugins.ExtractiveModel(200)).select("item_id", "answer")


_FIRST_TWO = "SELECT item_id, w[1] || ' ' || w[2] AS gram FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9à-ɏ]+') AS w FROM benchmark) WHERE len(w) >= 2"


def _named(read):
    words = mentions.words_of(F.col("text"))
    return read("benchmark").where(F.size(words) >= 2).select(F.array_join(F.slice(words, 1, 2), " ").alias("alias"), F.col("item_id").alias("entity"))


@query("name_mentions", f"""WITH al AS ({_FIRST_TWO}), w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9à-ɏ]+') AS w FROM documents),
g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w))
SELECT doc_id, item_id, count(*) AS n FROM g JOIN al USING (gram) GROUP BY ALL""")
def _mentions(read):
    return mentions.mentions(read("documents"), _named(read), "doc_id").groupBy(F.col("id").alias("doc_id"), F.col("entity").alias("item_id")).agg(F.count("*").alias("n"))


_KINDS = " ".join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in mentions.ARTIFACTS.items())


@query("resolved_files", f"""WITH al AS (SELECT gram, min('src' || (item_id % 20)) AS entity FROM ({_FIRST_TWO}) GROUP BY gram), q AS (SELECT item_id, trim(lower('transcript of ' || text)) AS q, regexp_extract_all(lower('transcript of ' || text), '[a-z0-9à-ɏ]+') AS w FROM benchmark),
m AS (SELECT item_id, q, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM q)), b AS (SELECT item_id, q, entity, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM m JOIN al USING (gram)),
f AS (SELECT item_id, doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY item_id ORDER BY doc_id) - length(text) AS before FROM b JOIN documents d ON d.source = b.entity
WHERE r = 1 AND text IS NOT NULL AND CASE {_KINDS} END = 'source')
SELECT item_id, doc_id, CASE WHEN n <= 32000 - before THEN n ELSE 32000 - before END::BIGINT AS chars FROM f WHERE n <= 32000 - before OR 32000 - before > 200""")
def _resolved(read):
    questions = read("benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("transcript of "), "text").alias("query"))
    aliases = _named(read).select("alias", F.concat(F.lit("src"), (F.col("entity") % 20).cast("string")).alias("entity"))
    files = read("documents").select(F.col("source").alias("entity"), F.lit("source").alias("artifact"), F.col("doc_id").alias("place"), F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    return mentions.resolved(questions, aliases, files).select(F.col("query_id").alias("item_id"), F.col("place").alias("doc_id"), F.length("text").cast("long").alias("chars"))
