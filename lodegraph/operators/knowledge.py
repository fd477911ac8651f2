"""Joins and roll-ups over a knowledge base: access, coverage, citations, routing, domains, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators.citing import fuzzy_citations  # noqa: F401  one of the joins of this module, kept apart for its length
from lodegraph.operators.graph import batched_pagerank
from lodegraph.session import cut

#: Confidence words as numbers.
CONFIDENCE = {"HIGH": 0.9, "MEDIUM": 0.7, "LOW": 0.5}
KEYWORD_FLOOR = 0.35


def confidence(value: Column) -> Column:
    """A word or a number as a number; 0.7 where it is neither."""
    words = F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), F.upper(value))
    return F.coalesce(words, value.try_cast("double"), F.lit(0.7))


# -- filters --------------------------------------------------------------------------------------------------------


def granted(frame: DataFrame, grants: DataFrame, agent: str, key: str = "bucket") -> DataFrame:
    """Rows of the buckets that an agent may see, by grants (agent, bucket)."""
    return frame.join(grants.where(F.col("agent") == agent).select(key).distinct(), key, "left_semi")


def changed_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files (path, sha) that the registry lacks or has with another hash."""
    known = registry.select("path", F.col("sha").alias("known"))
    return files.join(known, "path", "left").where(F.col("known").isNull() | (F.col("known") != F.col("sha"))).drop("known")


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest.where("status = 'completed'").select("path").distinct(), "path", "left_anti")


def uncited(chunks: DataFrame, citations: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that nothing cites, in order."""
    return chunks.select(key).distinct().join(citations.select(key).distinct(), key, "left_anti").orderBy(key)


def matching_communities(communities: DataFrame, query: str) -> DataFrame:
    """Communities (community, weight) whose name shares words with a query; weight times the share of its words."""
    asked = F.array_distinct(T.tokens(F.lit(query)))
    common = F.size(F.array_intersect(T.tokens(F.regexp_replace("community", "[-_]", " ")), asked))
    return communities.withColumn("score", F.col("weight") * common / F.greatest(F.size(asked), F.lit(1))).where("score > 0")


def ground_truth(rows: DataFrame, least: float = 0.7, most: int = 200) -> DataFrame:
    """(query, chunks, confidence) rows that are sure enough and name chunks, the first ``most`` by position."""
    return rows.withColumn("confidence", confidence(F.col("confidence"))).where((F.col("confidence") >= least) & (F.size("chunks") > 0)).orderBy("position").limit(most)


# -- joins ----------------------------------------------------------------------------------------------------------


def keyword_citations(sections: DataFrame, entries: DataFrame, floor: float = KEYWORD_FLOOR) -> DataFrame:
    """Sections (section, text) against entries (entry, keywords): twice the share of keywords, 0.9 at least where the id is named."""
    held = sections.select("section", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\w-]+"), F.lit(0)))).alias("word"))
    keys = entries.select("entry", F.size("keywords").alias("n"), F.explode("keywords").alias("word")).withColumn("word", F.lower("word"))
    hits = held.join(keys, "word").groupBy("section", "entry", "n").agg(F.count("*").alias("h")).select("section", "entry", F.least(2 * F.col("h") / F.col("n"), F.lit(1.0)).alias("s"))
    named = held.join(entries.select("entry", F.lower("entry").alias("word")), "word").select("section", "entry", F.lit(0.9).alias("s"))
    return hits.union(named).groupBy("section", "entry").agg(F.max("s").alias("score")).where(F.col("score") >= floor)


def section_chunks(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk ids of each (file, section), names compared without case; a copy named "x 2" counts as x; none gives an empty list."""
    key = lambda c: F.lower(F.regexp_replace(c, r" 2(?=\.|$)", ""))
    held = chunks.groupBy(key(F.col("file")).alias("f"), F.lower("section").alias("s")).agg(F.sort_array(F.collect_set("chunk_id")).alias("ids"))
    joined = sections.join(held, (key(F.col("file")) == F.col("f")) & (F.lower("section") == F.col("s")), "left")
    return joined.select("file", "section", F.coalesce("ids", F.array().cast("array<string>")).alias("chunk_ids"))


def agents_of(insights: DataFrame, by_theme: DataFrame, by_framework: DataFrame) -> DataFrame:
    """Agents of an insight's theme and framework together."""
    joined = insights.join(by_theme.select("theme", F.col("agents").alias("a")), "theme", "left").join(by_framework.select("framework", F.col("agents").alias("b")), "framework", "left")
    none = F.array().cast("array<string>")
    return joined.select("id", F.sort_array(F.array_union(F.coalesce("a", none), F.coalesce("b", none))).alias("agents"))


def select_agents(domains: DataFrame, duties: DataFrame, mentioned: DataFrame, k: int = 5) -> DataFrame:
    """Best agents for scored domains (domain, score): 0.6 of it where primary, 0.3 where secondary, 1 where mentioned."""
    scored = domains.join(duties, "domain").select("agent", F.when(F.col("level") == "primary", 0.6 * F.col("score")).otherwise(0.3 * F.col("score")).alias("s"))
    both = scored.union(mentioned.select("agent", F.lit(1.0)))
    return both.groupBy("agent").agg(F.round(F.max("s"), 6).alias("score")).orderBy(F.col("score").desc(), "agent").limit(k)


def coverage(sources: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """One row per source with a flag for each part that has it, and the share."""
    out = sources.select(key).distinct()
    for name, part in parts.items():
        out = out.join(part.select(key, F.lit(True).alias(name)).distinct(), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    share = reduce(lambda a, b: a + b, (F.col(n).cast("int") for n in parts)) / len(parts)
    return out.withColumn("share", F.round(share, 4))


def flat_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change) of two runs' flat (key, value) rows; time stamps are no difference."""
    both = before.select("key", F.col("value").alias("x")).join(after.select("key", F.col("value").alias("y")), "key", "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return both.where(~F.lower("key").rlike(r"(timestamp|_at|\bts)$")).withColumn("change", change).where("change IS NOT NULL").select("key", "x", "y", "change")


def flattened(frame: DataFrame, json_col: str) -> DataFrame:
    """(key, value) of the leaves of JSON objects, keys dotted, level by level."""
    rows = frame.select(F.lit("").alias("key"), F.try_parse_json(json_col).alias("v"))
    out = None
    for _ in range(8):  # deeper objects stay JSON text
        kind = F.schema_of_variant("v")
        leaf = rows.where(~kind.startswith("OBJECT")).select("key", F.col("v").cast("string").alias("value"))
        out = leaf if out is None else out.union(leaf)
        inner = F.try_variant_get("v", "$", "map<string,variant>")
        rows = rows.where(kind.startswith("OBJECT")).select("key", F.explode(inner).alias("k", "w")).select(F.concat("key", F.when(F.col("key") != "", ".").otherwise(""), "k").alias("key"), F.col("w").alias("v"))
    return out.union(rows.select("key", F.to_json("v")))


def edges_from_lists(entries: DataFrame, id_col: str, **lists: str) -> DataFrame:
    """Typed edges from array columns: ``relation=column``."""
    parts = [entries.select(F.col(id_col).alias("source"), F.explode(F.col(c)).alias("target"), F.lit(rel).alias("rel"), F.lit(1.0).alias("weight")) for rel, c in lists.items()]
    return reduce(DataFrame.unionByName, parts).where("target IS NOT NULL")


def seeds(nodes: DataFrame, query: str) -> DataFrame:
    """(id, mass): share of a label's words that the query has."""
    words = T.tokens(F.col("label"))
    mass = F.size(F.array_intersect(words, T.tokens(F.lit(query)))) / F.greatest(F.size(F.array_distinct(words)), F.lit(1))
    return nodes.select("id", mass.alias("mass")).where("mass > 0")


def seeds_of(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, id, mass) of many questions (query_id, query): the share of a label's distinct words that a question has."""
    labels = nodes.select("id", F.array_distinct(T.tokens(F.col("label"))).alias("words")).where(F.size("words") > 0)
    held = labels.select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    asked = questions.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("word"))
    return asked.join(held, "word").groupBy("query_id", "id").agg((F.count("*") / F.max("n")).alias("mass"))


def associative_many(questions: DataFrame, nodes: DataFrame, edges: DataFrame, hidden: tuple[str, ...] = ("domain", "agent"), exclude_seeds: bool = False, person: str | None = None, k: int = 15, **push) -> DataFrame:
    """(query_id, id, score, is_seed, rank): the k nodes of each question (query_id, query) that a walk from its seeds reaches most."""
    seeds = cut(seeds_of(nodes, questions))
    ranks = batched_pagerank(nodes, edges, seeds, **push).join(seeds.select("query_id", "id", F.lit(True).alias("seed")), ["query_id", "id"], "left")
    met = ranks.join(nodes, "id").where(~F.col("type").isin(*hidden))
    if exclude_seeds:
        met = met.where("seed IS NULL")
    if person is not None:
        met = met.where(F.lower("person") == person.lower())
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return met.select("query_id", "id", "score", F.col("seed").isNotNull().alias("is_seed"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def associative(ranks: DataFrame, nodes: DataFrame, hidden: tuple[str, ...] = ("domain", "agent"), person: str | None = None, k: int = 15) -> DataFrame:
    """The k nodes with the highest rank that are not of hidden types, of one person if asked."""
    met = ranks.join(nodes, "id").where(~F.col("type").isin(*hidden))
    if person is not None:
        met = met.where(F.col("person") == person)
    return met.orderBy(F.col("score").desc(), "id").limit(k)


def live_nodes(nodes: DataFrame, edges: DataFrame, kept: DataFrame, kind: str = "person") -> DataFrame:
    """Drops nodes of a kind that neither ``kept`` names nor an edge touches."""
    used = edges.select(F.col("source").alias("id")).union(edges.select("target")).union(kept.select("id")).distinct()
    return nodes.where(F.col("type") != kind).unionByName(nodes.where(F.col("type") == kind).join(used, "id", "left_semi"))


def call_participants(calls: DataFrame) -> DataFrame:
    """(call, day, participants) of call notes: ids are the local parts of the addresses on their participants' line."""
    line = F.regexp_extract("text", r"(?m)^Participants:\s*(.+)$", 1)
    people = F.transform(F.filter(F.transform(F.split(line, ","), lambda p: F.lower(F.trim(p))), lambda p: F.contains(p, F.lit("@")) & ~p.rlike(r"@(bot|notetaker)\.")), lambda p: F.substring_index(p, "@", 1))
    return calls.select("call", F.regexp_extract("text", r"(?m)^Date:\s*(\d{4}-\d{2}-\d{2})", 1).alias("day"), F.array_sort(F.array_distinct(people)).alias("participants"))


# -- roll-ups -------------------------------------------------------------------------------------------------------


def by_person(results: DataFrame, source: str) -> DataFrame:
    """Counts and best scores by person, the asking one apart."""
    side = F.when(F.col("person") == source, "own").otherwise("other")
    return results.groupBy(side.alias("side"), "person").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def layered(entities: DataFrame, edges: DataFrame, domain: str, k: int = 10, decay: float = 0.7) -> DataFrame:
    """Entities of a domain by layer and their neighbours at a lower score, each with its best, the first k a layer."""
    own = entities.where(F.exists("domains", lambda d: F.lower(d) == domain.lower())).select("id", F.col("weight").alias("score"))
    near = own.join(edges, F.col("id") == F.col("source")).select(F.col("target").alias("id"), (F.col("score") * decay).alias("score"))
    best = own.union(near).groupBy("id").agg(F.max("score").alias("score")).join(entities.select("id", "layer"), "id")
    order = Window.partitionBy("layer").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def domain_aggregate(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """Entries of a domain's experts with their weights and confidence as a number, and counts by expert."""
    joined = entries.join(weights, "expert", "left").withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "confidence": confidence(F.col("confidence"))})
    return joined.withColumn("expert_entries", F.count("*").over(Window.partitionBy("domain", "expert")))


def checks_passed(checks: DataFrame, key: str) -> DataFrame:
    """Share of passed checks by key and the names of failed ones, of blocking ones apart."""
    return checks.groupBy(key).agg(F.round(100 * F.avg(F.col("passed").cast("int")), 2).alias("percent"), F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("name")))).alias("failed"), F.bool_and(F.col("passed") | ~F.col("blocking")).alias("gate"))


def suite(cases: DataFrame) -> DataFrame:
    """Pass rate and means of evaluated cases (precision, hit_rate, n, least_n): enough results, and half of them right."""
    enough = F.least(F.lit(1.0), F.col("n") / F.greatest("least_n", F.lit(1)))
    passed = (enough >= 1) & (F.col("precision") >= 0.5)
    return cases.agg(F.count("*").alias("cases"), F.round(F.avg(passed.cast("int")), 4).alias("pass_rate"), F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("hit_rate"), 4).alias("hit_rate"), F.round(F.avg(enough), 4).alias("sufficiency"))


def stale(indexes: DataFrame, files: DataFrame) -> DataFrame:
    """Buckets whose index is missing or older than their newest file."""
    newest = files.groupBy("bucket").agg(F.max("modified").alias("newest"))
    held = indexes.groupBy("bucket").agg(F.min("modified").alias("oldest"))
    return newest.join(held, "bucket", "left").select("bucket", (F.col("oldest").isNull() | (F.col("newest") > F.col("oldest"))).alias("stale"))


def same_dimension(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.agg(F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most")).withColumn("consistent", F.coalesce(F.col("least") == F.col("most"), F.lit(True)))


def recommended(index: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Capabilities (key, name, path, priority) by words of four letters and more of the query: name 10, path 4, within 0 and 100."""
    words = F.filter(F.array_distinct(T.tokens(F.lit(query))), lambda t: F.length(t) >= 4)
    count = lambda c: F.size(F.filter(words, lambda w: F.contains(F.lower(c), w)))
    score = F.least(F.lit(100), 10 * count(F.col("name")) + 4 * count(F.col("path")) + F.coalesce("priority", F.lit(0)))
    return index.withColumn("score", F.when(count(F.col("name")) + count(F.col("path")) > 0, score).otherwise(0)).orderBy(F.col("score").desc(), "key").limit(k)


def merge_queue(existing: DataFrame, new: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Existing rows stay; new ones join where their key is not there yet."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*existing.columns))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait from a number or an HTTP date; none where it is neither."""
    when = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(value.try_cast("double"), F.when(when.isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(when) - F.unix_timestamp(now)).cast("double"))))
