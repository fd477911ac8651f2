"""Tags, vectors by id, kinds of questions, categories of texts, adjacency, inventories, traces and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import rules

#: Patterns of questions to a graph, the first that is found wins.
GRAPH_QUESTIONS = {
    "global": (r"(?:o que|what).*(?:todos|all|experts?|everyone|consenso|consensus)", r"(?:qual|what).*(?:consenso|consensus|agreement|concordam|agree)", r"(?:como|how).*(?:todos|all|experts?).*(?:veem|see|think|pensam)"),
    "ontological": (r"(?:quais|which|que).*(?:heurist|framework|metodolog|filosofi|modelo)", r"(?:heurist|framework|metodolog).*(?:para|for|sobre|about)", r"(?:regras?|rules?).*(?:para|for|sobre|about)", r"(?:threshold|limiar|limite|gate).*(?:para|for|de)"),
    "associative": (r"(?:quem|who).*(?:mais|else|também|also|similar).*(?:fala|said|talks|diz)", r"(?:parecido|similar|like|como).*(?:conceito|concept|ideia|idea)", r"(?:outros?|other).*(?:experts?|pessoas?|persons?)", r"(?:cross|cruzar|cruzamento).*(?:expert|fonte|source)"),
    "hierarchical": (r"(?:trace|rastrear|caminho|path).*(?:filosofia|metodologia|framework)", r"(?:da |from ).*(?:filosofia|philosophy).*(?:até|to|ate).*(?:metodologia|methodology)", r"(?:hierarquia|hierarchy|cascata|cascade).*(?:dna|cognitiv)"),
}
#: Most items of each kind that a comparison of declared and actual ones names.
NAMED = 25
#: Characters of a text that its category is read from, by definition.
CATEGORY_CHARS = 2000


def graph_question(question: Column) -> Column:
    return rules.first_match(F.lower(question), GRAPH_QUESTIONS, F.lit("factual"))


def tag_value(chunks: DataFrame, key: str, metadata: str = "metadata") -> Column:
    """A tag from the column of that name, also where it is null, else from the map of metadata."""
    return F.col(key) if key in chunks.columns else F.element_at(F.col(metadata), key)


def vectors_of(wanted: DataFrame, vectors: DataFrame, bucket: str) -> DataFrame:
    """(id, embedding) of the wanted ids in a bucket; ids that are not there are left out."""
    return vectors.where(F.col("bucket") == bucket).select("id", "embedding").join(wanted.select("id").distinct(), "id", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbour, weight): each edge from both its ends; a symmetric pair counts twice."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "weight").union(edges.select("target", "source", "weight"))


def content_category(text: Column, categories: dict[str, tuple[str, ...]], default: str) -> Column:
    """The category of which most patterns are found near the beginning of a text, the first of equals."""
    return rules.most_hits(F.lower(F.substring(text, 1, CATEGORY_CHARS)), categories, default)


def first_theme(name: Column, text: Column, themes: dict[str, tuple[str, ...]], lines: int = 50) -> Column:
    """The first theme with a keyword in a file's name or first lines; null without any."""
    seen = F.lower(F.concat_ws("\n", name, F.substring_index(text, "\n", lines)))
    found = [F.when(F.greatest(*(F.contains(seen, F.lit(w)) for w in words), F.lit(False)), theme) for theme, words in themes.items()]
    return F.coalesce(*found)


def parallel_groups(levels: DataFrame) -> DataFrame:
    """(level, steps): the steps of a level may run at once."""
    return levels.groupBy("level").agg(F.sort_array(F.collect_set("step")).alias("steps"))


def declared_and_actual(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per owner: how many items are on one side alone, the first NAMED of each by name, and the kind of gap."""
    both = declared.select("owner", "item", F.lit(True).alias("d")).distinct().join(actual.select("owner", "item", F.lit(True).alias("a")).distinct(), ["owner", "item"], "full_outer")
    side = F.when(F.col("d").isNull(), "undeclared").when(F.col("a").isNull(), "absent").otherwise("both")
    ranked = both.withColumn("side", side).withColumn("n", F.expr("row_number() OVER (PARTITION BY owner, side ORDER BY item)"))
    first = lambda s: F.array_join(F.sort_array(F.collect_list(F.when((F.col("side") == s) & (F.col("n") <= NAMED), F.col("item")))), ",")
    out = ranked.groupBy("owner").agg(F.count_if(F.col("side") == "undeclared").alias("undeclared"), F.count_if(F.col("side") == "absent").alias("absent"), first("undeclared").alias("first_undeclared"), first("absent").alias("first_absent"))
    gap = F.when((F.col("undeclared") > 0) & (F.col("absent") > 0), "both").when(F.col("undeclared") > 0, "undeclared").when(F.col("absent") > 0, "absent").otherwise("none")
    return out.withColumn("gap", gap)


def inventory(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, path, md5) of files (path, content), the kind by the folder below which they stand."""
    kind = F.coalesce(*(F.when(F.contains("path", F.lit(f"/{folder}/")), name) for folder, name in kinds.items()), F.lit("other"))
    return files.select(kind.alias("kind"), "path", F.md5(F.col("content").cast("binary")).alias("md5"))


def health(checks: DataFrame) -> DataFrame:
    """(source, passed, total, percent, gaps) of checks (source, check, passed); a check without a result has not passed."""
    ok = F.coalesce("passed", F.lit(False))
    return checks.groupBy("source").agg(
        F.count_if(ok).alias("passed"), F.count("*").alias("total"), F.round(100 * F.avg(ok.cast("int")), 1).alias("percent"),
        F.array_join(F.sort_array(F.collect_set(F.when(~ok, F.col("check")))), ",").alias("gaps"),
    )


def append_traces(traces: DataFrame, path: str, at: str = "ts") -> None:
    """Appends traces as JSON lines to a folder of their day."""
    traces.withColumn("day", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of earlier runs, one JSON object a line; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
