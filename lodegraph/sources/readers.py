"""Readers: Markdown corpora, JSON artifacts, JSON lines, YAML lists, graphs, relevance files, vector tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import chunking


@dataclass(frozen=True)
class Source:
    """A named part of a corpus: where it is and which bucket it belongs to."""

    name: str
    glob: str
    bucket: str


def whole_texts(spark: SparkSession, *globs: str) -> DataFrame:
    """(path, text) of files, each once; hidden and private ones are skipped."""
    found = spark.read.option("recursiveFileLookup", "true").text(list(globs), wholetext=True)
    named = found.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return named.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]"))


def corpus(spark: SparkSession, catalogue: list[Source], per_file_bucket: Column | None = None) -> DataFrame:
    """(source, bucket, path, text) of every source of a catalogue; a path of several belongs to the first."""
    out = None
    for at, s in enumerate(catalogue):
        bucket = F.lit(s.bucket) if per_file_bucket is None else F.coalesce(per_file_bucket, F.lit(s.bucket))
        part = whole_texts(spark, s.glob).withColumns({"source": F.lit(s.name), "bucket": bucket, "_at": F.lit(at)})
        out = part if out is None else out.unionByName(part)
    first = out.groupBy("path").agg(F.min("_at").alias("_at"))
    return out.join(first, ["path", "_at"]).select("source", "bucket", "path", "text")


def markdown_sections(texts: DataFrame) -> DataFrame:
    """(path, section, start_char, name, content) of Markdown files."""
    return chunking.sections(texts, id_col="path")


def frontmatter(text: Column) -> Column:
    """The block between a leading pair of --- lines, as a map of its plain ``key: value`` lines."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    pairs = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(\S.*)?$"), F.lit(0))
    cut = F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")))
    return F.map_from_entries(F.filter(cut, lambda e: e["k"] != ""))


def json_artifacts(spark: SparkSession, *globs: str) -> DataFrame:
    """(path, chunk) of three shapes: {"chunks": [...]}, a list, or a map of lists; rows without text go."""
    raw = whole_texts(spark, *globs).select("path", F.try_parse_json("text").alias("v"))
    shape = F.schema_of_variant("v")
    listed = F.when(shape.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.chunks", "array<variant>"))
    flat = raw.select("path", "v", listed.alias("items"))
    lists = flat.where("items IS NOT NULL").select("path", F.explode("items").alias("chunk"))
    maps = flat.where("items IS NULL").select("path", F.explode(F.map_values(F.try_variant_get("v", "$", "map<string,array<variant>>"))).alias("items")).select("path", F.explode("items").alias("chunk"))
    text = F.try_variant_get("chunk", "$.text", "string")
    return lists.union(maps).select("path", F.try_variant_get("chunk", "$.id", "string").alias("id"), text.alias("text")).where(F.trim(text) != "")


def json_lines(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Events of JSON lines with a given schema; lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(list(paths))


def traces(spark: SparkSession, folder: str, schema: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Traces as ``append_traces`` writes them, from the first to the last day (yyyy-mm-dd): other days' folders are not listed to tasks. Without either bound all of them, those without a time too."""
    found = json_lines(spark, f"{schema}, day date", folder)
    if first is not None:
        found = found.where(F.col("day") >= F.lit(first).cast("date"))
    return found if last is None else found.where(F.col("day") <= F.lit(last).cast("date"))


def yaml_entries(texts: DataFrame) -> DataFrame:
    """(path, id, text, domain): the first list of mappings in each YAML file, an entry a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            out = []
            for path, text in batch[["path", "text"]].itertuples(index=False):
                try:
                    loaded = yaml.safe_load(text or "")
                except yaml.YAMLError:
                    continue
                values = loaded.values() if isinstance(loaded, dict) else [loaded]
                entries = next((v for v in values if isinstance(v, list) and v and all(isinstance(e, dict) for e in v)), [])
                for e in entries:
                    lines = [f"ID: {e.get('id', '')}"] + [f"{k}: {v}" for k, v in e.items() if k != "id"]
                    domains = e.get("dominios") or [""]
                    out.append((path, str(e.get("id", "")), "\n".join(lines), str(domains[0])))
            yield pd.DataFrame(out, columns=["path", "id", "text", "domain"])

    return texts.select("path", "text").mapInPandas(run, "path string, id string, text string, domain string")


def graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file; nodes are a map by id or a list."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    node = "struct<id:string,type:string,label:string,domains:array<string>,weight:double>"
    edge = "struct<source:string,target:string,rel:string,weight:double>"
    as_map = F.map_values(F.try_variant_get("v", "$.entities", f"map<string,{node}>"))
    as_list = F.try_variant_get("v", "$.entities", f"array<{node}>")
    nodes = raw.select(F.inline(F.coalesce(as_map, as_list)))
    return nodes, raw.select(F.inline(F.try_variant_get("v", "$.edges", f"array<{edge}>")))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, id) of a relevance file: keys bucket::chunk, or bare chunk ids of the query's bucket."""
    schema = "schema_version int, queries array<struct<query_id:string,query:string,bucket:string,relevant:array<struct<bucket:string,chunk_id:string>>,relevant_chunk_ids:array<string>>>"
    q = spark.read.schema(schema).option("multiLine", "true").json(path).where("schema_version = 1").select(F.posexplode("queries").alias("i", "q"))
    bucket = F.coalesce("q.bucket", F.lit("external"))
    keys = F.coalesce(F.transform("q.relevant", lambda r: F.concat_ws("::", F.coalesce(r["bucket"], bucket), r["chunk_id"])), F.transform("q.relevant_chunk_ids", lambda c: F.concat_ws("::", bucket, c)))
    return q.select(F.coalesce("q.query_id", F.concat(F.lit("entry-"), F.col("i").cast("string"))).alias("query_id"), F.col("q.query").alias("query"), F.explode(keys).alias("id"))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of its numeric key; filters are pushed to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
    return reader.option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).options(**options).load()


def remote_difference(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """(key, state): missing here, gone there or in both."""
    both = remote.select(key).distinct().withColumn("r", F.lit(True)).join(local.select(key).distinct().withColumn("l", F.lit(True)), key, "full_outer")
    return both.select(key, F.when(F.col("l").isNull(), "missing").when(F.col("r").isNull(), "gone").otherwise("both").alias("state"))


def chunk_rows(docs: DataFrame, source: str, bucket: str) -> DataFrame:
    """Canonical chunk rows (chunk_id, content_sha, text, source, bucket, start_char, char_count)."""
    pieces = chunking.recursive_chunks(docs, source_col=source)
    return pieces.select("chunk_id", T.content_sha(F.col("content")).alias("content_sha"), F.col("content").alias("text"), "source", F.lit(bucket).alias("bucket"), "start_char", "char_count")
