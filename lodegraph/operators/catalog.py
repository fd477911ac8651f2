"""Catalogues of capabilities, frameworks in prose, evidence in file names, and a trained bucket classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as T

TRUSTED = 0.7
FEATURES = 1 << 12
#: Words of a file name that are no evidence.
NOISE = ("final", "copy", "draft", "new", "v1", "v2", "transcript", "recording", "call", "meeting", "audio", "video", "notes", "raw", "full", "part")


def inventory(spark: SparkSession, folder: str, kinds: dict[str, str]) -> DataFrame:
    """Files below a folder with their kind by name pattern (first match), size and MD5."""
    kind = F.lit("other")
    for pattern, name in reversed(list(kinds.items())):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", kind.alias("kind"), "length", F.md5("content").alias("md5"))


def layer_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def invalid_entries(index: DataFrame, required: tuple[str, ...] = ("id", "name")) -> DataFrame:
    """(id, problem): missing fields and ids that are not unique."""
    missing = None
    for name in required:
        part = index.where(F.col(name).isNull() | (F.trim(F.col(name)) == "")).select("id", F.lit(f"missing {name}").alias("problem"))
        missing = part if missing is None else missing.union(part)
    twice = index.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("not unique").alias("problem"))
    return missing.union(twice)


def routing_index(squads: DataFrame, agents: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per squad with its sorted agents and tasks; a squad's are few."""
    a = agents.groupBy("squad").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    t = tasks.groupBy("squad").agg(F.array_sort(F.collect_set("task")).alias("tasks"))
    none = F.array().cast("array<string>")
    return squads.join(a, "squad", "left").join(t, "squad", "left").withColumns({"agents": F.coalesce("agents", none), "tasks": F.coalesce("tasks", none)})


def filename_evidence(path: Column) -> Column:
    """Words of a file name that may name a person or topic: no extension, dates, numbers or noise."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    words = F.regexp_extract_all(F.lower(F.regexp_replace(stem, "[0-9]+", " ")), F.lit(T.TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*NOISE) & (F.length(w) >= 3))


def frameworks(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, framework) named in prose as "The X Framework", Method, Model, System or Formula."""
    named = F.regexp_extract_all(F.col(text_col), F.lit(r"\b(?:[Tt]he )?((?:[A-Z][\w-]+ ){1,4}(?:Framework|Method|Model|System|Formula))\b"), F.lit(1))
    return texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(named)).alias("framework"))


def fit_buckets(rows: DataFrame, features: int = FEATURES) -> PipelineModel:
    """A classifier of (text, label): hashed TF-IDF and logistic regression; its training passes over all rows."""
    tokens = rows.select(T.tokens(F.col("text")).alias("tokens"), "label")
    label = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(tokens)
    stages = [
        label, HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", maxIter=30, regParam=0.01), IndexToString(inputCol="prediction", outputCol="predicted", labels=label.labels),
    ]
    return Pipeline(stages=stages).fit(tokens)


def predict_buckets(model: PipelineModel, texts: DataFrame, trusted: float = TRUSTED) -> DataFrame:
    """Adds bucket and confidence; below ``trusted`` the bucket is ``all``."""
    stages = PipelineModel(model.stages[1:])  # without the label
    out = stages.transform(texts.withColumn("tokens", T.tokens(F.col("text"))))
    sure = F.array_max(vector_to_array("probability"))
    return out.select(*texts.columns, F.when(sure >= trusted, F.col("predicted")).otherwise("all").alias("bucket"), F.round(sure, 4).alias("confidence"))
