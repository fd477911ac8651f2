"""Names in texts: one automaton over all aliases, the direct resolver and the inference of a file's author and subject.

``mentions`` finds every occurrence of every alias in one pass over a text's words, however many aliases there are. The
automaton (Aho-Corasick) is built once per worker from a list whose size is checked before it is shipped; a larger list
meets the texts in a join on their n-grams of the aliases' lengths instead, with the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators.resolving import DIRECT_CHARS, bounded_files

#: Bound on the characters of the aliases that are shipped to the workers.
MOST_SHIPPED = 16_000_000

_built: dict[str, object] = {}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(T.WORD), F.lit(0))


def _automaton(key: str, names: list[str]):
    if key not in _built:
        import ahocorasick

        made = ahocorasick.Automaton()
        for name in names:
            made.add_word(f" {name} ", len(name.split(" ")))
        made.make_automaton()
        _built.clear()
        _built[key] = made
    return _built[key]


def _by_automaton(texts: DataFrame, names: list[str], kind: str) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(key, names)
        for batch in batches:
            at, starts, sizes, grams = [], [], [], []
            for row, line in enumerate(batch.column(1)):
                text = line.as_py()
                spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
                for end, n in found.iter(text):
                    last = int(np.searchsorted(spaces, end))
                    at.append(row)
                    starts.append(last - n + 1)
                    sizes.append(n)
                    grams.append(text[spaces[last - n] + 1 : end])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(grams, pa.string())], names=["id", "start", "n", "gram"])

    lines = texts.select("id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"))
    return lines.mapInArrow(run, f"id {kind}, start int, n int, gram string")


def _by_join(texts: DataFrame, grams: DataFrame) -> DataFrame:
    lengths = sorted(r[0] for r in grams.select(F.size(F.split("gram", " ")).alias("n")).distinct().collect())  # few: lengths, not names

    def of(n: int) -> DataFrame:
        at = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1)))
        return texts.select("id", F.explode(F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("words", i, n), " ").alias("gram")))).alias("g")).select("id", "g.*")

    if not lengths:
        return texts.select("id", F.lit(1).alias("start"), F.lit(1).alias("n"), F.lit("").alias("gram")).limit(0)
    return reduce(DataFrame.unionByName, [of(n) for n in lengths]).join(grams, "gram").select("id", "start", "n", "gram")


def mentions(texts: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text", most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """(id, start, n, gram, entity): each occurrence of an alias (alias, entity) as whole words, from word ``start`` (1-based), n words.

    Aliases and texts are compared in lower case by their words, so punctuation between words is no matter. An alias of several
    entities gives a row for each; aliases without a word and null texts give none; repeated aliases count once.
    """
    named = aliases.select(F.array_join(words_of(F.col("alias")), " ").alias("gram"), "entity").where("gram <> ''").distinct()
    grams = named.select("gram").distinct()
    lines = texts.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    size = grams.agg(F.coalesce(F.sum(F.length("gram")), F.lit(0))).first()[0]
    if size <= most_shipped:
        found = _by_automaton(lines, sorted(r["gram"] for r in grams.collect()), texts.schema[id_col].dataType.simpleString())
    else:
        found = _by_join(lines, grams)
    return found.join(named, "gram").select("id", "start", "n", "gram", "entity")


#: Words that name a kind of artifact, layers and parts of an agent; of several the first counts.
ARTIFACTS = {
    "dna": ("dna", "cognitivo", "cognitive", "knowledge layer"),
    "dossier": ("dossier", "dossiê", "dossie", "profile", "perfil"),
    "playbook": ("playbook", "playbooks", "manual", "guia"),
    "agent": ("agent", "agente", "soul", "activation", "memory"),
    "source": ("source", "fonte", "transcript", "transcription"),
}
LAYERS = {
    "l1": "FILOSOFIAS", "l2": "MODELOS-MENTAIS", "l3": "HEURISTICAS", "l4": "FRAMEWORKS", "l5": "METODOLOGIAS", "filosofias": "FILOSOFIAS", "modelos-mentais": "MODELOS-MENTAIS",
    "modelos mentais": "MODELOS-MENTAIS", "heuristicas": "HEURISTICAS", "frameworks": "FRAMEWORKS", "metodologias": "METODOLOGIAS", "voice": "VOICE-DNA", "voice-dna": "VOICE-DNA",
}
AGENT_FILES = {"soul": "SOUL.md", "memory": "MEMORY.md", "activation": "ACTIVATION.yaml", "dna-config": "DNA-CONFIG.yaml", "config": "DNA-CONFIG.yaml"}


def _first_key(text: Column, keys, value=lambda k: k) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(value(k))) for k in keys))


def parsed_question(question: Column) -> Column:
    """Struct (artifact, layer, part): the kind of artifact a question asks for, the file's stem of a layer, and an agent's file.

    A layer alone means an artifact of dna, a part alone one of an agent. The name of a layer comes before its number.
    """
    low = F.trim(F.lower(question))
    kind = F.coalesce(*(F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(name)) for name, words in ARTIFACTS.items()))
    number = F.nullif(F.regexp_extract(low, r"\bl([1-5])\b", 1), F.lit(""))
    layer = F.coalesce(_first_key(low, LAYERS, LAYERS.get), *(F.when(number == k[1], F.lit(v)) for k, v in LAYERS.items() if k[0] == "l" and k[1:].isdigit()))
    part = _first_key(low, AGENT_FILES, AGENT_FILES.get)
    kind = F.coalesce(kind, F.when(layer.isNotNull(), "dna"), F.when(part.isNotNull(), "agent"))
    return F.struct(kind.alias("artifact"), layer.alias("layer"), part.alias("part"))


def resolved(questions: DataFrame, aliases: DataFrame, files: DataFrame, most: int = DIRECT_CHARS, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """(query_id, entity, artifact, place, path, text): the files that answer a question (query_id, query) by name alone.

    The longest alias in a question wins, of equal ones the first, of one alias' entities the smallest. Files (entity,
    artifact, place, path, text) of the asked artifact, or of all, come by place up to ``most`` characters. A layer or part
    cuts them to files of that name. Questions without a name or without a file have no rows.
    """
    found = mentions(questions, aliases, "query_id", "query", most_shipped)
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "start", "entity")).alias("b")).select(F.col("id").alias("query_id"), "b.entity")
    asked = questions.select("query_id", parsed_question(F.col("query")).alias("p")).select("query_id", "p.*").join(best, "query_id")
    held = files.select("entity", F.col("artifact").alias("of"), "place", "path", "text")
    name = F.element_at(F.split("path", "/"), -1)
    met = asked.join(held, "entity").where(F.col("artifact").isNull() | (F.col("of") == F.col("artifact")))
    by_layer = ~F.coalesce((F.col("artifact") == "dna") & F.col("layer").isNotNull(), F.lit(False)) | (F.regexp_replace(name, r"\.[^.]*$", "") == F.col("layer"))
    by_part = ~F.coalesce((F.col("artifact") == "agent") & F.col("part").isNotNull(), F.lit(False)) | (name == F.col("part"))
    fit = met.where(by_layer & by_part).select("query_id", "entity", F.col("of").alias("artifact"), "place", "path", "text")
    return bounded_files(fit, "query_id", "place", "text", most)


def _without(items: Column, chosen: Column) -> Column:
    return F.filter(items, lambda x: ~F.coalesce(F.lower(x) == F.lower(chosen), F.lit(False)))


def inferred(files: DataFrame, known: DataFrame) -> DataFrame:
    """Author, subject and verdict of files from what their names and contents say.

    ``files``: id, stem, persons, persons_in_parens and companies (arrays, from the name), speaker, speaker_confidence,
    subject, subject_mentions and content_entities (from the content), bucket_hint, bucket_confidence, internal (boolean),
    forced_author, forced_subject. ``known``: names of known experts.

    The author is a speaker of high or medium confidence, else the first person of the name who is a known expert, those in
    parentheses first, else the first person. The subject is one that the content mentions three times, else the first
    company that the content knows, else the last that stands once in the name, else the first. What is known from both
    sides is routed with high confidence, from the name alone with medium, one of the two is reviewed, none is blocked;
    a known expert, hints in the content and an internal party raise that, a forced name decides all.
    """
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("persons", "persons_in_parens", "companies", "content_entities")}
    base = files.withColumns(lists)
    names = base.select("id", F.posexplode(F.array_distinct(F.concat("persons_in_parens", F.filter("persons", lambda p: ~F.array_contains(F.col("persons_in_parens"), p))))).alias("at", "name"))
    experts = names.join(known.select(F.lower("name").alias("_low")).distinct(), F.lower("name") == F.col("_low"), "left_semi")
    found = experts.groupBy("id").agg(F.min(F.struct("at", "name")).alias("e")).select("id", F.col("e.name").alias("expert"))
    low = F.lower("stem")
    counted = F.transform("companies", lambda c: F.struct(c.alias("name"), F.regexp_count(low, F.concat(F.lit(r"\b\Q"), F.lower(c), F.lit(r"\E\b"))).alias("n")))
    sure = F.coalesce(F.col("speaker").isNotNull() & F.col("speaker_confidence").isin("high", "medium"), F.lit(False))
    heard = F.coalesce(F.col("subject").isNotNull() & (F.col("subject_mentions") >= 3), F.lit(False))
    rows = base.join(found, "id", "left").withColumn("_counted", counted)
    in_content = F.filter("companies", lambda c: F.array_contains(F.transform("content_entities", F.lower), F.lower(c)))
    once = F.filter("_counted", lambda c: c["n"] == 1)
    more = F.filter("_counted", lambda c: c["n"] > 1)
    by_name = F.coalesce(F.get(in_content, F.lit(0)), F.try_element_at(once, F.lit(-1))["name"], F.get(more, F.lit(0))["name"], F.get("companies", F.lit(0)))
    rows = rows.withColumns({"author": F.when(sure, F.col("speaker")).otherwise(F.coalesce("expert", F.get("persons", F.lit(0)))), "about": F.when(heard, F.col("subject")).otherwise(by_name), "by_expert": ~sure & F.col("expert").isNotNull()})
    both, one = F.col("author").isNotNull() & F.col("about").isNotNull(), F.col("author").isNotNull() | F.col("about").isNotNull()
    confirmed = F.coalesce(F.col("speaker").isNotNull() & (F.col("speaker_confidence") == "high"), F.lit(False)) | F.col("subject").isNotNull()
    level = F.when(both & confirmed, "high").when(both, "medium").otherwise("low")
    verdict = F.when(both, "ROUTE").when(one, "REVIEW").otherwise("BLOCK")
    rows = rows.withColumns({"confidence": level, "verdict": verdict})
    rows = rows.withColumns({"verdict": F.when(F.col("by_expert") & (F.col("confidence") == "low"), "ROUTE").otherwise(F.col("verdict")), "confidence": F.when(F.col("by_expert") & (F.col("confidence") == "low"), "medium").otherwise(F.col("confidence"))})
    hinted = F.coalesce(F.col("bucket_confidence").isin("high", "medium"), F.lit(False)) & (F.col("confidence") == "low")
    rows = rows.withColumns({"verdict": F.when(hinted & (F.col("verdict") == "BLOCK") & F.coalesce(F.col("bucket_hint") == "business", F.lit(False)), "REVIEW").otherwise(F.col("verdict")), "confidence": F.when(hinted, "medium").otherwise(F.col("confidence"))})
    inside = F.coalesce(F.col("internal"), F.lit(False))
    rows = rows.withColumns({"verdict": F.when(inside & (F.col("verdict") == "BLOCK"), "ROUTE").otherwise(F.col("verdict")), "confidence": F.when(inside & (F.col("confidence") == "low"), "medium").otherwise(F.col("confidence"))})
    forced = F.col("forced_author").isNotNull() | F.col("forced_subject").isNotNull()
    others = F.concat(_without(F.col("companies"), F.col("about")), _without(F.col("persons"), F.col("author")))
    rows = rows.withColumn("_others", others).withColumnRenamed("author", "_author")
    return rows.select(
        "id", F.coalesce("forced_author", "_author").alias("author"), F.coalesce("forced_subject", "about").alias("subject"), F.col("_others").alias("cross_references"),
        F.when(forced, "high").otherwise(F.col("confidence")).alias("confidence"), F.when(forced, "ROUTE").otherwise(F.col("verdict")).alias("verdict"),
    )
