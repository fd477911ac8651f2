"""Normalising records of several shapes, and patterns of organisations, businesses and procedures in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as T

#: Intents and the characters of memory that they are given.
MEMORY_BUDGET = {"greeting": 0, "meta": 2000, "factual_simple": 4000, "factual_complex": 8000, "analytical": 12000, "cross_expert": 12000, "hierarchical": 8000}
REPORTS_TO = r"(?:the )?([a-z][a-z ]{2,30}?) (?:reports? to|answers? to) (?:the )?([a-z][a-z ]{2,30}?)(?=[.,;]|$| and )"
MANAGES = r"(?:the )?([a-z][a-z ]{2,30}?) (?:manages?|leads?|runs?) (?:the )?([a-z][a-z ]{2,30}?)(?=[.,;]|$| and )"
TEAM = r"team of ([0-9]+)"
LARGEST_TEAM = 100_000
REVENUE = r"\$ ?([0-9][0-9,.]*) ?(k|m|b|thousand|million|billion)?\b"
STEP = r"(?im)^\s*(?:step )?[0-9]+[.):]\s+\S"


def first_of(raw: Column, *paths: str) -> Column:
    """The first of several fields of a JSON text that is there and not blank."""
    found = [F.get_json_object(raw, f"$.{p}") for p in paths]
    return F.coalesce(*(F.when(F.trim(f) != "", f) for f in found))


def normalised_insights(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """(insight_id, text, speaker, priority, confidence) of JSON records whose fields go by several names.

    The evidence follows the text on its own line.
    """
    j = F.col(raw)
    evidence = first_of(j, "evidence", "quote")
    text = F.concat_ws("\n", first_of(j, "summary", "insight", "text"), evidence)
    return rows.select(
        first_of(j, "id", "insight_id", "chunk_id").alias("insight_id"), text.alias("text"), first_of(j, "person", "speaker", "source_person").alias("speaker"),
        F.upper(F.coalesce(first_of(j, "priority"), F.lit("MEDIUM"))).alias("priority"), first_of(j, "confidence", "score").try_cast("double").alias("confidence"),
    )


def record_format(raw: Column) -> Column:
    """Which known shape a JSON record has, by the keys that it holds, tested in order."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    return F.when(has("themes") & has("roles"), "ah").when(has("theme_tags"), "cg").when(has("topics"), "rag").when(has("subjects"), "ss").otherwise("unknown")


def themes(raw: Column) -> Column:
    """Distinct lower-cased themes of a record of any shape."""
    arrays = [F.coalesce(F.from_json(F.get_json_object(raw, f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("themes", "theme_tags", "topics", "subjects")]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*arrays), lambda t: F.lower(F.trim(t)))))


def organisation(texts: DataFrame, roles: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, relation, upper, lower): who reports to or manages whom, kept where either side is a known role."""
    low = F.lower(F.col(text_col))
    pairs = lambda p, rel, up, down: texts.select(F.col(id_col).alias("id"), F.lit(rel).alias("relation"), F.explode(F.arrays_zip(F.regexp_extract_all(low, F.lit(p), F.lit(up)).alias("u"), F.regexp_extract_all(low, F.lit(p), F.lit(down)).alias("d"))).alias("x"))
    both = pairs(REPORTS_TO, "reports_to", 2, 1).union(pairs(MANAGES, "manages", 1, 2)).select("id", "relation", F.trim("x.u").alias("upper"), F.trim("x.d").alias("lower"))
    return both.where(F.col("upper").isin(*roles) | F.col("lower").isin(*roles)).distinct()


def business_facts(texts: DataFrame, departments: dict[str, str], id_col: str = "doc_id", text_col: str = "text", largest: int | None = LARGEST_TEAM) -> DataFrame:
    """Departments by alias, the largest team of 1 to ``largest`` (None: any size), and the largest amount above 100.

    Numbers are read whole; teams beyond 32 bits are no teams.
    """
    low = F.lower(F.col(text_col))
    named = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(low.rlike(rf"\b{a}\b"), F.lit(d)) for a, d in departments.items())))))
    sizes = F.filter(F.transform(F.regexp_extract_all(low, F.lit(TEAM), F.lit(1)), lambda s: s.try_cast("int")), lambda n: (n >= 1) & (n <= largest if largest is not None else F.lit(True)))
    unit = lambda u: F.when(u.startswith("k") | u.startswith("t"), 1e3).when(u.startswith("m"), 1e6).when(u.startswith("b"), 1e9).otherwise(1.0)
    money = F.arrays_zip(F.regexp_extract_all(low, F.lit(REVENUE), F.lit(1)).alias("n"), F.regexp_extract_all(low, F.lit(REVENUE), F.lit(2)).alias("u"))
    amounts = F.filter(F.transform(money, lambda m: F.regexp_replace(F.regexp_replace(m["n"], ",", ""), r"\.$", "").try_cast("double") * unit(m["u"])), lambda a: a > 100)
    return texts.select(F.col(id_col).alias("id"), named.alias("departments"), F.array_max(sizes).alias("team"), F.array_max(amounts).alias("amount"))


def procedure_score(text: Column) -> Column:
    """0 to 100: ten a numbered step, five an imperative line, ten for words of procedure; at least two steps count."""
    steps = F.regexp_count(text, F.lit(STEP))
    imperative = F.regexp_count(text, F.lit(r"(?m)^\s*[-*] (?:always|never|check|send|open|write|call|ask|review|create|update)\b"))
    words = F.lower(text).rlike(r"\b(procedure|process|checklist|workflow|protocol|playbook)\b").cast("int")
    return F.when(steps >= 2, F.least(F.lit(100), 10 * steps + 5 * imperative + 10 * words)).otherwise(0)


def parse_filters(raw: str | None) -> dict[str, str]:
    """``k=v,k2=v2`` as a map; parts without a key or an equals sign are ignored."""
    pairs = (p.partition("=") for p in (raw or "").split(","))
    return {k.strip(): v.strip() for k, sep, v in pairs if sep and k.strip()}


def memory_budget(intent: Column) -> Column:
    """Characters of memory for an intent: 70 % the agent's own, the rest shared."""
    total = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MEMORY_BUDGET.items() for x in kv)), intent), F.lit(4000))
    own = F.floor(total * 0.7).cast("int")
    return F.struct(total.alias("total"), own.alias("own"), (total - own).alias("shared"))


def gate(answers: DataFrame, external: Column, floor: float = 0.6) -> DataFrame:
    """Verdict on answers (faithfulness): trusted from the floor on, else by an external score, else blocked."""
    return answers.withColumn("verdict", F.when(F.col("faithfulness") >= floor, "pass").when(external >= floor, "pass_external").otherwise("blocked"))


def speculative(sentence: Column) -> Column:
    return F.lower(sentence).rlike(r"\b(may|might|could|perhaps|possibly|talvez|provavelmente)\b")


def faithfulness(answers: DataFrame, chunks: DataFrame, least_chars: int = 20, floor: float = 0.5) -> DataFrame:
    """(answer_id, faithfulness, verdict): share of claims that any chunk of the answer supports; no claim is faithful.

    Claims meet chunks of their answer's retrieval, on its id.
    """
    claims = answers.select("answer_id", F.posexplode(F.filter(T.sentences(F.col("text")), lambda s: (F.length(s) >= least_chars) & ~s.endswith("?") & ~speculative(s))).alias("n", "claim"))
    key = claims.withColumn("k", F.array_distinct(F.filter(T.tokens(F.col("claim")), lambda t: F.length(t) >= 4)))
    met = key.join(chunks.select("answer_id", T.tokens(F.col("chunk")).alias("w")), "answer_id", "left")
    share = F.when(F.size("k") == 0, 1.0).otherwise(F.coalesce(F.size(F.array_intersect("k", "w")) / F.size("k"), F.lit(0.0)))
    best = met.groupBy("answer_id", "n").agg(F.max(share).alias("s"))
    scored = best.groupBy("answer_id").agg(F.round(F.avg((F.col("s") >= floor).cast("int")), 3).alias("f"))
    out = answers.select("answer_id").join(scored, "answer_id", "left").select("answer_id", F.coalesce("f", F.lit(1.0)).alias("faithfulness"))
    return out.withColumn("verdict", F.when(F.col("faithfulness") >= 0.9, "faithful").when(F.col("faithfulness") >= 0.6, "partial").otherwise("unfaithful"))


def inbox(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Files (path) with their folder, name and kind by extension; hidden and partial ones are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), ext), F.lit("unknown"))
    return files.where(~name.rlike(r"^[._~]|\.(tmp|part|crdownload)$")).select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), name.alias("name"), kind.alias("kind"))
