"""Relevance of chunks and sections, claims and their sources, costs, merges of settings, and checks of plans."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections that count for more and for less, boilerplate, and words of each domain.
HIGH_SECTIONS = (
    "framework", "frameworks", "heuristic", "heuristicas", "heuristics", "model", "modelos", "models", "metodologia", "metodologias", "methodology", "filosofia", "filosofias",
    "philosophy", "strategy", "estrategia", "principle", "principio", "decision", "decisao", "insight", "playbook", "dna", "soul", "cognitive",
)
LOW_SECTIONS = ("changelog", "references", "credits", "license", "acknowledgment", "table of contents", "toc", "index", "metadata", "config", "version", "appendix")
FILLERS = (r"(?m)^[-=_*]{3,}$", r"(?m)^\s*\|.*\|.*\|\s*$", r"(?m)^\s*#{1,6}\s*$", r"https?://\S+", r"(?m)^\s*-\s*$")
DOMAIN_WORDS = {
    "sales": "offer close commission objection pipeline lead prospect deal revenue conversion upsell pricing discount negotiation value equation guarantee",
    "marketing": "campaign funnel copy headline ctr conversion audience targeting creative brand content ads traffic landing page email sequence",
    "engineering": "architecture code deploy pipeline test api database schema index query performance debug refactor module service function class",
    "management": "team hire fire culture kpi okr meeting decision strategy leadership delegation accountability performance review feedback onboarding",
}
#: Marks of an answer that keeps facts, advice and guesses apart, and of a source.
MARKERS = ("FATOS", "RECOMENDACAO", "RECOMENDAÇÃO", "HIPOTESE", "HIPÓTESE", "[FONTE:")
SOURCE_MARK = r"\[FONTE:[^\]]+\]"
INPUT_SHARE = 0.6


def _any_within(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def keyword_density(text: Column, domain: str) -> Column:
    """0.2 and 5.3 times the share of a domain's words, 1 at most; 0.5 for an unknown domain and 0 without words."""
    low = domain.lower()
    known = sorted({w for d, words in DOMAIN_WORDS.items() if d in low or low in d for w in words.split()})
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ɏ]{3,}"), F.lit(0))
    share = F.size(F.filter(words, lambda w: w.isin(known))) / F.size(words)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.2 + share * 5.3) if known else F.lit(0.5))


def section_signal(section: Column) -> Column:
    low = F.lower(section)
    return F.when(F.coalesce(section, F.lit("")) == "", 0.5).when(_any_within(low, HIGH_SECTIONS), 1.0).when(_any_within(low, LOW_SECTIONS), 0.1).otherwise(0.5)


def filler_share(text: Column) -> Column:
    """1 less twice the share of boilerplate characters; 0 for an empty text."""
    chars = sum((F.aggregate(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lit(0), lambda s, m: s + F.length(m)) for p in FILLERS), F.lit(0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - chars / F.length(text) * 2.0))


def length_signal(text: Column) -> Column:
    n = F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(n < 50, 0.1).when(n < 150, 0.4).when(n < 300, 0.7).otherwise(1.0)


def chunk_relevance(text: Column, section: Column, domain: str = "") -> Column:
    """0 to 1: words of the domain 35 %, section 30 %, little boilerplate 20 %, length 15 %."""
    whole = keyword_density(text, domain) * 0.35 + section_signal(section) * 0.30 + filler_share(text) * 0.20 + length_signal(text) * 0.15
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), whole)), 4)


def section_relevance(title: Column, content: Column, size: Column, priority: tuple[str, ...], low: tuple[str, ...], domains: Mapping[str, tuple[float, tuple[str, ...]]], tokens: tuple[str, ...]) -> Column:
    """2 for a section of the first kind, -1 for one of the second, each domain's score where title or head names it, 0.5 a query word in the title, -0.3 above 10 KB."""
    name, head = F.lower(title), F.lower(F.substring(content, 1, 2000))
    score = F.when(_any_within(name, tuple(p.lower() for p in priority)), 2.0).otherwise(0.0)
    score = score - F.when(title.rlike("(?i)" + "|".join(low)), 1.0).otherwise(0.0)
    for weight, words in domains.values():
        score = score + F.when(_any_within(name, words) | _any_within(head, words), weight).otherwise(0.0)
    for t in tokens:
        if len(t) > 2:
            score = score + F.contains(name, F.lit(t)).cast("int") * 0.5
    return score - F.when(size > 10240, 0.3).otherwise(0.0)


def epistemic_check(text: Column, critical: tuple[str, ...]) -> Column:
    """Struct (is_critical, has_markers, sources, missing, valid): a critical claim needs a marker, a section of facts a source."""
    is_critical, marked = _any_within(F.upper(text), critical), _any_within(text, MARKERS)
    sources = F.regexp_count(text, F.lit(SOURCE_MARK))
    missing = F.array_compact(F.array(F.when(is_critical & ~marked, "missing_critical_marker"), F.when(marked & F.contains(text, F.lit("## FATOS")) & (sources == 0), "fatos_section_without_fonte_citation")))
    given = F.coalesce(text, F.lit("")) != ""
    none = F.array().cast("array<string>")
    return F.struct(
        (given & is_critical).alias("is_critical"), (given & marked).alias("has_markers"), F.when(given, sources).otherwise(0).alias("sources"),
        F.when(given, missing).otherwise(none).alias("missing"), (~given | (F.size(missing) == 0)).alias("valid"),
    )


def clock_text(value: Column) -> Column:
    """Seconds, or milliseconds above a day's seconds, as HH:MM:SS; what is no number stays as it is."""
    number = value.cast("string").try_cast("double")
    s = F.when(number > 86400, number / 1000).otherwise(number)
    whole = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), F.floor(s % 60).cast("long"))
    return F.coalesce(F.when(s.isNotNull(), whole), value.cast("string"))


def age_seconds(iso: Column, now: Column) -> Column:
    """Seconds since an ISO time, in UTC where it names no zone; 0 where it is missing or none."""
    at = F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(F.replace(iso, F.lit("T"), F.lit(" "))))
    return F.coalesce((F.unix_micros(now) - F.unix_micros(at)) / 1e6, F.lit(0.0))


def merged_settings(levels: DataFrame, key: str = "key", value: str = "value", level: str = "level") -> DataFrame:
    """One value per flattened key: that of the highest level which sets it, with the level."""
    best = levels.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(F.struct(level, value)).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), F.col(f"b.{level}").alias(level))


def theme_relevance(occurrences: Column, sources: Column, roles: Column, domains: Column, cross_source: float = 3.0, framework: float = 2.0, methodology: float = 2.0) -> Column:
    """Occurrences, and a bonus for each further source, each role and each further domain."""
    return F.round(occurrences + F.greatest(sources - 1, F.lit(0)) * cross_source + roles * framework + F.greatest(domains - 1, F.lit(0)) * methodology, 2)


def viability(scores: tuple[Column, Column, Column, Column, Column], weights: tuple[float, ...] = (1.0, 0.9, 0.8, 0.9, 0.8), go: float = 7.0, conditional: float = 5.0) -> Column:
    """Struct (score, decision): the weighted mean of availability, clarity, evolution, expertise and fit."""
    score = F.round(sum((s * w for s, w in zip(scores, weights)), F.lit(0.0)) / sum(weights), 2)
    return F.struct(score.alias("score"), F.when(score >= go, "GO").when(score >= conditional, "CONDITIONAL").otherwise("NO-GO").alias("decision"))


def plan_cost(nodes: DataFrame, prices: DataFrame, plan: str = "plan", share: float = INPUT_SHARE) -> DataFrame:
    """Dollars of each plan: its nodes' thousands of tokens (model, tokens) by the prices (model, p_in, p_out), rounded to cents."""
    cost = (F.col("tokens") * share * F.col("p_in") + F.col("tokens") * (1 - share) * F.col("p_out")) / 1000
    return nodes.join(prices, "model", "left").groupBy(plan).agg(F.count("*").alias("nodes"), F.round(F.sum(F.coalesce(cost, F.lit(0.0))), 2).alias("cost"))


def group_layers(members: DataFrame, levels: DataFrame, group: str = "group") -> DataFrame:
    """Groups (group, id) whose nodes do not all stand on the level of their first one, with the odd ones' number."""
    met = members.join(levels, "id")
    first = met.groupBy(group).agg(F.min(F.struct("id", "level")).alias("f"))
    return met.join(first, group).where(F.col("level") != F.col("f.level")).groupBy(group).agg(F.count("*").alias("odd"))


def compacted(chunks: DataFrame, group: str, order: list[Column], tokens: str, short: str, budget: int) -> DataFrame:
    """Chunks are cut to their summaries, in ``order``, while the total is above the budget; those a summary does not shorten are skipped.

    Adds is_cut. A group's chunks are those of one prompt.
    """
    saving = F.greatest(F.col(tokens) - F.col(short), F.lit(0))
    total = F.sum(tokens).over(Window.partitionBy(group))
    before = F.coalesce(F.sum(saving).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("is_cut", (saving > 0) & (total - before > budget))


def cross_source_conflicts(rows: DataFrame, pairs: tuple[tuple[str, str], ...], domain: str = "domain", expert: str = "expert", text: str = "text") -> DataFrame:
    """Experts of one domain of whom one has the first word and another the second: (domain, pair, a, b, n_a, n_b).

    Experts are counted by side first, so rows never meet rows.
    """
    sides = F.array(*(F.struct(F.lit(i).alias("pair"), F.contains(F.upper(text), F.lit(x)).alias("x"), F.contains(F.upper(text), F.lit(y)).alias("y")) for i, (x, y) in enumerate(pairs)))
    each = rows.select(domain, expert, F.explode(sides).alias("s")).groupBy(domain, expert, "s.pair").agg(F.count_if("s.x").alias("nx"), F.count_if("s.y").alias("ny"))
    left = each.where("nx > 0").select(domain, "pair", F.col(expert).alias("a"), F.col("nx").alias("n_a"))
    right = each.where("ny > 0").select(domain, "pair", F.col(expert).alias("b"), F.col("ny").alias("n_b"))
    return left.join(right, [domain, "pair"]).where("a <> b")


def replay(*logs: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows of several logs by key and time; columns that a log lacks are null."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (log.withColumn("log", F.lit(i)) for i, log in enumerate(logs)))
    return whole.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(ts, "log")))


def preselected(index: DataFrame, words: tuple[str, ...], preferred: tuple[str, ...], k: int = 24) -> DataFrame:
    """The k capabilities (key, name, squad, path) with preferred ones first, then by how many words of four letters they hold."""
    where = F.lower(F.concat_ws(" ", "name", "squad", "path"))
    score = sum((F.contains(where, F.lit(w.lower())).cast("int") for w in words if len(w) >= 4), F.lit(0))
    pinned = F.col("key").isin(*preferred) if preferred else F.lit(False)
    scored = index.withColumns({"score": score, "pinned": pinned}).where("pinned OR score > 0")
    return scored.orderBy(F.col("pinned").desc(), F.col("score").desc(), "key").limit(k)


def grounding_pack(chunks: DataFrame, query: str = "query_id", rank: str = "rank", text: str = "text", k: int = 8, most_chars: int = 1200) -> DataFrame:
    """The first k chunks of each query that hold text, cut to ``most_chars``."""
    order = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    full = chunks.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("place", order).where(F.col("place") <= k)
    return full.select(query, "place", F.substring(text, 1, most_chars).alias("excerpt"))
