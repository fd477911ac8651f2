"""Text detection by rule tables: ordered patterns, keyword votes, additive scores, contradictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as T

#: Pairs of words that contradict each other, in order of precedence.
ANTONYMS = (
    ("NUNCA", "SEMPRE"),
    ("PROIBIDO", "OBRIGATORIO"),
    ("IMPOSSIVEL", "POSSIVEL"),
    ("NAO DEVE", "DEVE"),
    ("ELIMINAR", "PRESERVAR"),
    ("AUMENTAR", "REDUZIR"),
    ("ACELERAR", "DESACELERAR"),
    ("SIMPLIFICAR", "COMPLEXIFICAR"),
    ("JAMAIS", "SEMPRE"),
    ("NUNCA", "OBRIGATORIO"),
    ("PROIBIDO", "DEVE"),
)
#: Patterns of question intents, first match wins.
INTENTS = {
    "greeting": (r"^(?:oi|ola|hey|hi|hello|bom dia|boa tarde|boa noite)", r"^(?:como vai|tudo bem|e ai)"),
    "meta": (r"(?:quem|who).*(?:voce|you|sou|am)", r"(?:o que|what).*(?:voce faz|you do|consegue|can you)", r"(?:help|ajuda|como funciona|how.*work)"),
    "factual_simple": (r"^(?:qual|what|quanto|how much|quando|when).*\?$", r"(?:defina|define|o que [eé]|what is)", r"(?:me diga|tell me).*(?:numero|number|taxa|rate|percentual|percent)"),
    "factual_complex": (r"(?:compare|comparar|diferenca|difference|versus|vs\.?)", r"(?:lista|list|quais|which).*(?:todos|all|principais|main)", r"(?:explique|explain|detalhe|detail|aprofunde|deep dive)"),
    "analytical": (r"(?:por que|why|como|how).*(?:funciona|works|deveria|should)", r"(?:estrategia|strategy|plano|plan|recomend|recommend)", r"(?:melhor|best|ideal|otim|optim)"),
    "cross_expert": (r"(?:o que|what).*(?:todos|all|experts?|especialistas)", r"(?:consenso|consensus|concordam|agree|divergem|disagree)", r"(?:quem mais|who else|outros|other).*(?:fala|says|pensa|thinks)"),
    "hierarchical": (r"(?:trace|rastrear|caminho|path|hierarquia|hierarchy)", r"(?:da filosofia|from philosophy).*(?:metodologia|methodology)", r"(?:dna|cognitiv).*(?:cascade|cascata)"),
}
SHORT_QUERY_WORDS = 5


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def first_match(text: Column, rules: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    """Name of the first rule of which any pattern is found."""
    out = None
    for name, patterns in rules.items():
        out = F.when(any_of(text, patterns), name) if out is None else out.when(any_of(text, patterns), name)
    return out.otherwise(otherwise)


def intent(query: Column) -> Column:
    q = F.trim(F.lower(query))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    return first_match(q, INTENTS, F.when(words <= SHORT_QUERY_WORDS, "factual_simple").otherwise("analytical"))


def pipeline_of(intent_name: Column) -> Column:
    """The retrieval pipeline that serves an intent."""
    table = {"greeting": "none", "meta": "none", "factual_simple": "bm25", "factual_complex": "hybrid", "analytical": "hybrid_graph", "cross_expert": "hybrid_graph", "hierarchical": "full"}
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), intent_name)


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """Number of patterns that are found."""
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns))


def most_hits(text: Column, table: dict[str, tuple[str, ...]], default: str) -> Column:
    """The category with most hits, the first of equals; the default without any."""
    options = F.array(*(F.struct(hits(text, p).alias("n"), F.lit(-i).alias("first"), F.lit(k).alias("name")) for i, (k, p) in enumerate(table.items())))
    best = F.array_max(options)
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def vote_confidence(text: Column, table: dict[str, tuple[str, ...]], otherwise: str = "all") -> Column:
    """(name, confidence): most hits over all hits; a tie at the top or no hit gives ``otherwise``."""
    counts = {k: hits(text, p) for k, p in table.items()}
    total = reduce(lambda a, b: a + b, counts.values())
    top = F.greatest(*counts.values())
    at_top = reduce(lambda a, b: a + b, ((c == top).cast("int") for c in counts.values()))
    name = reduce(lambda out, kv: F.when(kv[1] == top, kv[0]).otherwise(out), list(counts.items())[::-1], F.lit(otherwise))
    clear = (top > 0) & (at_top == 1)
    return F.struct(F.when(clear, name).otherwise(otherwise).alias("name"), F.round(F.when(clear, top / total).otherwise(0.0), 3).alias("confidence"))


def additive(signals: dict[str, tuple[Column, float]]) -> Column:
    """Sum of the weights of the signals that hold."""
    return reduce(lambda a, b: a + b, (F.when(on, F.lit(float(w))).otherwise(0.0) for on, w in signals.values()))


def meeting_score(organiser: Column, attendees: Column, title: Column, description: Column, domains: list[str], names: list[str], words: list[str]) -> Column:
    """3 for the organiser's domain, 2 for each attendee's, 2 for a company name in the title, 1 for a business word."""
    of = lambda email: F.substring_index(F.lower(email), "@", -1).isin(*domains)
    inside = F.size(F.filter(F.coalesce(attendees, F.array().cast("array<string>")), lambda e: F.coalesce(of(e), F.lit(False))))
    both = F.lower(F.concat_ws(" ", title, description))
    has = lambda text, any_: reduce(lambda a, b: a | b, (F.contains(text, F.lit(w.lower())) for w in any_))
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return flag(of(organiser), 3) + 2 * inside + flag(has(F.lower(title), names), 2) + flag(has(both, words), 1)


def contradictions(insights: DataFrame, group: str, id_col: str, text_col: str, pairs: tuple[tuple[str, str], ...] = ANTONYMS) -> DataFrame:
    """(group, a, b, pair): two insights of a group of which one has a word and the other its opposite; the first pair wins.

    Only insights with such words are joined, on group and pair; the test is containment in upper case.
    """
    upper = F.upper(F.col(text_col))
    sides = [F.when(F.contains(upper, F.lit(w)), F.struct(F.lit(i).alias("pair"), F.lit(s).alias("side"))) for i, p in enumerate(pairs) for s, w in enumerate(p)]
    found = insights.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*sides))).alias("x"))
    left, right = found.where("x.side = 0").alias("l"), found.where("x.side = 1").alias("r")
    met = left.join(right, (F.col("l.g") == F.col("r.g")) & (F.col("l.x.pair") == F.col("r.x.pair")) & (F.col("l.id") != F.col("r.id")))
    both = met.select(F.col("l.g").alias(group), F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), F.col("l.x.pair").alias("pair"))
    return both.groupBy(group, "a", "b").agg(F.min("pair").alias("pair")).withColumn("contradiction_id", T.pair_id(F.col(group).cast("string"), F.col("a").cast("string"), F.col("b").cast("string")))


def contradiction_sides(insights: DataFrame, group: str, id_col: str, text_col: str, pairs: tuple[tuple[str, str], ...] = ANTONYMS) -> DataFrame:
    """(group, pair, id, side, opposites): the insights with a word (side 0) or its opposite (side 1) that others of the group contradict.

    Any two insights of a group and pair on different sides are one of ``contradictions``; rows grow with the insights, not with their square.
    """
    upper = F.upper(F.col(text_col))
    sides = [F.struct(F.lit(i).alias("pair"), F.contains(upper, F.lit(x)).alias("x"), F.contains(upper, F.lit(y)).alias("y")) for i, (x, y) in enumerate(pairs)]
    met = insights.select(F.col(group), F.col(id_col), F.explode(F.filter(F.array(*sides), lambda p: p["x"] | p["y"])).alias("p"))
    one = met.dropna(subset=[group, id_col]).groupBy(group, id_col, "p.pair").agg(F.max("p.x").cast("int").alias("x"), F.max("p.y").cast("int").alias("y"))
    total = one.groupBy(group, "pair").agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("on"), (F.col("ny") - F.col("y")).alias("n")), F.struct(F.lit(1).alias("side"), F.col("y").alias("on"), (F.col("nx") - F.col("x")).alias("n")))
    rows = one.join(total, [group, "pair"]).select(group, "pair", id_col, F.explode(both).alias("s")).where("s.on = 1 AND s.n > 0")
    return rows.select(group, "pair", id_col, F.col("s.side").alias("side"), F.col("s.n").alias("opposites"))


def conflict_type(markers: Column) -> Column:
    return F.when(markers == 0, "complementary").when(markers <= 2, "divergent").otherwise("contradictory")


def negated_near(text: Column, keyword: str, negations: tuple[str, ...], within: int = 80) -> Column:
    """Whether a negation stands at most ``within`` characters before the keyword."""
    words = "|".join(negations)
    return F.lower(text).rlike(rf"(?s)\b(?:{words})\b.{{0,{within}}}\b{keyword.lower()}")


def mention_kind(window: Column, active: tuple[str, ...], passive: tuple[str, ...]) -> Column:
    return F.when(any_of(F.lower(window), active), "active").when(any_of(F.lower(window), passive), "passive").otherwise("ambiguous")


def traceable_paragraph(text: Column) -> Column:
    """Long enough, and no heading, quote, rule or table line."""
    t = F.trim(text)
    return (F.length(t) >= 30) & ~t.rlike(r"^(#|>|\||---|===|\*\*\*)")


def staging_path(path: Column, names: tuple[str, ...] = ("_unclassified", "unclassified", "misc")) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*(F.lit(n) for n in names)))


def priority_at_least(priority: Column, floor: str) -> Column:
    """HIGH above MEDIUM above LOW; a missing one counts as MEDIUM."""
    rank = F.create_map(*(F.lit(x) for kv in (("HIGH", 3), ("MEDIUM", 2), ("LOW", 1)) for x in kv))
    return F.coalesce(F.element_at(rank, F.upper(F.coalesce(priority, F.lit("MEDIUM")))), F.lit(2)) >= {"HIGH": 3, "MEDIUM": 2, "LOW": 1}[floor]
