"""Sectioned reports of a review as typed rows, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings of the sections and the criteria they score, verdicts and their least totals.
SECTIONS = {
    "[PREMISE AUDIT]": "premissas_declaradas",
    "[EVIDENCE CHAIN]": "evidencias_rastreaveis",
    "[LOGIC GAPS]": "logica_consistente",
    "[ALTERNATIVE SCENARIOS]": "cenarios_alternativos",
    "[VERDICT + SCORE]": "conflitos_resolvidos",
}
APPROVE, REVISE, REJECT = "APROVAR", "REVISAR", "REJEITAR"
APPROVE_FROM, REVISE_FROM = 70, 50
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _after(text: Column, labels: str) -> Column:
    """What follows a label on its line, or on the next where the line ends there; null without one."""
    pattern = rf"(?dU)(?:{labels}):\s*(.+)"
    return F.when(text.rlike(pattern), _strip(F.regexp_extract(text, pattern, 1)))


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def _score(part: Column) -> Column:
    stated = F.when(part.rlike(r"\d+/20"), _number(part, r"(\d+)/20")).otherwise(_number(part, r"(?U)Score:\s*(\d+)"))
    return F.coalesce(stated, F.lit(0).cast("long"))


def section(text: Column, heading: str) -> Column:
    """The text from a heading's first place to the next of the other headings; empty without it."""
    rest = F.substring(text, F.locate(heading, text) + len(heading), F.length(text))
    ends = [F.when(F.locate(h, rest) > 0, F.locate(h, rest)) for h in SECTIONS if h != heading]
    end = F.coalesce(F.array_min(F.array(*ends)), F.length(rest) + 1)
    return F.when(F.locate(heading, text) > 0, _strip(F.substring(rest, F.lit(1), end - 1))).otherwise("")


def _justification(text: Column) -> Column:
    lines = F.transform(F.split(text, LINE_END), _strip)
    other = F.filter(lines, lambda line: (line != "") & ~line.rlike(r"^\d+/20") & ~line.startswith("Score:"))
    return F.coalesce(_after(text, "Justificativa|Justification"), F.get(other, F.lit(0)), F.lit(""))


def criteria(reviews: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, criterion, score, justification, feedback, refs): five rows a review.

    The score is ``n/20`` or ``Score: n``, 0 without either or beyond a long; the justification what its label says, else the first other line;
    refs are marks such as [AB-001-015], in order, repeats kept. A missing section, a null or an empty text gives a score of 0 and
    empty values; rows of equal keys give five rows each.
    """
    held = reviews.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))
    parts = held.select("_k", F.explode(F.array(*(F.struct(F.lit(name).alias("criterion"), section(F.col("_t"), heading).alias("part")) for heading, name in SECTIONS.items()))).alias("s"))
    part = F.col("s.part")
    return parts.select(
        F.col("_k").alias(key),
        F.col("s.criterion").alias("criterion"),
        _score(part).alias("score"),
        _justification(part).alias("justification"),
        F.coalesce(_after(part, "Actionable Feedback|Acao|Action|Feedback"), F.lit("")).alias("feedback"),
        F.regexp_extract_all(part, F.lit(r"\[([A-Z]+-\d+(?:-\d+)?)\]"), F.lit(1)).alias("refs"),
    )


def _gaps(text: Column) -> Column:
    """Items of the first numbered list that follows a line with ``Gaps``."""
    rest = F.get(F.split(text, r"(?dU)Gaps.*\n(?=\s*\d+\..)", 2), F.lit(1))
    lines = F.filter(F.transform(F.split(rest, "\n"), _strip), lambda line: line != "")
    listed = F.transform(lines, lambda line: line.rlike(r"(?d)^\d+\..+"))
    stop = F.array_position(listed, F.lit(False)).cast("int")
    own = F.slice(lines, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(lines)))
    items = F.filter(own, lambda line: line.rlike(r"(?dU)^\d+\.\s+.+$"))
    return F.coalesce(F.transform(items, lambda line: _strip(F.regexp_replace(line, r"(?U)^\d+\.\s+", ""))), F.array().cast("array<string>"))


def verdicts(reviews: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, evaluated, total, verdict, gaps) of each review; without a total the scores are summed, without a verdict the total decides.

    Null and empty texts have nothing evaluated, a total of 0 and are rejected.
    """
    # Parts are columns of their own, so that each is cut out once.
    named = {name: f"_{i}" for i, name in enumerate(SECTIONS)}
    raw = reviews.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    cut_out = raw.select("_k", "_t", *(section(F.col("_t"), h).alias(c) for h, c in named.items()))
    held = F.col("_t")
    summed = sum((_score(F.col(c)) for c in named.values()), F.lit(0).cast("long"))
    total = F.coalesce(_number(held, r"(?U)Total:\s*(\d+)/100"), F.col("_sum"))
    said = F.nullif(F.regexp_extract(held, rf"(?U)(?:Verdict|Veredicto):\s*({APPROVE}|{REVISE}|{REJECT})", 1), F.lit(""))
    by_total = F.when(F.col("total") >= APPROVE_FROM, APPROVE).when(F.col("total") >= REVISE_FROM, REVISE).otherwise(REJECT)
    evaluated = F.coalesce(_after(held, "Input Avaliado|Input Evaluated"), F.lit(""))
    totals = cut_out.select("_k", "_t", summed.alias("_sum")).select("_k", "_t", total.alias("total"))
    return totals.select(F.col("_k").alias(key), evaluated.alias("evaluated"), "total", F.coalesce(said, by_total).alias("verdict"), _gaps(held).alias("gaps"))
