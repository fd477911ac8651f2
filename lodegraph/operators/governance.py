"""Who may do what and whether it was done well: layers of paths, grades of texts, policies, plans and the history of their nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks that a graded text should hold, and words that name nothing.
COVERAGE_MARKS = ("PHILOSOPHIES", "MENTAL", "HEURISTICS", "FRAMEWORKS", "METHODOLOGIES")
COMPLETENESS_MARKS = ("CONTEXTO", "DESTINO", "ARQUIVO", "BATCH", "FONTE")
NOISE_WORDS = "the a an this that these those and or but if then so because you your they them we our i my it its is are was were be"
GRADES = ((90, "A"), (70, "B"), (50, "C"), (30, "D"))
LINE_END = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def occurrences(text: Column, part: str) -> Column:
    """How often a part stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def line_count(text: Column) -> Column:
    """Lines of a text; an end of line at its end begins no further one."""
    last_open = F.when((F.length(text) > 0) & ~F.rlike(text, F.lit(f"(?:{LINE_END})\\z")), 1).otherwise(0)
    return F.regexp_count(text, F.lit(LINE_END)) + last_open


def quality_score(text: Column) -> Column:
    """Struct (coverage, clarity, completeness, traceability, total, grade): four shares of 25. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    upper = F.upper(text)

    def found(marks: Sequence[str]) -> Column:
        return sum((F.contains(upper, F.lit(m)).cast("int") for m in marks), F.lit(0)) * (25 // len(marks))

    lines = line_count(text)
    shape = (
        occurrences(text, "#") >= 3,
        (occurrences(text, "---") >= 2) | (occurrences(text, "###") >= 2),
        (occurrences(text, "- ") >= 5) | (occurrences(text, "* ") >= 5),
        (lines >= 50) & (lines <= 5000),
    )
    clarity = F.floor(sum((s.cast("int") for s in shape), F.lit(0)) * 25 / 4).cast("int")
    cited = occurrences(text, "^[") + occurrences(text, "[FONTE")
    traced = F.when(cited >= 10, 25).when(cited >= 5, 20).when(cited >= 2, 15).when(cited >= 1, 10).otherwise(0)
    coverage, complete = found(COVERAGE_MARKS), found(COMPLETENESS_MARKS)
    total = coverage + clarity + complete + traced
    grade = F.lit("F")
    for least, name in reversed(GRADES):
        grade = F.when(total >= least, name).otherwise(grade)
    return F.struct(coverage.alias("coverage"), clarity.alias("clarity"), complete.alias("completeness"), traced.alias("traceability"), total.alias("total"), grade.alias("grade"))


def is_noise(name: Column) -> Column:
    """A name of one word, of function words alone, or of fewer than 4 characters. Null is noise."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    return F.coalesce((F.size(words) <= 1) | F.forall(words, lambda w: w.isin(NOISE_WORDS.split())) | (F.length(name) < 4), F.lit(True))


def layer_of(path: Column, obsolete: Sequence[str], never: Sequence[str], personal: Sequence[str], premium: Sequence[str], core: Sequence[str]) -> Column:
    """Layer of a relative path: DELETE, NEVER, L3, L2, L1 or REVIEW, by the first list that matches.

    ``obsolete``: parts of the path. ``never``: ``dir/`` is a prefix, a name with a dot a whole file name, anything else a
    part of the name. ``personal`` and ``premium``: prefixes; placeholders, and in personal folders their documents and
    examples, are L1. ``core``: a prefix with ``/``, else the whole path. Names of the form ``name 2.ext`` are stale copies.
    """
    name = F.element_at(F.split(path, "/"), -1)

    def under(prefixes: Sequence[str]) -> Column:
        return _either([F.startswith(path, F.lit(p.rstrip("/"))) for p in prefixes])

    secret = _either([F.startswith(path, F.lit(p.rstrip("/"))) if p.endswith("/") else (name == p if "." in p else F.contains(name, F.lit(p))) for p in never])
    base = _either([F.startswith(path, F.lit(p.rstrip("/"))) if "/" in p and not p.endswith(".gitkeep") else path == p for p in core])
    scaffold = (name == "README.md") | F.contains(path, F.lit("/_example/")) | F.endswith(path, F.lit("/_example"))
    return (
        F.when(_either([F.contains(path, F.lit(p)) for p in obsolete]), "DELETE")
        .when(secret, "NEVER")
        .when(under(personal), F.when((name == ".gitkeep") | scaffold, "L1").otherwise("L3"))
        .when(under(premium), F.when(name == ".gitkeep", "L1").otherwise("L2"))
        .when(base, "L1")
        .when(F.rlike(name, F.lit(r" \d+(\.\w+)?$")), "DELETE")
        .otherwise("REVIEW")
    )


def _either(tests: Sequence[Column]) -> Column:
    found = F.lit(False)
    for t in tests:
        found = found | t
    return found


def policy_decisions(calls: DataFrame, policies: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each call with ``allowed`` and ``reason``.

    ``calls``: step, action and the columns of ``order``, which is total. ``policies``: step, mode, actions (array), max_calls
    (null: none), one row a step; a step without a policy may do anything. A whitelist allows its actions alone, a blacklist
    all others, and after max_calls allowed calls a step gets no more. Only the last call that a step's limit lets through is
    sought, by a limited rank, so a busy step is not gathered.
    """
    listed = F.array_contains("actions", F.col("action"))
    fits = F.coalesce(F.when(F.col("mode") == "whitelist", listed).otherwise(~listed), F.lit(True))
    at = F.struct(*order)
    rated = calls.join(policies, "step", "left").withColumn("fits", fits)
    most = policies.agg(F.coalesce(F.max("max_calls"), F.lit(0)).alias("m")).first().m
    ranked = rated.where("fits AND max_calls IS NOT NULL").select("step", "max_calls", at.alias("at"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("step").orderBy("at"))).where(F.col("r") <= most)
    last = ranked.where("r = max_calls").select("step", F.col("at").alias("last"))
    spent = F.coalesce((F.col("max_calls") == 0) | (at > F.col("last")), F.lit(False))
    reason = F.when(spent, "max_calls").when(~F.col("fits"), F.concat("mode", F.lit(":"), "action")).otherwise("ok")
    return rated.join(last, "step", "left").select(*calls.columns, (F.col("fits") & ~spent).alias("allowed"), reason.alias("reason"))


def plan_findings(nodes: DataFrame, plans: DataFrame, cap: float | None = None) -> DataFrame:
    """plan, node, level, type: one row per rule that a plan or one of its nodes breaks.

    ``nodes``: plan, node, label, capability, blocked, fallback. ``plans``: plan, cost and the results codeowners, isolation,
    authority and invention, of which a null or empty one was not checked.
    """
    checks = (("codeowners", "CODEOWNERS_VIOLATION", "error"), ("isolation", "BUSINESS_ISOLATION", "error"), ("authority", "AGENT_AUTHORITY", "error"), ("invention", "NO_INVENTION", "warning"))

    def finding(test: Column, kind: str, level: str) -> Column:
        return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(kind).alias("type")))

    whole = [finding(F.col(c).isNotNull() & ~F.col(c).isin("", "pass"), kind, level) for c, kind, level in checks]
    if cap:
        whole.append(finding(F.col("cost") > cap, "BUDGET_EXCEEDED", "warning"))
    pushes = F.rlike(F.lower("label"), F.lit("git push|gh pr")) & (F.col("capability") != "") & ~F.contains("capability", F.lit("devops"))
    single = [finding(pushes, "AGENT_AUTHORITY", "error"), finding(F.col("blocked"), "ROUTING_HARD_GATE_BLOCKED", "error"), finding(F.col("fallback"), "ROUTING_FALLBACK", "warning")]
    of_plans = plans.select("plan", F.lit(None).cast(nodes.schema["node"].dataType).alias("node"), F.inline(F.array_compact(F.array(*whole))))
    return of_plans.unionByName(nodes.select("plan", "node", F.inline(F.array_compact(F.array(*single)))))


def status_findings(nodes: DataFrame, history: DataFrame, known: DataFrame) -> DataFrame:
    """node and type, one row per broken rule, the repeats of a node included.

    ``nodes``: node, ref, status, last_event, started, finished. ``history``: node, at, place (from 1), status, event.
    ``known``: ref. The last step is a maximum of structs, and only the order of neighbours needs a node's steps sorted.
    """
    last = history.groupBy("node").agg(F.max(F.struct("place", "status", "event")).alias("last"))
    judged = nodes.join(last, "node", "left").join(known.select("ref", F.lit(True).alias("known")).distinct(), "ref", "left")
    found = F.array_compact(F.array(
        F.when(F.col("known").isNull(), "UNKNOWN_PLAN_NODE_REF"),
        F.when(F.col("last").isNotNull() & ~F.col("last.status").eqNullSafe(F.col("status")), "LAST_HISTORY_STATUS_MISMATCH"),
        F.when(F.col("last").isNotNull() & ~F.col("last.event").eqNullSafe(F.col("last_event")), "LAST_EVENT_TYPE_MISMATCH"),
        F.when(F.col("finished") < F.col("started"), "FINISHED_BEFORE_STARTED"),
    ))
    repeats = nodes.groupBy("node").count().where("count > 1").select("node", F.explode(F.array_repeat(F.lit("DUPLICATE_NODE_ID"), (F.col("count") - 1).cast("int"))).alias("type"))
    before = F.lag("at").over(Window.partitionBy("node").orderBy("place"))
    late = history.withColumn("before", before).where("at < before").select("node", F.lit("HISTORY_OUT_OF_ORDER").alias("type"))
    return judged.select("node", F.explode(found).alias("type")).unionByName(repeats).unionByName(late)


def phase_metrics(phases: DataFrame, run: str = "run") -> DataFrame:
    """Per run: seconds of its ended phases, phases begun and ended. ``phases``: started and ended, null while one goes on."""
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return phases.groupBy(run).agg(F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 2).alias("seconds"), F.count("started").alias("begun"), F.count(seconds).alias("ended"))
