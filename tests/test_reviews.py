"""Reports by section, rows written by hand."""

from __future__ import annotations

from lodegraph.operators import reviews as R

WHOLE = """Input Avaliado:  plan of March
[PREMISE AUDIT]
15/20
Justificativa: all three are named
Actionable Feedback: name the market [IM-001-015] and [MEET-0050]
[LOGIC GAPS]
Score: 9
12/20 is not the first line
the step from price to churn
[EVIDENCE CHAIN]
Score:  11
chain holds [im-2] [X-1]
[VERDICT + SCORE]
Acao:
call the owner
Total: 61/100
Gaps Identificados (two):

 1. no source for churn
  2.  no baseline
3.none
text
4. not of the list
"""


def test_criteria_and_verdicts(spark):
    frame = spark.createDataFrame([(1, WHOLE, "x"), (2, None, "x"), (3, "", "x"), (4, "[PREMISE AUDIT] 20/20 [EVIDENCE CHAIN] 20/20 [LOGIC GAPS] 20/20\nVeredicto: REVISAR", "x"), (5, "[LOGIC GAPS] 30/20 [VERDICT + SCORE] 99999999999999999999/20 [PREMISE AUDIT] Score: 25", "x")], "id int, text string, score string")
    rows = {(r.id, r.criterion): (r.score, r.justification, r.feedback, r.refs) for r in R.criteria(frame).collect()}
    assert len(rows) == 25
    assert rows[1, "premissas_declaradas"] == (15, "all three are named", "name the market [IM-001-015] and [MEET-0050]", ["IM-001-015", "MEET-0050"])
    assert rows[1, "logica_consistente"] == (12, "the step from price to churn", "", [])
    assert rows[1, "evidencias_rastreaveis"] == (11, "chain holds [im-2] [X-1]", "", ["X-1"])
    assert rows[1, "cenarios_alternativos"] == (0, "", "", []) and rows[1, "conflitos_resolvidos"][0] == 0 and rows[1, "conflitos_resolvidos"][2] == "call the owner"
    assert all(rows[i, c] == (0, "", "", []) for i in (2, 3) for c in R.SECTIONS.values())
    got = {r.id: (r.evaluated, r.total, r.verdict, r.gaps) for r in R.verdicts(frame).collect()}
    assert got[1] == ("plan of March", 61, "REVISAR", ["no source for churn", "no baseline"])
    assert got[2] == got[3] == ("", 0, "REJEITAR", []) and got[4] == ("", 60, "REVISAR", []) and got[5] == ("", 55, "REVISAR", [])
    assert R.criteria(frame.limit(0)).count() == 0


def test_long_lists_of_gaps(spark):
    text = "Gaps\n" + "\n".join(f"{i}. gap {i}" for i in range(20000))
    assert len(R.verdicts(spark.createDataFrame([(1, text)], "id int, text string")).first().gaps) == 20000
