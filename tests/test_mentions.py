"""Names in texts by the automaton and by the join, the direct resolver and the inference, against brute force and rows by hand."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from lodegraph.operators import mentions

ALIASES = [("New York", "ny"), ("york", "yk"), ("New", "n"), ("new york city", "nyc"), ("São Paulo", "sp"), ("a-b", "ab"), ("", "none"), ("!!", "none"), ("york", "yk"), ("York", "other"), ("the the", "t")]
TEXTS = [(1, "In New York, new york city and YORK."), (2, "newyork yorker"), (3, None), (4, ""), (5, "SÃO  PAULO; a b, A-B"), (6, "the the the"), (7, "york " * 50), (None, "York")]


def brute(texts, aliases):
    out = Counter()
    for i, text in texts:
        words = re.findall(mentions.T.WORD, (text or "").lower())
        for alias, entity in {(" ".join(re.findall(mentions.T.WORD, a.lower())), e) for a, e in aliases} - {("", "none")}:
            n = len(alias.split(" "))
            for at in range(len(words) - n + 1):
                if words[at : at + n] == alias.split(" "):
                    out[i, at + 1, n, alias, entity] += 1
    return out


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_every_occurrence_of_every_alias(spark, most):
    texts, aliases = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame(ALIASES, "alias string, entity string")
    assert Counter(map(tuple, mentions.mentions(texts, aliases, most_shipped=most).collect())) == brute(TEXTS, ALIASES)
    assert mentions.mentions(texts, aliases.limit(0), most_shipped=most).count() == mentions.mentions(texts.limit(0), aliases, most_shipped=most).count() == 0


def test_a_hundred_thousand_aliases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text")
    words = mentions.words_of(mentions.F.col("text"))
    pairs = docs.select(mentions.F.explode(mentions.F.transform(mentions.F.sequence(mentions.F.lit(1), mentions.F.greatest(mentions.F.size(words) - 1, mentions.F.lit(1))), lambda i: mentions.F.array_join(mentions.F.slice(words, i, 2), " "))).alias("alias")).distinct().limit(100_000)
    aliases = pairs.withColumn("entity", mentions.F.col("alias")).cache()
    assert aliases.count() > 20_000
    count = lambda most: mentions.mentions(docs, aliases, most_shipped=most).groupBy("gram").count().orderBy("gram").collect()
    assert count(1 << 30) == count(0)


#: Questions with what they ask for, read off the resolver's rules.
ASKED = [
    ("Hormozi DNA L4 frameworks", ("dna", "FRAMEWORKS", None)),
    ("hormozi l2", ("dna", "MODELOS-MENTAIS", None)),
    ("the soul of Hormozi", ("agent", None, "SOUL.md")),
    ("Hormozi config", ("agent", None, "DNA-CONFIG.yaml")),
    ("perfil de Hormozi", ("dossier", None, None)),
    ("where is Hormozi", (None, None, None)),
    ("voice of Hormozi, l3", ("dna", "HEURISTICAS", None)),
]


def test_what_a_question_asks_for(spark):
    frame = spark.createDataFrame([(q,) for q, _ in ASKED], "q string")
    assert [tuple(r) for r in frame.select(mentions.parsed_question(mentions.F.col("q")).alias("p")).select("p.*").collect()] == [w for _, w in ASKED]


def test_files_of_a_question(spark):
    questions = spark.createDataFrame([(1, "Alex Hormozi dna l4"), (2, "hormozi soul"), (3, "nobody dna"), (4, "Hormozi"), (5, "hormozi playbook")], "query_id long, query string")
    aliases = spark.createDataFrame([("Hormozi", "alex"), ("Alex Hormozi", "alex"), ("alex", "other")], "alias string, entity string")
    files = [("alex", "dna", 1, "p/FILOSOFIAS.yaml", "one"), ("alex", "dna", 2, "p/FRAMEWORKS.yaml", "two"), ("alex", "agent", 3, "a/SOUL.md", "x" * 31_900), ("alex", "agent", 4, "a/MEMORY.md", "y" * 400), ("other", "dna", 1, "o/FRAMEWORKS.yaml", "no")]
    frame = spark.createDataFrame(files, "entity string, artifact string, place long, path string, text string")
    got = sorted((r["query_id"], r["path"], len(r["text"])) for r in mentions.resolved(questions, aliases, frame).collect())
    # 31 906 characters before the last file leave 94, which are too few to cut it.
    assert got == [(1, "p/FRAMEWORKS.yaml", 3), (2, "a/SOUL.md", 31_900), (4, "a/SOUL.md", 31_900), (4, "p/FILOSOFIAS.yaml", 3), (4, "p/FRAMEWORKS.yaml", 3)]


FIELDS = "id long, stem string, persons array<string>, persons_in_parens array<string>, companies array<string>, speaker string, speaker_confidence string, subject string, subject_mentions long, content_entities array<string>, bucket_hint string, bucket_confidence string, internal boolean, forced_author string, forced_subject string"


def row(i, stem="", persons=(), parens=(), companies=(), speaker=None, sure=None, subject=None, n=0, seen=(), hint=None, hint_sure=None, internal=False, author=None, about=None):
    return (i, stem, list(persons), list(parens), list(companies), speaker, sure, subject, n, list(seen), hint, hint_sure, internal, author, about)


#: Rows and what the decision tree gives for them.
INFERRED = [
    (row(1, "100M Playbook Pricing (Alex Hormozi)", ["Playbook Pricing", "Alex Hormozi"], ["Alex Hormozi"]), ("Alex Hormozi", None, ["Playbook Pricing"], "medium", "ROUTE")),
    (row(2, "host + Widget - host", ["Ana"], [], ["host", "Widget"]), ("Ana", "Widget", ["host"], "medium", "ROUTE")),
    (row(3, "host host", [], [], ["host"]), (None, "host", [], "low", "REVIEW")),
    (row(4, "x", ["Ana"], [], [], "Bob", "high", "Widget", 3), ("Bob", "Widget", ["Ana"], "high", "ROUTE")),
    (row(5, "x", ["Ana"], [], ["Acme"], "Bob", "low", "Widget", 2), ("Ana", "Acme", [], "high", "ROUTE")),
    (row(6), (None, None, [], "low", "BLOCK")),
    (row(7, hint="business", hint_sure="high"), (None, None, [], "medium", "REVIEW")),
    (row(8, internal=True), (None, None, [], "medium", "ROUTE")),
    (row(9, "z", ["Ana"], author="Eva"), ("Eva", None, [], "high", "ROUTE")),
    (row(10, "a + b", [], [], ["a", "b"], seen=["A"]), (None, "a", ["b"], "low", "REVIEW")),
    (row(11, "a + b", [], [], ["a", "b"]), (None, "b", ["a"], "low", "REVIEW")),
    (row(12, "x", ["Ana", "Bo"]), ("Ana", None, ["Bo"], "low", "REVIEW")),
]


def test_authors_and_subjects(spark):
    known = spark.createDataFrame([("alex hormozi",)], "name string")
    got = {r["id"]: tuple(r)[1:] for r in mentions.inferred(spark.createDataFrame([r for r, _ in INFERRED], FIELDS), known).collect()}
    assert got == {r[0]: w for r, w in INFERRED}
