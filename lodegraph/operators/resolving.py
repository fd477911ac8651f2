"""What a question is answered from without a search, and what a rebuild can take over: contracts, files, vectors, chunks, overlays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.entity import title_key

CONTRACT_CHARS, DIRECT_CHARS, LEAST_REST = 48_000, 32_000, 200
MEMORY_SHARE, CHARS_PER_TOKEN, JOINT = 0.3, 4, "\n\n---\n\n"


def contract_of(question: Column, contracts: Mapping[str, Sequence[str]]) -> Column:
    """Struct (domain, hits) of the contract with most keywords within the question, of equal ones the first; null without a hit."""
    low = F.trim(F.lower(question))
    scored = [
        F.struct(sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0)).alias("hits"), F.lit(-i).alias("place"), F.lit(name).alias("domain"))
        for i, (name, words) in enumerate(contracts.items())
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best.hits > 0, F.struct(best.domain.alias("domain"), best.hits.alias("hits")))


def bounded_files(files: DataFrame, group: str, place: str, text: str, most: int = CONTRACT_CHARS, least_rest: int = LEAST_REST) -> DataFrame:
    """The files of a group by place until ``most`` characters, with ``taken`` characters each.

    The file that goes beyond is cut if more than ``least_rest`` are left; it or the one before it is the last.
    """
    n = F.length(text)
    before = F.coalesce(F.sum(n).over(Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(most) - F.col("_before")
    taken = F.when(n <= room, n).when(room > least_rest, room)
    whole = files.where(F.col(text).isNotNull()).withColumn("_before", before)
    return whole.withColumn("taken", taken.cast("int")).where("taken IS NOT NULL").withColumn(text, F.expr(f"substring(`{text}`, 1, taken)")).drop("_before")


def joined_context(found: Column, memory: Column, tokens: int = 8000) -> Column:
    """Found text and memory in one context: 70 % and 30 % of the characters, all of them for the first where there is no memory."""
    room = tokens * CHARS_PER_TOKEN
    found, memory = F.coalesce(found, F.lit("")), F.coalesce(memory, F.lit(""))
    of_found = int(room * (1 - MEMORY_SHARE))
    first = F.when(memory == "", F.substring(found, 1, room)).otherwise(F.substring(found, 1, of_found))
    return F.concat_ws(JOINT, F.nullif(first, F.lit("")), F.nullif(F.substring(memory, 1, room - of_found), F.lit("")))


def seeded_vectors(prior: DataFrame, artifacts: DataFrame, signature: str, size: int) -> DataFrame:
    """sha, vector and origin of every text whose vector can be used again.

    Both tables: sha, model, vector (array), ord. Vectors of another model or size are left out; an artifact comes before
    the prior index, and of one text's vectors that with the highest ``ord`` counts.
    """

    def usable(frame: DataFrame, name: str) -> DataFrame:
        fit = frame.where((F.col("model") == signature) & (F.size("vector") == size))
        return fit.groupBy("sha").agg(F.max_by("vector", "ord").alias(name))

    both = usable(prior, "old").join(usable(artifacts, "new"), "sha", "full")
    return both.select("sha", F.coalesce("new", "old").alias("vector"), F.when(F.col("new").isNotNull(), "artifact").otherwise("prior").alias("origin"))


def reused_chunks(chunks: DataFrame, indexed: DataFrame, live: DataFrame, signature: str, mode: str) -> DataFrame:
    """The chunks of unchanged files. ``indexed``: path, sha, model, mode as they were; ``live``: path and sha now."""
    same = indexed.where((F.col("model") == signature) & (F.col("mode") == mode)).join(live, ["path", "sha"], "left_semi")
    return chunks.join(same.select("path"), "path", "left_semi")


def merged_sidecar(records: DataFrame, key: str, ord_col: str, target: DataFrame | None = None) -> DataFrame:
    """One record per key, the last one by ``ord_col``; they replace the target's. A record without a key keeps its own row,
    under the key ``row:<ord>``, and no two of them are merged."""
    keyed = records.withColumn(key, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row:"), F.col(ord_col).cast("string"))))
    rest = [F.col(c) for c in records.columns if c != key]
    last = keyed.groupBy(key).agg(F.max_by(F.struct(*rest), ord_col).alias("r")).select(key, "r.*")
    if target is None:
        return last
    return last.unionByName(target.withColumn(key, F.col(key).cast("string")).join(last.select(key), key, "left_anti"), allowMissingColumns=True)


def insight_counts(categories: DataFrame, persons: DataFrame, insights: DataFrame, patterns: DataFrame) -> DataFrame:
    """Insights per person over four shapes: (person) of a category's insight, whose slugs become names, (person, n) where
    meetings are no persons, (person) of a single insight, (person, n) of patterns."""
    plain = F.when(F.contains("person", F.lit(" ")), F.col("person")).otherwise(F.initcap(F.replace("person", F.lit("-"), F.lit(" "))))
    one, n = F.lit(1).cast("long").alias("n"), F.col("n").cast("long").alias("n")
    rows = (
        categories.select(plain.alias("person"), one)
        .unionByName(persons.where(~F.startswith("person", F.lit("MEET-")) & (F.col("n") > 0)).select("person", n))
        .unionByName(insights.select("person", one))
        .unionByName(patterns.select("person", n))
    )
    return rows.where("person <> ''").groupBy("person").agg(F.sum("n").alias("insights"))


def domain_sections(insights: DataFrame, expertise: DataFrame) -> DataFrame:
    """The insights with ``place``, the rank of their domain in their person's dossier: those of expertise first, then by name.

    ``insights``: person, domain and more. ``expertise``: person, domain. Ranks are counted over distinct domains; ordered by
    person, place and time, the rows are the dossier, and none is gathered.
    """
    sections = insights.select("person", "domain").distinct()
    marked = sections.join(expertise.select("person", "domain", F.lit(0).alias("other")).distinct(), ["person", "domain"], "left")
    place = F.row_number().over(Window.partitionBy("person").orderBy(F.coalesce("other", F.lit(1)), "domain"))
    return insights.join(marked.select("person", "domain", place.alias("place")), ["person", "domain"])


def overlay_replayed(nodes: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and star edges after the saved hyperedges are put back.

    ``nodes``: id, type, label. ``overlay``: rel_label, rel_type (null: PARTICIPA), participants (array), labels (map). A
    hyperedge's id is a hash of its sorted participants and label, so replaying twice adds nothing; a participant that is no node
    becomes a person, and no node is overwritten. Entries without participants or label are left out.
    """
    members = F.array_sort(F.array_distinct("participants"))
    given = overlay.where((F.size("participants") > 0) & F.col("rel_label").isNotNull())
    he = given.select(F.concat(F.lit("H:"), F.sha2(F.concat_ws("|", members, "rel_label"), 256)).alias("he"), "rel_label", F.coalesce("rel_type", F.lit("PARTICIPA")).alias("rel"), members.alias("members"), "labels")
    ends = he.select("he", "rel", "labels", F.explode("members").alias("id"))
    slug = F.when(F.contains("id", F.lit(":")), F.regexp_replace("id", r"^[^:]*:", "")).otherwise(F.col("id"))
    label = F.coalesce(F.element_at("labels", F.col("id")), slug)
    people = ends.join(nodes.select("id"), "id", "left_anti").groupBy("id").agg(F.lit("pessoa").alias("type"), F.min(label).alias("label"))
    stars = he.groupBy(F.col("he").alias("id")).agg(F.lit("hyperedge").alias("type"), F.min("rel_label").alias("label"))
    edges = ends.select(F.col("id").alias("source"), F.col("he").alias("target"), "rel").distinct()
    return nodes.select("id", "type", "label").unionByName(people).unionByName(stars.join(nodes.select("id"), "id", "left_anti")), edges


def entity_lookup(nodes: DataFrame, edges: DataFrame, word: str) -> DataFrame:
    """Edges that touch a node whose id, label or person holds the word; ``hit`` names which ends do."""
    text = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("label", "id", "person") if c in nodes.columns)))
    hits = nodes.where(F.contains(text, F.lit(word.lower()))).select("id").distinct()
    at_source = hits.select(F.col("id").alias("source"), F.lit(True).alias("s"))
    at_target = hits.select(F.col("id").alias("target"), F.lit(True).alias("t"))
    both = edges.join(at_source, "source", "left").join(at_target, "target", "left").where("s OR t")
    return both.withColumn("hit", F.concat_ws("+", F.when(F.col("s"), "source"), F.when(F.col("t"), "target"))).drop("s", "t")


def numeric_heuristics(nodes: DataFrame, domain: str | None = None, person: str | None = None) -> DataFrame:
    """Heuristics with a numeric threshold: id, label, person, domains, weight. ``nodes``: those and type, has_threshold."""
    found = nodes.where((F.col("type") == "heuristica") & F.col("has_threshold"))
    if person:
        found = found.where(F.lower("person") == person.lower())
    if domain:
        found = found.where(F.exists("domains", lambda d: F.lower(d) == domain.lower()))
    return found.select("id", "label", "person", "domains", "weight")


def source_documents(files: DataFrame, ttl_days: Mapping[str, int], volatile_up_to: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents beside the graph: an anchor per kind of source, a document per file, CONTEM between them.

    ``files``: kind, path, title. The first part of a path that is a layer gives its days to live; documents that live no
    longer than ``volatile_up_to`` days are of the raw tier, and a layer that no part names is null.
    """
    layers = F.create_map(*(F.lit(x) for pair in ttl_days.items() for x in pair))
    layer = F.get(F.filter(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda p: p.isin(list(ttl_days))), 0)
    days = F.element_at(layers, layer)
    tier = F.when(F.coalesce(days <= volatile_up_to, F.lit(False)), "raw").otherwise("structured")
    doc = F.concat_ws(":", F.lit("DOC"), "kind", "path")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    title = F.coalesce(F.nullif("title", F.lit("")), stem)
    label = F.when(F.length(title) > 100, F.concat(F.substring(title, 1, 100), F.lit("..."))).otherwise(title)
    documents = files.select(doc.alias("id"), F.concat("kind", F.lit("_doc")).alias("type"), label.alias("label"), tier.alias("tier"), layer.alias("layer"), days.alias("ttl_days"))
    anchors = files.select("kind").distinct().select(F.concat(F.lit("FONTE:"), "kind").alias("id"), F.lit("fonte").alias("type"), F.initcap("kind").alias("label"), F.lit("structured").alias("tier"))
    edges = files.select(F.concat(F.lit("FONTE:"), "kind").alias("source"), doc.alias("target"), F.lit("CONTEM").alias("rel"))
    return documents.unionByName(anchors, allowMissingColumns=True), edges


def layer_entities(people: DataFrame, families: Mapping[str, tuple[str, str]]) -> DataFrame:
    """person, id, type, label, rel: a typed node and edge per item of each family. ``people``: person and an array per family."""

    def rows_of(family: str, kind: str, rel: str) -> Column:
        items = F.filter(F.coalesce(F.col(family), F.array().cast("array<string>")), lambda x: x != "")
        return F.transform(items, lambda x: F.struct(x.alias("label"), F.lit(kind).alias("type"), F.lit(rel).alias("rel")))

    rows = F.concat(*(rows_of(family, kind, rel) for family, (kind, rel) in families.items()))
    slug = F.regexp_replace(F.lower("label"), r"[^a-z0-9]+", "-")
    return people.select("person", F.inline(F.array_distinct(rows))).select("person", F.concat_ws(":", "type", "person", slug).alias("id"), "type", "label", "rel")


def file_themes(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """source, kind, name, domain, is_new: what each file names, once per normalised name, as the registry writes it.

    ``mentions``: source, kind (theme, person or role), at, name. ``registry``: kind, alias, canonical, domain; an unknown name
    keeps the form in which it first stands. Of two aliases that normalise alike the canonical name that sorts first counts.
    """
    named = mentions.withColumn("key", F.trim(title_key(F.col("name")))).where("key <> ''")
    first = named.groupBy("source", "kind", "key").agg(F.min(F.struct("at", "name")).alias("f"))
    known = registry.groupBy("kind", F.trim(title_key(F.col("alias"))).alias("key")).agg(F.min(F.struct("canonical", "domain")).alias("r"))
    met = first.join(known, ["kind", "key"], "left")
    resolved = met.groupBy("source", "kind", F.coalesce("r.canonical", "f.name").alias("name")).agg(F.min("r.domain").alias("domain"), F.every(F.col("r").isNull()).alias("is_new"))
    return resolved.select("source", "kind", "name", "domain", "is_new")
