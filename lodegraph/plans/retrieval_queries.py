"""Queries of retrieval, fusion, filters and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import evals, retrieval, vector_index
from lodegraph.plans.catalogue import query
from lodegraph.session import cut

TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-zà-ɏ]{{2,}}')"
#: Sources stand in for the three isolation buckets.
BUCKET_SQL = "CASE WHEN source IS NULL THEN NULL WHEN substring(source, 4)::INT <= 6 THEN 'external' WHEN substring(source, 4)::INT <= 13 THEN 'business' ELSE 'personal' END"

BM25_CTE = f"""
p AS (SELECT doc_id AS id, unnest(w) AS term, len(w) AS dl FROM (SELECT doc_id, {TOK.format('text')} AS w FROM documents)),
post AS (SELECT id, term, dl, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n, avg(len({TOK.format('text')})) AS avgdl FROM documents),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) AS score
  FROM post JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0)
"""
COS = "CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) > 0 THEN list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) ELSE 0 END"
#: Query vectors: every vector whose id is a multiple of 50.
VEC_CTE = f"""
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a, label FROM embeddings),
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT query_id, id, label, {COS} AS score FROM v, qv),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM c WHERE score > 0)
"""


def bucket(source):
    n = F.substring(source, 4, 10).cast("int")
    return F.when(n <= 6, "external").when(n <= 13, "business").when(n.isNotNull(), "personal")


def items(read) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_vectors(read) -> DataFrame:
    return read("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def bm25_results(read, k: int = retrieval.POOL) -> DataFrame:
    return retrieval.bm25(read("documents").select("doc_id", "text"), items(read), k)


def vector_results(read, k: int = retrieval.POOL) -> DataFrame:
    return retrieval.vector_topk(read("embeddings"), query_vectors(read), k)


@query("bm25_topk", f"WITH {BM25_CTE} SELECT query_id, id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10", ints=("rank",))
def _bm25(read):
    return bm25_results(read, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("bm25_corpus_stats", f"WITH {BM25_CTE} SELECT term, df FROM df WHERE df >= 20")
def _df(read):
    posts = retrieval.postings(read("documents").select("doc_id", "text"))
    return posts.groupBy("term").agg(F.count("*").alias("df")).where("df >= 20")


@query("corpus_lengths", f"SELECT count(*) AS n_docs, round(avg(len({TOK.format('text')})), 6) AS avg_len FROM documents")
def _lengths(read):
    return retrieval.corpus_stats(read("documents")).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("cosine_topk", f"WITH {VEC_CTE} SELECT query_id, id, round(score, 6) AS score, rank FROM vec WHERE rank <= 30", ints=("rank",))
def _cosine(read):
    return vector_results(read).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("indexed_cosine_topk", f"WITH {VEC_CTE} SELECT query_id, id, round(score, 6) AS score, rank FROM vec WHERE rank <= 30", ints=("rank",))
def _indexed_exact(read):
    """The index with its exact way: lists whose bound reaches the k-th score are looked into."""
    index = vector_index.build(read("embeddings"))
    return vector_index.search_exact(index, query_vectors(read)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("indexed_recall")
def _indexed_recall(read):
    """Recall of the nearest lists alone against a scan of all vectors, by query; no SQL, as centroids are fitted."""
    index = vector_index.build(read("embeddings"), recall=vector_index.RECALL)
    near = vector_index.search(index, query_vectors(read)).select("query_id", "id", F.lit(1).alias("hit"))
    return vector_results(read).join(near, ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


@query("cosine_floor", f"WITH {VEC_CTE} SELECT query_id, count(*) AS n FROM vec WHERE score > 0.4 GROUP BY query_id")
def _floor(read):
    return retrieval.vector_topk(read("embeddings"), query_vectors(read), None, retrieval.MATCH_FLOOR).groupBy("query_id").agg(F.count("*").alias("n"))


@query("vector_by_label", f"WITH {VEC_CTE}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM c WHERE label = 3 AND score > 0) SELECT query_id, id, r AS rank FROM f WHERE r <= 5", ints=("rank",))
def _filtered_vectors(read):
    return retrieval.vector_topk(read("embeddings").where("label = 3"), query_vectors(read), 5).select("query_id", "id", "rank")


#: Two arms over documents: word search by item, and by the vector of the same number.
ARMS = f"""
qd AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS b FROM benchmark JOIN embeddings ON item_id = vec_id),
cd AS (SELECT query_id, id, {COS} AS score FROM v, qd),
vd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cd WHERE score > 0),
arms AS (SELECT query_id, id, rank FROM bm WHERE rank <= 30 UNION ALL SELECT query_id, id, rank FROM vd WHERE rank <= 30),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM arms GROUP BY ALL)
"""


def arms(read) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = read("benchmark").join(read("embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    return bm25_results(read), retrieval.vector_topk(read("embeddings"), vectors), vectors


@query("rrf_fusion", f"WITH {BM25_CTE}, {VEC_CTE}, {ARMS} SELECT query_id, id, round(score, 8) AS score FROM fused")
def _rrf(read):
    words, vectors, _ = arms(read)
    return retrieval.rrf(words, vectors).select("query_id", "id", F.round("score", 8).alias("score"))


@query(
    "rrf_normalised_rescore",
    f"""WITH {BM25_CTE}, {VEC_CTE}, {ARMS}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM fused)
SELECT t.query_id, t.id, round(t.score / top, 6) AS normalised, round(CASE WHEN vd.score IS NULL THEN t.score ELSE 0.7 * t.score / top + 0.3 * vd.score END, 6) AS blended
FROM t LEFT JOIN vd USING (query_id, id)""",
)
def _rescore(read):
    words, found, vectors = arms(read)
    fused = cut(retrieval.rrf(words, found))  # it is read twice
    out = retrieval.rescored(fused, retrieval.cosines(fused, read("embeddings"), vectors))
    return out.select("query_id", "id", F.round("normalised", 6).alias("normalised"), F.round("blended", 6).alias("blended"))


@query("graph_hybrid_fusion", f"""WITH {BM25_CTE}, {VEC_CTE}, {ARMS}, g AS (SELECT * FROM vd WHERE rank <= 20), h AS (SELECT * FROM bm WHERE rank <= 20),
f AS (SELECT coalesce(g.query_id, h.query_id) AS query_id, coalesce(g.id, h.id) AS id, coalesce(0.4 / g.rank, 0.0) + coalesce(0.6 / h.rank, 0.0) AS score,
  CASE WHEN g.id IS NULL THEN 'hybrid' WHEN h.id IS NULL THEN 'graph' ELSE 'both' END AS origin FROM g FULL JOIN h ON g.query_id = h.query_id AND g.id = h.id)
SELECT query_id, id, round(score, 6) AS score, origin, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 10""", ints=("rank",))
def _fuse(read):
    words, vectors, _ = arms(read)
    out = retrieval.fuse_graph(vectors.where("rank <= 20"), words.where("rank <= 20"), 10)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "origin", "rank")


@query("hybrid_filtered", "SELECT doc_id, lang, source FROM documents WHERE lower(lang) = 'de' AND lower(source) = 'src0'")
def _filters(read):
    return retrieval.filtered(read("documents"), lang="DE", source="SRC0", nothing="x", n_chars=None).select("doc_id", "lang", "source")


@query("federated_bucket_topk", f"""WITH {BM25_CTE}, r AS (SELECT bm.query_id, bm.id, bm.score, {BUCKET_SQL} AS bucket FROM bm JOIN documents d ON d.doc_id = bm.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY round(score, 9) DESC, id) AS rb FROM r)
SELECT query_id, id, bucket, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, bucket, id) AS rank FROM k WHERE rb <= 10) WHERE rank <= 10""", ints=("rank",))
def _federated(read):
    docs = read("documents").select(F.col("doc_id").alias("id"), bucket(F.col("source")).alias("bucket"))
    hits = bm25_results(read, None).join(docs, "id").withColumn("part", F.struct("query_id", "bucket"))
    per = retrieval.ranked(hits, "part", 10).drop("rank", "part")
    return retrieval.federated(per, 10).select("query_id", "id", "bucket", F.round("score", 6).alias("score"), "rank")


@query("strategic_order", f"""WITH {BM25_CTE}, r AS (SELECT query_id, id, rank, count(*) OVER (PARTITION BY query_id) AS n FROM bm WHERE rank <= 7)
SELECT query_id, id, rank, CASE WHEN n <= 2 THEN rank ELSE row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 1 THEN rank ELSE 2 * n + 2 - rank END) END AS position FROM r""", ints=("rank",))
def _strategic(read):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("query_id"))
    return bm25_results(read, 7).select("query_id", "id", "rank", retrieval.strategic_position(F.col("rank"), n).alias("position"))


@query("context_budget_pack", f"""WITH {BM25_CTE}, l AS (SELECT bm.query_id, bm.id, bm.rank, length('[RAG:' || bm.id || '] ' || coalesce(text, '')) AS n FROM bm JOIN documents d ON d.doc_id = bm.id WHERE rank <= 20),
u AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM l) SELECT query_id, id, rank, used::BIGINT AS used FROM u WHERE used <= 8000""", ints=("rank",))
def _pack(read):
    texts = read("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.context_pack(bm25_results(read, 20).join(texts, "id"), 2000).select("query_id", "id", "rank", "used")


@query("variant_best_rank", f"""WITH {BM25_CTE}, {VEC_CTE}, {ARMS}, va AS (SELECT query_id, id, rank, 0 AS variant FROM bm WHERE rank <= 30 UNION ALL SELECT query_id, id, rank, 1 FROM vd WHERE rank <= 30),
m AS (SELECT query_id, id, min(rank * 10 + variant) AS b FROM va GROUP BY ALL)
SELECT query_id, id, b // 10 AS best_rank, (b % 10)::INT AS variant, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b, id) AS place FROM m) WHERE place <= 10""", ints=("place",))
def _variants(read):
    words, vectors, _ = arms(read)
    both = words.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.lit(0).alias("variant")).union(vectors.select("query_id", "id", F.col("rank").cast("long"), F.lit(1)))
    return retrieval.best_rank(both, 10)


@query("rerank_head_keep_tail", f"""WITH {BM25_CTE}, x AS (SELECT bm.query_id, bm.id, bm.rank, n_chars AS relevance FROM bm LEFT JOIN documents d ON d.doc_id = bm.id AND d.lang = 'en' WHERE rank <= 30)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN relevance END DESC NULLS LAST, rank) AS position FROM x""", ints=("position",))
def _rerank(read):
    results = bm25_results(read)
    relevance = results.select("query_id", "id").join(read("documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("relevance")), "id")
    return retrieval.rerank_head(results, relevance, 10).select("query_id", "id", "position")


def labels(read) -> tuple[DataFrame, DataFrame]:
    e = read("embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label"), e.select(F.col("vec_id").alias("id"), "label")


RELEVANT = "SELECT e.vec_id AS query_id, o.vec_id AS id FROM embeddings e JOIN embeddings o ON e.label = o.label WHERE e.vec_id % 50 = 0"


@query("recall_ndcg", f"""WITH {VEC_CTE}, rel AS ({RELEVANT}), tot AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY query_id),
h AS (SELECT query_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first_hit FROM vec JOIN rel USING (query_id, id) WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, n_relevant, coalesce(hits, 0) AS hits, round(coalesce(hits / n_relevant, 0), 6) AS recall,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, first_hit FROM tot LEFT JOIN h USING (query_id)""", ints=("first_hit",))
def _recall(read):
    found = cut(vector_results(read, 10))
    wanted, total = evals.relevant_by_class(found, *labels(read))
    return evals.retrieval_metrics(found, wanted, 10, total)


@query("id_precision", f"WITH {VEC_CTE}, rel AS ({RELEVANT}) SELECT vec.query_id, round(avg(CASE WHEN rel.id IS NULL THEN 0 ELSE 1 END), 4) AS precision FROM vec LEFT JOIN rel USING (query_id, id) WHERE rank <= 10 GROUP BY vec.query_id")
def _precision(read):
    found = cut(vector_results(read, 10))
    return evals.id_precision(found, evals.relevant_by_class(found, *labels(read))[0])


@query("pushed_filter", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src0'")
def _pushed(read):
    return retrieval.pushed(read("documents"), lang="en", source="src0", person="", unknown="x").select("doc_id", "source", "n_chars")


@query("metadata_equality_filter", "SELECT doc_id, source, n_chars FROM documents WHERE lower(lang) = 'en'")
def _metadata(read):
    return retrieval.filtered(read("documents"), lang="en").select("doc_id", "source", "n_chars")


@query("query_terms_bigrams", f"""WITH t AS (SELECT item_id, {TOK.format('text')} AS w FROM benchmark)
SELECT item_id, len(w) + 2 * greatest(len(w) - 1, 0) AS n, w[1] || '-' || w[2] AS first_pair FROM t WHERE len(w) >= 2""")
def _bigrams(read):
    words = read("benchmark").select("item_id", T.tokens(F.col("text")).alias("w")).where(F.size("w") >= 2)
    terms = T.query_terms(F.col("w"))
    return words.select("item_id", F.size(terms).cast("long").alias("n"), F.element_at(terms, F.size("w") + 1).alias("first_pair"))


@query("hybrid_search")
def _hybrid_search(read):
    """The composed search over all benchmark items: no SQL, as the last layer of its deduplication compares texts."""
    from lodegraph.operators import search

    asked = read("benchmark").join(read("embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("vector"))
    docs = read("documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")
    return search.hybrid_search(docs, read("embeddings").select(F.col("vec_id").alias("id"), "embedding"), asked, lang="en").select("query_id", "id", "place", F.round("score", 8).alias("score"))


@query("hash_dedup_layers", "SELECT conv_id AS query_id, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS r FROM conversations) WHERE r = 1 GROUP BY conv_id")
def _hash_layers(read):
    from lodegraph.operators import search

    rows = read("conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text", F.lit("").alias("source"), F.lit(None).cast("long").alias("offset"))
    return search.deduplicated(rows, likeness=1.0, most=None).groupBy("query_id").agg(F.count("*").alias("kept"))
