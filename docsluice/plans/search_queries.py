"""Queries of the vector search over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.functions import vectors
from docsluice.operators import search
from docsluice.plans.registry import Tables, query


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return (
        t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"),
        t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"),
    )


def _sql_hits(k: int) -> str:
    return f"""
SELECT query_id, chunk_id, score, hit_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS hit_rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
           round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score
    FROM embeddings q, embeddings c WHERE len(q.embedding) = len(c.embedding))) WHERE hit_rank <= {k}"""


def hits(t: Tables, k: int, **options) -> DataFrame:
    found = search.top_k(*_sides(t), k=k, **options)
    return found.withColumn("hit_rank", F.col("hit_rank").cast("bigint"))


@query("top_k", f"SELECT query_id, chunk_id, round(score, 6) AS score, hit_rank FROM ({_sql_hits(12)})")
def _top_k(t: Tables) -> DataFrame:
    return hits(t, search.TOP_K_SEARCH).withColumn("score", F.round("score", 6))


@query("knn_join", f"SELECT query_id, chunk_id, round(score, 6) AS score, hit_rank FROM ({_sql_hits(3)})")
def _knn_join(t: Tables) -> DataFrame:
    """The way taken by query batches too large to ship, forced here."""
    return hits(t, 3, max_shipped_floats=0, n_pivots=16, block_rows=512).withColumn("score", F.round("score", 6))


@query(
    "hit_ranks",
    f"""
SELECT query_id, chunk_id, hit_rank, round(score, 4) AS prompt_score, round(score, 3) AS chat_score FROM ({_sql_hits(10)})
""",
)
def _hit_ranks(t: Tables) -> DataFrame:
    return hits(t, search.TOP_K_ASK).select(
        "query_id",
        "chunk_id",
        "hit_rank",
        F.round("score", 4).alias("prompt_score"),
        F.round("score", 3).alias("chat_score"),
    )


_BLOCK = "'[#' || hit_rank || ' score=' || printf('%.4f', score) || ' path=' || source || ']' || chr(10) || text"
_LINE = """'#' || hit_rank || ' score=' || printf('%.3f', score) || ' — ' || source || chr(10) ||
  substring(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g'), 1, 520) || CASE WHEN length(text) > 520 THEN ' …' ELSE '' END"""


def hits_with_documents(t: Tables, k: int) -> DataFrame:
    documents = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "source")
    return hits(t, k).join(documents, "chunk_id")


@query(
    "hit_block",
    f"""
SELECT query_id, hit_rank, {_BLOCK} AS block, {_LINE} AS line FROM ({_sql_hits(8)}) JOIN documents ON doc_id = chunk_id
""",
)
def _hit_block(t: Tables) -> DataFrame:
    found = hits_with_documents(t, search.TOP_K_CHAT)
    args = (F.col("hit_rank"), F.col("score"), F.col("source"), F.col("text"))
    return found.select(
        "query_id", "hit_rank", search.hit_block(*args).alias("block"), search.chat_hit_line(*args).alias("line")
    )


@query(
    "l2_normalize",
    """
SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS unit_norm, round(u[1], 6) AS first,
       round(u[len(u)], 6) AS last FROM (
  SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM (
    SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)))
""",
)
def _l2(t: Tables) -> DataFrame:
    unit = t.embeddings.select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select(
        "vec_id",
        F.round(vectors.norm(F.col("u")), 6).alias("unit_norm"),
        F.round(F.element_at("u", 1), 6).alias("first"),
        F.round(F.element_at("u", -1), 6).alias("last"),
    )


@query(
    "truncate_dims",
    """
SELECT vec_id, CAST(len(e) AS BIGINT) AS dims, round(e[len(e)], 6) AS last
FROM (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 16) AS e FROM embeddings)
""",
)
def _truncate(t: Tables) -> DataFrame:
    cut = t.embeddings.select("vec_id", vectors.truncate_dims(F.col("embedding"), 16).alias("e"))
    return cut.select(
        "vec_id", F.size("e").cast("bigint").alias("dims"), F.round(F.element_at("e", -1).cast("double"), 6).alias("last")
    )


@query(
    "cosine",
    """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""",
)
def _cosine(t: Tables) -> DataFrame:
    """Each vector against its successor: an equi-join, scored in the JVM."""
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    joined = t.embeddings.join(nxt, "vec_id")
    return joined.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))
