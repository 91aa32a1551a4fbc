"""Queries of the corpus index over ``documents`` and ``part``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.operators import corpus
from docsluice.plans.registry import Tables, query, sql_trim
from docsluice.session import shared_folder
from docsluice.sources import indexing, readers, sinks

# Names of the document files: the language picks the extension, a share lies in folders that are never entered.
EXTENSIONS = {"en": ".txt", "fr": ".MD", "de": ".pdf", "es": ".csv"}
_SQL_EXT = "CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.MD' WHEN 'de' THEN '.pdf' WHEN 'es' THEN '.csv' ELSE '' END"
_SQL_DIR = "CASE WHEN n_chars < 400 THEN 'node_modules/' ELSE '' END"
SQL_PATH = f"source || '/' || {_SQL_DIR} || lang || '/' || doc_id || {_SQL_EXT}"


def document_path() -> Column:
    ext = F.lit("")
    for lang, name in EXTENSIONS.items():
        ext = F.when(F.col("lang") == lang, name).otherwise(ext)
    folder = F.when(F.col("n_chars") < 400, "node_modules/").otherwise("")
    return F.concat("source", F.lit("/"), folder, "lang", F.lit("/"), F.col("doc_id").cast("string"), ext)


def document_files(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", document_path().alias("path"), F.col("n_chars").alias("length"))


def document_texts(t: Tables, paragraphs: bool = False) -> DataFrame:
    """(path, text); lines become paragraphs on demand, as the given texts have none."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n")) if paragraphs else F.col("text")
    rows = t.spread("documents", "doc_id", "source", "lang", "n_chars", "text")
    return rows.select(document_path().alias("path"), text.alias("text"))


def text_tree(t: Tables) -> str:
    """The documents as files in their folders below the shared folder; gives the root."""
    root = f"{shared_folder(t.spark)}/tree-{uuid.uuid4().hex}"
    sinks.write_files(document_texts(t).select("path", F.encode("text", "UTF-8").alias("content")), root)
    return root


_SQL_INDEXED = "regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN ('.txt', '.md', '.markdown', '.csv', '.log') AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules'])"


@query("scan_text_corpus", f"SELECT path, strlen(text) AS length, md5(text) AS digest FROM (SELECT {SQL_PATH} AS path, text FROM documents) WHERE {_SQL_INDEXED}")
def _scan(t: Tables) -> DataFrame:
    """The documents as files of a tree, scanned."""
    return readers.scan_text_corpus(t.spark, text_tree(t)).select("path", "length", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(
    "select_text_files",
    f"SELECT path, length FROM (SELECT {SQL_PATH} AS path, n_chars AS length FROM documents) WHERE {_SQL_INDEXED}",
)
def _select(t: Tables) -> DataFrame:
    return corpus.select_text_files(document_files(t)).select("path", "length")


@query(
    "corpus_census",
    f"""
SELECT regexp_extract(lower(path), '(\\.[^./]*)$', 1) AS ext, count(*) AS n_files
FROM (SELECT {SQL_PATH} AS path FROM documents) GROUP BY 1
""",
)
def _census(t: Tables) -> DataFrame:
    return corpus.census(document_files(t))


@query(
    "extension_census",
    """
SELECT regexp_extract(lower(p_name || '.' || p_type), '(\\.[^./\\\\]*)$', 1) AS ext, count(*) AS n_files FROM part GROUP BY 1
""",
)
def _extension_census(t: Tables) -> DataFrame:
    return corpus.census(t.part.select(F.concat_ws(".", "p_name", "p_type").alias("path")))


@query(
    "extraction_routes",
    f"""
SELECT route, count(*) AS n_files FROM (
  SELECT CASE WHEN ext IN ('.txt', '.md', '.markdown', '.csv', '.log') THEN 'copy' WHEN ext = '.docx' THEN 'docx'
              WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.doc' THEN 'doc' ELSE 'other' END AS route
  FROM (SELECT regexp_extract(lower({SQL_PATH}), '(\\.[^./]*)$', 1) AS ext FROM documents)) GROUP BY 1
""",
)
def _routes(t: Tables) -> DataFrame:
    routed = document_files(t).select(corpus.extraction_route(F.col("path")).alias("route"))
    return routed.groupBy("route").agg(F.count("*").alias("n_files"))


def _outcomes(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left")
    error = F.when(F.col("quality") == 0, F.col("text"))
    outcome = F.when(error.isNotNull(), "failed").when(F.col("quality").isNull(), "skipped").otherwise("written")
    return joined.select(document_path().alias("path"), outcome.alias("outcome"), error.alias("error"))


_SQL_OUTCOMES = f"""
SELECT {SQL_PATH} AS path, CASE WHEN quality = 0 THEN 'failed' WHEN quality IS NULL THEN 'skipped' ELSE 'written' END AS outcome,
       CASE WHEN quality = 0 THEN text END AS error
FROM documents LEFT JOIN labels USING (doc_id)"""


@query(
    "write_extraction_report",
    f"""
SELECT outcome, count(*) AS n_files, count(error) AS n_errors,
       CAST(max(length(error)) AS BIGINT) AS longest_error
FROM ({_SQL_OUTCOMES}) GROUP BY 1
""",
)
def _report(t: Tables) -> DataFrame:
    return corpus.extraction_report(_outcomes(t)).withColumn("longest_error", F.col("longest_error").cast("bigint"))


@query("extraction_errors", f"SELECT path, outcome, error FROM ({_SQL_OUTCOMES}) WHERE error IS NOT NULL")
def _errors(t: Tables) -> DataFrame:
    return corpus.error_list(_outcomes(t))


def sql_chunks(text: str, size: int, lap: int) -> str:
    """Chunks of an expression over ``documents`` as the SQL engine computes them: a fold over the paragraphs."""
    step = size - lap
    cut = (
        f"list_filter(list_transform(range(0, CAST(ceil((length(s.buf) - {size}) / {step}.0) AS BIGINT) + 1), "
        f"lambda i: {sql_trim(f'substring(s.buf, CAST(i * {step} + 1 AS BIGINT), {size})')}), lambda y: y <> '')"
    )
    flushed = "CASE WHEN a.buf = '' THEN a.out ELSE list_append(a.out, a.buf) END"
    joined = "CASE WHEN a.buf = '' THEN s.buf ELSE a.buf || chr(10) || chr(10) || s.buf END"
    return f"""
SELECT doc_id, path, unnest(chunks) AS text, len(chunks) AS chunk_count,
       unnest(range(0, len(chunks))) AS chunk_index FROM (
  SELECT doc_id, path, CASE WHEN f.buf = '' THEN f.out ELSE list_append(f.out, f.buf) END AS chunks FROM (
    SELECT doc_id, path, list_reduce(
      list_transform(paras, lambda p: {{'buf': p, 'out': []::VARCHAR[]}}),
      lambda a, s: CASE
          WHEN length(s.buf) > {size} THEN {{'buf': '', 'out': list_concat({flushed}, {cut})}}
          WHEN length({joined}) <= {size} THEN {{'buf': {joined}, 'out': a.out}}
          ELSE {{'buf': s.buf, 'out': {flushed}}} END,
      {{'buf': '', 'out': []::VARCHAR[]}}) AS f
    FROM (SELECT doc_id, {SQL_PATH} AS path,
            list_filter(list_transform(regexp_split_to_array({sql_trim(text)}, '\\n\\n+'), lambda p: {sql_trim("p")}),
                        lambda p: p <> '') AS paras FROM documents)))"""


_PARAGRAPHS = "replace(text, chr(10), chr(10) || chr(10))"


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id",
        "text",
        F.col("metadata.chunk_index").cast("bigint").alias("chunk_index"),
        F.col("metadata.chunk_count").cast("bigint").alias("chunk_count"),
    )


_ROWS = "SELECT path || '#' || chunk_index AS chunk_id, text, chunk_index, chunk_count FROM"


@query("chunk_text", f"{_ROWS} ({sql_chunks('text', 3500, 420)})")
def _chunk_text(t: Tables) -> DataFrame:
    return _chunk_rows(corpus.chunk_table(document_texts(t)))


@query("chunk_text_packed", f"{_ROWS} ({sql_chunks(_PARAGRAPHS, 800, 60)})")
def _chunk_text_packed(t: Tables) -> DataFrame:
    return _chunk_rows(corpus.chunk_table(document_texts(t, paragraphs=True), max_chars=800, overlap=60))


@query(
    "chunk_ordinals",
    f"""
SELECT path AS source_path, min(chunk_index) AS first_index, max(chunk_index) AS last_index, max(chunk_count) AS chunk_count
FROM ({sql_chunks(_PARAGRAPHS, 3500, 420)}) GROUP BY 1
""",
)
def _chunk_ordinals(t: Tables) -> DataFrame:
    rows = _chunk_rows(corpus.chunk_table(document_texts(t, paragraphs=True)))
    return rows.groupBy(F.substring_index("chunk_id", "#", 1).alias("source_path")).agg(
        F.min("chunk_index").alias("first_index"),
        F.max("chunk_index").alias("last_index"),
        F.max("chunk_count").alias("chunk_count"),
    )


@query(
    "chunks_per_source",
    f"""
SELECT split_part(path, '/', 1) AS source, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM ({sql_chunks('text', 3500, 420)}) GROUP BY 1
""",
)
def chunks_per_source(t: Tables) -> DataFrame:
    """The flagship: corpus → chunks → totals per source."""
    rows = corpus.chunk_table(document_texts(t))
    return rows.groupBy(F.substring_index("metadata.source_path", "/", 1).alias("source")).agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars")
    )


@query(
    "resume_filter",
    f"""
SELECT path || '#' || chunk_index AS chunk_id, CAST(length(text) AS BIGINT) AS n_chars FROM ({sql_chunks('text', 3500, 420)})
WHERE path || '#' || chunk_index NOT IN (
  SELECT path || '#' || chunk_index FROM ({sql_chunks('text', 3500, 420)}) JOIN labels USING (doc_id) WHERE quality = 1)
""",
)
def _resume_filter(t: Tables) -> DataFrame:
    done = t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi")
    indexed = corpus.chunk_table(done.select(document_path().alias("path"), "text"))
    missing = corpus.resume_filter(corpus.chunk_table(document_texts(t)), indexed)
    return missing.select("chunk_id", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "index_stats",
    """
SELECT count(*) AS chunk_count, CAST(arg_min(len(embedding), vec_id) AS BIGINT) AS dimensions FROM embeddings
""",
)
def _index_stats(t: Tables) -> DataFrame:
    stats = corpus.index_stats(t.embeddings.withColumnRenamed("vec_id", "chunk_id"))
    return stats.withColumn("dimensions", F.col("dimensions").cast("bigint"))


@query(
    "write_index_manifest",
    f"""
SELECT chunk_count, dimensions, files_scanned, files_skipped, 3500 AS max_chars, 420 AS overlap_chars, 'hashing' AS model
FROM (SELECT count(*) AS chunk_count, CAST(32 AS BIGINT) AS dimensions FROM ({sql_chunks('text', 3500, 420)})
      WHERE regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN ('.txt', '.md', '.markdown', '.csv', '.log')
        AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules'])),
     (SELECT count(*) AS files_scanned, 0::BIGINT AS files_skipped
      FROM (SELECT {SQL_PATH} AS path, n_chars AS length FROM documents)
      WHERE regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN ('.txt', '.md', '.markdown', '.csv', '.log')
        AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules']))
""",
)
def _manifest(t: Tables) -> DataFrame:
    """The index and the counts are of the same files: those that may be indexed."""
    texts = document_texts(t)
    texts = texts.where(corpus.is_text_file(F.col("path")) & corpus.path_allowed(F.col("path")))
    index = corpus.build_index(texts, corpus.hashing_embedder())
    settings = {"max_chars": 3500, "overlap_chars": 420, "model": "hashing"}
    out = corpus.manifest(index, corpus.scan_counts(document_files(t)), settings)
    return out.withColumn("dimensions", F.col("dimensions").cast("bigint"))


_LETTERS = ["[^a-z]", "[^A-Z]", "[^0-9]", "[^ ]", "[a-zA-Z0-9 ]"]


@query(
    "embed_batches",
    f"""
SELECT path || '#' || chunk_index AS chunk_id, {", ".join(f"CAST(length(regexp_replace(text, '{p}', '', 'g')) AS DOUBLE) AS v{i}" for i, p in enumerate(_LETTERS))}
FROM ({sql_chunks('text', 3500, 420)})
""",
)
def _embed(t: Tables) -> DataFrame:
    """Every component of a provider whose vectors are counts of letter classes."""
    index = corpus.build_index(document_texts(t), corpus.letter_class_embedder())
    return index.select("chunk_id", *[F.element_at("embedding", i + 1).alias(f"v{i}") for i in range(len(_LETTERS))])


@query(
    "index_build",
    f"""
SELECT path || '#' || chunk_index AS chunk_id, chunk_index, chunk_count, length(text)::DOUBLE AS first, 2::BIGINT AS dims, count(*) OVER () AS manifest_chunks
FROM ({sql_chunks('text', 3500, 420)}) WHERE {_SQL_INDEXED}
""",
)
def _index_build(t: Tables) -> DataFrame:
    """Files, chunks, vectors, index and manifest: the whole job over a tree of files, with vectors that tell the chunk's length."""
    out = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    manifest = indexing.build(t.spark, text_tree(t), out, lambda texts: [[float(len(x)), 1.0] for x in texts], "lengths", 3500, 420)
    index = readers.read_chunk_index(t.spark, f"{out}/chunks")
    return index.select(
        "chunk_id", F.col("metadata.chunk_index").cast("bigint").alias("chunk_index"), F.col("metadata.chunk_count").cast("bigint").alias("chunk_count"),
        F.element_at("embedding", 1).alias("first"), F.size("embedding").cast("bigint").alias("dims"), F.lit(manifest["chunk_count"]).cast("bigint").alias("manifest_chunks"),
    )
