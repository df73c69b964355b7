"""Documents: chunks, search, upkeep, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import corpus as D
from tidemark.operators import search as S
from tidemark.operators.chunking import chunk_documents
from tidemark.operators.vectors import VectorIndex
from tidemark.session import spread

from .fixtures import view, with_views


# the index of each table, by the files it was made of; a session of its own finds none
_INDEXES: dict[tuple, object] = {}


def _index(spark, sf_dir, table, build):
    """The stored index of a table: built by the first query that searches it, opened by the others."""
    rows = view(spark, sf_dir, table)
    # one row per file
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, *sorted(map(str, files)))
    if key not in _INDEXES:
        _INDEXES[key] = build(rows)
    return _INDEXES[key]


def _search(spark, sf_dir):
    return S.Search(_index(spark, sf_dir, "documents", S.index_documents), view(spark, sf_dir, "search_queries"))


def _rounded(df, *names):
    # the same arithmetic as in the SQL, so that ties round alike
    for name in names:
        df = df.withColumn(name, F.floor(F.col(name) * 1e6 + 0.5) / 1e6)
    return df


def _rounded_sql(name):
    return f"floor({name} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS {name}"


def _hits(spark, sf_dir):
    return _search(spark, sf_dir).hits()


def _by_document(df):
    return df.withColumnRenamed("id", "doc_id")


def search_topk(spark, sf_dir):
    return _by_document(_rounded(_search(spark, sf_dir).hits(texts=False), "score"))


def search_after_upkeep(spark, sf_dir):
    """Documents with labels first, the others imported on top, the toxic ones deleted, all segments merged."""
    documents, labels = view(spark, sf_dir, "documents"), view(spark, sf_dir, "labels")
    index = S.index_documents(documents.join(labels.select("doc_id"), "doc_id", "left_semi"))
    index = index.add(documents).delete(labels.where("toxic = 1")).merge()
    return _by_document(_rounded(S.Search(index, view(spark, sf_dir, "search_queries")).hits(texts=False), "score"))


def snippet_relevance(spark, sf_dir):
    return S.snippet_relevance(_hits(spark, sf_dir), view(spark, sf_dir, "search_queries"))


def intent_list_sources(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations")
    asked = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("What sources have "), "text")).when(
        F.col("conv_id") % 9 == 1, F.concat(F.lit("show me the FILES "), "text")).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", S.asks_for_sources(asked).alias("asks"))


def _indexed(spark, sf_dir):
    """The files already in the collection: those with labels."""
    files = view(spark, sf_dir, "doc_files")
    return files, files.join(view(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def incremental_import(spark, sf_dir):
    files, indexed = _indexed(spark, sf_dir)
    return D.import_new(indexed, files).select("doc_id", "filename")


def delete_documents(spark, sf_dir):
    toxic = view(spark, sf_dir, "labels").filter("toxic = 1")
    return D.delete_documents(view(spark, sf_dir, "doc_files"), toxic).select("doc_id", "filename")


def corpus_stats(spark, sf_dir):
    documents = spread(view(spark, sf_dir, "documents"), "doc_id")
    return D.corpus_stats(documents, chunk_documents(documents))


def markdown_titles(spark, sf_dir):
    files = view(spark, sf_dir, "doc_files")
    return files.select("doc_id", D.markdown_title(F.col("text"), F.col("filename")).alias("title"))


def vector_neighbours(spark, sf_dir):
    """Every vector as query, over all vectors."""
    queries = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return _index(spark, sf_dir, "embeddings", VectorIndex).search(queries).withColumnRenamed("id", "vec_id")


QUERIES = {
    "chunk_documents": lambda spark, sf_dir: chunk_documents(spread(view(spark, sf_dir, "documents"), "doc_id")),
    "expand_query": lambda spark, sf_dir: S.expand_query(view(spark, sf_dir, "search_queries")),
    "idf": lambda spark, sf_dir: _rounded(_search(spark, sf_dir).idf(), "idf"),
    "chunk_scores": lambda spark, sf_dir: _by_document(_rounded(_search(spark, sf_dir).chunk_scores(), "score")),
    "best_chunk": lambda spark, sf_dir: _by_document(_rounded(_search(spark, sf_dir).best_chunks(), "score")),
    "search_topk": search_topk,
    "search_after_upkeep": search_after_upkeep,
    "citations": lambda spark, sf_dir: S.citations(_hits(spark, sf_dir)),
    "snippet_relevance": snippet_relevance,
    "intent_list_sources": intent_list_sources,
    "incremental_import": incremental_import,
    "delete_documents": delete_documents,
    "list_sources": lambda spark, sf_dir: D.list_sources(view(spark, sf_dir, "doc_files")),
    "shallow_documents": lambda spark, sf_dir: D.shallow_documents(view(spark, sf_dir, "doc_files")).select("doc_id", "filename", "reason"),
    "corpus_stats": corpus_stats,
    "markdown_title": markdown_titles,
    "vector_topk": vector_neighbours,
}

SPACES = "[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACES}'), lambda w: w <> '')"


CHUNKS = f"""split AS (SELECT doc_id, {words_sql('text')} AS words FROM documents),
chunks AS (
  SELECT doc_id, CAST(s // 116 AS INT) AS chunk_no, CAST(s AS INT) AS start_idx, CAST(least(s + 128, len(words)) AS INT) AS end_idx,
    array_to_string(words[s + 1 : s + 128], ' ') AS text
  FROM (SELECT doc_id, words, unnest(range(0, len(words), 116)) AS s FROM split) AS x)"""

_PAIRS = ", ".join(f"('{w}', '{t}')" for w, ts in S.TRANSLATIONS.items() for t in ts)
TERMS = f"""own AS (SELECT DISTINCT query_id, unnest({words_sql('lower(query)')}) AS term FROM search_queries),
terms AS (SELECT query_id, term FROM own UNION
  SELECT query_id, t FROM own JOIN (VALUES {_PAIRS}) AS m(w, t) ON trim(term, '.,;:!?"''()') = w)"""

SCORES = f"""{CHUNKS},
{TERMS},
words AS (SELECT doc_id, chunk_no, unnest(list_distinct({words_sql('lower(text)')})) AS term FROM chunks),
matched AS (SELECT * FROM words WHERE term IN (SELECT term FROM terms)),
freq AS (SELECT term, count(DISTINCT doc_id) AS df FROM matched GROUP BY term),
idf AS (SELECT DISTINCT t.term, coalesce(df, 0) AS document_frequency,
  CASE WHEN df IS NULL THEN 0.1 ELSE ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1 END AS idf FROM terms t LEFT JOIN freq f ON t.term = f.term),
sizes AS (SELECT query_id, count(*) AS size FROM terms GROUP BY query_id),
scores AS (SELECT t.query_id, m.doc_id, m.chunk_no, floor(sum(i.idf / s.size) * 1e10::DOUBLE + 0.5::DOUBLE) / 1e10::DOUBLE AS score
  FROM matched m JOIN terms t ON m.term = t.term JOIN idf i ON i.term = t.term JOIN sizes s ON s.query_id = t.query_id GROUP BY ALL),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_no) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM best QUALIFY rank <= 8),
first_docs AS (SELECT doc_id FROM chunks WHERE chunk_no = 0),
short AS (SELECT q.query_id, count(t.doc_id) AS found FROM (SELECT DISTINCT query_id FROM terms) q LEFT JOIN top t ON q.query_id = t.query_id GROUP BY 1 HAVING count(t.doc_id) < 8),
fill AS (SELECT s.query_id, d.doc_id, 0 AS chunk_no, 0.0::DOUBLE AS score, found + row_number() OVER (PARTITION BY s.query_id ORDER BY d.doc_id) AS rank
  FROM short s, first_docs d WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = s.query_id AND t.doc_id = d.doc_id) QUALIFY rank <= 8),
hits AS (SELECT h.query_id, CAST(h.rank AS INT) AS rank, h.doc_id, h.chunk_no, h.score, c.text FROM (SELECT * FROM top UNION ALL BY NAME SELECT * FROM fill) h
  JOIN chunks c ON c.doc_id = h.doc_id AND c.chunk_no = h.chunk_no)"""


def scored(body: str) -> str:
    return with_views(f"WITH {SCORES}\n{body}", "search_queries")


def _contains(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_RELEVANCE = " + ".join(
    f"CASE WHEN contains(lower(q.query), '{topic}') AND {_contains('lower(h.text)', words)} THEN {points} ELSE 0 END"
    for topic, words, points in S.TOPICS
) + f" + CASE WHEN list_has_any({words_sql('lower(q.query)')}, {words_sql('lower(h.text)')}) THEN 1 ELSE 0 END"

_ASKED = "CASE WHEN conv_id % 9 = 0 THEN 'What sources have ' || text WHEN conv_id % 9 = 1 THEN 'show me the FILES ' || text ELSE text END"

ORACLE = {
    "chunk_documents": f"WITH {CHUNKS} SELECT * FROM chunks",
    "expand_query": with_views(f"WITH {TERMS} SELECT * FROM terms", "search_queries"),
    "idf": scored(f"SELECT term, document_frequency, {_rounded_sql('idf')} FROM idf"),
    "chunk_scores": scored(f"SELECT query_id, doc_id, chunk_no, {_rounded_sql('score')} FROM scores"),
    "best_chunk": scored(f"SELECT query_id, doc_id, chunk_no, {_rounded_sql('score')} FROM best"),
    "search_topk": scored(f"SELECT query_id, rank, doc_id, chunk_no, {_rounded_sql('score')} FROM hits"),
    "search_after_upkeep": scored(f"SELECT query_id, rank, doc_id, chunk_no, {_rounded_sql('score')} FROM hits").replace(
        "FROM documents", "FROM (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS documents"),
    "citations": scored("SELECT query_id, rank AS citation_id, substr(text, 1, 200) || '...' AS text FROM hits"),
    "snippet_relevance": scored(
        f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS INT) AS place, CAST(relevance AS INT) AS relevance,
          CASE WHEN relevance = 0 THEN opening WHEN cut LIKE '%.' THEN cut ELSE cut || '.' END AS snippet
        FROM (SELECT h.query_id, h.rank, {_RELEVANCE} AS relevance,
            CASE WHEN len(string_split(h.text, '. ')) > 2 THEN array_to_string(string_split(h.text, '. ')[1:2], '. ') || '.' ELSE h.text END AS opening,
            CASE WHEN len(string_split(h.text, '. ')) > 3 THEN array_to_string(string_split(h.text, '. ')[1:3], '. ') || '.' ELSE h.text END AS cut
          FROM hits h JOIN search_queries q ON q.query_id = h.query_id
          WHERE length('[' || h.rank || '] ' || trim(h.text)) > 50) AS r QUALIFY relevance > 0 OR place = 1"""),
    "intent_list_sources": f"""
        SELECT conv_id, turn, {_contains('m', S.LIST_PHRASES)} OR (list_has_any(w, {S.LIST_VERBS!r}) AND list_has_any(w, {S.SOURCE_NOUNS!r})) AS asks
        FROM (SELECT conv_id, turn, lower({_ASKED}) AS m, {words_sql(f'lower({_ASKED})')} AS w FROM conversations) AS x""",
    "incremental_import": with_views(
        "SELECT doc_id, filename FROM doc_files WHERE doc_id IN (SELECT doc_id FROM labels) OR trim(text) <> ''", "doc_files"),
    "delete_documents": with_views(
        "SELECT doc_id, filename FROM doc_files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "doc_files"),
    "list_sources": with_views("SELECT doc_id AS id, filename, n_chars AS size FROM doc_files", "doc_files"),
    "shallow_documents": with_views(
        """SELECT doc_id, filename, CASE WHEN length(text) < 100 AND contains(filename, 'test') THEN 'small_test_document' WHEN length(text) < 100 THEN 'small_content'
          WHEN trim(text) = 'Test document about data quality' THEN 'generic_test_document' END AS reason FROM doc_files""", "doc_files"),
    "corpus_stats": f"""WITH {CHUNKS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks,
        (SELECT sum(length(text))::BIGINT FROM documents) AS characters""",
    "markdown_title": with_views(
        "SELECT doc_id, CASE WHEN filename LIKE '%.md' AND trim(split_part(text, chr(10), 1)) LIKE '#%' THEN trim(ltrim(trim(split_part(text, chr(10), 1)), '#')) END AS title FROM doc_files", "doc_files"),
    "vector_topk": """
        WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings),
        s AS (SELECT query_id, vec_id, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank, vec_id, similarity FROM s QUALIFY rank <= 8""",
}
