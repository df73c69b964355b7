"""TF-IDF search of many queries at once over an index of chunked documents."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..session import cut_lineage, scratch_path
from .index import SearchIndex

TOP_K = 8

# Portuguese words and the English words added for them.
TRANSLATIONS = {
    "dados": ["data"],
    "qualidade": ["quality"],
    "validação": ["validation", "validate"],
    "validacao": ["validation", "validate"],
    "teste": ["test", "testing"],
    "testes": ["tests", "testing"],
    "pipeline": ["pipeline"],
    "erro": ["error", "errors"],
    "erros": ["error", "errors"],
    "nulo": ["null", "missing"],
    "nulos": ["null", "missing", "nulls"],
    "duplicado": ["duplicate"],
    "duplicados": ["duplicates", "duplicate"],
    "esquema": ["schema"],
    "desempenho": ["performance"],
    "performance": ["performance"],
    "spark": ["spark"],
    "big": ["big"],
    "completude": ["completeness", "complete"],
    "precisão": ["accuracy", "precision"],
    "precisao": ["accuracy", "precision"],
    "consistência": ["consistency", "consistent"],
    "consistencia": ["consistency", "consistent"],
    "atualidade": ["timeliness", "freshness"],
    "fonte": ["source"],
    "fontes": ["sources", "source"],
    "documentos": ["documents", "document"],
    "documento": ["document"],
    "arquivos": ["files", "file"],
    "arquivo": ["file"],
    "base": ["base", "database", "knowledge"],
    "conhecimento": ["knowledge"],
    "métricas": ["metrics", "metric"],
    "metricas": ["metrics", "metric"],
}
# Fixed value: marks cut off a word before it is looked up.
QUERY_PUNCTUATION = ".,;:!?\"'()"


def lower_words(column: Column) -> Column:
    """Distinct words of a text: lower case, cut at white space, punctuation kept."""
    return F.array_distinct(split_words(F.lower(column)))


def expand_query(queries: DataFrame, id_column: str = "query_id", text_column: str = "query") -> DataFrame:
    """Distinct (query, term): the query's own words and their translations."""
    entries = [x for word, added in TRANSLATIONS.items() for x in (F.lit(word), F.array(*map(F.lit, added)))]
    lookup = F.create_map(*entries)
    # the marks are literal characters of a regular-expression class
    marks = "".join("\\" + c for c in QUERY_PUNCTUATION)
    bare = lambda w: F.regexp_replace(w, f"^[{marks}]+|[{marks}]+$", "")
    none = F.array().cast("array<string>")
    own = queries.select(id_column, lower_words(F.col(text_column)).alias("w"))
    added = F.flatten(F.transform("w", lambda w: F.coalesce(F.try_element_at(lookup, bare(w)), none)))
    return own.select(id_column, F.explode(F.array_distinct(F.concat("w", added))).alias("term"))


class Search:
    """Many queries at once over a stored index."""

    def __init__(self, index: SearchIndex, queries: DataFrame, k: int = TOP_K):
        self.index, self.k = index, k
        self.terms = cut_lineage(expand_query(queries))

    def idf(self) -> DataFrame:
        """(term, document_frequency, idf) of every query term, absent ones included."""
        return self.index.idf(self.terms)

    @cached_property
    def weights(self) -> DataFrame:
        return self.index.weights(self.terms)

    @cached_property
    def best(self) -> DataFrame:
        return cut_lineage(self.index.top_documents(self.weights, self.k))

    def chunk_scores(self) -> DataFrame:
        """(query, id, chunk_no, score): all chunks that share a word with the query."""
        return self.index.chunk_scores(self.weights)

    def best_chunks(self) -> DataFrame:
        """(query, id, chunk_no, score): the first chunk with the highest score of every document that shares a word with the query."""
        return self.index.best_chunks(self.weights)

    def hits(self, texts: bool = True) -> DataFrame:
        """(query, rank, id, chunk_no, score, text): the k best documents per query.

        A query with fewer hits is filled with the first chunks of the first
        other documents at score 0. ``texts=False`` leaves out the text and
        the pass over the stored words that fetches it.
        """
        columns = ["query_id", "rank", "segment", "bucket", "id", "chunk_no", "score"]
        ranked = self.best.select(*columns)
        found = self.best.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.collect_set("id").alias("matched"))
        asked = self.terms.select("query_id").distinct()
        short = cut_lineage(asked.join(found, "query_id", "left").where(F.coalesce("found", F.lit(0)) < self.k))
        if not short.isEmpty():
            ranked = ranked.unionByName(self._fill(short).select(*columns))
        return self.index.passages(ranked).select("query_id", "rank", "id", "chunk_no", "score", "text") if texts else ranked.drop("segment", "bucket")

    def _fill(self, short: DataFrame) -> DataFrame:
        """Rows at score 0 for queries with fewer than k hits.

        Among the first k documents at least k minus the number of hits are
        unmatched, so only these k documents can be needed.
        """
        first = self.index.first_documents(self.k)
        # k documents, whatever the size of the index
        listed = first.agg(F.array_sort(F.collect_list(F.struct("id", "segment", "bucket"))).alias("first"))
        candidates = short.crossJoin(F.broadcast(listed))
        matched = F.coalesce("matched", F.transform(F.slice("first", 1, 0), lambda d: d["id"]))
        unmatched = F.filter("first", lambda d: ~F.array_contains(matched, d["id"]))
        count = F.coalesce("found", F.lit(0)).cast("int")
        filled = candidates.select("query_id", count.alias("found"), F.posexplode(F.slice(unmatched, F.lit(1), F.lit(self.k) - count)).alias("place", "d"))
        return filled.select("query_id", "d.*", F.lit(0).alias("chunk_no"), F.lit(0.0).alias("score"), (F.col("found") + F.col("place") + 1).cast("int").alias("rank"))


def index_documents(documents: DataFrame, id_column: str = "doc_id", path: str | None = None) -> SearchIndex:
    """A fresh index of ``documents``, below the shared folder unless a path is given."""
    spark = documents.sparkSession
    id_type = documents.select(id_column).schema[0].dataType.simpleString()
    return SearchIndex.create(spark, path or scratch_path(spark, "index"), id_type).add(documents, id_column)


def search(
    documents: DataFrame, queries: DataFrame, k: int = TOP_K, id_column: str = "doc_id", texts: bool = True
) -> DataFrame:
    """One search over documents that have no index yet; ``Search`` over a kept index is for more."""
    return Search(index_documents(documents, id_column), queries, k).hits(texts).withColumnRenamed("id", id_column)


def citations(hits: DataFrame) -> DataFrame:
    """Number and first 200 characters of every hit."""
    return hits.select(
        "query_id", F.col("rank").alias("citation_id"), F.concat(F.substring("text", 1, 200), F.lit("...")).alias("text")
    )


# Topics of a question and the words that make a passage relevant.
TOPICS = [
    ("data quality", ["quality", "validation", "integrity"], 2),
    ("validation", ["validation", "check", "verify"], 2),
    ("issues", ["error", "problem", "issue", "null", "duplicate"], 2),
    ("null", ["null"], 3),
]
MIN_PASSAGE = 50


def snippet_relevance(hits: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query, place, relevance, snippet): passages that bear on the question.

    Points are given per topic and for any shared word; the snippet is the
    first three sentences. A question that no passage bears on gets the first
    two sentences of its first passage, with relevance 0. ``hits`` holds at most
    k passages per query.
    """
    numbered = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.trim("text"))
    long_enough = hits.filter(F.length(numbered) > MIN_PASSAGE)
    asked = long_enough.join(queries.select("query_id", F.lower("query").alias("question")), "query_id")
    passage, question = F.lower("text"), F.col("question")
    score = F.lit(0)
    for topic, words, points in TOPICS:
        bears = F.lit(False)
        for word in words:
            bears = bears | passage.contains(word)
        score = score + F.when(question.contains(topic) & bears, points).otherwise(0)
    shared = F.arrays_overlap(lower_words(question), lower_words(F.col("text")))
    score = score + F.when(shared, 1).otherwise(0)
    sentences = F.split(F.col("text"), r"\. ")
    cut = F.when(
        F.size(sentences) > 3, F.concat(F.array_join(F.slice(sentences, 1, 3), ". "), F.lit("."))
    ).otherwise(F.col("text"))
    snippet = F.when(cut.endswith("."), cut).otherwise(F.concat(cut, F.lit(".")))
    opening = F.when(
        F.size(sentences) > 2, F.concat(F.array_join(F.slice(sentences, 1, 2), ". "), F.lit("."))
    ).otherwise(F.col("text"))
    # a window holds the k passages of one query
    place = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")
    return (
        asked.withColumn("relevance", score)
        .withColumn("place", F.row_number().over(place))
        .filter((F.col("place") <= k) & ((F.col("relevance") > 0) | (F.col("place") == 1)))
        .select("query_id", "place", "relevance", F.when(F.col("relevance") > 0, snippet).otherwise(opening).alias("snippet"))
    )


# Phrases and words that ask for the list of sources.
LIST_PHRASES = [
    "lista", "listar", "liste", "fontes de dados", "seus documentos", "suas fontes",
    "base de conhecimento", "knowledge base", "list all", "list your", "show all",
    "what sources", "what documents", "what files", "all sources", "all documents",
]
LIST_VERBS = ["liste", "listar", "list", "show", "mostra", "mostre", "quais", "which", "what"]
SOURCE_NOUNS = [
    "fontes", "fonte", "documentos", "documento", "arquivos", "sources", "source",
    "documents", "files", "base", "bases",
]


def asks_for_sources(column: Column) -> Column:
    """A trigger phrase anywhere, or a list verb together with a source noun."""
    text = F.lower(column)
    phrase = F.lit(False)
    for trigger in LIST_PHRASES:
        phrase = phrase | text.contains(trigger)
    words = lower_words(column)
    pair = F.arrays_overlap(words, F.array(*map(F.lit, LIST_VERBS))) & F.arrays_overlap(
        words, F.array(*map(F.lit, SOURCE_NOUNS))
    )
    return phrase | pair
