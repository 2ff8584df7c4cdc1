"""Registered queries: each operator applied to the driver's tables, with DuckDB SQL of the same result."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import dates, keys, text as T, urls, vectors
from evidentia.operators import agenda, chunking, embedding, ranking, rollups
from evidentia.operators.search_index import SearchIndex
from evidentia.session import shared_folder, small_batches
from evidentia.sources import html, store as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TERMS_SQL = """list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]{1,}'),
  lambda t: CASE WHEN length(t) > 4 AND ends_with(t, 'ies') THEN t[:-4] || 'y' WHEN length(t) > 4 AND ends_with(t, 's') THEN t[:-2] ELSE t END), lambda t: length(t) > 1)"""
QUERY = "the stations of thing and eration"
QUERY_TERMS = T.query_terms(QUERY)
TERM_LIST = "[" + ", ".join(f"'{t}'" for t in dict.fromkeys(QUERY_TERMS)) + "]"
QUERY_VECTOR = [((7 * i) % 13 - 6) / 50 for i in range(64)]
VECTOR_LIST = "[" + ", ".join(map(repr, QUERY_VECTOR)) + "]::DOUBLE[]"


def scored_sql(where: str, vector: str, order: str, limit: int) -> str:
    return f"""
WITH base AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, {TERMS_SQL} AS terms, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id {where}),
idf AS (SELECT t, ln((count(*) OVER () * 0 + (SELECT count(*) FROM base) + 1.0) / ((SELECT count(*) FROM base WHERE list_contains(terms, t)) + 1)) + 1 AS idf FROM (SELECT unnest({TERM_LIST}) AS t)),
lex AS (SELECT doc_id, least(1.0, sum(least(1.0, len(list_filter(terms, lambda x: x = t)) / 3.0) * idf) / sum(idf)) AS lexical FROM base, idf GROUP BY doc_id),
scored AS (SELECT b.doc_id, b.n_chars, {vector} AS vector, lexical,
    len(list_intersect({TERM_LIST}, list_transform(regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9][a-z0-9-]{{1,}}'), lambda t: CASE WHEN length(t) > 4 AND ends_with(t, 's') THEN t[:-2] ELSE t END))) / len({TERM_LIST})::DOUBLE AS metadata
  FROM base b JOIN lex USING (doc_id))
SELECT doc_id, round(0.55 * vector + 0.35 * lexical + 0.1 * metadata, 4) AS score, round(vector, 4) AS vector_score, round(lexical, 4) AS lexical_score, round(metadata, 4) AS metadata_boost
FROM scored WHERE 0.55 * vector + 0.35 * lexical + 0.1 * metadata > 0 ORDER BY score DESC, {order} LIMIT {limit}"""


NO_VECTOR = "0.0::DOUBLE"
WITH_VECTOR = f"CASE WHEN b.embedding IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (list_dot_product({VECTOR_LIST}, b.embedding::DOUBLE[]) + 1) / 2)) END"


def _searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ranking.counted_for(table(spark, sf_dir, "documents"), QUERY).drop("text")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vecs, "doc_id", "left")


def _ranked(df: DataFrame, vector: list[float] | None, limit: int) -> DataFrame:
    found = ranking.rank(df, QUERY, vector, limit, ("source", "lang"), (F.col("doc_id").asc(),))
    return found.select("doc_id", "score", "vector_score", "lexical_score", "metadata_boost")


@registered(scored_sql("", NO_VECTOR, "doc_id", 10))
def lexical_topk(spark, sf_dir):
    return _ranked(table(spark, sf_dir, "documents").withColumn("embedding", F.lit(None).cast("array<float>")), None, 10)


@registered(scored_sql("", WITH_VECTOR, "doc_id", 10))
def hybrid_topk(spark, sf_dir):
    return _ranked(_searchable(spark, sf_dir), QUERY_VECTOR, 10)


@registered(scored_sql("WHERE lang IN ('en', 'fr') AND o.o_orderdate >= DATE '1995-01-01' AND o.o_orderdate <= DATE '1997-12-31'", WITH_VECTOR, "doc_id", 25).replace("FROM documents d LEFT JOIN", "FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id LEFT JOIN"))
def search_filtered(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("hearing_date"))
    dated = _searchable(spark, sf_dir).join(days, "doc_id", "left")
    return _ranked(ranking.filtered(dated, datetime.date(1995, 1, 1), datetime.date(1997, 12, 31), ["en", "fr"], type_col="lang").drop("hearing_date"), QUERY_VECTOR, 25)


class _Given:
    """An embedding provider of one given query vector."""

    provider_name, model_name = "given", "given-v1"

    @staticmethod
    def embed_query(query: str) -> list[float]:
        return QUERY_VECTOR


def dated_sql(where: str, vector: str) -> str:
    return (
        scored_sql(where, vector, "day DESC NULLS LAST, doc_id", 40)
        .replace("FROM documents d LEFT JOIN", "FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id LEFT JOIN")
        .replace("d.n_chars,", "d.n_chars, o.o_orderdate::DATE AS day,").replace("b.n_chars,", "b.n_chars, b.day,")
        .replace("SELECT doc_id, round(0.55", "SELECT doc_id, day, round(0.55")
    )


DATED_SQL = dated_sql("WHERE d.lang IN ('en', 'fr', 'de')", WITH_VECTOR)


def _as_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents as chunks and as documents, orders as hearings, and the vectors."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text", F.lit(None).cast("string").alias("section_hint"), F.lit(None).cast("string").alias("citation_label"))
    own = docs.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("hearing_id"), F.col("source").alias("title"), F.col("lang").alias("source_type"), F.lit("").alias("url"))
    hearings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hearing_id"), F.col("o_orderdate").cast("date").alias("hearing_date"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("given").alias("embedding_provider"), F.lit("given-v1").alias("embedding_model"), "embedding")
    return chunks, own, hearings, vecs


def _dated(found: DataFrame) -> DataFrame:
    return found.select(F.col("chunk_id").alias("doc_id"), F.col("hearing_date").alias("day"), "score", "vector_score", "lexical_score", "metadata_boost")


@registered(DATED_SQL)
def search_dated(spark, sf_dir):
    """The whole search: documents as chunks, orders as hearings, ties by date, document and chunk."""
    *tables, vecs = _as_chunks(spark, sf_dir)
    return _dated(ranking.search(*tables, QUERY, vecs, _Given, 40, types=["en", "fr", "de"]))


def _index(spark: SparkSession, tables: list[DataFrame]) -> SearchIndex:
    index = SearchIndex(spark, shared_folder(spark), "bigint", "bigint", buckets=16)
    index.build(*tables)
    return index


@registered(dated_sql("", NO_VECTOR))
def indexed_search(spark, sf_dir):
    """The same by words alone, from a stored index of all documents."""
    *tables, _ = _as_chunks(spark, sf_dir)
    return _dated(_index(spark, tables).search(*tables, QUERY, limit=40).rows)


@registered(DATED_SQL)
def indexed_hybrid(spark, sf_dir):
    *tables, vecs = _as_chunks(spark, sf_dir)
    return _dated(_index(spark, tables).search(*tables, QUERY, vecs, _Given, 40, types=["en", "fr", "de"]).rows)


@registered(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents WHERE doc_id % 5 <> 0) GROUP BY term")
def indexed_frequencies(spark, sf_dir):
    """Document frequencies from the index, after a fifth of the documents has lost its chunks."""
    chunks, own, hearings, _ = _as_chunks(spark, sf_dir)
    index = _index(spark, [chunks, own, hearings])
    index.replace(chunks.where("document_id % 5 = 0"), chunks.limit(0), own, hearings)
    return index.table.read().where("field = 'body'").groupBy("term").agg(F.sum("n").alias("df"))


@registered("""
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 4 <> 0 THEN source END AS hearing FROM documents), h AS (SELECT 'src' || n_nationkey AS hearing, n_name FROM nation WHERE n_nationkey < 15)
SELECT c.doc_id, d.source, h.n_name, len(e.embedding)::INTEGER AS n_dims
FROM documents c JOIN (SELECT * FROM d WHERE doc_id % 3 <> 0) d USING (doc_id) LEFT JOIN h ON h.hearing = d.hearing LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) e ON e.vec_id = c.doc_id""")
def searchable_joins(spark, sf_dir):
    """Chunks of unknown documents go; documents without a hearing and chunks without a vector of the model stay."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"))
    own = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("hearing_id"), F.lit(None).cast("string").alias("title"), F.col("source").alias("source_type"), F.lit("").alias("url"))
    hearings = table(spark, sf_dir, "nation").where("n_nationkey < 15").select(F.concat(F.lit("src"), "n_nationkey").alias("hearing_id"), F.col("n_name").alias("hearing_date"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("p").alias("embedding_provider"), (F.col("vec_id") % 2).cast("string").alias("embedding_model"), "embedding")
    found = ranking.searchable(chunks, own, hearings, vecs, "p", "0")
    return found.select(F.col("chunk_id").alias("doc_id"), F.col("source_type").alias("source"), F.col("hearing_date").alias("n_name"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_dims"))


@registered("SELECT doc_id, source, NULL::INTEGER AS n_dims FROM documents")
def lexical_null_vector(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text")
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(None).cast("string").alias("hearing_id"), F.lit(None).cast("string").alias("title"), F.col("source").alias("source_type"), F.lit("").alias("url"))
    hearings = table(spark, sf_dir, "region").select(F.col("r_name").alias("hearing_id"), F.lit(None).cast("date").alias("hearing_date"))
    found = ranking.searchable(docs, own, hearings, None)
    return found.select(F.col("chunk_id").alias("doc_id"), F.col("source_type").alias("source"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_dims"))


@registered(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY term")
def doc_frequency(spark, sf_dir):
    return ranking.document_frequency(table(spark, sf_dir, "documents"), "text")


@registered(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY doc_id, term")
def term_frequency(spark, sf_dir):
    return ranking.term_frequency(table(spark, sf_dir, "documents"), "doc_id", "text")


@registered(f"SELECT doc_id, len({TERMS_SQL})::BIGINT AS n_terms, greatest(1, length(text) // 4)::INTEGER AS token_estimate FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.terms_of(F.col("text"))).cast("bigint").alias("n_terms"), T.token_estimate(F.col("text")).alias("token_estimate"))


CORPUS_SYNONYMS = {"the": ("that", "this"), "and": ("with",), "ing": ("tion", "ation", "ed")}


@registered(f"""
WITH terms AS (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents),
known(term, other) AS (VALUES ('the', 'that'), ('the', 'this'), ('and', 'with'), ('ing', 'tion'), ('ing', 'ation'), ('ing', 'ed'))
SELECT doc_id, term, count(*) AS n FROM (SELECT * FROM terms UNION ALL SELECT doc_id, other FROM terms JOIN known USING (term)) GROUP BY ALL""")
def synonym_expansion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(T.expanded(T.terms_of(F.col("text")), CORPUS_SYNONYMS)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@registered(f"""
WITH terms AS (SELECT doc_id, md5(unnest({TERMS_SQL})) AS h FROM documents),
sums AS (SELECT doc_id, ('0x' || h[1:8])::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM terms GROUP BY ALL)
SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM sums WHERE v <> 0""")
def hash_embedding_md5(spark, sf_dir):
    return embedding.md5_embedding(table(spark, sf_dir, "documents"), "doc_id", "text", 64).select("doc_id", "slot", F.round("value", 6).alias("value"))


@registered()
def hash_embedding_blake2b(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return embedding.LocalHash().embed(docs, "text", "embedding").select("doc_id", "embedding")


@registered(f"""
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {VECTOR_LIST}), 6) AS similarity,
  round(greatest(0.0, least(1.0, (list_dot_product(embedding::DOUBLE[], {VECTOR_LIST}) + 1) / 2)), 6) AS score FROM embeddings""")
def cosine_scores(spark, sf_dir):
    query = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), query), 6).alias("similarity"), F.round(vectors.vector_score(query, F.col("embedding")), 6).alias("score"))


@registered("""
SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    left = vecs.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("l"), (F.col("vec_id") + 1).alias("right_id"))
    return left.join(vecs.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("r")), "right_id").select("left_id", "right_id", F.round(vectors.dot(F.col("l"), F.col("r")), 6).alias("similarity"))


NORMALISED_SQL = "SELECT vec_id, slot, round(value / norm, 6) AS value FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS value, generate_subscripts(embedding, 1)::INTEGER AS slot, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"


@registered(NORMALISED_SQL)
def l2_normalised(spark, sf_dir):
    return _normalised_slots(table(spark, sf_dir, "embeddings"))


@registered(NORMALISED_SQL)
def l2_normalised_whole(spark, sf_dir):
    return l2_normalised(spark, sf_dir)


def _normalised_slots(vecs: DataFrame) -> DataFrame:
    doubles = vecs.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return doubles.select("vec_id", F.posexplode(vectors.normalised(F.col("v"))).alias("slot", "value")).select("vec_id", (F.col("slot") + 1).alias("slot"), F.round("value", 6).alias("value"))


@registered("SELECT doc_id, n_chars FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 0) USING (doc_id)")
def pending_anti(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), "n_chars")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.lit("labels").alias("embedding_provider"), F.col("toxic").cast("string").alias("embedding_model"))
    return embedding.pending(chunks, done, "labels", "0").select(F.col("chunk_id").alias("doc_id"), "n_chars")


@registered("""
SELECT (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS customers, (SELECT count(*) FROM orders) AS orders,
  (SELECT count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#11') AS linked""")
def summary_counts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    linked = t("lineitem").join(t("part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    return rollups.summary(spark, nations=t("nation"), customers=t("customer").where("c_acctbal > 0"), orders=t("orders"), linked=linked)


@registered("""
SELECT n_nationkey, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL ORDER BY n_nationkey DESC LIMIT 12""")
def list_with_counts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    latest = t("nation").select("n_nationkey", "n_name").orderBy(F.col("n_nationkey").desc()).limit(12)
    return rollups.with_counts(latest, "n_nationkey", customers=(t("customer"), "c_nationkey"), suppliers=(t("supplier"), "s_nationkey"))


@registered("""
SELECT n_nationkey, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY n_nationkey DESC LIMIT 8""")
def recent_activity(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    placed = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    latest = t("nation").select("n_nationkey", "n_name").orderBy(F.col("n_nationkey").desc()).limit(8)
    return rollups.with_counts(latest, "n_nationkey", customers=(t("customer"), "c_nationkey"), orders=(placed, "c_nationkey"), suppliers=(t("supplier"), "s_nationkey"))


@registered("SELECT source AS source_type, count(*) AS count FROM documents GROUP BY source")
def type_counts(spark, sf_dir):
    return rollups.document_types(table(spark, sf_dir, "documents").withColumnRenamed("source", "source_type"))


@registered("SELECT CASE WHEN n_chars >= 500 THEN 'good' WHEN n_chars >= 100 THEN 'medium' WHEN n_chars >= 50 THEN 'poor' ELSE 'unknown' END AS extraction_quality, count(*) AS page_count FROM documents GROUP BY 1")
def quality_health(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rollups.extraction_health(docs.select(F.when(F.col("n_chars") >= 50, T.quality_of(F.col("n_chars"))).alias("extraction_quality")))


CORPUS_THEMES = {"articles": ("the", "die", "les"), "endings": ("tion", "ing", "ung", "ción"), "rail": ("rail",), "nothing": ("qqqq",)}


@registered("""
SELECT theme, sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::BIGINT AS mention_count
FROM documents, (VALUES ('articles', 'the'), ('articles', 'die'), ('articles', 'les'), ('endings', 'tion'), ('endings', 'ing'), ('endings', 'ung'), ('endings', 'ción'), ('rail', 'rail'), ('nothing', 'qqqq')) AS v(theme, term) GROUP BY theme""")
def theme_mentions(spark, sf_dir):
    return rollups.theme_mentions(table(spark, sf_dir, "documents"), "text", CORPUS_THEMES)


@registered("SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7")
def detail_nested(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_orderkey = 7")
    lines = rollups.ordered_list(table(spark, sf_dir, "lineitem").where("l_orderkey = 7").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity"), "o_orderkey", "lines", F.col("l_linenumber"))
    return own.join(lines, "o_orderkey").select("o_orderkey", "o_orderstatus", F.explode("lines").alias("x")).select("o_orderkey", "o_orderstatus", "x.l_linenumber", "x.l_quantity")


@registered("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def exists_probe(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


NATURAL_SQL = """
SELECT p_partkey, name, row_number() OVER (ORDER BY try_cast(regexp_extract(name, '^[0-9]+') AS INTEGER) NULLS LAST, name NULLS LAST, p_partkey) AS position
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_size || substr(p_brand, 1, 3) END AS name FROM part)"""


@registered(NATURAL_SQL)
def natural_sort(spark, sf_dir):
    return _sorted_parts(table(spark, sf_dir, "part"))


@registered(NATURAL_SQL)
def natural_sort_whole(spark, sf_dir):
    return natural_sort(spark, sf_dir)


def _sorted_parts(part: DataFrame) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.concat(F.col("p_size").cast("string"), F.substring("p_brand", 1, 3)))
    return rollups.numbered(part.select("p_partkey", name.alias("name")), [*rollups.natural_order("name"), F.col("p_partkey")])


@registered("SELECT conv_id, string_agg('--- page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def prefix_group_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text")
    docs = turns.select("document_id", F.col("document_id").alias("hearing_id"), F.lit("agenda").alias("source_type")).distinct()
    return agenda.agenda_texts(docs, turns).select(F.col("document_id").alias("conv_id"), "text")


AGENDA = """CONSENT CALENDAR:

1. 2024-001234CUA (J. SMITH: (628) 555-1212)
123 MAIN STREET - north side; District 3
Planner: Jane Smith, jane.smith@sfgov.org, (628) 555-1212
Project Description: Request for Conditional Use Authorization
to allow a new dwelling.
CEQA Status: Exempt
Preliminary Recommendation: Approve with Conditions
Continued from: March 7, 2024
Proposed Continuance Date: April 18, 2024

2. Election of officers

REGULAR CALENDAR
3a. 2023-004567 77 Oak Ave. Variance and Discretionary Review
Staff Contact: Bob O'Neil (415) 555-0000
"""


#: Items after a form feed, as between the pages of a PDF, and with no-break and ideographic spaces.
ODD_SPACES = "1.\xa0First item\n\xa0 2. Second item\n\x0c3. Third item\n\u30004.\u2003Fourth item"


def agenda_fields(spark: SparkSession) -> DataFrame:
    texts = spark.createDataFrame([("h1", AGENDA), ("h2", ""), ("h3", "no items"), ("h4", ODD_SPACES)], "hearing_id string, text string")
    return agenda.with_fields(agenda.items_of(texts))


@registered("""
SELECT * FROM (VALUES
 ('h1', '1', 'CONSENT CALENDAR', '2024-001234CUA', 'CUA', '123 MAIN STREET', '3', 'Jane Smith', 'jane.smith@sfgov.org, (628) 555-1212', 'Request for Conditional Use Authorization' || chr(10) || 'to allow a new dwelling.', 'Conditional Use Authorization', 'Exempt', 'Approve with Conditions', 'March 7, 2024', DATE '2024-04-18', 1.0::DOUBLE),
 ('h1', '2', 'CONSENT CALENDAR', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.1),
 ('h1', '3a', 'REGULAR CALENDAR', '2023-004567', NULL, '77 Oak Ave', NULL, 'Bob O''Neil', '(415) 555-0000', NULL, 'Variance; Discretionary Review', NULL, NULL, NULL, NULL, 0.6),
 ('h4', '1', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.1),
 ('h4', '2', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.1),
 ('h4', '3', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.1),
 ('h4', '4', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.1))
AS t(hearing_id, item_number, section, case_number, case_suffix, address, district, planner_name, planner_contact, project_description, entitlement_type, ceqa_status, preliminary_recommendation, continued_from, proposed_continuance_date, parser_confidence)""")
def case_fields(spark, sf_dir):
    return agenda_fields(spark).drop("agenda_item_id", "raw_text")


@registered("""
SELECT 'h' || doc_id AS hearing_id, '1' AS item_number, 'REGULAR CALENDAR' AS section, '2024-' || lpad(doc_id::VARCHAR, 6, '0') || 'CUA' AS case_number, 'CUA' AS case_suffix,
  (doc_id % 11 + 1)::VARCHAR AS district, coalesce(source, 'none') AS ceqa_status, coalesce(lang, 'none') AS preliminary_recommendation, 0.5::DOUBLE AS parser_confidence FROM documents
UNION ALL SELECT 'h' || doc_id, '2', 'REGULAR CALENDAR', NULL, NULL, NULL, NULL, NULL, 0.1 FROM documents""")
def agenda_of_documents(spark, sf_dir):
    """The agenda parser over all documents: an agenda of two items, with fields from the columns, of each."""
    case = F.concat(F.lit("2024-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("CUA"))
    first = F.concat(F.lit("1. "), case, F.lit("\nDistrict "), (F.col("doc_id") % 11 + 1).cast("string"), F.lit("\nCEQA Status: "), F.coalesce("source", F.lit("none")), F.lit("\nPreliminary Recommendation: "), F.coalesce("lang", F.lit("none")))
    text = F.concat(F.lit("REGULAR CALENDAR\n"), first, F.lit("\n\f2. Election "), F.col("doc_id").cast("string"))
    made = agenda.with_fields(agenda.items_of(table(spark, sf_dir, "documents").select(F.concat(F.lit("h"), "doc_id").alias("hearing_id"), text.alias("text"))))
    return made.select("hearing_id", "item_number", "section", "case_number", "case_suffix", "district", "ceqa_status", "preliminary_recommendation", "parser_confidence")


@registered("""
SELECT doc_id, nullif(regexp_extract(text, '\\(?[0-9]{3}\\)?[-.\\s][0-9]{3}[-.\\s][0-9]{4}'), '') AS phone FROM documents WHERE regexp_matches(text, '\\(?[0-9]{3}\\)?[-.\\s][0-9]{3}[-.\\s][0-9]{4}')""")
def phone_fields(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", agenda.matched(F.col("text"), agenda.PHONE, 0).alias("phone")).where("phone is not null")


@registered("""
SELECT doc_id, item, round(least(1.0, (CASE WHEN source = 'src0' THEN 1 ELSE 0 END + CASE WHEN lang <> 'en' THEN 1 ELSE 0 END + 1) / 10.0), 2)::DOUBLE AS confidence
FROM (SELECT doc_id, source, lang, doc_id || '' AS item FROM documents)""")
def confidence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    item = F.col("doc_id").cast("string")
    return docs.select("doc_id", item.alias("item"), agenda.confidence(item, F.when(F.col("source") == "src0", "x"), F.when(F.col("lang") != "en", "y").otherwise("")).alias("confidence"))


@registered("""
WITH items AS (SELECT doc_id, source, '2024-' || lpad((doc_id % 50)::VARCHAR, 6, '0') || 'CUA' AS cased FROM documents WHERE doc_id % 5 < 4),
docs AS (SELECT doc_id, source, 'Report 2024-' || lpad((doc_id % 60)::VARCHAR, 6, '0') || 'cua.pdf' AS title FROM documents WHERE lang <> 'fr')
SELECT 'a' || items.doc_id AS agenda_item_id, 'd' || docs.doc_id AS document_id, 'link-' || substr(sha256('a' || items.doc_id || '|d' || docs.doc_id), 1, 20) AS link_id, 'case_number_match' AS relationship, 1.0::DOUBLE AS confidence
FROM items JOIN docs ON items.source = docs.source AND contains(upper(title), cased[1:11])""")
def document_links(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    number = lambda n: F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % n).cast("string"), 6, "0"))
    items = docs.select(F.concat(F.lit("a"), "doc_id").alias("agenda_item_id"), F.col("source").alias("hearing_id"), F.when(F.col("doc_id") % 5 < 4, F.concat(number(50), F.lit("CUA"))).alias("case_number"))
    own = docs.select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.col("source").alias("hearing_id"), F.when(F.col("lang") == "fr", "agenda").otherwise("staff_report").alias("source_type"), F.concat(F.lit("Report "), number(60), F.lit("cua.pdf")).alias("title"), F.lit(None).cast("string").alias("url"))
    return agenda.document_links(items, own)


@registered("""
WITH RECURSIVE lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, greatest(1, length(line) // 4) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
size AS (SELECT doc_id, max(i) AS last FROM lines GROUP BY doc_id),
walk AS (
  SELECT doc_id, i, n AS held, 0 AS chunk, n >= 40 AS full_now FROM lines WHERE i = 0
  UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN w.full_now OR w.held + l.n > 60 THEN l.n ELSE w.held + l.n END,
    w.chunk + CASE WHEN w.full_now OR w.held + l.n > 60 THEN 1 ELSE 0 END,
    CASE WHEN w.full_now OR w.held + l.n > 60 THEN l.n ELSE w.held + l.n END >= 40
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT doc_id, chunk::INTEGER AS chunk_index, min(i)::INTEGER AS first_line, max(i)::INTEGER AS last_line FROM walk GROUP BY doc_id, chunk""")
def pack_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    sizes = F.transform("lines", T.token_estimate)
    ranges = chunking.packed(F.col("sizes"), F.col("chars"), F.col("sections"), 40, 60, 0)
    own = lines.withColumn("sizes", sizes).withColumn("chars", F.transform("lines", F.length)).withColumn("sections", F.transform("lines", lambda x: F.lit(None).cast("string")))
    return own.select("doc_id", F.posexplode(ranges).alias("chunk_index", "r")).select("doc_id", "chunk_index", F.col("r.from").alias("first_line"), F.col("r.to").alias("last_line"))


PACK_OVERLAP_SQL = """
WITH RECURSIVE lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, list_transform(l, lambda x: greatest(1, length(x) // 4)) AS sizes, list_transform(l, lambda x: length(x)) AS chars,
  list_transform(range(1, len(l) + 1), lambda k: CASE (k // 4) % 3 WHEN 0 THEN NULL WHEN 1 THEN 'A' ELSE 'B' END) AS secs FROM lines),
s AS (
  SELECT doc_id, 1 AS i, 1 AS first, 0::BIGINT AS n, []::STRUCT(f BIGINT, t BIGINT)[] AS made FROM d
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN base + sizes[i] >= 40 THEN i + 1 ELSE low END, CASE WHEN base + sizes[i] >= 40 THEN 0 ELSE base + sizes[i] END,
    (CASE WHEN flush THEN [{'f': first, 't': i - 1}] ELSE [] END) || (CASE WHEN base + sizes[i] >= 40 THEN [{'f': low, 't': i}] ELSE [] END)
  FROM (SELECT *, CASE WHEN flush THEN coalesce(list_sum(sizes[low:i - 1]), 0)::BIGINT ELSE n END AS base FROM (
    SELECT *, CASE WHEN NOT flush THEN first WHEN secs[i - 1] <> secs[i] THEN i ELSE
      coalesce(list_min(list_filter(range(first, i), lambda j: coalesce(list_sum(chars[j + 1:i - 1]), 0) < 20
        AND len(list_filter(secs[j:i - 1], lambda x: x IS DISTINCT FROM secs[i - 1])) = 0)), i) END AS low FROM (
    SELECT *, first < i AND (n + sizes[i] > 60 OR (coalesce(secs[i - 1] <> secs[i], false) AND n >= 16)) AS flush
    FROM s JOIN d USING (doc_id) WHERE i <= len(sizes)))))
, ranges AS (SELECT doc_id, unnest(made) AS r FROM s
  UNION ALL SELECT doc_id, {'f': first, 't': i - 1} FROM s JOIN d USING (doc_id) WHERE i = len(sizes) + 1 AND first < i)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY r.t, r.f) - 1)::INTEGER AS chunk_index, (r.f - 1)::INTEGER AS first_line, (r.t - 1)::INTEGER AS last_line FROM ranges"""


@registered(PACK_OVERLAP_SQL)
def pack_overlap(spark, sf_dir):
    """The packer with sections, some of them unknown, and overlap."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    section = lambda _, k: F.get(F.array(F.lit(None).cast("string"), F.lit("A"), F.lit("B")), F.floor((k + 1) / 4).cast("int") % 3)
    ranges = chunking.packed(F.transform("lines", T.token_estimate), F.transform("lines", F.length), F.transform("lines", section), 40, 60, 5)
    return lines.select("doc_id", F.posexplode(ranges).alias("chunk_index", "r")).select("doc_id", "chunk_index", F.col("r.from").alias("first_line"), F.col("r.to").alias("last_line"))


def _conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("document_id"), F.when(F.col("conv_id") % 3 == 0, "staff_report").otherwise("correspondence_pre_hearing").alias("source_type"),
        F.lit(None).cast("string").alias("title"), F.lit(datetime.date(2024, 5, 2)).alias("hearing_date"), (F.col("turn") + 1).cast("int").alias("page_number"),
        F.concat(F.when(F.col("turn") % 2 == 0, "EXECUTIVE SUMMARY\n\n").otherwise("Public Comment:\n\n"), F.coalesce("text", F.lit(""))).alias("text"), F.lit("good").alias("extraction_quality"),
    )


@registered()
def chunk_sections(spark, sf_dir):
    return chunking.chunks_of(_conversation_pages(spark, sf_dir), 60, 90, 10)


@registered()
def chunk_overlap(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("agenda").alias("source_type"), F.col("source").alias("title"), F.lit(None).cast("date").alias("hearing_date"),
        F.lit(1).alias("page_number"), F.regexp_replace("text", "\n", "\n\n").alias("text"), F.lit("good").alias("extraction_quality"),
    )
    return chunking.chunks_of(pages, 100, 120, 20)


@registered("""
SELECT o_orderkey, coalesce(strftime(o_orderdate, '%b %-d, %Y'), 'Undated') || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Staff Report' END || ' - ' ||
  CASE WHEN o_orderkey % 3 = 0 THEN 'p. ' || o_custkey ELSE 'pp. ' || o_custkey || '-' || (o_custkey + 2) END AS citation_label FROM orders""")
def citation_labels(spark, sf_dir):
    title = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    last = F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(2)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.citation_label(F.col("o_orderdate"), F.lit("staff_report"), title, F.col("o_custkey").cast("string"), last.cast("string")).alias("citation_label"))


@registered("""SELECT page_id, k::INTEGER AS place, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS k FROM pages)""")
def html_links(spark, sf_dir):
    from pyspark.sql import Window

    small_batches(spark)
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.headings_and_links(F.col("html"))).alias("position", "e")).where("e.kind = 'link'")
    return found.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("position")).alias("place"), F.col("e.href").alias("href"))


@registered("""
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN 'heading' ELSE 'link' END AS kind,
  CASE WHEN event_type = 'click' THEN 'agenda' WHEN event_type = 'view' THEN 'notice' ELSE 'other' END AS type FROM events)
SELECT event_id, coalesce(last_value(CASE WHEN kind = 'heading' AND type <> 'other' THEN type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'other') AS carried FROM e""")
def html_sections(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "click", "The Agenda").when(F.col("event_type") == "view", "NOTICE of it").otherwise("else")
    rows = e.select("event_id", "user_id", F.col("event_id").alias("position"), F.when(F.col("event_id") % 5 == 0, "heading").otherwise("link").alias("kind"), text.alias("text"))
    return html.carried_type(rows, ["user_id"]).select("event_id", "carried")


@registered("""
SELECT page_id, CASE WHEN contains(t, 'correspondence') THEN CASE WHEN regexp_matches(t, 'at hearing|at the hearing|during hearing|during the hearing') THEN 'correspondence_at_hearing' ELSE 'correspondence_pre_hearing' END
  WHEN contains(t, 'staff report') THEN 'staff_report' WHEN contains(t, 'presentation') THEN 'presentation' WHEN contains(t, 'agenda') THEN 'agenda' WHEN contains(t, 'minutes') THEN 'minutes' WHEN contains(t, 'notice') THEN 'notice' ELSE 'other' END AS source_type,
  CASE WHEN page_id % 10 = 2 THEN 'Case ' || page_id WHEN page_id % 10 = 3 THEN 'Item ' || page_id ELSE
  coalesce(nullif(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), ''), url) END AS title
FROM (SELECT page_id, url, lower(url) || CASE page_id % 10 WHEN 0 THEN ' minutes' WHEN 1 THEN ' public notice' WHEN 2 THEN ' staff report' WHEN 3 THEN ' presentation and agenda' WHEN 4 THEN ' correspondence received at the hearing'
  WHEN 5 THEN ' agenda correspondence' WHEN 6 THEN ' agenda and minutes' ELSE '' END AS t FROM pages)""")
def classify_source(spark, sf_dir):
    last = F.col("page_id") % 10
    extra = F.lit("")
    for k, words in enumerate((" Minutes", " Public  NOTICE", " Staff\n REPORT", " Presentation and Agenda", " Correspondence received AT  the hearing", " Agenda correspondence", " agenda and minutes")):
        extra = F.when(last == k, words).otherwise(extra)
    link = F.when(last == 2, F.concat(F.lit(" Case  "), "page_id")).otherwise("View PDF")
    context = F.when(last == 3, F.concat(F.lit("Item "), "page_id")).otherwise(" ")
    return table(spark, sf_dir, "pages").select("page_id", urls.source_type_of(F.concat("url", extra)).alias("source_type"), urls.document_title(link, context, F.col("url")).alias("title"))


ARCHIVE = """<table><tr><th>Hearing Date</th><th>Agenda</th><th>Minutes</th><th>Supporting</th></tr>
<tr><td>January 11, 2024</td><td><a href="/a/1.pdf">Agenda</a></td><td><a href="https://x.org/m1.pdf">Minutes</a></td><td><a href="s1">Supporting</a></td></tr>
<tr><td>January 4, 2024 (CANCELLED)</td><td><a href="/note">Notice of cancellation</a></td><td>N/A</td><td></td></tr>
<tr><td>December 14. 2023 (Joint with Recreation &amp; Park)</td><td>Agenda <a href="b.pdf">PDF</a></td><td>N/A</td><td>N/A</td></tr></table>"""


@registered("""
SELECT * FROM (VALUES
 ('cpc-2024-01-11', DATE '2024-01-11', 'Planning Commission', 'scheduled', 'https://c.org/a/1.pdf', 'https://x.org/m1.pdf', 'https://c.org/archive/s1'),
 ('cpc-2024-01-04', DATE '2024-01-04', 'Planning Commission', 'cancelled', NULL, NULL, NULL),
 ('cpc-2023-12-14-joint-with-recreation-park', DATE '2023-12-14', 'Planning Commission - Joint with Recreation & Park', 'scheduled', 'https://c.org/archive/b.pdf', NULL, NULL))
AS t(hearing_id, hearing_date, title, status, agenda_url, minutes_url, supporting_url)""")
def html_table(spark, sf_dir):
    pages = spark.createDataFrame([("https://c.org/archive/", ARCHIVE)], "source_url string, html string")
    return html.archive_hearings(pages).drop("source_url", "page_order", "position")


@registered("""
SELECT 'https://c.org/o/' || o_orderkey || '/' AS source_url, 'cpc-' || strftime(o_orderdate, '%Y-%m-%d') AS hearing_id, o_orderdate::DATE AS hearing_date, 'Planning Commission' AS title,
  CASE WHEN o_orderkey % 2 = 0 THEN 'cancelled' ELSE 'scheduled' END AS status, 'https://c.org/a/' || o_orderkey || '.pdf' AS agenda_url, NULL::VARCHAR AS minutes_url,
  'https://c.org/o/' || o_orderkey || '/s' || o_custkey AS supporting_url FROM orders WHERE o_orderdate IS NOT NULL""")
def archive_of_orders(spark, sf_dir):
    """The archive parser over all orders: a page with a table of one hearing, from the columns, of each. The few bytes of an
    order become a whole page, so orders are dealt by number; by the file's bytes millions would be one task's."""
    day = F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.when(F.col("o_orderkey") % 2 == 0, " (CANCELLED)").otherwise(""))
    html_of = F.concat(
        F.lit("<table><tr><th>Hearing Date</th><th>Agenda</th><th>Minutes</th><th>Supporting</th></tr><tr><td>"), day,
        F.lit('</td><td><a href="/a/'), F.coalesce(F.col("o_orderkey").cast("string"), F.lit("")), F.lit('.pdf">Agenda</a></td><td>N/A</td><td>'),
        F.coalesce(F.concat(F.lit('<a href="s'), "o_custkey", F.lit('">Supporting</a>')), F.lit("N/A")), F.lit("</td></tr></table>"),
    )
    orders = table(spark, sf_dir, "orders").where("o_orderdate is not null").select("o_orderkey", "o_custkey", "o_orderdate")
    dealt = orders.repartition(max(spark.sparkContext.defaultParallelism, orders.count() // 20_000))
    pages = dealt.select(F.concat(F.lit("https://c.org/o/"), "o_orderkey", F.lit("/")).alias("source_url"), html_of.alias("html"))
    return html.archive_hearings(pages).drop("page_order", "position")


@registered("""
SELECT 'doc-' || substr(sha256('h' || page_id || '|' || u), 1, 20) AS document_id, 'h' || page_id AS hearing_id, t AS source_type, upper(t[1]) || t[2:] AS title, u AS url
FROM (SELECT page_id, 'agenda' AS t, url AS u FROM pages UNION ALL SELECT page_id, 'minutes', url || '/m' FROM pages WHERE page_id % 2 = 0)""")
def unpivot_links(spark, sf_dir):
    hearings = table(spark, sf_dir, "pages").select(F.concat(F.lit("h"), "page_id").alias("hearing_id"), F.col("url").alias("agenda_url"), F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/m"))).alias("minutes_url"))
    return html.archive_documents(hearings).drop("position")


@registered("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first(spark, sf_dir):
    return html.first_of(table(spark, sf_dir, "documents"), ["source", "lang"], F.col("doc_id")).select("doc_id", "source", "lang")


@registered("""
SELECT source AS document_id, min(doc_id)::BIGINT AS position, coalesce(min_by(doc_id, doc_id) FILTER (lang <> 'en'), min(doc_id))::VARCHAR AS title FROM documents GROUP BY source""")
def dedupe_prefer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.lit("h").alias("hearing_id"), F.when(F.col("lang") == "en", "other").otherwise("notice").alias("source_type"), F.col("doc_id").cast("string").alias("title"), F.lit("u").alias("url"), F.col("doc_id").alias("position"))
    return html.preferred_documents(docs).select("document_id", "position", "title")


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "customer")
    new = base.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 10).alias("c_custkey"), F.upper("c_mktsegment").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_name", "c_nationkey")
    return base, new


@registered("""
WITH new AS (SELECT c_custkey + 10 AS c_custkey, upper(c_mktsegment) AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment
FROM customer c FULL JOIN new n USING (c_custkey)""")
def upsert_keep_cols(spark, sf_dir):
    base, new = _customers(spark, sf_dir)
    return S.upsert(base, new, ["c_custkey"], ["c_mktsegment"])


@registered("""
WITH new AS (SELECT c_custkey + 10 AS c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, upper(c_mktsegment) AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM new UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ANTI JOIN new USING (c_custkey)""")
def upsert_all(spark, sf_dir):
    base, new = _customers(spark, sf_dir)
    return S.upsert(base, new, ["c_custkey"])


@registered("""
WITH new AS (SELECT c_custkey + 10 AS c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
SELECT c.c_custkey, c.c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN new n USING (c_custkey)""")
def update_columns(spark, sf_dir):
    base, new = _customers(spark, sf_dir)
    return S.updated(base, new, ["c_custkey"], ["c_acctbal"]).select("c_custkey", "c_name", "c_acctbal")


@registered("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 100 FROM lineitem WHERE l_orderkey % 20 = 0 AND l_linenumber = 1""")
def replace_by_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = lines.where("l_orderkey % 20 = 0 and l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 100)
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.replace(lines, new, gone, ["l_orderkey"])


@registered("SELECT vec_id, label FROM embeddings WHERE NOT (label = 1 AND vec_id % 2 = 0)")
def force_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("label").cast("string").alias("embedding_provider"), (F.col("vec_id") % 2).cast("string").alias("embedding_model"))
    return S.forget_model(rows, "1", "0").select("vec_id", "label")


@registered("SELECT o_orderkey, o_totalprice FROM orders ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_nationkey = 3) USING (o_custkey)")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return S.without(table(spark, sf_dir, "orders"), gone, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@registered("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_path(F.col("url")).alias("path"))


@registered("SELECT min(page_id) AS page_id, substr(sha256(html), 1, 16) AS name FROM pages GROUP BY html HAVING min(page_id) % 4 <> 0")
def snapshot_hash(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    first = html.first_of(pages, ["html"], F.col("page_id"))
    known = first.where("page_id % 4 = 0").select(keys.snapshot_name(F.col("html")).alias("name"))
    return S.new_snapshots(first, known).select("page_id", "name")


@registered("""
SELECT doc_id, 'doc-' || substr(sha256(source || '|' || doc_id), 1, 20) AS document_id, printf('page-%s-%04d', source, doc_id) AS page_id, printf('chunk-%s-%04d', source, doc_id) AS chunk_id,
  'agenda-' || substr(sha256(source || '|' || doc_id || '||' || substr(trim(regexp_replace(lang || '  x ', '\\s+', ' ', 'g')), 1, 160)), 1, 20) AS agenda_item_id,
  'cpc-1998-01-02-' || source AS hearing_id, sha256(lang || ' x') AS content_hash FROM documents""")
def surrogate_keys(spark, sf_dir):
    i, s = F.col("doc_id"), F.col("source")
    odd = F.concat("lang", F.lit("  x "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", keys.document_id(s, F.concat(F.lit(" "), i.cast("string"))).alias("document_id"), keys.page_id(s, i).alias("page_id"), keys.chunk_id(s, i).alias("chunk_id"),
        keys.agenda_item_id(s, i, F.lit(None), odd).alias("agenda_item_id"), keys.hearing_id(F.lit(datetime.date(1998, 1, 2)), F.concat(F.lit("("), s, F.lit(")"))).alias("hearing_id"), T.content_hash(odd).alias("content_hash"),
    )


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def written_dates(spark, sf_dir):
    month = F.date_format("o_orderdate", "MMMM")
    text = F.when(F.col("o_orderkey") % 4 == 0, "February 30, 1998").when(F.col("o_orderkey") % 4 == 1, F.concat(F.upper(month), F.date_format("o_orderdate", " d, yyyy")))
    text = text.otherwise(F.concat(F.lit("on "), month, F.date_format("o_orderdate", " dd. yyyy"), F.lit(" (x)")))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.archive_date(text).alias("day"))


@registered("SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 77)) || '...' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), 80).alias("snippet"))


@registered("SELECT p_partkey, replace(regexp_replace(lower(p_type || '!! ' || p_brand), '[^a-z0-9]+', '-', 'g'), '--', '-') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_type", F.lit("!! "), "p_brand", F.lit(" "))).alias("slug"))


@registered("SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(l, '(?i)^\\s*page\\s+\\d+\\s*$|^\\s*\\d+\\s*$')) AS low FROM (SELECT doc_id, unnest(string_split(text || chr(10) || 'Page ' || doc_id || chr(10) || ' 7 ', chr(10))) AS l FROM documents) GROUP BY doc_id")
def low_value_lines(spark, sf_dir):
    lines = T.lines_of(F.concat("text", F.lit("\nPage "), "doc_id", F.lit("\n 7 ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, T.is_low_value)).cast("bigint").alias("low"))


@registered("SELECT p_partkey, list_filter(list_transform(string_split(p_type || ' , ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part")
def csv_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.csv_list(F.concat("p_type", F.lit(" , ,"), "p_brand")).alias("parts"))


@registered("SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0 AND (source = 'src1' OR lower(text) LIKE '%the%')")
def non_blank(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null and length(trim(text)) > 0").where((F.col("source") == "src1") | F.lower("text").contains("the")).select("doc_id")
