"""Vector and keyword search, evaluation, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import clamp_top_k
from ..functions import tokens, vector
from ..operators import bm25, embed, search
from ..plans import adapters
from . import query, table

_COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"
_Q0 = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)"


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


def _search_sql(rows: str, id_: str, text: str, where: str = "") -> str:
    return f"""WITH {adapters.META}, {adapters.CHUNKS}, {adapters.SUMMARIES}, {_Q0}
SELECT m.url, m.council_name, strftime(m.date, '%Y-%m-%d') AS date, c.{text}, {_COS.format(a='c.embedding', b='q.v')} AS score
FROM {rows} c JOIN meta m ON c.doc_id = m.doc_id, q {where}
ORDER BY list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) DESC NULLS LAST, c.{id_} LIMIT 5"""


@query(_search_sql("chunks", "chunk_id", "chunk_text"))
def chunk_search_topk(spark, sf_dir):
    return _rounded(search.search_chunks(adapters.chunks(spark, sf_dir), adapters.metadata(spark, sf_dir), adapters.vector(spark, sf_dir)))


@query(_search_sql("chunks", "chunk_id", "chunk_text", "WHERE m.ministry = 'src3'"))
def chunk_search_ministry(spark, sf_dir):
    return _rounded(search.search_chunks(adapters.chunks(spark, sf_dir), adapters.metadata(spark, sf_dir), adapters.vector(spark, sf_dir), ministry="src3"))


@query(_search_sql("summaries", "doc_id", "summary"))
def summary_search_topk(spark, sf_dir):
    return _rounded(search.search_summaries(adapters.summaries(spark, sf_dir), adapters.metadata(spark, sf_dir), adapters.vector(spark, sf_dir)))


@query(_search_sql("summaries", "doc_id", "summary", "WHERE m.ministry = 'src5'"))
def summary_search_ministry(spark, sf_dir):
    return _rounded(search.search_summaries(adapters.summaries(spark, sf_dir), adapters.metadata(spark, sf_dir), adapters.vector(spark, sf_dir), ministry="src5"))


@query(f"""WITH s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, chunk_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, chunk_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 20""")
def batch_search_ranked(spark, sf_dir):
    return _rounded(search.batch_search(adapters.chunks(spark, sf_dir), adapters.query_vectors(spark, sf_dir), 20))


@query(f"WITH {_Q0} SELECT vec_id, {_COS.format(a='embedding', b='q.v')} AS score FROM embeddings, q")
def cosine_scores(spark, sf_dir):
    v = vector.literal(adapters.vector(spark, sf_dir))
    return _rounded(table(spark, sf_dir, "embeddings").select("vec_id", vector.cosine(F.col("embedding"), v).alias("score")))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first, len(embedding) = 64 AS has_dim FROM embeddings")
def l2_norm(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.l2_norm(e), 6).alias("norm"), F.round(F.get(vector.l2_normalize(e), F.lit(0)), 6).alias("first"), vector.has_dim(e, 64).alias("has_dim"))


@query("SELECT vec_id, concat('[', array_to_string(list_transform(embedding, lambda x: printf('%.8f', CAST(x AS DOUBLE))), ', '), ']') AS literal, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def vector_literal_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vector.to_text(F.col("embedding")).alias("literal"))
    return e.withColumn("n", F.size(vector.from_text(F.col("literal"))))


@query("""WITH q AS (SELECT doc_id, list_transform(range(64), lambda i: CAST(('0x' || substr(sha256(concat(sha256(text), ':', i // 16)), CAST(i % 16 * 4 + 1 AS BIGINT), 4)) AS INTEGER) / 32767.5 - 1) AS v FROM documents)
SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(CAST(round(CAST(CAST(x / sqrt(list_dot_product(v, v)) AS FLOAT) AS DOUBLE) * 10000) AS INTEGER) AS VARCHAR)), ' ') AS embedding FROM q""")
def digest_embedding(spark, sf_dir):
    v = embed.digest_embedding(F.col("text"), 64)
    d = table(spark, sf_dir, "documents").select("doc_id", v.alias("v"))
    return d.select("doc_id", F.array_join(F.transform("v", lambda x: F.round(x.cast("double") * 10000).cast("int").cast("string")), " ").alias("embedding"))


@query("SELECT doc_id, greatest(1, least(100, coalesce(nullif(CAST(doc_id % 130 - 5 AS INTEGER), 0), 5))) AS k FROM documents")
def topk_clamp(spark, sf_dir):
    clamped = F.create_map(*[F.lit(x) for k in range(-5, 125) for x in (k, clamp_top_k(k))])
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(clamped, (F.col("doc_id") % 130 - 5).cast("int")).alias("k"))


_TERMS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


@query(f"""WITH t AS (SELECT doc_id, {_TERMS.format(x='text')} AS terms FROM documents), u AS (SELECT doc_id, CAST(len(terms) AS INTEGER) AS dl, unnest(terms) AS term FROM t)
SELECT doc_id, term, count(*) AS tf, dl FROM u GROUP BY ALL""")
def term_postings(spark, sf_dir):
    return bm25.postings(table(spark, sf_dir, "documents"), tokens.tokens(F.col("text")))


_ASKED = ["the", "der", "que", "the"]


@query(f"""WITH t AS (SELECT doc_id, {_TERMS.format(x='text')} AS terms FROM documents), st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM t),
a AS (SELECT unnest(['the', 'der', 'que']) AS term, unnest([2, 1, 1]) AS times), u AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM t),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM a) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
SELECT doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN a USING (term) JOIN idf USING (term), st GROUP BY doc_id""")
def bm25_scores(spark, sf_dir):
    return _rounded(bm25.search(table(spark, sf_dir, "documents"), tokens.tokens(F.col("text")), _ASKED))


_RERANK = """c AS (SELECT query_id, doc_id, {terms} AS terms, {asked} AS asked FROM cand),
st AS (SELECT query_id, count(*) AS n, avg(len(terms)) AS avgdl FROM c GROUP BY query_id),
u AS (SELECT query_id, doc_id, len(terms) AS dl, unnest(terms) AS term FROM c), tf AS (SELECT query_id, doc_id, dl, term, count(*) AS tf FROM u GROUP BY ALL),
raw AS (SELECT tf.query_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st ON tf.query_id = st.query_id GROUP BY tf.query_id, term, n),
mean AS (SELECT query_id, avg(raw) AS mean FROM raw GROUP BY query_id),
idf AS (SELECT raw.query_id, term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw JOIN mean ON raw.query_id = mean.query_id),
ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(asked) AS term FROM (SELECT DISTINCT query_id, asked FROM c)) GROUP BY ALL),
sc AS (SELECT tf.query_id, tf.doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN ask ON tf.query_id = ask.query_id AND tf.term = ask.term JOIN idf ON tf.query_id = idf.query_id AND tf.term = idf.term JOIN st ON tf.query_id = st.query_id GROUP BY ALL)"""


@query(f"""WITH cand AS (SELECT lang AS query_id, doc_id, text FROM documents), {_RERANK.format(terms=_TERMS.format(x='text'), asked="['the', 'der', 'le', 'the', query_id]")}
SELECT c.query_id, c.doc_id, round(coalesce(score, 0), 6) AS score FROM c LEFT JOIN sc ON c.query_id = sc.query_id AND c.doc_id = sc.doc_id""")
def bm25_rerank(spark, sf_dir):
    cand = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "doc_id", "text")
    asked = F.array(F.lit("the"), F.lit("der"), F.lit("le"), F.lit("the"), F.col("query_id"))
    return bm25.rerank(cand, tokens.tokens(F.col("text")), asked, ["query_id"]).select("query_id", "doc_id", F.round("bm25", 6).alias("score"))


@query(f"""WITH t AS (SELECT doc_id, {_TERMS.format(x='text')} AS terms FROM documents), st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM t),
u AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM t), tf AS (SELECT doc_id, dl, count(*) AS tf FROM u WHERE term = 'idiot' GROUP BY ALL), df AS (SELECT count(*) AS df FROM tf),
r AS (SELECT doc_id, (ln(n - df + 0.5) - ln(df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS score FROM tf, df, st)
SELECT CAST(row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank, concat('doc://', doc_id) AS url FROM r ORDER BY rank LIMIT 20""")
def keyword_search(spark, sf_dir):
    index = adapters.metadata(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "url", "discussion_text")
    return search.keyword_search(index, tokens.tokens(F.col("discussion_text")), ["idiot"])


@query(f"""WITH {adapters.META}, {adapters.SUMMARIES} SELECT CAST(m.doc_id AS VARCHAR) AS id, m.url,
array_to_string(regexp_extract_all(s.summary, '[\\p{{L}}\\p{{N}}]+'), ' ') AS summary, array_to_string(regexp_extract_all(m.discussion_text, '[\\p{{L}}\\p{{N}}]+'), ' ') AS discussion_text
FROM meta m JOIN summaries s ON m.doc_id = s.doc_id ORDER BY m.date DESC NULLS LAST, m.doc_id LIMIT 100""")
def export_for_index(spark, sf_dir):
    return search.export_documents(adapters.metadata(spark, sf_dir), adapters.summaries(spark, sf_dir), tokens.token_text)


@query(f"""WITH {adapters.META}, {adapters.CHUNKS}, {adapters.SUMMARIES},
qs AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, concat('the der que ', vec_id) AS query_text, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
a AS (SELECT q.query_id, c.chunk_id, c.doc_id, c.chunk_text AS text, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS score FROM chunks c, qs q),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM a),
b AS (SELECT q.query_id, c.doc_id, c.summary AS text, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS score FROM summaries c, qs q),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_id) AS rank FROM b) WHERE rank <= 20),
{_RERANK.format(terms=_TERMS.format(x='text'), asked="['the', 'der', 'que', query_id]")},
re AS (SELECT cand.query_id, cand.doc_id, cand.text, coalesce(sc.score, 0) AS score, row_number() OVER (PARTITION BY cand.query_id ORDER BY coalesce(sc.score, 0) DESC, cand.rank) AS rank FROM cand LEFT JOIN sc ON cand.query_id = sc.query_id AND cand.doc_id = sc.doc_id),
runs AS (SELECT query_id, doc_id, text, score, rank, 'chunks' AS run FROM ra WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, text, score, rank, 'summaries' FROM cand UNION ALL SELECT query_id, doc_id, text, score, rank, 'rerank_summaries' FROM re)
SELECT r.query_id, q.query_text, r.run, CAST(r.rank AS INTEGER) AS rank, r.doc_id, m.url, substr(r.text, 1, 50) AS text_or_summary, round(r.score, 6) AS score FROM runs r JOIN meta m ON r.doc_id = m.doc_id JOIN qs q ON r.query_id = q.query_id""")
def compare_runs_union(spark, sf_dir):
    qs = [(q, f"the der que {q}", v) for q, v in adapters.query_vectors(spark, sf_dir)]
    return _rounded(search.compare_runs(adapters.chunks(spark, sf_dir), adapters.summaries(spark, sf_dir), adapters.metadata(spark, sf_dir), qs, tokens.tokens))


_GRAMS = r"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), CAST(i AS BIGINT), 3)))))"


@query(f"""WITH g AS (SELECT item_id, {_GRAMS.format(x='text')} AS a, {_GRAMS.format(x="'the meeting of the council'")} AS b FROM benchmark)
SELECT item_id, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS similarity FROM g""")
def trigram_similarity(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(vector.trigram_similarity(F.col("text"), F.lit("the meeting of the council")), 6).alias("similarity"))


@query()
def lsh_search(spark, sf_dir):
    return search.lsh_search(adapters.chunks(spark, sf_dir), adapters.vector(spark, sf_dir))


@query("SELECT true AS ok")
def health(spark, sf_dir):
    return spark.range(1).select(F.lit(search.health(spark)).alias("ok"))
