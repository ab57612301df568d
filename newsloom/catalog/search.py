"""Search over the whole corpus and the whole vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query
from newsloom.catalog.filters import SIMILARITY_SQL, query_vector
from newsloom.catalog.fixtures import CORPUS_SQL, VECTORS_SQL, corpus, sql_time, time_text, vectors
from newsloom.functions.text import embedding_text
from newsloom.operators import search as ops
from newsloom.operators.encoder import encode_hashed, encode_query, encode_with_model
from newsloom.operators.similarity import cosine_topk, cosine_topk_batch, with_similarity
from newsloom.operators.trigrams import TrigramIndex
from newsloom.plans.embed import embed_incremental
from newsloom.session import materialize, work_path

_SNIPPET = "case when length(content) > 500 then substr(content, 1, 500) || '...' else content end as content"
_ARTICLE = (
    f"url, title, {{content}}, publisher_name, {sql_time('date')} as published_date, content_id, bucket, "
    "signal_type, source_type, source_feed"
)


@query(
    "browse_articles",
    f"""with {CORPUS_SQL} select {_ARTICLE.format(content='content')} from corpus
    where bucket = 'en' and lower(publisher_name) like '%src1%' and date >= timestamp '2024-01-03'
    order by date desc nulls last, url limit 50 offset 10""",
)
def browse_articles(spark, folder):
    page = ops.browse_articles(
        corpus(spark, folder), limit=50, offset=10, bucket="en", publisher_name="src1", date_from="2024-01-03"
    )
    return page.withColumn("published_date", time_text("published_date"))


@query(
    "browse_after",
    f"""with {CORPUS_SQL} select {_ARTICLE.format(content='content')} from corpus
    where date < timestamp '2024-01-15' or date is null
    order by date desc nulls last, url limit 100""",
)
def browse_after(spark, folder):
    page = ops.browse_after(corpus(spark, folder), 100, "2024-01-15 00:00:00", "~")
    return page.withColumn("published_date", time_text("published_date"))


@query(
    "keyword_search",
    f"""with {CORPUS_SQL} select {_ARTICLE.format(content=_SNIPPET)} from corpus
    where (lower(title) like '%tion%' or lower(content) like '%tion%') and signal_type = 'general_news'
    order by date desc nulls last, url limit 50""",
)
def keyword_search(spark, folder):
    hits = ops.keyword_search(corpus(spark, folder), "tion", limit=50, signal_type="general_news")
    return hits.withColumn("published_date", time_text("published_date"))


def trigram_index(spark, folder):
    """The corpus' trigram index, built once per application and input folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        path = work_path(spark, "trigrams")
        TrigramIndex.build(corpus(spark, folder), path, rows_per_block=500)
        _INDEXES[key] = path
    return TrigramIndex(spark, _INDEXES[key])


_INDEXES: dict[tuple[str, str], str] = {}


@query(
    "keyword_search_indexed",
    f"""with {CORPUS_SQL} select {_ARTICLE.format(content=_SNIPPET)} from corpus
    where (lower(title) like '%ation t%' or lower(content) like '%ation t%') and bucket = 'en'
    order by date desc nulls last, url limit 50""",
)
def keyword_search_indexed(spark, folder):
    hits = trigram_index(spark, folder).search("Ation T", limit=50, bucket="en")
    return hits.withColumn("published_date", time_text("published_date"))


@query(
    "keyword_match_indexed",
    f"""with {CORPUS_SQL} select url, content_id from corpus
    where lower(title) like '%der%und_die%' or lower(content) like '%der%und_die%'""",
)
def keyword_match_indexed(spark, folder):
    return trigram_index(spark, folder).match("der%und_die").select("url", "content_id")


@query(
    "cosine_topk",
    f"""with {VECTORS_SQL}, hits as (select *, {SIMILARITY_SQL} as s from vectors)
    select content_id, url, title, round(s, 4) as similarity from hits order by round(s, 10) desc, content_id limit 30""",
)
def cosine_top(spark, folder):
    vecs = vectors(spark, folder)
    return cosine_topk(vecs, query_vector(vecs), 30).withColumn("similarity", F.round("similarity", 4))


@query(
    "cosine_topk_batch",
    f"""with {VECTORS_SQL},
    cells as (select label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding) as x from vectors),
    means as (select label, i, avg(x) as m from cells group by label, i),
    queries as (select label, list(m order by i) as q from means group by label),
    named as (select ql as query_id, content_id, list_cosine_similarity(embedding, q) as s from vectors, (select label as ql, q from queries))
    select cast(query_id as varchar) as query_id, content_id, round(s, 4) as similarity, rank from
      (select *, row_number() over (partition by query_id order by round(s, 10) desc, content_id) as rank from named)
    where rank <= 10""",
)
def cosine_batch(spark, folder):
    vecs = vectors(spark, folder)
    cells = vecs.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("m"))
    dim = F.array_sort(F.collect_list(F.struct("i", "m")))
    queries = means.groupBy("label").agg(F.transform(dim, lambda c: c["m"]).alias("embedding"))
    hits = cosine_topk_batch(vecs, queries.withColumnRenamed("label", "query_id"), 10, dim=64)
    return hits.select("query_id", "content_id", F.round("similarity", 4).alias("similarity"), "rank")


def _semantic_sql(pool: int, floor: float) -> str:
    return f"""{VECTORS_SQL},
scored as (select content_id, url, title, {SIMILARITY_SQL} as s from vectors),
nearest as (select * from scored order by round(s, 10) desc, content_id limit {pool}),
hydrated as (
  select h.content_id, round(h.s, 4) as similarity, h.s, coalesce(nullif(h.url, ''), c.url, '') as url,
         coalesce(nullif(h.title, ''), c.title) as title, c.content, c.publisher_name, c.date, c.bucket, c.league,
         c.signal_type, c.source_type
  from nearest h left join corpus c on h.content_id = c.content_id where h.s >= {floor}
)"""

_RESULT = (
    f"url, title, {_SNIPPET}, publisher_name, coalesce(strftime(date, '%Y-%m-%d %H:%M:%S'), '') as published_date, "
    "content_id, similarity, coalesce(nullif(bucket, ''), league) as bucket, signal_type, source_type"
)


@query(
    "semantic_search",
    f"""with {_semantic_sql(150, 0.05)}
    select {_RESULT} from hydrated order by round(s, 10) desc, content_id limit 50""",
)
def semantic_search(spark, folder):
    vecs = vectors(spark, folder)
    found = ops.semantic_search(vecs, corpus(spark, folder), query_vector(vecs), limit=50, floor=0.05)
    return ops.result_projection(found)


@query(
    "semantic_search_filtered",
    f"""with {_semantic_sql(150, 0.0)}
    select {_RESULT} from hydrated where (league = 'en' or bucket = 'en') and signal_type = 'general_news'
    order by round(s, 10) desc, content_id limit 50""",
)
def semantic_search_filtered(spark, folder):
    vecs = vectors(spark, folder)
    found = ops.semantic_search(
        vecs, corpus(spark, folder), query_vector(vecs), limit=50, topic="en", signal_type="general_news"
    )
    return ops.result_projection(found)


@query(
    "semantic_search_prefilter",
    f"""with {VECTORS_SQL}
    select v.content_id, round({SIMILARITY_SQL.replace('embedding,', 'v.embedding,')}, 4) as similarity
    from vectors v join corpus c on v.content_id = c.content_id
    where (c.league = 'la_liga' or c.bucket = 'la_liga') and {SIMILARITY_SQL.replace('embedding,', 'v.embedding,')} >= 0
    order by round({SIMILARITY_SQL.replace('embedding,', 'v.embedding,')}, 10) desc, v.content_id limit 20""",
)
def semantic_search_prefilter(spark, folder):
    vecs = vectors(spark, folder)
    found = ops.semantic_search(
        vecs, corpus(spark, folder), query_vector(vecs), limit=20, topic="la_liga", mode="prefilter"
    )
    return found.select("content_id", "similarity")


# With all cells probed the answer is that of the exact search; recall with fewer is tested apart.
@query(
    "approx_topk",
    f"""with {VECTORS_SQL},
    scored as (select content_id, url, title, {SIMILARITY_SQL} as s from vectors)
    select content_id, url, title, round(s, 4) as similarity from scored order by round(s, 10) desc, content_id limit 30""",
)
def approx_topk(spark, folder):
    vecs = vectors(spark, folder)
    index = ops.CellIndex.build(vecs, lists=16)
    hits = index.search(query_vector(vecs), 30, probes=16)
    return hits.withColumn("similarity", F.round("similarity", 4))


# Word-hash vectors of every article, as (content, cell, weight).
_CELLS_SQL = f"""{CORPUS_SQL},
words as (
  select content_id, unnest(string_split_regex(lower(title || '. ' || content), '[^a-z0-9]+')) as word from corpus
),
tf as (
  select content_id, cast(('0x' || substr(md5(word), 1, 8))::ubigint % 384 as int) as cell, count(*) as n
  from words where word <> '' group by all
),
norms as (select content_id, sqrt(sum(n * n)) as norm from tf group by 1),
cells as (select content_id, cell, n / norm as weight from tf join norms using (content_id))"""


@query(
    "encode_hashed",
    f"""with {_CELLS_SQL}
    select content_id, cell, round(weight, 4) as weight from cells""",
)
def encode(spark, folder):
    texts = corpus(spark, folder)
    encoded = encode_hashed(texts, "content_id", embedding_text(F.col("title"), F.col("content")))
    # Written first, as embeddings are: filters on the exploded cells would encode again.
    encoded = materialize(encoded, "encoded")
    cells = encoded.select("content_id", F.posexplode("embedding").alias("cell", "weight")).where("weight <> 0")
    return cells.withColumn("weight", F.round(F.col("weight").cast("double"), 4))


def _letter_model():
    """A small model object, loaded once per task: shares of three letters."""

    def encode_batch(texts):
        return [[t.count("a") / max(1, len(t)), t.count("e") / max(1, len(t)), t.count("t") / max(1, len(t))] for t in texts]

    return encode_batch


@query(
    "encode_with_model",
    f"""with {CORPUS_SQL}
    select content_id, round(cast((length(content) - length(replace(content, 'a', ''))) / length(content) as float), 4) as a_share from corpus""",
)
def model_encoder(spark, folder):
    encoded = encode_with_model(corpus(spark, folder), "content_id", F.col("content"), _letter_model)
    return encoded.select("content_id", F.round(F.get("embedding", F.lit(0)), 4).alias("a_share"))


@query(
    "embed_incremental",
    f"""with {_CELLS_SQL},
    v0 as (select v.content_id, v.url, list_sum(list_transform(v.embedding, lambda x: x * x)) as length2 from
           (with {VECTORS_SQL} select * from vectors) v)
    select content_id, url, round(length2, 3) as length2, false as fresh from v0
    union all
    select c.content_id, c.url, 1.0, true from corpus c where content_id not in (select content_id from v0)
      and content_id in (select content_id from norms)
    union all
    select c.content_id, c.url, 0.0, true from corpus c where content_id not in (select content_id from v0)
      and content_id not in (select content_id from norms)""",
)
def embed(spark, folder):
    at = F.lit("2026-01-02 00:00:00").cast("timestamp")
    old = vectors(spark, folder).select(
        "content_id", "url", "title", "embedding", F.lit("2025-01-01 00:00:00").cast("timestamp").alias("embedded_at")
    )
    after = embed_incremental(corpus(spark, folder), old, at=at)
    squares = F.aggregate(
        F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x
    )
    return after.select("content_id", "url", F.round(squares, 3).alias("length2"), (F.col("embedded_at") == at).alias("fresh"))


@query(
    "embed_incremental_model",
    f"""with {CORPUS_SQL}, v0 as (select v.content_id from (with {VECTORS_SQL} select * from vectors) v)
    select content_id, cast(null as bigint) as a_percent, false as fresh from v0
    union all
    select content_id, cast(floor(100.0 * (length(t) - length(replace(t, 'a', ''))) / length(t) + 0.0001) as bigint), true
    from (select content_id, coalesce(title, '') || '. ' || content as t from corpus where content_id not in (select content_id from v0))""",
)
def embed_model(spark, folder):
    at = F.lit("2026-01-02 00:00:00").cast("timestamp")
    old = vectors(spark, folder).select(
        "content_id", "url", "title", "embedding", F.lit("2025-01-01 00:00:00").cast("timestamp").alias("embedded_at")
    )
    after = embed_incremental(corpus(spark, folder), old, at=at, model=_letter_model)
    fresh = F.col("embedded_at") == at
    share = F.get("embedding", F.lit(0)).cast("double")
    percent = F.when(fresh, F.floor(100 * share + 0.0001))
    return after.select("content_id", percent.cast("bigint").alias("a_percent"), fresh.alias("fresh"))


@query(
    "semantic_search_text",
    f"""with {_CELLS_SQL},
    qwords as (select unnest(['transfer', 'window', 'the', 'and', 'tion', 'table']) as word),
    q as (select cast(('0x' || substr(md5(word), 1, 8))::ubigint % 384 as int) as cell, count(*) as n from qwords group by 1),
    qn as (select cell, n / (select sqrt(sum(n * n)) from q) as w from q),
    scored as (select content_id, sum(weight * w) as s from cells join qn using (cell) group by 1)
    select content_id, round(s, 3) as similarity from scored order by round(s, 4) desc, content_id limit 20""",
)
def semantic_search_text(spark, folder):
    texts = corpus(spark, folder)
    encoded = encode_hashed(texts, "content_id", embedding_text(F.col("title"), F.col("content")))
    vecs = encoded.join(texts.select("content_id", "url", "title"), "content_id")
    wanted = encode_query(spark, "Transfer window: the AND tion table")
    hits = with_similarity(vecs, wanted).where(~F.isnan("similarity"))
    best = hits.orderBy(F.round("similarity", 4).desc(), "content_id").limit(20)
    return best.select("content_id", F.round("similarity", 3).alias("similarity"))
