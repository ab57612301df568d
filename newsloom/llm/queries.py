"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import (
    exact, licenses, minhash, mixing, packing, query, ranked, secrets, sharding, simhash, spelling, substring, topk, toxicity,
)
from newsloom.llm.common import documents


def vocabulary() -> str:
    """The vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


WS = r"[\x20\x09-\x0D]"
SIZE_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIX_SQL = f"""
with rows as (
  select doc_id, source, {SIZE_SQL} as size,
         cast('0x' || substr(md5('mix:' || doc_id), 1, 15) as bigint) as key from documents
),
sums as (select source, cast(sum(size) as bigint) as source_size from rows group by source),
named as (select *, row_number() over (order by source nulls last) as rank from sums),
weighed as (select *, [5, 2, 1][(rank - 1) % 3 + 1] as weight from named),
filled as (
  select *, sum(3 * source_size) over o as cap_sum, sum(weight) over o as weight_sum,
         sum(source_size) over () as words, sum(weight) over () as weight_all
  from weighed window o as (order by source_size / weight, rank rows unbounded preceding)
),
marked as (
  select *, cap_sum * weight + 3::hugeint * source_size * (weight_all - weight_sum) < words * weight as stopped from filled
),
freed as (
  select *, words - 3 * coalesce(sum(case when stopped then source_size end) over (), 0) as left_over,
         weight_all - coalesce(sum(case when stopped then weight end) over (), 0) as free_weight from marked
),
targets as (
  select source, source_size, case when stopped then cast(3 * source_size as double)
    else cast(left_over as double) * cast(weight as double) / cast(free_weight as double) end as target from freed
),
budgets as (
  select *, cast(floor(target + 0.5) as bigint) as budget from targets
),
epochs as (
  select *, case when source_size > 0 then budget // source_size else 0 end as whole from budgets
),
run as (
  select r.*, e.source_size, e.target, e.whole, e.budget - e.whole * e.source_size as rest,
         coalesce(sum(size) over (partition by r.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
  from rows r join epochs e on r.source is not distinct from e.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(whole * size + greatest(0, least(size, rest - ahead)) as bigint) as taken from run"""


@query("op1_mix_sources", MIX_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, folder))


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


EXACT_SQL = f"""
with rows as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '{WS}+', '', 'g')) as text_sha256 from documents
),
best as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size
  from rows window w as (partition by text_sha256 order by points desc, doc_id)
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from best"""


@query("op4_exact_dedup", EXACT_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, folder))


@query("op10_shard_histogram")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, folder), 8)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), vocabulary())


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digest_of_rest(documents(spark, folder))


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digests(documents(spark, folder))


@query("op9_license_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, folder)).drop("detections")


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (
  select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
),
ordered as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)
select query_id, cast(rank as integer) as rank, vec_id, score from ordered where rank <= 20"""


@query("op5_exact_topk", TOPK_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return topk.exact_topk(vectors, vectors.where("vec_id % 20 = 0"))


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH_SQL = f"""
with recursive words as (
  select doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') as w from documents
),
sets as (
  select doc_id, list_distinct(case when len(w) < 2 then w
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words
),
each as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
common as (
  select a.doc_id as a, b.doc_id as b, a.n as x, b.n as y, count(*) as c
  from each a join each b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2, 3, 4
),
links as (select a, b from common where 100 * c >= 80 * (x + y - c)),
both_ways as (select a, b from links union all select b, a from links),
reached as (
  select doc_id, doc_id as other from documents
  union select r.doc_id, l.b from reached r join both_ways l on r.other = l.a
),
lowest as (select doc_id, min(other) as component_id from reached group by doc_id)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept
from sets s join lowest l on s.doc_id = l.doc_id"""


@query("op11_minhash_near_dedup", MINHASH_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED_SQL = f"""
with d as (select doc_id, regexp_extract_all({LOWER_SQL}, '{TERM}') as t from documents),
sizes as (select doc_id, cast(len(t) as hugeint) as n from d where len(t) > 0),
totals as (select cast(count(*) as hugeint) as docs, sum(n) as words from sizes),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
weights as (
  select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as hugeint) as w from df, totals
),
asked as (select distinct item_id, unnest(regexp_extract_all({LOWER_SQL}, '{TERM}')) as term from benchmark),
parts as (
  select item_id, doc_id, w * ((1000000000 * cast(tf as hugeint)) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) as part
  from asked join tf using (term) join weights using (term) join sizes using (doc_id), totals
),
scores as (select item_id, doc_id, cast(sum(part) as bigint) as score from parts group by all having sum(part) > 0),
numbered as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores)
select item_id, cast(rank as integer) as rank, doc_id, score from numbered where rank <= 50"""


@query("op12_ranked_search", RANKED_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.ranked_search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


# crc32 byte by byte, with a table of 256 entries from its rule
SPELLING_SQL = f"""
with recursive crc_table as (
  select list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b)) as crc
),
runs as (
  select doc_id, run, count(*) as times from (
    select doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[a-zA-Z\\x{{C0}}-\\x{{FF}}]+')) as run from documents)
  where length(run) >= 6 group by all
),
hashed as (
  select run, times, xor(list_reduce(
    list_transform(range(0, octet_length(encode(doc_id || ':' || run))), lambda i: cast('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2) as bigint)),
    lambda c, x: xor(c // 256, crc[xor(c, x) % 256 + 1]), 4294967295), 4294967295) as h from runs, crc_table
),
words as (
  select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times
  from hashed
),
vocabulary as (
  select word, cast(sum(times) as bigint) as n from words where length(word) >= 6 group by word having sum(times) >= 5
),
cuts as (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, unnest(range(1, length(word) + 1)) as i from vocabulary)
),
pairs as (
  select a.word, b.word as near from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, v.word from cuts c join vocabulary v on c.rest = v.word
  union select v.word, c.word from cuts c join vocabulary v on c.rest = v.word
),
named as (
  select p.word, p.near, v.n as near_n, count(*) over (partition by p.word) as n_near,
         row_number() over (partition by p.word order by v.n desc, encode(p.near)) as best
  from pairs p join vocabulary v on p.near = v.word
),
forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * v.n then near end as form,
         case when near_n >= 5 * v.n then near_n end as form_n
  from vocabulary v left join named m on v.word = m.word and best = 1
),
followed as (
  select word, form, word as root from forms
  union all select f.word, n.form, f.form from followed f join forms n on f.form = n.word
)
select f.word, f.n, f.n_near, f.form, f.form_n, r.root from forms f join followed r on f.word = r.word and r.form is null"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder))
