"""Admission of the discovered items."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query
from newsloom.catalog.fixtures import BUCKETS, DISCOVERED_SQL, discovered, seen, sql_normalized
from newsloom.operators import admission as ops
from newsloom.operators.adaptive import Limits, admit_adaptive
from newsloom.operators.filters import admissible_url
from newsloom.operators.joins import anti_join_seen
from newsloom.operators.seen_urls import SeenUrls
from newsloom.session import work_path
from newsloom.streaming.ingest import known_urls

QUOTA, CAP = 100, 10
_ORDER = "page, bucket_pos, pos"

ADMITTED_SQL = f"""{DISCOVERED_SQL},
known as (select {sql_normalized('url')} as url_norm from seen),
firsts as (select * from hosts qualify row_number() over (partition by url_norm order by {_ORDER}) = 1),
fresh as (select * from firsts where url_norm not in (select url_norm from known)),
capped as (select * from fresh qualify row_number() over (partition by bucket, domain order by {_ORDER}) <= {CAP}),
admitted as (select * from capped qualify row_number() over (partition by bucket order by {_ORDER}) <= {QUOTA})"""

DECIDED_SQL = f"""{ADMITTED_SQL},
cut as (select bucket, max(row(page, pos)) as last from admitted group by bucket having count(*) >= {QUOTA}),
decided as (
  select d.bucket, d.page, d.pos, a.pos is not null as accepted
  from discovered d left join admitted a on d.bucket = a.bucket and d.page = a.page and d.pos = a.pos
       left join cut c on c.bucket = d.bucket
  where c.last is null or row(d.page, d.pos) <= c.last
)"""

_KEY = "bucket, page, pos"


def admitted_keys(spark, folder):
    return ops.admit_keys(discovered(spark, folder), seen(spark, folder), QUOTA)


def decided(spark, folder):
    return ops.decided_items(discovered(spark, folder), admitted_keys(spark, folder), QUOTA)


def _keys(spark, folder):
    return admissible_url(ops.candidate_keys(discovered(spark, folder)))


@query("first_seen_dedup", f"with {ADMITTED_SQL} select {_KEY} from firsts")
def first_seen_dedup(spark, folder):
    return ops.first_seen_dedup(_keys(spark, folder)).select("bucket", "page", "pos")


@query("anti_join_seen", f"with {ADMITTED_SQL} select {_KEY}, url_norm from fresh")
def anti_join(spark, folder):
    firsts = ops.first_seen_dedup(_keys(spark, folder))
    return anti_join_seen(firsts, seen(spark, folder)).select("bucket", "page", "pos", "url_norm")


# The known URLs in two commits of a filtered table.
@query("anti_join_seen_filtered", f"with {ADMITTED_SQL} select {_KEY}, url_norm from fresh")
def anti_join_filtered(spark, folder):
    known = known_urls(seen(spark, folder))
    table = SeenUrls(spark, work_path(spark, "seen-urls"), ranges=16, bits=1 << 16)
    for commit in (0, 1):
        table.add(known.where(F.pmod(F.xxhash64("url_norm"), F.lit(2)) == commit), commit)
    return table.unseen(ops.first_seen_dedup(_keys(spark, folder))).select("bucket", "page", "pos", "url_norm")


@query("domain_cap", f"with {ADMITTED_SQL} select {_KEY}, domain from capped")
def domain_cap(spark, folder):
    fresh = anti_join_seen(ops.first_seen_dedup(_keys(spark, folder)), seen(spark, folder))
    return ops.cap_domains(fresh, CAP).select("bucket", "page", "pos", "domain")


@query(
    "bucket_quota",
    f"""with {DISCOVERED_SQL}
    select {_KEY} from hosts qualify row_number() over (partition by bucket order by {_ORDER}) <= {QUOTA}""",
)
def bucket_quota(spark, folder):
    return ops.cap_buckets(_keys(spark, folder), QUOTA).select("bucket", "page", "pos")


@query("admit_static", f"with {ADMITTED_SQL} select {_KEY}, url from admitted")
def admit_static(spark, folder):
    admitted = ops.admit_static(discovered(spark, folder), seen(spark, folder), QUOTA, buckets=len(BUCKETS))
    return admitted.select("bucket", "page", "pos", "url")


@query("admit_adaptive")
def adaptive(spark, folder):
    limits = Limits(target_total=QUOTA * len(BUCKETS), init_quota=QUOTA)
    result = admit_adaptive(
        discovered(spark, folder), seen(spark, folder), [(b, 2) for b in BUCKETS], limits
    )
    return result.items.select("bucket", "page", "pos", F.col("url"))
