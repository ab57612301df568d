"""Admission with quota reallocation between buckets.

Buckets are visited in turn, one page per round. While quotas do not change, what is
accepted can be computed for all remaining pages at once; only the small control rule
(who is still active, who donates quota) is a sequence over page counts. So the work
goes in epochs: decide everything under the current quotas, follow the rule until a
quota it changed would change a decision, keep what was accepted up to that point, start
the next epoch.

The rule is followed by its change points. Quotas bound the pages on which anything is
accepted; on all others every item is passed over, so a round of such pages that leaves
the state as it was is repeated, unread, up to the next page that can differ. The driver
gets the pages with accepted rows and, after a change of quota, the first page whose
decisions it could alter; how many pages there are has no part in it.

Within an epoch one URL offered by two buckets is the only tie between buckets. Which
offer wins depends on whether the earlier one was accepted, so decisions are repeated
with the losing offers blocked until they no longer change. Every repeat settles at
least the earliest open offer; without shared URLs the first pass is final.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import (
    DUP_RATE_BAD,
    DUP_WINDOW_PAGES,
    INIT_QUOTA,
    LOW_YIELD_ADDS,
    MAX_DONATION,
    MAX_QUOTA,
    MIN_QUOTA,
    TARGET_TOTAL,
)
from newsloom.operators.admission import (
    ITEM_KEY,
    candidate_keys,
    domain_cap,
    visit_order,
)
from newsloom.operators.filters import admissible_url
from newsloom.operators.joins import anti_join_seen, hint_small
from newsloom.operators.ranking import first_k, first_per_key
from newsloom.session import materialize


@dataclass
class Limits:
    target_total: int = TARGET_TOTAL
    init_quota: int = INIT_QUOTA
    min_quota: int = MIN_QUOTA
    max_quota: int = MAX_QUOTA
    max_donation: int = MAX_DONATION
    low_yield: int = LOW_YIELD_ADDS
    window_pages: int = DUP_WINDOW_PAGES
    bad_rate: float = DUP_RATE_BAD


@dataclass
class BucketState:
    """Control state of one bucket; there is one of these per configured bucket."""

    name: str
    pos: int
    feeds: int
    quota: int
    count: int = 0
    active: bool = True
    next_page: int = 0
    rates: deque = field(default_factory=deque)


def _reachable(keys: DataFrame, states: list[BucketState]) -> DataFrame:
    """Drop API pages behind a gap: an empty API page ends its bucket.

    Pages count from 0; the first ``feeds`` of a bucket are feeds, where a gap is harmless.
    """
    spark = keys.sparkSession
    feeds = spark.createDataFrame([(s.name, s.feeds) for s in states], "bucket string, feeds int")
    pages = keys.select("bucket", "page").distinct().join(hint_small(feeds, len(states)), "bucket")
    api = pages.where(F.col("page") >= F.col("feeds"))
    followers = api.select("bucket", (F.col("page") - 1).alias("page"), F.lit(True).alias("_next"))
    last_feed = feeds.select("bucket", (F.col("feeds") - 1).alias("page"), "feeds")
    steps = api.unionByName(last_feed.select("bucket", F.col("page").cast("bigint"), "feeds"))
    gaps = (
        steps.join(followers, ["bucket", "page"], "left_anti")
        .groupBy("bucket")
        .agg(F.min("page").alias("_end"))
    )
    inside = keys.join(hint_small(gaps, len(states)), "bucket")
    return inside.where(F.col("page") <= F.col("_end")).drop("_end")


@dataclass
class _Epoch:
    """What is open at the start of an epoch and the quotas it is decided under."""

    open_keys: DataFrame
    states: dict[str, BucketState]
    used: DataFrame | None
    limits: Limits
    rows: int

    def per_bucket(self, value):
        """A number per bucket as an expression; there are only as many as buckets."""
        pairs = [x for name, s in self.states.items() for x in (F.lit(name), F.lit(value(s)))]
        return F.element_at(F.create_map(*pairs), F.col("bucket"))

    def top_cap(self) -> int:
        return max(domain_cap(self.limits.max_quota), domain_cap(self.limits.init_quota))

    def own_first(self, blocked: DataFrame | None) -> DataFrame:
        """Each bucket's first offer of a URL, unless blocked by another bucket."""
        keys = self.open_keys
        if blocked is not None:
            keys = keys.join(blocked, ["bucket", "url_norm"], "left_anti")
        return first_per_key(keys, ["bucket", "url_norm"], visit_order())

    def placed(self, offers: DataFrame) -> DataFrame:
        """Offers with their number within (bucket, domain), earlier epochs included.

        Those beyond every possible cap are left out.
        """
        keys, top = ["bucket", "domain"], self.top_cap()
        ranked = first_k(offers, keys, visit_order(), F.lit(top), top, _page_block(), rank="place")
        if self.used is None:
            return ranked
        counted = ranked.join(hint_small(self.used, self.rows), keys, "left")
        return counted.withColumn("place", F.col("place") + F.coalesce("used", F.lit(0))).drop("used")

    def decide(self, blocked: DataFrame | None) -> DataFrame:
        """Accepted keys, given the offers blocked by other buckets."""
        fits = self.placed(self.own_first(blocked)).where(
            F.col("place") <= self.per_bucket(lambda s: domain_cap(s.quota))
        )
        top = max(self.limits.max_quota, self.limits.init_quota)
        room = self.per_bucket(lambda s: s.quota - s.count)
        kept = first_k(fits, ["bucket"], visit_order(), room, top, _page_block())
        return kept.select("bucket", "bucket_pos", "page", "pos", "url_norm", "domain")


def _page_block():
    return F.floor(F.col("page") / 64)


def _won_earlier():
    won_page, won_pos = F.col("won.page"), F.col("won.bucket_pos")
    return (won_page < F.col("page")) | ((won_page == F.col("page")) & (won_pos < F.col("bucket_pos")))


def _settle(epoch: _Epoch, shared: DataFrame | None, guess: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Repeat ``decide`` until the set of blocked offers is stable: (accepted, blocked).

    ``guess`` is where to start, such as what the previous epoch ended with.
    """
    if shared is None:
        return materialize(epoch.decide(None), "admission"), None
    offers = (
        epoch.open_keys.join(shared, "url_norm", "left_semi")
        .groupBy("bucket", "bucket_pos", "url_norm")
        .agg(F.min("page").alias("page"))
    )
    blocked = guess
    while True:
        accepted = epoch.decide(blocked)
        place = F.struct("page", "bucket_pos", "bucket")
        winners = accepted.join(shared, "url_norm", "left_semi").groupBy("url_norm").agg(F.min(place).alias("won"))
        # An offer is blocked by an accepted offer of its URL that came earlier elsewhere.
        won = F.col("won").isNotNull() & (F.col("won.bucket") != F.col("bucket")) & _won_earlier()
        judged = offers.join(winners, "url_norm", "left")
        was = F.lit(False)
        if blocked is not None:
            judged = judged.join(blocked.withColumn("_was", F.lit(True)), ["bucket", "url_norm"], "left")
            was = F.coalesce("_was", F.lit(False))
        judged = judged.select("bucket", "url_norm", F.coalesce(won, F.lit(False)).alias("now"), was.alias("was"))
        judged = materialize(judged, "offers")
        if judged.where(F.col("now") != F.col("was")).isEmpty():
            return materialize(accepted, "admission"), blocked
        blocked = judged.where("now").select("bucket", "url_norm")


UNBOUNDED = 1 << 60


def _page_counts(totals: DataFrame, epoch: _Epoch, blocked: DataFrame | None, accepted: DataFrame) -> DataFrame:
    """Pages with open offers: items, offers, accepted ones, and the greatest place an
    offer takes within its domain, which tells what caps would change the decisions."""
    offers = epoch.own_first(blocked)
    fresh = offers.groupBy("bucket", "page").agg(F.count("*").alias("fresh"))
    placed = epoch.placed(offers).groupBy("bucket", "page").agg(
        F.count("*").alias("placed"), F.max("place").cast("bigint").alias("greatest")
    )
    taken = accepted.groupBy("bucket", "page").agg(F.count("*").alias("accepted"), F.max("pos").alias("last_pos"))
    joined = fresh.join(totals, ["bucket", "page"])
    for part in (placed, taken):
        joined = joined.join(part, ["bucket", "page"], "left")
    need = F.when(F.col("fresh") > F.col("placed"), F.lit(UNBOUNDED)).otherwise(F.col("greatest"))
    filled = joined.fillna(0, ["placed", "greatest", "accepted"])
    return filled.select("bucket", "page", "items", "fresh", need.alias("need"), "accepted", "last_pos")


@dataclass
class _Pages:
    """What the walk asks about an epoch's pages.

    ``feeds`` lists the feed pages there are, ``ends`` each bucket's last page, ``taken``
    the pages on which rows are accepted. ``open_from(bucket, page)`` is the first page
    from there on with offers none of which is accepted.
    """

    feeds: dict[str, set[int]]
    ends: dict[str, int]
    taken: dict[str, dict[int, dict]]
    open_from: Callable[[str, int], int]
    _open: dict[str, tuple[int, int]] = field(default_factory=dict)

    def exists(self, state: BucketState, page: int) -> bool:
        if page < state.feeds:
            return page in self.feeds.get(state.name, ())
        return page <= self.ends.get(state.name, -1)

    def next_open(self, state: BucketState, page: int) -> int:
        since, found = self._open.get(state.name, (UNBOUNDED, -1))
        if not since <= page <= found:
            found = self.open_from(state.name, page)
            self._open[state.name] = page, found
        return found

    def next_change(self, state: BucketState, page: int, moved: bool) -> int:
        """The first page from ``page`` on that may differ from the one before it.

        Feed pages may be missing, so each is looked at, and so is the first after them.
        """
        if page <= state.feeds:
            return page
        points = [self.ends.get(state.name, -1) + 1, *self.taken.get(state.name, ())]
        if moved:
            points.append(self.next_open(state, page))
        return min((p for p in points if p >= page), default=page)


def _after(start: tuple[int, int]):
    page, pos = start
    return (F.col("page") > page) | ((F.col("page") == page) & (F.col("bucket_pos") >= pos))


def _still_decided(state: BucketState, quota: int, number: int, pages: _Pages) -> bool:
    """Whether decisions made under ``quota`` hold for this page under the current one.

    They do if no offer's place lies beyond either cap and neither quota fills up. Offers
    none of which was accepted lie beyond the cap, or the quota was full: they may not hold.
    """
    if state.quota == quota:
        return True
    page = pages.taken.get(state.name, {}).get(number)
    if page is None:
        return pages.next_open(state, number) != number
    cap = min(domain_cap(quota), domain_cap(state.quota))
    return page["need"] <= cap and state.count + page["accepted"] < min(quota, state.quota)


class _Walk:
    """The control rule over change points. Holds one small state per bucket."""

    def __init__(self, states: list[BucketState], limits: Limits):
        self.states = states
        self.limits = limits
        self.stopped = False
        # What was visited so far ends before this (page, bucket position); None: everything.
        self.end: tuple[int, int] | None = None

    def active(self) -> list[BucketState]:
        return [s for s in self.states if s.active]

    def _state(self) -> list:
        return [(s.quota, s.count, s.active, tuple(s.rates)) for s in self.states]

    def run(self, pages: _Pages, start: tuple[int, int], counted_upto) -> tuple[int, int] | None:
        """Visit pages from ``start``; returns where the next epoch begins, None at the end."""
        decided_for = {s.name: s.quota for s in self.states}
        page, first = start
        while self.active():
            # Two buckets may hand a quota to and fro within a round, so what counts is the visit.
            before, moved = self._state(), set()
            for state in self.states[first:]:
                if state.active and state.count >= state.quota:
                    state.active = False
                elif state.active and not pages.exists(state, page):
                    state.active = page < state.feeds
                elif state.active:
                    if state.quota != decided_for[state.name]:
                        moved.add(state.name)
                    if not _still_decided(state, decided_for[state.name], page, pages):
                        self.end = (page, state.pos)
                        return self.end
                    self._visit(state, page, pages.taken.get(state.name, {}).get(page), counted_upto)
                    if self.stopped:
                        self.end = (page, state.pos + 1)
                        return None
            settled = first == 0 and self._state() == before
            page, first = page + 1, 0
            if settled:
                page = min(pages.next_change(s, page, s.name in moved) for s in self.active())
        self.end = None
        return None

    def _visit(self, state: BucketState, page: int, here, counted_upto) -> None:
        """``here`` is the page's counts, None if nothing on it is accepted."""
        accepted, rate = 0, 1.0
        if here is not None:
            accepted, looked_at = here["accepted"], here["items"]
            state.count += accepted
            if state.count >= state.quota:
                upto = counted_upto(state.name, page, here["last_pos"])
                if upto < looked_at:
                    state.active = False
                    looked_at = upto
            rate = (looked_at - accepted) / looked_at
        state.rates.append(rate)
        while len(state.rates) > self.limits.window_pages:
            state.rates.popleft()
        if accepted < self.limits.low_yield:
            if len(self.active()) <= 1 or not self._yields_badly(state):
                return
            self._donate(state)
        if sum(s.count for s in self.states) >= self.limits.target_total:
            self.stopped = True

    def _yields_badly(self, state: BucketState) -> bool:
        full = len(state.rates) == self.limits.window_pages
        return full and sum(state.rates) / len(state.rates) > self.limits.bad_rate

    def _donate(self, donor: BucketState) -> None:
        spare = max(0, donor.quota - donor.count - self.limits.min_quota)
        gift = min(self.limits.max_donation, spare)
        if gift:
            donor.quota -= gift
            taker = min((s for s in self.active() if s is not donor), key=lambda s: (s.quota, s.pos))
            taker.quota = min(self.limits.max_quota, taker.quota + gift)


def _epoch_pages(counts: DataFrame, feeds: dict[str, set[int]], ends: dict[str, int]) -> _Pages:
    """``counts`` is a stored table; the quotas bound its pages with accepted rows."""
    taken: dict[str, dict[int, dict]] = {}
    for row in counts.where("accepted > 0").collect():
        taken.setdefault(row["bucket"], {})[row["page"]] = row.asDict()
    idle = counts.where("accepted = 0")

    def open_from(bucket: str, page: int) -> int:
        found = idle.where((F.col("bucket") == bucket) & (F.col("page") >= page)).agg(F.min("page").alias("page")).first()
        return UNBOUNDED if found["page"] is None else found["page"]

    return _Pages(feeds, ends, taken, open_from)


@dataclass
class Admission:
    items: DataFrame
    buckets: list[BucketState]


def admit_adaptive(
    items: DataFrame, seen: DataFrame, buckets: list[tuple[str, int]], limits: Limits | None = None
) -> Admission:
    """Admitted items and the final control state.

    ``buckets`` lists (bucket, number of feeds) in visiting order, matching the items'
    ``bucket_pos``. Pages count from 0, feeds first.
    """
    limits = limits or Limits()
    spark: SparkSession = items.sparkSession
    states = [BucketState(name, i, feeds, limits.init_quota) for i, (name, feeds) in enumerate(buckets)]
    keys = materialize(_reachable(candidate_keys(items), states), "candidates")
    totals = materialize(
        keys.groupBy("bucket", "page").agg(F.count("*").alias("items")), "page-totals"
    )
    # A repeat of a URL on the same page can never be accepted.
    offers = (
        admissible_url(keys)
        .groupBy("bucket", "bucket_pos", "page", "url_norm", "domain")
        .agg(F.min("pos").alias("pos"))
    )
    eligible = materialize(anti_join_seen(offers, seen), "offers")
    shared = materialize(
        eligible.groupBy("url_norm")
        .agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .select("url_norm"),
        "shared-urls",
    )
    shared = None if shared.isEmpty() else shared

    def counted_upto(bucket: str, page: int, pos: int) -> int:
        on_page = (F.col("bucket") == bucket) & (F.col("page") == page) & (F.col("pos") <= pos)
        return keys.where(on_page).count()

    feeds_of = F.element_at(F.create_map(*[F.lit(x) for s in states for x in (s.name, s.feeds)]), F.col("bucket"))
    feeds: dict[str, set[int]] = {}
    for row in totals.where(F.col("page") < feeds_of).select("bucket", "page").collect():
        feeds.setdefault(row["bucket"], set()).add(row["page"])
    ends = {row["bucket"]: row["end"] for row in totals.groupBy("bucket").agg(F.max("page").alias("end")).collect()}
    bound = max(limits.target_total, limits.max_quota * len(states))
    walk = _Walk(states, limits)
    start: tuple[int, int] | None = (0, 0)
    kept: list[DataFrame] = []
    blocked = used = None
    while start is not None:
        names = [s.name for s in walk.active()]
        open_keys = eligible.where(F.col("bucket").isin(names) & _after(start))
        if kept:
            done = reduce(DataFrame.unionByName, kept)
            open_keys = open_keys.join(hint_small(done.select("url_norm"), bound), "url_norm", "left_anti")
            used = done.groupBy("bucket", "domain").agg(F.count("*").alias("used"))
        epoch = _Epoch(open_keys, {s.name: s for s in states}, used, limits, bound)
        accepted, blocked = _settle(epoch, shared, blocked)
        counts = materialize(_page_counts(totals, epoch, blocked, accepted), "page-counts")
        start = walk.run(_epoch_pages(counts, feeds, ends), start, counted_upto)
        kept.append(accepted if walk.end is None else accepted.where(~_after(walk.end)))
    admitted = reduce(DataFrame.unionByName, kept).select(*ITEM_KEY)
    chosen = items.join(hint_small(admitted, bound), list(ITEM_KEY), "left_semi")
    return Admission(chosen, states)
