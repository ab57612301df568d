"""Which of many URLs are known, by filters kept with the known ones.

Known URLs are dealt to ranges of their hash. A commit stores its URLs, one folder a range,
and a Bloom filter of each range it touches; filters of one range have one size, so those of
several commits are or-ed. Candidates first meet the filters only, in the task of their range.
What a filter lets through is looked up in that range's folders: ranges without such a
candidate are not opened, and no answer rests on a filter that says yes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import materialize

RANGES = 256
BITS = 1 << 23
PROBES = 6
FILTERS = "range int, bits binary"


def places(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The bits of each 64-bit hash, ``probes`` a row."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return ((h[:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]) >> np.uint64(7)) % np.uint64(bits)


def made_filter(hashes: np.ndarray, bits: int, probes: int) -> bytes:
    flags = np.zeros(bits, np.uint8)
    flags[places(hashes, bits, probes).ravel().astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def let_through(hashes: np.ndarray, body: bytes, probes: int) -> np.ndarray:
    data = np.frombuffer(body, np.uint8)
    at = places(hashes, 8 * len(data), probes).astype(np.int64)
    return ((data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


class SeenUrls:
    """Known URLs under ``root``. ``ranges`` and ``bits`` (a filter's, a power of two) stay as they were first.

    With 256 ranges of 8 million bits a filter is 1 MB and lets through about one in 100 others
    at 200 million URLs; more URLs want more ranges.
    """

    def __init__(self, spark: SparkSession, root: str, ranges: int = RANGES, bits: int = BITS, probes: int = PROBES):
        self.spark, self.root, self.ranges, self.bits, self.probes = spark, root.rstrip("/"), ranges, bits, probes

    def _range(self) -> Column:
        return F.pmod(F.xxhash64("url_norm"), F.lit(self.ranges)).cast("int")

    def _keyed(self, urls: DataFrame) -> DataFrame:
        named = urls.where(F.col("url_norm").isNotNull()).select("url_norm").distinct()
        return named.select("url_norm", F.xxhash64(F.lit("seen"), "url_norm").alias("h"), self._range().alias("range"))

    def add(self, urls: DataFrame, commit: int) -> None:
        """Store the URLs of a commit; done again, it replaces what it wrote."""
        bits, probes = self.bits, self.probes
        keyed = materialize(self._keyed(urls), "seen-keys")
        keyed.select("url_norm", "range").hint("rebalance", "range").write.mode("overwrite").partitionBy("range").parquet(
            f"{self.root}/keys/commit={commit}"
        )

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags: dict[int, np.ndarray] = {}  # of the ranges of this task
            for batch in batches:
                own, hashes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for r in np.unique(own):
                    packed = np.frombuffer(made_filter(hashes[own == r], bits, probes), np.uint8)
                    flags[int(r)] = packed | flags[int(r)] if int(r) in flags else packed
            for r, packed in flags.items():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed.tobytes()])], ["range", "bits"])

        parts = keyed.select("range", "h").repartition("range").mapInArrow(build, FILTERS)
        parts.write.mode("overwrite").parquet(f"{self.root}/filters/commit={commit}")

    def _stored(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, commit bigint").parquet(f"{self.root}/{what}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, commit bigint")

    def passed(self, candidates: DataFrame) -> DataFrame:
        """(url_norm, range) of the distinct candidates that some commit's filter lets through."""
        probes = self.probes

        def ask(key: tuple, asked: pa.Table, filters: pa.Table) -> pa.Table:
            found = np.zeros(asked.num_rows, bool)
            if filters.num_rows and asked.num_rows:
                bodies = [np.frombuffer(b, np.uint8) for b in filters.column("bits").to_pylist()]
                found = let_through(asked.column("h").to_numpy(), np.bitwise_or.reduce(bodies).tobytes(), probes)
            return asked.select(["url_norm", "range"]).filter(pa.array(found))

        kept = self._stored("filters", FILTERS).select("range", "bits")
        met = self._keyed(candidates).groupBy("range").cogroup(kept.groupBy("range"))
        return met.applyInArrow(ask, "url_norm string, range int")

    def seen(self, candidates: DataFrame) -> DataFrame:
        """The distinct ``url_norm`` of ``candidates`` that are known."""
        passed = materialize(self.passed(candidates), "seen-passed")
        ranges = [r["range"] for r in passed.select("range").distinct().collect()]  # at most ``ranges``
        known = self._stored("keys", "url_norm string, range int").where(F.col("range").isin(ranges))
        return passed.join(known.select("url_norm", "range"), ["url_norm", "range"], "left_semi").select("url_norm")

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """The rows of ``candidates`` whose ``url_norm`` is not known; a null one is not."""
        known = materialize(self.seen(candidates), "seen-known")
        return candidates.join(known, "url_norm", "left_anti")
