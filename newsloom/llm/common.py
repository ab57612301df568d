"""Helpers shared by the operators of this subpackage.

All intermediate tables are narrow (ids, hashes, sizes) and go to the shared folder through
``materialize``, so a lost executor costs a file read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.session import materialize

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
UNIT = float(2**60)


TEXTS_PER_BATCH = 1_000


def in_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the number of rows that Python workers get at a time bounded for whole texts."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
    return docs


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(*parts: Column, seed: str = "") -> Column:
    """A hash in [0, 2^60), the same in every engine: the first 15 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def block_of(key: Column, blocks: Column) -> Column:
    """Which of ``blocks`` equal ranges of [0, 2^60) a key lies in."""
    return F.floor(key / F.lit(UNIT) * blocks).cast("long")


def ordered_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], label: str) -> DataFrame:
    """Running totals, up to and with each row, over all rows in ``order``.

    Rows are dealt by range and written with the number of their range; one row per range
    gives each range its start. No task sees more than a range.
    """
    parts = df.select("*", *[v.alias(f"_{k}") for k, v in totals.items()])
    parts = parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = materialize(parts, label)
    sums = parts.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}_all") for k in totals])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_part", *[F.coalesce(F.sum(f"_{k}_all").over(before), F.lit(0)).alias(f"_{k}_start") for k in totals]
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(starts, "_part")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.sum(f"_{k}").over(within) + F.col(f"_{k}_start")).alias(k) for k in totals],
    )


def positions(df: DataFrame, key: str, mix: str, name: str, rows_per_block: int = 20_000) -> DataFrame:
    """Number the rows of each ``key`` from 0, in an order given by the uniform hash ``mix``.

    A key's rows are dealt over as many hash ranges as its count asks for, so a hot key is
    many small groups. ``mix`` lies in [0, 2^60); ``df`` should be a stored table, as it is read twice.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(F.col(key).alias("_k"), F.ceil(F.col("_n") / rows_per_block).alias("_blocks"))
    dealt = df.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_block", block_of(F.col(mix), F.col("_blocks")))
    counts = dealt.groupBy(F.col(key).alias("_ck"), F.col("_block").alias("_cb")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_ck").orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    own = Window.partitionBy(key, "_block").orderBy(mix)
    numbered = dealt.withColumn("_row", F.row_number().over(own) - 1)
    at = F.col(key).eqNullSafe(F.col("_ck")) & (F.col("_block") == F.col("_cb"))
    return numbered.join(starts, at).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.col("_row")).alias(name)
    )


def text_mark() -> Column:
    """Tells apart rows that repeat a doc_id with another text: 16 bytes of the text's SHA-256.

    Any number of rows may share an id, null above all, so a short hash would mix up their texts.
    """
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("mark")


def without_rows(docs: DataFrame, dropped: DataFrame, doubled: DataFrame) -> DataFrame:
    """``docs`` less the rows named in ``dropped`` (id, mark), and one of each in ``doubled``.

    Both are stored tables. ``doubled`` names rows to keep that occur more than once, equal in
    id and text; there are none unless rows were repeated. The names are dealt out with the
    rows at any size: they grow with the input, so a broadcast would only suit small ones.
    """
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("mark").eqNullSafe(F.col("m"))
    named = lambda rows: rows.select("id", F.col("mark").alias("m"))
    marked = docs.select(F.struct("*").alias("doc"), "doc_id", text_mark())
    kept = marked.join(named(dropped).hint("merge"), same, "left_anti")
    if not doubled.isEmpty():
        once = kept.join(named(doubled), same, "left_semi").dropDuplicates(["doc_id", "mark"])
        kept = kept.join(named(doubled), same, "left_anti").unionByName(once)
    return kept.select("doc.*")
