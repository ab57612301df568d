"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, equal ranges of the key space are blocks
of about equal row count; prefix sums over the blocks' word counts find the block that holds
the source's budget, and only that block's rows are sorted to find the row where it is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import WORD, block_of, count_words, ordered_totals, random_key
from newsloom.session import materialize

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix"


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Target words per source, from rows (source, size).

    Sources in code point order, null last, take the weights in turn. All words are shared by
    weight; a target stops at ``most`` times its source's words and the excess is shared again.
    Sources whose ``words / weight`` is smallest reach their stop first, so the stopped ones
    are a prefix in that order: source j stops if the level at which it does would not use up
    all words.
    """
    sums = rows.groupBy("source").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    named = ordered_totals(sums, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "mix-names")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = named.withColumn("weight", weight.cast("long"))
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("rank").asc()]
    filled = ordered_totals(
        weighed, order, {"cap_sum": F.col("source_size") * most, "weight_sum": F.col("weight")}, "mix-fill"
    )
    filled = materialize(filled, "mix-sources")
    total = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight_all = total["words"] or 0, total["weight"] or 0
    wide = lambda c: c.cast("decimal(38,0)")
    level = wide(F.col("cap_sum")) * wide(F.col("weight")) + wide(F.col("source_size") * most) * wide(
        F.lit(weight_all) - F.col("weight_sum")
    )
    marked = filled.withColumn("stopped", level < F.lit(words).cast("decimal(19,0)") * wide(F.col("weight")))
    used = marked.where("stopped").agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    left, over = words - most * (used["s"] or 0), weight_all - (used["w"] or 0)
    free = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(max(over, 1)))
    return marked.withColumn(
        "target", F.when(F.col("stopped"), (F.col("source_size") * most).cast("double")).otherwise(free)
    ).select("source", "source_size", "rows", "rank", "target")


def mix_cuts(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, rows_per_block: int = 20_000
) -> DataFrame:
    """Per source: target, whole epochs, and where the last epoch is cut.

    ``rows`` is a stored table (doc_id, source, size, key). A row ahead of ``cut`` in the
    order (key, doc_id, size) is taken once more; the ``cut_rows`` rows at it share
    ``cut_words`` words, one after the other.
    """
    sources = source_targets(rows, weights, most)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    sources = sources.withColumn("blocks", F.ceil(F.col("rows") / rows_per_block).cast("long"))
    sources = materialize(sources, "mix-targets")
    own = sources.select(F.col("source").alias("_s"), "rank", "rest", "blocks")
    dealt = rows.join(own, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "block", block_of(F.col("key"), F.col("blocks"))
    )
    sums = dealt.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = sums.where("start <= rest and rest < start + words").select("rank", "block", "start")
    last = materialize(last, "mix-blocks")
    inside = dealt.join(last, ["rank", "block"]).groupBy("rank", "start", "rest", "key", "doc_id", "size").agg(
        F.count(F.lit(1)).alias("n")
    )
    at = F.struct("key", "doc_id", "size")
    ahead = Window.partitionBy("rank").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(ahead), F.lit(0))
    cut = inside.withColumn("run", run).where("run <= rest and rest < run + size * n")
    cut = cut.select("rank", at.alias("cut"), (F.col("rest") - F.col("run")).alias("cut_words"), F.col("n").alias("cut_rows"))
    return materialize(sources.join(cut, "rank", "left"), "mix-cuts")


def _at_cut() -> Column:
    return F.coalesce(F.struct("key", "doc_id", "size") == F.col("cut"), F.lit(False))


def placed_at_cut(told: DataFrame, cuts: DataFrame) -> DataFrame:
    """``told`` with ``place``: the number, from 0, of a row among those equal to it at the cut.

    Where ids are not repeated, a source has one such row and nothing is numbered. Otherwise
    the rows at a cut are written with the number of their task; one count per task and
    source gives each task its first place, so no task sees more than another one wrote.
    """
    if cuts.where("cut_rows > 1").isEmpty():
        return told.withColumn("place", F.lit(0).cast("long"))
    equal = materialize(told.where(_at_cut()).withColumn("_task", F.spark_partition_id()), "mix-equal")
    counts = equal.groupBy("rank", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("rank").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("rank", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("rank", "_task").orderBy("mix")) - 1
    numbered = equal.withColumn("_own", own).join(starts, ["rank", "_task"])
    numbered = numbered.select(*told.columns, (F.col("_start") + F.col("_own")).alias("place"))
    return told.where(~_at_cut()).withColumn("place", F.lit(0).cast("long")).unionByName(numbered)


def words_taken() -> Column:
    at = F.struct("key", "doc_id", "size")
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut_words") - F.col("place") * F.col("size")))
    extra = F.when(at < F.col("cut"), F.col("size")).when(_at_cut(), left).otherwise(F.lit(0))
    return (F.col("whole") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long")


def keyed(docs: DataFrame, *more, seed: str = SEED) -> DataFrame:
    """The documents' ids, sources, sizes in words and random keys, and columns ``more``."""
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        count_words(F.col("text")).alias("size"),
        random_key(F.col("doc_id"), seed=seed).alias("key"),
        *more,
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: str = SEED,
    rows_per_block: int = 20_000,
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Columns doc_id, size, source_size, target (both of the row's source) and taken. Words
    taken from a source add up to its target, rounded; a document may be taken up to ``most``
    times, and one document per source in part.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, last.
    Null doc_id: hashed as a constant. Rows that repeat a doc_id have the same key; of rows equal
    in (doc_id, size) at the cut as many are taken whole as fit, and the next one in part.
    Empty input: no rows. Other columns are not looked at.
    """
    rows = materialize(keyed(docs, seed=seed), "mix-rows")
    cuts = mix_cuts(rows, weights, most, rows_per_block)
    own = cuts.select(F.col("source").alias("_s"), "rank", "source_size", "target", "whole", "cut", "cut_words")
    told = rows.join(own, F.col("source").eqNullSafe(F.col("_s")))
    told = told.select(
        "doc_id", "size", "key", "rank", "source_size", "target", "whole", "cut", "cut_words", F.col("doc_id").alias("mix")
    )
    return placed_at_cut(told, cuts).select("doc_id", "size", "source_size", "target", words_taken().alias("taken"))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: str = SEED,
    rows_per_block: int = 20_000,
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as it is taken.

    A row taken in part is cut to its first words, joined by one space, and its n_chars, if
    there is such a column, to their length. Rows of which no word is taken are left out.
    Nulls, repeated rows and empty input: as in ``mix_sources``; of rows equal in (doc_id, size)
    at the cut, which are taken goes by the hash of their text within each task's rows.
    """
    rows = materialize(keyed(docs, seed=seed), "mix-rows")
    cuts = mix_cuts(rows, weights, most, rows_per_block)
    own = cuts.select(F.col("source").alias("_s"), "rank", "whole", "cut", "cut_words")
    mix = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("mix")
    told = keyed(docs, F.struct("*").alias("doc"), mix, seed=seed).join(own, F.col("source").eqNullSafe(F.col("_s")))
    told = placed_at_cut(told.select("doc", "doc_id", "size", "key", "rank", "whole", "cut", "cut_words", "mix"), cuts)
    told = told.select("doc", "size", words_taken().alias("taken")).where("taken > 0")
    times = F.concat(
        F.array_repeat(F.col("size"), (F.col("taken") / F.col("size")).cast("int")),
        F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<bigint>")),
    )
    each = told.select("doc", "size", F.explode(times).alias("words"))
    first = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    each = each.withColumn("cut_text", F.when(F.col("words") < F.col("size"), first))
    changed = {"text": F.coalesce("cut_text", "doc.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("cut_text").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("cut_text").cast(kind))
    return each.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
