"""Text to unit vectors.

The built-in encoder hashes words into a fixed number of cells and needs no model: it is
one expression per row, so encoding shuffles nothing. Any other model fits through
``encode_with_model``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import EMBEDDING_DIM
from newsloom.functions.binding import let


def _word_cells(text: Column, dim: int) -> Column:
    """The hash cell of every word, sorted."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    cell = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    return F.sort_array(F.transform(words, cell))


def _counted(cells: Column) -> Column:
    """(cell, tf) entries in cell order, from sorted cells: where runs start tells their length."""
    size = F.size(cells)
    starts = F.filter(
        F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(cells, i) != F.get(cells, i - 1))
    )
    return let(
        starts,
        lambda s: F.zip_with(
            s, F.concat(F.slice(s, 2, F.size(s)), F.array(size)),
            lambda a, b: F.struct(F.get(cells, a).alias("cell"), (b - a).alias("tf")),
        ),
    )


def _fill(entries: Column, dim: int) -> Column:
    """Dense unit array from (cell, tf) entries; gaps become zeros."""
    edge = lambda cell: F.array(F.struct(F.lit(cell).alias("cell"), F.lit(0).alias("tf")))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    total = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["tf"] * e["tf"])
    runs = let(
        F.sqrt(total),
        lambda norm: F.zip_with(
            F.concat(edge(-1), entries),
            F.concat(entries, edge(dim)),
            lambda a, b: F.concat(zeros(b["cell"] - a["cell"] - 1), F.array(b["tf"] / norm)),
        ),
    )
    return F.slice(F.flatten(runs), 1, dim)


def hash_vector(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Unit vector of word counts per hash cell; a text without words gives zeros."""
    zero = F.array_repeat(F.lit(0.0), dim)
    dense = let(
        _word_cells(text, dim),
        lambda cells: F.when(F.size(cells) < 1, zero).otherwise(let(_counted(cells), lambda e: _fill(e, dim))),
    )
    return F.coalesce(dense, zero).cast("array<float>")


def encode_hashed(texts: DataFrame, key: str, text: Column, dim: int = EMBEDDING_DIM) -> DataFrame:
    """(key, embedding) for every text."""
    return texts.select(key, hash_vector(text, dim).alias("embedding"))


def encode_query(spark, text: str, dim: int = EMBEDDING_DIM) -> list[float]:
    """The vector of one query text."""
    return list(spark.range(1).select(hash_vector(F.lit(text), dim)).first()[0])


def encode_with_model(
    texts: DataFrame, key: str, text: Column, load_model: Callable[[], Callable[[list[str]], list]],
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(key, embedding) from any model, and the columns named in ``carry``. ``load_model`` runs
    once per task and returns a function from a list of texts to a list of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_model()
        for batch in batches:
            vectors = [list(map(float, v)) for v in encode(batch["text"].tolist())]
            yield batch[[*kept]].assign(embedding=vectors)

    kept = (key, *carry)
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.select(*kept, text.alias("text")).mapInPandas(run, f"{kinds}, embedding array<float>")
