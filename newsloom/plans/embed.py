"""Incremental embedding of the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import EMBEDDING_DIM
from newsloom.functions.text import embedding_text
from newsloom.operators.encoder import encode_with_model, hash_vector
from newsloom.operators.joins import pending_embeddings


def embed_pending(
    corpus: DataFrame, vectors: DataFrame, dim: int = EMBEDDING_DIM, at: Column | None = None,
    model: Callable | None = None,
) -> DataFrame:
    """New vector rows for corpus contents that have none.

    ``model`` loads an encoder as ``encode_with_model`` takes it; without one, words are hashed
    to ``dim`` cells.
    """
    pending = pending_embeddings(corpus, vectors)
    text = embedding_text(F.col("title"), F.col("content"))
    when = F.current_timestamp() if at is None else at
    if model is None:
        encoded = pending.withColumn("embedding", hash_vector(text, dim))
    else:
        encoded = encode_with_model(pending, "content_id", text, model, carry=("url", "title"))
    return encoded.select(
        "content_id", F.coalesce("url", F.lit("")).alias("url"), "title", "embedding", when.alias("embedded_at")
    )


def embed_incremental(
    corpus: DataFrame, vectors: DataFrame, dim: int = EMBEDDING_DIM, at: Column | None = None,
    model: Callable | None = None,
) -> DataFrame:
    """The vector table after embedding what is pending; a second run changes nothing.

    What is pending has no vector yet, so the new rows are appended and each text is encoded once.
    """
    return vectors.unionByName(embed_pending(corpus, vectors, dim, at, model))
