"""Embeddings: a plug-in protocol, and a deterministic embedder that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens


def hashed(text: Column, dimensions: int = 64) -> Column:
    """Unit vector of signed token hashes, in expressions only."""
    h = F.transform(tokens(text), lambda t: F.xxhash64(t))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    at = lambda x: F.pmod(x, F.lit(dimensions))
    pairs = F.transform(h, lambda x: F.struct(at(x).alias("i"), F.when(F.shiftright(x, 32).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0).alias("s")))
    raw = F.aggregate(pairs, zero, lambda v, p: F.transform(v, lambda y, i: F.when(i == p["i"], y + p["s"]).otherwise(y)))
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: (x / F.when(length > 0, length).otherwise(1.0)).cast("float"))


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], column: str = "embedding") -> DataFrame:
    """Embeddings of a text column by a model that ``load`` makes once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.fillna("").tolist()), np.float32)))

    return df.withColumn(column, run(F.col(text)))


def embed_cached(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], cache: DataFrame, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """:func:`embed` for texts that ``cache`` (``key``, a digest of the text, and the vector) has not; each different text is
    embedded once.  The rows with their vectors, and the next cache."""
    keyed = df.withColumn("_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    missing = keyed.select(F.col("_key").alias("key"), F.col(text).alias("_text")).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    grown = cache.select("key", column).unionByName(embed(missing, "_text", load, column).select("key", column))
    return keyed.join(grown.withColumnRenamed("key", "_key"), "_key").drop("_key"), grown


def chunk_text(symbol: Column, code: Column) -> Column:
    """What a chunk is embedded by."""
    return F.concat(symbol, F.lit("\n\n"), code)


def decision_text(title: Column, description: Column, reasoning: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), description, F.when(reasoning.isNotNull() & (reasoning != ""), F.concat(F.lit("\n\nReasoning: "), reasoning)).otherwise(""))


def event_text(kind: Column, from_ref: Column, to_ref: Column, summary: Column) -> Column:
    return F.concat(kind, F.lit(": "), from_ref, F.lit(" → "), to_ref, F.lit("\n\n"), summary)


def changelog_text(tag: Column, version: Column, summary: Column) -> Column:
    return F.concat(tag, F.lit(" ("), version, F.lit(")\n\n"), summary)


def vector_key(kind: Column, ref: Column) -> Column:
    return F.concat(kind, F.lit(":"), ref)


def parse_vector_key(key: Column) -> list[Column]:
    return [F.substring_index(key, ":", 1).alias("kind"), F.substring_index(key, ":", -1).cast("long").alias("ref_id")]
