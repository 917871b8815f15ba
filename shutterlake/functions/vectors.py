"""Embedding vectors as ARRAY<FLOAT>; arithmetic runs in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_THRESHOLD = 0.5


def embedding_from_info(info: Column) -> Column:
    """The ``embedding`` array of an info JSON text; null when absent or not all numbers."""
    parsed = F.from_json(info, "embedding ARRAY<FLOAT>").getField("embedding")
    return F.when(valid_embedding(parsed), parsed)


def valid_embedding(embedding: Column) -> Column:
    return F.coalesce(
        (F.size(embedding) > 0)
        & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)),
        F.lit(False),
    )


def _double(values: Column) -> Column:
    return values.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(_double(left), _double(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(vector: Column) -> Column:
    """v / |v|; the zero vector stays zero."""
    norm = F.sqrt(F.aggregate(_double(vector), F.lit(0.0), lambda acc, x: acc + x * x))
    # One-element array as a binding, so that the norm is computed once and not per element.
    bound = F.array(F.struct(_double(vector).alias("values"), norm.alias("norm")))
    scaled = F.transform(
        bound,
        lambda b: F.transform(
            b["values"], lambda x: F.when(b["norm"] > 0, x / b["norm"]).otherwise(F.lit(0.0))
        ),
    )
    return F.element_at(scaled, 1)


def cosine(left: Column, right: Column) -> Column:
    """Similarity of unit vectors; unequal lengths are an error."""
    return F.when(F.size(left) == F.size(right), dot(left, right)).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("double")
    )


def is_match(left: Column, right: Column, threshold: float = MATCH_THRESHOLD) -> Column:
    return cosine(left, right) >= F.lit(threshold)
