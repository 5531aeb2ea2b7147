"""Vector arithmetic and the offline embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.kernels import text_vectors


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def hashed_terms(texts: DataFrame, key: str, dimension: int = 64, prefix: str = "") -> DataFrame:
    """(key, vector): counts of hashed terms, unit length: an embedder that needs no model.

    ``prefix`` stands before every text, for embedders that tell questions from documents.  A vector is made where its
    row lies; texts without terms have none.
    """
    return text_vectors(texts, key, dimension, prefix)
