"""Content-derived identities, all sha1 in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(path: Column) -> Column:
    return F.sha1(path)


def section_id(path: Column, headings: Column, discriminator: Column | None = None) -> Column:
    """The discriminator (``page=N`` or ``occurrence=N``) takes part only where it isn't empty."""
    base = F.concat(path, F.lit("#"), F.array_join(headings, " > "))
    if discriminator is None:
        return F.sha1(base)
    return F.sha1(F.concat(base, F.when(F.coalesce(discriminator, F.lit("")) != "", F.concat(F.lit("#"), discriminator)).otherwise("")))


def chunk_id(doc_id: Column, strategy: Column, index: Column) -> Column:
    return F.sha1(F.concat_ws(":", doc_id, strategy, index.cast("string")))


def cache_key(*parts: Column) -> Column:
    """sha256 of the parts joined by NUL; a null part counts as empty."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
