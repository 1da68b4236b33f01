"""Book fingerprint (F1) and stable numeric ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col


def book_digest(norm_title, ext_id, version, author_ids) -> Column:
    """lower-case hex MD5 of ``norm_title|ext_id|version|id1|id2...``.

    Missing title/ext_id/version count as ``''``; the author ids keep their
    order; no authors -> no trailing ``|``.  ``concat_ws`` flattens the id
    array, so the whole fingerprint is one built-in expression.
    """
    return F.md5(F.concat_ws(
        "|",
        F.coalesce(col(norm_title), F.lit("")),
        F.coalesce(col(ext_id), F.lit("")),
        F.coalesce(col(version), F.lit("")),
        F.coalesce(col(author_ids), F.array().cast("array<string>")),
    ))


def hex_id(md5_hex) -> Column:
    """Stable bigint id from the first 15 hex digits (60 bits) of an MD5.

    Deterministic, needs no coordination between tasks or runs, and never
    numbers rows globally.
    """
    return F.conv(F.substring(col(md5_hex), 1, 15), 16, 10).cast("bigint")


def stable_id(key) -> Column:
    """Stable bigint id of any string key."""
    return hex_id(F.md5(col(key)))
