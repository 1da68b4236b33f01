"""Author aliases: alias table (E1), resolution (E2), per-book author
dedupe (E3) and the principal author (E4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import col
from ..functions.normalize import alias_key, name_parts, person_from_string, person_key
from ._joins import bounded_broadcast
from .metadata import PERSON

UNKNOWN_AUTHOR = "UnknownAuthor"


def alias_table(raw: DataFrame, canonical: str = "canonical", alias: str = "alias",
                position: str = "position") -> DataFrame:
    """``(canonical, alias, position)`` rows -> one row per alias key.

    The canonical string is parsed as ``Last [First [Middle]]`` (D5); the
    alias is matched on its normalised parts.  When an alias repeats, the
    later position wins (equal positions fall back to the alias text, so
    the choice is deterministic).  Canonical strings that cannot be parsed
    are kept out (see :func:`alias_errors`).  Output: ``alias_key,
    canonical`` (a person struct).  Each step is its own projection so the
    normaliser runs once per value.
    """
    s = raw.select(alias_key(F.col(alias)).alias("alias_key"),
                   name_parts(F.col(canonical)).alias("_parts"),
                   F.col(position).alias("_pos"), F.col(alias).alias("_alias"))
    s = s.select("alias_key", "_pos", "_alias", F.size("_parts").alias("_n"),
                 F.get(F.col("_parts"), 0).alias("last_name"), F.get(F.col("_parts"), 1).alias("first_name"),
                 F.get(F.col("_parts"), 2).alias("middle_name"))
    s = s.withColumn("id", person_key(F.col("last_name"), F.col("first_name"), F.col("middle_name")))
    s = s.filter(F.col("alias_key").isNotNull() & F.col("_n").between(1, 3) & F.col("id").isNotNull())
    person = F.struct(*[F.col(f) for f in PERSON.fieldNames()])
    return (s.groupBy("alias_key")
            .agg(F.max_by(person, F.struct(F.col("_pos"), F.col("_alias"))).alias("canonical")))


def alias_errors(raw: DataFrame, canonical: str = "canonical") -> DataFrame:
    """Canonical names of the alias source that cannot be parsed."""
    p = person_from_string(F.col(canonical))
    return raw.select(F.col(canonical), p["error"].alias("error")).filter(F.col("error").isNotNull())


def dedupe_authors(authors) -> Column:
    """Keep the first occurrence of each author id, order kept."""
    a = col(authors)
    return F.filter(a, lambda x, i: ~F.exists(F.slice(a, 1, i), lambda y: y["id"] == x["id"]))


def principal_author(authors) -> Column:
    """Id of the first author, else ``UnknownAuthor``."""
    return F.coalesce(F.try_element_at(col(authors), F.lit(1))["id"], F.lit(UNKNOWN_AUTHOR))


def resolve_aliases(books: DataFrame, aliases: DataFrame | None, key: str = "path",
                    authors: str = "authors") -> DataFrame:
    """E2 + E3: replace every author whose key is an alias by the canonical
    person (one hop, no chains), then drop repeated authors of a book.

    Only ``(key, author id)`` is exploded and joined to the alias table
    (broadcast when its size is proven small); what comes back to a book are
    its hits, so a book without one is never exploded or regrouped and no other
    column is carried twice.  Hits are keyed by author id, so books that repeat
    a ``key`` stay apart.
    """
    if aliases is None:
        return books.withColumn(authors, dedupe_authors(F.col(authors)))
    ids = (books.select(F.col(key).alias("_key"), F.explode(F.transform(F.col(authors), lambda a: a["id"])).alias("_id")))
    al = bounded_broadcast(aliases.select(F.col("alias_key"), F.col("canonical").alias("_canon")))
    hits = (ids.join(al, ids["_id"] == al["alias_key"])
            .groupBy("_key").agg(F.collect_list(F.struct("_id", "_canon")).alias("_hits")))
    joined = books.join(hits, books[key] == hits["_key"], "left")

    def canonical(a: Column) -> Column:
        hit = F.get(F.filter(F.col("_hits"), lambda h: h["_id"] == a["id"]), 0)
        return F.coalesce(hit["_canon"], a)

    resolved = F.when(F.col("_hits").isNull(), F.col(authors)).otherwise(
        F.transform(F.coalesce(F.col(authors), F.array()), canonical).cast(T.ArrayType(PERSON)))
    return joined.select(*[dedupe_authors(resolved).alias(c) if c == authors else books[c] for c in books.columns])
