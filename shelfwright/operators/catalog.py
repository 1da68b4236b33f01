"""The three-table catalogue (G1-G12): ``books``, ``persons``, ``book_authors``.

Ids are derived from the natural keys (``digest``, ``normalized_name``) by
:func:`~shelfwright.functions.digest.hex_id`, so no row is ever numbered
globally and an id never needs a lookup join.  Tables are append-only:
every insert is "anti-join on the natural key, then append", which makes a
replayed batch heal instead of duplicate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import hex_id, stable_id
from ..session import written
from ._joins import is_small, maybe_among
from .identity import dedupe_books, with_digest

_S = T.StringType()

BOOKS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("digest", _S, False),
    T.StructField("ext_id", _S),
    T.StructField("version", _S),
    T.StructField("title", _S, False),
    T.StructField("encoding", _S, False),
    T.StructField("lang", _S),
    T.StructField("genre", _S),
    T.StructField("filename", _S, False),
    T.StructField("created_at", T.TimestampType()),
])
PERSONS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("first_name", _S),
    T.StructField("middle_name", _S),
    T.StructField("last_name", _S),
    T.StructField("normalized_name", _S, False),
])
LINKS_SCHEMA = T.StructType([
    T.StructField("book_id", T.LongType(), False),
    T.StructField("person_id", T.LongType(), False),
])
TABLES = {"books": BOOKS_SCHEMA, "persons": PERSONS_SCHEMA, "book_authors": LINKS_SCHEMA}


@dataclass
class Catalog:
    books: DataFrame
    persons: DataFrame
    links: DataFrame
    titles: DataFrame | None = None  # the stored title index

    def tables(self) -> dict[str, DataFrame]:
        return {"books": self.books, "persons": self.persons, "book_authors": self.links}


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def empty_catalog(spark: SparkSession) -> Catalog:
    e = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    return Catalog(e["books"], e["persons"], e["book_authors"])


# ---------------------------------------------------------------- build

#: What the three tables take from a parsed book, beside its digest.
_PERSON_COLUMNS = ("path", "authors")
_BOOK_COLUMNS = ("path", "ext_id", "version", "title", "encoding", "lang", "genre", "filename")


def first_seen_books(parsed: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Accepted books with their digest, first file per digest kept (F1+F2).
    ``columns`` limits what is carried through the shuffle."""
    books = with_digest(parsed)
    return dedupe_books(books.select("digest", *columns) if columns else books)


def books_rows(deduped: DataFrame) -> DataFrame:
    """G1: rows of the ``books`` table from first-seen books."""
    return _conform(deduped.select(
        hex_id(F.col("digest")).alias("id"), "digest", "ext_id", "version", "title",
        "encoding", "lang", "genre", "filename",
        F.current_timestamp().alias("created_at")), BOOKS_SCHEMA)


def _author_occurrences(deduped: DataFrame) -> DataFrame:
    return deduped.select("digest", "path", F.posexplode("authors").alias("pos", "a"))


def persons_rows(deduped: DataFrame) -> DataFrame:
    """One row per normalised name; name parts of its first occurrence
    (smallest path, then position) kept.  ``min_by`` combines map-side."""
    occ = _author_occurrences(deduped)
    parts = F.struct(F.col("a.first_name").alias("first_name"),
                     F.col("a.middle_name").alias("middle_name"),
                     F.col("a.last_name").alias("last_name"))
    g = (occ.groupBy(F.col("a.id").alias("normalized_name"))
         .agg(F.min_by(parts, F.struct("path", "pos")).alias("p")))
    return _conform(g.select(stable_id(F.col("normalized_name")).alias("id"), "p.*",
                             "normalized_name"), PERSONS_SCHEMA)


def links_rows(deduped: DataFrame) -> DataFrame:
    """Distinct (book_id, person_id) pairs.  A digest has one row, so a
    book's pairs all come from one list and nothing is shuffled to compare
    them with other books'."""
    deduped = deduped if "person_ids" in deduped.columns else _with_ids(deduped)
    return _conform(deduped.select("book_id", F.explode("person_ids").alias("person_id")), LINKS_SCHEMA)


def _with_ids(deduped: DataFrame) -> DataFrame:
    people = F.array_distinct(F.transform("authors", lambda a: stable_id(a["id"])))
    return deduped.withColumns({"book_id": hex_id(F.col("digest")), "person_ids": people})


def build_catalog(parsed: DataFrame, once: bool = True) -> Catalog:
    """G1-G3 from accepted, alias-resolved books (one row per file).

    The first-seen books feed three tables, so they are written once to the
    shared checkpoint folder, with the ids of the links, and the dedupe's
    shuffle runs once.  With ``once``
    false nothing runs yet and each table has its own dedupe, which carries only
    that table's columns: for callers that read one table.
    """
    if not once:
        return Catalog(build_books(parsed), build_persons(parsed), build_links(parsed))
    d = written(_with_ids(first_seen_books(parsed, tuple(dict.fromkeys(_BOOK_COLUMNS + _PERSON_COLUMNS)))), "first-seen")
    return Catalog(books_rows(d), persons_rows(d), links_rows(d))


def build_books(parsed: DataFrame) -> DataFrame:
    return books_rows(first_seen_books(parsed, _BOOK_COLUMNS))


def build_persons(parsed: DataFrame) -> DataFrame:
    return persons_rows(first_seen_books(parsed, _PERSON_COLUMNS))


def build_links(parsed: DataFrame) -> DataFrame:
    return links_rows(first_seen_books(parsed, _PERSON_COLUMNS))


# ------------------------------------------------------------- upsert

def _not_in_catalog(batch: DataFrame, table: DataFrame, keys: list[str],
                    small_batch: bool = True) -> DataFrame:
    """``batch LEFT ANTI table`` on ``keys``.

    ``small_batch`` (a micro-batch against a big catalogue): the catalogue
    keys are first semi-joined against the batch keys.  While those are small
    enough to broadcast, the catalogue is only scanned per batch and the
    remaining anti-join is between two batch-sized inputs; beyond the bound a
    bitmap of hashed batch keys, of bounded size, goes through the scan first,
    and only keys that it may hold are shuffled.  Otherwise (a bulk load): one
    shuffled anti-join.
    """
    if not small_batch:
        return batch.join(table.select(*keys), keys, "left_anti")
    wanted = written(batch.select(*keys).distinct(), "batch-keys")
    known = table.select(*keys)
    if not is_small(wanted):
        known = maybe_among(known, wanted, keys)
    else:
        wanted = F.broadcast(wanted)
    present = known.join(wanted, keys, "left_semi")
    return batch.join(present, keys, "left_anti")


def upsert_books(cat_books: DataFrame, batch: Catalog, small_batch: bool = True) -> DataFrame:
    """Rows of the batch whose digest is not catalogued yet (never update)."""
    return (_not_in_catalog(batch.books, cat_books, ["digest"], small_batch)
            .select(*BOOKS_SCHEMA.fieldNames()))


def upsert_persons(cat_persons: DataFrame, batch: Catalog, small_batch: bool = True) -> DataFrame:
    """Find-or-insert persons; an existing name is a no-op."""
    return (_not_in_catalog(batch.persons, cat_persons, ["normalized_name"], small_batch)
            .select(*PERSONS_SCHEMA.fieldNames()))


def upsert_links(cat_links: DataFrame, batch: Catalog, small_batch: bool = True) -> DataFrame:
    """Links of new and existing books that are still missing."""
    return _not_in_catalog(batch.links, cat_links, ["book_id", "person_id"], small_batch)


def upsert(cat: Catalog, parsed_batch: DataFrame, small_batch: bool = True) -> Catalog:
    """G4-G6 together: the rows to append for a batch of parsed books."""
    batch = build_catalog(parsed_batch)
    return Catalog(upsert_books(cat.books, batch, small_batch),
                   upsert_persons(cat.persons, batch, small_batch),
                   upsert_links(cat.links, batch, small_batch))


def union_catalog(a: Catalog, b: Catalog) -> Catalog:
    return Catalog(a.books.unionByName(b.books), a.persons.unionByName(b.persons),
                   a.links.unionByName(b.links))


# ------------------------------------------------------------- lookup

def find_person(persons: DataFrame, name: str) -> DataFrame:
    """Persons with this normalised name (an equality pushed to the scan)."""
    return persons.filter(F.col("normalized_name") == F.lit(name))


def find_book(books: DataFrame, digest: str) -> DataFrame:
    """Books with this digest."""
    return books.filter(F.col("digest") == F.lit(digest))


def single_id(matches: DataFrame, what: str) -> int | None:
    """The one id of a G7/G8 lookup; more than one is an integrity error."""
    rows = matches.select("id").limit(2).collect()
    if len(rows) > 1:
        raise RuntimeError(f"catalogue integrity error: more than one {what}")
    return rows[0]["id"] if rows else None


def _lookup(table: DataFrame, key: str, wanted: DataFrame, wanted_col: str) -> DataFrame:
    w = wanted.select(F.col(wanted_col).alias("_k")).distinct()
    j = w.join(table.select(F.col(key).alias("_k"), "id"), "_k", "left")
    g = j.groupBy("_k").agg(F.count("id").alias("n_matches"), F.min("id").alias("id"))
    status = (F.when(F.col("n_matches") == 0, F.lit("missing"))
              .when(F.col("n_matches") == 1, F.lit("found"))
              .otherwise(F.lit("integrity error")))
    return g.select(F.col("_k").alias(key), "id", "n_matches", status.alias("status"))


def find_persons(persons: DataFrame, names: DataFrame, name_col: str = "normalized_name") -> DataFrame:
    """G7 for a whole set of names at once: ``(normalized_name, id, n_matches, status)``."""
    return _lookup(persons, "normalized_name", names, name_col)


def find_books(books: DataFrame, digests: DataFrame, digest_col: str = "digest") -> DataFrame:
    """G8 for a whole set of digests at once: ``(digest, id, n_matches, status)``."""
    return _lookup(books, "digest", digests, digest_col)


def authors_of(cat: Catalog, books: DataFrame | None = None) -> DataFrame:
    """``book_authors`` joined to ``persons`` for all (or the given) books.

    A shuffle join on ``person_id``; a prolific author is a hot key that AQE's
    skew-join splitting handles.
    """
    links = cat.links
    if books is not None:
        links = links.join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    p = cat.persons.select(F.col("id").alias("person_id"), "normalized_name",
                           "first_name", "middle_name", "last_name")
    return links.join(p, "person_id")


def search_titles(books: DataFrame, prefix: str) -> DataFrame:
    """Titles starting with ``prefix`` (no wildcard meaning of % or _).
    ``books`` may be a stored catalogue's ``titles``, whose files are sorted by
    title, so that a search skips what lies beside the prefix."""
    return (books.filter(F.col("title").startswith(prefix))
            .select("id", "title", "encoding", "filename"))


# ---------------------------------------------------------- delete / check

def delete_books(cat: Catalog, digests: DataFrame, digest_col: str = "digest") -> tuple[Catalog, DataFrame]:
    """Delete books by digest; their links go too, persons stay.

    Returns the new catalogue and ``(digest, book_id, status)`` per requested
    digest, ``status`` being ``deleted`` or ``not found`` (the caller decides
    whether a miss is an error).
    """
    req = digests.select(F.col(digest_col).alias("digest")).distinct()
    hit = cat.books.select("digest", F.col("id").alias("book_id")).join(req, "digest", "left_semi")
    books = cat.books.join(req, "digest", "left_anti")
    links = cat.links.join(hit.select("book_id"), "book_id", "left_anti")
    status = (req.join(hit, "digest", "left")
              .select("digest", "book_id",
                      F.when(F.col("book_id").isNull(), F.lit("not found"))
                      .otherwise(F.lit("deleted")).alias("status")))
    return Catalog(books, cat.persons, links), status


_DUPLICATES = {"digest": "duplicate_digest", "book": "duplicate_book_id", "name": "duplicate_person_name",
               "person": "duplicate_person_id", "link": "duplicate_link"}
_DANGLING = {"book": "dangling_link_book", "person": "dangling_link_person"}


def _fact(kind: str, key: F.Column, rows: int = 1, links: int = 0) -> F.Column:
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"),
                    F.lit(rows).alias("rows"), F.lit(links).alias("links"))


def _facts(df: DataFrame, table: str, required: list[str], *facts: F.Column) -> DataFrame:
    nulls = [F.when(F.col(c).isNull(), _fact("null", F.lit(f"{table}.{c}"))) for c in required]
    return df.select(F.explode(F.array_compact(F.array(*facts, *nulls))).alias("f")).select("f.*")


def check_catalog(cat: Catalog) -> DataFrame:
    """Integrity report ``(rule, key, n)``; empty when the catalogue is sound.

    Duplicate natural keys and ids, duplicate links, links to missing books
    or persons, NULL in required columns.  Every row states its facts (a key
    it has, a key it points to, a NULL), and one aggregate over all facts,
    combined per task first, answers every rule: each table is read once and
    only its key columns.
    """
    both = F.concat_ws("|", F.col("book_id").cast("string"), F.col("person_id").cast("string"))
    facts = (_facts(cat.books, "books", ["id", "digest", "title", "encoding", "filename"],
                    _fact("digest", F.col("digest")), _fact("book", F.col("id")))
             .unionByName(_facts(cat.persons, "persons", ["id", "normalized_name"],
                                 _fact("name", F.col("normalized_name")), _fact("person", F.col("id"))))
             .unionByName(_facts(cat.links, "book_authors", ["book_id", "person_id"], _fact("link", both),
                                 _fact("book", F.col("book_id"), 0, 1), _fact("person", F.col("person_id"), 0, 1))))
    g = facts.groupBy("kind", "key").agg(F.sum("rows").alias("rows"), F.sum("links").alias("links"))

    def rule(names: dict[str, str]) -> F.Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("kind"))

    def found(name: F.Column, key: F.Column, n: str, when: F.Column) -> F.Column:
        return F.when(name.isNotNull() & when, F.struct(name.alias("rule"), key.alias("key"), F.col(n).alias("n")))

    key = F.col("key")
    rules = F.array_compact(F.array(
        found(rule(_DUPLICATES), F.coalesce(key, F.lit("")), "rows", F.col("rows") > 1),
        # a NULL reference points to nothing, also where a row lacks its id
        found(rule(_DANGLING), key, "links", (F.col("links") > 0) & ((F.col("rows") == 0) | key.isNull())),
        found(rule({"null": "null_required"}), key, "rows", F.lit(True))))
    return g.select(F.explode(rules).alias("r")).select("r.rule", "r.key", F.col("r.n").cast("bigint").alias("n"))
