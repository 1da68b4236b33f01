"""Driver queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator
of the inventory, each over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._util import evaluate_once
from ..functions.encoding import CHARSETS, declared_encoding, encoding_supported, recode_charset, utf8_valid
from ..functions.naming import sanitize
from ..functions.normalize import norm_title, person_key
from ..operators import catalog as G
from ..operators.aliases import alias_table, principal_author, resolve_aliases
from ..operators.blacklist import exclude_blacklisted, new_blacklist_entries, only_blacklisted
from ..operators.identity import dedupe_books, duplicate_groups, with_digest
from ..operators.metadata import book_metadata, check_wellformed
from ..operators.organize import destination, move_plan, unique_destination
from ..session import scratch_path, written
from ..sources.archives import explode_archives
from ..sources.library import (BY_AUTHOR_SCHEMA, append_blacklist, compact_catalog, delete_from_catalog, read_blacklist, read_catalog, read_files,
                               scan_library, write_by_author, write_catalog)
from . import fixtures as X
from .pipeline import extract, extracted, index, parse_library, summary, validate

TARGET = "lib"


def _ids(c: str = "authors") -> F.Column:
    return F.array_join(F.transform(F.col(c), lambda a: a["id"]), "|")


# ---------------------------------------------------------------- D, F

def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    return X.book_src(spark, d).select("doc_id", norm_title(F.col("title")).alias("norm_title"))


def person_keys(spark: SparkSession, d: str) -> DataFrame:
    return X.authors_long(spark, d).select("doc_id", "pos", "id")


def book_digest(spark: SparkSession, d: str) -> DataFrame:
    return with_digest(X.accepted_books(spark, d)).select("doc_id", "digest")


def dedupe_books_q(spark: SparkSession, d: str) -> DataFrame:
    return dedupe_books(with_digest(X.accepted_books(spark, d))).select("digest", "path", "title", "doc_id")


def duplicate_groups_q(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(with_digest(X.accepted_books(spark, d)))


# ---------------------------------------------------------------- E

def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return alias_table(X.alias_source(spark, d))


def alias_table_q(spark: SparkSession, d: str) -> DataFrame:
    return _aliases(spark, d).select("alias_key", F.col("canonical.id").alias("canonical_id"),
                                     F.col("canonical.last_name").alias("canonical_last"))


def resolve_aliases_q(spark: SparkSession, d: str) -> DataFrame:
    books = X.parsed_books(spark, d).select("path", "doc_id", "authors")
    r = resolve_aliases(books, _aliases(spark, d))
    return r.filter(F.size("authors") > 0).select("doc_id", _ids().alias("resolved_ids"))


def author_list(spark: SparkSession, d: str) -> DataFrame:
    return (X.parsed_books(spark, d).filter(F.size("authors") > 0)
            .select("doc_id", _ids().alias("ids")))


def principal_author_q(spark: SparkSession, d: str) -> DataFrame:
    return X.parsed_books(spark, d).select("doc_id", principal_author(F.col("authors")).alias("principal"))


# ---------------------------------------------------------------- G (document catalogue)

def build_books(spark: SparkSession, d: str) -> DataFrame:
    return G.build_books(X.accepted_books(spark, d)).drop("created_at")


def build_persons(spark: SparkSession, d: str) -> DataFrame:
    return G.build_persons(X.accepted_books(spark, d))


def build_links(spark: SparkSession, d: str) -> DataFrame:
    return G.build_links(X.accepted_books(spark, d))


# ---------------------------------------------------------------- G (large catalogue)

def _base(spark: SparkSession, d: str) -> DataFrame:
    """The orders parsed once per query: every catalogue table of the query
    is derived from this written table, of which each reads its columns,
    instead of re-running the joins.  It takes no executor's memory."""
    return written(X.cat_parsed_base(spark, d), "parsed-orders")


def _existing(spark: SparkSession, d: str, base: DataFrame | None = None, once: bool = True) -> G.Catalog:
    base = base if base is not None else _base(spark, d)
    return G.build_catalog(X.cat_variant(base, "existing").filter(F.col("book_no") % 2 == 0), once)


def _batch(spark: SparkSession, d: str, base: DataFrame | None = None, once: bool = True) -> G.Catalog:
    base = base if base is not None else _base(spark, d)
    return G.build_catalog(X.cat_variant(base, "batch"), once)


def _both(spark: SparkSession, d: str, once: bool = True) -> tuple[G.Catalog, G.Catalog, DataFrame]:
    """Existing and batch catalogues from one written parse of the orders
    (both are derived from it by projection)."""
    base = _base(spark, d)
    return _existing(spark, d, base, once), _batch(spark, d, base, once), base


def upsert_books(spark: SparkSession, d: str) -> DataFrame:
    cat, batch, _ = _both(spark, d, once=False)
    new = G.upsert_books(cat.books, batch, small_batch=False)   # bulk load: all keys
    return cat.books.unionByName(new).select("id", "digest", "title", "encoding", "filename")


def upsert_persons(spark: SparkSession, d: str) -> DataFrame:
    cat, batch, _ = _both(spark, d, once=False)
    new = G.upsert_persons(cat.persons, batch, small_batch=False)
    return cat.persons.unionByName(new).select("id", "normalized_name", "first_name")


def upsert_links(spark: SparkSession, d: str) -> DataFrame:
    cat, batch, _ = _both(spark, d, once=False)
    return cat.links.unionByName(G.upsert_links(cat.links, batch, small_batch=False))


def find_person(spark: SparkSession, d: str) -> DataFrame:
    """Look every supplier's normalised name up in the existing catalogue."""
    sup = X.table(spark, d, "supplier")
    first = F.translate(F.split_part(F.col("s_name"), F.lit("#"), F.lit(2)), X.DIGITS, X.DIGIT_LETTERS)
    wanted = sup.select(person_key(F.lit("Supplier"), first, F.lit(None).cast("string")).alias("id"))
    return G.find_persons(_existing(spark, d, once=False).persons, wanted, "id")


def find_book(spark: SparkSession, d: str) -> DataFrame:
    cat, batch, _ = _both(spark, d, once=False)
    return G.find_books(cat.books, batch.books.select("digest"))


def authors_of_books(spark: SparkSession, d: str) -> DataFrame:
    return G.authors_of(_batch(spark, d)).select("book_id", "person_id", "normalized_name")


def _delete_request(base: DataFrame) -> DataFrame:
    cat = base.filter(F.col("book_no") % 10 == 0)
    real = with_digest(cat.select("norm_title", "ext_id", "version", "authors")).select("digest")
    fake = cat.select(F.md5(F.concat(F.lit("missing|"), F.col("book_no").cast("string"))).alias("digest"))
    return real.unionByName(fake)


def delete_books(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    _, status = G.delete_books(_batch(spark, d, base), _delete_request(base))
    return status


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    cat, _ = G.delete_books(_batch(spark, d, base), _delete_request(base))
    return cat.links


def snapshot_delete(spark: SparkSession, d: str) -> DataFrame:
    """A stored catalogue after a deletion and a compaction, each its own
    snapshot (A8, G10)."""
    base, root = _base(spark, d), scratch_path(spark, "snapshots")
    write_catalog(_batch(spark, d, base), root, bulk=True)
    delete_from_catalog(spark, root, _delete_request(base))
    cat = compact_catalog(spark, root)
    return (cat.books.select(F.lit("book").alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
            .unionByName(cat.links.select(F.lit("link").alias("kind"), F.col("book_id").alias("a"), F.col("person_id").alias("b"))))


def title_index(spark: SparkSession, d: str) -> DataFrame:
    """A prefix search in the stored title index of two commits."""
    cat, batch, _ = _both(spark, d)
    root = scratch_path(spark, "titles")
    write_catalog(cat, root, bulk=True)
    write_catalog(G.Catalog(G.upsert_books(read_catalog(spark, root).books, batch), batch.persons, batch.links), root, only=("books",))
    return G.search_titles(read_catalog(spark, root).titles, "Order bc").select("id", "title", "filename")


def catalog_integrity(spark: SparkSession, d: str) -> DataFrame:
    cat, batch, base = _both(spark, d)
    naive = G.union_catalog(cat, batch)          # appended without the anti-joins
    gone = base.filter(F.col("book_no") % 10 == 0)
    gone = with_digest(gone.select("norm_title", "ext_id", "version", "authors")).select("digest")
    return G.check_catalog(G.Catalog(naive.books.join(gone, "digest", "left_anti"), naive.persons, naive.links))


def search_titles(spark: SparkSession, d: str) -> DataFrame:
    return G.search_titles(_batch(spark, d, once=False).books, "Order bc")


# ---------------------------------------------------------------- H

def _plan(spark: SparkSession, d: str) -> DataFrame:
    return destination(X.accepted_books(spark, d), TARGET)


def sanitize_names(spark: SparkSession, d: str) -> DataFrame:
    b = X.accepted_books(spark, d)
    p = principal_author(F.col("authors"))
    return b.select("doc_id", sanitize(F.col("title")).alias("name"),
                    sanitize(F.col("title"), 24).alias("name24"), sanitize(p, 16).alias("author16"))


def destination_q(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("doc_id", "author_dir", "dest_name", "dest")


def unique_destination_q(spark: SparkSession, d: str) -> DataFrame:
    return unique_destination(_plan(spark, d), TARGET).select("doc_id", "unique_name", "dest_unique")


def move_plan_q(spark: SparkSession, d: str) -> DataFrame:
    """A library of which a part is sorted already: of the books that share a
    destination the first is in place, if its number divides by 4."""
    plan = _plan(spark, d).select("doc_id", "path", "author_dir", "dest_name", "suffix")
    first = plan.groupBy("author_dir", "dest_name").agg(F.min("doc_id").alias("_first"))
    there = (F.col("doc_id") == F.col("_first")) & (F.col("doc_id") % 4 == 0)
    place = F.concat(F.lit("file:/lib/"), F.col("author_dir"), F.lit("/"), F.col("dest_name"), F.col("suffix"))
    plan = plan.join(first, ["author_dir", "dest_name"]).withColumn("path", F.when(there, place).otherwise(F.col("path")))
    return move_plan(unique_destination(plan, "/lib"))


def by_author_sink(spark: SparkSession, d: str) -> DataFrame:
    """The planned layout written by author and read back."""
    text = X.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    # names only; they are read several times to be ranked, and twice to be dealt
    named = written(_plan(spark, d).select("doc_id", "path", "author_dir", "dest_name", "suffix", "dest"), "destinations")
    plan = written(unique_destination(named, TARGET).select("doc_id", "path", "author_dir", "unique_name", "suffix"), "by-author-plan")
    root = scratch_path(spark, "by-author")
    write_by_author(plan.join(text, "doc_id"), root)
    back = spark.read.schema(BY_AUTHOR_SCHEMA).parquet(root)
    return back.select("author_dir", "file_name", "source", F.sha2("content", 256).alias("sha"))


# ---------------------------------------------------------------- A, B3

def scan_library_q(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of four name endings, scanned without content and
    read afterwards (A1)."""
    m = F.col("doc_id") % 4
    ending = F.when(m == 0, ".fb2").when(m == 1, ".fb2.zip").when(m == 2, ".FB2").otherwise(".txt")
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ending)
    root = scratch_path(spark, "library")
    X.write_files(X.table(spark, d, "documents").select(name.alias("name"), F.encode("text", "UTF-8").alias("content")), root)
    read = read_files(scan_library(spark, root, with_content=False))
    return read.select("basename", "length", F.sha2("content", 256).alias("sha"))


def explode_archives_q(spark: SparkSession, d: str) -> DataFrame:
    """Multi-member archives with clashing names and damaged members (A2)."""
    root = scratch_path(spark, "archives")
    X.write_files(X.book_archives(spark, d), root)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(root).select("path")
    books = explode_archives(found)
    return books.select("basename", "member_path", F.col("error").isNull().alias("ok"), F.sha2("content", 256).alias("sha"))


def extract_twice(spark: SparkSession, d: str) -> DataFrame:
    """The target of four extractions: some archives, all of them without
    overwriting, the same again, and the others with overwriting (A2)."""
    root = scratch_path(spark, "archives")
    X.write_files(X.book_archives(spark, d), f"{root}/in")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(f"{root}/in").select("path")
    odd = F.regexp_extract("path", r"(\d)\.zip$", 1).cast("int") % 2 == 1
    extract(found.filter(~odd), f"{root}/out")
    for _ in range(2):
        extract(found, f"{root}/out")
    extract(found.filter(odd), f"{root}/out", overwrite=True)
    return extracted(spark, f"{root}/out").select("basename", "length", F.sha2("content", 256).alias("sha"))


def blacklist_file(spark: SparkSession, d: str) -> DataFrame:
    """A list with comments and remarks is read, appended to and read again
    (A4, A7)."""
    docs = X.table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.concat(F.col("doc_id"), F.lit(".fb2")).alias("basename"))
    root = scratch_path(spark, "blacklist")
    line = (F.when(F.col("doc_id") % 77 == 0, F.concat(F.lit("# "), F.col("basename"), F.lit("|remark")))
            .when(F.col("doc_id") % 2 == 0, F.col("basename"))
            .otherwise(F.concat(F.col("basename"), F.lit("|"), F.col("lang"), F.lit("|"), F.col("n_chars"))))
    docs.filter("doc_id % 7 = 0").select(line.alias("value")).write.text(root)
    failed = docs.select("basename", F.lit(False).alias("ok"), F.lit("cut\nshort").alias("reason")).filter("n_chars % 3 = 0")
    append_blacklist(new_blacklist_entries(failed, read_blacklist(spark, root)), root)
    return read_blacklist(spark, root)


def utf8_check(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, three quarters with a stray, a cut or an overlong
    sequence at the end (B3)."""
    m = F.col("doc_id") % 4
    tail = F.when(m == 1, F.unhex(F.lit("FF"))).when(m == 2, F.unhex(F.lit("C3"))).when(m == 3, F.unhex(F.lit("C0AF"))).otherwise(F.unhex(F.lit("")))
    return X.table(spark, d, "documents").select("doc_id", utf8_valid(F.concat(F.encode("text", "UTF-8"), tail)).alias("ok"))


# ---------------------------------------------------------------- I, K

def _files(spark: SparkSession, d: str) -> DataFrame:
    return X.book_src(spark, d).select("doc_id", "path", "basename")


def exclude_blacklisted_q(spark: SparkSession, d: str) -> DataFrame:
    return exclude_blacklisted(_files(spark, d), X.blacklist_src(spark, d)).select("path", "basename")


def only_blacklisted_q(spark: SparkSession, d: str) -> DataFrame:
    return only_blacklisted(_files(spark, d), X.blacklist_src(spark, d)).select("path", "basename")


#: The ``book_src`` columns that rendering reads.
_RENDERED = ("n_chars", "text", "title", "lang", "genre", "ext_id", "version", "w")


def _breakable(src: DataFrame) -> DataFrame:
    """``book_src`` rows with their FB2 text ``xml``, every 5th broken in one
    of seven ways: root left open, wrong end tag, bare ampersand, unquoted
    attribute, a prefix never declared, one out of scope, one of an attribute.
    Some others have prefixes that are bound, nested and declared anew."""
    broken = F.col("doc_id") % 5 == 0
    way = F.when(broken, (F.col("doc_id") / 5).cast("long") % 7)
    section = F.lit("<section>")
    bound = F.when(F.col("doc_id") % 5 == 1, F.lit('<section><y:p xmlns:y="u"><y:q xmlns:y="v" y:a="&gt;"/></y:p>')).when(
        F.col("doc_id") % 5 == 2, F.lit("<section xmlns:y='>'><y:p xml:lang=\"en\">y:z=\"1\"</y:p>"))
    root_end = F.when(way == 0, F.lit("")).otherwise(F.lit("</FictionBook>\n"))
    x = F.col("_whole")
    xml = (F.when(way == 1, F.replace(x, F.lit("</section>"), F.lit("</sektion>")))
           .when(way == 2, F.replace(x, F.lit("<section><p>"), F.lit("<section><p>this & that ")))
           .when(way == 3, F.replace(x, section, F.lit("<section id=a>")))
           .when(way == 4, F.replace(x, section, F.lit("<section><y:p/>")))
           .when(way == 5, F.replace(x, section, F.lit('<section><p><e xmlns:y="u"/><y:p/></p>')))
           .when(way == 6, F.replace(x, section, F.lit('<section y:href="u">')))
           .when(bound.isNotNull(), F.replace(x, section, bound)).otherwise(x))
    return evaluate_once(src, "_whole", X.fb2_text(src, close_root=root_end)).withColumn("xml", xml).drop("_whole")


def _validation(spark: SparkSession, d: str) -> DataFrame:
    """Rendered documents, some broken, checked."""
    src = _breakable(X.book_src(spark, d).select("doc_id", "path", "basename", *_RENDERED))
    checked = evaluate_once(src, "ok", check_wellformed(F.col("xml")))
    return checked.select("doc_id", "path", "basename", "ok",
                          F.when(~F.col("ok"), F.lit("malformed XML")).alias("reason"))


def new_blacklist_entries_q(spark: SparkSession, d: str) -> DataFrame:
    return new_blacklist_entries(_validation(spark, d), X.blacklist_src(spark, d))


def run_summary_q(spark: SparkSession, d: str) -> DataFrame:
    """The validate command's counts over files in bytes (K1)."""
    src = _breakable(X.book_src(spark, d).select("doc_id", "path", *_RENDERED))
    raw = written(src.select("doc_id", "path", F.encode("xml", "UTF-8").alias("raw")), "rendered")
    files = X.zipped_where_named(raw)
    results = written(validate(files, X.blacklist_src(spark, d)), "validated")   # read twice below
    return summary(files, results, results.filter(~F.col("ok")))


# ---------------------------------------------------------------- B, C

_DECLS = [  # Fixed values: the eight declaration forms rendered by doc_id % 8.
    '<?xml version="1.0" encoding="windows-1251"?>',
    '<?xml version="1.0" encoding="KOI8-R"?>',
    '<?xml version="1.0" encoding="Windows-1252"?>',
    '<?xml version="1.0" encoding="iso-8859-5"?>',
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<?xml version="1.0" encoding="big5"?>',
    '<?xml version="1.0"?>',
    "<?xml version='1.0' encoding='koi8-r'?>",
]


def declared_encoding_q(spark: SparkSession, d: str) -> DataFrame:
    src = X.book_src(spark, d)
    m = F.col("doc_id") % 8
    decl = None
    for i, s in enumerate(_DECLS):
        decl = F.when(m == i, F.lit(s + "\n")) if decl is None else decl.when(m == i, F.lit(s + "\n"))
    files = src.select("doc_id", F.encode(X.fb2_text(src, declaration=decl), "UTF-8").alias("content"))
    enc = files.select("doc_id", declared_encoding(F.col("content")).alias("encoding"))
    return enc.select("doc_id", "encoding", encoding_supported(F.col("encoding")).alias("supported"))


def recode_charsets(spark: SparkSession, d: str) -> DataFrame:
    """B2 over whole texts: each is stored as a single-byte file (what Latin-1
    lacks as ``?``) and decoded in one of the charsets."""
    src = X.table(spark, d, "documents").select(
        "doc_id", F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1").alias("raw"))
    raw = F.col("raw")
    m = F.col("doc_id") % 6
    out = None
    for i, cs in enumerate(CHARSETS):
        out = (F.when(m == i, recode_charset(raw, cs)) if out is None
               else out.when(m == i, recode_charset(raw, cs)))
    return src.select("doc_id", out.alias("recoded"))


def wellformed(spark: SparkSession, d: str) -> DataFrame:
    return _validation(spark, d).select("doc_id", "ok")


def fb2_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    src = X.book_src(spark, d)
    text = X.fb2_text(src, document_authors=True)
    meta = book_metadata(src.select("doc_id", "path", text.alias("text")))
    return meta.select("doc_id", "title", "ext_id", "version", "lang", "genre",
                       _ids().alias("author_ids"))


def _spoilt_title() -> F.Column:
    return (F.when(F.col("doc_id") % 11 == 0, F.lit("1984"))
            .when(F.col("doc_id") % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("title")))


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    src = X.book_src(spark, d).withColumn("title", _spoilt_title())
    text = X.fb2_text(src)
    text = F.when(F.col("doc_id") % 17 == 0,
                  F.replace(F.replace(text, F.lit("<description>"), F.lit("<annotation>")),
                            F.lit("</description>"), F.lit("</annotation>"))).otherwise(text)
    text = F.when(F.col("doc_id") % 19 == 0,
                  F.replace(text, F.lit("<title-info>"), F.lit("<title-info><p>"))).otherwise(text)
    meta = book_metadata(src.select("doc_id", "path", "basename", text.alias("text")))
    return meta.select("doc_id", "basename", "reject_reason")


def _edge_forms(src: DataFrame) -> F.Column:
    """FB2 text of a ``book_src`` row in one of twelve unusual but valid forms,
    chosen by ``doc_id % 12``."""
    text = X.fb2_text(src)
    title = F.coalesce(F.col("title"), F.lit(""))
    tag, end, root = F.lit("<book-title>"), F.lit("</book-title>"), F.lit("<FictionBook>")
    forms = [
        F.concat(F.lit("\ufeff"), text),
        F.concat(F.repeat(F.lit("\n"), F.lit(5000)), X.fb2_text(src, declaration=F.lit(""))),
        F.replace(text, root, F.lit('<!DOCTYPE FictionBook [<!ENTITY a "b>c">]>\n<FictionBook>')),
        F.replace(F.regexp_replace(text, r"<(/?)([A-Za-z])", "<$1f:$2"), F.lit("<f:FictionBook>"),
                  F.lit('<f:FictionBook xmlns:f="urn:f">')),
        F.replace(text, F.lit("<description>"), F.lit("<!-- </description> --><description>")),
        F.replace(text, end, F.concat(F.lit("<emphasis>and more</emphasis>"), end)),
        F.replace(text, F.concat(tag, X.xml_escape(title)), F.concat(tag, F.lit("<![CDATA["), title, F.lit("]]>"))),
        F.replace(F.replace(text, tag, F.concat(tag, F.lit("<strong>"))), end, F.concat(F.lit("</strong> Last words"), end)),
        F.replace(text, root, F.lit('<!DOCTYPE FictionBook [<!ENTITY a "x]y">]>\n<FictionBook>')),
        F.replace(text, root, F.lit("<!-- it's ]> --><!DOCTYPE FictionBook SYSTEM \"a>b\" [<?p '?> <!-- \" --> ] >\n<FictionBook>")),
        F.replace(text, root, F.lit("<!DOCTYPE FictionBook [<!ENTITY a '</description> <!-- \"'>]><FictionBook>")),
        F.replace(F.replace(text, root, F.lit('<FictionBook xmlns:l="u">')), tag, F.concat(F.lit(
            '<x:note xmlns:x="v" l:a="]>"><x:p xmlns:x="w"/></x:note>'), tag)),
    ]
    m = F.col("doc_id") % len(forms)
    out = F.when(m == 0, forms[0])
    for k, form in enumerate(forms[1:], 1):
        out = out.when(m == k, form)
    return out


def fb2_edge_cases(spark: SparkSession, d: str) -> DataFrame:
    """C1-C5 on byte order marks, long blank prologs, DOCTYPE subsets, prefixed
    elements, comments, CDATA and markup in titles, from bytes."""
    src = X.book_src(spark, d)
    path = F.concat(F.lit("edge/"), F.col("doc_id").cast("string"), F.lit(".fb2"))
    files = src.select("doc_id", path.alias("path"), F.encode(_edge_forms(src), "UTF-8").alias("content"))
    meta = parse_library(files).select("doc_id", "path", "title", _ids().alias("author_ids"), "reject_reason")
    checked = validate(files)
    return meta.join(checked.select("path", "ok"), "path").drop("path")


# ---------------------------------------------------------------- end to end

def _index_catalog(spark: SparkSession, d: str) -> G.Catalog:
    files = X.render_library(spark, d)
    cat, _ = index(files, aliases=_aliases(spark, d), persist=False)   # only books are read
    return cat


def index_books(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: rendered FB2 bytes (plain, zipped, three charsets) ->
    decode -> metadata -> aliases -> digest -> first-seen ``books``."""
    return _index_catalog(spark, d).books.drop("created_at")


def index_persons(spark: SparkSession, d: str) -> DataFrame:
    return _index_catalog(spark, d).persons.select("id", "normalized_name")


def index_links(spark: SparkSession, d: str) -> DataFrame:
    return _index_catalog(spark, d).links


def index_rejects(spark: SparkSession, d: str) -> DataFrame:
    _, rejects = index(X.render_library(spark, d, title=_spoilt_title()), persist=False)
    return rejects.select("path", "reject_reason")


def _streamed(spark: SparkSession, d: str) -> G.Catalog:
    from ..streaming.library_stream import stream_index_documents

    return stream_index_documents(spark, d)


def stream_index(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d).books.select("id", "digest", "ext_id", "version")


def stream_persons(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d).persons.select("id", "normalized_name")


def stream_links(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d).links


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "normalize_title": normalize_title,
        "person_keys": person_keys,
        "book_digest": book_digest,
        "dedupe_books": dedupe_books_q,
        "duplicate_groups": duplicate_groups_q,
        "alias_table": alias_table_q,
        "resolve_aliases": resolve_aliases_q,
        "author_list": author_list,
        "principal_author": principal_author_q,
        "build_books": build_books,
        "build_persons": build_persons,
        "build_links": build_links,
        "upsert_books": upsert_books,
        "upsert_persons": upsert_persons,
        "upsert_links": upsert_links,
        "find_person": find_person,
        "find_book": find_book,
        "authors_of_books": authors_of_books,
        "delete_books": delete_books,
        "delete_cascade": delete_cascade,
        "catalog_integrity": catalog_integrity,
        "snapshot_delete": snapshot_delete,
        "title_index": title_index,
        "search_titles": search_titles,
        "sanitize_names": sanitize_names,
        "destination": destination_q,
        "unique_destination": unique_destination_q,
        "move_plan": move_plan_q,
        "exclude_blacklisted": exclude_blacklisted_q,
        "only_blacklisted": only_blacklisted_q,
        "new_blacklist_entries": new_blacklist_entries_q,
        "run_summary": run_summary_q,
        "declared_encoding": declared_encoding_q,
        "recode_charsets": recode_charsets,
        "wellformed": wellformed,
        "fb2_roundtrip": fb2_roundtrip,
        "reject_reasons": reject_reasons,
        "fb2_edge_cases": fb2_edge_cases,
        "index_books": index_books,
        "index_persons": index_persons,
        "index_links": index_links,
        "index_rejects": index_rejects,
        "stream_index": stream_index,
        "stream_persons": stream_persons,
        "stream_links": stream_links,
        "by_author_sink": by_author_sink,
        "scan_library": scan_library_q,
        "explode_archives": explode_archives_q,
        "extract_twice": extract_twice,
        "blacklist_file": blacklist_file,
        "utf8_check": utf8_check,
    }
