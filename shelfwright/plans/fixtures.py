"""Catalogue inputs derived by Spark from the driver tables.

No FB2 file exists in the driver data, so books are modelled two ways:

* ``book_src`` -- one "file" per ``documents`` row, every field except the
  path derived from the content, so exact copies collide on the digest.
  :func:`render_library` renders these as real FB2 bytes (plain or zipped,
  in several charsets) for the end-to-end chain.
* ``cat_*`` -- a large relational catalogue: orders are books, suppliers
  are persons, lineitem gives the links.

All of it is lazy DataFrame code over the given tables; nothing is
synthesised outside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import evaluate_once
from ..functions.normalize import norm_title, person_key, trim_to_null
from ..operators.aliases import dedupe_authors
from ..operators.metadata import PERSON
from ..session import bound_batches

# Digits coded as letters (digits vanish in normalisation).
DIGITS = "0123456789"
DIGIT_LETTERS = "abcdefghij"


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cluster when it yields fewer input partitions
    than there are cores (a small file with one row group is read by one
    task, and every narrow expression after it would run in that task).
    A large input already has more splits than cores and is left alone, so
    this never adds a shuffle at scale."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet"))


def book_src(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: path, basename, raw title (first line), lang,
    genre, ext_id, version and the words ``w`` the authors come from."""
    docs = table(spark, d, "documents")
    ext = F.when(F.col("doc_id") % 7 == 0, F.lit(".fb2.zip")).otherwise(F.lit(".fb2"))
    return docs.select(
        "doc_id", "n_chars", "text",  # text is pruned by Catalyst where unused
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.concat(F.col("doc_id").cast("string"), ext).alias("basename"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        "lang",
        F.col("source").alias("genre"),
        F.when(F.col("n_chars") % 5 != 0, F.col("n_chars").cast("string")).alias("ext_id"),
        F.when(F.col("n_chars") % 3 != 0, F.lit("1.0")).alias("version"),
        # Only words 1-5 are ever used: with limit 6 the split stops after the
        # fifth separator (the sixth element holds the rest of the text
        # unsplit), which gives exactly the same first five words.
        F.split(F.trim(F.col("text")), r"\s+", 6).alias("w"),
    )


def _word(i: int):
    return F.get(F.col("w"), i)


def raw_authors(src: DataFrame) -> F.Column:
    """Author 1 = words 1,2,3 (last, first, middle); author 2 = words 4,5
    when ``n_chars`` is even.  Raw words, before normalisation."""
    a1 = F.struct(_word(0).alias("last"), _word(1).alias("first"), _word(2).alias("middle"))
    a2 = F.struct(_word(3).alias("last"), _word(4).alias("first"), F.lit(None).cast("string").alias("middle"))
    return F.when(F.col("n_chars") % 2 == 0, F.array(a1, a2)).otherwise(F.array(a1))


def authors_long(spark: SparkSession, d: str) -> DataFrame:
    """One row per (document, author position) with the person key (may be NULL)."""
    src = book_src(spark, d)
    ex = src.select("doc_id", "path", F.posexplode(raw_authors(src)).alias("p0", "a"))
    return ex.select("doc_id", "path", (F.col("p0") + 1).alias("pos"),
                     F.col("a.last").alias("last_name"), F.col("a.first").alias("first_name"),
                     F.col("a.middle").alias("middle_name"),
                     person_key(F.col("a.last"), F.col("a.first"), F.col("a.middle")).alias("id"))


def _person(a) -> F.Column:
    return F.struct(person_key(a["last"], a["first"], a["middle"]).alias("id"),
                    trim_to_null(a["first"]).alias("first_name"),
                    trim_to_null(a["middle"]).alias("middle_name"),
                    trim_to_null(a["last"]).alias("last_name"))


def parsed_books(spark: SparkSession, d: str) -> DataFrame:
    """``book_src`` in the shape the metadata stage produces: one row per
    file with ``title, norm_title, ext_id, version, lang, genre, filename,
    encoding`` and the usable authors (first occurrence, document order).
    Rejected titles are kept; filter on ``norm_title`` for accepted books."""
    src = book_src(spark, d)
    people = F.transform(raw_authors(src), _person)
    authors = dedupe_authors(F.filter(people, lambda p: p["id"].isNotNull())).cast(T.ArrayType(PERSON))
    src = evaluate_once(src, "norm_title", norm_title(F.col("title")))
    return src.select(
        "doc_id", "path", "basename", "title", "norm_title",
        "ext_id", "version", "lang", "genre",
        F.regexp_replace(F.col("basename"), r"\.[^.]*$", "").alias("filename"),
        F.lit("utf-8").alias("encoding"),
        authors.alias("authors"),
    )


def accepted_books(spark: SparkSession, d: str) -> DataFrame:
    return parsed_books(spark, d).filter(F.col("norm_title").isNotNull())


def alias_source(spark: SparkSession, d: str) -> DataFrame:
    """``(canonical, alias, position)``: about a quarter of the person keys
    (length divisible by 4) are aliases, each listed twice: of their last name
    alone and of ``<last name> Zweit``; half of them in either order."""
    al = authors_long(spark, d).filter(F.col("id").isNotNull() & (F.length("id") % 4 == 0))
    last = F.split_part(F.col("alias"), F.lit(" "), F.lit(1))
    turn = (F.length("alias") / 4).cast("int") % 2
    entries = F.array(F.struct(last.alias("canonical"), turn.alias("position")),
                      F.struct(F.concat(last, F.lit(" Zweit")).alias("canonical"), (1 - turn).alias("position")))
    return (al.select(F.col("id").alias("alias")).distinct().select("alias", F.explode(entries).alias("e"))
            .select("e.canonical", "alias", "e.position"))


def blacklist_src(spark: SparkSession, d: str) -> DataFrame:
    """``(basename, comment)``: documents labelled toxic."""
    lab = table(spark, d, "labels").filter(F.col("toxic") == 1)
    src = book_src(spark, d).select("doc_id", "basename")
    return lab.join(src, "doc_id").select(
        "basename", F.concat(F.lit("quality="), F.col("quality").cast("string")).alias("comment"))


# ------------------------------------------------------------------ rendering

def xml_escape(c) -> F.Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(tag: str, value) -> F.Column:
    """``<tag>value</tag>``, or '' when the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"<{tag}>"), xml_escape(value), F.lit(f"</{tag}>")), F.lit(""))


def _author_xml(a) -> F.Column:
    return F.concat(F.lit("<author>"), _element("first-name", a["first"]),
                    _element("middle-name", a["middle"]), _element("last-name", a["last"]),
                    F.lit("</author>"))


def fb2_text(src: DataFrame, declaration=None, close_root=None, document_authors: bool = False) -> F.Column:
    """FB2 document for a ``book_src`` row, whole text as the body.  With
    ``document_authors`` every author but the first stands in document-info."""
    people = F.transform(raw_authors(src), _author_xml)
    authors = F.get(people, 0) if document_authors else F.array_join(people, "")
    others = F.array_join(F.slice(people, 2, 9), "") if document_authors else F.lit("")
    decl = declaration if declaration is not None else F.lit('<?xml version="1.0" encoding="utf-8"?>\n')
    end = close_root if close_root is not None else F.lit("</FictionBook>\n")
    return F.concat(
        decl, F.lit("<FictionBook>\n<description>\n<title-info>"),
        _element("genre", F.col("genre")), authors,
        _element("book-title", F.col("title")), _element("lang", F.col("lang")),
        F.lit("</title-info>\n<document-info>"), others,
        _element("id", F.col("ext_id")), _element("version", F.col("version")),
        F.lit("</document-info>\n</description>\n<body><section><p>"),
        xml_escape(F.col("text")),
        F.lit("</p></section></body>\n"), end)


def render_library(spark: SparkSession, d: str, title=None) -> DataFrame:
    """``(path, content)``: every document as FB2 bytes.  A third of the
    files are single-byte encoded (declared ``windows-1252`` or
    ``ISO-8859-1``), every 7th is a ``.fb2.zip`` holding one ``.fb2``.
    ``title`` replaces the documents' own."""
    src = book_src(spark, d)
    if title is not None:
        src = src.withColumn("title", title)
    m = F.col("doc_id") % 3
    decl = (F.when(m == 1, F.lit('<?xml version="1.0" encoding="windows-1252"?>\n'))
            .when(m == 2, F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>\n'))
            .otherwise(F.lit('<?xml version="1.0" encoding="utf-8"?>\n')))
    xml = src.select("doc_id", "path", fb2_text(src, declaration=decl).alias("xml"))
    raw = xml.select("doc_id", "path", F.when(m == 0, F.encode("xml", "UTF-8"))
                     .otherwise(F.encode("xml", "ISO-8859-1")).alias("raw"))
    return zipped_where_named(raw)


def zipped_where_named(raw: DataFrame) -> DataFrame:
    """``(doc_id, path, content)`` from ``raw`` bytes: ``.fb2.zip`` paths hold
    them as their one member."""
    from ..sources.archives import zip_single

    bound_batches(raw.sparkSession)
    is_zip = F.col("path").endswith(".fb2.zip")
    inner = F.regexp_replace(F.regexp_extract(F.col("path"), r"([^/]*)$", 1), r"\.zip$", "")
    zipped = raw.withColumn("_zip", zip_single(F.when(is_zip, inner), F.when(is_zip, F.col("raw"))))
    content = F.when(is_zip, F.col("_zip")).otherwise(F.col("raw"))
    return zipped.select("doc_id", "path", content.alias("content"))


# ------------------------------------------------------------- large catalogue

def _letters(c) -> F.Column:
    return F.translate(c, DIGITS, DIGIT_LETTERS)


def cat_parsed_base(spark: SparkSession, d: str) -> DataFrame:
    """Orders as parsed books: title ``Order <key in letters>``, ext_id =
    key, version = status, genre = priority; authors = suppliers of the
    order's line items, ordered by supplier key (at most 7 per order)."""
    orders = table(spark, d, "orders")
    sup = table(spark, d, "supplier")
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_no"),
                                               F.col("l_suppkey").alias("person_no")).distinct()
    first = _letters(F.split_part(F.col("s_name"), F.lit("#"), F.lit(2)))
    persons = sup.select(F.col("s_suppkey").alias("person_no"),
                         F.struct(person_key(F.lit("Supplier"), first, F.lit(None).cast("string")).alias("id"),
                                  first.alias("first_name"), F.lit(None).cast("string").alias("middle_name"),
                                  F.lit("Supplier").alias("last_name")).alias("p"))
    authors = (links.join(persons, "person_no")
               .groupBy("book_no")
               .agg(F.sort_array(F.collect_list(F.struct("person_no", "p"))).alias("_a"))
               .select("book_no", F.transform("_a", lambda s: s["p"]).cast(T.ArrayType(PERSON)).alias("authors")))
    key = F.col("o_orderkey").cast("string")
    books = orders.select(
        F.col("o_orderkey").alias("book_no"),
        F.concat(F.lit("cat/"), key, F.lit(".fb2")).alias("path"),
        F.concat(F.lit("Order "), _letters(key)).alias("title"),
        key.alias("ext_id"), F.col("o_orderstatus").alias("version"),
        F.lit(None).cast("string").alias("lang"), F.col("o_orderpriority").alias("genre"),
        key.alias("filename"), F.lit("utf-8").alias("encoding"))
    out = books.join(authors, "book_no", "left").withColumn(
        "authors", F.coalesce(F.col("authors"), F.array().cast(T.ArrayType(PERSON))))
    return evaluate_once(out, "norm_title", norm_title(F.col("title")))


def cat_variant(base: DataFrame, variant: str = "batch") -> DataFrame:
    """``variant="existing"`` marks rows with encoding ``koi8-r`` and
    upper-case first names (same person keys), so that an upsert that wrongly
    updates shows up."""
    if variant == "batch":
        return base
    upper = F.transform("authors", lambda a: a.withField("first_name", F.upper(a["first_name"])))
    return base.withColumn("authors", upper).withColumn("encoding", F.lit("koi8-r"))


def cat_parsed(spark: SparkSession, d: str, variant: str = "batch") -> DataFrame:
    return cat_variant(cat_parsed_base(spark, d), variant)


# ------------------------------------------------------------- files on disk

def _store(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def write_files(files: DataFrame, root: str) -> None:
    """Write ``(name, content)`` rows as the files ``root/name``."""
    bound_batches(files.sparkSession)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                store, path = _store(f"{root}/{name}")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(content.as_buffer())
            yield batch.select([0])

    files.select("name", "content").mapInArrow(run, "name string").count()


#: Documents an archive holds, and how many names the clashing ones share.
ARCHIVE_BOOKS, CLASHING_NAMES = 64, 250


def book_archives(spark: SparkSession, d: str) -> DataFrame:
    """``(name, content)`` of ZIP archives with the documents' texts as books:
    every 5th has one of a few names that other documents share, and every
    20th is damaged."""
    import io
    import zipfile

    import pandas as pd

    def build(pdf):
        buf, damaged = io.BytesIO(), []
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
            for i, text in sorted(zip(pdf["doc_id"].tolist(), pdf["text"])):
                name = f"b{i % CLASHING_NAMES}.fb2" if i % 5 == 0 else f"{i}.fb2"
                info = zipfile.ZipInfo(f"d{i}/{name}", date_time=(2000, 1, 1, 0, 0, 0))
                z.writestr(info, text.encode())
                if i % 20 == 0:
                    damaged.append(info.header_offset + 30 + len(info.filename))
        data = bytearray(buf.getvalue())
        for at in damaged:
            data[at] ^= 0xFF
        return pd.DataFrame({"name": [f"a{pdf['a'].iloc[0]:08d}.zip"], "content": [bytes(data)]})

    bound_batches(spark)
    docs = table(spark, d, "documents").select("doc_id", "text", F.expr(f"doc_id DIV {ARCHIVE_BOOKS}").alias("a"))
    return docs.groupBy("a").applyInPandas(build, "name string, content binary")
