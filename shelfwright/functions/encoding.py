"""Bytes -> text: declared encoding (B1), single-byte recoding (B2),
UTF-8 check (B3) and the supported-encoding test (B4).

Spark 4's ``decode`` only knows ISO-8859-1, US-ASCII and the UTFs, so a
legacy single-byte charset is decoded as ISO-8859-1 (one char per byte,
U+0080..U+00FF for the upper half) and then ``translate``d through a
128-character table.  The tables are built from the standard codecs by a
rule, not typed in.  All of it stays a Catalyst expression; nothing throws
per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import col

REPLACEMENT = "�"
UPPER_HALF = bytes(range(0x80, 0x100)).decode("latin-1")

# The encoding names accepted (after ASCII lower-casing) and
# the charset each one decodes with.
ENCODING_ALIASES = {
    "windows-1251": "cp1251",
    "cp1251": "cp1251",
    "windows-1252": "cp1252",
    "cp1252": "cp1252",
    "windows-1255": "cp1255",
    "cp1255": "cp1255",
    "iso-8859-1": "iso-8859-1",
    "iso-8859-5": "iso-8859-5",
    "koi8-r": "koi8-r",
}
UTF8 = "utf-8"
SUPPORTED_ENCODINGS = sorted([UTF8, *ENCODING_ALIASES])
# Charsets whose bytes 0x80-0x9F have no character (U+FFFD).
C1_UNDEFINED = ("iso-8859-1", "iso-8859-5")
CHARSETS = ("cp1251", "koi8-r", "cp1252", "iso-8859-1", "iso-8859-5", "cp1255")


def charset_table(charset: str) -> str:
    """The 128 characters bytes 0x80..0xFF decode to (U+FFFD where undefined)."""
    chars = list(bytes(range(0x80, 0x100)).decode(charset, errors="replace"))
    if charset in C1_UNDEFINED:
        chars[:0x20] = REPLACEMENT * 0x20
    table = "".join(chars)
    assert len(table) == 128, charset
    return table


def _latin1(content) -> Column:
    return F.decode(col(content), "ISO-8859-1")


def recode_charset(content, charset: str) -> Column:
    """Decode single-byte ``content`` in ``charset`` (a key of CHARSETS)."""
    return F.translate(_latin1(content), UPPER_HALF, charset_table(charset))


def recode(content, encoding) -> Column:
    """B2: decode ``content`` (binary) declared as ``encoding`` to a string.

    UTF-8 passes through (see :func:`utf8_valid` for the validity test);
    unsupported encodings give NULL (see :func:`encoding_supported`).
    """
    enc = col(encoding)
    expr = F.when(enc == UTF8, col(content).cast("string"))
    by_charset: dict[str, list[str]] = {}
    for name, cs in ENCODING_ALIASES.items():
        by_charset.setdefault(cs, []).append(name)
    for cs, names in by_charset.items():
        expr = expr.when(enc.isin(*names), recode_charset(content, cs))
    return expr


def encoding_supported(encoding) -> Column:
    """True when the encoding name is one we can decode."""
    return col(encoding).isin(*SUPPORTED_ENCODINGS)


def utf8_valid(content) -> Column:
    """The bytes are valid UTF-8 (never throws, unlike ``decode``)."""
    return F.is_valid_utf8(col(content).cast("string"))


# How far into a file the declaration is looked for before falling back to
# the whole content (declarations are a few dozen bytes in practice).
_HEAD_BYTES = 4096


def declaration_head(content) -> Column:
    """The bytes the declaration is looked for in, decoded as Latin-1: the
    first few KiB, or the whole file when a declaration starts but does not
    end there (rare, so the whole-file decode runs only for those rows)."""
    content = col(content)
    head = _latin1(F.substring(content, 1, _HEAD_BYTES))
    need_whole = (F.startswith(head, F.lit("<?xml")) & (F.locate("?>", head) == 0)
                  & (F.octet_length(content) > _HEAD_BYTES))
    return F.when(need_whole, _latin1(content)).otherwise(head)


def encoding_from_head(head) -> Column:
    """B1 on :func:`declaration_head`: the lower-cased ``encoding="..."``
    value, ``utf-8`` without declaration or attribute, NULL when the
    declaration never ends."""
    text = col(head)
    decl = F.substring_index(text, "?>", 1)
    return (F.when(~F.startswith(text, F.lit("<?xml")), F.lit(UTF8))
            .when(F.locate("?>", text) == 0, F.lit(None).cast("string"))
            .when(decl.rlike(r'encoding="[^"]*"'), F.lower(F.regexp_extract(decl, r'encoding="([^"]*)"', 1)))
            .otherwise(F.lit(UTF8)))


def declaration_error(head) -> Column:
    text = col(head)
    return F.when(F.startswith(text, F.lit("<?xml")) & (F.locate("?>", text) == 0),
                  F.lit("XML declaration incomplete"))


def declared_encoding(content) -> Column:
    """B1: encoding named by the XML declaration of ``content`` (binary).

    Only a file starting with ``<?xml`` has a declaration; it runs to the
    first ``?>``.  ``encoding="..."`` (double quotes only) gives the
    lower-cased value; no attribute, no closing quote or no declaration
    give ``utf-8``; a declaration that never ends gives NULL (see
    :func:`declaration_error`).  Prefer :func:`decode_books` on
    DataFrames: it evaluates the head once.
    """
    return encoding_from_head(declaration_head(content))


def decode_books(df: DataFrame, content: str = "content", until: str | None = None) -> DataFrame:
    """B1-B4 as DataFrame stages: adds ``encoding``, ``error`` (kept if
    already present and non-NULL) and ``text``.

    Each intermediate is its own column, so the optimizer evaluates it once
    instead of inlining it at every use.  One bad file becomes an error
    string, never an exception.  With ``until`` (an ASCII marker such as
    ``</description>``) only the bytes up to and including its first
    occurrence are checked and decoded -- the metadata reader never looks
    further, and every supported charset is ASCII-compatible, so the byte
    search is exact.  Where a comment, CDATA section or entity value starts
    before the marker, the marker may stand inside it, so the whole content
    is decoded.
    """
    c = F.col(content)
    if until:
        # byte offset of the marker: substring_index works on the UTF-8 bytes
        # of the (unvalidated) string view, octet_length counts them
        head = F.substring_index(c.cast("string"), until, 1)
        before = F.octet_length(head)
        found = ((before < F.octet_length(c)) & ~F.contains(head, F.lit("<!--"))
                 & ~F.contains(head, F.lit("<![CDATA[")) & ~F.contains(head, F.lit("<!ENTITY")))
        df = df.withColumn("_upto", F.when(found, F.substring(c, F.lit(1), before + len(until)))
                           .otherwise(c))
        c = F.col("_upto")
    prior = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("_head", declaration_head(c))
    df = (df.withColumn("encoding", encoding_from_head(F.col("_head")))
            .withColumn("_decl_error", declaration_error(F.col("_head"))))
    enc = F.col("encoding")
    err = F.coalesce(
        prior, F.col("_decl_error"),
        F.when(~encoding_supported(enc), F.concat(F.lit("unsupported encoding: "), enc)),
        F.when((enc == UTF8) & ~utf8_valid(c), F.lit("malformed UTF-8")))
    df = df.withColumn("error", err)
    df = df.withColumn("text", F.when(F.col("error").isNull(), recode(c, enc)))
    return df.drop("_head", "_decl_error", "_upto")
