"""XML metadata: well-formedness (C1), element paths (C2), book metadata
(C3, C4) and the book acceptance rules (C5).

``from_xml`` in PERMISSIVE mode with a fixed schema replaces the streaming
tokenizer: a broken file yields ``_corrupt_record`` instead of an
exception, and the schema prunes everything but the seven paths read.
Elements match by local name (prefixes are ignored).  A leaf's value is the
last text directly under it: text inside child elements does not count.
Every repeatable leaf is an array so "last value wins" can be applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import col, evaluate_once
from ..functions.normalize import BLANKS, norm_title, person_key

_S = T.StringType()
# A leaf: ``_VALUE`` takes the last text chunk directly under the element, so
# markup inside a title never enters the title.
_A = T.ArrayType(T.StructType([T.StructField("_VALUE", _S)]))

AUTHOR_XML = T.StructType([
    T.StructField("first-name", _A),
    T.StructField("middle-name", _A),
    T.StructField("last-name", _A),
])

FB2_SCHEMA = T.StructType([
    T.StructField("description", T.StructType([
        T.StructField("title-info", T.StructType([
            T.StructField("genre", _A),
            T.StructField("author", T.ArrayType(AUTHOR_XML)),
            T.StructField("book-title", _A),
            T.StructField("lang", _A),
        ])),
        T.StructField("document-info", T.StructType([
            T.StructField("author", T.ArrayType(AUTHOR_XML)),
            T.StructField("id", _A),
            T.StructField("version", _A),
        ])),
    ])),
    T.StructField("_corrupt_record", _S),
])

CHECK_SCHEMA = T.StructType([T.StructField("_corrupt_record", _S)])

PERSON = T.StructType([
    T.StructField("id", _S),
    T.StructField("first_name", _S),
    T.StructField("middle_name", _S),
    T.StructField("last_name", _S),
])

XML_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
METADATA_OPTIONS = XML_OPTIONS | {"ignoreNamespace": "true"}

# Reject reasons.
R_MALFORMED = "malformed XML"
R_NO_DESCRIPTION = "no description element"
R_NO_TITLE = "book has no title"
R_EMPTY_TITLE = "title normalises to nothing"
ROOT = "FictionBook"

# No alternation stands under a star: java.util.regex recurses per turn of
# such a group, and a long prolog would overflow the executor's stack.  A
# DOCTYPE, where quotes hide brackets, is read token by token instead.
_DECL = r"^\x{FEFF}?<\?xml[\s\S]*?\?>"
_MISC = r"(<!\[CDATA\[[\s\S]*?\]\]>)|<!--[\s\S]*?-->|<\?[\s\S]*?\?>"
_DOCTYPE = "<!DOCTYPE"
_TOKEN = (r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!DOCTYPE|\"[^\"]*+\"|'[^']*+'|[\[\]<>\"']"
          r"|[^\[\]<>\"']++")
_ROOT_QNAME = r"^\s*+<([^\s>/!?]+)"
_END_DESCRIPTION = r"</(?:[^\s<>/:]+:)?description\s*+>"
_CDATA = "<![CDATA["


def strip_declaration(text) -> Column:
    """Drop the byte order mark and the XML declaration: the text is already
    decoded."""
    return F.regexp_replace(col(text), _DECL, "")


def _plain_cdata(text: Column) -> Column:
    """CDATA sections as escaped text, so that what looks like a tag in them
    is none; an unterminated one stays and fails the parse."""
    pieces = F.split(text, r"(?=<!\[CDATA\[)|(?<=\]\]>)")
    inner = lambda p: F.substring(p, len(_CDATA) + 1, F.length(p) - len(_CDATA) - 3)
    escaped = lambda p: F.replace(F.replace(F.replace(
        inner(p), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = F.transform(pieces, lambda p: F.when(
        F.startswith(p, F.lit(_CDATA)) & F.endswith(p, F.lit("]]>")), escaped(p)).otherwise(p))
    return F.when(F.contains(text, F.lit(_CDATA)), F.array_join(plain, "")).otherwise(text)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _after_doctype(text: Column) -> Column:
    """A text from its root element on, where a DOCTYPE stands before: a fold
    over tokens that knows where it is, before (0), in the DOCTYPE (1), in its
    bracketed subset (2), at the root (3) or lost (4).  Quoted strings, comments and
    processing instructions are tokens, so what they hold is never looked at.
    Nothing is left of a text whose DOCTYPE is broken."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    misc = lambda t: F.startswith(t, F.lit("<!--")) | F.startswith(t, F.lit("<?")) | t.rlike(r"^\s++$")

    def step(s: Column, t: Column) -> Column:
        state = (F.when(s["at"] == 0, F.when(t == _DOCTYPE, 1).when(misc(t), 0).otherwise(3))
                 .when(s["at"].isin(1, 2) & t.isin("'", '"'), 4)
                 .when(s["at"] == 1, F.when(t == "[", 2).when(t == ">", 0).when(t == "<", 4).otherwise(1))
                 .when(s["at"] == 2, F.when(t == "]", 1).otherwise(2)).otherwise(s["at"]))
        return _let(state, lambda at: F.struct(
            at.alias("at"), (s["chars"] + F.when(at == 3, 0).otherwise(F.length(t))).alias("chars")))

    end = F.aggregate(tokens, F.struct(F.lit(0).alias("at"), F.lit(0).alias("chars")), step)
    return _let(end, lambda e: F.when(e["at"] == 3, F.substring(text, e["chars"] + 1, F.length(text))).otherwise(F.lit("")))


def without_prolog(text) -> Column:
    """The document from its root element on: byte order mark, declaration,
    comments, processing instructions and DOCTYPE removed, CDATA as text."""
    marked = F.regexp_replace(col(text), r"^\x{FEFF}", "")
    rooted = F.when(F.contains(marked, F.lit(_DOCTYPE)), _after_doctype(marked)).otherwise(marked)
    return F.regexp_replace(_plain_cdata(F.regexp_replace(rooted, _MISC, "$1")), r"^\s++", "")


# ------------------------------------------------------------------ name scopes

# Prefixes of element and attribute names; declarations.  Tags are looked at
# with their values emptied, so a value never passes for a name.
_NAME = r"[^\s<>/!?:=\"']+"
_ELEMENT_PREFIX, _TAG_PREFIX = rf"<({_NAME}):", rf"^({_NAME}):"
_ATTRIBUTE_PREFIX = rf"\s({_NAME}):{_NAME}\s*="
_DECLARED = rf"\sxmlns:({_NAME})\s*="
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+')"
#: Bound everywhere.
_ALWAYS = ("xml", "xmlns")


def _found(text: Column, *patterns: str) -> Column:
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns)))


def _missing(used: Column, *bound: Column) -> Column:
    return F.array_except(used, F.concat(F.array(*map(F.lit, _ALWAYS)), *bound))


def _tag(piece: Column) -> Column:
    """What stands between ``<`` and ``>``, of the text after a ``<``."""
    return F.substring_index(F.regexp_replace(piece, _VALUE, '=""'), ">", 1)


def _scoped(bare: Column) -> Column:
    """Every prefix is bound where it stands: a fold over the tags with the
    declarations of the elements that are open.  What follows the root is
    ignored."""
    tags = F.transform(F.slice(F.split(bare, "<"), F.lit(2), F.size(F.split(bare, "<"))), _tag)

    def step(s: Column, tag: Column) -> Column:
        declared = _found(tag, _DECLARED)
        used = _found(tag, _TAG_PREFIX, _ATTRIBUTE_PREFIX)
        end, empty = F.startswith(tag, F.lit("/")), F.endswith(tag, F.lit("/"))
        rest = (F.when(end, F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0))))
                .when(empty, s["open"]).otherwise(F.concat(s["open"], F.array(declared))))
        fine = s["ok"] & (end | (F.size(_missing(used, F.flatten(s["open"]), declared)) == 0))
        now = _let(rest, lambda o: F.struct(o.alias("open"), fine.alias("ok"), (F.size(o) == 0).alias("over")))
        return F.when(s["over"], s).otherwise(now)

    start = F.struct(F.array().cast("array<array<string>>").alias("open"), F.lit(True).alias("ok"), F.lit(False).alias("over"))
    return F.aggregate(tags, start, step, lambda s: s["ok"])


def prefixes_bound(text) -> Column:
    """Every namespace prefix is declared where it is used.  Texts whose
    prefixes all stand in the root's declarations, nearly all there are, are
    done with two searches; only the others are read tag by tag."""
    text = col(text)
    used = _missing(_found(text, _ELEMENT_PREFIX, _ATTRIBUTE_PREFIX))
    root = lambda bare: _found(_tag(F.get(F.split(bare, "<", 3), F.lit(1))), _DECLARED)
    judged = lambda u: _let(without_prolog(text), lambda bare: (
        F.when(F.size(F.array_except(u, root(bare))) == 0, True).otherwise(_scoped(bare))))
    return _let(used, lambda u: F.when(F.size(u) == 0, True).otherwise(judged(u)))


def root_qname(bare) -> Column:
    """Qualified name of the root element of :func:`without_prolog` text
    ('' when none is found)."""
    return F.regexp_extract(col(bare), _ROOT_QNAME, 1)


def local_name(qname) -> Column:
    return F.regexp_replace(col(qname), r"^[^:]*:", "")


def check_wellformed(text) -> Column:
    """The whole text parses as XML up to the end of the root element.

    Text after the root is ignored and the root name is not checked, as in
    the validate command.  A prefix without a declaration in scope makes a
    text malformed.  Returns NULL-free boolean.
    """
    parsed = F.from_xml(strip_declaration(text), CHECK_SCHEMA, XML_OPTIONS)
    return F.coalesce(F.when(parsed["_corrupt_record"].isNull(), prefixes_bound(text)), F.lit(False))


def last_value(arr) -> Column:
    """Last trimmed, non-empty text of an array of leaves (NULL when none)."""
    vals = F.filter(F.transform(col(arr), lambda x: F.trim(x["_VALUE"], F.lit(BLANKS))),
                    lambda x: x != "")
    return F.try_element_at(vals, F.lit(-1))


def _persons(authors) -> Column:
    people = F.transform(F.coalesce(authors, F.array().cast(T.ArrayType(AUTHOR_XML))), lambda a: F.struct(
        person_key(last_value(a["last-name"]), last_value(a["first-name"]),
                   last_value(a["middle-name"])).alias("id"),
        last_value(a["first-name"]).alias("first_name"),
        last_value(a["middle-name"]).alias("middle_name"),
        last_value(a["last-name"]).alias("last_name"),
    ))
    return people


def description_text(bare) -> Column:
    """C3 early stop: keep :func:`without_prolog` text up to the first
    ``</description>`` and close the root, so a broken body never matters."""
    bare = col(bare)
    end = F.regexp_extract(bare, _END_DESCRIPTION, 0)
    cut = F.concat(F.get(F.split(bare, _END_DESCRIPTION, 2), 0), end, F.lit("</"), root_qname(bare), F.lit(">"))
    return F.when(end != "", cut).otherwise(bare)


def book_metadata(df: DataFrame, text: str = "text", path: str = "path",
                  author_scope: str = "all") -> DataFrame:
    """One row of metadata per decoded file.

    Adds ``title, norm_title, ext_id, version, lang, genre, filename,
    authors`` (array of person structs, usable authors only, document
    order) and ``reject_reason`` (NULL when the book is accepted).  An
    existing non-NULL ``error`` column (decode stage) takes precedence.
    ``author_scope="title_first"`` uses document-info authors only when
    title-info has none.
    """
    # stages of their own: both are read more than once below
    names = df.columns
    df = evaluate_once(df, "_bare", without_prolog(F.col(text)))
    t = F.col("_bare")
    df = evaluate_once(df, "_described", description_text(t))
    parsed = F.from_xml(F.col("_described"), FB2_SCHEMA, METADATA_OPTIONS)
    x = F.col("_x")
    d = x["description"]
    ti, di = d["title-info"], d["document-info"]
    title_people = _persons(ti["author"])
    doc_people = _persons(di["author"])
    if author_scope == "title_first":
        people = F.when(F.size(title_people) > 0, title_people).otherwise(doc_people)
    elif author_scope == "all":
        people = F.concat(title_people, doc_people)
    else:
        raise ValueError(f"unknown author_scope {author_scope!r}")
    authors = F.filter(people, lambda p: p["id"].isNotNull())
    title = last_value(ti["book-title"])
    ntitle = norm_title(title)
    has_description = (local_name(root_qname(t)) == ROOT) & d.isNotNull()
    base = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    reason = (F.when(t.isNull(), F.lit(None).cast("string"))
              .when(x["_corrupt_record"].isNotNull() | ~prefixes_bound(F.col("_described")), F.lit(R_MALFORMED))
              .when(~has_description, F.lit(R_NO_DESCRIPTION))
              .when(title.isNull(), F.lit(R_NO_TITLE))
              .when(ntitle.isNull(), F.lit(R_EMPTY_TITLE)))
    if "error" in df.columns:
        reason = F.coalesce(F.col("error"), reason)
    # evaluate_once: a filter on the reject reason (or any column derived
    # from the parse) then stays above the parse instead of being pushed down
    # with from_xml and the decode chain substituted at every reference.
    return (evaluate_once(df, "_x", parsed)
            .select(
                *[c for c in names if c not in (text, "error")],
                title.alias("title"),
                ntitle.alias("norm_title"),
                last_value(di["id"]).alias("ext_id"),
                last_value(di["version"]).alias("version"),
                last_value(ti["lang"]).alias("lang"),
                last_value(ti["genre"]).alias("genre"),
                F.regexp_replace(base, r"\.[^.]*$", "").alias("filename"),
                authors.cast(T.ArrayType(PERSON)).alias("authors"),
                reason.alias("reject_reason"),
            ))


def split_accepted(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted books, rejects) on the ``reject_reason`` column."""
    ok = meta.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = meta.filter(F.col("reject_reason").isNotNull())
    return ok, bad
