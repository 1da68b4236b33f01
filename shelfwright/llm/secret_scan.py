"""Secret scans with an incremental blob ledger (2), JVM expressions only.

Every version of every file is addressed by the SHA-256 of its content (its
blob).  The ledger holds one row per (blob, rule, rule version) that was ever
scanned, with the spans found.  A run scans only the pairs the ledger lacks:
new blobs by all rules, and known blobs by rules that are new or changed.
Findings are joined back to all paths that hold the blob.

Against a ledger, distinct digests are joined first; the digests of blobs that
lack a rule become a bitmap of bounded size, and only texts that it may hold
are grouped by blob.  Blobs are grouped before any text is scanned, so thousands
of copies of one file are scanned once.  The join back runs on written tables, where the
adaptive skew-join rule can split a blob that a third of all paths share.

Null texts count as empty; an empty text has a ledger row without spans.
Repeated rows get equal findings.  Extra columns are ignored.  A span is
(kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators._joins import maybe_among
from ._common import as_row, stage, text_or_empty

#: Bits of the bitmap of blobs to scan (8 MB), broadcast at every size.  With far
#: more blobs than bits it lets most texts through, and the join still decides.
BITMAP_BITS = 1 << 26

LEDGER_SCHEMA = ("blob string, rule string, version int, "
                 "spans array<struct<start:int,end:int>>")


class Rule(NamedTuple):
    """``group`` of a match must have ``least`` code points or more, else the
    match is dropped; matches are leftmost and don't overlap."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The patterns of the three kinds of secrets.
RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                      r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def find_spans(text: Column, rule: Rule) -> Column:
    """All spans of one rule in one text.

    The text's pieces between the matches come from ``split`` and the matches
    from ``regexp_extract_all``, both by the same pattern, so running lengths
    give the places.  A text without a match costs one regex search.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.zip_with(
        F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(whole)), F.length).alias("gap"),
                     F.transform(whole, F.length).alias("len")),
        F.transform(judged, F.length),
        lambda s, n: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), n.alias("judged")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    walked = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["len"]).alias("at"),
            F.when(s["judged"] >= rule.least, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["len"]).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")))
    return F.when(F.regexp_like(text, pattern), walked["spans"]).otherwise(none)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None,
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: every (blob, rule, version) of ``versions`` (``text``)
    that ``ledger`` lacks, with the spans found."""
    hashed = versions.select(blob_of(text_or_empty()).alias("blob"), text_or_empty().alias("text"))
    if ledger is None:
        todo = hashed.groupBy("blob").agg(F.first("text").alias("text"))
        wanted = [F.lit(True)] * len(rules)
    else:
        # digests alone tell which blobs lack a rule; only those blobs' texts are shuffled
        names = [f"{r.kind}:{r.version}" for r in rules]
        seen = (ledger.select("blob", F.concat_ws(":", "rule", F.col("version").cast("string")).alias("name"))
                .filter(F.col("name").isin(names)).groupBy("blob").agg(F.collect_set("name").alias("seen")))
        lacking = stage(hashed.select("blob").distinct().join(seen, "blob", "left").select(
            "blob", F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>"))).alias("lacks"))
            .filter("size(lacks) > 0"), "blobs-to-scan")
        todo = (maybe_among(hashed, lacking, ["blob"], BITMAP_BITS).groupBy("blob").agg(F.first("text").alias("text"))
                .join(lacking, "blob"))
        wanted = [F.array_contains("lacks", name) for name in names]
    found = F.array(*(F.when(w, F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                                         find_spans(F.col("text"), r).alias("spans")))
                      for r, w in zip(rules, wanted)))
    return (todo.select("blob", F.explode(found).alias("f")).filter("f IS NOT NULL")
            .select("blob", "f.rule", "f.version", "f.spans"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None,
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after ``versions``; a written table."""
    fresh = scan_unseen(versions, ledger, rules)
    return stage(fresh if ledger is None else ledger.unionByName(fresh), "blob-ledger")


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of blobs with findings by the current rules; spans are
    (start, end, rule number, kind), ordered by start, then rule.  A written
    table."""
    rank = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (f"{r.kind}:{r.version}", k)))
    key = F.concat_ws(":", "rule", F.col("version").cast("string"))
    found = ledger.withColumn("k", F.try_element_at(rank, key)).filter("k IS NOT NULL AND size(spans) > 0").select(
        "blob", F.expr("transform(spans, s -> struct(s.start AS start, s.end AS end, k AS k, rule AS kind))").alias("spans"))
    # a list per blob and rule: as many rows a blob as there are rules
    ordered = F.array_sort(F.flatten(F.collect_list("spans")), lambda a, b: F.when(
        a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["k"] - b["k"]))
    return stage(found.groupBy("blob").agg(ordered.alias("spans")), "blob-findings")


def findings(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id",
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, blob, spans) for every row of ``versions``, see
    :func:`blob_findings`."""
    at = stage(versions.select(F.col(id_col).alias(id_col), blob_of(text_or_empty()).alias("blob")), "blob-paths")
    none = F.array().cast("array<struct<start:int,end:int,k:int,kind:string>>")
    return at.join(blob_findings(ledger, rules), "blob", "left").select(
        id_col, "blob", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``found`` (:func:`blob_findings`) replaced by
    ``mark``; overlapping spans become one mark, all other rows pass unchanged.
    Findings are joined by content, so all copies change."""
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("spans", start, lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    joined = as_row(docs, blob=blob_of(text_or_empty())).join(found.select("blob", "spans"), "blob", "left")
    hit = F.col("spans").isNotNull()
    changed = joined.withColumn("new", F.when(hit, cut).otherwise(text))

    def column(c: str) -> Column:
        old = F.col(f"row.`{c}`")
        if c == "text":
            return F.col("new").alias(c)
        if c == "n_chars":
            return F.when(hit, F.length("new").cast("long")).otherwise(old).alias(c)
        return old.alias(c)

    return changed.select(*map(column, docs.columns))
