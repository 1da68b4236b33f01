"""By-author layout: author folder (H2), destination (H3), clash-free
names (H4) and the move plan (H5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import sanitize
from .aliases import principal_author
from .ranking import group_ordinal

# The two book suffixes, longer one tested first.
SUFFIXES = (".fb2.zip", ".fb2")


def book_suffix(path) -> F.Column:
    p = F.col(path) if isinstance(path, str) else path
    return (F.when(p.endswith(SUFFIXES[0]), F.lit(SUFFIXES[0]))
            .when(p.endswith(SUFFIXES[1]), F.lit(SUFFIXES[1])))


def destination(books: DataFrame, target: str, max_len: int = 0,
                authors: str = "authors", title: str = "title", path: str = "path") -> DataFrame:
    """H2 + H3: ``author_dir`` = sanitised principal author key,
    ``dest_name`` = sanitised raw title, ``suffix`` = original suffix and
    ``dest`` = ``target/author_dir/dest_name + suffix``."""
    author_dir = sanitize(principal_author(F.col(authors)), max_len)
    name = sanitize(F.col(title), max_len)
    return (books
            .withColumn("author_dir", author_dir)
            .withColumn("dest_name", name)
            .withColumn("suffix", book_suffix(path))
            .withColumn("dest", F.concat_ws("/", F.lit(target.rstrip("/")), F.col("author_dir"),
                                            F.concat(F.col("dest_name"), F.col("suffix")))))


_NUMBERED = r"^(.*)\(([1-9][0-9]{0,17})\)$"


def unique_destination(plan: DataFrame, target: str, path: str = "path") -> DataFrame:
    """H4: make ``dest_name`` unique per ``author_dir`` (extension ignored).

    Files sharing a name are ranked by ``path``; rank 0 keeps the name, rank
    r takes ``name(k)`` with k the r-th number not used by a literal title
    ``name(k)`` of the same author.  With the used numbers t_1 < ... < t_m
    and g_i = t_i - i (free numbers below t_i), the r-th free number is
    r + #{i : g_i < r}; putting the ranks and the g_i in one order, that is
    1 + the position of rank r among them.  All three positions come from
    :func:`group_ordinal`, so a name shared by a third of all files is still
    spread over many tasks.  Adds ``unique_name`` and ``dest_unique``.
    """
    g = ["author_dir", "dest_name"]
    ranked = group_ordinal(plan.select(*g, path), g, [path], out="rank")

    used = (ranked.select("author_dir",
                        F.regexp_extract("dest_name", _NUMBERED, 1).alias("base"),
                        F.regexp_extract("dest_name", _NUMBERED, 2).alias("k_txt"))
            .filter(F.col("k_txt") != "")
            .select("author_dir", "base", F.col("k_txt").cast("bigint").alias("k"))
            .distinct())
    if used.limit(1).count() == 0:
        # no literal "name(k)" anywhere: the r-th free number is r itself
        return _finish(plan, ranked, None, target, path)
    used = group_ordinal(used, ["author_dir", "base"], ["k"], out="i0")
    events = used.select("author_dir", "base", (F.col("k") - F.col("i0") - 1).alias("value"),
                         F.lit(1).alias("kind"), F.col("k").alias("tb"))
    asks = ranked.filter(F.col("rank") > 0).select(
        "author_dir", F.col("dest_name").alias("base"), F.col("rank").alias("value"),
        F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("tb"))
    merged = group_ordinal(asks.unionByName(events), ["author_dir", "base"], ["value", "kind", "tb"],
                           out="pos")
    numbers = merged.filter(F.col("kind") == 0).select(
        "author_dir", F.col("base").alias("dest_name"), F.col("value").alias("rank"),
        (F.col("pos") + 1).alias("number"))
    return _finish(plan, ranked, numbers, target, path)


def _finish(plan: DataFrame, ranked: DataFrame, numbers: DataFrame | None, target: str,
            path: str) -> DataFrame:
    if numbers is None:
        ranked = ranked.withColumn("number", F.col("rank"))
    else:
        ranked = ranked.join(numbers, ["author_dir", "dest_name", "rank"], "left")
    unique = F.when(F.col("rank") == 0, F.col("dest_name")).otherwise(
        F.concat(F.col("dest_name"), F.lit("("), F.col("number").cast("string"), F.lit(")")))
    ranked = ranked.select(path, "rank", unique.alias("unique_name"))
    out = plan.join(ranked, path)
    return out.withColumn("dest_unique", F.concat_ws(
        "/", F.lit(target.rstrip("/")), F.col("author_dir"),
        F.concat(F.col("unique_name"), F.col("suffix"))))


def _place(path: F.Column) -> F.Column:
    """A path without the ``file:`` scheme that a scan puts in front."""
    return F.regexp_replace(path, r"^file:(//)?(?=/)", "")


def move_plan(plan: DataFrame, path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """H5: ``(source, destination, action)`` and the ``keep`` columns;
    ``keep`` when already in place."""
    stays = _place(F.col(path)) == _place(F.col("dest_unique"))
    return plan.select(
        *keep, F.col(path).alias("source"), F.col("dest_unique").alias("destination"),
        F.when(stays, F.lit("keep")).otherwise(F.lit("move")).alias("action"))
