"""Exact dedup through a minimal perfect hash over historical digests (6).

The index maps every distinct SHA-256 digest of the history to a slot of its
own, without gaps: keys fall into buckets of a bounded size, each bucket is
hashed-and-displaced by one task, and a slot holds the full digest and the
locator of the row that stays.  A lookup computes the slot with two equi-joins
and compares all the digest's bytes, so a text outside the history (which
lands on someone's slot) is never taken for a member; non-members are grouped
among themselves.

Null and empty texts are one text.  Equal texts may differ in every other
column.  Rows that repeat both doc_id and text get equal verdicts, see
:func:`drop_copies`.  Extra columns of any name are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_row, ship_by_value, stage, text_or_empty

ship_by_value(__name__)

#: Keys of one bucket on average, and keys of one displacement group.
BUCKET_KEYS, GROUP_KEYS = 16384, 4
GROUPS = BUCKET_KEYS // GROUP_KEYS
#: Displaced keys are taken modulo a prime first: modulo the slots alone, a
#: step that shares a factor with their number would reach few of them.
PRIME = 2 ** 31 - 1

_SLOT_SCHEMA = ("bucket long, grp long, slot long, m long, salt long, d long, "
                "digest string, winner long, n long")


class DigestIndex(NamedTuple):
    """``displacements``: (bucket, grp, d, m, salt); ``slots``: (bucket,
    slot, slot_digest, winner, n).  ``buckets`` is the number of buckets."""

    displacements: DataFrame
    slots: DataFrame
    buckets: int


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _bits(digest: Column, start: int, width: int) -> Column:
    return F.conv(F.substring(digest, start, width), 16, 10).cast("long")


def _place(a: np.ndarray, b: np.ndarray, c: np.ndarray, grp: np.ndarray, salt: int):
    """Displacements and slots of one bucket's keys; None if a group finds no
    free slots with this salt."""
    m = len(a)
    base = a + salt * c
    order = np.argsort(grp, kind="stable")
    ids, starts = np.unique(grp[order], return_index=True)
    ends = np.append(starts[1:], m)
    free = np.ones(m, bool)
    slot, disp = np.empty(m, np.int64), np.zeros(m, np.int64)
    singles = []
    for g in np.argsort(starts - ends, kind="stable"):
        keys = order[starts[g]:ends[g]]
        if len(keys) == 1:
            singles.append(keys[0])
            continue
        for block in range(0, 64 * m, 64):
            tries = (base[keys] + np.arange(block, block + 64)[:, None] * b[keys]) % PRIME % m
            good = free[tries].all(axis=1)
            for t in np.flatnonzero(good):
                if len(set(tries[t].tolist())) == len(keys):
                    slot[keys], disp[keys] = tries[t], block + t
                    free[tries[t]] = False
                    break
            else:
                continue
            break
        else:
            return None
    if singles:  # a group of one key names its slot: -1 - slot
        slot[singles] = np.flatnonzero(free)
        disp[singles] = -1 - slot[singles]
    return disp, slot


def _hash_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("digest", ignore_index=True)
    a, b, c, grp = (pdf[k].to_numpy() for k in ("a", "b", "c", "grp"))
    salt, placed = 0, None
    while placed is None:
        placed = _place(a, b, c, grp, salt)
        salt += 1
    return pd.DataFrame({"bucket": pdf["bucket"], "grp": grp, "slot": placed[1], "m": len(pdf),
                         "salt": salt - 1, "d": placed[0], "digest": pdf["digest"],
                         "winner": pdf["winner"], "n": pdf["n"]})


def _address(keys: DataFrame, buckets: int) -> DataFrame:
    """Adds what a digest's place depends on: bucket, displacement group and
    the three numbers that slots are computed from."""
    x = F.col("digest")
    return (keys.withColumn("bucket", F.pmod(_bits(x, 1, 15), F.lit(buckets)))
            .withColumn("grp", F.pmod(_bits(x, 16, 15), F.lit(GROUPS)))
            .withColumn("a", _bits(x, 31, 7)).withColumn("b", _bits(x, 38, 7))
            .withColumn("c", _bits(x, 45, 7)))


def build_index(history: DataFrame) -> DigestIndex:
    """Index of ``history`` (digest, winner, n), one row per digest.  The
    result is a written table; buckets hold about BUCKET_KEYS keys however
    many there are."""
    buckets = max(1, -(-history.count() // BUCKET_KEYS))
    keyed = _address(history.select("digest", "winner", "n"), buckets)
    built = stage(keyed.groupBy("bucket").applyInPandas(_hash_bucket, _SLOT_SCHEMA), "mph-slots")
    displacements = built.groupBy("bucket", "grp").agg(
        F.first("d").alias("d"), F.first("m").alias("m"), F.first("salt").alias("salt"))
    slots = built.select("bucket", "slot", F.col("digest").alias("slot_digest"), "winner", "n")
    return DigestIndex(displacements, slots, buckets)


def lookup(probes: DataFrame, index: DigestIndex) -> DataFrame:
    """``probes`` (distinct digests and extra columns) with ``winner`` and
    ``n`` of the history, both null for digests that it lacks."""
    at = (_address(probes, index.buckets)
          .join(index.displacements, ["bucket", "grp"], "left")
          .withColumn("slot", F.when(F.col("d") < 0, -1 - F.col("d")).otherwise(
              F.pmod(F.pmod(F.col("a") + F.col("salt") * F.col("c") + F.col("d") * F.col("b"), F.lit(PRIME)), F.col("m")))))
    found = at.join(index.slots, ["bucket", "slot"], "left")
    member = F.col("slot_digest") == F.col("digest")
    return found.select(*probes.columns, F.when(member, F.col("winner")).alias("winner"),
                        F.when(member, F.col("n")).alias("n"))


def update_history(history: DataFrame, groups: DataFrame) -> DataFrame:
    """``history`` (digest, winner, n) after more rows, given as ``groups``
    (digest, own, own_n) with one row per digest.  Digests found in the index
    keep the larger locator and add their rows; the others are new groups.  A
    written table."""
    found = lookup(groups, build_index(history))
    met = found.select("digest", F.greatest("winner", "own").alias("winner"),
                       (F.col("own_n") + F.coalesce("n", F.lit(0))).alias("n"))
    # at most two rows a digest: the history's, and its update
    return stage(history.select("digest", "winner", "n").unionByName(met).groupBy("digest").agg(
        F.max("winner").alias("winner"), F.max("n").alias("n")), "digest-history")


def _groups(rows: DataFrame) -> DataFrame:
    return stage(rows.groupBy("digest").agg(F.max("doc_id").alias("own"), F.count("*").alias("own_n")), "digest-groups")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    ``history`` (digest, winner, n) holds the distinct digests seen so far; a
    row whose digest is in it is a copy of ``winner``.  Non-members' groups
    keep their largest doc_id.  Without a history one half of the rows (by
    hash of doc_id) becomes it, the other half is looked up in its index,
    and of equal texts in either half the largest doc_id stays.
    """
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                             digest_of(text_or_empty()).alias("digest")), "digests")
    if history is None:
        half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
        earlier = _groups(rows.filter(half == 0)).select("digest", F.col("own").alias("winner"), F.col("own_n").alias("n"))
        known = update_history(earlier, _groups(rows.filter(half == 1)))
        resolved = known.select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))
    else:
        found = lookup(_groups(rows), build_index(history))
        resolved = stage(found.select(
            "digest", F.when(F.col("n").isNull(), F.col("own")).otherwise(F.col("winner")).alias("keep_id"),
            (F.coalesce("n", F.lit(0)) + F.col("own_n")).alias("group_size")), "digest-winners")
    return rows.join(resolved, "digest", "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated texts: of equal texts the row with the
    largest doc_id stays, of rows that repeat doc_id and text one."""
    verdicts = stage(exact_dedup(docs), "copies")
    name = F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")
    gone = verdicts.filter(~F.col("kept")).select(*name).distinct()
    twice = verdicts.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").select(*name)
    rows = as_row(docs, doc_id=F.col("doc_id").cast("long"), digest=digest_of(text_or_empty()))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha"))
    once = rows.join(gone.unionByName(twice), same, "left_anti").select("row.*")
    if not twice.take(1):
        return once
    again = rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "digest"]).select("row.*")
    return once.unionByName(again)
