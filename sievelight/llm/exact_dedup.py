"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.llm.common import SPACE, materialize, small

#: White-space runs that are not already a single space; a lone space needs no replacement.
_RUNS = rf"[\x09-\x0D]{SPACE}*|\x20{SPACE}+"


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space replaced by one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def content_hash(norm: Column) -> Column:
    """128 bits of a normalised text, as 16 bytes."""
    return F.unhex(F.md5(norm))


#: Rows of one hash from which on the hash is joined by broadcast; others spread evenly when they are shuffled.
HOT_ROWS = 10_000


def _by_hash(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to groups(h, group_size, ...) of the shared hashes without dealing a hot hash to one task.

    All groups are broadcast if their measured size is small. Else only the hot ones are, of which there is at most
    one in HOT_ROWS rows, and the rows of the other hashes are shuffled.
    """
    side = small(groups)
    if side is not groups:
        return rows.join(side, "h", how)
    hot = materialize(groups.filter(F.col("group_size") >= HOT_ROWS), "exact-hot")
    rest = rows.join(small(hot.select("h")), "h", "left_anti").join(groups.filter(F.col("group_size") < HOT_ROWS), "h", how)
    return rest.unionByName(rows.join(small(hot), "h"))


def _grouped(docs: DataFrame, hashed) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha (binary); see assign_groups."""
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    ids = materialize(base.select("doc_id", hashed(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-ids")
    groups = ids.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.filter("group_size > 1"), "exact-groups")
    shared = materialize(_by_hash(ids.select("doc_id", "h"), groups).select("doc_id", "h", "keep_id", "group_size").distinct(), "exact-shared")

    # Texts are fetched by doc_id, which has no hot key; rows without an id are fetched by their hash.
    by_id = base.join(small(shared), "doc_id").filter(hashed(F.col("norm")) == F.col("h"))
    no_id = _by_hash(base.filter("doc_id is null").withColumn("h", hashed(F.col("norm"))), groups)
    members = by_id.select("doc_id", "h", "keep_id", "group_size", "norm").unionByName(no_id.select("doc_id", "h", "keep_id", "group_size", "norm"))
    # Repeated rows can carry keep_id more than once; one text per hash is enough to compare with.
    reps = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(F.max("group_size").alias("group_size"), F.min("norm").alias("rep"))
    collided = materialize(
        _by_hash(members.drop("group_size"), materialize(reps, "exact-reps")).filter(F.col("norm") != F.col("rep")).select("doc_id", "h", "norm", F.unhex(F.sha2("norm", 256)).alias("sha")),
        "exact-collided",
    )
    # A hash that no other row has is its own group.
    own = [F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")]
    plain = _by_hash(ids, groups, "left").select("h", "doc_id", "sha", *own)
    if not collided.isEmpty():
        # Practically never: documents that share 128 bits but not their bytes are grouped by their bytes.
        by_text = collided.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = collided.join(by_text, ["h", "norm"]).select("h", "doc_id", "sha", "keep_id", "group_size")
        gone = apart.groupBy("h").agg(F.count(F.lit(1)).alias("gone"))
        odd = collided.select("h", "sha").distinct()
        stay = plain.join(odd, ["h", "sha"], "left_anti").join(gone, "h", "left")
        plain = stay.withColumn("group_size", F.col("group_size") - F.coalesce("gone", F.lit(0))).select(*apart.columns).unionByName(apart)
    return plain.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")


def assign_groups(docs: DataFrame, *, hashed=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Only ids and hashes are shuffled for the grouping, with counts and minima combined before the shuffle.
    Texts move only for documents whose hash another document shares: each is compared with the text of the
    smallest id of its hash, and documents whose bytes differ (hash collisions) are grouped by the text itself.
    The lists of such documents and of shared hashes are broadcast if their measured size is small, and joined by
    shuffle otherwise, apart from hot hashes, which are always broadcast: a text that a third of all rows share is
    never dealt to one task. Very long texts are compared whole.

    Null text counts as empty, and all empty texts are equal. Rows that repeat a doc_id are documents of their
    own: each counts in group_size and is returned; of rows that tie on the smallest id, all are kept. A group
    whose ids are all null has a null keep_id and is kept. An empty table gives no rows. Other columns of docs
    are ignored, whatever their names.
    """
    return _grouped(docs, hashed).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat the kept id and text, one stays.

    Nulls, empty and very long texts, ties and empty tables are treated as in assign_groups; extra columns of any
    name are kept.
    Dropped documents leave by an anti-join on (id, text digest), so texts that stay are not shuffled where the
    list of dropped ones is small.
    """
    cols = docs.columns
    groups = materialize(_grouped(docs, content_hash), "exact-groups")
    ties = groups.filter("kept").groupBy("doc_id", "sha").count().filter("count > 1").drop("count")
    leave = materialize(groups.filter("not kept").select("doc_id", "sha").unionByName(ties).distinct(), "exact-leave")
    again = materialize(ties, "exact-ties")
    # Whole rows travel in one struct, so that columns of any name are safe.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("doc_id").alias("id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))

    def on(side: DataFrame):
        return rows["id"].eqNullSafe(side["doc_id"]) & (rows["digest"] == side["sha"])

    listed = small(leave)
    out = rows.join(listed, on(listed), "left_anti").select("row.*")
    if not again.isEmpty():
        order = Window.partitionBy("id", "digest").orderBy("digest")
        one = rows.join(again, on(again), "left_semi").withColumn("n", F.row_number().over(order)).filter("n = 1")
        out = out.unionByName(one.select("row.*"))
    return out
