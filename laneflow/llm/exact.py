"""Exact duplicates by a 128-bit content hash, with the bytes compared inside every group.

One aggregate per hash gives the size of the group, the id that stays, and the
least and the greatest text.  Where these two are equal, all texts between them
are, so the bytes of a whole group are compared without bringing its members
together: copies fold on the map side, and a group of any size leaves each task
as one row.  Hashes whose texts differ are grouped once more by the text itself.

Everything is a DataFrame expression; no row passes through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from laneflow.llm.common import fresh, materialise

# Longest run of equal rows expanded from one row.
RUN = 10_000
KEEP = {"smallest": F.min, "largest": F.max}


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))




def exact_duplicates(
    df: DataFrame, id: str, text: str, keep: str = "smallest", derived: Mapping[str, Column] | None = None,
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``df``: ``id``, the ``derived`` columns, ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when all their bytes are; null counts as the empty text.  Of
    equal texts the row with the smallest (or largest) id stays.  Null ids come
    last in this choice; a group of null ids alone keeps a null one.  Of rows that
    repeat id and text, exactly one is kept.  ``derived`` maps names to
    expressions of the text.  An empty table gives no rows; further columns of
    ``df``, whatever their names, are neither read nor returned.
    """
    if keep not in KEEP:
        raise ValueError(f"keep is one of {sorted(KEEP)}")
    derived = dict(derived or {})
    if clash := {id.lower(), *map(str.lower, derived)} & {"keep_id", "group_size", "kept"}:
        raise ValueError(f"columns named as results: {sorted(clash)}")
    names = [id, *derived]
    hashed, body, copies, mixed, run = fresh(df.select(F.col(f"`{id}`"), *[F.lit(0).alias(c) for c in derived]), "__hash", "__text", "__copies", "__mixed", "__run")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = df.select(F.col(f"`{id}`"), *[c.alias(n) for n, c in derived.items()], digest(content).alias(hashed), content.alias(body))

    # Narrow from here on: the only shuffle of texts is the one of this aggregate, and only distinct ones of a task take part.
    chosen = KEEP[keep](F.col(f"`{id}`")).alias("keep_id")
    size = F.count(F.lit(1)).alias("group_size")
    groups = materialise(texts.groupBy(hashed).agg(size, chosen, (F.min(body) < F.max(body)).alias(mixed)), "exact-groups")
    rows = texts.groupBy(*[F.col(f"`{c}`") for c in names], hashed).agg(F.count(F.lit(1)).alias(copies))
    found = rows.join(groups.where(~F.col(mixed)).drop(mixed), hashed).drop(hashed)
    collided = groups.where(mixed).select(hashed)
    if not collided.isEmpty():
        apart = texts.join(collided, hashed, "left_semi")
        exact = apart.groupBy(hashed, body).agg(size, chosen)
        counted = apart.groupBy(*[F.col(f"`{c}`") for c in names], hashed, body).agg(F.count(F.lit(1)).alias(copies))
        found = found.unionByName(counted.join(exact, [hashed, body]).drop(hashed, body))

    # Two steps, so that no array is longer than the root of what one row stands for.
    quoted = [F.col(f"`{c}`") for c in names]
    runs = found.withColumn(run, F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / RUN))))
    last = F.least(F.col(copies) - 1, F.col(run) * RUN + RUN - 1)
    each = runs.withColumn(run, F.explode(F.sequence(F.col(run) * RUN, last)))
    kept = F.col(f"`{id}`").eqNullSafe(F.col("keep_id")) & (F.col(run) == 0)
    return each.select(*quoted, "keep_id", "group_size", kept.alias("kept"))


def drop_exact_duplicates(df: DataFrame, id: str, text: str, keep: str = "smallest") -> DataFrame:
    """All columns of the rows that stay: one for each text; see :func:`exact_duplicates`.

    Of rows that repeat id and text but differ elsewhere, one stays.
    """
    (hashed,) = fresh(df, "__hash")
    # SHA-256 beside the id tells the kept row from another text of the same id.
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    kept = exact_duplicates(df.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__body")), "__id", "__body", keep, {
        "__digest": F.sha2(F.coalesce(F.col("__body"), F.lit("")).cast("binary"), 256),
    }).where("kept").select("__id", "__digest")
    same = F.col(f"`{id}`").eqNullSafe(F.col("__id")) & (F.col(hashed) == F.col("__digest"))
    whole = df.withColumn(hashed, digest).join(kept, same, "left_semi")
    return whole.dropDuplicates([id, hashed]).select(*[F.col(f"`{c}`") for c in df.columns])
