"""Storage classes of table locations.

Only locations under DBFS outside ``/mnt/`` need the list of mount points: they
are mounted if any mount point occurs anywhere in them. That test is an equi-join with
an index: each mount point stands under the one of its grams (its parts of a fixed length)
that is in the fewest mount points, and a shorter one under itself. A location is cut
into the grams at its positions, once for each length that the index has, and what the
index holds under them is compared in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatescope.functions.paths import (
    DBFS_MOUNT,
    DBFS_ROOT,
    class_by_prefix,
    needs_mount_list,
)
from estatescope.operators.kept import Kept, kept
from estatescope.operators.skew import inner_join_hot_apart, left_join_hot_apart

GRAM = 8


def mount_index(mounts: DataFrame) -> tuple[Kept, list[int]]:
    """(gram, points) of all mount points, and the lengths of the grams."""
    point = F.col("mountPoint")
    points = mounts.where(point.isNotNull()).select(point.alias("point")).distinct()
    last = F.greatest(F.length("point") - GRAM + 1, F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("point", i, F.lit(GRAM)))
    placed = points.select("point", F.explode(F.array_distinct(grams)).alias("gram"))
    counts = placed.groupBy("gram").agg(F.count("*").alias("points")).withColumn("held", F.col("points"))
    weighed = left_join_hot_apart(placed, counts, "gram", "held", "points")
    rarest = weighed.groupBy("point").agg(F.min(F.struct("held", "gram"))["gram"].alias("gram"))
    index = rarest.groupBy("gram").agg(F.collect_list("point").alias("points"))
    # One bit for each length, 0 to GRAM.
    lengths = F.bit_or(F.call_function("shiftleft", F.lit(1), F.length("gram")))
    index = kept(index, "mount-index", lengths=lengths)
    mask = index.metrics["lengths"] or 0
    return index, [n for n in range(GRAM + 1) if mask >> n & 1]


def _grams(text: Column, lengths: Sequence[int]) -> Column:
    """Parts of a text that have one of the lengths, each once; none of a null."""
    none = F.array().cast("array<string>")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
    parts = [
        F.transform(
            F.filter(starts, lambda i: i + (n - 1) <= F.length(text)), lambda i: F.substring(text, i, F.lit(n))
        )
        for n in lengths
        if n
    ]
    # The empty mount point occurs in every text, but not in a null.
    empty = [F.when(text.isNotNull(), F.array(F.lit("")))] if 0 in lengths else []
    return F.array_distinct(F.concat(none, *(F.coalesce(p, none) for p in [*parts, *empty])))


def _mounted(locations: DataFrame, mounts: DataFrame | None) -> DataFrame:
    """(location, n) rows of ``locations`` that contain a mount point."""
    if mounts is None or "mountPoint" not in mounts.columns:
        return locations.where(F.lit(False))
    index, lengths = mount_index(mounts)
    # A small table in few files, of which each row makes many: spread by what makes them differ.
    spread = int(locations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes = locations.repartition(spread, "location").select("location", "n", F.explode(_grams(F.col("location"), lengths)).alias("gram"))
    found = inner_join_hot_apart(probes, index, "gram")
    held = F.exists("points", lambda p: F.col("location").contains(p))
    return found.where(held).select("location", "n").distinct()


def storage_classes(tables: DataFrame, mounts: DataFrame | None) -> DataFrame:
    """``tables`` with their ``storage_type``.

    Only locations that depend on the mount points are looked up, each once; the
    tables are read for the count of those locations, when this is called, and for the join.
    """
    _require_location(tables)
    location = F.col("location")
    undecided = F.coalesce(needs_mount_list(location), F.lit(False))
    locations = tables.where(undecided).groupBy("location").agg(F.count("*").alias("n"))
    locations = kept(locations, "locations").rows
    mounted = _mounted(locations, mounts).select("location", F.lit(DBFS_MOUNT).alias("_mounted"))
    known = locations.join(mounted, "location", "left").withColumnRenamed("location", "_lookup")
    known = kept(known, "mounted-locations", total=F.sum("n"))
    joined = left_join_hot_apart(
        tables.withColumn("_lookup", F.when(undecided, location)),
        known,
        key="_lookup",
        value="_mounted",
        weight="n",
        total=known.metrics["total"] or 0,
    )
    by_mount = F.coalesce("_mounted", F.lit(DBFS_ROOT))
    storage_type = F.when(undecided, by_mount).otherwise(class_by_prefix(location))
    return joined.withColumn("storage_type", storage_type).drop("_lookup", "_mounted")


def counted_locations(tables: DataFrame) -> DataFrame:
    """(by_prefix, location, n): tables per class by prefix, and per location where the mount points decide."""
    _require_location(tables)
    location = F.col("location")
    undecided = needs_mount_list(location)
    return tables.groupBy(
        F.when(undecided, F.lit(DBFS_ROOT)).otherwise(class_by_prefix(location)).alias("by_prefix"),
        F.when(undecided, location).alias("location"),
    ).agg(F.count("*").alias("n"))


def storage_summary(tables: DataFrame, mounts: DataFrame | None) -> DataFrame:
    """Number of tables per storage class.

    Counted before anything is joined: one row per class, and per location only
    where the mount points decide. The counts are a written table, made when this is called.
    """
    counted = kept(counted_locations(tables), "counted-locations").rows
    mounted = _mounted(counted.where(F.col("location").isNotNull()), mounts)
    moved = mounted.select(
        F.explode(
            F.array(
                F.struct(F.lit(DBFS_MOUNT).alias("storage_type"), F.col("n")),
                F.struct(F.lit(DBFS_ROOT).alias("storage_type"), (-F.col("n")).alias("n")),
            )
        ).alias("m")
    ).select("m.*")
    return (
        counted.select(F.col("by_prefix").alias("storage_type"), "n")
        .unionByName(moved)
        .groupBy("storage_type")
        .agg(F.sum("n").alias("table_count"))
        .where(F.col("table_count") > 0)
    )


def _require_location(tables: DataFrame) -> None:
    if "location" not in tables.columns:
        raise ValueError("tables need a 'location' column")
