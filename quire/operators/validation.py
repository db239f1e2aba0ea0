"""Checks of containers: one row per container and check, with the figure that decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of a container's entries, total and single size in bytes, and compression ratio.
MOST_ENTRIES, MOST_TOTAL, MOST_ENTRY, MOST_RATIO = 2000, 512 << 20, 50 << 20, 100

CHECKS = ["entries", "names", "total size", "entry size", "ratio"]


def container_checks(entries: DataFrame, most_entries=MOST_ENTRIES, most_total=MOST_TOTAL, most_entry=MOST_ENTRY, most_ratio=MOST_RATIO) -> DataFrame:
    """entries (path, name, size, csize) to rows (path, check, passed, figure), all violations at once.

    A container that can't be opened, a row without a name, has no figures and passes no check.
    """
    bad = F.contains("name", F.lit("..")) | F.startswith("name", F.lit("/"))
    ratio = F.max(F.when(F.col("csize") > 0, F.col("size") / F.col("csize")))
    sums = entries.groupBy("path").agg(
        F.when(F.count("name") > 0, F.count("name")).alias("n"), F.when(F.count("name") > 0, F.count_if(bad)).alias("bad"), F.sum("size").alias("total"), F.max("size").alias("largest"), F.when(F.count("name") > 0, F.coalesce(ratio, F.lit(0.0))).alias("ratio")
    )
    figures = [("n", most_entries), ("bad", 0), ("total", most_total), ("largest", most_entry), ("ratio", most_ratio)]
    rows = F.array(*[
        F.struct(F.lit(name).alias("check"), F.coalesce(F.col(c) <= most, F.lit(False)).alias("passed"), F.col(c).cast("double").alias("figure"))
        for name, (c, most) in zip(CHECKS, figures, strict=True)
    ])
    return sums.select("path", F.explode(rows).alias("r")).select("path", "r.*")


def verdicts(checks: DataFrame) -> DataFrame:
    """(path, ok, failed): ok if all checks passed, else the names of those that didn't."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check"))))
    return checks.groupBy("path").agg(F.bool_and("passed").alias("ok"), F.array_join(failed, ",").alias("failed"))
