"""Snapshots, change sets, staleness and dependency levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_set(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "cksum") -> DataFrame:
    """(key, change): added, removed or modified between two snapshots; unchanged rows are left out."""
    b, a = before.select(F.col(key), F.col(digest).alias("_b"), F.lit(True).alias("_in_b")), after.select(F.col(key), F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def affected(changes: DataFrame, imports: DataFrame) -> DataFrame:
    """(file): changed files and the files that import them directly (G-30)."""
    changed = changes.select(F.col("path").alias("file"))
    return changed.union(imports.join(changed.withColumnRenamed("file", "imported_file"), "imported_file", "left_semi").select("file")).distinct()


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, hash) the extraction cache lacks (J-11)."""
    return files.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")


def months_between(now: Column, then: Column) -> Column:
    """Months of thirty days."""
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) / 2592000.0


def staleness(repos: DataFrame, now: Column) -> DataFrame:
    """Adds months, score and level from pushed_at, last_release, open_issues, open_prs and retired (A-12)."""
    m, r = months_between(now, F.col("pushed_at")), months_between(now, F.col("last_release"))
    score = (
        F.when(m > 12, 2).when(m > 6, 1).otherwise(0)
        + F.when(r > 12, 3).otherwise(0)
        + F.when(F.col("open_issues") > 50, 1).otherwise(0)
        + F.when(F.col("open_prs") > 10, 1).otherwise(0)
        + F.when(F.col("retired"), 5).otherwise(0)
    )
    out = repos.withColumns({"months": m, "score": score})
    return out.withColumn("level", F.when(F.col("score") >= 6, "critical").when(F.col("score") >= 3, "warning").otherwise("clean"))


def level_rank(level: Column) -> Column:
    return F.when(level == "critical", 2).when(level == "warning", 1).otherwise(0)


def advisory_level(severity: Column, failed: Column) -> Column:
    """Severities that begin like critical or high are critical, others warnings; a failed query counts as clean."""
    head = F.lower(F.substring(F.coalesce(severity, F.lit("")), 1, 4))
    return F.when(failed, "clean").when(head.isin("crit", "high"), "critical").otherwise("warning")


def audit(deps: DataFrame, advisories: DataFrame, stale: DataFrame) -> DataFrame:
    """(name, version, n_vulns, level): the worst of advisories and staleness for each dependency, worst first (A-11)."""
    v = advisories.groupBy("name").agg(F.max(level_rank(advisory_level(F.col("severity"), F.coalesce("failed", F.lit(False))))).alias("v"), F.count("*").alias("n"))
    s = stale.groupBy("name").agg(F.max(level_rank(F.col("level"))).alias("s"))
    worst = F.greatest(F.coalesce("v", F.lit(0)), F.coalesce("s", F.lit(0)))
    out = deps.join(v, "name", "left").join(s, "name", "left")
    return out.select("name", "version", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_vulns"), F.element_at(F.array(F.lit("clean"), F.lit("warning"), F.lit("critical")), worst + 1).alias("level"), worst.alias("rank")).orderBy(F.desc("rank"), "name").drop("rank")


def dependency_reachability(deps: DataFrame, imports: DataFrame, live_files: DataFrame) -> DataFrame:
    """(name, reachable): whether a file with live code imports the dependency, by its first path segment (J-12)."""
    sites = imports.select("file", F.substring_index("module", "/", 1).alias("name")).join(live_files, "file", "left_semi").select("name", F.lit(True).alias("hit")).distinct()
    return deps.select("name").join(sites, "name", "left").select("name", F.coalesce("hit", F.lit(False)).alias("reachable"))
