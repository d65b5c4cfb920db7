"""Lint rules over raw text: secrets, addresses, repeated lines, embedded scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

ASSIGNED = r'(?i)\b(password|passwd|token|secret|api_key|apikey)\s*=\s*"?([0-9A-Za-z_-]{8,})'


def words(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    return table.select(key, F.explode(F.split(text, r"[\x09-\x0D\x20]+")).alias("word"))


def secret_literals(table: DataFrame, key: str) -> DataFrame:
    """(key, word): words that begin like a credential and are long enough."""
    return words(table, key).where(P.secret_literal(F.col("word")))


def address_literals(table: DataFrame, key: str) -> DataFrame:
    return words(table, key).where(P.address_literal(F.col("word")))


def assigned_secrets(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, n): name = value places that look like credentials."""
    hit = table.where(F.col(text).rlike(ASSIGNED)).select(key, F.explode(F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(1))).alias("kind"))
    return hit.groupBy(key, F.lower("kind").alias("kind")).agg(F.count("*").alias("n"))


def repeated_lines(table: DataFrame, key: str, least: int = 3, length: int = 30) -> DataFrame:
    """(line_md5, n_docs): long lines that stand in several rows."""
    lines = table.select(key, F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line") >= length)
    return lines.groupBy(F.md5(F.col("line").cast("binary")).alias("line_md5")).agg(F.count_distinct(key).alias("n_docs")).where(F.col("n_docs") >= least)


def tag_use(pages: DataFrame, tag: str) -> DataFrame:
    return pages.select("page_id", F.regexp_count("html", F.lit(f"(?i)<{tag}[ >]")).cast("bigint").alias("n")).where("n > 0")


def links(pages: DataFrame) -> DataFrame:
    """(target, n): link targets."""
    urls = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target"))
    return urls.groupBy("target").agg(F.count("*").alias("n"))
