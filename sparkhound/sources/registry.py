"""Advisories and activity of packages, fetched by the tasks that hold them (S-18, S-19).

Requests are rows; they are dealt into groups, one task each, and answered by a transport: a function of (method, url, body) that
returns the response's text or raises. A request that fails to the end gives a row that says so, and never ends the job.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .project import advisories

Transport = Callable[[str, str, str | None], str]
RESPONSES = "name string, body string, error string"
#: Seconds for one attempt, attempts, and requests that one task sends.
TIMEOUT, ATTEMPTS, GROUP = 10, 3, 500


def over_http(method: str, url: str, body: str | None) -> str:
    request = urllib.request.Request(url, body.encode() if body is not None else None, {"Content-Type": "application/json", "Accept": "application/json"}, method=method)
    with urllib.request.urlopen(request, timeout=TIMEOUT) as response:
        return response.read().decode("utf-8", "replace")


def fetched(requests: DataFrame, transport: Transport = over_http, attempts: int = ATTEMPTS, wait: float = 1.0, group: int = GROUP) -> DataFrame:
    """RESPONSES of requests(name, method, url, body), one row each: the body, or the last error where all ``attempts`` failed.

    ``wait`` seconds, then twice as many, pass between attempts. An empty response counts as an empty object; a request without a URL fails at once.
    """

    def answer(method: str, url: str | None, body: str | None) -> tuple[str | None, str | None]:
        if not url:
            return None, "no address"
        for k in range(attempts):
            try:
                return transport(method, url, body) or "{}", None
            except Exception as e:  # a transport may raise anything; it is this row's answer
                error = f"{type(e).__name__}: {e}"
                if k + 1 < attempts:
                    time.sleep(wait * 2**k)
        return None, error

    def run(batches):
        for b in batches:
            names, *rest = (b.column(k).to_pylist() for k in range(4))
            found = [answer(*r) for r in zip(*rest, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x for x, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["name", "body", "error"])

    asked = requests.select("name", "method", "url", "body")
    parts = max(1, -(-asked.count() // group))
    return asked.repartition(parts, F.xxhash64("name", "url", "body")).mapInArrow(run, RESPONSES)


def advisory_requests(deps: DataFrame, endpoint: str, ecosystem: Column) -> DataFrame:
    """Requests for deps(name, version): one query for each package and version; a dependency without version asks for all of them."""
    body = F.to_json(F.struct(F.struct("name", ecosystem.alias("ecosystem")).alias("package"), "version"))
    return deps.select("name", "version").distinct().select("name", F.lit("POST").alias("method"), F.lit(endpoint).alias("url"), body.alias("body"))


def read_advisories(deps: DataFrame, ecosystem: Column, endpoint: str = "https://api.osv.dev/v1/query", transport: Transport = over_http, **how) -> DataFrame:
    """(name, id, summary, severity, failed) of deps(name, version): advisories, and one row with ``failed`` for a query that got no answer."""
    return advisories(fetched(advisory_requests(deps, endpoint, ecosystem), transport, **how))


_REPOSITORY = "pushed_at string, open_issues_count int"
_PACKAGE = "releases array<struct<version:string,inserted_at:string>>, retirements map<string,struct<reason:string>>"
_ACTIVITY = ["name", "pushed_at", "last_release", "open_issues", "open_prs", "retired", "failed"]


def read_repositories(deps: DataFrame, base: str, transport: Transport = over_http, **how) -> DataFrame:
    """(name, pushed_at, last_release, open_issues, open_prs, retired, failed) of deps(name, source), source being owner/repository: for changes.staleness."""
    path = F.regexp_extract("source", r"([^/:]+/[^/]+?)(?:\.git)?/?$", 1)
    asked = deps.where("source LIKE '%/%'").select("name", "source").distinct()
    got = fetched(asked.select("name", F.lit("GET").alias("method"), F.concat(F.lit(f"{base}/repos/"), path).alias("url"), F.lit(None).cast("string").alias("body")), transport, **how)
    j = got.withColumn("j", F.from_json("body", _REPOSITORY))
    none = F.lit(None)
    return j.select("name", F.to_timestamp("j.pushed_at").alias("pushed_at"), none.cast("timestamp").alias("last_release"), F.col("j.open_issues_count").alias("open_issues"), none.cast("int").alias("open_prs"), F.lit(False).alias("retired"), F.col("body").isNull().alias("failed"))


def read_packages(deps: DataFrame, base: str, transport: Transport = over_http, **how) -> DataFrame:
    """The same of deps(name, version) from a package index: the newest release, and whether the version in use, or without one the newest, was retired."""
    asked = deps.select("name", "version").distinct()
    got = fetched(asked.select("name").distinct().select("name", F.lit("GET").alias("method"), F.concat(F.lit(f"{base}/packages/"), "name").alias("url"), F.lit(None).cast("string").alias("body")), transport, **how)
    j = got.withColumn("j", F.from_json("body", _PACKAGE)).join(asked, "name")
    newest = F.array_max(F.transform("j.releases", lambda r: F.struct(F.to_timestamp(r["inserted_at"]).alias("at"), r["version"].alias("version"))))
    retired = F.coalesce(F.array_contains(F.map_keys("j.retirements"), F.coalesce("version", newest["version"])), F.lit(False))
    none = F.lit(None)
    out = j.select("name", none.cast("timestamp").alias("pushed_at"), newest["at"].alias("last_release"), none.cast("int").alias("open_issues"), none.cast("int").alias("open_prs"), retired.alias("retired"), F.col("body").isNull().alias("failed"))
    return out.select(*_ACTIVITY)
