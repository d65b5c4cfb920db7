"""Fetched advisories and activity, over a transport that reads files."""

import json

from pyspark.sql import functions as F

from sparkhound.operators import changes
from sparkhound.sources import registry


def _files(folder):
    """A transport: answers are files named by the last part of the path or the package asked for; a file "fails-N" makes N attempts fail first."""

    def answer(method, url, body):
        from pathlib import Path

        key = json.loads(body)["package"]["name"] if body else url.rstrip("/").rsplit("/", 1)[-1]
        left = Path(folder) / f"fails-{key}"
        if left.exists() and (n := int(left.read_text())) > 0:
            left.write_text(str(n - 1))
            raise ConnectionError("no answer")
        return (Path(folder) / f"{key}.json").read_text()

    return answer


def test_advisories_with_retries_and_failures(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"vulns": [{"id": "X-1", "summary": "s", "database_specific": {"severity": "CRITICAL"}}, {"id": "X-2", "severity": "LOW"}]}))
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "fails-c").write_text("2")
    (tmp_path / "e.json").write_text("not json")
    deps = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("c", None), ("d", "3"), ("e", "4")], "name string, version string")
    got = registry.read_advisories(deps, F.lit("hex"), "http://x", _files(str(tmp_path)), wait=0.0, group=2).cache()
    assert sorted((r["name"], r["id"], r["severity"], r["failed"]) for r in got.collect() if r["id"]) == [("a", "X-1", "CRITICAL", False), ("a", "X-2", "LOW", False)]
    assert {r["name"] for r in got.where("failed").collect()} >= {"d"} and {r["name"] for r in got.where("failed").collect()} <= {"d", "e"}
    stale = spark.createDataFrame([], "name string, level string")
    levels = {r["name"]: r["level"] for r in changes.audit(deps.distinct(), got, stale).collect()}
    assert levels == {"a": "critical", "b": "clean", "c": "clean", "d": "clean", "e": "clean"}


def test_requests_carry_package_and_version(spark):
    deps = spark.createDataFrame([("a", "1"), ("b", None)], "name string, version string")
    rows = {r["name"]: json.loads(r["body"]) for r in registry.advisory_requests(deps, "http://x", F.lit("hex")).collect()}
    assert rows == {"a": {"package": {"name": "a", "ecosystem": "hex"}, "version": "1"}, "b": {"package": {"name": "b", "ecosystem": "hex"}}}


def test_activity_feeds_staleness(spark, tmp_path):
    (tmp_path / "lib.json").write_text(json.dumps({"pushed_at": "2024-01-05T10:00:00Z", "open_issues_count": 77}))
    (tmp_path / "pkg.json").write_text(json.dumps({"releases": [{"version": "1.0", "inserted_at": "2020-01-01T00:00:00Z"}, {"version": "1.1", "inserted_at": "2021-01-01T00:00:00Z"}], "retirements": {"1.0": {"reason": "security"}}}))
    deps = spark.createDataFrame([("lib", "https://host/owner/lib.git", None), ("gone", "owner/gone", None), ("none", None, None)], "name string, source string, version string")
    repos = registry.read_repositories(deps, "http://x", _files(str(tmp_path)), wait=0.0)
    assert sorted((r["name"], r["open_issues"], r["failed"]) for r in repos.collect()) == [("gone", None, True), ("lib", 77, False)]
    used = spark.createDataFrame([("pkg", "1.0"), ("pkg", "1.1"), ("pkg", None)], "name string, version string")
    packages = registry.read_packages(used, "http://x", _files(str(tmp_path)), wait=0.0)
    assert sorted(r["retired"] for r in packages.collect()) == [False, False, True]
    now = F.to_timestamp(F.lit("2024-02-05 00:00:00"))
    levels = {(r["name"], r["retired"]): r["level"] for r in changes.staleness(repos.unionByName(packages), now).collect()}
    assert levels[("pkg", True)] == "critical" and levels[("lib", False)] == "clean" and levels[("gone", False)] == "clean"
    assert registry.fetched(spark.createDataFrame([("x", "GET", None, None)], "name string, method string, url string, body string"), wait=0.0).first()["error"] == "no address"
