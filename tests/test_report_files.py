"""Reports written by tasks are the documents that the driver would have put together."""

import json
import random

import pytest

from sparkhound.plans import report_files, reports
from sparkhound.schema import FINDINGS


@pytest.fixture(autouse=True)
def several_files(spark):
    """Small reports would be one partition; here they are several, as large ones are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def read(folder):
    return "\n".join(p.read_text().rstrip("\n") for p in sorted(folder.glob("part-*")) if p.stat().st_size)


def rows(n, seed=4):
    rng, out = random.Random(seed), []
    for k in range(n):
        flow = [("a.cr", s, f"step {s}") for s in range(rng.randint(0, 3))]
        reach = rng.choice([None, ("Dormant", None, None, None, None), ("Live", "http", "index", 2, [("a.cr", 3), ("b.cr", 9)])])
        text = rng.choice(["plain", 'with "quotes" and \\ bars', "two\nlines", "\u00fcml\u00e4ut"])
        out.append((f"R{k % 7}", rng.choice(["Critical", "High", "Medium", "Low", "Info"]), f"src/{k % 13}.cr", rng.choice([None, 0, k // 3]), text, flow, "crystal", None, reach, rng.choice([None, "x = 1"])))
    return out + out[: n // 10]  # repeated findings stay repeated


def bare(x):
    """Without nulls, which the written reports leave out."""
    if isinstance(x, dict):
        return {k: bare(v) for k, v in x.items() if v is not None}
    return [bare(v) for v in x] if isinstance(x, list) else x


def ordered(items):
    return sorted(json.dumps(x, sort_keys=True) for x in items)


def test_json_and_sarif(spark, tmp_path):
    found = spark.createDataFrame(rows(300), FINDINGS).repartition(6)
    report_files.write_json(found, 13, str(tmp_path / "json"))
    assert len([p for p in (tmp_path / "json").glob("part-*") if p.stat().st_size]) > 1
    got, want = json.loads(read(tmp_path / "json")), bare(json.loads(reports.json_report(found, 13)))
    assert ordered(got.pop("findings")) == ordered(want["findings"]) and got == {k: v for k, v in want.items() if k != "findings"}
    lines = [json.loads(x.lstrip(",")) for x in read(tmp_path / "json").splitlines()[1:-1]]
    place = lambda r: (-["info", "low", "medium", "high", "critical"].index(r["severity"].lower()), r["file"], r.get("line", -1), r["rule"])
    assert [place(x) for x in lines] == sorted(map(place, lines))
    report_files.write_sarif(found, str(tmp_path / "sarif"))
    got, want = (json.loads(x)["runs"][0] for x in (read(tmp_path / "sarif"), reports.sarif(found)))
    assert ordered(bare(got["results"])) == ordered(bare(want["results"])) and ordered(got["tool"]["driver"]["rules"]) == ordered(want["tool"]["driver"]["rules"])


def test_markdown_and_terminal(spark, tmp_path):
    found = spark.createDataFrame(rows(100), FINDINGS).where("line IS NOT NULL")
    report_files.write_markdown(found, str(tmp_path / "md"))
    sections = lambda text: sorted("\n".join(x for x in s.splitlines() if x) for s in text.split("## "))
    assert sections(read(tmp_path / "md")) == sections(reports.markdown(found))
    n = found.count()
    text, code = reports.terminal(found, limit=5)
    assert code == 1 and text.splitlines()[-2:] == [f"{n - 5} more", f"{n} findings"] and text.startswith("[Critical]")


def test_no_findings(spark, tmp_path):
    none = spark.createDataFrame([], FINDINGS)
    report_files.write_json(none, 0, str(tmp_path / "json"))
    report_files.write_sarif(none, str(tmp_path / "sarif"))
    assert json.loads(read(tmp_path / "json"))["findings"] == [] and json.loads(read(tmp_path / "sarif"))["runs"][0]["results"] == []
    assert reports.terminal(none) == ("0 findings", 0)


def test_call_graph(spark, tmp_path):
    names = [f'f"{k}\\' for k in range(60)]
    edges = spark.createDataFrame([(a, b) for a in names[:20] for b in names[:5]] * 2, "caller string, callee string")
    classes = spark.createDataFrame(list(zip(names, ["Entry", "Sink", "Reachable", "Dormant"] * 15)), "name string, class string")
    report_files.write_dot(edges.repartition(4), classes, str(tmp_path / "dot"))
    assert read(tmp_path / "dot").splitlines() == reports.dot(edges, classes).splitlines()
