"""Random graphs and programs against plain closures."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkhound.operators import reach, taint
from sparkhound.schema import NODES

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
pairs = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25)


def closure(start, edges):
    seen, todo = set(start), list(start)
    while todo:
        a = todo.pop()
        for x, y in edges:
            if x == a and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


@few
@given(pairs)
def test_reachability_is_the_closure(spark, edges):
    df = spark.createDataFrame([(f"f{a}", f"f{b}", "x", 1) for a, b in edges], "caller string, callee string, file string, line int")
    found = reach.reachable(df, spark.createDataFrame([("f0",)], "name string"))
    assert {r["name"] for r in found.collect()} == {f"f{x}" for x in closure([0], edges)}


@few
@given(pairs, st.integers(0, 9))
def test_taint_is_the_closure_and_grows_with_seeds(spark, edges, more):
    def run(seeds):
        rows = [("a", k, k, "assign", f"v{b}", [("var", f"v{a}", "")], False, "s", {}) for k, (a, b) in enumerate(edges)]
        rows += [("a", 99 + s, 99 + s, "assign", f"v{s}", [("literal", "1", "")], True, "s", {}) for s in seeds]
        return {r["var"] for r in taint.analyse(spark.createDataFrame(rows, NODES)).collect()}

    one, two = run([0]), run([0, more])
    assert one == {f"v{x}" for x in closure([0], edges)} and one <= two == {f"v{x}" for x in closure([0, more], edges)}
