import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph as g

GROUP, KEY = ["resource_id"], "task_key"


def tasks(spark, *values):
    return spark.createDataFrame(list(values), "resource_id string, task_key string, depends_on string")


CASES = [
    ("diamond", "a", "[]"), ("diamond", "b", '["a"]'), ("diamond", "c", '["a"]'), ("diamond", "d", '["b", "c", "b"]'),
    ("none", "x", None), ("none", "y", '["x", "x"]'),
    ("cycle", "p", "[]"), ("cycle", "q", '["p", "s"]'), ("cycle", "r", '["q"]'), ("cycle", "s", '["r"]'), ("cycle", "t", '["s"]'),
    ("self", "m", '["m"]'), ("missing", "n", '["zz"]'), ("broken", "o", "[oops"),
]


def test_edges_are_distinct_and_broken_lists_have_none(spark, rows):
    edges = g.dependency_edges(tasks(spark, *CASES))
    found = rows(edges)
    assert ("diamond", "d", "b") in found and len(found) == len(set(found)) == 12
    assert not [e for e in found if e[0] == "broken"]


# Every graph fits into a batch, some do, or no two edges do.
SIZES = [g.BATCH, 4, 1]


@pytest.mark.parametrize("small", SIZES)
def test_levels_cycles_missing_self_roots(spark, rows, small):
    t = tasks(spark, *CASES)
    edges = g.dependency_edges(t)
    levels = g.topological_levels(t, edges, GROUP, KEY, small)
    assert rows(levels) == sorted(
        [("broken", "o", 0), ("cycle", "p", 0), ("cycle", "q", None), ("cycle", "r", None), ("cycle", "s", None),
         ("cycle", "t", None), ("diamond", "a", 0), ("diamond", "b", 1), ("diamond", "c", 1), ("diamond", "d", 2),
         ("missing", "n", 0), ("none", "x", 0), ("none", "y", 1), ("self", "m", None)],
        key=lambda r: [(v is not None, str(v)) for v in r])
    assert rows(g.cyclic_groups(levels, GROUP)) == [("cycle",), ("self",)]
    assert rows(g.missing_dependencies(t, edges, GROUP, KEY)) == [("missing", "n", "zz")]
    assert rows(g.self_dependencies(edges, KEY)) == [("self", "m", "m")]
    assert ("none", "x") in rows(g.root_tasks(t, edges, GROUP, KEY))


@pytest.mark.parametrize("small", [g.BATCH, 1])
def test_all_on_a_cycle_and_no_edges(spark, rows, small):
    loop = tasks(spark, ("j", "a", '["b"]'), ("j", "b", '["a"]'))
    assert rows(g.topological_levels(loop, g.dependency_edges(loop), GROUP, KEY, small)) == [("j", "a", None), ("j", "b", None)]
    free = tasks(spark, ("j", "a", "[]"), ("j", "b", None))
    assert rows(g.topological_levels(free, g.dependency_edges(free), GROUP, KEY, small)) == [("j", "a", 0), ("j", "b", 0)]


def test_cleaned_edges(spark, rows):
    t = tasks(spark, ("j", "a-b", "[]"), ("j", "@c", '["a-b"]'))
    assert rows(g.dependency_edges(t, clean=True)) == [("j", "task_c", "a_b")]


def python_levels(nodes, deps):
    level, todo = {}, set(nodes)
    while True:
        ready = [n for n in todo if all(d in level for d in deps[n])]
        if not ready:
            return {n: level.get(n) for n in nodes}
        for n in ready:
            level[n] = 1 + max((level[d] for d in deps[n]), default=-1)
        todo -= set(ready)


def test_a_deep_chain(spark):
    depth = 3000
    ids = spark.range(depth).select(F.lit(7).alias("resource_id"), F.col("id").alias("task_key"), (F.col("id") - 1).alias("dep_key"))
    levels = g.topological_levels(ids, ids.filter("dep_key >= 0"), GROUP, KEY)
    assert levels.filter(F.col("level") == F.col("task_key")).count() == levels.count() == depth


@pytest.mark.parametrize("small", SIZES)
@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed, small):
    rng = random.Random(seed)
    nodes = [(f"j{j}", f"t{i}") for j in range(4) for i in range(8)]
    deps = {}
    for job, task in nodes:
        i = int(task[1:])
        pool = [f"t{x}" for x in (range(8) if job == "j0" else range(i))]
        deps[job, task] = [(job, d) for d in rng.sample(pool, min(len(pool), rng.randrange(3)))]
    df = spark.createDataFrame([(j, t, [d for _, d in deps[j, t]]) for j, t in nodes], "resource_id string, task_key string, depends_on array<string>")
    levels = g.topological_levels(df, g.dependency_edges(df), GROUP, KEY, small)
    assert {(r.resource_id, r.task_key): r.level for r in levels.collect()} == python_levels(nodes, deps)


# What each run condition makes of two outcomes.
RUN = [
    (None, "SUCCESS", "SUCCESS", "RUN"), (None, "SUCCESS", "FAILED", "SKIP"), (None, "SUCCESS", None, "WAIT"),
    ("ALL_SUCCESS", "SUCCESS", "SKIPPED", "SKIP"), ("AT_LEAST_ONE_SUCCESS", "SUCCESS", "FAILED", "RUN"),
    ("AT_LEAST_ONE_SUCCESS", "FAILED", "FAILED", "SKIP"), ("NONE_FAILED", "SUCCESS", "SKIPPED", "RUN"),
    ("NONE_FAILED", "SUCCESS", "FAILED", "SKIP"), ("ALL_DONE", "FAILED", "SKIPPED", "RUN"), ("ALL_DONE", "FAILED", None, "WAIT"),
    ("AT_LEAST_ONE_FAILED", "SUCCESS", "FAILED", "RUN"), ("AT_LEAST_ONE_FAILED", "SUCCESS", "SKIPPED", "SKIP"),
    ("ALL_FAILED", "FAILED", "FAILED", "RUN"), ("ALL_FAILED", "FAILED", "SUCCESS", "SKIP"),
]


def test_run_conditions(spark):
    job = lambda i: f"j{i}"
    t = spark.createDataFrame(
        [(job(i), k, c if k == "c" else None, False) for i, (c, *_) in enumerate(RUN) for k in "abc"],
        "resource_id string, task_key string, run_if string, disabled boolean")
    edges = spark.createDataFrame([(job(i), "c", d) for i in range(len(RUN)) for d in "ab"], "resource_id string, task_key string, dep_key string")
    outcomes = spark.createDataFrame(
        [(job(i), k, o) for i, (_, a, b, _) in enumerate(RUN) for k, o in (("a", a), ("b", b)) if o],
        "resource_id string, task_key string, outcome string")
    got = {(r.resource_id, r.task_key): r.decision for r in g.run_decisions(t, edges, outcomes, GROUP, KEY).collect()}
    assert {i: got[job(i), "c"] for i in range(len(RUN))} == {i: case[3] for i, case in enumerate(RUN)}
    assert got[job(0), "a"] == "RUN"


def test_disabled_tasks_satisfy_their_dependants(spark, rows):
    t = spark.createDataFrame([("j", "a", None, True), ("j", "b", None, False)], "resource_id string, task_key string, run_if string, disabled boolean")
    edges = spark.createDataFrame([("j", "b", "a")], "resource_id string, task_key string, dep_key string")
    none = spark.createDataFrame([], "resource_id string, task_key string, outcome string")
    assert rows(g.run_decisions(t, edges, none, GROUP, KEY)) == [("j", "a", "DISABLED"), ("j", "b", "RUN")]


def chains(spark, groups, depth):
    ids = spark.range(groups * depth).selectExpr(f"id % {groups} AS resource_id", f"id div {groups} AS task_key")
    return ids, ids.filter("task_key > 0").withColumn("dep_key", F.col("task_key") - 1)


def stages_of(monkeypatch, run):
    """How many tables run() stages, and its result."""
    calls = []
    stage = g.stage
    monkeypatch.setattr(g, "stage", lambda *a: calls.append(a[1]) or stage(*a))
    result = run()
    monkeypatch.setattr(g, "stage", stage)
    return len(calls), result


def test_chains_over_many_batches_take_logarithmic_rounds(spark, monkeypatch):
    steps = {}
    for depth in (60, 960):
        nodes, edges = chains(spark, 3, depth)
        steps[depth], levels = stages_of(monkeypatch, lambda: g.topological_levels(nodes, edges, GROUP, KEY, 20))
        assert levels.filter(F.col("level") == F.col(KEY)).count() == levels.count() == 3 * depth
    # Sixteen times as long: four doublings more, where rounds by length would be hundreds.
    assert steps[960] - steps[60] <= 6 and steps[960] < 30


def test_ladders_become_chains(spark, monkeypatch):
    """Rungs of four tasks: two wait for the last of the rung before, one for both, one for that."""
    depth = 80
    rungs = [("j", f"{kind}{i}", [f"d{i - 1}"] if kind in "ab" and i else ["ab"[0] + str(i), f"b{i}"] if kind == "c" else [f"c{i}"] if kind == "d" else [])
             for i in range(depth) for kind in "abcd"]
    t = spark.createDataFrame(rungs, "resource_id string, task_key string, depends_on array<string>")
    steps, levels = stages_of(monkeypatch, lambda: g.topological_levels(t, g.dependency_edges(t), GROUP, KEY, 10))
    place = {"a": 0, "b": 0, "c": 1, "d": 2}
    assert {r.task_key: r.level for r in levels.collect()} == {k: 3 * int(k[1:]) + place[k[0]] for _, k, _ in rungs}
    assert steps < 60


def test_a_cycle_that_spans_batches(spark, rows):
    ring = [("j", i, (i - 1) % 50) for i in range(50)] + [("j", 50 + i, 49 + i) for i in range(30)]
    edges = spark.createDataFrame(ring, "resource_id string, task_key long, dep_key long")
    nodes = edges.select(*GROUP, KEY).union(spark.createDataFrame([("j", 99)], "resource_id string, task_key long"))
    levels = g.topological_levels(nodes, edges, GROUP, KEY, 7)
    assert rows(levels.filter("level IS NOT NULL")) == [("j", 99, 0)] and levels.count() == 81


def python_cycles(nodes, deps):
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for d in deps[todo.pop()]:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        reach[n] = seen
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("small", SIZES)
@pytest.mark.parametrize("seed", range(2))
def test_tasks_on_cycles_are_told_from_tasks_behind_them(spark, seed, small):
    rng = random.Random(seed)
    nodes = [(f"j{j}", f"t{i:02d}") for j in range(3) for i in range(14)]
    deps = {(j, t): [(j, f"t{d:02d}") for d in rng.sample(range(14), rng.choice([0, 1, 1, 2]))] for j, t in nodes}
    df = spark.createDataFrame([(j, t, [d for _, d in deps[j, t]]) for j, t in nodes], "resource_id string, task_key string, depends_on array<string>")
    found = g.cycle_members(df, g.dependency_edges(df), GROUP, KEY, small).collect()
    assert {(r.resource_id, r.task_key): (r.resource_id, r.cycle) for r in found} == python_cycles(nodes, deps)
    assert len(found) == len({(r.resource_id, r.task_key) for r in found})


def test_a_chain_is_followed_inside_its_batches(spark):
    _, edges = chains(spark, 2, 300)
    walked = g._walked(edges.withColumns({"base": F.lit(0), "step": F.lit(1)}), GROUP, KEY, 100).collect()
    assert len(walked) == 598 and all(r.single and r.level is None and r.dep_key + r.step == r.task_key for r in walked)
    # They lead out of batches, of which each of at most 8 tasks has one more than its edges fill.
    assert len({(r.resource_id, r.dep_key) for r in walked}) < 24


@pytest.mark.parametrize("small", [2, 7])
def test_chains_that_meet_and_cycles_longer_than_a_batch(spark, small):
    edges = [("a", i, i - 1) for i in range(1, 40)] + [("a", 100, 39), ("a", 100, 17), ("a", 101, 100)]
    edges += [("b", i, (i + 1) % 30) for i in range(30)] + [("b", 50 + i, 49 + i) for i in range(1, 20)] + [("b", 50, 3)]
    df = spark.createDataFrame(edges, "resource_id string, task_key long, dep_key long")
    nodes = {(g_, x) for g_, t, d in edges for x in (t, d)}
    deps = {n: [(g_, d) for g_, t, d in edges if (g_, t) == n] for n in nodes}
    t = spark.createDataFrame(sorted(nodes), "resource_id string, task_key long")
    levels = g.topological_levels(t, df, GROUP, KEY, small)
    assert {(r.resource_id, r.task_key): r.level for r in levels.collect()} == python_levels(nodes, deps)
