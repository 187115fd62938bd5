import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge as m

SCHEMA = "g string, k int, v int, updated_at timestamp"
HOWS = ["left", "full"]


def ts(day):
    return None if day is None else F.lit(f"2024-01-{day:02d}").cast("timestamp")


def frame(spark, values):
    df = spark.createDataFrame([(g, k, v, None if d is None else f"2024-01-{d:02d}") for g, k, v, d in values], "g string, k int, v int, d string")
    return df.select("g", "k", "v", F.col("d").cast("timestamp").alias("updated_at"))


@pytest.mark.parametrize("how", HOWS)
def test_null_keys_never_match(spark, rows, how):
    target = frame(spark, [("a", None, 1, 1), (None, 1, 2, 1), ("a", 1, 3, 1)])
    source = frame(spark, [("a", None, 10, 2), (None, 1, 20, 2), (None, 1, 20, 2), ("a", 1, 30, 2)])
    merged = m.upsert(target, source, ["g", "k"], how=how)
    assert rows(merged, "g", "k", "v") == [(None, 1, 2), (None, 1, 20), (None, 1, 20), ("a", None, 1), ("a", None, 10), ("a", 1, 30)]


@pytest.mark.parametrize("how", HOWS)
def test_two_source_rows_for_one_target_row_are_an_error(spark, how):
    target, source = frame(spark, [("a", 1, 1, 1)]), frame(spark, [("a", 1, 2, 2), ("a", 1, 3, 2)])
    with pytest.raises(Exception, match="several source rows match"):
        m.upsert(target, source, ["g", "k"], how=how).collect()


@pytest.mark.parametrize("how", HOWS)
def test_repeated_source_rows_without_a_match_are_all_inserted(spark, how):
    target, source = frame(spark, [("a", 1, 1, 1)]), frame(spark, [("a", 2, 2, 2), ("a", 2, 3, 2)])
    assert m.upsert(target, source, ["g", "k"], how=how).count() == 3


@pytest.mark.parametrize("how", HOWS)
def test_only_newer_rows_update(spark, rows, how):
    target = frame(spark, [("a", 1, 1, 5), ("a", 2, 2, 5), ("a", 3, 3, None), ("a", 4, 4, 5)])
    source = frame(spark, [("a", 1, 10, 6), ("a", 2, 20, 5), ("a", 3, 30, 6), ("a", 5, 50, 1)])
    merged = m.upsert_newer(target, source, ["g", "k"], how=how, with_action=True)
    assert rows(merged, "k", "v", "action") == [
        (1, 10, "update"), (2, 2, "keep"), (3, 3, "keep"), (4, 4, "keep"), (5, 50, "insert")]


def test_audit_columns(spark, rows):
    target = spark.createDataFrame([("a", 1, "ann", "ann")], "k string, v int, created_by string, updated_by string")
    source = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    audit = m.Audit(F.current_timestamp(), F.lit("bob"), {"created_by": "user"}, {"updated_by": "user"})
    assert rows(m.upsert(target, source, ["k"], audit=audit)) == [("a", 2, "ann", "bob"), ("b", 3, "bob", "bob")]


def test_defaults_of_inserted_rows(spark, rows):
    target = spark.createDataFrame([("a", True)], "k string, disabled boolean")
    source = spark.createDataFrame([("b",)], "k string")
    assert rows(m.upsert(target, source, ["k"], defaults={"disabled": F.lit(False)})) == [("a", True), ("b", False)]


def test_scope_of_deletion(spark, rows):
    target = frame(spark, [("a", 1, 1, 1), ("a", 2, 1, 1), ("b", 1, 1, 1), ("a", None, 1, 1)])
    source = frame(spark, [("a", 1, 9, 2), ("c", 1, 9, 2)])
    assert rows(m.scoped_delete(target, source, ["g", "k"], ["g"]), "g", "k") == [("a", None), ("a", 1), ("b", 1)]
    for how in HOWS:
        touched = m.reconcile(target, source, ["g", "k"], ["g"], how=how)
        assert rows(touched, "g", "k") == [("a", None), ("a", 1), ("b", 1), ("c", 1)]
        everywhere = m.reconcile(target, source, ["g", "k"], "all", how=how)
        assert rows(everywhere, "g", "k") == [("a", None), ("a", 1), ("c", 1)]


def model(target, source, scope):
    """MERGE on (g, k) in plain Python; keys are unique on both sides, NULL keys match nothing."""
    whole = lambda r: r[0] is not None and r[1] is not None
    new = {r[:2]: r for r in source if whole(r)}
    old = {r[:2] for r in target if whole(r)}
    touched = {r[0] for r in source if r[0] is not None}
    out = []
    for r in target:
        if whole(r) and r[:2] in new:
            s = new[r[:2]]
            newer = r[3] is not None and s[3] is not None and r[3] < s[3]
            out.append((*(s if newer else r), "update" if newer else "keep"))
        else:
            gone = whole(r) and r[0] in touched and scope
            out.append((*r, "delete" if gone else "keep"))
    out += [(*s, "insert") for s in source if not whole(s) or s[:2] not in old]
    return sorted(map(str, out))


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("seed", range(4))
def test_random_merges(spark, how, seed):
    rng = random.Random(seed)

    def side(n):
        keys = {(rng.choice(["a", "b", "c", None]), rng.choice([*range(12), None])) for _ in range(n)}
        return [(*key, rng.randrange(100), rng.choice([None, *range(1, 9)])) for key in keys]

    target, source = side(30), side(20)
    scope = ["g"] if seed % 2 else None
    merged = m.merge(
        frame(spark, target), frame(spark, source), ["g", "k"], how=how, delete=scope, keep_deleted=True, with_action=True,
        when=lambda t, s: t("updated_at") < s("updated_at"),
    )
    found = [(r.g, r.k, r.v, r.updated_at and r.updated_at.day, r.action) for r in merged.collect()]
    assert sorted(map(str, found)) == model(target, source, scope)


def test_incremental_window_of_an_empty_target(spark):
    source = frame(spark, [("a", 1, 1, 1), ("a", 2, 1, 5)])
    window = lambda target: m.incremental_window(source, target, "updated_at", "updated_at").count()
    assert window(source.limit(0)) == 2
    assert window(source.filter("k = 2")) == 1
    assert window(source.withColumn("updated_at", F.lit(None).cast("timestamp"))) == 2


def test_keyed_insert_and_update(spark, rows):
    table = spark.createDataFrame([("a", 1, True), (None, 2, True)], "k string, v int, d boolean")
    grown = m.insert_rows(table, spark.createDataFrame([("b", 3)], "k string, v int"), {"d": F.lit(False)})
    changed = m.update_where(grown, F.col("k") == "a", {"v": F.col("v") + 10, "d": F.lit(False)})
    assert rows(changed) == [(None, 2, True), ("a", 11, False), ("b", 3, False)]


def test_ids_of_many_jobs(spark, rows):
    ids = spark.createDataFrame(
        [("r1", 1, "old", "ann", "ann")], "resource_id string, job_id long, job_name string, created_by string, updated_by string")
    assigned = spark.createDataFrame([("r1", "new", 7), ("r2", "x", 8)], "resource_id string, job_name string, job_id long")
    audit = m.Audit(F.current_timestamp(), F.lit("bob"), {"created_by": "user"}, {"updated_by": "user"})
    assert rows(m.upsert_ids(ids, assigned, audit)) == [("r1", 7, "new", "ann", "bob"), ("r2", 8, "x", "bob", "bob")]
