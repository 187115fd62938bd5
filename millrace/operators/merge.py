"""Upserts, scoped deletes and snapshot reconciliation as joins.

Rules kept from MERGE: NULL keys never match, and two source rows for one target row
are an error. Results are DataFrames; the caller stages and swaps them.

Two join shapes give the same rows:

* ``how="left"``: the target is probed by the source and never shuffled when Spark
  finds the source small enough to broadcast; beyond that it is a sort-merge join
  whose target side AQE may split. For increments into large targets.
* ``how="full"``: one full outer join, each side shuffled once. For sources about as
  large as the target, such as snapshots. Keys that hold much of the target are joined
  apart, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.temporal import EPOCH
from millrace.sources.staging import stage

NULL_KEY_SPREAD = 1024
HEAVY = 64  # a key with more than one row in so many is heavy
Condition = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Audit:
    """Who and when: created_* is set on insert only, updated_* on insert and update."""

    as_of: Column
    user: Column
    created: Mapping[str, str] = field(
        default_factory=lambda: {"created_by": "user", "created_timestamp": "as_of"}
    )
    updated: Mapping[str, str] = field(
        default_factory=lambda: {"updated_by": "user", "updated_timestamp": "as_of"}
    )

    def value(self, kind: str) -> Column:
        return self.user if kind == "user" else self.as_of


def _t(name: str) -> Column:
    return F.col(f"_t_{name}")


def _s(name: str) -> Column:
    return F.col(f"_s_{name}")


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def _hashable(df: DataFrame) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [name for name, kind in kinds.items() if "map<" not in kind and "variant" not in kind]


def _spread(df: DataFrame, keys: Sequence[str]) -> Column:
    """Join column that is 0 for complete keys and scatters rows whose key holds a NULL.

    Such rows match nothing, but would all be sent to one task by their key alone.
    """
    scattered = F.pmod(F.xxhash64(*_hashable(df)), F.lit(NULL_KEY_SPREAD)).cast("int")
    return F.when(_any_null(keys), scattered).otherwise(F.lit(0))


def _prefixed(df: DataFrame, prefix: str, keys: Sequence[str], columns: Sequence[str], complete: bool = False) -> DataFrame:
    spread = [] if complete else [_spread(df, keys).alias(f"{prefix}_spread")]
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns], *spread, F.lit(True).alias(f"{prefix}_here"))


def _on(left: str, right: str, joined: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{left}{k}") == F.col(f"{right}{k}") for k in joined])


def _complete(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


def _repeated(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complete keys that several source rows have; rows are counted before they are shuffled."""
    counts = source.filter(_complete(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter("_n > 1").select(*keys)


def _heavy(target: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that make up more than a HEAVY-th of the target, by a sketch of bounded size."""
    hashes = target.filter(_complete(keys)).select(F.xxhash64(*keys).alias("h"))
    row = hashes.agg(F.count("h").alias("n"), F.expr(f"approx_top_k(h, {HEAVY}, {HEAVY * 32})").alias("top")).first()
    return [top["item"] for top in row["top"] or () if top["count"] * HEAVY > row["n"]]


def _full(target: DataFrame, source: DataFrame, keys: Sequence[str], joined: Sequence[str], heavy: list[int]) -> DataFrame:
    """Full outer join, each side shuffled once.

    Rows of heavy target keys are left out of the shuffle: the few source rows that may
    match them, no more than there are heavy keys, are joined to them where they are.
    """
    def is_heavy(side: str) -> Column:
        return F.coalesce(F.xxhash64(*[F.col(f"{side}{k}") for k in keys]).isin(heavy), F.lit(False))

    if not heavy:
        return target.join(source, _on("_t_", "_s_", joined), "full_outer")
    few, many = stage(source.filter(is_heavy("_s_")), "heavy"), target.filter(is_heavy("_t_"))
    rest = target.filter(~is_heavy("_t_")).join(source.filter(~is_heavy("_s_")), _on("_t_", "_s_", joined), "full_outer")
    return rest.unionByName(_left(many, few, keys, joined))


def _left(target: DataFrame, source: DataFrame, keys: Sequence[str], joined: Sequence[str]) -> DataFrame:
    """Target left join source, then the source rows whose key the target lacks.

    The second pass over the target reads its key columns alone.
    """
    same_keys = reduce(and_, [F.col(f"_t_{k}") == F.col(f"_m_{k}") for k in keys])
    named = [f"_m_{k}" for k in joined]
    wanted = source.select(*[F.col(c.replace("_m_", "_s_", 1)).alias(c) for c in named])
    matched = target.select(*[f"_t_{k}" for k in keys]).join(wanted, same_keys).select(*named).distinct()
    known = target.join(source, _on("_t_", "_s_", joined), "left_outer")
    added = source.join(matched, _on("_s_", "_m_", joined), "left_anti")
    return known.unionByName(added, allowMissingColumns=True)


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    update: Sequence[str] | None = None,
    when: Condition | None = None,
    audit: Audit | None = None,
    defaults: Mapping[str, Column] | None = None,
    delete: str | Sequence[str] | None = None,
    keep_deleted: bool = False,
    with_action: bool = False,
    how: str = "left",
    staged: bool = False,
    complete: bool = False,
    unique: bool = False,
) -> DataFrame:
    """Merge source into target on keys.

    update   columns a match takes from the source; all shared non-key columns if None.
    when     (t, s) -> Column: a match is updated only where this is true (NULL is not).
    audit    stamps of created_* and updated_* columns.
    defaults values of columns an inserted row does not bring.
    delete   None, "all", or the scope columns: target rows absent from the source go,
             everywhere or only in scopes the source touches.
    staged   the source is a staged table or a file already; otherwise it is staged here.
    complete no key of either side holds a NULL: sides are joined on the keys alone, so that
             a target bucketed by them is not shuffled.
    unique   no two source rows share a key: none are looked for.

    The source is read once to stage it and once to find keys that several of its rows
    have. It is an error if one of them is in the target; such rows, however many share a
    key, are inserted without being joined. So what is joined has one row a key.
    """
    if how not in ("left", "full"):
        raise ValueError(f"how must be 'left' or 'full', not {how!r}")
    if not staged:
        source = stage(source, "source")
    extra, repeated = None, None if unique else stage(_repeated(source, keys), "repeated")
    if repeated is not None and not repeated.isEmpty():
        if not target.select(*keys).join(repeated, list(keys), "left_semi").isEmpty():
            raise ValueError(f"several source rows match one target row on ({', '.join(keys)})")
        extra = source.join(repeated, list(keys), "left_semi").select(*source.columns)
    audit_columns = {**audit.created, **audit.updated} if audit else {}
    shared = [c for c in target.columns if c in source.columns]
    if update is None:
        update = [c for c in shared if c not in keys and c not in audit_columns]
    defaults = defaults or {}

    probe = _prefixed(target, "_t_", keys, target.columns, complete)
    scope = None if delete in (None, "all") else list(delete)
    if scope:
        touched = source.select(*[F.col(c).alias(f"_g_{c}") for c in scope]).distinct()
        probe = probe.join(
            touched.withColumn("_g__here", F.lit(True)),
            reduce(and_, [F.col(f"_t_{c}") == F.col(f"_g_{c}") for c in scope]),
            "left_outer",
        ).drop(*[f"_g_{c}" for c in scope])
    once = source if extra is None else source.join(repeated, list(keys), "left_anti").select(*source.columns)
    feed = _prefixed(once, "_s_", keys, source.columns, complete)
    on = [*keys] if complete else [*keys, "_spread"]
    joined = _full(probe, feed, keys, on, _heavy(target, keys)) if how == "full" else _left(probe, feed, keys, on)
    if extra is not None:
        joined = joined.unionByName(_prefixed(extra, "_s_", keys, source.columns, complete), allowMissingColumns=True)

    in_target, in_source = F.col("_t__here").isNotNull(), F.col("_s__here").isNotNull()
    applies = F.coalesce(when(_t, _s), F.lit(False)) if when else F.lit(True)
    named = _complete([f"_t_{k}" for k in keys])  # no deletion could name the others
    gone = (
        F.lit(False)
        if delete is None
        else named if delete == "all" else named & F.col("_g__here").isNotNull()
    )
    action = (
        F.when(~in_target, "insert")
        .when(in_source, F.when(applies, "update").otherwise("keep"))
        .when(gone, "delete")
        .otherwise("keep")
    )
    joined = joined.withColumn("_action", action)
    inserted, updated = F.col("_action") == "insert", F.col("_action") == "update"

    def result(name: str) -> Column:
        kind = target.schema[name].dataType
        brought = _s(name) if name in source.columns else defaults.get(name, F.lit(None))
        changed = _s(name) if name in update else _t(name)
        if audit and name in audit_columns:
            stamp = audit.value(audit_columns[name])
            brought = stamp
            changed = stamp if name in audit.updated else _t(name)
        return (
            F.when(inserted, brought.cast(kind)).when(updated, changed.cast(kind)).otherwise(_t(name)).alias(name)
        )

    if delete is not None and not keep_deleted:
        joined = joined.filter(F.col("_action") != "delete")
    columns = [result(c) for c in target.columns]
    return joined.select(*columns, F.col("_action").alias("action")) if with_action else joined.select(*columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Update listed columns of known keys, insert the others."""
    return merge(target, source, keys, **options)


def upsert_newer(
    target: DataFrame, source: DataFrame, keys: Sequence[str], time: str = "updated_at", **options
) -> DataFrame:
    """Upsert that updates only where the source row is newer; a NULL time keeps the target row."""
    return merge(target, source, keys, when=lambda t, s: t(time) < s(time), **options)


def upsert_ids(ids: DataFrame, assigned: DataFrame, audit: Audit, **options) -> DataFrame:
    """Store (resource_id, job_name, job_id) of many jobs at once."""
    return merge(ids, assigned, ["resource_id"], update=["job_name", "job_id"], audit=audit, **options)


def reconcile(
    target: DataFrame, source: DataFrame, keys: Sequence[str], scope: Sequence[str] | str, how: str = "full", **options
) -> DataFrame:
    """Upsert, and delete what the source lacks: in the scopes it touches, or with scope="all" everywhere."""
    return merge(target, source, keys, delete=scope, how=how, **options)


def scoped_delete(target: DataFrame, source: DataFrame, keys: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Drop target rows absent from the source, only within scopes the source touches.

    Both sides joined to the target are distinct, so no row multiplies; rows whose key
    holds a NULL stay, as no deletion could name them.
    """
    touched = source.select(*[F.col(c).alias(f"_g_{c}") for c in scope]).distinct().withColumn("_g", F.lit(True))
    present = source.select(*[F.col(c).alias(f"_k_{c}") for c in keys]).distinct().withColumn("_k", F.lit(True))
    doomed = F.col("_g").isNotNull() & F.col("_k").isNull() & ~_any_null(keys)
    return (
        target.join(touched, reduce(and_, [F.col(c) == F.col(f"_g_{c}") for c in scope]), "left_outer")
        .join(present, reduce(and_, [F.col(c) == F.col(f"_k_{c}") for c in keys]), "left_outer")
        .filter(~doomed)
        .select(*[F.col(c) for c in target.columns])
    )


def incremental_window(
    source: DataFrame, target: DataFrame, source_time: str = "processed_at", target_time: str = "updated_at"
) -> DataFrame:
    """Source rows at or after the target's newest time, or all of them while it is empty.

    The bound is a scalar subquery: computed once, and pushed into the source scan.
    """
    kind = source.schema[source_time].dataType.simpleString()
    newest = F.max(target_time).cast(kind)
    bound = target.agg(F.coalesce(newest, F.lit(EPOCH).cast(kind)).alias("bound")).scalar()
    return source.filter(F.col(source_time) >= bound)


def action_counts(actions: DataFrame) -> DataFrame:
    """Rows per action of a merge that kept its actions."""
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def insert_rows(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Add rows; columns they lack take their default, or NULL."""
    missing = {c: e for c, e in (defaults or {}).items() if c not in rows.columns}
    added = rows.withColumns(missing) if missing else rows
    return table.unionByName(added, allowMissingColumns=True).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    )


def update_where(table: DataFrame, condition: Column, assignments: Mapping[str, Column]) -> DataFrame:
    """Set columns of the rows a condition selects; a NULL condition selects nothing."""
    return table.select(
        *[
            F.when(condition, assignments[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name in assignments
            else F.col(f.name)
            for f in table.schema.fields
        ]
    )
