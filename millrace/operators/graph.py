"""Dependency graphs of all jobs at once: edges, checks, levels and run conditions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import StringType

from millrace.functions.json import dependency_list
from millrace.functions.text import clean_key
from millrace.sources.staging import stage

# Outcomes of a task.
SUCCESS, FAILED, SKIPPED, DISABLED = "SUCCESS", "FAILED", "SKIPPED", "DISABLED"

# Edges that a task holds at once while it orders graphs.
BATCH = 200_000


def dependency_edges(
    tasks: DataFrame,
    group: Sequence[str] = ("resource_id",),
    key: str = "task_key",
    depends_on: str = "depends_on",
    clean: bool = False,
) -> DataFrame:
    """(group, key, dep_key), each once; depends_on is an array or its JSON text.

    With clean=True keys and dependencies are cleaned alike.
    """
    if isinstance(tasks.schema[depends_on].dataType, StringType):
        parsed = tasks.select(*group, key, F.try_parse_json(depends_on).alias("_value"))
        edges = parsed.select(*group, key, F.explode(dependency_list(F.col("_value"))).alias("dep_key"))
    else:
        edges = tasks.select(*group, key, F.explode(depends_on).alias("dep_key"))
    if clean:
        edges = edges.withColumns({key: clean_key(F.col(key)), "dep_key": clean_key(F.col("dep_key"))})
    return edges.distinct()


def _nodes_as_deps(tasks: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    return tasks.select(*group, F.col(key).alias("dep_key")).distinct()


def missing_dependencies(tasks: DataFrame, edges: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Edges to tasks the job does not have."""
    return edges.join(_nodes_as_deps(tasks, group, key), [*group, "dep_key"], "left_anti").select(
        *group, key, "dep_key"
    )


def edges_by_presence(tasks: DataFrame, edges: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Edges with `known`: whether their job has the task they lead to."""
    there = _nodes_as_deps(tasks, group, key).withColumn("_there", F.lit(True))
    joined = edges.join(there, [*group, "dep_key"], "left")
    return joined.select(*group, key, "dep_key", F.col("_there").isNotNull().alias("known"))


def self_dependencies(edges: DataFrame, key: str) -> DataFrame:
    return edges.filter(F.col(key) == F.col("dep_key"))


def root_tasks(tasks: DataFrame, edges: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Tasks that depend on nothing."""
    return tasks.select(*group, key).distinct().join(edges, [*group, key], "left_anti")


def topological_levels(
    tasks: DataFrame, edges: DataFrame, group: Sequence[str], key: str, batch: int = BATCH, known: bool = False
) -> DataFrame:
    """(group, key, level): roots are level 0, others one above their highest dependency.

    The level is NULL for tasks on a cycle or behind one. Dependencies that do not exist
    are left to missing_dependencies and ignored here. known: edges are staged and
    distinct already, and lead to tasks that exist.

    Graphs of at most `batch` edges are ordered whole, many in one task, in a single pass.
    Larger ones are spread over tasks and contracted round by round: see _contracted.
    """
    node, dep = [*group, key], [*group, "dep_key"]
    nodes = stage(tasks.select(*node).distinct(), "nodes")
    # Distinct before the join: after it, the join's partitioning would be kept for the
    # aggregation, and a dependency that most edges share could not be split.
    if not known:
        distinct = edges.select(*group, key, "dep_key").distinct()
        edges = distinct.join(nodes.withColumnRenamed(key, "dep_key"), dep, "left_semi").select(*group, key, "dep_key")
        edges = stage(edges, "edges")
    roots = nodes.join(edges, node, "left_anti").select(*node, F.lit(0).alias("level"))
    if edges.count() <= batch:
        return roots.unionByName(_walked_whole(edges, group, key, batch))
    large, n_large = _staged(edges.groupBy(*group).count().filter(F.col("count") > batch).select(*group), "large")
    if not n_large:
        return roots.unionByName(_walked_whole(edges, group, key, batch))
    roots = stage(roots, "roots")
    small = _walked_whole(edges.join(large, list(group), "left_anti"), group, key, batch)
    deep = _contracted(edges.join(large, list(group), "left_semi"), roots, group, key, batch)
    return roots.unionByName(small).unionByName(deep)


def _contracted(edges: DataFrame, roots: DataFrame, group: Sequence[str], key: str, batch: int) -> DataFrame:
    """Levels of the tasks of large graphs, of which roots are the tasks without edges.

    An edge says level(task) >= max(base, level(dep) + step). Each round places tasks that
    wait for nothing, and those whose dependencies are placed inside a batch of edges in
    order of their keys. A task that waits for a single other one needs no place of its
    own: its edge is followed, inside its batch and then by doubling, to where it ends, and
    replaces it in the edges of others, whose parallel ones become one. So chains of any length take a number of
    steps that grows with its logarithm, and so do graphs that fall apart into chains; what
    remains are tasks that wait for several others, a layer of them or a batch a round.
    In the end the tasks that were followed take their level from where they ended.
    """
    node, dep = [*group, key], [*group, "dep_key"]
    start = edges.filter(F.col(key).isNotNull()).select(*node, "dep_key", F.lit(0).alias("base"), F.lit(1).alias("step"))
    longest = edges.count() + 1  # no path has more edges
    at_start = _as_deps(roots.select(*node, "level"), group, key)
    # Edges are distinct, so bases alone are to be merged at first.
    bases = start.join(at_start, dep).groupBy(*node).agg(F.max(F.col("dep_level") + F.col("step")).alias("base"))
    bases = bases.select(*node, F.lit(None).cast(edges.schema["dep_key"].dataType).alias("dep_key"), "base", F.lit(0).alias("step"))
    waiting, left = _staged(start.join(at_start, dep, "left_anti").select(*bases.columns).unionByName(bases), "waiting")
    no_level = F.lit(None).cast("int").alias("level")
    unplaced = edges.filter(F.col(key).isNull()).select(*node).distinct()
    placed_parts, followed_parts = [], []
    while left:
        walked = stage(_walked(waiting, group, key, batch), "walked")
        placed = walked.filter("level IS NOT NULL").select(*node, "level")
        rest = walked.filter("level IS NULL AND NOT single").select(*node, "dep_key", "base", "step")
        if walked.filter("level IS NOT NULL OR single").isEmpty():
            unplaced = unplaced.unionByName(rest.select(*node).distinct())
            break
        followed = _followed(walked.filter("single").select(*node, "dep_key", "base", "step"), group, key, longest)
        placed_parts.append(placed)
        followed_parts.append(followed)
        if rest.isEmpty():
            break
        base, step = F.col("base"), F.col("step")
        moved = rest.join(_ends(followed, group, key), dep, "left").select(
            *node, F.coalesce("_end", "dep_key").alias("dep_key"),
            F.greatest(base, F.col("_base") + step).alias("base"), (step + F.coalesce("_step", F.lit(0))).alias("step"),
        )
        waiting, left = _staged(_merged(_resolved(moved, _as_deps(placed, group, key), dep), node), "waiting")
    found = placed_parts
    for followed in reversed(followed_parts):
        # Many tasks end at few, whose levels are small enough to be sent to all.
        levels = _as_deps(reduce(DataFrame.unionByName, found, roots).filter("level IS NOT NULL"), group, key)
        ends = stage(levels.join(followed.select(*dep).distinct(), dep, "left_semi"), "ends")
        level = F.when(F.col("dep_level").isNotNull(), F.greatest(F.col("base"), F.col("dep_level") + F.col("step")))
        ended = followed.join(ends, dep, "left").select(*node, level.alias("level"))
        found = [*found, stage(ended, "ended")]
    return reduce(DataFrame.unionByName, found, unplaced.select(*node, no_level))


def _resolved(waiting: DataFrame, placed: DataFrame, dep: list[str]) -> DataFrame:
    """Edges to placed tasks become a base without a dependency."""
    known = F.col("dep_level").isNotNull()
    joined = waiting.join(placed, dep, "left")
    return joined.select(
        *[c for c in waiting.columns if c not in ("dep_key", "base", "step")],
        F.when(~known, F.col("dep_key")).alias("dep_key"),
        F.greatest(F.col("base"), F.col("dep_level") + F.col("step")).alias("base"),
        F.when(known, 0).otherwise(F.col("step")).alias("step"),
    )


def _merged(waiting: DataFrame, node: list[str]) -> DataFrame:
    """Parallel edges as one."""
    return waiting.groupBy(*node, "dep_key").agg(F.max("base").alias("base"), F.max("step").alias("step"))


def _followed(single: DataFrame, group: Sequence[str], key: str, longest: int) -> DataFrame:
    """Edges of tasks that wait for one other, made to end at a task that is not such.

    Doubling is for the tasks in which edges of others end, the ends of batches, since
    edges were followed inside batches; the others' edges are moved once, afterwards.
    Those that lead into a cycle grow beyond the longest path and are left out, or end
    at a task that is.
    """
    node, dep = [*group, key], [*group, "dep_key"]
    met = single.select(*dep).distinct().withColumnRenamed("dep_key", key)
    current, n = _staged(single.join(met, node, "left_semi").select(*single.columns), "followed")
    if not n:
        return single
    while n:
        seen = Observation()
        jumped = _jumped(current, current, group, key).filter(F.col("step") < longest)
        counted = jumped.observe(seen, F.count_if("_on").alias("on"), F.count(F.lit(1)).alias("n"))
        current = stage(counted, "followed").drop("_on")
        n = seen.get["n"]
        if not seen.get["on"]:
            break
    return _jumped(single, current, group, key).drop("_on")


def _jumped(edges: DataFrame, others: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Edges that lead where the edge of the task they led to does, and whether there was one (_on)."""
    joined = edges.join(_ends(others, group, key), [*group, "dep_key"], "left")
    return joined.select(
        *group, key, F.coalesce("_end", "dep_key").alias("dep_key"),
        F.greatest(F.col("base"), F.col("_base") + F.col("step")).alias("base"),
        (F.col("step") + F.coalesce("_step", F.lit(0))).alias("step"), F.col("_end").isNotNull().alias("_on"),
    )


def _ends(followed: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    return followed.select(
        *group, F.col(key).alias("dep_key"), F.col("dep_key").alias("_end"),
        F.col("base").alias("_base"), F.col("step").alias("_step"),
    )


def _as_deps(placed: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    return placed.select(*group, F.col(key).alias("dep_key"), F.col("level").alias("dep_level"))


def _staged(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """A staged table and its number of rows."""
    staged = stage(df, label)
    return staged, staged.count()


def _walked_whole(edges: DataFrame, group: Sequence[str], key: str, most: int) -> DataFrame:
    """Levels of the tasks of graphs of at most `most` edges, several graphs of about that many edges together."""
    names = list(group)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _cut(batches, names, most):
            yield _levels_of(frame.assign(base=0, step=1), names, key)

    schema = edges.select(*group, key).schema.add("level", "integer")
    return edges.repartition(*group).sortWithinPartitions(*group).mapInPandas(walk, schema)


def _walked(waiting: DataFrame, group: Sequence[str], key: str, most: int) -> DataFrame:
    """Edges of waiting tasks after a walk in batches of about `most` edges, in order of group and key.

    A task that is placed inside its batch has one row with its level. One that waits for a
    single other task has one row, marked single, that leads out of the batch, or to a task
    that is not such. Other rows are as before: those of tasks that wait for several, that lead
    into a cycle of the batch, or that have more edges than a batch.
    """
    node = [*group, key]
    # Two rows, an edge and a base, are the least that a followed task may have.
    most = max(most, 2)

    rows = waiting.select(*node, "dep_key", "base", "step")
    schema = rows.schema.add("level", "integer").add("single", "boolean")
    names = schema.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, piece in _pieces(batches, node, most):
            yield from _stepped(table, piece, node).select(names).to_batches()

    return rows.repartitionByRange(*node).sortWithinPartitions(*node).mapInArrow(walk, schema)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers, NULL as one of them."""
    return pa.chunked_array(column).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _pieces(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows and their pieces, numbers of about `most` rows each that change only where `names` do.

    Values of `names` with more rows than that have the piece -1. A table has as many pieces
    as come in one go, so that small pieces cost no table each.
    """
    held, large = None, None  # rows of the last value so far; the last value, if it has too many
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        held = None
        if not table.num_rows:
            continue
        codes = [_codes(table.column(n)) for n in names]
        number = np.cumsum(np.append(False, np.any([c[1:] != c[:-1] for c in codes], axis=0)))
        sizes = np.bincount(number)
        first = np.cumsum(sizes) - sizes
        too_many = sizes > most
        end = lambda at: tuple(table.column(n)[at].as_py() for n in names)
        if large is not None and large == end(0):
            too_many[0] = True
        large = end(-1) if too_many[-1] else None
        keep = table.num_rows if too_many[-1] else int(first[-1])
        if keep < table.num_rows:
            held = table.slice(keep)
        if keep:
            yield table.slice(0, keep), np.where(too_many, -1, first // most)[number][:keep]
    if held is not None:
        yield held, np.zeros(held.num_rows, np.int64)


def _stepped(table: pa.Table, piece: np.ndarray, node: list[str]) -> pa.Table:
    """Rows of _walked for those of _pieces."""
    known = table.column("dep_key").is_null().to_numpy()
    base, step = (table.column(c).to_numpy().astype(np.int64) for c in ("base", "step"))
    # Tasks and dependencies as numbers, apart in each piece.
    *groups, key = node
    place = piece.astype(np.int64)
    for g in groups:
        codes = _codes(table.column(g))
        place = np.unique(place * (codes.max() + 1) + codes, return_inverse=True)[1]
    ends = _codes(pa.chunked_array([*table.column(key).chunks, *table.column("dep_key").chunks]))
    both = np.unique(np.append(place, place).astype(np.int64) * (int(ends.max()) + 1) + ends, return_inverse=True)[1]
    small = piece >= 0
    n = int(both.max()) + 1
    task, needs = both[: len(place)], both[len(place) :]
    level, placed = _placed(task[small], needs[small & ~known], known[small], base[small], step[small], n, False)
    # Tasks that wait for one other, and where its edge leads; followed by doubling, too.
    waits = small & ~known
    single = (np.bincount(task[waits], minlength=n) == 1) & ~placed
    own, met = np.zeros(n, np.int64), np.zeros(n, np.int64)  # a row of each task, and one that leads to it
    own[task], met[needs[~known]] = np.arange(len(place)), np.flatnonzero(~known)
    lowest, length, to = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    np.maximum.at(lowest, task[small], base[small])
    np.maximum.at(length, task[small], step[small])
    lone = waits & single[task]
    to[task[lone]] = needs[lone]
    for _ in range(n.bit_length() + 1):
        on = np.flatnonzero(single & single[to])
        if not on.size:
            break
        t = to[on]
        lowest[on], length[on], to[on] = np.maximum(lowest[on], lowest[t] + length[on]), length[on] + length[t], to[t]
    done = np.flatnonzero(single & ~single[to])  # others lead into a cycle
    over = np.flatnonzero(placed)
    settled = placed.copy()
    settled[done] = True
    rest = np.flatnonzero(~small | ~settled[task])
    at = np.concatenate((rest, own[done], own[over]))
    lead = np.concatenate((rest, met[to[done]], own[over]))
    none, kind = np.zeros(len(rest) + len(done), np.int64), np.repeat((0, 1, 2), (len(rest), len(done), len(over)))
    out = table.select(node).take(pa.array(at))
    dep_key = table.column("dep_key").take(pa.array(lead, mask=kind == 2))
    zeros = np.zeros(len(over), np.int64)
    numbers = {"base": np.concatenate((base[rest], lowest[done], zeros)), "step": np.concatenate((step[rest], length[done], zeros))}
    out = out.append_column("dep_key", dep_key)
    for name, values in numbers.items():
        out = out.append_column(name, pa.array(values, pa.int32()))
    out = out.append_column("level", pa.array(np.append(none, level[over]), pa.int32(), mask=kind != 2))
    return out.append_column("single", pa.array(kind == 1))


def _cut(batches: Iterator[pd.DataFrame], names: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames of about `most` that end where `names` change; values with more rows are left out."""
    held, size, skipped = [], 0, None
    for whole in batches:
        for start in range(0, len(whole), most):
            held.append(whole.iloc[start : start + most])
            size += len(held[-1])
            if size < most:
                continue
            frame = pd.concat(held, ignore_index=True)
            number = frame.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
            if skipped is not None and skipped == tuple(frame[names].iloc[0]):
                frame, number = frame[number > 0], number[number > 0]
            skipped = None
            last = number == number[-1] if len(number) else number
            if len(number) and last.all() and len(number) > most:
                held, size, skipped = [], 0, tuple(frame[names].iloc[0])
                continue
            if len(number) and not last.all():
                yield frame[~last].reset_index(drop=True)
                frame = frame[last]
            held, size = [frame], len(frame)
    frame = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
    if len(frame) and skipped is not None and skipped == tuple(frame[names].iloc[0]):
        frame = frame[frame.groupby(names, sort=False, dropna=False).ngroup().to_numpy() > 0].reset_index(drop=True)
    if len(frame):
        yield frame


def _levels_of(edges: pd.DataFrame, group: list[str], key: str) -> pd.DataFrame:
    """Levels of the tasks of whole graphs; tasks without edges are roots, those that cannot be placed have no level."""
    known = edges["dep_key"].isna().to_numpy()
    ends = [edges[[*group, key]], edges.loc[~known, [*group, "dep_key"]].rename(columns={"dep_key": key})]
    both = pd.concat(ends, ignore_index=True)
    codes = both.groupby([*group, key], sort=False, dropna=False).ngroup().to_numpy()
    nodes = both.drop_duplicates(ignore_index=True)
    task, needs = codes[: len(edges)], codes[len(edges) :]
    base, step = (edges[c].to_numpy(dtype=np.int64) for c in ("base", "step"))
    level, placed = _placed(task, needs, known, base, step, len(nodes), True)
    found = nodes.assign(level=pd.Series(level, dtype="Int32").where(placed))
    own = np.zeros(len(nodes), bool)
    own[task] = True
    return found[own]


def _placed(
    task: np.ndarray, needs: np.ndarray, known: np.ndarray, base: np.ndarray, step: np.ndarray, n: int, whole: bool
) -> tuple[np.ndarray, np.ndarray]:
    """(level, placed) of n tasks: placed are those all of whose dependencies are placed by these edges.

    The edges of a task are all here; those that are known need nothing and are a base, the
    others need a task each. If graphs are whole, tasks without edges are roots.
    """
    level, own = np.zeros(n, np.int64), np.zeros(n, bool)
    own[task] = True
    np.maximum.at(level, task, base)
    dependants, steps = task[~known], step[~known]
    waiting = np.bincount(dependants, minlength=n)
    order = np.argsort(needs, kind="stable")
    dependants, steps, used = dependants[order], steps[order], np.bincount(needs, minlength=n)
    starts = np.cumsum(used) - used
    free = np.flatnonzero((waiting == 0) & (own | whole))
    placed = np.zeros(n, bool)
    while free.size:
        placed[free] = True
        n_used = used[free]
        at = np.repeat(starts[free] - (np.cumsum(n_used) - n_used), n_used) + np.arange(n_used.sum())
        met = dependants[at]
        np.maximum.at(level, met, np.repeat(level[free], n_used) + steps[at])
        np.subtract.at(waiting, met, 1)
        free = np.unique(met[waiting[met] == 0])
    return level, placed


def cyclic_groups(levels: DataFrame, group: Sequence[str]) -> DataFrame:
    """Jobs with a cycle, from topological_levels."""
    return levels.filter(F.col("level").isNull()).select(*group).distinct()


def cycle_members(tasks: DataFrame, edges: DataFrame, group: Sequence[str], key: str, batch: int = BATCH) -> DataFrame:
    """(group, key, cycle): the tasks on cycles, and the least key of those they are on cycles with.

    Tasks that merely wait for a cycle are not named, nor are tasks between two cycles.
    What no cycle leads to and what leads to no cycle is cut off first, by levels of the
    edges and of their reverse; the rest falls into strongly connected parts, whole graphs
    of at most `batch` edges in a task, larger ones by spreading least keys forwards and
    then backwards until nothing changes, a part of each at least a round.
    """
    node, dep = [*group, key], [*group, "dep_key"]
    ahead = topological_levels(tasks, edges, group, key, batch).filter(F.col("level").isNull()).select(*node)
    open_edges = _between(edges.select(*node, "dep_key").distinct(), ahead, group, key)
    back = open_edges.select(*group, F.col("dep_key").alias(key), F.col(key).alias("dep_key"))
    core = topological_levels(ahead, back, group, key, batch).filter(F.col("level").isNull()).select(*node)
    rest, n_edges = _staged(_between(open_edges, core, group, key), "core")
    if n_edges <= batch:
        return _local_cycles(rest, group, key, batch)
    large = stage(rest.groupBy(*group).count().filter(F.col("count") > batch).select(*group), "large")
    small = _local_cycles(rest.join(large, list(group), "left_anti"), group, key, batch)
    return small.unionByName(_spread_cycles(rest.join(large, list(group), "left_semi"), group, key))


def _between(edges: DataFrame, nodes: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Edges both of whose ends are among some tasks."""
    deps = nodes.select(*group, F.col(key).alias("dep_key"))
    return edges.join(nodes, [*group, key], "left_semi").join(deps, [*group, "dep_key"], "left_semi").select(*edges.columns)


def _local_cycles(edges: DataFrame, group: Sequence[str], key: str, most: int) -> DataFrame:
    names = list(group)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _cut(batches, names, most):
            yield _cycles_of(frame, names, key)

    schema = edges.select(*group, key).schema.add("cycle", edges.schema[key].dataType)
    return edges.repartition(*group).sortWithinPartitions(*group).mapInPandas(find, schema)


def _cycles_of(edges: pd.DataFrame, group: list[str], key: str) -> pd.DataFrame:
    """Tasks of strongly connected parts that hold an edge, with the part's least key.

    Least numbers spread along edges; where one spreads back to its own start, all that it
    reached in both directions is a part. Tasks are numbered in order of their keys.
    """
    ends = [edges[[*group, key]], edges[[*group, "dep_key"]].rename(columns={"dep_key": key})]
    both = pd.concat(ends, ignore_index=True)
    codes = both.groupby([*group, key], sort=True, dropna=False).ngroup().to_numpy()
    nodes = both.assign(_code=codes).drop_duplicates("_code").sort_values("_code", ignore_index=True).drop(columns="_code")
    to, source = np.split(codes, 2)
    part = np.full(len(nodes), -1)
    active = np.ones(len(nodes), bool)
    while active.any():
        live = active[to] & active[source]
        a, b = source[live], to[live]
        colour = _least(np.where(active, np.arange(len(nodes)), len(nodes)), a, b)
        same = colour[a] == colour[b]
        root = colour == np.arange(len(nodes))
        home = _least(np.where(root & active, np.arange(len(nodes)), len(nodes)), b[same], a[same])
        found = active & (home == colour)
        part[found] = colour[found]
        active &= ~found
    held = np.zeros(len(nodes), bool)
    inner = part[to] == part[source]
    held[part[to[inner]]] = True
    chosen = held[part]
    return nodes.assign(cycle=nodes[key].to_numpy()[part])[chosen]


def _least(start: np.ndarray, source: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The least number that reaches each place along edges."""
    value = start.copy()
    while True:
        before = value.copy()
        np.minimum.at(value, to, before[source])
        if (value == before).all():
            return value


def _spread_cycles(edges: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Cycles of graphs that no task holds whole; each round settles at least one part of every graph."""
    node = [*group, key]
    parts = [edges.select(*node, F.col(key).alias("cycle")).limit(0)]
    left, n = _staged(edges, "left")
    while n:
        deps = left.select(*group, F.col("dep_key").alias(key))
        nodes = stage(left.select(*node).union(deps).distinct(), "nodes")
        colour = _spread(nodes.withColumn("colour", F.col(key)), left, group, key)
        named = _coloured(left, colour, group, key).filter("colour = dep_colour")
        back = named.select(*group, F.col("dep_key").alias(key), F.col(key).alias("dep_key"))
        roots = colour.select(*node, F.when(F.col("colour") == F.col(key), F.col(key)).alias("colour"))
        home = _spread(roots, back, group, key).withColumnRenamed("colour", "home")
        part = stage(colour.join(home.filter("home IS NOT NULL"), node).select(*node, F.col("colour").alias("cycle")), "part")
        inner = _coloured(left, part.withColumnRenamed("cycle", "colour"), group, key).filter("colour = dep_colour")
        parts.append(part.join(inner.select(*group, F.col("colour").alias("cycle")).distinct(), [*group, "cycle"], "left_semi").select(*node, "cycle"))
        rest = nodes.join(part.select(*node), node, "left_anti")
        left, n = _staged(_between(left, rest, group, key), "left")
    return reduce(DataFrame.unionByName, parts)


def _coloured(edges: DataFrame, colour: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    deps = colour.select(*group, F.col(key).alias("dep_key"), F.col("colour").alias("dep_colour"))
    return edges.join(colour, [*group, key]).join(deps, [*group, "dep_key"])


def _spread(values: DataFrame, edges: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """The least colour that reaches each task from those it depends on, its own among them; NULL is none."""
    node = [*group, key]
    current = stage(values.select(*node, "colour"), "colour")
    while True:
        deps = current.select(*group, F.col(key).alias("dep_key"), "colour")
        reached = edges.join(deps, [*group, "dep_key"]).groupBy(*node).agg(F.min("colour").alias("_new"))
        seen = Observation()
        least = F.least("colour", "_new")
        joined = current.join(reached, node, "left").withColumn("_changed", ~F.col("colour").eqNullSafe(least))
        joined = joined.observe(seen, F.count_if("_changed").alias("n"))
        current = stage(joined.select(*node, least.alias("colour")), "colour")
        if not seen.get["n"]:
            return current


def run_decisions(
    tasks: DataFrame,
    edges: DataFrame,
    outcomes: DataFrame,
    group: Sequence[str],
    key: str,
    run_if: str = "run_if",
    disabled: str = "disabled",
) -> DataFrame:
    """(group, key, decision) for tasks: DISABLED, WAIT, RUN or SKIP.

    outcomes: (group, key, outcome), one row per finished task. A disabled dependency
    counts as satisfied; a task waits while a dependency has no outcome. The run
    condition defaults to ALL_SUCCESS.
    """
    dep = [*group, "dep_key"]
    ended = outcomes.select(*group, F.col(key).alias("dep_key"), "outcome")
    off = tasks.filter(F.col(disabled)).select(*group, F.col(key).alias("dep_key"), F.lit(True).alias("_off"))
    seen = (
        edges.join(ended, dep, "left")
        .join(off, dep, "left")
        .withColumn("outcome", F.when(F.col("_off"), F.lit(DISABLED)).otherwise(F.col("outcome")))
    )
    counts = seen.groupBy(*group, key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("outcome").alias("n_done"),
        F.count_if(F.col("outcome").isin(SUCCESS, DISABLED)).alias("n_ok"),
        F.count_if(F.col("outcome") == FAILED).alias("n_failed"),
    )
    joined = tasks.select(*group, key, run_if, disabled).join(counts, [*group, key], "left")
    return joined.select(*group, key, _decision(F.col(run_if), F.col(disabled)).alias("decision"))


def _decision(run_if: Column, disabled: Column) -> Column:
    n, done, ok, failed = F.col("n"), F.col("n_done"), F.col("n_ok"), F.col("n_failed")
    condition = F.coalesce(run_if, F.lit("ALL_SUCCESS"))
    holds = (
        F.when(condition == "ALL_SUCCESS", ok == n)
        .when(condition == "AT_LEAST_ONE_SUCCESS", ok > 0)
        .when(condition == "NONE_FAILED", failed == 0)
        .when(condition == "ALL_DONE", F.lit(True))
        .when(condition == "AT_LEAST_ONE_FAILED", failed > 0)
        .when(condition == "ALL_FAILED", failed == n)
        .otherwise(ok == n)
    )
    return (
        F.when(disabled, DISABLED)
        .when(n.isNull(), "RUN")
        .when(done < n, "WAIT")
        .when(holds, "RUN")
        .otherwise("SKIP")
    )
