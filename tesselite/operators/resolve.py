"""Many records of one entity become one entity.

Every outcome that depends on order is decided by a position column (a key or a struct that is unique), never by the
order of rows. All are grouped aggregations with partial aggregation before the shuffle; a hot entity costs one
partial result per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pos(pos: str | Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in ([pos] if isinstance(pos, str) else pos)])


def static_merge(df: DataFrame, key: str, pos, fields: Sequence[str], held: dict[str, Column] | None = None) -> DataFrame:
    """First held value by position, per field. A null is a held value; ``held`` says otherwise for sparse records."""
    held = held or {}
    p = _pos(pos)
    out = [F.min_by(F.struct(F.col(f)), F.when(held[f], p) if f in held else p).getField(f).alias(f) for f in fields]
    return df.groupBy(key).agg(*out)


def conflicts(df: DataFrame, key: str, pos, fields: Sequence[str]) -> DataFrame:
    """Entities whose records disagree: the first field (in the order given) with unequal values, nulls aside, and how
    many records there were."""
    counts = [F.count_distinct(f).alias(f"__{k}") for k, f in enumerate(fields)]
    first = reduce(lambda c, k: c.when(F.col(f"__{k}") > 1, fields[k]), range(1, len(fields)), F.when(F.col("__0") > 1, fields[0]))
    return df.groupBy(key).agg(F.count("*").alias("records"), *counts).select(key, "records", first.alias("field")).where("field is not null")


def records_merged(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Per entity type: entities made of several records, and the records they were made of."""
    n = df.groupBy(kind, key).agg(F.count("*").alias("n"))
    return n.groupBy(kind).agg(F.count("*").alias("entities"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("merged_entities"), F.sum("n").alias("records"))


def current_state(df: DataFrame, key: str, pos, slots: dict[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Latest observation per slot: slots maps a slot to (its instant, its fields). Later instants win, then later
    positions; a record without an instant ranks lowest; a null value of the latest record stays."""
    out = []
    for instant, fields in slots.values():
        rank = F.struct(F.col(instant).alias("at"), _pos(pos).alias("pos"))
        out += [F.max_by(F.struct(F.col(f)), rank).getField(f).alias(f) for f in fields]
        out.append(F.max(F.col(instant)).alias(instant) if instant not in fields else None)
    seen, kept = set(), []
    for c in out:
        if c is not None and (name := c._jc.toString().split(" AS ")[-1]) not in seen:
            seen.add(name)
            kept.append(c)
    return df.groupBy(key).agg(*kept)


def newest(df: DataFrame, key: str, pos, instants: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields without an instant of their own: of the record that is newest over all instants."""
    rank = F.struct(F.greatest(*instants) if len(instants) > 1 else F.col(instants[0]), _pos(pos))
    return df.groupBy(key).agg(*[F.max_by(F.struct(F.col(f)), rank).getField(f).alias(f) for f in fields])


def series(df: DataFrame, key: str, pos, instant: str, fields: Sequence[str], static: Sequence[str] = ()) -> DataFrame:
    """All observations of an entity as arrays in the order of instant, then position; static fields are the first
    held. The array of one entity is its result and must fit one row; see ``series_rows`` otherwise."""
    item = F.struct(F.col(instant).alias("__at"), _pos(pos).alias("__pos"), *[F.col(f) for f in fields])
    p = _pos(pos)
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__s"), *[F.min_by(F.struct(F.col(f)), p).getField(f).alias(f) for f in static])
    pick = lambda f: F.transform("__s", lambda x: x.getField(f)).alias(f)
    return lists.select(key, *static, *[pick(f) for f in fields])


def series_rows(df: DataFrame, key: str, pos, instant: str) -> DataFrame:
    """The same as rows in order within sorted partitions, for entities whose series doesn't fit one row."""
    return df.repartition(key).sortWithinPartitions(key, instant, *([pos] if isinstance(pos, str) else pos))


def scope_union(df: DataFrame, key: str, scopes: str) -> DataFrame:
    """Distinct scopes of an entity, by code point."""
    return df.select(key, F.explode(scopes).alias("s")).groupBy(key).agg(F.array_sort(F.collect_set("s")).alias(scopes))


def expiry_static(df: DataFrame, key: str, pos, expires: str) -> DataFrame:
    """Within a static mapping: the last that was declared."""
    return df.groupBy(key).agg(F.max_by(expires, F.when(F.col(expires).isNotNull(), _pos(pos))).alias(expires))


def expiry_temporal(df: DataFrame, key: str, pos, instant: str, expires: str) -> DataFrame:
    """Within a temporal mapping: that of the kept record, also if it is none."""
    return current_state(df, key, pos, {"kept": (instant, [expires])}).select(key, expires)


def expiry_series(df: DataFrame, key: str, expires: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(expires).alias(expires))


def expiry_join(df: DataFrame, key: str, expires: str) -> DataFrame:
    """Across mappings: none if any lacks it, else the furthest."""
    return df.groupBy(key).agg(F.when(F.count("*") == F.count(expires), F.max(expires)).alias(expires))


def single_target(edges: DataFrame, parent: str, pos, child: str) -> DataFrame:
    """The first target in source order."""
    p = F.when(F.col(child).isNotNull(), _pos(pos))
    return edges.groupBy(parent).agg(F.min_by(child, p).alias(child))


def list_targets(edges: DataFrame, parent: str, pos, child: str) -> DataFrame:
    """Distinct targets in the order in which they first come."""
    first = edges.where(F.col(child).isNotNull()).groupBy(parent, child).agg(F.min(_pos(pos)).alias("__p"))
    lists = first.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct("__p", child))).alias("__l"))
    return lists.select(parent, F.transform("__l", lambda x: x.getField(child)).alias(child))


def earliest_edges(edges: DataFrame, parent: str, child: str, instant: str, pos) -> DataFrame:
    """Of repeated edges the earliest."""
    return edges.groupBy(parent, child).agg(F.min(F.struct(F.col(instant).alias("at"), _pos(pos).alias("pos"))).getField("at").alias(instant))


def source_order(df: DataFrame, key: str, pos) -> DataFrame:
    """Each entity with the position of its first record."""
    return df.groupBy(key).agg(F.min(_pos(pos)).alias("first"))


def join_mappings(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of several mappings' entities; an attribute belongs to the first frame that gives it a value."""
    names: list[str] = []
    tagged = []
    for k, f in enumerate(frames):
        names += [c for c in f.columns if c != key and c not in names]
        tagged.append(f.select(key, F.lit(k).alias("__k"), F.struct(*[F.col(c) for c in f.columns if c != key]).alias(f"__f{k}")))
    # A union and one aggregation cost one shuffle, whatever the number of frames.
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    owned = union.groupBy(key).agg(*[F.min_by(f"__f{k}", F.when(F.col("__k") == k, F.lit(0))).alias(f"__f{k}") for k in range(len(frames))])
    return owned.select(key, *[F.coalesce(*[F.col(f"__f{k}").getField(c) for k, f in enumerate(frames) if c in f.columns]).alias(c) for c in names])


def union_lanes(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def synthetic(df: DataFrame, id_: Column, link: str, fields: dict[str, Column], parent: Column) -> tuple[DataFrame, DataFrame]:
    """A second entity from the same rows, and the edges to it."""
    own = df.select(id_.alias("id"), *[c.alias(n) for n, c in fields.items()]).where("id is not null").dropDuplicates(["id"])
    return own, df.select(parent.alias("parent"), F.lit(link).alias("key"), id_.alias("child")).where("parent is not null and child is not null")


def unseen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that weren't read before."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def missing(committed: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Streams that were read before and aren't listed any more."""
    return committed.select(key).distinct().join(listed.select(key).distinct(), key, "left_anti")


def shared_members(df: DataFrame, key: str, members: Sequence[str]) -> DataFrame:
    """Members that all observations of an entity lack."""
    lacking = [F.when(F.count(m) == 0, F.lit(m)) for m in members]
    return df.groupBy(key).agg(F.filter(F.array(*lacking), lambda x: x.isNotNull()).alias("missing"))


def tally(df: DataFrame, code: str, example: str, pos) -> DataFrame:
    """Losses by reason: how many, and the first example."""
    return df.groupBy(code).agg(F.count("*").alias("n"), F.min_by(example, _pos(pos)).alias("example"))
