"""Connected classes of similar items, without ever forming all pairs of a group.

Items that may be similar share buckets. Each bucket's members are first held against a pivot,
the member that shares most with others, so that one round joins nearly all of a dense group.
Only pairs of one bucket that are still in different classes are then compared with each other, each pair
in one of the buckets it shares, so no link between classes is lost; links inside a class are
not needed. Hubs are read in parts: no task gets all that meets one item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import table

#: Members of a bucket that meet its pivot in one task, and parts in which a hub is read; they change the work's order only.
PART, WAYS = 1024, 32


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) -> (id, label): the smallest id reachable from each id that occurs in an edge.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so chains shorten by half at least; a written table ends each round's lineage.
    """
    both = table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), name)
    label = table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        low = label.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "seen").alias("low"))
        up = label.select(F.col("id").alias("low"), F.col("label").alias("top"))
        new = table(low.join(up, "low", "left").select("id", "was", F.least("low", "top").alias("label")), name)
        if new.where("label <> was").isEmpty():
            return new.select("id", "label")
        label = new.select("id", "label")


def fetch(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (a, b) with the values of both sides: left (a, ...) and right (b, ...). An item of many pairs is read in up to WAYS parts, by the other side's hash."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(WAYS))
    parts = pairs.select("a", "b", part("b").alias("part_a"), part("a").alias("part_b"))
    of = lambda side, values: parts.select(side, f"part_{side}").distinct().join(values, side)
    return parts.join(of("a", left), ["a", "part_a"]).join(of("b", right), ["b", "part_b"]).drop("part_a", "part_b")


def closure(nodes: DataFrame, buckets: DataFrame, near: Callable, verify: Callable[[DataFrame], DataFrame], name: str, finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, label) of all items that have a link; an item's label is the smallest id of its class.

    nodes: id and what near() reads. buckets: (key, id), a candidate pair shares a key.
    near(a, b, fine): a cheap necessary condition as a Column; a(name) and b(name) are the two sides' columns of nodes,
    and of finer()'s too if fine.
    verify: (a, b) pairs -> those that are links, as (a, b).
    finer: (id) -> (id, ...) more columns for near(), worth their cost only where whole classes meet.
    """
    own = [c for c in nodes.columns if c != "id"]
    size = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = table(buckets.join(size, "key").select("key", "id", "size"), name)
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"), F.array_sort(F.collect_set("key")).alias("keys"))
    active = table(nodes.join(weight, "id").select("id", "weight", "keys", *own), name)
    rows = shared.join(active.select("id", "weight", *own), "id")

    # Each bucket's members against its pivot, the one of the greatest weight; a large bucket in parts.
    best = F.max_by(F.struct("id", *own), F.struct("weight", F.xxhash64("id"), "id"))
    pivot = rows.groupBy("key").agg(best.alias("p"), F.max("size").alias("size"))
    parts = F.ceil(F.col("size") / PART)
    pivot = pivot.select("key", F.col("p.id").alias("b"), *[F.col(f"p.{c}").alias(f"b_{c}") for c in own], F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    mine = rows.select("key", F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in own], F.pmod(F.xxhash64("id"), parts).alias("part"))
    of = lambda side: lambda c: F.col(f"{side}_{c}")
    met = mine.join(pivot, ["key", "part"]).where((F.col("a") != F.col("b")) & near(of("a"), of("b"), False)).select("a", "b").distinct()
    links = table(verify(table(met, name)).select("a", "b").distinct(), name)
    label = components(links, name)

    # All pairs across classes: what lies outside a bucket's largest class against the bucket, in the first bucket that a pair shares.
    named = shared.select("key", "id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    count = named.groupBy("key", "label").count()
    main = count.groupBy("key").agg(F.max(F.struct("count", "label"))["label"].alias("main"), F.count("*").alias("classes")).where("classes > 1").select("key", "main")
    named = table(named.join(main, "key"), name)
    if named.isEmpty():
        return label
    known = active.join(named.select("id").distinct(), "id", "left_semi")
    if finer:
        known = table(known, name)
        extra = finer(known.select("id"))
        own += [c for c in extra.columns if c != "id"]
        known = known.join(extra, "id")
    known = table(known.select("id", "keys", *own), name)
    each = named.join(known, "id")
    # Numbers that can't be null keep the join's condition short enough for the JVM to compile.
    sure = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) if t in ("bigint", "int") else F.col(c) for c, t in known.dtypes}
    side = lambda s, rows: rows.select(F.col("key"), *([F.col("main")] if s == "b" else []), F.col("id").alias(s), F.col("label").alias(f"{s}_label"), *[sure[c].alias(f"{s}_{c}") for c in ("keys", *own)])
    few, many = side("a", each.where("label <> main")), side("b", each)
    new = (F.col("a_label") != F.col("b_label")) & ((F.col("b_label") == F.col("main")) | (F.col("a") < F.col("b")))
    once = F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("l.key")
    ok = (F.col("l.key") == F.col("r.key")) & new & near(of("a"), of("b"), finer is not None) & once
    found = table(verify(table(few.alias("l").join(many.alias("r"), ok).select("a", "b"), name)).select("a", "b").distinct(), name)
    return label if found.isEmpty() else components(links.unionByName(found), name)
