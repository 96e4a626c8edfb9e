"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has REPLICAS places on a ring of 64-bit hashes; a key goes to the next place clockwise.
No shard takes more than its capacity: it keeps its own keys in ring order up to it, and those
that overflow go on clockwise, first come first served, to the next places whose shards have room. With
load 1 the capacities add up to the number of rows, so that counts differ by one at most; a larger
load moves fewer keys.

Only counts are worked off in order: one row an arc (shards x REPLICAS, whatever the input), folded
by one SQL aggregate. Rows get their place along the ring from one range shuffle of narrow columns and
the partitions' totals; there is no window over rows, so repeated keys can't fill a task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ringside.llm.common import store

REPLICAS = 128
#: Ring cells in which a key's arc is looked up.
CELL_BITS = 12


def places(spark: SparkSession, shards: int, replicas: int = REPLICAS) -> DataFrame:
    """(arc, position, shard) of all places, in ring order; arc 0 comes again as the last one, for keys beyond the last place."""
    # a place is its shard's own: adding a shard adds places and moves none
    ring = spark.range(shards * replicas).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
    ring = ring.select("shard", F.xxhash64(F.lit("place"), "shard", "replica").alias("position"))
    ring = ring.select((F.row_number().over(Window.orderBy("position", "shard")) - 1).alias("arc"), "position", "shard")
    return ring.union(ring.where("arc = 0").select(F.lit(shards * replicas), F.lit(None).cast("bigint"), "shard"))


def cells(ring: DataFrame) -> DataFrame:
    """2^CELL_BITS rows: the places in each cell of the ring and how many lie before it."""
    spark = ring.sparkSession
    every = spark.range(1 << CELL_BITS).select((F.col("id") - (1 << CELL_BITS - 1)).alias("cell"))
    own = ring.where("position is not null").groupBy(F.shiftright("position", 64 - CELL_BITS).alias("cell")).agg(F.array_sort(F.collect_list("position")).alias("inside"))
    own = every.join(own, "cell", "left").select("cell", F.coalesce("inside", F.array().cast("array<bigint>")).alias("inside"))
    return own.withColumn("before", F.coalesce(F.sum(F.size("inside")).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def plan(counts: DataFrame, ring: DataFrame, shards: int, load: float = 1.0) -> DataFrame:
    """From (arc, n): one row an arc with shard, keep (rows that stay), first (rows before it on the ring), slot
    (of its first row), out (overflowing rows before it) and moves (where its overflowing rows go)."""
    so_far = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    of_shard = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    arcs = ring.join(counts, "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    capacity = F.floor(total / shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0) if load == 1.0 else F.ceil(total * load / shards)
    arcs = arcs.withColumn("capacity", capacity.cast("long")).withColumn("slot", F.coalesce(F.sum("n").over(of_shard), F.lit(0)))
    arcs = arcs.withColumn("keep", F.greatest(F.lit(0).cast("long"), F.least("n", F.col("capacity") - F.col("slot"))))
    arcs = arcs.withColumn("excess", F.col("n") - F.col("keep"))
    arcs = store(arcs.withColumn("first", F.coalesce(F.sum("n").over(so_far), F.lit(0))).withColumn("out", F.coalesce(F.sum("excess").over(so_far), F.lit(0))), "arcs")

    # two laps: what is carried past a place enters its shard as far as there is room, then the place's own overflow joins the queue
    room = arcs.groupBy("shard").agg((F.max("capacity") - F.sum("keep")).alias("room"), F.sum("keep").alias("kept"))
    lap = F.sort_array(F.collect_list(F.struct("arc", "shard", "excess")))
    again = F.transform("lap", lambda a: F.struct((a.arc + F.lit(1 << 40)).alias("arc"), a.shard.alias("shard"), F.lit(0).cast("long").alias("excess")))
    rooms = F.transform(F.sort_array(F.collect_set(F.struct("shard", "room"))), lambda r: r.room)
    walk = arcs.join(room, "shard").agg(lap.alias("lap"), rooms.alias("rooms")).select(F.concat("lap", again).alias("walk"), "rooms")

    def step(state, place):
        take = F.least(state.carried, F.element_at(state.rooms, place.shard + 1))
        return F.struct((state.carried - take + place.excess).alias("carried"),
                        F.transform(state.rooms, lambda r, i: F.when(i == place.shard, r - take).otherwise(r)).alias("rooms"),
                        F.concat(state.takes, F.array(F.struct(place.shard.alias("shard"), take.alias("take")))).alias("takes"))

    start = F.struct(F.lit(0).cast("long").alias("carried"), F.col("rooms").alias("rooms"), F.array().cast("array<struct<shard:int,take:bigint>>").alias("takes"))
    takes = (walk.select(F.aggregate("walk", start, step, lambda s: s.takes).alias("takes"))
             .select(F.posexplode("takes").alias("step", "t")).select("step", "t.shard", "t.take").where("take > 0"))
    by_step = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = Window.partitionBy("shard").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    taken = takes.select(F.coalesce(F.sum("take").over(by_step), F.lit(0)).alias("at"), "shard", F.coalesce(F.sum("take").over(by_shard), F.lit(0)).alias("nth"))
    taken = taken.join(room.select("shard", "kept"), "shard").select("at", F.struct(F.col("shard"), F.col("at"), (F.col("kept") + F.col("nth")).alias("slot")).alias("into"))

    # the queue is cut by arcs and by takes; where both are known, a stretch of one arc's overflow goes to one shard
    cuts = arcs.where("excess > 0").select(F.col("out").alias("at"), F.col("arc").alias("from_arc"), F.lit(None).cast(taken.schema["into"].dataType).alias("into"))
    cuts = cuts.union(taken.select("at", F.lit(None).cast("int"), "into")).groupBy("at").agg(F.max("from_arc").alias("from_arc"), F.max("into").alias("into"))
    until = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stretches = cuts.select("at", F.last("from_arc", True).over(until).alias("arc"), F.last("into", True).over(until).alias("into"))
    moves = stretches.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("lo"), F.col("into.shard").alias("shard"), F.col("into.slot").alias("slot"), F.col("into.at").alias("from")))).alias("moves"))
    return arcs.join(moves, "arc", "left").select("arc", "shard", "keep", "first", "slot", "out", "moves")


def assign(rows: DataFrame, shards: int, key: str = "doc_id", load: float = 1.0, replicas: int = REPLICAS) -> DataFrame:
    """`rows` with shard and slot (gapless from 0 in a shard, for load 1 and more).

    Null keys have one place on the ring; rows of one key lie side by side in the order read. An empty
    table gives no rows. Columns may have any name; given ones called shard or slot make way for the result's.
    """
    spark = rows.sparkSession
    ring = store(places(spark, shards, replicas), "ring")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    placed = rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("ring_row"), F.monotonically_increasing_id().alias("ring_rid"),
                         F.xxhash64(F.lit("key"), rows[f"`{key}`"]).alias("ring_position"))
    cell = F.broadcast(cells(ring).select(F.col("cell").alias("ring_cell"), "inside", "before"))  # 2^CELL_BITS rows
    placed = placed.withColumn("ring_cell", F.shiftright("ring_position", 64 - CELL_BITS)).join(cell, "ring_cell")
    placed = placed.withColumn("ring_arc", (F.col("before") + F.size(F.filter("inside", lambda p: p < F.col("ring_position")))).cast("int")).drop("inside", "before", "ring_cell")
    placed = placed.repartitionByRange("ring_position", "ring_rid").sortWithinPartitions("ring_position", "ring_rid")
    placed = store(placed.withColumn("ring_part", F.spark_partition_id()).withColumn("ring_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("ring_rid", "ring_position"), "placed")

    parts = placed.groupBy("ring_part").agg((F.max("ring_nth") + 1).alias("n"))
    offsets = parts.select("ring_part", F.coalesce(F.sum("n").over(Window.orderBy("ring_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ring_before"))
    arcs = plan(placed.groupBy(F.col("ring_arc").alias("arc")).agg(F.count(F.lit(1)).alias("n")), ring, shards, load)
    arcs = arcs.select(*[F.col(c).alias(f"ring_{c}") for c in arcs.columns])
    rank = F.col("ring_before") + F.col("ring_nth") - F.col("ring_first")
    nth_out = F.col("ring_out") + rank - F.col("ring_keep")
    move = F.element_at(F.filter("ring_moves", lambda m: m.lo <= nth_out), -1)
    both = placed.join(offsets, "ring_part").join(F.broadcast(arcs), "ring_arc")  # shards x replicas rows
    into = F.when(rank < F.col("ring_keep"), F.struct(F.col("ring_shard").alias("shard"), (F.col("ring_slot") + rank).alias("slot"))).otherwise(
        F.struct(move.shard.alias("shard"), (move.slot + nth_out - move["from"]).alias("slot")))
    return both.withColumn("ring_into", into).select(*[F.col("ring_row").getField(c).alias(c) for c in kept], F.col("ring_into.shard").cast("int").alias("shard"), F.col("ring_into.slot").cast("long").alias("slot"))
