"""Greedy leader grouping: in a given order, a row joins the first leader within a radius, or
becomes a leader.

Done as rounds over a grid whose cells are smaller across than the radius, so a cell can hold
at most one leader. A row leads when it comes first among the undecided rows of all cells its
radius can reach; rows within reach of a leader are decided. Every round is a partial minimum
per cell and a join with at most one leader per cell: no pair of neighbours is ever listed,
however crowded a place is. Rows at one coordinate are folded into the first of them, because
the others always follow it.
"""
import math

from pyspark.sql import DataFrame, functions as F

from ringside.functions import geo
from ringside.session import cut_lineage, shuffled

c = F.col


def leader_groups(rows: DataFrame, radius_m: float, order, by=()) -> DataFrame:
    """Adds `leader` (the id of the leader) to rows that have id, lat, lon and the order columns.

    Rows only group with rows of the same `by` keys. Every round decides at least the first
    undecided row, so the rounds end; there are as many as the longest chain of rows that wait for
    one another. Where the order is free, take a hash: chains of a random order stay short.
    """
    # a cell is at most radius / sqrt(2) tall, and never wider than tall
    level = min(30, int(math.ceil(math.log2(360.0 / math.degrees(radius_m / geo.EARTH_M / math.sqrt(2))))))
    key = F.struct(*[c(x) for x in order], c("id"))
    by = list(by)
    spots = rows.groupBy(*by, "lat", "lon").agg(F.min(key).alias("key")).withColumns({
        "cy": geo.cell_row(c("lat"), level), "cx": geo.cell_col(c("lon"), level)})
    open_ = cut_lineage(spots)
    leaders = None
    reach = F.explode(geo.cells_around(c("lat"), c("lon"), radius_m, level))

    while not open_.isEmpty():
        # the first undecided row of each cell, told to every cell its own row can reach
        first = open_.groupBy(*by, "cy", "cx").agg(F.min("key").alias("first"))
        heads = open_.join(shuffled(first), [*by, "cy", "cx"]).where(c("key") == c("first"))
        around = heads.select(*by, "lat", "lon", "key", "cy", "cx", reach.alias("_r")).select(
            *by, "lat", "lon", "key", "cy", "cx", c("_r.cy").alias("ny"), c("_r.cx").alias("nx"))
        seen = around.join(shuffled(first.withColumnsRenamed({"cy": "ny", "cx": "nx"})), [*by, "ny", "nx"])
        new = cut_lineage(seen.groupBy(*by, "lat", "lon", "key", "cy", "cx").agg(F.min("first").alias("least"))
                          .where(c("least") == c("key")).drop("least"))
        leaders = new if leaders is None else leaders.unionByName(new)
        open_ = cut_lineage(_out_of_reach(open_, new, radius_m, reach, by))
    if leaders is None:
        return rows.withColumn("leader", c("id")).limit(0)

    # each spot goes to the earliest leader within reach
    told = _reaching(leaders, reach, by)
    held = spots.join(shuffled(told), [*by, "cy", "cx"]).where(
        geo.haversine(c("llat"), c("llon"), c("lat"), c("lon")) <= radius_m)
    held = held.groupBy(*by, "lat", "lon").agg(F.min("lkey").alias("_leader"))
    return rows.join(shuffled(held), [*by, "lat", "lon"]).withColumn("leader", c("_leader.id")).drop("_leader").select(
        *rows.columns, "leader")


def _reaching(leaders, reach, by):
    """Leaders repeated once per cell their radius can reach."""
    return leaders.select(*by, c("lat").alias("llat"), c("lon").alias("llon"), c("key").alias("lkey"),
                          reach.alias("_r")).select(*by, "llat", "llon", "lkey", c("_r.cy").alias("cy"),
                                                    c("_r.cx").alias("cx"))


def _out_of_reach(open_, leaders, radius_m, reach, by):
    keys = [*by, "cy", "cx"]
    told = _reaching(leaders, reach, by).withColumnsRenamed({k: f"_l_{k}" for k in keys})
    near = [c(k) == c(f"_l_{k}") for k in keys]
    near.append(geo.haversine(c("llat"), c("llon"), c("lat"), c("lon")) <= radius_m)
    return open_.join(shuffled(told), near, "left_anti")
