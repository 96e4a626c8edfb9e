"""Distance, nearest-neighbour and point-in-ring joins as equi-joins on grid cells.

No operator here compares everything with everything: both sides meet on a cell key, so Spark
hash-partitions them, adaptive execution can split a crowded cell, and the exact predicate
runs on the few rows that share a cell. Copies at one coordinate are folded by the callers
before they get here wherever the answer allows it.
"""
from pyspark.sql import DataFrame, Window, functions as F

from ringside.functions import geo
from ringside.operators import ranking
from ringside.session import cut_lineage, shuffled


def _with_cell(points, level, lat, lon):
    return points.withColumn("_cy", geo.cell_row(F.col(lat), level)).withColumn(
        "_cx", geo.cell_col(F.col(lon), level))


def within_radius(left: DataFrame, right: DataFrame, radius_m: float, *, by=(), strict=False,
                  left_point=("lat", "lon"), right_point=("lat", "lon"), how="inner"):
    """Pairs at most radius_m apart (strictly less with strict=True), with their distance.

    Column names of the two sides must differ except for the keys in `by`. The left side is
    repeated once per cell its disc touches (about six), the right side never: each pair is
    therefore met exactly once. how may be "inner", "left_semi" or "left_anti"; the last two
    keep the rows of `right` instead, because that is the side that is not repeated.
    """
    level = geo.level_for(radius_m)
    (alat, alon), (blat, blon) = left_point, right_point
    spread = left.where(F.col(alat).isNotNull() & F.col(alon).isNotNull()).withColumn(
        "_cell", F.explode(geo.cells_around(F.col(alat), F.col(alon), radius_m, level)))
    spread = spread.select(*left.columns, F.col("_cell.cy").alias("_cy"),
                           F.col("_cell.cx").alias("_cx"))
    placed = _with_cell(right, level, blat, blon)
    if how != "inner":
        probe = spread.select(F.col(alat).alias("_alat"), F.col(alon).alias("_alon"),
                              *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
                              F.col("_cy").alias("_ay"), F.col("_cx").alias("_ax"))
        probe = probe.distinct()
        gap = geo.haversine(F.col("_alat"), F.col("_alon"), F.col(blat), F.col(blon))
        on = [F.col("_ay") == F.col("_cy"), F.col("_ax") == F.col("_cx"),
              gap < radius_m if strict else gap <= radius_m]
        on += [F.col(f"_k{i}") == F.col(c) for i, c in enumerate(by)]
        return placed.join(shuffled(probe), on, how).drop("_cy", "_cx")
    pairs = spread.join(placed, [*by, "_cy", "_cx"]).withColumn(
        "metres", geo.haversine(F.col(alat), F.col(alon), F.col(blat), F.col(blon)))
    near = F.col("metres") < radius_m if strict else F.col("metres") <= radius_m
    return pairs.where(near).drop("_cy", "_cx")


def best_within(left: DataFrame, right: DataFrame, radius_m: float, order, *, left_point=("lat", "lon"),
                right_point=("ring_lat", "ring_lon"), level=geo.FINEST_LEVEL) -> DataFrame:
    """Pairs (left's columns, best, metres) with rows of `right` less than radius_m away, among them each left row's
    first in `order`: cells of `level` that lie wholly within reach give their first row alone.

    left is repeated over the few cells of a coarser grid its disc touches and meets the occupied cells of `level`
    there, so a crowded spot is one row for each of its cells, however many rows lie in them.
    """
    (alat, alon), (blat, blon) = left_point, right_point
    # read by both the cells and the single rows: worked out once
    placed = cut_lineage(_with_cell(right.dropna(subset=[blat, blon]), level, blat, blon)).withColumn("_row", F.struct(*right.columns))
    cells = placed.groupBy("_cy", "_cx").agg(
        F.min_by("_row", order).alias("_first"), F.min(blat).alias("s"), F.max(blat).alias("n"), F.min(blon).alias("w"), F.max(blon).alias("e"))
    middle = [(F.col("s") + F.col("n")) / 2, (F.col("w") + F.col("e")) / 2]
    # half the diagonal of the rows' box, or a little more
    reach = (F.radians(F.col("n") - F.col("s")) + F.radians(F.col("e") - F.col("w")) * F.cos(F.radians(F.least(F.abs("s"), F.abs("n"))))) * (geo.EARTH_M / 2) + 0.01
    cells = cells.select("_cy", "_cx", "_first", middle[0].alias("_mlat"), middle[1].alias("_mlon"), reach.alias("_reach")).withColumnsRenamed({"_cy": "_fy", "_cx": "_fx"})
    widest = 360.0 / 2 ** level * geo.DEG_M     # no box in a cell has a greater half diagonal
    met = within_radius(left, cells, radius_m + widest, left_point=left_point, right_point=("_mlat", "_mlon")).where(F.col("metres") - F.col("_reach") < radius_m)
    gap = geo.haversine(F.col(alat), F.col(alon), F.col(f"best.{blat}"), F.col(f"best.{blon}"))
    whole = met.where(F.col("metres") + F.col("_reach") < radius_m).select(*left.columns, F.col("_first").alias("best"))
    edge = met.where(F.col("metres") + F.col("_reach") >= radius_m).select(*left.columns, "_fy", "_fx")
    rows = placed.select(F.col("_cy").alias("_fy"), F.col("_cx").alias("_fx"), F.col("_row").alias("best"))
    single = edge.join(rows, ["_fy", "_fx"]).select(*left.columns, "best").where(gap < radius_m)
    return whole.unionByName(single).withColumn("metres", gap)


def in_rings(points: DataFrame, rings: DataFrame, *, level: int, by=(),
             point=("lat", "lon"), ring="ring") -> DataFrame:
    """Point and ring pairs where the point lies inside the ring.

    Rings are repeated once per grid cell of their bounding box, points never; the box test
    and the ray casting run only inside a shared cell. Choose a level whose cells are about
    the size of the rings.
    """
    boxed = rings.withColumn("_box", geo.ring_box(F.col(ring)))
    b = lambda side: F.col(f"_box.{side}")
    spread = boxed.withColumn("_cell", F.explode(geo.cells_of_box(
        b("south"), b("west"), b("north"), b("east"), level)))
    spread = spread.select(*rings.columns, "_box", F.col("_cell.cy").alias("_cy"),
                           F.col("_cell.cx").alias("_cx"))
    lat, lon = F.col(point[0]), F.col(point[1])
    placed = _with_cell(points.where(lat.isNotNull() & lon.isNotNull()), level, *point)
    boxes = lat.between(b("south"), b("north")) & lon.between(b("west"), b("east"))
    return (placed.join(shuffled(spread), [*by, "_cy", "_cx"]).where(boxes)
            .where(geo.in_ring(lat, lon, F.col(ring))).drop("_cy", "_cx", "_box"))


def keep_first(pairs: DataFrame, keys, order, k=1, rank="rank") -> DataFrame:
    """The first k rows per key. Spark prunes each map partition to k rows per key before the
    shuffle, so one key with very many rows does not reach one task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return pairs.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


class Packed:
    """Points sorted along a space-filling curve and packed into a tree of boxes by rank.

    LEAF points in curve order are a leaf, FAN nodes in a row a node of the next level. Places follow from
    ranks by division, so however the points crowd together every leaf and node is equally full: no
    cell is hot, and a dense spot has small boxes where a grid would have one crowded cell. Points under
    the same `by` keys are one run of ranks.

    points: `rank` and `_node` (the leaf) beside the given columns. levels, leaves first: the nodes of a level, by
    their low and high corners on the unit sphere, in one row (_node, kids) for each node above, so FAN in a
    row at most. runs: (by, _lo, _hi), ranks from _lo up to _hi, without it; none without keys.
    """
    LEAF, FAN = 8, 64

    def __init__(self, points: DataFrame, lat: str, lon: str, order, by=()):
        by = list(by)
        rows = points.dropna(subset=[*by, lat, lon])
        rows = ranking.placed(rows, [*by, geo.along_curve(F.col(lat), F.col(lon)), *order], "rank")
        self.size = rows.count()
        self.points = rows.withColumn("_node", F.floor(F.col("rank") / self.LEAF).cast("bigint"))
        run = [F.min("rank").alias("_lo"), (F.max("rank") + 1).alias("_hi")]
        self.runs = self.points.groupBy(*by).agg(*run) if by else None
        spot = geo.on_sphere(F.col(lat), F.col(lon))
        leaves = self.points.select("_node", *[x.alias(f"{n}{i}") for x, n in zip(spot, "xyz") for i in (0, 1)])
        self.levels, nodes = [], -(-self.size // self.LEAF)
        boxes = self._boxes(leaves, F.col("_node"))
        while True:
            kids = F.struct(F.col("_node").alias("kid"), *[f"{x}{i}" for i in (0, 1) for x in "xyz"])
            above = F.floor(F.col("_node") / self.FAN).cast("bigint")
            self.levels.append(cut_lineage(boxes.groupBy(above.alias("_node")).agg(F.collect_list(kids).alias("kids"))))
            if nodes <= self.FAN:
                break
            nodes = -(-nodes // self.FAN)
            boxes = self._boxes(self.levels[-1].select("_node", F.inline("kids")), F.col("_node"))

    @staticmethod
    def _boxes(nodes, key):
        return nodes.groupBy(key.alias("_node")).agg(*[f(f"{x}{i}").alias(f"{x}{i}") for i, f in ((0, F.min), (1, F.max)) for x in "xyz"])

    def held(self, level: int) -> int:
        """Points of a full node of a level."""
        return self.LEAF * self.FAN ** level


def nearest(queries: DataFrame, candidates: DataFrame, k: int, *, by=(), within_m=None, need=None, exclude=None) -> DataFrame:
    """The k nearest candidates of each query point, exactly, without a radius given up front.

    queries: q_id, q_lat, q_lon, the `by` keys and any column `exclude` needs.
    candidates: c_id, c_lat, c_lon and the same keys.
    Returns the query columns with c_id, metres (to the millimetre) and rank; ties go to the
    smaller c_id.

    The candidates are packed into a tree of boxes (`Packed`); all queries go down it level by level, in blocks of
    neighbours along the curve. On each level a block knows how many points its boxes hold and how far each box reaches
    at most from any of its queries, which bounds the distance of the `need`-th candidate (k, plus those it will exclude);
    boxes that begin beyond the bound are left out. Among the leaves of its block every query bounds its own way
    likewise. A query so meets the points of a few leaves, also beside a spot where very many lie together. Levels are
    as many as the logarithm of the input.

    A query with fewer than `need` candidates under its keys searches all of them. `exclude` is a predicate
    over both sides' columns; `need` is then an upper bound column. Queries sharing a
    coordinate should be folded into one by the caller; queries without a position or key find nothing.
    """
    pairs = pairs_met(queries, candidates, k, by=by, within_m=within_m, need=need)
    if exclude is not None:
        pairs = pairs.where(~exclude)
    return keep_first(pairs, ["_q"], ["metres", "c_id"], k).drop("_q")


def pairs_met(queries, candidates, k, *, by=(), within_m=None, need=None) -> DataFrame:
    """The pairs `nearest` ranks: every query with the points of the leaves it could not leave out, as far as
    its bound; _q numbers the queries."""
    by, c = list(by), F.col
    tree = Packed(candidates, "c_lat", "c_lon", ["c_id"], by)
    need = (F.lit(k) if need is None else need).cast("long")
    asked = queries.dropna(subset=["q_id", "q_lat", "q_lon", *by]).withColumn("_need", need)
    asked = asked.join(tree.runs, by) if by else asked.withColumns({"_lo": F.lit(0).cast("long"), "_hi": F.lit(tree.size).cast("long")})
    asked = _blocked(ranking.placed(asked.withColumn("_z", geo.along_curve(c("q_lat"), c("q_lon"))), ["_lo", "_z"], "_q"))
    slack = 3e-9    # two centimetres, in radii: more than rounding to millimetres and doubles can shift
    limit = F.lit(2.0 + slack) if within_m is None else geo.chord_of(F.lit(float(within_m))) + slack
    block, box = ["_b", "_lo", "_hi"], [f"{x}{i}" for i in (0, 1) for x in "xyz"]

    def left_in(met, low, high, keys):
        """Rows of (keys, box of a node) that a query, or a block of them, can't leave out; `_bound` is how far it has to look."""
        first = c("kid") * c("_size")
        own = F.least(c("_hi"), first + c("_size")) - F.greatest(c("_lo"), first)       # points of the query's own run
        near, far = geo.chords_between(low, high, [c(x) for x in box[:3]], [c(x) for x in box[3:]])
        met = met.withColumns({"_own": own, "_from": near, "_upto": far + slack}).where((c("_own") > 0) & (c("_from") <= c("_bound")))
        of = Window.partitionBy(*keys)
        so_far = F.sum("_own").over(of.orderBy("_upto").rangeBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("_so_far", so_far).withColumn("_bound", F.least("_bound", F.min(F.when(c("_so_far") >= c("_need"), c("_upto"))).over(of)))
        return met.where(c("_from") <= c("_bound")).drop("_own", "_from", "_upto", "_so_far")

    at = dict(zip("xyz", geo.on_sphere(c("q_lat"), c("q_lon"))))
    corners = [f(at[x]).alias(f"_{x}{i}") for i, f in ((0, F.min), (1, F.max)) for x in "xyz"]
    # few bytes, much work: dealt to a stated number of tasks, which adaptive execution doesn't fold into one
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = asked.groupBy(*block).agg(F.max("_need").alias("_need"), *corners).repartition(tasks, *block).withColumns(
        {"_bound": limit, "_node": F.lit(0).cast("bigint")})
    held = down.columns[:-1]
    low, high = ([c(f"_{x}{i}") for x in "xyz"] for i in (0, 1))
    for level in range(len(tree.levels) - 1, -1, -1):
        kids = tree.levels[level]
        kids = F.broadcast(kids) if level + 1 == len(tree.levels) else kids     # the root's: one row of FAN boxes
        # the boxes become rows before anything is worked out: functions over arrays are interpreted, box by box
        met = down.join(kids, "_node").select(*held, F.inline("kids")).withColumn("_size", F.lit(tree.held(level)).cast("bigint"))
        down = left_in(met, low, high, block).withColumn("_node", c("kid"))
        down = down.select(*held, "_node", *box) if level == 0 else down.select(*held, "_node")
    # every query for itself among the leaves of its block
    leaves = down.select(*block, "_bound", c("_node").alias("kid"), *box)
    met = asked.withColumns({f"_{x}": v for x, v in at.items()}).join(shuffled(leaves), block).withColumn("_size", F.lit(tree.LEAF).cast("bigint"))
    point = [c(f"_{x}") for x in "xyz"]
    down = left_in(met, point, point, [*block, "_q"]).withColumn("_node", c("kid"))
    reach = F.asin(F.least(c("_bound") / 2, F.lit(1.0))) * (2 * geo.EARTH_M) + 0.01
    down = down.select("_q", "_lo", "_hi", "_node", *queries.columns, (reach if within_m is None else F.least(reach, F.lit(float(within_m)))).alias("_reach"))
    gap = F.round(geo.haversine(c("q_lat"), c("q_lon"), c("c_lat"), c("c_lon")), 3)
    pairs = down.join(shuffled(tree.points.drop(*by)), "_node").where((c("rank") >= c("_lo")) & (c("rank") < c("_hi")))
    pairs = pairs.drop("rank", "_lo", "_hi", "_node").withColumn("metres", gap).where(c("metres") <= c("_reach"))
    return pairs.select("_q", *queries.columns, "c_id", *[x for x in candidates.columns if x not in ("c_id", "c_lat", "c_lon", *by)], "metres")


#: Queries in a row along the curve that go down the tree together.
BLOCK = 64


def _blocked(asked: DataFrame) -> DataFrame:
    """Queries with their block: _b within a run of candidates.

    BLOCK queries in curve order (_q) are parted by the quarters of the smallest curve cell that holds them all, so a
    block never reaches over a jump of the curve.
    """
    of = Window.partitionBy("_row", "_lo", "_hi")
    apart = F.min("_z").over(of).bitwiseXOR(F.max("_z").over(of))
    shift = F.when(F.col("_apart") > 0, F.floor(F.log2("_apart") / 2).cast("int") * 2).otherwise(0)
    rows = asked.withColumn("_row", F.floor(F.col("_q") / BLOCK).cast("bigint")).withColumn("_apart", apart).withColumn("_shift", shift)
    quarter = F.expr("shiftright(_z, _shift) & 3")
    return rows.withColumn("_b", F.col("_row") * 4 + quarter).drop("_row", "_apart", "_shift", "_z")
