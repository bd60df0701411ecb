"""Road polylines: building them from past fixes, matching positions, progress along a route."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions import geo, text
from wayline.operators.prefix import running_totals
from wayline.operators.storage import cut


@dataclass(frozen=True)
class Gates:
    """What a match must meet: metres to the road, degrees to its direction; the share of the way to the road that a
    position is moved."""

    max_distance_m: float = 20.0
    max_heading_deg: float = 30.0
    strength: float = 0.5

    def __post_init__(self) -> None:
        if not 0 <= self.strength <= 1 or self.max_distance_m <= 0 or not 0 < self.max_heading_deg <= 90:
            raise ValueError("strength must be in [0, 1], the distance positive, the heading in (0, 90]")


def kept_vertices(vertices: DataFrame, keys: list[str], order: str = "seq", least_m: float = 0.1) -> DataFrame:
    """Drop a vertex within `least_m` of the one before it (whether or not that was kept) and number the rest."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.sqrt(F.pow(F.col("e") - F.lag("e").over(w), 2) + F.pow(F.col("n") - F.lag("n").over(w), 2))
    kept = vertices.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > least_m)).drop("_gap")
    return kept.withColumn("vertex", (F.row_number().over(w) - 1).cast("int"))


def past_roads(fixes: DataFrame, intervals: DataFrame, lookback_s: float = 120.0, min_vertices: int = 3, min_length_m: float = 1.0, exclude_outages: bool = False) -> DataFrame:
    """Vertices (session_id, duration_s, interval_idx, vertex, e, n) of a road for each interval, from fixes before it.

    Fixes from `lookback_s` before the interval's start up to, not at, the start count (all before it, if not positive);
    no later one can. A road needs `min_vertices` fixes, as many vertices that are apart, and `min_length_m`. Where
    `exclude_outages`, fixes inside any interval of the same schedule don't count either.
    Columns of `fixes`: session_id, t_s, gt_lat, gt_lon, ref_lat, ref_lon.
    """
    keys = ["session_id", "duration_s", "interval_idx"]
    before = F.col("t_s") < F.col("start_s")
    if lookback_s > 0:
        before &= F.col("t_s") >= F.col("start_s") - lookback_s
    rows = fixes.join(intervals, "session_id").where(before)
    if exclude_outages:
        hidden = intervals.select("session_id", "duration_s", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
        same = ["session_id", "duration_s"]
        rows = rows.join(hidden, [rows[c] == hidden[c] for c in same] + [rows["t_s"].between(hidden["_s"], hidden["_e"])], "left_anti")
    rows = rows.withColumn("e", geo.east_m(F.col("gt_lon"), F.col("ref_lat"), F.col("ref_lon"))).withColumn("n", geo.north_m(F.col("gt_lat"), F.col("ref_lat")))
    raw = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = kept_vertices(rows.withColumn("_raw", raw).where(F.col("_raw") >= min_vertices), keys, "t_s")
    w, whole = Window.partitionBy(*keys).orderBy("vertex"), Window.partitionBy(*keys)
    piece = F.sqrt(F.pow(F.col("e") - F.lag("e").over(w), 2) + F.pow(F.col("n") - F.lag("n").over(w), 2))
    rows = rows.withColumn("_piece", piece).withColumn("_length", F.sum("_piece").over(whole)).withColumn("_kept", F.count(F.lit(1)).over(whole))
    rows = rows.where((F.col("_kept") >= min_vertices) & (F.coalesce("_length", F.lit(0.0)) >= min_length_m))
    return rows.select(*keys, "vertex", "e", "n")


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["e"] - b["e"], 2) + F.pow(a["n"] - b["n"], 2))


def road_ranges(fixes: DataFrame, intervals: DataFrame, lookback_s: float = 120.0, min_vertices: int = 3, min_length_m: float = 1.0, least_m: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The roads of `past_roads` as each session's one polyline and the range of it that an interval has.

    No fix is copied to an interval, so the work is linear in fixes whatever the look-back. Whether a vertex is kept depends
    on the fix before it alone, so all roads of a session share its vertices but for a first fix that isn't kept there.
    The polyline has session_id, vertex, t_s, e, n and length_m from its start; a range has the interval's keys, first_vertex
    and last_vertex of the polyline, `start` (e, n of a first vertex of its own, else null), n_vertices and length_m.
    """
    asc, desc = (Window.partitionBy("session_id").orderBy(o) for o in ("t_s", F.desc("t_s")))
    upto, past = asc.rowsBetween(Window.unboundedPreceding, 0), asc.rowsBetween(Window.unboundedPreceding, -1)
    spot = F.struct(geo.east_m(F.col("gt_lon"), F.col("ref_lat"), F.col("ref_lon")).alias("e"), geo.north_m(F.col("gt_lat"), F.col("ref_lat")).alias("n"))
    rows = fixes.select("session_id", "t_s", spot.alias("at")).withColumn("_gap", _apart(F.col("at"), F.lag("at").over(asc)))
    rows = rows.withColumn("kept", F.col("_gap").isNull() | (F.col("_gap") > least_m)).withColumn("_mine", F.when(F.col("kept"), F.col("at")))
    rows = rows.withColumn("_piece", F.when(F.col("kept"), _apart(F.col("at"), F.last("_mine", ignorenulls=True).over(past))))
    rows = rows.withColumns({
        "no": F.row_number().over(asc), "v": F.count("_mine").over(upto).cast("int"), "m": F.coalesce(F.sum("_piece").over(upto), F.lit(0.0)),
    })
    nearest = F.last(F.when(F.col("kept"), F.struct("at", "m")), ignorenulls=True)
    rows = rows.withColumn("then", nearest.over(desc.rowsBetween(Window.unboundedPreceding, -1)))
    polyline = rows.where("kept").select("session_id", (F.col("v") - 1).alias("vertex"), "t_s", "at.e", "at.n", F.col("m").alias("length_m"))

    keys = ["session_id", "duration_s", "interval_idx"]
    since = F.col("start_s") - lookback_s if lookback_s > 0 else F.lit(float("-inf"))
    ends = F.explode(F.array(F.struct(since.alias("t"), F.lit(True).alias("first")), F.struct(F.col("start_s").alias("t"), F.lit(False).alias("first"))))
    asked = intervals.select(*keys, ends.alias("_end")).select("session_id", F.col("_end.t").alias("t_s"), F.lit(0).alias("_side"), F.struct(*keys[1:], "_end.first").alias("_ask"))
    packed = rows.select("session_id", "t_s", F.lit(1).alias("_side"), F.struct("no", "v", "m", "kept", "at", "then").alias("_fix"))
    both = asked.unionByName(packed, allowMissingColumns=True)
    # At one time the mark stands before the fix: the last fix behind it is earlier, the first from it on may be as late.
    behind, ahead = (
        F.last("_fix", ignorenulls=True).over(Window.partitionBy("session_id").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0))
        for o in (("t_s", "_side"), (F.desc("t_s"), F.desc("_side")))
    )
    met = both.withColumns({"_b": behind, "_a": ahead}).where("_ask is not null")
    one = lambda first, c: F.max_by(c, F.when(F.col("_ask.first") == F.lit(first), 1))
    found = met.groupBy("session_id", F.col("_ask.duration_s").alias("duration_s"), F.col("_ask.interval_idx").alias("interval_idx")).agg(one(True, "_a").alias("a"), one(False, "_b").alias("b"))
    a, b = F.col("a"), F.col("b")
    further = F.when(a["kept"], b["m"] - a["m"]).otherwise(_apart(a["at"], a["then"]["at"]) + b["m"] - a["then"]["m"])
    found = found.where(b["no"] - a["no"] + 1 >= min_vertices).withColumns({
        "first_vertex": a["v"] - a["kept"].cast("int"), "last_vertex": b["v"] - 1, "start": F.when(~a["kept"], a["at"]),
        "n_vertices": b["v"] - a["v"] + 1, "length_m": F.when(b["v"] > a["v"], further).otherwise(0.0),
    })
    ranges = found.where((F.col("n_vertices") >= min_vertices) & (F.col("length_m") >= min_length_m)).drop("a", "b")
    return polyline, ranges


def range_vertices(polyline: DataFrame, ranges: DataFrame) -> DataFrame:
    """Vertices of the ranges' roads, as `past_roads` gives them; each range's are copied out here."""
    keys = ["session_id", "duration_s", "interval_idx"]
    own = F.col("start").isNotNull().cast("int")
    shared = ranges.join(polyline.drop("length_m"), "session_id").where(F.col("vertex").between(F.col("first_vertex"), F.col("last_vertex")))
    shared = shared.select(*keys, (F.col("vertex") - F.col("first_vertex") + own).alias("vertex"), "e", "n")
    return shared.unionByName(ranges.where("start is not null").select(*keys, F.lit(0).alias("vertex"), "start.e", "start.n"))


def segments(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive vertices as segments; a road of fewer than two vertices has none."""
    w = Window.partitionBy(*keys).orderBy("vertex")
    rows = vertices.select(*keys, F.col("vertex").alias("segment_idx"), F.col("e").alias("ax"), F.col("n").alias("ay"), F.lead("e").over(w).alias("bx"), F.lead("n").over(w).alias("by"))
    return rows.where("bx is not null")


#: The nearest segment of a point: metres to it, its number, the place on it, and its direction.
_NEAR = T.StructType([T.StructField(n, T.IntegerType() if n == "s" else T.DoubleType()) for n in "dsxyh"])
#: So many pairs of points and segments are held at once.
PAIRS = 500_000


def _with_nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put `_near`, the first of the nearest segments of `_road`, in the place of `_road`; null without a segment."""
    for batch in batches:
        counts = pc.fill_null(pc.list_value_length(batch["_road"]), 0).to_numpy(zero_copy_only=False)
        first = 0
        while first < len(batch):
            n = max(1, int(np.searchsorted(np.cumsum(counts[first:]), PAIRS, "right")))
            part = batch.slice(first, n)
            near = _nearest(part["_road"], counts[first : first + n], *(part[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("e", "n")))
            names = [c for c in part.schema.names if c != "_road"]
            yield pa.RecordBatch.from_arrays([*[part[c] for c in names], near], [*names, "_near"])
            first += n


def _nearest(roads: pa.Array, counts: np.ndarray, e: np.ndarray, n: np.ndarray) -> pa.Array:
    have = np.flatnonzero(counts)
    starts, row = np.cumsum(counts[have]) - counts[have], np.repeat(have, counts[have])
    parts = pc.list_flatten(roads)
    ax, ay, bx, by = (pc.struct_field(parts, c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by"))
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    share = np.where(square < 1e-12, 0.0, np.clip(((e[row] - ax) * dx + (n[row] - ay) * dy) / np.where(square < 1e-12, 1.0, square), 0.0, 1.0))
    x, y = ax + share * dx, ay + share * dy
    away = (e[row] - x) ** 2 + (n[row] - y) ** 2
    away = np.where(np.isnan(away), np.inf, away)
    least = np.minimum.reduceat(away, starts) if len(have) else away
    nearest = np.flatnonzero(away == np.repeat(least, counts[have]))
    best = nearest[np.unique(row[nearest], return_index=True)[1]]
    at = np.zeros(len(counts), int)
    at[have] = np.arange(len(have))
    none = counts == 0
    pick = lambda v: pa.array(v).take(pa.array(at, mask=none))
    heading = np.degrees(np.arctan2(dx[best], dy[best])) % 360.0
    numbers = pc.struct_field(parts, "segment_idx").cast(pa.int32()).take(pa.array(best))
    values = [pick(np.sqrt(away[best])), numbers.take(pa.array(at, mask=none)), pick(x[best]), pick(y[best]), pick(heading)]
    return pa.StructArray.from_arrays(values, names=list("dsxyh"), mask=pa.array(none))


def match(points: DataFrame, roads: DataFrame, keys: list[str], gates: Gates = Gates()) -> DataFrame:
    """Match each point (e, n, heading_deg) with the road of its keys.

    A road's segments travel as one array (at most a look-back of fixes), and the nearest is found over Arrow batches of
    points: no pairs are shuffled, and what is asked of the result isn't worked out again for each mention of it. The nearest segment (first on a tie) is taken before the gates; a farther one that would pass them isn't
    tried. Both gates pass at equality. Unmatched points keep their place and have no segment (-1), NaN angles and
    infinite distance. Adds matched, outcome, proj_e, proj_n, corr_e, corr_n, road_heading_deg, segment_idx, distance_m,
    heading_diff_deg, rejection_reason.
    """
    parts = F.struct("segment_idx", "ax", "ay", "bx", "by")
    packed = roads.groupBy(*keys).agg(F.array_sort(F.collect_list(parts)).alias("_road"))
    rows = points.join(packed, keys, "left")

    rows = rows.mapInArrow(_with_nearest, T.StructType([*rows.drop("_road").schema, T.StructField("_near", _NEAR)]))
    turn = geo.heading_difference_deg(geo.wrap_degrees(F.col("heading_deg")), F.col("_near.h"))
    rows = rows.withColumn("_turn", turn)
    outcome = (
        F.when(F.col("_near").isNull(), "no_road")
        .when(F.col("_near.d") > gates.max_distance_m, "distance")
        .when(F.col("_turn") > gates.max_heading_deg, "heading")
        .otherwise("matched")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("matched", F.col("outcome") == "matched")
    nan = F.lit(float("nan"))
    hit = lambda value, other: F.when(F.col("matched"), value).otherwise(other)
    reason = text.rejection_text(F.col("outcome"), F.col("_near.d"), F.col("_turn"), gates.max_distance_m, gates.max_heading_deg)
    return rows.withColumns(
        {
            "proj_e": hit(F.col("_near.x"), F.col("e")), "proj_n": hit(F.col("_near.y"), F.col("n")),
            "corr_e": hit(F.col("e") + gates.strength * (F.col("_near.x") - F.col("e")), F.col("e")),
            "corr_n": hit(F.col("n") + gates.strength * (F.col("_near.y") - F.col("n")), F.col("n")),
            "road_heading_deg": hit(F.col("_near.h"), nan), "segment_idx": hit(F.col("_near.s"), F.lit(-1)),
            "distance_m": hit(F.col("_near.d"), F.lit(float("inf"))), "heading_diff_deg": hit(F.col("_turn"), nan),
            "rejection_reason": reason,
        }
    ).drop("_near", "_turn")


def match_stats(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Steps by outcome, the matched share, and the mean and largest correction (0 without a match)."""
    moved = F.sqrt(F.pow(F.col("corr_e") - F.col("e"), 2) + F.pow(F.col("corr_n") - F.col("n"), 2))
    return matches.withColumn("_moved", F.when(F.col("matched"), moved)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if("matched").alias("n_matched"),
        F.count_if(F.col("outcome") == "distance").alias("n_rejected_distance"), F.count_if(F.col("outcome") == "heading").alias("n_rejected_heading"),
        (F.count_if("matched") / F.count(F.lit(1))).alias("match_fraction"),
        F.coalesce(F.avg("_moved"), F.lit(0.0)).alias("avg_correction_m"), F.coalesce(F.max("_moved"), F.lit(0.0)).alias("max_correction_m"),
    )


def rolled_up(stats: DataFrame, keys: list[str], by_step: bool = True) -> DataFrame:
    """Totals over intervals. The mean correction weighs steps, or, where not `by_step`, takes the mean of the intervals'
    means."""
    weighted = F.sum(F.col("avg_correction_m") * F.col("n_matched")) / F.nullif(F.sum("n_matched"), F.lit(0))
    mean = F.coalesce(weighted, F.lit(0.0)) if by_step else F.avg("avg_correction_m")
    fraction = F.coalesce(F.sum("n_matched") / F.nullif(F.sum("n_steps"), F.lit(0)), F.lit(0.0))
    counts = [F.sum(c).alias(c) for c in ("n_steps", "n_matched", "n_rejected_distance", "n_rejected_heading")]
    return stats.groupBy(*keys).agg(*counts, fraction.alias("match_fraction"), mean.alias("avg_correction_m"))


def route_lengths(points: DataFrame, key: str = "route_id") -> DataFrame:
    """Each route point with the metres from it to the route's end and the route's whole length."""
    w = Window.partitionBy(key).orderBy("seq")
    piece = geo.haversine_atan2_m(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    rest = Window.partitionBy(key).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)  # a frame that grows
    rows = points.withColumn("_piece", F.coalesce(piece, F.lit(0.0))).withColumn("to_end_m", F.sum("_piece").over(rest))
    return rows.withColumn("route_m", F.sum("_piece").over(Window.partitionBy(key))).drop("_piece")


#: Points in a leaf of the index, nodes in a node above.
LEAF, FAN = 1024, 16
#: Positions that meet one leaf are dealt to parts of about so many; so many are compared with it at a time.
ASKED, AT_ONCE = 65_536, 256
#: Levels of up to so many nodes (under 10 MB) are sent to every task; others are joined by shuffle.
FEW_NODES = 4096
#: Bits of each axis in each half of a point's place on the curve: 42 in all, steps of a few micrometres.
CURVE_BITS = 21


def _on_globe(lat: Column, lon: Column) -> list[Column]:
    """Metres along three axes: a straight distance, so never more than that along the ground."""
    a, b = F.radians(lat), F.radians(lon)
    return [geo.EARTH_RADIUS_M * x for x in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]


def _interleaved(axes: list[Column]) -> Column:
    """The low CURVE_BITS bits of whole numbers in turn, as one."""

    def bit(m: Column, b: Column) -> Column:
        for i, v in enumerate(axes):
            m = m + F.call_function("shiftleft", F.call_function("shiftright", v, b).bitwiseAND(1), 3 * b + i)
        return m

    return F.aggregate(F.sequence(F.lit(0), F.lit(CURVE_BITS - 1)), F.lit(0).cast("long"), bit)


def _square(p: list[Column], q: list[Column]) -> Column:
    return sum(((a - b) * (a - b) for a, b in zip(p[1:], q[1:], strict=True)), (p[0] - q[0]) * (p[0] - q[0]))


def _point_index(points: DataFrame, keys: list[str], leaf: int, fan: int) -> list[DataFrame]:
    """Levels of an index over each key's points, leaves first: keys, node, kids; the leaves also have `leaf_id`. The last
    has one node for each key.

    Points stand along a space-filling curve, numbered by prefix sums over ranges of it; every `leaf` in a row of a key are
    a leaf and every `fan` nodes a node above, so no node ever holds more, however near to each other points are, and
    the longest route alone decides the number of levels. A kid is a node's box, one of its points, its number, and a
    leaf's id; a leaf's kids are its points.
    """
    axes = ["_x", "_y", "_z"]
    on = dict(zip(axes, _on_globe(F.col("lat"), F.col("lon")), strict=True))
    scaled = [F.floor((v + geo.EARTH_RADIUS_M) / (2.0 * geo.EARTH_RADIUS_M + 1) * float(1 << 2 * CURVE_BITS)).cast("long") for v in on.values()]
    rough, fine = _interleaved([F.shiftright(v, CURVE_BITS) for v in scaled]), _interleaved([v.bitwiseAND((1 << CURVE_BITS) - 1) for v in scaled])
    lined = points.withColumns(on | {"_rough": rough, "_fine": fine, "_one": F.lit(1)})
    order = [F.col(k) for k in keys] + [F.col("_rough"), F.col("_fine"), F.col("seq")]
    placed = running_totals(lined, order, "_one", "_before", "_place")
    firsts = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    placed = placed.join(firsts, keys).withColumn("node", F.expr(f"(_place - _first) div {leaf}"))
    placed = placed.withColumn("leaf_id", (F.col("_first") + F.col("node") * leaf) * 2 + 1)
    boxes = [f(a).alias(f"{n}{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]
    kid = F.struct("lat", "lon", "seq", "to_end_m")
    level = cut(placed.groupBy(*keys, "node", "leaf_id").agg(F.collect_list(kid).alias("kids"), *boxes, F.first(F.struct(*axes)).alias("mid")))
    levels = [level.select(*keys, "node", "leaf_id", "kids")]
    while len(levels) == 1 or level.groupBy(*keys).count().where("count > 1").limit(1).count():
        kid = F.struct("node", "leaf_id", "mid", *[f"{n}{a}" for a in axes for n in ("lo", "hi")])
        boxes = [f(f"{n}{a}").alias(f"{n}{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]
        level = cut(level.groupBy(*keys, F.expr(f"node div {fan}").alias("_up")).agg(
            F.collect_list(kid).alias("kids"), *boxes, F.first("mid").alias("mid"), F.first("leaf_id").alias("leaf_id")
        ).withColumnRenamed("_up", "node"))
        levels.append(level.select(*keys, "node", "kids"))
    return levels


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by leaf and part, points (row null) before positions: each position with the points of the leaf that
    are as near as the nearest, with room for rounding. A leaf's points are all that is held."""
    held, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("leaf_id", "part", "asked", "lat", "lon")}
        a, b = np.radians(whole["lat"]), np.radians(whole["lon"])
        place = geo.EARTH_RADIUS_M * np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
        starts = np.flatnonzero(np.r_[True, np.any([whole[n][1:] != whole[n][:-1] for n in ("leaf_id", "part", "asked")], axis=0)])
        found = []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            group = int(whole["leaf_id"][i]), int(whole["part"][i])
            if not whole["asked"][i]:
                kept = [*(kept if group == held else []), (place[:, i:j], batch.slice(i, j - i).select(["lat", "lon", "seq", "rest"]))]
                held = group
                continue
            if len(kept) > 1:
                kept = [(np.concatenate([x for x, _ in kept], 1), pa.Table.from_batches([x for _, x in kept]).combine_chunks().to_batches()[0])]
            (points, columns), = kept
            for k in range(i, j, AT_ONCE):
                some = place[:, k : min(j, k + AT_ONCE)]
                away = np.sqrt(sum((p[:, None] - q[None, :]) ** 2 for p, q in zip(some, points, strict=True)))
                at, near = np.nonzero(away <= away.min(1)[:, None] * (1 + 1e-9) + 1e-6)
                own = batch.select(["row", "lat", "lon"]).take(pa.array(at + k))
                found.append(pa.RecordBatch.from_arrays([*own.columns, *columns.take(pa.array(near)).columns], ["row", "lat", "lon", "to_lat", "to_lon", "seq", "rest"]))
        yield from found


def _searched(met: DataFrame, points: DataFrame) -> DataFrame:
    """met: row, lat, lon, leaf_id; points: leaf_id, lat, lon, seq, to_end_m. The nearest point of each row: row, d, seq, rest."""
    met = cut(met)
    parts = met.groupBy("leaf_id").count().select("leaf_id", F.expr(f"cast(count div {ASKED} + 1 as int)").alias("_parts"))
    many = F.broadcast(cut(parts.where("_parts > 1")))  # at most one for each ASKED positions
    seq = points.schema["seq"].dataType
    asked = met.join(many, "leaf_id", "left").select(
        "leaf_id", F.pmod(F.xxhash64("row"), F.coalesce("_parts", F.lit(1))).cast("int").alias("part"), F.lit(True).alias("asked"), "row", "lat", "lon",
        F.lit(None).cast(seq).alias("seq"), F.lit(None).cast("double").alias("rest"),
    )
    known = points.join(many, "leaf_id", "left").select(
        "leaf_id", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("part"), F.lit(False).alias("asked"),
        F.lit(None).cast("long").alias("row"), "lat", "lon", "seq", F.col("to_end_m").alias("rest"),
    )
    # Few bytes and much work: dealt to a given number of partitions, they aren't coalesced by size.
    spread = asked.unionByName(known).repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "leaf_id", "part")
    pairs = spread.sortWithinPartitions("leaf_id", "part", "asked").mapInArrow(
        _compared, f"row long, lat double, lon double, to_lat double, to_lon double, seq {seq.simpleString()}, rest double"
    )
    away = F.struct(geo.haversine_atan2_m(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")).alias("d"), "seq", "rest")
    return pairs.groupBy("row").agg(F.min(away).alias("_n")).select("row", "_n.*")


def nearest_points(at: DataFrame, points: DataFrame, keys: list[str], row: str, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """For each position (keys, `row`, lat, lon; `row` numbers the positions) of a key that has points (keys, seq, lat,
    lon, to_end_m): row, d, seq, rest of the nearest point by great-circle metres, the first on a tie.

    A key of at most `leaf` points is one leaf. A position of a longer one goes down its index: of a node's kids it follows
    those whose box isn't farther than some point that it knows, so it meets a few leaves of bounded size wherever the
    points lie and however dense they are. In a leaf it is compared with every point, over Arrow batches. Straight
    distances prune, with room for rounding; distances along the ground decide. Where several points are at one place the
    first counts. Places with a null take no part.
    """
    placed = "lat is not null and lon is not null"
    one = points.where(placed).groupBy(*keys, "lat", "lon").agg(F.min(F.struct("seq", "to_end_m")).alias("_p"))
    one = one.select(*keys, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "_p.*")
    sizes = cut(one.groupBy(*keys).agg(F.count(F.lit(1)).alias("_points")).withColumn("leaf_id", F.monotonically_increasing_id() * 2))
    held = one.join(sizes, keys)
    asked = at.where(placed).select(*keys, F.col(row).cast("long").alias("row"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).join(sizes, keys)
    few = f"_points <= {leaf}"
    leaves, met = held.where(few).select("leaf_id", "lat", "lon", "seq", "to_end_m"), asked.where(few).select("row", "lat", "lon", "leaf_id")
    if sizes.where(f"not {few}").limit(1).count():
        lowest, *levels = _point_index(held.where(f"not {few}").drop("_points", "leaf_id"), keys, leaf, fan)
        leaves, met = leaves.unionByName(lowest.select("leaf_id", F.inline("kids"))), met.unionByName(_descended(asked.where(f"not {few}").drop("_points", "leaf_id"), levels, keys))
    return _searched(met, leaves).withColumnRenamed("row", row)


def _descended(asked: DataFrame, levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """The leaves that each position must see: row, lat, lon, leaf_id."""
    levels = [F.broadcast(level) if level.count() <= FEW_NODES else level for level in levels]
    x, y, z = _on_globe(F.col("lat"), F.col("lon"))
    spread = asked.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
    met = spread.select(*keys, "row", "lat", "lon", x.alias("_px"), y.alias("_py"), z.alias("_pz"), F.lit(float("inf")).alias("_bound"), F.lit(0).cast("long").alias("node"))
    p = [F.col(f"_p{a}") for a in "xyz"]
    for level in reversed(levels):
        met = met.join(level, [*keys, "node"])
        reach = F.array_min(F.transform("kids", lambda k: _square(p, [k["mid"][f"_{a}"] for a in "xyz"])))
        met = met.withColumn("_bound", F.least("_bound", reach))
        outside = lambda k: [F.least(F.greatest(v, k[f"lo_{a}"]), k[f"hi_{a}"]) for v, a in zip(p, "xyz", strict=True)]
        near = F.filter("kids", lambda k: _square(p, outside(k)) <= F.col("_bound") * (1 + 1e-9) + 1e-6)
        met = met.withColumn("_kid", F.explode(F.transform(near, lambda k: F.struct(k["node"].alias("node"), k["leaf_id"].alias("leaf_id")))))
        met = met.drop("kids", "leaf_id", "node").select("*", "_kid.*").drop("_kid")
    return met.select("row", "lat", "lon", "leaf_id")


def route_progress(at: DataFrame, points: DataFrame, key: str = "route_id", total: str | None = None) -> DataFrame:
    """Remaining metres, whole percent done and their texts for positions (lat, lon) on the route of their key.

    Counted from the nearest route point (the first on a tie). `total` names a column with the planned length that counts
    instead of the measured one where positive. No points: nothing remains and the texts are dashes; no length: done.
    """
    measured = cut(route_lengths(points, key))
    lengths = measured.groupBy(key).agg(F.max("route_m").alias("_length"))
    asked = cut(at.withColumn("_row", F.monotonically_increasing_id()))
    near = nearest_points(asked, measured, [key], "_row").select("_row", F.struct("d", "seq", "rest").alias("_near"))
    rows = asked.join(lengths, key, "left").join(near, "_row", "left")
    length = F.col("_length") if total is None else F.when(F.col(total) > 0, F.col(total)).otherwise(F.col("_length"))
    rows = rows.withColumn("_total", length)
    none, done = F.col("_near").isNull(), F.col("_total") <= 0
    remaining = F.when(none | done, 0.0).otherwise(F.least(F.col("_total"), F.greatest(F.lit(0.0), F.col("_near.d") + F.col("_near.rest"))))
    rows = rows.withColumn("remaining_m", remaining)
    part = ((F.col("_total") - F.col("remaining_m")) / F.col("_total") * 100).cast("int")
    rows = rows.withColumn("percent", F.when(none, 0).when(done, 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), part))))
    rows = rows.withColumn("remaining_text", F.when(none, "--").otherwise(text.distance_text(F.col("remaining_m"))))
    shown = F.when(none, "Progress: --").when(done, "Progress: 100%").otherwise(text.progress_text(F.col("percent"), F.col("remaining_text")))
    return rows.withColumn("progress_text", shown).drop("_row", "_length", "_near", "_total")
