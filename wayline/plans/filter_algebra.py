"""Single filter steps over the event table: prediction and each kind of update, with the algebra in DuckDB as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import matrix as M
from wayline.functions import quat as Q
from wayline.operators import filter_columns as FC
from wayline.plans import oracles as O
from wayline.plans.common import r
from wayline.sources.events import raw_steps

def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's filter moved on by half a second, with the event's readings."""
    value, k = F.col("value"), F.col("k")
    rows = raw_steps(spark, sf).withColumns({
        "pose": Q.normalize(Q.from_euler_deg(F.col("event_id") * 7 % 170, k * 0.5 - 20, value % 40)),
        "later": Q.normalize(Q.from_euler_deg(F.col("event_id") * 7 % 170 + 4, k * 0.5 - 18, value % 40 + 3)),
        "position": M.vector(value, -value / 2, k / 10), "velocity": M.vector(F.col("true_speed"), F.col("speed_ms") / 4, k / 100),
        "covariance": FC.start_covariance(), "force": M.vector(F.col("accel_x"), F.col("accel_y"), F.col("accel_z")),
        "rate": M.vector(F.col("true_gyro"), 0.01, F.col("gyro_z")),
    })
    rows = rows.select("event_id", "k", "speed_ms", "pose", "later", "position", "velocity", F.col("pose").alias("attitude"), "covariance", "force", "rate")
    return FC.predict(rows, F.lit(0.5), F.col("force"), F.col("rate"))


def _shown() -> list[Column]:
    """Position, velocity, attitude, the covariance's trace and the sum of its entries weighted by place."""
    cells = [r(F.col(part)[i], 5).alias(f"{part[0]}{i}") for part in ("position", "velocity") for i in range(3)]
    cells += [r(F.col(f"attitude.{c}"), 5).alias(f"q{c}") for c in "wxyz"]
    c = F.col("covariance")
    trace = sum((c[i][i] for i in range(1, 9)), c[0][0])
    weights = M.rows(*[M.vector(*[1.0 + 9 * i + j for j in range(9)]) for i in range(9)])
    weighed = F.aggregate(F.zip_with(c, weights, M.dot), F.lit(0.0), lambda t, x: t + x)
    return [*cells, r(trace, 5).alias("trace"), r(weighed, 3).alias("weighed")]


def filter_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's filter after one prediction."""
    return _predicted(spark, sf).select("event_id", *_shown())


def filter_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's filter after a prediction and one update, for each kind of update."""
    rows = _predicted(spark, sf).withColumn("back", Q.inverse(F.col("pose"))).withColumn("relative", Q.multiply(F.col("back"), F.col("later")))
    fix = F.zip_with("position", M.vector(F.col("k") / 20, -1.5, F.col("speed_ms") / 10), lambda a, b: a + b)
    after = {
        "track": FC.hold_to_track(rows), "speed": FC.take_speed(rows, F.col("speed_ms")),
        "turn": FC.take_turn(rows, F.col("relative"), F.col("pose")), "fix": FC.take_position(rows, fix),
    }
    found = [df.select("event_id", F.lit(kind).alias("kind"), *_shown()) for kind, df in after.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


QUERIES = {f.__name__: f for f in (filter_predict, filter_updates)}

#: List algebra of DuckDB: matrices are lists of rows.
_T = lambda m: f"list_transform(range(1, len({m}[1]) + 1), lambda tj: list_transform({m}, lambda tr: tr[tj]))"
_MUL = lambda a, bt: f"list_transform({a}, lambda mr: list_transform({bt}, lambda mc: list_inner_product(mr, mc)))"  # noqa: E731  (bt: b transposed)
_ADD = lambda a, b: f"list_transform(range(1, len({a}) + 1), lambda ai: list_transform(range(1, len({a}[1]) + 1), lambda aj: {a}[ai][aj] + {b}[ai][aj]))"
_SYM = lambda m: f"list_transform(range(1, 10), lambda si: list_transform(range(1, 10), lambda sj: ({m}[si][sj] + {m}[sj][si]) / 2))"
_DIAG = lambda n, v: "[" + ", ".join("[" + ", ".join(f"CAST({v if i == j else 0} AS DOUBLE)" for j in range(n)) + "]" for i in range(n)) + "]"
_ROT = lambda q: f"[[1 - 2 * ({q}[3]^2 + {q}[4]^2), 2 * ({q}[2] * {q}[3] - {q}[1] * {q}[4]), 2 * ({q}[2] * {q}[4] + {q}[1] * {q}[3])], [2 * ({q}[2] * {q}[3] + {q}[1] * {q}[4]), 1 - 2 * ({q}[2]^2 + {q}[4]^2), 2 * ({q}[3] * {q}[4] - {q}[1] * {q}[2])], [2 * ({q}[2] * {q}[4] - {q}[1] * {q}[3]), 2 * ({q}[3] * {q}[4] + {q}[1] * {q}[2]), 1 - 2 * ({q}[2]^2 + {q}[3]^2)]]"
_QMUL = lambda p, q: f"[{p}[1] * {q}[1] - {p}[2] * {q}[2] - {p}[3] * {q}[3] - {p}[4] * {q}[4], {p}[1] * {q}[2] + {p}[2] * {q}[1] + {p}[3] * {q}[4] - {p}[4] * {q}[3], {p}[1] * {q}[3] - {p}[2] * {q}[4] + {p}[3] * {q}[1] + {p}[4] * {q}[2], {p}[1] * {q}[4] + {p}[2] * {q}[3] - {p}[3] * {q}[2] + {p}[4] * {q}[1]]"
_NORM = lambda q: f"list_transform({q}, lambda nx: nx / sqrt(list_inner_product({q}, {q})) * CASE WHEN {q}[1] < 0 THEN -1 ELSE 1 END)"
_EXP = lambda v: f"CASE WHEN list_inner_product({v}, {v}) < 1e-16 THEN [1.0, {v}[1] / 2, {v}[2] / 2, {v}[3] / 2] ELSE list_concat([cos(sqrt(list_inner_product({v}, {v})) / 2)], list_transform({v}, lambda ex: ex * sin(sqrt(list_inner_product({v}, {v})) / 2) / sqrt(list_inner_product({v}, {v})))) END"
_SKEW = lambda v: f"[[0.0, -{v}[3], {v}[2]], [{v}[3], 0.0, -{v}[1]], [-{v}[2], {v}[1], 0.0]]"
_CONJ = lambda q: f"[{q}[1], -{q}[2], -{q}[3], -{q}[4]]"


def _euler_list(yaw: str, pitch: str, roll: str) -> str:
    cy, sy, cp, sp, cr, sr = (f"{f}(radians({a}) / 2)" for a in (yaw, pitch, roll) for f in ("cos", "sin"))
    return f"[{cr} * {cp} * {cy} + {sr} * {sp} * {sy}, {sr} * {cp} * {cy} - {cr} * {sp} * {sy}, {cr} * {sp} * {cy} + {sr} * {cp} * {sy}, {cr} * {cp} * {sy} - {sr} * {sp} * {cy}]"


def _block(cells: dict[tuple[int, int], str], diagonal: float) -> str:
    """A 9 x 9 list of 3 x 3 blocks; the blocks' text gets the row and column in it as {i} and {j}."""
    cell = lambda i, j: cells[i // 3, j // 3].format(i=i % 3 + 1, j=j % 3 + 1, d=int(i % 3 == j % 3)) if (i // 3, j // 3) in cells else str(diagonal if i == j else 0.0)
    return "[" + ", ".join("[" + ", ".join(f"CAST({cell(i, j)} AS DOUBLE)" for j in range(9)) + "]" for i in range(9)) + "]"


#: Variances written out: 1 m, 0.5 m/s and 2 degrees at the start; 0.2 m/s2 and 0.02 rad/s of noise.
_START = "[" + ", ".join("[" + ", ".join((("1.0", "0.25", "radians(2.0) * radians(2.0)")[i // 3] if i == j else "0.0") + "::DOUBLE" for j in range(9)) + "]" for i in range(9)) + "]"
_TAIL = ", ".join([f"{O.r(f'{n}[{i + 1}]', 5)} AS {n}{i}" for n in "pv" for i in range(3)] + [f"{O.r(f'q[{i + 1}]', 5)} AS q{c}" for i, c in enumerate("wxyz")])
_TAIL += f", {O.r('list_sum(list_transform(range(1, 10), lambda wi: c[wi][wi]))', 5)} AS trace, {O.r('list_sum(list_transform(range(1, 10), lambda wi: list_sum(list_transform(range(1, 10), lambda wj: c[wi][wj] * (1 + (wi - 1) * 9 + wj - 1)))))', 3)} AS weighed"
_PREDICTED = f""", a0 AS (SELECT event_id, CAST(k AS DOUBLE) AS k, speed_ms, [value, -value / 2, k / 10.0] AS p, [true_speed, speed_ms / 4, k / 100.0] AS v,
  {_euler_list("event_id * 7 % 170", "k * 0.5 - 20", "value % 40")} AS q0, {_euler_list("event_id * 7 % 170 + 4", "k * 0.5 - 18", "value % 40 + 3")} AS z0, [accel_x, accel_y, accel_z] AS f, [true_gyro * 0.5, 0.005, gyro_z * 0.5] AS w FROM raw),
a1 AS (SELECT *, {_NORM("q0")} AS q, {_NORM("z0")} AS z FROM a0),
a2 AS (SELECT *, {_ROT("q")} AS m, {_EXP("w")} AS dq FROM a1),
a3 AS (SELECT *, list_transform(m, lambda x: list_inner_product(x, f)) AS u, {_QMUL("q", "dq")} AS q2 FROM a2),
a4 AS (SELECT *, [u[1], u[2], u[3] - 9.80665] AS g, {_SKEW("u")} AS s FROM a3),
a5 AS (SELECT *, {_block({(0, 1): "0.5 * {d}", (0, 2): "-0.125 * s[{i}][{j}]", (1, 2): "-0.5 * s[{i}][{j}]"}, 1.0)} AS st, {_START} AS c0,
  {_block({(0, 0): "0.02 * 0.25 / 3 * {d}", (1, 1): "0.02 * {d}", (2, 2): "0.0002 * {d}", (0, 1): "0.005 * {d}", (1, 0): "0.005 * {d}"}, 0.0)} AS no FROM a4),
a6 AS (SELECT *, {_MUL("st", "c0")} AS sc FROM a5),
a7 AS (SELECT *, {_MUL("sc", "st")} AS scs FROM a6),
a8 AS (SELECT *, {_ADD("scs", "no")} AS c1 FROM a7),
pre AS (SELECT event_id, k, speed_ms, q AS pose, z, list_transform(range(1, 4), lambda i: p[i] + v[i] * 0.5 + g[i] * 0.125) AS p, list_transform(range(1, 4), lambda i: v[i] + g[i] * 0.5) AS v, {_NORM("q2")} AS q, {_SYM("c1")} AS c FROM a8)"""
_ZERO = "[0.0, 0.0, 0.0]"
_UPDATED = f"""{_PREDICTED},
b0 AS (SELECT *, {_ROT("q")} AS m, {_QMUL(_CONJ("pose"), "z")} AS rel, {_SKEW("v")} AS sv FROM pre),
b1 AS (SELECT *, {_T("m")} AS tb, {_QMUL(_CONJ("pose"), "q")} AS since, {_NORM("rel")} AS rel1 FROM b0),
b2 AS (SELECT *, {_MUL("tb", f"({_T('sv')})")} AS lev, list_transform(tb, lambda x: list_inner_product(x, v)) AS bv, {_QMUL(_CONJ("rel1"), "since")} AS off0 FROM b1),
b3 AS (SELECT *, {_NORM("off0")} AS off FROM b2),
b4 AS (SELECT *, sqrt(off[2]^2 + off[3]^2 + off[4]^2) AS ln FROM b3),
b5 AS (SELECT *, list_transform(off[2:4], lambda x: -x * CASE WHEN ln < 1e-8 THEN 2.0 ELSE 2 * atan2(ln, off[1]) / ln END) AS rv FROM b4),
b6 AS (
  SELECT event_id, p, v, q, c, 'track' AS kind, [-bv[2], -bv[3]] AS y, [list_concat({_ZERO}, tb[2], lev[2]), list_concat({_ZERO}, tb[3], lev[3])] AS h, {_DIAG(2, "0.0025")} AS n FROM b5 UNION ALL
  SELECT event_id, p, v, q, c, 'speed', [speed_ms - bv[1]], [list_concat({_ZERO}, tb[1], lev[1])], {_DIAG(1, "0.0625")} FROM b5 UNION ALL
  SELECT event_id, p, v, q, c, 'turn', list_transform(m, lambda x: list_inner_product(x, rv)), [list_concat({_ZERO}, {_ZERO}, x) FOR x IN {_DIAG(3, "1")}], {_DIAG(3, "radians(5.0) * radians(5.0)")} FROM b5 UNION ALL
  SELECT event_id, p, v, q, c, 'fix', [k / 20, -1.5, speed_ms / 10], [list_concat(x, {_ZERO}, {_ZERO}) FOR x IN {_DIAG(3, "1")}], {_DIAG(3, "1.0")} FROM b5),
b7 AS (SELECT *, {_MUL("c", "h")} AS ac FROM b6),
b8 AS (SELECT *, {_MUL("h", f"({_T('ac')})")} AS hs FROM b7),
b9 AS (SELECT *, {_ADD("hs", "n")} AS s, len(n) AS z FROM b8),
c0 AS (SELECT *, CASE z WHEN 1 THEN s[1][1] WHEN 2 THEN s[1][1] * s[2][2] - s[1][2] * s[2][1] ELSE
  s[1][1] * (s[2][2] * s[3][3] - s[2][3] * s[3][2]) - s[1][2] * (s[2][1] * s[3][3] - s[2][3] * s[3][1]) + s[1][3] * (s[2][1] * s[3][2] - s[2][2] * s[3][1]) END AS d FROM b9),
c1 AS (SELECT *, CASE z WHEN 1 THEN [[1 / d]] WHEN 2 THEN [[s[2][2] / d, -s[1][2] / d], [-s[2][1] / d, s[1][1] / d]] ELSE [
  [(s[2][2] * s[3][3] - s[2][3] * s[3][2]) / d, (s[1][3] * s[3][2] - s[1][2] * s[3][3]) / d, (s[1][2] * s[2][3] - s[1][3] * s[2][2]) / d],
  [(s[2][3] * s[3][1] - s[2][1] * s[3][3]) / d, (s[1][1] * s[3][3] - s[1][3] * s[3][1]) / d, (s[1][3] * s[2][1] - s[1][1] * s[2][3]) / d],
  [(s[2][1] * s[3][2] - s[2][2] * s[3][1]) / d, (s[1][2] * s[3][1] - s[1][1] * s[3][2]) / d, (s[1][1] * s[2][2] - s[1][2] * s[2][1]) / d]] END AS si FROM c0),
c2 AS (SELECT *, {_MUL("ac", f"({_T('si')})")} AS kk FROM c1),
c3 AS (SELECT *, list_transform(kk, lambda x: list_inner_product(x, y)) AS e, {_MUL("kk", f"({_T('h')})")} AS kh, {_MUL("kk", "n")} AS kn FROM c2),
c4 AS (SELECT *, list_transform(range(1, 10), lambda i: list_transform(range(1, 10), lambda j: CASE WHEN i = j THEN 1 ELSE 0 END - kh[i][j])) AS ke, {_MUL("kn", "kk")} AS knk FROM c3),
c5 AS (SELECT *, {_MUL("ke", "c")} AS kc FROM c4),
c6 AS (SELECT *, {_MUL("kc", "ke")} AS kck, e[7:9] AS ea FROM c5),
c7 AS (SELECT *, {_ADD("kck", "knk")} AS cc, {_EXP("ea")} AS de FROM c6),
c8 AS (SELECT event_id, kind, list_transform(range(1, 4), lambda i: p[i] + e[i]) AS p, list_transform(range(1, 4), lambda i: v[i] + e[i + 3]) AS v, {_QMUL("de", "q")} AS q3, {_SYM("cc")} AS c FROM c7),
post AS (SELECT event_id, kind, p, v, {_NORM("q3")} AS q, c FROM c8)"""
ORACLES = {
    "filter_predict": O.sql(f"{_PREDICTED} SELECT event_id, {_TAIL} FROM pre"),
    "filter_updates": O.sql(f"{_UPDATED} SELECT event_id, kind, {_TAIL} FROM post"),
}
