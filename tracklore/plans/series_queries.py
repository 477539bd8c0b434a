"""Queries on series, pairs of entities, rules, roles and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bouts as B
from ..operators import geometry as G
from ..operators import metrics as M
from ..operators import models as L
from ..operators import rules as R
from ..operators import series as S
from ..operators.lineage import shared_path
from ..sources.archives import read_archives, write_archives
from .base import GAPPY, SERIES, TAU, TRACKS, gappy, merged_sql, pmod, runs_sql, series, signed, table, tracks

KEY = ["user_id"]
ID = ["user_id", "frame"]
#: Fixed model over vectors: (dim, threshold, direction, alpha); dimension 70 does not exist.
STUMPS = [L.Stump(1, 0.05, 1, 0.8), L.Stump(7, -0.02, -1, 0.5), L.Stump(20, 0.0, 1, 0.3), L.Stump(64, 0.1, -1, 0.4), L.Stump(70, 0.0, 1, 9.0)]
SPECS = [
    {"perframe": "value", "stat": "mean", "radius": 2},
    {"perframe": "value", "stat": "max", "trans": "flip", "radius": 1, "offset": 1},
    {"perframe": "speed", "stat": "mean"},
    {"perframe": "value", "stat": "diff_neighbor_mean", "radius": 3},
    {"feature": "Wing Spread", "trans": "relative", "stat": "mean", "radius": 2},
    {"stat": "min", "radius": 1, "trans_types": "10"},
]
FRAME_STUMPS = [
    L.Stump(1, 45.0, -1, 1.0), L.Stump(2, -20.0, 1, 0.6), L.Stump(3, 0.5, 1, 0.2), L.Stump(4, 0.0, -1, 0.7), L.Stump(5, 0.597, -1, 0.5), L.Stump(6, 0.403, 1, 0.3),
]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*ID, *(F.round(n, 5).alias(n) for n in names))


def fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.fill_linear(gappy(spark, sf_dir), KEY, "x", "filled"), "filled")


def gap_interpolate(spark, sf_dir):
    """Short runs of errors: values on a line, angles along the shorter arc, a zeroed column."""
    df = gappy(spark, sf_dir).withColumn("z", F.col("x"))
    return _rounded(S.interpolate_gaps(df, KEY, "x", ["x"], ["h"], ["z"], most=2), "x", "h", "z")


def score_gaussian(spark, sf_dir):
    return _rounded(S.gaussian(series(spark, sf_dir), KEY, "value", "smooth", 1.5), "smooth")


def smooth_positions(spark, sf_dir):
    return _rounded(S.smooth(gappy(spark, sf_dir), KEY, "x", "smooth", 1.5), "smooth")


def score_smooth_rethreshold(spark, sf_dir):
    """Bouts of a 0/1 score smoothed and cut at 0.3."""
    df = series(spark, sf_dir).withColumn("hit", (F.col("value") > 40).cast("double"))
    return B.from_scores(S.gaussian(df, KEY, "hit", "level", 1.0), KEY, F.round("level", 9) > 0.3, 2, 2)


def rolling_std(spark, sf_dir):
    s = series(spark, sf_dir)
    return _rounded(s.withColumn("sd", S.rolling_std("value", S.over(KEY), 6)), "sd")


def window_stats(spark, sf_dir):
    w = S.over(KEY)
    stats = {"mean": "w_mean", "min": "w_min", "max": "w_max", "std": "w_std", "diff_neighbor_mean": "d_mean", "diff_neighbor_min": "d_min", "diff_neighbor_max": "d_max", "zscore_neighbors": "z"}
    df = gappy(spark, sf_dir).withColumns({out: S.window_stat("x", w, stat, 3, 1) for stat, out in stats.items()})
    return _rounded(df, *stats.values())


def window_change(spark, sf_dir):
    return _rounded(series(spark, sf_dir).withColumn("change", S.window_stat("value", S.over(KEY), "change", 3)), "change")


def percentile_rank(spark, sf_dir):
    return _rounded(S.percentile_rank(gappy(spark, sf_dir), KEY, "x", "rank"), "rank")


def gradient(spark, sf_dir):
    return _rounded(gappy(spark, sf_dir).withColumn("slope", S.gradient("x", S.over(KEY))), "slope")


def diff_wrap(spark, sf_dir):
    return _rounded(gappy(spark, sf_dir).withColumn("turn", S.turn("h", S.over(KEY))), "turn")


def head_tail_scan(spark, sf_dir):
    df = gappy(spark, sf_dir).withColumns({"motion": F.pmod(F.col("value") * 3, F.lit(TAU)), "fast": F.col("value") > 30})
    return _rounded(G.resolve_heading(df, KEY, "h", "motion", "fast", "heading"), "heading")


def partner_features(spark, sf_dir):
    keys = ["video_id"]
    df = G.with_partner(tracks(spark, sf_dir).repartition(*keys), keys, "fly", ["x", "y", "theta", "a", "b"])
    found = df.select(
        "video_id", "fly", "frame", F.round(G.centre_distance(), 4).alias("c2c"), F.round(G.facing_angle(), 4).alias("facing"),
        F.round(G.tip_distance(1), 4).alias("n2e"), F.round(G.tip_distance(-1), 4).alias("t2e"), G.overlaps().alias("overlap"),
    )
    return found.where("c2c is not null")


def component_velocities(spark, sf_dir):
    df = G.with_velocity(tracks(spark, sf_dir), ["video_id", "fly"], 30.0)
    return df.select("video_id", "fly", "frame", *(F.round(c, 4).alias(c) for c in ("vel", "v_par", "v_perp", "ang_vel")))


def rules_courtship(spark, sf_dir):
    """All rules over pairs of users, from tracks to bouts."""
    features = G.social_features(tracks(spark, sf_dir), ["video_id"], "fly", 3.0)
    ready = R.in_units(features, ["video_id", "fly"], 3.0, 1.5)
    return R.behaviours(ready, ["video_id", "fly"], 3.0, {"wing_ext_angle_deg": 40.0, "merge_gap_s": 0.5})


def role_inference(spark, sf_dir):
    s = series(spark, sf_dir)
    fly = F.pmod("user_id", F.lit(2))
    aggs = []
    for k in (0, 1):
        own = fly == k
        aggs += [
            F.coalesce(F.sum(F.when(own & (F.col("event_type") == "view"), 1)), F.lit(0)).alias(f"w{k}"),
            F.median(F.when(own, F.col("value"))).alias(f"a{k}"),
            F.count(F.when(own, 1)).alias(f"n{k}"),
            *(F.count(F.when(own & (F.col("event_type") == e), 1)).alias(f"c_{b}_{k}") for b, e in (("following", "click"), ("circling", "signup"), ("attempted", "purchase"))),
        ]
    pairs = s.groupBy(F.floor(F.col("user_id") / 2).alias("video_id")).agg(*aggs)
    return M.infer_roles(pairs).select("video_id", "score_0", "score_1", "is_male_0", "is_male_1")


def calibration_median(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_suppkey")
    sized = items.withColumn("a", F.when(F.col("l_suppkey") % 7 != 0, F.col("l_quantity") - 3))
    return M.px_per_mm(sized, ["l_returnflag"]).withColumn("px_per_mm", F.round("px_per_mm", 6))


def calibration_mean(spark, sf_dir):
    return calibration_median(spark, sf_dir).agg(F.round(F.coalesce(F.avg("px_per_mm"), F.lit(15.0)), 6).alias("px_per_mm"))


def boosted_stumps(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.round(L.array_score(STUMPS, F.col("embedding").cast("array<double>")), 6).alias("score"))


def boosted_bouts(spark, sf_dir):
    """Scores of features named in full, by a synonym, not at all, and unknown; two of them ranked within their series."""
    df = L.window_features(series(spark, sf_dir).withColumn("wing_angle", F.col("value") / 64 - 0.5), KEY, SPECS)
    # Features are compared at nine decimals, below which interpolated percentiles are not exact.
    scored = df.withColumn("score", F.round(L.boosted_score(FRAME_STUMPS, [F.round(f"f{k}", 9) for k in range(1, len(SPECS) + 1)]), 6))
    return L.boosted_bouts(scored, KEY, "score")


def adaptive_speed(spark, sf_dir):
    """Of each user: max(0.3, a fifth of the median of positive speeds), 0.5 without any."""
    speed = F.abs(S.gradient("x", S.over(KEY)))
    s = gappy(spark, sf_dir).withColumn("speed", speed)
    level = F.greatest(F.lit(0.3), 0.2 * F.median(F.when(F.col("speed") > 0, F.col("speed"))))
    none = F.count(F.when(F.col("speed") > 0, 1)) == 0
    return s.groupBy("user_id").agg(F.round(F.when(none, 0.5).otherwise(level), 6).alias("threshold"))


def running_median(spark, sf_dir):
    """Median of the last 200 values of each user."""
    w = S.over(KEY).rowsBetween(-199, 0)
    return _rounded(series(spark, sf_dir).withColumn("med", F.percentile("value", F.lit(0.5)).over(w)), "med")


def _gauss_sql(sigma: float, source: str, value: str) -> str:
    """CTE z: (user_id, frame, v), the Gaussian of a series without gaps, mirrored at its ends."""
    w = ", ".join(f"({k - len(x) // 2}, {v!r})" for x in [S.gaussian_weights(sigma)] for k, v in enumerate(x))
    return f"""wt(k, w) AS (VALUES {w}), nn AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id),
q AS (SELECT s.user_id, s.frame, wt.k, wt.w, ((s.frame + wt.k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM s JOIN nn USING (user_id) CROSS JOIN wt),
z AS (SELECT q.user_id, q.frame, sum(q.w * y.{value} ORDER BY q.k) AS v FROM q JOIN {source} y ON y.user_id = q.user_id AND y.frame = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY 1, 2)"""


_NEAR = """nb AS (SELECT *,
  last_value(x IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS pf, last_value(h IGNORE NULLS) OVER b AS ph,
  first_value(x IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS nf, first_value(h IGNORE NULLS) OVER a AS nh FROM g
  WINDOW b AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT user_id, frame, x, coalesce(x, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (frame - pf) / (nf - pf) END) AS filled FROM nb)"""
_W = "(PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING)"
_W_ORDER = "(PARTITION BY user_id ORDER BY frame)"


def _grad_sql(v: str) -> str:
    return f"""CASE WHEN lag(1) OVER w IS NULL AND lead(1) OVER w IS NULL THEN 0.0 WHEN lag(1) OVER w IS NULL THEN lead({v}) OVER w - {v}
WHEN lead(1) OVER w IS NULL THEN {v} - lag({v}) OVER w ELSE (lead({v}) OVER w - lag({v}) OVER w) / 2 END"""


_PARTNER = f"""{TRACKS}, p AS (SELECT t.*, o.x AS px, o.y AS py, o.theta AS pt, o.a AS pa, o.b AS pb FROM t JOIN t o ON o.video_id = t.video_id AND o.frame = t.frame AND o.fly = 1 - t.fly)"""


def _tip_sql(sign: str) -> str:
    dx, dy = f"(x {sign} a * cos(theta) - px)", f"(y {sign} a * sin(theta) - py)"
    ang = f"(atan2({dy}, {dx}) - pt)"
    return f"greatest(sqrt({dx} * {dx} + {dy} * {dy}) - pa * pb / sqrt(power(pb * cos({ang}), 2) + power(pa * sin({ang}), 2) + 1e-10), 0.0)"


_VOTES = " + ".join(
    f"(CASE WHEN CAST(embedding[{s.dim}] AS DOUBLE) < {s.thr} THEN {s.direction * s.alpha} ELSE {-s.direction * s.alpha} END)" for s in STUMPS if s.dim <= 64
)
_FRAME_VOTES = " + ".join(f"(CASE WHEN round(f{s.dim}, 9) < {s.thr} THEN {s.direction * s.alpha} ELSE {-s.direction * s.alpha} END)" for s in FRAME_STUMPS)
_ISLANDS = "SELECT user_id, min(frame) AS start, max(frame) AS \"end\" FROM (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS grp FROM on_rows) GROUP BY user_id, grp"

def track_archives(spark, sf_dir):
    """Tracks of pairs of users written as one NumPy archive a chamber, and read back."""
    path = shared_path(spark, "tracks")
    known = F.when(F.col("frame") % 9 > 0, F.col("x"))
    rows = tracks(spark, sf_dir).select(
        F.concat(F.lit("run"), (F.col("video_id") % 4).cast("string")).alias("run"), F.col("video_id").cast("int").alias("chamber"), F.lit(25.0).alias("fps"),
        "fly", "frame", known.alias("x"), "y", "a", (F.col("frame") % 5 == 0).alias("overlap"),
    )
    write_archives(rows, path)
    back = read_archives(spark, path, ["run", "chamber", "fly", "frame", "x", "y", "a", "overlap", "fps"])
    sums = back.where("y is not null").groupBy("run", "chamber", "fly").agg(F.count("*").alias("n"), F.count("x").alias("known"), F.sum("frame").alias("frames"), F.max("fps").alias("fps"), *(F.sum(c).alias(c) for c in ("x", "y", "a")))
    return sums.withColumns({c: F.round(c, 5) for c in ("x", "y", "a")})


_RULED = ["WingExt", "Copulation", "Attempted_Copulation", "Following", "Circling"]


def _courtship_sql() -> str:
    """Features, rules, smoothing, bouts, priorities and their union, rule by rule; remainders of 1.6 are exact, as in 2 ** -52."""
    exact = TRACKS.replace("fmod(value, 1.6)", "(CAST(value * 4503599627370496 AS BIGINT) % 7205759403792794) / 4503599627370496.0")
    scores = [
        "wing_angle > radians(40.0)", "c2c < 3.0 AND vel < 0.5 AND sd < 1.0", "n2e < 1.0 AND vel > 0.5",
        "v_par > 1.0 AND abs(facing) < radians(60.0) AND c2c > 1.5 AND c2c < 10.0", "abs(v_perp) > 1.5 AND c2c < 10.0 AND abs(facing) > radians(45.0) AND abs(facing) < radians(135.0)",
    ]
    smooth = lambda name, source, value, more="": f"{name} AS (SELECT q.user_id{more}, q.frame, sum(q.w * y.{value} ORDER BY q.k) AS v FROM q JOIN {source} y ON y.user_id = q.user_id AND y.frame = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL)"
    long = "e - s + 1 >= CASE b WHEN 1 THEN 15 WHEN 2 THEN 0 ELSE 1 END"
    return f"""WITH {exact}, u AS (SELECT t.video_id * 2 + t.fly AS user_id, t.*, o.x AS px, o.y AS py, o.theta AS pt, o.a AS pa, o.b AS pb FROM t LEFT JOIN t o ON o.video_id = t.video_id AND o.frame = t.frame AND o.fly = 1 - t.fly),
{_gauss_sql(1.0, 'u', 'x')}, {smooth('zy', 'u', 'y')},
v AS (SELECT u.*, z.v AS sx, zy.v AS sy FROM u JOIN z USING (user_id, frame) JOIN zy USING (user_id, frame)),
d AS (SELECT *, {_grad_sql('sx')} AS vx, {_grad_sql('sy')} AS vy FROM v WINDOW w AS {_W_ORDER}),
f AS (SELECT user_id, frame, wing_angle, sqrt((px - x) * (px - x) + (py - y) * (py - y)) / 1.5 AS c2c, CASE WHEN px IS NOT NULL THEN {_tip_sql('+')} END / 1.5 AS n2e, {signed('atan2(py - y, px - x) - theta')} AS facing,
sqrt(vx * vx + vy * vy) / 1.5 * 3 AS vel, (vx * cos(theta) + vy * sin(theta)) / 1.5 * 3 AS v_par, (-vx * sin(theta) + vy * cos(theta)) / 1.5 * 3 AS v_perp, coalesce(sqrt((px - x) * (px - x) + (py - y) * (py - y)) < a + pa, FALSE) AS overlap FROM d),
g AS (SELECT *, coalesce(stddev_samp(c2c) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 0) AS sd FROM f),
sc AS ({' UNION ALL '.join(f"SELECT user_id, {b} AS b, frame, CASE WHEN coalesce({c}, FALSE) AND NOT overlap THEN 1.0::DOUBLE ELSE 0 END AS score FROM g" for b, c in enumerate(scores))}),
{smooth('zs', 'sc', 'score', ', y.b')}, {runs_sql('zs', 'user_id, b', 'v > 0.3', 'r0')}, {merged_sql('r0', 'user_id, b', 1, 'r1', long)},
fr AS (SELECT *, unnest(range(s, e + 1)) AS frame FROM r1 WHERE {long}),
kp AS (SELECT DISTINCT user_id, b, s, e FROM fr WHERE b = 0 OR NOT EXISTS (SELECT 1 FROM fr l WHERE l.user_id = fr.user_id AND l.frame = fr.frame AND l.b > 0 AND l.b < fr.b)),
{merged_sql('kp', 'user_id', 1, 'c1')}, {merged_sql('c1', 'user_id', 9, 'c2', 'e - s + 1 >= 1')}
SELECT user_id // 2 AS video_id, CAST(user_id % 2 AS INT) AS fly, ({_RULED})[b + 1] AS behavior, s AS start, e AS "end" FROM kp
UNION ALL SELECT user_id // 2, CAST(user_id % 2 AS INT), 'Courtship', s, e FROM c2 WHERE e - s + 1 >= 1"""


QUERIES = {
    "fill_linear": (fill_linear, f"WITH {GAPPY}, {_NEAR} SELECT user_id, frame, round(filled, 5) AS filled FROM fl"),
    "gap_interpolate": (
        gap_interpolate,
        f"""WITH {GAPPY}, {_NEAR}, k AS (SELECT *, x IS NULL AND pf IS NOT NULL AND nf IS NOT NULL AND nf - pf - 1 <= 2 AS gap, (frame - pf) / CAST(nf - pf AS DOUBLE) AS part FROM nb)
SELECT user_id, frame, round(CASE WHEN gap THEN pv + part * (nv - pv) ELSE x END, 5) AS x,
round(CASE WHEN gap THEN {pmod(f"ph + part * {signed('nh - ph')}")} ELSE h END, 5) AS h, round(CASE WHEN gap THEN 0.0 ELSE x END, 5) AS z FROM k""",
    ),
    "score_gaussian": (score_gaussian, f"WITH {SERIES}, {_gauss_sql(1.5, 's', 'value')} SELECT user_id, frame, round(v, 5) AS smooth FROM z"),
    "smooth_positions": (
        smooth_positions,
        f"WITH {GAPPY}, {_NEAR}, {_gauss_sql(1.5, 'fl', 'filled')} SELECT z.user_id, z.frame, round(CASE WHEN fl.x IS NOT NULL THEN z.v END, 5) AS smooth FROM z JOIN fl USING (user_id, frame)",
    ),
    "score_smooth_rethreshold": (
        score_smooth_rethreshold,
        f"""WITH {SERIES}, hits AS (SELECT user_id, frame, CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END AS hit FROM s), {_gauss_sql(1.0, 'hits', 'hit')},
on_rows AS (SELECT user_id, frame FROM z WHERE round(v, 9) > 0.3), r AS (SELECT * FROM ({_ISLANDS}) WHERE "end" - start + 1 >= 2),
m0 AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY user_id ORDER BY start) <= 2 THEN 0 ELSE 1 END AS new FROM r),
m1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS sid FROM m0)
SELECT user_id, min(start) AS start, max("end") AS "end" FROM m1 GROUP BY user_id, sid HAVING max("end") - min(start) + 1 >= 2""",
    ),
    "rolling_std": (rolling_std, f"WITH {SERIES} SELECT user_id, frame, round(coalesce(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 0), 5) AS sd FROM s"),
    "window_stats": (
        window_stats,
        f"""WITH {GAPPY}, k AS (SELECT *, avg(x) OVER w AS m, min(x) OVER w AS lo, max(x) OVER w AS hi, stddev_pop(x) OVER w AS sd FROM g WINDOW w AS {_W})
SELECT user_id, frame, round(m, 5) AS w_mean, round(lo, 5) AS w_min, round(hi, 5) AS w_max, round(sd, 5) AS w_std, round(x - coalesce(m, 0), 5) AS d_mean,
round(x - coalesce(lo, 0), 5) AS d_min, round(x - coalesce(hi, 0), 5) AS d_max, round((x - coalesce(m, 0)) / CASE WHEN coalesce(sd, 0) > 1e-6 THEN sd ELSE 1 END, 5) AS z FROM k""",
    ),
    "window_change": (
        window_change,
        f"""WITH {SERIES}, n AS (SELECT user_id, max(frame) AS last FROM s GROUP BY user_id), k AS (SELECT s.user_id, s.frame, greatest(s.frame - 3, 0) AS a, least(s.frame + 3, last) AS b FROM s JOIN n USING (user_id)),
j AS (SELECT k.*, avg(y.value) FILTER (WHERE y.frame <= (a + b) // 2) AS m0, avg(y.value) FILTER (WHERE y.frame > (a + b) // 2) AS m1 FROM k JOIN s y ON y.user_id = k.user_id AND y.frame BETWEEN a AND b GROUP BY ALL)
SELECT user_id, frame, round(CASE WHEN a = b THEN 0 ELSE m1 - m0 END, 5) AS change FROM j""",
    ),
    "percentile_rank": (
        percentile_rank,
        f"""WITH {GAPPY}, p AS (SELECT user_id, quantile_cont(x, {[k / 100 for k in range(0, 101, 2)]}) AS bins FROM g GROUP BY user_id)
SELECT user_id, frame, round(CASE WHEN x IS NULL THEN 0 ELSE len(list_filter(bins, lambda b: round(b, 9) <= x)) / 51.0 END, 5) AS rank FROM g JOIN p USING (user_id)""",
    ),
    "gradient": (gradient, f"WITH {GAPPY} SELECT user_id, frame, round({_grad_sql('x')}, 5) AS slope FROM g WINDOW w AS {_W_ORDER}"),
    "diff_wrap": (
        diff_wrap,
        f"WITH {GAPPY} SELECT user_id, frame, round(CASE WHEN lag(1) OVER w IS NULL THEN CASE WHEN h IS NOT NULL THEN 0.0 END ELSE {signed('h - lag(h) OVER w')} END, 5) AS turn FROM g WINDOW w AS {_W_ORDER}",
    ),
    "head_tail_scan": (
        head_tail_scan,
        f"""WITH RECURSIVE {GAPPY}, d AS (SELECT user_id, frame, h, h AS t1, fmod(h + {TAU / 2}, {TAU}) AS t2, fmod(value * 3, {TAU}) AS mo, value > 30 AS fast FROM g),
r AS (SELECT user_id, frame, CASE WHEN h IS NULL THEN NULL WHEN fast THEN CASE WHEN abs({signed('t1 - mo')}) < abs({signed('t2 - mo')}) THEN 0 ELSE 1 END ELSE 0 END AS bit, t1, t2 FROM d WHERE frame = 0
UNION ALL SELECT d.user_id, d.frame, CASE WHEN d.h IS NULL THEN NULL
 WHEN d.fast AND (r.bit IS NULL OR abs(abs({signed('d.t1 - d.mo')}) - abs({signed('d.t2 - d.mo')})) > 0.3) THEN CASE WHEN abs({signed('d.t1 - d.mo')}) < abs({signed('d.t2 - d.mo')}) THEN 0 ELSE 1 END
 WHEN r.bit IS NULL THEN 0
 WHEN abs({signed('d.t1 - (CASE WHEN r.bit = 1 THEN r.t2 ELSE r.t1 END)')}) < abs({signed('d.t2 - (CASE WHEN r.bit = 1 THEN r.t2 ELSE r.t1 END)')}) THEN 0 ELSE 1 END, d.t1, d.t2
FROM r JOIN d ON d.user_id = r.user_id AND d.frame = r.frame + 1)
SELECT user_id, frame, round(CASE WHEN bit = 1 THEN t2 WHEN bit = 0 THEN t1 END, 5) AS heading FROM r""",
    ),
    "partner_features": (
        partner_features,
        f"""WITH {_PARTNER} SELECT video_id, fly, frame, round(sqrt((px - x) * (px - x) + (py - y) * (py - y)), 4) AS c2c, round({signed('atan2(py - y, px - x) - theta')}, 4) AS facing,
round({_tip_sql('+')}, 4) AS n2e, round({_tip_sql('-')}, 4) AS t2e, sqrt((px - x) * (px - x) + (py - y) * (py - y)) < a + pa AS overlap FROM p""",
    ),
    "component_velocities": (
        component_velocities,
        f"""WITH {SERIES}, {TRACKS[TRACKS.index(', t AS') + 2:]}, u AS (SELECT video_id * 2 + fly AS user_id, * EXCLUDE (video_id), video_id FROM t),
{_gauss_sql(1.5, 'u', 'x').replace('z AS', 'zx AS')}, zy AS (SELECT q.user_id, q.frame, sum(q.w * y.y ORDER BY q.k) AS v FROM q JOIN u y ON y.user_id = q.user_id AND y.frame = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY 1, 2),
v AS (SELECT u.user_id, u.video_id, u.fly, u.frame, u.theta, zx.v AS sx, zy.v AS sy FROM u JOIN zx USING (user_id, frame) JOIN zy USING (user_id, frame)),
d AS (SELECT *, {_grad_sql('sx')} AS vx, {_grad_sql('sy')} AS vy, CASE WHEN lag(1) OVER w IS NULL THEN 0.0 ELSE {signed('theta - lag(theta) OVER w')} END * 30 AS tu FROM v WINDOW w AS {_W_ORDER}),
zw AS (SELECT q.user_id, q.frame, sum(q.w * y.tu ORDER BY q.k) AS v FROM q JOIN d y ON y.user_id = q.user_id AND y.frame = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY 1, 2)
SELECT video_id, fly, frame, round(zw.v, 4) AS ang_vel, round(sqrt(vx * vx + vy * vy), 4) AS vel, round(vx * cos(theta) + vy * sin(theta), 4) AS v_par, round(-vx * sin(theta) + vy * cos(theta), 4) AS v_perp FROM d JOIN zw USING (user_id, frame)""".replace(f"{SERIES}, {SERIES}", SERIES),
    ),
    "rules_courtship": (rules_courtship, _courtship_sql()),
    "role_inference": (
        role_inference,
        f"""WITH {SERIES}, k AS (SELECT user_id // 2 AS video_id, {', '.join(f"count(*) FILTER (WHERE user_id % 2 = {k} AND event_type = 'view') AS w{k}, median(value) FILTER (WHERE user_id % 2 = {k}) AS a{k}, count(*) FILTER (WHERE user_id % 2 = {k}) AS n{k}, " + ', '.join(f"count(*) FILTER (WHERE user_id % 2 = {k} AND event_type = '{e}') AS {b}{k}" for b, e in (('f', 'click'), ('c', 'signup'), ('t', 'purchase'))) for k in (0, 1))} FROM s GROUP BY 1),
g AS (SELECT *, CASE WHEN greatest(w0, w1) / nullif(w0 + w1, 0) > 0.7 THEN 2.0 WHEN greatest(w0, w1) / nullif(w0 + w1, 0) > 0.55 THEN 1.0 ELSE 0.0 END AS wing, coalesce(n0 > 50 AND n1 > 50 AND least(a0, a1) / greatest(a0, a1) < 0.85, FALSE) AS sized FROM k),
r AS (SELECT video_id, CASE WHEN w0 > w1 THEN wing ELSE 0 END + CASE WHEN sized AND a0 < a1 THEN 1 ELSE 0 END + 0.5 * ((f0 > 2 * f1)::INT + (c0 > 2 * c1)::INT + (t0 > 2 * t1)::INT) AS s0,
CASE WHEN w0 > w1 THEN 0 ELSE wing END + CASE WHEN sized AND a1 < a0 THEN 1 ELSE 0 END + 0.5 * ((f1 > 2 * f0)::INT + (c1 > 2 * c0)::INT + (t1 > 2 * t0)::INT) AS s1 FROM g)
SELECT video_id, CAST(s0 AS DOUBLE) AS score_0, CAST(s1 AS DOUBLE) AS score_1, s0 > s1 AND s0 >= 1 AS is_male_0, s1 > s0 AND s1 >= 1 AS is_male_1 FROM r""",
    ),
    "calibration_median": (calibration_median, "SELECT l_returnflag, round(median(CASE WHEN l_suppkey % 7 <> 0 AND l_quantity - 3 > 0 THEN l_quantity - 3 END) / 1.25, 6) AS px_per_mm FROM lineitem GROUP BY 1"),
    "calibration_mean": (calibration_mean, "WITH m AS (SELECT round(median(CASE WHEN l_suppkey % 7 <> 0 AND l_quantity - 3 > 0 THEN l_quantity - 3 END) / 1.25, 6) AS p FROM lineitem GROUP BY l_returnflag) SELECT round(coalesce(avg(p), 15.0), 6) AS px_per_mm FROM m"),
    "boosted_stumps": (boosted_stumps, f"SELECT vec_id, CAST(round({_VOTES}, 6) AS DOUBLE) AS score FROM embeddings"),
    "boosted_bouts": (
        boosted_bouts,
        f"""WITH {SERIES}, wa AS (SELECT *, value / 64 - 0.5 AS a FROM s),
bn AS (SELECT user_id, quantile_cont(a, {[k / 100 for k in range(0, 101, 2)]}) AS b1, quantile_cont(abs(a), {[k / 100 for k in range(0, 101, 2)]}) AS b2 FROM wa GROUP BY user_id),
ranked AS (SELECT wa.*, len(list_filter(b1, lambda b: round(b, 9) <= round(a, 9))) / 51.0 AS k1, len(list_filter(b2, lambda b: round(b, 9) <= round(abs(a), 9))) / 51.0 AS k2 FROM wa JOIN bn USING (user_id)),
f AS (SELECT user_id, frame, avg(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f1,
max(-value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS f2, 0.0 AS f3,
value - avg(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS f4,
avg(k1) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f5,
min(k2) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f6 FROM ranked),
on_rows AS (SELECT user_id, frame FROM f WHERE round({_FRAME_VOTES}, 6) > 0) SELECT * FROM ({_ISLANDS}) WHERE "end" - start + 1 >= 3""",
    ),
    "adaptive_speed": (
        adaptive_speed,
        f"""WITH {GAPPY}, v AS (SELECT user_id, abs({_grad_sql('x')}) AS speed FROM g WINDOW w AS {_W_ORDER})
SELECT user_id, round(CASE WHEN count(*) FILTER (WHERE speed > 0) = 0 THEN 0.5 ELSE greatest(0.3, 0.2 * median(speed) FILTER (WHERE speed > 0)) END, 6) AS threshold FROM v GROUP BY 1""",
    ),
    "running_median": (running_median, f"WITH {SERIES} SELECT user_id, frame, round(median(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 5) AS med FROM s"),
    "track_archives": (
        track_archives,
        f"""WITH {TRACKS} SELECT 'run' || video_id % 4 AS run, CAST(video_id AS INT) AS chamber, fly, count(*) AS n, count(*) FILTER (frame % 9 > 0) AS known, sum(frame)::BIGINT AS frames, 25.0::DOUBLE AS fps,
round(sum(x) FILTER (frame % 9 > 0), 5) AS x, round(sum(y), 5) AS y, round(sum(a), 5) AS a FROM t GROUP BY 1, 2, 3""",
    ),
}
