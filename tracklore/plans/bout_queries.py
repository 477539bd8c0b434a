"""Queries on bouts and their measures."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bouts as B
from ..operators import metrics as M
from ..operators.lineage import cut
from ..streaming.online import session_bouts, window_totals
from .base import SERIES, merged_sql, runs_sql, series, table

KEY = ["user_id"]
#: Conditions of a hit, as SQL: columns need a session, which an import does not have.
HIGH, LOW = "value > 40", "value > 30"
#: Event types as behaviours in order of priority; errors have none.
RANKS = {"purchase": 1, "signup": 2, "click": 3, "view": 4}
_RANK_SQL = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 END"


def _bouts(spark, sf_dir):
    return B.from_scores(series(spark, sf_dir), KEY, F.expr(HIGH), 2, 3)


_BOUTS = f"""{SERIES}, {runs_sql("s", "user_id", "value > 40", "r")},
{merged_sql("r", "user_id", 3, "m", "e - s + 1 >= 2")}, b AS (SELECT * FROM m WHERE e - s + 1 >= 2)"""


def bout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user: bouts, their frames, and the first one's start."""
    return _bouts(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n_bouts"), F.sum(M.frames_in()).alias("n_frames"), F.min("start").alias("first_start")
    )


def bouts_islands(spark, sf_dir):
    return B.runs(series(spark, sf_dir), KEY, F.expr(HIGH))


def bouts_min_len(spark, sf_dir):
    return B.from_scores(series(spark, sf_dir), KEY, F.expr(LOW), 3, 0)


def bouts_merge_gap(spark, sf_dir):
    return _bouts(spark, sf_dir)


def bouts_merge_refilter(spark, sf_dir):
    """Long bouts only after near ones are made one."""
    return B.at_least(_bouts(spark, sf_dir), 8)


def _behaviours(spark, sf_dir):
    """Runs within 3 frames of each other, of each event type as a behaviour."""
    s = series(spark, sf_dir).withColumnRenamed("event_type", "behavior").where("value > 20")
    spans = s.select("user_id", "behavior", F.col("frame").alias("start"), (F.col("frame") + 2).alias("end"))
    return B.merged(spans, ["user_id", "behavior"], 1)


_BEHAVIOURS = f"""{SERIES}, spans AS (SELECT user_id, event_type AS behavior, frame AS s, frame + 2 AS e FROM s WHERE value > 20),
{merged_sql("spans", "user_id, behavior", 1, "bh")}"""


def interval_union(spark, sf_dir):
    return B.merged(_behaviours(spark, sf_dir), KEY, 1)


def priority_exclusion(spark, sf_dir):
    ranks = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))
    ranked = _behaviours(spark, sf_dir).withColumn("rank", F.try_element_at(ranks, F.col("behavior")))
    return B.uncovered(ranked, KEY, "rank").select("user_id", "behavior", "start", "end")


def unified_union(spark, sf_dir):
    union = B.at_least(B.merged(_behaviours(spark, sf_dir).where("behavior <> 'error'"), KEY, 1), 4)
    return B.at_least(B.merged(union, KEY, 5), 4)


def _sides(spark, sf_dir):
    """Two sets of spans: of values over 40 and over 30, as predicted and annotated."""
    s = series(spark, sf_dir).repartition("user_id")
    p = B.from_scores(s, KEY, F.expr(HIGH), 1, 3).select("user_id", F.col("start").alias("i"), F.col("start").alias("s"), (F.col("end") + 1).alias("e"))
    r = B.from_scores(s, KEY, F.expr(LOW), 1, 2).select("user_id", F.col("start").alias("j"), F.col("start").alias("rs"), (F.col("end") + 1).alias("re"))
    return p, r


_SIDES = f"""{SERIES}, {runs_sql("s", "user_id", "value > 40", "p0")}, {merged_sql("p0", "user_id", 3, "p1")},
{runs_sql("s", "user_id", "value > 30", "r0")}, {merged_sql("r0", "user_id", 2, "r1")},
pairs AS (
  SELECT p1.user_id, p1.s AS i, r1.s AS j,
         (least(p1.e, r1.e) + 1 - greatest(p1.s, r1.s)) / CAST(greatest(p1.e, r1.e) + 1 - least(p1.s, r1.s) AS DOUBLE) AS iou
  FROM p1 JOIN r1 ON p1.user_id = r1.user_id AND p1.s <= r1.e AND r1.s <= p1.e)"""

#: CTE ``gm`` (user_id, i, j, iou): pairs taken one by one, the best first, unless either side is taken.
_GREEDY = f"""WITH RECURSIVE {_SIDES},
o AS (SELECT user_id, i, j, iou, row_number() OVER (PARTITION BY user_id ORDER BY iou DESC, i DESC, j DESC) AS k FROM pairs WHERE iou >= 0.3),
st AS (SELECT user_id, k, i, j, iou, TRUE AS ok, [i] AS ui, [j] AS uj FROM o WHERE k = 1
UNION ALL SELECT user_id, k, i, j, iou, ok, CASE WHEN ok THEN list_append(ui, i) ELSE ui END, CASE WHEN ok THEN list_append(uj, j) ELSE uj END FROM (
  SELECT o.*, st.ui, st.uj, NOT list_contains(st.ui, o.i) AND NOT list_contains(st.uj, o.j) AS ok FROM st JOIN o ON o.user_id = st.user_id AND o.k = st.k + 1)),
gm AS (SELECT user_id, i, j, iou FROM st WHERE ok)"""


def overlap_join(spark, sf_dir):
    p, r = _sides(spark, sf_dir)
    return B.overlap_pairs(p, r, KEY, 0.3).select("user_id", "i", "j", F.round("iou", 6).alias("iou"))


def greedy_match(spark, sf_dir):
    p, r = _sides(spark, sf_dir)
    return B.greedy_match(B.overlap_pairs(p, r, KEY, 0.3), KEY).select("user_id", "i", "j", F.round("iou", 6).alias("iou"))


def match_metrics(spark, sf_dir):
    p, r = _sides(spark, sf_dir)
    p, r = cut(p), cut(r)
    pairs = B.overlap_pairs(p, r, KEY, 0.3)
    found = B.greedy_match(pairs, KEY).join(p, ["user_id", "i"]).join(r, ["user_id", "j"])
    found = found.withColumns({"ds": F.abs(F.col("s") - F.col("rs")).cast("double"), "de": F.abs(F.col("e") - F.col("re")).cast("double")})
    n_p, n_r = (x.groupBy("user_id").agg(F.count("*").alias(n)) for x, n in ((p, "n_pred"), (r, "n_ref")))
    out = M.match_summary(found, KEY, n_p, n_r)
    return out.withColumns({c: F.round(c, 6) for c in ("start_offset", "end_offset", "median_iou")})


def frame_labels(spark, sf_dir):
    """Frames of spans in seconds, at 2.5 frames a second, clipped to the series."""
    s = series(spark, sf_dir)
    n = s.groupBy("user_id").agg(F.count("*").alias("n"))
    a = F.col("frame").cast("decimal(19,0)") * Decimal("0.37")  # SQL's literals are decimals: exact until the value, a double, joins
    spans = s.where("value > 60").select("user_id", a.alias("a"), (a.cast("double") + F.col("value") / 100).alias("b"))
    first, last = B.seconds_to_frames(F.col("a"), F.col("b"), F.col("n"), Decimal("2.5"))
    cut_spans = spans.join(n, "user_id").select("user_id", first.alias("start"), last.alias("end")).where("start <= end")
    return B.to_frames(B.merged(cut_spans, KEY, 1)).select("user_id", "frame")


def frame_confusion(spark, sf_dir):
    out = M.confusion(series(spark, sf_dir), KEY, F.col("value") > 40, F.col("event_type").isin("click", "view"))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "iou")})


def interval_confusion(spark, sf_dir):
    s = series(spark, sf_dir)
    totals = s.groupBy("user_id").agg(F.count("*").alias("n"))
    return M.interval_confusion(B.runs(s, KEY, F.expr(HIGH)), B.runs(s, KEY, F.col("event_type").isin("click", "view")), totals, KEY, "n")


def mean_f1(spark, sf_dir):
    scored = frame_confusion(spark, sf_dir)
    return scored.agg(F.round(F.avg(F.round("f1", 3)), 6).alias("mean_f1"))


def label_confusion(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.confusion(joined, ["lang"], F.col("n_chars") > 1500, F.col("quality") == 1).select("lang", "tp", "fp", "fn", "tn")


def courtship_index(spark, sf_dir):
    n = series(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    found = M.index_percent(_behaviours(spark, sf_dir).join(n, "user_id"), KEY, "n", onset=5, skip="error")
    return found.withColumn("courtship_index", F.round("courtship_index", 6))


def latency_summary(spark, sf_dir):
    b = _behaviours(spark, sf_dir)
    any_ = M.latency(b, KEY, 30.0).withColumnRenamed("latency_s", "first_s")
    one = M.latency(b, KEY, 30.0, "purchase").withColumnRenamed("latency_s", "purchase_s")
    return any_.join(one, "user_id").select("user_id", F.round("first_s", 6).alias("first_s"), F.round("purchase_s", 6).alias("purchase_s"))


def behaviour_totals(spark, sf_dir):
    users = series(spark, sf_dir).select("user_id").distinct()
    out = M.behaviour_totals(_behaviours(spark, sf_dir), KEY, users, [*RANKS, "error"], 30.0)
    return out.withColumn("seconds", F.round("seconds", 6))


def summary_long(spark, sf_dir):
    b = _behaviours(spark, sf_dir)
    wide = b.groupBy("user_id").agg(
        F.count("*").alias("bouts"), F.sum(M.frames_in()).alias("frames"), F.min(F.when(F.col("behavior") == "purchase", F.col("start"))).alias("first_purchase")
    )
    return M.summary_long(wide, KEY, ["bouts", "frames", "first_purchase"])


def param_sweep(spark, sf_dir):
    """One pass over the series for five thresholds: the parameter table, five rows, goes to every task."""
    params = F.broadcast(spark.createDataFrame([(k, 20.0 + 15 * k) for k in range(5)], "param_set int, thr double"))
    swept = series(spark, sf_dir).crossJoin(params)
    found = B.from_scores(swept, ["param_set", "user_id"], F.col("value") > F.col("thr"), 2, 3)
    return found.groupBy("param_set").agg(F.count("*").alias("n_bouts"), F.sum(M.frames_in()).alias("n_frames"))


def sessions(spark, sf_dir):
    found = session_bouts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), KEY, F.col("value") > 20, "6 hours")
    return found.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def tumbling_totals(spark, sf_dir):
    found = window_totals(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "value", "1 day")
    return found.select("event_type", F.to_date("start").cast("string").alias("day"), "n", F.round("total", 4).alias("total"))


def select(source: str, cols: str = "user_id, s AS start, e AS \"end\"") -> str:
    return f"SELECT {cols} FROM {source}"


_CONFUSED = """c AS (SELECT user_id,
  count(*) FILTER (WHERE value > 40 AND event_type IN ('click','view')) AS tp,
  count(*) FILTER (WHERE value > 40 AND event_type NOT IN ('click','view')) AS fp,
  count(*) FILTER (WHERE value <= 40 AND event_type IN ('click','view')) AS fn,
  count(*) FILTER (WHERE value <= 40 AND event_type NOT IN ('click','view')) AS tn FROM s GROUP BY user_id)"""
_SCORED = f"""WITH {SERIES}, {_CONFUSED}, f AS (SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou FROM c)"""

QUERIES = {
    "bout_summary": (bout_summary, f"WITH {_BOUTS} SELECT user_id, count(*) AS n_bouts, CAST(sum(e - s + 1) AS BIGINT) AS n_frames, min(s) AS first_start FROM b GROUP BY user_id"),
    "bouts_islands": (bouts_islands, f"WITH {SERIES}, {runs_sql('s', 'user_id', 'value > 40', 'r')} {select('r')}"),
    "bouts_min_len": (bouts_min_len, f"WITH {SERIES}, {runs_sql('s', 'user_id', 'value > 30', 'r')} {select('r')} WHERE e - s + 1 >= 3"),
    "bouts_merge_gap": (bouts_merge_gap, f"WITH {_BOUTS} {select('b')}"),
    "bouts_merge_refilter": (bouts_merge_refilter, f"WITH {_BOUTS} {select('b')} WHERE e - s + 1 >= 8"),
    "interval_union": (interval_union, f"WITH {_BEHAVIOURS}, {merged_sql('bh', 'user_id', 1, 'u')} {select('u')}"),
    "priority_exclusion": (
        priority_exclusion,
        f"""WITH {_BEHAVIOURS}, k AS (SELECT user_id, behavior, s, e, {_RANK_SQL.replace('event_type', 'behavior')} AS rk FROM bh),
f AS (SELECT DISTINCT user_id, rk, unnest(range(s, e + 1)) AS frame FROM k),
c AS (SELECT k.user_id, k.behavior, k.s, k.e, count(DISTINCT f.frame) AS n FROM k LEFT JOIN f ON f.user_id = k.user_id AND f.rk < k.rk AND f.frame BETWEEN k.s AND k.e GROUP BY ALL)
SELECT user_id, behavior, s AS start, e AS "end" FROM c WHERE n < e - s + 1""",
    ),
    "unified_union": (
        unified_union,
        f"WITH {_BEHAVIOURS}, {merged_sql('bh', 'user_id', 1, 'u', chr(98) + 'ehavior <> ' + repr('error'))}, {merged_sql('u', 'user_id', 5, 'v', 'e - s + 1 >= 4')} {select('v')} WHERE e - s + 1 >= 4",
    ),
    "overlap_join": (overlap_join, f"WITH {_SIDES} SELECT user_id, i, j, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.3"),
    "greedy_match": (greedy_match, f"{_GREEDY} SELECT user_id, i, j, round(iou, 6) AS iou FROM gm"),
    "match_metrics": (
        match_metrics,
        f"""{_GREEDY}, np AS (SELECT user_id, count(*) AS n_pred FROM p1 GROUP BY user_id), nr AS (SELECT user_id, count(*) AS n_ref FROM r1 GROUP BY user_id),
mm AS (SELECT gm.user_id, count(*) AS matched, avg(abs(i - j)) AS ds, avg(abs(p1.e - r1.e)) AS de, median(iou) AS iou
FROM gm JOIN p1 ON p1.user_id = gm.user_id AND p1.s = i JOIN r1 ON r1.user_id = gm.user_id AND r1.s = j GROUP BY 1)
SELECT user_id, coalesce(matched, 0) AS matched, coalesce(n_pred, 0) - coalesce(matched, 0) AS false_bouts, coalesce(n_ref, 0) - coalesce(matched, 0) AS missed,
round(coalesce(ds, 0.0), 6) AS start_offset, round(coalesce(de, 0.0), 6) AS end_offset, round(coalesce(iou, 0.0), 6) AS median_iou FROM np FULL JOIN nr USING (user_id) LEFT JOIN mm USING (user_id)""",
    ),
    "frame_labels": (
        frame_labels,
        f"""WITH {SERIES}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id),
z AS (SELECT user_id, greatest(CAST(floor(frame * 0.37 * 2.5) AS BIGINT), 0) AS a, least(CAST(ceil((frame * 0.37 + value / 100) * 2.5) AS BIGINT), n) - 1 AS b FROM s JOIN n USING (user_id) WHERE value > 60)
SELECT DISTINCT user_id, unnest(range(a, b + 1)) AS frame FROM z WHERE a <= b""",
    ),
    "frame_confusion": (frame_confusion, f"{_SCORED} SELECT * FROM f"),
    "interval_confusion": (interval_confusion, f"WITH {SERIES}, {_CONFUSED} SELECT * FROM c"),
    "mean_f1": (mean_f1, f"{_SCORED} SELECT round(avg(round(f1, 3)), 6) AS mean_f1 FROM f"),
    "label_confusion": (
        label_confusion,
        """SELECT lang, count(*) FILTER (WHERE n_chars > 1500 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars > 1500 AND quality = 0) AS fp,
count(*) FILTER (WHERE n_chars <= 1500 AND quality = 1) AS fn, count(*) FILTER (WHERE n_chars <= 1500 AND quality = 0) AS tn
FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    ),
    "courtship_index": (
        courtship_index,
        f"""WITH {_BEHAVIOURS}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id),
f AS (SELECT DISTINCT user_id, unnest(range(s, e + 1)) AS frame FROM bh WHERE behavior <> 'error'),
x AS (SELECT user_id, count(*) FILTER (WHERE frame >= 5) AS k FROM f GROUP BY user_id)
SELECT user_id, round(k / CAST(greatest(n - 5, 1) AS DOUBLE) * 100, 6) AS courtship_index FROM x JOIN n USING (user_id)""",
    ),
    "latency_summary": (
        latency_summary,
        f"WITH {_BEHAVIOURS} SELECT user_id, round(min(s) / 30.0, 6) AS first_s, round(min(s) FILTER (WHERE behavior = 'purchase') / 30.0, 6) AS purchase_s FROM bh GROUP BY user_id",
    ),
    "behaviour_totals": (
        behaviour_totals,
        f"""WITH {_BEHAVIOURS}, k AS (SELECT DISTINCT user_id FROM s), d AS (SELECT unnest(['purchase','signup','click','view','error']) AS behavior)
SELECT k.user_id, d.behavior, count(bh.s) AS n_bouts, round(coalesce(sum(e - bh.s + 1), 0) / 30.0, 6) AS seconds FROM k CROSS JOIN d LEFT JOIN bh ON bh.user_id = k.user_id AND bh.behavior = d.behavior GROUP BY 1, 2""",
    ),
    "summary_long": (
        summary_long,
        f"""WITH {_BEHAVIOURS}, w AS (SELECT user_id, count(*) AS bouts, CAST(sum(e - s + 1) AS BIGINT) AS frames, min(s) FILTER (WHERE behavior = 'purchase') AS first_purchase FROM bh GROUP BY user_id)
SELECT user_id, 'bouts' AS metric, CAST(bouts AS VARCHAR) AS value FROM w UNION ALL SELECT user_id, 'frames', CAST(frames AS VARCHAR) FROM w
UNION ALL SELECT user_id, 'first_purchase', coalesce(CAST(first_purchase AS VARCHAR), 'N/A') FROM w""",
    ),
    "param_sweep": (
        param_sweep,
        f"""WITH {SERIES}, q AS (SELECT s.*, CAST(k AS INT) AS param_set, 20.0 + 15 * k AS thr FROM s CROSS JOIN range(5) t(k)),
{runs_sql('q', 'param_set, user_id', 'value > thr', 'r')}, {merged_sql('r', 'param_set, user_id', 3, 'm', 'e - s + 1 >= 2')}
SELECT param_set, count(*) AS n_bouts, CAST(sum(e - s + 1) AS BIGINT) AS n_frames FROM m WHERE e - s + 1 >= 2 GROUP BY param_set""",
    ),
    "session_bouts": (
        sessions,
        """WITH h AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE value > 20),
k AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM h), c AS (SELECT user_id, sid, count(*) AS n FROM k GROUP BY ALL)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id""",
    ),
    "tumbling_totals": (tumbling_totals, "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
}
