"""Queries on what views show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bouts as B
from ..operators import models as L
from ..operators import report as V
from ..sources import results as S
from .base import SERIES, merged_sql, series, table
from .bout_queries import _BEHAVIOURS, _behaviours

NAMES = {"purchase": "Pur", "signup": "Sig", "click": "Cli", "view": "Vie"}


def active_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.active_labels(_behaviours(spark, sf_dir), ["user_id"], NAMES)


def behaviour_masks(spark, sf_dir):
    return V.behaviour_masks(_behaviours(spark, sf_dir), ["user_id"], list(NAMES))


def preview_frames(spark, sf_dir):
    b = B.merged(_behaviours(spark, sf_dir), ["user_id"], 1)
    shown = V.preview_frames(F.col("start"), F.col("end"), 30.0)
    return b.select("user_id", "start", F.explode(shown).alias("frame"))


def sample_times(spark, sf_dir):
    """Times to sample in orders taken as videos, whose length in seconds is their price over 1000."""
    orders = table(spark, sf_dir, "orders")
    times = V.sample_times(F.floor(F.col("o_totalprice") / 1000).cast("double"))
    return orders.select("o_orderkey", F.explode(times).alias("t")).select("o_orderkey", F.round("t", 6).alias("t"))


def best_sample(spark, sf_dir):
    """Of each part, the earliest line number with the most units."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("n"))
    return V.best_sample(items, ["l_partkey"], "l_linenumber", "n")


def grid_boxes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("width"), (F.col("p_partkey") % 97 * 5).alias("height"))
    return V.grid_boxes(parts, 3, 4, "width", "height").select("p_partkey", "idx", "x", "y", "w", "h")


def box_text(spark, sf_dir):
    """Boxes typed as lines of numbers, some of them broken."""
    k = F.col("p_partkey")
    text = F.concat_ws("\n", F.format_string("%d, %d,%d,%d", k, F.col("p_size"), k % 7, k % 11), F.when(k % 3 == 0, "1,2,3"), F.when(k % 4 == 0, F.lit("a,b,c,d")))
    boxes = table(spark, sf_dir, "part").select("p_partkey", S.box_lines(text).alias("b"))
    return boxes.select("p_partkey", F.size("b").alias("n"), F.get(F.get("b", F.lit(0)), F.lit(1)).alias("y"))


def token_maps(spark, sf_dir):
    """Feature names as alternating keys and values, of varying length."""
    k = F.col("p_partkey")
    tokens = F.array(F.lit("stat"), F.col("p_type"), F.lit("radius"), F.col("p_size").cast("string"), F.lit("offset"))
    cut = F.slice(tokens, F.lit(1), (k % 6).cast("int"))
    found = table(spark, sf_dir, "part").select("p_partkey", L.token_map_column(cut).alias("m"))
    return found.select("p_partkey", F.try_element_at("m", F.lit("stat")).alias("stat"), F.try_element_at("m", F.lit("radius")).try_cast("int").alias("radius"))


def evaluate_video(spark, sf_dir):
    """Suppliers as annotated chambers, nations as chambers: unmapped, without results, or measured."""
    suppliers = table(spark, sf_dir, "supplier")
    annotated = suppliers.select(F.col("s_name").alias("descriptor"))
    mapping = suppliers.where("s_suppkey % 4 <> 0").select(F.col("s_name").alias("descriptor"), F.col("s_nationkey").alias("chamber"))
    results = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("chamber"), F.when(F.col("n_regionkey") > 2, "male").otherwise("union").alias("scope"))
    measures = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("chamber")).agg(F.count("*").alias("n"))
    out = V.evaluate(annotated, mapping, measures, results)
    return out.select("descriptor", "chamber", "scope", F.when(F.col("scope").isin("male", "union"), F.col("n")).alias("n"))


def chamber_descriptors(spark, sf_dir):
    mapping = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("descriptor"), F.col("s_nationkey").alias("chamber"), "s_suppkey")
    return V.last_descriptor(mapping, "s_suppkey")


def event_frames(spark, sf_dir):
    """Frames of the series of each user: how many, and whether they are dense from 0."""
    s = series(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("frame").alias("last"), F.min("frame").alias("first"))
    return s.select("user_id", "n", "first", ((F.col("last") - F.col("first") + 1) == F.col("n")).alias("dense"))


_FRAMES = f"WITH {_BEHAVIOURS}, f AS (SELECT DISTINCT user_id, behavior, unnest(range(s, e + 1)) AS frame FROM bh WHERE behavior <> 'error')"

QUERIES = {
    "active_labels": (
        active_labels,
        f"{_FRAMES} SELECT user_id, frame, string_agg(CASE behavior WHEN 'purchase' THEN 'Pur' WHEN 'signup' THEN 'Sig' WHEN 'click' THEN 'Cli' ELSE 'Vie' END, ' | ' ORDER BY CASE behavior WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END) AS label FROM f GROUP BY 1, 2",
    ),
    "behaviour_masks": (behaviour_masks, f"{_FRAMES} SELECT user_id, frame, {', '.join(f'bool_or(behavior = {n!r}) AS {n}' for n in NAMES)} FROM f GROUP BY 1, 2"),
    "preview_frames": (preview_frames, f"WITH {_BEHAVIOURS}, {merged_sql('bh', 'user_id', 1, 'u')} SELECT user_id, s AS start, unnest((range(s, e + 1, 3))[1:100]) AS frame FROM u"),
    "sample_times": (
        sample_times,
        """WITH d AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS d FROM orders), k AS (SELECT *, least(90.0, d * 0.15) AS a, least(300.0, d * 0.8) AS b FROM d)
SELECT o_orderkey, round(a + i * 5.0, 6) AS t FROM (SELECT *, unnest(range(60)) AS i FROM k) WHERE a + i * 5.0 < b""",
    ),
    "best_sample": (best_sample, "SELECT l_partkey, l_linenumber AS best_t FROM (SELECT l_partkey, l_linenumber, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_linenumber) = 1"),
    "grid_boxes": (
        grid_boxes,
        """WITH p AS (SELECT p_partkey, p_size * 20 // 4 AS w, p_partkey % 97 * 5 // 3 AS h FROM part)
SELECT p_partkey, CAST(i AS INT) AS idx, i % 4 * w AS x, i // 4 * h AS y, w, h FROM p CROSS JOIN range(12) r(i) WHERE w > 0 AND h > 0""",
    ),
    "box_text": (box_text, "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS y FROM part"),
    "token_maps": (token_maps, "SELECT p_partkey, CASE WHEN p_partkey % 6 >= 2 THEN p_type END AS stat, CASE WHEN p_partkey % 6 >= 4 THEN p_size END AS radius FROM part"),
    "evaluate_video": (
        evaluate_video,
        """WITH j AS (SELECT s_name AS descriptor, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS chamber FROM supplier),
k AS (SELECT j.*, CASE WHEN chamber IS NULL THEN 'unmapped' WHEN n_nationkey IS NULL THEN 'no_results' WHEN n_regionkey > 2 THEN 'male' ELSE 'union' END AS scope FROM j LEFT JOIN nation ON n_nationkey = chamber AND n_nationkey % 3 <> 0)
SELECT descriptor, chamber, scope, CASE WHEN scope IN ('male', 'union') THEN (SELECT count(*) FROM customer WHERE c_nationkey = chamber) END AS n FROM k""",
    ),
    "chamber_descriptors": (chamber_descriptors, "SELECT s_nationkey AS chamber, arg_max(s_name, s_suppkey) AS descriptor FROM supplier GROUP BY 1"),
    "event_frames": (event_frames, f"WITH {SERIES} SELECT user_id, count(*) AS n, min(frame) AS first, max(frame) - min(frame) + 1 = count(*) AS dense FROM s GROUP BY 1"),
}
