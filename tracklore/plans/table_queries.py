"""Queries on texts, grids, mappings, images and plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blobs as P
from ..operators import grid as G
from ..operators import image as I
from ..operators import metrics as M
from ..sources import results as S
from .base import SERIES, TRACKS, series, table, tracks

#: Descriptions of a position and what each means: row, rows from its edge, column. A leading number is a tag, even in 4th.
_DESCRIBED = [
    ("01 (bottom right)", "bottom", 0, "right"), ("02 (second row from the bottom, right)", "bottom", 1, "right"),
    ("second from the bottom, right", "bottom", 1, "right"), ("third top, left", "top", 2, "left"), ("07 (top row middle)", "top", 0, "middle"),
    ("middle", "middle", 0, None), ("middle row middle", "middle", 0, None), ("middle row, left", "middle", 0, "left"), ("left", None, 0, "left"),
    ("4th row from the top centre", "top", 0, "middle"), ("09 (4th row from the top, centre)", "top", 3, "middle"), ("12 plate top left (2nd row from bottom, center)", "bottom", 1, "middle"),
    ("(FIRST BOTTOM)", "bottom", 0, None), ("top row", "top", 0, None), ("fifth row from top, right of the middle", "top", 4, "middle"),
    ("somewhere", None, 0, None), ("6 (bottom row (left) of the top)", None, 0, "left"), ("top-left row", "top", 0, "left"), ("1st bottom right", "bottom", 0, "right"),
    ("one from the bottom, middle", "bottom", 0, "middle"), ("", None, 0, None),
]

#: Boxes in a row, by image.
_ROW_SIZES = [3, 2, 1, 6, 4, 12, 5]


def time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written from part keys, some of them broken, read as seconds."""
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = (
        F.when(k % 5 == 0, F.format_string("%d:%02d", k % 90, k % 60))
        .when(k % 5 == 1, F.format_string(" %d:%02d:%02d ", k % 7, k % 60, (k * 7) % 60))
        .when(k % 5 == 2, F.format_string("%d:%d:%d:0", k % 7, k % 60, k % 60))
        .when(k % 5 == 3, F.col("p_name"))
    )
    return parts.select("p_partkey", T.time_seconds(text).alias("seconds"))


def clock_text(spark, sf_dir):
    """Quarter seconds, which both sides write alike."""
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", T.clock(F.col("p_partkey") * 0.25).alias("clock"))


def _described(spark, sf_dir):
    texts = F.array(*(F.lit(d[0]) for d in _DESCRIBED))
    number = (F.col("s_suppkey") % len(_DESCRIBED)).cast("int")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.get(texts, number).alias("descriptor"))


def descriptor_parse(spark, sf_dir):
    found = _described(spark, sf_dir).withColumn("p", T.position(F.col("descriptor")))
    return found.select("s_suppkey", "p.row_key", "p.row_offset", "p.col_key")


def _boxes(spark, sf_dir, columns=None):
    """Boxes of parts, 12 to an image, in rows of 3 (or of ``columns`` of the image) that are not quite straight."""
    k = F.col("p_partkey")
    i, n = k % 12, columns(F.floor(k / 12)) if columns else 3
    return table(spark, sf_dir, "part").select(
        F.floor(k / 12).alias("image"), i.alias("idx"), (i % n * 100 + F.col("p_size") % 20).cast("double").alias("x"),
        (F.floor(i / n) * 80 + F.col("p_size") % 15).cast("double").alias("y"), (40 + F.col("p_size") % 10).cast("double").alias("w"),
        (40 + F.col("p_size") % 8).cast("double").alias("h"),
    )


def grid_assign(spark, sf_dir):
    return G.grid_coordinates(_boxes(spark, sf_dir), ["image"], "idx").select("image", "idx", "row", F.col("col").cast("long").alias("col"))


def grid_match(spark, sf_dir):
    """Each supplier's description in the image of its number; images have 1 to 6 boxes in a row."""
    columns = lambda image: F.get(F.array(*map(F.lit, _ROW_SIZES)), (image % len(_ROW_SIZES)).cast("int"))
    cells = P.cut(G.grid_coordinates(_boxes(spark, sf_dir, columns), ["image"], "idx").select("image", "idx", "row", "col"))
    described = _described(spark, sf_dir)
    # The grammar is a long expression: each distinct text is parsed once.
    parsed = P.cut(described.select("descriptor").distinct().withColumn("p", T.position(F.col("descriptor"))))
    wanted = described.join(parsed, "descriptor").select("s_suppkey", F.col("s_suppkey").alias("image"), "p")
    return G.resolve_positions(cells, wanted, ["image"], "idx").select("s_suppkey", F.col("chamber").alias("idx"))


def mapping_override(spark, sf_dir):
    """Suppliers as descriptors that name their nation; every ninth is overridden."""
    suppliers = table(spark, sf_dir, "supplier")
    resolved = suppliers.select(F.col("s_name").alias("descriptor"), "s_suppkey", F.col("s_nationkey").alias("chamber"))
    overrides = suppliers.where("s_suppkey % 9 = 0").select(F.col("s_name").alias("descriptor"), (F.col("s_suppkey") % 25).cast("int").alias("chamber"))
    return G.with_overrides(resolved, overrides, "s_suppkey").select("descriptor", "chamber", "ambiguous")


def reading_order(spark, sf_dir):
    return G.reading_order(_boxes(spark, sf_dir), ["image"]).select("image", "idx", F.col("chamber").cast("long").alias("chamber"))


def box_padding(spark, sf_dir):
    out = G.padded("x", "y", "w", "h", 12, F.lit(300.0), F.lit(320.0))
    return _boxes(spark, sf_dir).withColumn("area", F.col("w") * F.col("h") * (F.col("idx") + 1) / 12).where(G.plausible_blob("area", "w", "h", F.lit(40000.0))).select("image", "idx", *out)


def top_n_blobs(spark, sf_dir):
    """The two largest line items of each order, as the largest blobs of a frame."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    blobs = items.withColumns({"cy": F.col("l_linenumber"), "cx": F.col("l_linenumber")})
    return I.largest(blobs, ["l_orderkey"], "l_quantity", 2).select("l_orderkey", "l_linenumber", "l_quantity")


def argmax_first(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    best = F.max_by("l_partkey", F.struct("l_quantity", -F.col("l_linenumber"), -F.col("l_partkey")))
    return items.groupBy("l_suppkey").agg(best.alias("l_partkey"))


def anti_completed(spark, sf_dir):
    return S.remaining(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


def left_unmapped(spark, sf_dir):
    """Customers and the first order of each, 'no_results' without one."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left")
    return joined.withColumn("scope", F.when(F.col("first_order").isNull(), "no_results").otherwise("mapped"))


def json_override_merge(spark, sf_dir):
    """The entries of each event's JSON properties, as overrides: of each name, how many and their sum."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    rows = S.read_overrides(events, "props")
    return rows.groupBy("descriptor").agg(F.count("*").alias("n"), F.sum("chamber").alias("total"))


def entity_labels(spark, sf_dir):
    users = series(spark, sf_dir).select("user_id").distinct()
    k = F.col("user_id")
    label = T.entity_label(k, k % 3 == 0, k % 3 == 1)
    return users.select("user_id", label.alias("label"), T.entity_of_label(label).alias("entity"), T.names_male(label).alias("male"))


def bout_file_rows(spark, sf_dir):
    """Line items as rows of a bout file."""
    spans = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("behavior"), (F.col("l_suppkey") % 2).alias("fly"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("end")
    )
    rows = S.bout_rows(spans, 32.0)
    return rows.select("Behavior", "Fly", F.col("`Start_Time (s)`").alias("start_s"), F.col("`End_Time (s)`").alias("end_s"), F.col("`Duration (s)`").alias("duration_s"), "Start_Frame", "End_Frame")


def courtship_scope(spark, sf_dir):
    """Courtship of a male where there is one, else of both, in seconds."""
    s = series(spark, sf_dir).where("value > 30")
    k = F.col("user_id")
    bouts = s.select(
        "user_id", F.lit("Courtship").alias("behavior"), F.when((k % 2 == 0) & (F.col("frame") % 3 == 0), "Fly 0 (Male)").otherwise("Fly 1 (Female)").alias("label"),
        F.col("frame").cast("double").alias("start_s"), (F.col("frame") + F.col("value") / 40).alias("end_s"),
    )
    found = S.courtship_spans(bouts, ["user_id"])
    return found.groupBy("user_id", "scope").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 6).alias("seconds"))


def otsu_threshold(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("v"))
    return I.otsu(items, ["l_returnflag"], "v")


def temporal_upper_median(spark, sf_dir):
    pixels = series(spark, sf_dir).select(F.pmod("user_id", F.lit(10)).alias("x"), F.pmod("frame", F.lit(7)).alias("y"), "value")
    return I.background(pixels, ["y", "x"], "value")


def moment_ellipse(spark, sf_dir):
    found = I.ellipse(tracks(spark, sf_dir), ["video_id", "fly"])
    return found.select("video_id", "fly", *(F.round(c, 5).alias(c) for c in ("cx", "cy", "a", "b")), "area")


def mask_opening(spark, sf_dir):
    """Foreground pixels of part sizes on a lattice, opened with a 3x3 square."""
    mask = table(spark, sf_dir, "part").where("p_size > 8").select(F.floor(F.col("p_partkey") / 40).alias("y"), (F.col("p_partkey") % 40).alias("x")).distinct()
    return P.opened(mask, [], P.kernel(3))


def identity_tracks(spark, sf_dir):
    """Two identities followed through each pair of users' places."""
    found = tracks(spark, sf_dir).select("video_id", "frame", "x", "y", (F.col("a") * F.col("b")).alias("area"))
    out = I.assign_identities(found, ["video_id"], 12.0, area="area")
    return out.withColumns({c: F.round(c, 6) for c in "xy"})


def pixel_blobs(spark, sf_dir):
    """Blobs of large parts on a lattice of 40 columns, and what fits a box of their area."""
    mask = table(spark, sf_dir, "part").where("p_size > 36").select((F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"))
    return P.blobs(mask, []).select("area", "x", "y", "w", "h", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def nearest_track(spark, sf_dir):
    """Of each pair, the user whose median place is nearest to 21 and within 4."""
    return M.nearest_item(tracks(spark, sf_dir), ["video_id"], "fly", "x", 21.0, 4.0)


def newest_runs(spark, sf_dir):
    """Orders as result files in folders named by their date, one a clerk."""
    orders = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("results/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_00-00-00/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".txt").otherwise("_results.csv"))
    return S.runs_newest_first(orders.select(name.alias("f")), "f")


def null_share(spark, sf_dir):
    """Share of errors among each user's first 20 events."""
    s = series(spark, sf_dir).where("frame < 20")
    return s.groupBy("user_id").agg(F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("share"))


def distinct_behaviours(spark, sf_dir):
    """Event types in the order in which each user shows them first."""
    firsts = series(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("frame").alias("first"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("first"))
    return firsts.withColumn("ord", order.cast("long"))


def _boxes_sql(n: str = "3") -> str:
    return f"""bx AS (SELECT p_partkey // 12 AS image, p_partkey % 12 AS idx, CAST(p_partkey % 12 % {n} * 100 + p_size % 20 AS DOUBLE) AS x,
CAST(p_partkey % 12 // {n} * 80 + p_size % 15 AS DOUBLE) AS y, CAST(40 + p_size % 10 AS DOUBLE) AS w, CAST(40 + p_size % 8 AS DOUBLE) AS h FROM part)"""


def _grid_sql(boxes: str) -> str:
    return f"""WITH RECURSIVE {boxes}, o AS (SELECT *, y + h / 2 AS cy, row_number() OVER (PARTITION BY image ORDER BY y + h / 2, idx) AS k FROM bx),
mm AS (SELECT image, greatest(1.0, 0.5 * (list_sort(list(h)))[count(*) // 2 + 1]) AS near FROM bx GROUP BY image),
f AS (SELECT image, k, idx, x, w, cy AS anchor, 0 AS row FROM o WHERE k = 1
UNION ALL SELECT o.image, o.k, o.idx, o.x, o.w, CASE WHEN abs(o.cy - f.anchor) <= near THEN f.anchor ELSE o.cy END, CASE WHEN abs(o.cy - f.anchor) <= near THEN f.row ELSE f.row + 1 END
FROM f JOIN o ON o.image = f.image AND o.k = f.k + 1 JOIN mm ON mm.image = f.image),
grid AS (SELECT image, idx, row, row_number() OVER (PARTITION BY image, row ORDER BY x + w / 2, idx) - 1 AS col FROM f)"""


_BOXES = _boxes_sql()
_GRID = _grid_sql(_BOXES)
_PLATES = _grid_sql(_boxes_sql(f"({_ROW_SIZES})[p_partkey // 12 % {len(_ROW_SIZES)} + 1]"))
_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_DESC = f"""dx(k, row_key, row_offset, col_key) AS (VALUES {', '.join(f"({k}, {_quoted(r)}, {n}, {_quoted(c)})" for k, (_, r, n, c) in enumerate(_DESCRIBED))}),
ps AS (SELECT s_suppkey, row_key, row_offset, col_key FROM supplier JOIN dx ON k = s_suppkey % {len(_DESCRIBED)})"""

_IDENTITIES = f"""WITH RECURSIVE {TRACKS}, de AS (SELECT video_id, frame, list({{'x': x, 'y': y}} ORDER BY x, y) AS ds, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS k FROM t GROUP BY video_id, frame),
no AS (SELECT NULL::STRUCT(x DOUBLE, y DOUBLE) AS p),
st AS (SELECT video_id, 0::BIGINT AS k, -1::BIGINT AS frame, p AS p0, p AS p1, p AS o0, p AS o1 FROM (SELECT DISTINCT video_id FROM de) CROSS JOIN no
UNION ALL SELECT video_id, k, frame, coalesce(o0, p0), coalesce(o1, p1), o0, o1 FROM (
SELECT *, CASE WHEN j0 IS NOT NULL AND (p0 IS NULL OR CASE j0 WHEN 1 THEN c01 ELSE c02 END < 12) THEN ds[j0] END AS o0, CASE WHEN j1 IS NOT NULL AND (p1 IS NULL OR CASE j1 WHEN 1 THEN c11 ELSE c12 END < 12) THEN ds[j1] END AS o1 FROM (
SELECT *, CASE WHEN fresh THEN 1 WHEN len(ds) = 2 THEN CASE WHEN c02 + c11 < c01 + c12 THEN 2 ELSE 1 END WHEN c11 < c01 THEN NULL ELSE 1 END AS j0,
CASE WHEN fresh THEN CASE WHEN len(ds) > 1 THEN 2 END WHEN len(ds) = 2 THEN CASE WHEN c02 + c11 < c01 + c12 THEN 1 ELSE 2 END WHEN c11 < c01 THEN 1 END AS j1 FROM (
SELECT st.video_id, de.k, de.frame, p0, p1, ds, p0 IS NULL AND p1 IS NULL AS fresh,
coalesce(sqrt(pow(p0.x - ds[1].x, 2) + pow(p0.y - ds[1].y, 2)), 1e6) AS c01, CASE WHEN p0 IS NULL THEN 1e6 ELSE sqrt(pow(p0.x - ds[2].x, 2) + pow(p0.y - ds[2].y, 2)) END AS c02,
coalesce(sqrt(pow(p1.x - ds[1].x, 2) + pow(p1.y - ds[1].y, 2)), 1e6) AS c11, CASE WHEN p1 IS NULL THEN 1e6 ELSE sqrt(pow(p1.x - ds[2].x, 2) + pow(p1.y - ds[2].y, 2)) END AS c12
FROM st JOIN de ON de.video_id = st.video_id AND de.k = st.k + 1))))
SELECT video_id, frame, 0::INT AS fly, round(o0.x, 6) AS x, round(o0.y, 6) AS y FROM st WHERE k > 0 UNION ALL SELECT video_id, frame, 1::INT, round(o1.x, 6), round(o1.y, 6) FROM st WHERE k > 0"""

QUERIES = {
    "time_text": (
        time_text,
        "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_partkey % 90 * 60 + p_partkey % 60 WHEN 1 THEN p_partkey % 7 * 3600 + p_partkey % 60 * 60 + p_partkey * 7 % 60 END AS DOUBLE) AS seconds FROM part",
    ),
    "clock_text": (clock_text, "SELECT p_partkey, printf('%d:%05.2f', CAST(floor(p_partkey * 0.25 / 60) AS BIGINT), CAST(p_partkey * 0.25 - floor(p_partkey * 0.25 / 60) * 60 AS DOUBLE)) AS clock FROM part"),
    "descriptor_parse": (descriptor_parse, f"WITH {_DESC} SELECT * FROM ps"),
    "grid_assign": (grid_assign, f"{_GRID} SELECT * FROM grid"),
    "grid_match": (
        grid_match,
        f"""{_PLATES}, {_DESC}, cl AS (SELECT image, row, max(row) OVER (PARTITION BY image) + 1 AS nr, list(idx ORDER BY col) AS ids FROM grid GROUP BY image, row),
pk AS (SELECT s_suppkey, col_key, ids, len(ids) AS n, greatest(len(ids) // 3, 1) AS third FROM ps JOIN cl ON image = s_suppkey
AND row = CASE row_key WHEN 'top' THEN row_offset WHEN 'bottom' THEN nr - 1 - row_offset WHEN 'middle' THEN nr // 2 END),
bk AS (SELECT s_suppkey, CASE WHEN col_key IS NULL THEN ids WHEN col_key = 'left' THEN ids[1:third] WHEN col_key = 'right' THEN ids[n - third + 1:n] WHEN n = 1 THEN ids
WHEN n = 2 THEN NULL WHEN n - third <= third THEN ids[n // 2 + 1:n // 2 + 1] ELSE ids[third + 1:n - third] END AS ids FROM pk)
SELECT ps.s_suppkey, CASE WHEN len(ids) = 1 THEN ids[1] END AS idx FROM ps LEFT JOIN bk USING (s_suppkey)""",
    ),
    "mapping_override": (
        mapping_override,
        """WITH o AS (SELECT s_name, CAST(s_suppkey % 25 AS INT) AS c FROM supplier WHERE s_suppkey % 9 = 0),
a AS (SELECT s.s_name, s.s_suppkey, o.c AS o, CASE WHEN o.c IS NULL AND s_nationkey NOT IN (SELECT c FROM o) THEN s_nationkey END AS a FROM supplier s LEFT JOIN o USING (s_name)),
r AS (SELECT s_name, coalesce(o, CASE WHEN a IS NOT NULL AND row_number() OVER (PARTITION BY a ORDER BY s_suppkey) = 1 THEN a END) AS chamber FROM a)
SELECT s_name AS descriptor, chamber, chamber IS NULL AS ambiguous FROM r""",
    ),
    "reading_order": (
        reading_order,
        f"WITH {_BOXES}, k AS (SELECT *, greatest(median(h) OVER (PARTITION BY image) / 2, 1.0) AS half FROM bx) SELECT image, idx, row_number() OVER (PARTITION BY image ORDER BY floor(y / half), x, y) - 1 AS chamber FROM k",
    ),
    "box_padding": (
        box_padding,
        f"""WITH {_BOXES}, k AS (SELECT *, w * h * (idx + 1) / 12 AS area FROM bx), kk AS (SELECT * FROM k WHERE area BETWEEN 80.0 AND 3200.0 AND w / h BETWEEN 0.5 AND 2.0 AND area / (w * h) >= 0.45)
SELECT image, idx, greatest(x - 12, 0) AS x, greatest(y - 12, 0) AS y, least(w + 24, 300 - greatest(x - 12, 0)) AS w, least(h + 24, 320 - greatest(y - 12, 0)) AS h FROM kk""",
    ),
    "top_n_blobs": (top_n_blobs, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) <= 2"),
    "argmax_first": (argmax_first, "SELECT l_suppkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) = 1"),
    "anti_completed": (anti_completed, "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "left_unmapped": (left_unmapped, "SELECT c_custkey, min(o_orderkey) AS first_order, CASE WHEN min(o_orderkey) IS NULL THEN 'no_results' ELSE 'mapped' END AS scope FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "json_override_merge": (json_override_merge, "SELECT 'k' AS descriptor, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total FROM events"),
    "entity_labels": (
        entity_labels,
        "SELECT DISTINCT user_id, 'Fly ' || user_id || CASE user_id % 3 WHEN 0 THEN ' (Male)' WHEN 1 THEN ' (Female)' ELSE '' END AS label, CAST(user_id AS INT) AS entity, user_id % 3 = 0 AS male FROM events",
    ),
    "bout_file_rows": (
        bout_file_rows,
        """SELECT l_returnflag AS Behavior, 'Fly ' || l_suppkey % 2 AS Fly, round(l_orderkey / 32.0, 3) AS start_s, round((l_orderkey + l_linenumber) / 32.0, 3) AS end_s,
round((l_linenumber + 1) / 32.0, 3) AS duration_s, l_orderkey AS Start_Frame, l_orderkey + l_linenumber AS End_Frame FROM lineitem""",
    ),
    "courtship_scope": (
        courtship_scope,
        f"""WITH {SERIES}, c AS (SELECT user_id, user_id % 2 = 0 AND frame % 3 = 0 AS male, CAST(frame AS DOUBLE) AS s, frame + value / 40 AS e FROM s WHERE value > 30),
k AS (SELECT *, CASE WHEN max(male) OVER (PARTITION BY user_id) THEN 'male' ELSE 'union' END AS scope FROM c), u AS (SELECT * FROM k WHERE scope = 'union' OR male),
w AS (SELECT *, CASE WHEN scope = 'male' OR s > coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM u),
x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS sid FROM w), y AS (SELECT user_id, scope, min(s) AS s, max(e) AS e FROM x GROUP BY user_id, scope, sid)
SELECT user_id, scope, count(*) AS n, round(sum(e - s), 6) AS seconds FROM y GROUP BY 1, 2""",
    ),
    "otsu_threshold": (
        otsu_threshold,
        """WITH c AS (SELECT l_returnflag, CAST(l_quantity AS INT) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT l_returnflag, v, CAST(sum(n) OVER w AS DOUBLE) AS n0, sum(v * n) OVER w AS s0, sum(n) OVER p AS n_1, sum(v * n) OVER p AS s FROM (SELECT l_returnflag, v, n FROM c) WINDOW w AS (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY l_returnflag))
SELECT l_returnflag, v AS threshold FROM k QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY coalesce(n0 * (n_1 - n0) * power(s0 / n0 - (s - s0) / nullif(n_1 - n0, 0), 2), 0) DESC, v) = 1""",
    ),
    "temporal_upper_median": (temporal_upper_median, f"WITH {SERIES} SELECT frame % 7 AS y, user_id % 10 AS x, (list_sort(list(value)))[count(*) // 2 + 1] AS background FROM s GROUP BY 1, 2"),
    "moment_ellipse": (
        moment_ellipse,
        f"""WITH {TRACKS}, m AS (SELECT video_id, fly, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, count(*) AS area FROM t GROUP BY 1, 2),
r AS (SELECT *, (xx + yy) / 2 AS mid, sqrt(power((xx - yy) / 2, 2) + power(xy, 2)) AS root FROM m)
SELECT video_id, fly, round(cx, 5) AS cx, round(cy, 5) AS cy, round(2 * sqrt(mid + root), 5) AS a, round(2 * sqrt(greatest(mid - root, 0)), 5) AS b, area FROM r""",
    ),
    "mask_opening": (
        mask_opening,
        """WITH m AS (SELECT DISTINCT p_partkey // 40 AS y, p_partkey % 40 AS x FROM part WHERE p_size > 8), d AS (SELECT unnest([-1, 0, 1]) AS d),
e AS (SELECT m.y, m.x FROM m CROSS JOIN d a CROSS JOIN d b JOIN m o ON o.y = m.y + a.d AND o.x = m.x + b.d GROUP BY 1, 2 HAVING count(*) = 9)
SELECT DISTINCT e.y + a.d AS y, e.x + b.d AS x FROM e CROSS JOIN d a CROSS JOIN d b""",
    ),
    "identity_tracks": (identity_tracks, _IDENTITIES),
    "pixel_blobs": (
        pixel_blobs,
        """WITH RECURSIVE m AS (SELECT DISTINCT p_partkey % 40 AS x, p_partkey // 40 AS y, p_partkey // 40 * 40 + p_partkey % 40 AS id FROM part WHERE p_size > 36),
l AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.id <> b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r AS (SELECT id, id AS other FROM m UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT id, min(other) AS part FROM r GROUP BY id)
SELECT count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM m JOIN c USING (id) GROUP BY part""",
    ),
    "nearest_track": (
        nearest_track,
        f"""WITH {TRACKS}, m AS (SELECT video_id, fly, abs(median(x) - 21) AS d FROM t GROUP BY 1, 2)
SELECT video_id, arg_min(fly, d) FILTER (d < 4) AS fly FROM m GROUP BY 1""",
    ),
    "newest_runs": (
        newest_runs,
        """SELECT strftime(o_orderdate, '%Y-%m-%d_00-00-00') AS run, strftime(o_orderdate, '%b %d, %Y 12:00 AM') AS label, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2""",
    ),
    "null_share": (null_share, f"WITH {SERIES} SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS share FROM s WHERE frame < 20 GROUP BY 1"),
    "distinct_behaviours": (
        distinct_behaviours,
        f"WITH {SERIES}, k AS (SELECT user_id, event_type, min(frame) AS first FROM s GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS ord FROM k",
    ),
}
