"""Queries of spatial operators and rules (§2.3, §2.11, §2.12) on floors derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyroclast.operators import floor_rules, graph, rules, spatial
from pyroclast.plans.registry import query, table


@query("""
    SELECT c_custkey AS id, CASE WHEN (dx <= 60 AND dy <= 30) OR (dx <= 30 AND dy <= 60) THEN c_nationkey END AS room
    FROM (SELECT c_custkey, c_nationkey, c_custkey % 70 AS dx, c_custkey * 7 % 70 AS dy FROM customer)
""")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """The room that covers each point, boundaries included."""
    corner = lambda x, y: F.struct((F.col("n_nationkey") * 100.0 + x).alias("x"), F.lit(float(y)).alias("y"))
    shape = F.array(*[corner(x, y) for x, y in ((0, 0), (60, 0), (60, 30), (30, 30), (30, 60), (0, 60))])
    floor = table(spark, sf, "nation").select(F.col("n_nationkey").alias("room"), F.lit(2700.0).alias("area"), shape.alias("points"))
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select(k.alias("id"), (F.col("c_nationkey") * 100.0 + k % 70).alias("x"), (k * 7 % 70).cast("double").alias("y"))
    return spatial.rooms_at(points, floor).select("id", "room")


@query("""
    WITH p AS (SELECT c_custkey AS id, (c_custkey * 37 % 1000)::DOUBLE AS x, (c_custkey * 91 % 1000)::DOUBLE AS y FROM customer),
    t AS (SELECT s_suppkey AS target, (s_suppkey * 53 % 1000)::DOUBLE AS x, (s_suppkey * 29 % 1000)::DOUBLE AS y FROM supplier),
    d AS (SELECT p.id, t.target, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS distance FROM p JOIN t ON abs(p.x - t.x) <= 60 AND abs(p.y - t.y) <= 60),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, target) AS n FROM d WHERE distance <= 60)
    SELECT p.id, r.target, round(r.distance, 6) AS distance FROM p LEFT JOIN r ON r.id = p.id AND n = 1
""")
def nearest_within_radius(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest device within a radius, by grid cells instead of a product."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf, "customer").select(c.alias("id"), (c * 37 % 1000).cast("double").alias("x"), (c * 91 % 1000).cast("double").alias("y"))
    targets = table(spark, sf, "supplier").select(s.alias("target"), (s * 53 % 1000).cast("double").alias("x"), (s * 29 % 1000).cast("double").alias("y"))
    return spatial.nearest_within(points, targets, 60.0).withColumn("distance", F.round("distance", 6))


@query("""
    WITH p AS (SELECT c_custkey AS id, (c_custkey * 37 % 500)::DOUBLE AS x, (c_custkey * 91 % 500)::DOUBLE AS y FROM customer),
    b AS (SELECT n_nationkey AS idx, n_nationkey * 17.0 AS x0, n_nationkey * 11.0 AS y0, n_nationkey * 17.0 + 60 + n_nationkey % 4 * 20 AS x1, n_nationkey * 11.0 + 100 AS y1 FROM nation),
    r AS (SELECT p.id, b.idx, row_number() OVER (PARTITION BY p.id ORDER BY (x1 - x0) * (y1 - y0), idx) AS n FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
    SELECT p.id, r.idx FROM p LEFT JOIN r ON r.id = p.id AND n = 1
""")
def smallest_containing_box(spark: SparkSession, sf: str) -> DataFrame:
    """The least frame that holds a point, ties to the lowest index, none if there is none."""
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    points = table(spark, sf, "customer").select(c.alias("id"), (c * 37 % 500).cast("double").alias("x"), (c * 91 % 500).cast("double").alias("y"))
    boxes = table(spark, sf, "nation").select(n.alias("idx"), (n * 17.0).alias("x0"), (n * 11.0).alias("y0"), (n * 17.0 + 60 + n % 4 * 20).alias("x1"), (n * 11.0 + 100).alias("y1"))
    return spatial.smallest_box(points, boxes)


def _anchors(spark: SparkSession, sf: str, odd: int) -> DataFrame:
    e = table(spark, sf, "embeddings").where(F.col("vec_id") % 2 == odd)
    v = F.col("embedding")
    return e.select(F.col("label").alias("sheet"), (F.floor(F.col("vec_id") / 2) % 2).alias("kind"), F.col("vec_id").alias("anchor"), v[0].cast("double").alias("x"), v[1].cast("double").alias("y"), (F.abs(v[2].cast("double")) + 0.1).alias("area"))


@query("""
    WITH e AS (SELECT label, vec_id, (vec_id // 2) % 2 AS kind, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3]::DOUBLE) + 0.1 AS area FROM embeddings)
    SELECT a.label AS sheet, floor((b.x - a.x) / 0.05)::BIGINT AS dx, floor((b.y - a.y) / 0.05)::BIGINT AS dy, count(*) AS votes
    FROM e a JOIN e b ON a.label = b.label AND a.kind = b.kind AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND least(a.area, b.area) >= greatest(a.area, b.area) * 0.8 GROUP BY 1, 2, 3
""")
def displacement_band_join(spark: SparkSession, sf: str) -> DataFrame:
    """C20: votes for the displacement between anchors of one kind and like areas."""
    pairs = spatial.displacement_pairs(_anchors(spark, sf, 0), _anchors(spark, sf, 1), 0.05, 0.8)
    return pairs.groupBy("sheet", "dx", "dy").agg(F.count("*").alias("votes"))


@query("""
    WITH a AS (SELECT s_nationkey AS sheet, s_suppkey AS anchor, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y FROM supplier),
    b AS (SELECT sheet, anchor, x + 3.0::DOUBLE + (anchor % 5 - 2) * 0.01::DOUBLE AS x, y - 164.2::DOUBLE + (anchor % 5 - 2) * 0.01::DOUBLE AS y FROM a),
    p AS (SELECT a.sheet, floor((b.x - a.x) / 0.5::DOUBLE)::BIGINT AS dx, floor((b.y - a.y) / 0.5::DOUBLE)::BIGINT AS dy, b.x - a.x AS mx, b.y - a.y AS my FROM a JOIN b ON a.sheet = b.sheet),
    v AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY votes DESC, dx, dy) AS r FROM (SELECT sheet, dx, dy, count(*) AS votes FROM p GROUP BY 1, 2, 3)),
    m AS (SELECT p.*, votes FROM p JOIN v USING (sheet, dx, dy) WHERE r = 1 AND votes >= 2),
    s AS (SELECT sheet, median(mx) AS sx, median(my) AS sy, max(votes) AS votes FROM m GROUP BY 1),
    o AS (SELECT sheet, median(sqrt((mx - sx) ** 2 + (my - sy) ** 2)) AS residual FROM m JOIN s USING (sheet) GROUP BY 1)
    SELECT sheet, round(sx, 6) AS sx, round(sy, 6) AS sy, s.votes, round(residual, 6) AS residual FROM s JOIN o USING (sheet) WHERE residual < 0.3
""")
def sheet_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The shift between two copies of a sheet, by votes and medians."""
    s = F.col("s_suppkey")
    first = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("sheet"), F.lit("shaft").alias("kind"), s.alias("anchor"), (s * 37 % 101).cast("double").alias("x"), (s * 53 % 97).cast("double").alias("y"), F.lit(1.0).alias("area"))
    second = first.withColumn("x", F.col("x") + 3.0 + (s_jitter := (F.col("anchor") % 5 - 2) * 0.01)).withColumn("y", F.col("y") - 164.2 + s_jitter)
    found = spatial.align_sheets(spatial.displacement_pairs(first, second, 0.5, 0.8), first, second)
    return found.select("sheet", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), "votes", F.round("residual", 6).alias("residual"))


@query()
def recognise_equipment(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols without those that repeat an earlier one of the same name within 5 cm."""
    l = table(spark, sf, "lineitem").where("l_linenumber <> 7")
    rows = l.select(F.col("l_suppkey").alias("sheet"), F.col("l_returnflag").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_quantity") * 0.02).alias("x"), (F.col("l_discount") * 3).alias("y"))
    return spatial.first_wins(rows, ["sheet", "name"], 0.05)


@query()
def label_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Room names go to the nearest room that is still without one, in order."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    items = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("floor"), s.alias("ord"), (s * 37 % 50).cast("double").alias("x"), (s * 53 % 50).cast("double").alias("y"))
    places = table(spark, sf, "customer").select(F.col("c_nationkey").alias("floor"), c.alias("place"), (c * 31 % 50).cast("double").alias("x"), (c * 17 % 50).cast("double").alias("y"))
    return spatial.greedy_nearest(items, places, "floor", 5.0)


def _floors(spark: SparkSession, sf: str) -> DataFrame:
    """A floor per supplier, with one wall across it and two devices."""
    s = F.col("s_suppkey")
    wide, high = (s % 20 + 30) * 0.2, (s % 7 + 20) * 0.2
    wall = F.struct((wide * 0.5).alias("x0"), F.lit(-1.0).alias("y0"), (wide * 0.5 + 0.3).alias("x1"), F.when(s % 2 == 0, 99.0).otherwise(high * 0.6).alias("y1"))
    spot = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return table(spark, sf, "supplier").select(s.alias("floor"), wide.alias("width"), high.alias("height"), F.array(wall).alias("walls"), F.array(spot(F.lit(1.0), F.lit(1.0)), spot(wide - 1.5, high - 0.7)).alias("devices"))


_CELLS = """
    WITH f AS (SELECT s_suppkey AS floor, (s_suppkey % 20 + 30) * 0.2::DOUBLE AS w, (s_suppkey % 7 + 20) * 0.2::DOUBLE AS h, s_suppkey % 20 + 30 AS nx, s_suppkey % 7 + 20 AS ny, s_suppkey % 2 AS part FROM supplier),
    c AS (SELECT *, (i + 0.5::DOUBLE) * 0.2::DOUBLE AS x, (j + 0.5::DOUBLE) * 0.2::DOUBLE AS y FROM (SELECT f.*, i, unnest(range(0, ny)) AS j FROM (SELECT f.*, unnest(range(0, nx)) AS i FROM f) f)),
    free AS (SELECT * FROM c WHERE NOT (x >= w * 0.5::DOUBLE AND x <= w * 0.5::DOUBLE + 0.3::DOUBLE AND y <= CASE WHEN part = 0 THEN 99 ELSE h * 0.6::DOUBLE END))
"""


@query(
    _CELLS
    + """SELECT floor, round(count(*) * 0.2::DOUBLE * 0.2::DOUBLE, 2) AS area, round(count(*) FILTER (WHERE (x - 1) * (x - 1) + (y - 1) * (y - 1) > 2.1::DOUBLE * 2.1::DOUBLE AND (x - (w - 1.5::DOUBLE)) * (x - (w - 1.5::DOUBLE)) + (y - (h - 0.7::DOUBLE)) * (y - (h - 0.7::DOUBLE)) > 2.1::DOUBLE * 2.1::DOUBLE) * 0.2::DOUBLE * 0.2::DOUBLE, 2) AS uncovered FROM free GROUP BY 1"""
)
def coverage_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    """Floor area that no sprinkler reaches."""
    return spatial.uncovered(_floors(spark, sf), 2.1)


@query(
    _CELLS
    + """SELECT floor, row_number() OVER (PARTITION BY floor ORDER BY count(*) DESC)::INTEGER AS room, round(count(*) * 0.2::DOUBLE * 0.2::DOUBLE, 2) AS area FROM free GROUP BY floor, CASE WHEN part = 0 AND x > w * 0.5::DOUBLE THEN 1 ELSE 0 END"""
)
def room_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Connected rooms of each floor with their areas, largest first."""
    return spatial.rooms(_floors(spark, sf))


@query("""
    WITH f AS (SELECT s_suppkey AS floor, (s_suppkey % 20 + 30) * 0.2::DOUBLE AS w, (s_suppkey % 7 + 20) * 0.2::DOUBLE AS h, s_suppkey % 20 + 30 AS nx, s_suppkey % 7 + 20 AS ny FROM supplier),
    c AS (SELECT floor, w, h, (i + 0.5::DOUBLE) * 0.2::DOUBLE AS x, (j + 0.5::DOUBLE) * 0.2::DOUBLE AS y FROM (SELECT f.*, i, unnest(range(0, ny)) AS j FROM (SELECT f.*, unnest(range(0, nx)) AS i FROM f) f))
    SELECT floor, round(count(*) FILTER (WHERE greatest(x - w * 0.5::DOUBLE, 0) ** 2 + greatest(y - h * 0.5::DOUBLE, 0) ** 2 > 0.6::DOUBLE * 0.6::DOUBLE) * 0.2::DOUBLE * 0.2::DOUBLE, 2) AS open_area, 1::INTEGER AS counted FROM c GROUP BY floor
""")
def open_floor_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The region of a floor outside its rooms."""
    room = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("width") * 0.5).alias("x1"), (F.col("height") * 0.5).alias("y1"))
    floors = _floors(spark, sf).withColumn("walls", F.slice("walls", 1, 0)).withColumn("rooms", F.array(room))
    return spatial.open_floor(floors)


@query()
def uncovered_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of floor that no sprinkler reaches, without slivers."""
    return spatial.uncovered_pieces(_floors(spark, sf), 2.1)


@query("""
    WITH r AS (SELECT c_nationkey AS floor, c_custkey AS room, (c_custkey * 37 % 100)::DOUBLE AS x0, (c_custkey * 53 % 100)::DOUBLE AS y0, c_custkey * 37 % 100 + 4.0::DOUBLE AS x1, c_custkey * 53 % 100 + 3.0::DOUBLE AS y1 FROM customer),
    p AS (SELECT s_nationkey AS floor, s_suppkey AS part, (s_suppkey * 29 % 100)::DOUBLE AS x0, (s_suppkey * 31 % 100)::DOUBLE AS y0, s_suppkey * 29 % 100 + 6.5::DOUBLE AS x1, s_suppkey * 31 % 100 + 5.5::DOUBLE AS y1 FROM supplier)
    SELECT * FROM (SELECT r.floor, room, part, greatest(least(r.x1, p.x1) - greatest(r.x0, p.x0), 0) * greatest(least(r.y1, p.y1) - greatest(r.y0, p.y0), 0) AS overlap FROM r JOIN p ON r.floor = p.floor) WHERE overlap > 0.05
""")
def rooms_touching(spark: SparkSession, sf: str) -> DataFrame:
    """Rooms that a part of their floor overlaps."""
    box = lambda x, y, w, h: [x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1")]
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    rooms = table(spark, sf, "customer").select(F.col("c_nationkey").alias("floor"), c.alias("room"), *box(c * 37 % 100, c * 53 % 100, 4.0, 3.0))
    return spatial.rooms_touching(rooms, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("floor"), s.alias("part"), *box(s * 29 % 100, s * 31 % 100, 6.5, 5.5)))


@query()
def walk_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Walking distances to the nearest device; beyond the limit, in the grid's error band, unreachable."""
    return spatial.walk_distances(_floors(spark, sf), 4.0)


@query("""
    SELECT o_custkey AS building, o_orderkey AS device, 5 AS level, (5 - CASE WHEN o_orderkey % 10 <= 6 THEN o_custkey % 4 ELSE 0 END)::INTEGER AS lands, o_orderkey % 10 <= 6 AND o_custkey % 4 > 0 AS projected FROM orders
""")
def project_devices(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors over an opening serve the first floor below that is closed."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    devices = o.select(F.col("o_custkey").alias("building"), F.col("o_orderkey").alias("device"), F.lit(5).alias("level"), (F.col("o_orderkey") % 10).cast("double").alias("x"), F.lit(0.0).alias("y"))
    open_ = c.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("building"), F.explode(F.expr("transform(sequence(1, CAST(c_custkey % 4 AS INT)), i -> 6 - i)")).alias("level"), F.lit(0.0).alias("x0"), F.lit(-1.0).alias("y0"), F.lit(6.0).alias("x1"), F.lit(1.0).alias("y1"))
    return spatial.project_down(devices, open_)


@query("""
    SELECT s_nationkey AS building, s_suppkey AS stair, min(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 3) AS component FROM supplier
""")
def stair_components(spark: SparkSession, sf: str) -> DataFrame:
    """Stairs of a building that share a letter are one, across floors."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("building"), F.col("s_suppkey").alias("stair"), (F.col("s_suppkey") % 3).alias("letter"))
    heads = s.groupBy("building", "letter").agg(F.min("stair").alias("head"))
    return graph.components(s.select("building", "stair"), s.join(heads, ["building", "letter"]).select("building", F.col("head").alias("a"), F.col("stair").alias("b")), "building", "stair")


@query("""
    WITH f AS (SELECT l_orderkey AS floor, sum(l_quantity) * 10 AS area, sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE l_linenumber END)::DOUBLE AS low, bool_or(l_discount > 0.08) AS unknown FROM lineitem GROUP BY 1)
    SELECT floor, ceil(area / 100 - 1e-9)::BIGINT AS need, CASE WHEN low >= ceil(area / 100 - 1e-9) THEN NULL WHEN unknown THEN 'YELLOW' ELSE 'RED' END AS severity FROM f
""")
def two_bound_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """extinguishers' capacity under a lenient and a strict reading."""
    capacity = F.when(F.col("l_discount") > 0.08, F.lit(None)).otherwise(F.col("l_linenumber").cast("double"))
    floors = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("floor")).agg((F.sum("l_quantity") * 10).alias("area"), F.collect_list(F.struct(capacity.alias("c"))).alias("x"))
    floors = floors.select("floor", "area", F.transform("x", lambda s: s["c"]).alias("capacities"))
    return rules.extinguisher_count(floors, 100.0).select("floor", "need", "severity")


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    codes = F.array(*[F.lit(c) for c in ("甲-1", "甲-3", "乙-1", "乙-3", "丙-1", "丁-1", "戊-1", "戊-3", "乙-12")])
    buildings = table(spark, sf, "supplier").select(
        s.alias("building"), F.when(s % 10 < 9, F.element_at(codes, (s % 10 + 1).cast("int"))).alias("occupancy"), F.when(s % 18 > 0, (s % 18).cast("int")).alias("stories"),
        F.when(s % 4 > 0, (s % 60).cast("double")).alias("height"), F.when(s % 3 > 0, s * 400.0).alias("site_area"), F.lit(10.0).alias("roof_area"),
    )
    l = table(spark, sf, "lineitem").where("l_linenumber <> 3")
    floors = l.groupBy(F.col("l_suppkey").alias("building"), (F.col("l_linenumber") - 3).alias("level")).agg(F.max("l_quantity").alias("q"))
    return rules.profile(buildings, floors.select("building", F.col("level").cast("string").alias("label"), "level", (F.col("q") * 20).alias("area"), ((F.col("building") + F.col("level")) % 5 == 0).alias("no_opening")))


@query("""
    WITH f AS (SELECT l_suppkey AS b, l_linenumber - 3 AS level, max(l_quantity) * 20 AS area, (l_suppkey + l_linenumber - 3) % 5 = 0 AS closed FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL),
    p AS (SELECT s_suppkey AS b, CASE WHEN s_suppkey % 10 < 9 THEN ['甲-1', '甲-3', '乙-1', '乙-3', '丙-1', '丁-1', '戊-1', '戊-3', '乙-12'][s_suppkey % 10 + 1] END AS occ, coalesce(s_suppkey % 18, 0) AS st,
        CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 60)::DOUBLE END AS height, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 400.0 END AS site,
        coalesce(sum(area), 0) + 10 AS total, coalesce(max(area), 0) AS most, coalesce(max(area) FILTER (WHERE level > 0), 0) AS above, coalesce(max(area) FILTER (WHERE level < 0 OR closed), 0) AS special
        FROM supplier LEFT JOIN f ON f.b = s_suppkey GROUP BY ALL),
    q AS (SELECT *, split_part(coalesce(occ, ''), '-', 1) AS cls FROM p)
    SELECT b AS building, key, CASE WHEN hit THEN 'REQUIRED' WHEN unknown THEN 'UNKNOWN' ELSE 'NOT_REQUIRED' END AS status FROM (
        SELECT b, '14' AS key, cls = '甲' OR coalesce(occ IN ('戊-1', '戊-3', '乙-12'), false) OR (cls IN ('乙', '丙', '丁') AND total >= 150) OR special >= 50 AS hit, occ IS NULL OR cls = '戊' AS unknown FROM q
        UNION ALL SELECT b, '20', (st >= 3 AND most >= 200) OR coalesce(occ = '甲-3', false), st = 0 OR occ IS NULL FROM q
        UNION ALL SELECT b, '26', st >= 7 OR (st IN (5, 6) AND total >= 6000) OR (coalesce(occ = '戊-3', false) AND total >= 1000), st = 0 FROM q
        UNION ALL SELECT b, '27', coalesce(site >= 20000 AND most >= 1500, false) OR coalesce(height > 31 AND total >= 25000, false), (site IS NULL AND most >= 1500) OR (height IS NULL AND total >= 25000) FROM q
        UNION ALL SELECT b, '19', (st BETWEEN 1 AND 5 AND CASE WHEN cls = '甲' OR coalesce(occ = '乙-12', false) THEN above >= 300 ELSE cls IN ('乙', '丙', '丁') AND above >= 500 END) OR (st BETWEEN 6 AND 10 AND above >= 300) OR st >= 11
            OR special >= CASE WHEN coalesce(occ IN ('甲-1', '甲-5'), false) THEN 100 ELSE 300 END OR ((cls = '甲' OR coalesce(occ = '戊-3', false)) AND total >= 300), occ IS NULL OR coalesce(occ IN ('戊-1', '戊-2'), false) OR st = 0 FROM q)
""")
def requirement_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Which equipment buildings need, unknown where data are missing (five of the rules; tests hold the others)."""
    found = rules.requirements(_profiles(spark, sf))
    return found.where(F.col("key").isin("14", "19", "20", "26", "27")).select("building", "key", "status")


#: The same rules in SQL: for each requirement its clauses and what may be missing, with their conditions.
_RULES = {
    "14": ([("14/1/1", "cls = '甲' OR occ IN ('戊-1', '戊-3', '乙-12')"), ("14/1/2", "cls IN ('乙', '丙', '丁') AND total >= 150"), ("14/1/3", "special >= 50")], [("occupancy", "occ = ''"), ("areas by use", "cls = '戊'")]),
    "15": (
        [
            ("15/1/1", "st BETWEEN 1 AND 5 AND cls IN ('甲', '乙', '丙', '丁') AND NOT school AND above >= CASE WHEN occ = '甲-1' THEN 300 ELSE 500 END"),
            ("15/1/2", "st >= 6 AND cls IN ('甲', '乙', '丙', '丁') AND above >= 150"),
            ("15/1/3", "occ = '戊-3' AND total >= 150"),
            ("15/1/4", "cls IN ('甲', '乙', '丙', '丁') AND special >= CASE WHEN occ = '甲-1' THEN 100 ELSE 150 END"),
        ],
        [("occupancy", "occ = ''"), ("areas by use", "occ IN ('戊-1', '戊-2')"), ("stories", "st = 0"), ("whether a school's class room", "st BETWEEN 1 AND 5 AND school")],
    ),
    "16": ([("16/1", "occ = '丁-1' AND lower_two >= 3000")], [("occupancy", "occ = ''")]),
    "17": (
        [
            ("17/1/1", "st BETWEEN 1 AND 10 AND CASE WHEN occ = '甲-1' THEN above_sum >= 300 ELSE (cls = '甲' OR occ = '乙-1') AND above >= 1500 END"),
            ("17/1/2", "eleventh >= 100"),
            ("17/1/3", "cls = '甲' AND special >= 1000"),
            ("17/1/4", "st >= 11 AND (cls = '甲' OR occ = '戊-1')"),
            ("17/1/7", "under"),
            ("17/1/8", "tower"),
        ],
        [("occupancy", "occ = ''"), ("areas by use", "occ IN ('戊-1', '戊-2')"), ("stories", "st = 0"), ("height", "tower IS NULL")],
    ),
    "18": ([], [("uses and areas of rooms", "true")]),
    "19": (_ALARM := [
            ("19/1/1", "st BETWEEN 1 AND 5 AND CASE WHEN cls = '甲' OR occ = '乙-12' THEN above >= 300 ELSE cls IN ('乙', '丙', '丁') AND above >= 500 END"),
            ("19/1/2", "st BETWEEN 6 AND 10 AND above >= 300"),
            ("19/1/3", "st >= 11"),
            ("19/1/4", "special >= CASE WHEN occ IN ('甲-1', '甲-5') THEN 100 ELSE 300 END"),
            ("19/1/6", "(cls = '甲' OR occ = '戊-3') AND total >= 300"),
        ],
        [("occupancy", "occ = ''"), ("areas by use", "occ IN ('戊-1', '戊-2')"), ("stories", "st = 0")],
    ),
    "20": ([("20/1/1", "st >= 3 AND most >= 200"), ("20/1/2", "occ = '甲-3'")], [("occupancy", "occ = ''"), ("stories", "st = 0")]),
    "21": (_GAS := [("21/1/1", "cls = '甲' AND below_sum >= 1000"), ("21/1/3", "under")], [("areas by use", "occ = '戊-1' AND below_sum >= 1000")]),
    "22": ([("22/1", " OR ".join(f"({x})" for _, x in _ALARM + _GAS))], [("occupancy", "occ = ''"), ("areas by use", "occ IN ('戊-1', '戊-2')"), ("stories", "st = 0")]),
    "23-1": ([("23/1", "cls = '甲' OR occ IN ('乙-12', '戊-1', '戊-3') OR marked > 0")], [("occupancy", "occ = ''")]),
    "23-2": ([("23/1", "cls = '甲' OR occ IN ('乙-12', '戊-1', '戊-3') OR marked > 0")], [("occupancy", "occ = ''")]),
    "24": ([("24/1/1", "cls IN ('甲', '丙', '戊')"), ("24/1/2", "occ IN ('乙-1', '乙-12')"), ("24/1/3", "occ <> '乙-3' AND total >= 1000")], [("uses and areas of rooms", "true")]),
    "25": ([], [("places and persons of each floor", "true")]),
    "26": ([("26/1/1", "st >= 7 OR (st IN (5, 6) AND total >= 6000)"), ("26/1/2", "under")], [("stories", "st = 0")]),
    "27": ([("27/1/1", "site >= 20000 AND most >= 1500"), ("27/1/2", "height > 31 AND total >= 25000")], [("site area", "site IS NULL AND most >= 1500"), ("height", "height IS NULL AND total >= 25000")]),
    "28": ([("28/1/1", "(cls = '甲' OR occ = '戊-3') AND total >= 500"), ("28/1/3", "closed_most >= 1000")], [("occupancy", "occ = ''")]),
    "29": ([("29/1/1", "st >= 11"), ("29/1/2", "under")], []),
    "30": ([("30/1/1", "below > 0 AND height >= 100"), ("30/1/2", "under"), ("30/1/3", "below >= 4 AND below_sum >= 3000")], [("height", "below > 0 AND height IS NULL")]),
    "30-1": ([("30-1/1", "coalesce(tower, false) OR total >= 50000 OR under")], [("height", "tower IS NULL")]),
}


def _named_in_sql(conditions: list[tuple[str, str]]) -> str:
    cases = ", ".join("CASE WHEN {} THEN '{}' END".format(x, n.replace("'", "''")) for n, x in conditions)
    return f"array_to_string(list_filter([{cases}]::VARCHAR[], lambda x: x IS NOT NULL), ',')"


@query(
    """
    WITH f AS (SELECT l_suppkey AS b, l_linenumber - 3 AS level, max(l_quantity) * 20 AS area, (l_suppkey + l_linenumber - 3) % 5 = 0 AS closed FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL),
    p AS (SELECT s_suppkey AS b, CASE WHEN s_suppkey % 10 < 9 THEN ['甲-1', '甲-3', '乙-1', '乙-3', '丙-1', '丁-1', '戊-1', '戊-3', '乙-12'][s_suppkey % 10 + 1] ELSE '' END AS occ, s_suppkey % 18 AS st,
        CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 60)::DOUBLE END AS height, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 400.0 END AS site, coalesce(sum(area), 0) + 10 AS total, coalesce(max(area), 0) AS most,
        coalesce(max(area) FILTER (WHERE level > 0), 0) AS above, coalesce(sum(area) FILTER (WHERE level > 0), 0) AS above_sum, coalesce(max(area) FILTER (WHERE level < 0 OR closed), 0) AS special, coalesce(max(area) FILTER (WHERE closed), 0) AS closed_most,
        coalesce(sum(area) FILTER (WHERE level < 0), 0) AS below_sum, count(*) FILTER (WHERE level < 0) AS below, coalesce(sum(area) FILTER (WHERE level IN (1, 2)), 0) AS lower_two, coalesce(max(area) FILTER (WHERE level >= 11), 0) AS eleventh, count(*) FILTER (WHERE level < 0 OR closed) AS marked
        FROM supplier LEFT JOIN f ON f.b = s_suppkey GROUP BY s_suppkey),
    q AS (SELECT *, split_part(occ, '-', 1) AS cls, occ = '戊-3' AND total >= 1000 AS under, occ = '乙-3' AND above >= 500 AND above < 1400 AS school, CASE WHEN coalesce(height >= 50, false) OR st >= 16 THEN true WHEN height IS NULL AND st >= 11 THEN NULL ELSE false END AS tower FROM p)
    SELECT b AS building, key, law, missing, CASE WHEN law <> '' THEN 'REQUIRED' WHEN missing <> '' THEN 'UNKNOWN' ELSE 'NOT_REQUIRED' END AS status FROM (
"""
    + " UNION ALL ".join(f"SELECT b, '{key}' AS key, {_named_in_sql(clauses)} AS law, {_named_in_sql(lacks)} AS missing FROM q" for key, (clauses, lacks) in _RULES.items())
    + ")"
)
def all_requirements(spark: SparkSession, sf: str) -> DataFrame:
    """All requirement rules with the clauses that apply and the data that are missing."""
    found = rules.requirements(_profiles(spark, sf))
    return found.select("building", "key", F.array_join("law", ",").alias("law"), F.array_join("missing", ",").alias("missing"), "status")


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice > 400000 AND o_custkey % 3 = 0 THEN 'BLUE' WHEN o_totalprice > 400000 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'ORANGE' ELSE 'RED' END WHEN o_totalprice > 200000 THEN 'YELLOW' END AS severity FROM orders WHERE o_totalprice > 200000
""")
def adjusted_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Severities lowered for unclear rooms and for what isn't required."""
    o = table(spark, sf, "orders").where("o_totalprice > 200000")
    raw = rules.verdict(F.col("o_totalprice") > 400000, F.lit(True))
    touched = (F.col("o_orderkey") % 4).cast("int")
    found = o.select("o_orderkey", F.col("o_custkey").alias("building"), F.when(F.col("o_totalprice") > 400000, "SIGN").otherwise("OTHER").alias("rule"), rules.severity_for(raw, F.lit(-1), touched).alias("severity"))
    needed = o.select(F.col("o_custkey").alias("building")).distinct().select("building", F.lit("23-1").alias("key"), F.when(F.col("building") % 3 == 0, "NOT_REQUIRED").otherwise("UNKNOWN").alias("status"))
    return rules.downgrade(found, needed, ["SIGN"], "23-1").select("o_orderkey", "severity")


@query("""
    SELECT p_partkey AS room, 'DET-120' AS rule, CASE WHEN have < need_least THEN 'RED' ELSE 'YELLOW' END AS severity, need_least, need_most FROM (
        SELECT p_partkey, p_partkey % 6 AS have, ceil(p_size * 10 / CASE p_partkey % 3 WHEN 0 THEN 90 WHEN 1 THEN 50 ELSE 90 END::DOUBLE - 1e-9)::BIGINT AS need_least, ceil(p_size * 10 / CASE p_partkey % 3 WHEN 0 THEN 90 ELSE 50 END::DOUBLE - 1e-9)::BIGINT AS need_most FROM part)
    WHERE have < need_most
""")
def detector_need(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors of rooms of known and unknown construction."""
    k = F.col("p_partkey")
    fireproof = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    rooms = table(spark, sf, "part").select(k.alias("room"), (F.col("p_size") * 10.0).alias("area"), F.lit(3.0).alias("height"), fireproof.alias("fireproof"), F.lit("差動式").alias("type"), F.lit("1").alias("class"), (k % 6).alias("have"))
    return floor_rules.detector_count(rooms)


@query("""
    SELECT p_partkey AS room, 'S18' AS rule, 'RED' AS severity, kind, lim AS "limit" FROM (
        SELECT p_partkey, p_size * 12.0 AS area, CASE p_partkey % 4 WHEN 0 THEN 'parking' WHEN 1 THEN 'electrical' WHEN 2 THEN 'boiler' END AS kind,
            CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 500.0 WHEN p_partkey % 3 = 1 THEN 200.0 ELSE 300.0 END WHEN 1 THEN 200.0 WHEN 2 THEN 200.0 END AS lim FROM part)
    WHERE area >= lim
""")
def special_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """Rooms by name and area; parking by storey."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("停車場", "電氣室", "廚房", "會議室")]), (k % 4 + 1).cast("int"))
    level = F.when(k % 3 == 0, 1).when(k % 3 == 1, -1).otherwise(4)
    return floor_rules.special_suppression(table(spark, sf, "part").select(k.alias("room"), name.alias("name"), (F.col("p_size") * 12.0).alias("area"), level.alias("level")))


@query("""
    WITH d AS (SELECT c_custkey AS door, (c_custkey * 37 % 400)::DOUBLE AS x, (c_custkey * 91 % 400)::DOUBLE AS y, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 40)::DOUBLE END AS walk FROM customer),
    s AS (SELECT (s_suppkey * 53 % 400)::DOUBLE AS x, (s_suppkey * 29 % 400)::DOUBLE AS y FROM supplier)
    SELECT door, 'EXIT-146-3' AS rule, CASE WHEN walk IS NULL THEN 'YELLOW' ELSE 'RED' END AS severity FROM d
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE sqrt((s.x - d.x) ** 2 + (s.y - d.y) ** 2) <= 3) AND (walk IS NULL OR walk > 20)
""")
def exit_sign_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Doors without a sign near, unless the way out is short."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    doors = table(spark, sf, "customer").select(c.alias("door"), (c * 37 % 400).cast("double").alias("x"), (c * 91 % 400).cast("double").alias("y"), F.when(c % 3 > 0, (c % 40).cast("double")).alias("walk"), F.lit(20.0).alias("exempt_walk"))
    signs = table(spark, sf, "supplier").select(s.alias("target"), (s * 53 % 400).cast("double").alias("x"), (s * 29 % 400).cast("double").alias("y"))
    return floor_rules.exit_signs(doors, signs)


@query("""
    SELECT o_orderkey AS zone, 'SMK-188' AS rule, CASE WHEN reason = 'opening unknown' THEN 'YELLOW' ELSE 'RED' END AS severity, reason FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no vent' WHEN o_orderkey % 41 > 30 THEN 'too far' WHEN o_totalprice / 800 > 500 THEN 'too large' WHEN o_orderkey % 3 > 0 AND o_orderkey % 11 < o_totalprice / 800 * 0.02::DOUBLE THEN 'too little opening' WHEN o_orderkey % 3 = 0 THEN 'opening unknown' END AS reason FROM orders)
    WHERE reason IS NOT NULL
""")
def smoke_vent_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Vents by distance, zone and opening."""
    k = F.col("o_orderkey")
    zones = table(spark, sf, "orders").select(k.alias("zone"), (F.col("o_totalprice") / 800).alias("area"), (k % 7).alias("vents"), (k % 41).cast("double").alias("farthest"), F.when(k % 3 > 0, (k % 11).cast("double")).alias("opening"))
    return floor_rules.smoke_vents(zones)


@query("""
    SELECT p_partkey AS file, 'PIPE' AS rule, 'RED' AS severity, 'riser' AS kind, 50::INTEGER AS mm, 65::INTEGER AS least FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_partkey, 'PIPE', 'RED', 'branch', 20, 25 FROM part WHERE p_partkey % 3 = 2
""")
def pipe_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated pipes that are too thin."""
    text = F.element_at(F.array(F.lit("立管 Ø65"), F.lit("主管 DN50"), F.lit('支管 3/4"')), (F.col("p_partkey") % 3 + 1).cast("int"))
    return floor_rules.pipe_texts(table(spark, sf, "part").select(F.col("p_partkey").alias("file"), text.alias("text")))


@query("""
    SELECT c_custkey AS room, 'EML-24' AS rule, CASE WHEN level = 1 AND w IS NULL THEN 'YELLOW' ELSE 'RED' END AS severity FROM (
        SELECT c_custkey, c_custkey % 4 AS level, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 60)::DOUBLE END AS w, c_mktsegment AS seg FROM customer)
    WHERE seg <> 'BUILDING' AND NOT (level = 1 AND coalesce(w <= 30, false)) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')
""")
def emergency_light_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Rooms without a light that aren't exempt."""
    k = F.col("c_custkey")
    rooms = table(spark, sf, "customer").select(k.alias("room"), F.when(F.col("c_mktsegment") == "BUILDING", "toilet").otherwise("room").alias("kind"), (k % 4).alias("level"), F.when(k % 5 > 0, (k % 60).cast("double")).alias("exit_walk"))
    return floor_rules.emergency_lights(rooms, table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("room")))


@query()
def floor_review(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of the registry over the floors, numbered."""
    return floor_rules.review(_floors(spark, sf))
