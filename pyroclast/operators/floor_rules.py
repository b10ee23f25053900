"""Rules for one floor (§2.12), each a function from DataFrames to findings.

Findings have floor, rule, severity and measures.  A floor without any device of
a kind gets no finding here: whether it needs one is for the requirement rules.
Coverage and walking distances come from the rasters of
:mod:`~pyroclast.operators.spatial`; the rest are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyroclast.operators import rules, spatial
from pyroclast.operators.relational import missing_pairs

# Square metres that one heat detector serves, by type, class and height band (fireproof, other).
HEAT_AREA = [
    ("差動式", "1", "lt4", 90.0, 50.0), ("差動式", "1", "4to8", 45.0, 30.0), ("差動式", "2", "lt4", 70.0, 40.0), ("差動式", "2", "4to8", 35.0, 25.0),
    ("補償式", "1", "lt4", 90.0, 50.0), ("補償式", "1", "4to8", 45.0, 30.0), ("補償式", "2", "lt4", 70.0, 40.0), ("補償式", "2", "4to8", 35.0, 25.0),
    ("定溫式", "特種", "lt4", 70.0, 40.0), ("定溫式", "特種", "4to8", 35.0, 25.0), ("定溫式", "1", "lt4", 60.0, 30.0), ("定溫式", "1", "4to8", 30.0, 15.0), ("定溫式", "2", "lt4", 20.0, 15.0),
]
# The same for smoke detectors, by class and height band.
SMOKE_AREA = [("1", "lt4", 150.0), ("1", "4to15", 75.0), ("1", "15to20", 75.0), ("2", "lt4", 150.0), ("2", "4to15", 75.0), ("3", "lt4", 50.0)]
# Rooms that need special suppression from an area on; parking by storey (first, upper, below).
SPECIAL_ROOMS = [("electrical", "發電機|變壓器|變電|配電室|電氣室|受電", 200.0), ("boiler", "鍋爐|廚房", 200.0), ("telecom", "電信機|電腦室|總機室|伺服器", 200.0), ("parking", "停車|汽車修", None), ("aircraft", "飛機修理|機庫", 200.0)]
PARKING_AREA = {"first": 500.0, "below": 200.0, "upper": 300.0}
# Metres. Hydrants, speakers and outlets; margin; extinguishers' walk; signs near doors; lights' reach by grade; smoke vents.
HYDRANT, SPEAKER, OUTLET, MARGIN = 25.0, 10.0, 50.0, 0.3
EXTINGUISHER_WALK, SIGN_NEAR, OUTLET_STAIR = 20.0, 3.0, 5.0
LIGHT_REACH = {"A": 20.0, "B": 15.0, "C": 10.0}
VENT_DISTANCE, VENT_ZONE, VENT_SHARE = 30.0, 500.0, 0.02
# Least millimetres of pipes by what their text names.
PIPE_LEAST = [("riser", "立管|主管", 65), ("branch", "支管", 25), ("test_valve", "查驗管|末端", 25)]


def horizontal_distance(floors: DataFrame, rule: str, radius: float) -> DataFrame:
    """Every place within ``radius`` of a device; a little over on under 1 m² is marginal."""
    equipped = floors.where(F.size("devices") > 0)
    plain = spatial.uncovered(equipped, radius)
    wider = spatial.uncovered(equipped, radius + MARGIN).select("floor", F.col("uncovered").alias("beyond_margin"))
    rows = plain.join(wider, "floor").where("uncovered > 0")
    marginal = (F.col("beyond_margin") == 0) & (F.col("uncovered") < 1)
    return rows.select("floor", F.lit(rule).alias("rule"), rules.verdict(F.lit(True), F.lit(True), marginal).alias("severity"), "uncovered")


def sprinkler_distance(floors: DataFrame, lenient: float = 2.6, strict: float = 2.1) -> DataFrame:
    """Coverage by the largest and the smallest radius that the unknown response and construction allow, and how many heads to add."""
    equipped = floors.where(F.size("devices") > 0)
    wide = spatial.uncovered(equipped, lenient).select("floor", F.col("uncovered").alias("lenient"))
    narrow = spatial.uncovered(equipped, strict).select("floor", F.col("uncovered").alias("strict"))
    rows = wide.join(narrow, "floor")
    rows = rows.withColumn("severity", rules.verdict(F.col("lenient") >= 0.2, F.col("strict") >= 0.2)).where("severity IS NOT NULL")
    return rows.select("floor", F.lit("SPK-46").alias("rule"), "severity", F.ceil(F.col("strict") / (2 * strict * strict)).cast("long").alias("add"))


def extinguisher_walk(floors: DataFrame, limit: float = EXTINGUISHER_WALK) -> DataFrame:
    """Walking distance: RED beyond the grid's error, ORANGE within it, YELLOW where a square metre can't be reached."""
    rows = spatial.walk_distances(floors.where(F.size("devices") > 0), limit)
    severity = F.when(F.col("beyond_sure") > 0, "RED").when(F.col("beyond") > 0, "ORANGE").when(F.col("unreachable") >= 1, "YELLOW")
    return rows.withColumn("severity", severity).where("severity IS NOT NULL").select("floor", F.lit("EXT-31-3").alias("rule"), "severity", "farthest", "unreachable")


def devices_near_rooms(rooms: DataFrame, devices: DataFrame, radius: float = 3.0, per: float = 100.0) -> DataFrame:
    """One device for each begun ``per`` m² within ``radius`` of a room's centre.

    ``rooms``: room, x, y, area; ``devices``: device, x, y.  Rooms, and devices, that stand in one place meet as one: places are
    paired on grid cells, and a room has as many devices as stand near its place.  A room or device with several places counts by itself, once.
    """
    def placed(df: DataFrame, key: str, p: str) -> DataFrame:
        """Rows (key, crowd, x, y): a crowd is all that stand in one place and in no other, or one that stands in several."""
        rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col("x").alias(p + "x"), F.col("y").alias(p + "y"))
        at = F.struct(p + "x", p + "y")
        ends = rows.groupBy("k").agg(F.min(at).alias("low"), F.max(at).alias("high"))
        several = F.col("low") != F.col("high")
        crowds = ends.select("k", F.struct(F.when(several, F.col("k")).alias("k"), F.when(~several, F.col("low")).alias("at")).alias(p + "crowd"))
        return rows.join(crowds, "k")

    r, d = placed(rooms, "room", "r"), placed(devices, "device", "d")
    x, y = F.col("dx"), F.col("dy")
    near = d.select("dcrowd", "dx", "dy").distinct().withColumn("cell", F.explode(spatial.cells(x - radius, y - radius, x + radius, y + radius, radius)))
    cell = F.struct(F.floor(F.col("rx") / radius).cast("long").alias("i"), F.floor(F.col("ry") / radius).cast("long").alias("j"))
    met = r.select("rcrowd", "rx", "ry").distinct().withColumn("cell", cell).join(near, "cell").where(F.hypot(F.col("rx") - F.col("dx"), F.col("ry") - F.col("dy")) <= radius)
    many = d.groupBy("dcrowd").agg(F.count_distinct("k").alias("many"))
    by_crowd = met.select("rcrowd", "dcrowd").distinct().join(many, "dcrowd").groupBy("rcrowd").agg(F.sum("many").alias("have"))
    have = r.select("k", "rcrowd").distinct().join(by_crowd, "rcrowd").select(F.col("k").alias("room"), "have")
    rows = rooms.select("room", rules.needed(F.col("area"), per).alias("need")).join(have, "room", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return rows.where("have < need").select("room", F.lit("EXT-31-2").alias("rule"), F.lit("RED").alias("severity"), "need", "have")


def detector_count(rooms: DataFrame) -> DataFrame:
    """Detectors of each room against the need under both readings.

    ``rooms``: room, area, height, fireproof (null where unknown), type, class, have.
    A height that no area is listed for is not allowed and fails both ways.
    """
    spark = rooms.sparkSession
    heat = spark.createDataFrame(HEAT_AREA, "type string, class string, band string, fire double, other double")
    smoke = spark.createDataFrame([("偵煙式", c, b, a, a) for c, band, a in SMOKE_AREA for b in {"lt4": ["lt4"], "4to15": ["4to8", "8to15"], "15to20": ["15to20"]}[band]], heat.schema)
    rows = rooms.withColumn("band", rules.height_band(F.col("height"))).join(F.broadcast(heat.unionByName(smoke)), ["type", "class", "band"], "left")
    best = F.when(F.col("fireproof"), F.col("fire")).when(~F.col("fireproof"), F.col("other")).otherwise(F.greatest("fire", "other"))
    worst = F.when(F.col("fireproof"), F.col("fire")).when(~F.col("fireproof"), F.col("other")).otherwise(F.least("fire", "other"))
    rows = rows.withColumn("need_least", rules.needed(F.col("area"), best)).withColumn("need_most", rules.needed(F.col("area"), worst))
    unlisted = F.col("fire").isNull() & F.col("band").isNotNull()
    severity = F.when(unlisted, "RED").otherwise(rules.verdict(F.col("have") < F.col("need_least"), F.col("have") < F.col("need_most")))
    return rows.withColumn("severity", severity).where("severity IS NOT NULL").select("room", F.lit("DET-120").alias("rule"), "severity", "need_least", "need_most")


def special_suppression(rooms: DataFrame) -> DataFrame:
    """Rooms whose name and area ask for special suppression (L09). ``rooms``: room, name, area, level."""
    kind = reduce(lambda rest, r: F.when(F.col("name").rlike(r[1]), r[0]).otherwise(rest), reversed(SPECIAL_ROOMS), F.lit(None).cast("string"))
    parking = F.when(F.col("level") == 1, PARKING_AREA["first"]).when(F.col("level") < 0, PARKING_AREA["below"]).otherwise(PARKING_AREA["upper"])
    limit = reduce(lambda rest, r: F.when(kind == r[0], parking if r[2] is None else F.lit(r[2])).otherwise(rest), SPECIAL_ROOMS, F.lit(None).cast("double"))
    rows = rooms.withColumn("kind", kind).withColumn("limit", limit)
    return rows.where(F.col("area") >= F.col("limit")).select("room", F.lit("S18").alias("rule"), F.lit("RED").alias("severity"), "kind", "limit")


def exit_signs(doors: DataFrame, signs: DataFrame) -> DataFrame:
    """Doors without a sign within three metres, unless the way is short.

    ``doors``: door, x, y, walk (metres, null unknown), exempt_walk; ``signs``: target, x, y.
    """
    found = spatial.nearest_within(doors.withColumnRenamed("door", "id"), signs, SIGN_NEAR)
    rows = doors.join(found.withColumnRenamed("id", "door"), "door").where("target IS NULL")
    severity = rules.verdict(F.col("walk") > F.col("exempt_walk"), F.coalesce(F.col("walk") > F.col("exempt_walk"), F.lit(True)))
    return rows.withColumn("severity", severity).where("severity IS NOT NULL").select("door", F.lit("EXIT-146-3").alias("rule"), "severity")


def direction_lights(floors: DataFrame, grade: str = "B") -> DataFrame:
    """Places beyond the walking reach of lights of a grade."""
    rows = extinguisher_walk(floors, LIGHT_REACH[grade])
    return rows.withColumn("rule", F.lit("DIR-146-3"))


def emergency_lights(rooms: DataFrame, devices: DataFrame) -> DataFrame:
    """Rooms without a light, but toilets, stores and rooms by an exit on the first floor.

    ``rooms``: room, kind, level, exit_walk; ``devices``: room.
    """
    exempt = F.col("kind").isin("toilet", "storage", "machine") | ((F.col("level") == 1) & F.coalesce(F.col("exit_walk") <= 30, F.lit(False)))
    dark = missing_pairs(rooms.where(~F.coalesce(exempt, F.lit(False))), devices, ["room"])
    severity = F.when((F.col("level") == 1) & F.col("exit_walk").isNull(), "YELLOW").otherwise("RED")
    return dark.select("room", F.lit("EML-24").alias("rule"), severity.alias("severity"))


def smoke_vents(zones: DataFrame) -> DataFrame:
    """Zones without a vent, too far from one, too large, or with too little opening.

    ``zones``: zone, area, vents, farthest, opening (m², null where unknown).
    """
    reason = (
        F.when(F.col("vents") == 0, "no vent").when(F.col("farthest") > VENT_DISTANCE, "too far").when(F.col("area") > VENT_ZONE, "too large")
        .when(F.col("opening") < F.col("area") * VENT_SHARE, "too little opening").when(F.col("opening").isNull(), "opening unknown")
    )
    rows = zones.withColumn("reason", reason).where("reason IS NOT NULL")
    return rows.select("zone", F.lit("SMK-188").alias("rule"), F.when(F.col("reason") == "opening unknown", "YELLOW").otherwise("RED").alias("severity"), "reason")


def standpipe_outlets(outlets: DataFrame, stairs: DataFrame) -> DataFrame:
    """Outlets farther than five metres from every stair (L14). ``outlets``: id, x, y; ``stairs``: target, x, y."""
    found = spatial.nearest_within(outlets, stairs, OUTLET_STAIR)
    return found.where("target IS NULL").select("id", F.lit("SDP-180").alias("rule"), F.lit("ORANGE").alias("severity"))


def pipe_texts(texts: DataFrame) -> DataFrame:
    """Annotated pipes thinner than their kind allows (L15, H20). ``texts``: file, text."""
    from pyroclast.functions.text import pipe_size

    kind = reduce(lambda rest, r: F.when(F.col("text").rlike(r[1]), r[0]).otherwise(rest), reversed(PIPE_LEAST), F.lit(None).cast("string"))
    least = reduce(lambda rest, r: F.when(kind == r[0], r[2]).otherwise(rest), PIPE_LEAST, F.lit(None).cast("int"))
    rows = texts.withColumn("mm", pipe_size(F.col("text"))).withColumn("kind", kind).withColumn("least", least)
    return rows.where("mm < least").select("file", F.lit("PIPE").alias("rule"), F.lit("RED").alias("severity"), "kind", "mm", "least")


def stair_speakers(speakers: DataFrame, stairs: DataFrame, span: float = 15.0) -> DataFrame:
    """Stairs whose speakers are too few or too far apart in height (L20, E09). ``speakers``: stair, z; ``stairs``: stair, low, high."""
    from pyspark.sql import Window

    ends = stairs.select("stair", F.explode(F.array("low", "high")).alias("z"))
    w = Window.partitionBy("stair").orderBy("z")
    gaps = speakers.select("stair", "z").unionByName(ends).withColumn("gap", F.lead("z").over(w) - F.col("z")).groupBy("stair").agg(F.max("gap").alias("gap"))
    have = speakers.groupBy("stair").agg(F.count("*").alias("have"))
    need = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / span - 1e-9)).cast("long")
    rows = stairs.withColumn("need", need).join(have, "stair", "left").join(gaps, "stair", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    severity = F.when(F.col("high").isNull() | F.col("low").isNull(), "YELLOW").when(F.col("have") < F.col("need"), "RED").when(F.col("gap") > span, "ORANGE")
    return rows.withColumn("severity", severity).where("severity IS NOT NULL").select("stair", F.lit("SPKR-133-5").alias("rule"), "severity", "need", "have")


#: Rules that take floors with their devices; another rule is one more entry.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "HYD-34": lambda floors: horizontal_distance(floors, "HYD-34", HYDRANT),
    "SPKR-133": lambda floors: horizontal_distance(floors, "SPKR-133", SPEAKER),
    "SDP-180": lambda floors: horizontal_distance(floors, "SDP-180", OUTLET),
    "SPK-46": sprinkler_distance,
    "EXT-31-3": extinguisher_walk,
    "DIR-146-3": direction_lights,
}


def review(floors: DataFrame, asked: list[str] | None = None, extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Findings of all rules, numbered by severity within each floor."""
    from pyspark.sql import Window

    known = REGISTRY | (extra or {})
    found = [known[r](floors).select("floor", "rule", "severity") for r in (asked or list(known))]
    rank = reduce(lambda rest, s: F.when(F.col("severity") == s[1], s[0]).otherwise(rest), enumerate(rules.SEVERITY), F.lit(9))
    w = Window.partitionBy("floor").orderBy(rank, "rule")
    return reduce(DataFrame.unionByName, found).withColumn("no", F.row_number().over(w))
