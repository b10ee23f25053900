"""Review of whole buildings in one plan (§2.12, L22): projection, rules of floors, rooms and doors, profile, and what follows from it.

A case is a few tables (``Case``); a rule is a function from a case to findings
(floor, rule, severity, subject, measure) and stands in ``RULES`` under its name, where others can be added.  Every
rule is joins and aggregates, or a measure of one floor at a time; floors of all buildings go through together.
A floor without a device of a kind gets no finding about where such devices stand; whether a building
needs them at all is what the requirement clauses say, and a kind that is required and nowhere drawn is a finding of the building.

Edge cases: devices outside of all rooms belong to their floor only; a device over a void goes down to the first
floor that is closed there, if that floor is drawn; nulls in a case's facts make rules answer with both readings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.operators import drawn, floor_rules, planar, rules, spatial
from pyroclast.operators.relational import missing_pairs
from pyroclast.sources.shared import written

FINDING = ["floor", "rule", "severity", "subject", "measure"]
#: Metres between floors where plane operators take the points of all floors at once.
APART = 1_000_000.0
# Walks to an exit that may go without a sign (ground floor, others); storeys for outlets; metres of a storey.
EXIT_WALK, OUTLET_LEVEL, STOREY = (20.0, 10.0), 3, 3.5


@dataclass
class Case:
    """``plans``: PLAN with building and level, ceiling and fireproof (null where unknown); ``equipment``: floor, device, kind, x, y, response, capacity, type, class;
    ``buildings``: building, occupancy, stories, height, site_area, roof_area."""

    plans: DataFrame
    equipment: DataFrame
    buildings: DataFrame
    rooms: DataFrame | None = None
    placed: DataFrame | None = None

    def of(self, *kinds: str) -> DataFrame:
        return self.equipment.where(F.col("kind").isin(*kinds))

    def with_spots(self, *kinds: str, name: str = "devices", **more: Column) -> DataFrame:
        """Plans of the floors that have such devices, with where they stand."""
        spots = self.of(*kinds).groupBy("floor").agg(F.array_sort(F.collect_list(F.struct("x", "y", *[c.alias(k) for k, c in more.items()]))).alias(name))
        return self.plans.join(spots, "floor")


def rooms_of(plans: DataFrame) -> DataFrame:
    """A row for each room: building, floor, level, its own columns and ``id`` floor/room."""
    return plans.select("building", "floor", "level", "label", "ceiling", "fireproof", F.explode("rooms").alias("r")).select("building", "floor", "level", "label", "ceiling", "fireproof", "r.*").withColumn("id", F.concat_ws("/", "floor", "room"))


def rooms_with(equipment: DataFrame, rooms: DataFrame, size: float = 10.0) -> DataFrame:
    """The room that each device stands in, the largest where several do."""
    met = drawn.standing_in(equipment, rooms.select("floor", "room", "id", drawn.ring_edges(F.col("rings")).alias("edges")), size)
    return equipment.join(met.groupBy("floor", "device").agg(F.min_by("id", "room").alias("id")), ["floor", "device"])


def project(case: Case, kinds: tuple[str, ...] = ("detector", "flame_detector")) -> Case:
    """Devices drawn over a void count for the first closed floor below."""
    floors = case.plans.select("building", "level", "floor")
    box = lambda f, k: f(F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[k]))))
    open_ = rooms_of(case.plans).where("kind = 'void'").select("building", "level", box(F.array_min, "x").alias("x0"), box(F.array_min, "y").alias("y0"), box(F.array_max, "x").alias("x1"), box(F.array_max, "y").alias("y1"))
    over = case.of(*kinds).join(floors, "floor").select("building", "device", "level", "x", "y")
    lands = spatial.project_down(over, open_).where("projected").select("device", "building", F.col("lands").alias("level")).join(floors, ["building", "level"]).select("device", F.col("floor").alias("lands"))
    moved = case.equipment.join(lands, "device", "left").withColumn("floor", F.coalesce("lands", "floor")).drop("lands")
    return replace(case, equipment=moved)


def _found(df: DataFrame, rule: str, subject: Column | None = None, measure: Column | None = None) -> DataFrame:
    return df.where("severity IS NOT NULL").select("floor", F.lit(rule).alias("rule"), "severity", (F.lit(None) if subject is None else subject).cast("string").alias("subject"), (F.lit(None) if measure is None else measure).cast("double").alias("measure"))


def _uncovered(plans: DataFrame, radius: float) -> DataFrame:
    """Area of each floor beyond a radius of its devices, and beyond the radius and the margin, by exact overlay."""

    def measure(r: SimpleNamespace, edge, region, walls) -> list[tuple]:
        spots = drawn._spots(r.devices)
        left = [sum(planar.area_of(p) for p in planar.pieces(planar.difference(region, [planar.circle(x, y, reach) for x, y in spots], grid=1e-5))) for reach in (radius, radius + floor_rules.MARGIN)]
        return [(round(left[0], 3), round(left[1], 3))]

    return drawn._measured(plans, {"devices": F.col("devices")}, measure, "floor long, uncovered double, beyond double")


def distance_rule(kind: str, rule: str, radius: float, from_level: int | None = None) -> Callable[[Case], DataFrame]:
    """Every place within ``radius`` of such a device; a little over on under a square metre is marginal."""

    def run(case: Case) -> DataFrame:
        plans = case.with_spots(kind)
        rows = _uncovered(plans if from_level is None else plans.where(F.col("level") >= from_level), radius)
        severity = F.when(F.col("uncovered") > 0, F.when((F.col("beyond") == 0) & (F.col("uncovered") < 1), "ORANGE").otherwise("RED"))
        return _found(rows.withColumn("severity", severity), rule, measure=F.col("uncovered"))

    return run


def sprinklers(case: Case) -> DataFrame:
    rows = drawn.sprinklers_by_room(case.with_spots("sprinkler", name="heads", response=F.col("response")))
    return _found(rows, "SPK-46", F.concat_ws("/", "floor", "room"), F.when(F.col("lenient") > 0, F.col("lenient")).otherwise(F.col("strict")))


def extinguisher_walk(case: Case) -> DataFrame:
    rows = drawn.walks_by_room(case.with_spots("extinguisher"), floor_rules.EXTINGUISHER_WALK).where("kind NOT IN ('stair', 'toilet', 'shaft')")
    severity = F.when(F.col("beyond_sure") > 0, "RED").when(F.col("beyond") > 0, "ORANGE").when(F.col("unreachable") >= 1, "YELLOW")
    return _found(rows.withColumn("severity", severity), "EXT-31-3", F.concat_ws("/", "floor", "room"), F.col("farthest"))


def extinguisher_count(case: Case, per: float = 100.0) -> DataFrame:
    have = case.of("extinguisher").groupBy("floor").agg(F.collect_list(F.struct(F.col("capacity").alias("c"))).alias("x"))
    rows = case.plans.join(have, "floor").select("floor", F.col("region_area").alias("area"), F.transform("x", lambda s: s["c"].cast("double")).alias("capacities"))
    return _found(rules.extinguisher_count(rows, per), "EXT-31-1", measure=F.col("need"))


def _flat(df: DataFrame) -> DataFrame:
    """Points of all floors in one plane, floors far apart."""
    return df.withColumn("x", F.col("x") + F.col("floor") * APART)


def electrical_rooms(case: Case) -> DataFrame:
    """One extinguisher for each begun 100 m² within three metres of the middle of an electrical room."""
    mid = lambda k: (F.array_min(F.transform(F.col("rings")[0], lambda p: p[k])) + F.array_max(F.transform(F.col("rings")[0], lambda p: p[k]))) / 2
    rooms = _flat(case.rooms.where("kind = 'electrical'").select("floor", F.col("id").alias("room"), "area", mid("x").alias("x"), mid("y").alias("y")))
    found = floor_rules.devices_near_rooms(rooms, _flat(case.of("extinguisher")).select("device", "x", "y"))
    return _found(found.join(case.rooms.select("floor", F.col("id").alias("room")), "room"), "EXT-31-2", F.col("room"), F.col("need"))


def detectors(case: Case) -> DataFrame:
    """Detectors of the rooms that have some, by type, class, height and construction."""
    have = case.placed.where("kind = 'detector'").groupBy("id").agg(F.min("type").alias("type"), F.min("class").alias("class"), F.count("*").alias("have"))
    rooms = case.rooms.join(have, "id").select(F.col("id").alias("room"), "area", F.col("ceiling").alias("height"), "fireproof", "type", "class", "have")
    found = floor_rules.detector_count(rooms).withColumnRenamed("room", "id").join(case.rooms.select("floor", "id"), "id")
    return _found(found, "DET-120", F.col("id"), F.col("need_least"))


def suppression(case: Case) -> DataFrame:
    found = floor_rules.special_suppression(case.rooms.select(F.col("id").alias("room"), "name", "area", "level")).withColumnRenamed("room", "id")
    return _found(found.join(case.rooms.select("floor", "id"), "id"), "S18", F.col("id"), F.col("limit"))


def exit_signs(case: Case) -> DataFrame:
    """Doors to the outside on the ground floor and doors of stairs without a sign within three metres.

    Doors drawn on an unbroken wall, with a short walk to all they serve, or without floor beside them are to be confirmed.
    """
    plans = case.with_spots("exit_sign", name="signs")
    doors = drawn.doors_of_plans(plans).join(case.plans.select("floor", "level"), "floor")
    ground = F.col("level") == 1
    doors = doors.where(F.col("stair") | (ground & F.col("side").isin("open", "wall"))).withColumn("id", F.concat_ws("/", "floor", "door"))
    near = spatial.nearest_within(_flat(doors).select("id", "x", "y"), _flat(case.of("exit_sign")).select(F.col("device").alias("target"), "x", "y"), floor_rules.SIGN_NEAR)
    rows = doors.join(near.where("target IS NULL").select("id"), "id")
    short = F.coalesce(F.col("reach") <= F.when(ground, EXIT_WALK[0]).otherwise(EXIT_WALK[1]), F.lit(False)) & (F.col("stair") != ground) & (F.col("level") > 0)
    unsure = (F.col("side") == "wall") | short | (F.col("stair") & F.col("reach").isNull())
    return _found(rows.withColumn("severity", F.when(F.coalesce(unsure, F.lit(False)), "ORANGE").otherwise("RED")), "EXIT-146-3", F.col("id"), F.col("reach"))


def direction_lights(case: Case) -> DataFrame:
    """Corridors beyond the walking reach of lights: of the largest grade for sure, of the smallest if grades are unknown."""
    plans = case.with_spots("direction_light")
    plans = plans.withColumn("rooms", F.filter("rooms", lambda r: r["kind"] == "corridor")).where(F.size("rooms") > 0)
    wide, narrow = drawn.walks_by_room(plans, max(floor_rules.LIGHT_REACH.values())), drawn.walks_by_room(plans, min(floor_rules.LIGHT_REACH.values()))
    rows = wide.join(narrow.select("floor", "room", F.col("beyond").alias("strict")), ["floor", "room"])
    severity = F.when(F.col("beyond_sure") > 0, "RED").when(F.col("strict") > 0, "YELLOW")
    return _found(rows.withColumn("severity", severity), "DIR-146-3", F.concat_ws("/", "floor", "room"), F.col("farthest"))


def emergency_lights(case: Case) -> DataFrame:
    """Rooms without a light on floors that have some."""
    floors = case.of("emergency_light").select("floor").distinct()
    rooms = case.rooms.join(floors, "floor").where("kind NOT IN ('void', 'outdoor', 'shaft', 'elevator')").select(F.col("id").alias("room"), "kind", "level", F.lit(None).cast("double").alias("exit_walk"))
    found = floor_rules.emergency_lights(rooms, case.placed.where("kind = 'emergency_light'").select(F.col("id").alias("room"))).withColumnRenamed("room", "id")
    return _found(found.join(case.rooms.select("floor", "id"), "id"), "EML-24", F.col("id"))


def outlet_stairs(case: Case) -> DataFrame:
    """Outlets from the third storey on farther than five metres from every stair of their floor."""
    outlets = case.of("standpipe_outlet").join(case.plans.where(F.col("level") >= OUTLET_LEVEL).select("floor"), "floor")
    stairs = case.rooms.where("kind = 'stair'").select("floor", drawn.ring_edges(F.col("rings")).alias("edges"))
    x, y = F.col("x"), F.col("y")
    away = F.when(drawn.in_rings(x, y, F.col("edges")), 0.0).otherwise(F.array_min(F.transform("edges", lambda e: drawn.edge_distance(x, y, e))))
    near = outlets.join(stairs, "floor").groupBy("floor", "device").agg(F.min(away).alias("away"))
    rows = outlets.join(near, ["floor", "device"], "left").where("away IS NULL OR away > 5")
    return _found(rows.withColumn("severity", F.lit("ORANGE")), "SDP-180-stair", F.col("device"), F.col("away"))


def stair_speakers(case: Case) -> DataFrame:
    """Speakers in the stairs of one name across the storeys of a building (L20); the finding is of its lowest floor."""
    stairs = case.rooms.where("kind = 'stair' AND NOT conflict").withColumn("stair", F.concat_ws("/", "building", "name"))
    z = (F.col("level") - 1) * STOREY
    spans = stairs.groupBy("stair").agg(F.min(z).alias("low"), F.max(z + STOREY).alias("high"), F.min_by("floor", "level").alias("floor"))
    speakers = case.placed.where("kind = 'speaker'").select("id").join(stairs.select("id", "stair", z.alias("z")), "id").select("stair", "z")
    some = case.of("speaker").join(case.plans.select("floor", "building"), "floor").select("building").distinct()
    heard = spans.join(stairs.join(some, "building").select("stair").distinct(), "stair")
    found = floor_rules.stair_speakers(speakers, heard.select("stair", "low", "high")).join(spans.select("stair", "floor"), "stair")
    return _found(found, "SPKR-133-5", F.col("stair"), F.col("need"))


#: Rules by name (L01, N02): a rule of one's own is one more entry, given as ``extra``.
RULES: dict[str, Callable[[Case], DataFrame]] = {
    "SPK-46": sprinklers, "HYD-34": distance_rule("hydrant", "HYD-34", floor_rules.HYDRANT), "SPKR-133": distance_rule("speaker", "SPKR-133", floor_rules.SPEAKER),
    "SDP-180": distance_rule("standpipe_outlet", "SDP-180", floor_rules.OUTLET, OUTLET_LEVEL), "SDP-180-stair": outlet_stairs, "EXT-31-1": extinguisher_count, "EXT-31-2": electrical_rooms, "EXT-31-3": extinguisher_walk,
    "DET-120": detectors, "S18": suppression, "EXIT-146-3": exit_signs, "DIR-146-3": direction_lights, "EML-24": emergency_lights, "SPKR-133-5": stair_speakers,
}
#: Rules of signs that are voluntary where the requirement doesn't hold.
VOLUNTARY = {"EXIT-146-3": "23-1", "DIR-146-3": "23-2"}


def building_profile(case: Case) -> DataFrame:
    """The sums that requirement clauses read, from the plans."""
    floors = case.plans.select("building", "label", "level", F.col("region_area").alias("area"), F.lit(False).alias("no_opening"), "ceiling")
    has = lambda kind: F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False))
    kinds = case.rooms.groupBy("building").agg(has("electrical").alias("has_electrical"), has("kitchen").alias("has_kitchen"))
    return rules.profile(case.buildings, floors).join(kinds, "building", "left").na.fill(False, ["has_electrical", "has_kitchen"])


def review(case: Case, asked: list[str] | None = None, extra: dict[str, Callable[[Case], DataFrame]] | None = None, policy: dict[str, bool] | None = None) -> DataFrame:
    """All findings of each building, numbered by severity, rule, floor and subject: building, no and a finding's columns.

    What requirements ask for and nothing shows is a finding without a floor.  ``policy`` switches passes off (L21).
    """
    on = rules.POLICY | (policy or {})
    case = replace(case, plans=written(case.plans, "plans"), equipment=written(case.equipment, "equipment"))
    case = project(case)
    case = replace(case, equipment=written(case.equipment, "equipment"), rooms=written(rooms_of(case.plans), "rooms"))
    case = replace(case, placed=written(rooms_with(case.equipment, case.rooms), "placed"))
    known = RULES | (extra or {})
    names = [n for n in (asked or list(known)) if on["stair_speakers"] or n != "SPKR-133-5"]
    of_floors = [known[n](case).select(*FINDING) for n in names]
    building = case.plans.select("floor", "building")
    required = written(rules.requirements(building_profile(case)), "requirements")
    found = reduce(DataFrame.unionByName, of_floors).join(building, "floor").select("building", *FINDING) if of_floors else None
    asked_kinds = required.where("status = 'REQUIRED' AND size(kinds) > 0").select("building", "key", "equipment", F.explode("kinds").alias("kind"))
    shown = case.equipment.join(building, "floor").select("building", "kind").distinct()
    present = asked_kinds.join(shown, ["building", "kind"]).select("building", "key").distinct()
    absent = missing_pairs(asked_kinds.select("building", "key", "equipment").distinct(), present, ["building", "key"])
    missing = absent.select("building", F.lit(None).cast(dict(case.plans.dtypes)["floor"]).alias("floor"), F.concat(F.lit("REQ-"), "key").alias("rule"), F.lit("RED").alias("severity"), F.col("equipment").alias("subject"), F.lit(None).cast("double").alias("measure"))
    rows = missing if found is None else found.unionByName(missing)
    if on["voluntary_signs"]:
        for rule, key in VOLUNTARY.items():
            rows = rules.downgrade(rows, required, [rule], key)
    rank = reduce(lambda rest, s: F.when(F.col("severity") == s[1], s[0]).otherwise(rest), enumerate(rules.SEVERITY), F.lit(9))
    w = Window.partitionBy("building").orderBy(rank, "rule", F.asc_nulls_last("floor"), "subject")
    return rows.withColumn("no", F.row_number().over(w)).select("building", "no", *FINDING)
