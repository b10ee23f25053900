"""Rules with three outcomes (§2.12).

An unknown input never counts as false: a rule is judged by a lenient and by a
strict reading, and what fails only under the strict one asks for the missing
data.  Requirement clauses are boolean columns over a building's profile; null
means unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Policy switches and their defaults, and the order of severities.
POLICY = {"exit_reach": True, "direction_policy": True, "stair_speakers": True, "voluntary_signs": True, "shaft_exempt": True}
SEVERITY = ["RED", "ORANGE", "YELLOW", "BLUE"]

# Bounds of ceiling heights in metres, by band.
HEIGHT_BANDS = [("lt4", 4), ("4to8", 8), ("8to15", 15), ("15to20", 20)]


# What each requirement asks for, and the kinds of symbols that show it on plans.
EQUIPMENT = {
    "14": ("滅火器", ["extinguisher"]),
    "15": ("室內消防栓設備", ["hydrant"]),
    "16": ("室外消防栓設備", []),
    "17": ("自動撒水設備", ["sprinkler"]),
    "18": ("水霧、泡沫、二氧化碳、鹵化烴或乾粉滅火設備", []),
    "19": ("火警自動警報設備", ["detector", "flame_detector"]),
    "20": ("手動報警設備", ["manual_alarm"]),
    "21": ("瓦斯漏氣火警自動警報設備", ["gas_detector"]),
    "22": ("緊急廣播設備", ["speaker"]),
    "23-1": ("出口標示燈", ["exit_sign"]),
    "23-2": ("避難方向指示燈", ["direction_light"]),
    "24": ("緊急照明設備", ["emergency_light"]),
    "25": ("避難器具", []),
    "26": ("連結送水管", ["standpipe_outlet"]),
    "27": ("消防專用蓄水池", []),
    "28": ("排煙設備", ["smoke_vent"]),
    "29": ("緊急電源插座", ["emergency_outlet"]),
    "30": ("無線電通信輔助設備", []),
    "30-1": ("防災監控系統綜合操作裝置", []),
}


def verdict(fails_lenient: Column, fails_strict: Column, marginal: Column | None = None) -> Column:
    """RED if even the lenient reading fails (ORANGE if marginal), YELLOW if only the strict one does; null if none."""
    red = F.when(F.coalesce(marginal, F.lit(False)), "ORANGE").otherwise("RED") if marginal is not None else F.lit("RED")
    return F.when(F.coalesce(fails_lenient, F.lit(False)), red).when(F.coalesce(fails_strict, F.lit(True)), "YELLOW")


def severity_for(severity: Column, unclear: Column, touched: Column) -> Column:
    """RED becomes ORANGE where every touched room is unclear, or none was touched."""
    return F.when((severity == "RED") & ((touched == 0) | (unclear == touched)), "ORANGE").otherwise(severity)


def switched(policy: Column, key: str, defaults: dict[str, bool] = POLICY) -> Column:
    """A policy switch of a case, or its default."""
    return F.coalesce(F.try_element_at(policy, F.lit(key)), F.lit(defaults[key]))


def height_band(height: Column) -> Column:
    return reduce(lambda rest, b: F.when(height < b[1], b[0]).otherwise(rest), reversed(HEIGHT_BANDS), F.when(height.isNotNull(), "ge20"))


def needed(area: Column, per: Column | float) -> Column:
    """Devices for an area, one for each begun share (L06 to L08); null if either is unknown."""
    return F.ceil(area / per - F.lit(1e-9)).cast("long")


def extinguisher_count(floors: DataFrame, per: float) -> DataFrame:
    """Capacity against need: unknown capacities count 1 at least and any number at most.

    ``floors``: floor, area, capacities (array of doubles, null where unknown).
    """
    low = F.aggregate("capacities", F.lit(0.0), lambda s, c: s + F.coalesce(c, F.lit(1.0)))
    high = F.when(F.exists("capacities", lambda c: c.isNull()), float("inf")).otherwise(low)
    rows = floors.withColumn("need", needed(F.col("area"), per)).withColumn("low", low).withColumn("high", high)
    return rows.withColumn("severity", verdict(F.col("high") < F.col("need"), F.col("low") < F.col("need")))


def high_rise(height: Column, stories: Column) -> Column:
    """50 m or 16 storeys; unknown from 11 storeys where the height is."""
    return F.when((height >= 50) | (stories >= 16), True).when(height.isNull() & (stories >= 11), F.lit(None)).otherwise(False)


def profile(buildings: DataFrame, floors: DataFrame) -> DataFrame:
    """One row a building with the sums that requirement clauses read.

    ``buildings``: building, occupancy, stories, height, site_area, roof_area.
    ``floors``: building, label, level, area, no_opening and, where known, ceiling (metres); the first sheet of a label counts.
    """
    w = Window.partitionBy("building", "label").orderBy(F.desc("area"))
    once = floors.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    special = (F.col("level") < 0) | F.col("no_opening")
    tall = F.coalesce(F.col("ceiling") > 10, F.lit(False)) if "ceiling" in floors.columns else F.lit(False)
    biggest = lambda c: F.coalesce(F.max(F.when(c, F.col("area"))), F.lit(0.0))
    sums = once.groupBy("building").agg(
        F.sum("area").alias("floor_area"), F.max("area").alias("max_floor"), biggest(F.col("level") > 0).alias("max_above"), biggest((F.col("level") > 0) & tall).alias("max_tall"), biggest((F.col("level") > 0) & ~tall).alias("max_not_tall"), F.coalesce(F.sum(F.when(F.col("level") > 0, F.col("area"))), F.lit(0.0)).alias("above_area"),
        biggest(special).alias("max_special"), biggest(F.col("no_opening")).alias("max_closed"), F.coalesce(F.sum(F.when(F.col("level") < 0, F.col("area"))), F.lit(0.0)).alias("basement_area"), F.count_if(F.col("level") < 0).alias("basements"),
        F.coalesce(F.sum(F.when(F.col("level").isin(1, 2), F.col("area"))), F.lit(0.0)).alias("lower_area"), biggest(F.col("level") >= 11).alias("max_high"), F.count_if(special | (F.col("level") >= 11)).alias("special_floors"),
    )
    rows = buildings.join(sums, "building", "left").na.fill(0.0, [c for c in sums.columns if c not in ("building",)])
    rows = rows.withColumn("total_area", F.col("floor_area") + F.coalesce("roof_area", F.lit(0.0)))
    return rows.withColumn("high_rise", high_rise(F.col("height"), F.col("stories"))).withColumn("cls", F.split_part("occupancy", F.lit("-"), F.lit(1)))


def _is(*codes: str) -> Column:
    """Whether the occupancy is one of the codes (甲-1) or in one of the classes (甲)."""
    return F.coalesce(F.col("occupancy").isin(*codes) | F.col("cls").isin(*codes), F.lit(False))


def requirement_clauses() -> dict[str, tuple[dict[str, Column], dict[str, Column]]]:
    """For each requirement its clauses by name, and by what is missing the condition under which it stays unknown.

    Areas are square metres, heights metres; all thresholds are fixed values of the regulation.
    """
    c = F.col
    no_class, no_stories = c("occupancy").isNull(), c("stories").isNull()
    st = F.coalesce(c("stories"), F.lit(0))
    low, mid = st.between(1, 5), st.between(6, 10)
    yes = lambda x: F.coalesce(x, F.lit(False))
    under = _is("戊-3") & (c("total_area") >= 1000)
    mixed = _is("戊-1", "戊-2")
    room_limit = F.when(_is("甲-1"), 300).otherwise(500)
    school = _is("乙-3") & (c("max_above") >= 500) & (c("max_above") < 1400)
    alarm = {
        "19/1/1": low & F.when(_is("甲", "乙-12"), c("max_above") >= 300).otherwise(_is("乙", "丙", "丁") & (c("max_above") >= 500)),
        "19/1/2": mid & (c("max_above") >= 300),
        "19/1/3": st >= 11,
        "19/1/4": c("max_special") >= F.when(_is("甲-1", "甲-5"), 100).otherwise(300),
        "19/1/6": _is("甲", "戊-3") & (c("total_area") >= 300),
    }
    gas = {"21/1/1": _is("甲") & (c("basement_area") >= 1000), "21/1/3": under}
    any_of = lambda d: reduce(Column.__or__, map(yes, d.values()))
    occupancy, stories, uses = {"occupancy": no_class}, {"stories": no_stories}, {"areas by use": mixed}
    always = lambda what: {what: F.lit(True)}
    signs = {"23/1": _is("甲", "乙-12", "戊-1", "戊-3") | (c("special_floors") > 0)}
    return {
        "14": ({"14/1/1": _is("甲", "戊-1", "戊-3", "乙-12"), "14/1/2": _is("乙", "丙", "丁") & (c("total_area") >= 150), "14/1/3": c("max_special") >= 50, "14/1/4": c("has_electrical"), "14/1/5": c("has_kitchen")}, occupancy | {"areas by use": _is("戊")}),
        "15": (
            {
                "15/1/1": low & _is("甲", "乙", "丙", "丁") & ~school & (c("max_above") >= room_limit),
                "15/1/2": (st >= 6) & _is("甲", "乙", "丙", "丁") & (c("max_above") >= 150),
                "15/1/3": _is("戊-3") & (c("total_area") >= 150),
                "15/1/4": _is("甲", "乙", "丙", "丁") & (c("max_special") >= F.when(_is("甲-1"), 100).otherwise(150)),
            },
            occupancy | uses | stories | {"whether a school's class room": low & school},
        ),
        "16": ({"16/1": F.when(_is("丁-1"), c("lower_area") >= 3000).when(_is("丁-2"), c("lower_area") >= 5000).when(_is("丁-3"), c("lower_area") >= 10000)}, occupancy),
        "17": (
            {
                "17/1/1": st.between(1, 10) & F.when(_is("甲-1"), c("above_area") >= 300).otherwise(_is("甲", "乙-1") & (c("max_above") >= 1500)),
                "17/1/2": c("max_high") >= 100,
                "17/1/3": _is("甲") & (c("max_special") >= 1000),
                "17/1/4": (st >= 11) & _is("甲", "戊-1"),
                "17/1/6": _is("乙-11") & (c("max_tall") >= 700),
                "17/1/7": under,
                "17/1/8": c("high_rise"),
            },
            occupancy | uses | stories | {"height": c("high_rise").isNull(), "height of stores": _is("乙-11") & (c("max_not_tall") >= 700)},
        ),
        "18": ({"18/1": F.lit(False)}, always("uses and areas of rooms")),
        "19": (alarm, occupancy | uses | stories),
        "20": ({"20/1/1": (st >= 3) & (c("max_floor") >= 200), "20/1/2": _is("甲-3")}, occupancy | stories),
        "21": (gas, {"areas by use": _is("戊-1") & (c("basement_area") >= 1000)}),
        "22": ({"22/1": any_of(alarm) | any_of(gas)}, occupancy | uses | stories),
        "23-1": (signs, occupancy),
        "23-2": (signs, occupancy),
        "24": ({"24/1/1": _is("甲", "丙", "戊"), "24/1/2": _is("乙-1", "乙-2", "乙-4", "乙-5", "乙-6", "乙-8", "乙-9", "乙-12"), "24/1/3": ~_is("乙-3") & (c("total_area") >= 1000)}, always("uses and areas of rooms")),
        "25": ({"25": F.lit(False)}, always("places and persons of each floor")),
        "26": ({"26/1/1": (st >= 7) | (st.isin(5, 6) & (c("total_area") >= 6000)), "26/1/2": under}, stories),
        "27": (
            {"27/1/1": (c("site_area") >= 20000) & (c("max_floor") >= 1500), "27/1/2": (c("height") > 31) & (c("total_area") >= 25000)},
            {"site area": c("site_area").isNull() & (c("max_floor") >= 1500), "height": c("height").isNull() & (c("total_area") >= 25000)},
        ),
        "28": ({"28/1/1": _is("甲", "戊-3") & (c("total_area") >= 500), "28/1/3": c("max_closed") >= 1000}, occupancy | {"openings of large rooms": c("big_rooms")}),
        "29": ({"29/1/1": st >= 11, "29/1/2": under}, {}),
        "30": ({"30/1/1": (c("basements") > 0) & (c("height") >= 100), "30/1/2": under, "30/1/3": (c("basements") >= 4) & (c("basement_area") >= 3000)}, {"height": (c("basements") > 0) & c("height").isNull()}),
        "30-1": ({"30-1/1": yes(c("high_rise")) | (c("total_area") >= 50000) | under}, {"height": c("high_rise").isNull()}),
    }


def requirements(profiles: DataFrame) -> DataFrame:
    """building, key, status, equipment, kinds, the clauses that apply and the data that are missing.

    REQUIRED if any clause applies; else UNKNOWN if data are missing that could make one apply, or NOT_REQUIRED.
    """
    defaults = {"has_electrical": F.lit(False), "has_kitchen": F.lit(False), "big_rooms": F.lit(False)}
    rows = profiles.withColumns({k: v for k, v in defaults.items() if k not in profiles.columns})
    out = []
    for key, (clauses, unknown) in requirement_clauses().items():
        true = lambda named: F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), n) for n, x in named.items()]).cast("array<string>"), lambda x: x.isNotNull())
        law, missing = true(clauses), true(unknown)
        status = F.when(F.size(law) > 0, "REQUIRED").when(F.size(missing) > 0, "UNKNOWN").otherwise("NOT_REQUIRED")
        equipment, kinds = EQUIPMENT[key]
        told = F.array(*[F.lit(k) for k in kinds]).cast("array<string>")
        out.append(F.struct(F.lit(key).alias("key"), status.alias("status"), F.lit(equipment).alias("equipment"), told.alias("kinds"), law.alias("law"), missing.alias("missing")))
    return rows.select("building", F.inline(F.array(*out)))


def downgrade(findings: DataFrame, required: DataFrame, rules: list[str], key: str) -> DataFrame:
    """Findings of ``rules`` become BLUE where the requirement ``key`` doesn't hold."""
    status = required.where(F.col("key") == key).select("building", F.col("status").alias("__status"))
    rows = findings.join(status, "building", "left")
    voluntary = F.col("rule").isin(rules) & (F.col("__status") == "NOT_REQUIRED")
    return rows.withColumn("severity", F.when(F.coalesce(voluntary, F.lit(False)), "BLUE").otherwise(F.col("severity"))).drop("__status")
