import heapq
import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyroclast.operators import boxtable, equipment, floor_rules, graph, hierarchy, relational, retrieval, rules, spatial, state


def test_relational_edges(spark):
    empty = spark.createDataFrame([], "k int, v string, o int")
    assert relational.latest_per_key(empty, ["k"], F.desc("o")).count() == 0
    assert relational.majority(empty, ["k"], "v", "o").count() == 0
    rows = spark.createDataFrame([(1, None, 1), (1, '"', 2), (1, "a", 3), (1, '"', 4), (2, '"', 1)], "k int, v string, o int")
    got = {(r.k, r.o): (r.resolved, r.review) for r in relational.same_as_above(rows, "v", '"', ["k"], "o").collect()}
    assert got == {(1, 1): (None, False), (1, 2): (None, True), (1, 3): ("a", False), (1, 4): ("a", False), (2, 1): (None, True)}
    count = {r.k: r.ahead for r in relational.running_count(spark.createDataFrame([(k,) for k in (-3, 0, 5, 12, 25)], "k int"), "k", 10).collect()}
    assert count == {-3: 0, 0: 1, 5: 2, 12: 3, 25: 4}
    valid, bad = relational.split_valid(rows, {"v": F.col("v") == "a"})
    assert (valid.count(), bad.count()) == (1, 4)


def test_pinned_and_empty_routes(spark):
    a = spark.createDataFrame([(1, "keyword", 1, 10), (1, "keyword", 2, 11)], "qid int, route string, rank int, node int")
    none = a.where("false")
    pinned = spark.createDataFrame([(1, 0, 11), (1, 1, 12)], "qid int, ord int, node int")
    got = retrieval.fuse([a, none], pinned).orderBy("rank").collect()
    assert [(r.node, r.score, r.routes) for r in got] == [(11, round(10 + 0.5 / 62, 9), ["direct", "keyword"]), (12, 9.99, ["direct"]), (10, round(0.5 / 61, 9), ["keyword"])]


def test_missed_questions_count(spark):
    answers = spark.createDataFrame([(1, 2, 5)], "qid int, rank int, node int")
    expected = spark.createDataFrame([(1, 5), (2, 7)], "qid int, node int")
    assert retrieval.quality(answers, expected).first().asDict() == {"questions": 2, "hits": 1, "top1": 0, "mrr": 0.25}


def test_line_tree_and_references(spark):
    docs = spark.createDataFrame([(1, "甲\n乙\n一、a\n（一）b\n二、c"), (2, "一、x"), (3, ""), (4, None)], "k int, t string")
    got = {(r.k, r.pos): r.path for r in hierarchy.line_tree(docs, "k", "t").collect()}
    assert got == {(1, 0): [1], (1, 1): [2], (1, 2): [2, 1], (1, 3): [2, 1, 1], (1, 4): [2, 2], (2, 0): [1, 1]}
    nodes = spark.createDataFrame([("L/5/2/1", "4", "前項及同條，第3條第2項第一款"), ("L/5/1", "4", "前項"), ("L/9/1", None, None)], "node string, previous string, text string")
    ids = spark.createDataFrame([("L/5/1",), ("L/5",), ("L/3",), ("L/3/2",), ("L/3/2/1",)], "node string")
    got = {(r.src, r.ord): (r.raw, r.target) for r in hierarchy.resolve_references(nodes, ids).collect()}
    assert got[("L/5/2/1", 0)] == ("前項", "L/5/1")
    assert got[("L/5/2/1", 1)] == ("同條", "L/5")
    assert [got[("L/5/2/1", i)][1] for i in (2, 3, 4)] == ["L/3", "L/3/2", "L/3/2/1"]
    assert got[("L/5/1", 0)] == ("前項", None)


def test_walk_is_shortest_within_the_band():
    rng = np.random.default_rng(3)
    free = rng.random((18, 22)) > 0.25
    free[0, 0] = True
    got = spatial.walk(free, [(0.1, 0.1)], 0.2)
    plain = np.where(free, np.inf, np.nan)
    plain[0, 0] = 0
    heap = [(0.0, 0, 0)]
    while heap:
        d, i, j = heapq.heappop(heap)
        for a, b in itertools.product((-1, 0, 1), repeat=2):
            p, q = i + a, j + b
            if (a or b) and 0 <= p < 18 and 0 <= q < 22 and free[p, q] and free[i + a, j] and free[i, j + b] and d + np.hypot(a, b) * 0.2 < plain[p, q] - 1e-12:
                plain[p, q] = d + np.hypot(a, b) * 0.2
                heapq.heappush(heap, (plain[p, q], p, q))
    assert (np.isinf(got) == np.isinf(plain)).all()
    ok = np.isfinite(got)
    assert (got[ok] <= plain[ok] + 1e-9).all()
    open_ = spatial.walk(np.ones((60, 60), bool), [(0.1, 0.1)], 0.2)
    straight = np.hypot(*np.meshgrid(np.arange(60) * 0.2, np.arange(60) * 0.2))
    far = straight > 3
    assert (open_[far] / straight[far]).max() < 1.04


def test_first_wins_matches_a_scan(spark):
    rng = np.random.default_rng(1)
    points = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((80, 2)))]
    kept = []
    for p in points:
        if not any(abs(p[2] - q[2]) <= 0.1 and abs(p[3] - q[3]) <= 0.1 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(points, "g int, ord int, x double, y double")
    assert sorted(r.ord for r in spatial.first_wins(df, ["g"], 0.1).collect()) == [p[1] for p in kept]


def test_alignment_and_projection(spark):
    a = spark.createDataFrame([(1, "s", i, float(x), float(y), 1.0) for i, (x, y) in enumerate([(0, 0), (7, 3), (20, 11), (5, 30)])], "sheet int, kind string, anchor int, x double, y double, area double")
    b = a.withColumn("x", F.col("x") + 3.1).withColumn("y", F.col("y") - 164.2)
    got = spatial.align_sheets(spatial.displacement_pairs(a, b, 0.5, 0.8), a, b).first()
    assert (got.sx, got.sy, got.votes) == (pytest.approx(3.1), pytest.approx(-164.2), 4)


def test_graph(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(6)] + [(2, 1)], "g int, n int")
    edges = spark.createDataFrame([(1, 3, 2), (1, 3, 5), (1, 9, 0)], "g int, a int, b int")
    got = {(r.g, r.n): r.component for r in graph.components(nodes, edges, "g", "n").collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 4, (1, 5): 2, (2, 1): 1}


def test_equipment(spark):
    legend = ["室內消防栓", "排煙口", "閥"]
    with pytest.raises(ValueError):
        equipment.known_symbols(spark, legend, [("block", "^X", "沒有", {})])
    dictionary = equipment.known_symbols(spark, legend, [("block", "^H-", "室內消防栓", {"hydrant_class": "1"}), ("layer", "VENT", "排煙口", {})])
    rows = [
        (1, 1, "H-1", "FP", 0.0, 0.0, {"種類": "第二種"}), (1, 2, "H-1", "FP", 0.04, 0.04, None), (1, 3, "H-1", "FP", 0.2, 0.0, None), (1, 4, "A$C", "P-VENT", 0.0, 0.0, {"SIZE": "60x50", "AREA": ""}),
        (1, 5, "A$C", None, 9.0, 0.0, None), (1, 6, "閥", "FP", 0.0, 0.0, None), (1, 7, "H-1", "圖例", 5.0, 0.0, None), (2, 1, None, None, 0.0, 0.0, None),
    ]
    df = spark.createDataFrame(rows, "sheet int, ord int, name string, layer string, x double, y double, attribs map<string,string>")
    found, unknown = equipment.recognise(df, dictionary)
    got = {(r.sheet, r.ord): (r.legend, r.kinds, r.spec.hydrant_class, r.spec.open_area) for r in found.collect()}
    assert got == {(1, 1): ("室內消防栓", ["hydrant"], "2", None), (1, 3): ("室內消防栓", ["hydrant"], "1", None), (1, 4): ("排煙口", ["smoke_vent"], None, 0.003)}
    assert {(r.sheet, r.name): r.times for r in unknown.collect()} == {(1, "A$C"): 1, (2, None): 1}
    assert equipment.recognise(df.where("false"), dictionary)[0].count() == 0


def test_box_tables():
    good = ["┌──┬──┐", "│a   │b   │", "├──┼──┤", "│c   │d   │", "└──┴──┘"]
    assert boxtable.cells(good) == [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b"), (1, 0, 1, 1, "c"), (1, 1, 1, 1, "d")]
    assert boxtable.cells(["│a", "x"]) is None
    rng = np.random.default_rng(5)
    for _ in range(200):  # mutated tables never raise
        lines = [list(x) for x in good]
        i = rng.integers(len(lines))
        j = rng.integers(len(lines[i]))
        lines[i][j] = rng.choice(list("─│┼ ax"))
        boxtable.cells(["".join(x) for x in lines])


def _requirements(spark, floors, **building):
    row = {"occupancy": None, "stories": None, "height": None, "site_area": None, "roof_area": 0.0} | building
    b = spark.createDataFrame([(1, *row.values())], "building int, occupancy string, stories int, height double, site_area double, roof_area double")
    f = spark.createDataFrame([(1, *x) for x in floors], "building int, label string, level int, area double, no_opening boolean")
    return {r.key: (r.status, r.law) for r in rules.requirements(rules.profile(b, f)).collect()}


def test_requirements(spark):
    got = _requirements(spark, [("1F", 1, 600.0, False), ("B1", -1, 120.0, False)], occupancy="甲-1", stories=3, height=12.0)
    assert got["14"][0] == got["15"][0] == got["17"][0] == got["19"][0] == "REQUIRED"
    assert got["15"][1] == ["15/1/1", "15/1/4"] and got["22"][0] == "REQUIRED" and got["26"][0] == "NOT_REQUIRED"
    got = _requirements(spark, [("1F", 1, 600.0, False)])
    assert got["14"][0] == got["15"][0] == got["19"][0] == "UNKNOWN" and got["29"][0] == "NOT_REQUIRED"
    got = _requirements(spark, [("1F", 1, 600.0, False)], occupancy="乙-3", stories=3)
    assert got["15"] == ("UNKNOWN", [])
    got = _requirements(spark, [(f"{k}F", k, 90.0, False) for k in range(1, 13)], occupancy="丙-1", stories=12)
    assert got["17"][0] == got["30-1"][0] == "UNKNOWN" and got["29"][0] == "REQUIRED"
    assert len(got) == len(rules.requirement_clauses()) == len(rules.EQUIPMENT)


def test_missing_data_are_named(spark):
    b = spark.createDataFrame([(1, None, None, None, None, 0.0), (2, "丙-1", 12, None, 10.0, 0.0)], "building int, occupancy string, stories int, height double, site_area double, roof_area double")
    f = spark.createDataFrame([(k, "1F", 1, 600.0, False) for k in (1, 2)], "building int, label string, level int, area double, no_opening boolean")
    got = {(r.building, r.key): r for r in rules.requirements(rules.profile(b, f)).collect()}
    assert got[1, "15"].missing == ["occupancy", "stories"] and got[2, "17"].missing == ["height"] and got[2, "29"].missing == []
    assert got[2, "19"].kinds == ["detector", "flame_detector"] and got[2, "18"].status == "UNKNOWN"


def test_high_warehouse(spark):
    """17/1/6: a ceiling over 10 m decides; where none is known, large floors stay unknown."""
    assert _requirements(spark, [("1F", 1, 800.0, False)], occupancy="乙-11", stories=1, height=12.0)["17"] == ("UNKNOWN", [])
    assert _requirements(spark, [("1F", 1, 699.0, False)], occupancy="乙-11", stories=1, height=12.0)["17"][0] == "NOT_REQUIRED"
    b = spark.createDataFrame([(1, "乙-11", 1, 12.0, None, 0.0)], "building int, occupancy string, stories int, height double, site_area double, roof_area double")
    f = spark.createDataFrame([(1, "1F", 1, 800.0, False, 11.0)], "building int, label string, level int, area double, no_opening boolean, ceiling double")
    assert {r.key: (r.status, r.law) for r in rules.requirements(rules.profile(b, f)).collect()}["17"] == ("REQUIRED", ["17/1/6"])


def test_two_bounds(spark):
    rows = spark.createDataFrame([(1, 250.0, [1.0, 2.0]), (2, 250.0, [1.0, None]), (3, 250.0, [1.0]), (4, None, [1.0])], "floor int, area double, capacities array<double>")
    got = {r.floor: r.severity for r in rules.extinguisher_count(rows, 100.0).collect()}
    assert got == {1: None, 2: "YELLOW", 3: "RED", 4: "YELLOW"}


def test_quota_and_transitions(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00")], "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [r.accepted for r in state.daily_quota(rows, "at", "id", 1).orderBy("id").collect()] == [True, False]
    assert not any(r.accepted for r in state.daily_quota(rows, "at", "id", 0).collect())
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "processing"), (1, 3, "done"), (2, 1, "done")], "k int, o int, status string")
    assert [(r.k, r.o) for r in state.illegal_transitions(log, "k", "o").collect()] == [(1, 3)]


def test_open_regions_and_pieces():
    free = np.ones((40, 60), bool)
    region = spatial.open_region(free, [(0, 0, 6, 8)])
    assert not region[:, :33].any() and region[:, 33:].all()
    assert not spatial.open_region(free, [(0, 0, 6, 8), (7, 0, 12, 8)]).any()
    assert not spatial.opened(np.pad(np.ones((40, 2), bool), ((0, 0), (5, 5))), 0.3).any()
    mask = np.zeros((10, 10), bool)
    mask[0, :4], mask[5, :5], mask[8:, 8:] = True, True, True
    assert spatial.pieces(mask).tolist() == pytest.approx([0.2])
    assert spatial.pieces(mask, 0.1).tolist() == pytest.approx([0.2, 0.16, 0.16])


def test_components_of_masks():
    rng = np.random.default_rng(1)
    for _ in range(60):
        mask = rng.random((rng.integers(1, 25), rng.integers(1, 25))) < rng.random()
        label = spatial.components(mask)
        assert ((label > 0) == mask).all()
        todo, n = {tuple(x) for x in np.argwhere(mask)}, 0
        for first in map(tuple, np.argwhere(mask)):
            if first in todo:
                n += 1
                stack = [first]
                todo.discard(first)
                while stack:
                    i, j = stack.pop()
                    assert label[i, j] == n
                    near = {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)} & todo
                    todo -= near
                    stack += near


def test_greedy_assignment_is_one_after_the_other(spark):
    rng = np.random.default_rng(12)
    items = [(int(g), k, float(rng.integers(0, 25)), float(rng.integers(0, 25))) for k in range(160) for g in [rng.integers(0, 3)]] + [(1, 900, None, 2.0), (None, 901, 1.0, 1.0)]
    places = [(int(rng.integers(0, 3)), k, float(rng.integers(0, 25)), float(rng.integers(0, 25))) for k in range(90)] + [(1, 500, 3.0, None)]
    want, free = {}, {(g, p): (x, y) for g, p, x, y in places if y is not None}
    for g, k, x, y in sorted((i for i in items if i[0] is not None and i[2] is not None), key=lambda i: i[1]):
        near = min(((np.hypot(a - x, b - y), p) for (h, p), (a, b) in free.items() if h == g and np.hypot(a - x, b - y) <= 3), default=None)
        if near:
            want[g, k] = (near[1], near[0])
            del free[g, near[1]]
    df, at = spark.createDataFrame(items, "floor int, ord int, x double, y double"), spark.createDataFrame(places, "floor int, place int, x double, y double")
    got = {(r.floor, r.ord): (r.place, r.distance) for r in spatial.greedy_nearest(df, at, "floor", 3.0).collect()}
    assert set(got) == set(want) and all(got[k][0] == p and got[k][1] == pytest.approx(d) for k, (p, d) in want.items())
    assert spatial.greedy_nearest(df.where("false"), at, "floor", 3.0).count() == spatial.greedy_nearest(df, at.where("false"), "floor", 3.0).count() == 0


def test_devices_fall_in_high_buildings(spark):
    """Each device against its own levels; a high building's devices don't meet all of its openings."""
    rng = np.random.default_rng(4)
    openings = {(b, n, float(x)) for b, n in ((1, 3000), (2, 40)) for n, x in zip(range(-3, n), rng.integers(0, 3, n + 3), strict=True) if n % 7 and n % 3 < 2 or b == 2 and n % 7}
    spots = [(b, k, int(rng.integers(-3, n)), float(rng.integers(0, 5)) + 0.5, 0.5) for b, n, m in ((1, 3000, 40_000), (2, 40, 300)) for k in range(m)] + [(1, 90_000, None, 0.5, 0.5), (1, 90_001, 1, None, 0.5)]
    want = {}
    for b, k, level, x, _ in spots:
        lands = level
        while x is not None and any((b, lands, x - 0.5 - d) in openings for d in (0, 1)):
            lands -= 1
        want[b, k] = lands
    df = spark.createDataFrame(spots, "building int, device int, level int, x double, y double")
    holes = spark.createDataFrame([(b, n, x, 0.0, x + 2, 1.0) for b, n, x in openings], "building int, level int, x0 double, y0 double, x1 double, y1 double")
    began = time.time()
    got = {(r.building, r.device): (r.lands, r.projected) for r in spatial.project_down(df, holes).collect()}
    assert time.time() - began < 25 and {k: v for k, (v, _) in got.items()} == want
    assert all(p == (lands is not None and lands != level) for (b, k, level, _, _) in spots for lands, p in [got[b, k]])


def test_crowds_of_rooms_and_devices(spark):
    """Rooms and devices in few places, some in several: each device counts once for a room, and places meet instead of rows."""
    rng = np.random.default_rng(6)
    spot = lambda: (float(rng.integers(0, 12)), float(rng.integers(0, 12)))
    rooms = [(int(rng.integers(0, 120)) if k % 9 == 0 else 200 + k, *spot(), float(rng.integers(0, 60)) * 100) for k in range(400)] + [(None, 1.0, 1.0, 500.0), (900, None, 1.0, 500.0), (901, 1.0, 1.0, None)]
    devices = [(int(rng.integers(0, 40)) if k % 4 == 0 else 100 + k, *spot()) for k in range(150)] + [(7, None, 1.0), (None, 1.0, 1.0)]
    area = {}
    have = {r: set() for r, *_ in rooms}
    for r, x, y, a in rooms:
        area.setdefault(r, []).append(a)
        have[r] |= {d for d, u, v in devices if None not in (r, d, x, y, u, v) and math.hypot(x - u, y - v) <= 3}
    want = sorted((r if r is not None else -1, need, len(have[r])) for r, told in area.items() for a in told if a is not None for need in [math.ceil(a / 100 - 1e-9)] if len(have[r]) < need)
    schema = "room int, x double, y double, area double", "device int, x double, y double"
    got = floor_rules.devices_near_rooms(spark.createDataFrame(rooms, schema[0]), spark.createDataFrame(devices, schema[1]))
    assert sorted((-1 if r.room is None else r.room, r.need, r.have) for r in got.collect()) == want and 50 < len(want) < 350
    began = time.time()
    many = floor_rules.devices_near_rooms(spark.range(100_000).selectExpr("id room", "0.0D x", "1.0D y", "1000000.0D area"), spark.range(9_000).selectExpr("id device", "2.0D x", "2.0D y"))
    assert many.groupBy("need", "have").count().collect() == [(10_000, 9_000, 100_000)] and time.time() - began < 15


def test_greedy_assignment_of_crowds(spark):
    """Hundreds of items wait in a row for the places of few points; one after the other in a task, and by rounds."""
    rng = np.random.default_rng(15)
    items = [(int(g), k, float(rng.integers(0, 12) * 4), 0.0) for k in range(2000) for g in [rng.integers(0, 2)]] + [(1, None, 4.0, 0.0), (None, 5000, 4.0, 0.0)]
    places = [(int(rng.integers(0, 2)), k, float(rng.integers(0, 12) * 4), 3.0) for k in range(5000)] + [(1, None, 4.0, 3.0), (1, 9000, None, 3.0)]

    def wanted(items, places):
        want, free = {}, {}
        for g, p, x, y in places:
            if None not in (g, p, x):
                free.setdefault((g, x), []).append((p, x))
        for g, k, x, _ in sorted((i for i in items if None not in i), key=lambda i: i[1]):
            near = min(((math.hypot(a - x, 3.0), *free[g, a][0]) for a in (x - 4, x, x + 4) if free.get((g, a))), default=None)
            if near:
                want[g, k] = (near[1], near[0])
                free[g, near[2]].pop(0)
        return want

    def got(items, places, **more):
        df, at = spark.createDataFrame(items, "floor int, ord int, x double, y double"), spark.createDataFrame(places, "floor int, place int, x double, y double")
        return {(r.floor, r.ord): (r.place, r.distance) for r in spatial.greedy_nearest(df, at, "floor", 5.0, **more).collect()}

    began = time.time()
    assert got(items, places) == wanted(items, places) and time.time() - began < 20
    part = [i for i in items if i[1] is None or i[1] < 40], [p for p in places if p[1] is None or p[1] < 60]
    assert got(*part, most=0) == got(*part, most=450) == got(*part) == wanted(*part)
