"""Queries of joins, aggregates, windows, sorts and sets (§2.2 to §2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyroclast.operators import relational as R
from pyroclast.plans.registry import query, table


@query("SELECT * FROM part WHERE p_partkey = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One node by its key, the filter is pushed to the scan."""
    return table(spark, sf, "part").where("p_partkey = 42")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'ECONOMY'")
def optional_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Filters that are given apply, those left out don't."""
    return R.optional_filter(table(spark, sf, "part"), p_type="ECONOMY", p_brand=None).select("p_partkey", "p_name", "p_size")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey")
def children_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Children of one parent in document order."""
    return table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name").orderBy("n_nationkey")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_linestatus = 'F') AND l_returnflag IN ('A', 'R') GROUP BY 1")
def state_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Rows not marked deleted, in a set of states."""
    return table(spark, sf, "lineitem").where(~(F.col("l_linestatus") == "F") & F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey, list_concat(CASE WHEN o_totalprice BETWEEN 1000 AND 400000 THEN []::VARCHAR[] ELSE ['price'] END,
        CASE WHEN regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+$') THEN []::VARCHAR[] ELSE ['priority'] END) AS reasons
    FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 400000) OR NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+$')
""")
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that fail range or format checks, with the reasons."""
    checks = {"price": F.col("o_totalprice").between(1000, 400000), "priority": F.col("o_orderpriority").rlike("^[1-5]-[A-Z]+$")}
    return R.split_valid(table(spark, sf, "orders"), checks)[1].select("o_orderkey", "reasons")


@query("""
    SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, sum(CASE WHEN json_extract(props, '$.missing') IS NULL THEN 1 ELSE 0 END)::BIGINT AS without_key
    FROM events GROUP BY 1, 2
""")
def json_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Typed fields out of JSON, and a test for a key."""
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long, missing string"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("p.missing").isNull()).alias("without_key"))


@query("""
    WITH first_last AS (SELECT user_id, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1)
    SELECT f.user_id, json_extract_string(n.props, '$.k') AS k, o.event_type AS first_type, n.event_type AS last_type
    FROM first_last f JOIN events o ON o.event_id = f.a JOIN events n ON n.event_id = f.b
""")
def json_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The right-hand side of a merge wins, key by key."""
    e = table(spark, sf, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    row = F.struct("event_type", "m")
    ends = e.groupBy("user_id").agg(F.min_by(row, "event_id").alias("a"), F.max_by(row, "event_id").alias("b"))
    old = F.map_concat(F.col("a.m"), F.create_map(F.lit("first_type"), F.col("a.event_type"), F.lit("last_type"), F.lit("?")))
    new = F.map_concat(F.col("b.m"), F.create_map(F.lit("last_type"), F.col("b.event_type")))
    merged = ends.select("user_id", R.merge_maps(old, new).alias("m"))
    return merged.select("user_id", *[F.col("m")[k].alias(k) for k in ("k", "first_type", "last_type")])


@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def inner_join_count(spark: SparkSession, sf: str) -> DataFrame:
    """An equi-join and grouped counts."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT c_custkey, count(o_orderkey) AS files, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS queued,
        count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS running, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS done
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY c_custkey DESC LIMIT 200
""")
def case_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The 200 newest cases with counts by state; orders are aggregated before the join."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("files"), *[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("O", "queued"), ("P", "running"), ("F", "done"))]
    )
    newest = table(spark, sf, "customer").select("c_custkey").orderBy(F.desc("c_custkey")).limit(200)
    names = ["files", "queued", "running", "done"]
    return newest.join(counts, "c_custkey", "left").select("c_custkey", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


@query("""
    SELECT n_name, r_name FROM nation LEFT JOIN region ON 'R/' || r_regionkey || '/' || length(r_name) = 'R/' || n_regionkey || '/' || (n_nationkey % 3 + 5)
""")
def computed_key_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """A left join on a key made of several columns."""
    n = table(spark, sf, "nation").withColumn("key", F.concat(F.lit("R/"), "n_regionkey", F.lit("/"), F.col("n_nationkey") % 3 + 5))
    r = table(spark, sf, "region").withColumn("key", F.concat(F.lit("R/"), "r_regionkey", F.lit("/"), F.length("r_name")))
    return n.join(r, "key", "left").select("n_name", "r_name")


@query("""
    WITH n AS (SELECT DISTINCT o_orderkey::VARCHAR AS node, 0 AS seq, o_orderstatus AS t FROM orders
        UNION ALL SELECT l_orderkey || '/' || l_linenumber, l_linenumber, min(l_returnflag || l_linestatus) FROM lineitem GROUP BY l_orderkey, l_linenumber),
    a AS (SELECT node AS of, node, seq, t FROM n UNION ALL SELECT split_part(node, '/', 1), node, seq, t FROM n WHERE contains(node, '/'))
    SELECT n.node, string_agg(a.t, '' ORDER BY a.seq, a.node) AS full_text FROM n JOIN a ON a.of = n.node GROUP BY n.node
""")
def descendant_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's text with its descendants' in order, by an equi-join on ancestors' ids."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("node"), F.lit(0).alias("seq"), F.col("o_orderstatus").alias("t"))
    parts = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("t"))
    parts = parts.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("node"), F.col("l_linenumber").alias("seq"), "t")
    return R.descendants_text(o.unionByName(parts), "node", "t", "seq")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def exists_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a returned line."""
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(returned, "o_orderkey", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def stale_rows_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the other table doesn't have, as an anti-join."""
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
    WITH new AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE lang <> 'de'),
    old AS (SELECT doc_id, CASE WHEN source LIKE '%1%' THEN 'changed' ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE lang <> 'fr')
    SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, CASE WHEN new.h IS NULL THEN 'delete' ELSE 'recompute' END AS action
    FROM new FULL JOIN old ON new.doc_id = old.doc_id WHERE new.h IS DISTINCT FROM old.h
""")
def incremental_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What to compute anew and what to delete, from digests of two snapshots."""
    d = table(spark, sf, "documents").withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    old = d.where("lang <> 'fr'").withColumn("h", F.when(F.col("source").contains("1"), "changed").otherwise(F.col("h")))
    return R.recompute_plan(d.where("lang <> 'de'"), old, "doc_id", "h")


@query("""
    WITH req AS (SELECT s_nationkey AS floor, p_type AS kind FROM (SELECT DISTINCT s_nationkey FROM supplier) CROSS JOIN (SELECT DISTINCT p_type FROM part)),
    have AS (SELECT DISTINCT s_nationkey AS floor, p_type AS kind FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_discount >= 0.1)
    SELECT floor, kind FROM req WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.floor = req.floor AND have.kind = req.kind)
""")
def missing_equipment_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Required kinds that a floor lacks; kinds are exploded from a small array of distinct values."""
    s, p, l = (table(spark, sf, t) for t in ("supplier", "part", "lineitem"))
    kinds = p.agg(F.collect_set("p_type").alias("kinds"))
    floors = s.select(F.col("s_nationkey").alias("floor")).distinct()
    required = floors.join(F.broadcast(kinds)).select("floor", F.explode("kinds").alias("kind"))
    big = l.where("l_quantity >= 50 AND l_discount >= 0.1")
    found = big.join(s, big.l_suppkey == s.s_suppkey).join(p, big.l_partkey == p.p_partkey).select(F.col("s_nationkey").alias("floor"), F.col("p_type").alias("kind"))
    return R.missing_pairs(required, found, ["floor", "kind"])


@query("""
    SELECT o_orderkey, 'pending' AS state, count(*) AS floors FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'F' GROUP BY o_orderkey HAVING count(*) >= 1
""")
def update_from_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that an update through a join changes, with what it returns."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("floors"))
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").join(lines, "o_orderkey").select("o_orderkey", F.lit("pending").alias("state"), "floors")


@query("SELECT p_type, list_sort(list(DISTINCT p_brand)) AS brands, count(DISTINCT p_brand) AS n FROM part GROUP BY 1")
def multimap_collect(spark: SparkSession, sf: str) -> DataFrame:
    """A map from a term to the set of its codes."""
    return table(spark, sf, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("brands")).select("*", F.size("brands").cast("long").alias("n"))


@query("""
    SELECT source, CASE WHEN source = 'src_7' THEN 'named' WHEN regexp_matches(source, '1$') THEN 'one' WHEN regexp_matches(source, '[02468]$') THEN 'even' WHEN regexp_matches(source, '.') THEN 'other' END AS target
    FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
""")
def first_match_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Equal names first, then the first pattern in order, on distinct names."""
    rules = spark.createDataFrame([(1, "1$", "one"), (2, "[02468]$", "even"), (3, ".", "other"), (4, "src_7", "named")], "ord int, pattern string, target string")
    return R.first_match(table(spark, sf, "documents"), "source", rules)


@query("""
    SELECT event_id, user_id, CASE WHEN v = '"' THEN last_value(CASE WHEN v <> '"' THEN v END IGNORE NULLS) OVER w ELSE v END AS resolved,
        coalesce(v = '"', false) AND lag(v) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS review
    FROM (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN '"' ELSE event_type || value END AS v FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def asof_same_as_above(spark: SparkSession, sf: str) -> DataFrame:
    """A mark for "same as above" takes the nearest earlier real value; a blank right above asks for review."""
    v = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "click", '"').otherwise(F.concat("event_type", "value"))
    return R.same_as_above(table(spark, sf, "events").withColumn("v", v), "v", '"', ["user_id"], "event_id").select("event_id", "user_id", "resolved", "review")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of each key."""
    return R.latest_per_key(table(spark, sf, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("""
    WITH c AS (SELECT l_partkey, l_suppkey, l_orderkey, l_quantity < 45 AS usable, l_suppkey % 10 = l_partkey % 10 AS same FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY same, l_orderkey DESC, l_suppkey) AS n FROM c WHERE usable)
    SELECT p_partkey, r.l_suppkey AS bound_to, r.same AS last_resort FROM part LEFT JOIN r ON r.l_partkey = p_partkey AND n = 1
""")
def reference_binding(spark: SparkSession, sf: str) -> DataFrame:
    """The newest readable candidate of each reference; those of the same name only if nothing else is left."""
    l = table(spark, sf, "lineitem").where("l_quantity < 45").select("l_partkey", "l_suppkey", "l_orderkey", (F.col("l_suppkey") % 10 == F.col("l_partkey") % 10).alias("same"))
    best = R.latest_per_key(l, ["l_partkey"], F.col("same"), F.desc("l_orderkey"), F.col("l_suppkey"))
    p = table(spark, sf, "part").select("p_partkey")
    return p.join(best, p.p_partkey == best.l_partkey, "left").select("p_partkey", F.col("l_suppkey").alias("bound_to"), F.col("same").alias("last_resort"))


@query("""
    WITH b AS (SELECT l_orderkey AS main, unnest(list(DISTINCT l_partkey)) AS part FROM lineitem GROUP BY 1),
    done AS (SELECT p_partkey AS part FROM part WHERE p_size >= 48)
    SELECT main, count(*) AS changed FROM b JOIN done USING (part) JOIN orders ON o_orderkey = main WHERE o_orderstatus <> 'P' GROUP BY 1
""")
def dependents_requeue(spark: SparkSession, sf: str) -> DataFrame:
    """Files that bound what has changed, found through their exploded lists of references."""
    bound = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("main")).agg(F.collect_set("l_partkey").alias("parts")).select("main", F.explode("parts").alias("part"))
    changed = table(spark, sf, "part").where("p_size >= 48").select(F.col("p_partkey").alias("part"))
    idle = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("main"))
    return bound.join(changed, "part").join(idle, "main", "left_semi").groupBy("main").agg(F.count("*").alias("changed"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN (SELECT count(*) FROM orders x WHERE x.o_orderstatus = 'P') + count(*) FILTER (WHERE o_orderstatus = 'O')
        OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS position FROM orders
""")
def queue_position(spark: SparkSession, sf: str) -> DataFrame:
    """How many are ahead in a queue: those with smaller ids, and all that are running."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    running = o.where("o_orderstatus = 'P'").agg(F.count("*").alias("running"))
    open_ = o.where("o_orderstatus = 'O'")
    waiting = R.running_count(open_, "o_orderkey", R.range_width(open_, "o_orderkey")).select("o_orderkey", "ahead")
    placed = waiting.join(F.broadcast(running)).select("o_orderkey", (F.col("ahead") + F.col("running")).alias("position"))
    return o.select("o_orderkey").join(placed, "o_orderkey", "left")


@query("""
    SELECT o_orderkey, count(*) OVER (ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS position
    FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000
""")
def reverse_position_claimable(spark: SparkSession, sf: str) -> DataFrame:
    """Newest first, only claimable rows count."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'O' AND o_totalprice > 100000").select("o_orderkey", (-F.col("o_orderkey")).alias("back"))
    return R.running_count(o, "back", R.range_width(o, "back")).select("o_orderkey", F.col("ahead").alias("position"))


@query("""
    SELECT (SELECT round(avg(o_totalprice), 2) FROM (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 20)) AS files,
        (SELECT round(avg(o_totalprice), 2) FROM (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 20)) AS drawings,
        (SELECT round(avg(o_totalprice), 2) FROM (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'X' ORDER BY o_orderkey DESC LIMIT 20)) AS nothing
""")
def recent_n_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Averages over the 20 most recent finished rows; null when there are none."""
    o = table(spark, sf, "orders")

    def recent(status: str, name: str) -> DataFrame:
        return o.where(F.col("o_orderstatus") == status).orderBy(F.desc("o_orderkey")).limit(20).agg(F.round(F.avg("o_totalprice"), 2).alias(name))

    return recent("F", "files").join(F.broadcast(recent("P", "drawings"))).join(F.broadcast(recent("X", "nothing")))


@query("""
    SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2) WHERE r = 1
""")
def majority_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent kind of each group, ties to the one seen first."""
    return R.majority(table(spark, sf, "events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", "votes")


@query("""
    SELECT l_partkey AS value, count(*) AS times, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY 1 HAVING count(*) >= 3 ORDER BY times DESC, first_seen LIMIT 50
""")
def top_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 most frequent values with at least 3 hits."""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return R.top_values(l, "value", "at", 3, 50)


@query("""
    SELECT o_custkey, count(DISTINCT o_orderpriority) AS labels, sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END)::BIGINT AS findings FROM orders GROUP BY 1
""")
def nested_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct labels and sums of array sizes inside nested results."""
    floor = F.struct(F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("findings"))
    docs = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(floor).alias("floors"))
    labels = F.size(F.array_distinct(F.transform("floors", lambda f: f["label"])))
    total = F.aggregate("floors", F.lit(0), lambda a, f: a + F.size(f["findings"]))
    return docs.select("o_custkey", labels.cast("long").alias("labels"), total.cast("long").alias("findings"))


@query("""
    SELECT l_returnflag, count(*) FILTER (WHERE sev = 'RED') AS red, count(*) FILTER (WHERE sev = 'ORANGE') AS orange, count(*) FILTER (WHERE sev = 'YELLOW') AS yellow, count(*) FILTER (WHERE sev = 'BLUE') AS blue
    FROM (SELECT l_returnflag, CASE WHEN l_discount >= 0.08 THEN 'RED' WHEN l_discount >= 0.05 THEN 'ORANGE' WHEN l_discount >= 0.02 THEN 'YELLOW' ELSE 'BLUE' END AS sev FROM lineitem WHERE l_linestatus <> 'F') GROUP BY 1
""")
def severity_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by severity without rejected findings, as a pivot over known values."""
    sev = F.when(F.col("l_discount") >= 0.08, "red").when(F.col("l_discount") >= 0.05, "orange").when(F.col("l_discount") >= 0.02, "yellow").otherwise("blue")
    l = table(spark, sf, "lineitem").where("l_linestatus <> 'F'").withColumn("sev", sev)
    return l.groupBy("l_returnflag").pivot("sev", ["red", "orange", "yellow", "blue"]).count().na.fill(0)


@query("""
    SELECT n_nationkey, coalesce(max(s_acctbal), 0) AS largest, round(coalesce(sum(s_acctbal), 0) + 100, 2) AS total
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1
""")
def max_and_total_area(spark: SparkSession, sf: str) -> DataFrame:
    """Largest floor, 0 without floors, and the total with the roof."""
    s = table(spark, sf, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("m"), F.sum("s_acctbal").alias("t"))
    return table(spark, sf, "nation").select("n_nationkey").join(s, "n_nationkey", "left").select("n_nationkey", F.coalesce("m", F.lit(0.0)).alias("largest"), F.round(F.coalesce("t", F.lit(0.0)) + 100, 2).alias("total"))


@query("""
    WITH f AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS area FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 6 ELSE l_linenumber END AS level, sum(area) AS area FROM f GROUP BY 1, 2
""")
def floor_area_fold(spark: SparkSession, sf: str) -> DataFrame:
    """One sheet per label, a mezzanine adds to its storey."""
    l = R.latest_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_quantity"))
    level = F.when(F.col("l_linenumber") == 7, 6).otherwise(F.col("l_linenumber"))
    return l.groupBy("l_orderkey", level.alias("level")).agg(F.sum("l_quantity").alias("area"))


@query("SELECT o_custkey, string_agg(o_orderpriority, '；' ORDER BY o_orderkey) AS priorities FROM orders GROUP BY 1")
def ordered_listagg(spark: SparkSession, sf: str) -> DataFrame:
    """Values in order as one text."""
    table(spark, sf, "orders").createOrReplaceTempView("pyroclast_orders")
    return spark.sql("SELECT o_custkey, listagg(o_orderpriority, '；') WITHIN GROUP (ORDER BY o_orderkey) AS priorities FROM pyroclast_orders GROUP BY o_custkey")


@query("SELECT l_suppkey, median(l_quantity - l_discount * 100) AS shift FROM lineitem GROUP BY 1")
def median_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Exact medians."""
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.median(F.col("l_quantity") - F.col("l_discount") * 100).alias("shift"))


@query("SELECT label, min(embedding[1])::DOUBLE AS x0, min(embedding[2])::DOUBLE AS y0, max(embedding[1])::DOUBLE AS x1, max(embedding[2])::DOUBLE AS y1 FROM embeddings GROUP BY 1")
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    """Extent of a group's points."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").groupBy("label").agg(*[f(e[i].cast("double")).alias(n) for f, i, n in ((F.min, 0, "x0"), (F.min, 1, "y0"), (F.max, 0, "x1"), (F.max, 1, "y1"))])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def status_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Grouping sets, which Spark has built in."""
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank FROM events")
def rank_within_route(spark: SparkSession, sf: str) -> DataFrame:
    """Place in each ranked list, from 0."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("rank"))


@query("""
    SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, turn <> coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) + 1 AS broken FROM conversations
""")
def continuity_check(spark: SparkSession, sf: str) -> DataFrame:
    """The row before, and whether numbers go on without a gap."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    broken = F.col("turn") != F.coalesce(F.lag("turn").over(w), F.lit(-1)) + 1
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), broken.alias("broken"))


@query("""
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations
""")
def heading_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Each row gets the heading that holds for it."""
    c = table(spark, sf, "conversations")
    return R.carry_forward(c, F.when(F.col("role") == "user", F.col("turn")), "heading", ["conv_id"], "turn").select("conv_id", "turn", "heading")


@query("""
    WITH p AS (SELECT user_id, value AS z FROM events UNION ALL SELECT DISTINCT user_id, 0.0 FROM events UNION ALL SELECT DISTINCT user_id, 200.0 FROM events),
    g AS (SELECT user_id, z, lead(z) OVER (PARTITION BY user_id ORDER BY z) - z AS gap FROM p)
    SELECT user_id, round(max(gap), 6) AS largest_gap, max(gap) > 15 AS confirm, greatest(1, ceil((max(z) - min(z)) / 15 - 1e-9))::BIGINT AS need FROM g GROUP BY 1
""")
def gap_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The largest gap between heights, both ends included, and how many devices a span needs."""
    e = table(spark, sf, "events").select("user_id", F.col("value").alias("z"))
    ends = e.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(0.0), F.lit(200.0))).alias("z"))
    w = Window.partitionBy("user_id").orderBy("z")
    g = e.unionByName(ends).withColumn("gap", F.lead("z").over(w) - F.col("z"))
    need = F.greatest(F.lit(1), F.ceil((F.max("z") - F.min("z")) / 15 - 1e-9)).cast("long")
    return g.groupBy("user_id").agg(F.round(F.max("gap"), 6).alias("largest_gap"), (F.max("gap") > 15).alias("confirm"), need.alias("need"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_discount >= 0.08 THEN 0 WHEN l_discount >= 0.05 THEN 1 WHEN l_discount >= 0.02 THEN 2 ELSE 3 END, l_quantity DESC, l_linenumber, l_partkey, l_suppkey)::INTEGER AS no
    FROM lineitem
""")
def severity_sort_number(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by severity, then larger areas, then order of emission, numbered from 1."""
    rank = F.when(F.col("l_discount") >= 0.08, 0).when(F.col("l_discount") >= 0.05, 1).when(F.col("l_discount") >= 0.02, 2).otherwise(3)
    w = Window.partitionBy("l_orderkey").orderBy(rank, F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("no"))


@query("""
    (SELECT 'fifo' AS head, o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1)
    UNION ALL (SELECT 'lifo', o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 1)
""")
def queue_heads(spark: SparkSession, sf: str) -> DataFrame:
    """the oldest waiting and the newest pending row."""
    o = table(spark, sf, "orders")
    oldest = o.where("o_orderstatus = 'O'").orderBy("o_orderkey").limit(1)
    newest = o.where("o_orderstatus = 'P'").orderBy(F.desc("o_orderkey")).limit(1)
    return oldest.select(F.lit("fifo").alias("head"), "o_orderkey").unionByName(newest.select(F.lit("lifo").alias("head"), "o_orderkey"))


@query("""
    SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY n NULLS LAST, p_partkey) AS ordered FROM (SELECT p_brand, p_partkey, CASE WHEN p_size > 10 THEN p_size END AS n FROM part) GROUP BY 1
""")
def nulls_last_order(spark: SparkSession, sf: str) -> DataFrame:
    """F06, F09, C2.15: sheets by number, those without one last, ties by id."""
    n = F.when(F.col("p_size") > 10, F.col("p_size"))
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(n.isNull().alias("a"), n.alias("b"), F.col("p_partkey").alias("c")))).alias("x"))
    return rows.select("p_brand", F.array_join(F.transform("x", lambda s: s["c"].cast("string")), ",").alias("ordered"))


@query("""
    SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1] AS largest, list(o_orderkey ORDER BY o_totalprice, o_orderkey)[1] AS smallest,
        array_to_string(list_slice(list(o_orderstatus ORDER BY o_orderkey), 1, 8), '、') || CASE WHEN count(*) > 8 THEN '…' || count(*) ELSE '' END AS shown
    FROM orders GROUP BY 1
""")
def arg_max_and_display(spark: SparkSession, sf: str) -> DataFrame:
    """rows with the largest and smallest price (ties to the smaller key), and a list cut for display."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"])
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("largest"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("smallest"), items.alias("items"))
    shown = F.concat(F.array_join(F.slice("items", 1, 8), "、"), F.when(F.size("items") > 8, F.concat(F.lit("…"), F.size("items"))).otherwise(""))
    return g.select("o_custkey", "largest", "smallest", shown.alias("shown"))


@query("""
    SELECT o_custkey, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, list_sort(list_filter(a, lambda x: list_contains(b, x))) AS both, list_sort(list_distinct(list_concat(a, b))) AS either FROM (
        SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), []) AS b FROM orders GROUP BY 1)
""")
def set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Difference, intersection and union of sets in columns."""
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(of("F").alias("a"), of("O").alias("b"))
    return g.select("o_custkey", *[F.array_sort(f("a", "b")).alias(n) for f, n in ((F.array_except, "only_a"), (F.array_intersect, "both"), (F.array_union, "either"))])


@query("""
    SELECT 'except' AS op, k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'union', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
""")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """SQL's set operations."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    mine, other = o.select(F.col("o_custkey").alias("k")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    some = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).union(c.where("c_acctbal > 9000").select("c_custkey")).distinct()
    named = lambda d, n: d.select(F.lit(n).alias("op"), "k")
    return named(mine.distinct().subtract(other), "except").unionByName(named(mine.intersect(other), "intersect")).unionByName(named(some, "union"))


@query("""
    SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1
""")
def distinct_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values by first appearance."""
    firsts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    rows = firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("x"))
    return rows.select("user_id", F.array_join(F.transform("x", lambda s: s["event_type"]), ">").alias("kinds"))
