"""Event-store views and commands on the driver's tables: events with users as entities, orders with customers and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import checks, temporal
from tidewright.plans.base import Registry, table

R = Registry()
add = R.add


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their day as text and as a date."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", "props", "ts", F.to_date("ts").alias("day"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"))


_DAY = "strftime(ts, '%Y-%m-%d')"


@add(f"SELECT event_id, {_DAY} AS event_date, event_type, user_id FROM events WHERE ts IS NOT NULL ORDER BY ts, event_type, event_id LIMIT 200")
def event_timeline(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("ts is not null").orderBy("ts", "event_type", "event_id").limit(200).select("event_id", "event_date", "event_type", "user_id")


@add(f"SELECT event_id, {_DAY} AS event_date, event_type FROM events WHERE event_type ILIKE '%CH%' AND {_DAY} >= '2024-01-05' AND {_DAY} <= '2024-01-20' AND value >= 10")
def event_filter_like(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    asked = {"type": F.col("event_type").ilike("%CH%"), "since": F.col("event_date") >= "2024-01-05", "until": F.col("event_date") <= "2024-01-20", "value": F.col("value") >= 10}
    for condition in asked.values():
        rows = rows.where(condition)
    return rows.select("event_id", "event_date", "event_type")


@add(f"SELECT user_id, count(*) AS event_count, min({_DAY}) AS first_date, max({_DAY}) AS last_date, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM events GROUP BY user_id")
def entity_activity(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array_join(F.sort_array(F.collect_set("event_type")), ",")
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("event_count"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), kinds.alias("event_types"))


@add(f"""SELECT user_id, count(*) AS event_count, max({_DAY}) AS last_date FROM events WHERE CAST(user_id AS VARCHAR) LIKE '%1%'
GROUP BY user_id ORDER BY (user_id = 11) DESC, event_count DESC, user_id LIMIT 20""")
def entity_exact_first(spark: SparkSession, d: str) -> DataFrame:
    hits = _events(spark, d).where(F.col("user_id").cast("string").like("%1%")).groupBy("user_id").agg(F.count("*").alias("event_count"), F.max("event_date").alias("last_date"))
    return hits.orderBy(F.desc(F.col("user_id") == 11), F.desc("event_count"), "user_id").limit(20)


@add("""SELECT o.o_orderkey, strftime(o.o_orderdate, '%Y-%m-%d') AS order_date, o.o_orderstatus, c.c_name AS customer, l.suppliers
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, string_agg(s, '; ' ORDER BY s) AS suppliers FROM (SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem WHERE l_returnflag = 'A') GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""")
def event_full_left_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), "; ").alias("suppliers"))
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "o_orderstatus", F.col("c_name").alias("customer"), "suppliers")


@add("SELECT s_suppkey, s_name, count(l_orderkey) AS line_count FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name")
def source_usage(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("l_orderkey").alias("n"))
    s = table(spark, d, "supplier")
    return s.join(used, s.s_suppkey == used.l_suppkey, "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("line_count"))


@add(f"""SELECT event_type AS metric, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS unit, count(*) AS observations, min(value) AS min_value, max(value) AS max_value,
max(max({_DAY})) OVER (PARTITION BY event_type) AS latest_date FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def metric_series(spark: SparkSession, d: str) -> DataFrame:
    """The latest date is of the metric, whatever the unit, as the view defines it."""
    rows = _events(spark, d).where("value is not null").withColumn("unit", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    parts = rows.groupBy(F.col("event_type").alias("metric"), "unit").agg(F.count("*").alias("observations"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.max("event_date").alias("_last"))
    latest = parts.groupBy("metric").agg(F.max("_last").alias("latest_date"))
    return parts.drop("_last").join(latest, "metric").select("metric", "unit", "observations", "min_value", "max_value", "latest_date")


@add("SELECT l_orderkey, count(DISTINCT l_suppkey) AS source_count, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'multi' ELSE 'single' END AS corroboration_class FROM lineitem GROUP BY l_orderkey")
def corroboration_class(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("source_count")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("source_count")).select("l_orderkey", "source_count", F.when(n > 1, "multi").otherwise("single").alias("corroboration_class"))


@add("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def open_claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


_CHAIN = "SELECT user_id, event_id AS from_id, lead(event_id) OVER w AS to_id, date_diff('day', CAST(ts AS DATE), CAST(lead(ts) OVER w AS DATE)) AS gap_days FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _precedes(spark: SparkSession, d: str) -> DataFrame:
    return temporal.chain(_events(spark, d), "user_id", "ts", "event_id", 2)


@add(f"SELECT * FROM ({_CHAIN}) WHERE to_id IS NOT NULL AND gap_days <= 2")
def event_links_precedes(spark: SparkSession, d: str) -> DataFrame:
    return _precedes(spark, d)


_ASOF = """SELECT p.user_id, arg_max(c.event_id, (c.ts, c.event_id)) AS from_id, p.event_id AS to_id, date_diff('day', CAST(max(c.ts) AS DATE), CAST(p.ts AS DATE)) AS gap_days
FROM events p JOIN events c ON c.user_id = p.user_id AND c.event_type IN ('click', 'view') AND (c.ts, c.event_id) < (p.ts, p.event_id)
WHERE p.event_type = 'purchase' GROUP BY p.user_id, p.event_id, p.ts"""


@add(_ASOF)
def event_links_follows_asof(spark: SparkSession, d: str) -> DataFrame:
    return temporal.previous_matching(_events(spark, d), "user_id", "ts", "event_id", F.col("event_type") == "purchase", F.col("event_type").isin("click", "view"))


@add(f"SELECT * FROM ({_ASOF.replace(chr(39) + 'click' + chr(39) + ', ' + chr(39) + 'view' + chr(39), chr(39) + 'signup' + chr(39))}) WHERE gap_days <= 3")
def asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return temporal.previous_matching(_events(spark, d), "user_id", "ts", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "signup", 3)


@add(f"WITH l AS (SELECT from_id, to_id FROM ({_CHAIN}) WHERE to_id IS NOT NULL AND gap_days <= 2) SELECT from_id AS node, to_id AS other, 'out' AS direction FROM l UNION ALL SELECT to_id, from_id, 'in' FROM l")
def links_both_directions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.both_directions(_precedes(spark, d))


@add(f"""SELECT l.from_id, a.event_type AS from_type, l.to_id, b.event_type AS to_type, l.gap_days FROM ({_CHAIN}) l
JOIN events a ON a.event_id = l.from_id JOIN events b ON b.event_id = l.to_id WHERE l.gap_days <= 2""")
def event_links_full(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "event_type")
    a, b = e.select(F.col("event_id").alias("from_id"), F.col("event_type").alias("from_type")), e.select(F.col("event_id").alias("to_id"), F.col("event_type").alias("to_type"))
    return _precedes(spark, d).join(a, "from_id").join(b, "to_id").select("from_id", "from_type", "to_id", "to_type", "gap_days")


_THREADS = """SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS thread FROM (
SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) > 1 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _threads(spark: SparkSession, d: str) -> DataFrame:
    return temporal.sessions(_events(spark, d), "user_id", "ts", "event_id", 1)


@add(f"SELECT user_id, CAST(thread AS BIGINT) AS thread, event_id, event_type, row_number() OVER (PARTITION BY user_id, thread ORDER BY ts, event_id) AS seq FROM ({_THREADS})")
def story_timeline(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id", "thread").orderBy("ts", "event_id"))
    return _threads(spark, d).select("user_id", "thread", "event_id", "event_type", seq.alias("seq"))


@add(f"""WITH t AS ({_THREADS}), s AS (SELECT user_id, CAST(thread AS BIGINT) AS thread, count(*) AS event_count, CAST(min(ts) AS DATE) AS f, CAST(max(ts) AS DATE) AS l FROM t GROUP BY 1, 2)
SELECT user_id, thread, event_count, strftime(f, '%Y-%m-%d') AS first_seen, strftime(l, '%Y-%m-%d') AS last_update,
CASE WHEN date_diff('day', l, (SELECT max(l) FROM s)) <= 7 THEN 'open' WHEN date_diff('day', l, (SELECT max(l) FROM s)) <= 14 THEN 'dormant' ELSE 'closed' END AS status FROM s""")
def story_status(spark: SparkSession, d: str) -> DataFrame:
    s = _threads(spark, d).groupBy("user_id", "thread").agg(F.count("*").alias("event_count"), F.min("day").alias("f"), F.max("day").alias("l"))
    as_of = _events(spark, d).agg(F.max("day").alias("as_of"))
    return s.crossJoin(F.broadcast(as_of)).select("user_id", "thread", "event_count", F.date_format("f", "yyyy-MM-dd").alias("first_seen"), F.date_format("l", "yyyy-MM-dd").alias("last_update"), temporal.age_status(F.col("l"), F.col("as_of"), 7, 14).alias("status"))


@add(f"""WITH t AS ({_THREADS}), s AS (SELECT user_id, CAST(thread AS BIGINT) AS thread, count(*) AS event_count, max({_DAY}) AS last_event_date, min({_DAY}) AS first_event_date, arg_max(event_type, (ts, event_id)) AS latest_type FROM t GROUP BY 1, 2)
SELECT * FROM s WHERE last_event_date >= '2024-01-25'""")
def story_current(spark: SparkSession, d: str) -> DataFrame:
    s = _threads(spark, d).groupBy("user_id", "thread").agg(F.count("*").alias("event_count"), F.max("event_date").alias("last_event_date"), F.min("event_date").alias("first_event_date"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest_type"))
    return s.where("last_event_date >= '2024-01-25'")


@add("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value > 5 GROUP BY event_type")
def guarded_query(spark: SparkSession, d: str) -> DataFrame:
    statement = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} WHERE value > 5 GROUP BY event_type"
    return checks.guarded_sql(spark, statement, events=table(spark, d, "events"))


@add("""SELECT 'event_type' AS kind, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    def counted(frame: DataFrame, kind: str, column: str) -> DataFrame:
        return frame.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")

    o = table(spark, d, "orders")
    return counted(table(spark, d, "events"), "event_type", "event_type").unionByName(counted(o, "status", "o_orderstatus")).unionByName(counted(o, "priority", "o_orderpriority"))


@add("SELECT CASE WHEN c_acctbal IS NULL THEN 'undated' WHEN c_acctbal < 0 THEN 'antecedent' WHEN c_acctbal <= 5000 THEN 'in_window' ELSE 'post_window' END AS window_class, count(*) AS n FROM customer GROUP BY 1")
def window_class(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    kind = F.when(b.isNull(), "undated").when(b < 0, "antecedent").when(b.between(0, 5000), "in_window").otherwise("post_window")
    return table(spark, d, "customer").groupBy(kind.alias("window_class")).agg(F.count("*").alias("n"))


@add("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value_num, 'k' AS metric, CASE WHEN 'k' LIKE '%_pct' THEN 'pct' ELSE 'count' END AS unit FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_metric_flatten(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.from_json("props", "map<string,string>")).alias("metric", "raw")
    rows = table(spark, d, "events").select("event_id", pairs)
    return rows.select("event_id", F.col("raw").try_cast("double").alias("value_num"), "metric", F.when(F.col("metric").endswith("_pct"), "pct").otherwise("count").alias("unit")).where("value_num is not null")
