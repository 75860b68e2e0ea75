"""Further joins, merges, report statistics and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import forecast, merging, temporal
from tidewright.plans import seats as seat_plans
from tidewright.plans.base import Registry, table

R = Registry()
add = R.add
_S = seat_plans.SEATS_SQL


@add("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.event_id < b.event_id AND abs(date_diff('second', a.ts, b.ts)) <= 3600""")
def time_tolerance_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Same key, other kind, within an hour: an equi-join on key and hour slot (own and next), not a scan of a user's pairs."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.unix_timestamp("ts").alias("s"))
    slot = F.floor(F.col("s") / 3600)
    left = e.select("user_id", F.col("event_id").alias("i"), F.col("event_type").alias("ti"), F.col("s").alias("si"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    right = e.select("user_id", F.col("event_id").alias("j"), F.col("event_type").alias("tj"), F.col("s").alias("sj"), slot.alias("slot"))
    near = left.join(right, ["user_id", "slot"]).where((F.col("ti") != F.col("tj")) & (F.col("i") < F.col("j")) & (F.abs(F.col("si") - F.col("sj")) <= 3600))
    return near.select(F.col("i").alias("a"), F.col("j").alias("b"))


@add("""SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2""")
def cooccurrence_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one record as unordered pairs: records hold few entities, so lists are exploded in place."""
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s")).where("size(s) > 1")
    firsts = sets.select(F.posexplode("s").alias("k", "a"), "s")
    return firsts.select("a", F.explode(F.filter("s", lambda x: x > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@add("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000) UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9500 UNION SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)""")
def qualifying_union(spark: SparkSession, d: str) -> DataFrame:
    """Three ways to qualify, as semi joins, united without repeats."""
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    s = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    ways = [c.join(o, "c_custkey", "left_semi"), c.where("c_acctbal > 9500"), c.join(s, "c_nationkey", "left_semi")]
    return ways[0].select("c_custkey").unionByName(ways[1].select("c_custkey")).unionByName(ways[2].select("c_custkey")).distinct()


@add("""WITH k AS (SELECT * FROM (VALUES ('red', 'colour'), ('ring', 'shape'), ('gear', 'shape')) v(label, kind)) SELECT p_partkey, kind, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(lower(trim(p_name)), ' ')) AS label FROM part) JOIN k USING (label) GROUP BY 1, 2""")
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("red", "colour"), ("ring", "shape"), ("gear", "shape")], "label string, kind string")
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower(F.trim("p_name")), " ")).alias("label"))
    return words.join(F.broadcast(known), "label").groupBy("p_partkey", "kind").agg(F.count("*").alias("n"))


@add("""SELECT DISTINCT p_brand, s.key FROM part, (VALUES ('brand#1'), ('brand#12'), ('#2')) s(key) WHERE lower(p_brand) = s.key OR contains(lower(p_brand), s.key)""")
def fuzzy_party_key(spark: SparkSession, d: str) -> DataFrame:
    """Equal or contained: over distinct labels and a fixed list of keys, both small."""
    keys = F.array(*[F.lit(k) for k in ("brand#1", "brand#12", "#2")])
    labels = table(spark, d, "part").select("p_brand").distinct()
    return labels.select("p_brand", F.explode(F.filter(keys, lambda k: F.contains(F.lower("p_brand"), k))).alias("key"))


@add(r"""SELECT doc_id, regexp_matches(text, '(?s)\bof\b.{0,34}\bthe\b|\bthe\b.{0,34}\bof\b') AS near_cue FROM documents""")
def proximity_cue(spark: SparkSession, d: str) -> DataFrame:
    """A name counts only with a cue word within 34 characters."""
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(r"(?s)\bof\b.{0,34}\bthe\b|\bthe\b.{0,34}\bof\b").alias("near_cue"))


@add("""SELECT user_id, CAST(round(sum(w) * 10) AS BIGINT) AS strength_tenths, count(*) AS n, CASE WHEN sum(w) >= 250 AND count(*) >= 10 THEN 'PROMOTE' WHEN sum(w) >= 80 THEN 'WATCH' ELSE 'DORMANT' END AS advice
FROM (SELECT user_id, CASE event_type WHEN 'purchase' THEN 10 WHEN 'signup' THEN 5 WHEN 'click' THEN 2 ELSE 1 END AS w FROM events) GROUP BY user_id""")
def signal_strength(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    w = F.when(kind == "purchase", 10).when(kind == "signup", 5).when(kind == "click", 2).otherwise(1)
    rows = table(spark, d, "events").groupBy("user_id").agg(F.sum(w).alias("w"), F.count("*").alias("n"))
    advice = F.when((F.col("w") >= 250) & (F.col("n") >= 10), "PROMOTE").when(F.col("w") >= 80, "WATCH").otherwise("DORMANT")
    return rows.select("user_id", (F.col("w") * 10).alias("strength_tenths"), "n", advice.alias("advice"))


@add(r"""SELECT lang, round(sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')))::DOUBLE / (SELECT sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) FROM documents WHERE lang = 'en'), 6) AS ratio FROM documents GROUP BY lang""")
def word_count_ratio(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    sums = table(spark, d, "documents").groupBy("lang").agg(F.sum(n).alias("n"))
    base = sums.where("lang = 'en'").select(F.col("n").alias("base"))
    return sums.crossJoin(F.broadcast(base)).select("lang", F.round(F.col("n") / F.col("base"), 6).alias("ratio"))


@add("""WITH s AS (SELECT c_mktsegment AS bloc, CASE WHEN max(o_orderdate) >= TIMESTAMP '2001-07-25' THEN 'recent' ELSE 'old' END AS era, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, c_nationkey) SELECT bloc, era, count(*) AS groups, sum(n)::BIGINT AS orders FROM s GROUP BY 1, 2""")
def era_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("bloc"), "c_nationkey").agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    era = F.when(F.col("last") >= F.lit("2001-07-25").cast("timestamp"), "recent").otherwise("old")
    return rows.groupBy("bloc", era.alias("era")).agg(F.count("*").alias("groups"), F.sum("n").alias("orders"))


@add("""WITH u AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') || ' ' || o_orderstatus AS line, 0 AS layer FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_custkey, CASE WHEN o_totalprice > 250000 THEN 'large order' ELSE strftime(o_orderdate, '%Y-%m') || ' F' END, 1 FROM orders),
o AS (SELECT o_custkey, line, min(layer) AS layer FROM u GROUP BY 1, 2) SELECT o_custkey, line, row_number() OVER (PARTITION BY o_custkey ORDER BY (nullif(regexp_extract(line, '^(\\d{4}(?:-\\d{2}){0,2})', 1), '') IS NULL), nullif(regexp_extract(line, '^(\\d{4}(?:-\\d{2}){0,2})', 1), ''), layer, line) AS place FROM o""".replace("\\\\", "\\"))
def merged_history(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    first = o.where("o_orderstatus <> 'P'").select("o_custkey", F.concat_ws(" ", month, "o_orderstatus").alias("line"))
    second = o.select("o_custkey", F.when(F.col("o_totalprice") > 250000, "large order").otherwise(F.concat(month, F.lit(" F"))).alias("line"))
    return merging.layered_history([first, second], "o_custkey", "line").select("o_custkey", "line", "place")


@add("""WITH l AS (SELECT p_name AS name, p_type AS display, p_brand AS alias, p_size AS layer FROM part) SELECT name, arg_min(display, (layer, display)) AS display, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases, count(DISTINCT layer) AS layers FROM l GROUP BY name""")
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("display"), F.array("p_brand").alias("alias"), F.col("p_size").alias("layer"))
    return merging.merge_entities(rows, "name", "display", "alias", "layer").withColumn("aliases", F.array_join("aliases", ","))


@add("""WITH r AS (SELECT p_brand AS anchor, p_partkey AS id, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS t FROM part) SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.anchor = b.anchor AND a.id < b.id WHERE len(list_intersect(a.t, b.t)) > 0 AND len(list_intersect(a.t, b.t)) >= 0.7 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) - 1e-9""")
def same_event_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return merging.same_event_pairs(rows, "p_partkey", "p_brand", "title")


@add("""WITH g AS (SELECT c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS grp, c_custkey FROM customer), p AS (SELECT c_custkey, 'old-' || CAST(c_nationkey // 2 AS VARCHAR) AS prior_id FROM customer WHERE c_acctbal > 3000), v AS (SELECT grp, prior_id, count(*) AS n FROM g JOIN p USING (c_custkey) GROUP BY 1, 2),
b AS (SELECT grp, arg_min(prior_id, (-n, prior_id)) AS kept FROM v GROUP BY grp) SELECT DISTINCT g.grp, coalesce(kept, g.grp) AS stable_id FROM g LEFT JOIN b ON b.grp = g.grp""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    groups = c.select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("grp"), "c_custkey")
    prior = c.where("c_acctbal > 3000").select("c_custkey", F.concat(F.lit("old-"), F.expr("c_nationkey div 2").cast("string")).alias("prior_id"))
    return merging.inherited_ids(groups, prior, "grp", "c_custkey", "prior_id")


@add(f"""WITH {_S}, s AS (SELECT unnest(['base', 'pn_surge', 'government_surge', 'split', 'fragmentation']) AS scenario), t AS (SELECT scenario, CASE WHEN raw + {seat_plans._shift_sql('winner')} - {seat_plans._shift_sql('runnerup')} < 0 THEN runnerup ELSE winner END AS bloc, count(*) AS seats FROM proj, s GROUP BY 1, 2)
SELECT bloc, min(seats) AS low, max(seats) AS high, max(seats) - min(seats) AS spread FROM t GROUP BY bloc HAVING count(*) = 5""")
def widest_scenario_range(spark: SparkSession, d: str) -> DataFrame:
    """Only blocs that have a number in every scenario."""
    rows = forecast.scenarios(forecast.with_swings(seat_plans.seats(spark, d), seat_plans.swings(spark, d)), seat_plans.SCENARIOS, F.col("code") % 2 == 0)
    return rows.groupBy("bloc").agg(F.min("seats").alias("low"), F.max("seats").alias("high"), (F.max("seats") - F.min("seats")).alias("spread"), F.count("*").alias("n")).where("n = 5").drop("n")


@add(f"WITH {_S} SELECT state, CASE WHEN raw < 0 THEN runnerup ELSE winner END AS bloc, count(*) AS seats, round(min(abs(raw)), 6) AS thinnest FROM proj GROUP BY 1, 2")
def state_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Projected seats of each bloc inside a state, and its thinnest hold."""
    rows = seat_plans.with_projection(spark, d).groupBy("state", F.col("proj_winner").alias("bloc"))
    return rows.agg(F.count("*").alias("seats"), F.round(F.min("proj_margin"), 6).alias("thinnest"))


@add(f"WITH {_S} SELECT winner || '>' || runnerup AS direction, count(*) AS flips, round(min(-raw), 6) AS tightest FROM proj WHERE raw < 0 GROUP BY 1")
def flip_directions(spark: SparkSession, d: str) -> DataFrame:
    rows = seat_plans.with_projection(spark, d).where("flip").groupBy(F.concat_ws(">", "winner", "runnerup").alias("direction"))
    return rows.agg(F.count("*").alias("flips"), F.round(F.min("proj_margin"), 6).alias("tightest"))


@add("""WITH c AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_at FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_at, l_suppkey) AS number FROM c""")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Citations numbered by where they are seen first in their document."""
    first = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_at"))
    return first.select("l_orderkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first_at", "l_suppkey")).alias("number"))


@add("""WITH w AS (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_end FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT CAST(max(o_orderdate) AS DATE) AS now FROM orders) SELECT c_custkey, date_diff('day', last_end, now) AS gap_days, greatest(7, coalesce(date_diff('day', last_end, now), 0) + 1) AS look_back FROM customer LEFT JOIN w ON o_custkey = c_custkey, n""")
def dynamic_window(spark: SparkSession, d: str) -> DataFrame:
    """Next collection window of each source: the usual interval, or the gap since the last success and a day."""
    from tidewright.streaming.incremental import look_back_days

    o = table(spark, d, "orders")
    last = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).alias("last_end"))
    now = o.agg(F.to_date(F.max("o_orderdate")).alias("now"))
    rows = table(spark, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").crossJoin(F.broadcast(now))
    gap = F.datediff("now", "last_end")
    return rows.select("c_custkey", gap.alias("gap_days"), look_back_days(F.lit(7), F.coalesce(gap, F.lit(0))).alias("look_back"))


@add("""WITH s AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_type = 'purchase'), t AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error') SELECT s.event_id AS to_id, arg_max(t.event_id, (t.ts, t.event_id)) AS from_id, date_diff('day', CAST(max(t.ts) AS DATE), CAST(any_value(s.ts) AS DATE)) AS gap_days FROM s JOIN t ON t.user_id = s.user_id AND (t.ts, t.event_id) < (s.ts, s.event_id) GROUP BY s.event_id HAVING date_diff('day', CAST(max(t.ts) AS DATE), CAST(any_value(s.ts) AS DATE)) <= 1""")
def switch_follows_exit(spark: SparkSession, d: str) -> DataFrame:
    """The last exit of the same person within a tolerance before a switch."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    found = temporal.previous_matching(e, "user_id", "ts", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error", 1)
    return found.select("to_id", "from_id", "gap_days")


@add(r"""SELECT page_id, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS masked_length, len(list_distinct(regexp_extract_all(html, 'https?://[^\s"''<>)\]]+'))) AS n_urls FROM pages""")
def masked_pages(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.functions.text import urls_in

    raw = F.regexp_replace("html", "<[^>]*>", " ")
    return table(spark, d, "pages").select("page_id", F.length(raw).cast("long").alias("masked_length"), F.size(urls_in(F.col("html"))).cast("long").alias("n_urls"))
