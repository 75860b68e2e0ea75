"""Dates, names, filters, forecast inputs and integrity rules on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import dates, names
from tidewright.operators import checks, filters, forecast, keys
from tidewright.plans import seats
from tidewright.plans.base import Registry, table

R = Registry()
add = R.add

_SAID = """CASE o_orderkey % 12 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') ELSE strftime(o_orderdate, '%Y-%m-%d') END"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their date as news carry it: missing, empty, unreadable, RFC 822 or ISO."""
    k, at = F.col("o_orderkey") % 12, F.col("o_orderdate")
    said = F.when(k == 0, "unknown").when(k == 1, None).when(k == 2, "").when(k == 3, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", said.alias("said"))


@add("SELECT o_orderkey FROM orders WHERE o_orderkey % 12 < 3 OR o_orderdate >= TIMESTAMP '1998-01-01'")
def recent_items(spark: SparkSession, d: str) -> DataFrame:
    """Recency: what can't be read as a date passes."""
    return _said(spark, d).where(dates.is_recent(F.col("said"), F.lit("1998-01-01").cast("timestamp"))).select("o_orderkey")


@add(f"SELECT o_orderkey FROM (SELECT o_orderkey, {_SAID} AS said FROM orders) WHERE coalesce(said, '') <> '' AND substr(said, 1, 10) BETWEEN '1997-01-01' AND '1998-06-30'")
def items_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Hard window: what has no ISO date fails."""
    return _said(spark, d).where(dates.in_window(F.col("said"), "1997-01-01", "1998-06-30")).select("o_orderkey")


_MONTH = "strftime(o_orderdate, '%b')"
_SHAPES = [
    ("'From ' || strftime(o_orderdate, '%Y-%m-%d') || ' to ' || strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') || '.'", "5", "%Y-%m-%d", "40", "day"),
    ("'Signed ' || strftime(o_orderdate, '%Y-%m-%d') || ', filed.'", "7", "%Y-%m-%d", None, "day"),
    ("'Over ' || strftime(o_orderdate, '%-d %B') || ' – ' || strftime(o_orderdate + INTERVAL 3 DAY, '%-d %B') || ' ' || strftime(o_orderdate, '%Y')", "5", "%Y-%m-%d", "3", "day"),
    ("'On ' || strftime(o_orderdate, '%-d %b. %Y') || ' it ended'", "3", "%Y-%m-%d", None, "day"),
    ("'Since ' || strftime(o_orderdate, '%B %Y')", "6", "%Y-%m-01", None, "month"),
    ("'In Q' || CAST(quarter(o_orderdate) AS VARCHAR) || ' ' || strftime(o_orderdate, '%Y') || ' at last'", "3", "quarter", None, "quarter"),
]
_MOVED = "o_orderdate + INTERVAL 8 YEAR"


def _shape_sql(k: int) -> str:
    said, start, iso, days, precision = _SHAPES[k]
    first = "strftime(o_orderdate, '%Y') || '-' || lpad(CAST(quarter(o_orderdate) * 3 - 2 AS VARCHAR), 2, '0') || '-01'" if iso == "quarter" else f"strftime(o_orderdate, '{iso}')"
    last = "NULL" if days is None else f"strftime(o_orderdate, '%Y') || strftime(o_orderdate + INTERVAL {days} DAY, '-%m-%d')" if k == 2 else f"strftime(o_orderdate + INTERVAL {days} DAY, '%Y-%m-%d')"
    return f"SELECT o_orderkey, {start} AS start, {first} AS iso, {last} AS iso_end, '{precision}' AS precision FROM o WHERE o_orderkey % 6 = {k}"


@add(f"WITH o AS (SELECT o_orderkey, {_MOVED} AS o_orderdate FROM orders) " + " UNION ALL ".join(_shape_sql(k) for k in range(len(_SHAPES))))
def date_grammars(spark: SparkSession, d: str) -> DataFrame:
    """Dates of sentences in six shapes (years from 2000 on), read back with their places, ends and precision."""
    at = F.add_months("o_orderdate", 96)
    o = table(spark, d, "orders").select("o_orderkey", at.alias("at"))

    def day(days: int, form: str):
        return F.date_format(F.date_add("at", days), form)

    shapes = [
        F.concat(F.lit("From "), day(0, "yyyy-MM-dd"), F.lit(" to "), day(40, "yyyy-MM-dd"), F.lit(".")),
        F.concat(F.lit("Signed "), day(0, "yyyy-MM-dd"), F.lit(", filed.")),
        F.concat(F.lit("Over "), day(0, "d MMMM"), F.lit(" – "), day(3, "d MMMM"), F.lit(" "), day(0, "yyyy")),
        F.concat(F.lit("On "), day(0, "d MMM. yyyy"), F.lit(" it ended")),
        F.concat(F.lit("Since "), day(0, "MMMM yyyy")),
        F.concat(F.lit("In Q"), F.quarter("at").cast("string"), F.lit(" "), day(0, "yyyy"), F.lit(" at last")),
    ]
    said = F.get(F.array(*shapes), (F.col("o_orderkey") % 6).cast("int"))
    return o.select("o_orderkey", F.inline(dates.extract_dates(said)))


@add("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2026-03-05' WHEN 1 THEN '2019-04-01' ELSE NULL END AS iso, CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'unknown' END AS precision FROM orders")
def primary_dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, "elected in May 2019, sworn in on 5 March 2026, again 2027-01-01").when(k == 1, "since April 2019 and Q3 2020").otherwise("no date at all, but 1999")
    rows = table(spark, d, "orders").select("o_orderkey", dates.primary_date(dates.extract_dates(said)).alias("hit"))
    return rows.select("o_orderkey", F.col("hit.iso").alias("iso"), F.coalesce("hit.precision", F.lit("unknown")).alias("precision"))


@add("SELECT lower(regexp_extract(c_name, '#0*([0-9]+)$', 1)) AS number, 'customer ' || lower(c_mktsegment) AS person FROM customer WHERE c_custkey % 5 < 4 UNION ALL SELECT regexp_extract(c_name, '#0*([0-9]+)$', 1), 'customer of ' || lower(c_mktsegment) FROM customer WHERE c_custkey % 5 = 4")
def person_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names of one person in several spellings have one key."""
    k, seg = F.col("c_custkey") % 5, F.initcap("c_mktsegment")
    name = F.when(k == 0, F.concat(F.lit("Datuk Seri Customer bin "), seg)).when(k == 1, F.concat(F.lit("Dr. Customer Mohd "), seg, F.lit(" (MP)"))).when(k == 2, F.concat(F.lit("  CUSTOMER  "), seg, F.lit(" from 2 December 2023"))).when(k == 3, F.concat(F.lit("Tun Customer a/l "), seg)).otherwise(F.concat(F.lit("Customer of "), seg))
    return table(spark, d, "customer").select(F.regexp_extract("c_name", "#0*([0-9]+)$", 1).alias("number"), names.person_key(name).alias("person"))


@add("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN CASE WHEN contains(p_name, 'ring') THEN 'critical' ELSE 'high' END WHEN 'SMALL' THEN CASE WHEN contains(p_name, 'ring') THEN 'high' ELSE 'medium' END ELSE 'low' END AS significance, CASE WHEN contains(p_name, 'old') THEN CASE WHEN p_size % 3 > 0 THEN 'medium' ELSE 'low' END WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 'low' ELSE 'medium' END WHEN p_size % 4 IN (1, 2) THEN 'high' ELSE 'medium' END AS confidence FROM part")
def significance_confidence(spark: SparkSession, d: str) -> DataFrame:
    precision = F.get(F.array(*[F.lit(x) for x in ("unknown", "day", "month", "quarter")]), F.col("p_size") % 4)
    rank = names.significance(F.col("p_type"), F.col("p_name"), {"PROMO": "high", "SMALL": "medium"}, "ring")
    return table(spark, d, "part").select("p_partkey", rank.alias("significance"), names.confidence(F.col("p_size") % 3, precision, F.col("p_name"), "old").alias("confidence"))


@add("SELECT c_custkey, CASE WHEN round(c_acctbal, 2) < 0 THEN '−' ELSE '+' END || printf('%.2f', abs(c_acctbal)) AS signed, CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 100 BETWEEN 10 AND 20 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM customer")
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", names.signed(F.col("c_acctbal")).alias("signed"), names.ordinal(F.col("c_custkey")).alias("ordinal"))


@add("SELECT p_partkey, 'A ' || p_name || ' of ' || p_type || ' in code' AS cleaned FROM part")
def markdown_cleaned(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("A a **"), "p_name", F.lit("**  of *"), "p_type", F.lit("*\n in IN `code`"))
    return table(spark, d, "part").select("p_partkey", names.dedupe_words(names.clean_markdown(said)).alias("cleaned"))


@add("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || CASE WHEN contains(p_name, 'ring') AND contains(p_name, 'blue') THEN ['azure', 'hoop'] ELSE [] END || CASE WHEN list_contains(string_split(p_name, ' '), 'old') THEN ['aged'] ELSE [] END)), ' ') AS tokens FROM part")
def synonym_expansion(spark: SparkSession, d: str) -> DataFrame:
    tokens = names.expanded(F.split("p_name", " "), {"blue ring": ["azure hoop"], "old": ["aged"]})
    return table(spark, d, "part").select("p_partkey", F.array_join(tokens, " ").alias("tokens"))


@add("SELECT c_custkey, 'name: ' || c_name || ' | segment: ' || c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' | balance: owing' ELSE '' END || ' | nation: ' || n_name AS profile FROM customer JOIN nation ON n_nationkey = c_nationkey")
def profile_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    text = names.profile(("name", F.col("c_name")), ("segment", F.col("c_mktsegment")), ("balance", F.when(F.col("c_acctbal") < 0, "owing")), ("nation", F.col("n_name")))
    return rows.select("c_custkey", text.alias("profile"))


@add("SELECT doc_id FROM documents WHERE (contains(lower(text), 'token') OR contains(lower(text), 'license')) AND regexp_matches(text, '(?i)\\b(?:the|that) [a-z]+tion\\b')")
def relevant_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(filters.relevant(F.col("text"), ["token", "License"], [r"\b(?:the|that) [a-z]+tion\b"])).select("doc_id")


@add("SELECT p_partkey FROM part WHERE (contains(p_name, 'red') OR contains(p_name, 'old')) AND NOT regexp_matches(p_name, '(?:red|old)\\s+(?:ring|gear)\\b')")
def place_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(filters.of_place(F.col("p_name"), ["Red", "Old"], "ring|gear", "state|govt")).select("p_partkey")


@add("SELECT p_partkey FROM part WHERE CASE WHEN p_size % 2 = 0 THEN p_type = 'PROMO' ELSE contains(p_name, 'blue') END")
def tag_or_keyword_items(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").where(filters.tag_or_keyword(tags, "PROMO", F.col("p_name"), ["Blue"])).select("p_partkey")


@add("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 1.0 ELSE 0.2 END AS weight FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'ring']) AND NOT (list_has_all(string_split(p_name, ' '), ['red', 'ring'])) AND NOT (p_type IN ('SMALL', 'LARGE') AND contains(p_name, 'old'))")
def tagged_items(spark: SparkSession, d: str) -> DataFrame:
    tags = F.split("p_name", " ")
    rows = table(spark, d, "part").where(filters.tagged(tags, ["red", "ring"]) & ~filters.tagged(tags, ["red", "ring"], every=True) & ~filters.noise(F.col("p_type"), F.col("p_name"), ["SMALL", "LARGE"], ["old"]))
    return rows.select("p_partkey", F.when(F.col("p_type") == "PROMO", 1.0).otherwise(0.2).alias("weight"))


@add("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'o') AND p_type = 'PROMO' ORDER BY p_name, p_partkey LIMIT 3 OFFSET 3")
def table_search_page(spark: SparkSession, d: str) -> DataFrame:
    found = filters.searched(table(spark, d, "part"), "O", ["p_name", "p_brand", "p_type"], p_type="PROMO", p_brand=None)
    return filters.page(found, ["p_name", "p_partkey"], 2, 3).select("p_partkey", "p_name")


@add("SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS vacant FROM customer")
def vacancy_flags(spark: SparkSession, d: str) -> DataFrame:
    vacant = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return filters.flagged(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", vacant, "vacant").select("c_custkey", "vacant")


@add("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey LIMIT 150")
def waiting_items_first(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.waiting_first(table(spark, d, "orders"), F.col("o_orderstatus") == "P", F.col("o_orderdate"), F.col("o_orderkey"), 150)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@add("WITH dun AS (SELECT n_nationkey AS state, 'N.' || lpad(CAST(s_suppkey % 50 AS VARCHAR), 2, '0') AS code, min(s_name) AS seat FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2) SELECT c_custkey, seat FROM customer LEFT JOIN dun ON state = c_nationkey AND code = 'N.' || lpad(CAST(c_custkey % 50 AS VARCHAR), 2, '0')")
def state_qualified_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A seat number means something only within its state."""

    def code(column: str):
        return F.concat(F.lit("N."), F.lpad((F.col(column) % 50).cast("string"), 2, "0"))

    known = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey"), code("s_suppkey").alias("code")).agg(F.min("s_name").alias("seat"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", code("c_custkey").alias("code")).join(known, ["c_nationkey", "code"], "left").select("c_custkey", "seat")


@add(f"WITH {seats.SEATS_SQL}, b AS (SELECT code, winner AS bloc, swing_pp * 0.5 + code % 7 AS pp FROM seats JOIN swings USING (state) WHERE bloc = winner AND code % 3 = 0) SELECT code, round(coalesce(b.pp, w.swing_pp, 0.0), 6) AS winner_base, round(coalesce(r.swing_pp, 0.0), 6) AS runnerup_base FROM seats LEFT JOIN b USING (code) LEFT JOIN swings w ON w.state = seats.state AND w.bloc = winner LEFT JOIN swings r ON r.state = seats.state AND r.bloc = runnerup")
def forecast_boundary(spark: SparkSession, d: str) -> DataFrame:
    """A seat's own swing of a bloc stands in for the state's."""
    s, w = seats.seats(spark, d), seats.swings(spark, d)
    own = s.join(w, (s.state == w.state) & (s.winner == w.bloc)).where("code % 3 = 0").select("code", "bloc", (F.col("swing_pp") * 0.5 + F.col("code") % 7).alias("boundary_swing_pp"))
    rows = forecast.base_swings(s, w, own)
    return rows.select("code", F.round("winner_base", 6).alias("winner_base"), F.round("runnerup_base", 6).alias("runnerup_base"))


@add("SELECT c_mktsegment AS bloc, sum(CASE WHEN c_custkey % 2 = 0 THEN 1.5 ELSE -0.5 END) AS shock_pp FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 4000) GROUP BY 1")
def local_shocks(spark: SparkSession, d: str) -> DataFrame:
    """Shocks of a state's seats, added up by bloc."""
    touched = table(spark, d, "supplier").where("s_acctbal < 4000").select(F.col("s_nationkey").alias("c_nationkey"))
    shocks = table(spark, d, "customer").select("c_nationkey", F.col("c_mktsegment").alias("bloc"), F.when(F.col("c_custkey") % 2 == 0, 1.5).otherwise(-0.5).alias("pp"))
    return shocks.join(touched, "c_nationkey", "left_semi").groupBy("bloc").agg(F.sum("pp").alias("shock_pp"))


@add(f"WITH {seats.SEATS_SQL}, s AS (SELECT unnest([{', '.join(repr(s.name) for s in seats.SCENARIOS)}]) AS scenario), t AS (SELECT scenario, CASE WHEN raw + {seats._shift_sql('winner')} - {seats._shift_sql('runnerup')} < 0 THEN runnerup ELSE winner END AS bloc FROM proj, s) SELECT scenario, count_if(bloc IN ('PH', 'BN', 'GPS', 'GRS', 'WARISAN', 'MUDA', 'KDM', 'PBM')) AS government, count_if(bloc IN ('PN', 'IND')) AS opposition, count(*) AS total FROM t GROUP BY scenario")
def scenario_totals(spark: SparkSession, d: str) -> DataFrame:
    """Seats of government and opposition in each scenario."""
    rows = seats.forecast_scenarios(spark, d)
    own, other = F.col("bloc").isin(*forecast.GOVERNMENT_TOTAL), F.col("bloc").isin("PN", "IND")
    return rows.groupBy("scenario").agg(F.sum(F.when(own, F.col("seats")).otherwise(0)).alias("government"), F.sum(F.when(other, F.col("seats")).otherwise(0)).alias("opposition"), F.sum("seats").alias("total"))


@add("WITH l AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1) SELECT c_custkey, latest, coalesce(n, 0) AS n FROM customer LEFT JOIN l ON o_custkey = c_custkey WHERE c_acctbal < 1000")
def battleground_latest(spark: SparkSession, d: str) -> DataFrame:
    """Close seats with their latest contest since a date, if there was one."""
    late = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    late = late.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("n"))
    return table(spark, d, "customer").where("c_acctbal < 1000").select("c_custkey").join(late, "c_custkey", "left").select("c_custkey", "latest", F.coalesce("n", F.lit(0)).alias("n"))


@add("WITH b AS (SELECT n_name AS state, c_mktsegment AS bloc, count(*) AS n, avg(c_acctbal) AS mean, count_if(c_acctbal < 0) AS changed FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT state, arg_max(bloc, (n, bloc)) AS leading, max(n) AS leading_seats, round(sum(changed) / sum(n), 6) AS changed_share, round(sum(mean * n) / sum(n), 4) AS mean_turnout FROM b GROUP BY state")
def dashboard_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """By state: the leading bloc, its seats, the share that changed hands, mean turnout."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    b = c.groupBy(F.col("n_name").alias("state"), F.col("c_mktsegment").alias("bloc")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("changed"))
    return b.groupBy("state").agg(F.max_by("bloc", F.struct("n", "bloc")).alias("leading"), F.max("n").alias("leading_seats"), F.round(F.sum("changed") / F.sum("n"), 6).alias("changed_share"), F.round(F.sum("total") / F.sum("n"), 4).alias("mean_turnout"))


@add("SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(a.s_name, b.s_name) AS name, a.s_acctbal IS NOT NULL AND b.bal IS NOT NULL AND a.s_acctbal <> b.bal AS mismatch FROM (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE s_acctbal END AS bal FROM supplier WHERE s_suppkey % 3 <> 1) b ON a.s_suppkey = b.s_suppkey")
def payload_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two payloads of the same things: the first one's values, filled up from the second, with a mark where they differ."""
    s = table(spark, d, "supplier")
    first = s.where("s_suppkey % 3 <> 0").select("s_suppkey", F.col("s_name").alias("n1"), F.col("s_acctbal").alias("b1"))
    second = s.where("s_suppkey % 3 <> 1").select("s_suppkey", F.col("s_name").alias("n2"), F.when(F.col("s_suppkey") % 5 == 0, 0.0).otherwise(F.col("s_acctbal")).alias("b2"))
    return first.join(second, "s_suppkey", "full_outer").select("s_suppkey", F.coalesce("n1", "n2").alias("name"), F.coalesce(F.col("b1") != F.col("b2"), F.lit(False)).alias("mismatch"))


@add("SELECT DISTINCT 'supplier ' || CAST(l_suppkey * 2 AS VARCHAR) AS person FROM lineitem WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)")
def unknown_persons(spark: SparkSession, d: str) -> DataFrame:
    """Names in updates whose key no known person has."""
    known = table(spark, d, "supplier").select(names.person_key(F.concat(F.lit("Dr. Supplier "), F.col("s_suppkey").cast("string"))).alias("person"))
    said = table(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("k")).distinct().select(names.person_key(F.concat(F.lit("Tan Sri Supplier  "), F.col("k").cast("string"))).alias("person"))
    return said.join(known, "person", "left_anti").select("person")


@add("SELECT 'events' AS name, count(*) AS n, count(*) >= 50 AS ok FROM events UNION ALL SELECT 'orders', count(*), count(*) >= 1000000000 FROM orders UNION ALL SELECT 'span_days', date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE), date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) >= 365 FROM orders")
def floors_and_span(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    span = o.agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("n"))
    found = {"events": table(spark, d, "events").agg(F.count("*").alias("n")), "orders": o.agg(F.count("*").alias("n")), "span_days": span}
    return checks.floors(found, {"events": 50, "orders": 1_000_000_000, "span_days": 365})


@add("SELECT n_name AS state, count(*) AS seats, count(*) = count(DISTINCT c_custkey) AND count(*) > 0 AS ok FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) = (SELECT count(*) FROM customer) FROM customer JOIN nation ON n_nationkey = c_nationkey")
def seat_sums(spark: SparkSession, d: str) -> DataFrame:
    """Seats of each state, and whether they add up to the whole."""
    c = table(spark, d, "customer")
    joined = c.join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    by_state = joined.groupBy(F.col("n_name").alias("state")).agg(F.count("*").alias("seats"), F.count_distinct("c_custkey").alias("u")).select("state", "seats", ((F.col("seats") == F.col("u")) & (F.col("seats") > 0)).alias("ok"))
    total = joined.agg(F.count("*").alias("seats")).join(c.agg(F.count("*").alias("expected")))
    return by_state.unionByName(total.select(F.lit("all").alias("state"), "seats", (F.col("seats") == F.col("expected")).alias("ok")))


@add("SELECT o_orderkey AS lost FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 20000) ")
def shrink_guard(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a new edition would lose."""
    o = table(spark, d, "orders")
    return checks.lost(o, o.where("o_totalprice > 20000"), "o_orderkey").select(F.col("o_orderkey").alias("lost"))


@add("SELECT count_if(o_orderstatus = 'F') AS subset, count_if(o_orderstatus = 'O') AS disagree, count_if(o_orderstatus = 'P') AS superseded, count(*) AS total, count_if(o_orderstatus IN ('F', 'O', 'P')) = count(*) AS ok FROM orders")
def partition_identity(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return checks.partitioned(table(spark, d, "orders"), {"subset": status == "F", "disagree": status == "O", "superseded": status == "P"})


@add("""SELECT s_suppkey, sha256('{' || chr(10) || '  "cents": ' || CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR) || ',' || chr(10) || '  "name": "' || s_name || '",' || chr(10) || '  "tags": [' || chr(10) || '    "x",' || chr(10) || '    "é"' || chr(10) || '  ]' || chr(10) || '}' || chr(10)) AS digest FROM supplier""")
def canonical_json_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a record's canonical JSON: keys in order, two blanks of indentation, characters as they are."""
    from tidewright.functions import json_text

    cents = F.round(F.col("s_acctbal") * 100).cast("long").alias("cents")
    record = F.to_json(F.struct(F.array(F.lit("x"), F.lit("é")).alias("tags"), F.col("s_name").alias("name"), cents))
    return table(spark, d, "supplier").select("s_suppkey", json_text.canonical_hash(record).alias("digest"))


@add("SELECT event_id, 'k ' || json_extract_string(props, '$.k') || ' u https://a.example/' || CAST(user_id AS VARCHAR) AS said, 'https://a.example/' || CAST(user_id AS VARCHAR) AS urls FROM events")
def payload_text(spark: SparkSession, d: str) -> DataFrame:
    """All keys and leaves of a nested payload as one text, and the links in it."""
    from tidewright.functions import json_text

    nested = F.concat(F.lit('{"a": ['), "props", F.lit(', {"u": "https://a.example/'), F.col("user_id").cast("string"), F.lit('"}]}'))
    rows = table(spark, d, "events").select("event_id", json_text.flattened(nested).alias("f"))
    return rows.select("event_id", F.col("f.said").alias("said"), F.array_join("f.urls", " ").alias("urls"))


@add("SELECT 'event' AS kind, event_type AS name, strftime(ts, '%Y-%m-%d') AS detail FROM events WHERE event_id = 7 UNION ALL SELECT 'entity', CAST(user_id AS VARCHAR), 'actor' FROM events WHERE event_id = 7 UNION ALL SELECT 'metric', 'k', json_extract_string(props, '$.k') FROM events WHERE event_id = 7 UNION ALL SELECT 'citation', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders JOIN events ON o_custkey = user_id WHERE event_id = 7")
def event_command(spark: SparkSession, d: str) -> DataFrame:
    """One event with its entities, metrics and citations."""
    e = table(spark, d, "events").where("event_id = 7")
    parts = [
        e.select(F.lit("event").alias("kind"), F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("detail")),
        e.select(F.lit("entity"), F.col("user_id").cast("string"), F.lit("actor")),
        e.select(F.lit("metric"), F.explode(F.from_json("props", "map<string,string>"))),
        table(spark, d, "orders").join(e, F.col("o_custkey") == F.col("user_id")).select(F.lit("citation"), F.col("o_orderkey").cast("string"), "o_orderstatus"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@add("WITH c AS (SELECT c_mktsegment AS party, CASE WHEN c_custkey % 60 + 20 < 30 THEN 'under_30' WHEN c_custkey % 60 + 20 < 45 THEN '30_44' WHEN c_custkey % 60 + 20 < 60 THEN '45_59' ELSE '60_up' END AS bracket, c_acctbal > 5000 AS won FROM customer) SELECT party, bracket, count(*) AS contested, round(100.0 * count_if(won) / count(*), 4) AS win_rate FROM c GROUP BY 1, 2 HAVING count(*) >= 5")
def win_rate_by_age(spark: SparkSession, d: str) -> DataFrame:
    """Groups of fewer than five candidates aren't shown, as in the report."""
    age = F.col("c_custkey") % 60 + 20
    bracket = F.when(age < 30, "under_30").when(age < 45, "30_44").when(age < 60, "45_59").otherwise("60_up")
    rows = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("party"), bracket.alias("bracket"))
    return rows.agg(F.count("*").alias("contested"), F.round(F.count_if(F.col("c_acctbal") > 5000) * 100.0 / F.count("*"), 4).alias("win_rate")).where("contested >= 5")


@add("WITH v AS (SELECT c_nationkey AS seat, year(o_orderdate) AS y, c_mktsegment AS bloc, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3), w AS (SELECT seat, y, arg_max(bloc, (n, bloc)) AS winner FROM v GROUP BY 1, 2) SELECT seat, y, winner, coalesce(winner <> lag(winner) OVER (PARTITION BY seat ORDER BY y), false) AS changed_hands FROM w")
def changed_hands(spark: SparkSession, d: str) -> DataFrame:
    """Each election's winner against the one before on the same seat."""
    from pyspark.sql import Window

    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    votes = rows.groupBy(F.col("c_nationkey").alias("seat"), F.year("o_orderdate").cast("long").alias("y"), F.col("c_mktsegment").alias("bloc")).agg(F.count("*").alias("n"))
    won = votes.groupBy("seat", "y").agg(F.max_by("bloc", F.struct("n", "bloc")).alias("winner"))
    before = F.lag("winner").over(Window.partitionBy("seat").orderBy("y"))
    return won.select("seat", "y", "winner", F.coalesce(F.col("winner") != before, F.lit(False)).alias("changed_hands"))


@add(f"WITH {seats.SEATS_SQL}, f AS (SELECT code, CASE WHEN code % 5 = 0 THEN NULL ELSE round(-raw, 6) END AS m FROM proj WHERE raw < 0) SELECT code, m AS proj_margin FROM f ORDER BY abs(coalesce(nullif(m, 0), 99)), code LIMIT 3")
def tightest_flips(spark: SparkSession, d: str) -> DataFrame:
    """The three closest flips; an unknown margin, or none, counts as 99."""
    rows = seats.with_projection(spark, d).where("flip").select("code", F.when(F.col("code") % 5 != 0, F.round("proj_margin", 6)).alias("proj_margin"))
    return rows.orderBy(F.abs(F.coalesce(F.nullif("proj_margin", F.lit(0.0)), F.lit(99.0))), "code").limit(3)


@add("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 >= 2")
def resumable_run(spark: SparkSession, d: str) -> DataFrame:
    """A half of the items has a decision on the same input; a changed input counts anew."""
    from tidewright.streaming import incremental

    items = table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderstatus", "o_totalprice"), 256).alias("digest"))
    log = items.where("o_orderkey % 4 < 3").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 2, "old").otherwise(F.col("digest")).alias("digest"), F.lit(2).alias("n"))
    log = log.unionByName(log.select("o_orderkey", F.lit("older").alias("digest"), F.lit(1).alias("n")))
    return incremental.still_to_do(items, log, "o_orderkey", "digest", "n").select("o_orderkey")


@add("SELECT count(*) AS n, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim, min(len(embedding)) = max(len(embedding)) AND count(*) = count(DISTINCT vec_id) AS ok FROM embeddings")
def vector_collection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    least, most = F.min(F.size("embedding")), F.max(F.size("embedding"))
    return e.agg(F.count("*").alias("n"), least.alias("least_dim"), most.alias("most_dim"), ((least == most) & (F.count("*") == F.count_distinct("vec_id"))).alias("ok"))


_RULES = {
    "orders have customers": "(SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))",
    "lines have orders": "(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))",
    "lines have parts": "(SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))",
    "event ids are unique": "(SELECT count(*) - count(DISTINCT event_id) FROM events)",
    "order ids are unique": "(SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)",
    "events are dated": "(SELECT count_if(ts IS NULL) FROM events)",
    "types are known": "(SELECT count_if(event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')) FROM events)",
    "values are not negative": "(SELECT count_if(value < 0) FROM events)",
    "discounts are shares": "(SELECT count_if(l_discount < 0 OR l_discount > 1) FROM lineitem)",
    "names are filled": "(SELECT count_if(coalesce(c_name, '') = '') FROM customer)",
    "payloads are JSON": "(SELECT count_if(NOT json_valid(props)) FROM events)",
    "dates are ordered": "(SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < TIMESTAMP '1900-01-01')",
}


@add(" UNION ALL ".join(f"SELECT '{name}' AS rule, CAST({sql} AS BIGINT) AS violations" for name, sql in _RULES.items()))
def store_checks(spark: SparkSession, d: str) -> DataFrame:
    """The store's integrity rules: references, unique ids, dates, known values."""
    t = {n: table(spark, d, n) for n in ("orders", "customer", "lineitem", "part", "events")}
    e, l = t["events"], t["lineitem"]

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")

    names_ = list(_RULES)
    found = [
        counted(checks.dangling(t["orders"], "o_custkey", t["customer"], "c_custkey"), names_[0]),
        counted(checks.dangling(l, "l_orderkey", t["orders"], "o_orderkey"), names_[1]),
        counted(checks.dangling(l, "l_partkey", t["part"], "p_partkey"), names_[2]),
        checks.duplicates(e, ["event_id"]).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(names_[3]).alias("rule"), "violations"),
        checks.duplicates(t["orders"], ["o_orderkey"]).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(names_[4]).alias("rule"), "violations"),
        checks.rule_counts(e, {names_[5]: F.col("ts").isNotNull(), names_[6]: F.col("event_type").isin("view", "click", "purchase", "signup", "error"), names_[7]: F.coalesce(F.col("value") >= 0, F.lit(True)), names_[10]: F.try_parse_json("props").isNotNull()}),
        checks.rule_counts(l, {names_[8]: F.col("l_discount").between(0, 1)}),
        checks.rule_counts(t["customer"], {names_[9]: F.length("c_name") > 0}),
        counted(l.join(t["orders"], F.col("o_orderkey") == F.col("l_orderkey")).where(F.col("l_shipdate") < F.lit("1900-01-01").cast("timestamp")), names_[11]),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
