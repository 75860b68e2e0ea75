"""Joins, keys, merges, differences, quotas and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import checks, forecast, keys
from tidewright.plans.base import Registry, table

R = Registry()
add = R.add


@add("SELECT d.doc_id, d.lang, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_accepted(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(good, "doc_id", "left_semi")


@add("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unjudged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@add("SELECT DISTINCT l_suppkey AS missing FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000)")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "supplier").where("s_acctbal > 1000")
    return checks.dangling(table(spark, d, "lineitem").select("l_suppkey").distinct(), "l_suppkey", rich, "s_suppkey").select(F.col("l_suppkey").alias("missing"))


@add("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return keys.pick_per_key(table(spark, d, "events"), ["user_id"], F.struct("ts", "event_id"), ["event_id", "event_type"])


@add("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return keys.first_per_key(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn"), F.col("role")])


@add("""WITH r AS (SELECT l_orderkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rk FROM lineitem)
SELECT l_orderkey, max(CASE WHEN rk = 1 THEN l_suppkey END) AS winner, max(CASE WHEN rk = 2 THEN l_suppkey END) AS runnerup, max(CASE WHEN rk = 1 THEN cents END) - max(CASE WHEN rk = 2 THEN cents END) AS majority_cents FROM r WHERE rk <= 2 GROUP BY l_orderkey""")
def winner_runnerup_majority(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    top = keys.quota(rows, "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 2)

    def at(rank: int, column: str):
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    return top.groupBy("l_orderkey").agg(at(1, "l_suppkey").alias("winner"), at(2, "l_suppkey").alias("runnerup"), (at(1, "cents") - at(2, "cents")).alias("majority_cents"))


@add("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def quota_per_source(spark: SparkSession, d: str) -> DataFrame:
    return keys.quota(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 5).select("source", "doc_id", "rank")


@add("""WITH a AS (SELECT o_orderpriority, o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY o_orderpriority, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS turn FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY turn, month) AS rank FROM a) SELECT o_orderpriority, o_orderkey, month, rank FROM b WHERE rank <= 40""")
def month_round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return keys.round_robin(rows, "o_orderpriority", "month", [F.col("o_orderkey")], 40).select("o_orderpriority", "o_orderkey", "month", "rank")


@add("SELECT o_orderkey, month FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE (rn - 1) % 7 = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return keys.every_kth(rows, "month", [F.col("o_orderdate"), F.col("o_orderkey")], 7).select("o_orderkey", "month")


@add("""SELECT o_orderkey, CASE WHEN rn = 1 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '~' || CAST(rn AS VARCHAR) END AS unique_key
FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)""")
def duplicate_suffix(spark: SparkSession, d: str) -> DataFrame:
    return keys.duplicate_suffix(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [F.col("o_orderkey")]).select("o_orderkey", "unique_key")


@add("""WITH g AS (SELECT p_type, p_brand, min(p_partkey) AS f FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY f, p_brand) AS group_rank FROM g)
SELECT p_partkey, p.p_type, p.p_brand, group_rank FROM part p JOIN r ON r.p_type = p.p_type AND r.p_brand = p.p_brand WHERE group_rank <= 3""")
def first_groups_per_family(spark: SparkSession, d: str) -> DataFrame:
    return keys.first_groups(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), "p_type", "p_brand", F.col("p_partkey"), 3).select("p_partkey", "p_type", "p_brand", "group_rank")


@add("SELECT doc_id, lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 40) AS BIGINT) AS chunk FROM documents")
def chunked_batches(spark: SparkSession, d: str) -> DataFrame:
    return keys.chunks(table(spark, d, "documents").select("doc_id", "lang"), "lang", [F.col("doc_id")], 40)


@add("""WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT o_orderkey, 'N' AS o_orderstatus FROM orders WHERE o_orderpriority <= '3')
SELECT o_orderkey, o_orderstatus, 'base' AS origin FROM b UNION ALL SELECT o_orderkey, o_orderstatus, 'new' FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)""")
def additive_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    new = o.where("o_orderpriority <= '3'").select("o_orderkey", F.lit("N").alias("o_orderstatus"))
    return keys.additive_merge(o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"])


@add("""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    after = o.where("o_orderpriority <> '1-URGENT'").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("o_orderstatus")))
    return keys.snapshot_diff(o.where("o_orderpriority <> '5-LOW'"), after, ["o_orderkey"], ["o_orderstatus"])


@add("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def subset_check(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return keys.missing_from(table(spark, d, "orders").select("o_custkey").distinct(), allowed, ["o_custkey"])


@add("""SELECT k, CASE WHEN sum(s) > 0 THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT o_custkey AS k, 1 AS s FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT DISTINCT o_custkey, -1 FROM orders WHERE o_orderstatus = 'F') GROUP BY k HAVING sum(s) <> 0""")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus").distinct()
    both = keys.multiset_difference(o.where("o_orderstatus = 'P'").select("k"), o.where("o_orderstatus = 'F'").select("k"), ["k"])
    return both.select("k", F.when(F.col("surplus") > 0, "left").otherwise("right").alias("side"))


@add("SELECT l_quantity AS q, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END) AS surplus FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END) <> 0")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), "l_returnflag")
    return keys.multiset_difference(rows.where("l_returnflag = 'A'").select("q"), rows.where("l_returnflag = 'R'").select("q"), ["q"])


@add("SELECT n_name AS nation, round(sum(c_acctbal * (c_custkey % 7 + 1)) / sum(c_custkey % 7 + 1), 6) AS weighted FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def weighted_shares(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("c_custkey") % 7 + 1
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal") * w).alias("x"), F.sum(w).alias("w"))
    return rows.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("nation"), F.round(F.col("x") / F.col("w"), 6).alias("weighted"))


@add("""SELECT c_mktsegment AS segment, count_if(m < 1) AS under_1, count_if(m < 2.5) AS under_2_5, count_if(m < 5) AS under_5, count_if(m >= 2 AND m < 5) AS marginal, count_if(m >= 5 AND m < 10) AS fairly_safe, count_if(m >= 10) AS safe, CAST(floor(count(*) * 2 / 3) AS BIGINT) + 1 AS two_thirds
FROM (SELECT c_mktsegment, (c_acctbal + 1000) / 110 AS m FROM customer) GROUP BY 1""")
def margin_bands(spark: SparkSession, d: str) -> DataFrame:
    m = (F.col("c_acctbal") + 1000) / 110
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), m.alias("m"))
    bands = {"under_1": F.col("m") < 1, "under_2_5": F.col("m") < 2.5, "under_5": F.col("m") < 5, "marginal": (F.col("m") >= 2) & (F.col("m") < 5), "fairly_safe": (F.col("m") >= 5) & (F.col("m") < 10), "safe": F.col("m") >= 10}
    return rows.groupBy("segment").agg(*[F.count_if(c).alias(n) for n, c in bands.items()], (F.floor(F.count("*") * 2 / 3) + 1).alias("two_thirds"))


@add("""SELECT n_name AS nation, count_if(c_mktsegment = 'AUTOMOBILE') AS automobile, count_if(c_mktsegment = 'BUILDING') AS building, count_if(c_mktsegment = 'FURNITURE') AS furniture, count_if(c_mktsegment = 'HOUSEHOLD') AS household, count_if(c_mktsegment = 'MACHINERY') AS machinery
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def pivot_crosstab(spark: SparkSession, d: str) -> DataFrame:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    wide = rows.groupBy(F.col("n_name").alias("nation")).pivot("c_mktsegment", names).count()
    return wide.select("nation", *[F.coalesce(F.col(n), F.lit(0)).alias(n.lower()) for n in names])


@add("""SELECT o_orderpriority AS grp, count(*) AS contested, count_if(o_orderstatus = 'F') AS won, round(100.0 * count_if(o_orderstatus = 'F') / count(*), 6) AS win_rate, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest FROM orders GROUP BY 1""")
def win_rate(spark: SparkSession, d: str) -> DataFrame:
    won = F.count_if(F.col("o_orderstatus") == "F")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp"))
    return rows.agg(F.count("*").alias("contested"), won.alias("won"), F.round(won * 100.0 / F.count("*"), 6).alias("win_rate"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"), F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), (-F.col("o_orderkey")).alias("k"))).alias("dearest"))


@add("SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE rn = 1")
def mode_label(spark: SparkSession, d: str) -> DataFrame:
    return keys.mode_label(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@add("SELECT o_orderkey, o_custkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return forecast.share_within(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice").select("o_orderkey", "o_custkey", F.round("share", 9).alias("share"))


@add("""SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(CAST(c_nationkey AS VARCHAR), 'all') AS nation, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")
def battleground_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    sets = c.groupingSets([[c.c_mktsegment], [c.c_nationkey], []], c.c_mktsegment, c.c_nationkey).agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("all")).alias("nation"), "n")


@add("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def month_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"))


@add("""WITH a AS (SELECT o_orderpriority AS k, count(*) AS before FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS after FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta FROM a FULL JOIN b ON a.k = b.k""")
def map_delta(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after"))
    return rows.withColumn("delta", F.col("after") - F.col("before"))


@add("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal), c_custkey LIMIT 8")
def closest_margins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").orderBy(F.abs("c_acctbal"), "c_custkey").limit(8).select("c_custkey", "c_acctbal")


@add("""SELECT c.c_custkey, o.last_date FROM customer c LEFT JOIN (SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.o_custkey = c.c_custkey
ORDER BY (o.last_date IS NULL), o.last_date DESC, c.c_custkey LIMIT 300""")
def null_date_last(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_date"))
    rows = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.orderBy(F.col("last_date").isNull(), F.desc("last_date"), "c_custkey").limit(300).select("c_custkey", "last_date")


@add("SELECT p_type, median(p_retailprice) AS median_price, round(avg(p_size), 6) AS mean_size FROM part GROUP BY p_type")
def median_profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.median("p_retailprice").alias("median_price"), F.round(F.avg("p_size"), 6).alias("mean_size"))


@add("""SELECT r_name AS coalition, count(DISTINCT c_nationkey) AS members, count(*) AS seats, sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END)::BIGINT AS strong FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def coalition_rollup(spark: SparkSession, d: str) -> DataFrame:
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("s"))
    return rows.join(dims, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("r_name").alias("coalition")).agg(F.count("*").alias("members"), F.sum("n").alias("seats"), F.sum("s").alias("strong"))


@add("SELECT lang, sha256(string_agg(h, chr(10) ORDER BY h)) AS set_hash, count(*) AS n FROM (SELECT DISTINCT lang, sha256(source || '|' || CAST(n_chars AS VARCHAR)) AS h FROM documents) GROUP BY lang")
def set_hash(spark: SparkSession, d: str) -> DataFrame:
    return keys.set_hash(table(spark, d, "documents"), "lang", F.sha2(F.concat_ws("|", "source", F.col("n_chars").cast("string")), 256))


@add("""SELECT column_name, filled, total, round(100.0 * filled / total, 1) AS pct FROM (
SELECT 'quality' AS column_name, count(quality) AS filled, count(*) AS total FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
UNION ALL SELECT 'lang', count(lang), count(*) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def coverage_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return checks.coverage(rows, ["quality", "lang"])


@add("""WITH e AS (SELECT strftime(o_orderdate, '%Y-%m') AS edition_id, CAST(max(o_orderkey) AS BIGINT) AS created_at FROM orders GROUP BY 1), c AS (SELECT edition_id, created_at, lag(edition_id) OVER (ORDER BY edition_id) AS prior FROM e)
SELECT c.edition_id, CASE WHEN c.prior IS NULL THEN 'root' WHEN p.created_at IS NULL THEN 'missing_prior' WHEN p.created_at >= c.created_at THEN 'not_older' ELSE 'ok' END AS state FROM c LEFT JOIN c p ON p.edition_id = c.prior""")
def chain_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("edition_id")).agg(F.max("o_orderkey").alias("created_at"))
    # editions are months: few, whatever the number of orders
    return checks.verify_chain(e.withColumn("prior", F.lag("edition_id").over(Window.orderBy("edition_id"))))


@add("""WITH m AS (SELECT o_orderpriority AS name, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE count(*) END AS n FROM orders GROUP BY 1, 2)
SELECT name, month, last_value(n IGNORE NULLS) OVER (PARTITION BY name ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM m""")
def recorded_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return checks.carried_forward(m.withColumn("n", F.when(F.col("n") % 3 != 0, F.col("n"))), "month", "n").select("name", "month", "n")


@add("""SELECT 'quantity in 1..50' AS rule, count_if(NOT coalesce(l_quantity BETWEEN 1 AND 50, FALSE)) AS violations FROM lineitem UNION ALL SELECT 'discount at most 9 percent', count_if(NOT coalesce(l_discount <= 0.09, FALSE)) FROM lineitem
UNION ALL SELECT 'flag known', count_if(NOT coalesce(l_returnflag IN ('A', 'N'), FALSE)) FROM lineitem""")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    return checks.rule_counts(table(spark, d, "lineitem"), {"quantity in 1..50": F.col("l_quantity").between(1, 50), "discount at most 9 percent": F.col("l_discount") <= 0.09, "flag known": F.col("l_returnflag").isin("A", "N")})


@add("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@add("""WITH o AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS ordinal, o_orderpriority AS family, o_totalprice AS v FROM orders)
SELECT 'ord:' || lower(substr(family, 3)) || ':' || CAST(o_orderkey AS VARCHAR) AS claim_id, family, CAST(round(v * 100) AS BIGINT) AS cents, ordinal FROM o""")
def claim_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Claims with an identity and their place within their family."""
    rows = table(spark, d, "orders")
    ident = F.concat_ws(":", F.lit("ord"), F.lower(F.expr("substring(o_orderpriority, 3)")), F.col("o_orderkey").cast("string"))
    return rows.select(ident.alias("claim_id"), F.col("o_orderpriority").alias("family"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")).alias("ordinal"))
