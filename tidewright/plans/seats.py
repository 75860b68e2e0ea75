"""Seat forecasts on the driver's tables.

Seats are customers: the nation is the state, the market segment the winning bloc, the next segment the
runner-up, and the balance gives the margin. Swings are the change of a segment's share of a nation's
order count between two halves of the order dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import forecast
from tidewright.plans.base import Registry, table

R = Registry()
add = R.add

#: Which bloc stands for which segment, and its usual opponent.
BLOC = {"AUTOMOBILE": "PH", "BUILDING": "PN", "FURNITURE": "BN", "HOUSEHOLD": "GPS", "MACHINERY": "WARISAN"}
RIVAL = {"AUTOMOBILE": "PN", "BUILDING": "BN", "FURNITURE": "PH", "HOUSEHOLD": "PN", "MACHINERY": "GRS"}


def _case(column: str, values: dict[str, str]):
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


def seats(spark: SparkSession, d: str) -> DataFrame:
    """code, state, winner, runnerup, margin, malay_pct, youth_pct."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select(F.col("c_custkey").alias("code"), F.col("n_name").alias("state"), _case("c_mktsegment", BLOC).alias("winner"), _case("c_mktsegment", RIVAL).alias("runnerup"), ((F.col("c_acctbal") + 1000) / 110).alias("margin"), (F.col("c_custkey") * 37 % 101).cast("double").alias("malay_pct"), (F.col("c_custkey") * 13 % 51).cast("double").alias("youth_pct"))


def swings(spark: SparkSession, d: str) -> DataFrame:
    """(state, bloc, swing_pp): the bloc's share of the state's orders, later minus earlier."""
    s = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("state"), _case("c_mktsegment", BLOC).alias("bloc"))
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderdate") >= F.lit("1998-04-01").cast("timestamp")).alias("late"))
    n = o.join(s, "o_custkey").groupBy("state", "bloc").agg(F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("early"))
    n = forecast.share_within(forecast.share_within(n, "state", "late", "l"), "state", "early", "e")
    return n.select("state", "bloc", ((F.col("l") - F.col("e")) * 100).alias("swing_pp"))


_BLOC = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BLOC.items()) + " END"
_RIVAL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RIVAL.items()) + " END"
_D = forecast.Drift()


def _swing(bloc: str, base: str) -> str:
    shift = f"coalesce({base}, 0.0) + CASE WHEN {bloc} IN ('PH', 'BN', 'GPS', 'GRS') THEN {_D.government_shift!r} ELSE 0.0 END"
    m = "(malay_pct / 100.0)"
    ethnic = f"CASE {bloc} WHEN 'PN' THEN 0.60 + 0.80 * {m} WHEN 'PH' THEN 1.40 - 0.80 * {m} WHEN 'BN' THEN 1.0 + 0.10 * greatest(0.0, 1.0 - (({m} - 0.60) / 0.30) * (({m} - 0.60) / 0.30)) ELSE 1.0 END"
    return f"(({shift}) * ({ethnic}) * (1.0 + 0.30 * greatest(0.0, youth_pct / 100.0 - 0.20)))"


SEATS_SQL = f"""seats AS (SELECT c_custkey AS code, n_name AS state, {_BLOC.format('c_mktsegment')} AS winner, {_RIVAL.format('c_mktsegment')} AS runnerup, (c_acctbal + 1000) / 110 AS margin, CAST(c_custkey * 37 % 101 AS DOUBLE) AS malay_pct, CAST(c_custkey * 13 % 51 AS DOUBLE) AS youth_pct FROM customer JOIN nation ON n_nationkey = c_nationkey),
counts AS (SELECT n_name AS state, {_BLOC.format('c_mktsegment')} AS bloc, count_if(o_orderdate >= TIMESTAMP '1998-04-01') AS late, count_if(o_orderdate < TIMESTAMP '1998-04-01') AS early FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
swings AS (SELECT state, bloc, (late / sum(late) OVER (PARTITION BY state) - early / sum(early) OVER (PARTITION BY state)) * 100 AS swing_pp FROM counts),
ready AS (SELECT s.*, {_swing('winner', 'w.swing_pp')} AS sw, {_swing('runnerup', 'r.swing_pp')} AS sr FROM seats s LEFT JOIN swings w ON w.state = s.state AND w.bloc = s.winner LEFT JOIN swings r ON r.state = s.state AND r.bloc = s.runnerup),
proj AS (SELECT *, margin + sw - sr AS raw FROM ready)"""


def with_projection(spark: SparkSession, d: str, drift: forecast.Drift | None = forecast.Drift()) -> DataFrame:
    return forecast.projected(forecast.with_swings(seats(spark, d), swings(spark, d), drift))


@add(f"WITH {SEATS_SQL} SELECT CASE WHEN raw < 0 THEN runnerup ELSE winner END AS bloc, count(*) AS seats, count_if(raw < 0) AS gained FROM proj GROUP BY 1")
def forecast_projection(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: projected seats of each bloc, and how many of them change hands."""
    return with_projection(spark, d).groupBy(F.col("proj_winner").alias("bloc")).agg(F.count("*").alias("seats"), F.count_if("flip").alias("gained"))


@add(f"WITH {SEATS_SQL} SELECT code, state, winner, runnerup AS proj_winner, round(-raw, 6) AS proj_margin FROM proj WHERE raw < 0")
def forecast_flips(spark: SparkSession, d: str) -> DataFrame:
    return with_projection(spark, d).where("flip").select("code", "state", "winner", "proj_winner", F.round("proj_margin", 6).alias("proj_margin"))


@add(f"WITH {SEATS_SQL} SELECT winner AS bloc, count(*) AS seats, count_if(margin < 0) AS flips FROM seats GROUP BY 1")
def forecast_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Without swings the projection gives back the base result."""
    rows = seats(spark, d).withColumns({"swing_winner": F.lit(0.0), "swing_runnerup": F.lit(0.0)})
    return forecast.projected(rows).groupBy(F.col("winner").alias("bloc")).agg(F.count("*").alias("seats"), F.count_if("flip").alias("flips"))


SCENARIOS = [forecast.Scenario("base"), forecast.Scenario("pn_surge", {"PN": 5.0}), forecast.Scenario("government_surge", {"PH": 3.0, "BN": 3.0, "GPS": 2.0, "GRS": 2.0}), forecast.Scenario("split", {}, 6.0), forecast.Scenario("fragmentation", {"PH": -3.0}, 6.0)]


def _shift_sql(bloc: str) -> str:
    parts = [f"CASE WHEN s.scenario = '{s.name}' AND {bloc} = '{b}' THEN {pp} ELSE 0.0 END" for s in SCENARIOS for b, pp in s.shift.items()]
    parts += [f"-CASE WHEN s.scenario = '{s.name}' AND {bloc} = 'PN' AND code % 2 = 0 THEN {s.penalty} ELSE 0.0 END" for s in SCENARIOS if s.penalty]
    return "(" + " + ".join(parts) + ")"


@add(f"WITH {SEATS_SQL}, s AS (SELECT unnest([{', '.join(repr(s.name) for s in SCENARIOS)}]) AS scenario) SELECT scenario, CASE WHEN raw + {_shift_sql('winner')} - {_shift_sql('runnerup')} < 0 THEN runnerup ELSE winner END AS bloc, count(*) AS seats FROM proj, s GROUP BY 1, 2")
def forecast_scenarios(spark: SparkSession, d: str) -> DataFrame:
    rows = forecast.with_swings(seats(spark, d), swings(spark, d))
    return forecast.scenarios(rows, SCENARIOS, F.col("code") % 2 == 0)


_U = "((('0x' || substr(md5('42|' || CAST(i AS VARCHAR) || '|' || CAST(code AS VARCHAR)), {0}, 8))::BIGINT + 0.5) / 4294967296.0)"
_NOISE = f"sqrt(-2.0 * ln({_U.format(1)})) * cos({_U.format(9)} * 6.283185307179586) * CASE WHEN margin < 5 THEN 2.0 ELSE 1.2 END"


@add(f"""WITH {SEATS_SQL}, m AS (SELECT i, raw + {_NOISE} < 0 AS flip, winner, runnerup FROM proj, (SELECT unnest(range(5000)) AS i)), t AS (SELECT i, count_if(CASE WHEN flip THEN runnerup ELSE winner END IN ('PH', 'BN', 'GPS', 'GRS', 'WARISAN', 'MUDA', 'KDM', 'PBM')) AS g, count_if(flip) AS f FROM m GROUP BY i)
SELECT round(quantile_cont(g, 0.1), 6) AS p10, round(quantile_cont(g, 0.5), 6) AS p50, round(quantile_cont(g, 0.9), 6) AS p90, round(avg(f), 6) AS mean_flips, round(avg(CASE WHEN g >= 600 THEN 1.0 ELSE 0.0 END), 6) AS majority_chance FROM t""")
def monte_carlo_quantiles(spark: SparkSession, d: str) -> DataFrame:
    runs = forecast.monte_carlo(forecast.with_swings(seats(spark, d), swings(spark, d)), 5000)
    q = [F.round(F.percentile("government", p), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)]
    return runs.agg(*q, F.round(F.avg("flips"), 6).alias("mean_flips"), F.round(F.avg(F.when(F.col("government") >= 600, 1.0).otherwise(0.0)), 6).alias("majority_chance"))


@add(f"WITH {SEATS_SQL} SELECT CASE WHEN malay_pct > 80 THEN 'pn_core' WHEN malay_pct > 55 THEN 'mixed_malay' WHEN malay_pct > 30 THEN 'true_mixed' ELSE 'non_malay' END AS seat_type, count(*) AS n FROM seats GROUP BY 1")
def seat_type(spark: SparkSession, d: str) -> DataFrame:
    return seats(spark, d).groupBy(forecast.seat_type(F.col("malay_pct"), F.col("state")).alias("seat_type")).agg(F.count("*").alias("n"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select((F.col("c_custkey") % 40).alias("parent"), F.col("n_name").alias("state"), _case("c_mktsegment", BLOC).alias("winner_bloc"), (F.col("c_custkey") % 900 + 100).alias("votes"), (F.col("c_custkey") % 900 + 100 + F.col("c_custkey") % 500).alias("valid"))


@add(f"""WITH {SEATS_SQL.split('ready AS')[0].rstrip().rstrip(',')}, u AS (SELECT c_custkey % 40 AS parent, n_name AS state, {_BLOC.format('c_mktsegment')} AS wb, c_custkey % 900 + 100 AS votes, c_custkey % 900 + 100 + c_custkey % 500 AS valid FROM customer JOIN nation ON n_nationkey = c_nationkey),
sb AS (SELECT state, wb AS bloc, sum(votes) AS bv FROM u GROUP BY 1, 2), st AS (SELECT state, sum(valid) AS sv, sum(votes) AS vv FROM u GROUP BY 1),
got AS (SELECT parent, state, wb AS bloc, CAST(votes AS DOUBLE) AS g FROM u UNION ALL SELECT u.parent, u.state, o.bloc, (u.valid - u.votes) * (o.bv / (st.vv - w.bv)) FROM u JOIN sb w ON w.state = u.state AND w.bloc = u.wb JOIN st ON st.state = u.state JOIN sb o ON o.state = u.state AND o.bloc <> u.wb WHERE st.vv > w.bv AND u.valid > u.votes),
est AS (SELECT parent, state, bloc, sum(g) AS e FROM got GROUP BY 1, 2, 3), tot AS (SELECT parent, state, sum(valid) AS total FROM u GROUP BY 1, 2),
x AS (SELECT t.parent, t.state, s.bloc, s.swing_pp, coalesce(e.e, 0.0) / t.total AS share, coalesce(sb.bv, 0) / st.sv AS ss FROM tot t JOIN swings s ON s.state = t.state LEFT JOIN est e ON e.parent = t.parent AND e.state = t.state AND e.bloc = s.bloc LEFT JOIN sb ON sb.state = s.state AND sb.bloc = s.bloc JOIN st ON st.state = t.state),
y AS (SELECT *, CASE WHEN swing_pp > 0 THEN 1.0 ELSE -1.0 END AS sg FROM x)
SELECT parent, state, bloc, round(share, 6) AS share, round(least(greatest(CASE WHEN ss > 0 AND share > 0 THEN 1.0 + sg * 0.30 * (least(greatest(share / ss, 0.2), 5.0) - 1.0) WHEN share > 0 THEN 1.0 + sg * 0.30 ELSE 1.0 - sg * 0.30 END, 0.60), 1.60), 6) AS factor FROM y""")
def boundary_swing(spark: SparkSession, d: str) -> DataFrame:
    rows = forecast.boundary_swings(_units(spark, d), swings(spark, d))
    return rows.select("parent", "state", "bloc", F.round("share", 6).alias("share"), F.round("factor", 6).alias("factor"))


@add("""WITH r AS (SELECT o_orderpriority AS k, l_suppkey AS bloc, sum(CAST(l_quantity AS BIGINT)) AS votes FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY votes DESC, bloc) AS rk FROM r)
SELECT k, max(CASE WHEN rk = 1 THEN bloc END) AS winner, max(CASE WHEN rk = 2 THEN bloc END) AS runnerup, round(100.0 * (max(CASE WHEN rk = 1 THEN votes END) - max(CASE WHEN rk = 2 THEN votes END)) / sum(votes), 6) AS margin_pct FROM q WHERE rk <= 2 GROUP BY k""")
def state_projection(spark: SparkSession, d: str) -> DataFrame:
    """Margin of the first two over their own sum, as a state's two-way contest."""
    from tidewright.operators import keys

    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("bloc"), F.col("l_quantity").cast("long").alias("q"))
    votes = lines.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderpriority").alias("k"), "bloc").agg(F.sum("q").alias("votes"))
    top = keys.quota(votes, "k", [F.desc("votes"), F.col("bloc")], 2)

    def at(rank: int, column: str):
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    return top.groupBy("k").agg(at(1, "bloc").alias("winner"), at(2, "bloc").alias("runnerup"), F.round((at(1, "votes") - at(2, "votes")) * 100.0 / F.sum("votes"), 6).alias("margin_pct"))


@add("""WITH p AS (SELECT CASE WHEN p_size % 3 = 0 THEN p_type || '+' || p_brand ELSE p_type END AS k, CAST(p_size AS DOUBLE) AS v FROM part), s AS (SELECT unnest(string_split(k, '+')) AS k, v / len(string_split(k, '+')) AS v FROM p) SELECT k, round(sum(v), 6) AS v FROM s GROUP BY k""")
def composite_key_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, F.concat_ws("+", "p_type", "p_brand")).otherwise(F.col("p_type")).alias("k"), F.col("p_size").cast("double").alias("v"))
    return forecast.split_composite(p, "k", "v").groupBy("k").agg(F.round(F.sum("v"), 6).alias("v"))


@add(f"WITH {SEATS_SQL} SELECT state, bloc, round(swing_pp, 6) AS swing_pp, rank FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY round(abs(swing_pp), 6) DESC, bloc) AS rank FROM swings) WHERE rank <= 2")
def largest_swings(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators import keys

    ranked = keys.quota(swings(spark, d), "state", [F.desc(F.round(F.abs("swing_pp"), 6)), F.col("bloc")], 2)
    return ranked.select("state", "bloc", F.round("swing_pp", 6).alias("swing_pp"), "rank")


@add(f"WITH {SEATS_SQL} SELECT state, count(*) AS seats, round(avg(margin), 6) AS mean_margin, round(100.0 * count_if(margin >= 10) / count(*), 6) AS safe_pct, round(max(margin) - min(margin), 6) AS spread FROM seats WHERE winner NOT IN ('PH', 'BN', 'GPS', 'GRS') GROUP BY state")
def opposition_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = seats(spark, d).where(~F.col("winner").isin(*forecast.GOVERNMENT)).groupBy("state")
    return rows.agg(F.count("*").alias("seats"), F.round(F.avg("margin"), 6).alias("mean_margin"), F.round(F.count_if(F.col("margin") >= 10) * 100.0 / F.count("*"), 6).alias("safe_pct"), F.round(F.max("margin") - F.min("margin"), 6).alias("spread"))


@add(f"""WITH {SEATS_SQL}, z AS (SELECT code, -margin / 2.5 AS x FROM seats WHERE margin < 10), t AS (SELECT code, x, 1.0 / (1.0 + abs(x) * 0.2316419) AS t FROM z),
u AS (SELECT code, x, exp(-x * x / 2.0) / 2.5066282746310002 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS up FROM t) SELECT code, round(CASE WHEN x >= 0 THEN 1.0 - up ELSE up END, 6) AS flip_chance FROM u""")
def flip_probability(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.functions.numbers import normal_cdf

    return seats(spark, d).where("margin < 10").select("code", F.round(normal_cdf(-F.col("margin") / 2.5), 6).alias("flip_chance"))
