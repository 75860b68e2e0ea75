"""Seat forecasts: swings, modulation, projection, scenarios, Monte Carlo, boundary swings.

Seats are a frame (code, state, winner, runnerup, margin, malay_pct, youth_pct); swings a long frame
(state, bloc, swing_pp). Swings are joined twice, for the winner and for the runner-up, as small
dimension tables; there is no loop over seats.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.numbers import clamp, gauss

GOVERNMENT = ("PH", "BN", "GPS", "GRS")
#: Blocs counted as government in simulated totals.
GOVERNMENT_TOTAL = ("PH", "BN", "GPS", "GRS", "WARISAN", "MUDA", "KDM", "PBM")
EAST = ("Sabah", "Sarawak", "Labuan")


@dataclass(frozen=True)
class Drift:
    """National terms: growth, inflation, approval (fixed default values), and the weights of two factors."""

    growth: float = 6.0
    inflation: float = 1.9
    approval: float = 3.0
    economy_weight: float = 0.18
    approval_weight: float = 0.22

    @property
    def economic_term(self) -> float:
        return 0.7 * self.growth - 0.8 * (self.inflation - 2.0) + 0.15 * self.approval

    @property
    def government_shift(self) -> float:
        return self.economic_term * self.economy_weight / 0.20 * 0.10 + self.approval * 0.1 * self.approval_weight / 0.25


@dataclass(frozen=True)
class Scenario:
    name: str
    shift: dict[str, float] = field(default_factory=dict)
    penalty: float = 0.0


def seat_type(malay: Column, state: Column) -> Column:
    """Class of a seat by composition; comparisons with null fail, as with a missing number."""
    return F.when(state.isin(*EAST), "east_malaysia").when(malay > 80, "pn_core").when(malay > 55, "mixed_malay").when(malay > 30, "true_mixed").otherwise("non_malay")


def ethnic_factor(malay: Column, bloc: Column) -> Column:
    m = malay / 100.0
    peak = (m - 0.60) / 0.30
    return F.when(bloc == "PN", 0.60 + 0.80 * m).when(bloc == "PH", 1.40 - 0.80 * m).when(bloc == "BN", 1.0 + 0.10 * F.greatest(F.lit(0.0), 1.0 - peak * peak)).otherwise(1.0)


def youth_factor(youth: Column) -> Column:
    return 1.0 + 0.30 * F.greatest(F.lit(0.0), youth / 100.0 - 0.20)


def party_factor(malay: Column, peak: Column) -> Column:
    """Bell curve around a party's best composition (off unless a party column is joined)."""
    distance = F.abs(malay / 100.0 - F.coalesce(peak, F.lit(0.50))) / 0.30
    return 1.0 + 0.15 * F.greatest(F.lit(0.0), 1.0 - distance * distance)


def seat_swing(base: Column, bloc: Column, malay: Column, youth: Column, drift: Drift | None = Drift(), shock: Column | None = None) -> Column:
    """A bloc's swing in a seat: base, national terms for government blocs, local shock, then the factors."""
    if drift is None:
        return F.coalesce(base, F.lit(0.0))
    total = F.coalesce(base, F.lit(0.0)) + F.when(bloc.isin(*GOVERNMENT), drift.government_shift).otherwise(0.0)
    if shock is not None:
        total = total + F.coalesce(shock, F.lit(0.0))
    return total * ethnic_factor(malay, bloc) * youth_factor(youth)


def with_swings(seats: DataFrame, swings: DataFrame, drift: Drift | None = Drift()) -> DataFrame:
    """Seats with the swings of their winner and runner-up (0 where a bloc has none)."""
    w = swings.select(F.col("state"), F.col("bloc").alias("winner"), F.col("swing_pp").alias("_w"))
    r = swings.select(F.col("state"), F.col("bloc").alias("runnerup"), F.col("swing_pp").alias("_r"))
    joined = seats.join(w, ["state", "winner"], "left").join(r, ["state", "runnerup"], "left")
    sw = seat_swing(F.col("_w"), F.col("winner"), F.col("malay_pct"), F.col("youth_pct"), drift)
    sr = seat_swing(F.col("_r"), F.col("runnerup"), F.col("malay_pct"), F.col("youth_pct"), drift)
    named = F.col("runnerup").isNotNull() & (F.col("runnerup") != "")
    return joined.withColumns({"swing_winner": sw, "swing_runnerup": F.when(named, sr).otherwise(0.0)}).drop("_w", "_r")


def base_swings(seats: DataFrame, swings: DataFrame, boundary: DataFrame) -> DataFrame:
    """winner_base and runnerup_base: a seat's own swing of the bloc (code, bloc, boundary_swing_pp), else the state's, else 0."""
    out = seats
    for side in ("winner", "runnerup"):
        own = boundary.select("code", F.col("bloc").alias(side), F.col("boundary_swing_pp").alias("_own"))
        state = swings.select("state", F.col("bloc").alias(side), F.col("swing_pp").alias("_state"))
        out = out.join(own, ["code", side], "left").join(state, ["state", side], "left")
        out = out.withColumn(f"{side}_base", F.coalesce("_own", "_state", F.lit(0.0))).drop("_own", "_state")
    return out


def projected(seats: DataFrame, extra: Column | None = None) -> DataFrame:
    """proj_winner, proj_margin, flip from margin and swings; the sign is tested before any rounding."""
    raw = F.col("margin") + F.col("swing_winner") - F.col("swing_runnerup")
    if extra is not None:
        raw = raw + extra
    flips = F.coalesce(raw < 0, F.lit(False)) & F.col("runnerup").isNotNull() & (F.col("runnerup") != "")
    return seats.withColumns({"flip": flips, "proj_margin": F.when(flips, -raw).otherwise(raw), "proj_winner": F.when(flips, F.col("runnerup")).otherwise(F.col("winner"))})


def scenario_shift(bloc: Column, scenario: Scenario, penalised: Column) -> Column:
    out = F.lit(0.0)
    for name, pp in sorted(scenario.shift.items()):
        out = out + F.when(bloc == name, float(pp)).otherwise(0.0)
    return out - F.when((bloc == "PN") & penalised, float(scenario.penalty)).otherwise(0.0)


def scenarios(seats: DataFrame, defined: list[Scenario], penalised: Column) -> DataFrame:
    """Seats per scenario and bloc; ``seats`` has swings. One pass: scenarios are exploded, not looped over the data."""
    tables = [F.struct(F.lit(s.name).alias("scenario"), (scenario_shift(F.col("winner"), s, penalised) - scenario_shift(F.col("runnerup"), s, penalised)).alias("extra")) for s in defined]
    spread = seats.withColumn("_s", F.explode(F.array(*tables)))
    rows = projected(spread.withColumns({"scenario": F.col("_s.scenario")}), F.col("_s.extra"))
    return rows.groupBy("scenario", F.col("proj_winner").alias("bloc")).agg(F.count("*").alias("seats"))


#: Iterations that one row of a seat draws, before partial sums are made.
DRAWS = 250


def monte_carlo(seats: DataFrame, iterations: int, seed: int = 42) -> DataFrame:
    """(iteration, government, flips): noise by a counter-based generator, so any partitioning gives the same draws.

    Seats are dealt in blocks of iterations, and each task adds up its draws by iteration before they are sent.
    """
    sigma = F.when(F.col("margin") < 5, 2.0).otherwise(1.2)
    noise = gauss(F.lit(str(seed)), F.col("iteration").cast("string"), F.col("code").cast("string")) * sigma
    blocks = seats.select("code", "winner", "runnerup", "margin", "swing_winner", "swing_runnerup", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(DRAWS))).alias("first"))
    parts = int(seats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.least(F.col("first") + (DRAWS - 1), F.lit(iterations - 1))
    rows = projected(blocks.repartition(parts, "code", "first").withColumn("iteration", F.explode(F.sequence("first", last))), noise)
    return rows.groupBy("iteration").agg(F.sum(F.col("proj_winner").isin(*GOVERNMENT_TOTAL).cast("long")).alias("government"), F.sum(F.col("flip").cast("long")).alias("flips"))


def boundary_factor(share: Column, state_share: Column, swing: Column, alpha: float = 0.30) -> Column:
    """How much a state's swing counts in a seat, by the bloc's local share against its share in the state."""
    ratio = clamp(share / state_share, 0.2, 5.0) - 1.0
    sign = F.when(swing > 0, 1.0).otherwise(-1.0)
    raw = F.when((state_share > 0) & (share > 0), 1.0 + sign * alpha * ratio).when(share > 0, 1.0 + sign * alpha).otherwise(1.0 - sign * alpha)
    return clamp(raw, 0.60, 1.60)


def boundary_swings(units: DataFrame, swings: DataFrame) -> DataFrame:
    """Swings per parent seat and bloc from its child units (parent, state, winner_bloc, votes, valid).

    A unit's winner gets its votes; the rest is dealt to the state's other winning blocs in proportion.
    """
    state_bloc = units.groupBy("state", F.col("winner_bloc").alias("bloc")).agg(F.sum("votes").alias("bloc_votes"))
    state_total = units.groupBy("state").agg(F.sum("valid").alias("state_valid"), F.sum("votes").alias("state_votes"))
    own = units.select("parent", "state", F.col("winner_bloc").alias("bloc"), F.col("votes").cast("double").alias("got"))
    winner_votes = state_bloc.select("state", F.col("bloc").alias("winner_bloc"), F.col("bloc_votes").alias("winner_state_votes"))
    rest = units.join(winner_votes, ["state", "winner_bloc"]).join(state_total.select("state", "state_votes"), "state")
    rest = rest.withColumn("others", F.col("state_votes") - F.col("winner_state_votes")).where("others > 0 and valid > votes")
    dealt = rest.join(state_bloc, "state").where("bloc != winner_bloc").select("parent", "state", "bloc", ((F.col("valid") - F.col("votes")) * (F.col("bloc_votes") / F.col("others"))).alias("got"))
    est = own.unionByName(dealt).groupBy("parent", "state", "bloc").agg(F.sum("got").alias("est_votes"))
    totals = units.groupBy("parent", "state").agg(F.sum("valid").alias("total")).where("total > 0")
    grid = totals.join(swings.select("state", "bloc", "swing_pp"), "state").join(est, ["parent", "state", "bloc"], "left").join(state_bloc, ["state", "bloc"], "left").join(state_total.select("state", "state_valid"), "state")
    share = F.coalesce(F.col("est_votes"), F.lit(0.0)) / F.col("total")
    state_share = F.coalesce(F.col("bloc_votes"), F.lit(0)) / F.col("state_valid")
    return grid.withColumns({"share": share, "state_share": state_share}).withColumn("factor", boundary_factor(F.col("share"), F.col("state_share"), F.col("swing_pp"))).select("parent", "state", "bloc", "share", "state_share", "factor", (F.col("swing_pp") * F.col("factor")).alias("boundary_swing_pp"))


def split_composite(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A value under 'A+B' counts half for A and half for B."""
    parts = F.split(F.col(key), r"\+")
    spread = rows.select(*[c for c in rows.columns if c not in (key, value)], F.explode(parts).alias(key), (F.col(value) / F.size(parts)).alias(value))
    return spread


def share_within(df: DataFrame, group: str, value: str, out: str = "share") -> DataFrame:
    """A row's share of its group's total."""
    return df.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy(group)))
