"""Results in words and counts: figures as text, a sentence for each verdict, calibration and detection over many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalforge.config import Costs, Stats

NA = "n/a"


def number(x: Column, decimals: int = 2, sign: bool = True) -> Column:
    """A figure with its sign; n/a for null or NaN, inf for infinity. It is rounded first, so that nothing reads -0.00."""
    shown = F.format_string(f"%{'+' if sign else ''}.{decimals}f", F.round(x.cast("double"), decimals) + F.lit(0.0))
    return F.when(x.isNull() | F.isnan(x.cast("double")), NA).when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(shown)


def percent(x: Column) -> Column:
    return F.when(x.isNull(), NA).otherwise(F.format_string("%.1f", x.cast("double") * 100))


def span(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), NA).otherwise(F.concat(F.lit("["), number(low), F.lit(","), number(high), F.lit("]")))


def explained(rows: DataFrame, stats: Stats) -> DataFrame:
    """Add told: what a row's verdict rests on. Rows are those of a run, with trades, sessions, verdict and the tests' figures."""
    seen = F.concat(F.format_number("trades", 0), F.lit(" trades on "), F.format_number("sessions", 0), F.lit(" dates"))
    r = lambda c: F.concat(number(F.col(c)), F.lit("R"))
    p = lambda c: number(F.col(c), 3, False)
    first = F.col("discovery_verdict") if "discovery_verdict" in rows.columns else F.col("verdict")
    later = F.col("validation_verdict") if "validation_verdict" in rows.columns else F.lit(None).cast("string")
    lost = F.when((first == "EDGE") & later.isNull(), "; discovery found an edge, and no held-out date was there to confirm it")
    lost = lost.when((first == "EDGE") & (later != "EDGE"), F.concat(F.lit("; discovery found an edge, the held-out dates gave "), later)).otherwise("")
    text = (
        F.when(F.col("verdict") == "EDGE", F.concat(seen, F.lit(" earned "), r("expectancy_r"), F.lit(" each after costs and led their controls by "), r("delta_r"), F.lit(" (adjusted p "), p("delta_p_adjusted"), F.lit(")")))
        .when(F.col("verdict") == "NEGATIVE", F.concat(seen, F.lit(" lost: "), r("expectancy_r"), F.lit(" each after costs (adjusted p "), p("p_adjusted"), F.lit("), "), r("delta_r"), F.lit(" against their controls")))
        .when(F.col("verdict") == "INSUFFICIENT", F.concat(seen, F.lit(f" are too few: {stats.min_trades} trades on {stats.min_sessions} dates, and controls, are needed")))
        .otherwise(F.concat(seen, F.lit(" show no edge: "), r("expectancy_r"), F.lit(" each after costs, "), r("delta_r"), F.lit(" against their controls"), lost))
    )
    return rows.withColumn("told", F.concat("pattern", F.lit(" at "), F.when(F.col("interval") == "all", "all intervals").otherwise(F.col("interval")), F.lit(": "), "verdict", F.lit(": "), text))


def executed_cost(trades: DataFrame) -> DataFrame:
    """(interval, legs_priced, mean_cost_bps): what patterns' and random entries' trades paid for a leg; matched controls aren't counted."""
    own = trades.filter(~F.col("matched")) if "matched" in trades.columns else trades
    return own.groupBy("interval").agg((2 * F.count("cost_bps")).alias("legs_priced"), F.avg("cost_bps").alias("mean_cost_bps"))


def costs_told(costs: Costs, mean_bps: float | None, shares: dict[str, float] | None = None) -> str:
    """How the charged cost came about; what wasn't observed isn't called so. shares: of observed, imputed and fixed quotes."""
    if mean_bps is None:
        return f"{costs.slippage_bps:g} bps for a leg, fixed"
    seen = {k: v for k, v in (shares or {}).items() if v > 0}
    if set(seen) & {"observed", "imputed"}:
        return f"{mean_bps:.2f} bps for a leg from quotes ({', '.join(f'{k} {v:.0%}' for k, v in sorted(seen.items()))})"
    return f"{mean_bps:.2f} bps for a leg, estimated from highs and lows"


def calibration(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rows of patterns that pass each test, by seed and interval, in runs on markets without an edge."""
    own, lead = (F.col("p_adjusted") <= alpha) & (F.col("ci_low") > 0), (F.col("delta_p_adjusted") <= alpha) & (F.col("delta_low") > 0)
    counts = {"beats_control": lead, "positive_expectancy": own, "confirmed_edge": F.col("verdict") == "EDGE"}
    counts |= {"discovery_edge": F.col("discovery_verdict") == "EDGE"} if "discovery_verdict" in rows.columns else {}
    found = rows.filter(F.col("kind") != "control")
    return found.groupBy("seed", "interval").agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in counts.items()])


def detection(rows: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Over markets with a planted edge, one row each: mean lead and its standard error, and how often the edge was found."""
    lead = F.coalesce((F.col("delta_p_adjusted") <= alpha) & (F.col("delta_low") > 0), F.lit(False))
    n = F.count("delta_r")
    rate = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("markets"),
        F.avg("delta_r").alias("delta_r"),
        F.when(n > 1, F.stddev_samp("delta_r") / F.sqrt(n)).alias("delta_se"),
        F.avg("gross_expectancy_r").alias("gross_r"),
        F.avg("expectancy_r").alias("net_r"),
        rate(lead).alias("beats_control"),
        rate(F.col("verdict") == "EDGE").alias("confirmed_edge"),
    )
