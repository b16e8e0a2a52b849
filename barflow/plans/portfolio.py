"""Positions: upsert, valuation, alerts and allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.rules import present

# Alert thresholds in percent (the volume one is a factor).
ALERTS = {"cost_pct_above": 15, "cost_pct_below": -8, "change_pct": 5, "volume_surge": 2.0, "trailing_drawdown": 5}


def upsert(positions: DataFrame, changes: DataFrame, key: str = "code") -> DataFrame:
    """Cost and quantity of a change replace the stored ones only when positive; new codes are added."""
    a = positions.select(key, F.col("name").alias("name0"), F.col("cost").alias("cost0"), F.col("qty").alias("qty0"))
    x = a.join(changes.select(key, "name", "cost", "qty"), key, "full")
    keep = lambda new, old: F.when(F.coalesce(F.col(new), F.lit(0)) > 0, F.col(new)).otherwise(F.coalesce(F.col(old), F.col(new), F.lit(0)))
    return x.select(
        key, F.coalesce("name0", "name", F.col(key).cast("string")).alias("name"),
        keep("cost", "cost0").alias("cost"), keep("qty", "qty0").alias("qty"),
    )


def remove(positions: DataFrame, codes: DataFrame, key: str = "code") -> DataFrame:
    return positions.join(codes.select(key), key, "left_anti")


def valued(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """P&L percent and market value in 100-share lots; a position without cost has no P&L."""
    x = positions.join(quotes.select("symbol", "price"), "symbol", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
    gain = F.when(F.col("cost") > 0, (F.col("price") - F.col("cost")) / F.col("cost") * 100).otherwise(0.0)
    return x.withColumns(
        {
            "pnl_pct": F.round(gain, 2),
            "value": F.col("price") * F.col("qty") * 100,
            "pnl": (F.col("price") - F.coalesce("cost", F.lit(0.0))) * F.col("qty") * 100,
        }
    )


def alerts(pnl: str = "pnl_pct") -> Column:
    g = F.col(pnl)
    return present([F.when(g >= ALERTS["cost_pct_above"], "take_profit"), F.when(g <= ALERTS["cost_pct_below"], "stop_loss")])


def declared_alerts(change: str, vol_ratio: str, drawdown: str) -> Column:
    """The thresholds that are declared beside the two active ones."""
    return present(
        [
            F.when(F.abs(change) >= ALERTS["change_pct"], "day_move"),
            F.when(F.col(vol_ratio) > ALERTS["volume_surge"], "volume_surge"),
            F.when(F.col(drawdown) >= ALERTS["trailing_drawdown"], "trailing_drawdown"),
        ]
    )


def totals(valued: DataFrame) -> DataFrame:
    return valued.agg(F.sum("value").alias("total_value"), F.sum("pnl").alias("total_pnl"))


def allocate(ranked: DataFrame, capital: float = 200000, deploy_pct: float = 80, top_k: int = 5) -> DataFrame:
    """Equal budgets in 100-share lots for the first `top_k` rows by momentum."""
    budget = capital * (deploy_pct / 100) / top_k
    top = ranked.orderBy(F.desc("momentum"), "symbol").limit(top_k)
    lots = F.floor(F.lit(budget) / (F.col("price") * 100))
    return top.withColumns({"lots": lots, "cost": lots * 100 * F.col("price")})


def deployment(vix: Column, calm: float = 80, panic: float = 15) -> Column:
    return F.when(vix < 25, F.lit(calm)).otherwise(F.lit(panic))


def allocation_totals(picks: DataFrame, capital: float = 200000) -> DataFrame:
    invested = F.coalesce(F.sum("cost"), F.lit(0.0))
    return picks.agg(invested.alias("invested"), (F.lit(capital) - invested).alias("cash"), (invested / capital * 100).alias("deployed_pct"))


def trailing_drawdown(axis_keys: list[str], price: str, order: str) -> Column:
    w = Window.partitionBy(*axis_keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (F.max(price).over(w) - F.col(price)) / F.max(price).over(w) * 100
