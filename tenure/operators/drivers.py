"""Driver-level tables: summary (CP3), behaviour metrics, feature table
(CP2), RFM scores.  One ``groupBy(driver_id)`` each (partial aggregation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.numeric import histogram, qcut_scores
from tenure.functions.quantiles import column_quantiles
from tenure.functions.timeutil import floor_days, month_start, plus_days
from tenure.operators.common import AMT, DRV, KIND, TS, drivers, mavg, sum0, per_driver_with_ref
from tenure.session import cut_lineage
from tenure.sources.schema import KINDS


def driver_summary(t: DataFrame, days: int = 28) -> DataFrame:
    """Ten columns per driver, with counts per kind and churn = more than
    ``days`` whole days without payment (CP3)."""
    x = per_driver_with_ref(
        t, F.max(TS).alias("ultimo_pagamento"), F.min(TS).alias("primeiro_pagamento"),
        F.count(TS).alias("total_pagamentos"), mavg(AMT).alias("valor_medio"),
        sum0(AMT).alias("valor_total"),
        F.count_if(F.col(KIND) == "RECURRENCY").alias("pagamentos_recorrentes"),
        F.count_if(F.col(KIND) == "FIRST_PAYMENT_EXCHANGE").alias("trocas_carro"),
        F.count_if(F.col(KIND) == "FIRST_PAYMENT").alias("contratos_novos"), ref_name="_final")
    dias = floor_days("ultimo_pagamento", "_final")
    return x.withColumn("dias_sem_pagar", dias).withColumn("churn", dias > days).drop("_final")


def churn_by_new_contracts(t: DataFrame, days: int = 28) -> DataFrame:
    """Churn rate per number of new contracts."""
    return (driver_summary(t, days).groupBy("contratos_novos")
            .agg(F.avg(F.col("churn").cast("double")).alias("churn_rate"),
                 F.count(F.lit(1)).alias("n_drivers")))


def payment_flow(t: DataFrame, days: int = 28) -> DataFrame:
    """Flow totals new contract → recurring payment → churn as (source, target, value)."""
    s = driver_summary(t, days).agg(F.sum("contratos_novos").alias("a"),
                                    F.sum(F.col("churn").cast("long")).alias("b"))
    return s.select(F.explode(F.array(
        F.struct(F.lit("new_contract").alias("source"), F.lit("recurring_payment").alias("target"),
                 F.col("a").cast("long").alias("value")),
        F.struct(F.lit("recurring_payment").alias("source"), F.lit("churn").alias("target"),
                 F.col("b").cast("long").alias("value")))).alias("f")).select("f.*")


def driver_value_vs_inactivity(t: DataFrame, days: int = 28) -> DataFrame:
    """Scatter data: mean value vs days without payment, coloured by churn."""
    return driver_summary(t, days).select(DRV, "valor_medio", "dias_sem_pagar", "churn")


def payments_per_driver(t: DataFrame, kind: str = "RECURRENCY") -> DataFrame:
    """Number of payments of one kind per driver (equality filter pushed to the scan)."""
    return (drivers(t).where(F.col(KIND) == kind).groupBy(DRV)
            .agg(F.count(F.lit(1)).alias("total_pagamentos")))


def behavioral_metrics(t: DataFrame) -> DataFrame:
    """avg_amount, transactions per *active* month, amount_std (NULL→0) and
    whole days since the driver's last transaction."""
    d = drivers(t)
    per_month = (d.where(F.col(TS).isNotNull()).groupBy(DRV, month_start(TS).alias("_m"))
                  .agg(F.count(F.lit(1)).alias("_n"))
                  .groupBy(DRV).agg(F.avg("_n").alias("transactions_per_month")))
    x = per_driver_with_ref(t, mavg(AMT).alias("avg_amount"),
                            F.coalesce(F.stddev_samp(AMT), F.lit(0.0)).alias("amount_std"),
                            F.max(TS).alias("_last"))
    x = x.withColumn("days_since_last", floor_days("_last", "ref_date"))
    return (x.join(per_month, DRV, "left")
             .select(DRV, "avg_amount", "transactions_per_month", "amount_std", "days_since_last"))


BEHAVIOR_METRICS = ["avg_amount", "transactions_per_month", "amount_std", "days_since_last"]


def _long_metrics(t: DataFrame) -> DataFrame:
    b = behavioral_metrics(t)
    return b.unpivot(DRV, [F.col(c).cast("double").alias(c) for c in BEHAVIOR_METRICS], "metric", "value")


def behavioral_box_stats(t: DataFrame) -> DataFrame:
    """Box statistics per behaviour metric: min, q1, median, q3, max and the
    whisker ends (most extreme values within 1.5 IQR of the quartiles).

    The metrics are written once, a row per driver; quartiles are selected from
    its columns, the rest is one aggregation."""
    m = cut_lineage(behavioral_metrics(t).select(*[F.col(c).cast("double").alias(c) for c in BEHAVIOR_METRICS]))
    boxes, aggs = column_quantiles(m, list(BEHAVIOR_METRICS), [0.25, 0.5, 0.75]), []
    for c, (q1, med, q3) in boxes.items():
        if q1 is None:
            continue
        lo, hi, v = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), F.col(c)
        aggs.append(F.struct(F.lit(c).alias("metric"), F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
                             F.min(v).alias("min"), F.max(v).alias("max"), F.min(F.when(v >= lo, v)).alias("lower_whisker"),
                             F.max(F.when(v <= hi, v)).alias("upper_whisker")))
    if not aggs:
        schema = "metric string, " + ", ".join(f"{c} double" for c in ("q1", "median", "q3", "min", "max", "lower_whisker", "upper_whisker"))
        return t.sparkSession.createDataFrame([], schema)
    return m.agg(F.array(*aggs).alias("boxes")).select(F.explode("boxes").alias("b")).select("b.*")


def behavior_histogram(t: DataFrame, bins: int = 20) -> DataFrame:
    """20-bin histogram of each behaviour metric."""
    return histogram(cut_lineage(_long_metrics(t).select("metric", "value")), "value", bins, by="metric")


def value_by_churn_histogram(t: DataFrame, bins: int = 30, days: int = 28) -> DataFrame:
    """Mean value per driver, 30 bins, stacked by churn (CP3).  Range, counts and
    churn values all read one checkpointed two-column driver table."""
    return histogram(cut_lineage(driver_summary(t, days).select("valor_medio", "churn")), "valor_medio", bins, hue="churn")


def driver_features(t: DataFrame, kinds=tuple(KINDS), days: int = 30) -> DataFrame:
    """Driver feature table (model input).

    count / mean / sample std / sum of amounts, first / last date,
    days_active, avg_transaction_per_day = n / (days_active + 1), churn (CP2,
    0/1) and the share of each kind among the driver's rows (a NULL kind
    counts in the denominator).  Kind columns are a fixed list — the schema
    never depends on the data.
    """
    shares = [F.avg(F.when(F.col(KIND) == k, 1.0).otherwise(0.0)).alias(f"payment_type_{k}")
              for k in sorted(kinds)]
    x = per_driver_with_ref(
        t, F.count(AMT).alias("total_transactions"), mavg(AMT).alias("avg_amount"),
        F.stddev_samp(AMT).alias("std_amount"), sum0(AMT).alias("total_amount"),
        F.min(TS).alias("first_transaction"), F.max(TS).alias("last_transaction"), *shares)
    da = floor_days("first_transaction", "last_transaction")
    return (x.withColumn("days_active", da)
             .withColumn("avg_transaction_per_day", F.col("total_transactions") / (da + 1))
             .withColumn("churn", (floor_days("last_transaction", "ref_date") > days).cast("long"))
             .select(DRV, "total_transactions", "avg_amount", "std_amount", "total_amount",
                     "first_transaction", "last_transaction", "days_active", "avg_transaction_per_day",
                     "churn", *[f"payment_type_{k}" for k in sorted(kinds)]))


def rfm_scores(t: DataFrame, q: int = 5, exact: bool = True) -> DataFrame:
    """Recency (whole days from the last date + 1 day), frequency, monetary,
    1..q quantile scores (recency inverted), rfm_score and churn_risk.

    Quantile edges are exact, found by selection on the table of drivers, which is
    written once; with ``exact=False`` they come from a sketch, without that copy's
    further scans.  Tied edges are kept.
    """
    x = per_driver_with_ref(t, F.max(TS).alias("_last"), F.count(AMT).alias("frequency"),
                            sum0(AMT).alias("monetary"))
    x = x.withColumn("recency", floor_days("_last", plus_days("ref_date", 1)))
    x = x.select(DRV, "recency", "frequency", "monetary")
    x = qcut_scores(cut_lineage(x) if exact else x, ["recency", "frequency", "monetary"], q, exact=exact)
    x = x.withColumn("recency_score", (q + 1) - F.col("recency_score"))
    return (x.withColumn("rfm_score", F.col("recency_score") * 100 + F.col("frequency_score") * 10
                         + F.col("monetary_score"))
             .withColumn("churn_risk", ((q + 1) - F.col("recency_score")) / F.lit(float(q))))
