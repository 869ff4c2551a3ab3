"""Feature preparation for the churn classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.ordering import GIDX, PID, global_order
from tenure.session import few_rows

# Columns never used as model inputs.
DROP = ("driver_id", "churn", "first_transaction", "last_transaction")


def scaled_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Standard scaling with the *population* std (sklearn): (x − mean)/std;
    a constant column becomes 0.  One aggregation, broadcast as one row."""
    st = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    x = df.crossJoin(F.broadcast(st))
    for c in cols:
        m, s = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        x = x.withColumn(c, F.when(s > 0, (F.col(c) - m) / s).otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0))))
    return x.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def split_positions(df: DataFrame, label: str, id_col: str = "driver_id", seed: int = 42) -> DataFrame:
    """Each row's position within its label class in a seeded hash order,
    and the class size.  Balanced however skewed the classes are (global
    sort + per-class start offsets)."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    o = global_order(df.withColumn("_h", h), [label, "_h", id_col])
    grp = o.groupBy(label).agg(F.min(GIDX).alias("_start"), F.count(F.lit(1)).alias("_class_n"))
    return (o.join(few_rows(grp), label)  # one row per class
             .withColumn("_pos", F.col(GIDX) - F.col("_start"))
             .drop("_start", "_h", GIDX, PID))


def stratified_split(df: DataFrame, label: str = "churn", test_size: float = 0.2, seed: int = 42,
                     id_col: str = "driver_id", folds: int = 5,
                     materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Deterministic stratified train / test split: in each class the first
    ``round(test_size · n)`` rows of the seeded order go to test.  The train
    part carries a stratified ``fold`` column (0..folds-1) for CV.

    ``materialize`` checkpoints the marked rows to the shared checkpoint
    folder first: model fitting reads the split many times (every fold and
    grid point), and a lost executor then recomputes from the checkpoint."""
    p = split_positions(df, label, id_col, seed)
    if materialize:
        from tenure.session import cut_lineage
        p = cut_lineage(p)
    n_test = F.floor(F.lit(test_size) * F.col("_class_n") + 0.5)
    is_test = F.col("_pos") < n_test
    marked = p.withColumn("_test", is_test).withColumn(
        "fold", F.pmod(F.col("_pos") - n_test, F.lit(folds)).cast("int"))
    drop = ["_pos", "_class_n", "_test"]
    return (marked.where(~F.col("_test")).drop(*drop),
            marked.where(F.col("_test")).drop(*drop, "fold"))


def stratified_split_counts(df: DataFrame, label: str = "churn", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows per (split, label) of :func:`stratified_split`."""
    train, test = stratified_split(df, label, test_size, seed)
    return (train.select(F.lit("train").alias("split"), label)
            .unionByName(test.select(F.lit("test").alias("split"), label))
            .groupBy("split", label).agg(F.count(F.lit(1)).alias("n")))


def model_columns(df: DataFrame, label: str = "churn", drop=DROP) -> list[str]:
    """Numeric model inputs: 64-bit int / double columns, ids and target removed."""
    from tenure.sources.schema import numeric_columns
    return numeric_columns(df, exclude=[label, *drop])


def fill_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL features (std of one-transaction drivers) become 0."""
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])
