"""Lifecycle tiers and storage, retrieval, job and export cost."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.constants import (
    AUTO_APPROVE_NZD,
    BYTES_PER_GB,
    DUAL_APPROVAL_NZD,
    EXPORT_RATE,
    HOT_DAYS,
    JOB_FEE,
    MONITORING_PER_THOUSAND,
    OBJECT_FEE_PER_MILLION,
    RETRIEVAL_RATE,
    STORAGE_RATES,
    TIERED_ARCHIVE_RATE,
    TIERED_FLOOR_BYTES,
    TIERED_FREQUENT_RATE,
)


def tier_on(day: Column, last_modified: Column, hot_days: int = HOT_DAYS) -> Column:
    return F.when(F.datediff(day, last_modified) < hot_days, "STANDARD").otherwise("GLACIER_IR")


def lifecycle_tier(backup: DataFrame, day: Column, hot_days: int = HOT_DAYS) -> DataFrame:
    return backup.select(
        "source_alias", "key", "size", tier_on(day, F.col("last_modified_date"), hot_days).alias("tier")
    )


def gigabytes(size: Column) -> Column:
    return size / F.lit(float(BYTES_PER_GB))


def _rate(tier: Column, rates: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(v) for pair in rates.items() for v in pair])[tier]


def tier_sizes(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy("source_alias", "tier").agg(
        F.count("*").alias("objects"), F.sum("size").alias("bytes")
    )


def storage_cost(tiered: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Monthly cost per source and tier; rates apply after the aggregation."""
    rate = _rate(F.col("tier"), rates or STORAGE_RATES)
    return tier_sizes(tiered).withColumn("monthly_nzd", gigabytes(F.col("bytes")) * rate)


def cost_breakdown(cost: DataFrame) -> DataFrame:
    """Cost by source and tier, by source, and in total."""
    return (
        cost.rollup("source_alias", "tier")
        .agg(
            F.sum("objects").alias("objects"),
            F.sum("bytes").alias("bytes"),
            F.sum("monthly_nzd").alias("monthly_nzd"),
            F.grouping_id().cast("bigint").alias("level"),
        )
    )


def approval_level(
    cost: Column, auto: float = AUTO_APPROVE_NZD, dual: float = DUAL_APPROVAL_NZD
) -> Column:
    return F.when(cost <= auto, "none").when(cost <= dual, "single").otherwise("dual")


def retrieval_cost(
    tiered: DataFrame,
    rate: float = RETRIEVAL_RATE,
    auto: float = AUTO_APPROVE_NZD,
    dual: float = DUAL_APPROVAL_NZD,
) -> DataFrame:
    """One-off cost of restoring a source: only its cold bytes are charged."""
    cold = F.when(F.col("tier") == "GLACIER_IR", F.col("size")).otherwise(0)
    return (
        tiered.groupBy("source_alias")
        .agg(F.sum(cold).alias("cold_bytes"))
        .withColumn("retrieval_nzd", gigabytes(F.col("cold_bytes")) * F.lit(rate))
        .withColumn("approval", approval_level(F.col("retrieval_nzd"), auto, dual))
    )


def batch_fee(manifest_counts: DataFrame) -> DataFrame:
    """Fee of one copy job per source; an empty manifest submits none."""
    fee = F.lit(JOB_FEE) + F.col("objects") / F.lit(1e6) * F.lit(OBJECT_FEE_PER_MILLION)
    return manifest_counts.withColumn("fee_usd", F.when(F.col("objects") > 0, fee).otherwise(0.0))


def tiering_delta(source: DataFrame, warm_share: float = 0.01) -> DataFrame:
    """Standard against access-tiered cost per source (USD per month).

    Cold objects are billed at 128 KB at least; monitoring is charged per object.
    """
    sums = source.groupBy("source_alias").agg(
        F.count("*").alias("objects"),
        F.sum("size").alias("bytes"),
        F.sum(F.greatest(F.col("size"), F.lit(TIERED_FLOOR_BYTES))).alias("billed_bytes"),
    )
    standard = gigabytes(F.col("bytes")) * F.lit(TIERED_FREQUENT_RATE)
    storage = gigabytes(F.col("bytes")) * F.lit(warm_share * TIERED_FREQUENT_RATE) + gigabytes(
        F.col("billed_bytes")
    ) * F.lit((1 - warm_share) * TIERED_ARCHIVE_RATE)
    monitoring = F.col("objects") / F.lit(1000.0) * F.lit(MONITORING_PER_THOUSAND)
    return (
        sums.withColumn("standard_usd", standard)
        .withColumn("tiered_usd", storage + monitoring)
        .withColumn("saving_usd", F.col("standard_usd") - F.col("tiered_usd"))
    )


def export_cost(exports: DataFrame, table_sizes: DataFrame, rate: float = EXPORT_RATE) -> DataFrame:
    """Fees per table and month; NULL where the table's size isn't known.

    Exports are counted before the sizes are joined on.
    """
    counted = (
        exports.where(F.col("status") == "COMPLETED")
        .groupBy("table_name", F.date_format("export_time", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("exports"))
    )
    return counted.join(table_sizes, "table_name", "left").withColumn(
        "fee_nzd", F.col("exports") * gigabytes(F.col("bytes")) * F.lit(rate)
    )
