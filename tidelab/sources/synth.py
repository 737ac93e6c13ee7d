"""Synthetic demo tables (A15–A17) as ``spark.range`` + column expressions — no recursion, no
driver-side rows; every task computes its own slice of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelab.functions.text import round_value

# Demo-table category lists and per-category constants, in formula order.
RETAIL_REGIONS = ["North", "South", "West", "East"]
RETAIL_CATEGORIES = ["Beverages", "Snacks", "Dairy", "Cleaning", "Personal Care"]
RETAIL_BASE_PRICE = [15.8, 13.4, 11.6, 9.8, 10.7]
SAAS_PLANS = ["Starter", "Pro", "Business", "Enterprise"]
SAAS_INDUSTRIES = ["Retail", "Education", "Services", "Healthcare", "Manufacturing"]
SAAS_REGIONS = ["LATAM", "NA", "EU", "APAC"]
SAAS_SEATS = [(6, 5), (18, 12), (42, 25), (120, 80)]  # base + n mod m
SAAS_RATIO = [0.58, 0.72, 0.82, 0.91]
SAAS_LOGINS = [(18, 15), (34, 25), (58, 30), (95, 60)]
SAAS_USAGE = [44, 58, 71, 83]
SAAS_TICKETS = [5, 2, 1, 3, 0, 4]  # by n mod 6
SAAS_RESPONSE = [2.4, 1.4, 0.8, 0.5]  # by plan
SAAS_MRR = [(49, 2), (149, 7), (480, 18), (2200, 35)]  # base + (n mod 8) * step
RETAIL_N, SAAS_N = 1200, 1500


def _pick(index: Column, values: list) -> Column:
    """``values[index]`` as a CASE expression (index is 0-based)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def row_sequence(spark: SparkSession, n: int, start: int = 1) -> DataFrame:
    """Rows ``n`` = start … start+n-1."""
    return spark.range(start, start + n).withColumnRenamed("id", "n")


def synth_retail(spark: SparkSession, n: int = RETAIL_N) -> DataFrame:
    s = row_sequence(spark, n)
    c = F.col("n")
    promo = (c % 3 == 0).cast("int")
    cat = (c - 1) % 5
    base = s.select(
        c.alias("sale_id"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (c % 730).cast("int")), "yyyy-MM-dd").alias("sale_date"),
        (((c - 1) % 20) + 1).cast("int").alias("store_id"),
        _pick((c - 1) % 4, RETAIL_REGIONS).alias("region"),
        _pick(cat, RETAIL_CATEGORIES).alias("product_category"),
        ((c - 1) % 7).cast("int").alias("day_of_week"),
        (((c - 1) % 12) + 1).cast("int").alias("month"),
        (c % 13 == 0).cast("int").alias("holiday_flag"),
        promo.alias("promo_flag"),
        round_value(F.lit(0.03) + (c % 10) * 0.02 + promo * 0.05, 3).alias("discount_pct"),
        round_value(F.lit(100) + (c % 25) * 18 + promo * 120, 2).alias("ad_spend"),
        (F.lit(1800) + (c % 40) * 75 + promo * 650).cast("int").alias("web_traffic"),
        round_value(F.lit(0.92) + (c % 9) * 0.01, 3).alias("competitor_price_index"),
        (F.lit(700) + (c % 15) * 35).cast("int").alias("inventory_level"),
        round_value(F.lit(12) + (c % 12) * 0.7, 1).alias("avg_temp_c"),
        round_value(_pick(cat, RETAIL_BASE_PRICE) + (c % 4) * 0.35, 2).alias("unit_price"),
        (F.lit(40) + (c % 6) * 9 + c % 12 + promo * 20 - F.when(c % 4 == 0, 8).otherwise(0)).cast("int").alias("units_sold"),
    )
    gross = F.col("units_sold") * F.col("unit_price") * (F.lit(1) - F.col("discount_pct"))
    return base.select(
        "*",
        round_value(gross, 2).alias("revenue"),
        round_value(gross * 0.42 - F.col("ad_spend") * 0.08, 2).alias("profit"),
    )


def synth_saas(spark: SparkSession, n: int = SAAS_N) -> DataFrame:
    s = row_sequence(spark, n)
    c = F.col("n")
    plan = c % 4
    signup = F.date_add(F.lit("2021-01-01").cast("date"), (c % 1200).cast("int"))
    tickets = _pick(c % 6, SAAS_TICKETS)
    base = s.select(
        F.format_string("CUST-%05d", c).alias("customer_id"),
        F.date_format(signup, "yyyy-MM-dd").alias("signup_date"),
        F.floor(F.datediff(F.lit("2026-04-01").cast("date"), signup) / 30).cast("int").alias("account_age_months"),
        _pick(plan, SAAS_PLANS).alias("plan"),
        _pick(c % 5, SAAS_INDUSTRIES).alias("industry"),
        _pick(plan, SAAS_REGIONS).alias("region"),
        _pick(plan, [0, 1, 2, 3]).alias("_plan_idx"),
        tickets.cast("int").alias("support_tickets"),
        F.when(c % 13 == 0, 7).when(c % 9 == 0, 4).when(c % 5 == 0, 2).otherwise(0).cast("int").alias("billing_delay_days"),
        c.alias("_n"),
    )
    n_ = F.col("_n")
    p = F.col("_plan_idx")
    seats = None
    logins = None
    for i, ((sb, sm), (lb, lm)) in enumerate(zip(SAAS_SEATS, SAAS_LOGINS)):
        sv, lv = F.lit(sb) + n_ % sm, F.lit(lb) + n_ % lm
        seats = F.when(p == i, sv) if seats is None else seats.when(p == i, sv)
        logins = F.when(p == i, lv) if logins is None else logins.when(p == i, lv)
    ratio = round_value(F.greatest(F.lit(0.05), F.least(F.lit(1.0), _pick(p, SAAS_RATIO) - (n_ % 7) * 0.02)), 3)
    usage = round_value(_pick(p, SAAS_USAGE) + (n_ % 9) * 1.6 - F.when(n_ % 11 == 0, 12).otherwise(0), 1)
    mrr = round_value(_pick(p, [b for b, _ in SAAS_MRR]) + (n_ % 8) * _pick(p, [s for _, s in SAAS_MRR]), 2)
    nps = (F.lit(68) - F.col("support_tickets") * 6 - F.when(n_ % 4 == 0, 8).otherwise(0) + F.when(n_ % 4 == 3, 5).otherwise(0)).cast("int")
    out = base.select(
        "customer_id", "signup_date", "account_age_months", "plan", "industry", "region",
        seats.cast("int").alias("seats"), ratio.alias("active_users_ratio"), logins.cast("int").alias("monthly_logins"),
        usage.alias("feature_usage_score"), "support_tickets",
        round_value(F.lit(2.0) + F.col("support_tickets") * 1.9 + _pick(p, SAAS_RESPONSE), 1).alias("avg_response_time_hours"),
        "billing_delay_days", mrr.alias("mrr_usd"), nps.alias("nps"),
    )
    churn = (
        (F.col("support_tickets") >= 4) | (F.col("billing_delay_days") >= 4) | (F.col("active_users_ratio") < 0.6)
        | (F.col("monthly_logins") < 35) | (F.col("feature_usage_score") < 55)
    )
    return out.withColumn("churn", churn.cast("int"))
