"""Registered queries: normalisation, calibration joins, enrichment, validation
(P02, P13-P21, J01-J04, F04-F06, D10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderpulse.operators import normalize as NZ
from orderpulse.operators import validate as V
from orderpulse.plans import standins as SI
from orderpulse.plans.registry import query
from orderpulse.sources.tables import read_table


def _sku_aliases(spark, d):
    p = read_table(spark, d, "part", ["p_partkey", "p_brand"])
    return p.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("value"))


def _sku_names(spark, d):
    p = read_table(spark, d, "part", ["p_brand", "p_type"])
    return p.groupBy(F.col("p_brand").alias("key")).agg(F.max("p_type").alias("value"))


def _client_aliases(spark, d):
    c = read_table(spark, d, "customer", ["c_name", "c_custkey"])
    return c.select(F.col("c_name").alias("key"),
                    F.concat(F.lit("CLI-"), F.col("c_custkey").cast("string")).alias("value"))


@query("base_geral")
def base_geral(spark, d):
    """P02, P15-P18, P21 on a free-form sheet with accented headers."""
    return NZ.normalize_structure(SI.stored(SI.freeform_orders(spark, d)))


@query("base_geral_split")
def base_geral_split(spark, d):
    """SKU and product split from a 'code - name' product column."""
    return NZ.normalize_structure(SI.stored(SI.freeform_orders(spark, d, split_code=True)))


@query("base_geral_calibrated")
def base_geral_calibrated(spark, d):
    """J01 (SKU alias), J02 (name by SKU), J03 (client alias) on the Base Geral."""
    return NZ.run_normalization(SI.stored(SI.freeform_orders(spark, d)), _sku_aliases(spark, d),
                                _sku_names(spark, d), _client_aliases(spark, d))


@query("canonical_keys")
def canonical_keys(spark, d):
    """Original, canonical and key for client and SKU."""
    base = NZ.normalize_structure(SI.stored(SI.freeform_orders(spark, d)))
    k = NZ.canonical_keys(base, _client_aliases(spark, d), _sku_aliases(spark, d))
    return k.select("order_id", "client_original", "client_canonical", "client_key",
                    "sku_original", "sku_canonical", "sku_key").distinct()


@query("customer_master")
def customer_master(spark, d):
    """P20: customer master projection."""
    return NZ.extract_customers(SI.stored(SI.customer_sheet(spark, d))).drop("ingest_seq")


@query("customer_enrich")
def customer_enrich(spark, d):
    """P19 + J04: canonical transactions enriched from the customer master."""
    valid, _ = V.validate_transactions(SI.stored(SI.raw_transactions(spark, d)))
    cust = NZ.extract_customers(SI.stored(SI.customer_sheet(spark, d)))
    tx = NZ.normalize_transactions(valid, "tpch", cust)
    return tx.select("dataset_id", "ingest_seq", "order_id", "date", "client", "sku", "product", "price",
                     "qty", "subtotal", "segment", "city", "uf")


@query("validate_valid")
def validate_valid(spark, d):
    """rows passing validation, subtotal corrected to price x qty."""
    valid, _ = V.validate_transactions(SI.stored(SI.raw_transactions(spark, d)))
    return valid.select("ingest_seq", "product", "order_id", "client", "price", "qty", "subtotal")


@query("validate_rejects")
def validate_rejects(spark, d):
    """quarantined rows with their first error."""
    _, rejects = V.validate_transactions(SI.stored(SI.raw_transactions(spark, d)))
    return rejects.select("ingest_seq", "error")


@query("validation_summary")
def validation_summary(spark, d):
    """rejected rows per message."""
    _, rejects = V.validate_transactions(SI.stored(SI.raw_transactions(spark, d)))
    return V.validation_summary(rejects)
