"""Report plans (G01-G03): dictionaries of DataFrames over facts stored once, plus
the P26, P32 and P33 projections."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.dates import add_days
from orderpulse.functions.labels import reliability_label
from orderpulse.operators import alerts as AL
from orderpulse.operators import metrics as M
from orderpulse.operators import summary as SU
from orderpulse.operators.normalize import base_positions
from orderpulse.operators.ranks import numbered_in_order
from orderpulse.schemas import DEFAULT_DELAY_DAYS, REPORT_SHEETS
from orderpulse.session import stored_once


def relationship_sheet(clients: DataFrame, delay: int = DEFAULT_DELAY_DAYS) -> DataFrame:
    """Next purchase window = last order + (median turnover + delay) days."""
    janela = F.coalesce(F.col("gm_cliente"), F.lit(0.0)) + F.lit(float(delay))
    return clients.select("client", "segment", "city", "uf", "gm_cliente", "recency", "frequency",
                          "last_order", janela.alias("janela_prevista_dias"),
                          add_days(F.col("last_order"), janela).alias("proxima_janela"))


#: What the report plans read of the facts: the joins behind them run once.
REPORT_FACTS = ["dataset_id", "order_id", "date", "client", "seller", "sku", "product", "price", "qty", "subtotal",
                "category", "segment", "city", "uf", "ingest_seq"]


#: What the tables of G01 read of the facts, for a report of some of them.
SHEET_FACTS = {"clients": M.CUSTOMER_FACTS, "history": ["date", "client", "order_id", "qty", "subtotal"],
               "mix": M.PRODUCT_FACTS, "relationship": M.CUSTOMER_FACTS, "behavior": [*M.CUSTOMER_FACTS, "sku"]}


def report_facts(tx: DataFrame, columns: list[str] = REPORT_FACTS) -> DataFrame:
    """The facts of a report, stored once; every table of the report scans the columns it needs.
    Raises ``ValueError`` on empty input."""
    facts = stored_once(tx, columns)
    if facts.isEmpty():
        raise ValueError("no normalised transactions to report on")
    return facts


def report_plans(tx: DataFrame, reference_date, delay: int = DEFAULT_DELAY_DAYS,
                 sheet: str | None = None) -> dict[str, Callable[[], DataFrame]]:
    """A function per table over the shared facts; what several tables need is computed once.

    ``sheet`` names the one table that will be asked for: only what it reads is stored."""
    tx = report_facts(tx, REPORT_FACTS if sheet is None else SHEET_FACTS[sheet])
    clients = cache(lambda: M.customer_rfm(tx, reference_date))
    plans = {
        REPORT_SHEETS["clients"]: clients,
        REPORT_SHEETS["history"]: lambda: M.monthly_history(tx),
        REPORT_SHEETS["mix"]: lambda: M.product_analytics(tx),
        REPORT_SHEETS["relationship"]: lambda: relationship_sheet(clients(), delay),
        REPORT_SHEETS["behavior"]: lambda: M.behaviour_sheet(M.general_kpis(tx, reference_date, delay), clients()),
    }
    return plans if sheet is None else {REPORT_SHEETS[sheet]: plans[REPORT_SHEETS[sheet]]}


def build_report(tx: DataFrame, reference_date, delay: int = DEFAULT_DELAY_DAYS) -> dict[str, DataFrame]:
    """The five report tables. Raises ``ValueError`` on empty input."""
    return {name: plan() for name, plan in report_plans(tx, reference_date, delay).items()}


def insights_projection(alerts: DataFrame) -> DataFrame:
    """Insight falls back to diagnosis and action to recommended_action;
    columns missing from a legacy alert table read as null."""
    def col(name):
        return F.col(name) if name in alerts.columns else F.lit(None).cast("string")
    return alerts.select(col("client").alias("client"), col("sku").alias("sku"), col("type").alias("type"),
                         F.coalesce(col("insight"), col("diagnosis")).alias("insight"),
                         F.coalesce(col("action"), col("recommended_action")).alias("action"),
                         col("reliability").alias("reliability"),
                         col("suggested_deadline").alias("suggested_deadline"))


def prioritised_targets(alerts: DataFrame) -> DataFrame:
    """Alert rows for the panel with the type upper-cased and reliability as a label."""
    return alerts.select("client", F.coalesce("sku", F.lit("")).alias("sku"),
                         F.upper("type").alias("type"), "diagnosis", "recommended_action",
                         reliability_label(F.col("reliability")).alias("confiabilidade"),
                         F.coalesce("suggested_deadline", F.lit("")).alias("prazo"))


def client_order(clients: DataFrame) -> DataFrame:
    """``position`` by falling RFM score, nulls last (ties by client)."""
    return numbered_in_order(clients, [F.desc_nulls_last("rfm_score"), F.asc_nulls_last("client")], "position")


def pro_plans(tx: DataFrame, reference_date, table: str | None = None) -> dict[str, Callable[[], DataFrame]]:
    """A function per table over the shared facts.

    ``table`` names the one table that will be asked for: only what it reads is stored."""
    tx = report_facts(tx, AL.ALERT_FACTS if table in ("insights", "alertas") else REPORT_FACTS)
    alerts = cache(lambda: AL.rico_alerts(tx, reference_date))
    plans = {
        "base": lambda: base_positions(tx).orderBy("position"),
        "clientes": lambda: client_order(M.customer_rfm(tx, reference_date)).orderBy("position"),
        "produtos": lambda: SU.potential_order(SU.client_sku_potential(tx)).orderBy("position"),
        "insights": lambda: insights_projection(alerts()),
        "alertas": alerts,
    }
    return plans if table is None else {table: plans[table]}


def pro_report(tx: DataFrame, reference_date) -> dict[str, DataFrame]:
    """Base (T01), client potential (T02), product potential (A22, T09), insights (P26), alerts."""
    return {name: plan() for name, plan in pro_plans(tx, reference_date).items()}


def panel_plans(tx: DataFrame, reference_date, base_rows: int | None = None,
                table: str | None = None) -> dict[str, Callable[[], DataFrame]]:
    """A function per table over the shared facts; ``base_rows`` caps the base table in arrival order.

    ``table`` names the one table that will be asked for: only what it reads is stored."""
    tx = report_facts(tx, AL.ALERT_FACTS if table == "alvos_priorizados" else REPORT_FACTS)
    clients = cache(lambda: M.customer_rfm(tx, reference_date))

    def base() -> DataFrame:
        b = tx.orderBy("ingest_seq", "product", "qty", "subtotal")
        return b if base_rows is None else b.limit(base_rows)
    plans = {
        "painel": lambda: SU.panel_kpis(tx),
        "rfm_resumo": lambda: SU.rfm_summary(clients()),
        "radar_cliente": lambda: clients().select("client", "recency", "frequency", "monetary", "avg_ticket",
                                                  "gm_cliente", "tier"),
        "radar_produto": lambda: SU.product_radar(tx),
        "alvos_priorizados": lambda: prioritised_targets(AL.rico_alerts(tx, reference_date)),
        "base_completa": base,
    }
    return plans if table is None else {table: plans[table]}


def panel_report(tx: DataFrame, reference_date, base_rows: int | None = None) -> dict[str, DataFrame]:
    """Panel KPIs + RFM summary, client radar, product radar, prioritised targets (P32) and the base table."""
    return {name: plan() for name, plan in panel_plans(tx, reference_date, base_rows).items()}
