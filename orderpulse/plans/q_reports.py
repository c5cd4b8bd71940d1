"""Registered queries: report tables (G01-G03), orderings with positions (T01-T03, T07, T09, D07), the whole
dataset summary (A17), sinks and sources read back (S01-S06, S10, S11, S13-S16, S18) and parsing tables
(P06, P14, P22, P27, P29-P31)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orderpulse.functions.dates import parse_date, ts_literal
from orderpulse.operators import cycles as CY
from orderpulse.operators import extract as X
from orderpulse.operators import metrics as M
from orderpulse.operators import normalize as NZ
from orderpulse.operators import segments as SG
from orderpulse.operators import stats as S
from orderpulse.operators import summary as SU
from orderpulse.plans import reports as RP
from orderpulse.plans import standins as SI
from orderpulse.plans.registry import TPCH_REF, query, rounded, tx_events, tx_orders, tx_tpch
from orderpulse.schemas import REPORT_SHEETS, TX_ALIASES
from orderpulse.session import ensure_checkpoint_dir
from orderpulse.sources import columns as C
from orderpulse.sources import grid as GR
from orderpulse.sources import store as ST
from orderpulse.sources.adapters import tpch
from orderpulse.sources.tables import read_table


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _g01(spark, d, sheet: str):
    return RP.report_plans(tx_tpch(spark, d), TPCH_REF, sheet=sheet)[REPORT_SHEETS[sheet]]()


# --- G01 ------------------------------------------------------------------------------

@query("report_clients")
def report_clients(spark, d):
    """Client table."""
    return rounded(_g01(spark, d, "clients").select("client", "recency", "frequency", "monetary", "rfm_score", "tier"),
                   {"monetary": 2, "rfm_score": 8})


@query("report_history")
def report_history(spark, d):
    """Monthly history."""
    return rounded(_g01(spark, d, "history").select("periodo", "receita_total", "pedidos", "clientes", "volume"),
                   {"receita_total": 2})


@query("report_mix")
def report_mix(spark, d):
    """Product table."""
    return rounded(_g01(spark, d, "mix").select("sku", "product", "orders", "qty", "revenue", "turnover_median", "hero_mix"),
                   {"revenue": 2, "turnover_median": 4})


@query("report_relationship")
def report_relationship(spark, d):
    """Next purchase windows."""
    return _g01(spark, d, "relationship").select("client", "frequency", "last_order", "janela_prevista_dias", "proxima_janela")


@query("report_behavior")
def report_behavior(spark, d):
    """Behaviour sheet with positions."""
    return _g01(spark, d, "behavior")


# --- G02, G03 -------------------------------------------------------------------------

@query("pro_base")
def pro_base(spark, d):
    """The base in order of date, client, SKU, as positions."""
    b = RP.pro_plans(tx_tpch(spark, d), TPCH_REF)["base"]()
    return b.select("position", "date", "client", "sku", "order_id", "qty")


@query("base_positions")
def base_positions(spark, d):
    """Positions of the Base Geral."""
    b = NZ.base_positions(NZ.normalize_structure(SI.stored(SI.freeform_orders(spark, d))))
    return b.select("position", "date", "client", "sku", "order_id", "seller")


@query("pro_clients")
def pro_clients(spark, d):
    """Clients by falling RFM score, as positions."""
    rfm = rounded(M.customer_rfm(tx_orders(spark, d), TPCH_REF), {"rfm_score": 8})
    return RP.client_order(rfm).select("position", "client", "rfm_score", "tier")


@query("pro_products")
def pro_products(spark, d):
    """Client x SKU potential by client, falling subtotal, as positions."""
    return RP.pro_plans(tx_tpch(spark, d), TPCH_REF)["produtos"]().select("position", "client", "sku", "subtotal", "qty")


@query("pro_insights")
def pro_insights(spark, d):
    """Texts of all alerts."""
    return RP.pro_plans(tx_tpch(spark, d), TPCH_REF, table="insights")["insights"]()


@query("pro_alerts")
def pro_alerts(spark, d):
    """Diagnosis, recommended action and triggers of all alerts."""
    return RP.pro_plans(tx_tpch(spark, d), TPCH_REF, table="alertas")["alertas"]().select(
        "client", "sku", "type", "diagnosis", "recommended_action", "triggers", "reliability")


@query("pdv_order")
def pdv_order(spark, d):
    """PDV segments by falling score, then client."""
    return SG.pdv_order(SG.pdv_scores(tx_tpch(spark, d))).select("position", "client", "score", "justificativa")


@query("panel_client_radar")
def panel_client_radar(spark, d):
    """Client radar."""
    r = RP.panel_plans(tx_tpch(spark, d), TPCH_REF)["radar_cliente"]()
    return rounded(r, {"monetary": 2, "avg_ticket": 6, "gm_cliente": 4})


@query("panel_targets")
def panel_targets(spark, d):
    """Prioritised targets with export labels."""
    return RP.panel_plans(tx_tpch(spark, d), TPCH_REF, table="alvos_priorizados")["alvos_priorizados"]()


@query("panel_base")
def panel_base(spark, d):
    """Base rows in arrival order under the reproduced cap of 10 000 rows."""
    b = RP.panel_plans(tx_tpch(spark, d), TPCH_REF, base_rows=10_000)["base_completa"]()
    return b.select("ingest_seq", "order_id", "client", "product", "qty", "subtotal")


@query("operational_list")
def operational_list(spark, d):
    """Priorities of one status above a confidence, with positions."""
    p = rounded(CY.priority_items(tx_tpch(spark, d), TPCH_REF), {"priority_score": 6, "confidence": 6})
    top = CY.priority_order(CY.operational_list(p, status="ataque", min_confidence=0.5))
    return top.select("position", "client", "sku", "priority_score", "confidence")


@query("dataset_overview")
def dataset_overview(spark, d):
    """A17 whole (T05, T06): scalars and lists from one scan; category = the product's first word."""
    tx = tpch(spark, d).withColumn("category", F.substring_index("product", " ", 1)).withColumn("cnpj", F.col("client"))
    o = SU.dataset_overview(tx, "cnpj")
    return o.select("n_clientes", "n_cnpjs", "n_produtos", "inicio", "fim", "meses",
                    *[F.array_join(c, ",").alias(c) for c in ("ufs", "cidades_top", "categorias_top")])


# --- sources and sinks read back ------------------------------------------------------

@query("sheet_text_extract")
def sheet_text_extract(spark, d):
    """Order sheets written as delimited text with quoted and multi-line cells, read in splits and
    extracted."""
    path = _folder(spark, "sheets")
    (SI.order_sheet_lines(spark, d).where("sheet <> 'copy'").repartition("sheet")
     .sortWithinPartitions("sheet", "part", "pos", "value").select("sheet", "value").write.partitionBy("sheet").text(path))
    tx = X.extract_only(GR.read_grid_csv(spark, path, ";"))
    return tx.select("product", "date", "order_id", "client", "seller", "price", "qty", "subtotal")


@query("grid_parquet_extract")
def grid_parquet_extract(spark, d):
    """Grids stored as Parquet, read and extracted."""
    path = _folder(spark, "grids")
    SI.flat_grid(spark, d).write.parquet(path)
    return X.extract_structured(GR.read_grid_parquet(spark, path))


@query("sheet_csv_base")
def sheet_csv_base(spark, d):
    """Sheets with a header row, one folder per sheet; all of them, then the Base Geral."""
    path = _folder(spark, "csv")
    (SI.freeform_orders(spark, d).drop("ingest_seq").withColumn("sheet", F.col("UF"))
     .write.option("header", True).partitionBy("sheet").csv(path))
    sheets = GR.read_sheet_csv(spark, path)
    return NZ.normalize_structure(sheets.drop("sheet")).select("date", "order_id", "client", "sku", "price", "qty", "subtotal", "uf")


@query("calibration_mapping")
def calibration_mapping(spark, d):
    """Calibration CSV with padded cells, empty keys and repeated keys; the last row of a key wins."""
    path = _folder(spark, "mapping")
    p = read_table(spark, d, "part", ["p_partkey", "p_brand"])
    rows = p.select(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" ")).alias("Apelido (alias)"),
                    F.col("p_brand").alias("SKU final"), F.lit(0).alias("o"), "p_partkey")
    second = rows.where("p_partkey % 3 = 0").withColumn("SKU final", F.concat("SKU final", F.lit("*"))).withColumn("o", F.lit(1))
    empty = rows.where("p_partkey % 7 = 0").withColumn("Apelido (alias)", F.lit("  ")).withColumn("o", F.lit(2))
    # all rows of a key lie in one file, in the order of arrival
    (rows.unionByName(second).unionByName(empty).repartition("p_partkey").sortWithinPartitions("o", "p_partkey")
     .select("Apelido (alias)", "SKU final").write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return GR.load_mapping(spark, path, "alias", "sku")


@query("dataset_partitions")
def dataset_partitions(spark, d):
    """Results kept per dataset; one is replaced, the other served from the store as it was."""
    path = _folder(spark, "results")

    def totals(factor):
        return tx_tpch(spark, d).groupBy("client").agg((F.count(F.lit(1)) * factor).alias("rows"))
    for dataset in ("a", "b"):
        ST.serve_or_compute(spark, path, dataset, lambda: totals(1))
    ST.serve_or_compute(spark, path, "a", lambda: totals(2), regenerate=True)
    served = ST.serve_or_compute(spark, path, "b", lambda: totals(3))
    return served.unionByName(ST.read_dataset(spark, path, "a")).select("dataset_id", "client", "rows")


@query("export_csv")
def export_csv(spark, d):
    """An exportable table with decimals as double, written with a header, ``_id`` left out, read back."""
    path = _folder(spark, "export")
    tx = tx_tpch(spark, d).withColumn("subtotal", F.col("subtotal").cast("decimal(28,2)")).withColumn("_id", F.col("ingest_seq"))
    ST.export_csv(ST.export_table({"transactions": tx}, "transactions").select("_id", "order_id", "client", "product", "subtotal"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.col(c).cast("double" if c == "subtotal" else "string").alias(c) for c in back.columns])


@query("report_sink")
def report_sink(spark, d):
    """Report tables written one folder each and read back (rows per table)."""
    paths = ST.write_report(RP.build_report(tx_orders(spark, d).withColumn("sku", F.col("segment")).withColumn(
        "product", F.col("segment")), TPCH_REF), _folder(spark, "report"))
    out = None
    for name, path in paths.items():
        n = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


# --- parsing --------------------------------------------------------------------------

@query("date_shapes")
def date_shapes(spark, d):
    """Order times as text in twelve shapes, one of them unreadable, under a date-like column name."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 12
    month_first = F.when(F.dayofmonth(t) > 12, F.date_format(t, "MM/dd/yyyy")).otherwise(F.date_format(t, "dd/MM/yyyy"))
    shapes = ["yyyy/MM/dd", "yyyyMMdd", "d MMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss'-03:00'",
              "dd.MM.yy", "dd/MM/yyyy hh:mm a", "dd-MMM-yyyy HH'h'mm", "MM/yyyy"]
    text = F.when(k == 10, month_first).when(k == 11, F.lit("sem data"))
    for i, shape in enumerate(shapes):
        text = text.when(k == i, F.date_format(t, shape))
    rows = NZ.reparse_date_columns(o.select("o_orderkey", text.alias("data_emissao"), text.alias("texto")))
    return rows.select("o_orderkey", F.col("data_emissao").alias("parsed"),
                       parse_date(F.col("texto"), fallback=ts_literal("2000-01-01")).alias("parsed_or"))


@query("sku_fallback")
def sku_fallback(spark, d):
    """No row names a product, so the product is the SKU."""
    sheet = SI.stored(SI.freeform_orders(spark, d)).withColumn("Descrição", F.lit(""))
    return NZ.normalize_structure(sheet).groupBy("sku", "product").agg(F.count(F.lit(1)).alias("rows"))


@query("metrics_boundary")
def metrics_boundary(spark, d):
    """Decimal facts under untidy column names at the metrics boundary."""
    tx = tx_tpch(spark, d).withColumn("price", F.lit("1.25").cast("decimal(28,2)")).withColumn("qty", F.col("qty").cast("long"))
    tx = C.lower_trim_columns(tx.toDF(*[f" {c.upper()} " for c in tx.columns]))
    tx = C.apply_aliases(tx.withColumnRenamed("order_id", "pedido"), TX_ALIASES)
    money = C.first_present(tx.columns, ["receita", "subtotal", "price"])
    return NZ.metrics_frame(tx).groupBy("client").agg(
        F.count_distinct("order_id").alias("orders"), F.round(F.sum(money), 2).alias("revenue"),
        F.round(F.sum("price"), 2).alias("prices"), F.sum("qty").alias("qty"))


@query("coerced_statistics")
def coerced_statistics(spark, d):
    """Statistics of text values, of which some are no numbers."""
    e = tx_events(spark, d)
    text = F.when(F.col("ingest_seq") % 5 == 0, F.lit("n/d")).when(F.col("ingest_seq") % 7 == 0, F.lit("NaN")) \
        .otherwise(F.col("qty").cast("string"))
    m = S.key_moments(e.withColumn("valor", text), ["sku"], "valor")
    return m.select("sku", F.col("_n").alias("n"), F.round("_mean", 6).alias("mean"), F.round("_sd", 6).alias("sd"))
