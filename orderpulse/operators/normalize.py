"""Normalisation to the Base Geral and canonical transactions
(P13-P21, J01-J04, S05 consumers, D10).

Calibration mappings and the customer master are joined with
``bounded_broadcast``: broadcast when the table is proven small, a shuffle join
chosen by AQE otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.dates import parse_date, to_utc
from orderpulse.functions.numbers import lenient_double, locale_decimal, locale_number
from orderpulse.functions.text import client_key, generated_sku, split_code_description
from orderpulse.operators.ranks import numbered_in_order
from orderpulse.schemas import BASE_COLUMNS
from orderpulse.session import stored_once
from orderpulse.sources.columns import fuzzy_column, fuzzy_map
from orderpulse.sources.tables import bounded_broadcast

MAPPING_BROADCAST_ROWS = 2_000_000
TEXT_COLUMNS = ["order_id", "client", "seller", "sku", "product", "category", "segment", "city", "uf"]


def _clean_text(c):
    """Text trimmed; null -> '' (Q8)."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def normalize_structure(df: DataFrame, dayfirst: bool = True, locale_numbers: bool = False) -> DataFrame:
    """Map free-form columns to the 13 Base Geral columns.

    Missing text columns are '', missing numbers 0. The CODE - description split
    (P13) applies when no row has a SKU; product falls back to SKU (P14) when no
    row has a product. Numbers are dot-decimal only unless ``locale_numbers``
    (P15, Q3); a null or zero subtotal becomes price x qty (P16); dates are
    parsed leniently, unparsable -> null (P17)."""
    m = fuzzy_map(df.columns)
    combined = fuzzy_column(df.columns, ["produto", "item", "descricao"])
    num = locale_number if locale_numbers else lenient_double
    sel = []
    for t in BASE_COLUMNS:
        s = F.col(f"`{m[t]}`") if m[t] else None
        if t in ("price", "qty", "subtotal"):
            sel.append((num(s) if s is not None else F.lit(0.0)).alias(t))
        elif t == "date":
            sel.append((parse_date(s, dayfirst) if s is not None else F.lit(None).cast("timestamp_ntz")).alias(t))
        else:
            sel.append((s.cast("string") if s is not None else F.lit("")).alias(t))
    sel.append((F.col(f"`{combined}`") if combined else F.lit(None).cast("string")).alias("_comb"))
    out = df.select(*sel)
    # "every row" facts for P13/P14 in one aggregate row, cross-joined
    code, desc = split_code_description(F.col("_comb"))
    flags = out.agg(F.coalesce(F.bool_and(F.col("sku") == ""), F.lit(True)).alias("_no_sku"),
                    F.coalesce(F.bool_and(F.col("product") == ""), F.lit(True)).alias("_no_prod"),
                    F.coalesce(F.bool_and(desc == ""), F.lit(True)).alias("_no_desc"),
                    (F.count(F.lit(1)) > 0).alias("_any_row"))
    out = out.crossJoin(flags)
    split_ok = F.col("_no_sku") & F.lit(combined is not None)
    # product is still empty everywhere after P13 when it was and the split gave no description
    prod_empty = F.col("_no_prod") & (~split_ok | F.col("_no_desc"))
    out = out.withColumn("sku", F.when(split_ok, code).otherwise(F.col("sku"))) \
        .withColumn("product", F.when(split_ok & F.col("_no_prod"), desc).otherwise(F.col("product")))
    # Sku text is never missing (empty string counts as present), so any row suffices
    out = out.withColumn("product", F.when(prod_empty & F.col("_any_row"), F.col("sku").cast("string"))
                         .otherwise(F.col("product")))
    missing = F.col("subtotal").isNull() | (F.col("subtotal") == 0)
    out = out.withColumn("subtotal", F.when(missing, F.coalesce("price", F.lit(0.0)) * F.coalesce("qty", F.lit(0.0)))
                         .otherwise(F.col("subtotal")))
    return out.select(*[_clean_text(F.col(c)).alias(c) if c in TEXT_COLUMNS else F.col(c)
                        for c in BASE_COLUMNS])


def _lookup(df: DataFrame, mapping: DataFrame, on: str, target: str) -> DataFrame:
    """``target := mapping[trim(on)]`` when the key is mapped, else unchanged."""
    m = bounded_broadcast(mapping.select(F.col("key").alias("_k"), F.col("value").alias("_v")),
                          MAPPING_BROADCAST_ROWS)
    j = df.join(m, F.trim(F.col(on).cast("string")) == F.col("_k"), "left")
    return j.withColumn(target, F.coalesce(F.col("_v"), F.col(target))).drop("_k", "_v")


def run_normalization(df: DataFrame, sku_aliases: DataFrame | None = None,
                      sku_names: DataFrame | None = None, client_aliases: DataFrame | None = None,
                      dayfirst: bool = True, locale_numbers: bool = False) -> DataFrame:
    """Base Geral pipeline: structure, then SKU alias (J01), canonical product
    name by SKU (J02, after J01), client alias (J03). Sort with ``base_order``
    at the sink (T01)."""
    out = normalize_structure(df, dayfirst, locale_numbers)
    if sku_aliases is not None:
        out = _lookup(out, sku_aliases, "sku", "sku")
    if sku_names is not None:
        out = _lookup(out, sku_names, "sku", "product")
    if client_aliases is not None:
        out = _lookup(out, client_aliases, "client", "client")
    return out.select(*BASE_COLUMNS)


BASE_ORDER = ("date", "client", "sku")


def base_order(df: DataFrame) -> DataFrame:
    """Date, client, sku ascending, nulls last."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in BASE_ORDER])


def base_positions(df: DataFrame) -> DataFrame:
    """T01 as a column: ``position`` of every row in the base order, ties by the other columns."""
    rest = [c for c in df.columns if c not in BASE_ORDER]
    # a global sort reads its rows twice, to sample and to sort: cells are parsed once, before it
    return numbered_in_order(stored_once(df), [F.asc_nulls_last(c) for c in (*BASE_ORDER, *rest)], "position")


def normalize_transactions(raw: DataFrame, dataset_id: str, customers: DataFrame | None = None,
                           use_supplied_sku: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """P19 + J04: canonical transactions from validated raw rows.

    client = client key (P11); sku = supplied sku when present (Q7) else
    generated from the product (P12); price decimal(28,2) HALF_UP (P08);
    subtotal = price x qty recomputed; date naive local -> UTC (P09); uf,
    segment, city from the customer master by client key (miss -> null).
    Rows whose price does not parse are dropped, as the reference skips them.
    ``keep`` names extra input columns carried through (e.g. the source file)."""
    price = locale_decimal(F.col("price"))
    sku = generated_sku(F.col("product"))
    if use_supplied_sku and "sku" in raw.columns:
        sku = F.when(F.coalesce(F.trim("sku"), F.lit("")) != "", F.trim("sku")).otherwise(sku)
    tx = raw.select(
        F.lit(dataset_id).alias("dataset_id"), F.col("order_id").cast("string").alias("order_id"),
        to_utc(F.col("date")).alias("date"), client_key(F.col("client")).alias("client"),
        (F.col("seller") if "seller" in raw.columns else F.lit(None)).cast("string").alias("seller"),
        sku.alias("sku"), F.col("product").cast("string").alias("product"),
        price.alias("price"), F.col("qty").cast("long").alias("qty"),
        (price * F.col("qty").cast("decimal(20,0)")).cast("decimal(28,2)").alias("subtotal"),
        (F.col("category") if "category" in raw.columns else F.lit(None)).cast("string").alias("category"),
        (F.col("ingest_seq") if "ingest_seq" in raw.columns else F.lit(None)).cast("long").alias("ingest_seq"),
        *[F.col(k) for k in keep],
    ).where(F.col("price").isNotNull())
    if customers is None:
        return tx.select("*", *[F.lit(None).cast("string").alias(c) for c in ("segment", "city", "uf")])
    # one row per client key, so that repeated customers do not multiply facts: per field the latest value
    # (S07); without an arrival order the largest
    def current(c):
        seq = F.when(F.col(c).isNotNull(), F.col("ingest_seq")) if "ingest_seq" in customers.columns else F.col(c)
        return F.max_by(c, seq).alias(c)
    c = customers.groupBy(F.col("name").alias("_name")).agg(*[current(f) for f in ("segment", "city", "uf")])
    return tx.join(c, tx.client == c._name, "left").drop("_name")


def canonical_keys(df: DataFrame, client_aliases: DataFrame | None = None,
                   sku_aliases: DataFrame | None = None) -> DataFrame:
    """Original, canonical (aliases applied) and key for client and SKU."""
    out = df.withColumn("client_original", F.col("client")).withColumn("sku_original", F.col("sku")) \
        .withColumn("client_canonical", F.col("client")).withColumn("sku_canonical", F.col("sku"))
    if client_aliases is not None:
        out = _lookup(out, client_aliases, "client_original", "client_canonical")
    if sku_aliases is not None:
        out = _lookup(out, sku_aliases, "sku_original", "sku_canonical")
    return out.withColumn("client_key", client_key(F.col("client_canonical"))) \
        .withColumn("sku_key", generated_sku(F.col("sku_canonical")))


def extract_customers(rows: DataFrame) -> DataFrame:
    """P20: customer master rows (already column-mapped: client, cnpj, ie, uf,
    city, optional segment) -> name, original name, cnpj, ie, UF upper-cased,
    city, segment; blank names dropped."""
    def col(c):
        return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in rows.columns else F.lit("")
    out = rows.select(
        client_key(col("client")).alias("name"), col("client").alias("original_name"),
        col("cnpj").alias("cnpj"), col("ie").alias("ie"), F.upper(col("uf")).alias("uf"),
        col("city").alias("city"), F.nullif(col("segment"), F.lit("")).alias("segment"),
        (F.col("ingest_seq") if "ingest_seq" in rows.columns else F.lit(None)).cast("long").alias("ingest_seq"),
        *[F.col(c) for c in ("file_id",) if c in rows.columns])
    return out.where(F.col("original_name") != "")


def reparse_date_columns(df: DataFrame, dayfirst: bool = True) -> DataFrame:
    """Every column whose name contains ``date`` or ``data`` re-parsed as a
    timestamp (text day-first; timestamps pass through; unparsable -> null)."""
    out = []
    for f in df.schema.fields:
        name = f.name.lower()
        if "date" in name or "data" in name:
            if f.dataType.typeName().startswith("timestamp"):
                out.append(F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name))
            else:
                out.append(parse_date(F.col(f"`{f.name}`"), dayfirst).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def metrics_frame(tx: DataFrame) -> DataFrame:
    """Canonical transactions at the metrics boundary — decimal money and
    integer quantities as double."""
    casts = {"price": "double", "subtotal": "double", "qty": "double"}
    return tx.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in tx.columns])
