"""Stand-in inputs built from the driver tables for operators whose natural
input is not a driver table (cell grids, text columns).

These only lay rows out in the schema the operator expects; they do none of
the operator's work. Row order within a grid is given by ``row_idx``.
``stored`` writes a stand-in once (checkpoint directory), as the sheet or table
it stands for would be stored, so an operator's several passes read it rather
than rebuild it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.session import stored_once
from orderpulse.sources.tables import read_table

BLOCK_HEADER_CELLS = ["Data Emissão", "Pedido", "Cliente", "Vendedor", "Preço", "Quantidade", "Subtotal"]
FLAT_HEADER_CELLS = ["data_emissao", "pedido", "cliente", "vendedor", "preco", "quantidade", "total",
                     "produto"]


def stored(df: DataFrame) -> DataFrame:
    """Write the stand-in as a Parquet table, in the splits in which its rows arrive."""
    return stored_once(df)


def pt_br(x: Column) -> Column:
    """2-place number as pt-BR text: 1234.5 -> '1.234,50'."""
    return F.translate(F.format_number(x, 2), ",.", ".,")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                           "l_quantity", "l_extendedprice", "l_returnflag", "l_discount"])
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    c = read_table(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey"])
    n = read_table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    p = read_table(spark, d, "part", ["p_partkey", "p_name", "p_retailprice"])
    # customers meet orders before line items do, so line items are shuffled for orders and parts only
    placed = o.join(c.join(n, c.c_nationkey == n.n_nationkey), o.o_custkey == c.c_custkey)
    return li.join(placed, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)


def _data_cells(df: DataFrame) -> list[Column]:
    return [F.date_format("o_orderdate", "dd/MM/yyyy"), F.col("l_orderkey").cast("string"),
            F.col("c_name"), F.concat(F.lit("Vendedor "), F.col("l_suppkey").cast("string")),
            pt_br(F.col("p_retailprice")), F.col("l_quantity").cast("long").cast("string"),
            pt_br(F.col("l_extendedprice"))]


def block_grid(spark: SparkSession, d: str) -> DataFrame:
    """One 'Produtos por Pedido' sheet per nation: per part a ``Produto: <name>``
    row, a column header row, one row per line item and a closing total row."""
    lines = _lines(spark, d)
    base = F.col("p_partkey") * F.lit(1 << 32)
    data = lines.select(F.col("n_name").alias("file_id"),
                        (base + F.col("l_orderkey") * 8 + F.col("l_linenumber") + 2).alias("row_idx"),
                        F.array(*_data_cells(lines)).alias("cells"))
    blocks = lines.select(F.col("n_name").alias("file_id"), "p_partkey", "p_name").distinct()
    heads = blocks.select("file_id", (base).alias("row_idx"),
                          F.array(F.concat(F.lit("Produto: "), F.col("p_name"))).alias("cells"))
    cols = blocks.select("file_id", (base + 1).alias("row_idx"),
                         F.array(*[F.lit(h) for h in BLOCK_HEADER_CELLS]).alias("cells"))
    totals = blocks.select("file_id", (base + F.lit((1 << 32) - 1)).alias("row_idx"),
                           F.array(*[F.lit(None).cast("string")] * 5, F.lit(None).cast("string"),
                                   F.lit("Total")).alias("cells"))
    return heads.unionByName(cols).unionByName(data).unionByName(totals)


def flat_grid(spark: SparkSession, d: str) -> DataFrame:
    """One structured sheet per region: a title row, the header row, one row per
    line item and a 'Total geral' row at the end."""
    lines = _lines(spark, d)
    region = read_table(spark, d, "region", ["r_regionkey", "r_name"])
    lines = lines.join(region, lines.n_regionkey == region.r_regionkey)
    data = lines.select(F.col("r_name").alias("file_id"),
                        (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 2).alias("row_idx"),
                        F.array(*_data_cells(lines), F.col("p_name")).alias("cells"))
    title = region.select(F.col("r_name").alias("file_id"), F.lit(0).cast("long").alias("row_idx"),
                          F.array(F.concat(F.lit("Pedidos - "), F.col("r_name"))).alias("cells"))
    head = region.select(F.col("r_name").alias("file_id"), F.lit(1).cast("long").alias("row_idx"),
                         F.array(*[F.lit(h) for h in FLAT_HEADER_CELLS]).alias("cells"))
    total = region.select(F.col("r_name").alias("file_id"), F.lit((1 << 62)).cast("long").alias("row_idx"),
                          F.array(F.lit("Total geral"), *[F.lit(None).cast("string")] * 7).alias("cells"))
    return title.unionByName(head).unionByName(data).unionByName(total)


def freeform_orders(spark: SparkSession, d: str, split_code: bool = False) -> DataFrame:
    """A free-form order sheet (accented headers, all text) from line items.

    ``split_code``: no SKU column; the product cell reads ``<code> - <name>``."""
    lines = _lines(spark, d)
    region = read_table(spark, d, "region", ["r_regionkey", "r_name"])
    lines = lines.join(region, lines.n_regionkey == region.r_regionkey)
    cols = [F.date_format("o_orderdate", "dd/MM/yyyy").alias("Data Emissão"),
            F.col("l_orderkey").cast("string").alias("Pedido"),
            F.col("c_name").alias("Cliente"),
            F.concat(F.lit("Vendedor "), F.col("l_suppkey").cast("string")).alias("Vendedor")]
    if split_code:
        cols.append(F.concat(F.col("l_partkey").cast("string"), F.lit(" - "), F.col("p_name")).alias("Produto"))
    else:
        cols += [F.col("l_partkey").cast("string").alias("Código"), F.col("p_name").alias("Descrição")]
    cols += [F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("Preço Unitário"),
             F.col("l_quantity").cast("long").cast("string").alias("Quantidade"),
             F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("Valor Total"),
             F.col("n_name").alias("Cidade"), F.col("r_name").alias("UF"),
             (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ingest_seq")]
    return lines.select(*cols)


def raw_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Extracted-transaction rows from line items, as an extractor hands them to
    validation: returns (flag 'R') carry a negative quantity and undiscounted
    lines a zero price, which the validator must reject."""
    lines = _lines(spark, d)
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    price = F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    return lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ingest_seq"),
        F.col("p_name").alias("product"), F.col("o_orderdate").alias("date"),
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("c_name").alias("client"),
        F.concat(F.lit("Vendedor "), F.col("l_suppkey").cast("string")).alias("seller"),
        price.alias("price"), qty.alias("qty"), F.col("l_extendedprice").alias("subtotal"))


def customer_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Customer master rows (client, cnpj, ie, uf, city, segment) from customers."""
    c = read_table(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, d, "region", ["r_regionkey", "r_name"])
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.select(F.col("c_name").alias("client"), F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("cnpj"),
                    F.lit("").alias("ie"), F.lower("r_name").alias("uf"), F.col("n_name").alias("city"),
                    F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("ingest_seq"))


#: Line items of one order sheet and customers of one customer sheet, at most about this many.
SHEET_ROWS = 200_000


def order_sheet_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order sheets as text lines ``sheet, part, pos, value``, to be written in that order.

    One or more sheets per nation (orders are dealt over as many as its line items need). A block per part:
    ``Produto: <name>``, a column header, its lines, a total. Returns carry a negative quantity and undiscounted
    lines a zero price, which the validator rejects; sellers are plain, hold the separator or a line break.
    The first sheet is delivered a second time as ``copy``."""
    lines = _lines(spark, d)
    sizes = lines.groupBy("n_name").agg(F.ceil(F.count(F.lit(1)) / SHEET_ROWS).alias("_sheets"))
    lines = lines.join(F.broadcast(sizes), "n_name")               # one row per nation
    sheet = F.concat_ws("-", F.translate("n_name", " ", "_"),
                        F.pmod(F.xxhash64("l_orderkey"), F.col("_sheets")).cast("string"))
    supplier = F.col("l_suppkey").cast("string")
    seller = (F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit('"Vendedor; '), supplier, F.lit('"')))
              .when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit('"Vendedor ""A""\n'), supplier, F.lit('"')))
              .otherwise(F.concat(F.lit("Vendedor "), supplier)))
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    price = F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    lines = lines.withColumn("sheet", sheet)
    data = lines.select("sheet", F.col("p_partkey").alias("part"),
                        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
                        F.concat_ws(";", F.date_format("o_orderdate", "dd/MM/yyyy"), F.col("l_orderkey").cast("string"),
                                    "c_name", seller, pt_br(price), qty.cast("long").cast("string"),
                                    pt_br(F.col("l_extendedprice"))).alias("value"))
    blocks = lines.select("sheet", F.col("p_partkey").alias("part"), "p_name").distinct()
    frame = F.inline(F.array(
        F.struct(F.lit(-2).cast("long").alias("pos"), F.concat(F.lit("Produto: "), F.col("p_name")).alias("value")),
        F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(";".join(BLOCK_HEADER_CELLS)).alias("value")),
        F.struct(F.lit((1 << 62)).cast("long").alias("pos"), F.lit(";;;;;;Total").alias("value"))))
    out = data.unionByName(blocks.select("sheet", "part", frame))
    first = out.agg(F.min("sheet")).first()[0]
    return out.unionByName(out.where(F.col("sheet") == first).withColumn("sheet", F.lit("copy")))


def customer_sheet_lines(spark: SparkSession, d: str) -> DataFrame:
    """Customer sheets as text lines ``sheet, pos, value``: a title, the header row, customers; every fiftieth
    customer has no name, which the validator rejects."""
    c = customer_sheet(spark, d)
    sheets = max(1, -(-c.count() // SHEET_ROWS))
    name = F.when(F.col("ingest_seq") % 50 == 0, F.lit("")).otherwise(F.col("client"))
    body = c.select(F.pmod("ingest_seq", F.lit(sheets)).alias("sheet"), F.col("ingest_seq").alias("pos"),
                    F.concat_ws(";", name, "cnpj", "uf", "city", "segment").alias("value"))
    top = spark.range(sheets).select(F.col("id").alias("sheet"), F.inline(F.array(
        F.struct(F.lit(-2).cast("long").alias("pos"), F.lit("Cadastro geral").alias("value")),
        F.struct(F.lit(-1).cast("long").alias("pos"), F.lit("cliente;cnpj;uf;cidade;segmento").alias("value")))))
    return top.unionByName(body)
