"""Schemas, canonical column names and values fixed by the reproduced behaviour."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical transaction (fact) schema. Money is decimal(28,2) on ingest and
# double at the metrics boundary; timestamps are wall-clock (timestamp_ntz).
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("client", T.StringType()),
    T.StructField("seller", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("subtotal", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("uf", T.StringType()),
    T.StructField("ingest_seq", T.LongType()),
])

TRANSACTION_COLUMNS = [f.name for f in TRANSACTION_SCHEMA.fields]

CELL_GRID_SCHEMA = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
])

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("original_name", T.StringType()),
    T.StructField("cnpj", T.StringType()),
    T.StructField("ie", T.StringType()),
    T.StructField("uf", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("ingest_seq", T.LongType()),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reproduced behaviour for equal results)
# ---------------------------------------------------------------------------

# Base Geral output columns, in order.
BASE_COLUMNS = ["date", "order_id", "client", "seller", "sku", "product", "price",
                "qty", "subtotal", "category", "segment", "city", "uf"]

# Exact header aliases (lower-cased, trimmed header must equal one alias).
# Listed in a fixed order so a tie resolves deterministically.
TX_ALIASES = {
    "date": ["data_emissao", "emissao", "data", "dt", "data_venda"],
    "order_id": ["pedido", "order", "n_pedido", "doc"],
    "client": ["cliente", "razao_social", "nome_fantasia"],
    "seller": ["criador", "vendedor", "representante"],
    "price": ["preco", "preco_liquido", "valor_unit", "vl_unit"],
    "qty": ["quantidade", "qtd", "qde", "qtde", "quant"],
    "subtotal": ["total", "vl_total", "valor_total"],
    "product": ["produto", "item", "descricao"],
    "sku": ["sku", "codigo", "cod_prod"],
    "uf": ["uf", "estado", "sigla_uf"],
}
CUSTOMER_ALIASES = {
    "client": ["cliente", "razao_social", "nome_fantasia", "cliente_nome"],
    "cnpj": ["cnpj"],
    "ie": ["insc._estadual", "insc_estadual"],
    "uf": ["uf", "estado", "sigla_uf"],
    "city": ["cidade"],
    "segment": ["segmento", "segment"],
}

# Fuzzy (accent/space/case-insensitive substring) keywords for the Base Geral
# mapping; keyword order first, then column order.
FUZZY_KEYWORDS = {
    "date": ["data", "data emissao", "emissao", "date", "data emissão"],
    "order_id": ["pedido", "order", "nota", "nf", "order id"],
    "client": ["cliente", "cliente nome", "razao", "cliente_id"],
    "seller": ["vendedor", "representante", "seller", "criador"],
    "sku": ["sku", "codigo", "código", "cod sku", "ean", "produto codigo"],
    "product": ["produto", "descricao", "descrição", "product", "item"],
    "price": ["preco", "preço", "valor unitario", "vl unit", "price"],
    "qty": ["quantidade", "qtd", "qtde", "qty"],
    "subtotal": ["subtotal", "valor total", "vl total", "total"],
    "category": ["categoria", "categoria produto"],
    "segment": ["segmento", "segment"],
    "city": ["cidade", "municipio"],
    "uf": ["uf", "estado", "sigla", "state"],
}

# Block-report header keywords per field (substring match on lower-cased cells).
# Order matters: a cell takes the first field with a matching keyword. ``subtotal``
# is tested before ``price`` so "Valor Total" maps to subtotal (our decision).
BLOCK_HEADER_KEYWORDS = {
    "date": ["data", "data emissão", "data emissao", "emissão", "emissao"],
    "order_id": ["pedido", "order"],
    "client": ["cliente", "cliente nome", "razao"],
    "seller": ["criador", "vendedor", "representante"],
    "subtotal": ["subtotal", "total"],
    "price": ["preço", "preco", "valor"],
    "qty": ["quantidade", "qtd", "qde", "qtde", "quant"],
}

# Tier thresholds on the RFM score (>= bound -> label), highest first.
TIER_BOUNDS = [(0.85, "hero"), (0.65, "growth"), (0.45, "manter")]
TIER_DEFAULT = "risco"

# Alert reliability symbols by score (>= bound), highest first.
RELIABILITY_BOUNDS = [(0.75, "🔴"), (0.4, "🟡")]
RELIABILITY_DEFAULT = "🔵"
# Export label per reliability symbol.
RELIABILITY_LABELS = {"🔵": "ALTA", "🟡": "MÉDIA", "🔴": "BAIXA"}

# PDV trigger texts.
TRIGGER_MIX = "mix abaixo do cluster"
TRIGGER_VOLUME = "ausência anômala de SKU esperado"
TRIGGER_TURNOVER = "giro lento em relação ao cluster"

# Alert texts (format strings) and deadlines per rule.
ALERT_TEXTS = {
    "ruptura_insight": "Cliente %s sem comprar %s há %d dias. Giro mediano %.1fd (IC %.0f-%.0f) e prob. recompra %.0f%%.",
    "ruptura_diagnosis": "%s está há %dd sem comprar %s (giro %.0fd).",
    "ruptura_action": "Ligar para %s e reservar estoque para reposição em até 3 dias.",
    "ruptura_joiner": " Considerar: ",
    "queda_insight": "Receita de %s caiu %.1f%% vs média. Z-score %.2f, YoY %.1f%%",
    "queda_diagnosis": "Receita mensal de %s recuou %.1f%% (z %.1f).",
    "queda_action": "Oferecer ofertas de recuperação e revisar cobertura com o time comercial.",
    "queda_joiner": " Verificar também: ",
    "outlier_insight": "Volume %s da média para %s (último %.0f vs média %.0f). CV giro %.2f, score sobrevivência %.2f.",
    "outlier_diagnosis": "Volume de %s ficou %s %.0f%% vs média (%.0f vs %.0f).",
    "outlier_action": "Agendar validação de estoque e alinhar com operações/atendimento.",
    "outlier_joiner": " Contexto: ",
}

# Validation messages.
MISSING_FIELD = "Campo obrigatório '{}' ausente"
INVALID_FIELD = {
    "product": "Nome do produto não pode estar vazio",
    "date": "Data deve ser um objeto datetime",
    "order_id": "ID do pedido não pode estar vazio",
    "client": "Nome do cliente não pode estar vazio",
    "price": "Preço deve ser um número válido",
    "qty": "Quantidade deve ser um número inteiro válido",
    "customer": "Nome do cliente é obrigatório",
}

# Report table names.
REPORT_SHEETS = {
    "clients": "Identificação do Cliente",
    "history": "Histórico Comercial",
    "mix": "Inteligência de Mix",
    "relationship": "Relacional e Atendimento",
    "behavior": "Inteligência Comportamental",
}

UNCLASSIFIED_SEGMENT = "Não classificado"
DEFAULT_DELAY_DAYS = 20
