"""Alert rules (R00-R03, M01-M04), their union (U01, U02), summary (A18) and
filters (F07, F08).

Rules are grouped aggregates over (client, sku) or client; per-pair ordered
work (gaps, previous quantity, last six rows) goes through ``ordered`` so a hot
pair is split by day.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.dates import add_days, floor_days, month_start, ts_literal
from orderpulse.functions.labels import reliability
from orderpulse.functions.numbers import cents, money_sum
from orderpulse.operators import stats as S
from orderpulse.operators.metrics import series_growth
from orderpulse.operators.gaps import median_gap, weighted_gaps
from orderpulse.operators.ordered import with_previous
from orderpulse.operators.segments import pdv_scores
from orderpulse.schemas import ALERT_TEXTS, DEFAULT_DELAY_DAYS
from orderpulse.session import materialize, stored_once
from orderpulse.sources.tables import bounded_broadcast

PAIR = ["client", "sku"]
OUTLIER_PAIRS = 200_000  # longer lists of flagged pairs are joined by shuffle


def _triggers(tx: DataFrame) -> DataFrame:
    return pdv_scores(tx).select("client", "gatilhos")


def _text(name: str, *values) -> Column:
    """A fixed text with its values; numbers are rounded half-even to the places they are shown with (noise
    beyond the ninth place does not decide a half)."""
    template = ALERT_TEXTS[name]
    args = []
    for spec, v in zip(re.findall(r"%(?!%)(?:\.(\d))?([sdf])", template.replace("%%", "")), values, strict=True):
        c = F.col(v) if isinstance(v, str) else v
        args.append(F.bround(F.round(c, 9), int(spec[0])) if spec[1] == "f" else c)
    return F.format_string(template, *args)


def _with_action(df: DataFrame, base: str, joiner: str) -> DataFrame:
    """Action text plus the client's PDV triggers, when it has any."""
    trig = F.coalesce(F.col("gatilhos"), F.array().cast("array<string>"))
    action = F.when(F.size(trig) > 0, F.concat(F.col("_action"), F.lit(joiner), F.array_join(trig, ", "))) \
        .otherwise(F.col("_action"))
    return df.withColumn("_action", F.lit(base) if base else F.col("_action")) \
        .withColumn("recommended_action", action).withColumn("action", F.col("recommended_action")) \
        .withColumn("triggers", F.array_join(trig, ", ")).drop("_action", "gatilhos")


def rupture_alerts(tx: DataFrame, reference_date, delay: int = DEFAULT_DELAY_DAYS,
                   triggers: DataFrame | None = None) -> DataFrame:
    """Every (client, sku) with >= 2 rows; confidence = days since last /
    (median gap + delay), capped at 1; repurchase probability and 95% interval
    of the gaps."""
    ref = ts_literal(reference_date)
    if triggers is None:  # read by the pairs and by the triggers
        tx = stored_once(tx, ["client", "sku", "order_id", "qty", "date"])
    t = tx.where(F.col("client").isNotNull() & F.col("sku").isNotNull())
    p = F.percentile(F.col("gap").cast("double"), [0.5, (1 - 0.95) / 2, 1 - (1 - 0.95) / 2], F.col("weight"))
    a = weighted_gaps(t, PAIR).groupBy(*PAIR).agg(
        F.sum("weight").alias("_n"), F.max("last_ts").alias("last_order"), p.alias("_ic"),
        S.share_within(90, F.col("weight")).alias("prob_recompra")).where(F.col("_n") >= 2) \
        .withColumn("giro_mediano", F.col("_ic")[0])
    dias = floor_days(ref, F.col("last_order"))
    previsao = F.col("giro_mediano") + F.lit(float(delay))
    conf = F.least(F.lit(1.0), dias / F.greatest(F.lit(1.0), previsao))
    out = a.select(
        *PAIR, F.lit("ruptura").alias("type"), "last_order", dias.alias("dias_sem_compra"),
        "giro_mediano", conf.alias("confianca"), reliability(conf).alias("reliability"),
        "prob_recompra", F.col("_ic")[1].alias("ic_low"), F.col("_ic")[2].alias("ic_high"),
        F.lit("3 dias").alias("suggested_deadline"))
    out = out.withColumn("insight", _text("ruptura_insight", "client", "sku", "dias_sem_compra", "giro_mediano",
                                          "ic_low", "ic_high", F.col("prob_recompra") * 100)) \
        .withColumn("diagnosis", _text("ruptura_diagnosis", "client", "dias_sem_compra", "sku", "giro_mediano")) \
        .withColumn("_action", _text("ruptura_action", "client"))
    trig = _triggers(tx) if triggers is None else triggers
    return _with_action(out.join(trig, "client", "left"), "", ALERT_TEXTS["ruptura_joiner"])


def drop_alerts(tx: DataFrame, triggers: DataFrame | None = None, z_limit: float = -1.5) -> DataFrame:
    """Client whose last present month is below the mean of its earlier
    months with z <= -1.5 (needs >= 3 months); score = min(1, |z|/3)."""
    if triggers is None:  # read by the months and by the triggers
        tx = stored_once(tx, ["client", "sku", "order_id", "qty", "date", "subtotal"])
    t = tx.where(F.col("client").isNotNull())
    monthly = t.groupBy("client", month_start(F.col("date")).alias("month")).agg(
        money_sum(F.col("subtotal")).alias("revenue"))
    g = series_growth(monthly, "client")
    z = F.col("growth_zscore")
    hit = g.where((F.col("n_months") >= 3) & (F.col("last") < F.col("mean_prev")) & (z <= z_limit))
    score = F.least(F.lit(1.0), F.abs(z) / 3)
    queda = (F.col("mean_prev") - F.col("last")) / F.greatest(F.lit(1.0), F.col("mean_prev")) * 100
    out = hit.select(
        "client", F.lit(None).cast("string").alias("sku"), F.lit("queda_brusca").alias("type"),
        z.alias("zscore"), F.col("growth_yoy").alias("yoy"), queda.alias("queda_pct"),
        score.alias("score"), reliability(score).alias("reliability"),
        F.lit("1 semana").alias("suggested_deadline"))
    out = out.withColumn("insight", _text("queda_insight", "client", "queda_pct", "zscore", "yoy")) \
        .withColumn("diagnosis", _text("queda_diagnosis", "client", "queda_pct", "zscore"))
    trig = _triggers(tx) if triggers is None else triggers
    return _with_action(out.join(trig, "client", "left"), ALERT_TEXTS["queda_action"],
                        ALERT_TEXTS["queda_joiner"])


def outlier_alerts(tx: DataFrame, triggers: DataFrame | None = None, z_limit: float = 3.0,
                   min_rows: int = 5, tail: int = 6) -> DataFrame:
    """(client, sku) with >= 5 rows and a quantity beyond ``z_limit``
    sigma_pop; reports the latest flagged row, its distance from the mean, the
    CV of consecutive quantity differences and survival over the last 6 rows."""
    facts = stored_once(tx, ["client", "sku", "order_id", "qty", "date", "ingest_seq"])  # read by the rule and the triggers
    tx = facts.where(F.col("client").isNotNull() & F.col("sku").isNotNull())
    # one aggregate names the pairs that can be flagged; only their rows are joined and ordered
    pairs = materialize(S.outlier_keys(tx, PAIR, "qty", z_limit, min_rows))
    tx = tx.join(bounded_broadcast(pairs, OUTLIER_PAIRS), PAIR, "left_semi")
    flagged = S.volume_outliers(tx, PAIR, "qty", z_limit).where(F.col("key_n") >= min_rows)
    latest = flagged.groupBy(*PAIR).agg(
        F.max_by("qty", F.struct("date", "ingest_seq")).alias("valor"),
        F.first("key_mean").alias("media"))
    prev = with_previous(tx, PAIR, ["date", "ingest_seq"], ["qty"])
    cvs = prev.groupBy(*PAIR).agg(S.cv(F.col("qty") - F.col("prev_qty")).alias("cv_giro"))
    surv = S.last_rows(tx, PAIR, tail).groupBy(*PAIR).agg(S.survival(F.col("qty") > 0).alias("survival"))
    df = latest.join(cvs, PAIR, "left").join(surv, PAIR, "left")
    delta = F.abs(F.col("valor") - F.col("media")) / F.greatest(F.lit(1.0), F.col("media"))
    direcao = F.when(F.col("valor") > F.col("media"), "acima").otherwise("abaixo")
    out = df.select(
        *PAIR, F.lit("outlier_volume").alias("type"), "valor", "media", direcao.alias("direcao"),
        delta.alias("delta"), reliability(F.least(F.lit(1.0), delta)).alias("reliability"),
        F.coalesce("cv_giro", F.lit(0.0)).alias("cv_giro"), F.coalesce("survival", F.lit(0.0)).alias("survival"),
        F.lit("48 horas").alias("suggested_deadline"))
    out = out.withColumn("insight", _text("outlier_insight", "direcao", "sku", "valor", "media", "cv_giro", "survival")) \
        .withColumn("diagnosis", _text("outlier_diagnosis", "sku", "direcao", F.col("delta") * 100, "valor", "media"))
    trig = _triggers(facts) if triggers is None else triggers
    return _with_action(out.join(trig, "client", "left"), ALERT_TEXTS["outlier_action"],
                        ALERT_TEXTS["outlier_joiner"])


ALERT_COLUMNS = ["dataset_id", "client", "sku", "type", "insight", "action", "diagnosis",
                 "recommended_action", "reliability", "suggested_deadline"]


#: What the alert rules read of the facts.
ALERT_FACTS = ["client", "sku", "order_id", "qty", "subtotal", "date", "ingest_seq"]


def rico_alerts(tx: DataFrame, reference_date, delay: int = DEFAULT_DELAY_DAYS,
                dataset_id: str | None = None) -> DataFrame:
    """PDV triggers once, the three rules, one union."""
    tx = stored_once(tx, ALERT_FACTS)
    trig = materialize(_triggers(tx))  # one small row per client, joined by each rule
    parts = [rupture_alerts(tx, reference_date, delay, trig), drop_alerts(tx, trig),
             outlier_alerts(tx, trig)]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True) \
        .unionByName(parts[2], allowMissingColumns=True)
    ds = F.lit(dataset_id) if dataset_id is not None else F.lit(None).cast("string")
    return out.withColumn("dataset_id", ds)


def filter_alerts(alerts: DataFrame, alert_type: str | None = None,
                  reliability_symbol: str | None = None, types=None) -> DataFrame:
    """F07 (optional type and reliability) and F08 (type restricted to a list)."""
    if alert_type is not None:
        alerts = alerts.where(F.col("type") == alert_type)
    if reliability_symbol is not None:
        alerts = alerts.where(F.col("reliability") == reliability_symbol)
    if types is not None:
        alerts = alerts.where(F.col("type").isin(list(types)))
    return alerts


def alerts_summary(alerts: DataFrame) -> DataFrame:
    """Total, per type and per reliability in one grouping-sets aggregate."""
    return (alerts.groupingSets([["type"], ["reliability"], []], "type", "reliability")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")))


# --- minimum rules ------------------------------------------------------------------

def min_rupture(tx: DataFrame, reference_date, delay: int = DEFAULT_DELAY_DAYS,
                single_purchase_days: int = 45) -> DataFrame:
    """M01 per (client, product): turnover = whole median gap (45 for a single
    purchase); ALERTA from last + int(.75 x (turnover + delay)) days until
    last + turnover + delay, CRITICO after; OK rows are not emitted."""
    today = ts_literal(reference_date)
    t = tx.where(F.col("date").isNotNull() & F.col("client").isNotNull() & F.col("product").isNotNull())
    a = weighted_gaps(t, ["client", "product"]).groupBy("client", "product").agg(
        F.max("last_ts").alias("ultimo"), median_gap().alias("_med"))
    giro = F.coalesce(F.floor(F.col("_med")), F.lit(single_purchase_days)).cast("long")
    a = a.withColumn("giro_mediano_dias", giro)
    total = F.col("giro_mediano_dias") + F.lit(delay)
    limite = add_days(F.col("ultimo"), total)
    alerta = add_days(F.col("ultimo"), F.floor(total * 0.75))
    status = (F.when(today > limite, "CRITICO")
              .when((today >= alerta) & (today < limite), "ALERTA").otherwise("OK"))
    return a.select(
        F.col("client").alias("cliente"), F.col("product").alias("produto"),
        F.lit("Ruptura").alias("tipo"), "giro_mediano_dias",
        F.date_format("ultimo", "yyyy-MM-dd").alias("ultimo_pedido"),
        F.date_format(limite, "yyyy-MM-dd").alias("limite"), status.alias("status"),
    ).where(F.col("status") != "OK")


def inactive_clients(tx: DataFrame, reference_date, days: int = 90) -> DataFrame:
    """Clients whose last order is more than ``days`` before the reference."""
    today = ts_literal(reference_date)
    t = tx.where(F.col("date").isNotNull() & F.col("client").isNotNull())
    last = t.groupBy("client").agg(F.max("date").alias("ultimo"))
    us = F.timestamp_diff("MICROSECOND", F.col("ultimo"), today)
    return last.where(us > F.lit(days * 86_400_000_000)).select(
        F.col("client").alias("cliente"), F.lit("Inatividade").alias("tipo"),
        floor_days(today, F.col("ultimo")).alias("dias_sem_compra"),
        F.date_format("ultimo", "yyyy-MM-dd").alias("ultimo_pedido"), F.lit("ALERTA").alias("status"))


def growth_clients(tx: DataFrame, reference_date, window: int = 90, ratio: float = 1.2) -> DataFrame:
    """Revenue of the last ``window`` days above ``ratio`` x the window
    before it (which must be positive); change in %, half-even 2 places (W11)."""
    today = ts_literal(reference_date)
    t = tx.where(F.col("date").isNotNull() & F.col("client").isNotNull())
    start_cur = add_days(today, F.lit(-window))
    start_prev = add_days(today, F.lit(-2 * window))
    cur = F.sum(F.when(F.col("date") >= start_cur, cents(F.col("subtotal"))))
    ant = F.sum(F.when((F.col("date") < start_cur) & (F.col("date") >= start_prev), cents(F.col("subtotal"))))
    a = t.groupBy("client").agg(F.coalesce(cur, F.lit(0)).alias("_cur"), F.coalesce(ant, F.lit(0)).alias("_ant"))
    return a.where((F.col("_ant") > 0) & (F.col("_cur") > F.col("_ant") * ratio)).select(
        F.col("client").alias("cliente"), F.lit("Crescimento").alias("tipo"),
        F.lit(f"ultimos_{window}_dias").alias("periodo"), F.lit("vs_periodo_anterior").alias("comparacao"),
        F.bround(100 * (F.col("_cur") - F.col("_ant")) / F.col("_ant"), 2).alias("variacao_perc"),
        F.lit("POSITIVO").alias("status"))


def single_purchase(tx: DataFrame, reference_date, days: int = 120) -> DataFrame:
    """(client, product) bought exactly once, more than ``days`` ago."""
    today = ts_literal(reference_date)
    t = tx.where(F.col("date").isNotNull() & F.col("client").isNotNull() & F.col("product").isNotNull())
    a = t.groupBy("client", "product").agg(F.count(F.lit(1)).alias("_n"), F.max("date").alias("_last"))
    us = F.timestamp_diff("MICROSECOND", F.col("_last"), today)
    return a.where((F.col("_n") == 1) & (us > F.lit(days * 86_400_000_000))).select(
        F.col("client").alias("cliente"), F.col("product").alias("produto"),
        F.lit("Oportunidade").alias("tipo"),
        F.lit(f"SKU com 1 compra e sem retorno >{days}d").alias("motivo"), F.lit("SUGESTAO").alias("status"))


def minimum_alerts(tx: DataFrame, reference_date) -> DataFrame:
    """M01-M04 in one frame with the union of their columns."""
    tx = stored_once(tx, ["client", "product", "date", "subtotal"])
    parts = [min_rupture(tx, reference_date), inactive_clients(tx, reference_date),
             growth_clients(tx, reference_date), single_purchase(tx, reference_date)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
