"""Minimum-rule boundaries (M01-M04) and R03 on a repeated flagged date."""

import datetime as dt

from orderpulse.operators import alerts as AL
from orderpulse.operators import stats as S
from orderpulse.operators.ordered import with_previous
from tests.conftest import tx_frame

REF = "2024-06-01 00:00:00"


def _tx(spark, rows):
    return tx_frame(spark, rows)


def test_min_rupture_status_boundaries(spark):
    # single purchase -> turnover 45; limit = last + 65 days
    ref = dt.datetime(2024, 6, 1)
    at_limit = ref - dt.timedelta(days=65)
    past = ref - dt.timedelta(days=66)
    alert = ref - dt.timedelta(days=48)        # int(.75 * 65) = 48 -> ALERTA from day 48
    early = ref - dt.timedelta(days=47)
    rows = [("c1", "s", "p1", str(at_limit), "1", 1.0, 1.0), ("c2", "s", "p1", str(past), "2", 1.0, 1.0),
            ("c3", "s", "p1", str(alert), "3", 1.0, 1.0), ("c4", "s", "p1", str(early), "4", 1.0, 1.0)]
    out = {r["cliente"]: r["status"] for r in AL.min_rupture(_tx(spark, rows), REF).collect()}
    assert out == {"c2": "CRITICO", "c3": "ALERTA"}


def test_inactivity_growth_single_purchase(spark):
    ref = dt.datetime(2024, 6, 1)
    rows = [("old", "s", "p", str(ref - dt.timedelta(days=91)), "1", 1.0, 10.0),
            ("edge", "s", "p", str(ref - dt.timedelta(days=90)), "2", 1.0, 10.0),
            ("grow", "s", "p", str(ref - dt.timedelta(days=100)), "3", 1.0, 100.0),
            ("grow", "s", "p", str(ref - dt.timedelta(days=10)), "4", 1.0, 121.0),
            ("once", "s", "q", str(ref - dt.timedelta(days=121)), "5", 1.0, 1.0)]
    tx = _tx(spark, rows)
    inactive = {r["cliente"] for r in AL.inactive_clients(tx, REF).collect()}
    assert inactive == {"old", "once", "grow"} - {"grow"}
    growth = AL.growth_clients(tx, REF).collect()
    assert [(r["cliente"], r["variacao_perc"]) for r in growth] == [("grow", 21.0)]
    single = {(r["cliente"], r["produto"]) for r in AL.single_purchase(tx, REF).collect()}
    assert ("once", "q") in single and ("edge", "p") not in single


def test_outlier_with_repeated_flagged_date(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("c", "s", "p", str(base + dt.timedelta(days=i)), str(i), 10.0, 10.0) for i in range(12)]
    rows += [("c", "s", "p", str(base + dt.timedelta(days=20)), "x1", 500.0, 500.0),
             ("c", "s", "p", str(base + dt.timedelta(days=20)), "x2", 500.0, 500.0)]
    # two 500s among twelve 10s: z = 2.3 < 3, so lower the limit to flag them
    out = AL.outlier_alerts(_tx(spark, rows), z_limit=2.0).collect()
    assert len(out) == 1 and out[0]["valor"] == 500.0 and out[0]["direcao"] == "acima"


def test_outlier_rule_orders_rows_of_flagged_pairs_only(spark, monkeypatch):
    day = dt.datetime(2024, 1, 1)

    def pair(client, qtys):
        return [(client, "s", "p", str(day + dt.timedelta(days=i)), f"{client}{i}", float(q), 1.0) for i, q in enumerate(qtys)]
    rows = pair("high", [1] * 20 + [50]) + pair("low", [50] * 20 + [1]) + pair("calm", [1, 2] * 10) + pair("few", [1, 1, 9])
    rows += pair("flat", [3] * 12) + [(None, "s", "p", str(day), "n", 900.0, 1.0)]
    ordered = []

    def spy(df, *args, **kwargs):
        ordered.append(sorted(r["client"] for r in df.select("client").distinct().collect()))
        return with_previous(df, *args, **kwargs)
    monkeypatch.setattr(AL, "with_previous", spy)
    out = {r["client"]: (r["valor"], r["direcao"], r["survival"]) for r in AL.outlier_alerts(_tx(spark, rows)).collect()}
    assert out == {"high": (50.0, "acima", 0.875), "low": (1.0, "abaixo", 0.875)}
    assert ordered == [["high", "low"]]


def test_outlier_keys_are_those_with_flagged_rows(spark):
    inf, nan = float("inf"), float("nan")
    values = {"a": [1.0] * 20 + [50.0], "b": [1.0, 2.0] * 9, "c": [inf, 1.0, 2.0], "d": [nan, nan], "e": [None, 1.0],
              "f": [5.0] * 10 + [-90.0] + [nan, None], "g": [4.0] * 5}
    df = spark.createDataFrame([(k, "s", v) for k, vs in values.items() for v in vs], "client string, sku string, qty double")
    want = {(r["client"], r["sku"]) for r in S.volume_outliers(df, AL.PAIR).collect()}
    assert {tuple(r) for r in S.outlier_keys(df, AL.PAIR).collect()} == want
    assert {"a", "f"} <= {c for c, _ in want}
