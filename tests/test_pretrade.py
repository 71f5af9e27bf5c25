"""Every pre-trade rule by an intent that trips it alone, and a book that only accepted intents move."""

from tapeloom.operators.pretrade import Policy, check

SCHEMA = "account string, id int, day int, symbol string, market string, sector string, order_type string, side string, qty double, limit_price double, mark double, equity double, cash double, buying_power double, halted boolean, blocked boolean, day_trader boolean, daytrades int"
PLAIN = {"id": 1, "day": 1, "symbol": "A", "market": "us", "sector": "x", "order_type": "market", "side": "buy", "qty": 1.0, "limit_price": None, "mark": 100.0, "equity": 10_000.0, "cash": 5_000.0, "buying_power": None, "halted": False, "blocked": False, "day_trader": True, "daytrades": 0}
ALONE = {
    "halted": {"halted": True}, "blocked": {"blocked": True}, "market": {"market": "kr"}, "type": {"order_type": "stop"}, "side": {"side": "hold"}, "qty": {"qty": 0.0}, "mark": {"mark": None}, "limit_deviation": {"order_type": "limit", "limit_price": 104.0},
    "notional": {"qty": 15.0}, "buying_power": {"qty": 5.0, "buying_power": 400.0}, "daytrades": {"day_trader": False, "daytrades": 3}, "equity": {"equity": 0.0}, "cash_fraction": {"cash": 600.0, "qty": 2.0}, "short": {"side": "sell"},
}


def test_each_rule_alone(spark):
    rows = [{"account": name} | PLAIN | change for name, change in ALONE.items()] + [{"account": "ok"} | PLAIN, {"account": "cash"} | PLAIN | {"cash": 50.0, "buying_power": 1e6}]
    got = {r["account"]: r for r in check(spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)).collect()}
    assert got["ok"]["accepted"] and got["ok"]["cash_after"] == 4_900
    assert {k: got[k]["breaches"] for k in ALONE} == {k: k for k in ALONE}
    assert got["cash"]["breaches"] == "cash,cash_fraction"


def test_only_accepted_intents_move_the_book(spark):
    say = [  # id, change, what breaks
        (1, {"qty": 9.0}, ""), (2, {"qty": 9.0}, ""), (3, {"qty": 9.0}, "daily_notional,weight"), (4, {"day": 2, "qty": 9.0}, "weight"), (5, {"day": 2, "symbol": "B", "qty": 9.0}, ""), (6, {"day": 2, "symbol": "C", "qty": 8.0}, "sector"),
        (7, {"day": 2, "symbol": "C", "sector": "y", "qty": 8.0}, ""), (8, {"day": 2, "symbol": "A", "side": "sell", "qty": 18.5}, "notional,short"), (9, {"day": 2, "side": "sell", "qty": 8.0}, ""), (10, {"day": 2, "symbol": "C", "sector": "y", "qty": 3.0}, ""), (11, {"day": 2, "qty": 0.5}, "daily_orders"),
        (12, {"day": 3, "symbol": "D", "sector": "z", "qty": 9.0}, ""), (13, {"day": 3, "symbol": "E", "sector": None, "qty": 9.0}, "gross"),
    ]
    rows = [{"account": "a"} | PLAIN | {"id": i, "cash": 9_500.0} | change for i, change, _ in say]
    policy = Policy(daily_notional=2_500.0, symbol_weight=0.2, sector_weight=0.3, gross=0.45, daily_orders=4)
    got = check(spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA), policy).orderBy("id").collect()
    assert [(r["id"], r["breaches"]) for r in got] == [(i, b) for i, _, b in say]
    assert got[-1]["cash_after"] == 9_500 - 1_800 - 900 - 800 + 800 - 300 - 900
