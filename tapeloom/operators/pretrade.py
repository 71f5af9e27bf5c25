"""Pre-trade rules on the projected book: intents of an account in order, of which only accepted ones move the book."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tapeloom.operators.fold import Machine, fold, schema_of


@dataclass(frozen=True)
class Policy:
    markets: tuple[str, ...] = ("us",)
    order_types: tuple[str, ...] = ("market", "limit")
    sides: tuple[str, ...] = ("buy", "sell")
    margin: bool = False
    short: bool = False
    order_notional: float = 1_000.0
    daily_notional: float = 2_000.0
    symbol_weight: float = 0.25
    sector_weight: float = 1.0
    gross: float = 1.0
    cash_fraction: float = 0.05
    limit_deviation: float = 0.03
    daily_orders: int = 20
    daytrades: int = 3


class Book(Machine):
    """One account: cash, quantities by (symbol, market), and the day's accepted orders and buys."""

    def __init__(self, policy: Policy):
        self.policy, self.cash, self.held = policy, None, {}
        self.day, self.orders, self.bought = None, 0, 0.0

    def breaches(self, r: dict, notional: float, price: float | None) -> list[str]:
        p, buy, key = self.policy, r["side"] == "buy", (r["symbol"], r["market"])
        ref, cap, out = r["mark"], r["limit_price"], []
        told = lambda bad, rule: out.append(rule) if bad else None
        told(r["halted"], "halted")
        told(r["blocked"], "blocked")
        told(r["market"] not in p.markets, "market")
        told(r["order_type"] not in p.order_types, "type")
        told(r["side"] not in p.sides, "side")
        told(r["qty"] <= 0, "qty")
        if price is None:
            out.append("mark")
        else:
            if r["order_type"] == "limit" and cap is not None and ref is not None and ref > 0:
                told(cap > ref * (1 + p.limit_deviation) if buy else r["side"] == "sell" and cap < ref * (1 - p.limit_deviation), "limit_deviation")
            told(notional > p.order_notional, "notional")
            told(buy and notional > (self.cash if r["buying_power"] is None else r["buying_power"]), "buying_power")
            told(buy and self.bought + notional > p.daily_notional, "daily_notional")
        told(self.orders >= p.daily_orders, "daily_orders")
        told(not r["day_trader"] and r["daytrades"] >= p.daytrades, "daytrades")
        if r["equity"] <= 0:
            return [*out, "equity"]
        if buy:
            told(not p.margin and notional > self.cash, "cash")
            told((self.cash - notional) / r["equity"] < p.cash_fraction, "cash_fraction")
        own = self.held.get(key, (0.0, 0.0, None))[0]
        told(r["side"] == "sell" and not p.short and r["qty"] > max(own, 0.0) + 1e-8, "short")
        after = (own + (r["qty"] if buy else -r["qty"])) * (price or 0.0)
        others = {k: v for k, v in self.held.items() if k != key}
        told((sum(abs(q * m) for q, m, _ in others.values()) + abs(after)) / r["equity"] > p.gross, "gross")
        told(abs(after) / r["equity"] > p.symbol_weight, "weight")
        if p.sector_weight < 1 and r["sector"]:
            same = sum(abs(q * m) for q, m, s in others.values() if s == r["sector"])
            now, then = same + abs(own * (price or 0.0)), same + abs(after)
            told(then / r["equity"] > p.sector_weight and then > now + 1e-9, "sector")
        return out

    def step(self, r: dict) -> list[dict]:
        if self.cash is None:
            self.cash = r["cash"]
        if r["day"] != self.day:
            self.day, self.orders, self.bought = r["day"], 0, 0.0
        price = r["limit_price"] or r["mark"]
        price = price if price is not None and price > 0 else None
        notional = r["qty"] * price if price is not None else 0.0
        broken = self.breaches(r, notional, price)
        if not broken:
            sign = 1 if r["side"] == "buy" else -1
            key = (r["symbol"], r["market"])
            qty = self.held.get(key, (0.0,))[0] + sign * r["qty"]
            self.held[key] = (qty, r["mark"] or price, r["sector"])
            if not qty:
                del self.held[key]
            self.cash -= sign * notional
            self.orders += 1
            self.bought += notional if sign > 0 else 0.0
        return [{"id": r["id"], "accepted": not broken, "breaches": ",".join(broken), "cash_after": self.cash, "n_held": len(self.held)}]


def check(intents: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """(account, id, accepted, breaches, cash_after, n_held) of intents, taken by account in order of day and id.

    Columns: account, id, day, symbol, market, sector, order_type, side, qty, limit_price, mark, equity, cash (of the
    account before its first intent), buying_power (null: the cash left), halted, blocked, day_trader, daytrades. The
    state of an account is its book; its intents pass through in batches.
    """
    return fold(intents, ["account"], ["day", "id"], lambda: Book(policy), schema_of(intents, ["account", "id"], "accepted boolean, breaches string, cash_after double, n_held int"))
