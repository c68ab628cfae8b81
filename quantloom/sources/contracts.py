"""Column contracts of the known sources: names in order, identity keys, and level-2 types."""

from __future__ import annotations

# Vendor file columns and their normalised names.
RENAMES = {
    "SecuCode": "secu_code",
    "MinBar": "minute",
    "Price": "price",
    "Amount": "amount",
    "Volume": "volume",
    "No": "no",
    "Side": "side",
    "isfirst": "is_first",
    "islast": "is_last",
    "trading_day": "date",
    "DealTime": "deal_time",
    "BuyID": "buy_id",
    "SellID": "sell_id",
    "DealID": "deal_id",
    "OrderTime": "order_time",
    "OrderID": "order_id",
    "OrderType": "order_type",
    "TickTime": "tick_time",
}

# Codes that moved, and the ceiling of stock codes, both for level-2 sources.
TRANSFER_CODES = {22: 1872, 600849: 601607, 43: 1914, 601313: 601360}
MAX_CODE = 700000

LEVELS = range(1, 11)


def _levels(kind: str) -> list[str]:
    """The ten levels of one kind of book column."""
    return [f"{kind}{level}" for level in LEVELS]


# The columns of each source, in order.
COLUMNS = {
    "steptrades": [
        "date", "secu_code", "deal_time", "buy_id", "sell_id", "deal_id", "price", "volume", "side",
    ],
    "steporders": [
        "date", "secu_code", "order_time", "order_id", "order_type", "price", "volume",
    ],
    "trades_tbar": [
        "secu_code", "minute", "price", "side", "volume", "vw_wait_time", "is_first", "is_last", "no", "date",
    ],
    "cancels_tbar": [
        "secu_code", "minute", "price", "side", "volume", "vw_wait_time", "is_first", "is_last", "no", "date",
    ],
    "quotes_tbar": [
        "secu_code", "minute", "price", "side", "volume", "is_first", "is_last", "no", "date",
    ],
    "daily_k": [
        "sec_code", "date", "open", "high", "low", "close", "shares", "amount", "limit_up", "limit_down", "preclose",
        "isSuspend", "isST", "adjfactor", "total_share", "float_share", "free_share", "list_date", "secu_code",
    ],
    "snapshot_tbar": [
        *_levels("AskPrice"), *_levels("BidPrice"), *_levels("AskVolume"), *_levels("BidVolume"),
        "aVOI1", "aVOI2", "aVOI3", "aVOI4", "aVOI5", "secu_code", "minute", "date",
    ],
    "orderbook": [
        "secu_code", "date", "tick_time", "price",
        *_levels("AskPrice"), *_levels("AskVolume"), *_levels("BidPrice"), *_levels("BidVolume"),
    ],
    "universe/ex2kamt": ["sec_code", "preclose", "close", "adjfactor", "secu_code", "date"],
}

_BAR_KEYS = ("date", "secu_code", "minute", "price", "side")
KEYS = {
    "steptrades": ("date", "secu_code", "deal_id"),
    "steporders": ("date", "secu_code", "order_time", "order_id", "order_type"),
    "orderbook": ("date", "secu_code", "tick_time"),
    "trades_tbar": _BAR_KEYS,
    "cancels_tbar": _BAR_KEYS,
    "quotes_tbar": _BAR_KEYS,
    "daily_k": ("date", "secu_code"),
    "snapshot_tbar": ("date", "secu_code", "minute"),
    "universe/ex2kamt": ("date", "secu_code"),
}

_LONG = {"deal_time", "buy_id", "sell_id", "deal_id", "price", "side", "order_time", "order_id", "order_type", "tick_time"}
LEVEL2 = {"steptrades": _LONG, "steporders": _LONG, "orderbook": {"tick_time", "price"}}


def level2_type(source: str, column: str) -> str | None:
    if source not in LEVEL2:
        return None
    if column == "volume":
        return "double"
    return "long" if column in LEVEL2[source] else None
