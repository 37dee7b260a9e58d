"""Schemas of the research tables; readers declare them and never infer."""

from __future__ import annotations

BARS = "instrument_id string, ts date, open double, high double, low double, close double, volume double, adj_close double, source string, unadjusted_close double, delisting boolean"
ACTIONS = "instrument_id string, kind string, ex_date date, ratio double, amount double"
DELISTINGS = "instrument_id string, date date, delisting_return double"
INSTRUMENTS = "id string, symbol string, asset_class string, quote_asset string"
MEMBERSHIPS = "instrument_id string, start date, end date"
SIGNALS = "instrument_id string, ts date, direction string, strength double, weight double"
FINDINGS = "check string, level string, instrument_id string, day date, detail string"
TRADES = (
    "trade_id long, instrument_id string, side string, entry_ts date, entry_price double, exit_ts date, exit_price double, size double, "
    "gross_pnl double, costs double, net_pnl double, holding_days int, regime_at_entry string, open_at_end boolean"
)
