"""Configuration and response files as values and small tables: definitions, corrections, universes, listings."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.studies import STUDIES, Costs, Definition, Portfolio

RENAMES = "position int, old string, new string, start date, end date"


def _yaml(text: str) -> Any:
    import yaml

    return yaml.safe_load(text)


def definition_from_yaml(text: str, load: Callable[[str], Definition] | None = None) -> Definition:
    """A frozen definition; load: gives the definitions that a portfolio's components name."""
    raw = _yaml(text)
    own = dict(raw["parameters"])
    kind, where, costs, missing = own.pop("strategy"), own.pop("universe"), own.pop("cost_model"), own.pop("missing_delisting_return", None)
    if kind not in STUDIES:
        raise ValueError(f"unknown strategy {kind}")
    requires: tuple[str, ...] = ()
    if STUDIES[kind] is Portfolio:
        parts = {n: load(n) for n in own["components"]}
        if odd := sorted(n for n, d in parts.items() if d.universe != where):
            raise ValueError(f"components of another universe: {odd}")
        own["components"] = tuple((n, d.study, d.costs) for n, d in parts.items())
        requires = tuple(n for n, d in parts.items() if d.holdout[0] <= raw["end"] and raw["start"] <= d.holdout[1])
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in own.items()}
    goal = raw.get("success_criterion", {})
    return Definition(
        raw["hypothesis"], where, STUDIES[kind](**own), Costs(**costs), (raw["training_start"], raw["training_end"]), (raw["start"], raw["end"]), missing,
        goal.get("min_sharpe", 0.0), goal.get("max_p_value", 0.05), goal.get("description", ""), requires,
    )


def definitions_table(spark: SparkSession, definitions: list[Definition], registered: dict[str, date], deleted: set[str] = frozenset()) -> DataFrame:
    rows = [(d.hypothesis, type(d.study).__name__, d.universe, d.costs.name, *d.training, *d.holdout, d.description, d.study.configurations, registered[d.hypothesis], d.hypothesis in deleted) for d in definitions]
    return spark.createDataFrame(rows, "hypothesis string, study string, universe string, cost_model string, training_start date, training_end date, start date, end date, criterion string, configurations int, registered_at date, deleted boolean")


def _text(x: Any, what: str) -> str:
    if not isinstance(x, str):
        raise ValueError(f"{what}: {x!r} is no text (a ticker like ON needs quotes)")
    return x


def renames_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    """Ticker corrections in their order: the first that covers a day counts."""
    rows = [(i, _text(r["old"], "old"), _text(r["new"], "new"), r.get("start"), r.get("end")) for i, r in enumerate(_yaml(text)["renames"])]
    return spark.createDataFrame(rows, RENAMES)


def not_in_source_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(_text(t, "ticker").lower(),) for t in _yaml(text)["not_in_source"]], "instrument_id string")


def universe_to_yaml(name: str, instruments: DataFrame, memberships: DataFrame, periods_per_year: int, market_proxy: str, header: str) -> str:
    """A universe as a file with its provenance as a comment. A universe has a few thousand rows, as its file has."""
    import yaml

    spans = [{k: v for k, v in zip(("instrument_id", "start", "end"), r, strict=True) if v is not None} for r in memberships.select("instrument_id", "start", "end").orderBy("instrument_id", "start").toLocalIterator()]
    ids = [r.asDict() for r in instruments.select("id", "symbol", "asset_class", "quote_asset").orderBy("id").toLocalIterator()]
    body = yaml.safe_dump({"name": name, "periods_per_year": periods_per_year, "market_proxy": market_proxy, "instruments": ids, "memberships": spans}, sort_keys=False)
    return "".join(f"# {line}\n" for line in header.splitlines()) + body


def listings(responses: DataFrame) -> DataFrame:
    """(symbol, name, start, end) from a source's company metadata (symbol, body); an unknown ticker has no row."""
    meta = F.from_json("body", "name string, startDate string, endDate string")
    rows = responses.withColumn("m", meta).where("m.name is not null")
    return rows.select("symbol", F.col("m")["name"].alias("name"), *[F.to_date(F.substring(F.col("m")[k], 1, 10)).alias(n) for k, n in (("startDate", "start"), ("endDate", "end"))])


def settled(last_day: Column, asked_on: Column, end: Column) -> Column:
    """Whether a cached last price date is final: it was asked for over a week after the end, or it lies at the end or later."""
    return (F.datediff(asked_on, end) > 7) | (last_day >= end)


def rendered_pages(responses: DataFrame) -> DataFrame:
    """(page_id, html) from stored responses (page_id, body) of a wiki's parse call."""
    return responses.select("page_id", F.from_json("body", "parse struct<text:string>")["parse"]["text"].alias("html"))


def bars_to_json(bars: DataFrame) -> DataFrame:
    """(body): each bar as a JSON object."""
    return bars.select(F.to_json(F.struct(*bars.columns)).alias("body"))


def bars_from_json(lines: DataFrame) -> DataFrame:
    """Bars from JSON objects; fields that older dumps lack are null, and no bar of theirs is a delisting."""
    from .schemas import BARS

    r = lines.select(F.from_json("body", BARS).alias("b")).select("b.*")
    return r.withColumn("delisting", F.coalesce("delisting", F.lit(False)))
