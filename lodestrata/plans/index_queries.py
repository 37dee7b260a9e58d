"""Registered queries of index histories, identity checks and stored pages, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit, index_history, prep
from ..sources import configs, files, html_tables
from .bars import ACTIONS, DELISTINGS, D, line_bars, literal, literal_sql, table
from .oracle import ID, STEPS, _r, _sql
from .queries import QUERIES, query, rounded

SQL: dict[str, str] = {}
SINCE, AS_OF = D("1995-01-01"), D("2001-12-31")
NOW = [("S0", "Zeroth Corp.", "1994-06-30"), ("S1", "First Company", "1999-06-01"), ("S2", "Second Trust", "July 1, 1999"), ("S3", "Third", ""), ("S4", "Fourth Limited", "1998-05-04"), ("S6", "Sixth Group", "Mar 6, 2000")]
CHANGES = [
    ("January 3, 2000", "S6", "Sixth Group Inc.", "S5", "Fifth Holdings"),
    ("1999-06-01 (a note)", "S1", "First Company", "S7", "Seventh plc"),
    ("March 2, 1998", "", "", "S1", "First Company Inc"),
    ("1998-03-02", "S2B", "Second Trust Corp", "S9", "Nine Ltd"),
    ("no date yet", "S8", "Eighth", "", ""),
    ("May 6, 1996", "S5", "Fifth Holdings Ltd", "S2B", "Second"),
    ("Sep 1, 1995", "S7", "Seventh", "S8", "Eight Corp"),
    ("1995-05-01", "S9", "Nine", "S4", "Fourth"),
    ("1994-01-03", "S0", "Zeroth", "S3", "Third"),
]
RENAMES = [(0, "S2B", "S2", D("1996-01-01"), D("1998-12-31")), (1, "S2B", "S2C", None, None)]
LISTINGS = [("S5", "Fifth Holdings Limited", "1995-02-01", "1999-12-31"), ("S7", "Seventh", "1994-01-03", "1999-01-04"), ("S9", "Another Firm", "1990-01-02", "2005-01-03")]


def _page() -> str:
    cells = lambda tag, r: "<tr>" + "".join(f"<{tag}>{c}" for c in r)
    now = "".join(cells("td", (f"<a href='/{s}'>{s}</a>", n, d)) for s, n, d in NOW)
    rows = "".join(cells("td", (d + "<sup>[1]</sup>", a, an, r, rn, "a reason")) for d, a, an, r, rn in CHANGES)
    head = "<tr><th rowspan=2>Effective Date<th colspan=2>Added<th colspan=2>Removed<th rowspan=2>Reason<tr><th>Ticker<th>Security<th>Ticker<th>Security"
    return f"<p>Text</p><table id=constituents><tr><th>Symbol<th>Security<th>Date added{now}</table><table id='changes'>{head}{rows}</table><table><tr><td>no id</table>"


def _pages(spark):
    return spark.createDataFrame([(1, _page())], "page_id long, html string")


def _renames(spark):
    return spark.createDataFrame(RENAMES, configs.RENAMES)


def _events(spark):
    return index_history.ticker_events(index_history.changes(_pages(spark)), _renames(spark))


def _reconstructed(spark):
    return index_history.reconstruct(index_history.constituents(_pages(spark)), _events(spark), SINCE, AS_OF)


def _day(c: str) -> str:
    return f"coalesce(try_strptime({c}, '%B %d, %Y'), try_strptime({c}, '%b %d, %Y'), try_strptime({c}[:10], '%Y-%m-%d'))::DATE"


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL::DATE' if x is None else f"DATE '{x}'" if isinstance(x, date) else str(x) if isinstance(x, int) else repr(x) for x in r) + ')' for r in rows)}) AS v({columns})"


STEPS["index_now"] = f"SELECT ticker, {_day('d')} AS date_added FROM ({_values([(s, d) for s, _, d in NOW], 'ticker, d')})"
STEPS["index_changes"] = f"SELECT position, {_day('d')} AS day, nullif(added, '') AS added, added_name, nullif(removed, '') AS removed, removed_name FROM ({_values([(i, *r) for i, r in enumerate(CHANGES)], 'position, d, added, added_name, removed, removed_name')})"
STEPS["index_renames"] = _values([(i, o, n, a, b) for i, o, n, a, b in RENAMES], 'position, old, new, "start", "end"')
STEPS["index_sides"] = "SELECT added AS t, day, position, 0 AS kind, added_name AS name FROM index_changes WHERE added IS NOT NULL AND day IS NOT NULL UNION ALL SELECT removed, day, position, 1, removed_name FROM index_changes WHERE removed IS NOT NULL AND day IS NOT NULL"
STEPS["index_events"] = """SELECT coalesce((SELECT arg_min(r.new, r.position) FROM index_renames r WHERE r.old = e.t AND (r."start" IS NULL OR r."start" <= e.day) AND (r."end" IS NULL OR e.day <= r."end")), e.t) AS ticker, day, position, kind, name FROM index_sides e"""
STEPS["index_queue"] = f"SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC, position, kind) AS i FROM index_events WHERE day > DATE '{SINCE}' AND day <= DATE '{AS_OF}'"
STEPS["index_walk"] = """SELECT ticker, 0::BIGINT AS i, ticker IN (SELECT ticker FROM index_now) AS inside, NULL::DATE AS until, NULL::VARCHAR AS what, NULL::DATE AS day, NULL::DATE AS closed, NULL::VARCHAR AS name FROM (SELECT ticker FROM index_now UNION SELECT ticker FROM index_queue)
  UNION ALL SELECT w.ticker, q.i, CASE WHEN q.kind = 1 THEN TRUE WHEN w.inside AND (w.until IS NULL OR w.until >= q.day) THEN FALSE ELSE w.inside END,
    CASE WHEN q.kind = 1 AND NOT w.inside THEN q.day - 1 WHEN q.kind = 0 AND w.inside AND (w.until IS NULL OR w.until >= q.day) THEN NULL ELSE w.until END,
    CASE WHEN q.kind = 0 THEN CASE WHEN w.inside AND (w.until IS NULL OR w.until >= q.day) THEN 'period' ELSE 'added_but_not_in_index' END WHEN w.inside THEN 'removed_but_still_in_index' END,
    q.day, CASE WHEN q.kind = 0 AND w.inside AND (w.until IS NULL OR w.until >= q.day) THEN w.until END, q.name FROM index_walk w JOIN index_queue q ON q.ticker = w.ticker AND q.i = w.i + 1"""
STEPS["index_raw"] = f"SELECT ticker, day AS \"start\", closed AS \"end\" FROM index_walk WHERE what = 'period' UNION ALL SELECT ticker, DATE '{SINCE}', until FROM (SELECT ticker, arg_max(inside, i) AS inside, arg_max(struct_pack(u := until), i).u AS until FROM index_walk GROUP BY 1) WHERE inside"
STEPS["index_starts"] = f"""SELECT n.ticker, n.date_added, p."start", CASE WHEN n.date_added <= e.last THEN 'date_added_mismatches' ELSE 'started_at_date_added' END AS what FROM index_now n
  JOIN (SELECT *, min("start") OVER (PARTITION BY ticker, island) AS chain FROM (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY "start") AS island FROM (SELECT *, CASE WHEN lag("end") OVER (PARTITION BY ticker ORDER BY "start") + 1 = "start" THEN 0 ELSE 1 END AS fresh FROM index_raw))) p ON p.ticker = n.ticker AND p."end" IS NULL
  LEFT JOIN (SELECT ticker, max("end") AS last FROM index_raw GROUP BY 1) e ON e.ticker = n.ticker WHERE n.date_added > DATE '{SINCE}' AND n.date_added <= DATE '{AS_OF}' AND n.date_added <> p."start" AND n.date_added <> p.chain"""
STEPS["index_spans"] = """SELECT r.ticker, CASE WHEN r."end" IS NULL THEN coalesce(s.date_added, r."start") ELSE r."start" END AS "start", r."end" FROM index_raw r LEFT JOIN index_starts s ON s.ticker = r.ticker AND s.what = 'started_at_date_added'"""


@query
def html_table_rows(spark, sf_dir):
    """Tables of nations by region, one page a region: parsed back from HTML that is made of the tables."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat(F.lit("<tr><td>"), "n_name", F.lit("<sup>*</sup><td>"), F.col("n_nationkey").cast("string"), F.lit("</tr>")).alias("row"))
    body = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]), "").alias("body"), F.count("*").alias("k"))
    html = F.concat(F.lit("<table id=nations><tr><th rowspan=1>Region<th>Name<th>Key</tr><tr><td rowspan="), (F.col("k") + 1).cast("string"), F.lit(">R"), F.col("n_regionkey").cast("string"), F.lit("<td colspan=2>all</tr>"), "body", F.lit("</table>"))
    rows = html_tables.named_rows(body.select(F.col("n_regionkey").cast("long").alias("page_id"), html.alias("html")))
    return rows.select("key", "table_id", F.array_join("columns", ",").alias("columns"), "row_no", F.array_join("cells", "|").alias("cells"))


SQL["html_table_rows"] = """SELECT n_regionkey::BIGINT AS key, 'nations' AS table_id, 'region,name,key' AS columns, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row_no, 'R' || n_regionkey || '|' || n_name || '|' || n_nationkey AS cells FROM nation
  UNION ALL SELECT DISTINCT n_regionkey::BIGINT, 'nations', 'region,name,key', 0, 'R' || n_regionkey || '|all|all' FROM nation"""


@query
def index_constituents(spark, sf_dir):
    return index_history.constituents(_pages(spark))


SQL["index_constituents"] = "SELECT * FROM index_now"


@query
def index_changes(spark, sf_dir):
    return index_history.changes(_pages(spark)).drop("raw")


SQL["index_changes"] = "SELECT position::INT AS position, day, added, added_name, removed, removed_name FROM index_changes"


@query
def unreadable_changes(spark, sf_dir):
    return index_history.changes(_pages(spark)).where("day is null").select("raw")


SQL["unreadable_changes"] = f"SELECT array_to_string(list_filter([d, added, added_name, removed, removed_name, 'a reason'], lambda x: x <> ''), ' | ') AS raw FROM ({_values(CHANGES, 'd, added, added_name, removed, removed_name')}) WHERE {_day('d')} IS NULL"


@query
def renamed_tickers(spark, sf_dir):
    return _events(spark)


SQL["renamed_tickers"] = "SELECT ticker, day, position::INT AS position, kind::INT AS kind, name FROM index_events"


@query
def index_memberships(spark, sf_dir):
    return _reconstructed(spark)[0]


SQL["index_memberships"] = "SELECT * FROM index_spans"


@query
def index_findings(spark, sf_dir):
    return _reconstructed(spark)[1]


SQL["index_findings"] = """SELECT what, ticker, day, NULL::DATE AS other, name FROM index_walk WHERE what <> 'period' UNION ALL SELECT what, ticker, date_added, "start", '' FROM index_starts
  UNION ALL SELECT 'several_periods', ticker, NULL, NULL, '' FROM index_spans GROUP BY ticker HAVING count(*) > 1"""


@query
def index_universe(spark, sf_dir):
    return index_history.universe_tables(_reconstructed(spark)[0], "SPY")[0]


SQL["index_universe"] = "SELECT lower(t) AS id, t AS symbol, 'equity' AS asset_class, 'USD' AS quote_asset FROM (SELECT DISTINCT ticker AS t FROM index_spans UNION SELECT 'SPY')"


@query
def security_names(spark, sf_dir):
    return index_history.security_names(_events(spark)).select("ticker", F.array_join("names", "; ").alias("names"))


SQL["security_names"] = "SELECT ticker, string_agg(name, '; ' ORDER BY day, position, kind) AS names FROM (SELECT ticker, name, min(day) AS day, arg_min(position, (day, position, kind)) AS position, arg_min(kind, (day, position, kind)) AS kind FROM index_events WHERE name <> '' GROUP BY 1, 2) GROUP BY 1"


def _audited(spark):
    spans, _ = _reconstructed(spark)
    last = F.max(F.coalesce("end", F.lit(AS_OF)))
    members = spans.groupBy(F.col("ticker").alias("symbol")).agg(F.min("start").alias("first_day"), last.alias("last_day"), F.count(F.when(F.col("end").isNull(), 1)).alias("open")).where("open = 0").drop("open")
    bodies = [(s, '{"name": "%s", "startDate": "%sT00:00:00.000Z", "endDate": "%s"}' % r) for s, *r in ((x[0], *x[1:]) for x in LISTINGS) for r in [tuple(r)]] + [("S8", '{"detail": "Not found."}')]
    found = configs.listings(spark.createDataFrame(bodies, "symbol string, body string"))
    return audit.ticker_audit(members, found, index_history.security_names(_events(spark)).withColumnRenamed("ticker", "symbol"))


@query
def ticker_audit(spark, sf_dir):
    return rounded(audit.review_order(_audited(spark)).withColumn("flags", F.array_join("flags", "; ")))


_WORDS = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda x: NOT list_contains([{', '.join(repr(w) for w in scalars.LEGAL_FORMS)}], x))"
SQL["ticker_audit"] = f"""SELECT symbol, name, {_r('similarity')}, CASE WHEN name IS NULL THEN 'unknown to the source' ELSE array_to_string(list_filter([CASE WHEN similarity IS NULL THEN 'no name in the index''s table' WHEN similarity = 0 THEN 'name differs' WHEN similarity < 1 THEN 'name partly differs' END,
    CASE WHEN s > first_day THEN 'prices start after membership' END, CASE WHEN e < last_day - 7 THEN 'prices end before membership' END], lambda x: x IS NOT NULL), '; ') END AS flags FROM (
  SELECT m.*, l.name, l.s::DATE AS s, l.e::DATE AS e, (SELECT max(CASE WHEN len({_WORDS('v.name')}) > 0 AND len({_WORDS('l.name')}) > 0 THEN len(list_intersect({_WORDS('v.name')}, {_WORDS('l.name')})) / len(list_distinct(list_concat({_WORDS('v.name')}, {_WORDS('l.name')}))) ELSE 0.0 END) FROM index_events v WHERE v.ticker = m.symbol AND v.name <> '' AND l.name IS NOT NULL) AS similarity
  FROM (SELECT ticker AS symbol, min("start") AS first_day, max(coalesce("end", DATE '{AS_OF}')) AS last_day FROM index_spans GROUP BY 1 HAVING count(*) = count("end")) m LEFT JOIN ({_values(LISTINGS, 'symbol, name, s, e')}) l ON l.symbol = m.symbol)"""


@query
def member_medians(spark, sf_dir):
    return rounded(audit.member_medians(line_bars(spark, sf_dir), literal(spark, "memberships")), 4)


SQL["member_medians"] = f"""SELECT instrument_id, {_r('median_close median_dollar_volume', 4)} FROM (SELECT instrument_id, quantile_cont(close, 0.5) AS median_close, quantile_cont(close * volume, 0.5) AS median_dollar_volume FROM line_bars b WHERE EXISTS (SELECT 1 FROM memberships m WHERE m.instrument_id = b.instrument_id AND m."start" <= b.ts AND (m."end" IS NULL OR b.ts <= m."end")) GROUP BY 1)"""


def _market(spark, sf_dir):
    return prep.with_events(line_bars(spark, sf_dir), literal(spark, "actions"), literal(spark, "delistings"), 0.0)


@query
def bars_with_events(spark, sf_dir):
    m = _market(spark, sf_dir).where("instrument_id in ('s0', 's6', 's7')")
    return rounded(m.select("instrument_id", "ts", "close", "volume", "unadjusted_close", "delisting", "assumed"), 4)


STEPS["adjusted"] = "SELECT b.instrument_id, b.ts, b.close * coalesce((SELECT product(pf) FROM factors f WHERE f.instrument_id = b.instrument_id AND f.first_after > b.ts), 1) AS close, b.volume * coalesce((SELECT product(vf) FROM factors f WHERE f.instrument_id = b.instrument_id AND f.first_after > b.ts), 1) AS volume, b.close AS raw FROM line_bars b"
STEPS["ended"] = """SELECT d.instrument_id, coalesce((SELECT min(ts) FROM sessions s WHERE s.ts >= d."date"), d."date") AS ts, d.delisting_return IS NULL AS assumed, arg_max(a.close, a.ts) AS last, arg_max(a.raw, a.ts) AS last_raw, any_value(d.delisting_return) AS rate FROM delistings d JOIN adjusted a ON a.instrument_id = d.instrument_id GROUP BY d.instrument_id, d."date", d.delisting_return"""
_ENDED = lambda rate: f"SELECT instrument_id, ts, close, volume, raw, FALSE AS delisting, FALSE AS assumed FROM adjusted UNION ALL SELECT instrument_id, ts, last * (1 + {rate}), 0.0, last_raw * (1 + {rate}), TRUE, assumed FROM ended"
SQL["bars_with_events"] = f"SELECT instrument_id, ts, {_r('close volume unadjusted_close=raw', 4)}, delisting, assumed FROM ({_ENDED('coalesce(rate, 0.0)')}) WHERE instrument_id IN ('s0', 's6', 's7')"


@query
def assumed_delistings(spark, sf_dir):
    return rounded(prep.with_assumed_return(_market(spark, sf_dir), -0.3).where("delisting").select("instrument_id", "ts", "close", "unadjusted_close", "assumed"), 4)


SQL["assumed_delistings"] = f"SELECT instrument_id, ts, {_r('close unadjusted_close=raw', 4)}, assumed FROM ({_ENDED('coalesce(rate, -0.3)')}) WHERE delisting"


@query
def known_bars(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    return prep.known_through(bars, prep.sessions(bars).where(F.dayofmonth("ts") == 15))


SQL["known_bars"] = "SELECT i.instrument_id, s.ts, count(b.ts) AS known FROM (SELECT DISTINCT instrument_id FROM line_bars) i CROSS JOIN (SELECT ts FROM sessions WHERE day(ts) = 15) s LEFT JOIN line_bars b ON b.instrument_id = i.instrument_id AND b.ts <= s.ts GROUP BY 1, 2"


@query
def calendar_days(spark, sf_dir):
    return prep.reference_sessions(line_bars(spark, sf_dir), True)


SQL["calendar_days"] = "SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS ts FROM (SELECT min(ts) AS a, max(ts) AS b FROM line_bars)"


@query
def forward_filled(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    return rounded(prep.forward_filled(bars, prep.sessions(bars)), 4)


STEPS["filled"] = "SELECT i.instrument_id, s.ts, b.close FROM (SELECT instrument_id, min(ts) AS first FROM line_bars GROUP BY 1) i JOIN sessions s ON s.ts >= i.first ASOF JOIN line_bars b ON b.instrument_id = i.instrument_id AND b.ts <= s.ts"
SQL["forward_filled"] = f"SELECT instrument_id, ts, {_r('close', 4)} FROM filled"


@query
def parsed_dates(spark, sf_dir):
    """Order dates written in three ways and one that is no date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("d", "MMMM d, yyyy")).when(k == 1, F.date_format("d", "MMM d, yyyy")).when(k == 2, F.concat(F.col("d").cast("string"), F.lit(" or so"))).otherwise(F.lit("soon"))
    return o.select("o_orderkey", scalars.parse_date(text).alias("day"))


SQL["parsed_dates"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS day FROM orders"


@query
def bars_json_round_trip(spark, sf_dir):
    return configs.bars_from_json(configs.bars_to_json(line_bars(spark, sf_dir))).select("instrument_id", "ts", "close", "delisting")


SQL["bars_json_round_trip"] = "SELECT instrument_id, ts, close, FALSE AS delisting FROM line_bars"


@query
def latest_bars(spark, sf_dir):
    """The union of two versions of bars; the newer has other prices for days of 1997."""
    old = line_bars(spark, sf_dir).select("instrument_id", "ts", "close")
    return files.latest(old.where("ts < '1998-01-01'"), old.where("ts >= '1997-01-01'").withColumn("close", F.col("close") * 2))


SQL["latest_bars"] = "SELECT instrument_id, ts, CASE WHEN ts < DATE '1997-01-01' THEN close ELSE close * 2 END AS close FROM line_bars"

for _n, _s in SQL.items():
    SQL[_n] = _sql(_s)
