"""Registered queries on what decisions rest on, with SQL. The fixture has no sources, warnings and forecasts: they are made of keys and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from .decisions import scored, scored_sql
from .portfolio import UNIVERSE, universe

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_line(text: str, *figures: str) -> str:
    parts = text.split("%s")
    return " || ".join([_quoted(parts[0]), *[x for f, rest in zip(figures, parts[1:], strict=True) for x in (f, _quoted(rest))]])


def _if(test: str, line: str) -> str:
    return f"CASE WHEN {test} THEN {line} END"


_T = lambda c: f"printf('%.1f', round({c}, 1))"  # halves away from zero
_N = lambda c: f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"
_WARNINGS = "CASE WHEN {0} % 5 = 0 THEN ['Quotes are stale.', '', 'Quotes are stale.'] WHEN {0} % 7 = 0 THEN ['Thin volume.'] END"
_REASONS = [_if(f"{z} >= 0.5", _sql_line(t, _T(z))) for z, t in ev.REASONS] + [_if("dataConfidence >= 75 AND p_partkey % 3 > 0", _quoted(ev.SYNCED)), _if("p_partkey % 8 = 0", _quoted(ev.FUND))]
_FLAGS = [_if("dataConfidence < 45", _quoted(ev.LOW_CONFIDENCE)), _if("a.risk_z >= 0.8", _sql_line(ev.HIGH_RISK, _T("a.risk_z"))), _if("fragility_z <= -0.8", _sql_line(ev.FRAGILE, _T("fragility_z")))]
_FLAGS += [_if(f"{n} >= {least}", _sql_line(t, _N(n))) for n, least, t in ((("a." + n if n == "thesis_damage" else n), k, t) for n, k, t in ev.LEVELS)]
_BOTH = lambda test, pair: f"CASE WHEN {test} THEN {_quoted(pair[0])} ELSE {_quoted(pair[1])} END"
_ENDS = [_BOTH("relativeStrength >= 70", ev.INVALID["strength"]), _BOTH("revisionTrend >= 65", ev.INVALID["revisions"]), _if("skewRisk >= 58 OR impliedVolRank >= 58", _quoted(ev.INVALID["skew"])), _if("a.breadth <= 50", _quoted(ev.INVALID["breadth"]))]


@query(scored_sql("base") + f""", l AS (SELECT p_partkey, regime, list_filter([{', '.join(_REASONS)}], lambda x: x IS NOT NULL) AS reasons,
  list_concat(list_filter([{', '.join(_FLAGS)}], lambda x: x IS NOT NULL), {_WARNINGS.format('p_partkey')}) AS flags, list_filter([{', '.join(_ENDS)}], lambda x: x IS NOT NULL) AS ends FROM a JOIN scored USING (p_partkey)),
d AS (SELECT *, list_filter(flags, lambda x, i: list_position(flags, x) = i) AS told FROM l)
SELECT p_partkey, CASE WHEN len(reasons) = 0 THEN {_sql_line(ev.MIXED, "replace(regime, '-', ' ')")} ELSE array_to_string(reasons[1:4], ' | ') END AS reasons,
  CASE WHEN len(told) = 0 THEN {_quoted(ev.NO_FLAG)} ELSE array_to_string(told[1:4], ' | ') END AS risk_flags, array_to_string(ends[1:3], ' | ') AS invalidation FROM d""")
def signal_evidence(spark, sf_dir):
    key = F.col("p_partkey")
    stale = F.array(F.lit("Quotes are stale."), F.lit(""), F.lit("Quotes are stale."))
    rows = scored(spark, sf_dir, "base").withColumns({
        "dataSource": F.when(key % 3 == 0, "priors").otherwise("synced"), "assetType": F.when(key % 8 == 0, "ETF").otherwise("Stock"),
        "dataWarnings": F.when(key % 5 == 0, stale).when(key % 7 == 0, F.array(F.lit("Thin volume."))),
    })
    lists = ["reasons", "risk_flags", "invalidation"]
    return ev.signal_evidence(rows).select("p_partkey", *[F.array_join(c, " | ").alias(c) for c in lists])


_DAY = lambda c: f"CASE WHEN try_cast(nullif(regexp_extract({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS DATE) IS NOT NULL THEN left({c}, 10) END"
_SIGN = lambda c: f"CASE WHEN {c} >= 0 THEN '+' ELSE '' END || {_T(c)} || '%'"
_B = ev.BLOCKERS
_BLOCKERS = [
    _if("source IS NULL OR source <> 'ml'", _quoted(_B["source"])),
    _if("sure < 80", _sql_line(_B["confidence"], "CAST(CAST(floor(sure + 0.5) AS BIGINT) AS VARCHAR)")),
    f"CASE WHEN NOT filings THEN {_quoted(_B['filings'])} WHEN filed IS NULL THEN {_quoted(_B['filing day'])} END",
    _if("price IS NULL", _quoted(_B["price day"])),
    _if("NOT adjusted", _quoted(_B["basis"])),
    _if("filed > price", _sql_line(_B["order"], "filed", "price")),
    _if("stale", _quoted(_B["stale"])),
    _if("NOT has", _quoted(_B["forecast"])),
    _if("has AND NOT live", _quoted(_B["mode"])),
    f"CASE WHEN has AND made IS NULL THEN {_quoted(_B['forecast day'])} WHEN made <> price THEN {_sql_line(_B['days'], 'made', 'price')} END",
    f"CASE WHEN has AND NOT valid THEN {_quoted(_B['interval'])} WHEN valid AND direction = 'bullish' AND low <= 0 THEN {_quoted(_B['bullish'])} WHEN valid AND direction = 'bearish' AND high >= 0 THEN {_quoted(_B['bearish'])} END",
]


@query(UNIVERSE + f""", s AS (SELECT ticker, unnest(['bullish', 'bearish']) AS direction, CASE WHEN ticker % 9 > 0 THEN 'ml' END AS source, dataConfidence + 40 AS sure, ticker % 7 > 0 AS filings,
  CASE WHEN ticker % 13 = 0 THEN 'soon' WHEN ticker % 17 = 0 THEN '2024-05-30' ELSE '2024-02-1' || ticker % 10 END AS filed0, CASE WHEN ticker % 19 = 0 THEN '2024-02-30' ELSE '2024-03-01T00:00' END AS price0, ticker % 11 > 0 AS adjusted,
  ticker % 5 = 0 AS stale, ticker % 8 > 0 AS has, ticker % 6 > 0 AS live, CASE WHEN ticker % 23 = 0 THEN NULL WHEN ticker % 29 = 0 THEN '2024-02-29' ELSE '2024-03-01' END AS made0,
  (ticker * 37 % 121 - 60)::DOUBLE / 8 AS mid, (ticker * 37 % 121 - 60)::DOUBLE / 8 - ticker % 31 / 4 + 0.5 AS low, (ticker * 37 % 121 - 60)::DOUBLE / 8 + ticker % 31 / 4 AS high FROM u),
r AS (SELECT *, {_DAY('filed0')} AS filed, {_DAY('price0')} AS price, CASE WHEN has THEN {_DAY('made0')} END AS made, has AND low <= mid AND mid <= high AS valid FROM s),
b AS (SELECT *, list_filter([{', '.join(_BLOCKERS)}], lambda x: x IS NOT NULL) AS blockers FROM r)
SELECT ticker, direction, len(blockers) = 0 AS decision_grade, array_to_string(blockers, ' | ') AS blockers, CASE WHEN valid THEN '80% relative-return interval ' || {_SIGN('low')} || ' to ' || {_SIGN('high')} ELSE {_quoted(ev.UNKNOWN_INTERVAL)} END AS uncertainty,
  CASE WHEN ticker % 4 > 0 THEN 'feed' || CASE WHEN filings THEN ' + SEC EDGAR XBRL' ELSE '' END WHEN filings THEN 'SEC EDGAR XBRL' ELSE {_quoted(ev.UNKNOWN_SOURCE)} END AS evidence_source FROM b""")
def ml_evidence(spark, sf_dir):
    key = F.col("ticker")
    mid = (key * 37 % 121 - 60).cast("double") / 8
    forecast = F.struct(
        F.when(key % 6 > 0, ev.LIVE).otherwise("frozen").alias("normalizationMode"), F.when(key % 23 == 0, None).when(key % 29 == 0, "2024-02-29").otherwise("2024-03-01").alias("asOf"),
        mid.alias("predictedReturn20d"), (mid - key % 31 / 4 + 0.5).alias("p10Return20d"), (mid + key % 31 / 4).alias("p90Return20d"),
    )
    rows = universe(spark, sf_dir).withColumns({
        "verdictSource": F.when(key % 9 > 0, "ml"), "dataConfidence": F.col("dataConfidence") + 40, "fundamentalsSource": F.when(key % 7 > 0, ev.FILINGS),
        "fundamentalsAsOf": F.when(key % 13 == 0, "soon").when(key % 17 == 0, "2024-05-30").otherwise(F.concat(F.lit("2024-02-1"), (key % 10).cast("string"))),
        "priceAsOf": F.when(key % 19 == 0, "2024-02-30").otherwise("2024-03-01T00:00"), "priceBasis": F.when(key % 11 > 0, ev.ADJUSTED), "dataSource": F.when(key % 4 > 0, " feed "),
        "dataWarnings": F.when(key % 5 == 0, F.array(F.lit("Feed is STALE"), F.lit(" "))).otherwise(F.array(F.lit("stalemate"))), "forecast": F.when(key % 8 > 0, forecast),
    })
    out = None
    for direction in ("bullish", "bearish"):
        part = ev.ml_evidence(rows, direction).select("ticker", F.lit(direction).alias("direction"), "decision_grade", F.array_join("blockers", " | ").alias("blockers"), "uncertainty", "evidence_source")
        out = part if out is None else out.unionByName(part)
    return out
