"""What a decision rests on: reasons, risk flags and invalidations of a signal, and whether a model's direction is of decision grade.

All are projections over scored rows, so they add no shuffle. Absent columns and nulls count as not reported. A list has
no nulls; where nothing is to be told it has the one line that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import js_round

MOST_LINES, CLEAR_Z, RISKY_Z = 4, 0.5, 0.8
DECISION_GRADE, SURE, UNSURE = 80, 75, 45
FILINGS, ADJUSTED, LIVE = "sec-edgar-xbrl", "adjusted-total-return", "cross-sectional-live"
# Lines of the lists, with %s for the figure.
REASONS = (
    ("momentum_z", "Momentum factor +%sσ — leading the universe on trend + relative strength."),
    ("growth_z", "Growth factor +%sσ — revisions, surprise, and revenue acceleration above peers."),
    ("quality_z", "Quality factor +%sσ — margins, FCF, and balance sheet rank top quartile."),
    ("value_z", "Value factor +%sσ — valuation support above the universe median."),
    ("lowVol_z", "Low-vol factor +%sσ — drawdown risk and realized vol below peers."),
)
SYNCED, FUND, MIXED = "Price-derived signals are backed by synced daily OHLCV.", "ETF structure lowers single-name event risk.", "Mixed factor profile in a %s regime — no factor clears 0.5σ."
LOW_CONFIDENCE, NO_FLAG = "Price-history confidence is low.", "No major deterioration cluster yet."
HIGH_RISK, FRAGILE = "Composite risk +%sσ above universe — top decile of risk.", "Fragility factor %sσ — high skew + crowding cluster."
LEVELS = (
    ("impliedVolRank", 65, "Implied vol rank %s — options market pricing wide outcomes."),
    ("skewRisk", 64, "Put skew %s — institutions buying downside protection."),
    ("crowding", 68, "Crowding %s — limited marginal buyer."),
    ("thesis_damage", 60, "Thesis damage %s — factor decay in momentum/growth/quality."),
)
INVALID = {
    "strength": ("Relative strength falls below peer group for 10 trading days.", "Relative strength fails to reclaim the sector median."),
    "revisions": ("Positive revisions flatten or turn negative.", "Revision trend keeps deteriorating into the next refresh."),
    "skew": "Put skew steepens again without price confirmation.",
    "breadth": "Sector breadth remains below confirmation level.",
}
BLOCKERS = {
    "scenario": "hypothetical scenario, not a live action",
    "source": "verdict is not ML-led",
    "confidence": f"data confidence %s is below the existing decision-grade gate ({DECISION_GRADE})",
    "filings": "SEC XBRL fundamentals are unavailable",
    "filing day": "SEC filing as-of date is unavailable",
    "price day": "price as-of date is unavailable",
    "basis": "current analytical price window is not proven adjusted-total-return",
    "order": "SEC filing date %s is later than price date %s",
    "stale": "price feed reports stale data",
    "forecast": "live ML forecast is unavailable",
    "mode": "ML forecast used unvalidated frozen-normalization fallback",
    "forecast day": "ML forecast as-of date is unavailable",
    "days": "ML forecast date %s does not match price date %s",
    "interval": "calibrated 80% ML interval is unavailable or malformed",
    "bullish": "80% ML interval includes no peer outperformance",
    "bearish": "80% ML interval includes no peer underperformance",
}
UNKNOWN_INTERVAL, UNKNOWN_SOURCE = "80% ML interval unavailable", "source not reported"


def _of(rows: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)


def _line(text: str, *figures: Column) -> Column:
    """text with each %s replaced by a figure's string."""
    parts = text.split("%s")
    out = [F.lit(parts[0])]
    for figure, rest in zip(figures, parts[1:], strict=True):
        out += [figure, F.lit(rest)]
    return F.concat(*out)


def _tenth(x: Column) -> Column:
    return F.format_string("%.1f", x)


def _signed(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), _tenth(x), F.lit("%"))


def _figure(x: Column) -> Column:
    """A number without a point if it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def _list(lines: list[Column], more: Column | None = None) -> Column:
    found = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return found if more is None else F.array_distinct(F.concat(found, F.filter(F.coalesce(more, F.array().cast("array<string>")), lambda x: x.isNotNull())))


def _or_one(lines: Column, one: Column, most: int = MOST_LINES) -> Column:
    return F.when(F.size(lines) > 0, F.slice(lines, 1, most)).otherwise(F.array(one))


def signal_evidence(rows: DataFrame) -> DataFrame:
    """rows with ``reasons``, ``risk_flags`` and ``invalidation``.

    rows: output of the scores (factor z's, risk_z, thesis_damage, regime) with dataConfidence, and if they are there
    dataSource, assetType and dataWarnings (strings). Without a confidence reasons count it as 0 and flags as 65.
    """
    source, sure = _of(rows, "dataSource", "string"), F.col("dataConfidence")
    reasons = [F.when(F.col(z) >= CLEAR_Z, _line(text, _tenth(F.col(z)))) for z, text in REASONS]
    reasons.append(F.when((sure >= SURE) & (source != "") & (source != "priors"), SYNCED))
    reasons.append(F.when(_of(rows, "assetType", "string") == "ETF", FUND))
    flags = [
        F.when(F.coalesce(sure, F.lit(65.0)) < UNSURE, LOW_CONFIDENCE),
        F.when(F.col("risk_z") >= RISKY_Z, _line(HIGH_RISK, _tenth(F.col("risk_z")))),
        F.when(F.col("fragility_z") <= -RISKY_Z, _line(FRAGILE, _tenth(F.col("fragility_z")))),
        *[F.when(F.col(name) >= least, _line(text, _figure(F.col(name)))) for name, least, text in LEVELS],
    ]
    pick = lambda test, pair: F.when(test, pair[0]).otherwise(pair[1])
    ends = [
        pick(F.col("relativeStrength") >= 70, INVALID["strength"]), pick(F.col("revisionTrend") >= 65, INVALID["revisions"]),
        F.when((F.col("skewRisk") >= 58) | (F.col("impliedVolRank") >= 58), INVALID["skew"]), F.when(F.col("breadth") <= 50, INVALID["breadth"]),
    ]
    return rows.withColumns({
        "reasons": _or_one(_list(reasons), _line(MIXED, F.regexp_replace("regime", "-", " "))),
        "risk_flags": _or_one(_list(flags, _of(rows, "dataWarnings", "array<string>")), F.lit(NO_FLAG)),
        "invalidation": F.slice(_list(ends), 1, 3),
    })


def iso_day(value: Column) -> Column:
    """The calendar day that a text begins with, as text; null for another or one that does not exist."""
    day = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull(), day)


def ml_evidence(rows: DataFrame, direction: str, scenario: str = "base") -> DataFrame:
    """rows with ``decision_grade``, ``blockers`` (why not), ``evidence_source``, ``uncertainty`` and ``caveats`` of a model's direction.

    rows: verdictSource, dataConfidence, fundamentalsSource, fundamentalsAsOf, priceAsOf, priceBasis, dataSource, dataWarnings,
    and forecast, a struct of normalizationMode, asOf, predictedReturn20d, p10Return20d and p90Return20d or null.
    A bullish direction wants the whole interval above zero, a bearish one below.
    """
    if direction not in ("bullish", "bearish"):
        raise ValueError("direction is bullish or bearish")
    caveats = F.filter(F.coalesce(_of(rows, "dataWarnings", "array<string>"), F.array().cast("array<string>")), lambda w: F.trim(w) != "")
    price, filed, made = iso_day(F.col("priceAsOf")), iso_day(F.col("fundamentalsAsOf")), iso_day(F.col("forecast.asOf"))
    sure, has = F.coalesce("dataConfidence", F.lit(0.0)), F.col("forecast").isNotNull()
    low, mid, high = (F.col(f"forecast.{k}") for k in ("p10Return20d", "predictedReturn20d", "p90Return20d"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = finite(low) & finite(mid) & finite(high) & (low <= mid) & (mid <= high)
    filings = F.coalesce(F.col("fundamentalsSource") == FILINGS, F.lit(False))
    not_that = lambda c, value: ~F.coalesce(F.col(c) == value, F.lit(False))
    say = BLOCKERS
    blockers = [
        F.when(F.lit(scenario != "base"), say["scenario"]),
        F.when(not_that("verdictSource", "ml"), say["source"]),
        F.when(sure < DECISION_GRADE, _line(say["confidence"], js_round(sure).cast("string"))),
        F.when(~filings, say["filings"]).when(filed.isNull(), say["filing day"]),
        F.when(price.isNull(), say["price day"]),
        F.when(not_that("priceBasis", ADJUSTED), say["basis"]),
        F.when(filed > price, _line(say["order"], filed, price)),
        F.when(F.exists(caveats, lambda w: w.rlike(r"(?i)\bstale\b")), say["stale"]),
        F.when(~has, say["forecast"]),
        F.when(has & not_that("forecast.normalizationMode", LIVE), say["mode"]),
        F.when(has & made.isNull(), say["forecast day"]).when(made != price, _line(say["days"], made, price)),
        F.when(has & ~valid, say["interval"]).when(valid & (low <= 0 if direction == "bullish" else high >= 0), say[direction]),
    ]
    source = F.when(F.trim("dataSource") != "", F.trim("dataSource"))
    named = F.concat_ws(" + ", source, F.when(filings, "SEC EDGAR XBRL"))
    out = rows.withColumns({
        "blockers": _list(blockers), "evidence_source": F.when(named != "", named).otherwise(UNKNOWN_SOURCE), "caveats": caveats,
        "uncertainty": F.when(valid, F.concat(F.lit("80% relative-return interval "), _signed(low), F.lit(" to "), _signed(high))).otherwise(UNKNOWN_INTERVAL),
    })
    return out.withColumn("decision_grade", F.size("blockers") == 0)
