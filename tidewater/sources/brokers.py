"""Holdings from brokers' files: each body is sniffed for its header and format, split at quotes as expressions, and told what was skipped.

A body is one string, as the header above its rows decides what they mean; files are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER, parse_number, sanitize_ticker

#: A record behind a line break and a field behind a comma: plain runs and quoted sections by turns, in linear time.
RECORD = r'[\r\n]([^"\r\n]*+(?:"[^"]*+"?+[^"\r\n]*+)*+)'
FIELD = r',([^",]*+(?:"[^"]*+"?+[^",]*+)*+)'
SECTION = r'"((?:[^"]++|"")*+)"?+'
BLANKS = " \t\r\n\f\v ﻿"

# Names of columns in brokers' exports, and symbols that are no holding.
SYMBOLS = ("symbol", "ticker", "security", "symbol/cusip", "instrument")
QUANTITIES = ("quantity", "shares", "qty", "quantity #", "shares owned", "units", "shares held")
COSTS = ("average cost basis", "avg cost", "avg cost basis", "cost basis per share", "price paid", "price paid $", "average cost", "cost/share", "cost per share", "avg price", "purchase price")
TOTALS = ("total cost", "cost basis total", "cost basis", "total cost basis")
NO_HOLDING = ("cash", "total", "subtotal", "pending", "pending activity", "spaxx**", "spaxx", "fdrxx", "fzfxx")
FORMATS = {"fidelity": ("account number", "average cost basis"), "schwab": ("day change $", "cost basis"), "etrade": ("quantity #", "price paid"), "robinhood": ("average cost", "total cost")}
# The same for position exports, whose names are told by their letters and digits alone.
POSITIONS = {
    "symbol": ("symbol", "ticker", "tickersymbol"),
    "shares": ("quantity", "qty", "shares", "sharequantity", "currentquantity"),
    "current_value": ("currentvalue", "marketvalue", "positionvalue", "value"),
    "current_price": ("lastprice", "price", "currentprice", "marketprice"),
    "description": ("description", "securitydescription", "name"),
    "type": ("type", "securitytype", "assettype"),
    "average_cost": ("averagecostbasis", "averagecost", "avgcost", "costbasispershare", "costpershare", "unitcost"),
    "total_cost": ("costbasistotal", "totalcostbasis", "totalcost", "costbasis"),
}
POSITION_HEADS = ("symbol", "ticker", "quantity", "shares")
HEAD_LINES = 6


def bare(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def cells(record: Column) -> Column:
    """Fields of a record without their blanks: quotes shield commas and are dropped, doubled ones in a quoted section are one."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1))
    return F.transform(fields, lambda x: bare(F.replace(F.regexp_replace(x, SECTION, "$1"), F.lit('""'), F.lit('"'))))


def records(body: Column) -> Column:
    """Records of a body that are not blank; a quoted section may hold line breaks."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), body), F.lit(RECORD), F.lit(1))
    return F.filter(F.transform(found, cells), lambda r: F.exists(r, lambda c: c != ""))


def lines(body: Column) -> Column:
    """The same where every line break ends a record; lines with tabs and no comma are cut at tabs."""
    kept = F.filter(F.split(body, r"\r?\n"), lambda x: bare(x) != "")
    return F.transform(kept, lambda x: F.when(x.contains("\t") & ~x.contains(","), F.transform(F.split(x, "\t"), bare)).otherwise(cells(x)))


def stored(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns added behind an explode of one row, which keeps their expressions from being copied into each use."""
    name = "_" + "_".join(columns)
    return df.withColumn(name, F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))).select("*", f"{name}.*").drop(name)


def _place(names: Column, wanted) -> Column:
    """Place of the first name that is one of the wanted, from 1; 0 if none."""
    return F.array_position(F.transform(names, lambda c: c.isin(*wanted)), True)


def broker_rows(raw: DataFrame, multiline: bool = False) -> DataFrame:
    """Every data row of broker files (file, body): file, format, columns, place, ticker, shares, average_cost, status.

    The header is the first of the leading HEAD_LINES records that names a symbol and a quantity; a body without one is a
    pasted list: symbol, shares, cost. status: kept, skipped (no symbol, no holding, or in a file no number of shares) or
    duplicate (the file told the symbol before). A file without data rows has one row without place and status. A null
    body is an empty one. Shares below 0 are 0; the cost is null unless positive, and total / shares where only that is
    told. multiline: line breaks in quotes belong to their field.
    """
    body = F.coalesce("body", F.lit(""))
    told = stored(raw.select("file", bare(body).alias("body")), rows=(records if multiline else lines)(F.col("body")))

    def head(row: Column, i: Column) -> Column:
        names = F.transform(row, F.lower)
        joined = F.array_join(names, "|")
        kind = F.lit("generic-csv")
        for name, marks in reversed(FORMATS.items()):
            kind = F.when(joined.contains(marks[0]) & joined.contains(marks[1]), name).otherwise(kind)
        found = {"symbol": SYMBOLS, "quantity": QUANTITIES, "cost": COSTS, "total": TOTALS}
        return F.struct(i.alias("i"), row.alias("columns"), kind.alias("format"), *[_place(names, of).alias(k) for k, of in found.items()])

    heads = F.filter(F.transform(F.slice("rows", 1, HEAD_LINES), head), lambda h: (F.size(h["columns"]) >= 2) & (h["symbol"] > 0) & (h["quantity"] > 0))
    told = stored(told, head=F.get(heads, F.lit(0)))
    is_file = F.col("head").isNotNull()
    data = F.when(is_file, F.slice("rows", F.col("head.i") + 2, F.size("rows"))).otherwise(F.col("rows"))
    told = told.select("file", F.coalesce("head.format", F.lit("paste")).alias("format"), F.col("head.columns").alias("columns"), "head", F.posexplode_outer(data).alias("place", "row"))
    row = F.when(is_file | (F.size("row") > 1), F.col("row")).otherwise(F.filter(F.split(F.get("row", F.lit(0)), r"\s+"), lambda x: x != ""))
    told = told.withColumn("row", row)
    at = lambda name, place: F.get("row", F.when(is_file, F.col(f"head.{name}").cast("int") - 1).otherwise(place)).alias(name)
    told = stored(told, **{k: at(k, p) for k, p in (("symbol", 0), ("quantity", 1), ("cost", 2), ("total", None))})
    told = stored(told, ticker=sanitize_ticker("symbol"), n=parse_number("quantity"), c=parse_number("cost"), t=parse_number("total"))
    positive = lambda x: F.when(F.col(x) > 0, F.col(x))
    cost = F.coalesce(positive("c"), positive("t") / positive("n"))
    no_holding = is_file & (F.lower("symbol").isin(*NO_HOLDING) | F.col("symbol").startswith("**") | F.col("n").isNull())
    good = F.col("ticker").isNotNull() & ~no_holding
    told = told.withColumn("good", F.coalesce(good, F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("file", "ticker", "good").orderBy("place"))
    status = F.when(F.col("place").isNull(), None).when(~F.col("good"), "skipped").when(turn > 1, "duplicate").otherwise("kept")
    return told.select("file", "format", "columns", "place", "ticker", F.greatest(F.coalesce("n", F.lit(0.0)), F.lit(0.0)).alias("shares"), cost.alias("average_cost"), status.alias("status"))


def broker_holdings(raw: DataFrame, multiline: bool = False) -> DataFrame:
    """file, format, place, ticker, shares, average_cost: the rows of broker files that are holdings."""
    return broker_rows(raw, multiline).filter("status = 'kept'").drop("columns", "status")


def broker_report(raw: DataFrame, multiline: bool = False) -> DataFrame:
    """Per file: format, number of its columns (null for a pasted list), rows kept, skipped and duplicate, and a warning where nothing is kept."""
    n = lambda s: F.count_if(F.coalesce(F.col("status") == s, F.lit(False)))
    out = broker_rows(raw, multiline).groupBy("file", "format").agg(F.max(F.size("columns")).alias("columns"), n("kept").alias("kept"), n("skipped").alias("skipped"), n("duplicate").alias("duplicates"))
    none = F.when(F.col("kept") > 0, None).when(F.col("format") == "paste", F.when(F.col("skipped") == 0, "no rows")).otherwise("header without usable rows")
    return out.withColumns({"columns": F.when(F.col("columns") >= 0, F.col("columns")), "warning": none})


def _loose(text: str) -> Column:
    """A number without signs of currency, percent and thousands; parentheses around it are a minus sign."""
    x = bare(F.col(text))
    digits = F.regexp_replace(x, r"[$,%()+\s]", "")
    number = digits.try_cast("double")
    number = F.when(x.startswith("(") & x.endswith(")"), -number).otherwise(number)
    return F.when(digits.rlike(NUMBER) & (F.abs(number) != float("inf")), number)


def position_rows(raw: DataFrame) -> DataFrame:
    """Every row of position exports (file, body) with its status: holding, cash or skipped.

    The first record is a header if it names a symbol or a quantity; without one the fields are symbol, shares and cost. Cash
    is a row with a value that is told as cash by its symbol, description or, without shares, its type. A null body has none.
    """
    told = stored(raw, rows=records(F.coalesce("body", F.lit(""))))
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    told = stored(told.filter(F.size("rows") > 0), names=F.transform(F.get("rows", F.lit(0)), plain))
    told = stored(told, headed=F.exists("names", lambda c: c.isin(*POSITION_HEADS)))
    # the last of equal names counts, so places are told from the end
    known = F.when(F.col("headed"), F.reverse("names")).otherwise(F.array().cast("array<string>"))
    told = stored(told, known=known).select("file", "headed", "known", F.posexplode(F.when(F.col("headed"), F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows"))).alias("place", "row"))

    def cell(wanted, fallback: Column | None) -> Column:
        place = lambda name: F.array_position("known", name)
        found = [F.get("row", F.when(place(name) > 0, (F.size("known") - place(name)).cast("int"))) for name in wanted]
        return F.coalesce(*found, *([] if fallback is None else [F.get("row", fallback)]))

    fallback = {"symbol": F.lit(0), "shares": F.lit(1), "average_cost": F.when(~F.col("headed"), 2)}
    told = stored(told, **{k: cell(names, fallback.get(k)) for k, names in POSITIONS.items()})
    ticker = F.regexp_replace(F.get(F.split(F.upper(bare(F.col("symbol"))), r"\s+"), F.lit(0)), r"[^A-Z0-9.\-]", "")
    numbers = ("shares", "current_value", "current_price", "average_cost", "total_cost")
    told = stored(told, ticker=F.coalesce(ticker, F.lit("")), **{f"{c}_": _loose(c) for c in numbers})
    has = lambda c, *words: F.coalesce(F.upper(c).rlike("|".join(words)), F.lit(False))
    no_shares = ~F.coalesce(F.col("shares_") > 0, F.lit(False))
    cash = F.coalesce(F.col("current_value_") > 0, F.lit(False)) & (has("ticker", "^SPAXX", "CASH") | has("description", "MONEY MARKET", "CASH RESERVE") | (has("type", "CASH") & no_shares))
    status = F.when(cash, "cash").when((F.col("ticker") == "") | no_shares, "skipped").otherwise("holding")
    average = F.coalesce("average_cost_", F.when(~no_shares, F.col("total_cost_") / F.col("shares_")))
    return told.select("file", "place", "ticker", F.col("shares_").alias("shares"), average.alias("average_cost"), F.col("current_price_").alias("current_price"), F.col("current_value_").alias("current_value"), status.alias("status"))


def positions(raw: DataFrame) -> DataFrame:
    """Holdings of position exports, one row a file and symbol: a later row of a symbol replaces an earlier one."""
    rows = position_rows(raw).filter("status = 'holding'")
    last = Window.partitionBy("file", "ticker").orderBy(F.desc("place"))
    return rows.withColumn("back", F.row_number().over(last)).filter("back = 1").drop("back", "status", "place")


def position_report(raw: DataFrame) -> DataFrame:
    """Per file: rows imported and skipped, and the cash balance (null without a cash row)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return position_rows(raw).groupBy("file").agg(n("holding").alias("imported"), n("skipped").alias("skipped"), F.sum(F.when(F.col("status") == "cash", F.col("current_value"))).alias("cash"))
