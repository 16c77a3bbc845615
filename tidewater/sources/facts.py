"""Facts from company-facts JSON: taxonomy, concept, unit, and the values filed under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACTS = "facts MAP<STRING, MAP<STRING, STRUCT<units MAP<STRING, ARRAY<STRUCT<val DOUBLE, start STRING, end STRING, filed STRING, form STRING>>>>>>"

# Forms that are statements, and the names a figure is filed under, the first one first.
FORMS = ("10-Q", "10-K", "20-F", "40-F", "10-Q/A", "10-K/A")
NAMES = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerIncludingAssessedTax"),
    "netIncome": ("NetIncomeLoss", "ProfitLoss"),
    "operatingCashFlow": ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"),
    "operatingIncome": ("OperatingIncomeLoss",),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "currentAssets": ("AssetsCurrent",),
    "currentLiabilities": ("LiabilitiesCurrent",),
    "retainedEarnings": ("RetainedEarningsAccumulatedDeficit",),
    "shortTermDebt": ("DebtCurrent", "LongTermDebtCurrent", "ShortTermBorrowings"),
    "longTermDebt": ("LongTermDebtNoncurrent", "LongTermDebt"),
    "shares": ("dei:EntityCommonStockSharesOutstanding", "CommonStockSharesOutstanding", "WeightedAverageNumberOfDilutedSharesOutstanding"),
}
TAXONOMY, UNITS = "us-gaap", {"shares": "shares"}


def facts_from_json(raw: DataFrame, newest_only: bool = False) -> DataFrame:
    """symbol, concept, since, until, filed, value, form, span of raw: symbol, json.

    Only the figures named above are taken out of the maps. A figure is read under the first of its names that has any
    usable row: of a statement's form, with an end, a filing date and a value. Of one period's rows of one filing date the
    first is kept; with ``newest_only`` the last filed of a period. JSON that cannot be read gives no rows.
    """
    # exploded as an array of one, which keeps the parser from being run anew for each name
    facts = F.explode(F.array(F.from_json("json", FACTS)["facts"]))
    under = []
    for concept, names in NAMES.items():
        for priority, name in enumerate(names):
            taxonomy, name = name.split(":") if ":" in name else (TAXONOMY, name)
            filed = F.try_element_at(F.try_element_at(F.try_element_at("facts", F.lit(taxonomy)), F.lit(name))["units"], F.lit(UNITS.get(concept, "USD")))
            under.append(F.struct(F.lit(concept).alias("concept"), F.lit(priority).alias("priority"), filed.alias("filed")))
    rows = raw.select("symbol", facts.alias("facts")).select("symbol", F.inline(F.array(*under)))
    rows = rows.select("symbol", "concept", "priority", F.posexplode("filed").alias("place", "f")).filter(F.col("f.form").isin(*FORMS))
    day = lambda c: F.col(f"f.{c}").try_cast("date")
    rows = rows.select("symbol", "concept", "priority", "place", day("start").alias("since"), day("end").alias("until"), day("filed").alias("filed"), F.col("f.val").alias("value"), F.col("f.form").alias("form")).dropna(subset=["until", "filed", "value"])
    rows = rows.withColumn("first", F.min("priority").over(Window.partitionBy("symbol", "concept"))).filter("priority = first")
    period = ["symbol", "concept", "since", "until"]
    order = Window.partitionBy(*period) if newest_only else Window.partitionBy(*period, "filed")
    rows = rows.withColumn("back", F.row_number().over(order.orderBy(F.desc("filed"), "place"))).filter("back = 1")
    days = F.datediff("until", "since")
    span = F.when(F.col("since").isNull(), "instant").when(days.between(70, 110), "quarter").when(days.between(330, 400), "annual").otherwise("other")
    return rows.select(*period, "filed", "value", "form", span.alias("span"))
