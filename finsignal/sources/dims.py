"""Dimensions and schemas. Values that results depend on are listed as they are, in their natural order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Keywords by category.
KEYWORDS = {
    "macro_economy": ["inflation", "interest rates", "debt", "tax", "imf", "cbk"],
    "energy_sector": ["fuel", "electricity", "tariff", "epra", "subsidy", "power outage"],
    "geopolitics": ["war", "sanctions", "china", "usa", "russia", "oil", "middle east", "shipping"],
    "market_stress": ["losses", "profit warning", "decline", "shortage", "crisis"],
    "kenya_policy": ["treasury", "parliament", "finance bill", "budget", "cbk", "kra", "epra", "ministry"],
}
# Impact weights; other keywords weigh 1.
WEIGHTS = {
    "war": 5, "interest rates": 5, "oil": 4, "inflation": 4, "cbk": 4, "fuel": 3, "sanctions": 3, "crisis": 3, "profit warning": 3,
    "finance bill": 3, "budget": 2, "tariff": 2, "debt": 2, "imf": 2, "electricity": 2, "epra": 2,
}
# Feeds (label, url); the first four are regional.
FEEDS = [
    ("Business Daily Africa", "https://news.google.com/rss/search?q=Business+Daily+Africa&hl=en-KE&gl=KE&ceid=KE:en"),
    ("The Standard Business", "https://www.standardmedia.co.ke/rss/business.php"),
    ("Nation Business", "https://news.google.com/rss/search?q=site:nation.africa+business&hl=en-KE&gl=KE&ceid=KE:en"),
    ("Capital FM Business", "https://www.capitalfm.co.ke/business/feed/"),
    ("Reuters Business", "https://feeds.reuters.com/reuters/businessNews"),
    ("CNBC Markets", "https://search.cnbc.com/rs/search/combinedcms/view.xml?partnerId=wrss01&id=15839135"),
    ("Financial Times World", "https://www.ft.com/world?format=rss"),
    ("IMF News", "https://www.imf.org/en/News/rss?language=eng"),
    ("World Bank News", "https://news.google.com/rss/search?q=World+Bank&hl=en-KE&gl=KE&ceid=KE:en"),
]
REGIONAL_FEEDS = 4
# Currency names (alias, code, pair), in order of precedence.
CURRENCIES = [
    ("US DOLLAR", "USD", "USD/KES"), ("USD", "USD", "USD/KES"), ("STG POUND", "GBP", "GBP/KES"), ("STERLING POUND", "GBP", "GBP/KES"),
    ("POUND STERLING", "GBP", "GBP/KES"), ("BRITISH POUND", "GBP", "GBP/KES"), ("GBP", "GBP", "GBP/KES"), ("EURO", "EUR", "EUR/KES"), ("EUR", "EUR", "EUR/KES"),
]
# Report line labels and the fields they fill.
METRIC_LABELS = {
    "Revenue from contracts with customers": "revenue", "Profit After Tax": "profit_after_tax", "Basic and diluted earnings per share": "eps",
    "Shareholders' equity": "shareholders_equity", "Non-current liabilities": "non_current_liabilities", "Current liabilities": "current_liabilities",
}
# Indicators, the extractor fields that fill their columns, and their columns.
FIELD_MAPS = {
    "inflation": {"kenya_inflation": "inflation"},
    "exchange": {"usd": "usd_kes_rate", "pound_sterling": "pounds_kes_rate", "euro": "euro_kes_rate"},
    "cbr": {"cbr": "cbk_rate"},
    "fuel": {"diesel_price": "fuel_price"},
}
INDICATORS = {"inflation": ["inflation"], "fuel": ["fuel_price"], "cbr": ["cbk_rate"], "exchange": ["usd_kes_rate", "euro_kes_rate", "pounds_kes_rate"]}
INDICATOR_COLUMNS = [c for columns in INDICATORS.values() for c in columns]

SCHEMAS = {
    "headlines": "id long, source string, headline string, description string, content string, sentiment_score double, published_at timestamp, keywords_detected string, categories string, matched_keywords_count int, impact_score int, url string, timestamp timestamp",
    "market_data": "id long, ticker string, company string, price decimal(10,3), volume long, daily_change decimal(10,3), daily_change_pct double, volatility double, timestamp timestamp",
    "macro_data": "id long, report_date date, inflation double, fuel_price double, cbk_rate double, usd_kes_rate double, euro_kes_rate double, pounds_kes_rate double, month string, year string, fuel_trend double, inflation_trend double, timestamp date",
    "fundamentals": "id long, ticker string, company string, report_date timestamp, eps double, pe_ratio double, dividend_yield double, revenue double, debt_ratio double, net_profit_margin double, timestamp timestamp",
    "quotes_json": "success boolean, data array<struct<ticker string, name string, volume string, price string, change string, lastUpdated string, timestamp string>>, meta string",
    "feed_entries": "feed_ord int, entry_ord long, feed_url string, label string, feed_title string, title string, summary string, description string, link string, id string, content array<struct<value string>>, published string, updated string",
    "table_grid": "source_url string, report_date string, indicator string, page int, table_idx int, row_idx int, cells array<string>",
    "pages": "page_id long, url string, html string",
}


@dataclass(frozen=True)
class Dictionary:
    """Keywords by category and impact weights; any two tables of this shape can stand in."""

    keywords: dict[str, list[str]] = field(default_factory=lambda: KEYWORDS)
    weights: dict[str, int] = field(default_factory=lambda: WEIGHTS)
    default_weight: int = 1

    def distinct(self) -> list[str]:
        return sorted({k for words in self.keywords.values() for k in words})


def dim_keywords(spark: SparkSession, d: Dictionary = Dictionary()) -> DataFrame:
    return spark.createDataFrame([(c, k) for c, words in d.keywords.items() for k in words], "category string, keyword string")


def dim_weights(spark: SparkSession, d: Dictionary = Dictionary()) -> DataFrame:
    return spark.createDataFrame([(k, d.weights.get(k, d.default_weight)) for k in d.distinct()], "keyword string, weight int")


def dim_feeds(spark: SparkSession, region: str | None = None) -> DataFrame:
    """(ord, label, url, region); region: kenya, global or None for all."""
    rows = [(i, label, url, "kenya" if i < REGIONAL_FEEDS else "global") for i, (label, url) in enumerate(FEEDS)]
    return spark.createDataFrame([r for r in rows if region in (None, r[3])], "ord int, label string, url string, region string")


def dim_currencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(CURRENCIES)], "ord int, alias string, code string, pair string")


def dim_labels(spark: SparkSession, labels: dict[str, str] = METRIC_LABELS) -> DataFrame:
    return spark.createDataFrame(list(labels.items()), "label string, field string")
