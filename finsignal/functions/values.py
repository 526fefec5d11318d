"""Numbers, dates and months out of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import capitalize, strip

ZONE = "Africa/Nairobi"
# Month names in calendar order.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(c: Column) -> Column:
    """Text to double where it is a plain number, else null (try_cast alone also takes '12.5f')."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_price(c: Column) -> Column:
    """Commas and spaces out, three decimals half to even; null if no number."""
    text = F.regexp_replace(c, r"[,\s]", "")
    return F.when(text.rlike(NUMBER), F.bround(text.try_cast("decimal(20,6)"), 3)).cast("decimal(10,3)")


def parse_volume(c: Column) -> Column:
    """Commas out, fraction cut off."""
    return _number(F.regexp_replace(c, r"[,\s]", "")).cast("long")


def parse_change_pct(c: Column) -> Column:
    """'+0.33%' -> 0.33; a percentage stays one."""
    return _number(F.regexp_replace(c, r"[%+,\s]", ""))


def normalize_numeric(c: Column) -> Column:
    """Commas out; blank or no number: null."""
    return _number(strip(F.replace(c, F.lit(","), F.lit(""))))


def first_number(c: Column) -> Column:
    """First signed number after commas are out."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"[-+]?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")


def first_statement_value(c: Column) -> Column:
    """First number token of a statement line, thousands commas allowed."""
    token = F.regexp_extract(c, r"-?\d[\d,]*(\.\d+)?", 0)
    return F.nullif(F.replace(token, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def local_to_instant(c: Column) -> Column:
    return F.to_utc_timestamp(c, ZONE)


def parse_timestamp_iso(c: Column, fallback: Column | None = None) -> Column:
    """ISO text; without an offset it is Nairobi time; null or `fallback` when unreadable."""
    has_zone = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    value = F.try_to_timestamp(c)
    return F.coalesce(F.when(has_zone, value).otherwise(local_to_instant(value)), F.lit(None).cast("timestamp") if fallback is None else fallback)


def parse_feed_date(published: Column, updated: Column) -> Column:
    """Published, else updated, as an instant."""

    def one(c: Column) -> Column:
        return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"^\w{3}, ", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))

    return F.coalesce(one(published), one(updated))


def parse_report_month(c: Column) -> Column:
    """'March 2026' -> first day of the month."""
    return F.try_to_timestamp(F.concat(F.lit("1 "), strip(c)), F.lit("d MMMM yyyy")).cast("date")


def parse_date_dayfirst(c: Column) -> Column:
    """Day-first dates in a fixed list of formats."""
    text = strip(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-M-d")]).cast("date")


def report_month_from_url(c: Column) -> Column:
    """Struct (month, year, label) from a file name with a month name and 20xx; null fields where absent."""
    name = F.element_at(F.split(c, "/"), -1)
    month = F.nullif(capitalize(F.regexp_extract(name, f"(?i)({'|'.join(MONTHS)})", 1)), F.lit(""))
    year = F.nullif(F.regexp_extract(name, r"(20\d{2})", 1), F.lit(""))
    return F.struct(month.alias("month"), year.alias("year"), F.when(month.isNotNull() & year.isNotNull(), F.concat_ws(" ", month, year)).alias("label"))


def last_long_date(c: Column) -> Column:
    """The last 'd Month yyyy' of a text as a date; null if it is no date."""
    found = F.regexp_extract_all(c, F.lit(r"(\d{1,2}\s+[A-Za-z]+\s+\d{4})"), F.lit(1))
    return F.try_to_timestamp(F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"\s+", " "), F.lit("d MMMM yyyy")).cast("date")


def publication_date(c: Column) -> Column:
    """'Posted On: d/m/y' first, else any d/m/yyyy."""
    posted = F.nullif(F.regexp_extract(c, r"(?i)posted on:?\s*(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(c, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit(""))
    return parse_date_dayfirst(F.coalesce(posted, anywhere))


def normalize_month(c: Column) -> Column:
    """Capitalised month name, or null."""
    name = capitalize(strip(c))
    return F.when(name.isin(*MONTHS), name)


def normalize_year(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


def month_number(c: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), c).cast("int"), F.lit(0))


def period(month: Column, year: Column) -> Column:
    """First day of (month name, year text); null if either is unusable."""
    return F.when(month_number(month).isNotNull() & year.rlike(r"^\d{4}$"), F.make_date(year.try_cast("int"), month_number(month), F.lit(1)))


def split_list(c: Column) -> Column:
    """'a, b,,c' -> [a, b, c]; null: empty array."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""), F.array().cast("array<string>"))


def to_json_row(columns: list[str]) -> Column:
    """A row as a JSON document with ISO dates."""
    return F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"})


def missing_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row of warnings: for each target column the rows whose source field is absent, blank or no number."""
    values = map_fields(fields, df.columns)
    return df.select(*[c.alias(n) for n, c in values.items()]).agg(*[F.count_if(F.col(n).isNull()).alias(f"missing_{n}") for n in values])


def map_fields(fields: dict[str, str], available: list[str]) -> dict[str, Column]:
    """Target column -> numeric expression of its source field; a missing source is null."""
    return {target: normalize_numeric(F.col(source).cast("string")) if source in available else F.lit(None).cast("double") for source, target in fields.items()}
