"""Parsers of the public sources' payloads, as DataFrames over text or binary columns.

A payload is a table with a ``body`` column (JSON text) or files read by ``binaryFile``; fetching is
``harborline.sources.fetch``. Bad envelopes raise when the rows are evaluated.
"""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from harborline.settings import EngineError

# Texts that stand for no number, and percent fields of the bank filings.
PLACEHOLDERS = ["", "-", "--", ".", "n/a", "na", "nan", "none", "null"]
PERCENT_FIELDS = ["NIMY", "ROA", "ROE", "EEFFR"]
# World Bank series of the panel, with their labels.
INDICATORS = {
    "FR.INR.LEND": "Lending interest rate (%)",
    "FR.INR.DPST": "Deposit interest rate (%)",
    "FB.CBK.BRCH.P5": "Commercial bank branches (per 100,000 adults)",
    "FX.OWN.TOTL.ZS": "Account ownership, age 15+ (% of population)",
    "NY.GDP.MKTP.KD.ZG": "GDP growth (annual %)",
    "FP.CPI.TOTL.ZG": "Inflation, consumer prices (annual %)",
    "NY.GDP.PCAP.CD": "GDP per capita (current US$)",
    "FB.BNK.CAPA.ZS": "Bank capital to assets ratio (%)",
}


class SourceError(EngineError):
    """A source failed or answered with something else than data."""


def coerce_numeric(c: Column | str) -> Column:
    """A number from dirty text: commas dropped, placeholders and the unparseable to null."""
    text = F.regexp_replace(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")), ",", "")
    value = text.try_cast("double")
    return F.when(~F.lower(text).isin(PLACEHOLDERS) & ~F.isnan(value), value)


def _raise_unless(ok: Column, message: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(message).cast("string"))


def world_bank(payloads: DataFrame) -> DataFrame:
    """(indicator, indicator_label, country_iso3, year, value) from [meta, rows]; null rows give none, an error object raises."""
    parts = F.from_json("body", "array<string>")
    rows = _raise_unless((F.size(parts) == 2) | ~F.get_json_object("body", "$[0].message").isNotNull(), F.concat(F.lit("the World Bank answered with an error: "), F.coalesce(F.get_json_object("body", "$[0].message[0].value"), F.get_json_object("body", "$[0].message"))), F.get(parts, F.lit(1)))
    kind = "array<struct<indicator:struct<id:string,value:string>,countryiso3code:string,date:string,value:string>>"
    found = payloads.select(F.explode(F.from_json(rows, kind)).alias("r"))
    return found.select(F.col("r.indicator.id").alias("indicator"), F.col("r.indicator.value").alias("indicator_label"), F.col("r.countryiso3code").alias("country_iso3"), F.col("r.date").try_cast("int").alias("year"), coerce_numeric(F.col("r.value")).alias("value"))


def latest_value(series: DataFrame) -> DataFrame:
    """(indicator, year, value) of the last year that has a value."""
    last = F.max_by(F.struct("year", "value"), "year")
    return series.where("value is not null").groupBy("indicator").agg(last.alias("x")).select("indicator", "x.year", "x.value")


def bank_rows(payloads: DataFrame) -> DataFrame:
    """(m), a row's fields as a map of texts, of {data: [{data: {...}} or {...}]}; a payload without data raises."""
    data = F.get_json_object("body", "$.data")
    rows = payloads.select(F.explode(F.from_json(_raise_unless(data.isNotNull(), F.lit("the filings have no data"), data), "array<string>")).alias("r"))
    inner = F.coalesce(F.get_json_object("r", "$.data"), F.col("r"))
    return rows.select(F.from_json(inner, "map<string,string>").alias("m"))


def bank_filings(payloads: DataFrame, numbers: list[str]) -> DataFrame:
    """CERT, NAME, REPDTE as report_date, and the numbers asked for, of every row."""
    get = lambda k: F.col("m")[k]
    return bank_rows(payloads).select(get("CERT").try_cast("int").alias("CERT"), get("NAME").alias("NAME"), F.try_to_date(get("REPDTE"), "yyyyMMdd").alias("report_date"), *[coerce_numeric(get(n)).alias(n) for n in numbers])


def peer_panel(financials: DataFrame, institutions: DataFrame, quarters: int) -> DataFrame:
    """The last quarters of each bank, with its name."""
    by = Window.partitionBy("CERT").orderBy(F.desc("report_date"))
    recent = financials.withColumn("_i", F.row_number().over(by)).where(F.col("_i") <= quarters).drop("_i", "NAME")
    return recent.join(institutions.select("CERT", F.col("NAME").alias("institution_name")).dropDuplicates(["CERT"]), "CERT", "left")


def peer_quartiles(panel: DataFrame, field: str) -> DataFrame:
    """(q1, median, q3) of a field over each bank's latest quarter."""
    last = panel.where(F.col(field).isNotNull()).groupBy("CERT").agg(F.max_by(field, "report_date").alias("x"))
    q = last.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def suspect_units(panel: DataFrame) -> list[str]:
    """Percent fields whose median is over 1000: dollars, most likely."""
    there = [c for c in PERCENT_FIELDS if c in panel.columns]
    row = panel.agg(*[F.median(F.abs(c)).alias(c) for c in there]).first()
    return [c for c in there if row[c] is not None and row[c] > 1000]


def fx_latest(payloads: DataFrame) -> DataFrame:
    kind = "base string, date date, rates map<string,double>"
    x = payloads.select(F.from_json("body", kind).alias("x")).select("x.base", "x.date", F.explode("x.rates").alias("quote", "rate"))
    return x.select("date", "base", "quote", "rate")


def fx_series(payloads: DataFrame) -> DataFrame:
    kind = "base string, rates map<string,map<string,double>>"
    days = payloads.select(F.from_json("body", kind).alias("x")).select("x.base", F.explode("x.rates").alias("day", "of"))
    return days.select(F.col("day").cast("date").alias("date"), "base", F.explode("of").alias("quote", "rate")).orderBy("date", "quote")


def usd_inr(rates: DataFrame) -> DataFrame:
    return rates.where("quote = 'INR' and rate is not null").agg(F.max_by("rate", "date").alias("rate"))


def inner_csv(blob: bytes, hint: str = "bank-additional-full.csv") -> tuple[bytes, str]:
    """A CSV from an archive that may hold archives: the member whose name ends with ``hint``, else the largest CSV."""
    found: dict[str, bytes] = {}

    def walk(raw: bytes) -> None:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name in z.namelist():
                if name.startswith("__MACOSX/") or name.endswith("/"):
                    continue
                if name.lower().endswith(".zip"):
                    walk(z.read(name))
                elif name.lower().endswith(".csv"):
                    found[name] = z.read(name)

    walk(blob)
    if not found:
        raise SourceError("no CSV in the archive")
    name = next((n for n in found if n.endswith(hint)), max(found, key=lambda n: len(found[n])))
    return found[name], name


def campaign_contacts(spark: SparkSession, text: str, drop_leaky: bool = True) -> DataFrame:
    """Contacts of a ;-separated file: dots in names become underscores, y becomes subscribed, duration goes."""
    return contacts_of(spark.createDataFrame(list(csv_rows(text)), _text_schema(text)), drop_leaky)


def campaign_contacts_at(spark: SparkSession, path: str, drop_leaky: bool = True) -> DataFrame:
    """``campaign_contacts`` of a file or folder, read by the executors; quoted line feeds stay in their field."""
    return contacts_of(spark.read.csv(path, sep=";", quote='"', header=True, multiLine=True), drop_leaky)


def csv_rows(text: str) -> Iterator[tuple[str, ...]]:
    """The rows of a ;-separated text after its head; a quoted field may hold line feeds."""
    return map(tuple, itertools.islice(csv.reader(io.StringIO(text, newline=""), delimiter=";"), 1, None))


def _text_schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(c.strip(), T.StringType()) for c in next(csv.reader(io.StringIO(text, newline=""), delimiter=";"))])


def contacts_of(df: DataFrame, drop_leaky: bool = True) -> DataFrame:
    """Contacts from columns of text; a column is a number if every value is."""
    names = df.columns
    plain = df.agg(*[F.count_if(F.col(f"`{c}`").try_cast("double").isNull()).alias(str(i)) for i, c in enumerate(names)]).first()
    df = df.select(*[F.col(f"`{c}`").cast("double").alias(c) if not plain[i] else F.col(f"`{c}`") for i, c in enumerate(names)])
    df = df.toDF(*[c.replace(".", "_") for c in df.columns])
    df = df.withColumn("subscribed", (F.lower(F.trim("y")) == "yes").cast("int"))
    return df.drop("duration") if drop_leaky else df


def campaign_summary(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.count("*").alias("n_contacts"), F.avg("subscribed").alias("conversion_rate"), F.sum("subscribed").alias("n_subscribed"), F.avg("age").alias("mean_age"), F.median("campaign").alias("median_contacts"), F.count_distinct("job").alias("n_jobs"))
