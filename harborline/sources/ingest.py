"""The five public sources: their requests, the ingestion job, its manifest and provenance.

Requests are few and small (an indicator, a bank's quarters), so the driver makes them; everything after
a payload is a DataFrame. ``get`` is what fetches, by default ``fetch.get_bytes``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta
from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.operators.profiling import Benford, benford_test, profile_table
from harborline.operators.rules import SUITES, ValidationReport, validate
from harborline.settings import Settings, logger
from harborline.sources import parsers
from harborline.sources.fetch import Fetched, Manifest, Source, get_bytes, ingest_all
from harborline.sources.parsers import INDICATORS, SourceError
from harborline.sources.staged import staging_folder

# Addresses of the sources, and the fields asked of bank filings.
WORLD_BANK = "https://api.worldbank.org/v2"
BANKS = "https://banks.data.fdic.gov/api"
RATES = "https://api.frankfurter.app"
CAMPAIGN = "https://archive.ics.uci.edu/static/public/222/bank+marketing.zip"
PERCENTS = ["ROA", "ROE", "NIMY", "EEFFR", "ROAPTX", "INTINCY", "EQV", "LNLSDEPR", "NPERFV"]
DOLLARS = ["ASSET", "DEP", "NETINC", "NIM", "LNLSNET", "EQ", "INTINC", "EINTEXP"]
DIRECTORY = ["CERT", "NAME", "CITY", "STALP", "ASSET", "DEP", "OFFDOM", "ESTYMD", "BKCLASS"]

Get = Callable[..., Fetched]
LOG = logger("sources")


def get_text(url: str, params: dict | None = None, get: Get = get_bytes) -> str:
    return get(url, params).body.decode("utf-8", "replace")


def get_json(url: str, params: dict | None = None, get: Get = get_bytes) -> object:
    """The parsed body; SourceError if it is no JSON."""
    try:
        return json.loads(get_text(url, params, get))
    except ValueError as e:
        raise SourceError(f"{url}: no JSON") from e


def payload(spark: SparkSession, *bodies: str) -> DataFrame:
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def indicator_series(spark: SparkSession, code: str, country: str = "IND", start: int = 2000, end: int | None = None, get: Get = get_bytes) -> DataFrame:
    """One indicator's years, in order."""
    asked = {"format": "json", "per_page": 500, "date": f"{start}:{end or date.today().year}"}
    return parsers.world_bank(payload(spark, get_text(f"{WORLD_BANK}/country/{country}/indicator/{code}", asked, get))).orderBy("year")


def indicator_panel(spark: SparkSession, codes: list[str] | None = None, get: Get = get_bytes) -> DataFrame:
    """The series of all codes, stacked; one that fails or is empty is left out, if all are it raises."""
    found = []
    for code in INDICATORS if codes is None else codes:
        try:
            series = indicator_series(spark, code, get=get)
            if not series.isEmpty():
                found.append(series)
        except Exception as e:
            LOG.warning("indicator %s: %s", code, str(e).split("\n")[0][:200])
    if not found:
        raise SourceError("no indicator gave a row")
    return reduce(DataFrame.unionByName, found)


def institutions(spark: SparkSession, filters: str = "ACTIVE:1", limit: int = 1000, get: Get = get_bytes) -> DataFrame:
    """The directory of banks, one row each; amounts are numbers."""
    asked = {"filters": filters, "fields": ",".join(DIRECTORY), "limit": limit, "format": "json"}
    rows = parsers.bank_rows(payload(spark, get_text(f"{BANKS}/institutions", asked, get)))
    numbers = ("ASSET", "DEP", "OFFDOM")
    cells = [parsers.coerce_numeric(F.col("m")[c]) if c in numbers else F.col("m")[c].try_cast("int") if c == "CERT" else F.col("m")[c] for c in DIRECTORY]
    return rows.select(*[x.alias(c) for x, c in zip(cells, DIRECTORY, strict=True)])


def financials(spark: SparkSession, certs: list[int], quarters: int = 20, get: Get = get_bytes) -> DataFrame:
    """The last quarters of the given banks; one whose request fails is left out."""
    bodies = []
    for cert in certs:
        asked = {"filters": f"CERT:{cert}", "fields": ",".join(["CERT", "REPDTE", *PERCENTS, *DOLLARS]), "sort_by": "REPDTE", "sort_order": "DESC", "limit": quarters, "format": "json"}
        try:
            bodies.append(get_text(f"{BANKS}/financials", asked, get))
        except SourceError as e:
            LOG.warning("bank %s: %s", cert, e)
    return parsers.bank_filings(payload(spark, *bodies), [*PERCENTS, *DOLLARS])


def peers(spark: SparkSession, low: int = 1_000_000, high: int = 100_000_000, n_banks: int = 60, quarters: int = 8, get: Get = get_bytes) -> DataFrame:
    """Banks of a band of assets (thousands of dollars) with their last quarters; raises if there is none or units are wrong."""
    banks = institutions(spark, f"ACTIVE:1 AND ASSET:[{low} TO {high}]", n_banks, get)
    certs = [r.CERT for r in banks.where("CERT is not null").select("CERT").limit(n_banks).collect()]
    panel = parsers.peer_panel(financials(spark, certs, quarters, get), banks, quarters)
    if panel.isEmpty():
        raise SourceError("no bank of the band has filings")
    if wrong := parsers.suspect_units(panel):
        raise SourceError(f"{', '.join(wrong)}: dollars where percent are expected")
    return panel.join(F.broadcast(banks.select("CERT", "STALP").dropDuplicates(["CERT"])), "CERT", "left")


def rates_now(spark: SparkSession, base: str = "USD", quotes: str = "INR", get: Get = get_bytes) -> DataFrame:
    return parsers.fx_latest(payload(spark, get_text(f"{RATES}/latest", {"from": base, "to": quotes}, get)))


def rates_since(spark: SparkSession, start: date, base: str = "USD", quotes: str = "INR", get: Get = get_bytes) -> DataFrame:
    return parsers.fx_series(payload(spark, get_text(f"{RATES}/{start}..", {"from": base, "to": quotes}, get)))


def campaign(spark: SparkSession, get: Get = get_bytes) -> DataFrame:
    """The contacts of the archive: the driver unpacks the file that it has fetched, the executors parse its lines."""
    body, _ = parsers.inner_csv(get(CAMPAIGN).body)
    path = staging_folder(spark, "campaign")
    payload(spark, body.decode("utf-8", "replace").rstrip("\r\n")).coalesce(1).write.text(path)
    return parsers.campaign_contacts_at(spark, path)


def registry(s: Settings, get: Get | None = None) -> list[Source]:
    """The five sources; exchange rates may fail without stopping the job."""
    get = get or partial(get_bytes, cache_dir=s.cache or None, ttl_days=s.ttl_days, timeout=s.timeout, max_retries=s.max_retries)
    since = date.today() - timedelta(days=730)
    return [
        Source("uci_campaign", lambda spark: campaign(spark, get), True, CAMPAIGN),
        Source("worldbank_macro", lambda spark: indicator_panel(spark, get=get), True, WORLD_BANK),
        Source("fdic_peers", lambda spark: peers(spark, n_banks=40, get=get), True, BANKS),
        Source("fx_latest", lambda spark: rates_now(spark, get=get), False, RATES),
        Source("fx_usd_inr_series", lambda spark: rates_since(spark, since, get=get), False, RATES),
    ]


def ingest(spark: SparkSession, s: Settings, only: list[str] | None = None, get: Get | None = None) -> Manifest:
    """Fetches the sources into ``data/sources`` as Parquet, and the manifest beside them."""
    manifest = ingest_all(spark, [replace(x) for x in registry(s, get)], f"{s.data}/sources", only)
    manifest.to_frame(spark).coalesce(1).write.mode("overwrite").json(f"{s.data}/manifest")
    return manifest


def manifest_table(spark: SparkSession, s: Settings) -> DataFrame:
    """The stored manifest; no rows if nothing was ingested."""
    kind = Manifest().to_frame(spark).schema
    try:
        return spark.read.schema(kind).json(f"{s.data}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], kind)


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: count and exact sum of row hashes, 64 bits each."""
    h = F.xxhash64(*[F.to_json(F.struct(*df.columns))]).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(h).alias("s")).first()
    return f"{r.n:016x}{int(r.s or 0) % (1 << 64):016x}"


def provenance(spark: SparkSession, s: Settings) -> DataFrame:
    """Per source: status, rows, when it was fetched, columns and a digest of the stored rows."""
    held = {}
    for r in manifest_table(spark, s).where("status = 'ok'").collect():
        df = spark.read.parquet(f"{s.data}/sources/{r.source}")
        held[r.source] = (r.source, df.columns, content_digest(df))
    extra = spark.createDataFrame(list(held.values()), "source string, columns array<string>, digest string")
    return manifest_table(spark, s).join(F.broadcast(extra), "source", "left").select("source", "status", "n_rows", "fetched_at", "url", "columns", "digest")


def save_with_provenance(df: DataFrame, path: str, url: str = "", fetched_at: float | None = None) -> None:
    """A table as CSV with a header, and one JSON row on it in ``<path>.provenance``."""
    df.write.mode("overwrite").option("header", True).csv(path)
    row = (url, fetched_at, df.count(), df.columns, content_digest(df))
    kind = "source_url string, fetched_at double, n_rows long, columns array<string>, digest string"
    df.sparkSession.createDataFrame([row], kind).coalesce(1).write.mode("overwrite").json(f"{path}.provenance")


def validate_ingested(spark: SparkSession, s: Settings, get: Get | None = None) -> tuple[ValidationReport, DataFrame | None, dict[str, Benford]]:
    """Every ingested source against its suite: the report, the stacked profiles, and the first-digit control.

    A source that is not there is noted as skipped. Peers are of a narrow band of assets, which first
    digits need not follow; the control is the whole directory of banks.
    """
    report, profiles, control = ValidationReport(), [], {}
    for name, suite in SUITES.items():
        try:
            df = spark.read.parquet(f"{s.data}/sources/{name}")
        except AnalysisException:
            report.skipped.append((name, "not ingested"))
            continue
        validate(df, suite(), name, report)
        profiles.append(profile_table(df).withColumn("table_name", F.lit(name)))
        if name == "fdic_peers":
            control = benford_control(spark, get or get_bytes)
    return report, reduce(DataFrame.unionByName, profiles) if profiles else None, control


def benford_control(spark: SparkSession, get: Get = get_bytes, least: int = 200) -> dict[str, Benford]:
    """First digits of all banks' assets, which should conform; nothing if the source fails or gives few."""
    try:
        assets = institutions(spark, get=get).where("ASSET > 0")
        enough = assets.limit(least).count() == least
    except Exception as e:
        LOG.warning("first-digit control: %s", str(e).split("\n")[0][:200])
        return {}
    return {"total assets of all active banks": benford_test(assets, "ASSET")} if enough else {}
