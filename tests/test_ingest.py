import io
import json
import math
import zipfile

import pytest

from harborline.operators.calibration import build_profile, envelope, latest_quarter
from harborline.operators.generation import CalibrationError
from harborline.operators.rules import ValidationReport
from harborline.settings import ConfigError, EngineError, Settings, log_to_console, logger, settings
from harborline.sources import ingest as I
from harborline.sources.fetch import Fetched
from harborline.sources.parsers import SourceError

BANKS = 250


def zipped():
    head = "age;job;marital;education;y;duration;campaign;pdays;previous;euribor3m;contact"
    rows = [f'{20 + i % 50};"{["admin.", "student"][i % 2]}";"single";"basic.9y";"{["no", "yes"][i % 4 == 0]}";10;1;999;0;{i % 5};"cellular"' for i in range(120)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("bank-additional-full.csv", "\n".join([head, *rows, ""]))
    return out.getvalue()


def internet(url, params=None, **_):
    """What the five sources would answer; two indicators fail or are empty."""
    if url.endswith(".zip"):
        return Fetched(url, zipped(), False, 1.0)
    if "worldbank" in url:
        code = url.rsplit("/", 1)[1]
        if code == "FB.BNK.CAPA.ZS":
            raise SourceError("down")
        years = [] if code == "FR.INR.DPST" else [(2021, 8.0), (2022, 8.5), (2023, None)]
        body = [{"page": 1}, [{"indicator": {"id": code, "value": code}, "countryiso3code": "IND", "date": str(y), "value": v} for y, v in years] or None]
    elif "institutions" in url:
        n = min(params["limit"], BANKS)
        body = {"data": [{"data": {"CERT": i, "NAME": f"bank {i}", "STALP": "TX", "ASSET": str(round(10 ** (5 + 4 * i / n)))}} for i in range(n)]}
    elif "financials" in url:
        cert = int(params["filters"].split(":")[1])
        if cert == 3:
            raise SourceError("no such bank")
        body = {"data": [{"data": {"CERT": cert, "REPDTE": f"2024{m}", "ROA": 1 + cert / 100, "NIMY": "3.0", "LNLSNET": 80, "DEP": 100, "EQ": 10, "ASSET": 110}} for m in ("0630", "0331")]}
    elif "latest" in url:
        raise SourceError("rates are optional")
    else:
        body = {"base": "USD", "rates": {"2024-01-01": {"INR": 83.0}, "2024-01-02": {"INR": 84.0}}}
    return Fetched(url, json.dumps(body).encode(), False, 1.0)


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    s = Settings(data=str(tmp_path_factory.mktemp("data")))
    I.ingest(spark, s, get=internet)
    return s


def test_manifest_and_provenance(spark, ingested):
    rows = {r.source: r for r in I.manifest_table(spark, ingested).collect()}
    assert {k: (r.status, r.n_rows) for k, r in rows.items()} == {"uci_campaign": ("ok", 120), "worldbank_macro": ("ok", 18), "fdic_peers": ("ok", 78), "fx_latest": ("failed", 0), "fx_usd_inr_series": ("ok", 2)}
    told = {r.source: r for r in I.provenance(spark, ingested).collect()}
    assert told["fx_latest"].digest is None and "rate" in told["fx_usd_inr_series"].columns
    df = spark.read.parquet(f"{ingested.data}/sources/fdic_peers")
    assert I.content_digest(df.repartition(7)) == told["fdic_peers"].digest != I.content_digest(df.limit(70))
    assert "institution_name" in df.columns and df.where("STALP is null").isEmpty()
    assert I.manifest_table(spark, Settings(data="/nowhere")).isEmpty()


def test_csv_with_sidecar(spark, tmp_path):
    I.save_with_provenance(spark.range(3), f"{tmp_path}/x", "http://x")
    assert spark.read.option("header", True).csv(f"{tmp_path}/x").count() == 3
    r = spark.read.json(f"{tmp_path}/x.provenance").first()
    assert (r.source_url, r.n_rows, r.columns) == ("http://x", 3, ["id"])


def test_requests(spark):
    assert I.get_json("http://rates", get=internet)["base"] == "USD"
    with pytest.raises(SourceError):
        I.get_json("http://x.zip", get=internet)
    with pytest.raises(SourceError):
        I.indicator_panel(spark, ["FB.BNK.CAPA.ZS"], get=internet)
    assert I.institutions(spark, limit=5, get=internet).columns == I.DIRECTORY
    with pytest.raises(Exception, match="no data"):
        I.institutions(spark, get=lambda *a, **k: Fetched("", b"{}", False, 0.0)).collect()


def test_validation_job(spark, ingested):
    report, profiles, control = I.validate_ingested(spark, ingested, internet)
    assert [r.rule for r in report.errors if r.table != "uci_campaign"] == []
    assert ("fx_latest", "not ingested") in report.skipped
    assert {r.table_name for r in profiles.select("table_name").distinct().collect()} == {"uci_campaign", "worldbank_macro", "fdic_peers", "fx_usd_inr_series"}
    assert [b.n for b in control.values()] == [BANKS] and all(b.conforms for b in control.values())
    assert I.benford_control(spark, internet, least=BANKS + 1) == {}
    assert I.validate_ingested(spark, Settings(data="/nowhere"), internet)[1] is None


def test_profile(spark, ingested, tmp_path):
    p = build_profile(spark, ingested, I.provenance(spark, ingested))
    assert p.wealth["mu"] == pytest.approx(math.log(8.5 * 84 / 3)) and p.conversion_rate == 0.25
    assert (p.lending_rate, p.lending_year, p.deposit_rate) == (8.5, 2022, 5.5)
    assert p.envelopes["LTD"]["median"] == pytest.approx(80) and p.envelopes["ROA"]["n"] == 39
    assert p.equity_ratio == pytest.approx(10 / 110) and set(p.elasticities) == {"euribor3m"}
    assert sum(d["share"] for d in p.demographics) == pytest.approx(1)
    assert json.loads(p.save(tmp_path / "p.json").read_text())["macro"]["usd_inr"] == 84
    assert "39 banks" in p.summary() and p.profile().conversion_rate == 0.25
    assert "fx_latest" not in p.provenance and p.provenance["uci_campaign"]["n_rows"] == 120
    with pytest.raises(CalibrationError):
        build_profile(spark, Settings(data="/nowhere"))


def test_quarters_weigh_banks_once(spark):
    panel = spark.createDataFrame([(c, f"2024-0{m}-01", float(c * m)) for c in range(1, 6) for m in range(1, c + 1)], "CERT int, report_date string, ROA double")
    last = latest_quarter(panel)
    assert last.count() == 5 and envelope(last, last.ROA, {"ROA"})["median"] == 9
    assert envelope(last.limit(4), last.ROA, {"ROA"}) is None and envelope(last, last.ROA, {"ROE"}) is None


def test_settings_and_logging(tmp_path):
    (tmp_path / ".env").write_text("# c\nexport HARBORLINE_SEED='7'\n\nHARBORLINE_DATA=\"a b\"\nnothing\nHARBORLINE_TTL_DAYS=2\n")
    s = settings(tmp_path / ".env", {"HARBORLINE_SEED": "8", "HARBORLINE_TTL_DAYS": " "})
    assert (s.seed, s.data, s.ttl_days, s.max_retries) == (8, "a b", 2.0, 4)
    with pytest.raises(ConfigError):
        settings(environ={"HARBORLINE_SEED": "x"})
    assert issubclass(SourceError, EngineError) and issubclass(CalibrationError, EngineError)
    log_to_console()
    log_to_console("debug")
    assert [h.get_name() for h in logger("a").parent.handlers].count("harborline") == 1 and logger().level == 10


def test_report_is_saved(tmp_path):
    report = ValidationReport()
    report.log_summary()
    assert json.loads(report.save(tmp_path / "r.json").read_text())["summary"]["rules"] == 0
