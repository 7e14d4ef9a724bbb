import io
import json
import urllib.error
import zipfile

import pytest

from harborline.operators.report import html_report
from harborline.operators.rules import SUITES, not_null, validate
from harborline.sources import fetch as S
from harborline.sources import parsers as P


def payload(spark, *bodies):
    return spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("1,234", "5,678", "", "N/A", "-", "null", "7", " 8 ", None, "x")], "x string")
    assert [r.v for r in df.select(P.coerce_numeric("x").alias("v")).collect()] == [1234, 5678, None, None, None, None, 7, 8, None, None]


def test_world_bank(spark):
    row = lambda y, v: {"indicator": {"id": "FR.INR.LEND", "value": "Lending"}, "countryiso3code": "IND", "date": str(y), "value": v}
    df = P.world_bank(payload(spark, [{"page": 1}, [row(2021, 8.698333), row(2022, 8.567143), row(2023, None), row(2024, None)]], [{"page": 1}, None]))
    assert df.count() == 4
    assert tuple(P.latest_value(df).first()) == ("FR.INR.LEND", 2022, 8.567143)
    with pytest.raises(Exception, match="error"):
        P.world_bank(payload(spark, [{"message": [{"id": "120"}]}])).collect()


def test_filings_and_fx(spark):
    rows = [{"data": {"CERT": 1, "NAME": "A", "REPDTE": "20240331", "ROA": "99"}}, {"data": {"CERT": 1, "NAME": "A", "REPDTE": "20240630", "ROA": 1.0}}, {"CERT": 2, "NAME": "B", "REPDTE": "20240630", "ROA": 1.2}]
    df = P.bank_filings(payload(spark, {"data": rows}), ["ROA"])
    assert df.count() == 3 and P.peer_quartiles(df, "ROA").first().median == pytest.approx(1.1)
    panel = P.peer_panel(df, df, 1)
    assert sorted((r.CERT, r.ROA, r.institution_name) for r in panel.collect()) == [(1, 1.0, "A"), (2, 1.2, "B")]
    assert P.suspect_units(df) == [] and P.suspect_units(df.withColumn("ROA", df.ROA * 1e6)) == ["ROA"]
    fx = P.fx_series(payload(spark, {"base": "USD", "rates": {"2024-01-02": {"INR": 83.2}, "2024-01-01": {"INR": 83.0, "EUR": 0.9}}}))
    assert fx.count() == 3 and P.usd_inr(fx).first().rate == 83.2
    assert P.fx_latest(payload(spark, {"base": "USD", "date": "2024-01-02", "rates": {"INR": 83.2, "EUR": 0.9}})).count() == 2


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_nested_archive(spark):
    text = 'age;job;y;duration;campaign;emp.var.rate\n30;"admin.";"yes";10;1;1.1\n40;"x";"no";20;3;1.1\n'
    inner = archive({"d/bank-additional-full.csv": text, "d/small.csv": "a\n", "__MACOSX/d/bank-additional-full.csv": "junk"})
    body, name = P.inner_csv(archive({"__MACOSX/x.zip": "junk", "bank-additional.zip": inner}))
    assert name.endswith("bank-additional-full.csv") and body.decode() == text
    assert P.inner_csv(archive({"a.csv": "1", "b.csv": "123"}), "none")[1] == "b.csv"
    with pytest.raises(P.SourceError):
        P.inner_csv(archive({"readme.txt": "x"}))
    df = P.campaign_contacts(spark, text)
    assert df.columns == ["age", "job", "y", "campaign", "emp_var_rate", "subscribed"]
    assert P.campaign_summary(df).first().conversion_rate == 0.5


class Reply(io.BytesIO):
    pass


def test_fetch_retries_and_caches(tmp_path):
    calls = []

    def flaky(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise OSError("reset")
        return Reply(b"body")

    get = lambda **k: S.get_bytes("http://x/y", {"b": 1, "a": 2}, str(tmp_path), pause=lambda s: None, **k)
    assert get(opener=flaky).body == b"body" and calls[0] == "http://x/y?a=2&b=1" and len(calls) == 3
    assert get(opener=flaky).from_cache and len(calls) == 3

    def gone(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 404, "gone", {}, None)

    assert get(opener=gone, refresh=True).from_cache
    with pytest.raises(P.SourceError):
        S.get_bytes("http://x/z", opener=gone, pause=lambda s: None)


def test_registry_and_report(spark, tmp_path):
    good = S.Source("good", lambda s: s.range(3))
    bad = S.Source("bad", lambda s: 1 / 0, required=False)
    rows = S.ingest_all(spark, [good, bad], str(tmp_path)).to_frame(spark).collect()
    assert [(r.source, r.status, r.n_rows) for r in rows] == [("good", "ok", 3), ("bad", "failed", 0)]
    with pytest.raises(P.SourceError):
        S.ingest_all(spark, [S.Source("bad", lambda s: 1 / 0)], str(tmp_path))
    report = validate(spark.createDataFrame([(None,)], "a string"), [not_null("a"), not_null("<b>")], "t<")
    page = html_report(report, [["s", "ok", 1, "u"]], [["a", 1, 1, 0]], {"t": "close conformity"})
    assert "failed" in page and "t&lt;" in page and "Skipped" in page
    S.write_json(tmp_path / "r.json", {"a": 1})
    assert S.read_json(tmp_path / "r.json") == {"a": 1} and S.human_size(2048) == "2.0 KB"
    assert sum(len(s()) for s in SUITES.values()) == 36


def test_conditional_requests_and_sidecars(tmp_path):
    asked = []

    class Reply(io.BytesIO):
        headers = {"ETag": '"v1"', "Last-Modified": "Mon, 01 Jan 2024 00:00:00 GMT", "Content-Type": "text/csv"}

    def opener(request, timeout):
        asked.append({k.lower(): v for k, v in request.header_items()})
        if asked[-1].get("if-none-match") == '"v1"':
            raise urllib.error.HTTPError(request.full_url, 304, "not modified", {}, None)
        return Reply(b"body")

    get = lambda **k: S.get_bytes("http://x/y", {"a": 1}, str(tmp_path), pause=lambda s: None, opener=opener, **k)
    first = get()
    side = next(tmp_path.glob("*.meta.json"))
    meta = S.read_json(side)
    assert not first.from_cache and first.content_type == "text/csv" and meta["url"] == "http://x/y?a=1" and meta["etag"] == '"v1"' and meta["sha256"] == first.sha256 and meta["size"] == 4
    assert get().from_cache and len(asked) == 1
    S.write_json(side, meta | {"checked_at": 0, "fetched_at": 5.0})
    again = get()
    assert again.from_cache and not again.stale and again.fetched_at == 5.0 and asked[-1]["if-modified-since"].startswith("Mon") and S.read_json(side)["checked_at"] > 1e9
    assert get().from_cache and len(asked) == 2  # good for another ttl
    assert not get(refresh=True).from_cache and "if-none-match" not in asked[-1]
    S.write_json(side, S.read_json(side) | {"checked_at": 0})

    def gone(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 404, "gone", {}, None)

    stale = S.get_bytes("http://x/y", {"a": 1}, str(tmp_path), opener=gone)
    assert stale.from_cache and stale.stale and stale.body == b"body"
    side.with_name(side.name.removesuffix(".meta.json")).write_bytes(b"torn")
    assert not get().from_cache  # a body that is not the sidecar's is fetched anew
    assert S.file_sha256(side) == S.sha256(side.read_bytes())
