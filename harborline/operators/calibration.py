"""The calibration profile: what the generators take from the ingested sources, with its JSON and text forms."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.operators.generation import CalibrationError, Profile, age_band, fit_lognormal, joint_demographics, macro_elasticity
from harborline.operators.ranking import exact_quantiles
from harborline.settings import Settings
from harborline.sources.fetch import atomic_write

# Spread of balances where the campaign has none, income and rate where the sources have none.
ANCHOR_SIGMA, GDP_PER_HEAD, RUPEES = 1.25, 2700.0, 88.0
DRIVERS = ["euribor3m", "emp_var_rate", "cons_price_idx", "cons_conf_idx"]
TRAITS = ["age_band", "job", "marital", "education"]
LEAST_BANKS = 5
#: Combinations of traits that a profile holds at most.
MOST_TRAITS = 100_000


@dataclass
class Calibration:
    """Fitted values; None is what the sources do not tell."""

    seed: int
    n_customers: int
    wealth: dict[str, float | str | None]
    demographics: list[dict]
    age: dict[str, float | None]
    lending_rate: float | None
    lending_year: int | None
    deposit_rate: float | None
    conversion_rate: float
    elasticities: dict[str, float]
    envelopes: dict[str, dict[str, float]]
    equity_ratio: float | None
    macro: dict[str, float | None]
    provenance: dict[str, dict] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    def save(self, path: str | Path) -> Path:
        return atomic_write(path, self.to_json().encode())

    def summary(self) -> str:
        show = lambda x, unit="": "unknown" if x is None else f"{x:,.4f}{unit}"
        rows = [("customers", f"{self.n_customers:,}"), ("wealth", f"lognormal({show(self.wealth['mu'])}, {show(self.wealth['sigma'])}) from {self.wealth['source']}")]
        rows += [("traits", f"{len(self.demographics):,} combinations"), ("lending rate", f"{show(self.lending_rate, '%')} ({self.lending_year})"), ("deposit rate", show(self.deposit_rate, "%")), ("conversion", f"{self.conversion_rate:.4%}")]
        rows += [(f"slope of {k}", f"{v:+.4f} log-odds") for k, v in self.elasticities.items()]
        rows += [(f"peers' {k}", f"{e['q1']:.3f} to {e['q3']:.3f}, median {e['median']:.3f}, {e['n']} banks") for k, e in self.envelopes.items()]
        rows += [(k.replace("_", " "), show(v)) for k, v in self.macro.items()]
        return "\n".join(f"{k:<24}{v}" for k, v in rows)

    def profile(self) -> Profile:
        """The generators' parameters; what is unknown keeps its default."""
        known = {"mu": self.wealth["mu"], "sigma": self.wealth["sigma"], "lending_rate": self.lending_rate, "conversion_rate": self.conversion_rate}
        bands = {k: (e["q1"], e["median"], e["q3"]) for k, e in self.envelopes.items()}
        mix = [(d["age_band"], d["marital"], d["education"], d["job"], d["share"]) for d in self.demographics if all(d.get(t) is not None for t in TRAITS)]
        return Profile(seed=self.seed, envelopes=bands, **({"demographics": mix} if mix else {}), **{k: v for k, v in known.items() if v is not None})


def latest_of(macro: DataFrame | None, code: str) -> tuple[float | None, int | None]:
    """The last value an indicator has, and its year."""
    if macro is None or not {"indicator", "year", "value"} <= set(macro.columns):
        return None, None
    r = macro.where((F.col("indicator") == code) & F.col("value").isNotNull()).agg(F.max_by("value", "year").alias("v"), F.max("year").alias("y")).first()
    return r.v, r.y


def latest_rate(rates: DataFrame | None) -> float | None:
    if rates is None or not {"date", "rate"} <= set(rates.columns):
        return None
    rates = rates.where("quote = 'INR'") if "quote" in rates.columns else rates
    return rates.where("rate is not null").agg(F.max_by("rate", "date")).first()[0]


def latest_quarter(panel: DataFrame) -> DataFrame:
    """Each bank's last quarter, so that one with a longer history weighs no more."""
    if "report_date" not in panel.columns:
        return panel
    row = F.struct(*[c for c in panel.columns if c != "CERT"])
    return panel.where("CERT is not null").groupBy("CERT").agg(F.max_by(row, "report_date").alias("r")).select("CERT", "r.*")


def envelope(quarters: DataFrame | None, value: Column, needed: set[str]) -> dict[str, float] | None:
    """Quartiles of a ratio over the banks that have it; None for fewer than five."""
    if quarters is None or not needed <= set(quarters.columns):
        return None
    n = quarters.where(value.isNotNull()).count()
    if n < LEAST_BANKS:
        return None
    q1, median, q3 = exact_quantiles(quarters, {"x": value}, [0.25, 0.5, 0.75])["x"]
    return {"q1": q1, "median": median, "q3": q3, "n": n}


def build_profile(spark: SparkSession, s: Settings, provenance: DataFrame | None = None) -> Calibration:
    """The profile of the sources under ``data/sources``; without the campaign it raises, all others may be absent.

    Wealth is fitted to the campaign's balances; where it has none, its median is a third of a year's
    income per head. A deposit rate that is not published is the lending rate less the peers' margin.
    """

    def read(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{s.data}/sources/{name}")
        except AnalysisException:
            return None

    contacts, macro, panel, rates = (read(n) for n in ("uci_campaign", "worldbank_macro", "fdic_peers", "fx_usd_inr_series"))
    if contacts is None or "subscribed" not in contacts.columns:
        raise CalibrationError("the campaign has not been ingested")
    conversion = contacts.agg(F.avg("subscribed")).first()[0]
    if conversion is None:
        raise CalibrationError("the campaign has no contacts")
    rupees = latest_rate(rates)
    if "balance" in contacts.columns:
        wealth = fit_lognormal(contacts, "balance") | {"source": "campaign balances"}
    else:
        middle = (latest_of(macro, "NY.GDP.PCAP.CD")[0] or GDP_PER_HEAD) * (rupees or RUPEES) / 3
        wealth = {"n": 0, "mu": math.log(middle), "sigma": ANCHOR_SIGMA, "median": middle, "mean": middle * math.exp(ANCHOR_SIGMA**2 / 2), "p90": None, "source": "income per head"}
    people = contacts if "age_band" in contacts.columns or "age" not in contacts.columns else contacts.withColumn("age_band", F.when(F.col("age").isNotNull(), age_band(F.col("age"))))
    ages = {"mean": contacts.agg(F.avg("age")).first()[0], **dict(zip(("p25", "p75"), exact_quantiles(contacts, {"x": F.col("age").cast("double")}, [0.25, 0.75])["x"], strict=True))} if "age" in contacts.columns else {}
    traits = [c for c in TRAITS if c in people.columns]
    mix = [r.asDict() for r in joint_demographics(people, traits).orderBy(*traits).limit(MOST_TRAITS + 1).collect()] if traits else []
    if len(mix) > MOST_TRAITS:
        raise CalibrationError(f"over {MOST_TRAITS} combinations of {', '.join(traits)}: these are no categories")
    quarters = None if panel is None else latest_quarter(panel)
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    bands = {k: envelope(quarters, F.col(k), {k}) for k in ("ROA", "NIMY", "EEFFR", "ROE")}
    bands["LTD"] = envelope(quarters, 100 * ratio("LNLSNET", "DEP"), {"LNLSNET", "DEP"})
    bands = {k: e for k, e in bands.items() if e}
    equity = envelope(quarters, ratio("EQ", "ASSET"), {"EQ", "ASSET"})
    lending, year = latest_of(macro, "FR.INR.LEND")
    deposit = latest_of(macro, "FR.INR.DPST")[0]
    if deposit is None and lending is not None and "NIMY" in bands:
        deposit = lending - bands["NIMY"]["median"]
    slopes = {d: macro_elasticity(contacts, d, "subscribed") for d in DRIVERS}
    named = {"branch_density": "FB.CBK.BRCH.P5", "account_ownership": "FX.OWN.TOTL.ZS", "gdp_growth": "NY.GDP.MKTP.KD.ZG", "inflation": "FP.CPI.TOTL.ZG"}
    context = {k: latest_of(macro, code)[0] for k, code in named.items()} | {"usd_inr": rupees}
    known = {} if provenance is None else {r.source: {"url": r.url, "fetched_at": r.fetched_at, "n_rows": r.n_rows} for r in provenance.where("status = 'ok'").collect()}
    return Calibration(s.seed, s.n_customers, wealth, mix, ages, lending, year, deposit, conversion, {k: v for k, v in slopes.items() if v is not None}, bands, equity and equity["median"], context, known)
