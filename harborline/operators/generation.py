"""Calibration of a synthetic bank on public aggregates, and its generators.

Every random number is a hash of the seed, a stream name and the row's own keys, so results are the
same for any partitioning and order, and each table can be generated alone. Sequences over time (churn
states, campaign memory) fold over an array of a customer's months or campaigns inside the row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.functions.distributions import betainc
from harborline.operators.models import sigmoid
from harborline.operators.ranking import exact_quantiles
from harborline.settings import EngineError

#: The mean up to which one inversion draws a Poisson number.
PART = 256

# ---- fixed values of the generated bank ------------------------------------------------------------
CITIES = [
    ("Mumbai", "Maharashtra", 0.18),
    ("Delhi", "Delhi", 0.14),
    ("Bengaluru", "Karnataka", 0.12),
    ("Chennai", "Tamil Nadu", 0.09),
    ("Hyderabad", "Telangana", 0.08),
    ("Pune", "Maharashtra", 0.07),
    ("Kolkata", "West Bengal", 0.07),
    ("Ahmedabad", "Gujarat", 0.06),
    ("Jaipur", "Rajasthan", 0.05),
    ("Lucknow", "Uttar Pradesh", 0.04),
    ("Kochi", "Kerala", 0.04),
    ("Indore", "Madhya Pradesh", 0.03),
    ("Chandigarh", "Punjab", 0.03),
]
JOB_WEALTH = {"management": 2.4, "entrepreneur": 2.0, "self-employed": 1.6, "admin.": 1.0, "technician": 1.1, "services": 0.8, "blue-collar": 0.7, "housemaid": 0.5, "retired": 0.9, "student": 0.25, "unemployed": 0.35, "unknown": 0.9}
EDUCATION_WEALTH = {"university.degree": 1.5, "professional.course": 1.3, "high.school": 1.0, "basic.9y": 0.8, "basic.6y": 0.7, "basic.4y": 0.65, "illiterate": 0.5, "unknown": 0.95}
#: Acquisition channel: share at the window's start, and how it drifts to the end.
ACQUISITION = [("branch", 0.46, -0.22), ("digital", 0.18, 0.26), ("partner", 0.14, -0.02), ("telesales", 0.12, -0.01), ("dsa", 0.10, -0.01)]
SEGMENTS = [("private", 10_000_000), ("priority", 3_000_000), ("affluent", 1_200_000), ("mass", 0)]
#: code, name, category, rate offset, adoption, least income, annual fee, balance as a multiple of income, least balance
PRODUCTS = [
    ("SAV", "Savings Account", "deposit", -5.2, 0.97, 0, 0, 0.18, 500.0),
    ("CUR", "Current Account", "deposit", -8.0, 0.16, 600_000, 1_200, 0.30, 500.0),
    ("FD", "Fixed Deposit", "deposit", -1.8, 0.34, 250_000, 0, 0.55, 500.0),
    ("RD", "Recurring Deposit", "deposit", -2.4, 0.19, 180_000, 0, 0.12, 500.0),
    ("PL", "Personal Loan", "lending", 3.0, 0.13, 300_000, 0, 0.62, 500.0),
    ("HL", "Home Loan", "lending", -0.3, 0.09, 800_000, 0, 2.62, 500.0),
    ("AL", "Auto Loan", "lending", 0.9, 0.08, 500_000, 0, 0.54, 500.0),
    ("GL", "Gold Loan", "lending", 1.2, 0.06, 0, 0, 0.18, 500.0),
    ("CC", "Credit Card", "card", 14.0, 0.28, 360_000, 500, 0.09, 0.0),
    ("MF", "Mutual Fund", "investment", 0.0, 0.15, 500_000, 0, 0.45, 500.0),
    ("INS", "Insurance", "investment", 0.0, 0.21, 300_000, 0, 0.25, 500.0),
    ("DMT", "Demat Account", "investment", 0.0, 0.09, 700_000, 300, 0.30, 0.0),
]
SEGMENT_ADOPTION = {"mass": 0.85, "affluent": 1.2, "priority": 1.45, "private": 1.6}
#: Log-odds of the monthly churn hazard: the ground truth that models are to recover.
HAZARD = {"intercept": -2.55, "log_tenure": -0.32, "txn_recency_months": 0.44, "n_products": -0.38, "digital_engagement": -0.55, "log_balance": -0.22, "fee_paid_recently": 0.21, "age_scaled": -0.16, "is_salaried": -0.19, "complaint_active": 0.68, "rate_delta_pp": 0.13, "structural_break": 0.85}
FRAILTY_SIGMA, BREAK_AT = 0.6, 0.62
#: type, direction, share of volume, mean amount as a fraction of monthly income
TXN_TYPES = [
    ("SALARY_CREDIT", "credit", 0.06, 0.85),
    ("UPI_PAYMENT", "debit", 0.34, 0.020),
    ("CARD_SPEND", "debit", 0.16, 0.045),
    ("ATM_WITHDRAWAL", "debit", 0.11, 0.060),
    ("NEFT_TRANSFER", "debit", 0.08, 0.180),
    ("BILL_PAYMENT", "debit", 0.10, 0.035),
    ("EMI_DEBIT", "debit", 0.05, 0.150),
    ("INTEREST_CREDIT", "credit", 0.04, 0.012),
    ("CHEQUE_DEPOSIT", "credit", 0.03, 0.320),
    ("FEE_DEBIT", "debit", 0.03, 0.008),
]
MERCHANTS = ["groceries", "fuel", "dining", "travel", "utilities", "healthcare", "education", "apparel", "electronics", "entertainment", "insurance", "other"]
SEASON = [0.94, 0.90, 1.05, 0.98, 1.00, 0.96, 0.99, 1.02, 1.08, 1.24, 1.18, 1.06]
#: id, name, product, channel, first month, months, segment, cost per contact, share of the eligible
CAMPAIGNS = [
    ("CMP001", "Festive Gold Loan Push", "GL", "telesales", 9, 3, "all", 42.0, 0.30),
    ("CMP002", "Salary Account Upgrade", "CUR", "branch", 4, 4, "mass", 65.0, 0.22),
    ("CMP003", "Premium Card Acquisition", "CC", "digital", 12, 6, "affluent", 28.0, 0.45),
    ("CMP004", "Fixed Deposit Rate Drive", "FD", "telesales", 18, 3, "all", 40.0, 0.35),
    ("CMP005", "Home Loan Balance Transfer", "HL", "dsa", 24, 5, "priority", 180.0, 0.55),
    ("CMP006", "Digital Onboarding Nudge", "MF", "digital", 28, 4, "all", 18.0, 0.40),
    ("CMP007", "Insurance Cross-Sell", "INS", "telesales", 33, 4, "all", 38.0, 0.28),
    ("CMP008", "Recurring Deposit Campaign", "RD", "branch", 38, 3, "mass", 55.0, 0.25),
    ("CMP009", "Wealth Advisory Outreach", "DMT", "branch", 44, 4, "private", 320.0, 0.70),
    ("CMP010", "Personal Loan Pre-Approved", "PL", "digital", 48, 5, "all", 22.0, 0.33),
    ("CMP011", "Auto Loan Festive Offer", "AL", "dsa", 55, 3, "affluent", 150.0, 0.40),
    ("CMP012", "Savings Reactivation", "SAV", "digital", 58, 4, "all", 15.0, 0.50),
]
#: Contacts of one customer in one campaign at most.
MOST_CONTACTS = 8
OUTCOME_EFFECT, SEGMENT_RESPONSE = {"success": 3.1, "failure": 0.72, "nonexistent": 1.0}, {"mass": 0.9, "affluent": 1.15, "priority": 1.3, "private": 1.45}


# ---- random numbers ----------------------------------------------------------------------------------
def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the seed, the stream and the keys only."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, stream: str, *keys: Column) -> Column:
    radius = F.sqrt(-2 * F.log(uniform(seed, stream + "/r", *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, stream + "/a", *keys))


def lognormal(mu: float, sigma: float, seed: int, stream: str, *keys: Column) -> Column:
    return F.exp(mu + sigma * normal(seed, stream, *keys))


def chosen(u: Column, values: list, weights: list) -> Column:
    """The value whose share of the weights holds u."""
    total, upto, out = sum(weights, F.lit(0.0)) if isinstance(weights[0], Column) else sum(weights), 0.0, F.lit(values[-1])
    edges = []
    for w in weights[:-1]:
        upto = upto + w
        edges.append(upto / total)
    for v, e in reversed(list(zip(values, edges, strict=False))):
        out = F.when(u < e, F.lit(v)).otherwise(out)
    return out


def poisson(u: Column, mean: Column) -> Column:
    """The least k whose cumulative chance reaches u, for means up to 700, where exp(-mean) is a number.

    The search is as long as it takes: beyond the mean and its twelve deviations there is less than 2**-53.
    It ends where a further term no longer moves the sum."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    step = lambda s, i: F.when((s["c"] >= u) | ((s["k"] > mean) & (s["p"] < 1e-17)), s).otherwise(F.struct((s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"), i.alias("k")))
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def poisson_draw(mean: Column, seed: int, stream: str, *keys: Column) -> Column:
    """A Poisson number of any mean: the sum of draws of PART or less each, with numbers of their own."""
    parts = F.greatest(F.lit(1), F.ceil(mean / PART)).cast("int")
    one = lambda j: poisson(F.when(j == 0, uniform(seed, stream, *keys)).otherwise(uniform(seed, stream, j, *keys)), mean / parts)
    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, j: n + one(j))


def geometric(u: Column, p: float) -> Column:
    """Trials up to the first success, by inversion."""
    return F.greatest(F.lit(1), F.ceil(F.log(u) / math.log(1 - p))).cast("int")


@cache
def beta_quantiles(a: float, b: float, parts: int = 1 << 12) -> list[float]:
    """The quantiles at i / parts, to the last bits of a double, by bisection of the incomplete beta function."""
    out = [0.0]
    for i in range(1, parts):
        low, high = out[-1], 1.0
        while (middle := (low + high) / 2) not in (low, high):
            low, high = (middle, high) if betainc(a, b, middle) * parts < i else (low, middle)
        out.append(high)
    return [*out, 1.0]


def beta(a: float, b: float, seed: int, stream: str, *keys: Column, parts: int = 1 << 10) -> Column:
    """By inversion: between exact quantiles 1 / parts apart, along a line; next to 0 and 1 along the power that the density follows there."""
    table, place = F.array(*map(F.lit, beta_quantiles(a, b, parts))), uniform(seed, stream, *keys) * parts
    i = F.floor(place).cast("int")
    low, high, share = F.get(table, i), F.get(table, i + 1), place - i
    first, last = high * F.pow(share, F.lit(1 / a)), 1 - (1 - low) * F.pow(1 - share, F.lit(1 / b))
    return F.when(i == 0, first).when(i == parts - 1, last).otherwise(low + (high - low) * share)


def zscored(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with standardised columns; 0 where nothing varies."""
    stats = df.agg(F.struct(*[F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(n) for n, v in values.items()])).scalar()
    out = df.withColumn("_z", stats)
    for n, v in values.items():
        z = F.col("_z")[n]
        out = out.withColumn(n, F.when(z["s"] > 0, (v - z["m"]) / z["s"]).otherwise(0.0))
    return out.drop("_z")


# ---- calibration -------------------------------------------------------------------------------------
class CalibrationError(EngineError):
    """Too little data to calibrate on, or a portfolio outside its peers' range."""


@dataclass(frozen=True)
class Window:
    start: date
    end: date

    @property
    def n_months(self) -> int:
        return (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1

    def months(self) -> Column:
        return F.sequence(F.trunc(F.lit(str(self.start)).cast("date"), "MM"), F.lit(str(self.end)).cast("date"), F.expr("interval 1 month"))


@dataclass
class Profile:
    seed: int = 20260911
    mu: float = 11.36
    sigma: float = 1.25
    lending_rate: float = 8.567143
    conversion_rate: float = 0.1127
    demographics: list[tuple] = field(default_factory=lambda: [("25-34", "single", "university.degree", "management", 0.3), ("35-44", "married", "high.school", "admin.", 0.4), ("55-64", "married", "basic.9y", "retired", 0.2), ("<25", "single", "high.school", "student", 0.1)])
    envelopes: dict[str, tuple[float, float, float]] = field(default_factory=dict)


def fit_lognormal(df: DataFrame, column: str, least: int = 30) -> dict[str, float]:
    x = F.col(column).cast("double")
    positive = df.where(x > 0)
    r = positive.agg(F.count("*").alias("n"), F.avg(F.log(x)).alias("mu"), F.stddev_samp(F.log(x)).alias("sigma"), F.avg(x).alias("mean")).first()
    if r.n < least:
        raise CalibrationError(f"{r.n} positive values, {least} needed")
    median, p90 = exact_quantiles(positive, {"x": x}, [0.5, 0.9])["x"]
    return r.asDict() | {"median": median, "p90": p90}


def age_band(age: Column) -> Column:
    """Right-closed bands."""
    out = F.lit("65+")
    for top, name in ((65, "55-64"), (55, "45-54"), (45, "35-44"), (35, "25-34"), (25, "<25")):
        out = F.when(age <= top, name).otherwise(out)
    return out


def joint_demographics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every combination with its share; columns that the table lacks are left out."""
    columns = [c for c in columns if c in df.columns]
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def macro_elasticity(df: DataFrame, driver: str, outcome: str) -> float | None:
    """Log-odds slope of the outcome between the lowest and the highest third of the driver; None without one that varies."""
    if driver not in df.columns or outcome not in df.columns:
        return None
    q = exact_quantiles(df, {"x": F.col(driver)}, [1 / 3, 2 / 3])["x"]
    if q[0] is None:
        return None
    low, high = F.col(driver) <= q[0], F.col(driver) >= q[1]
    r = df.agg(*[F.avg(F.when(c, F.col(x).cast("double"))).alias(n) for c, s in ((low, "l"), (high, "h")) for x, n in ((driver, f"x{s}"), (outcome, f"y{s}"))]).first()
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    return (odds(r.yh) - odds(r.yl)) / (r.xh - r.xl) if None not in tuple(r) and r.xh != r.xl else None


def assert_calibrated(ratios: dict[str, float], envelopes: dict[str, tuple[float, float, float]], strict: bool = True) -> dict[str, str]:
    """Each ratio as inside, outside or unchecked; strict raises if one is outside. Unchecked is not passed."""
    found = {k: "unchecked" if k not in envelopes else "inside" if envelopes[k][0] <= v <= envelopes[k][2] else "outside" for k, v in ratios.items()}
    if strict and "outside" in found.values():
        raise CalibrationError(", ".join(f"{k}={ratios[k]:.3f} outside {envelopes[k]}" for k, s in found.items() if s == "outside"))
    return found


# ---- generators --------------------------------------------------------------------------------------
def generate_customers(spark: SparkSession, n: int, p: Profile, w: Window) -> DataFrame:
    i = F.col("id")
    u = lambda stream, *more: uniform(p.seed, stream, i, *more)
    months, count = w.months(), w.n_months
    # the book grows: the last month draws 2.5 times the first
    grown = (F.sqrt(1 + (2.5**2 - 1) * u("month")) - 1) / 1.5
    at = F.least(F.floor(grown * count), F.lit(count - 1)).cast("int")
    kinds = F.array(*[F.struct(F.lit(a).alias("age_band"), F.lit(m).alias("marital"), F.lit(e).alias("education"), F.lit(j).alias("job")) for a, m, e, j, _ in p.demographics])
    kind = chosen(u("kind"), list(range(len(p.demographics))), [d[-1] for d in p.demographics])
    cities = F.array(*[F.struct(F.lit(c).alias("city"), F.lit(s).alias("state")) for c, s, _ in CITIES])
    city = chosen(u("city"), list(range(len(CITIES))), [c[-1] for c in CITIES])
    base = spark.range(n).select(i, F.format_string("CUST%07d", i + 1).alias("customer_id"), F.get(kinds, kind).alias("k"), F.get(cities, city).alias("c"), F.date_add(F.get(months, at), F.floor(u("day") * 28).cast("int")).alias("acquired_date"), F.when(u("gender") < 0.52, "M").otherwise("F").alias("gender"))
    spans = {"<25": (18, 7), "25-34": (26, 9), "35-44": (36, 9), "45-54": (46, 9), "55-64": (56, 9), "65+": (66, 20)}
    low, width = F.lit(40), F.lit(10)
    for band, (a, b) in spans.items():
        low, width = F.when(F.col("k.age_band") == band, a).otherwise(low), F.when(F.col("k.age_band") == band, b).otherwise(width)
    base = base.withColumn("age", (low + F.floor(u("age") * width)).cast("int")).select("*", "k.*", "c.*").drop("k", "c")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff("acquired_date", F.lit(str(w.start)).cast("date")) / max((w.end - w.start).days, 1)))
    base = base.withColumn("acquisition_channel", chosen(u("channel"), [c for c, _, _ in ACQUISITION], [a + b * t for _, a, b in ACQUISITION]))
    job, study = F.lit(1.0), F.lit(1.0)
    for k, v in JOB_WEALTH.items():
        job = F.when(F.col("job") == k, v).otherwise(job)
    for k, v in EDUCATION_WEALTH.items():
        study = F.when(F.col("education") == k, v).otherwise(study)
    income = lognormal(p.mu, p.sigma, p.seed, "income", i) * job * study * (0.55 + 0.9 * F.exp(-F.pow(F.col("age") - 52, F.lit(2)) / (2 * 17**2))) * 2.4
    floor = F.when(F.col("job").isin("student", "unemployed"), 45_000.0).otherwise(180_000.0)
    base = base.withColumn("_raw", income).withColumn("annual_income_inr", F.round(F.when(F.col("_raw") < floor, floor * (0.75 + 0.35 * u("floor"))).otherwise(F.col("_raw")), -2)).drop("_raw")
    segment = F.lit("mass")
    for name, least in reversed(SEGMENTS):
        segment = F.when(F.col("annual_income_inr") >= least, name).otherwise(segment)
    base = zscored(base.withColumn("segment", segment), {"_iz": F.log1p("annual_income_inr"), "_az": F.col("age")})
    score = 690 + 95 * (0.45 * F.col("_iz") + 0.25 * F.col("_az") + 0.85 * normal(p.seed, "score", i))
    latent = 0.2 - 0.035 * (F.col("age") - 40) + 0.30 * F.col("_iz") + 0.9 * (F.col("acquisition_channel") == "digital").cast("double") + 0.7 * normal(p.seed, "digital", i)
    end = F.lit(str(w.end)).cast("date")
    return base.select(
        "id", "customer_id", "age", "age_band", "gender", "marital", "education", "job", (~F.col("job").isin("student", "unemployed", "retired", "housemaid")).cast("int").alias("is_salaried"), "city", "state", "segment", "annual_income_inr", F.greatest(F.lit(300), F.least(F.lit(900), F.round(score))).cast("int").alias("credit_score"),
        F.greatest(F.lit(0.01), F.least(F.lit(0.99), sigmoid(latent))).alias("digital_engagement"), "acquisition_channel", "acquired_date", F.greatest(F.lit(0), (F.year(end) - F.year("acquired_date")) * 12 + F.month(end) - F.month("acquired_date")).cast("int").alias("tenure_months"), lognormal(0.0, FRAILTY_SIGMA, p.seed, "frailty", i).alias("frailty"),
    )


def product_dimension(spark: SparkSession, p: Profile) -> DataFrame:
    rows = [(i, code, name, kind, round(max(p.lending_rate + off, 0.0), 4), off, float(fee), float(least), int(code == "SAV"), adoption, multiple, floor) for i, (code, name, kind, off, adoption, least, fee, multiple, floor) in enumerate(PRODUCTS, 1)]
    return spark.createDataFrame(rows, "product_key int, product_code string, product_name string, category string, interest_rate_pct double, rate_offset_pp double, annual_fee_inr double, min_income_inr double, is_anchor int, adoption double, multiple double, floor double")


def generate_holdings(customers: DataFrame, p: Profile, w: Window) -> DataFrame:
    """Customer by product: the savings account first, everything else gated on it."""
    i, code = F.col("id"), F.col("product_code")
    u = lambda stream: uniform(p.seed, stream, i, code)
    # the catalogue is a dozen fixed rows
    both = customers.crossJoin(F.broadcast(product_dimension(customers.sparkSession, p)))
    anchor = uniform(p.seed, "anchor", i) < PRODUCTS[0][4]
    segment = F.lit(1.0)
    for k, v in SEGMENT_ADOPTION.items():
        segment = F.when(F.col("segment") == k, v).otherwise(segment)
    credit = F.when(F.col("category").isin("lending", "card"), F.greatest(F.lit(0.05), F.least(F.lit(1.6), (F.col("credit_score") - 550) / 250))).otherwise(1.0)
    digital = F.when(F.col("category") == "investment", 0.6 + 0.9 * F.col("digital_engagement")).otherwise(1.0)
    chance = F.col("adoption") * segment * (0.55 + 0.45 * (1 - F.exp(-F.col("tenure_months") / 24.0))) * credit * digital
    held = F.when(F.col("is_anchor") == 1, anchor).otherwise(anchor & (F.col("annual_income_inr") >= F.col("min_income_inr")) & (u("held") < F.least(chance, F.lit(0.98))))
    span = F.greatest(F.lit(0), F.datediff(F.lit(str(w.end)).cast("date"), "acquired_date"))
    opened = F.date_add("acquired_date", F.floor(span * beta(1.4, 3.0, p.seed, "opened", i, code)).cast("int"))
    balance = F.round(F.greatest(F.col("annual_income_inr") * F.col("multiple") * lognormal(0.0, 0.55, p.seed, "balance", i, code), F.col("floor")), -1)
    return both.where(held).select("customer_id", "product_code", "category", opened.alias("opened_date"), balance.alias("balance_inr"), "interest_rate_pct", "annual_fee_inr")


def generate_churn(customers: DataFrame, holdings: DataFrame, p: Profile, w: Window) -> tuple[DataFrame, DataFrame]:
    """The at-risk panel (customer by month) and one outcome per customer, censored or churned.

    Recency and complaints carry over from month to month, so each customer's months are folded in
    order within the row; nothing is exchanged between customers but the balance's mean and deviation.
    """
    sums = holdings.groupBy("customer_id").agg(F.count("*").alias("n_products"), F.sum("balance_inr").alias("b"), F.sum("annual_fee_inr").alias("f"))
    base = customers.join(sums, "customer_id", "left").na.fill(0, ["n_products", "b", "f"])
    base = zscored(base, {"log_balance": F.log1p("b")}).withColumn("months", w.months())
    i, h, cut = F.col("id"), HAZARD, int(w.n_months * BREAK_AT)
    static = h["intercept"] + h["n_products"] * F.col("n_products") + h["digital_engagement"] * F.col("digital_engagement") + h["log_balance"] * F.col("log_balance") + h["fee_paid_recently"] * (F.col("f") > 0).cast("double") + h["age_scaled"] * (F.col("age") - 40) / 15.0 + h["is_salaried"] * F.col("is_salaried") + F.log("frailty")
    base = base.withColumn("static", static)
    lapse = F.greatest(F.lit(0.02), F.least(F.lit(0.4), 0.16 - 0.10 * F.col("digital_engagement")))

    def rate(m: Column) -> Column:
        return 0.6 * F.sin(m / 9.0)

    def month(s: Column, m: Column) -> Column:
        day = F.get("months", m)
        recency = F.when(uniform(p.seed, "lapse", i, m) < lapse, s["recency"] + 1).otherwise(0.0)
        complaint = F.when(uniform(p.seed, "complaint", i, m) < 0.021, 3.0).otherwise(F.greatest(s["complaint"] - 1, F.lit(0.0)))
        tenure = F.greatest(F.lit(0), (F.year(day) - F.year("acquired_date")) * 12 + F.month(day) - F.month("acquired_date"))
        x = F.col("static") + h["log_tenure"] * F.log1p(tenure.cast("double")) + h["txn_recency_months"] * F.least(recency, F.lit(12.0)) + h["complaint_active"] * (complaint > 0).cast("double") + h["rate_delta_pp"] * rate(m) + F.when(m >= cut, h["structural_break"]).otherwise(0.0)
        risk = s["active"] & (F.col("acquired_date") <= day)
        hazard = sigmoid(x)
        gone = risk & (uniform(p.seed, "churn", i, m) < hazard)
        row = F.struct(day.alias("month"), tenure.cast("int").alias("tenure_months"), F.least(recency, F.lit(12.0)).alias("txn_recency_months"), (complaint > 0).cast("int").alias("complaint_active"), rate(m).alias("lending_rate_delta_pp"), hazard.alias("hazard"), gone.cast("int").alias("churned"))
        rows = F.when(risk, F.concat(s["rows"], F.array(row))).otherwise(s["rows"])
        return F.struct(recency.alias("recency"), complaint.alias("complaint"), (s["active"] & ~gone).alias("active"), rows.alias("rows"))

    kind = "array<struct<month:date,tenure_months:int,txn_recency_months:double,complaint_active:int,lending_rate_delta_pp:double,hazard:double,churned:int>>"
    start = F.struct(F.lit(0.0).alias("recency"), F.lit(0.0).alias("complaint"), F.lit(True).alias("active"), F.array().cast(kind).alias("rows"))
    lives = base.withColumn("life", F.aggregate(F.sequence(F.lit(0), F.lit(w.n_months - 1)), start, month))
    panel = lives.select("customer_id", F.col("n_products").cast("int").alias("n_products"), F.col("b").alias("total_balance_inr"), "digital_engagement", F.explode("life.rows").alias("r")).select("customer_id", "r.*", "n_products", "total_balance_inr", "digital_engagement")
    gone = F.size(F.filter("life.rows", lambda r: r["churned"] == 1)) > 0
    outcomes = lives.select("customer_id", "acquired_date", F.when(gone, F.try_element_at(F.filter("life.rows", lambda r: r["churned"] == 1), F.lit(1))["month"]).alias("churn_date"), gone.cast("int").alias("churned"), (~gone).cast("int").alias("censored"), F.size("life.rows").alias("observed_months"))
    return panel, outcomes


def live_months(df: DataFrame, since: str, w: Window) -> DataFrame:
    """A row for each month of the window from ``since`` until before churn."""
    first = F.greatest(F.trunc(since, "MM"), F.trunc(F.lit(str(w.start)).cast("date"), "MM"))
    last = F.coalesce(F.date_sub(F.trunc("churn_date", "MM"), 1), F.lit(str(w.end)).cast("date"))
    live = df.where(first <= last)
    return live.withColumn("month", F.explode(F.sequence(first, F.trunc(last, "MM"), F.expr("interval 1 month"))))


def season(month: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in SEASON]), F.month(month) - 1)


def generate_transactions(customers: DataFrame, outcomes: DataFrame, p: Profile, w: Window) -> DataFrame:
    base = zscored(customers, {"_iz": F.log1p("annual_income_inr")}).join(outcomes.select("customer_id", "churn_date"), "customer_id", "left")
    mean = F.greatest(F.lit(0.4), F.least(F.lit(14.0), 1.4 + 3.4 * F.col("digital_engagement") + 1.1 * F.col("_iz"))) * season(F.col("month"))
    i, m = F.col("id"), F.col("month")
    counted = live_months(base, "acquired_date", w).withColumn("n", poisson_draw(mean, p.seed, "n_txn", i, m))
    rows = counted.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    u = lambda stream: uniform(p.seed, stream, i, m, F.col("k"))
    kind = chosen(u("type"), list(range(len(TXN_TYPES))), [t[2] for t in TXN_TYPES])
    types = F.array(*[F.struct(F.lit(a).alias("txn_type"), F.lit(b).alias("direction"), F.lit(f).alias("f")) for a, b, _, f in TXN_TYPES])
    rows = rows.withColumn("t", F.get(types, kind)).withColumn("cu", u("channel"))
    d, cu = F.col("digital_engagement"), F.col("cu")
    channel = F.when(cu < d * 0.55, "mobile").when(cu < d * 0.80, "upi").when(cu < d * 0.90, "internet").when(cu < 0.94, "pos").when(cu < 0.98, "atm").otherwise("branch")
    amount = F.round(F.greatest(F.col("annual_income_inr") / 12 * F.col("t.f") * lognormal(0.0, 0.85, p.seed, "amount", i, m, F.col("k")), F.lit(10.0)), 2)
    day = F.date_add(m, F.floor(u("day") * F.dayofmonth(F.last_day(m))).cast("int"))
    shop = F.when(F.col("t.txn_type").isin("CARD_SPEND", "UPI_PAYMENT"), F.get(F.array(*map(F.lit, MERCHANTS)), F.floor(u("shop") * len(MERCHANTS)).cast("int"))).otherwise("")
    # an id of the row's own keys needs no global numbering
    txn = F.concat_ws("-", F.lit("TXN"), F.col("customer_id"), F.date_format(m, "yyyyMM"), F.col("k").cast("string"))
    return rows.select(txn.alias("txn_id"), "customer_id", day.alias("txn_date"), "month", "t.txn_type", "t.direction", amount.alias("amount_inr"), channel.alias("channel"), shop.alias("merchant_category"))


def generate_monthly_snapshots(holdings: DataFrame, outcomes: DataFrame, p: Profile, w: Window) -> DataFrame:
    base = live_months(holdings.join(outcomes.select("customer_id", "churn_date"), "customer_id", "left"), "opened_date", w)
    m, s = F.col("month"), season(F.col("month"))
    age = F.greatest(F.lit(0), (F.year(m) - F.year("opened_date")) * 12 + F.month(m) - F.month("opened_date")).cast("int")
    swing = F.when(F.col("category") == "deposit", 2 - s).otherwise(s)
    balance = F.round(F.greatest(F.col("balance_inr") * F.pow(F.lit(1.004), age) * lognormal(0.0, 0.07, p.seed, "snapshot", F.col("customer_id"), F.col("product_code"), m) * swing, F.lit(0.0)), 2)
    rows = base.withColumn("account_age_months", age).withColumn("balance_inr", balance)
    rate = F.col("interest_rate_pct")
    margin = F.when(F.col("category").isin("lending", "card"), rate).when(F.col("category") == "deposit", F.greatest(p.lending_rate - rate, F.lit(0.0))).otherwise(0.9)
    interest, fee = F.col("balance_inr") * margin / 100 / 12, F.col("annual_fee_inr") / 12
    return rows.select("customer_id", "product_code", "category", "month", "balance_inr", "interest_rate_pct", F.round(interest, 2).alias("interest_revenue_inr"), F.round(fee, 2).alias("fee_revenue_inr"), F.round(interest + fee, 2).alias("total_revenue_inr"), "account_age_months")


def generate_campaign_contacts(customers: DataFrame, holdings: DataFrame, outcomes: DataFrame, p: Profile, w: Window) -> DataFrame:
    """Contacts of the campaigns that start in the window; a customer's outcomes carry over to later ones."""
    owned = holdings.groupBy("customer_id").agg(F.collect_set("product_code").alias("owned"))
    base = customers.join(outcomes.select("customer_id", "churn_date"), "customer_id", "left").join(owned, "customer_id", "left").withColumn("owned", F.coalesce("owned", F.array().cast("array<string>")))
    base = base.withColumn("months", w.months())
    names = ("campaign_id", "name", "product_code", "channel", "at", "months", "segment", "cost", "share")
    plan = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c, strict=True)]) for c in sorted(CAMPAIGNS, key=lambda c: c[4]) if c[4] < w.n_months])
    i = F.col("id")
    pick = lambda table, key, default=1.0: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))
    # fixed values: what a channel multiplies the base conversion rate by
    multiplier = {"digital": 1.15, "telesales": 0.85, "branch": 1.30, "dsa": 0.95}
    kind = "array<struct<campaign_id:string,contact_sequence:int,contact_date:date,channel:string,product_code:string,prior_outcome:string,n_prior_contacts:int,response_probability:double,converted:int,cost_inr:double>>"

    def attempt(c: Column) -> object:
        def one(s: Column, k: Column) -> Column:
            chance = F.lit(p.conversion_rate) * pick(multiplier, c["channel"]) * F.pow(F.lit(0.72), k - 1) * pick(OUTCOME_EFFECT, s["before"]) * F.pow(F.lit(0.94), F.least(s["n"], F.lit(12))) * pick(SEGMENT_RESPONSE, F.col("segment"))
            chance = F.greatest(F.lit(0.001), F.least(F.lit(0.85), F.when(c["channel"] == "digital", chance * (0.55 + 0.9 * F.col("digital_engagement"))).otherwise(chance)))
            won = uniform(p.seed, "response", i, c["campaign_id"], k) < chance
            day = F.date_add(F.get("months", c["at"]), F.floor(uniform(p.seed, "contact", i, c["campaign_id"], k) * 28 * c["months"]).cast("int"))
            row = F.struct(c["campaign_id"].alias("campaign_id"), k.alias("contact_sequence"), day.alias("contact_date"), c["channel"].alias("channel"), c["product_code"].alias("product_code"), s["before"].alias("prior_outcome"), s["n"].alias("n_prior_contacts"), F.round(chance, 6).alias("response_probability"), won.cast("int").alias("converted"), c["cost"].alias("cost_inr"))
            return F.when(s["won"], s).otherwise(F.struct(s["before"].alias("before"), (s["n"] + 1).alias("n"), won.alias("won"), F.concat(s["rows"], F.array(row)).alias("rows")))

        return one

    def campaign(s: Column, c: Column) -> Column:
        start = F.get("months", c["at"])
        fits = (F.col("acquired_date") <= start) & (F.col("churn_date").isNull() | (F.col("churn_date") > start)) & ((c["segment"] == "all") | (c["segment"] == F.col("segment"))) & ~F.array_contains("owned", c["product_code"]) & (uniform(p.seed, "target", i, c["campaign_id"]) < c["share"])
        tries = F.least(F.lit(MOST_CONTACTS), geometric(uniform(p.seed, "tries", i, c["campaign_id"]), 0.55))
        begun = F.struct(s["before"].alias("before"), s["n"].alias("n"), F.lit(False).alias("won"), s["rows"].alias("rows"))
        end = F.aggregate(F.sequence(F.lit(1), tries), begun, attempt(c))
        return F.when(fits, F.struct(F.when(end["won"], "success").otherwise("failure").alias("before"), end["n"].alias("n"), end["rows"].alias("rows"))).otherwise(s)

    begin = F.struct(F.lit("nonexistent").alias("before"), F.lit(0).alias("n"), F.array().cast(kind).alias("rows"))
    return base.select("customer_id", F.explode(F.aggregate(plan, begin, campaign)["rows"]).alias("r")).select("customer_id", "r.*")


def portfolio_ratios(snapshots: DataFrame, p: Profile, cost_income: float = 0.56, equity: float = 0.103) -> dict[str, float]:
    """ROA, ROE, NIMY, EEFFR and loan-to-deposit of the last month, annualised."""
    last = snapshots.agg(F.max("month")).scalar()
    loans, deposits = F.col("category").isin("lending", "card"), F.col("category") == "deposit"
    r = snapshots.where(F.col("month") == last).agg(F.sum(F.when(loans, F.col("balance_inr"))).alias("l"), F.sum(F.when(deposits, F.col("balance_inr"))).alias("d"), F.sum(F.when(loans, F.col("balance_inr") * F.col("interest_rate_pct") / 100)).alias("earned"), F.sum(F.when(deposits, F.col("balance_inr") * F.col("interest_rate_pct") / 100)).alias("paid"), (F.sum("fee_revenue_inr") * 12).alias("fees")).first()
    assets = max(r.l or 0, (r.d or 0) / (1 - equity))
    net = (r.earned or 0) + max(assets - (r.l or 0), 0) * 0.06 - (r.paid or 0)
    income = net + (r.fees or 0)
    profit = income * (1 - cost_income) * 0.75
    return {"ROA": 100 * profit / assets, "ROE": 100 * profit / (assets * equity), "NIMY": 100 * net / assets, "EEFFR": 100 * cost_income, "LTD": 100 * (r.l or 0) / (r.d or 1)}


def generate_all(spark: SparkSession, n: int, p: Profile, w: Window, out: str, strict: bool = False) -> dict[str, int]:
    """All tables as Parquet, each read back by those that build on it; row counts. A strict gate raises.

    What a model is to recover lies in ``ground_truth``, one JSON row beside the tables and not a column of any.
    """
    sizes: dict[str, int] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        back = spark.read.parquet(f"{out}/{name}")
        sizes[name] = back.count()
        return back

    customers = keep("customers", generate_customers(spark, n, p, w))
    keep("products", product_dimension(spark, p).drop("adoption", "multiple", "floor"))
    holdings = keep("holdings", generate_holdings(customers, p, w))
    panel, outcomes = generate_churn(customers, holdings, p, w)
    keep("churn_panel", panel)
    outcomes = keep("churn_outcomes", outcomes)
    keep("transactions", generate_transactions(customers, outcomes, p, w))
    snapshots = keep("monthly_snapshots", generate_monthly_snapshots(holdings, outcomes, p, w))
    keep("campaign_contacts", generate_campaign_contacts(customers, holdings, outcomes, p, w))
    ratios = portfolio_ratios(snapshots, p)
    checked = assert_calibrated(ratios, p.envelopes, strict)
    truth = {**HAZARD, "frailty_sigma": FRAILTY_SIGMA, "break_at": BREAK_AT}
    row = ({k: float(v) for k, v in truth.items()}, ratios, checked, p.seed, str(w.start), str(w.end), dict(sizes))
    kind = "hazard_coefficients map<string,double>, portfolio map<string,double>, calibration_check map<string,string>, seed long, start string, end string, row_counts map<string,long>"
    spark.createDataFrame([row], kind).coalesce(1).write.mode("overwrite").json(f"{out}/ground_truth")
    return sizes
