"""Typed scans of staged CSV folders: declared schemas, rejected lines kept apart and counted."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.sources.parsers import SourceError

#: Schemas of the staged tables; a column named after ``not null`` may not be missing.
STAGED = {
    "customers": "id bigint, customer_id string not null, age int not null, age_band string not null, gender string not null, marital string, education string, job string, is_salaried int not null, city string not null, state string not null, segment string not null, annual_income_inr double not null, credit_score int not null, digital_engagement double not null, acquisition_channel string not null, acquired_date date not null, tenure_months int not null, frailty double",
    "products": "product_key int not null, product_code string not null, product_name string not null, category string not null, interest_rate_pct double not null, rate_offset_pp double not null, annual_fee_inr double not null, min_income_inr double not null, is_anchor int not null",
    "holdings": "customer_id string not null, product_code string not null, category string not null, opened_date date not null, balance_inr double not null, interest_rate_pct double not null, annual_fee_inr double not null",
    "churn_outcomes": "customer_id string not null, acquired_date date not null, churn_date date, churned int not null, censored int not null, observed_months int not null",
    "transactions": "txn_id string not null, customer_id string not null, txn_date date not null, month date not null, txn_type string not null, direction string not null, amount_inr double not null, channel string, merchant_category string",
    "monthly_snapshots": "customer_id string not null, product_code string not null, category string not null, month date not null, balance_inr double not null, interest_rate_pct double not null, interest_revenue_inr double not null, fee_revenue_inr double not null, total_revenue_inr double not null, account_age_months int not null",
    "campaign_contacts": "customer_id string not null, campaign_id string not null, contact_sequence int not null, contact_date date not null, channel string not null, product_code string not null, prior_outcome string not null, n_prior_contacts int not null, response_probability double, converted int not null, cost_inr double not null",
}


@dataclass(frozen=True)
class Scan:
    """``rows`` has the schema's columns; ``rejects`` is (line, reason, file)."""

    rows: DataFrame
    rejects: DataFrame
    _marked: DataFrame

    def counts(self) -> DataFrame:
        """(file, n_rows, n_rejected, n_malformed, n_missing), one pass over the folder."""
        reason = F.col("_reason")
        return self._marked.groupBy(F.col("_file").alias("file")).agg(
            F.count_if(reason.isNull()).alias("n_rows"), F.count_if(reason.isNotNull()).alias("n_rejected"), F.count_if(reason == "malformed").alias("n_malformed"), F.count_if(reason.startswith("missing")).alias("n_missing")
        )


def declared(schema: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> Scan:
    """A CSV folder with a header, by its declared schema; nothing is inferred and no line is lost.

    A line is rejected as malformed, if it has too few or too many fields or one that its type does not hold,
    or as missing, if a column that may not be null is. Only the file's own columns are compared with the
    schema; a header in another order or of other names raises. An empty text is a null.
    """
    kinds = declared(schema)
    open_ = T.StructType([*[T.StructField(f.name, f.dataType) for f in kinds], T.StructField("_line", T.StringType())])
    options = {"header": True, "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "enforceSchema": False, "dateFormat": "yyyy-MM-dd"}
    read = spark.read.options(**options).schema(open_).csv(path)
    # the reader parses only the fields that a query needs, so a line would be malformed for one query and not for
    # another; a hash of all fields, whatever it is, makes every query need them all
    every = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in kinds]), F.lit(2)) >= 0
    reason = F.when(F.col("_line").isNotNull() & every, F.lit("malformed"))
    for f in kinds:
        if not f.nullable:
            reason = reason.when(F.col(f"`{f.name}`").isNull(), F.lit(f"missing {f.name}"))
    marked = read.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_reason", reason)
    plain = F.coalesce("_line", F.concat_ws(sep, *[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")) for f in kinds]))
    rows = marked.where("_reason is null").select(*[F.col(f"`{f.name}`") for f in kinds])
    rejects = marked.where("_reason is not null").select(plain.alias("line"), F.col("_reason").alias("reason"), F.col("_file").alias("file"))
    return Scan(rows, rejects, marked)


def staged_table(spark: SparkSession, folder: str, name: str, most_rejects: int = 0) -> DataFrame:
    """A staged table by its declared schema; raises if more lines are rejected than allowed."""
    if name not in STAGED:
        raise SourceError(f"no schema for a staged table {name}")
    scan = scan_csv(spark, f"{folder}/{name}", STAGED[name])
    bad = scan.rejects.groupBy("reason").count().collect()
    if (n := sum(r["count"] for r in bad)) > most_rejects:
        raise SourceError(f"{name}: {n} lines rejected, " + ", ".join(f"{r['count']} {r.reason}" for r in bad))
    return scan.rows


def stage_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return path


def staging_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: under ``spark.checkpoint.dir``, in local mode without one a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[")
        base = "file://" + tempfile.mkdtemp(prefix="staging-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_staging"
    return f"{base}/{name}-{uuid.uuid4().hex}"
