"""The given order tables seen as a claim and referral warehouse.

orders are referrals, line items are procedure lines and claims, nations are
specialties, brands are procedure codes. Each derived table keeps every row
of its source.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearlane.operators.staging import stage_table

# specialty of nation 0, 1, 2, ...
SPECIALTIES = (
    "ALLERGY/IMMUNOLOGY", "CARDIOLOGY", "DERMATOLOGY", "ENDOCRINOLOGY", "ENT-OTOLARYNGOLOGY",
    "FACILITY SERVICES", "GASTROENTEROLOGY", "GENETICS", "HOME HEALTH", "NEPHROLOGY", "NEUROLOGY",
    "OCCUPATIONAL THERAPY", "ONCOLOGY - GYN", "OPHTHALMOLOGY", "PAIN MANAGEMENT", "PODIATRY",
    "PSYCHIATRY", "PULMONARY DISEASE", "RADIOLOGY", "RHEUMATOLOGY", "SURGERY - GENERAL",
    "SURGERY - HAND", "SURGERY - VASCULAR", "UROLOGY", "PHARMACY",
)
# procedure code of Brand#1, Brand#2, ...
CODES = (
    "10060", "11055", "11057", "J3301", "99203", "99213", "45378", "00812", "G0105", "36430",
    "86900", "86920", "95115", "97110", "J0585", "95024", "J1561", "64483", "71046", "74177",
    "93000", "99232", "A0999", "29580", "73721",
)
# codes the claim warehouse does not know
CODES_WITHOUT_CLAIMS = ("95024", "J1561", "73721")

# site number (balance in steps of 1,500) to community
SITES = (
    (-1, "San Gabriel Valley"), (0, "South Bay"), (1, "San Fernando Valley"), (2, "Orange County"),
    (3, "LA/Downtown"), (4, "Long Beach"), (5, "Magan"), (6, "Inland Empire"),
)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
REFERRAL_TYPES = (
    ("1-URGENT", "EMERGENCY ROOM"), ("2-HIGH", "OUTPT"), ("3-MEDIUM", "OUTPT"),
    ("4-NOT SPECIFIED", None), ("5-LOW", "OUTPT"),
)
# (order status + priority, status category, status name)
STATUSES = (
    ("F1-URGENT", "APPROVED", "APPROVED - AUTO"),
    ("F2-HIGH", "APPROVED", "APPROVED - AUTO"),
    ("F3-MEDIUM", "APPROVED", "APPROVED - CM"),
    ("F4-NOT SPECIFIED", "APPROVED", "APPROVED - AUTO"),
    ("F5-LOW", "APPROVED", "APPROVED - AUTO"),
    ("O1-URGENT", "APPROVED", "APPROVED - CM"),
    ("O2-HIGH", "DENIED", "DENIED - NOT A COVERED BENEFIT"),
    ("O3-MEDIUM", "APPROVED", "APPROVED - CM"),
    ("O4-NOT SPECIFIED", "APPROVED", "APPROVED - CM"),
    ("O5-LOW", "DENIED", "DENIED - MODIFIED"),
    ("P1-URGENT", "DENIED", "DENIED - MD"),
    ("P2-HIGH", "DENIED", "DENIED - MD"),
    ("P3-MEDIUM", "PENDING", "PENDING - CM"),
    ("P4-NOT SPECIFIED", "PENDING", "PENDING - CM"),
    ("P5-LOW", "DENIED", "DENIED - RETRO REVIEW"),
)
PLANS = (
    ("AUTOMOBILE", "COMMERCIAL"), ("BUILDING", "SENIOR"), ("FURNITURE", "MEDI-CAL"),
    ("HOUSEHOLD", "EXCHANGE"), ("MACHINERY", None),
)

CLAIM_WINDOW = ("1996-01-01", "2000-12-31")
CLAIM_WINDOW_QUARTERLY = ("1998-01-01", "1998-09-28")
REFERRAL_WINDOW = ("1995-01-01", "2001-12-31")
REFERRAL_WINDOW_QUARTERLY = ("1998-05-02", "1998-09-28")
# referrals scored with rules learned on earlier ones
OLD_WINDOW = ("1995-01-01", "1998-12-31")
NEW_WINDOW = ("1999-01-01", "2001-12-31")
# starts and ends inside a month
PART_WINDOW = ("1996-02-10", "2001-05-20")
BUCKETS = 8
DEPARTMENT_COST = 5.0e8
AS_OF = "2001-10-01"
AS_OF_QUARTERLY = "1998-10-01"


def sql_literal(value: object) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({columns})"


def _inline(spark: SparkSession, rows, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values(rows, columns)}")


def specialty_rows():
    return tuple(enumerate(SPECIALTIES))


def code_rows():
    return tuple((f"Brand#{i}", code) for i, code in enumerate(CODES, start=1))


# declared, so that no job has to open the files to find out
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def once(method):
    """Define a table once per object."""

    @wraps(method)
    def defined(self, *args):
        key = (method.__name__, *args)
        if key not in self.made:
            self.made[key] = method(self, *args)
        return self.made[key]

    return defined


class Sample:
    """Derived tables of one data folder, each defined once and on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.made: dict[tuple, DataFrame | dict[str, DataFrame]] = {}

    @once
    def raw(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        return self.spark.read.schema(TABLE_SCHEMAS[name]).parquet(path)

    def inline(self, rows, columns: str) -> DataFrame:
        return _inline(self.spark, rows, columns)

    @once
    def specialties(self) -> DataFrame:
        named = self.inline(specialty_rows(), "n_nationkey, specialty")
        return self.raw("nation").select("n_nationkey", "n_regionkey").join(named, "n_nationkey")

    @once
    def parts(self) -> DataFrame:
        named = self.inline(code_rows(), "p_brand, code")
        return self.raw("part").select("p_partkey", "p_brand", "p_name").join(named, "p_brand")

    # --- referral warehouse -----------------------------------------------------

    @once
    def referral_tables(self) -> dict[str, DataFrame]:
        customer = self.raw("customer")
        balance = F.col("c_acctbal")
        headers = (
            self.raw("orders")
            .join(
                customer.select(
                    F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment"
                ),
                "o_custkey",
            )
            .select(
                F.col("o_orderkey").alias("referral_key"),
                F.when(F.col("o_totalprice") >= 15000, F.col("o_orderkey").cast("string")).alias(
                    "hcp_connect_auth_number"
                ),
                F.col("o_orderpriority").alias("ref_type_key"),
                F.when(balance >= 0, F.when(balance < 7000, "Y").otherwise("N")).alias("ppl"),
                F.col("o_orderdate").alias("dt_received"),
                F.when(
                    F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")
                ).alias("decision_dt"),
                F.col("o_custkey").alias("referring_prov_key"),
                F.col("c_nationkey").alias("specialty_ref_to_provider_key"),
                F.col("o_custkey").alias("elig_key"),
                F.col("o_orderpriority").alias("priority_key"),
                F.concat("o_orderstatus", "o_orderpriority").alias("referral_status_key"),
                F.col("c_mktsegment").alias("patient_plan_key"),
            )
        )
        parts = self.parts()
        return {
            "referral_hdr": headers,
            "referral_det": self.raw("lineitem")
            .select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_quantity")
            .join(parts, "p_partkey")
            .select(
                F.col("l_orderkey").alias("referral_key"),
                F.col("code").alias("px_code"),
                F.col("l_quantity").alias("units"),
            ),
            "lu_referring_provider": customer.select(F.col("c_custkey").alias("record_number")),
            "lu_specialty": self.specialties().select(
                F.col("n_nationkey").alias("record_number"), F.col("specialty").alias("billing_area")
            ),
            "lu_eligibility": customer.select(
                F.col("c_custkey").alias("elig_key"),
                F.floor(balance / 1500).cast("int").alias("hcp_site_key"),
            ),
            "lu_site": self.inline(SITES, "record_number, budget_community"),
            "lu_priority": self.inline([(p, p) for p in PRIORITIES], "record_number, name"),
            "lu_referral_status": self.inline(STATUSES, "record_number, status_type, name"),
            "lu_referral_type": self.inline(REFERRAL_TYPES, "ref_type, referral_type_name"),
            "lu_benefit_plan": self.inline(PLANS, "patient_plan_key, product_category_name"),
            "lu_px_cpt": parts.select(
                F.col("code").alias("procedure_code"), F.col("p_name").alias("name")
            ),
        }

    # --- claim warehouse ----------------------------------------------------------

    @once
    def claim_tables(self) -> dict[str, DataFrame]:
        supplier = self.raw("supplier")
        specialties = self.specialties()
        fact = (
            self.raw("lineitem")
            .join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
            .select(
                F.col("l_suppkey").alias("vendor_sk"),
                F.date_format("l_shipdate", "yyyyMMdd").cast("bigint").alias("date_service_from_sk"),
                F.col("l_orderkey").alias("patient_sk"),
                F.col("s_nationkey").alias("site_market_hierarchy_sk"),
                F.col("l_linenumber").alias("place_of_service_sk"),
                F.col("s_nationkey").alias("specialty_sk"),
                F.col("l_partkey").alias("procedure_code_sk"),
                F.ascii("l_returnflag").alias("fund_type_sk"),
                # whole amounts: sums do not depend on the order of addition
                F.floor("l_extendedprice").cast("double").alias("hcp_cost"),
                F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("capitation_flag"),
            )
        )
        days = self.spark.sql(
            "SELECT explode(sequence(DATE'1995-01-01', DATE'2002-12-31')) AS day"
        )
        return {
            "fact_claim": fact,
            "dim_vendor": supplier.select(F.col("s_suppkey").alias("vendor_sk")),
            "dim_date": days.select(
                F.date_format("day", "yyyyMMdd").cast("bigint").alias("date_sk"),
                F.col("day").cast("timestamp_ntz").alias("date_bk"),
            ),
            "dim_patient": self.raw("orders").select(F.col("o_orderkey").alias("patient_sk")),
            "bridge_site_market_hierarchy": specialties.select(
                F.col("n_nationkey").alias("site_market_hierarchy_sk"),
                F.col("n_regionkey").alias("market_sk"),
            ),
            "dim_market": self.raw("region").select(
                F.col("r_regionkey").alias("market_sk"),
                F.when(F.col("r_name") == "MIDDLE EAST", "CENTRAL VALLEY")
                .otherwise("SOUTHERN CALIFORNIA")
                .alias("super_region_name"),
            ),
            "dim_place_of_service": self.inline([(i,) for i in range(1, 8)], "place_of_service_sk"),
            "dim_specialty": specialties.select(
                F.col("n_nationkey").alias("specialty_sk"),
                F.col("specialty").alias("specialty_long_name"),
            ),
            "dim_procedure_code": self.parts()
            .filter(~F.col("code").isin(*CODES_WITHOUT_CLAIMS))
            .select(F.col("p_partkey").alias("procedure_code_sk"), F.col("code").alias("procedure_code")),
            "dim_fund_type": self.inline(
                [(ord("N"), "PROFESSIONAL"), (ord("R"), "INSTITUTIONAL"), (ord("A"), "ANCILLARY")],
                "fund_type_sk, fund_type_name",
            ),
        }

    # --- sheets and predictions ------------------------------------------------------

    @once
    def decision_log(self) -> DataFrame:
        """Clinical decisions per (specialty, code, network, year): returned
        against accepted line items decide, their difference gives the reason."""
        returned = F.count(F.when(F.col("l_returnflag") == "R", 1))
        accepted = F.count(F.when(F.col("l_returnflag") == "A", 1))
        grouped = (
            self.raw("lineitem")
            .join(self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
            .join(self.parts().select(F.col("p_partkey").alias("l_partkey"), "code"), "l_partkey")
            .join(
                self.specialties().select(F.col("n_nationkey").alias("s_nationkey"), "specialty"),
                "s_nationkey",
            )
            .groupBy(
                F.when(F.col("specialty") == "RADIOLOGY", "RADIOLOGY_senior")
                .otherwise(F.col("specialty"))
                .alias("specialty"),
                F.col("code").alias("cpt_code"),
                F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("is_ppl"),
                F.year("l_shipdate").alias("decision_year"),
            )
            .agg(
                (returned - accepted).alias("d"),
                F.max("l_shipdate").cast("date").alias("decision_date"),
                F.floor(F.max("l_extendedprice")).cast("double").alias("top_price"),
            )
        )
        d = F.col("d")
        reason = (
            F.when(d >= 4, "Override Pend")
            .when(d == 3, "Heavy Cap Vol")
            .when(d == 2, "Cost Containment")
            .when(d == 1, "Needs Review")
            .when(d == -1, "Upcoding")
            .when(d == -2, "Pend Specialty")
            .when(d == -3, "Typed By Hand")
            .when(d <= -4, "Medical Necessity Review")
        )
        return grouped.select(
            "specialty",
            "cpt_code",
            "is_ppl",
            "decision_year",
            F.when(d > 0, 1).when(d < 0, 0).alias("decision"),
            reason.alias("reason"),
            F.lit("clinical review").alias("decision_source"),
            F.when(d > 0, "medical director").otherwise("case manager").alias("decision_maker"),
            "decision_date",
            F.when(d != 0, F.col("top_price")).alias("avg_cost"),
        )

    @once
    def stored_log(self) -> DataFrame:
        """The log as a table of its own: the sheets of all years are read from it."""
        return stage_table(self.decision_log())

    def sheet(self, year: int) -> DataFrame:
        """The decision sheet of one year; reasons are free-text notes there."""
        return (
            self.stored_log()
            .filter(F.col("decision_year") == year)
            .withColumnRenamed("reason", "notes")
            .drop("decision_year", "avg_cost")
        )

    def master(self) -> DataFrame:
        """All years in one sheet: keys repeat, the latest decision counts."""
        return self.decision_log().drop("decision_year")

    @once
    def predictions(self) -> DataFrame:
        balance, flag = F.col("c_acctbal"), F.col("l_returnflag")
        specialty = F.col("specialty")
        status = F.col("o_orderstatus")
        return (
            self.raw("lineitem")
            .join(self.parts().select(F.col("p_partkey").alias("l_partkey"), "code"), "l_partkey")
            .join(self.raw("orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
            .join(self.raw("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
            .join(
                self.specialties().select(F.col("n_nationkey").alias("c_nationkey"), "specialty"),
                "c_nationkey",
            )
            .select(
                F.col("l_orderkey").cast("string").alias("referral_ident"),
                F.when(balance < 0, F.lit(None).cast("string"))
                .when(balance < 3000, "PPL CONTRACTED")
                .when(balance < 5000, "PPL EMPLOYED")
                .when(balance < 6000, "PPL CAPITATED")
                .when(balance < 8000, "NLL CONTRACTED")
                .when(balance < 9000, "UNASSIGNED")
                .otherwise("SPECIAL ARRANGEMENT")
                .alias("ref_to_status"),
                F.when((specialty == "OPHTHALMOLOGY") & (flag == "R"), "OPHTHALMOLOGY - RETINAL")
                .when((specialty == "PULMONARY DISEASE") & (flag == "A"), "SLEEP MEDICINE")
                .when((specialty == "PHARMACY") & (flag == "N"), "ANTI-COAGULATION CLINIC (ACC)")
                .otherwise(specialty)
                .alias("ref_to_specialty"),
                F.col("code").alias("px_code"),
                F.when(status == "F", "APPROVED")
                .when(status == "P", "PENDED")
                .when(F.col("o_orderpriority") == "1-URGENT", "CANCEL")
                .when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "DENIED")
                .alias("status_type_human"),
                F.col("l_shipdate").alias("dt_prediction"),
                F.when(F.col("l_quantity") < 50, F.col("l_extendedprice")).alias("confidence"),
            )
        )
