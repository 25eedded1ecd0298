"""Declared schemas of every input. Codes and identifiers are always strings:
inferring numbers would lose leading zeros."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(spec: str) -> T.StructType:
    """Usable before a session exists, unlike the DDL parser."""
    columns = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


REFERRAL_LINE = _struct(
    "cpt_code string, auth_number string, ref_type_key string, ppl string, "
    "date_received timestamp_ntz, date_decision timestamp_ntz, ref_type string, "
    "status_cat string, status_name string, specialty string, region string, urgent string, "
    "units double, lob string"
)
REFERRAL_HEADER = T.StructType(
    [f for f in REFERRAL_LINE.fields if f.name not in ("cpt_code", "urgent", "units")]
)
# the extract used for scoring a newer period has no priority column
REFERRAL_LINE_NEW = T.StructType([f for f in REFERRAL_LINE.fields if f.name != "urgent"])
CLAIM_COST = _struct(
    "specialty string, cpt_code string, cnt_hcp_cost bigint, avg_hcp_cost double, sd_hcp_cost double"
)
CODE_NAME = _struct("name string, cpt_code string")
CLINICAL_DECISION = _struct(
    "specialty string, cpt_code string, is_ppl int, decision int, reason string, "
    "decision_source string, decision_maker string, decision_date date"
)
# the master sheet also carries the cost figure used by the model evaluation
CLINICAL_DECISION_MASTER = T.StructType(
    CLINICAL_DECISION.fields
    + _struct("cpt_desc string, denial_rate double, volume bigint, avg_cost double").fields
)
PREDICTION = _struct(
    "referral_ident string, ref_to_status string, ref_to_specialty string, px_code string, "
    "status_type_human string, dt_prediction timestamp_ntz, confidence double"
)
