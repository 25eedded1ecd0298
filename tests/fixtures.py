"""Small inline tables. A row names only the columns that matter."""

from datetime import date, datetime

from clearlane import schemas

LINE = {
    "cpt_code": "99203", "auth_number": "A1", "ref_type_key": "K", "ppl": "Y",
    "date_received": datetime(2019, 1, 1), "date_decision": None, "ref_type": "OUTPT",
    "status_cat": "PENDING", "status_name": "PENDING - CM", "specialty": "CARDIOLOGY",
    "region": "South Bay", "urgent": "ROUTINE", "units": 2.0, "lob": "COMMERCIAL",
}
DECISION = {
    "specialty": "CARDIOLOGY", "cpt_code": "99203", "is_ppl": 1, "decision": None, "reason": None,
    "decision_source": "sheet", "decision_maker": "someone", "decision_date": date(2019, 1, 1),
    "cpt_desc": None, "denial_rate": None, "volume": None, "avg_cost": None,
}
PREDICTION = {
    "referral_ident": "A1", "ref_to_status": "PPL CONTRACTED", "ref_to_specialty": "CARDIOLOGY",
    "px_code": "99203", "status_type_human": "APPROVED", "dt_prediction": datetime(2019, 8, 1),
    "confidence": 0.5,
}
# a group as the overrides see it
GROUP = {
    "specialty": "CARDIOLOGY", "cpt_code": "99203", "is_ppl": 1, "units": 100, "units_man": 50,
    "avg_hcp_cost": 10.0, "roi": 0.5, "fin_aa_rec": 1,
}
GROUP_SCHEMA = (
    "specialty string, cpt_code string, is_ppl int, units bigint, units_man bigint, "
    "avg_hcp_cost double, roi double, fin_aa_rec int"
)


def _frame(spark, rows, default, schema):
    names = schema.fieldNames()
    unknown = {k for row in rows for k in row} - set(names)
    assert not unknown, unknown
    return spark.createDataFrame([tuple({**default, **row}[n] for n in names) for row in rows], schema)


def lines(spark, *rows):
    return _frame(spark, rows, LINE, schemas.REFERRAL_LINE)


def decisions(spark, *rows):
    return _frame(spark, rows, DECISION, schemas.CLINICAL_DECISION_MASTER)


def predictions(spark, *rows):
    return _frame(spark, rows, PREDICTION, schemas.PREDICTION)


def claims(spark, *rows):
    """(specialty, code, count, mean)"""
    return spark.createDataFrame([(*r, None) for r in rows], schemas.CLAIM_COST)


def groups(spark, *rows):
    names = [c.split()[0] for c in GROUP_SCHEMA.split(", ")]
    return spark.createDataFrame(
        [tuple({**GROUP, **row}[n] for n in names) for row in rows], GROUP_SCHEMA
    )


def by(df, *keys):
    """Rows as dictionaries, keyed by the values of ``keys``."""
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        key = key[0] if len(key) == 1 else key
        assert key not in out, key
        out[key] = row.asDict()
    return out
