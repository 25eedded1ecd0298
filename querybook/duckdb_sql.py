"""The registered queries as SQL over the same tables, for comparison.

``WITH`` lists the shared steps; a query names the ones it needs and the text
is put together in dependency order.
"""

from __future__ import annotations

import re

from clearlane import constants as K
from querybook import sample as S


def _values(rows, columns: str) -> str:
    return "SELECT * FROM " + S.values(rows, columns).replace("AS STRING", "AS VARCHAR")


def _list(items) -> str:
    return ", ".join(S.sql_literal(i) for i in items)


def _ts(day: str) -> str:
    return f"TIMESTAMP '{day} 00:00:00'"


def _case(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {S.sql_literal(a)} THEN {S.sql_literal(b)}" for a, b in mapping.items())
    return f"CASE {column} {whens} ELSE {column} END"


# --- shared steps ----------------------------------------------------------------------

STEPS: dict[str, str] = {
    "spec_map": _values(S.specialty_rows(), "nation, specialty"),
    "code_map": _values(S.code_rows(), "brand, code"),
    "site_map": _values(S.SITES, "site, community"),
    "type_map": _values(S.REFERRAL_TYPES, "priority, ref_type"),
    "status_map": _values(S.STATUSES, "status_key, status_cat, status_name"),
    "plan_map": _values(S.PLANS, "segment, lob"),
}


def _header_select(window: tuple[str, str]) -> str:
    return f"""
    SELECT o.o_orderkey,
           CASE WHEN o.o_totalprice >= 15000 THEN CAST(o.o_orderkey AS VARCHAR) END AS auth_number,
           o.o_orderpriority AS ref_type_key,
           CASE WHEN cu.c_acctbal < 0 THEN NULL WHEN cu.c_acctbal < 7000 THEN 'Y' ELSE 'N' END AS ppl,
           o.o_orderdate AS date_received,
           CASE WHEN o.o_orderstatus <> 'P' THEN o.o_orderdate + INTERVAL 5 DAY END AS date_decision,
           ty.ref_type, st.status_cat, st.status_name, sp.specialty, si.community AS region,
           o.o_orderpriority AS urgent, pl.lob
    FROM orders o
    JOIN customer cu ON cu.c_custkey = o.o_custkey
    JOIN spec_map sp ON sp.nation = cu.c_nationkey
    JOIN type_map ty ON ty.priority = o.o_orderpriority
    JOIN status_map st ON st.status_key = o.o_orderstatus || o.o_orderpriority
    JOIN plan_map pl ON pl.segment = cu.c_mktsegment
    JOIN site_map si ON si.site = CAST(floor(cu.c_acctbal / 1500) AS INTEGER)
    WHERE o.o_orderdate BETWEEN {_ts(window[0])} AND {_ts(window[1])}
      AND si.community IN ({_list(K.COMMUNITIES)})"""


def _lines_select(headers: str) -> str:
    return f"""
    SELECT cm.code AS cpt_code, h.auth_number, h.ref_type_key, h.ppl, h.date_received,
           h.date_decision, h.ref_type, h.status_cat, h.status_name, h.specialty, h.region,
           h.urgent, l.l_quantity AS units, h.lob
    FROM lineitem l
    JOIN {headers} h ON h.o_orderkey = l.l_orderkey
    JOIN part p ON p.p_partkey = l.l_partkey
    JOIN code_map cm ON cm.brand = p.p_brand"""


def _clean_select(lines: str, suffixes: dict[str, str], count_lines: bool = True) -> str:
    units = "CAST(1 AS DOUBLE)" if count_lines else "units"
    lob = _case("lob", suffixes)
    return f"""
    SELECT cpt_code, auth_number, ref_type_key, ppl, date_received, date_decision, ref_type,
           status_cat, status_name,
           CASE WHEN specialty = 'RADIOLOGY' THEN specialty || ({lob}) ELSE specialty END AS specialty,
           region, urgent, {units} AS units, {lob} AS lob,
           CASE WHEN status_name = '{K.AUTO_APPROVED_STATUS}' THEN 1 ELSE 0 END AS is_autoapp,
           CASE WHEN ppl = 'Y' THEN 1 ELSE 0 END AS is_ppl,
           CASE WHEN status_name IN ({_list(K.DENIED_STATUSES)}) THEN 1 ELSE 0 END AS is_den,
           CASE WHEN status_cat = 'APPROVED' THEN 1 ELSE 0 END AS is_app
    FROM {lines}
    WHERE status_name IS NULL OR status_name NOT IN ({_list(K.RETRO_STATUSES)})"""


def _claims_select(window: tuple[str, str]) -> str:
    return f"""
    SELECT sp.specialty, cm.code AS cpt_code, CAST(floor(l.l_extendedprice) AS DOUBLE) AS hcp_cost
    FROM lineitem l
    JOIN supplier s ON s.s_suppkey = l.l_suppkey
    JOIN nation n ON n.n_nationkey = s.s_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey
    JOIN spec_map sp ON sp.nation = n.n_nationkey
    JOIN part p ON p.p_partkey = l.l_partkey
    JOIN code_map cm ON cm.brand = p.p_brand
    WHERE CAST(l.l_shipdate AS DATE) BETWEEN DATE '{window[0]}' AND DATE '{window[1]}'
      AND l.l_returnflag = 'N' AND l.l_linestatus <> 'O'
      AND floor(l.l_extendedprice) > 0
      AND r.r_name <> 'MIDDLE EAST'
      AND cm.code NOT IN ({_list(S.CODES_WITHOUT_CLAIMS)})
      AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
      AND l.l_linenumber BETWEEN 1 AND 7"""


def _stats_select(claims: str) -> str:
    return f"""
    SELECT specialty, cpt_code, count(hcp_cost) AS cnt_hcp_cost, avg(hcp_cost) AS avg_hcp_cost,
           stddev_samp(hcp_cost) AS sd_hcp_cost
    FROM {claims} GROUP BY specialty, cpt_code"""


def _roi_select(clean: str, unit_cost: str) -> str:
    return f"""
    WITH grouped AS (
      SELECT specialty, cpt_code, is_ppl, count(units) AS units, avg(is_autoapp) AS auto_rate,
             avg(is_den) AS denial_rate, CAST(sum(1 - is_autoapp) AS BIGINT) AS units_man
      FROM {clean} WHERE specialty IS NOT NULL AND cpt_code IS NOT NULL
      GROUP BY specialty, cpt_code, is_ppl),
    costed AS (
      SELECT g.*, c.cnt_hcp_cost, coalesce(c.avg_hcp_cost, m.avg_hcp_cost_code) AS avg_hcp_cost,
             CASE WHEN g.units_man > 0 THEN g.units_man * ({unit_cost}) END AS cost_to_review
      FROM grouped g
      LEFT JOIN claim_stats c ON c.specialty = g.specialty AND c.cpt_code = g.cpt_code
      LEFT JOIN code_mean m ON m.cpt_code = g.cpt_code),
    denied AS (SELECT *, denial_rate * units * avg_hcp_cost AS sum_cost_denied FROM costed),
    returned AS (
      SELECT *, CASE WHEN avg_hcp_cost IS NULL THEN 100.0::DOUBLE
                     WHEN cost_to_review IS NULL OR cost_to_review = 0 THEN 0.01::DOUBLE
                     ELSE sum_cost_denied / cost_to_review END AS roi FROM denied)
    SELECT *, CASE WHEN roi < 1 THEN 1 ELSE 0 END AS fin_aa_rec FROM returned"""


STEPS |= {
    "headers": _header_select(S.REFERRAL_WINDOW),
    "headers_old": _header_select(S.OLD_WINDOW),
    "headers_new": _header_select(S.NEW_WINDOW),
    "lines": _lines_select("headers"),
    "lines_old": _lines_select("headers_old"),
    "lines_new": _lines_select("headers_new"),
    "clean": _clean_select("lines", K.LOB_SUFFIX_SENIOR),
    "clean_a": _clean_select("lines", K.LOB_SUFFIX_A, count_lines=False),
    "clean_m": _clean_select("lines", K.LOB_SUFFIX_M),
    "clean_old": _clean_select("lines_old", K.LOB_SUFFIX_SENIOR),
    "clean_new": _clean_select("lines_new", K.LOB_SUFFIX_SENIOR),
    "clean_old_a": _clean_select("lines_old", K.LOB_SUFFIX_A, count_lines=False),
    "clean_new_a": "SELECT * FROM ("
    + _clean_select("lines_new", K.LOB_SUFFIX_A)
    + ") WHERE auth_number IS NOT NULL",
    "claim_rows": _claims_select(S.CLAIM_WINDOW),
    "claim_rows_quarterly": _claims_select(S.CLAIM_WINDOW_QUARTERLY),
    "claim_stats": _stats_select("claim_rows"),
    "code_mean": """SELECT cpt_code, avg(avg_hcp_cost) AS avg_hcp_cost_code
                    FROM claim_stats GROUP BY cpt_code""",
    "ga": f"SELECT {S.DEPARTMENT_COST!r}::DOUBLE / sum(1 - is_autoapp) AS unit_cost FROM clean",
    "ga_m": f"SELECT {S.DEPARTMENT_COST!r}::DOUBLE / sum(1 - is_autoapp) AS unit_cost FROM clean_m",
    "names": """SELECT min(substr(p.p_name, 1, 25)) AS name, cm.code AS cpt_code
                FROM part p JOIN code_map cm ON cm.brand = p.p_brand GROUP BY cm.code""",
    "roi": _roi_select("clean", "SELECT unit_cost FROM ga"),
    "roi_a": _roi_select("clean_a", "10000.0::DOUBLE"),
    "roi_a_cost": _roi_select("clean_a", f"{K.UNIT_COST_OVERRIDE!r}::DOUBLE"),
    "roi_m": _roi_select("clean_m", "SELECT unit_cost FROM ga_m"),
    "roi_old_a": _roi_select("clean_old_a", "10000.0::DOUBLE"),
    "decision_log": """
      SELECT CASE WHEN specialty = 'RADIOLOGY' THEN 'RADIOLOGY_senior' ELSE specialty END AS specialty,
             cpt_code, is_ppl, decision_year,
             CASE WHEN d > 0 THEN 1 WHEN d < 0 THEN 0 END AS decision,
             CASE WHEN d >= 4 THEN 'Override Pend' WHEN d = 3 THEN 'Heavy Cap Vol'
                  WHEN d = 2 THEN 'Cost Containment' WHEN d = 1 THEN 'Needs Review'
                  WHEN d = -1 THEN 'Upcoding' WHEN d = -2 THEN 'Pend Specialty'
                  WHEN d = -3 THEN 'Typed By Hand' WHEN d <= -4 THEN 'Medical Necessity Review'
             END AS reason,
             'clinical review' AS decision_source,
             CASE WHEN d > 0 THEN 'medical director' ELSE 'case manager' END AS decision_maker,
             decision_date, CASE WHEN d <> 0 THEN top_price END AS avg_cost
      FROM (SELECT sp.specialty, cm.code AS cpt_code,
                   CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END AS is_ppl,
                   CAST(year(l.l_shipdate) AS INTEGER) AS decision_year,
                   count(*) FILTER (l.l_returnflag = 'R') - count(*) FILTER (l.l_returnflag = 'A') AS d,
                   CAST(max(l.l_shipdate) AS DATE) AS decision_date,
                   CAST(floor(max(l.l_extendedprice)) AS DOUBLE) AS top_price
            FROM lineitem l
            JOIN supplier s ON s.s_suppkey = l.l_suppkey
            JOIN spec_map sp ON sp.nation = s.s_nationkey
            JOIN part p ON p.p_partkey = l.l_partkey
            JOIN code_map cm ON cm.brand = p.p_brand
            GROUP BY ALL)""",
    "latest": """
      SELECT * EXCLUDE (decision_year, place) FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty, cpt_code, is_ppl
               ORDER BY decision_date DESC NULLS LAST, decision NULLS LAST, reason NULLS LAST,
                        decision_source NULLS LAST, decision_maker NULLS LAST, avg_cost NULLS LAST) AS place
        FROM decision_log) WHERE place = 1""",
    "latest_ppl": """SELECT specialty, cpt_code, is_ppl, decision, coalesce(reason, 'DBA') AS reason,
                            avg_cost FROM latest WHERE is_ppl = 1""",
}


# --- override chains: one step per override, in order ---------------------------------------


def _start(source: str) -> str:
    return f"""SELECT *, 'DBA' AS dec_source, CAST(NULL AS VARCHAR) AS overrule_rsn,
               fin_aa_rec AS final_decision FROM {source}"""


def _forced(source: str, where: str, reason: str, by: str, decision: int) -> str:
    return f"""SELECT * REPLACE (
        CASE WHEN {where} THEN '{by}' ELSE dec_source END AS dec_source,
        CASE WHEN {where} THEN '{reason}' ELSE overrule_rsn END AS overrule_rsn,
        CASE WHEN {where} THEN {decision} ELSE final_decision END AS final_decision)
        FROM {source}"""


def _sheet(source: str, sheet: str) -> str:
    return f"""SELECT t.* REPLACE (
        CASE WHEN d.decision <> t.final_decision THEN 'clinical' ELSE t.dec_source END AS dec_source,
        CASE WHEN d.decision <> t.final_decision THEN d.reason ELSE t.overrule_rsn END AS overrule_rsn,
        CASE WHEN d.decision <> t.final_decision THEN d.decision ELSE t.final_decision END
            AS final_decision)
        FROM {source} t LEFT JOIN {sheet} d
          ON d.specialty = t.specialty AND d.cpt_code = t.cpt_code AND d.is_ppl = t.is_ppl"""


def _year(year: int) -> str:
    return f"(SELECT * FROM decision_log WHERE decision_year = {year})"


def _codes(codes, specialties=None, ppl_only: bool = False) -> str:
    where = f"cpt_code IN ({_list(codes)})"
    if specialties:
        where += f" AND specialty IN ({_list(specialties)})"
    return where + (" AND is_ppl = 1" if ppl_only else "")


def _lists(ppl_only: bool = False):
    return [
        ("force", _codes(K.DERMATOLOGY_CODES, ["DERMATOLOGY"], ppl_only), "from PRL", "clinical", 1),
        ("force", _codes(K.PAIN_CODES, ["PAIN MANAGEMENT"], ppl_only), "from PRL", "clinical", 1),
        (
            "force",
            _codes(K.GASTRO_CODES, ["GASTROENTEROLOGY", "SURGERY - GENERAL"], ppl_only),
            "from PRL", "clinical", 1,
        ),
        ("force", _codes(K.TRANSFUSION_CODES, None, ppl_only), "from PRL", "clinical", 1),
        ("force", _codes(K.PODIATRY_CODES, ["PODIATRY"], ppl_only), "from PRL", "clinical", 1),
        ("force", _codes(K.CODES_TO_PEND, None, ppl_only), "from PRL", "clinical", 0),
    ]


def _pend(specialties, reason: str, by: str):
    return ("force", f"specialty IN ({_list(specialties)})", reason, by, 0)


_LOW = ("force", "units <= 30", "low volume", "rule", 0)
_EPL = ("force", "is_ppl = 0", "Pend EPL", "rule", 0)
_SOFT = _pend(K.SOFT_PEND_SPECIALTIES, "Soft Pend Specialty", "clinical")
_HARD = _pend(K.HARD_PEND_SPECIALTIES, "Hard Pend Specialty", "rule")

CHAINS = {
    "a": [
        *_lists(), _SOFT, *[("sheet", _year(y)) for y in (1996, 1997, 1998, 1999)],
        ("force", "units <= 30", "low volume", "Rule", 0),
        _pend(K.HARD_PEND_SPECIALTIES_A, "Hard Pend Specialty", "clinical"),
        ("force", "is_ppl = 0", "Pend EPL", "clinical", 0),
    ],
    "b": [*_lists(True), _SOFT, _EPL, _LOW, ("sheet", _year(2000)), _HARD],
    "c": [
        ("sheet", "latest"), _pend(K.SOFT_PEND_SPECIALTIES_C, "Soft Pend Specialty", "clinical"),
        _LOW, _HARD, _EPL,
    ],
    "m": [*_lists(), _SOFT, ("sheet", "latest"), _LOW, _HARD, _EPL],
    "codes": [
        ("force", _codes(K.DERMATOLOGY_CODES, ["DERMATOLOGY"]), "from PRL", "clinical", 1),
        ("force", _codes(K.CODES_TO_PEND, None, True), "from PRL", "clinical", 0),
    ],
    "specialties": [_SOFT],
    "overlay": [("sheet", "latest")],
    "low": [_LOW],
    "network": [_EPL],
}


def _chain(name: str, source: str, chain: str) -> None:
    """Register ``name`` and its intermediate steps."""
    steps = CHAINS[chain]
    STEPS[f"{name}_0"] = _start(source)
    for i, step in enumerate(steps, start=1):
        last = f"{name}_{i - 1}"
        STEPS[f"{name}_{i}"] = _forced(last, *step[1:]) if step[0] == "force" else _sheet(last, step[1])
    STEPS[name] = f"SELECT * FROM {name}_{len(steps)}"


_chain("plan_a", "roi_a", "a")
_chain("plan_a_old", "roi_old_a", "a")
_chain("plan_a_cost", "roi_a_cost", "a")
_chain("plan_b", "roi", "b")
_chain("plan_c", "roi", "c")
_chain("plan_m", "roi_m", "m")
for _name in ("codes", "specialties", "overlay", "low", "network"):
    _chain(f"only_{_name}", "roi", _name)


# --- from decisions to referrals ------------------------------------------------------------------


def _scored(clean: str, plan: str) -> str:
    return f"""
    SELECT c.*, d.avg_hcp_cost, d.roi,
           CASE WHEN c.is_ppl = 1 AND d.final_decision = 1
                 AND (c.ref_type IS NULL OR c.ref_type NOT IN ({_list(K.PEND_REFERRAL_TYPES)}))
                THEN 1 ELSE 0 END AS auto_approvable
    FROM {clean} c LEFT JOIN {plan} d
      ON d.specialty = c.specialty AND d.cpt_code = c.cpt_code AND d.is_ppl = c.is_ppl"""


def _with_referral(scored: str) -> str:
    return f"""
    SELECT s.*, r.aa_yn FROM {scored} s LEFT JOIN (
      SELECT auth_number, min(auto_approvable) AS aa_yn FROM {scored}
      WHERE auth_number IS NOT NULL GROUP BY auth_number) r ON r.auth_number = s.auth_number"""


def _rollup(source: str, region: bool) -> str:
    extra = ", region" if region else ""
    known = " AND region IS NOT NULL" if region else ""
    return f"""
    SELECT specialty, ref_type{extra}, auth_number, count(units) AS units,
           avg(is_autoapp) AS is_autoapp, avg(is_ppl) AS is_ppl, avg(is_app) AS is_app,
           avg(is_den) AS is_den, min(aa_yn) AS aa_yn
    FROM {source}
    WHERE specialty IS NOT NULL AND ref_type IS NOT NULL AND auth_number IS NOT NULL{known}
    GROUP BY specialty, ref_type{extra}, auth_number"""


def _financials(source: str, unit_cost: str) -> str:
    return f"""
    SELECT *, is_den * aa_yn * avg_hcp_cost AS dollars_denied_now_app,
           (1 - is_autoapp) * aa_yn * ({unit_cost}) AS cost_to_review_bene,
           is_autoapp * (1 - aa_yn) * ({unit_cost}) AS cost_to_review_loss,
           is_autoapp * (1 - aa_yn) * ({unit_cost}) * roi * is_ppl AS new_denial_bene_est
    FROM {source}"""


def _summary(rollup: str, financials: str, plan: str) -> str:
    return f"""
    WITH r AS (SELECT specialty, count(aa_yn) AS ref_vol, avg(aa_yn) AS new_rate,
                      avg(is_autoapp) AS old_rate, coalesce(sum(is_den * aa_yn), 0) AS deny_now_aa
               FROM {rollup} GROUP BY specialty),
    f AS (SELECT specialty, coalesce(sum(cost_to_review_bene), 0) AS cost_to_review_bene,
                 coalesce(sum(cost_to_review_loss), 0) AS cost_to_review_loss,
                 coalesce(sum(dollars_denied_now_app), 0) AS dollars_denied_now_app,
                 coalesce(sum(new_denial_bene_est), 0) AS new_denial_bene_est
          FROM {financials} WHERE specialty IS NOT NULL GROUP BY specialty),
    n AS (SELECT specialty, count(DISTINCT cpt_code) AS num_codes FROM {plan}
          WHERE final_decision = 1 AND is_ppl = 1 GROUP BY specialty)
    SELECT r.specialty, r.ref_vol, r.new_rate, r.old_rate, coalesce(n.num_codes, 0) AS num_codes,
           r.deny_now_aa, f.cost_to_review_bene, f.cost_to_review_loss, f.dollars_denied_now_app,
           f.new_denial_bene_est,
           f.cost_to_review_bene - f.cost_to_review_loss - f.dollars_denied_now_app AS net_benefit,
           f.cost_to_review_bene - f.cost_to_review_loss - f.dollars_denied_now_app
             + f.new_denial_bene_est AS net_benefit_w_new_den
    FROM r JOIN f ON f.specialty = r.specialty LEFT JOIN n ON n.specialty = r.specialty"""


def _edges() -> str:
    picks = " UNION ALL ".join(f"SELECT {part * 0.1!r}::DOUBLE AS share" for part in range(1, 10))
    return f"""
    WITH v AS (SELECT confidence, row_number() OVER (ORDER BY confidence) - 1 AS place
               FROM predicted WHERE confidence IS NOT NULL),
    p AS (SELECT share * (SELECT max(place) FROM v)::DOUBLE AS pos FROM ({picks})),
    ab AS (SELECT a.confidence AS a, b.confidence AS b, pos - floor(pos) AS t
           FROM p JOIN v a ON a.place = CAST(floor(pos) AS BIGINT)
                  JOIN v b ON b.place = CAST(ceil(pos) AS BIGINT))
    SELECT CASE WHEN t < 0.5 THEN a + (b - a) * t ELSE b - (b - a) * (1 - t) END AS edge FROM ab"""


STEPS |= {
    "scored": _scored("clean", "plan_c"),
    "referred": _with_referral("scored"),
    "scored_new": _scored("clean_new_a", "plan_a_old"),
    "referred_new": _with_referral("scored_new"),
    "refs": """SELECT auth_number, min(auto_approvable) AS aa_yn, avg(is_den) AS denial_rate
               FROM scored WHERE auth_number IS NOT NULL GROUP BY auth_number""",
    "rollup": _rollup("referred", region=False),
    "rollup_region": _rollup("referred", region=True),
    "rollup_new": _rollup("referred_new", region=True),
    "financials": _financials("referred", "SELECT unit_cost FROM ga"),
    "financials_new": _financials("referred_new", "10000.0::DOUBLE"),
    "summary": _summary("rollup", "financials", "plan_c"),
    "summary_new": _summary("rollup_new", "financials_new", "plan_a_old"),
    "code_rate": """SELECT specialty, cpt_code, is_ppl, avg(aa_yn) AS new_rate FROM referred
                    WHERE specialty IS NOT NULL AND cpt_code IS NOT NULL
                    GROUP BY specialty, cpt_code, is_ppl""",
    # period
    "bounds": """
      SELECT first_date, last_date,
             first_date + to_microseconds((epoch_us(last_date) - epoch_us(first_date)) // 2) AS mid_date,
             ((epoch_us(last_date) - epoch_us(first_date)) // 86400000000) / 365.0::DOUBLE AS year_share
      FROM (SELECT min(date_received) AS first_date, max(date_received) AS last_date FROM clean)""",
    "halves": """SELECT c.*, CASE WHEN date_received >= (SELECT mid_date FROM bounds) THEN 1 ELSE 0 END
                 AS post FROM clean c""",
    "period_ga": f"""SELECT {S.DEPARTMENT_COST!r}::DOUBLE * (SELECT year_share FROM bounds)
                     / sum(1 - is_autoapp) AS unit_cost FROM clean""",
    "half_groups": """
      SELECT post, specialty, cpt_code, is_ppl, count(units) AS units, avg(is_autoapp) AS is_autoapp,
             CAST(sum(1 - is_autoapp) AS BIGINT) AS units_man,
             avg(CASE WHEN is_autoapp = 0 THEN is_den END) AS is_den
      FROM halves WHERE specialty IS NOT NULL GROUP BY post, specialty, cpt_code, is_ppl""",
    "half_roi": """
      SELECT g.*, coalesce(c.avg_hcp_cost, m.avg_hcp_cost_code) AS avg_hcp_cost,
             CASE WHEN coalesce(c.avg_hcp_cost, m.avg_hcp_cost_code) IS NULL THEN 100.0::DOUBLE
                  WHEN units_man = 0 THEN 0.01::DOUBLE
                  ELSE is_den * units_man * coalesce(c.avg_hcp_cost, m.avg_hcp_cost_code)
                       / (units_man * (SELECT unit_cost FROM period_ga)) END AS roi
      FROM half_groups g
      LEFT JOIN claim_stats c ON c.specialty = g.specialty AND c.cpt_code = g.cpt_code
      LEFT JOIN code_mean m ON m.cpt_code = g.cpt_code""",
    "half_rec": "SELECT *, CASE WHEN roi < 1 THEN 1 ELSE 0 END AS fin_aa_rec FROM half_roi",
    "compared": """
      SELECT coalesce(a.specialty, b.specialty) AS specialty, coalesce(a.cpt_code, b.cpt_code) AS cpt_code,
             coalesce(a.is_ppl, b.is_ppl) AS is_ppl, a.units, b.units AS units_pre,
             a.units / b.units - 1 AS vol_increase, a.is_autoapp, b.is_autoapp AS is_autoapp_pre,
             a.is_autoapp - b.is_autoapp AS aa_rate_increase, a.is_den, b.is_den AS is_den_pre,
             a.is_den - b.is_den AS den_rate_increase, a.units_man, b.units_man AS units_man_pre,
             a.avg_hcp_cost, a.roi, b.roi AS roi_pre, a.fin_aa_rec, b.fin_aa_rec AS fin_aa_rec_pre
      FROM (SELECT * FROM half_rec WHERE post = 1) a
      FULL JOIN (SELECT * FROM half_rec WHERE post = 0) b
        ON a.specialty = b.specialty AND a.cpt_code = b.cpt_code AND a.is_ppl = b.is_ppl""",
    "comparison": f"""
      SELECT coalesce(d.specialty, c.specialty) AS specialty, coalesce(d.cpt_code, c.cpt_code) AS cpt_code,
             c.name, coalesce(d.is_ppl, c.is_ppl) AS is_ppl, d.decision_source,
             coalesce(d.reason, 'DBA') AS reason,
             CASE WHEN coalesce(d.reason, 'DBA') IN ({_list(K.REASON_CATEGORIES['M'])}) THEN 'M'
                  WHEN coalesce(d.reason, 'DBA') IN ({_list(K.REASON_CATEGORIES['do not AA'])})
                    THEN 'do not AA'
                  WHEN coalesce(d.reason, 'DBA') IN ('Override Pend', 'DBA') THEN 'AA'
                  ELSE '0' END AS reason_cat,
             d.decision_maker, d.decision_date, d.decision,
             c.* EXCLUDE (specialty, cpt_code, is_ppl, name)
      FROM latest d FULL JOIN (SELECT x.*, n.name FROM compared x JOIN names n ON n.cpt_code = x.cpt_code) c
        ON d.specialty = c.specialty AND d.cpt_code = c.cpt_code AND d.is_ppl = c.is_ppl""",
    # evaluation
    "predicted": f"""
      SELECT referral_ident, ref_to_status,
             CASE WHEN ref_to_status IN ({_list(K.IN_NETWORK_PROVIDER_STATUSES)}) THEN 1
                  WHEN ref_to_status IN ({_list(K.OUT_OF_NETWORK_PROVIDER_STATUSES)}) THEN 0 END AS is_ppl,
             {_case('ref_to_specialty', K.PREDICTED_SPECIALTY_CLEANUP)} AS ref_to_specialty,
             px_code, status_type_human,
             CASE WHEN status_type_human = 'APPROVED' THEN 1 ELSE 0 END AS is_approved, confidence
      FROM (
        SELECT CAST(l.l_orderkey AS VARCHAR) AS referral_ident,
               CASE WHEN c_acctbal < 0 THEN 'EPL CONTRACTED' WHEN c_acctbal < 3000 THEN 'PPL CONTRACTED'
                    WHEN c_acctbal < 5000 THEN 'PPL EMPLOYED' WHEN c_acctbal < 6000 THEN 'PPL CAPITATED'
                    WHEN c_acctbal < 8000 THEN 'NLL CONTRACTED' WHEN c_acctbal < 9000 THEN 'UNASSIGNED'
                    ELSE 'SPECIAL ARRANGEMENT' END AS ref_to_status,
               CASE WHEN sp.specialty = 'OPHTHALMOLOGY' AND l_returnflag = 'R'
                      THEN 'OPHTHALMOLOGY - RETINAL'
                    WHEN sp.specialty = 'PULMONARY DISEASE' AND l_returnflag = 'A' THEN 'SLEEP MEDICINE'
                    WHEN sp.specialty = 'PHARMACY' AND l_returnflag = 'N'
                      THEN 'ANTI-COAGULATION CLINIC (ACC)' ELSE sp.specialty END AS ref_to_specialty,
               cm.code AS px_code,
               CASE WHEN o_orderstatus = 'F' THEN 'APPROVED' WHEN o_orderstatus = 'P' THEN 'PENDED'
                    WHEN o_orderpriority = '1-URGENT' THEN 'CANCEL'
                    WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'DENIED' END AS status_type_human,
               CASE WHEN l_quantity < 50 THEN l_extendedprice END AS confidence
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN customer cu ON cu.c_custkey = o.o_custkey
        JOIN spec_map sp ON sp.nation = cu.c_nationkey
        JOIN part p ON p.p_partkey = l.l_partkey
        JOIN code_map cm ON cm.brand = p.p_brand)""",
    "edges": _edges(),
    "edge_list": "SELECT list(edge) AS edges FROM edges",
    "binned": """
      SELECT p.*, CASE WHEN confidence IS NOT NULL
                  THEN CAST(len(list_filter(e.edges, lambda x: confidence > x)) AS INTEGER) END AS decile
      FROM predicted p, edge_list e""",
    "matched": """SELECT b.*, d.decision, d.reason FROM binned b LEFT JOIN latest_ppl d
      ON d.specialty = b.ref_to_specialty AND d.cpt_code = b.px_code AND d.is_ppl = b.is_ppl""",
    "costs": f"""
      SELECT l.auth_number, coalesce(sum(d.avg_cost), 0) AS avg_cost
      FROM (SELECT auth_number, cpt_code, CASE WHEN specialty = 'RADIOLOGY'
                   THEN specialty || ({_case('lob', K.LOB_SUFFIX_M)}) ELSE specialty END AS specialty
            FROM lines WHERE auth_number IS NOT NULL) l
      LEFT JOIN latest_ppl d ON d.specialty IS NOT DISTINCT FROM l.specialty AND d.cpt_code = l.cpt_code
      GROUP BY l.auth_number""",
    "priced": """
      SELECT m.*, coalesce(c.avg_cost, 150) AS avg_cost,
             (1 - m.is_approved) * coalesce(c.avg_cost, 150) AS false_positive_dollars
      FROM matched m LEFT JOIN costs c ON c.auth_number = m.referral_ident""",
}


# --- the queries ------------------------------------------------------------------------------------

QUERIES: dict[str, str] = {}

_MONEY = ("avg_hcp_cost", "cost_to_review", "sum_cost_denied", "roi")


def _shift(digits: int) -> str:
    return f"{0.123 * 10**-digits:.{digits + 3}f}"


def _round(source: str, digits: int, *columns: str, exclude: str = "") -> str:
    swaps = ", ".join(f"round({c} + {_shift(digits)}, {digits}) AS {c}" for c in columns)
    drop = f"EXCLUDE ({exclude}) " if exclude else ""
    return f"SELECT * {drop}REPLACE ({swaps}) FROM {source}"


def _table(source: str) -> str:
    return _round(source, 4, *_MONEY, exclude="cnt_hcp_cost")


def _xtab(source: str, keys: list[str], sets: str, measure: str) -> str:
    labels = ", ".join(f"coalesce(CAST({k} AS VARCHAR), 'All') AS {k}" for k in keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""SELECT {labels}, {measure} FROM {source} WHERE {known}
               GROUP BY GROUPING SETS ({sets})"""


_SUMMARY_MONEY = (
    "dollars_denied_now_app", "cost_to_review_bene", "cost_to_review_loss", "new_denial_bene_est",
    "deny_now_aa", "net_benefit", "net_benefit_w_new_den",
)


def _summary_rounded(source: str) -> str:
    rates = ", ".join(f"round({c} + 0.000000123, 6) AS {c}" for c in ("new_rate", "old_rate"))
    money = ", ".join(f"round({c} + 0.00123, 2) AS {c}" for c in _SUMMARY_MONEY)
    return f"SELECT * REPLACE ({rates}, {money}) FROM {source}"


def _report() -> str:
    exact = ("specialty", "ref_vol", "num_codes")
    cols = ", ".join(
        f'{c} AS "{title}"' if c in exact else f'round({c}, 2) AS "{title}"'
        for c, title in K.SPECIALTY_SUMMARY_HEADER.items()
    )
    return f"SELECT {cols} FROM summary"


def _checks(as_of: str, fresh: int, span: tuple[int, int]) -> str:
    return f"""
      WITH d AS (SELECT min(date_received) AS a, max(date_received) AS z FROM lines),
      raw AS (
        SELECT 'freshness_days' AS "check", epoch({_ts(as_of)} - z)::DOUBLE / 86400 AS value,
               NULL::DOUBLE AS lo, {fresh}::DOUBLE AS hi FROM d
        UNION ALL SELECT 'span_days', epoch(z - a)::DOUBLE / 86400, {span[0]}, {span[1]} FROM d
        UNION ALL SELECT 'review_cost', sum(cost_to_review), {S.DEPARTMENT_COST * 0.95!r},
               {S.DEPARTMENT_COST * 1.05!r} FROM roi
        UNION ALL SELECT 'groups_without_roi', count(*) FILTER (roi IS NULL), NULL, 1 FROM roi
        UNION ALL SELECT 'groups_without_review', count(*) FILTER (units_man = 0), NULL, NULL FROM roi
        UNION ALL SELECT 'unexpected_reasons', count(DISTINCT reason), NULL, 1 FROM decision_log
               WHERE reason NOT IN ({_list(K.EXPECTED_REASONS)})
        UNION ALL SELECT 'duplicate_decision_keys', count(*), NULL, 1 FROM (
               SELECT 1 FROM decision_log GROUP BY specialty, cpt_code, is_ppl HAVING count(*) > 1))
      SELECT "check", round(value + 0.00123, 2) AS value, round(lo + 0.00123, 2) AS lo, round(hi + 0.00123, 2) AS hi,
             (lo IS NULL OR value > lo) AND (hi IS NULL OR value < hi) AS passed FROM raw"""


def _titled(source: str, header: dict[str, str], rounded: dict[str, str]) -> str:
    cols = ", ".join(f'{rounded.get(c, c)} AS "{title}"' for c, title in header.items())
    return f"SELECT {cols} FROM ({source})"


_CODE_DETAIL = f"""
      SELECT p.specialty, p.cpt_code, p.is_ppl, p.units, p.auto_rate, p.denial_rate, p.units_man,
             {', '.join(f'round(p.{c} + 0.0000123, 4) AS {c}' for c in _MONEY)}, p.fin_aa_rec, p.dec_source,
             p.overrule_rsn, p.final_decision, r.new_rate, n.name AS cpt_desc
      FROM plan_c p LEFT JOIN code_rate r
        ON r.specialty = p.specialty AND r.cpt_code = p.cpt_code AND r.is_ppl = p.is_ppl
      JOIN names n ON n.cpt_code = p.cpt_code"""


def _rule_constants() -> str:
    return """8 AS auth_status, 1 AS auth_status_num, CAST(NULL AS VARCHAR) AS reftype_key,
      CAST(NULL AS VARCHAR) AS reftype_num, false AS bypass_adjudication, 'All' AS region_list,
      2000 AS rule_priority, 2 AS rule_category, DATE '2019-06-15' AS eff_date,
      CAST(NULL AS DATE) AS term_date, 'All' AS entity_list, 'All' AS site_list, 'All' AS hmo_list,
      'All' AS product_type_list, CAST(NULL AS VARCHAR) AS dx_list, 18 AS age_from, 199 AS age_to,
      'A' AS gender, 'A' AS goldstar, 'All' AS pos_list, 'All' AS refto_provider_list,
      'All' AS reffrom_spc_list, 'All' AS facility_spc_list, 'OR' AS spc_operator,
      DATE '2019-06-14' AS date_added, 'analytics' AS added_by, false AS archive_flag,
      'ALL' AS reffrom_provider_list, 'PPL' AS refto_status_list"""


# the steps of a period once more, over the quarterly windows
_PERIOD = (
    "clean bounds halves period_ga half_groups half_roi half_rec compared comparison claim_stats code_mean lines "
    "headers claim_rows"
).split()
_PERIOD_NAME = re.compile(rf"\b({'|'.join(_PERIOD)})\b")


def _quarterly(text: str) -> str:
    return _PERIOD_NAME.sub(r"\1_q", text)


STEPS |= {f"{name}_q": _quarterly(STEPS[name]) for name in _PERIOD}
STEPS |= {
    "headers_q": _header_select(S.REFERRAL_WINDOW_QUARTERLY),
    "claim_rows_q": _claims_select(S.CLAIM_WINDOW_QUARTERLY),
    "ga_q": _quarterly(STEPS["ga"]),
    "roi_q": _quarterly(_roi_select("clean", "SELECT unit_cost FROM ga_q")),
}

QUERIES |= {
    "claims_cost_stats": _round("claim_stats", 4, "sd_hcp_cost"),
    "claims_cost_stats_quarterly": _round(
        "(" + _stats_select("claim_rows_quarterly") + ")", 4, "sd_hcp_cost"
    ),
    "claim_dimension_semi": "SELECT * FROM claim_rows",
    "cpt_short_name": "SELECT * FROM names",
    "referral_extract": "SELECT * FROM lines",
    "referral_extract_new": "SELECT * EXCLUDE (urgent) FROM lines_new",
    "referral_extract_stored": "SELECT * FROM lines_q",
    "referral_extract_bucketed": "SELECT * FROM lines",
    "claims_cost_stats_stored": _round(
        "(" + _stats_select("claim_rows_quarterly") + ")", 4, "sd_hcp_cost"
    ),
    "claims_cost_stats_monthly": _round("claim_stats", 4, "sd_hcp_cost"),
    "code_summary_monthly": f"""
      SELECT specialty, cpt_code, is_ppl, count(units) AS units, avg(is_autoapp) AS auto_rate,
             avg(is_den) AS denial_rate, CAST(sum(1 - is_autoapp) AS BIGINT) AS units_man
      FROM clean WHERE specialty IS NOT NULL
        AND date_received BETWEEN {_ts(S.PART_WINDOW[0])} AND {_ts(S.PART_WINDOW[1])}
      GROUP BY specialty, cpt_code, is_ppl""",
    "text_lines_pipe": "SELECT * FROM lines",
    "text_claims_comma": _round("claim_stats", 4, "sd_hcp_cost"),
    "text_saved_index": "SELECT * FROM names",
    "text_dates": """SELECT cpt_code, min(date_received) AS oldest, max(date_decision) AS newest,
                            count(date_decision) AS decided FROM lines GROUP BY cpt_code""",
    "table_round_trip": "SELECT * EXCLUDE (o_orderkey, urgent) FROM headers",
    "text_scan_good": """SELECT CAST(l_shipdate AS DATE) AS decision_date, count(*) AS n, sum(l_quantity) AS units
      FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag <> 'R' GROUP BY 1""",
    "text_scan_rejected": """
      SELECT concat_ws('; ', CASE WHEN l_returnflag = 'R' THEN 'column decision_date, not date: unknown' END,
                       CASE WHEN l_linenumber = 7 THEN 'column units, not double: n/a' END) AS reason, count(*) AS n
      FROM lineitem WHERE l_linenumber = 7 OR l_returnflag = 'R' GROUP BY 1""",
    "referral_name_fanout": """SELECT l.cpt_code, l.specialty, CAST(sum(k) AS BIGINT) AS n, sum(units * k) AS units
      FROM lines l JOIN (SELECT cm.code, count(*) AS k FROM part p JOIN code_map cm ON cm.brand = p.p_brand
                         GROUP BY cm.code) c ON c.code = l.cpt_code GROUP BY 1, 2""",
    "referral_header_extract": "SELECT * EXCLUDE (o_orderkey, urgent) FROM headers",
    "clean_referrals": "SELECT * FROM clean",
    "lob_specialty_split": f"""
      SELECT CASE WHEN specialty = 'RADIOLOGY' THEN specialty || lob2 ELSE specialty END AS specialty,
             lob2 AS lob, count(*) AS n
      FROM (SELECT *, {_case('lob', K.LOB_SUFFIX_SENIOR)} AS lob2 FROM lines) GROUP BY ALL""",
    "first_line_per_referral": """
      SELECT * EXCLUDE (place) FROM (
        SELECT *, row_number() OVER (PARTITION BY auth_number ORDER BY date_received, cpt_code,
               ref_type_key, ppl, date_decision, ref_type, status_cat, status_name, specialty, region,
               urgent, units, lob) AS place
        FROM lines WHERE auth_number IS NOT NULL) WHERE place = 1""",
    "specialty_union": f"""
      SELECT specialty FROM clean_old UNION SELECT specialty FROM clean_new
      UNION SELECT '{K.EXTRA_SPECIALTY}'""",
    "missing_lob": "SELECT count(*) FILTER (lob IS NULL) AS missing FROM lines",
    "one_region": """SELECT region, specialty, count(units) AS units FROM clean
                     WHERE upper(region) = 'SAN GABRIEL VALLEY' GROUP BY region, specialty""",
    "note_cleanup": f"""SELECT {_case('reason', K.NOTE_CLEANUP)} AS notes, count(*) AS n
                        FROM decision_log GROUP BY 1""",
    "cost_by_code": _round("code_mean", 4, "avg_hcp_cost_code"),
    "manual_volume": """SELECT specialty, cpt_code, is_ppl, count(units) AS units_man FROM clean
                        WHERE is_autoapp = 0 AND specialty IS NOT NULL GROUP BY ALL""",
    "code_summary": "SELECT specialty, cpt_code, is_ppl, units, auto_rate, denial_rate, units_man FROM roi",
    "code_cost_fallback": """SELECT specialty, cpt_code, is_ppl, units, auto_rate, denial_rate,
      units_man, cnt_hcp_cost, round(avg_hcp_cost + 0.0000123, 4) AS avg_hcp_cost FROM roi""",
    "review_unit_cost": """SELECT CAST(sum(1 - is_autoapp) AS BIGINT) AS lines_man,
      round((SELECT unit_cost FROM ga) + 0.0000123, 4) AS unit_cost FROM clean""",
    "review_roi": _round("roi", 4, *_MONEY),
    "unmatched_counts": """SELECT count(*) FILTER (cost_to_review IS NULL) AS groups_without_review,
      count(*) FILTER (avg_hcp_cost IS NULL) AS groups_without_cost,
      count(*) FILTER (roi IS NULL) AS groups_without_roi FROM roi""",
    "override_codes": _table("only_codes"),
    "override_specialties": _table("only_specialties"),
    "overlay_decisions": _table("only_overlay"),
    "override_low_volume": _table("only_low"),
    "override_out_of_network": _table("only_network"),
    "latest_decisions": "SELECT * FROM latest",
    "duplicate_decisions": """SELECT specialty, cpt_code, is_ppl, count(*) AS copies FROM decision_log
                              GROUP BY ALL HAVING count(*) > 1""",
    "decision_plan_a": _table("plan_a"),
    "decision_plan_a_unit_cost": _table("plan_a_cost"),
    "decision_plan_b": _table("plan_b"),
    "decision_plan_c": _table("plan_c"),
    "decision_plan_m": _table("plan_m"),
    "decision_counts": _xtab(
        "plan_c", ["final_decision"], "(final_decision), ()", "count(cpt_code) AS n"
    ),
    "allow_list": """SELECT DISTINCT specialty, cpt_code FROM plan_c
                     WHERE final_decision = 1 AND is_ppl = 1""",
    "allow_list_counts": f"""
      SELECT s.specialty, count(DISTINCT p.cpt_code) AS num_codes
      FROM (SELECT specialty FROM plan_c UNION SELECT '{K.EXTRA_SPECIALTY}') s
      LEFT JOIN plan_c p ON p.specialty = s.specialty AND p.final_decision = 1 AND p.is_ppl = 1
      GROUP BY s.specialty""",
    "assign_status": """SELECT auth_number, specialty, cpt_code, is_ppl, ref_type, auto_approvable
                        FROM scored""",
    "referral_decision": "SELECT * FROM refs",
    "attach_referral_decision": """SELECT auth_number, specialty, cpt_code, auto_approvable, aa_yn
                                   FROM referred""",
    "predicted_rate": "SELECT round(avg(aa_yn) - 0.04::DOUBLE + 0.000000123, 6) AS predicted_rate FROM refs",
    "false_positives": """SELECT auth_number, specialty, cpt_code, date_received, status_name, is_den,
                          aa_yn FROM referred WHERE is_den = 1 AND aa_yn = 1""",
    "referral_lookup": """SELECT auth_number, specialty, cpt_code, status_name, date_received FROM clean
                          WHERE specialty = 'ENT-OTOLARYNGOLOGY' AND cpt_code = '95024'""",
    "spot_check": """
      SELECT date_received, auth_number, cpt_code, units, status_name FROM clean
      WHERE specialty = 'CARDIOLOGY' AND is_ppl = 1 AND auth_number IS NOT NULL
      ORDER BY date_received DESC, auth_number DESC, cpt_code DESC, units DESC, status_name DESC
      LIMIT 10""",
    "referral_rollup": "SELECT * FROM rollup",
    "referral_rollup_region": "SELECT * FROM rollup_region",
    "specialty_rates": """SELECT specialty, count(aa_yn) AS ref_vol, round(avg(aa_yn) + 0.000000123, 6) AS new_rate,
                          round(avg(is_autoapp) + 0.000000123, 6) AS old_rate FROM rollup GROUP BY specialty""",
    "denied_now_approved": """SELECT specialty, round(coalesce(sum(is_den * aa_yn), 0) + 0.00123, 2) AS deny_now_aa
                              FROM rollup GROUP BY specialty""",
    "line_financials": """
      SELECT auth_number, specialty, cpt_code, is_ppl, aa_yn,
             round(dollars_denied_now_app + 0.0000123, 4) AS dollars_denied_now_app,
             round(cost_to_review_bene + 0.0000123, 4) AS cost_to_review_bene,
             round(cost_to_review_loss + 0.0000123, 4) AS cost_to_review_loss,
             round(new_denial_bene_est + 0.0000123, 4) AS new_denial_bene_est FROM financials""",
    "specialty_financials": """
      SELECT specialty, round(dollars_denied_now_app + 0.00123, 2) AS dollars_denied_now_app,
             round(cost_to_review_bene + 0.00123, 2) AS cost_to_review_bene,
             round(cost_to_review_loss + 0.00123, 2) AS cost_to_review_loss,
             round(new_denial_bene_est + 0.00123, 2) AS new_denial_bene_est
      FROM (SELECT specialty, coalesce(sum(dollars_denied_now_app), 0) AS dollars_denied_now_app,
                   coalesce(sum(cost_to_review_bene), 0) AS cost_to_review_bene,
                   coalesce(sum(cost_to_review_loss), 0) AS cost_to_review_loss,
                   coalesce(sum(new_denial_bene_est), 0) AS new_denial_bene_est
            FROM financials WHERE specialty IS NOT NULL GROUP BY specialty)""",
    "specialty_summary": _summary_rounded("summary"),
    "specialty_report": _report(),
    "new_period_summary": _summary_rounded("summary_new"),
    "projected_code_rate": "SELECT * FROM code_rate",
    "code_detail": _CODE_DETAIL,
    "code_rate_report": _titled(
        "SELECT * FROM code_rate", K.CODE_RATE_HEADER, {"new_rate": "round(new_rate, 4)"}
    ),
    "code_detail_report": _titled(
        _CODE_DETAIL, K.CODE_DETAIL_HEADER,
        {c: f"round({c} + 0.000000123, 6)" for c in ("auto_rate", "denial_rate", "new_rate")},
    ),
    "xtab_auto_denied": _xtab(
        "clean", ["is_autoapp", "is_den"], "(is_autoapp, is_den), ()", "count(auth_number) AS n"
    ),
    "xtab_manual_denied": _xtab(
        "(SELECT * FROM clean WHERE is_autoapp = 0)", ["is_autoapp", "is_den"],
        "(is_autoapp, is_den), ()", "count(auth_number) AS n",
    ),
    "xtab_referral": _xtab(
        "refs", ["aa_yn", "denial_rate"], "(aa_yn, denial_rate), (aa_yn), (denial_rate), ()",
        "count(auth_number) AS n",
    ),
    "xtab_auto_denied_by_new": _xtab(
        "referred", ["is_autoapp", "is_den", "aa_yn"],
        "(is_autoapp, is_den, aa_yn), (is_autoapp, is_den), (aa_yn), ()", "count(units) AS n",
    ),
    "xtab_lines": _xtab(
        "referred", ["aa_yn", "is_den"], "(aa_yn, is_den), (aa_yn), (is_den), ()",
        "count(cpt_code) AS n",
    ),
    "xtab_urgent": _xtab(
        "referred", ["aa_yn", "urgent"], "(aa_yn, urgent), (aa_yn), (urgent), ()",
        "count(auth_number) AS n",
    ),
    "period_split": "SELECT auth_number, cpt_code, date_received, post FROM halves",
    "period_bounds": "SELECT * FROM bounds",
    "period_summary": """SELECT *, round(CASE WHEN units_man > 0
      THEN units_man * (SELECT unit_cost FROM period_ga) END + 0.0000123, 4) AS cost_to_review FROM half_groups""",
    "period_compare": _round("comparison", 4, "avg_hcp_cost", "roi", "roi_pre"),
    "period_split_quarterly": "SELECT auth_number, cpt_code, date_received, post FROM halves_q",
    "period_bounds_quarterly": "SELECT * FROM bounds_q",
    "period_summary_quarterly": """SELECT *, round(CASE WHEN units_man > 0
      THEN units_man * (SELECT unit_cost FROM period_ga_q) END + 0.0000123, 4) AS cost_to_review FROM half_groups_q""",
    "period_compare_quarterly": _round("comparison_q", 4, "avg_hcp_cost", "roi", "roi_pre"),
    "high_volume_groups": """SELECT specialty, cpt_code, is_ppl, units, units_pre, vol_increase
                             FROM comparison WHERE units > 40""",
    "reason_category": f"""
      SELECT reason, CASE WHEN reason IN ({_list(K.REASON_CATEGORIES['M'])}) THEN 'M'
               WHEN reason IN ({_list(K.REASON_CATEGORIES['do not AA'])}) THEN 'do not AA'
               WHEN reason IN ('Override Pend', 'DBA') THEN 'AA' ELSE '0' END AS reason_cat,
             count(*) AS n
      FROM (SELECT coalesce(reason, 'DBA') AS reason FROM decision_log) GROUP BY ALL""",
    "predictions_prepared": """SELECT referral_ident, ref_to_status, is_ppl, ref_to_specialty, px_code,
                               is_approved FROM predicted""",
    "confidence_decile": "SELECT referral_ident, px_code, confidence, decile FROM binned",
    "confidence_decile_monthly": "SELECT referral_ident, px_code, confidence, decile FROM binned",
    "referral_cost": "SELECT * FROM costs",
    "false_positive_dollars": """SELECT referral_ident, px_code, decile, decision, reason, is_approved,
                                 avg_cost, false_positive_dollars FROM priced""",
    "decile_report": _xtab(
        "priced", ["decile"], "(decile), ()",
        """count(*) AS candidates, sum(false_positive_dollars) AS false_positive_dollars,
           sum(CASE WHEN status_type_human IS DISTINCT FROM 'CANCEL' THEN false_positive_dollars END)
             AS dollars_not_cancelled""",
    ),
    "decile_status": _xtab(
        "(SELECT * FROM priced WHERE decile = 9)", ["status_type_human"], "(status_type_human), ()",
        "count(referral_ident) AS n",
    ),
    "decision_reason_xtab": """
      WITH top AS (SELECT CAST(decision AS VARCHAR) AS decision, reason,
                          CAST(is_approved AS VARCHAR) AS is_approved
                   FROM priced WHERE decile > 8 AND decision IS NOT NULL AND reason IS NOT NULL),
      frame AS (SELECT * FROM (SELECT DISTINCT decision FROM top), (SELECT DISTINCT reason FROM top),
                (SELECT DISTINCT is_approved FROM top UNION SELECT 'All')),
      cell AS (SELECT decision, reason, coalesce(is_approved, 'All') AS is_approved, count(*) AS n
               FROM top GROUP BY GROUPING SETS ((decision, reason, is_approved), (decision, reason)))
      SELECT f.*, c.n FROM frame f LEFT JOIN cell c USING (decision, reason, is_approved)
      UNION ALL
      SELECT 'All', 'All', coalesce(is_approved, 'All'), count(*) FROM top
      GROUP BY GROUPING SETS ((is_approved), ())""",
    "status_frequency": """SELECT status_type_human, count(*) AS n FROM binned
      WHERE decile = 6 AND is_approved = 0 AND status_type_human IS NOT NULL GROUP BY 1""",
    "rejection_rate": "SELECT 1 - avg(is_approved) AS rejection_rate FROM predicted",
    "unmatched_candidates": """
      SELECT p.ref_to_specialty, count(*) AS n FROM predicted p LEFT JOIN latest_ppl d
        ON d.specialty = p.ref_to_specialty AND d.cpt_code = p.px_code AND d.is_ppl = p.is_ppl
      WHERE d.decision IS NULL GROUP BY 1""",
    "candidate_lookup": """SELECT referral_ident, px_code, decile, confidence, decision FROM matched
      WHERE decile = 9 AND ref_to_specialty = 'SURGERY - VASCULAR' AND reason = 'DBA'""",
    "unexpected_reasons": f"""SELECT DISTINCT reason FROM decision_log
      WHERE reason IS NOT NULL AND reason NOT IN ({_list(K.EXPECTED_REASONS)})""",
    "quality_checks": _checks(S.AS_OF, K.FRESH_DAYS, K.SPAN_DAYS),
    "quality_checks_scanned": _checks(S.AS_OF, K.FRESH_DAYS, K.SPAN_DAYS),
    "missing_lob_seen": "SELECT count(*) AS lines, count(*) FILTER (lob IS NULL) AS missing_lob FROM lines",
    "quality_checks_quarterly": _quarterly(
        _checks(S.AS_OF_QUARTERLY, K.FRESH_DAYS_QUARTERLY, K.SPAN_DAYS_QUARTERLY).replace("FROM roi", "FROM roi_q")
    ),
    "rule_table": f"""
      WITH pairs AS (
        SELECT specialty, cpt_code FROM plan_c WHERE final_decision = 1 AND is_ppl = 1
        UNION SELECT '{K.EXTRA_SPECIALTY}', unnest([{_list(K.EXTRA_SPECIALTY_CODES)}])
        UNION SELECT '{K.CARE_PROGRAM_SPECIALTY}', 'All'),
      rules AS (SELECT specialty, string_agg(cpt_code, ',' ORDER BY cpt_code) AS px_list
                FROM pairs GROUP BY specialty),
      bare AS (SELECT *, regexp_replace(specialty, '(_not_sen|_senior)$', '') AS plain FROM rules)
      SELECT row_number() OVER (ORDER BY specialty) AS rule_key, px_list,
             replace(specialty || '_PPL', ' ', '') AS rule_code,
             'auto-approve ' || specialty || ' referrals to PPL providers for specific codes.' AS rule_desc,
             CASE WHEN specialty LIKE '%\\_senior' ESCAPE '\\' THEN 'SENIOR' ELSE 'All' END AS lob_list,
             CASE plain WHEN 'RADIOLOGY' THEN '{K.UMBRELLA_SPECIALTIES['RADIOLOGY']}'
                        WHEN 'CARDIOLOGY' THEN '{K.UMBRELLA_SPECIALTIES['CARDIOLOGY']}'
                        ELSE plain END AS refto_spc_list,
             {_rule_constants()} FROM bare""",
}


def _compose(text: str) -> str:
    """Put the steps a query names, and those they name, in front of it."""
    order: list[str] = []

    def visit(fragment: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", fragment)):
            if word in STEPS and word not in order and STEPS[word] != fragment:
                visit(STEPS[word])
                if word not in order:
                    order.append(word)

    visit(text)
    body = text.strip()
    if not order:
        return body
    shared = ",\n".join(f"{name} AS ({STEPS[name]})" for name in order)
    return f"WITH {shared}\nSELECT * FROM (\n{body}\n)"


ORACLE: dict[str, str] = {name: _compose(text) for name, text in QUERIES.items()}
