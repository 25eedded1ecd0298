"""Export of the allow-list as one rule per specialty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlane import constants as K
from clearlane.functions.columns import replace_values
from clearlane.operators.ranking import sequence_number

EXTRA_RULES = {
    K.EXTRA_SPECIALTY: K.EXTRA_SPECIALTY_CODES,
    K.CARE_PROGRAM_SPECIALTY: (K.ALL,),
}


def with_extra_codes(
    allowed: DataFrame, extra: Mapping[str, Sequence[str]] = EXTRA_RULES
) -> DataFrame:
    """Specialties the warehouse does not know replace or join the list."""
    if not extra:
        return allowed
    pairs = [F.struct(F.lit(s).alias("specialty"), F.lit(c).alias("cpt_code")) for s in extra for c in extra[s]]
    added = allowed.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    kept = allowed.filter(~F.coalesce(F.col("specialty").isin(*extra), F.lit(False)))
    return kept.select("specialty", "cpt_code").union(added)


def referred_specialty(specialty: Column) -> Column:
    """Specialty without its line-of-business suffix, widened to the umbrella
    list where there is one."""
    pattern = f"({K.NOT_SENIOR_SUFFIX}|{K.SENIOR_SUFFIX})$"
    return replace_values(F.regexp_replace(specialty, pattern, ""), K.UMBRELLA_SPECIALTIES)


def _constants(added_by: str, date_added: str, with_region: bool) -> dict[str, Column]:
    none = F.lit(None).cast("string")
    text = F.lit(K.ALL)
    columns = {
        "auth_status": F.lit(8),
        "auth_status_num": F.lit(1),
        "reftype_key": none,
        "reftype_num": none,
        "bypass_adjudication": F.lit(False),
        "region_list": text,
        "rule_priority": F.lit(2000),
        "rule_category": F.lit(2),
        "eff_date": F.lit(K.RULE_EFFECTIVE_DATE).cast("date"),
        "term_date": F.lit(None).cast("date"),
        "entity_list": text,
        "site_list": text,
        "hmo_list": text,
        "product_type_list": text,
        "dx_list": none,
        "age_from": F.lit(18),
        "age_to": F.lit(199),
        "gender": F.lit("A"),
        "goldstar": F.lit("A"),
        "pos_list": text,
        "refto_provider_list": text,
        "reffrom_spc_list": text,
        "facility_spc_list": text,
        "spc_operator": F.lit("OR"),
        "date_added": F.lit(date_added).cast("date"),
        "added_by": F.lit(added_by),
        "archive_flag": F.lit(False),
        "reffrom_provider_list": F.lit("ALL"),
        "refto_status_list": F.lit(K.RULE_PROVIDER_STATUS),
    }
    if not with_region:
        del columns["region_list"]
    return columns


def rule_table(
    allowed: DataFrame,
    added_by: str,
    date_added: str,
    extra: Mapping[str, Sequence[str]] = EXTRA_RULES,
    with_region: bool = True,
) -> DataFrame:
    """One rule per specialty that has at least one allowed code, numbered in
    alphabetical order. A rule's code list holds distinct codes, so its length
    is bounded by the code system, not by the number of referrals."""
    specialty = F.col("specialty")
    lists = (
        with_extra_codes(allowed, extra)
        .filter(specialty.isNotNull())
        .groupBy("specialty")
        .agg(F.array_sort(F.collect_set("cpt_code")).alias("px_list"))
    )
    numbered = sequence_number(lists, ["specialty"], "rule_key")
    return numbered.select(
        "rule_key",
        "px_list",
        F.replace(F.concat(specialty, F.lit("_PPL")), F.lit(" "), F.lit("")).alias("rule_code"),
        F.concat(
            F.lit("auto-approve "), specialty,
            F.lit(" referrals to PPL providers for specific codes."),
        ).alias("rule_desc"),
        F.when(specialty.endswith(K.SENIOR_SUFFIX), F.lit(K.SENIOR_LOB))
        .otherwise(F.lit(K.ALL))
        .alias("lob_list"),
        referred_specialty(specialty).alias("refto_spc_list"),
        *[c.alias(n) for n, c in _constants(added_by, date_added, with_region).items()],
    )
