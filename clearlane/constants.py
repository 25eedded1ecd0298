"""Domain constants.

FIXED VALUES: status names, code lists, specialty lists, labels and thresholds
below are business vocabulary. They must match the source systems exactly, so
they are kept as plain text in one place.
"""

# --- statuses -----------------------------------------------------------------

RETRO_STATUSES = (
    "APPROVED - RETRO REVIEW",
    "DENIED - RETRO REVIEW",
    "APPROVED - COB RETRO",
    "PENDING - RETRO REVIEW",
)

DENIED_STATUSES = (
    "DENIED - CM",
    "DENIED - BENEFIT CARVE OUT",
    "DENIED - NOT A COVERED BENEFIT",
    "DENIED - APPEAL",
    "DENIED - CLINICAL TRIAL/EXP/INV",
    "DENIED - TRANSPLANT",
    "DENIED - MD",
    "DENIED - CM/MD",
    "DENIED - REDIRECT OSVN",
    "DENIED - TICKLER",
)

AUTO_APPROVED_STATUS = "APPROVED - AUTO"
APPROVED_CATEGORY = "APPROVED"

# --- extract filters ----------------------------------------------------------

COMMUNITIES = (
    "San Gabriel Valley",
    "South Bay",
    "San Fernando Valley",
    "Orange County",
    "LA/Downtown",
    "Long Beach",
    "Magan",
)
FUND_TYPE = "PROFESSIONAL"
SUPER_REGION = "SOUTHERN CALIFORNIA"
DESCRIPTION_LENGTH = 25

CLAIM_WINDOW = ("2018-10-15", "2019-10-15")
CLAIM_WINDOW_QUARTERLY = ("2019-01-01", "2019-09-28")
REFERRAL_WINDOW = ("2018-10-15", "2019-10-15")
REFERRAL_WINDOW_NEW = ("2019-04-01", "2019-07-01")
REFERRAL_WINDOW_HEADER = ("2019-01-01", "2019-09-27")
REFERRAL_WINDOW_QUARTERLY = ("2019-05-02", "2019-09-28")

# --- cleaning -----------------------------------------------------------------

SPLIT_SPECIALTIES = ("RADIOLOGY",)

# line-of-business suffixes; one map per pipeline generation
LOB_SUFFIX_SENIOR = {"COMMERCIAL": "_not_sen", "SENIOR": "_senior", "MEDI-CAL": "_not_sen"}
LOB_SUFFIX_A = {"COMMERCIAL": "_b", "SENIOR": "_s", "MEDI-CAL": "_s"}
LOB_SUFFIX_M = {"COMMERCIAL": "_b", "SENIOR": "_s", "MEDI-CAL": "_b"}

# specialties known to the rule system only
EXTRA_SPECIALTY = "HIV/AIDS SPECIALIST"
EXTRA_SPECIALTY_CODES = ("99203", "99204", "99213", "99214")

NOTE_CLEANUP = {
    " Capped Providers/Employed ": "capped providers",
    "Concern for Over-Utilization": "overutilization concern",
    "Cost  containment with this speciality": "cost containment",
    "drug?": "UD",
    "Facility Code": "facility code",
    "GUIDELINE REQ": "guideline req",
    "Heavy cap volume": "heavy cap vol",
    "Inappropriate location": "inappropriate loc",
    "NEEDS BENEFIT CHECK": "bene check",
    "Needs Review": "needs review",
    "needs review": "needs review",
    "Not CMS benefit": "not CMS bene",
    "ok to AA to employed/cap providers. R1,II,III,VI": "can approve",
    "Old code": "old code",
    "RNL Stauts, intentionally surpressed, not currently reviewed; additional discussion": "RNL",
    "Unclassified Drugs": "unclassified drug",
    "UPCODING": "upcode",
}

# --- cost and return on investment ---------------------------------------------

DEPARTMENT_COST = 6_500_000.0
UNIT_COST_OVERRIDE = 2.53
ROI_UNKNOWN_COST = 100.0
ROI_NO_REVIEW = 0.01
ROI_THRESHOLD = 1.0
LOW_VOLUME = 30
RATE_HAIRCUT = 0.04
DAYS_PER_YEAR = 365

# --- overrides ------------------------------------------------------------------

SOURCE_ANALYSIS = "DBA"
SOURCE_CLINICAL = "clinical"
SOURCE_RULE = "rule"
SOURCE_RULE_CAPITAL = "Rule"
REASON_CODE_LIST = "from PRL"
REASON_SOFT_PEND = "Soft Pend Specialty"
REASON_HARD_PEND = "Hard Pend Specialty"
REASON_LOW_VOLUME = "low volume"
REASON_OUT_OF_NETWORK = "Pend EPL"

DERMATOLOGY_CODES = (
    "10060", "10061", "11000", "11055", "11057", "11100", "11101", "11300", "11301", "11302",
    "11303", "11305", "11306", "11307", "11308", "11310", "11311", "11312", "11313", "11404",
    "11426", "11440", "11600", "11601", "11602", "11603", "11604", "11606", "11620", "11621",
    "11622", "11623", "11624", "11626", "11640", "11641", "11642", "11643", "11644", "11646",
    "11900", "11901", "29580", "54050", "54056", "54100", "67810", "69100", "87101", "87220",
    "J3301", "10080", "10081", "10140", "10180", "11056", "11444", "11446", "54105",
)
PAIN_CODES = ("99203", "99204", "99213", "99214")
GASTRO_CODES = ("45378", "45380", "45385", "G0105", "G0121", "00812")
TRANSFUSION_CODES = (
    "36430", "86900", "86901", "86902", "86903", "86904", "86905", "86906", "86907", "86908",
    "86909", "86910", "86911", "86912", "86913", "86914", "86915", "86916", "86917", "86918",
    "86919", "86920",
)
PODIATRY_CODES = ("11055",)
CODES_TO_PEND = (
    "97810", "95115", "95116", "95117", "95170", "95180", "95181", "95182", "95183", "95184",
    "95185", "95186", "95187", "95188", "95199", "95004", "A0999", "A0426", "A0427", "A0428",
    "A0429", "92590", "92591", "92592", "92593", "92594", "90901", "90902", "90903", "90904",
    "90905", "90906", "90907", "90908", "90909", "90910", "90911", "90875", "90876", "86890",
    "93798", "98940", "J1050", "58301", "58565", "58611", "G0337", "74740", "89320", "J3490",
    "J0717", "J1438", "J7321", "J7322", "J7323", "J7324", "J7325", "J3489", "J0135", "J3030",
    "J1830", "J9215", "J9218", "J0129", "J9202", "J3301", "J1745", "96365", "96366", "90378",
    "J2505", "J1440", "J1441", "J0885", "J0886", "T1013", "96118", "96119", "96120", "97166",
    "97167", "97168", "97110", "92015", "97162", "97163", "36468", "92506", "55250", "59840",
    "S0199", "S0618", "92595", "58300", "J7300", "57170", "A4266", "11981", "J7302", "58670",
    "59600", "58605", "64612", "J0585", "11055", "11057", "11719", "11721", "G0127", "S0390",
)

SOFT_PEND_SPECIALTIES = (
    "ACUPUNCTURE", "ADDICTION MEDICINE", "ANESTHESIOLOGY", "BEHAVIORAL HEALTH", "CHIROPRACTIC",
    "DENTIST", "DME MAINTENANCE", "LICENSED CLIN SOCIAL WORKER", "MFCC (THERAPIST)",
    "NON-CONTRACT UNKWN BILL AREA", "NURSE PRACTITIONER", "NURSING FACILITY - OTHER", "OPTICIAN",
    "PEDS-DEVELOPMENTAL BEHAVIORAL", "PSYCHIATRY", "PSYCHOLOGY", "SENIOR WELLNESS VISIT",
    "SPORTS MEDICINE", "SURGERY - ORAL", "AMBULATORY SURGICAL CENTER", "AMBULANCE",
    "ALLERGY/IMMUNOLOGY", "CUSTODIAL CARE", "HOME HEALTH", "INFERTILITY", "OPTOMETRY",
    "PALLIATIVE CARE", "PODIATRY", "SLEEP STUDY", "SNF - FAC", "OCCUPATIONAL THERAPY",
    "PHYSICAL THERAPY/REHAB", "FACILITY SERVICES", "GENETICS", "INTERVENTIONAL RADIOLOGY",
    "LABORATROY", "NUCLEAR MEDICINE", "ONCOLOGY - GYN", "PATHOLOGY", "PHARMACY",
    "SURGERY - HAND", "SURGERY - CARDIAC", "SURGERY - MAXILLOFACIAL ORAL",
    "SURGERY - PLASTIC/RECONSTRUCT",
)
SOFT_PEND_SPECIALTIES_C = (
    "ALLERGY/IMMUNOLOGY", "PODIATRY", "PHYSICAL THERAPY/REHAB", "FACILITY SERVICES", "GENETICS",
    "INTERVENTIONAL RADIOLOGY", "LABORATROY", "ONCOLOGY - GYN", "SURGERY - CARDIAC",
    "SURGERY - MAXILLOFACIAL ORAL", "SURGERY - PLASTIC/RECONSTRUCT",
)
HARD_PEND_SPECIALTIES = (
    "ACUPUNCTURE", "ADDICTION MEDICINE", "ANESTHESIOLOGY", "BEHAVIORAL HEALTH", "CHIROPRACTIC",
    "DENTIST", "DME MAINTENANCE", "LICENSED CLIN SOCIAL WORKER", "MFCC (THERAPIST)",
    "NON-CONTRACT UNKWN BILL AREA", "NURSE PRACTITIONER", "NURSING FACILITY - OTHER", "OPTICIAN",
    "PEDS-DEVELOPMENTAL BEHAVIORAL", "PSYCHIATRY", "PSYCHOLOGY", "SENIOR WELLNESS VISIT",
    "SPORTS MEDICINE", "SURGERY - ORAL", "AMBULATORY SURGICAL CENTER", "AMBULANCE",
    "CUSTODIAL CARE", "HOME HEALTH", "INFERTILITY", "OPTOMETRY", "PALLIATIVE CARE", "SLEEP STUDY",
    "SNF - FAC", "OCCUPATIONAL THERAPY", "NUCLEAR MEDICINE", "PATHOLOGY", "PHARMACY",
    "SURGERY - HAND",
)
# the first pipeline generation also pends this one
HARD_PEND_SPECIALTIES_A = HARD_PEND_SPECIALTIES + ("FACILITY SERVICES",)

PEND_REFERRAL_TYPES = (
    "INPT ADM", "EMERGENCY ROOM", "DAY SURG", "OOA INPT", "SKILLED NURSING", "OBSERVATION",
    "OB OBSERVATION",
)

# --- reasons --------------------------------------------------------------------

EXPECTED_REASONS = (
    "Pend EPL", "Pend Specialty", "Low Volume", "Heavy Cap Vol", "Medical Necessity Review",
    "Needs Review", "Override Pend", "Upcoding", "Cost Containment", "Overutilization Concern",
    "Inappropriate Location", "RNL", "Unclassified Drug", "Sub-Spec Addition",
)
REASON_CATEGORIES = {
    "M": ("Heavy Cap Vol", "Overutilization Concern", "Upcoding"),
    "do not AA": (
        "Cost Containment", "Inappropriate Location", "Medical Necessity Review", "RNL",
        "Unclassified Drug", "Pend Specialty", "Pend EPL", "Low Volume",
    ),
    "AA": ("Override Pend", "DBA"),
}
REASON_CATEGORY_DEFAULT = "0"

# --- model evaluation -----------------------------------------------------------

DEFAULT_PROVIDER_STATUS = "EPL CONTRACTED"
IN_NETWORK_PROVIDER_STATUSES = ("PPL CONTRACTED", "PPL CAPITATED", "PPL EMPLOYED")
OUT_OF_NETWORK_PROVIDER_STATUSES = (
    "UNASSIGNED", "EPL CONTRACTED", "EPL CAPITATED", "NLL CONTRACTED", "NLL CAPITATED",
    "EPL EMPLOYED", "NLL EMPLOYED", "EPL MEDI MEDI", "EPL PLAN CONTRACTED", "NLL PLAN CONTRACTED",
)
PREDICTED_SPECIALTY_CLEANUP = {
    "OPHTHALMOLOGY - RETINAL": "OPHTHALMOLOGY",
    "SLEEP MEDICINE": "PULMONARY DISEASE",
    "ANTI-COAGULATION CLINIC (ACC)": "PHARMACY",
}
HUMAN_APPROVED = "APPROVED"
HUMAN_CANCELLED = "CANCEL"
DEFAULT_REFERRAL_COST = 150.0
DECILES = 10

# --- quality checks ---------------------------------------------------------------

FRESH_DAYS = 90
FRESH_DAYS_QUARTERLY = 20
SPAN_DAYS = (360, 370)
SPAN_DAYS_QUARTERLY = (180, 190)
COST_TOLERANCE = 0.05

# --- rule export ------------------------------------------------------------------

CARE_PROGRAM_SPECIALTY = (
    "COMPREHENSIVE CARE PROGRAM - AMBULATORY CARE MGT, COMPREHENSIVE CARE PROGRAM - CHF, "
    "COMPREHENSIVE CARE PROGRAM - COMPREHEN CARE CENTER, COMPREHENSIVE CARE PROGRAM - ESRD/CKD, "
    "COMPREHENSIVE CARE PROGRAM - PALLIATIVE CARE, COMPREHENSIVE CARE PROGRAM - SOCIAL WORK, "
    "COMPREHENSIVE CARE PROGRAM -COPD, COMPREHENSIVE CARE PROGRAM -HOUSE CALLS"
)
ALL = "All"
SENIOR_SUFFIX = "_senior"
NOT_SENIOR_SUFFIX = "_not_sen"
SENIOR_LOB = "SENIOR"
UMBRELLA_SPECIALTIES = {
    "RADIOLOGY": (
        "RADIOLOGY, CT - CAT SCANS, MAMMOGRAMS, MRI - MAGNETIC RESONANCE IMAGING, BONE DENSITY SCANS"
    ),
    "CARDIOLOGY": "CARDIOLOGY, CARDIAC TESTING",
}
RULE_EFFECTIVE_DATE = "2019-06-15"
RULE_PROVIDER_STATUS = "PPL"

# --- report headers ----------------------------------------------------------------

SPECIALTY_SUMMARY_HEADER = {
    "specialty": "Specialty",
    "ref_vol": "volume",
    "new_rate": "new rate",
    "old_rate": "old_rate",
    "num_codes": "# codes in dictionary",
    "deny_now_aa": "false positives",
    "cost_to_review_bene": "cost to review, benefit",
    "cost_to_review_loss": "cost to review, loss",
    "dollars_denied_now_app": "dollars denied, now approved",
    "new_denial_bene_est": "new denials, benefit (est)",
    "net_benefit": "new benefit",
    "net_benefit_w_new_den": "net benefit, est",
}
CODE_RATE_HEADER = {
    "specialty": "Specialty",
    "cpt_code": "CPT Code",
    "is_ppl": "PPL?",
    "new_rate": "new rate",
}
CODE_DETAIL_HEADER = {
    "specialty": "Specialty",
    "cpt_code": "CPT Code",
    "is_ppl": "PPL?",
    "units": "volume",
    "auto_rate": "old rate",
    "denial_rate": "denial rate",
    "units_man": "volume, reviewed",
    "cost_to_review": "cost to review",
    "avg_hcp_cost": "avg. cost",
    "sum_cost_denied": "denied dollars",
    "roi": "ROI",
    "fin_aa_rec": "decision by ROI",
    "dec_source": "decision source",
    "overrule_rsn": "clinical reason",
    "final_decision": "final decision",
    "new_rate": "new rate",
    "cpt_desc": "CPT desc",
}
