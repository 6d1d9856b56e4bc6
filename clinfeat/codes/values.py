"""Fixed code lists and limits of the hospital schema."""

from typing import NamedTuple, Optional


class LabItem(NamedTuple):
    item_id: int
    label: str
    hi: float


class VitalItem(NamedTuple):
    item_id: int
    category: str
    lo: Optional[float]
    hi: Optional[float]
    hi_closed: bool = False
    fahrenheit: bool = False


class UnitItem(NamedTuple):
    item_id: int
    factor: float


# Label, item ids, highest plausible value.
LAB_LABELS = [
    ("ANION GAP", [50868], 10000),
    ("ALBUMIN", [50862], 10),
    ("BANDS", [51144], 100),
    ("BICARBONATE", [50882], 10000),
    ("BILIRUBIN", [50885], 150),
    ("CREATININE", [50912], 150),
    ("CHLORIDE", [50806, 50902], 10000),
    ("GLUCOSE", [50809, 50931], 10000),
    ("HEMATOCRIT", [50810, 51221], 100),
    ("HEMOGLOBIN", [50811, 51222], 50),
    ("LACTATE", [50813], 50),
    ("PLATELET", [51265], 10000),
    ("POTASSIUM", [50822, 50971], 30),
    ("PTT", [51275], 150),
    ("INR", [51237], 50),
    ("PT", [51274], 150),
    ("SODIUM", [50824, 50983], 200),
    ("BUN", [51006], 300),
    ("WBC", [51300, 51301], 1000),
]

# Category, item ids, open lower bound, upper bound, upper bound included, Fahrenheit.
VITAL_CATEGORIES = [
    ("heartrate", [211, 220045], 0, 300, False, False),
    ("sysbp", [51, 442, 455, 6701, 220179, 220050], 0, 400, False, False),
    ("diasbp", [8368, 8440, 8441, 8555, 220180, 220051], 0, 300, False, False),
    ("meanbp", [456, 52, 6702, 443, 220052, 220181, 225312], 0, 300, False, False),
    ("resprate", [615, 618, 220210, 224690], 0, 70, False, False),
    ("tempc", [223761, 678], 70, 120, False, True),
    ("tempc", [223762, 676], 10, 50, False, False),
    ("spo2", [646, 220277], 0, 100, True, False),
    ("glucose", [807, 811, 1529, 3745, 3744, 225664, 220621, 226537], 0, None, False, False),
]

# Item id, factor to kilograms.
WEIGHT_ITEMS = [
    UnitItem(762, 1.0), UnitItem(763, 1.0), UnitItem(3723, 1.0), UnitItem(3580, 1.0),
    UnitItem(226512, 1.0), UnitItem(3581, 0.45359237), UnitItem(3582, 0.0283495231),
]

# Item id, factor to centimetres.
HEIGHT_ITEMS = [
    UnitItem(920, 2.54), UnitItem(1394, 2.54), UnitItem(4187, 2.54), UnitItem(3486, 2.54),
    UnitItem(226707, 2.54), UnitItem(3485, 1.0), UnitItem(4188, 1.0),
]

LAB_ITEMS = [LabItem(i, label, float(hi)) for label, ids, hi in LAB_LABELS for i in ids]

VITAL_ITEMS = [
    VitalItem(i, cat, lo, hi, closed, fahrenheit)
    for cat, ids, lo, hi, closed, fahrenheit in VITAL_CATEGORIES
    for i in ids
]

# Code of the outcome, and the text that marks lab evidence of it.
OUTCOME_CODE = "00845"
EVIDENCE_PATTERN = "%DIFF%"

# Code prefixes of bacterial and fungal infection, by prefix length.
INFECTION_PREFIXES = {
    3: """
        001 002 003 004 005 008 009 010 011 012 013 014 015 016 017 018 020 021 022 023 024 025
        026 027 030 031 032 033 034 035 036 037 038 039 040 041 090 091 092 093 094 095 096 097
        098 100 101 102 103 104 110 111 112 114 115 116 117 118 320 322 324 325 420 421 451 461
        462 463 464 465 481 482 485 486 494 510 513 540 541 542 566 567 590 597 601 614 615 616
        681 682 683 686 730
    """.split(),
    4: "5695 5720 5721 5750 5990 7110 7907 9966 9985 9993".split(),
    5: "49121 56201 56203 56211 56213 56983".split(),
}

# Drug groups used as features, and those folded into "Other".
DRUG_FEATURES = [
    "Aminoglycoside", "Antifungal", "Carbapenem", "Cephalosporin", "Combination",
    "Fluoroquinolone", "Glycopeptide", "Lincosamide", "Macrolide", "Metronidazole", "None",
    "Other", "Penicillin BS", "Sulfonamide",
]
FOLDED_GROUPS = ["Penicillin NS", "Polypeptide", "Rifamycin", "TB-specific", "Tetracycline", "Other"]
DRUG_GROUPS = sorted(set(DRUG_FEATURES + FOLDED_GROUPS + ["Macrocycle"]) - {"None"})

# Drug names (not classes) with a level of their own in the corrected association.
ASSOCIATION_BY_NAME = {
    "Aztreonam": "High",
    "Clindamycin": "High",
    "Fidaxomicin": "Treatment",
    "Dapsone": "Unknown",
    "Daptomycin": "Unknown",
    "Ethambutol": "Unknown",
    "Fosfomycin Tromethamine": "Unknown",
    "Linezolid": "Unknown",
    "Mupirocin": "Unknown",
    "Quinupristin-Dalfopristin": "Unknown",
    "Rifaximin": "Unknown",
}

# Condensing of free categories, applied in this order to every text column.
CONDENSE_PATTERNS = [
    ("ASIAN.*", "ASIAN"),
    ("BLACK.*", "BLACK"),
    ("HISPANIC.*", "HISPANIC"),
    ("AMERICAN.*", "AMERICAN INDIAN"),
    ("WHITE.*", "WHITE"),
    ("PORTUGUESE", "WHITE"),
]
UNKNOWN_CATEGORIES = ["UNKNOWN/NOT SPECIFIED", "OTHER", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER"]
CONDENSE_TAIL = [(".*REFERRAL.*", "REFERRAL"), (".*TRANSFER.*", "TRANSFER")]

# Categories that become 0/1 columns, per text column.
ONEHOT_CATEGORIES = {
    "admission_type": ["ELECTIVE", "EMERGENCY"],
    "admission_location": ["EMERGENCY ROOM ADMIT", "REFERRAL", "TRANSFER"],
    "ethnicity": ["WHITE", "BLACK"],
    "insurance": ["Medicaid", "Medicare", "Private"],
    "marital_status": ["DIVORCED", "MARRIED", "SINGLE", "WIDOWED"],
}
ONEHOT_FEATURES = [f"{col}_{cat}" for col, cats in ONEHOT_CATEGORIES.items() for cat in cats]

# Derived numeric columns.
SQUARED = {"albumin": "albumin_2"}
CUBED = {"spo2_mean": "spo2_mean_3"}
LOGGED = ["bands", "bilirubin", "bun", "creatinine", "glucose", "lactate", "inr", "wbc"]

# Numeric features of the model.
NUMERIC_FEATURES = [
    "aniongap", "albumin", "log_bands", "bicarbonate", "log_bilirubin", "log_bun",
    "log_creatinine", "chloride", "log_glucose", "hemoglobin", "log_lactate", "platelet",
    "potassium", "log_inr", "sodium", "log_wbc", "heartrate_mean", "sysbp_mean", "diasbp_mean",
    "meanbp_mean", "resprate_mean", "tempc_mean", "spo2_mean_3", "weight", "bmi", "age", "gender",
    "rescaled_time", "am_admit",
]
MODEL_FEATURES = NUMERIC_FEATURES + ONEHOT_FEATURES

# Right-closed age bands (upper bound, label); at or below -300 and above 100 no band.
AGE_FLOOR = -300
AGE_BANDS = [
    (0, "exclude"), (18, "youth"), (40, "18-39"), (50, "40-49"), (60, "50-59"),
    (70, "60-69"), (80, "70-79"), (90, "80-89"), (100, ">89"),
]

DAYS_PER_YEAR = 365.242          # age at admission
DAYS_PER_YEAR_AT_DEATH = 365.2425
FOLLOW_ON_GAP_DAYS = 91
SEED = 42

#: Coefficients of the inverse normal distribution (M. J. Wichura, algorithm AS 241, 1988), highest power first:
#: (numerator, denominator) near the middle, in the tails and far out.
NORMAL_QUANTILE = {
    "central": (
        (2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987,
         13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665),
        (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597,
         5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0),
    ),
    "near": (
        (0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684,
         3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835),
        (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008,
         0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0),
    ),
    "far": (
        (2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124,
         0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103),
        (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133,
         0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0),
    ),
}
