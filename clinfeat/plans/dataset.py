"""End-to-end plans: source tables to dataset, dataset to model input."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from clinfeat.codes.drugs import DRUG_SPELLINGS, UNNAMED_SPELLINGS
from clinfeat.codes.values import (
    DRUG_FEATURES, EVIDENCE_PATTERN, HEIGHT_ITEMS, LAB_ITEMS, MODEL_FEATURES, OUTCOME_CODE, SEED,
    VITAL_ITEMS, WEIGHT_ITEMS,
)
from clinfeat.operators import cohort, encounters, features, measures, meds, prep
from clinfeat.sources.stages import materialize


@dataclass
class Sources:
    admissions: DataFrame
    patients: DataFrame
    diagnoses: DataFrame
    labs: DataFrame
    charts: DataFrame
    prescriptions: DataFrame
    micro: DataFrame


@dataclass
class Codes:
    labs: list = field(default_factory=lambda: LAB_ITEMS)
    vitals: list = field(default_factory=lambda: VITAL_ITEMS)
    weights: list = field(default_factory=lambda: WEIGHT_ITEMS)
    heights: list = field(default_factory=lambda: HEIGHT_ITEMS)
    spellings: dict = field(default_factory=lambda: DRUG_SPELLINGS)
    unnamed: list = field(default_factory=lambda: UNNAMED_SPELLINGS)
    pattern: str = EVIDENCE_PATTERN
    code_is: Column | None = None

    def outcome_code(self) -> Column:
        return F.col("code") == OUTCOME_CODE if self.code_is is None else self.code_is


def stay_info(src: Sources, staged: bool = False) -> DataFrame:
    """``encounter_info``; staged when a plan reads it several times."""
    info = encounters.encounter_info(src.admissions, src.patients, src.diagnoses)
    return materialize(info, "encounter_info") if staged else info


def all_outcomes(src: Sources, codes: Codes, info: DataFrame) -> DataFrame:
    return cohort.coded_outcome(info, src.diagnoses, code_is=codes.outcome_code())


def joined_features(src: Sources, codes: Codes, info: DataFrame) -> DataFrame:
    """Labs and vitals with weight, height, age and gender, one row per stay that has both.

    The chart table, the largest of all, is read once for vitals, weight and height.
    """
    charts = measures.first_charts(
        src.charts, src.admissions, codes.vitals, codes.weights, codes.heights
    )
    labs = measures.first_labs(src.labs, src.admissions, codes.labs)
    both = features.numeric_features(charts, labs)  # still partitioned by stay; the later joins by id alone share one more shuffle
    return features.with_stay_facts(both, info).select(*both.columns, "start_ts", "age", "gender")


def sessions(info: DataFrame) -> DataFrame:
    """``session_members``, staged: its users read it two or three times."""
    return materialize(cohort.session_members(info), "session_members")


def cohort_outcomes(src: Sources, codes: Codes, info: DataFrame) -> DataFrame:
    """Outcomes of treated stays: close stays merged, adults only, not admitted for the outcome."""
    scoped = meds.prescriptions_in_scope(src.prescriptions, info.select("subj_id", "enc_id"),
                                         codes.spellings, codes.unnamed)
    treated = materialize(meds.treated_stays(all_outcomes(src, codes, info), scoped), "treated_outcomes")
    merged = cohort.merge_close_stays(treated, sessions(info))
    adults = cohort.adults_only(merged, info)
    return cohort.drop_primary_code(adults, info, codes.outcome_code())


def build_dataset(src: Sources, codes: Codes | None = None, info: DataFrame | None = None) -> DataFrame:
    """The labelled dataset: derived features, one-hot demographics and outcome per stay."""
    codes = codes or Codes()
    info = stay_info(src, staged=True) if info is None else info
    numeric = features.derive_features(joined_features(src, codes, info))
    demographics = features.onehot_demographics(info)
    return features.labelled_dataset(numeric, demographics, cohort_outcomes(src, codes, info))


def drug_features(src: Sources, codes: Codes, dataset: DataFrame, info: DataFrame) -> DataFrame:
    """Drug group flags of the dataset's stays, from prescriptions of the first two days."""
    named = meds.normalised_prescriptions(src.prescriptions, info, codes.spellings, codes.unnamed)
    early = meds.early(meds.classified_prescriptions(named))
    return meds.multi_hot_drugs(dataset.select("enc_id", "outcome"), early)


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list
    scaler: prep.Scaler | None


def prepare(dataset: DataFrame, columns=MODEL_FEATURES, drugs: DataFrame | None = None,
            only_drugs: bool = False, four_classes: bool = False, under: bool = True,
            strategy: str = "median", seed: int = SEED) -> Prepared:
    """Select, balance, join drug flags, split, scale and impute.

    Scaling comes before imputation and the id is not a feature, so no single column rules the
    distance; both are fitted on the training rows only. ``strategy`` is "median" or "nearest".
    """
    if strategy not in ("nearest", "median"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if only_drugs:
        chosen, used = prep.select_drug_features(drugs), list(DRUG_FEATURES)
    else:
        chosen, used = prep.select_features(dataset, columns), list(columns)
        if four_classes:
            chosen = prep.with_death_classes(chosen)
        chosen = chosen.drop("expire")
    # balancing and the split read their rows four times each: staged in between, or the dataset would be read sixteen times
    balanced = materialize(prep.balance(chosen, "outcome", "enc_id", seed, under), "balanced")
    if drugs is not None and not only_drugs:
        balanced = balanced.join(
            prep.select_drug_features(drugs).withColumn("outcome", F.col("outcome").cast("int")),
            ["enc_id", "outcome"],
        )
        used += DRUG_FEATURES
    # read by the split, the scaler, the imputation and the fits: staged once
    split = materialize(prep.stratified_split(balanced, seed=seed), "prepared")
    train = split.filter(~F.col("is_test")).drop("is_test")
    test = split.filter(F.col("is_test")).drop("is_test")
    if only_drugs:
        return Prepared(train, test, used, None)
    scaler = prep.fit_scaler(train, used)
    scaled_train, scaled_test = prep.apply_scaler(train, scaler), prep.apply_scaler(test, scaler)
    middle = prep.medians(scaled_train, used)
    if strategy == "nearest":
        scaled_test = prep.impute_nearest(scaled_test, used, donors=scaled_train)
        scaled_train = prep.impute_nearest(scaled_train, used)
    # also covers cells without any usable neighbour; a column without any value becomes 0, its mean
    fill = {c: middle.get(c) or 0.0 for c in used}
    return Prepared(
        materialize(prep.impute_constants(scaled_train, fill), "train"),
        materialize(prep.impute_constants(scaled_test, fill), "test"),
        used, scaler,
    )
