"""One row per stay, and evidence beside it."""

from pyspark.sql import DataFrame, functions as F

from clinfeat.codes.values import EVIDENCE_PATTERN, INFECTION_PREFIXES
from clinfeat.functions.text import has_prefix, yes_no
from clinfeat.functions.time import age_years, days_between
from clinfeat.operators.ordered import dense_rank_by_time


def primary_codes(diag: DataFrame) -> DataFrame:
    return diag.filter(F.col("seq_num") == 1).select("enc_id", "code")


def encounter_info(adm: DataFrame, pat: DataFrame, diag: DataFrame) -> DataFrame:
    """Stays with length of stay, age, sequence within the subject and primary code.

    The sequence counts only stays left after the inner joins.
    """
    joined = (
        adm.join(primary_codes(diag), "enc_id")
        .join(pat.select("subj_id", "gender", "dob"), "subj_id")
    )
    # wide decimals are added after the last shuffle
    ranked = dense_rank_by_time(joined, "subj_id", "start_ts", "hospstay_seq")
    return ranked.select(
        *[c for c in joined.columns if c != "dob"], days_between(F.col("end_ts"), F.col("start_ts")).alias("los_hospital"),
        age_years(F.col("start_ts"), F.col("dob")).alias("age"), "hospstay_seq", yes_no(F.col("hospstay_seq") == 1).alias("first_hosp_stay"),
    )


def code_cohort(diag: DataFrame, adm: DataFrame, prefixes=INFECTION_PREFIXES) -> DataFrame:
    """Stays whose primary code starts with a listed prefix; a code without its stay is kept."""
    coded = diag.filter((has_prefix(F.col("code"), prefixes) == 1) & (F.col("seq_num") == 1))
    return coded.select("enc_id", "code").join(
        adm.withColumnRenamed("enc_id", "_enc"), F.col("enc_id") == F.col("_enc"), "left"
    ).withColumn("enc_id", F.col("_enc")).drop("_enc")


def stays_with_primary_code(adm: DataFrame, diag: DataFrame) -> DataFrame:
    """All stays, with the primary code where there is one."""
    return adm.join(primary_codes(diag), "enc_id", "left")


def lab_evidence_lag(micro: DataFrame, info: DataFrame, pattern=EVIDENCE_PATTERN) -> DataFrame:
    """Lab evidence of known stays, with lag and length of stay in days."""
    return (
        micro.filter(F.col("org_name").ilike(pattern))
        .select("enc_id", "org_name", "ts")
        .join(info.select("enc_id", "start_ts", "end_ts", "expire"), "enc_id")
        .withColumn("lag_days", days_between(F.col("ts"), F.col("start_ts")))
        .withColumn("los", days_between(F.col("end_ts"), F.col("start_ts")))
    )


def events_with_names(adm: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """Every stay with its events and their item names; stays without events stay in."""
    return adm.select("enc_id", "subj_id", "start_ts", "expire").join(
        events.select("enc_id", "item_id", "ts", "value"), "enc_id", "left"
    ).join(items.select("item_id", "label"), "item_id", "left")


def with_suffixes(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str],
                  how: str = "left") -> DataFrame:
    """Join that renames columns found on both sides."""
    both = (set(left.columns) & set(right.columns)) - {on}
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, on, how)
