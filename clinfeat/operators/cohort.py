"""Outcome evidence, sessions of close stays, and the cohort rules."""

from pyspark.sql import DataFrame, functions as F

from clinfeat.codes.values import EVIDENCE_PATTERN, FOLLOW_ON_GAP_DAYS, OUTCOME_CODE
from clinfeat.functions.time import days_between, days_exact
from clinfeat.operators.ordered import running_sum_by_number



def full_join_on_stay(coded: DataFrame, lab: DataFrame, coalesce_ids: bool = False) -> DataFrame:
    """Full outer join of coded and lab evidence by stay, keeping the coded side's ids only.

    Written as two joins: lab rows with their codes, and codes without lab rows. Spark can split a
    stay with very many lab rows in a left join, but not in a full join.
    """
    c = coded.select("subj_id", "enc_id", "code", "seq_num")
    rows = lab.select(F.col("subj_id").alias("_subj"), F.col("enc_id").alias("_enc"), "org_name", "ts")
    with_lab = rows.join(c, F.col("_enc") == F.col("enc_id"), "left")
    if coalesce_ids:
        with_lab = with_lab.withColumns({
            "subj_id": F.coalesce("subj_id", "_subj"), "enc_id": F.coalesce("enc_id", "_enc"),
        })
    seen = rows.select("_enc").distinct()
    without_lab = c.join(seen, F.col("enc_id") == F.col("_enc"), "left_anti")
    return without_lab.unionByName(with_lab.drop("_subj", "_enc"), allowMissingColumns=True)


def evidence(diag: DataFrame, micro: DataFrame, info: DataFrame, code_is=None,
             pattern: str = EVIDENCE_PATTERN, coalesce_ids: bool = False) -> DataFrame:
    """Coded and lab evidence of the outcome, with the stay and the lag in days.

    Lab-only rows have no stay id (and so never set the outcome) unless ``coalesce_ids``.
    """
    is_outcome = (F.col("code") == OUTCOME_CODE) if code_is is None else code_is
    coded = diag.filter(is_outcome)
    lab = micro.filter(F.col("org_name").ilike(pattern) & F.col("subj_id").isNotNull())
    both = full_join_on_stay(coded, lab, coalesce_ids)
    stays = info.select(
        F.col("enc_id").alias("_enc"), "start_ts", "hospstay_seq", F.col("code").alias("primary_code")
    )
    return both.join(stays, F.col("enc_id") == F.col("_enc"), "left").select(
        "subj_id", "enc_id", "start_ts", "hospstay_seq", "primary_code", "code",
        F.col("seq_num").alias("code_seq"), "org_name", "ts",
        days_between(F.col("ts"), F.col("start_ts")).alias("chart_timelag"),
    )


def outcome_flag(info: DataFrame, found: DataFrame) -> DataFrame:
    """Does any evidence carry the id of the stay?"""
    ids = found.select("enc_id").distinct().withColumn("_hit", F.lit(True))
    return info.select("subj_id", "enc_id").join(ids, "enc_id", "left").select(
        "subj_id", "enc_id", F.col("_hit").isNotNull().alias("outcome")
    )


def coded_outcome(info: DataFrame, diag: DataFrame, micro: DataFrame | None = None, code_is=None,
                  pattern: str = EVIDENCE_PATTERN) -> DataFrame:
    """``outcome_flag`` from ids alone, without the rows of the evidence: stays with the outcome's code.

    With ``micro`` lab evidence counts too, as it does where the evidence takes the lab side's ids.
    """
    is_outcome = (F.col("code") == OUTCOME_CODE) if code_is is None else code_is
    ids = diag.filter(is_outcome).select("enc_id")
    if micro is not None:
        ids = ids.union(micro.filter(F.col("org_name").ilike(pattern) & F.col("subj_id").isNotNull()).select("enc_id"))
    return outcome_flag(info, ids)


def stay_gaps(info: DataFrame) -> DataFrame:
    """Days from the end of the first stay of the previous sequence number; NULL for the first.

    The sequence number is dense, so the previous stay is an equality join, not a window.
    """
    ends = info.groupBy("subj_id", (F.col("hospstay_seq") + 1).alias("hospstay_seq")).agg(
        F.min_by("end_ts", "enc_id").alias("_previous_end")
    )
    return info.select("subj_id", "enc_id", "hospstay_seq", "start_ts", "end_ts").join(
        ends, ["subj_id", "hospstay_seq"], "left"
    ).select(
        "subj_id", "enc_id", "hospstay_seq", "start_ts", "end_ts",
        days_exact(F.col("start_ts"), F.col("_previous_end")).alias("gap_days"),
    )


def session_members(info: DataFrame, gap: float = FOLLOW_ON_GAP_DAYS) -> DataFrame:
    """Every stay with the number of its session: a gap of ``gap`` days or more starts a new one.

    So does an unknown gap, after a stay without an end. Stays with the same start share a sequence
    number, and so a session.
    """
    follows = (F.col("hospstay_seq") == 1) | (F.col("gap_days") < gap)
    steps = stay_gaps(info).groupBy("subj_id", "hospstay_seq").agg(
        F.max(F.when(follows, 0).otherwise(1)).alias("_new")
    )
    numbered = running_sum_by_number(steps, "subj_id", "hospstay_seq", "_new", "session")
    return info.select(
        "subj_id", "enc_id", "hospstay_seq", "start_ts", "end_ts", "los_hospital", "code"
    ).join(numbered.drop("_new"), ["subj_id", "hospstay_seq"])


def session_totals(members: DataFrame) -> DataFrame:
    """Roll-up of sessions with more than one stay; the first stay has the lowest sequence number."""
    return (
        members.groupBy("subj_id", "session")
        .agg(
            F.min(F.struct("hospstay_seq", "enc_id")).alias("_first"),
            F.count("*").alias("num_stays"),
            F.sum("los_hospital").alias("cumulative_los"),
            F.min("start_ts").alias("first_admit"),
            F.max("end_ts").alias("last_disch"),
        )
        .filter(F.col("num_stays") > 1)
        .select(
            "subj_id", "session", F.col("_first.hospstay_seq").alias("first_seq"),
            F.col("_first.enc_id").alias("first_enc_id"),
            "num_stays", "cumulative_los", "first_admit", "last_disch",
        )
    )


def session_stays(members: DataFrame) -> DataFrame:
    """The stays of sessions with more than one, a row each: the form for any size."""
    totals = session_totals(members).select("subj_id", "session")
    return members.select("subj_id", "session", "hospstay_seq", "start_ts", "enc_id", "code").join(
        totals, ["subj_id", "session"]
    )


def multistay(members: DataFrame) -> DataFrame:
    """Sessions with more than one stay, a row each, with the ids and codes of their stays in order.

    An export of ``session_totals`` and ``session_stays``: a list is as long as its session.
    """
    keys = ["subj_id", "session"]
    stay = F.struct("hospstay_seq", "start_ts", "enc_id", "code")
    lists = session_stays(members).groupBy(*keys).agg(F.sort_array(F.collect_list(stay)).alias("_stays"))
    listed = session_totals(members).join(lists, keys)
    enc_ids = F.transform("_stays", lambda s: s["enc_id"])
    return listed.select(
        "subj_id", "session", "first_enc_id",
        enc_ids.alias("combined_enc_id"),
        F.filter(enc_ids, lambda e: e != F.col("first_enc_id")).alias("other_enc_id"),
        F.transform("_stays", lambda s: s["code"]).alias("codes"),
        "num_stays", "cumulative_los", "first_admit", "last_disch",
    )


def merge_close_stays(outcomes: DataFrame, members: DataFrame) -> DataFrame:
    """Keep the first stay of each session, with the highest outcome of the session's stays.

    A session whose first stay is not among the outcomes is lost. Works on one row per stay; the
    lists of ``multistay`` are not needed.
    """
    totals = session_totals(members).select("subj_id", "session", "first_enc_id")
    in_session = members.select("subj_id", "session", "enc_id").join(totals, ["subj_id", "session"])
    lifted = in_session.join(outcomes.select("enc_id", "outcome"), "enc_id").groupBy(
        F.col("first_enc_id").alias("enc_id")
    ).agg(F.bool_or("outcome").alias("_session_outcome"))
    later = in_session.filter(F.col("enc_id") != F.col("first_enc_id")).select("enc_id")
    return (
        outcomes.select("enc_id", "outcome")
        .join(later, "enc_id", "left_anti")
        .join(lifted, "enc_id", "left")
        .select("enc_id", (F.col("outcome") | F.coalesce("_session_outcome", F.lit(False))).alias("outcome"))
    )


def keep_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("enc_id"), "enc_id", "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("enc_id"), "enc_id", "left_anti")


def adults_only(outcomes: DataFrame, info: DataFrame, min_age: float = 18) -> DataFrame:
    return keep_ids(outcomes, info.filter(F.col("age") >= min_age))


def drop_primary_code(outcomes: DataFrame, info: DataFrame, code_is=None) -> DataFrame:
    """Without stays that were admitted for the outcome itself."""
    is_outcome = (F.col("code") == OUTCOME_CODE) if code_is is None else code_is
    return drop_ids(outcomes, info.filter(is_outcome))


def long_stays(outcomes: DataFrame, info: DataFrame, min_days: float = 3) -> DataFrame:
    facts = info.select("enc_id", "expire", "los_hospital")
    return outcomes.join(facts, "enc_id").filter(F.col("los_hospital") >= min_days)


def survivors_only(outcomes: DataFrame, info: DataFrame) -> DataFrame:
    alive = info.filter(F.col("expire") == 0).select("enc_id")
    return outcomes.join(alive, "enc_id")


def member_flag(df: DataFrame, ids: DataFrame, out: str) -> DataFrame:
    """0/1: is the id of the row in the other table?"""
    hits = ids.select("enc_id").distinct().withColumn("_hit", F.lit(1))
    return df.join(hits, "enc_id", "left").withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")


def event_rate(df: DataFrame, group: str, flag: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(flag).alias("rate"), F.count("*").alias("n"))
