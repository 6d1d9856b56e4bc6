"""The same queries as plain SQL for the check engine.

Written from the meaning of each query, with ordinary windows and self-joins where the library uses
slices, so the two are independent.
"""

from clinfeat.codes.drugs import DRUG_CLASSES
from clinfeat.codes.values import (
    NORMAL_QUANTILE,
    AGE_BANDS, DRUG_FEATURES, DRUG_GROUPS, FOLDED_GROUPS, INFECTION_PREFIXES, ONEHOT_CATEGORIES,
    ONEHOT_FEATURES,
)
from clinfeat.operators.measures import lab_labels, vital_names
from clinfeat.plans.catalogue import TEST_FEATURES, TEST_NUMERIC, WEEKDAYS
from clinfeat.sources.retail import (
    DUCKDB, TEST_CODE_PREFIX, TEST_DICTIONARY, TEST_HEIGHTS, TEST_LABS, TEST_PATTERN, TEST_SPELLINGS, TEST_UNNAMED,
    TEST_VITALS, TEST_WEIGHTS, Retail, view_texts,
)

ORACLES = {}
LABS = lab_labels(TEST_LABS)
VITALS = vital_names(TEST_VITALS)


def lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def values(rows, names):
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({', '.join(names)})"


def seconds(a, b):
    return f"(epoch_us({a}) - epoch_us({b})) / 1000000.0"


def days4(a, b):
    return f"cast(round(cast({seconds(a, b)} / 86400.0 AS decimal(30,12)), 4) AS double)"


def r(expr, alias, digits=6):
    return f"round(cast({expr} AS double), {digits}) AS {alias}"


def hours(a, b):
    return f"({seconds(a, b)} / 3600.0)"


CLOCK = "(extract(hour FROM {0}) + extract(minute FROM {0}) / 60.0)"

LAB_COLUMNS = ", ".join(f"min(CASE WHEN label = '{n}' THEN value END) AS {n}" for n in LABS)


def vital_columns(digits=6):
    out = []
    for n in VITALS:
        for suffix, fn in (("min", "min"), ("max", "max"), ("mean", "avg")):
            out.append(f"{fn}(CASE WHEN category = '{n}' THEN value END) AS {n}_{suffix}")
    return ", ".join(out)


VITAL_NAMES = [f"{n}_{s}" for n in VITALS for s in ("min", "max", "mean")]


def rounded_list(names, digits=6):
    return ", ".join(f'round(cast("{n}" AS double), {digits}) AS "{n}"' for n in names)


def prefixes():
    return " OR ".join(
        f"substring(code, 1, {n}) IN ({', '.join(lit(c) for c in codes)})"
        for n, codes in INFECTION_PREFIXES.items()
    )


def unit(items, out):
    return f"""
        SELECT enc_id, subj_id,
          cast(round(cast(value * factor AS decimal(30,12)), 2) AS double) AS {out}, ts
        FROM (SELECT m.*, factor, row_number() OVER (PARTITION BY subj_id, enc_id ORDER BY ts, value * factor, m.item_id) AS n
              FROM meas m JOIN ({values(items, ['item_id', 'factor'])}) u ON m.item_id = u.item_id
              WHERE value IS NOT NULL AND value <> 0 AND error IS DISTINCT FROM 1)
        WHERE n = 1"""


CODED = f"starts_with(code, '{TEST_CODE_PREFIX}')"
SPELLED = [(raw, name) for name, raws in TEST_SPELLINGS.items() for raw in raws]
SCOPE = ", ".join(lit(d) for d in [raw for raw, _ in SPELLED] + TEST_UNNAMED)


def condensed(c):
    for pattern, to in (("ASIAN.*", "ASIAN"), ("BLACK.*", "BLACK"), ("HISPANIC.*", "HISPANIC"),
                        ("AMERICAN.*", "AMERICAN INDIAN"), ("WHITE.*", "WHITE"), ("PORTUGUESE", "WHITE")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    c = (f"CASE WHEN {c} IN ('UNKNOWN/NOT SPECIFIED', 'OTHER', 'UNABLE TO OBTAIN', "
         f"'PATIENT DECLINED TO ANSWER') THEN 'UNKNOWN' ELSE {c} END")
    for word in ("REFERRAL", "TRANSFER"):
        c = f"regexp_replace({c}, '.*{word}.*', '{word}', 'g')"
    return c


def onehots():
    return ", ".join(
        f"""CASE WHEN {c} = '{cat}' THEN 1 ELSE 0 END AS "{c}_{cat}" """
        for c, cats in ONEHOT_CATEGORIES.items() for cat in cats
    )


BASE = {t: t for t in Retail.names}
VIEWS = {name: ([], text.format(**BASE)) for name, text in view_texts(DUCKDB).items()}
VIEWS |= {
    "lab_dict": ([], values([(i.item_id, i.label.lower(), i.hi) for i in TEST_LABS], ["item_id", "label", "hi"])),
    "vital_dict": ([], values([tuple(i) for i in TEST_VITALS],
                              ["item_id", "cat", "lo", "hi", "closed", "f"])),
    "lab_rows": (["meas", "lab_dict"], """
        SELECT subj_id, enc_id, m.item_id, ts, label, CASE WHEN value > hi THEN NULL ELSE value END AS value
        FROM meas m JOIN lab_dict d ON m.item_id = d.item_id
        WHERE value IS NOT NULL AND value > 0"""),
    "vital_rows": (["meas", "vital_dict"], """
        SELECT subj_id, enc_id, m.item_id, ts,
          CASE WHEN (lo IS NULL OR value > lo) AND (hi IS NULL OR value < hi OR (closed AND value = hi))
               THEN cat END AS category,
          CASE WHEN f THEN (value - 32) / 1.8 ELSE value END AS value
        FROM meas m JOIN vital_dict d ON m.item_id = d.item_id
        WHERE error IS DISTINCT FROM 1"""),
    "first_labs": (["lab_rows"], f"""
        SELECT subj_id, enc_id, {LAB_COLUMNS} FROM (
          SELECT f.subj_id, f.enc_id, f.label, d.value
          FROM (SELECT subj_id, enc_id, label, min(ts) AS ts FROM lab_rows GROUP BY ALL) f
          LEFT JOIN lab_rows d ON f.subj_id = d.subj_id AND f.enc_id = d.enc_id
            AND f.label = d.label AND f.ts = d.ts)
        GROUP BY subj_id, enc_id"""),
    "first_vitals": (["vital_rows"], f"""
        SELECT subj_id, enc_id, {vital_columns()} FROM (
          SELECT f.subj_id, f.enc_id, f.category, d.value
          FROM (SELECT subj_id, enc_id, category, min(ts) AS ts FROM vital_rows GROUP BY ALL) f
          LEFT JOIN vital_rows d ON f.subj_id = d.subj_id AND f.enc_id = d.enc_id
            AND f.category = d.category AND f.ts = d.ts)
        GROUP BY subj_id, enc_id"""),
    "vitals_window": (["vital_rows", "enc"], f"""
        SELECT subj_id, enc_id, {vital_columns()} FROM (
          SELECT v.* FROM enc e JOIN vital_rows v ON v.subj_id = e.subj_id AND v.enc_id = e.enc_id
            AND v.ts BETWEEN e.start_ts AND e.start_ts + INTERVAL 6 HOUR)
        GROUP BY subj_id, enc_id"""),
    "weight": (["meas"], unit(TEST_WEIGHTS, "weight_first")),
    "height": (["meas"], unit(TEST_HEIGHTS, "height_first")),
    "info": (["enc", "subj", "diag"], f"""
        SELECT e.*, d.code, s.gender, {days4('end_ts', 'start_ts')} AS los_hospital,
          cast(round(cast({seconds('start_ts', 'dob')} / (86400.0 * 365.242) AS decimal(30,12)), 4) AS double) AS age,
          dense_rank() OVER (PARTITION BY e.subj_id ORDER BY start_ts) AS hospstay_seq,
          CASE WHEN dense_rank() OVER (PARTITION BY e.subj_id ORDER BY start_ts) = 1 THEN 'Y' ELSE 'N' END AS first_hosp_stay
        FROM enc e JOIN subj s ON e.subj_id = s.subj_id JOIN diag d ON d.enc_id = e.enc_id
        WHERE d.seq_num = 1"""),
    "scoped": (["rx", "enc"], f"""
        SELECT e.*, startdate, drug_type, drug FROM enc e JOIN rx ON rx.subj_id = e.subj_id AND rx.enc_id = e.enc_id
        WHERE drug_type = 'MAIN' AND drug IN ({SCOPE})"""),
    "spelling": ([], values(SPELLED, ["raw", "drug_name"])),
    "classes": ([], values(DRUG_CLASSES, ["drug_name", "drug_class", "spectrum", "drug_group", "association"])),
    "named": (["scoped", "spelling"], """
        SELECT DISTINCT subj_id, enc_id, startdate, start_ts, drug_name,
          cast(round((epoch_us(startdate) - epoch_us(date_trunc('day', start_ts))) / 86400000000.0) AS integer) + 1
            AS day_prescribed
        FROM scoped LEFT JOIN spelling ON drug = raw"""),
    "classified": (["named", "classes"], """
        SELECT n.drug_name, subj_id, enc_id, day_prescribed, drug_class, coalesce(spectrum, 'Narrow') AS spectrum,
          drug_group, coalesce(association, 'None') AS association
        FROM named n LEFT JOIN classes c ON n.drug_name = c.drug_name"""),
    "multi_hot": (["enc", "classified"], "SELECT e.enc_id, e.expire AS outcome, " + ", ".join(
        f"""coalesce(max(CASE WHEN drug_group = '{g}' THEN 1 ELSE 0 END), 0) AS "{g}" """ for g in DRUG_GROUPS
    ) + """, CASE WHEN count(c.enc_id) = 0 THEN 1 ELSE 0 END AS "None"
        FROM enc e LEFT JOIN classified c ON c.enc_id = e.enc_id AND day_prescribed <= 2
        GROUP BY e.enc_id, e.expire"""),
    "evidence": (["diag", "micro", "info"], f"""
        SELECT cc.subj_id, cc.enc_id, i.start_ts, i.hospstay_seq, i.code AS primary_code, cc.code,
          cc.seq_num AS code_seq, cm.org_name, cm.ts, {days4('cm.ts', 'i.start_ts')} AS chart_timelag
        FROM (SELECT * FROM diag WHERE {CODED}) cc
        FULL JOIN (SELECT * FROM micro WHERE org_name ILIKE '{TEST_PATTERN}' AND subj_id IS NOT NULL) cm
          ON cc.enc_id = cm.enc_id
        LEFT JOIN info i ON cc.enc_id = i.enc_id"""),
    "outcomes": (["info", "evidence"], """
        SELECT subj_id, enc_id,
          EXISTS (SELECT 1 FROM evidence e WHERE e.enc_id = info.enc_id) AS outcome FROM info"""),
    "treated": (["outcomes", "scoped"], """
        SELECT * FROM outcomes WHERE enc_id IN (SELECT enc_id FROM scoped)"""),
    "gaps": (["info"], f"""
        SELECT i.subj_id, i.enc_id, i.hospstay_seq, i.start_ts, i.end_ts,
          {seconds('i.start_ts', 'p.end_ts')} / 86400.0 AS gap_days
        FROM info i LEFT JOIN (SELECT * FROM info QUALIFY row_number()
            OVER (PARTITION BY subj_id, hospstay_seq ORDER BY enc_id) = 1) p
          ON p.subj_id = i.subj_id AND p.hospstay_seq = i.hospstay_seq - 1"""),
    "members": (["gaps", "info"], """
        SELECT i.*, s.session FROM info i JOIN (
          SELECT subj_id, hospstay_seq, sum(CASE WHEN gap >= 91 THEN 1 ELSE 0 END)
            OVER (PARTITION BY subj_id ORDER BY hospstay_seq) AS session
          FROM (SELECT subj_id, hospstay_seq, max(gap_days) AS gap FROM gaps GROUP BY ALL)) s
        ON s.subj_id = i.subj_id AND s.hospstay_seq = i.hospstay_seq"""),
    "sessions": (["members"], """
        SELECT subj_id, session, arg_min(enc_id, (hospstay_seq, enc_id)) AS first_enc_id,
          list(enc_id ORDER BY hospstay_seq, start_ts, enc_id) AS ids,
          list(code ORDER BY hospstay_seq, start_ts, enc_id) AS code_list,
          count(*) AS num_stays, round(sum(los_hospital), 4) AS cumulative_los,
          min(start_ts) AS first_admit, max(end_ts) AS last_disch
        FROM members GROUP BY subj_id, session HAVING count(*) > 1"""),
    "joined": (["first_vitals", "info", "weight", "height"], """
        SELECT v.*, i.start_ts, i.los_hospital, i.age, CASE WHEN i.gender = 'M' THEN 1 ELSE 0 END AS gender,
          weight_first AS weight, height_first AS height
        FROM first_vitals v JOIN info i ON i.enc_id = v.enc_id
        LEFT JOIN weight w ON w.enc_id = v.enc_id LEFT JOIN height h ON h.enc_id = v.enc_id"""),
    "numeric": (["joined", "first_labs"], """
        SELECT l.*, v.* EXCLUDE (subj_id, enc_id, los_hospital, glucose_min, glucose_max)
        FROM joined v JOIN first_labs l ON l.enc_id = v.enc_id AND l.subj_id = v.subj_id"""),
    "condensed": (["enc"], "SELECT enc_id, expire, " + ", ".join(
        f"{condensed(c)} AS {c}" for c in ONEHOT_CATEGORIES) + " FROM enc"),
    "onehot": (["condensed"], f"SELECT enc_id, expire, {onehots()} FROM condensed"),
}


def merged(source):
    return f"""
        SELECT o.enc_id, o.outcome OR coalesce((
            SELECT bool_or(x.outcome) FROM sessions s, unnest(s.ids) u(id), {source} x
            WHERE s.first_enc_id = o.enc_id AND x.enc_id = u.id), false) AS outcome
        FROM {source} o
        WHERE o.enc_id NOT IN (SELECT u.id FROM sessions s, unnest(s.ids) u(id) WHERE u.id <> s.first_enc_id)"""


VIEWS["merged_treated"] = (["treated", "sessions"], merged("treated"))
VIEWS["dataset"] = (["numeric", "onehot", "merged_treated", "info"], f"""
    SELECT n.* EXCLUDE (subj_id, start_ts, weight, height, age),
      CASE WHEN height BETWEEN 60 AND 250 THEN height END AS height,
      CASE WHEN weight BETWEEN 25 AND 400 THEN weight END AS weight,
      CASE WHEN weight BETWEEN 25 AND 400 AND height BETWEEN 60 AND 250
        THEN weight / ((height / 100) * (height / 100)) END AS bmi,
      {CLOCK.format('n.start_ts')} AS time_of_admission,
      CASE WHEN {CLOCK.format('n.start_ts')} < 6 THEN {CLOCK.format('n.start_ts')} + 18
        ELSE {CLOCK.format('n.start_ts')} - 6 END AS rescaled_time,
      CASE WHEN {CLOCK.format('n.start_ts')} >= 7 AND {CLOCK.format('n.start_ts')} < 9 THEN 1 ELSE 0 END AS am_admit,
      CASE WHEN n.age > 200 THEN 90 ELSE n.age END AS age,
      albumin * albumin AS albumin_2, spo2_mean * spo2_mean * spo2_mean AS spo2_mean_3,
      ln(bun) AS log_bun, ln(glucose) AS log_glucose, ln(lactate) AS log_lactate, ln(wbc) AS log_wbc,
      o.* EXCLUDE (enc_id), cast(t.outcome AS integer) AS outcome
    FROM numeric n JOIN onehot o ON o.enc_id = n.enc_id JOIN merged_treated t ON t.enc_id = n.enc_id
    JOIN info i ON i.enc_id = n.enc_id
    WHERE i.age >= 18 AND NOT starts_with(i.code, '{TEST_CODE_PREFIX}')""")


def needed(names, done=None):
    done = [] if done is None else done
    for n in names:
        if n not in done:
            needed(VIEWS[n][0], done)
            done.append(n)
    return done


def oracle(name, body, *views):
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in needed(views))
    ORACLES[name] = f"WITH {ctes} {body}" if ctes else body


# Scans and stages
oracle("scan_project", "SELECT o_orderkey AS enc_id, o_custkey AS subj_id, o_totalprice FROM orders")
SESSION_LISTS = """array_to_string(ids, '|') AS combined_enc_id,
    array_to_string(list_filter(ids, lambda x: x <> first_enc_id), '|') AS other_enc_id,
    array_to_string(code_list, '|') AS codes"""
oracle("csv_roundtrip_lists",
       f"SELECT subj_id, first_enc_id, num_stays, cumulative_los, {SESSION_LISTS} FROM sessions", "sessions")
oracle("stage_tables", "SELECT subj_id, enc_id, hospstay_seq FROM info WHERE hospstay_seq = 1", "info")

# Projections and filters
oracle("label_items", "SELECT * FROM lab_rows", "lab_rows")
oracle("range_category", f"SELECT subj_id, enc_id, item_id, ts, category, {r('value', 'value')} FROM vital_rows",
       "vital_rows")
oracle("flags_and_caps", f"""
    SELECT enc_id, height, weight, {r('weight / ((height / 100) * (height / 100))', 'bmi')}, gender, age, death_class
    FROM (SELECT i.enc_id, CASE WHEN height_first BETWEEN 60 AND 250 THEN height_first END AS height,
        CASE WHEN weight_first BETWEEN 25 AND 400 THEN weight_first END AS weight,
        CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS gender, CASE WHEN age > 200 THEN 90 ELSE age END AS age,
        CASE WHEN {CODED} THEN 1 ELSE 0 END + 2 * expire AS death_class
      FROM info i LEFT JOIN weight w ON w.enc_id = i.enc_id LEFT JOIN height h ON h.enc_id = i.enc_id)""",
       "info", "weight", "height")
oracle("power_log", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * l_quantity AS squared,
      l_quantity * l_quantity * l_quantity AS cubed, {r('ln(l_quantity)', 'log_quantity')},
      {r('CASE WHEN l_discount > 0 THEN ln(l_discount) END', 'log_discount')} FROM lineitem""")
oracle("condense_categories", "SELECT * FROM onehot", "onehot")
oracle("condensed_counts", """
    SELECT ethnicity, admission_location, count(*) AS n FROM condensed GROUP BY ALL""", "condensed")
oracle("lag_split", f"""
    SELECT enc_id, org_name, ts, lag_days, los, expire,
      CASE WHEN lag_days IS NULL THEN 'none' WHEN lag_days > 3 THEN 'late' ELSE 'early' END AS lag_group, within_3h
    FROM (SELECT m.enc_id, org_name, ts, {days4('ts', 'start_ts')} AS lag_days,
        {days4('end_ts', 'start_ts')} AS los, expire, {hours('ts', 'start_ts')} < 3 AS within_3h
      FROM micro m JOIN enc e ON e.enc_id = m.enc_id WHERE org_name ILIKE '{TEST_PATTERN}')""", "micro", "enc")
oracle("lag_groups_of_cohort", """
    SELECT CASE WHEN chart_timelag IS NULL THEN 'none' WHEN chart_timelag > 3 THEN 'late' ELSE 'early' END AS lag_group,
      count(DISTINCT enc_id) AS n_stays FROM evidence GROUP BY 1""", "evidence")
oracle("letter_prefix_filter", """
    SELECT *, cast(substring(code, 1, 3) AS integer) AS prefix FROM diag
    WHERE substring(code, 1, 1) NOT IN ('E', 'V') AND cast(substring(code, 1, 3) AS integer) < 140""", "diag")
oracle("pattern_filters", f"""
    SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '{TEST_PATTERN}' OR p_name LIKE '%dget'""")
oracle("code_equality_filter", "SELECT * FROM diag WHERE (seq_num = 1 AND code = '00845') OR code = '00800'", "diag")
oracle("id_list_filter", f"""
    SELECT enc_id, CASE WHEN enc_id IN (SELECT enc_id FROM micro WHERE org_name ILIKE '{TEST_PATTERN}')
      THEN 'in' ELSE 'out' END AS side FROM enc""", "enc", "micro")
FILLED = " + ".join(f"(CASE WHEN {n} IS NULL THEN 0 ELSE 1 END)" for n in LABS)
oracle("completeness_filter", f"""
    SELECT enc_id, {FILLED} AS n_filled FROM first_labs WHERE {FILLED} > 0.5 * {len(LABS)}""", "first_labs")
oracle("filled_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count({n}) AS n FROM first_labs" for n in LABS
) + f" UNION ALL SELECT 'rows with ' || ({FILLED}), count(*) FROM first_labs GROUP BY 1", "first_labs")

# Stays
oracle("encounter_info", "SELECT * FROM info", "info")
oracle("prefix_cohort", f"""
    SELECT e.enc_id, e.subj_id, code, start_ts, end_ts FROM diag d LEFT JOIN enc e ON e.enc_id = d.enc_id
    WHERE ({prefixes()}) AND seq_num = 1""", "diag", "enc")
oracle("primary_code_stays", """
    SELECT e.enc_id, e.subj_id, code FROM enc e
    LEFT JOIN (SELECT * FROM diag WHERE seq_num = 1) d ON d.enc_id = e.enc_id""", "enc", "diag")
oracle("age_interval_parts", f"""
    SELECT enc_id, {r('''(extract(day FROM start_ts - dob) + extract(hour FROM start_ts - dob) / 24.0
      + extract(minute FROM start_ts - dob) / 24.0 / 60.0) / 365.25''', 'age')}
    FROM enc JOIN subj ON enc.subj_id = subj.subj_id""", "enc", "subj")
oracle("clock_features", f"""
    SELECT event_id, {r('c', 'clock')}, {r('CASE WHEN c < 6 THEN c + 18 ELSE c - 6 END', 'shifted')},
      CASE WHEN c >= 7 AND c < 9 THEN 1 ELSE 0 END AS is_morning, cast(cast(ts AS date) AS varchar) AS day
    FROM (SELECT *, {CLOCK.format('ts')} AS c FROM events)""")
BAND = "CASE WHEN a <= -300 THEN NULL " + " ".join(f"WHEN a <= {u} THEN '{b}'" for u, b in AGE_BANDS) + " END"
oracle("age_bins", f"""
    SELECT expire, {BAND} AS age_band, count(*) AS n
    FROM (SELECT expire, {seconds('dod', 'dob')} / (86400.0 * 365.2425) AS a FROM enc JOIN subj ON enc.subj_id = subj.subj_id)
    GROUP BY 1, 2""", "enc", "subj")
oracle("year_age_by_month", f"""
    SELECT extract(month FROM o_orderdate) AS birth_month, {r('avg(a)', 'avg_age')}, min(a) AS min_age, max(a) AS max_age
    FROM (SELECT *, 2026 - extract(year FROM o_orderdate) AS a FROM orders) GROUP BY 1""")
ITEMS = values([(i.item_id, i.label) for i in TEST_DICTIONARY], ["item_id", "label"])
NAMED_EVENTS = f"""
    SELECT m.item_id, e.enc_id, e.subj_id, e.start_ts, e.expire, m.ts, m.value, label
    FROM enc e LEFT JOIN meas m ON m.enc_id = e.enc_id LEFT JOIN ({ITEMS}) d ON d.item_id = m.item_id"""
oracle("event_dictionary_join", NAMED_EVENTS, "enc", "meas")
oracle("early_events", f"""
    SELECT enc_id, item_id, ts, value, {r(hours('ts', 'start_ts'), 'chart_lag')} FROM ({NAMED_EVENTS})
    WHERE {hours('ts', 'start_ts')} < 3""", "enc", "meas")
oracle("suffix_join", """
    SELECT e.subj_id, enc_id, expire AS expire_ad, gender, CASE WHEN s.subj_id IS NOT NULL THEN 1 END AS expire_pt
    FROM enc e LEFT JOIN subj s ON s.subj_id = e.subj_id""", "enc", "subj")
oracle("body_measures", """
    SELECT h.enc_id, h.subj_id, height_first, h.ts AS height_charttime, weight_first, w.ts AS weight_charttime,
      start_ts, age, gender
    FROM height h JOIN weight w ON w.enc_id = h.enc_id JOIN info i ON i.enc_id = h.enc_id""", "height", "weight", "info")

# Measures
oracle("first_labs", "SELECT * FROM first_labs", "first_labs")
oracle("first_vitals", f"SELECT subj_id, enc_id, {rounded_list(VITAL_NAMES)} FROM first_vitals", "first_vitals")
oracle("labs_window_6h", "SELECT subj_id, enc_id, " + ", ".join(
    f"{fn}(CASE WHEN label = '{n}' THEN value END) AS {n}_{fn}" for n in LABS for fn in ("min", "max")
) + """ FROM (SELECT e.subj_id, e.enc_id, label, value FROM enc e LEFT JOIN lab_rows l
      ON l.subj_id = e.subj_id AND l.enc_id = e.enc_id
      AND l.ts BETWEEN e.start_ts - INTERVAL 6 HOUR AND e.start_ts + INTERVAL 6 HOUR)
    GROUP BY subj_id, enc_id""", "enc", "lab_rows")
oracle("vitals_window_6h", f"SELECT subj_id, enc_id, {rounded_list(VITAL_NAMES)} FROM vitals_window", "vitals_window")
oracle("events_after_first", f"""
    SELECT user_id AS enc_id, event_type AS category, min(value) AS value_min, max(value) AS value_max,
      {r('avg(value)', 'value_mean')}, count(*) AS n
    FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS s FROM events)
    WHERE ts BETWEEN s AND s + INTERVAL 6 HOUR GROUP BY 1, 2""")
oracle("first_value_unit", """
    SELECT enc_id, subj_id, 'weight' AS kind, weight_first AS value, ts FROM weight
    UNION ALL SELECT enc_id, subj_id, 'height', height_first, ts FROM height""", "weight", "height")
NOT_MEAN = "subj_id, enc_id, start_ts, los_hospital, age, gender, weight, height"
oracle("vitals_joined", f"SELECT {NOT_MEAN}, {rounded_list(VITAL_NAMES)} FROM joined", "joined")
KEPT_VITALS = [n for n in VITAL_NAMES if n not in ("glucose_min", "glucose_max")]
oracle("numeric_features", f"""
    SELECT subj_id, enc_id, start_ts, age, gender, weight, height, {', '.join(LABS)}, {rounded_list(KEPT_VITALS)}
    FROM numeric""", "numeric")
ORACLES["stage_chain"] = ORACLES["numeric_features"]
oracle("window_cohort_features", f"""
    SELECT v.subj_id, v.enc_id, {rounded_list(VITAL_NAMES)}, i.expire, i.age,
      CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS gender, weight_first AS weight, height_first AS height
    FROM vitals_window v JOIN info i ON i.enc_id = v.enc_id
    LEFT JOIN weight w ON w.enc_id = v.enc_id LEFT JOIN height h ON h.enc_id = v.enc_id
    WHERE {prefixes()}""", "vitals_window", "info", "weight", "height")

# Prescriptions
oracle("drug_scope", "SELECT subj_id, enc_id, startdate, drug_type, drug, start_ts, expire FROM scoped", "scoped")
oracle("drug_normalise", """
    SELECT *, date_diff('day', cast(start_ts AS date), cast(startdate AS date)) AS date_lag FROM named""", "named")
oracle("drug_classify", "SELECT * FROM classified", "classified")
oracle("first_drug", """
    SELECT subj_id, enc_id, drug AS first_drug, startdate AS first_start FROM (
      SELECT *, row_number() OVER (PARTITION BY subj_id, enc_id ORDER BY startdate, drug) AS n FROM scoped)
    WHERE n = 1""", "scoped")
oracle("treated_semi", "SELECT * FROM treated", "treated")
oracle("drug_names_per_day", """
    SELECT subj_id, enc_id, day_prescribed, coalesce(string_agg(drug_name, '|' ORDER BY drug_name), '') AS drug_names
    FROM classified GROUP BY subj_id, enc_id, day_prescribed""", "classified")
oracle("drug_sets", """
    SELECT enc_id, coalesce(string_agg(DISTINCT drug_group, '|' ORDER BY drug_group), '') AS drug_groups,
      string_agg(DISTINCT association, '|' ORDER BY association) AS associations
    FROM classified WHERE day_prescribed <= 2 GROUP BY enc_id""", "classified")
oracle("multi_hot_drugs", "SELECT * FROM multi_hot", "multi_hot")
oracle("prescriptions_per_day", """
    SELECT day_prescribed, count(*) AS n FROM (SELECT DISTINCT subj_id, enc_id, day_prescribed FROM classified)
    WHERE day_prescribed BETWEEN 1 AND 10 GROUP BY 1""", "classified")
oracle("drug_cumulative", """
    SELECT a.subj_id, a.enc_id, a.day_prescribed, count(DISTINCT b.drug_class) AS n_classes,
      count(DISTINCT b.drug_name) AS n_names
    FROM (SELECT DISTINCT subj_id, enc_id, day_prescribed FROM classified) a
    JOIN classified b ON b.subj_id = a.subj_id AND b.enc_id = a.enc_id AND b.day_prescribed <= a.day_prescribed
    GROUP BY ALL""", "classified")
oracle("drug_burden", """
    SELECT subj_id, c.enc_id, count(DISTINCT drug_class) AS cumulative_number_classes,
      count(DISTINCT drug_name) AS cumulative_number, e.expire
    FROM classified c JOIN (SELECT enc_id, expire FROM enc) e ON e.enc_id = c.enc_id GROUP BY ALL""",
       "classified", "enc")
oracle("event_types_to_date", """
    SELECT a.user_id AS enc_id, a.d AS day_prescribed, count(DISTINCT b.event_type) AS n_types
    FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) a
    JOIN events b ON b.user_id = a.user_id AND CAST(b.ts AS DATE) <= a.d GROUP BY ALL""")

# Outcome, sessions, cohort
oracle("evidence_full_right", "SELECT * FROM evidence", "evidence")
oracle("evidence_all_ids", f"""
    SELECT x.subj_id, x.enc_id, i.start_ts, i.hospstay_seq, i.code AS primary_code, x.code, x.code_seq, x.org_name, x.ts,
      {days4('x.ts', 'i.start_ts')} AS chart_timelag
    FROM (SELECT coalesce(cc.subj_id, cm.subj_id) AS subj_id, coalesce(cc.enc_id, cm.enc_id) AS enc_id, cc.code,
        cc.seq_num AS code_seq, cm.org_name, cm.ts
      FROM (SELECT * FROM diag WHERE {CODED}) cc
      FULL JOIN (SELECT * FROM micro WHERE org_name ILIKE '{TEST_PATTERN}') cm ON cc.enc_id = cm.enc_id) x
    LEFT JOIN info i ON x.enc_id = i.enc_id""", "diag", "micro", "info")
oracle("outcome_exists", "SELECT * FROM outcomes", "outcomes")
oracle("stay_gaps", f"""
    SELECT subj_id, enc_id, hospstay_seq, start_ts, end_ts, {r('gap_days', 'gap_days', 8)} FROM gaps""", "gaps")
oracle("session_members", "SELECT subj_id, enc_id, hospstay_seq, session FROM members", "members")
oracle("multistay", f"""
    SELECT subj_id, session, first_enc_id, {SESSION_LISTS}, num_stays, cumulative_los, first_admit, last_disch
    FROM sessions""", "sessions")
VIEWS["merged_all"] = (["outcomes", "sessions"], merged("outcomes"))
oracle("merge_close_stays", "SELECT * FROM merged_all", "merged_all")
oracle("merge_treated_stays", "SELECT * FROM merged_treated", "merged_treated")
oracle("cohort_filters", f"""
    SELECT enc_id, outcome, rule FROM (
      SELECT o.enc_id, o.outcome, 'adults' AS rule FROM outcomes o JOIN info i ON i.enc_id = o.enc_id WHERE age >= 18
      UNION ALL SELECT o.enc_id, o.outcome, 'not_primary' FROM outcomes o JOIN info i ON i.enc_id = o.enc_id WHERE NOT {CODED}
      UNION ALL SELECT o.enc_id, o.outcome, 'long' FROM outcomes o JOIN info i ON i.enc_id = o.enc_id WHERE los_hospital >= 3
      UNION ALL SELECT o.enc_id, o.outcome, 'survivors' FROM outcomes o JOIN info i ON i.enc_id = o.enc_id WHERE expire = 0)""",
       "outcomes", "info")
oracle("flag_by_membership", f"""
    SELECT flag, {r('avg(expire)', 'rate')}, count(*) AS n
    FROM (SELECT expire, CASE WHEN enc_id IN (SELECT enc_id FROM micro WHERE org_name ILIKE '{TEST_PATTERN}')
      THEN 1 ELSE 0 END AS flag FROM enc) GROUP BY flag""", "enc", "micro")

# Dataset
DATASET_FLOATS = [*LABS, *KEPT_VITALS, "height", "weight", "bmi", "time_of_admission", "rescaled_time", "age",
                  "albumin_2", "spo2_mean_3", "log_bun", "log_glucose", "log_lactate", "log_wbc", "gender"]
ONEHOT_LIST = ", ".join(f'"{c}"' for c in ONEHOT_FEATURES)
oracle("build_dataset", f"""
    SELECT enc_id, outcome, expire, am_admit, {ONEHOT_LIST}, {rounded_list(DATASET_FLOATS)} FROM dataset""", "dataset")

# Descriptive jobs
oracle("value_counts", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT o_orderstatus, 'all', count(*) FROM orders GROUP BY ALL""")
oracle("distinct_counts", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM orders"""
    for c in ("o_orderkey", "o_custkey", "o_orderpriority")))


def cells(column, names):
    return ", ".join(
        f"""CASE WHEN count(*) FILTER ({column} = '{n}') > 0 THEN count(*) FILTER ({column} = '{n}') END AS "{n}" """
        for n in names)


oracle("crosstab", f"""
    SELECT event_type, {cells('day', WEEKDAYS)} FROM (SELECT *, strftime(ts, '%a') AS day FROM events)
    GROUP BY event_type""")
oracle("crosstab_sparse", f"""
    SELECT c_nationkey, {cells('c_mktsegment', ["BUILDING", "MACHINERY", "FURNITURE", "NO SUCH SEGMENT"])}
    FROM customer GROUP BY c_nationkey""")


def describe(v):
    quartiles = ", ".join(r(f"quantile_cont({v}, {p})", n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
    return f"""count({v}) AS n, {r(f'avg({v})', 'mean')}, {r(f'stddev_samp({v})', 'std')},
      min({v}) AS min, max({v}) AS max, {quartiles}"""


oracle("grouped_describe", f"""
    SELECT CASE WHEN {CODED} THEN 1 ELSE 0 END AS coded, expire, {describe('los_hospital')} FROM info GROUP BY 1, 2""",
       "info")
oracle("frame_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {describe(c)} FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
oracle("histogram_by_class", """
    SELECT cast(least(floor((x - lo) / ((hi - lo) / 10)) + 1, 10) AS bigint) AS bin, l_returnflag, count(*) AS n
    FROM (SELECT l_extendedprice AS x, l_returnflag FROM lineitem),
      (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_returnflag = 'A')
    WHERE x BETWEEN lo AND hi GROUP BY 1, 2""")
oracle("histogram_fixed_edges", """
    SELECT cast(least(floor((l_quantity - 5) / 5.0) + 1, 7) AS bigint) AS bin, count(*) AS n
    FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 GROUP BY 1""")
oracle("correlations", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {r(f'corr({n}, expire)', 'corr')} FROM w" for n in LABS
).replace("FROM w", "FROM (SELECT l.*, e.expire FROM first_labs l JOIN enc e ON e.enc_id = l.enc_id)"),
    "first_labs", "enc")
oracle("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'corr')} FROM first_labs" for a in LABS for b in LABS),
    "first_labs")
oracle("correlation_ends", f"""
    WITH c AS ({ORACLES['correlations']})
    SELECT * FROM (SELECT feature, corr, 'top' AS "end" FROM c ORDER BY corr DESC, feature LIMIT 3)
    UNION ALL SELECT * FROM (SELECT feature, corr, 'bottom' FROM c ORDER BY corr, feature LIMIT 3)""")


def normal_rows():
    from statistics import NormalDist

    return [(i / 100, NormalDist().inv_cdf(i / 100)) for i in range(1, 100)]


oracle("normal_quantiles", f"""
    SELECT {r('p', 'p')}, {r('z', 'normal')}, {r('s', 'sample')} FROM (
      SELECT unnest([{', '.join(repr(p) for p, _ in normal_rows())}]) AS p,
        unnest([{', '.join(repr(z) for _, z in normal_rows())}]) AS z,
        unnest(quantile_cont(value, [{', '.join(repr(p) for p, _ in normal_rows())}])) AS s FROM events)""")


def polynomial(coefficients, x):
    total = repr(coefficients[0])
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c!r})"
    return total


def normal_sql(kind, x):
    num, den = NORMAL_QUANTILE[kind]
    return f"({polynomial(num, x)} / {polynomial(den, x)})"


oracle("probability_line", f"""
    SELECT event_type, count(*) AS n, {r('regr_slope(value, z)', 'slope')}, {r('regr_intercept(value, z)', 'intercept')}, {r('corr(value, z)', 'r')}
    FROM (SELECT *, CASE WHEN abs(p - 0.5) <= 0.425 THEN {normal_sql('central', '(0.180625 - (p - 0.5) * (p - 0.5))')} * (p - 0.5)
        ELSE sign(p - 0.5) * CASE WHEN t <= 5 THEN {normal_sql('near', '(t - 1.6)')} ELSE {normal_sql('far', '(t - 5)')} END END AS z
      FROM (SELECT *, sqrt(-ln(least(p, 1 - p))) AS t
        FROM (SELECT *, CASE WHEN i = m THEN pow(0.5, 1.0::DOUBLE / m) WHEN i = 1 THEN 1 - pow(0.5, 1.0::DOUBLE / m)
            ELSE (i - 0.3175::DOUBLE) / (m + 0.365::DOUBLE) END AS p
          FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS m
            FROM events WHERE value IS NOT NULL)))) GROUP BY event_type""")
oracle("class_means", f"SELECT expire, {r('avg(' + CLOCK.format('start_ts') + ')', 'mean_clock')} FROM enc GROUP BY 1",
       "enc")
oracle("density_scott", f"""
    WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi
      FROM events WHERE value IS NOT NULL GROUP BY 1),
    b AS (SELECT e.event_type, value - lo + 3 * h AS far, h FROM events e JOIN s USING (event_type) WHERE value IS NOT NULL),
    w AS (SELECT event_type, g, sum(w) AS w FROM (
        SELECT event_type, floor(far / h * 512) AS g, 1 - (far / h * 512 - floor(far / h * 512)) AS w FROM b
        UNION ALL SELECT event_type, floor(far / h * 512) + 1, far / h * 512 - floor(far / h * 512) FROM b) GROUP BY 1, 2),
    p AS (SELECT event_type, n, h, i, lo - 3 * h AS low, (hi - lo + 6 * h) / 39 AS step FROM s, range(40) t(i))
    SELECT event_type, {r('low + i * step', 'x')}, {r('coalesce(sum(w * exp(-0.5 * pow(i * step / h - g / 512, 2))), 0) / (n * h * sqrt(2 * pi()))', 'density')}
    FROM p JOIN w USING (event_type) GROUP BY event_type, n, h, i, low, step""")
oracle("density_grid", f"""
    SELECT event_type, {r('x', 'x')}, {r('sum(n * exp(-0.5 * ((x - c) / 2.0) * ((x - c) / 2.0))) / (sum(n) * 2.0 * sqrt(2 * pi()))', 'density')}
    FROM (SELECT event_type, (least(floor(value / 0.5), 99) + 0.5) * 0.5 AS c, count(*) AS n FROM events
          WHERE value BETWEEN 0 AND 50 GROUP BY 1, 2),
      (SELECT range * 2.0 AS x FROM range(26)) GROUP BY event_type, x""")
oracle("sort_limit_offset", """
    SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_type, event_id LIMIT 25 OFFSET 50""")
oracle("argmax_group", """
    WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT * FROM c WHERE n = (SELECT max(n) FROM c)""")
oracle("sample_rows", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 20""")
oracle("id_set_ops", """
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'both' ELSE 'no lines' END AS part
    FROM orders""")

# Preparation
CUTOFF = 0.75 * (len(TEST_FEATURES) + 3 + 1 - 3)
CHOSEN = [*TEST_FEATURES, "outcome", "expire", "enc_id"]
N_CHOSEN = " + ".join(f'(CASE WHEN "{c}" IS NULL THEN 0 ELSE 1 END)' for c in CHOSEN)
PLAIN = ["gender", "am_admit", *ONEHOT_FEATURES, "outcome", "expire", "enc_id"]
oracle("select_features", f"""
    SELECT {', '.join(f'"{c}"' for c in PLAIN)}, {rounded_list([c for c in TEST_NUMERIC if c not in PLAIN])}
    FROM dataset WHERE {N_CHOSEN} > {CUTOFF}""", "dataset")
FOLD = " + ".join(f'"{g}"' for g in FOLDED_GROUPS)
oracle("select_and_fold", f"""
    SELECT {', '.join(f'"{g}"' for g in DRUG_FEATURES if g != 'Other')},
      CASE WHEN {FOLD} > 1 THEN 1 ELSE {FOLD} END AS "Other", outcome, enc_id FROM multi_hot""", "multi_hot")


def under(table, id_col, label):
    return f"""
    SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5({id_col} || '|42'), {id_col}) AS n
      FROM {table})
    WHERE n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM {table} GROUP BY {label}))"""


oracle("balance_under", under("labels", "doc_id", "quality"))
oracle("balance_orders", under("(SELECT o_orderkey, o_orderstatus FROM orders)", "o_orderkey", "o_orderstatus"))
oracle("balance_over", """
    SELECT doc_id, quality, toxic, j AS copy FROM (
      SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42'), doc_id) - 1 AS i,
        count(*) OVER (PARTITION BY quality) AS n FROM labels) t,
      (SELECT max(c) AS most FROM (SELECT count(*) AS c FROM labels GROUP BY quality)) m,
      unnest(range(1, cast(most AS bigint) + 1)) u(j)
    WHERE (j - 1) * n + i < most""")


def split(table, id_col, label):
    return f"""
    SELECT * EXCLUDE (i, n), i <= round(0.2 * n) AS is_test FROM (
      SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5({id_col} || '|42'), {id_col}) AS i,
        count(*) OVER (PARTITION BY {label}) AS n FROM {table})"""


oracle("stratified_split", split("labels", "doc_id", "quality"))
oracle("split_orders", split("(SELECT o_orderkey, o_orderstatus FROM orders)", "o_orderkey", "o_orderstatus"))
oracle("impute_median", "SELECT subj_id, enc_id, " + ", ".join(
    f"coalesce({n}, (SELECT median({n}) FROM first_labs)) AS {n}" for n in LABS) + " FROM first_labs", "first_labs")
VIEWS["scaled"] = (["first_labs"], "SELECT enc_id, " + ", ".join(
    f"({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () = 0 THEN 1 ELSE stddev_pop({n}) OVER () END AS {n}"
    for n in LABS) + " FROM first_labs")
SQUARES = " + ".join(f"coalesce((a.{n} - b.{n}) * (a.{n} - b.{n}), 0)" for n in LABS)
SHARED = " + ".join(f"CASE WHEN a.{n} IS NULL OR b.{n} IS NULL THEN 0 ELSE 1 END" for n in LABS)


def filled(n):
    return f"""coalesce({n}, (SELECT sum(v / greatest(d, 1e-6)) / sum(1 / greatest(d, 1e-6)) FROM near_{n} x
        WHERE x.enc_id = s.enc_id))"""


for _n in LABS:  # every pair is compared
    VIEWS[f"near_{_n}"] = (["scaled"], f"""
        SELECT enc_id, x.d AS d, x.v AS v FROM (
          SELECT a.enc_id, unnest(min({{'d': round(({SQUARES}) / ({SHARED}), 9), 'donor': b.enc_id, 'v': b.{_n}}}, 3)) AS x
          FROM scaled a JOIN scaled b ON a.{_n} IS NULL AND b.{_n} IS NOT NULL AND a.enc_id <> b.enc_id AND ({SHARED}) > 0
          GROUP BY a.enc_id)""")
oracle("impute_knn", "SELECT enc_id, " + ", ".join(r(filled(n), n) for n in LABS) + " FROM scaled s",
       "scaled", *[f"near_{n}" for n in LABS])


def is_masked(n):
    digits = "lower(substring(md5(enc_id || '|" + n + "'), 1, 6))"
    return f"cast('0x' || {digits} AS bigint) % 10 = 0"


oracle("impute_error", " UNION ALL ".join(f"""
    SELECT '{n}' AS feature, {r(f'avg(({n} - m) * ({n} - m))', 'mse')}, count(*) AS n_cells
    FROM scaled, (SELECT median({n}) FILTER (NOT ({is_masked(n)})) AS m FROM scaled)
    WHERE {n} IS NOT NULL AND {is_masked(n)} HAVING count(*) > 0""" for n in LABS), "scaled")
oracle("standardise", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      {', '.join(r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', c) for c in ('l_quantity', 'l_extendedprice'))},
      cast(l_returnflag = 'R' AS double) AS returned, 0.0::double AS constant FROM lineitem""")

# Evaluation of a fixed score
VIEWS["stay_scores"] = (["enc"], """
    SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM (
      SELECT enc_id, expire AS outcome, round((enc_id * 7919) % 1009 / 1009.0 * 0.7 + expire * 0.3, 4) AS score FROM enc)""")
oracle("confusion_shares", f"""
    SELECT outcome, prediction AS predicted, count(*) AS n,
      {r('count(*) / sum(count(*)) OVER (PARTITION BY outcome)', 'share')} FROM stay_scores GROUP BY 1, 2""", "stay_scores")
oracle("oof_report", " UNION ALL ".join(f"""
    SELECT {c} AS class, {r('hit / said', 'precision')}, {r('hit / support', 'recall')},
      {r('2.0 * hit / (said + support)', 'f1')}, support, said - hit AS false_alarms, support - hit AS misses,
      {r('accuracy', 'accuracy')}
    FROM (SELECT count(*) FILTER (outcome = {c} AND prediction = {c}) AS hit, count(*) FILTER (prediction = {c}) AS said,
      count(*) FILTER (outcome = {c}) AS support, avg(CASE WHEN outcome = prediction THEN 1 ELSE 0 END) AS accuracy
      FROM stay_scores)""" for c in (0, 1)), "stay_scores")
VIEWS["binned"] = (["stay_scores"], """
    SELECT *, sum(n) OVER (ORDER BY bin) AS cum_n, sum(events) OVER (ORDER BY bin) AS cum_events
    FROM (SELECT cast(least(floor(score * 100) + 1, 100) AS bigint) AS bin, count(*) AS n, sum(outcome) AS events FROM stay_scores GROUP BY 1)""")
VIEWS["roc"] = (["stay_scores"], """
    SELECT score AS threshold, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cum_pos,
      sum(neg) OVER (ORDER BY score DESC) AS cum_neg, sum(pos) OVER () AS p, sum(neg) OVER () AS q
    FROM (SELECT score, sum(outcome) AS pos, sum(1 - outcome) AS neg FROM stay_scores GROUP BY score)""")
oracle("roc_points", f"""
    SELECT {r('threshold', 'threshold')}, {r('cum_neg / q', 'fpr')}, {r('cum_pos / p', 'tpr')}, cum_pos, cum_neg FROM roc""",
       "roc")
oracle("roc_auc", f"""
    SELECT {r('sum(CASE WHEN a.score > b.score THEN n * m WHEN a.score = b.score THEN n * m / 2.0 ELSE 0 END) / sum(n * m)', 'auc')}
    FROM (SELECT score, count(*) AS n FROM stay_scores WHERE outcome = 1 GROUP BY 1) a,
      (SELECT score, count(*) AS m FROM stay_scores WHERE outcome = 0 GROUP BY 1) b""", "stay_scores")
KIND = """CASE WHEN outcome = 1 AND prediction = 1 THEN 'true_pos' WHEN outcome = 0 AND prediction = 0 THEN 'true_neg'
    WHEN outcome = 0 THEN 'false_pos' ELSE 'false_neg' END"""
oracle("score_quadrants", f"""
    SELECT {KIND} AS kind, cast(least(floor(score * 19) + 1, 19) AS bigint) AS bin, count(*) AS n
    FROM stay_scores WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2""", "stay_scores")
oracle("calibration", f"""
    SELECT cast(least(floor(score * 11) + 1, 11) AS bigint) AS bin, {r('avg(score)', 'mean_score')},
      {r('avg(outcome)', 'event_rate')}, count(*) AS n FROM stay_scores GROUP BY 1""", "stay_scores")
oracle("slice_rmse", f"""
    SELECT {r('sqrt(avg((score - outcome) * (score - outcome)))', 'rmse')}, count(*) AS n
    FROM stay_scores WHERE score < 0.25""", "stay_scores")
EFFECTS = values([(d, round(0.07 * (i + 1) - 0.5, 2)) for i, d in enumerate(DRUG_FEATURES)], ["drug", "effect"])
oracle("what_if", f"""
    SELECT enc_id, drug, probability, row_number() OVER (PARTITION BY enc_id ORDER BY probability DESC, drug) AS "position",
      CASE WHEN max(probability) OVER (PARTITION BY enc_id) <= 0.40 THEN 'low'
        WHEN max(probability) OVER (PARTITION BY enc_id) < 0.60 THEN 'moderate' ELSE 'high' END AS risk,
      printf('%.1f%%', probability * 100) AS shown
    FROM (SELECT enc_id, drug, round(1 / (1 + exp(-((enc_id % 17) / 10.0 - 1.0 + effect))), 6) AS probability
      FROM enc, ({EFFECTS}))""", "enc")

# The rate of a bin is the largest, over ranges that end at or after it, of the smallest rate of ranges that begin at or before it.
oracle("monotone_steps", f"""
    SELECT min(bin) AS low, max(bin) AS high, sum(n)::BIGINT AS n, sum(events)::BIGINT AS events, {r('rate', 'rate')} FROM (
      SELECT b.bin, b.n, b.events, max(m) AS rate FROM (
        SELECT b.bin, a.bin AS a,
          min((c.cum_events - a.cum_events + a.events)::DOUBLE / (c.cum_n - a.cum_n + a.n)) AS m
        FROM binned b JOIN binned a ON a.bin <= b.bin JOIN binned c ON c.bin >= b.bin GROUP BY b.bin, a.bin) JOIN binned b USING (bin)
      GROUP BY b.bin, b.n, b.events) GROUP BY rate""", "binned")

# Four classes with a fixed score for each
VIEWS["class_scores"] = (["enc"], """
    SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 AND s0 >= s3 THEN 0 WHEN s1 >= s2 AND s1 >= s3 THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS prediction FROM (
      SELECT enc_id, outcome, """ + ", ".join(
    f"round((enc_id * {7919 + 101 * k}) % 211 / 211.0 + CASE WHEN outcome = {k} THEN 0.4 ELSE 0 END, 4) AS s{k}" for k in range(4)
) + """ FROM (SELECT enc_id, CASE WHEN enc_id % 3 = 0 THEN 1 ELSE 0 END + 2 * expire AS outcome FROM enc))""")
VIEWS["against_rest"] = (["class_scores"], " UNION ALL ".join(
    f"SELECT {k} AS class, s{k} AS threshold, sum((outcome = {k})::INT) AS pos, sum((outcome <> {k})::INT) AS neg FROM class_scores GROUP BY 2" for k in range(4)))
VIEWS["class_curve"] = (["against_rest"], """
    SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(pos) OVER (PARTITION BY class) AS p, sum(neg) OVER (PARTITION BY class) AS n
    FROM against_rest WINDOW w AS (PARTITION BY class ORDER BY threshold DESC)""")
oracle("class_report", " UNION ALL ".join(f"""
    SELECT {k} AS class, {r('coalesce(hit / nullif(said, 0), 0)', 'precision')}, {r('coalesce(hit / nullif(support, 0), 0)', 'recall')},
      {r('coalesce(2.0 * hit / nullif(said + support, 0), 0)', 'f1')}, support, said - hit AS false_alarms, support - hit AS misses, {r('accuracy', 'accuracy')}
    FROM (SELECT count(*) FILTER (outcome = {k} AND prediction = {k}) AS hit, count(*) FILTER (prediction = {k}) AS said,
      count(*) FILTER (outcome = {k}) AS support, avg((outcome = prediction)::INT) AS accuracy FROM class_scores)""" for k in range(4)), "class_scores")
oracle("class_roc", f"""
    SELECT class, {r('threshold', 'threshold')}, {r('cum_neg / nullif(n, 0)', 'fpr')}, {r('cum_pos / nullif(p, 0)', 'tpr')}, cum_pos, cum_neg FROM class_curve""", "class_curve")
oracle("class_auc", f"""
    SELECT class, {r('sum(neg * (cum_pos - pos) + neg * pos / 2.0) / nullif(any_value(p) * any_value(n), 0)', 'auc')} FROM class_curve GROUP BY class""", "class_curve")
