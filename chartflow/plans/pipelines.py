"""Queries of the two longest clinical pipelines, over tables of their shape made from events, and the same written out in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..clinical import sepsis, waterfall
from .queries import query, table

# Respiratory support: two users make a stay, so records often share their time.
_DEVICE = "CASE event_id % 8 WHEN 0 THEN 'IMV' WHEN 1 THEN 'NIPPV' WHEN 2 THEN 'Nasal Cannula' WHEN 3 THEN 'Trach Collar' WHEN 4 THEN 'Room Air' END"
_NAME = "CASE event_id % 7 WHEN 0 THEN 'Vent A' WHEN 1 THEN 'Vent B' WHEN 2 THEN 'T-Piece' WHEN 3 THEN 'Trach mask' END"
_MODE = "CASE event_id % 9 WHEN 0 THEN 'Assist Control-Volume Control' WHEN 1 THEN 'SIMV' WHEN 2 THEN 'Pressure Support/CPAP' WHEN 3 THEN 'Pressure Control' END"
_MODE_NAME = "CASE event_id % 5 WHEN 0 THEN 'AC' WHEN 1 THEN 'PS' END"
_SETTINGS = {
    "tracheostomy": "CASE event_id % 17 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END", "fio2_set": "CASE WHEN event_type = 'click' THEN value END", "lpm_set": "CASE WHEN event_type = 'view' THEN value / 10 END",
    "peep_set": "CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 4 AS DOUBLE) END", "tidal_volume_set": "CASE WHEN event_id % 5 > 0 THEN value * 5 END", "resp_rate_set": "CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 23 AS DOUBLE) END",
    "resp_rate_obs": "CASE WHEN event_type = 'error' THEN value END", "pressure_support_set": "CASE WHEN event_id % 6 > 1 THEN CAST(event_id % 5 AS DOUBLE) END", "peak_inspiratory_pressure_set": "CASE WHEN event_id % 4 > 1 THEN CAST(event_id % 11 AS DOUBLE) END",
}
_TEXTS = {"device_category": _DEVICE, "device_name": _NAME, "mode_category": _MODE, "mode_name": _MODE_NAME}


def _support(spark, d):
    e = table(spark, d, "events")
    return e.select(F.expr("user_id div 2").alias("hospitalization_id"), F.date_trunc("hour", "ts").alias("recorded_dttm"), *(F.expr(x).alias(c) for c, x in (_TEXTS | _SETTINGS).items()))


def _waterfall_sql() -> str:
    texts, numbers = list(_TEXTS), list(_SETTINGS)
    every = [*texts, *numbers]
    key, by = "hospitalization_id", ", ".join(["recorded_dttm", *every])
    w = f"PARTITION BY {key} ORDER BY {by}"
    fill = lambda c, *above: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY {', '.join([key, *above])} ORDER BY recorded_dttm, is_scaffold ROWS UNBOUNDED PRECEDING)"
    lag = lambda c: f"lag(coalesce({c}, 'missing')) OVER (PARTITION BY {key} ORDER BY recorded_dttm, is_scaffold)"
    steps, last, above = [], "f0", []
    for i, (column, number) in enumerate((("device_category", "device_cat_id"), ("device_name", "device_id"), ("mode_category", "mode_cat_id"), ("mode_name", "mode_name_id"))):
        steps.append(f"g{i} AS (SELECT * REPLACE ({fill(column, *above)} AS {column}) FROM {last})")
        steps.append(f"h{i} AS (SELECT *, {lag(column)} AS before FROM g{i})")
        steps.append(f"f{i + 1} AS (SELECT * EXCLUDE (before), CAST(sum(CASE WHEN before IS NULL OR before <> coalesce({column}, 'missing') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY recorded_dttm, is_scaffold ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {number} FROM h{i})")
        last, above = f"f{i + 1}", [number]
    settings = numbers[1:]
    most = lambda device, default: f"coalesce((SELECT device_name FROM s0 WHERE device_category = '{device}' AND device_name IS NOT NULL GROUP BY device_name ORDER BY count(*) DESC, device_name LIMIT 1), '{default}')"
    return f"""WITH raw AS (SELECT user_id // 2 AS {key}, date_trunc('hour', ts) AS recorded_dttm, {", ".join(f"{f'lower({x})' if c in texts else x} AS {c}" for c, x in (_TEXTS | _SETTINGS).items())} FROM events),
    s0 AS (SELECT * REPLACE (CASE WHEN (SELECT avg(fio2_set) FROM raw) > 1 AND fio2_set > 1 THEN fio2_set / 100 ELSE fio2_set END AS fio2_set) FROM raw),
    names AS (SELECT {most("imv", "ventilator")} AS vent, {most("nippv", "bipap")} AS mask),
    s1 AS (SELECT * EXCLUDE (g, vent, mask) REPLACE (CASE WHEN g THEN vent ELSE device_name END AS device_name, CASE WHEN g THEN 'imv' ELSE device_category END AS device_category)
        FROM (SELECT *, device_category IS NULL AND device_name IS NULL AND coalesce(regexp_matches(mode_category, 'assist control-volume control|simv|pressure control'), FALSE) AS g FROM s0), names),
    t2 AS (SELECT *, lag(device_category) OVER w AS a, lead(device_category) OVER w AS b FROM s1 WINDOW w AS ({w})),
    u2 AS (SELECT * EXCLUDE (a, b), device_category IS NULL AND (coalesce(a = 'imv', FALSE) OR coalesce(b = 'imv', FALSE)) AND coalesce(peep_set > 1, FALSE) AND coalesce(resp_rate_set > 1, FALSE) AND coalesce(tidal_volume_set > 1, FALSE) AS g FROM t2),
    s2 AS (SELECT * EXCLUDE (g, vent, mask) REPLACE (CASE WHEN g THEN vent ELSE device_name END AS device_name, CASE WHEN g THEN 'imv' ELSE device_category END AS device_category) FROM u2, names),
    t3 AS (SELECT *, lag(device_category) OVER w AS a, lead(device_category) OVER w AS b FROM s2 WINDOW w AS ({w})),
    u3 AS (SELECT * EXCLUDE (a, b), device_category IS NULL AND (coalesce(a = 'nippv', FALSE) OR coalesce(b = 'nippv', FALSE)) AND coalesce(peak_inspiratory_pressure_set > 1, FALSE) AND coalesce(pressure_support_set > 1, FALSE) AS g FROM t3),
    s3 AS (SELECT * EXCLUDE (g, vent, mask) REPLACE (CASE WHEN g AND device_name IS NULL THEN mask ELSE device_name END AS device_name, CASE WHEN g THEN 'nippv' ELSE device_category END AS device_category) FROM u3, names),
    s4 AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY {key}, recorded_dttm) AS n FROM s3) WHERE NOT (n > 1 AND coalesce(device_category = 'nippv', FALSE))),
    s5 AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY {key}, recorded_dttm) AS n FROM s4) WHERE NOT (n > 1 AND device_category IS NULL)),
    s6 AS (SELECT * REPLACE (CASE WHEN device_category = 'nasal cannula' AND peep_set > 0 THEN NULL ELSE device_category END AS device_category) FROM s5),
    s7 AS (SELECT *, FALSE AS is_scaffold FROM s6 WHERE {" OR ".join(f"{c} IS NOT NULL" for c in every)} QUALIFY row_number() OVER (PARTITION BY {key}, recorded_dttm ORDER BY {", ".join(every)}) = 1),
    hours AS (SELECT {key}, unnest(generate_series(date_trunc('hour', min(recorded_dttm)), date_trunc('hour', max(recorded_dttm)), INTERVAL 1 HOUR)) + INTERVAL 3599 SECOND AS recorded_dttm FROM raw GROUP BY {key}),
    f0 AS (SELECT * FROM s7 UNION ALL BY NAME SELECT *, TRUE AS is_scaffold FROM hours),
    {("," + chr(10) + "    ").join(steps)},
    k0 AS (SELECT *, device_name IS NOT NULL AND contains(device_name, 'trach') AS trach, coalesce(mode_category = 'pressure support/cpap', FALSE) AS pressure FROM f4),
    k1 AS (SELECT * REPLACE (CASE WHEN device_category = 'room air' AND fio2_set IS NULL THEN 0.21 ELSE fio2_set END AS fio2_set,
            CASE WHEN NOT ((pressure AND pressure_support_set IS NOT NULL) OR (mode_category IS NULL AND trach) OR (pressure AND trach)) THEN tidal_volume_set END AS tidal_volume_set),
        max(CASE WHEN device_category = 'trach collar' THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, mode_name_id) AS collar FROM k0),
    k2 AS (SELECT * REPLACE ({", ".join(f"CASE WHEN collar = 0 THEN {fill(c, 'mode_name_id')} END AS {c}" for c in settings)}, CASE WHEN mode_category IS NULL AND contains(coalesce(device_name, ''), 't-piece') THEN 'blow by' ELSE mode_category END AS mode_category,
        {fill("tracheostomy")} AS tracheostomy) FROM k1)
    SELECT DISTINCT * EXCLUDE (trach, pressure, collar) FROM k2"""


@query(_waterfall_sql())
def respiratory_waterfall(spark, d):
    return waterfall.waterfall(_support(spark, d))


# Sepsis surveillance: a user is a stay; (columns, rows of events) of each table, the same text for both engines.
_SEPSIS = {
    "medication_admin_intermittent": (
        [
            "user_id AS hospitalization_id",
            "ts AS admin_dttm",
            "CASE event_id % 4 WHEN 0 THEN 'vancomycin' WHEN 1 THEN 'cefepime' ELSE 'meropenem' END AS med_category",
            "CASE WHEN event_id % 5 < 2 THEN 'PO' ELSE 'IV' END AS med_route_category",
            "CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'CMS_sepsis_qualifying_antibiotics' END AS med_group",
        ],
        "event_id % 3 > 0",
    ),
    "microbiology_culture": (
        [
            "user_id AS hospitalization_id",
            "CASE WHEN event_id % 13 > 0 THEN ts END AS collect_dttm",
            "CASE WHEN event_id % 2 = 0 AND user_id % 7 > 0 THEN 'Blood_Buffy' ELSE 'urine' END AS fluid_category",
        ],
        "event_type = 'error'",
    ),
    "labs": (
        [
            "user_id AS hospitalization_id",
            "CASE event_id % 4 WHEN 0 THEN 'creatinine' WHEN 1 THEN 'bilirubin_total' WHEN 2 THEN 'platelet_count' ELSE 'lactate' END AS lab_category",
            "CASE WHEN event_id % 13 > 0 THEN CASE event_id % 4 WHEN 2 THEN value * 4 ELSE value / 20 END END AS lab_value_numeric",
            "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 9 AS VARCHAR(9)) ELSE 'x' END AS lab_value",
            "CASE WHEN event_id % 10 > 0 THEN ts END AS lab_result_dttm",
            "ts - INTERVAL '1' HOUR AS lab_order_dttm",
        ],
        "event_type IN ('view', 'purchase')",
    ),
    "medication_admin_continuous": (
        [
            "user_id AS hospitalization_id",
            "ts AS admin_dttm",
            "CASE event_id % 2 WHEN 0 THEN 'norepinephrine' ELSE 'vasopressin' END AS med_category",
            "value - 10 AS med_dose",
            "'Vasoactives' AS med_group",
        ],
        "event_type = 'signup'",
    ),
    "adt": (
        [
            "user_id AS hospitalization_id",
            "ts AS in_dttm",
            "ts + INTERVAL '9' HOUR AS out_dttm",
            "CASE event_id % 3 WHEN 0 THEN 'icu' WHEN 1 THEN 'Procedural' END AS location_category",
        ],
        "event_type = 'click'",
    ),
    "respiratory_support": (
        [
            "user_id AS hospitalization_id",
            "ts AS recorded_dttm",
            "CASE WHEN event_id % 3 = 0 THEN 'IMV' ELSE 'Nasal Cannula' END AS device_category",
        ],
        "event_type IN ('view', 'signup')",
    ),
    "hospital_diagnosis": (
        [
            "user_id AS hospitalization_id",
            "CASE WHEN user_id % 5 = 0 THEN 'N18.6' ELSE 'I10' END AS diagnosis_code",
        ],
        "event_type = 'view'",
    ),
}
_STAY = [
    "user_id AS hospitalization_id",
    "user_id AS patient_id",
    "min(ts) - INTERVAL '12' HOUR AS admission_dttm",
    "CASE WHEN user_id % 6 > 0 THEN max(ts) + INTERVAL '1' HOUR END AS discharge_dttm",
    "CASE user_id % 3 WHEN 0 THEN 'Expired' WHEN 1 THEN 'Home' ELSE 'hospice' END AS discharge_category",
]
_PATIENT = [
    "user_id AS patient_id",
    "CASE WHEN user_id % 4 = 0 THEN max(ts) END AS death_dttm",
]

_ORGANS = ["vasopressor_dttm", "imv_dttm", "aki_dttm", "hyperbilirubinemia_dttm", "thrombocytopenia_dttm"]
_CAUSES = {"blood_culture_dttm": "blood_culture", "first_qad_dttm": "first_qad", "vasopressor_dttm": "vasopressor", "imv_dttm": "imv", "aki_dttm": "aki", "hyperbilirubinemia_dttm": "hyperbilirubinemia", "thrombocytopenia_dttm": "thrombocytopenia", "lactate_dttm": "lactate"}


def _sepsis_sql() -> str:
    of = {t: f"(SELECT {', '.join(c)} FROM events WHERE {w})" for t, (c, w) in _SEPSIS.items()}
    with_lactate = list(_CAUSES)
    without = with_lactate[:-1]
    first = lambda names: "CASE " + " ".join(f"WHEN {n} = least({', '.join(names)}) THEN '{_CAUSES[n]}'" for n in names) + " END"
    signs = lambda s: f"""min(tm) FILTER (k = 'creatinine' AND esrd IS NULL AND v >= 2.0 * cr_{s}) AS aki_{s}, min(tm) FILTER (k = 'bilirubin_total' AND v >= 2.0 AND v >= 2.0 * bi_{s}) AS bili_{s},
        min(tm) FILTER (k = 'platelet_count' AND v < 100 AND v <= 0.5 * pl_{s}) AS plt_{s}"""  # noqa: E731
    base = lambda s: f"min(v) FILTER (k = 'creatinine') AS cr_{s}, min(v) FILTER (k = 'bilirubin_total') AS bi_{s}, max(v) FILTER (k = 'platelet_count' AND v >= 100) AS pl_{s}"
    names = lambda cond: f"string_agg(DISTINCT drug, ', ' ORDER BY drug) FILTER ({cond})"
    near = "abs(epoch_us({t}) - epoch_us(c.culture_time)) <= 2 * 86400000000"
    return f"""WITH RECURSIVE stays AS (SELECT {", ".join(_STAY)} FROM events GROUP BY user_id), patients AS (SELECT {", ".join(_PATIENT)} FROM events GROUP BY user_id),
    bc AS (SELECT hospitalization_id, collect_dttm AS culture_time, row_number() OVER (PARTITION BY hospitalization_id ORDER BY collect_dttm) AS bc_id, CAST(collect_dttm AS DATE) AS culture_day
        FROM (SELECT DISTINCT hospitalization_id, collect_dttm FROM {of["microbiology_culture"]} WHERE lower(fluid_category) = 'blood_buffy' AND collect_dttm IS NOT NULL)),
    given AS (SELECT hospitalization_id, CAST(admin_dttm AS DATE) AS day, CAST(lower(med_route_category) = 'iv' AS INTEGER) AS iv, CASE WHEN med_category = 'vancomycin' THEN CASE WHEN lower(med_route_category) = 'iv' THEN 'vancomycin_iv' ELSE 'vancomycin_oral' END ELSE med_category END AS drug
        FROM {of["medication_admin_intermittent"]} WHERE lower(med_group) = 'cms_sepsis_qualifying_antibiotics'),
    days AS (SELECT hospitalization_id, drug, day, max(iv) AS iv FROM given JOIN stays USING (hospitalization_id) WHERE CAST(day AS TIMESTAMP) BETWEEN admission_dttm AND discharge_dttm GROUP BY ALL),
    cut AS (SELECT *, sum(CASE WHEN p IS NULL OR day - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY hospitalization_id, drug ORDER BY day) AS course FROM (SELECT *, lag(day) OVER (PARTITION BY hospitalization_id, drug ORDER BY day) AS p FROM days)),
    courses AS (SELECT hospitalization_id, drug, course, min(day) AS first, max(day) AS last, arg_min(iv, day) AS first_iv FROM cut GROUP BY ALL),
    close AS (SELECT * FROM (SELECT *, min(first) FILTER (new) OVER (PARTITION BY hospitalization_id, bc_id) AS start FROM (SELECT *, abs(first - culture_day) <= 2 AS new FROM bc JOIN courses USING (hospitalization_id))) WHERE start IS NOT NULL),
    facts AS (SELECT hospitalization_id, bc_id, start, max(CAST(new AND first_iv = 1 AS INTEGER)) AS parenteral, {names("new")} AS anchors, {names("new AND first_iv = 1")} AS iv_anchors, {names("first >= start")} AS run_meds FROM close GROUP BY ALL),
    covered AS (SELECT DISTINCT hospitalization_id, bc_id, start, day FROM (SELECT *, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day FROM close WHERE first >= start) WHERE day - start BETWEEN 0 AND 6),
    runs AS (SELECT hospitalization_id, bc_id, count(*) AS n, min(day) AS a, max(day) AS b FROM (SELECT *, day - start - row_number() OVER (PARTITION BY hospitalization_id, bc_id ORDER BY day) + 1 AS off FROM covered) WHERE off = 0 GROUP BY ALL),
    qad AS (SELECT f.*, r.n, r.a, r.b, parenteral = 1 AND n >= 4 AS full_run, coalesce(n >= 1 AND parenteral = 1 AND discharge_category IN ('Expired', 'hospice') AND censor - start <= 3 AND b - censor >= -1, FALSE) AS excused
        FROM facts f JOIN runs r USING (hospitalization_id, bc_id) JOIN (SELECT hospitalization_id, discharge_category, CAST(coalesce(discharge_dttm, death_dttm) AS DATE) AS censor FROM stays LEFT JOIN patients USING (patient_id)) USING (hospitalization_id)),
    renal AS (SELECT DISTINCT hospitalization_id, 1 AS esrd FROM {of["hospital_diagnosis"]} WHERE lower(replace(diagnosis_code, '.', '')) = 'n186'),
    read AS (SELECT hospitalization_id, lab_category AS k, coalesce(lab_value_numeric, try_cast(lab_value AS DOUBLE)) AS v, coalesce(lab_result_dttm, lab_order_dttm) AS tm FROM {of["labs"]}),
    lab AS (SELECT * FROM read WHERE tm IS NOT NULL AND v <= CASE k WHEN 'creatinine' THEN 20 WHEN 'bilirubin_total' THEN 80 WHEN 'platelet_count' THEN 2000 ELSE 30 END AND hospitalization_id IN (SELECT hospitalization_id FROM bc)),
    nearby AS (SELECT l.*, bc_id FROM lab l JOIN bc c ON l.hospitalization_id = c.hospitalization_id AND abs(CAST(tm AS DATE) - culture_day) <= 2),
    co AS (SELECT hospitalization_id, {base("co")} FROM lab GROUP BY ALL), ho AS (SELECT hospitalization_id, bc_id, {base("ho")} FROM nearby GROUP BY ALL),
    organs AS (SELECT hospitalization_id, bc_id, {signs("co")}, {signs("ho")}, min(tm) FILTER (k = 'lactate' AND v >= 2.0) AS lactate_dttm
        FROM nearby JOIN co USING (hospitalization_id) JOIN ho USING (hospitalization_id, bc_id) LEFT JOIN renal USING (hospitalization_id) GROUP BY ALL),
    pressor AS (SELECT d.hospitalization_id, admin_dttm, med_category FROM {of["medication_admin_continuous"]} d LEFT JOIN {of["adt"]} a ON d.hospitalization_id = a.hospitalization_id AND admin_dttm >= in_dttm AND admin_dttm < out_dttm
        WHERE lower(med_group) = 'vasoactives' AND med_dose > 0 AND (in_dttm IS NULL OR location_category IS NULL OR lower(location_category) <> 'procedural')),
    pnew AS (SELECT * FROM pressor QUALIFY coalesce(CAST(admin_dttm AS DATE) - CAST(lag(admin_dttm) OVER (PARTITION BY hospitalization_id, med_category ORDER BY admin_dttm) AS DATE) > 1, TRUE)),
    drugs AS (SELECT hospitalization_id, bc_id, min(admin_dttm) AS vasopressor_dttm, arg_min(med_category, (admin_dttm, med_category)) AS vasopressor_name FROM pnew JOIN bc c USING (hospitalization_id) WHERE {near.format(t="admin_dttm")} GROUP BY ALL),
    tube AS (SELECT * FROM {of["respiratory_support"]} WHERE lower(device_category) = 'imv'),
    tnew AS (SELECT * FROM tube QUALIFY coalesce(CAST(recorded_dttm AS DATE) - CAST(lag(recorded_dttm) OVER (PARTITION BY hospitalization_id ORDER BY recorded_dttm) AS DATE) > 1, TRUE)),
    tubes AS (SELECT hospitalization_id, bc_id, min(recorded_dttm) AS imv_dttm FROM tnew JOIN bc c USING (hospitalization_id) WHERE {near.format(t="recorded_dttm")} GROUP BY ALL),
    joined AS (SELECT bc.hospitalization_id, bc.bc_id, culture_time AS blood_culture_dttm, admission_dttm, coalesce(CAST(full_run OR excused AS INTEGER), 0) AS presumed_infection, q.n AS total_qad, CAST(q.a AS TIMESTAMP) AS qad_start_date, CAST(q.b AS TIMESTAMP) AS qad_end_date,
            CASE WHEN parenteral = 1 THEN CAST(start AS TIMESTAMP) END AS first_qad_dttm, vasopressor_dttm, vasopressor_name, imv_dttm, CASE WHEN early THEN aki_co ELSE aki_ho END AS aki_dttm, CASE WHEN early THEN bili_co ELSE bili_ho END AS hyperbilirubinemia_dttm,
            CASE WHEN early THEN plt_co ELSE plt_ho END AS thrombocytopenia_dttm, lactate_dttm, coalesce(esrd, 0) AS has_esrd, anchors AS anchor_meds_in_window, iv_anchors AS anchor_parenteral_meds_in_window, run_meds,
            CASE WHEN full_run THEN 'Meets QAD (standard)' WHEN excused THEN 'Meets QAD (censoring exception)' WHEN parenteral = 0 THEN 'Fails QAD: no new IV/IM in window' WHEN parenteral = 1 THEN 'Fails QAD: insufficient QAD days' END AS final_qad_status
        FROM (SELECT bc.*, admission_dttm, CAST(culture_time AS DATE) - CAST(admission_dttm AS DATE) + 1 <= 2 AS early FROM bc JOIN stays USING (hospitalization_id)) bc
        LEFT JOIN qad q USING (hospitalization_id, bc_id) LEFT JOIN drugs USING (hospitalization_id, bc_id) LEFT JOIN tubes USING (hospitalization_id, bc_id) LEFT JOIN organs USING (hospitalization_id, bc_id) LEFT JOIN renal USING (hospitalization_id)),
    judged AS (SELECT *, CAST(presumed_infection = 1 AND coalesce({", ".join(_ORGANS)}, lactate_dttm) IS NOT NULL AS INTEGER) AS sepsis, CAST(presumed_infection = 1 AND coalesce({", ".join(_ORGANS)}) IS NOT NULL AS INTEGER) AS sepsis_wo_lactate,
            CASE WHEN presumed_infection = 1 THEN least(blood_culture_dttm, first_qad_dttm) END AS presumed_infection_onset_dttm, least({", ".join(with_lactate)}) AS ase_onset_w_lactate_dttm, {first(with_lactate)} AS ase_first_criteria_w_lactate,
            least({", ".join(without)}) AS ase_onset_wo_lactate_dttm, {first(without)} AS ase_first_criteria_wo_lactate FROM joined),
    typed AS (SELECT *, CASE WHEN ase_onset_w_lactate_dttm IS NULL THEN NULL WHEN CAST(ase_onset_w_lactate_dttm AS DATE) - CAST(admission_dttm AS DATE) + 1 <= 2 THEN 'community' ELSE 'hospital' END AS type FROM judged),
    ill AS (SELECT hospitalization_id, bc_id, type, ase_onset_w_lactate_dttm AS t, row_number() OVER (PARTITION BY hospitalization_id ORDER BY ase_onset_w_lactate_dttm, bc_id) AS n FROM typed WHERE sepsis = 1),
    walk AS (SELECT hospitalization_id, bc_id, n, t AS clock, TRUE AS keep FROM ill WHERE n = 1
        UNION ALL SELECT i.hospitalization_id, i.bc_id, i.n, CASE WHEN i.type <> 'hospital' OR floor((epoch_us(i.t) - epoch_us(w.clock)) / 86400000000) > 14 THEN i.t ELSE w.clock END, i.type <> 'hospital' OR floor((epoch_us(i.t) - epoch_us(w.clock)) / 86400000000) > 14
        FROM ill i JOIN walk w ON i.hospitalization_id = w.hospitalization_id AND i.n = w.n + 1),
    kept AS (SELECT * FROM typed WHERE sepsis = 0 OR (hospitalization_id, bc_id) IN (SELECT (hospitalization_id, bc_id) FROM walk WHERE keep)),
    with_cultures AS (SELECT *, CASE WHEN sepsis = 1 THEN row_number() OVER (PARTITION BY hospitalization_id, sepsis ORDER BY ase_onset_w_lactate_dttm, bc_id) END AS episode_id,
        CASE WHEN sepsis = 1 THEN NULL WHEN presumed_infection = 0 THEN 'no_presumed_infection' ELSE 'no_organ_dysfunction' END AS no_sepsis_reason FROM kept),
    bare AS (SELECT s.hospitalization_id, 0 AS presumed_infection, 0 AS sepsis, 0 AS sepsis_wo_lactate, 'no_blood_culture' AS no_sepsis_reason, vasopressor_dttm, vasopressor_name, imv_dttm, lactate_dttm, thrombocytopenia_dttm, hyperbilirubinemia_dttm, coalesce(esrd, 0) AS has_esrd FROM stays s
        LEFT JOIN (SELECT hospitalization_id, min(admin_dttm) AS vasopressor_dttm, arg_min(med_category, (admin_dttm, med_category)) AS vasopressor_name FROM pressor GROUP BY ALL) USING (hospitalization_id)
        LEFT JOIN (SELECT hospitalization_id, min(recorded_dttm) AS imv_dttm FROM tube GROUP BY ALL) USING (hospitalization_id)
        LEFT JOIN (SELECT hospitalization_id, min(tm) FILTER (k = 'lactate' AND v >= 2) AS lactate_dttm, min(tm) FILTER (k = 'platelet_count' AND v < 100) AS thrombocytopenia_dttm, min(tm) FILTER (k = 'bilirubin_total' AND v >= 2) AS hyperbilirubinemia_dttm FROM read GROUP BY ALL) USING (hospitalization_id)
        LEFT JOIN renal USING (hospitalization_id) WHERE s.hospitalization_id NOT IN (SELECT hospitalization_id FROM bc))
    SELECT {", ".join(sepsis.COLUMNS)} FROM (SELECT * EXCLUDE (admission_dttm) FROM with_cultures UNION ALL BY NAME SELECT * FROM bare)"""


@query(_sepsis_sql())
def sepsis_events(spark, d):
    e = table(spark, d, "events")
    t = {name: e.where(w).selectExpr(*c) for name, (c, w) in _SEPSIS.items()}
    of_user = lambda c: e.groupBy("user_id").agg(*(F.expr(x) for x in c if not x.startswith("user_id AS"))).withColumnRenamed("user_id", "hospitalization_id")
    stays = of_user(_STAY).withColumn("patient_id", F.col("hospitalization_id"))
    return sepsis.events(t | {"hospitalization": stays, "patient": of_user(_PATIENT).withColumnRenamed("hospitalization_id", "patient_id")})
