"""Schemas, rules, ranges and vocabularies from YAML."""

import datetime as dt

import yaml

from chartflow.clinical import crosswalk
from chartflow.operators import ranges
from chartflow.quality import checks
from chartflow.quality.schema import Schema, load, range_rules

SCHEMA = """
table_name: adt
columns:
- {name: hospitalization_id, data_type: VARCHAR, required: true}
- {name: location_category, data_type: VARCHAR, is_category_column: true, permissible_values: [icu, ward]}
- {name: location_group, data_type: VARCHAR}
- {name: location_type, data_type: VARCHAR}
- {name: in_dttm, data_type: DATETIME}
- {name: out_dttm, data_type: DATETIME}
location_category_to_group_mapping: {icu: a, ward: b}
"""
RULES = """
conditional_requirements: {adt: [{when_column: location_category, when_value: [icu], then_required: [location_type], description: type of icu}]}
chronological_order: {adt: [{earlier: in_dttm, later: out_dttm, strict: true}]}
field_plausibility_rules: {adt: [{when_column: location_category, when_not_value: [icu], then_null_or_absent: [location_type], description: no type}]}
overlapping_periods: {adt: {entity_column: hospitalization_id, start_column: in_dttm, end_column: out_dttm}}
composite_keys: {adt: {keys: [hospitalization_id, in_dttm]}}
"""
RANGES = """
tables:
  vitals: {vital_value: {map: {min: 20, max: 200}, spo2: {min: 50, max: 100}}}
  hospitalization: {age_at_admission: {min: 0, max: 120}}
  doses: {med_dose: {a: {"mg/hr": {min: 0, max: 10}}}}
"""


def test_schema_and_rules(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(SCHEMA)
    s = Schema.from_yaml(str(tmp_path / "s.yaml")).with_rules(yaml.safe_load(RULES))
    assert s.keys == ["hospitalization_id", "in_dttm"] and s.groups == {("location_category", "location_group"): {"icu": "a", "ward": "b"}}
    assert s.spark()["location_category"].metadata["values"] == ["icu", "ward"]
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("1", "ICU", "a", None, t, t), ("2", "ward", "b", "x", t, None)], s.spark())
    by = {(f.code, f.column): f.metrics.get("bad") for fs in checks.full(df, s).values() for f in fs}
    assert (by["K.2", "location_type"], by["P.1", "in_dttm - out_dttm"], by["P.3", None]) == (1, 1, 1)
    assert s.expected_checks()["K.3"] == 2


def test_ranges(spark, tmp_path):
    (tmp_path / "r.yaml").write_text(RANGES)
    config = load(str(tmp_path / "r.yaml"))
    v = spark.createDataFrame([("map", 10.0), ("MAP", 200.0), ("spo2", 101.0), ("other", 9999.0), (None, 5.0)], "vital_category string, vital_value double")
    assert [r[0] for r in ranges.clean(v, range_rules(config, "vitals")).select("vital_value").collect()] == [None, 200.0, None, 9999.0, 5.0]
    h = spark.createDataFrame([(130.0,), (120.0,)], "age_at_admission double")
    assert [r[0] for r in ranges.clean(h, range_rules(config, "hospitalization")).collect()] == [None, 120.0]
    d = spark.createDataFrame([("a", "mg/hr", 11.0), ("a", "mg/min", 11.0)], "med_category string, med_dose_unit string, med_dose double")
    assert [r[2] for r in ranges.clean(d, range_rules(config, "doses")).collect()] == [None, 11.0]
    s = Schema("hospitalization", []).with_ranges(config)
    assert checks.numeric_ranges(h, s)[0].metrics["above"] == 1


def test_vocabularies(spark, tmp_path):
    (tmp_path / "v.yaml").write_text("renames: {labs: {lab_category: {old: new}}}\nunresolved: {labs: {lab_category: {gone: {candidates: []}}}}\n")
    v = crosswalk.Vocabulary.from_yaml(str(tmp_path / "v.yaml"), "labs")
    df = spark.createDataFrame([("old",), ("gone",), ("A b",)], "lab_category string")
    assert [r[0] for r in crosswalk.crosswalk(df, v).collect()] == ["new", "gone", "a_b"]
    own = spark.createDataFrame([("High Flow NC",), ("Face Mask",)], "device_category string")
    assert [r[0] for r in crosswalk.crosswalk(own, crosswalk.vocabulary_of("respiratory_support")).collect()] == ["hfnc", "face_mask"]
