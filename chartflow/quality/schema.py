"""Schemas of tables and rules about them, from YAML or Python."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import types as T

KINDS = {
    "VARCHAR": (T.StringType,), "DATETIME": (T.TimestampType,), "DATE": (T.DateType,),
    "INT": (T.IntegerType, T.LongType, T.ShortType, T.ByteType), "INTEGER": (T.IntegerType, T.LongType, T.ShortType, T.ByteType),
    "DOUBLE": (T.DoubleType, T.FloatType, T.DecimalType), "FLOAT": (T.DoubleType, T.FloatType, T.DecimalType), "BOOLEAN": (T.BooleanType,),
}
SPARK = {"VARCHAR": "string", "DATETIME": "timestamp", "DATE": "date", "INT": "bigint", "INTEGER": "bigint", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean"}


@dataclass
class ColumnRule:
    name: str
    kind: str = "VARCHAR"
    required: bool = False
    category: bool = False
    values: list[str] = field(default_factory=list)
    nullable: bool = False
    allow_missing: bool = False


def one_of(column: str, values) -> str:
    """SQL: the column, in lower case, is one of the values."""
    listed = ", ".join("'" + str(v).lower().replace("'", "''") + "'" for v in (values if isinstance(values, list) else [values]))
    return f"lower({column}) IN ({listed})"


#: The category (and unit) that ranges of a value column go by.
RANGE_KEYS = {
    "lab_value_numeric": ["lab_category"], "vital_value": ["vital_category"], "numerical_value": ["assessment_category"], "med_dose": ["med_category", "med_dose_unit"], "sweep": ["device_category"], "flow": ["device_category"],
}


def range_rules(config: dict, table: str) -> list[tuple]:
    """(value column, key columns, rules) from tables -> table -> column -> [category -> [unit ->]] min and max."""
    out = []

    def walk(x: dict, path: tuple) -> list[tuple]:
        if "min" in x or "max" in x:
            return [(*path, x.get("min"), x.get("max"))]
        return [r for k, v in x.items() for r in walk(v, (*path, k))]

    for column, x in ((config.get("tables") or {}).get(table) or {}).items():
        keys = RANGE_KEYS.get(column, [])
        by_depth: dict[int, list] = {}
        for r in walk(x, ()):
            by_depth.setdefault(len(r) - 2, []).append(r)
        out += [(column, keys[:n], rules) for n, rules in by_depth.items()]
    return out


def load(path: str) -> dict:
    with open(path) as f:
        return yaml.safe_load(f)


@dataclass
class Schema:
    """Columns, keys, groups of categories, units, ranges and rules between columns of one table."""

    table: str
    columns: list[ColumnRule]
    keys: list[str] = field(default_factory=list)
    groups: dict[tuple[str, str], dict[str, str]] = field(default_factory=dict)  # (category column, group column) -> category -> group
    units: dict[str, list[str]] = field(default_factory=dict)  # category -> accepted units, the canonical one first
    unit_columns: tuple[str, str] | None = None
    ranges: list[tuple] = field(default_factory=list)  # (value column, key columns, [(key..., low, high)])
    order: list[tuple[str, str, bool]] = field(default_factory=list)  # (earlier, later, strict)
    conditions: list[tuple[str, str, str]] = field(default_factory=list)  # (name, SQL condition, column that must then have a value)
    plausible: list[tuple[str, str, str]] = field(default_factory=list)  # (name, SQL condition, SQL that must then hold)
    periods: tuple[list[str], str, str] | None = None
    time_column: str | None = None
    entity: str | None = None

    @classmethod
    def from_yaml(cls, path: str) -> Schema:
        with open(path) as f:
            t = yaml.safe_load(f)
        columns = [ColumnRule(c["name"], c.get("data_type", "VARCHAR"), bool(c.get("required")), bool(c.get("is_category_column")), list(c.get("permissible_values") or []), bool(c.get("nullable")), bool(c.get("allow_missing"))) for c in t["columns"]]
        out = cls(t["table_name"], columns, list(t.get("composite_keys") or []))
        names = [c.name for c in columns]
        for k, mapping in t.items():
            # <stem>_category_to_group_mapping: from the column <stem>_category to <stem>_group
            if k.endswith("_category_to_group_mapping") and isinstance(mapping, dict):
                stem = k.removesuffix("_category_to_group_mapping")
                pair = (f"{stem}_category", f"{stem}_group")
                if set(pair) <= set(names):
                    out.groups[pair] = {str(a): str(b) for a, b in mapping.items()}
        if units := t.get("lab_reference_units"):
            more = t.get("allowed_unit_variants") or {}
            each = lambda x: list(x) if isinstance(x, list) else [x]
            out.units = {k: [*each(u), *each(more.get(k) or [])] for k, u in units.items()}
            out.unit_columns = ("lab_category", "reference_unit")
        return out

    def with_rules(self, rules: dict) -> Schema:
        """Add the rules of this table from a rule file (conditional_requirements, chronological_order and so on)."""
        t, name = self.table, lambda r: r.get("description", "")
        for r in (rules.get("conditional_requirements") or {}).get(t, []):
            when = one_of(r["when_column"], r["when_value"])
            if "and_column" in r:
                when += " AND " + one_of(r["and_column"], r["and_value"])
            self.conditions += [(name(r), when, c) for c in r["then_required"]]
        self.order += [(r["earlier"], r["later"], bool(r.get("strict"))) for r in (rules.get("chronological_order") or {}).get(t, [])]
        for r in (rules.get("field_plausibility_rules") or {}).get(t, []):
            when = f"{r['when_column']} IS NOT NULL" if r.get("when_not_null") else f"NOT ({one_of(r['when_column'], r['when_not_value'])})"
            for c in r.get("then_null_or_absent", []):
                self.plausible.append((name(r), when, f"{c} IS NULL"))
            if "then_column" in r:
                self.plausible.append((name(r), when, f"NOT coalesce({one_of(r['then_column'], r['then_not_value'])}, false)"))
        if p := (rules.get("overlapping_periods") or {}).get(t):
            self.periods = ([p["entity_column"]], p["start_column"], p["end_column"])
        if not self.keys and (k := (rules.get("composite_keys") or {}).get(t)):
            self.keys = list(k["keys"])
        return self

    def with_ranges(self, config: dict) -> Schema:
        """Add the ranges of this table from an outlier file; see range_rules."""
        self.ranges += range_rules(config, self.table)
        return self

    def expected_checks(self) -> dict[str, int]:
        """How many atomic checks of each code the schema asks for."""
        have = {c.name for c in self.columns}
        return {
            "C.1": 1, "C.2": sum(c.required for c in self.columns), "C.3": len(self.columns), "C.4": sum(c.kind == "DATETIME" for c in self.columns), "C.5": sum(bool(c.category and c.values) for c in self.columns),
            "C.6": len(self.groups), "C.7": len(self.units), "K.1": sum(not c.nullable for c in self.columns), "K.2": sum(c in have for _, _, c in self.conditions), "K.3": sum(len(c.values) for c in self.columns if c.category),
            "P.1": len(self.order), "P.2": sum(len(r) for _, _, r in self.ranges), "P.3": len(self.plausible), "P.5": int(self.periods is not None), "P.7": int(bool(self.keys)),
        }

    def spark(self) -> T.StructType:
        """As a StructType; the rules of a column are in its metadata."""
        out = T.StructType()
        for c in self.columns:
            out.add(T.StructField(c.name, T._parse_datatype_string(SPARK[c.kind]), True, {"required": c.required, "category": c.category, "values": c.values}))
        return out
