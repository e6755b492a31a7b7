"""Comorbidity indices from diagnosis codes."""

from __future__ import annotations

import os
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import prefix


@dataclass(frozen=True)
class Index:
    """Prefix rules, weights and (severe, mild) pairs of an index."""

    conditions: dict[str, list[str]]
    weights: dict[str, int]
    hierarchies: tuple[tuple[str, str], ...] = ()

    @classmethod
    def published(cls, path: str) -> Index:
        """An index from one of the files in ``codes``: conditions, weights, hierarchies."""
        with open(path) as f:
            t = yaml.safe_load(f)
        return cls(t["conditions"], t["weights"], tuple((severe, mild) for severe, mild in t["hierarchies"]))

    @classmethod
    def from_yaml(cls, path: str, codes: str = "ICD10CM") -> Index:
        """An index as published in a file: diagnosis_code_mappings, weights, hierarchies."""
        with open(path) as f:
            t = yaml.safe_load(f)
        pairs = tuple((h[0], mild) for h in (t.get("hierarchies") or {}).values() for mild in h[1:])
        return cls({k: v["codes"] for k, v in t["diagnosis_code_mappings"][codes].items()}, t["weights"], pairs)


CODES = os.path.join(os.path.dirname(__file__), "codes")
CHARLSON = Index.published(os.path.join(CODES, "charlson.yaml"))
ELIXHAUSER = Index.published(os.path.join(CODES, "elixhauser.yaml"))


def index(diagnoses: DataFrame, definition: Index, name: str, *, key: str = "hospitalization_id", hierarchy: bool = True) -> DataFrame:
    """key, a 0/1 column for each condition, and the weighted sum under the given name.

    Only codes whose format is ICD-10-CM count; a key without any is absent.
    """
    rows = diagnoses.where(F.lower("diagnosis_code_format") == "icd10cm")
    flags = prefix.flags(rows, [key], scalars.clean_code(F.col("diagnosis_code")), definition.conditions, definition.hierarchies if hierarchy else ())
    return flags.withColumn(name, prefix.weighted_sum(definition.weights))


def charlson(diagnoses: DataFrame, **options) -> DataFrame:
    return index(diagnoses, CHARLSON, "cci_score", **options)


def elixhauser(diagnoses: DataFrame, definition: Index = ELIXHAUSER, **options) -> DataFrame:
    return index(diagnoses, definition, "elix_score", **options)
