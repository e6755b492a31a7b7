"""Flags of drug resistance for each culture and organism."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals


@dataclass(frozen=True)
class Organism:
    groups: dict[str, list[str]]
    required: list[str]
    resistant: tuple[str, ...] = ("non_susceptible", "intermediate")
    min_groups: int = 3
    max_susceptible: int = 2

    @property
    def agents(self) -> list[str]:
        return [a for g in self.groups.values() for a in g]


# Agents by group for the one organism that is defined.
ORGANISMS = {
    "pseudomonas_aeruginosa": Organism(
        {
            "aminoglycosides": ["gentamicin", "tobramycin", "amikacin"],
            "antipseudomonal_carbapenems": ["meropenem"],
            "antipseudomonal_cephalosporins": ["ceftazidime", "cefepime"],
            "antipseudomonal_fluoroquinolones": ["ciprofloxacin", "levofloxacin"],
            "antipseudomonal_penicillins_beta_lactamase_inhibitors": ["piperacillin_tazobactam"],
            "monobactams": ["aztreonam"],
            "phosphonic_acids": ["fosfomycin"],
            "polymyxins": ["colistin"],
        },
        ["piperacillin_tazobactam", "ceftazidime", "cefepime", "aztreonam", "meropenem", "ciprofloxacin", "levofloxacin"],
    )
}
WORST_FIRST = ["non_susceptible", "intermediate", "susceptible", "NA"]


def flags(cultures: DataFrame, susceptibility: DataFrame, organism: str, *, organisms: dict[str, Organism] = ORGANISMS, cohort: DataFrame | None = None) -> DataFrame:
    """Per hospitalization and organism: worst result of each agent, whether each group is resistant, MDR, XDR, PDR and DTR.

    cohort (hospitalization_id, start_time, end_time) keeps cultures collected
    inside its windows.  Agents never tested read not_tested.
    """
    if organism not in organisms:
        raise ValueError(f"{organism} is none of {sorted(organisms)}")
    o = organisms[organism]
    keys = ["hospitalization_id", "organism_id"]
    rows = cultures.where(F.col("organism_category") == organism)
    if cohort is not None:
        rows = intervals.interval_join(rows, cohort.select("hospitalization_id", "start_time", "end_time"), ["hospitalization_id"], "collect_dttm", "start_time", "end_time")
    # Results of an organism are one bit for each agent and category, so tests are reduced to a few numbers before
    # they meet cultures: nothing sorts them, and a task keeps no lists.
    agents = list(dict.fromkeys([*o.agents, *o.required]))
    agent, category = F.col("antimicrobial_category"), F.col("susceptibility_category")
    bits = len(WORST_FIRST) + 2  # then null, then any other category
    rank = F.when(category.isNull(), bits - 2).otherwise(F.coalesce(F.array_position(F.array(*map(F.lit, WORST_FIRST)), category) - 1, F.lit(-1)))
    rank = F.when(rank < 0, bits - 1).otherwise(rank).cast("int")
    tests = susceptibility.where(agent.isin(agents)).select("organism_id", agent, category, rank.alias("_rank"))
    a_word = 63 // bits
    words = [agents[i : i + a_word] for i in range(0, len(agents), a_word)]
    bit = lambda part: F.when(agent.isin(part), F.call_function("shiftleft", F.lit(1).cast("long"), (F.coalesce(*(F.when(agent == x, bits * i) for i, x in enumerate(part))) + F.col("_rank")).cast("int")))
    found = tests.groupBy("organism_id").agg(*(F.bit_or(bit(part)).alias(f"_found{i}") for i, part in enumerate(words)))
    others = tests.where(F.col("_rank") == bits - 1).groupBy("organism_id").agg(*(F.min(F.when(agent == x, category)).alias(f"_other{i}") for i, x in enumerate(agents)))
    out = rows.select(*keys).distinct().join(found, "organism_id", "left").join(others, "organism_id", "left")
    worst = {}
    for i, x in enumerate(agents):
        has = lambda r, i=i: F.col(f"_found{i // a_word}").bitwiseAND(F.lit(1 << (i % a_word * bits + r))) != 0
        named = F.when(has(0), WORST_FIRST[0])
        for r, c in enumerate(WORST_FIRST[1:], 1):
            named = named.when(has(r), c)
        worst[x] = named.when(has(bits - 2), None).otherwise(F.col(f"_other{i}"))
    out = out.select(*keys, *(F.coalesce(worst[x], F.lit("not_tested")).alias(x) for x in o.agents), *(F.coalesce(worst[x].isin(list(o.resistant)), F.lit(False)).alias(f"_bad{i}") for i, x in enumerate(agents)))
    bad = {x: F.col(f"_bad{i}") for i, x in enumerate(agents)}
    every = lambda want: reduce(and_, (bad[x] for x in want), F.lit(True))
    out = out.withColumns({g: reduce(or_, (bad[x] for x in a), F.lit(False)).cast("int") for g, a in o.groups.items()})
    n = F.lit(0)
    for g in o.groups:
        n = n + F.col(g)
    out = out.withColumn("n_resistant_groups", n)
    out = out.withColumns({"MDR": (F.col("n_resistant_groups") >= o.min_groups).cast("int"), "XDR": (F.col("n_resistant_groups") >= len(o.groups) - o.max_susceptible).cast("int"), "PDR": every(o.agents).cast("int"), "DTR": every(o.required).cast("int")})
    return out.drop(*(f"_bad{i}" for i in range(len(agents))))


def missing_agents(susceptibility: DataFrame, organism: str, organisms: dict[str, Organism] = ORGANISMS) -> list[str]:
    """Agents of the definition that the data never hold."""
    have = {r[0] for r in susceptibility.where(F.col("antimicrobial_category").isin(organisms[organism].agents)).select("antimicrobial_category").distinct().collect()}
    return sorted(set(organisms[organism].agents) - have)
