"""Types and relations of the graph, as fixed values and as small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import WHITE_SPACE

# Entity types with their labels.
ENTITY_TYPES = {
    "Disease": "疾病",
    "Symptom": "症状",
    "Drug": "药物",
    "Treatment": "治疗方法",
    "Examination": "检查方法",
    "Department": "科室",
    "Population": "人群",
    "RiskFactor": "危险因素",
    "Complication": "并发症",
}
ANY = tuple(ENTITY_TYPES)
# Relation -> (label, domain, range, specificity).
RELATIONS = {
    "HAS_SYMPTOM": ("常见症状", ("Disease",), ("Symptom",), 5),
    "TREATED_BY": ("治疗", ("Disease",), ("Drug", "Treatment"), 6),
    "DIAGNOSED_BY": ("检查方法", ("Disease",), ("Examination",), 6),
    "HAS_RISK_FACTOR": ("病因", ("Disease",), ("RiskFactor",), 4),
    "HAS_SIDE_EFFECT": ("不良反应", ("Drug",), ("Symptom",), 5),
    "BELONGS_TO": ("所属科室", ("Disease",), ("Department",), 3),
    "HIGH_RISK_FOR": ("高危人群", ("Population",), ("Disease",), 4),
    "MAY_CAUSE": ("可致并发症", ("Disease",), ("Complication",), 4),
    "RELATED_TO": ("相关", ANY, ANY, 1),
}
# The quality score's own, different domains and ranges.
QUALITY_SCHEMA = {
    "HAS_SYMPTOM": (("Disease",), ("Symptom",)),
    "TREATED_BY": (("Disease",), ("Drug", "Treatment")),
    "DIAGNOSED_BY": (("Disease",), ("Examination",)),
    "MAY_CAUSE": (("Disease", "RiskFactor"), ("Disease", "Symptom", "Complication")),
    "HAS_RISK_FACTOR": (("Disease",), ("RiskFactor",)),
    "HAS_SIDE_EFFECT": (("Drug", "Treatment"), ("Symptom", "Complication")),
    "HIGH_RISK_FOR": (("Disease",), ("Population",)),
    "BELONGS_TO": (("Disease", "Drug", "Symptom", "Treatment"), ("Department",)),
}
UNTYPED = "未分类"


def relation_types(spark: SparkSession) -> DataFrame:
    rows = [(r, label, list(d), list(g), s, r == "RELATED_TO") for r, (label, d, g, s) in RELATIONS.items()]
    return spark.createDataFrame(rows, "relation string, label string, domain array<string>, range array<string>, specificity int, symmetric boolean")


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENTITY_TYPES.items()), "type string, label string")


def _lookup(value: Column, names: dict[str, str]) -> Column:
    """Exact id, then label, then id in any case; NULL where nothing fits."""
    v = F.btrim(value, F.lit(WHITE_SPACE))
    ids = F.create_map(*(F.lit(x) for n in names for x in (n.upper(), n)))
    labels = F.create_map(*(F.lit(x) for n, label in names.items() for x in (label, n)))
    return F.coalesce(F.when(v.isin(*names), v), F.try_element_at(labels, v), F.try_element_at(ids, F.upper(v)))


def resolve_type(value: Column) -> Column:
    return _lookup(value, ENTITY_TYPES)


def resolve_relation(value: Column) -> Column:
    return _lookup(value, {r: x[0] for r, x in RELATIONS.items()})


def _label(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), _lookup(value, names)), value)


def type_label(value: Column) -> Column:
    return _label(value, ENTITY_TYPES)


def relation_label(value: Column) -> Column:
    return _label(value, {r: x[0] for r, x in RELATIONS.items()})


def specificity(relation: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for r, v in RELATIONS.items() for x in (r, v[3]))), relation), F.lit(0))


def fits(relation: Column, subject_type: Column, object_type: Column) -> Column:
    """The relation resolves, and each given and resolvable type lies in its domain or range."""
    r, s, o = resolve_relation(relation), resolve_type(subject_type), resolve_type(object_type)
    ok = F.lit(False)
    for name, (_, domain, rng, _) in RELATIONS.items():
        ok = F.when(r == name, (s.isNull() | s.isin(*domain)) & (o.isNull() | o.isin(*rng))).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def mismatched(relation: Column, subject_type: Column, object_type: Column) -> Column:
    """By the quality schema; relations it does not list never mismatch."""
    bad = F.lit(False)
    for name, (domain, rng) in QUALITY_SCHEMA.items():
        bad = F.when(relation == name, ~subject_type.isin(*domain) | ~object_type.isin(*rng)).otherwise(bad)
    return bad
