"""Pieces of the comparison SQL that several queries share."""

from __future__ import annotations

from ..functions.text import WHITE_SPACE
from ..ontology import ENTITY_TYPES, QUALITY_SCHEMA, RELATIONS, UNTYPED

WS = "'" + WHITE_SPACE + "'"
_BLANK = "".join(c for c in WHITE_SPACE if not 28 <= ord(c) <= 31)


def names(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def s(x: str) -> str:
    return f"coalesce(trim({x}, {WS}), '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{_BLANK}]+', ' ', 'g'), {WS})"


def kind(x: str) -> str:
    return f"CASE WHEN {s(x)} = '' THEN '{UNTYPED}' ELSE {s(x)} END"


VALID = f"{s('subject')} <> '' AND {s('relation')} <> '' AND {s('object')} <> ''"


def ends(x: str, values) -> str:
    return f"regexp_matches({x}, '({'|'.join(values)})$')"


def node(name: str, type_: str) -> str:
    return f"CAST(to_json([{name}, {type_}]) AS VARCHAR)"


EDGES = f"""
v AS (SELECT {s('subject')} AS subject, {s('relation')} AS relation, {s('object')} AS object, {kind('subject_type')} AS st, {kind('object_type')} AS ot,
        {s('source_document_id')} AS doc, {s('source_text')} AS txt, coalesce(confidence, 0.72) AS confidence, id FROM triples WHERE {VALID}),
v2 AS (SELECT *, {node('subject', 'st')} AS source, {node('object', 'ot')} AS target FROM v),
nodes AS (SELECT source AS id, subject AS name, st AS type FROM v2 UNION SELECT target, object, ot FROM v2),
edges AS (SELECT source, target, relation, CAST(to_json([source, relation, target]) AS VARCHAR) AS id, least(1.0, min(confidence)) AS confidence,
        count(DISTINCT CASE WHEN doc <> '' OR txt <> '' THEN doc || chr(1) || txt END) AS n_evidence, min(id) AS first_pos FROM v2 GROUP BY source, target, relation),
degree AS (SELECT n.id, n.name, n.type, count(e.x) AS degree FROM nodes n LEFT JOIN
        (SELECT source AS x FROM edges UNION ALL SELECT target FROM edges WHERE source <> target) e ON e.x = n.id GROUP BY ALL)
"""

SYMPTOM_EDGES = """
sym AS (SELECT e.* FROM edges e JOIN nodes a ON a.id = e.source AND a.type = 'Disease' JOIN nodes b ON b.id = e.target AND b.type = 'Symptom' WHERE e.relation = 'HAS_SYMPTOM')
"""


def case_map(x: str, pairs: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


def resolve_type(x: str) -> str:
    x = f"trim({x}, {WS})"
    return f"coalesce({case_map(x, {t: t for t in ENTITY_TYPES})}, {case_map(x, {v: k for k, v in ENTITY_TYPES.items()})}, {case_map(f'upper({x})', {t.upper(): t for t in ENTITY_TYPES})})"


def resolve_relation(x: str) -> str:
    x = f"trim({x}, {WS})"
    return f"coalesce({case_map(x, {r: r for r in RELATIONS})}, {case_map(x, {v[0]: r for r, v in RELATIONS.items()})}, {case_map(f'upper({x})', {r: r for r in RELATIONS})})"


def fits(r: str, st: str, ot: str) -> str:
    tests = " ".join(f"WHEN '{name}' THEN ({st} IS NULL OR {st} IN {names(d)}) AND ({ot} IS NULL OR {ot} IN {names(g)})" for name, (_, d, g, _) in RELATIONS.items())
    return f"coalesce(CASE {r} {tests} ELSE false END, false)"


def mismatched(r: str, st: str, ot: str) -> str:
    tests = " ".join(f"WHEN '{name}' THEN {st} NOT IN {names(d)} OR {ot} NOT IN {names(g)}" for name, (d, g) in QUALITY_SCHEMA.items())
    return f"CASE {r} {tests} ELSE false END"
