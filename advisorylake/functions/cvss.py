"""CVSS vectors in text, v3.x base scores and the qualitative severity hint."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from advisorylake.functions.text import bind, find_all, strip

# Metric keys of the public CVSS v3 and v4 specifications.
METRICS_V3 = ["AV", "AC", "PR", "UI", "S", "C", "I", "A", "E", "RL", "RC", "CR", "IR", "AR",
              "MAV", "MAC", "MPR", "MUI", "MS", "MC", "MI", "MA"]
METRICS_V4 = ["AV", "AC", "AT", "PR", "UI", "VC", "VI", "VA", "SC", "SI", "SA", "E", "CR",
              "IR", "AR", "MAV", "MAC", "MAT", "MPR", "MUI", "MVC", "MVI", "MVA", "MSC",
              "MSI", "MSA", "S", "AU", "R", "V", "RE", "U"]
VECTOR = r"(?i)CVSS:(?:3\.[01]|4\.0)/[A-Z]+:[A-Z]+(?:/[A-Z]+:[A-Z]+)+"
_V3_TRIM = r"^CVSS:3\.[01](?:/(?:" + "|".join(METRICS_V3) + r"):[A-Z]+)+"
_V4_TRIM = r"^CVSS:4\.0(?:/(?:" + "|".join(METRICS_V4) + r"):[A-Z]+)+"
# Fixed value: allowed values per v3 metric.
_V3_VALID = (
    r"^CVSS:3\.[01](?:/(?:AV:[NALP]|AC:[LH]|PR:[NLH]|UI:[NR]|S:[UC]|[CIA]:[NLH]"
    r"|E:[XUPFH]|RL:[XOTWU]|RC:[XURC]|[CIA]R:[XLMH]|MAV:[XNALP]|MAC:[XLH]|MPR:[XNLH]"
    r"|MUI:[XNR]|MS:[XUC]|M[CIA]:[XNLH]))+$"
)
# Word -> letter for each base metric of a derived vector.
DERIVED_METRICS = [
    ("AV", "attack_vector", {"network": "N", "adjacent": "A", "local": "L", "physical": "P"}),
    ("AC", "attack_complexity", {"low": "L", "high": "H"}),
    ("PR", "privileges_required", {"none": "N", "low": "L", "high": "H"}),
    ("UI", "user_interaction", {"none": "N", "required": "R"}),
    ("S", "scope", {"unchanged": "U", "changed": "C"}),
    ("C", "confidentiality", {"none": "N", "low": "L", "high": "H"}),
    ("I", "integrity", {"none": "N", "low": "L", "high": "H"}),
    ("A", "availability", {"none": "N", "low": "L", "high": "H"}),
]
# Weight per vulnerability type, looked up exactly, then as a substring in
# this order.
TYPE_WEIGHTS = [
    ("rce", 4), ("remote code execution", 4), ("auth bypass", 3), ("authbypass", 3),
    ("sqli", 3), ("sql injection", 3), ("deserialization", 4), ("ssrf", 2), ("xss", 2),
    ("cross-site scripting", 2), ("csrf", 2), ("info leak", 1), ("dos", 2),
    ("denial of service", 2), ("privilege escalation", 3), ("lpe", 3),
]


def cvss_vectors_in_text(text: Column) -> Column:
    """Distinct vectors in order, each cut at the first unknown metric key."""
    trimmed = F.transform(
        F.transform(find_all(text, VECTOR), F.upper),
        lambda v: F.when(v.startswith("CVSS:4"), F.regexp_extract(v, _V4_TRIM, 0))
        .otherwise(F.regexp_extract(v, _V3_TRIM, 0)))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def vector_version(vector: Column) -> Column:
    return (F.when(vector.startswith("CVSS:4"), "4.0")
            .when(vector.startswith("CVSS:3.1"), "3.1")
            .when(vector.startswith("CVSS:3.0"), "3.0"))


def _metric(vector: Column, key: str, weights: dict[str, float]) -> Column:
    letter = F.regexp_extract(vector, f"/{key}:([A-Z])(?:/|$)", 1)
    out = None
    for value, weight in weights.items():
        branch = (letter == value, F.lit(float(weight)))
        out = F.when(*branch) if out is None else out.when(*branch)
    return out


def _round_up(x: Column) -> Column:
    return bind(F.round(x * 100000), lambda scaled: F.when(
        scaled % 10000 == 0, scaled / 100000.0).otherwise((F.floor(scaled / 10000) + 1) / 10.0))


def _is_valid_v3(v: Column) -> Column:
    keys = F.transform(F.split(v, "/"), lambda part: F.regexp_extract(part, "^([A-Z]+):", 1))
    return v.rlike(_V3_VALID) & (F.size(F.array_distinct(keys)) == F.size(keys))


def cvss3_base_score(vector: Column) -> Column:
    """Base score of a valid v3.0/v3.1 vector by the public FIRST formula, else null.

    Intermediate values are bound once; the formula reuses each of them several times.
    """
    v = F.upper(vector)
    changed = F.regexp_extract(v, "/S:([UC])(?:/|$)", 1) == "C"
    pr = F.when(changed, _metric(v, "PR", {"N": 0.85, "L": 0.68, "H": 0.5})).otherwise(
        _metric(v, "PR", {"N": 0.85, "L": 0.62, "H": 0.27}))
    ease = (8.22 * _metric(v, "AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2})
            * _metric(v, "AC", {"L": 0.77, "H": 0.44}) * pr
            * _metric(v, "UI", {"N": 0.85, "R": 0.62}))
    loss = {"H": 0.56, "L": 0.22, "N": 0.0}
    iss = 1 - (1 - _metric(v, "C", loss)) * (1 - _metric(v, "I", loss)) * (
        1 - _metric(v, "A", loss))
    has_scope = v.rlike("/S:[UC](?:/|$)")
    parts = F.struct(changed.alias("changed"), iss.alias("iss"), ease.alias("ease"))

    def with_impact(p: Column) -> Column:
        impact = F.when(p["changed"], 7.52 * (p["iss"] - 0.029)
                        - 3.25 * F.pow(p["iss"] - 0.02, F.lit(15.0))).otherwise(6.42 * p["iss"])
        return F.struct(p["changed"].alias("changed"), p["ease"].alias("ease"),
                        impact.alias("impact"))

    def final(p: Column) -> Column:
        total = (p["impact"] + p["ease"]) * F.when(p["changed"], 1.08).otherwise(1.0)
        return F.when(total.isNull(), None).when(p["impact"] <= 0, 0.0).otherwise(
            _round_up(F.least(total, F.lit(10.0))))

    return F.when(_is_valid_v3(v) & has_scope, bind(bind(parts, with_impact), final))


def cvss3_severity(score: Column) -> Column:
    return bind(score, lambda s: F.when(s == 0, "NONE").when(s < 4, "LOW").when(
        s < 7, "MEDIUM").when(s < 9, "HIGH").when(s <= 10, "CRITICAL"))


def vector_from_metrics(metrics: dict[str, Column]) -> Column:
    """v3.1 vector of the eight words; null as soon as one is missing or unknown."""
    parts = [F.lit("CVSS:3.1")]
    for key, name, letters in DERIVED_METRICS:
        table = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
        parts.append(F.concat(F.lit(f"/{key}:"), F.try_element_at(table, metrics[name])))
    return F.concat(*parts)


def severity_hint(vuln_type: Column, attack_vector: Column, has_public_poc: Column) -> Column:
    """Qualitative level from cheap proxies; null without type and vector."""
    key = F.lower(strip(vuln_type))
    weight = F.when(F.coalesce(vuln_type, F.lit("")) == "", 0)
    for known, value in TYPE_WEIGHTS:
        weight = weight.when(key == known, value)
    for known, value in TYPE_WEIGHTS:
        weight = weight.when(key.contains(known), value)
    weight = weight.otherwise(1)
    score = (weight
             + F.when(attack_vector == "network", 2).when(attack_vector == "adjacent", 1)
             .otherwise(0)
             + F.when(has_public_poc, 1).otherwise(0))
    label = (F.when(score >= 6, "likely-critical").when(score >= 4, "likely-high")
             .when(score >= 2, "likely-medium").otherwise("likely-low"))
    return F.when(F.concat_ws("", vuln_type, attack_vector) != "", label)
