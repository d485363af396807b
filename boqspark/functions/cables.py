"""Cable specs: spellings of one model, and the features that a spec names. Every function takes and returns Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_spec

# Spellings that stand for a cable model.
SPELLINGS = {
    "WDZA-YJY": ["WDZ-YJY-A", "WDZAYJY", "WDZA-YJY"],
    "WDZB-YJY": ["WDZ-YJY-B", "WDZBYJY", "WDZB-YJY"],
    "WDZC-YJY": ["WDZ-YJY-C", "WDZCYJY", "WDZC-YJY"],
    "WDZ-YJY": ["WDZ-YJY", "WDZYJY"],
    "ZRA-YJV": ["ZR-YJV-A", "ZRAYJV", "ZRA-YJV"],
    "ZRB-YJV": ["ZR-YJV-B", "ZRBYJV", "ZRB-YJV"],
    "ZRC-YJV": ["ZR-YJV-C", "ZRCYJV", "ZRC-YJV", "ZR-YJV"],
    "NH-YJV": ["NH-YJV", "NHYJV", "N-YJV"],
    "YJV22": ["YJV22", "YJV-22"],
    "YJV": ["YJV", "YJV-"],
    "YJY": ["YJY", "YJY-"],
}
# Marks of the retardant grades, tried in this order, and grades as they are written.
GRADES = [("A级", ["WDZA", "WDZ-A"]), ("B级", ["WDZB", "WDZ-B"]), ("C级", ["WDZ"]), ("A级", ["ZRA", "ZA-"]), ("B级", ["ZRB", "ZB-"]), ("C级", ["ZRC", "ZC-", "ZR"])]
XLPE, PVC, PE = "交联聚乙烯(XLPE)", "聚氯乙烯(PVC)", "聚乙烯(PE)"
CORES = r"(\d+)\*(\d+(?:\.\d+)?)(?:\+(\d+)\*(\d+(?:\.\d+)?))?"
# Points of a shared feature when two cables are compared; from LEAST_POINTS on they are taken as the same.
POINTS, LEAST_POINTS = {"section": 40, "cores": 30, "grade": 10, "fire": 5, "halogen_free": 5, "armoured": 5, "insulation": 5}, 60


def _first(text: Column, old: str, new: str) -> Column:
    """The text with the first place of old replaced."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(new), F.substr(text, at + len(old)))).otherwise(text)


def spec_aliases(spec: Column) -> Column:
    """All spellings of a spec: the canonical one, those with a model written as its family, and WDZA as WDZ-A."""
    s = canonical_spec(spec)
    out = [F.array(s)]
    for model, spellings in SPELLINGS.items():
        named = F.lit(False)
        for x in spellings:
            named = named | s.contains(x)
        out.append(F.when(named, F.array(*[_first(s, x, model) for x in spellings])).otherwise(F.array().cast("array<string>")))
    for x in ("A", "B", "C"):
        out.append(F.when(s.contains(f"WDZ{x}"), F.array(_first(s, f"WDZ{x}", f"WDZ-{x}"))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*out))


def cable_features(spec: Column) -> Column:
    """grade, fire, halogen_free, armoured, insulation, sheath, cores, section (main), total_section of a cable spec."""
    s = canonical_spec(spec)
    any_of = lambda xs: _or([s.contains(x) for x in xs])
    grade = F.lit(None).cast("string")
    for name, marks in reversed(GRADES):
        grade = F.when(any_of(marks), name).otherwise(grade)
    part = lambda i: F.nullif(F.regexp_extract(s, CORES, i), F.lit(""))
    number = lambda i: part(i).cast("double")
    crossed = any_of(["YJV", "YJY"])
    cores = F.concat(part(1), F.lit("×"), number(2).cast("string"), F.coalesce(F.concat(F.lit("+"), part(3), F.lit("×"), number(4).cast("string")), F.lit("")))
    return F.struct(
        grade.alias("grade"),
        any_of(["NH", "N-"]).alias("fire"),
        s.contains("WDZ").alias("halogen_free"),
        any_of(["22", "23"]).alias("armoured"),
        F.when(crossed, XLPE).when(any_of(["VV", "BV"]), PVC).alias("insulation"),
        F.when(s.contains("YJV"), PVC).when(s.contains("YJY"), PE).when(any_of(["VV", "BV"]), PVC).alias("sheath"),
        cores.alias("cores"),
        F.coalesce(number(2), F.lit(0.0)).alias("section"),
        (F.coalesce(number(1) * number(2), F.lit(0.0)) + F.coalesce(number(3) * number(4), F.lit(0.0))).alias("total_section"),
    )


def _or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def feature_score(a: Column, b: Column) -> Column:
    """Points that two cables share; text features only where they are known, sections only where they are over zero."""
    same = {
        "section": (F.abs(a["section"] - b["section"]) < 0.01) & (a["section"] > 0),
        "cores": a["cores"] == b["cores"], "grade": a["grade"] == b["grade"], "fire": a["fire"] == b["fire"], "halogen_free": a["halogen_free"] == b["halogen_free"],
        "armoured": a["armoured"] == b["armoured"], "insulation": a["insulation"] == b["insulation"],
    }
    total = F.lit(0)
    for name, points in POINTS.items():
        total = total + F.when(F.coalesce(same[name], F.lit(False)), points).otherwise(0)
    return total


def section_bucket(section: Column) -> Column:
    """Section group of a cable: up to 10, 16 to 50, 70 to 120, from 150; the sizes between belong to the smaller group."""
    return F.when(section <= 10, "<=10").when(section <= 50, "16-50").when(section <= 120, "70-120").otherwise(">=150")
