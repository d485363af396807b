"""Bill codes and grouping keys. Every function takes and returns Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import spec_of, squeezed

# Ten-digit codes that stand for nine-digit ones.
TEN_DIGITS = {"0302280006": "030228006", "0304130010": "030413010"}


def _clean(code: Column) -> Column:
    return F.trim(F.coalesce(code, F.lit("")))


def _n_digits(c: Column) -> Column:
    """Length of a text of digits, 0 for other texts."""
    return F.when(F.translate(c, "0123456789", "") == "", F.length(c)).otherwise(0)


def _other_codes(out: Column, c: Column, n: Column) -> Column:
    """Ten-digit codes that stand for others, Z keys in capitals, all else as it is."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in TEN_DIGITS.items() for x in kv]), c)
    return out.when(n == 10, F.coalesce(known, c)).when(F.substring(c, 1, 1).isin("z", "Z"), F.concat(F.lit("Z"), F.upper(F.trim(F.substr(c, F.lit(2)))))).otherwise(c)


def code_full(code: Column) -> Column:
    """The code as it counts: an eleven-digit one with its zero put back, a Z key in capitals, else as it is."""
    c = _clean(code)
    n = _n_digits(c)
    return _other_codes(F.when((n == 11) & ~c.startswith("0"), F.concat(F.lit("0"), c)), c, n)


def code9(code: Column) -> Column:
    """Nine digits, a Z key, or the code as it is."""
    c = _clean(code)
    n = _n_digits(c)
    nine = F.when(n == 12, F.substring(c, 1, 9)).when((n == 11) & ~c.startswith("0"), F.concat(F.lit("0"), F.substring(c, 1, 8)))
    return _other_codes(nine, c, n)


def is_code9(c: Column) -> Column:
    return _n_digits(c) == 9


def source_of(c9: Column, std_name: Column, std_spec: Column, dict_id: Column) -> Column:
    """Where the key of a line with this code9 comes from: dict, std, code or raw."""
    named = (F.coalesce(std_name, F.lit("")) != "") & (F.coalesce(std_spec, F.lit("")) != "")
    return F.when(F.coalesce(dict_id, F.lit(0)) != 0, "dict").when(named, "std").when(c9.startswith("Z") | is_code9(c9), "code").otherwise("raw")


def key_of(source: Column, c9: Column, name: Column, feature: Column, unit: Column, std_name: Column, std_spec: Column, dict_id: Column, version: Column) -> Column:
    ver = F.coalesce(version, F.lit("unknown"))
    join = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    empty = F.lit("")
    return (
        F.when(source == "dict", join("dict:", dict_id.cast("string"), "|", unit))
        .when(source == "std", join("std:", std_name, "|", std_spec, "|", unit))
        .when(c9.startswith("Z"), join("code:2024:", c9, "|", unit))
        .when(source == "code", join("code:", ver, ":", c9, "|", unit))
        .otherwise(join("raw:", ver, ":", squeezed(F.coalesce(name, empty)), "|", squeezed(F.coalesce(feature, empty)), "|", unit))
    )


def match_source(code: Column, std_name: Column, std_spec: Column, dict_id: Column) -> Column:
    return source_of(code9(code), std_name, std_spec, dict_id)


def match_key(code: Column, name: Column, feature: Column, unit: Column, std_name: Column, std_spec: Column, dict_id: Column, version: Column) -> Column:
    c9 = code9(code)
    return key_of(source_of(c9, std_name, std_spec, dict_id), c9, name, feature, unit, std_name, std_spec, dict_id, version)


def aggregate_id(key: Column, source: Column, std_spec: Column, feature: Column) -> Column:
    """The key; for dictionary rows with the spec as one more part."""
    spec = F.coalesce(F.when(F.coalesce(std_spec, F.lit("")) != "", std_spec), spec_of(feature))
    return F.when((source == "dict") & (spec != ""), F.concat(key, F.lit("|"), spec)).otherwise(key)


def with_keys(df):
    """Rows of a bill with unit_std, code9, match_key, match_key_source and aggregate_id.

    One step for each, every step on the columns of the one before: the code of a line is worked out once.
    """
    c = F.col
    from .text import unit_std

    df = df.withColumns({"unit_std": unit_std(c("unit")), "code9": code9(c("item_code"))})
    df = df.withColumn("match_key_source", source_of(c("code9"), c("std_name"), c("std_spec"), c("material_dict_id")))
    df = df.withColumn("match_key", key_of(c("match_key_source"), c("code9"), *map(c, ("item_name", "item_feature", "unit_std", "std_name", "std_spec", "material_dict_id", "item_code_version"))))
    return df.withColumn("aggregate_id", aggregate_id(c("match_key"), c("match_key_source"), c("std_spec"), c("item_feature")))


# Majors by the first two digits of a code.
MAJORS = {"03": "安装工程", "04": "市政工程", "01": "房屋建筑", "05": "园林绿化"}
OTHER_MAJOR = "其他"
# Six-digit prefixes of each edition by section of the standard, and the family of a section.
SECTIONS = {
    "2024": {
        "电气设备安装工程": ["030409", "030411"],
        "工业管道工程": ["031001", "031002", "031003", "031004", "031005", "031006", "031007", "031008"],
        "给排水、采暖、燃气工程": ["031009", "031010", "031011", "031012", "031013"],
        "消防工程": ["030901", "030902", "030903", "030904"],
        "通风空调工程": ["030701", "030702", "030703"],
        "建筑智能化工程": ["030501", "030502", "030503", "030504"],
        "通信设备及线路工程": ["030601", "030602", "030603"],
    },
    "2013": {
        "电气设备安装工程": ["030408", "030411"],
        "工业管道工程": ["030801", "030802", "030803", "030804"],
        "给排水、采暖、燃气工程": ["031001", "031002", "031003", "031004"],
        "消防工程": ["030901", "030902", "030903"],
        "通风空调工程": ["030701", "030702"],
        "建筑智能化工程": ["030501", "030502", "030503"],
    },
}
SECTION_FAMILIES = {
    "工业管道工程": "管道", "给排水、采暖、燃气工程": "管道", "消防工程": "管道", "通风空调工程": "管道", "热力设备安装工程": "管道",
    "电气设备安装工程": "电线电缆", "建筑智能化工程": "电线电缆", "通信设备及线路工程": "电线电缆",
}


def _choice(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def major(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_choice(MAJORS), F.substring(code, 1, 2)), F.lit(OTHER_MAJOR))


def section_of(code: Column, version: Column) -> Column:
    """Section of the standard by prefix; an unknown edition tries the newer one first."""
    six = F.substring(code, 1, 6)
    by = {v: F.try_element_at(_choice({p: name for name, ps in sections.items() for p in ps}), six) for v, sections in SECTIONS.items()}
    return F.when(version == "2024", by["2024"]).when(version == "2013", by["2013"]).otherwise(F.coalesce(by["2024"], by["2013"]))


def big_family(code: Column, version: Column) -> Column:
    """Family of the section of a code; null for sections without price analysis."""
    return F.try_element_at(_choice(SECTION_FAMILIES), section_of(code, version))


def material_family(section: Column) -> Column:
    return F.try_element_at(_choice(SECTION_FAMILIES), section)
