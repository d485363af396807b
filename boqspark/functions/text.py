"""Text columns: headers, units, numbers, names. Every function takes and returns Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of each standard unit.
UNITS = {
    "m": ["米", "m", "米(m)", "延米", "延长米"],
    "kg": ["千克", "kg", "公斤"],
    "t": ["吨", "t"],
    "㎡": ["平方米", "平米", "m2", "m²"],
    "m³": ["立方米", "立方", "m3", "m³"],
    "台": ["台"],
    "套": ["套"],
    "个": ["个"],
    "组": ["组"],
    "块": ["块"],
    "根": ["根"],
    "处": ["处"],
}
# Header aliases of the canonical fields.
ALIASES = {
    "item_code": ["项目编码", "编码", "清单编码", "清单编号", "项目编号", "item_code", "code"],
    "item_name": ["项目名称", "名称", "清单名称", "分项名称", "项目", "item_name", "name", "description"],
    "item_feature": ["项目特征", "特征", "特征描述", "项目特征描述", "规格及特征", "规格型号", "规格型号/项目特征", "feature"],
    "unit": ["计量单位", "单位", "工程量单位", "unit", "uom"],
    "quantity": ["工程量", "数量", "工程数量", "qty", "quantity"],
    "unit_rate": ["综合单价", "单价", "清单单价", "综合单价(元)", "unit_price", "rate"],
    "total": ["合价", "金额", "合价(元)", "total", "amount"],
    "provisional_sum": ["暂估价", "暂列金额", "暂估价合计", "其中:暂估价", "provisional"],
    "project_name": ["工程名称", "工程", "单项工程", "项目名称(工程)", "project"],
    "sub_division": ["子分部", "分部", "分项", "分部工程", "sub_division"],
    "ordinal": ["序号", "行号", "顺序号", "编号", "no", "seq"],
    "source_path": ["来源路径", "路径", "文件", "source_path"],
}
# Symbols of dictionary units, tried in this order where a unit only contains one.
UNIT_SYMBOLS = {
    "立方米": "m³", "立方": "m³", "方": "m³", "平方米": "m²", "平方": "m²", "平米": "m²", "米": "m", "公尺": "m", "千米": "km", "公里": "km",
    "厘米": "cm", "公分": "cm", "毫米": "mm", "公厘": "mm", "千克": "kg", "公斤": "kg", "克": "g", "毫克": "mg", "吨": "t", "升": "L", "公升": "L",
    "毫升": "mL", "公撮": "mL", "千瓦时": "kWh", "度": "kWh", "瓦": "W", "千瓦": "kW", "米/平方米": "m/m²",
}
# Units of the dictionary that mean the same.
UNIT_WORDS = {
    "平米": "平方米", "平方": "平方米", "㎡": "平方米", "m2": "平方米", "立方": "立方米", "m3": "立方米", "㎥": "立方米", "公斤": "千克", "kg": "千克",
    "KM": "千米", "km": "千米", "公分": "厘米", "cm": "厘米", "公厘": "毫米", "mm": "毫米",
}
# Material words and spec forms that are read from feature texts.
MATERIALS = [
    "圆钢", "螺纹钢", "角钢", "扁钢", "工字钢", "槽钢", "钢板", "钢管", "不锈钢", "镀锌", "铝合金", "铜", "铝", "铸铁", "铸钢",
    "水泥", "混凝土", "砂浆", "砂", "石子", "碎石", "卵石", "砖", "砌块", "瓦", "石灰", "石膏", "木材", "木板", "胶合板", "密度板", "刨花板",
    "玻璃", "瓷砖", "陶瓷", "大理石", "花岗石", "石材", "电缆", "电线", "导线", "母线", "桥架", "配电箱", "开关", "插座", "灯具",
    "阀门", "法兰", "弯头", "三通", "四通", "管件", "管道", "螺栓", "螺母", "螺钉", "铆钉", "焊条", "焊丝",
    "油漆", "涂料", "防腐", "防火", "防水", "保温", "隔热", "塑料", "橡胶", "PVC", "PE", "PPR", "HDPE", "沥青", "油毡", "卷材", "密封胶", "胶粘剂",
]
SPEC_FORMS = [
    r"Φ\s*\d+(?:\.\d+)?", r"φ\s*\d+(?:\.\d+)?", r"DN\s*\d+", r"dn\s*\d+", r"\d+\s*\*\s*\d+(?:\s*\*\s*\d+)?", r"\d+\s*×\s*\d+(?:\s*×\s*\d+)?",
    r"Q\d+", r"\d+#", r"\d+\s*mm", r"\d+\s*cm", r"\d+\s*m\b", r"[A-Z]+\d+",
]
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def half_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def squeezed(c: Column) -> Column:
    """Half width, lower case, no white space."""
    return F.regexp_replace(F.lower(half_width(c)), r"(?U)\s+", "")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def unit_std(c: Column) -> Column:
    """Standard unit; unknown ones squeezed; null or blank: empty."""
    known = _map({v: std for std, spellings in UNITS.items() for v in spellings})
    norm = squeezed(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(known, norm), norm)


def unit_unknown(c: Column) -> Column:
    norm = squeezed(F.coalesce(c, F.lit("")))
    return (norm != "") & ~norm.isin(*{v for s in UNITS.values() for v in s})


def parsed_number(c: Column) -> Column:
    """Decimal of a text with separators and currency signs; null if it is none."""
    return F.translate(F.trim(c), ",￥¥", "").try_cast("decimal(16,6)")


def is_summary(c: Column) -> Column:
    return F.coalesce(c.rlike("合计|总计|小计|求和|总结"), F.lit(False))


def spec_of(feature: Column) -> Column:
    """First three different labelled specs of a feature text, joined by |."""
    found = F.regexp_extract_all(F.coalesce(feature, F.lit("")), F.lit(r"(?:规格型号|规格|型号|截面|线径|管径)[:：]\s*([^;；,，\n]{1,60})"), 1)
    clean = F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))
    return F.array_join(F.slice(clean, 1, 3), "|")


def canonical_spec(c: Column) -> Column:
    """Upper case, one multiplication sign, one diameter sign, plain brackets, no spaces."""
    s = F.translate(F.upper(F.coalesce(c, F.lit(""))), "×X（）φ", "**()Φ")
    return F.regexp_replace(s, r"(?U)\s+", "")


def clean_name(c: Column) -> Column:
    s = F.translate(F.trim(F.coalesce(c, F.lit(""))), "（）", "()")
    return F.regexp_replace(s, r"[\x00-\x1f\x7f-\x9f]", "")


def clean_spec(c: Column) -> Column:
    """Capital diameter sign, × between numbers."""
    return F.regexp_replace(F.translate(F.trim(F.coalesce(c, F.lit(""))), "φ", "Φ"), r"(?U)(\d)\s*[xX]\s*(?=\d)", "$1×")


def clean_unit(c: Column) -> Column:
    u = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(_map(UNIT_WORDS), u), u)


def unit_symbol(c: Column) -> Column:
    """Symbol of a dictionary unit: a unit as a whole, else the first unit word that it contains replaced."""
    u = F.trim(F.coalesce(c, F.lit("")))
    out = u
    for word, sign in reversed(UNIT_SYMBOLS.items()):
        out = F.when(u.contains(word), F.replace(u, F.lit(word), F.lit(sign))).otherwise(out)
    return F.coalesce(F.try_element_at(_map(UNIT_SYMBOLS), u), out)


def first_filled(*columns: Column) -> Column:
    """The first of several columns of one field that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def is_summary_exact(c: Column) -> Column:
    """The stricter test of the older path: the name is the word itself."""
    return F.trim(F.coalesce(c, F.lit(""))).isin("合计", "总计", "小计", "求和", "总结")


def project_features(c: Column) -> Column:
    """materials, specs: material words in a feature text, and pieces that have the form of a spec; each once."""
    t = F.coalesce(c, F.lit(""))
    words = F.filter(F.array(*[F.lit(w) for w in MATERIALS]), lambda w: F.contains(t, w))
    specs = F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(f"(?iU)({form})"), 1) for form in SPEC_FORMS]))
    return F.struct(words.alias("materials"), specs.alias("specs"))


def attributes(c: Column) -> Column:
    """Attributes of a JSON text that holds either an object or a list: a map; the entries of a list get their place as key."""
    obj = F.from_json(c, "map<string,string>")
    items = F.from_json(c, "array<string>")
    listed = F.map_from_entries(F.transform(items, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))))
    t = F.trim(F.coalesce(c, F.lit("")))
    m = F.when(t.startswith("{"), obj).when(t.startswith("["), listed)
    return F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != ""))


def month(c: Column) -> Column:
    """YYYY-MM; empty without a date."""
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit(""))


def status_label(std_name: Column, key_source: Column) -> Column:
    """What is shown of a line: standardised, code to be checked, or neither."""
    return F.when(F.coalesce(std_name, F.lit("")) != "", "已标准化").when(key_source.isin("code", "raw"), "编码待核").otherwise("未标准化")


def simple_name(c: Column) -> Column:
    """Without bracketed parts and closing words of work."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[(（][^)）]*[)）]", "")
    return F.trim(F.regexp_replace(F.replace(s, F.lit(" "), F.lit("")), "(制作安装|制作|安装|运输|采购|敷设|铺设)+$", ""))


def thousands(c: Column, digits: int = 2) -> Column:
    return F.format_number(c, digits)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "—").otherwise(F.concat(F.format_number(100 * F.try_divide(part, whole), 1), F.lit("%")))


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of the padded lower-case text."""
    padded = F.concat(F.lit("  "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
