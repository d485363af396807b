"""Material families and specs of bill lines by code prefix and by text, and the edition of the code standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Six-digit prefixes per edition, their family and excluded nine-digit codes.
PREFIXES = [
    ("2013", "030408", "电线电缆", ("030408006", "030408007")),
    ("2013", "030412", "配管配线", ("030412003",)),
    ("2013", "010515", "钢筋", ()),
    ("2013", "010502", "混凝土", ()),
    ("2024", "030409", "电线电缆", ("030409003", "030409004", "030409005")),
    ("2024", "030412", "配管配线", ("030412003",)),
    ("2024", "031001", "管道", ("031001010",)),
    ("2024", "010506", "钢筋", ()),
    ("2024", "010502", "混凝土", ()),
]
# Material type of each family, and what a family without a readable spec is called.
MATERIAL_TYPES = {"电线电缆": "电力电缆", "钢筋": "钢筋", "混凝土": "普通混凝土", "水泥": "水泥", "管道": "管道", "配管配线": "配管"}
UNREAD = {"电线电缆": "电线电缆(未识别)", "管道": "管道(未识别)", "配管配线": "配管(未识别)"}
# Patterns of cable models in the order in which they are tried, with the model's name.
CABLE_MODELS = [
    ("BTLY|NG-A|BTTW|矿物绝缘|矿物电缆", "BTLY"),
    ("BPGGP|BPGGR|YGGP|YGGR|硅橡胶", "BPGGP"),
    ("KVVP2?|KVV|KVVR|控制电缆", "KVV"),
    ("WDZ[AB]N?-?YJY", "YJY"),
    ("WDZ[AB]N?-?YJV", "YJV"),
    ("ZR-?YJV|ZRC?-?YJV|ZRN?-?YJV", "YJV"),
    ("ZR-?YJY|ZRC?-?YJY|ZRN?-?YJY", "YJY"),
    ("NH-?YJV", "NH-YJV"),
    ("NH-?YJY", "NH-YJY"),
    ("YJV22", "YJV22"),
    ("YJY22", "YJY22"),
    ("YJV", "YJV"),
    ("YJY", "YJY"),
    ("VV22", "VV22"),
    ("VV", "VV"),
    ("BVVB", "BVVB"),
    ("BVR", "BVR"),
    ("BV", "BV"),
    ("RVV", "RVV"),
    ("RVVP", "RVVP"),
    ("RVS|RVB", "RVS"),
]
# Words and forms of each family, and words that rule it out.
CABLE_NAMES = "电缆|电线|配线|布电线"
NO_CABLE = "电缆头|终端头|中间头|接线端子|电缆终端|电力电缆头|控制电缆头"
TRAYS = "桥架|托盘|梯架|线槽"
REBAR = "HRB400|HRB500|HPB300|HRBF400|螺纹钢|圆钢|钢筋"
CONCRETE = r"\b(C\d{2}(?:\.\d)?)\b"
CONCRETE_NAMES = r"\b(混凝土|砼)\b"
CEMENT = r"P\.O\s*\d{3}|P\.C\s*\d{3}|P\.I\s*\d{3}|P\.II\s*\d{3}|硅酸盐水泥|普通硅酸盐水泥|矿渣硅酸盐水泥|白水泥"
NO_CEMENT = "砂浆|楼地面|砖基础|块料|石材|擦缝|勾缝|抹灰|找平|垫层|防水|堵漏|混凝土"
PIPE = (
    r"镀锌钢管|焊接钢管|无缝钢管|不锈钢管|螺旋焊管|直缝焊管|PPR[- ]?管?|PVC[- ]?U?管?|CPVC[- ]?管?|HDPE[- ]?管?|PE[- ]?RT?管?|UPVC|PP管|"
    r"铸铁管|球墨铸铁管|铝塑复合管|铜管|给水管|排水管|雨水管|采暖管|燃气管道|DN\s*\d+|de\s*\d+|DE\s*\d+"
)
# The same as a test: its words, and the shortest form of each of its other alternatives.
PIPE_WORDS = [w for w in PIPE.split("|") if all("\u4e00" <= x <= "\u9fff" for x in w)]
PIPE_FORMS = r"P(?:PR|VC|P管|E[- ]?R)|HDPE|D[NE]\s*\d"
NO_PIPE = "截止阀|闸阀|球阀|蝶阀|止回阀|排气阀|安全阀|减压阀|低压螺纹阀门|管件|套管|地漏|法兰|弯头|三通|接头|堵头|栏杆|爬梯|扶手|支架|支吊架|一般填料|防水套管|绝热|凿|预留洞|雨水斗|散流器|风口"
CONDUIT_NAMES = "穿线|线管|配管"
SECTION = r"\d+\s*[×x*]\s*\d+(?:\s*[+]\s*\d+\s*[×x*]\s*\d+)?(?:\s*mm2?)?"
SINGLE_SECTION = r"(?:^|[\s\-])((?:\d+(?:\.\d+)?)\s*mm2?)(?:\s|$|[,，;；])"
MODEL_SIZE = r"(?:BV|BVR|RV|RVV|RVVP|BVVB)\s*[-]?\s*(\d+(?:\.\d+)?)"

_I = "(?iuU)"  # any case, letters and spaces of all scripts


def _has(text: Column, pattern: str, flags: str = _I) -> Column:
    """Whether the pattern is in the text. Words without letters that have a case are looked for as such, which is faster."""
    words = pattern.split("|")
    if flags == _I and all(w and all("\u4e00" <= x <= "\u9fff" for x in w) for w in words):
        return _holds(text, words)
    return F.coalesce(text.rlike(f"{flags}(?:{pattern})"), F.lit(False))


def _holds(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def _found(text: Column, pattern: str, group: int = 1, flags: str = _I) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, flags + pattern, group), F.lit(""))


def both_texts(name: Column, feature: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(feature, F.lit("")))


def by_prefix(code: Column, version: Column) -> Column:
    """Family of the prefix; an unknown edition tries both, the newer one first."""
    six, nine = F.substring(code, 1, 6), F.substring(code, 1, 9)
    out = F.lit(None).cast("string")
    for edition, prefix, family, excluded in PREFIXES:
        fits = (six == prefix) & ((version == edition) | ~F.coalesce(version, F.lit("unknown")).isin("2013", "2024"))
        fits = fits & ~nine.isin(*excluded) if excluded else fits
        out = F.when(fits, family).otherwise(out)
    return out


def cable_model(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, model in reversed(CABLE_MODELS):
        out = F.when(_has(text, pattern), model).otherwise(out)
    return out


def cable_section(text: Column) -> Column:
    """Cores and cross-sections, like 4*16+1*10."""
    found = F.regexp_replace(F.translate(F.regexp_replace(_found(text, f"({SECTION})"), " ", ""), "×x", "**"), f"{_I}mm2?$", "")
    return found


def cable_spec(name: Column, feature: Column) -> Column:
    """Model and section of a cable or wire; null if the line is no cable."""
    text = both_texts(name, feature)
    model = cable_model(text)
    single = F.regexp_replace(F.regexp_replace(_found(text, SINGLE_SECTION), " ", ""), f"{_I}mm2?$", "")
    size = F.coalesce(cable_section(text), single, _found(text, MODEL_SIZE))
    spec = F.when(size.isNotNull(), F.concat_ws("-", model, size)).when(model.isNotNull(), F.concat(model, F.lit("(无截面)"))).otherwise("电缆(未识别)")
    return F.when(_has(name, CABLE_NAMES) & ~_has(text, NO_CABLE), spec)


def concrete_grade(text: Column) -> Column:
    return _found(text, CONCRETE, flags="(?U)")


def concrete_spec(text: Column) -> Column:
    return F.coalesce(concrete_grade(text), F.lit("混凝土"))


def cement_spec(text: Column) -> Column:
    return F.coalesce(F.replace(F.upper(_found(text, f"({CEMENT})")), F.lit(" "), F.lit("")), F.lit("水泥"))


def rebar(text: Column) -> Column:
    grade = F.coalesce(_found(text, f"({REBAR})"), F.lit("钢筋"))
    width = _found(text, r"[Φφ]\s*(\d{1,3})", flags="(?U)")
    return F.when(width.isNotNull(), F.concat(grade, F.lit(" Φ"), width)).otherwise("钢筋_未识别")


def pipe_size(text: Column) -> Column:
    kind, size = _found(text, r"(DN|de|DE)\s*(\d+)", 1), _found(text, r"(DN|de|DE)\s*(\d+)", 2)
    return F.concat(F.upper(kind), size)


def pipe_spec(name: Column, feature: Column) -> Column:
    """Material and nominal width of a pipe; null if the line is no pipe."""
    text = both_texts(name, feature)
    steel = F.when(_has(name, CONDUIT_NAMES), F.concat(F.lit("焊接钢管 DN"), _found(text, r"SC\s*(\d+)")))
    whole = _found(text, f"({PIPE})")
    material = F.trim(F.regexp_replace(whole, rf"{_I}\s*(DN|de|DE)\s*\d+\s*$", ""))
    spec = F.concat_ws(" ", F.nullif(material, F.lit("")), pipe_size(text))
    return F.when(~_has(text, NO_PIPE), F.coalesce(steel, F.when(whole.isNotNull(), spec)))


def conduit(text: Column) -> Column:
    return F.concat(F.upper(_found(text, r"(SC|PC|JDG|KBG)\s*(\d+)", 1)), _found(text, r"(SC|PC|JDG|KBG)\s*(\d+)", 2))


def by_text(name: Column, feature: Column | None = None) -> Column:
    """Family by the words of name and feature, in the order concrete, cement, rebar, cable, pipe."""
    feature = F.lit(None).cast("string") if feature is None else feature
    text, tray = both_texts(name, feature), _has(name, TRAYS)
    # what a pattern cannot do without is looked for first: most texts have none of it
    concrete = (_holds(text, ["C"]) & _has(text, CONCRETE, "(?U)")) | (_holds(text, ["混凝土", "砼"]) & _has(text, CONCRETE_NAMES, "(?U)"))
    cable = _has(name, CABLE_NAMES) & ~_has(text, NO_CABLE)
    pipe = ~_has(text, NO_PIPE) & (_holds(text, PIPE_WORDS) | _has(text, PIPE_FORMS) | _has(name, CONDUIT_NAMES) & _has(text, r"SC\s*\d+"))
    return (
        F.when(concrete & ~tray, "混凝土")
        .when(_holds(text, ["P.", "p.", "水泥"]) & _has(text, CEMENT) & ~_has(text, NO_CEMENT), "水泥")
        .when(_holds(text, ["300", "400", "500", "钢"]) & _has(text, REBAR) & ~tray, "钢筋")
        .when(cable & ~tray, "电线电缆")
        .when(pipe, "管道")
    )


def family(code: Column, version: Column, name: Column, feature: Column) -> Column:
    """Prefix first, then text; nothing for an unknown edition."""
    return F.when(version.isin("2013", "2024"), F.coalesce(by_prefix(code, version), by_text(name, feature)))


def spec(family: Column, name: Column, feature: Column) -> Column:
    """The spec that a family reads from a line; empty without a family."""
    text = both_texts(name, feature)
    return (
        F.when(family == "电线电缆", F.coalesce(cable_spec(name, feature), F.lit(UNREAD["电线电缆"])))
        .when(family == "钢筋", rebar(text))
        .when(family == "混凝土", concrete_spec(text))
        .when(family == "水泥", cement_spec(text))
        .when(family == "管道", F.coalesce(pipe_spec(name, feature), F.lit(UNREAD["管道"])))
        .when(family == "配管配线", F.coalesce(conduit(text), F.lit(UNREAD["配管配线"])))
        .otherwise("")
    )


def with_family(lines: DataFrame) -> DataFrame:
    """Lines with family, spec and material_type. Equal lines are many: each distinct text is classified once and joined back."""
    keys = ["item_code", "item_code_version", "item_name", "item_feature"]
    c = F.col
    kinds = lines.select(*keys).distinct().withColumn("family", family(*(c(k) for k in keys)))
    kinds = kinds.withColumn("spec", spec(c("family"), c("item_name"), c("item_feature"))).filter("family IS NOT NULL")
    types = F.create_map(*[F.lit(x) for kv in MATERIAL_TYPES.items() for x in kv])
    kinds = kinds.select(*[c(k).alias(f"_{k}") for k in keys], "family", "spec", F.try_element_at(types, c("family")).alias("material_type"))
    return lines.join(kinds, [c(k).eqNullSafe(c(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def edition(items: DataFrame, lookup: DataFrame) -> DataFrame:
    """items (code9, item_name) with version, confidence, layer. lookup: version, code9, name.

    Layer 1: a code of one edition only; 2: equal name; 3: name contained; 4: prefix of one-edition codes.
    A cross check by prefix lowers what it contradicts.
    """
    both = lookup.groupBy("code9").agg(
        F.max(F.when(F.col("version") == "2013", F.col("name"))).alias("n13"), F.max(F.when(F.col("version") == "2024", F.col("name"))).alias("n24"),
        F.max((F.col("version") == "2013").cast("int")).alias("in13"), F.max((F.col("version") == "2024").cast("int")).alias("in24"),
    )
    only = both.filter("in13 + in24 = 1").groupBy(F.substring("code9", 1, 6).alias("prefix6")).agg(F.max("in13").alias("p13"), F.max("in24").alias("p24"))
    rows = items.join(both, "code9", "left").withColumn("prefix6", F.substring("code9", 1, 6)).join(only, "prefix6", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    name = F.trim(F.coalesce("item_name", F.lit("")))
    has = lambda n: (name != "") & F.coalesce(F.col(n) != "", F.lit(False))
    prefix = F.when(zero("p13"), "2013").when(zero("p24"), "2024")
    known = zero("in13") | zero("in24")
    say = lambda v, c, n: F.struct(v.alias("version") if isinstance(v, Column) else F.lit(v).alias("version"), F.lit(c).alias("confidence"), F.lit(n).alias("layer"))
    fallback = F.when(prefix.isNotNull(), say(prefix, "low", 4)).otherwise(say("unknown", "unknown", 4))
    first = (
        F.when(F.length(F.coalesce("code9", F.lit(""))) < 6, say("unknown", "unknown", 4))
        .when(zero("in13") & ~zero("in24"), say("2013", "high", 1))
        .when(zero("in24") & ~zero("in13"), say("2024", "high", 1))
        .when(~known, fallback)
        .when(has("n13") & (name == F.col("n13")), say("2013", "high", 2))
        .when(has("n24") & (name == F.col("n24")), say("2024", "high", 2))
        .when(has("n13") & name.contains(F.col("n13")), say("2013", "medium", 3))
        .when(has("n24") & name.contains(F.col("n24")), say("2024", "medium", 3))
        .otherwise(fallback)
    )
    rows = rows.withColumn("e", first).withColumn("cross", F.coalesce(prefix, F.lit("unknown")))
    v, c, n = (F.col(f"e.{x}") for x in ("version", "confidence", "layer"))
    keep = (n == 1) | (F.col("cross") == v) | ((c == "high") & (F.col("cross") == "unknown")) | (c == "high")
    return rows.select(
        *items.columns,
        F.when(~keep & (c == "low"), "unknown").otherwise(v).alias("version"),
        F.when(~keep & (c == "medium"), "low").when(~keep & (c == "low"), "unknown").otherwise(c).alias("confidence"),
        n.alias("layer"),
    )
