from pyspark.sql import functions as F

from boqspark.functions import classify, codes, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_units(spark):
    for raw, std in (("米", "m"), ("Ｍ", "m"), ("ｋｇ", "kg"), ("m2", "㎡"), ("樘", "樘"), (None, ""), (" t ", "t")):
        assert one(spark, text.unit_std(F.lit(raw).cast("string"))) == std
    assert one(spark, text.unit_unknown(F.lit("樘"))) and not one(spark, text.unit_unknown(F.lit("台")))


def test_codes(spark):
    cases = {"030404001001": ("030404001", "030404001001"), "30404001001": ("030404001", "030404001001"), "030404001": ("030404001",) * 2,
             "0302280006": ("030228006",) * 2, "0399999999": ("0399999999",) * 2, "z12a": ("Z12A",) * 2, "ab1": ("ab1",) * 2, "": ("", "")}
    for raw, (nine, full) in cases.items():
        assert one(spark, codes.code9(F.lit(raw))) == nine
        assert one(spark, codes.code_full(F.lit(raw))) == full
    assert one(spark, codes.code9(F.lit(None).cast("string"))) == ""


def test_match_keys(spark):
    base = {"code": "030404001001", "name": " Cable A ", "feature": "YJV 4*16", "unit": "m", "std_name": None, "std_spec": None, "dict_id": None, "version": "2013"}

    def key(**change):
        v = base | change
        args = [F.lit(v[k]).cast("long" if k == "dict_id" else "string") for k in base]
        return one(spark, codes.match_key(*args))

    assert key(dict_id=7) == "dict:7|m"
    assert key(std_name="n", std_spec="s") == "std:n|s|m"
    assert key(code="z1b") == "code:2024:Z1B|m"
    assert key() == "code:2013:030404001|m"
    assert key(code=None, version=None) == "raw:unknown:cablea|yjv4*16|m"


def test_numbers_and_specs(spark):
    assert float(one(spark, text.parsed_number(F.lit(" ￥1,234.5 ")))) == 1234.5
    assert one(spark, text.parsed_number(F.lit("abc"))) is None
    assert one(spark, text.spec_of(F.lit("型号:A;规格:16;规格:16"))) == "A|16"
    assert one(spark, text.canonical_spec(F.lit("yjv 4×16（φ20）"))) == "YJV4*16(Φ20)"
    assert one(spark, text.simple_name(F.lit("钢管(镀锌)制作安装"))) == "钢管"
    assert one(spark, text.is_summary(F.lit("本页小计")))


def test_families(spark):
    f = lambda c, v, n, x="": one(spark, classify.family(F.lit(c), F.lit(v), F.lit(n), F.lit(x)))
    assert f("030408001001", "2013", "a") == "电线电缆"
    assert f("030408006001", "2013", "a") is None
    assert f("999999001", "2024", "现浇混凝土梁 C30") == "混凝土"
    assert f("999999001", "unknown", "混凝土") is None
    assert one(spark, classify.cable_section(F.lit("YJV 4×16+1x10"))) == "4*16+1*10"
    assert one(spark, classify.rebar(F.lit("HRB400 Φ20"))) == "HRB400 Φ20"
    assert one(spark, classify.pipe_size(F.lit("镀锌钢管 dn 50"))) == "DN50"
    assert one(spark, classify.conduit(F.lit("配管 SC 20"))) == "SC20"
