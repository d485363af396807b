"""Filters and searches over bills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigram_similarity, trigrams

FIELDS = {"item_code", "item_name", "item_feature", "unit", "quantity", "province", "price_period", "data_source_type", "anomaly_flag", "import_batch_id", "material_dict_id"}
TEXTS = ("item_name", "item_feature", "item_code", "std_name")
# Words that mean the same.
SYNONYMS = [
    ("配电箱", "配电柜", "配电箱柜", "照明箱", "动力箱", "开关柜", "箱式变电站"), ("配电柜", "配电箱", "配电箱柜", "开关柜"),
    ("桥架", "电缆桥架", "电缆线槽", "线槽", "梯式桥架", "槽式桥架"), ("电缆", "电力电缆", "电线电缆", "控制电缆", "电缆线"),
    ("电线", "绝缘导线", "布电线", "BV线", "BVR线"), ("钢管", "焊接钢管", "镀锌钢管", "无缝钢管", "焊管", "镀锌管"),
    ("塑料管", "PVC管", "PPR管", "HDPE管", "PE管", "PVC-U管", "UPVC管"), ("阀门", "闸阀", "截止阀", "球阀", "蝶阀", "止回阀"),
    ("钢筋", "螺纹钢", "圆钢", "钢筋网", "热轧带肋钢筋"), ("水泥", "硅酸盐水泥", "普通水泥", "PO水泥", "复合硅酸盐水泥"),
    ("砼", "混凝土", "商品砼", "商品混凝土", "现浇混凝土"), ("砂浆", "水泥砂浆", "混合砂浆", "抹灰砂浆"), ("土方", "挖沟槽", "挖土方", "回填土", "土石方"),
]


def _one(field: str, op: str, value) -> Column:
    c = F.col(field)
    if value is None:
        return c.isNotNull() if op == "!=" else c.isNull()
    return {
        "=": lambda: c == value, "!=": lambda: c != value, ">": lambda: c > value, ">=": lambda: c >= value, "<": lambda: c < value, "<=": lambda: c <= value,
        "like": lambda: c.like(value), "ilike": lambda: c.ilike(value), "in": lambda: c.isin(*value), "not in": lambda: ~c.isin(*value),
    }[op]()


def domain(conditions: list[tuple], fields: set[str] = FIELDS) -> Column:
    """Conjunction of (field, op, value), active rows only; unknown fields are ignored."""
    return reduce(lambda a, b: a & b, [_one(*c) for c in conditions if c[0] in fields], F.col("active"))


def variants(word: str) -> list[str]:
    """A word and its spellings with other hyphens, multiplication signs and diameter signs, and its synonyms."""
    out = {word}
    for group in ("×x*", "Φφ", "- "):
        out |= {w.replace(a, b) for w in out for a in group for b in group}
    out |= {s for group in SYNONYMS if word.lower() in map(str.lower, group) for s in group}
    return sorted(out)


def _has(word: str, columns=TEXTS) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(v.lower())), F.lit(False)) for c in columns for v in variants(word)])


def keyword(df: DataFrame, text: str) -> DataFrame:
    """Rows that have every word of the text, or a variant of it, in some text column."""
    return df.filter(reduce(lambda a, b: a & b, [_has(w) for w in text.split()]))


def relevance(text: str) -> Column:
    """0: all words in the name, 1: some, 2: all in the feature, 3: else."""
    words = text.split()
    count = lambda c: reduce(lambda a, b: a + b, [_has(w, (c,)).cast("int") for w in words])
    return F.when(count("item_name") == len(words), 0).when(count("item_name") > 0, 1).when(count("item_feature") == len(words), 2).otherwise(3)


def trigram_search(df: DataFrame, text: str, column: str = "item_name", least: float = 0.2) -> DataFrame:
    """Rows similar to the text by padded trigrams that do not hold it as it is."""
    grams = trigrams(F.lit(text))
    found = df.withColumn("similarity", trigram_similarity(trigrams(F.col(column)), grams))
    return found.filter((F.col("similarity") >= least) & ~F.contains(F.lower(F.col(column)), F.lit(text.lower())))


def needs_fuzzy(text: str, hits: DataFrame, least: int = 3) -> bool:
    """Whether a search falls back to similarity: one word of two characters or more, not a number, with fewer than three exact hits."""
    words = text.split()
    return len(words) == 1 and len(words[0]) >= 2 and not words[0].replace(".", "", 1).isdigit() and hits.limit(least).count() < least


def search(df: DataFrame, text: str, least: float = 0.2) -> DataFrame:
    """Rows that hold the words; for one short search with few hits the rows of similar names below them (`similarity`, null for exact hits)."""
    exact = keyword(df, text)
    found = exact.withColumn("similarity", F.lit(None).cast("double"))
    if not needs_fuzzy(text, exact):
        return found
    return found.unionByName(trigram_search(df.join(exact.select("id"), "id", "left_anti"), text, "item_name", least))


def narrowed(df: DataFrame, major: str = "", code: str = "", name: str = "", source: str = "", anomaly: str = "", state: str = "", only_std: bool = False) -> DataFrame:
    """Rows by prefix of the code, parts of code and name, source type, anomaly flag and state: standard (with a standard name) or pending (without)."""
    c, out = F.col, df
    if major:
        out = out.filter(c("item_code").startswith(major))
    if code:
        out = out.filter(F.contains(c("item_code"), F.lit(code)))
    if name:
        out = out.filter(F.contains(c("item_name"), F.lit(name)))
    if source:
        out = out.filter(c("data_source_type") == source)
    if anomaly:
        out = out.filter(c("anomaly_flag") == anomaly)
    named = F.coalesce(c("std_name"), F.lit("")) != ""
    if state == "standard" or only_std:
        out = out.filter(named)
    elif state == "pending":
        out = out.filter(~named)
    return out


def counts(df: DataFrame, size: int) -> DataFrame:
    """One row: hits, those with a standard name, those without, pages of `size` (one at least)."""
    named = F.coalesce(F.col("std_name"), F.lit("")) != ""
    n = df.agg(F.count("*").alias("total"), F.count_if(named).alias("n_standard"), F.count_if(~named).alias("n_pending"))
    return n.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


#: Orders of result pages; ids break ties.
ORDERS = {
    "batch": lambda: [F.desc("import_batch_id"), F.asc("sequence"), F.asc("id")],
    "name": lambda: [F.asc("item_name"), F.desc("id")],
    "relevance": lambda: [F.asc("relevance"), F.desc_nulls_last("price_period"), F.asc("id")],
}


def page(df: DataFrame, number: int, size: int, order: str = "batch") -> DataFrame:
    """A page of results with the total; a number beyond the pages gives the last one, one under 1 the first."""
    n = counts(df, size).first()
    number = min(max(1, number), n["pages"])
    return df.orderBy(*ORDERS[order]()).offset((number - 1) * size).limit(size).withColumns({"page": F.lit(number), "total": F.lit(n["total"])})


def item(df: DataFrame, biz_id: str) -> DataFrame:
    return df.filter(F.col("biz_id") == biz_id)


def with_source(df: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows with name and archive path of the batch that they come from; rows of unknown batches keep nulls."""
    b = batches.select("import_batch_id", F.col("name").alias("batch_name"), "archive_path")
    return df.join(b, "import_batch_id", "left")


def batch_list(batches: DataFrame, items: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page of batches, the newest first, with counts of active rows and anomalies."""
    active = items.filter("active").groupBy("import_batch_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("anomaly_flag") != "normal").alias("n_anomalies"))
    shown = batches.orderBy(F.desc("import_batch_id")).offset((number - 1) * size).limit(size)
    return shown.join(active, "import_batch_id", "left").na.fill(0, ["n_items", "n_anomalies"]).orderBy(F.desc("import_batch_id"))


def first_items(items: DataFrame, batch: int, n: int = 100) -> DataFrame:
    return items.filter((F.col("import_batch_id") == batch) & F.col("active")).orderBy("sequence", "id").limit(n)


def catalog_page(catalog: DataFrame, text: str, number: int = 1, size: int = 50) -> DataFrame:
    """Keys of the cost catalog whose name, spec or key holds the text, a page in falling order of key."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c in ("item_name", "spec", "match_key") if c in catalog.columns])
    return catalog.filter(hit).orderBy(F.desc("match_key")).offset((number - 1) * size).limit(size)


def tagged(items: DataFrame, item_tags: DataFrame, tags: DataFrame, user: int) -> DataFrame:
    """Items of a user's tags, the newest tagging first."""
    own = item_tags.join(tags.filter(F.col("user_id") == user).select("tag_id", F.col("name").alias("tag")), "tag_id")
    return items.join(own.select(F.col("item_id").alias("id"), "tag", "tagged_at"), "id").orderBy(F.desc("tagged_at"), "id")


def tags_of(item_tags: DataFrame, tags: DataFrame, item_id: int) -> DataFrame:
    return item_tags.filter(F.col("item_id") == item_id).join(tags, "tag_id").select("tag_id", "name").orderBy("name", "tag_id")


def favourites(items: DataFrame, favourite: DataFrame, user: int) -> DataFrame:
    """Items that a user has marked, the newest first."""
    own = favourite.filter(F.col("user_id") == user).select(F.col("item_id").alias("id"), "created_at")
    return items.join(own, "id").orderBy(F.desc("created_at"), "id")


def is_favourite(favourite: DataFrame, user: int, item_id: int) -> bool:
    return not favourite.filter((F.col("user_id") == user) & (F.col("item_id") == item_id)).isEmpty()


def audit_page(audit: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """A page of change records, the newest first."""
    return audit.orderBy(F.desc("ts"), F.desc("trace_id")).offset((number - 1) * size).limit(size)


def badges(items: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: batches that wait for review, active items without a dictionary id, distinct names among these."""
    b = batches.filter("active").agg(F.count_if(F.col("data_source_type") == "pending_review").alias("n_batches"))
    open_ = items.filter("active AND material_dict_id IS NULL").agg(F.count("*").alias("n_items"), F.countDistinct("item_name").alias("n_names"))
    return b.join(F.broadcast(open_))  # one row each
