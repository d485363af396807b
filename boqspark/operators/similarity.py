"""Matching names to the dictionary: edit, trigram, TF-IDF and vector similarity, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

# Weights of name and spec, of levels, and of the three algorithms.
NAME_SHARE, SPEC_SHARE = 0.7, 0.3
LEVEL_WEIGHT = {"l3": 0.8, "l4": 1.0, "l5": 1.0}
FUSION = {"edit": 0.3, "tfidf": 0.35, "vector": 0.35}


def bigrams(c: Column) -> Column:
    """Distinct character pairs of the lower-case text; a single character stands for itself."""
    t = F.lower(F.coalesce(c, F.lit("")))
    pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) >= 2, F.array_distinct(pairs)).when(F.length(t) == 1, F.array(t)).otherwise(F.array().cast("array<string>"))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence by one row of the table per character of a."""
    xs, ys = F.split(a, ""), F.split(b, "")
    start = F.transform(F.sequence(F.lit(0), F.size(ys)), lambda _: F.lit(0))

    def row(old: Column, x: Column) -> Column:
        def cell(new: Column, i: Column) -> Column:
            diagonal = F.get(old, i - 1) + F.when(F.get(ys, i - 1) == x, 1).otherwise(0)
            return F.array_append(new, F.greatest(F.element_at(new, -1), F.get(old, i), diagonal))

        return F.aggregate(F.sequence(F.lit(1), F.size(ys)), F.array(F.lit(0)), cell)

    out = F.element_at(F.aggregate(xs, start, row), -1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(out)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (|a| + |b|); two empty texts: 0."""
    return F.coalesce(F.try_divide(F.lit(200.0) * lcs_length(a, b), F.length(a) + F.length(b)), F.lit(0.0))


def candidates(left: DataFrame, right: DataFrame, l_id: str, l_text: str, r_id: str, r_text: str, least_shared: int = 2) -> DataFrame:
    """l_id, r_id, shared: the pairs that share least_shared distinct character bigrams or more. No bound on edit similarity: see near_pairs."""
    lg = left.select(l_id, F.explode(bigrams(F.col(l_text))).alias("g"))
    rg = right.select(r_id, F.explode(bigrams(F.col(r_text))).alias("g"))
    return lg.join(rg, "g").groupBy(l_id, r_id).agg(F.count("*").alias("shared")).filter(F.col("shared") >= least_shared)


def near_pairs(left: DataFrame, right: DataFrame, l_text: str, r_text: str, above: int = 80) -> DataFrame:
    """l_text, r_text, score: all pairs of an indel ratio over `above` (80 or more), of tables of distinct texts.

    Of n characters in both, L > above * n / 200 are common in order. Of the L - 1 steps between them a - L at most are
    torn in the one text and b - L in the other, so 3L - 1 - n bigrams are common, counted with repetition. From 80 on
    that is one at least, but for two equal single characters, which stand for themselves.
    """
    if above < 80:
        raise ValueError("below 80 a pair may share no bigram")

    def counted(df: DataFrame, text: str, count: str) -> DataFrame:
        t = F.col(text)
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        grams = F.when(F.length(t) >= 2, pairs).when(F.length(t) == 1, F.array(t))
        return df.select(text, F.explode(grams).alias("_g")).groupBy(text, "_g").agg(F.count("*").alias(count))

    a, b = F.length(l_text), F.length(r_text)
    least = F.floor((a + b) * above / 200).cast("int") + 1
    shared = counted(left, l_text, "_l").join(counted(right, r_text, "_r"), "_g").filter(F.least(a, b) >= least)
    shared = shared.groupBy(l_text, r_text).agg(F.sum(F.least("_l", "_r")).alias("_shared")).filter(F.col("_shared") >= F.greatest(F.lit(1), 3 * least - 1 - a - b))
    # A checkpoint, so that each ratio is worked out once.
    return cut(shared.select(l_text, r_text, indel_ratio(F.col(l_text), F.col(r_text)).alias("score"))).filter(F.col("score") > above)


def best_by_edit(left: DataFrame, right: DataFrame, l_text: str, r_text: str, k: int, least: float = 0.0) -> DataFrame:
    """The k best of right for each text of left by indel ratio (four decimals), of all pairs of a positive ratio, from `least` on.

    Texts meet in blocks; what a pair can reach by its common characters decides whether it is scored (`topk.ratio_pairs`).
    """
    from .topk import ratio_pairs

    return top_k(ratio_pairs(left, right, l_text, r_text, k, least).withColumn("score", F.round("score", 4)), l_text, k, by=r_text)


def level_weight(level: Column) -> Column:
    out = F.lit(0.5)
    for k, w in LEVEL_WEIGHT.items():
        out = F.when(level == k, w).otherwise(out)
    return out


def match_score(name_score: Column, spec_score: Column, level: Column, exact_spec: Column) -> Column:
    """Weighted score by level, 30 more for a nearly equal name, 100 for an equal spec; 0 to 100, two decimals."""
    score = (NAME_SHARE * name_score + SPEC_SHARE * spec_score) * level_weight(level)
    score = score + F.when(name_score > 90, 30).otherwise(0)
    return F.round(F.when(exact_spec, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))), 2)


def top_k(scored: DataFrame, item: str, k: int, score: str = "score", by: str = "dict_id") -> DataFrame:
    w = Window.partitionBy(item).orderBy(F.desc(score), by)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def high_confidence(top: DataFrame, item: str, score: str = "score") -> DataFrame:
    """item, score, sure: the best is at least 90 and more than 15 ahead of the next."""
    w = Window.partitionBy(item).orderBy("rank")
    gap = F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0))
    return top.withColumn("sure", (F.col(score) >= 90) & (gap > 15)).filter("rank = 1").select(item, score, "sure")


# Words that say nothing about a material.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有",
    "看", "好", "自己", "这", "那", "他", "她", "它", "们", "这个", "那个", "什么", "怎么", "为什么", "哪", "哪里", "谁", "多少", "几", "些",
]


def tokens(c: Column) -> Column:
    """ASCII words and CJK bigrams in the order of the text, lower case, without single characters and stop words."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]{2,}|[\\u4e00-\\u9fff]{2,})"), 1)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    out = F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9]"), F.array(r)).otherwise(pairs(r))))
    return F.filter(out, lambda w: ~w.isin(*STOP_WORDS))


def terms(c: Column) -> Column:
    """The tokens of a text and its pairs of following tokens."""
    t = tokens(c)
    return F.concat(t, F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(2), F.size(t)), lambda i: F.concat(F.get(t, i - 2), F.lit(" "), F.get(t, i - 1)))).otherwise(F.array().cast("array<string>")))


def _counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _unit(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    raw = tf.join(F.broadcast(idf), "term").withColumn("raw", F.col("tf") * F.col("idf"))  # a bounded vocabulary
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def fitted(docs: DataFrame, key: str, text: str, features: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Vectors (key, term, w; unit length, smoothed inverse document frequency) of the docs over their `features` most
    frequent terms (ties: by term), and term, idf for others."""
    tf = cut(_counted(docs, key, text))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(features)
    idf = cut(df.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    return _unit(tf, idf, key), idf


def transformed(docs: DataFrame, key: str, text: str, idf: DataFrame) -> DataFrame:
    """Vectors of other texts in the vocabulary of fitted ones."""
    return _unit(_counted(docs, key, text), idf, key)


def tfidf(docs: DataFrame, key: str, text: str, features: int = 10_000) -> DataFrame:
    """key, term, w: the vectors of docs fitted to themselves."""
    return fitted(docs, key, text, features)[0]


def cosine_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Scores in percent of pairs that share a term."""
    j = a.select(a_key, "term", F.col("w").alias("_wa")).join(b.select(b_key, "term", F.col("w").alias("_wb")), "term")
    return j.groupBy(a_key, b_key).agg((100 * F.sum(F.col("_wa") * F.col("_wb"))).alias("score"))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, q_block: int = 1024, v_block: int = 16_384) -> DataFrame:
    """query, rank, id, score: the k vectors (id, v) of greatest inner product for each query (id, v), itself left out; ties to the smaller id.

    Blocks of queries meet blocks of vectors, one matrix product each, from which the k best of every query go on.
    """
    import numpy as np
    import pandas as pd

    nq, nv = -(-max(1, queries.count()) // q_block), -(-max(1, vectors.count()) // v_block)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select("id", "v", block(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
    right = vectors.select("id", "v", block(nv).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            ids = v["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, scores = ids[order], np.round(np.stack(q["v"].to_numpy()) @ np.stack(v["v"].to_numpy())[order].T, 9)
            for query, row in zip(q["id"].tolist(), scores, strict=True):
                top = np.argsort(-row, kind="stable")[: k + 1]
                out += [(query, int(i), float(x)) for i, x in zip(ids[top], row[top], strict=True) if i != query]
        return pd.DataFrame(out, columns=["query", "id", "score"])

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(best, "query long, id long, score double")
    return top_k(found, "query", k, by="id")


def fuse(scores: dict[str, DataFrame], item: str, weights: dict[str, float] = FUSION, by: str = "dict_id") -> DataFrame:
    """item, dict_id, score, sources: weighted mean over the algorithms that found the candidate."""
    parts = [df.select(item, by, F.col("score"), F.lit(name).alias("source"), F.lit(weights[name]).alias("weight")) for name, df in scores.items()]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(item, by).agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources")
    )


def parts(df: DataFrame, text: str, of: DataFrame, whole: str, whole_too: bool = False) -> DataFrame:
    """df with `part`: every substring of its text whose length, 2 or more, is that of some text of the other table; with whole_too the text itself too."""
    sizes = of.agg(F.collect_set(F.length(whole)).alias("_sizes"))  # one row, as many numbers as there are lengths
    n = F.length(text)
    sized = F.filter("_sizes", lambda k: (k >= 2) & ((k <= n) if whole_too else (k < n)))
    cut_ = F.transform(sized, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(text), i, k)))
    return df.join(F.broadcast(sizes)).withColumn("part", F.explode(F.array_distinct(F.flatten(cut_)))).drop("_sizes")


def progressive(items: DataFrame, dictionary: DataFrame) -> DataFrame:
    """items (item, name), dictionary (dict_id, dict_name): exact, else contained, else none. Ties: the smaller id.

    Contained: 80 + 20 * length ratio where the name holds the dictionary name, 75 + 20 * ratio where it is the other
    way round; both have two characters at least. All such pairs are found, by equality with substrings.
    """
    exact = items.join(dictionary, F.col("name") == F.col("dict_name")).groupBy("item").agg(F.min("dict_id").alias("dict_id")).select("item", "dict_id", F.lit(100.0).alias("score"), F.lit("exact").alias("how"))
    left = items.join(exact, "item", "left_anti")
    d = dictionary.groupBy("dict_name").agg(F.min("dict_id").alias("dict_id"))
    inner = parts(left, "name", d, "dict_name").join(d, F.col("part") == F.col("dict_name"))
    inner = inner.select("item", "dict_id", (80 + 20 * F.length("dict_name") / F.length("name")).alias("score"))
    outer = parts(d, "dict_name", left, "name").join(left, F.col("part") == F.col("name"))
    outer = outer.select("item", "dict_id", (75 + 20 * F.length("name") / F.length("dict_name")).alias("score"))
    best = top_k(inner.unionByName(outer), "item", 1).select("item", "dict_id", "score", F.lit("contained").alias("how"))
    none = left.join(best, "item", "left_anti").select("item", F.lit(None).cast("long").alias("dict_id"), F.lit(0.0).alias("score"), F.lit("none").alias("how"))
    return exact.unionByName(best).unionByName(none)
