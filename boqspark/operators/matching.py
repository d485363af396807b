"""Matching bill items to the dictionary: candidate pool, three scorers, fusion, pre-match, pending list, automatic confirmation.

Items repeat their texts: everything is scored once per distinct name and spec and joined back. The best nodes are found
without scoring all pairs (`topk`): by falling bounds, down to the k-th score. Similarities with partial alignment run in Arrow
batches over distinct pairs of texts; the rest is joins, windows and columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cables
from ..functions.text import canonical_spec
from ..shared import cut, kept
from . import learning, topk
from . import similarity as sim
from .merge import confirm_matches
from .topk import edit_score, edit_similarity  # noqa: F401

# Ranks of candidates shown, features of the two vector models, hours that a stored match is good for.
TOP, SHOWN, SCORED, FEATURES, VECTOR_FEATURES, GOOD_HOURS = 5, 3, 10, 10_000, 512, 24
# Limits of the match types by name similarity.
FUZZY, FUZZY_LOW, FUZZY_STAGE = 85, 75, 65

_CANDIDATE = "struct<dict_id:bigint,name:string,spec:string,score:double,path:string,source:string>"


# --- candidates and their scores ---


def text_pairs(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """a, b, score: the edit similarity of each distinct pair of texts. The pairs are written first, so that none is scored twice."""
    return cut(pairs.select(a, b).distinct()).withColumn(score, edit_similarity(a, b))


def candidate_pool(nodes: DataFrame, levels: tuple[str, ...] = ("l3", "l4"), least_name: int = 1) -> DataFrame:
    """dict_id, level, name, spec, path of the nodes of these levels with a name of so many characters. nodes: id, level, name, spec (may be missing), path."""
    spec = F.nullif(F.trim("spec"), F.lit("")) if "spec" in nodes.columns else F.lit(None).cast("string")
    n = nodes.filter(F.col("level").isin(*levels)).withColumn("name", F.trim("name")).filter(F.length("name") >= least_name)
    return n.select(F.col("id").alias("dict_id"), "level", "name", F.coalesce(spec, "name").alias("spec"), F.coalesce("path", "name").alias("path"))


def edit_candidates(queries: DataFrame, pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """qid, dict_id, score of the given pairs (qid, dict_id). queries: qid, name, spec; pool: dict_id, level, name, spec."""
    q, p = queries.select("qid", "name", "spec"), pool.select("dict_id", "level", F.col("name").alias("pool_name"), F.col("spec").alias("pool_spec"))
    met = cut(pairs.select("qid", "dict_id").distinct().join(q, "qid").join(p, "dict_id"))
    scored = met.join(text_pairs(met, "name", "pool_name", "name_score"), ["name", "pool_name"])
    scored = scored.join(text_pairs(met.filter("spec <> ''"), "spec", "pool_spec", "spec_score"), ["spec", "pool_spec"], "left")
    exact = (F.col("level") == "l3") & (F.trim("spec") != "") & (F.trim("spec") == F.trim("pool_spec"))
    return scored.select("qid", "dict_id", sim.match_score(F.col("name_score"), F.coalesce("spec_score", F.lit(0.0)), F.col("level"), exact).alias("score"))


def vector_candidates(queries: DataFrame, pool: DataFrame, features: int, k: int = SCORED) -> DataFrame:
    """qid, dict_id, score: the k nearest pool nodes by TF-IDF cosine over one- and two-word terms, the `features` most frequent ones of the pool."""
    docs = pool.select("dict_id", F.concat_ws(" ", "name", "spec", "path").alias("text"))
    own, idf = sim.fitted(docs, "dict_id", "text", features)
    mine = sim.transformed(queries.select("qid", F.concat_ws(" ", "name", "spec").alias("text")), "qid", "text", idf)
    return topk.cosine_top_k(mine, own, "qid", "dict_id", k).select("qid", "dict_id", "score")


def recall(queries: DataFrame, pool: DataFrame, weights: dict[str, float] = sim.FUSION, k: int = TOP) -> DataFrame:
    """qid, rank, dict_id, name, spec, path, score, sources: the k best nodes of different names, by all three scorers.

    queries: qid, name, spec, and w_edit, w_tfidf, w_vector where each has weights of its own (`learning.weights_for`).
    A node's score is the weighted mean over the scorers that have it: the edit score has all nodes, the other two their ten
    nearest. These twenty at most are scored and fused first; their k-th best is then the least that a node with the edit
    score alone has to reach, and such nodes are searched from this floor up.
    """
    w = {a: F.col(f"w_{a}") if f"w_{a}" in queries.columns else F.lit(x) for a, x in weights.items()}
    lists = {"tfidf": vector_candidates(queries, pool, FEATURES), "vector": vector_candidates(queries, pool, VECTOR_FEATURES)}
    near = cut(lists["tfidf"].withColumn("source", F.lit("tfidf")).unionByName(lists["vector"].withColumn("source", F.lit("vector"))))
    edit = edit_candidates(queries, pool, near).filter("score > 0").withColumn("source", F.lit("edit"))
    weight = F.when(F.col("source") == "edit", w["edit"]).when(F.col("source") == "tfidf", w["tfidf"]).otherwise(w["vector"])
    own = near.unionByName(edit).join(queries.select("qid", *[c for c in queries.columns if c.startswith("w_")]), "qid").withColumn("weight", weight)
    fused = own.groupBy("qid", "dict_id").agg(F.round(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), 2).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    fused = cut(fused.filter("score > 0").join(pool.select("dict_id", "name"), "dict_id"))
    once = Window.partitionBy("qid", "name").orderBy(F.desc("score"), "dict_id")
    floor = sim.top_k(fused.withColumn("_n", F.row_number().over(once)).filter("_n = 1"), "qid", k).groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    known = fused.groupBy("qid").agg(F.collect_list("dict_id").alias("excluded"))
    asked = cut(queries.select("qid", "name", "spec").join(floor, "qid", "left").join(known, "qid", "left"))
    alone = topk.edit_top_k(asked, pool, k, spare=2 * SCORED).filter("score > 0").withColumn("sources", F.lit("edit")).join(pool.select("dict_id", "name"), "dict_id")
    best = sim.top_k(fused.unionByName(alone).withColumn("_n", F.row_number().over(once)).filter("_n = 1"), "qid", k)
    return best.join(pool.select("dict_id", "spec", "path"), "dict_id").select("qid", "rank", "dict_id", "name", "spec", "path", "score", "sources")


def mapped(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """items (code9, item_code_version) with `category` of the mapping (version, code9, name; the least id of a code wins), null without one."""
    one = mapping.groupBy(F.col("version").alias("_v"), F.col("code9").alias("_c")).agg(F.min(F.struct("id", "name")).alias("_m"))
    return items.join(one, (F.col("item_code_version") == F.col("_v")) & (F.col("code9") == F.col("_c")), "left").withColumn("category", F.col("_m.name")).drop("_v", "_c", "_m")


def prematch(
    items: DataFrame, pool: DataFrame, mapping: DataFrame | None = None, weights: dict[str, float] = sim.FUSION, k: int = TOP, learned: DataFrame | None = None, batch: int | None = None, first: int | None = None
) -> DataFrame:
    """id, candidates (the k best, best first), top_score, for active items without a dictionary id. items: id, name, spec and what `mapped` needs.

    A code with a mapping has its category as the only candidate, of score 100 and without an id. learned: weights by category
    (`learning.replay`) for items with a `path`, blended with `weights` as `learning.weights_for` does; without it all items have these.
    batch: items of this import batch only; first: so many items of the least ids only (default: all).
    """
    todo = items.filter("active AND material_dict_id IS NULL")
    todo = todo if batch is None else todo.filter(F.col("import_batch_id") == batch)
    todo = todo if first is None else todo.orderBy("id").limit(first)
    todo = mapped(todo, mapping) if mapping is not None else todo.withColumn("category", F.lit(None).cast("string"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    kind_of = learning.category_of(F.col("path")) if learned is not None else F.lit("")
    todo = kept(todo.select("id", text("name").alias("name"), text("spec").alias("spec"), "category", kind_of.alias("_kind")), "todo")
    rest = todo.filter("category IS NULL")
    queries = rest.select("name", "spec", "_kind").distinct().withColumn("qid", F.xxhash64("name", "spec", "_kind"))
    if learned is not None:
        queries = learning.weights_for(queries.withColumn("path", F.col("_kind")), learned, tuple(weights[a] for a in learning.ALGORITHMS)).drop("path")
    queries = cut(queries)
    best = recall(queries, pool, weights, k)
    one = F.struct("rank", F.struct("dict_id", "name", "spec", "score", "path", F.lit("match").alias("source")).cast(_CANDIDATE).alias("c"))
    lists = best.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["c"]).alias("candidates"))
    none = F.array().cast(f"array<{_CANDIDATE}>")
    lists = queries.join(lists, "qid", "left").select("name", "spec", "_kind", "candidates")
    matched = rest.join(lists, ["name", "spec", "_kind"]).select("id", F.coalesce("candidates", none).alias("candidates"))
    kind = F.struct(F.lit(None).cast("long"), F.col("category"), F.lit(""), F.lit(100.0), F.concat(F.lit("大类分类/"), "category"), F.lit("mapping")).cast(_CANDIDATE)
    by_code = todo.filter("category IS NOT NULL").select("id", F.array(kind).alias("candidates"))
    return matched.unionByName(by_code).withColumn("top_score", F.coalesce(F.get("candidates", F.lit(0))["score"], F.lit(0.0)))


# --- stored matches ---


def fresh_matches(cache: DataFrame, now: Column, hours: int = GOOD_HOURS) -> DataFrame:
    """Stored matches (id, candidates, computed_at) that are not older than so many hours."""
    return cache.filter(F.col("computed_at") > now - F.make_dt_interval(hours=F.lit(hours)))


def stored(cache: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """The store (id, candidates, top_score, computed_at) after a match job: its items replaced or added, the others kept."""
    return invalidated(cache, matches).select("id", "candidates", "top_score", "computed_at").unionByName(matches.select("id", "candidates", "top_score", now.alias("computed_at")))


def invalidated(cache: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the matches of these items."""
    return cache.join(ids.select("id").distinct(), "id", "left_anti")


def confidence(score: Column) -> Column:
    """Band of a score: A from 90, B from 75, C from 60, else D."""
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")


def pending(items: DataFrame, cache: DataFrame, mapping: DataFrame, now: Column, shown: int = SHOWN) -> DataFrame:
    """id, from_cache, candidates: active items without a dictionary id and what is shown for them.

    A fresh stored match gives its first candidates of different names; without one the category of the code's mapping is
    the only candidate; items of other codes have none.
    """
    todo = mapped(items.filter("active AND material_dict_id IS NULL"), mapping).select("id", "category")
    j = todo.join(fresh_matches(cache, now).select("id", "candidates"), "id", "left")
    names = F.transform("candidates", lambda c: F.trim(c["name"]))
    once = F.filter("candidates", lambda c, i: (F.trim(c["name"]) != "") & (F.array_position(names, F.trim(c["name"])) == i + 1))
    kind = F.struct(F.lit(None).cast("long"), F.col("category"), F.lit(""), F.lit(100.0), F.col("category"), F.lit("mapping")).cast(_CANDIDATE)
    long_name = F.length(F.trim("category")) >= 3
    alone = F.when(long_name, F.array(kind)).otherwise(F.array().cast(f"array<{_CANDIDATE}>"))
    return j.select("id", F.col("candidates").isNotNull().alias("from_cache"), F.when(F.col("candidates").isNotNull(), F.slice(once, 1, shown)).otherwise(alone).alias("candidates"))


def auto_confirmed(items: DataFrame, mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """confirmations (id, dict_id, name, spec) of unlinked active items whose code maps to the exact name of a node of level three or four.

    Names have three characters at least; of several nodes the least id counts. spec: the node's category of level three, else its name.
    """
    pool = nodes.filter(F.col("level").isin("l3", "l4") & (F.length(F.trim("name")) >= 3))
    l3 = F.nullif(F.trim("cat_l3"), F.lit("")) if "cat_l3" in nodes.columns else F.lit(None).cast("string")
    pool = pool.groupBy(F.trim("name").alias("_name")).agg(F.min(F.struct("id", l3.alias("l3"))).alias("_n"))
    todo = mapped(items.filter("active AND material_dict_id IS NULL").filter(F.length("code9") == 9), mapping).filter("category IS NOT NULL")
    return todo.join(pool, F.trim("category") == F.col("_name")).select("id", F.col("_n.id").alias("dict_id"), F.col("_name").alias("name"), F.coalesce("_n.l3", "_name").alias("spec"))


def auto_confirm(items: DataFrame, mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """All items, those that `auto_confirmed` finds linked and keyed again; `auto` marks them (for the audit)."""
    sure = cut(auto_confirmed(items, mapping, nodes))
    return confirm_matches(items, sure).join(sure.select("id", F.lit(True).alias("auto")), "id", "left").withColumn("auto", F.coalesce("auto", F.lit(False)))


# --- lists of the standard to the dictionary ---


def match_type(exact: Column, name_score: Column, by_feature: Column) -> Column:
    """exact_name, fuzzy_name, feature_match, fuzzy_low or no_match, in this order."""
    score = F.coalesce(name_score, F.lit(0.0))
    return F.when(exact, "exact_name").when(score >= FUZZY, "fuzzy_name").when(by_feature, "feature_match").when(score >= FUZZY_LOW, "fuzzy_low").otherwise("no_match")


def contained_names(texts: DataFrame, dictionary: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """key, dict_id, dict_name: all dictionary names of two characters or more that stand in a text, by equality with its substrings.

    Equal texts are taken apart once. The names are written first, so that their size is known: few of them are broadcast, and
    the substrings, which are a thousand times the texts, are not shuffled.
    """
    d = kept(dictionary.filter(F.length("dict_name") >= least).groupBy("dict_name").agg(F.min("dict_id").alias("dict_id")), "names")
    rows = texts.select(key, text).filter(F.length(text) >= least)
    inside = sim.parts(rows.select(F.col(text).alias("_text")).distinct(), "_text", d, "dict_name", whole_too=True)
    inside = inside.join(d, F.col("part") == F.col("dict_name")).select("_text", "dict_id", "dict_name")
    return rows.join(inside, F.col(text) == F.col("_text")).select(key, "dict_id", "dict_name").distinct()


def progressive_all(items: DataFrame, dictionary: DataFrame, synonyms: DataFrame) -> DataFrame:
    """items (item, name, feature), dictionary (dict_id, dict_name), synonyms (synonym, standard) -> item, dict_id, score, how.

    Stages, each over what those before it left: exact name (100), synonym (95), one name holds the other (80 or 75, and
    20 times the ratio of lengths), best edit similarity of the whole names from 65 on, a dictionary name inside the
    feature text (100, the longest), a synonym inside it (95). Ties: the smaller id.
    """
    d = dictionary.groupBy("dict_name").agg(F.min("dict_id").alias("dict_id"))
    s = synonyms.join(d, F.col("standard") == F.col("dict_name")).groupBy("synonym").agg(F.min("dict_id").alias("dict_id"))
    three = sim.progressive(items.select("item", "name"), dictionary)
    first = three.filter("how = 'exact'")
    left = items.join(first, "item", "left_anti")
    by_synonym = left.join(s, F.col("name") == F.col("synonym")).groupBy("item").agg(F.min("dict_id").alias("dict_id")).select("item", "dict_id", F.lit(95.0).alias("score"), F.lit("synonym").alias("how"))
    done = first.unionByName(by_synonym)
    done = cut(done.unionByName(three.filter("how = 'contained'").join(by_synonym, "item", "left_anti")))
    left = cut(items.join(done, "item", "left_anti"))
    fuzzy = sim.best_by_edit(left.select("name").distinct(), d.select("dict_name"), "name", "dict_name", 1, FUZZY_STAGE)
    fuzzy = left.select("item", "name").join(fuzzy, "name").join(d, "dict_name").select("item", "dict_id", "score", F.lit("fuzzy").alias("how"))
    left = left.join(fuzzy, "item", "left_anti")
    inside = contained_names(left, d, "item", "feature").select("item", "dict_id", F.lit(100.0).alias("score"), F.length("dict_name").alias("n"))
    known = s.select("dict_id", F.col("synonym").alias("dict_name"))
    inside = inside.unionByName(contained_names(left, known, "item", "feature").select("item", "dict_id", F.lit(95.0).alias("score"), F.length("dict_name").alias("n")))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.desc("n"), "dict_id"))
    feature = inside.withColumn("_r", best).filter("_r = 1").select("item", "dict_id", "score", F.lit("feature").alias("how"))
    none = left.join(feature, "item", "left_anti").select("item", F.lit(None).cast("long").alias("dict_id"), F.lit(0.0).alias("score"), F.lit("none").alias("how"))
    return done.unionByName(fuzzy).unionByName(feature).unionByName(none)


def spec_matches(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """items (item, dict_id, spec) with the children of the matched node whose spec holds the item's spec or is held by it, without spaces and diameter signs."""
    plain = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), " Φφ", "")
    kids = nodes.select(F.col("parent_id").alias("_p"), F.col("id").alias("child_id"), plain("spec").alias("_s")).filter("_s <> ''")
    j = items.withColumn("_i", plain("spec")).filter("_i <> ''").join(kids, F.col("dict_id") == F.col("_p"))
    return j.filter(F.contains("_i", F.col("_s")) | F.contains("_s", F.col("_i"))).select("item", "dict_id", "child_id")


def cable_baseline(items: DataFrame, baseline: DataFrame) -> DataFrame:
    """items (item, spec), baseline (base_id, base_spec) -> item, base_id, how, score.

    Equal canonical specs first, then an alias of the item's spec, then the baseline that shares most features, with 60
    points or more. Sixty points need the main section or the cores in common, so that these are joined by equality.
    Ties: the least base_id. Items without a spec or a match have none.
    """
    i = cut(items.withColumn("_s", canonical_spec(F.col("spec"))))
    b = cut(baseline.select("base_id", canonical_spec(F.col("base_spec")).alias("_b"), cables.cable_features(F.col("base_spec")).alias("_bf")))
    by_spec = b.filter("_b <> ''").groupBy("_b").agg(F.min("base_id").alias("base_id"))
    exact = i.filter("_s <> ''").join(by_spec, F.col("_s") == F.col("_b")).select("item", "base_id", F.lit("spec").alias("how"), F.lit(100).alias("score"))
    left = i.filter("_s <> ''").join(exact, "item", "left_anti")
    alias = left.select("item", F.explode(cables.spec_aliases(F.col("spec"))).alias("_a")).join(by_spec, F.col("_a") == F.col("_b"))
    alias = alias.groupBy("item").agg(F.min("base_id").alias("base_id")).select("item", "base_id", F.lit("alias").alias("how"), F.lit(100).alias("score"))
    rest = left.join(alias, "item", "left_anti").select("item", cables.cable_features(F.col("spec")).alias("_f"))
    keys = lambda f: F.explode(F.array_compact(F.array(F.when(F.col(f"{f}.section") > 0, F.concat(F.lit("s"), F.round(F.col(f"{f}.section"), 2).cast("string"))), F.concat(F.lit("c"), F.col(f"{f}.cores"))))).alias("_k")
    near = rest.select("item", "_f", keys("_f")).join(b.select("base_id", "_bf", keys("_bf")), "_k").select("item", "base_id", cables.feature_score(F.col("_f"), F.col("_bf")).alias("score")).distinct()
    feature = sim.top_k(near.filter(F.col("score") >= cables.LEAST_POINTS), "item", 1, by="base_id").select("item", "base_id", F.lit("feature").alias("how"), "score")
    found = exact.unionByName(alias).unionByName(feature)
    none = i.join(found, "item", "left_anti").select("item", F.lit(None).cast("long").alias("base_id"), F.lit("none").alias("how"), F.lit(0).alias("score"))
    return found.unionByName(none)


def match_rates(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Matches of each type and their share, in all or by columns (specialty, edition)."""
    by = by or []
    n = matches.groupBy(*by, "how").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 2))  # a few types


# The types that a list match ends with.
MATCH_TYPES = ["exact", "synonym", "contained", "fuzzy", "feature", "none"]


def match_pivot(matches: DataFrame, by: str, types: list[str] | None = None) -> DataFrame:
    """A row per value of a column (specialty, edition): lines, a count for each match type, and the share of lines with a match in percent."""
    types = types or MATCH_TYPES
    wide = matches.groupBy(by).pivot("how", types).count().na.fill(0, types)
    n = sum((F.col(t) for t in types[1:]), F.col(types[0]))
    return wide.withColumns({"n": n, "pct_matched": F.round(100 * (n - F.col("none")) / n, 2)})


def unmatched_profile(items: DataFrame, words: list[str], by: str) -> DataFrame:
    """of, value, n: items without a match by a column, by length of name, and by words that their names hold."""
    group = items.groupBy(F.lit(by).alias("of"), F.col(by).cast("string").alias("value")).agg(F.count("*").alias("n"))
    length = items.groupBy(F.lit("name_length").alias("of"), F.length("name").cast("string").alias("value")).agg(F.count("*").alias("n"))
    held = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("name"), w))
    word = items.select(F.explode(held).alias("value")).groupBy(F.lit("word").alias("of"), "value").agg(F.count("*").alias("n"))
    return group.unionByName(length).unionByName(word)
