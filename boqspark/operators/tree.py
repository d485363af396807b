"""Five-level material dictionary: nodes (id, level, parent_id, name, code), built, checked, recoded and maintained in change sets.

Ancestors come from depth - 1 joins of the nodes with their parents, whose right side is one and the same exchange.
Operators that read their nodes more than once take them as they are: `cut` them first if they are costly to derive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

# Code digits of each level, after the letter I.
WIDTHS = [3, 2, 2, 3, 4]
LENGTHS = [4, 6, 8, 11, 15]


def rank_of(level: Column) -> Column:
    """1 to 5 for l1 to l5."""
    return F.substring(level, 2, 1).cast("int")


def build(rows: DataFrame, paths: list[Column]) -> DataFrame:
    """Distinct tree of the path columns, from one pass over the rows. Ids are hashes of level and path."""
    names = [f"n{i + 1}" for i in range(len(paths))]
    leaves = rows.select(*[p.cast("string").alias(n) for p, n in zip(paths, names, strict=True)]).distinct()
    own = lambda k: F.xxhash64(F.lit(k), *names[:k])
    node = lambda k: F.struct(own(k).alias("id"), F.lit(f"l{k}").alias("level"), (own(k - 1) if k > 1 else F.lit(None).cast("long")).alias("parent_id"), F.col(names[k - 1]).alias("name"))
    return leaves.select(F.inline(F.array(*[node(k) for k in range(1, len(paths) + 1)]))).distinct()


def chains(nodes: DataFrame, columns: list[str], depth: int = 5, of: DataFrame | None = None) -> DataFrame:
    """id, level, ancestors (ids from the root, the node last) and each column as an array in that order. Stops after depth steps; a cycle ends.

    of: the nodes (all columns of them) whose chains are wanted; all without it. Chains that have ended go by their own id in the
    joins: with no key they would all meet in one task.
    """
    up = nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_up"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = (nodes if of is None else of).select("id", "level", F.array("id").alias("ancestors"), F.col("parent_id").alias("_next"), *[F.array(c).alias(c) for c in columns])
    for _ in range(depth - 1):
        j = out.join(up, (F.coalesce("_next", "id") == F.col("_id")) & F.col("_next").isNotNull(), "left")
        step = F.col("_id").isNotNull() & ~F.array_contains("ancestors", F.col("_id"))
        more = lambda c, x: F.when(step, F.array_prepend(c, F.col(x))).otherwise(F.col(c)).alias(c)  # noqa: B023, E731
        out = j.select("id", "level", more("ancestors", "_id"), F.when(step, F.col("_up")).alias("_next"), *[more(c, f"_{c}") for c in columns])
    return out.withColumnRenamed("_next", "open_end")


def _merged(names: str) -> Column:
    """Names from the root joined by /, equal neighbours once."""
    return F.array_join(F.filter(F.col(names), lambda x, i: (i == 0) | (x != F.get(F.col(names), i - 1))), "/")


def paths(nodes: DataFrame, depth: int = 5) -> DataFrame:
    """id, level, path (names from the root, equal neighbours merged; null for a node deeper than depth), ancestors (ids from the root, or from as far up as depth goes)."""
    return chains(nodes, ["name"], depth).select("id", "level", F.when(F.col("open_end").isNull(), _merged("name")).alias("path"), "ancestors")


def checks(nodes: DataFrame) -> DataFrame:
    """Broken rules: check, id. Roots have no parent, others one on the level above; codes (if there are any) continue the parent's, in the length of their level."""
    has_code = "code" in nodes.columns
    up = nodes.select(F.col("id").alias("_id"), F.col("level").alias("_level"), (F.col("code") if has_code else F.lit(None).cast("string")).alias("_code"))
    j = nodes.join(up, F.col("parent_id") == F.col("_id"), "left")
    n, above = rank_of(F.col("level")), rank_of(F.col("_level"))
    found = [
        F.when((n == 1) & F.col("parent_id").isNotNull(), "root_with_parent"),
        F.when((n > 1) & F.col("parent_id").isNull(), "no_parent"),
        F.when(F.col("parent_id").isNotNull() & F.col("_id").isNull(), "orphan"),
        F.when(F.col("_id").isNotNull() & (above != n - 1), "level_gap"),
    ]
    if has_code:
        found += [F.when(~F.startswith("code", F.col("_code")), "code_prefix"), F.when(~F.col("level").eqNullSafe(level_of_code(F.col("code"))), "code_length")]
    return j.select(F.explode(F.array_compact(F.array(*found))).alias("check"), "id")


def _digits(n: Column, width: Column) -> Column:
    """n with zeros before it; never cut where it needs more places."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(width, F.length(text)), "0")


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WIDTHS]), rank_of(level))


def recode(nodes: DataFrame, depth: int = 5) -> DataFrame:
    """id, level, path, new_code, overflow: I and the ordinals within the parents, in widths 3-2-2-3-4.

    Siblings are numbered by name, id. A node with more siblings than its width has numbers for keeps all its digits and
    is marked, as are the nodes below it (`overflow`): such a tree needs more levels before its codes can be used.
    """
    ordinal = F.row_number().over(Window.partitionBy("parent_id").orderBy("name", "id"))
    own = nodes.withColumn("digits", _digits(ordinal, _width(F.col("level"))))
    own = own.withColumn("wide", F.length("digits") > _width(F.col("level")))
    c = chains(own.select("id", "level", "parent_id", "name", "digits", "wide"), ["name", "digits", "wide"], depth)
    return c.select("id", "level", _merged("name").alias("path"), F.concat(F.lit("I"), F.array_join("digits", "")).alias("new_code"), F.exists("wide", lambda x: x).alias("overflow"))


def code_problems(codes: DataFrame, code: str = "new_code") -> DataFrame:
    """problem, code, n: codes of several nodes, and codes whose length is not that of their level."""
    twice = codes.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("problem"), "code", "n")
    odd = codes.filter(~F.col("level").eqNullSafe(level_of_code(F.col(code)))).select(F.lit("length").alias("problem"), F.col(code).alias("code"), F.lit(1).cast("long").alias("n"))
    return twice.unionByName(odd)


def level_of_code(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, n in enumerate(LENGTHS, 1):
        out = F.when(F.length(code) == n, f"l{k}").otherwise(out)
    return out


def parent_code(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for up, n in zip(LENGTHS, LENGTHS[1:], strict=False):
        out = F.when(F.length(code) == n, F.substring(code, 1, up)).otherwise(out)
    return out


def reparented(nodes: DataFrame) -> DataFrame:
    """Level and parent read from the code: the node whose code is the prefix of a level above; else the declared parent."""
    by = nodes.filter("code IS NOT NULL").groupBy(F.col("code").alias("_code")).agg(F.min("id").alias("_id"))
    j = nodes.withColumn("_prefix", parent_code(F.col("code"))).join(by, F.col("_prefix") == F.col("_code"), "left")
    new = {"parent_id": F.coalesce("_id", "parent_id"), "level": F.coalesce(level_of_code(F.col("code")), "level")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in nodes.columns])


def relevelled(nodes: DataFrame, depth: int = 8) -> DataFrame:
    """id, level, new_level by the distance from the root; null for nodes that reach none (cycles, missing parents, more than depth levels)."""
    c = chains(nodes, ["parent_id"], depth)
    rooted = F.col("open_end").isNull() & F.get("parent_id", F.lit(0)).isNull()
    return c.select("id", "level", F.when(rooted, F.concat(F.lit("l"), F.size("ancestors").cast("string"))).alias("new_level"))


def dense_levels(nodes: DataFrame, level: str = "level") -> DataFrame:
    """Levels numbered without gaps: the k-th of the distinct levels in use becomes k."""
    used = nodes.select(F.col(level).alias("_old")).distinct()  # a few levels
    ranks = used.withColumn("_new", F.dense_rank().over(Window.orderBy("_old")))
    return nodes.join(F.broadcast(ranks), F.col(level).eqNullSafe(F.col("_old"))).withColumn(level, F.col("_new")).drop("_old", "_new")


def clean_codes(nodes: DataFrame) -> DataFrame:
    """id, code, new_code, parent_code, new_parent_code: letters and digits only; a cleaned code that is taken gets a number behind it.

    Codes that are clean keep theirs. Cleaned ones of the same form are numbered in the order of id, over those in use.
    """
    dirty = F.coalesce(F.col("code").rlike("[^A-Za-z0-9]"), F.lit(False))
    base = F.regexp_replace("code", "[^A-Za-z0-9]", "")
    n = nodes.withColumns({"_dirty": dirty, "_base": base})
    w = Window.partitionBy("_base")
    turn = F.row_number().over(w.orderBy("_dirty", "id")) - 1  # 0: has the form to itself or was there first
    n = n.withColumn("_turn", F.when(F.col("_dirty"), turn))
    # a numbered form may itself be in use: such rows get the node's id behind the number, which nothing else has
    used = nodes.select(F.col("code").alias("_used")).distinct()
    tried = F.when(F.col("_turn") > 0, F.concat("_base", F.col("_turn").cast("string"))).otherwise(F.col("_base"))
    n = n.withColumn("_try", tried).join(used, F.col("_dirty") & (F.col("_turn") > 0) & (F.col("_try") == F.col("_used")), "left")
    n = n.withColumn("new_code", F.when(F.col("_used").isNotNull(), F.concat("_try", F.lit("x"), F.col("id").cast("string"))).otherwise(F.col("_try")))
    renamed = n.filter("_dirty").groupBy(F.col("code").alias("_old")).agg(F.min("new_code").alias("_now"))
    return n.join(renamed, F.col("parent_code") == F.col("_old"), "left").select("id", "code", "new_code", "parent_code", F.coalesce("_now", "parent_code").alias("new_parent_code"))


def rebuilt(nodes: DataFrame, depth: int = 13) -> DataFrame:
    """Five levels from a deeper or a shallower tree: three levels of categories, names, and the leaves with their name.

    Of a leaf's path the first three categories stay; a shorter path repeats its last category, a leaf without one stands
    under its own name. Leaves of one name share the node of level four. Result: nodes as `build` makes them, the leaf's
    old id as the name of level five. A leaf deeper than depth is an error.
    """
    ups = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("_up")).distinct()
    leaves = nodes.join(ups, F.col("id") == F.col("_up"), "left_anti")
    c = cut(chains(nodes, ["name"], depth, leaves))
    if not c.filter("open_end IS NOT NULL").isEmpty():
        raise ValueError(f"the tree is deeper than {depth} levels")
    above = F.slice("name", 1, F.greatest(F.lit(1), F.size("name") - 1))
    at = lambda k: F.element_at(above, F.least(F.lit(k), F.size(above)))
    return build(c, [at(1), at(2), at(3), F.element_at("name", -1), F.col("id")])


def descendants(nodes: DataFrame) -> DataFrame:
    """id, path, n_below, n_leaves, n_names per node with something below it. Only numbers are counted; the path is that of the node's own chain."""
    c = cut(chains(nodes, ["name"]))
    below = c.select("level", F.explode(F.slice("ancestors", 1, F.size("ancestors") - 1)).alias("_up"))
    n = below.groupBy("_up").agg(F.count("*").alias("n_below"), F.count_if(F.col("level") == "l5").alias("n_leaves"), F.count_if(F.col("level") == "l4").alias("n_names"))
    return n.join(c.select("id", _merged("name").alias("path")), F.col("_up") == F.col("id")).select("id", "path", "n_below", "n_leaves", "n_names")


def profile(nodes: DataFrame, filled: tuple[str, ...] = ("spec", "unit", "material")) -> DataFrame:
    """Per level: nodes, distinct names, and how many have each of the columns filled."""
    some = lambda c: F.count_if(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)))
    return nodes.groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"), *[some(c).alias(f"n_{c}") for c in filled if c in nodes.columns])


def root_profile(nodes: DataFrame) -> DataFrame:
    """Per root: its name, leaves, and distinct names of level four below it."""
    c = chains(nodes, ["name"]).filter(F.col("level").isin("l4", "l5"))
    root = c.select(F.get("ancestors", F.lit(0)).alias("root"), F.get("name", F.lit(0)).alias("root_name"), "level", F.get("name", F.lit(3)).alias("_name"))
    return root.groupBy("root", "root_name").agg(F.count_if(F.col("level") == "l5").alias("n_leaves"), F.countDistinct("_name").alias("n_names"))


def top_values(nodes: DataFrame, columns: tuple[str, ...] = ("unit", "material"), k: int = 15) -> DataFrame:
    """of, value, n, rank: the k most frequent values of each column, empty ones left out; ties by value."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c in columns]))
    n = nodes.select(each.alias("x")).select("x.of", "x.value").filter("value IS NOT NULL").groupBy("of", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("of").orderBy(F.desc("n"), "value")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def duplicates(nodes: DataFrame, keys: tuple[str, ...] = ("name", "spec", "model", "unit")) -> DataFrame:
    """Groups of nodes equal in the keys (null equals empty), how many parents they have, and the least id: across is true for several parents."""
    text = [F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")).alias(k) for k in keys]
    g = nodes.select(*text, "id", "parent_id").groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("parent_id").alias("n_parents"), F.min("id").alias("first_id"))
    return g.filter("n > 1").withColumn("across", F.col("n_parents") > 1)


def unit_outliers(nodes: DataFrame, family: Column, expected: list[str]) -> DataFrame:
    """Units of the nodes of a family, and whether each is one of the expected ones or empty."""
    unit = F.coalesce(F.trim("unit"), F.lit(""))
    return nodes.filter(family).groupBy(unit.alias("unit")).agg(F.count("*").alias("n")).withColumn("odd", ~F.col("unit").isin("", *expected))


def corrected(nodes: DataFrame, rules: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """nodes with units corrected by rules (word, wrong_unit, right_unit) and without the ids of drop, nor name nodes that this leaves without leaves.

    The rules are a short table written by people; of several that fit the least word counts.
    """
    fits = F.contains(F.col("name"), F.col("word")) & (F.col("unit") == F.col("wrong_unit"))
    best = nodes.join(F.broadcast(rules), fits).groupBy(F.col("id").alias("_id")).agg(F.min(F.struct("word", "right_unit")).alias("_r"))
    out = nodes.join(best, F.col("id") == F.col("_id"), "left").withColumn("unit", F.coalesce("_r.right_unit", "unit")).select(*nodes.columns)
    if drop is None:
        return out
    gone = drop.select("id").distinct()
    left = out.join(gone, "id", "left_anti")
    parents = out.join(gone, "id", "left_semi").select(F.col("parent_id").alias("id")).distinct()
    full = left.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    empty = left.filter("level = 'l4'").select("id").join(parents, "id", "left_semi").join(full, "id", "left_anti")
    return left.join(empty, "id", "left_anti").select(*nodes.columns)


def merge_leaves(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves with equal keys become one: the least id, all sources and how many were merged."""
    return leaves.groupBy(*keys).agg(F.min("id").alias("id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n_merged"))


def children_page(nodes: DataFrame, parent: int | None, offset: int, limit: int, keyword: str = "") -> DataFrame:
    """Children with has_child, a page in the order of name, id; has_more says whether there are others after it."""
    own = nodes.filter(F.col("parent_id").eqNullSafe(F.lit(parent)) & F.contains(F.lower("name"), F.lit(keyword.lower())))
    page = own.orderBy("name", "id").offset(offset).limit(limit + 1)
    ups = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("_up")).distinct()
    out = page.join(ups, F.col("id") == F.col("_up"), "left").withColumn("_n", F.row_number().over(Window.orderBy("name", "id")))  # one page
    return out.select("id", "name", "level", F.col("_up").isNotNull().alias("has_child"), (F.max("_n").over(Window.partitionBy()) > limit).alias("has_more"), "_n").filter(F.col("_n") <= limit).drop("_n")


def search_names(nodes: DataFrame, word: str) -> DataFrame:
    """Nodes whose name holds the word, with path and ancestors."""
    found = nodes.filter(F.contains(F.lower("name"), F.lit(word.lower()))).select("id")
    return paths(nodes).join(found, "id", "left_semi")


def next_codes(new: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Codes for new nodes (parent_code, name) after the greatest of their siblings; overflow where the width has no number left."""
    last = nodes.groupBy(parent_code(F.col("code")).alias("parent_code")).agg(F.max(F.substring("code", -width, width).try_cast("long")).alias("last"))
    n = F.row_number().over(Window.partitionBy("parent_code").orderBy("name"))
    digits = _digits(F.coalesce("last", F.lit(0)) + F.col("_n"), F.lit(width))
    j = new.withColumn("_n", n).join(last, "parent_code", "left")
    return j.withColumn("code", F.concat("parent_code", digits)).withColumn("overflow", F.length(digits) > width).drop("_n", "last")


def fill_codes(nodes: DataFrame) -> DataFrame:
    """Nodes of levels three to five without a code get the next one below their parent, level by level; without a coded parent they stay without."""
    empty = F.col("code").isNull() | (F.col("code") == "")
    for k in (3, 4, 5):
        up = nodes.filter(~empty).select(F.col("id").alias("_up"), F.col("code").alias("_upcode"))
        j = nodes.join(up, F.col("parent_id") == F.col("_up"), "left")
        suffix = F.when(~empty & F.startswith("code", F.col("_upcode")), F.substr("code", F.length("_upcode") + 1).try_cast("long"))
        turn = F.row_number().over(Window.partitionBy("parent_id", "level", empty).orderBy("name", "id"))
        after = F.coalesce(F.max(suffix).over(Window.partitionBy("parent_id")), F.lit(0)) + turn
        fresh = (F.col("level") == f"l{k}") & empty & F.col("_upcode").isNotNull()
        nodes = cut(j.withColumn("code", F.when(fresh, F.concat("_upcode", _digits(after, F.lit(WIDTHS[k - 1])))).otherwise(F.col("code"))).select(*nodes.columns))
    return nodes


def backfill_codes(nodes: DataFrame, coded: DataFrame) -> DataFrame:
    """Codes for nodes (id, level, parent_id, name) from another copy of the tree (the same columns and code).

    Levels one to four by the path of names, level five by the ordinal among the leaves of one parent.
    """
    def keyed(df: DataFrame, *more: str) -> DataFrame:
        p = chains(df, ["name"]).select("id", "level", F.when(F.col("level") == "l5", F.slice("name", 1, F.size("name") - 1)).otherwise(F.col("name")).alias("_names"))
        turn = F.when(F.col("level") == "l5", F.row_number().over(Window.partitionBy("level", "_names").orderBy("id"))).otherwise(F.lit(1))
        return p.withColumn("_turn", turn).join(df.select("id", *more), "id")

    theirs = keyed(coded, "code").groupBy("level", "_names", "_turn").agg(F.min("code").alias("code"))
    return keyed(nodes).join(theirs, ["level", "_names", "_turn"], "left").select("id", "level", "code")


def repaired_links(items: DataFrame, nodes: DataFrame, name: str = "std_name", link: str = "material_dict_id") -> DataFrame:
    """Items with links to nodes that are gone, or with none, linked by name: the node of level four first, then the least id."""
    best = nodes.groupBy(F.trim("name").alias("_name")).agg(F.min(F.struct((F.col("level") != "l4").alias("x"), "id")).alias("_best"))
    there = nodes.select(F.col("id").alias("_id")).distinct()
    j = items.join(there, F.col(link) == F.col("_id"), "left").join(best, F.trim(name) == F.col("_name"), "left")
    return j.select(*[F.coalesce("_id", "_best.id").alias(link) if c == link else F.col(c) for c in items.columns])


def change_problems(changes: DataFrame, nodes: DataFrame, used: DataFrame) -> DataFrame:
    """changes: change_id, action (create, update, delete), id, parent_id, level, name; used: dict_id in use by items.

    problem, change_id for each change that may not be made: no_parent (or one on a wrong level), same_name (among the
    siblings, or in the change set itself), has_children, in_use, no_node. A change without a row here is good.
    """
    up = nodes.select(F.col("id").alias("_up"), F.col("level").alias("_uplevel"))
    own = nodes.select(F.col("id").alias("_own"))
    siblings = nodes.select(F.col("parent_id").alias("_sp"), F.trim("name").alias("_sn"), F.col("id").alias("_sid"))
    kids = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("_kid")).distinct()
    made, gone, kept = F.col("action") == "create", F.col("action") == "delete", F.col("action") != "create"
    say = lambda df, why: df.select(F.lit(why).alias("problem"), "change_id").distinct()
    j = changes.join(up, F.col("parent_id") == F.col("_up"), "left")
    fits = F.when(F.col("level") == "l1", F.col("parent_id").isNull()).otherwise(F.coalesce(rank_of(F.col("_uplevel")) == rank_of(F.col("level")) - 1, F.lit(False)))
    others = changes.filter(~gone).join(siblings, F.col("parent_id").eqNullSafe(F.col("_sp")) & (F.trim("name") == F.col("_sn")) & ~F.col("_sid").eqNullSafe(F.when(kept, F.col("id"))))
    again = F.row_number().over(Window.partitionBy("parent_id", F.trim("name")).orderBy("change_id"))
    return (
        say(j.filter(made & ~fits), "no_parent")
        .unionByName(say(others, "same_name"))
        .unionByName(say(changes.filter(made).withColumn("_k", again).filter("_k > 1"), "same_name"))
        .unionByName(say(changes.filter(gone).join(kids, F.col("id") == F.col("_kid"), "left_semi"), "has_children"))
        .unionByName(say(changes.filter(gone).join(used.select(F.col("dict_id").alias("_used")).distinct(), F.col("id") == F.col("_used"), "left_semi"), "in_use"))
        .unionByName(say(changes.filter(kept).join(own, F.col("id") == F.col("_own"), "left_anti"), "no_node"))
        .distinct()
    )
