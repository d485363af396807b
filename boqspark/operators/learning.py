"""Learning from confirmations: rolling hit rates, drift, queues by uncertainty, and per-category algorithm weights.

A confirmation is a row with, for each algorithm, its first candidate's id and score and where the confirmed id stood
among its candidates (`signals` makes the columns). The weights of a category are one sequence by nature: its rows
stream through one task in order, with a small state. Everything else is a window or an aggregate.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, dealt

ALGORITHMS = ("edit", "tfidf", "vector")
# Start, bounds and smoothing of the weights; steps by phase; strategies (step, smoothing); windows of drift and fusion.
START, LOW, HIGH, EMA = (0.3, 0.35, 0.35), 0.05, 0.85, 0.3
BASE_RATE, LEAST_RATE, MOST_RATE, PHASES = 0.1, 0.02, 0.25, ((100, 1.5), (500, 1.0), (None, 0.5))
STRATEGIES = (("fast", 1.5, 0.5), ("balanced", 1.0, 0.3), ("stable", 0.5, 0.15))
FUSION_START, FUSION_WINDOW = 0.7, 20
PLAIN_STEP, PLAIN_LOW, PLAIN_HIGH = 0.1, 0.1, 0.8
WINDOW, DRIFT_FROM, DRIFT_BELOW, NEW_BELOW = 50, 25, 0.5, 5
UNSURE_HIGH, UNSURE_MEDIUM = 0.6, 0.3
#: Halves go up when scores are rounded, whatever the order of the additions.
_HALF = 1e-9


# --- rolling windows ---


def running(rows: DataFrame, count: Column, name: str, *keys: str, unit: str = "hour") -> DataFrame:
    """rows (ts, id) with `name`: how many of the key's rows up to this one, in the order of ts, id, count (an integer column).

    Counts by unit of time are added up first; only the rows of one unit are ordered in a task. Without keys: of all rows.
    """
    rows = rows.withColumns({"_unit": F.date_trunc(unit, "ts"), "_one": count})
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("_unit").rowsBetween(Window.unboundedPreceding, 0))
    units = rows.groupBy(*keys, "_unit").agg(F.sum("_one").alias("_n")).withColumn("_before", upto - F.col("_n"))
    units = units.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_unit").alias("_u"), "_before")
    inside = F.sum("_one").over(Window.partitionBy(*keys, "_unit").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_unit").eqNullSafe(F.col("_u"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.withColumn("_inside", inside).join(units, same)
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_unit", "_one", "_before", "_inside", "_u", *[f"_k_{k}" for k in keys])


def _in_chunks(events: DataFrame, window: int, chunk: int) -> DataFrame:
    """events (category, ts, id, hit) with rate, seen (over the last `window` rows of the category), _at (place from 0) and _chunk.

    A category is not one task: its rows are numbered and cut into chunks that begin with the last window - 1 rows of the chunk before.
    """
    rows = running(events, F.lit(1), "_at", "category").withColumn("_at", F.col("_at") - 1)
    own = F.floor(F.col("_at") / chunk)
    place = lambda k, extra: F.struct(k.alias("_chunk"), F.lit(extra).alias("_extra"))
    tail = F.col("_at") - own * chunk >= chunk - (window - 1)
    rows = rows.select("*", F.inline(F.when(tail, F.array(place(own, False), place(own + 1, True))).otherwise(F.array(place(own, False)))))
    w = Window.partitionBy("category", "_chunk").orderBy("_at").rowsBetween(1 - window, 0)
    return rows.withColumns({"rate": F.avg("hit").over(w), "seen": F.count("*").over(w)}).filter("NOT _extra").drop("_extra")


def hit_rates(events: DataFrame, window: int = WINDOW, chunk: int = 100_000) -> DataFrame:
    """events: category, ts, id, hit (0/1) -> with the hit rate of the last confirmations of the category, and how many there are."""
    return _in_chunks(events, window, chunk).select(*events.columns, "rate", "seen")


def fusion(events: DataFrame, chunk: int = 100_000) -> DataFrame:
    """events (ts, id, hit: whether any algorithm hit) -> id, fusion: the share of the best strategy after each confirmation, over the one
    sequence of all of them.

    From the twentieth confirmation on it moves a tenth of the way to 0.5 + 0.4 * the hit rate of the last twenty. That is linear in
    what it was before: each chunk of the sequence is worked out from nothing, the ends of the chunks (a row each) give what each really
    starts from, and 0.9 to the power of the steps since then says how much of that is left.
    """
    rows = _in_chunks(events.select(F.lit("").alias("category"), "ts", "id", "hit"), FUSION_WINDOW, chunk).select("_chunk", "_at", "id", "rate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, left = None, 0.0, 1.0
        for b in batches:
            out = []
            for k, at, key, rate in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != now:
                    now, own, left = k, 0.0, 1.0
                if at >= FUSION_WINDOW - 1:
                    own, left = 0.9 * own + 0.1 * (0.5 + 0.4 * rate), 0.9 * left
                out.append((k, at, key, own, left))
            if out:
                types = [pa.int64(), pa.int64(), b.column(2).type, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["_chunk", "_at", "id", "own", "left"])

    kind = rows.schema["id"].dataType.simpleString()
    alone = cut(dealt(rows, "_chunk").sortWithinPartitions("_chunk", "_at").mapInArrow(run, f"_chunk long, _at long, id {kind}, own double, left double"))
    ends = alone.groupBy("_chunk").agg(F.max(F.struct("_at", "own", "left")).alias("e")).select("_chunk", "e.own", "e.left").orderBy("_chunk").collect()  # a row per chunk
    starts, value = [], FUSION_START
    for r in ends:
        starts.append((r["_chunk"], value))
        value = r["own"] + r["left"] * value
    begin = F.broadcast(events.sparkSession.createDataFrame(starts, "_chunk long, _start double"))
    return alone.join(begin, "_chunk").select("id", (F.col("own") + F.col("left") * F.col("_start")).alias("fusion"))


def drift(rated: DataFrame) -> DataFrame:
    return rated.withColumn("drift", (F.col("seen") >= DRIFT_FROM) & (F.col("rate") < DRIFT_BELOW))


def surges(events: DataFrame, stream: str, window: int = WINDOW) -> DataFrame:
    """events: stream, category, ts, id -> n_seen, n_categories, n_new and surge: at least half of the categories among the
    last confirmations of the stream have had fewer than five confirmations in it so far."""
    w = Window.partitionBy(stream).orderBy("ts", "id").rowsBetween(1 - window, 0)
    so_far = F.count("*").over(Window.partitionBy(stream, "category").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("_n", so_far).withColumn("_last", F.collect_list(F.struct("category", "_n")).over(w))
    kinds = F.array_distinct(F.transform("_last", lambda x: x["category"]))
    count = lambda k: F.array_max(F.transform(F.filter("_last", lambda x: x["category"].eqNullSafe(k)), lambda x: x["_n"]))
    rows = rows.withColumns({"n_seen": F.size("_last"), "n_categories": F.size(kinds), "n_new": F.size(F.filter(kinds, lambda k: count(k) < NEW_BELOW))})
    return rows.withColumn("surge", (F.col("n_seen") >= DRIFT_FROM) & (F.col("n_new") >= 0.5 * F.col("n_categories"))).drop("_n", "_last")


# --- uncertainty ---


def info_quality(ids: Column, scores: Column) -> Column:
    """Disagreement of the algorithms' first candidates (null: none) and how close their scores are; low if they agree or are few."""
    known, real = F.filter(ids, lambda x: x.isNotNull()), F.filter(scores, lambda x: x > 0)
    n, distinct = F.size(known), F.size(F.array_distinct(known))
    mean = F.aggregate(real, F.lit(0.0), lambda a, x: a + x) / F.size(real)
    var = F.aggregate(real, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(real)
    close = F.when(F.size(real) >= 2, 1 - F.least(F.lit(1.0), var / 100)).otherwise(0.5)
    value = 0.6 * (distinct - 1) / F.greatest(n - 1, F.lit(1)) + 0.4 * close
    return F.when(n < 2, 0.3).when(distinct == 1, F.least(F.lit(0.4), value)).otherwise(value)


def uncertainty(ids: Column, first: Column, second: Column) -> Column:
    """0 to 1 from the algorithms' first ids, first and second scores: disagreement, low scores, small gaps, few algorithms."""
    known, real = F.filter(ids, lambda x: x.isNotNull()), F.filter(first, lambda x: x > 0)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    gaps = F.transform(F.filter(F.arrays_zip(first.alias("a"), second.alias("b")), lambda p: (p["a"] > 0) & (p["b"] > 0)), lambda p: p["a"] - p["b"])
    apart = F.when(F.size(known) >= 2, 0.35 * F.size(F.array_distinct(known)) / F.size(known)).otherwise(0.0)
    weak = F.when(F.size(real) > 0, 0.25 * F.greatest(F.lit(0.0), 1 - mean(real) / 90)).otherwise(0.0)
    near = F.when(F.size(gaps) > 0, 0.25 * F.greatest(F.lit(0.0), 1 - mean(gaps) / 15)).otherwise(0.0)
    few = F.when(F.size(real) < 3, 0.15 * (1 - F.size(real) / 3)).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), apart + weak + near + few)) + _HALF, 4)


def uncertainty_level(c: Column) -> Column:
    return F.when(c >= UNSURE_HIGH, "high").when(c >= UNSURE_MEDIUM, "medium").otherwise("low")


def queue(items: DataFrame) -> DataFrame:
    """items: id, category, uncertainty, length (of name and spec) -> priority: uncertainty, the first of a category, longer texts first."""
    first = F.row_number().over(Window.partitionBy("category").orderBy("id")) == 1
    term = 0.1 * F.least(F.lit(1.0), F.col("length") / 50)
    return items.withColumn("priority", F.round(0.7 * F.col("uncertainty") + F.when(first, 0.2).otherwise(0.0) + term + _HALF, 4))


# --- weights ---


def category_of(path: Column) -> Column:
    """The first two parts of a category path."""
    return F.when(F.coalesce(path, F.lit("")) == "", "_default").otherwise(F.array_join(F.slice(F.split(path, "/"), 1, 2), "/"))


def rank_of(confirmed: Column, candidates: Column) -> Column:
    """Place of the confirmed id among candidates, from 0; -1 if it is not there."""
    return F.coalesce(F.array_position(candidates, confirmed) - 1, F.lit(-1))


def signals(confirmations: DataFrame) -> DataFrame:
    """confirmations: confirmed_id, path and per algorithm a: a_id, a_score, a_candidates -> category, a_hit, a_rank, a_score, quality."""
    out = {"category": category_of(F.col("path"))}
    for a in ALGORITHMS:
        out |= {f"{a}_hit": F.coalesce((F.col(f"{a}_id") == F.col("confirmed_id")).cast("int"), F.lit(0)), f"{a}_rank": rank_of(F.col("confirmed_id"), F.col(f"{a}_candidates")).cast("int")}
    out["quality"] = info_quality(F.array(*[F.col(f"{a}_id") for a in ALGORITHMS]), F.array(*[F.col(f"{a}_score").cast("double") for a in ALGORITHMS]))
    return confirmations.withColumns(out)


def _unit(values: list[float]) -> list[float]:
    total = sum(values)
    return [round(v / total, 4) for v in values] if total > 0 else values


class Weights:
    """State of one category; one event at a time, in order. Weights sum to one after each, in four decimals."""

    def __init__(self, state: tuple | None = None):
        if state is None:
            state = (list(START), 0, 0, list(START) * len(STRATEGIES), [], [], FUSION_START)
        values, self.n, self.n_rejected, flat, hits, own, self.fusion = state
        self.values = list(values)
        self.strategies = [list(flat[i : i + 3]) for i in range(0, len(flat), 3)]
        self.hits = deque(hits, FUSION_WINDOW)  # whether any algorithm hit
        self.own = deque(own, WINDOW)  # for each strategy a bit: whether the algorithm that it weights most hit

    def state(self) -> tuple:
        return (self.values, self.n, self.n_rejected, [v for s in self.strategies for v in s], list(self.hits), list(self.own), self.fusion)

    def rate(self, quality: float, n: int | None = None) -> float:
        """Step of a confirmation; the phase goes by the confirmations of the category, or by those of all where that is given."""
        phase = next(m for upto, m in PHASES if upto is None or (self.n if n is None else n) < upto)
        return max(LEAST_RATE, min(MOST_RATE, BASE_RATE * phase * (1 + quality)))

    @staticmethod
    def _moved(values: list[float], by: list[float], ema: float) -> list[float]:
        aim = [max(LOW, min(HIGH, v + d)) for v, d in zip(values, by, strict=True)]
        return _unit([ema * a + (1 - ema) * v for a, v in zip(aim, values, strict=True)])

    def confirm(self, hits: list[bool], ranks: list[int] | None = None, scores: list[float] | None = None, quality: float = 0.5, overall: int | None = None) -> None:
        """Algorithms whose first candidate was confirmed gain, more with a high score; others lose, most if the confirmed one stood high."""
        ranks, scores = ranks or [-1] * len(hits), scores or [0.0] * len(hits)
        self.n += 1
        step = self.rate(quality, overall)
        change = [step * (1 + 0.3 * s / 100) if h else -step * (1 - 0.2 * r) if r >= 0 else -0.5 * step for h, r, s in zip(hits, ranks, scores, strict=True)]
        self.values = self._moved(self.values, change, EMA)
        bits = 0
        for i, (_, faster, ema) in enumerate(STRATEGIES):
            own = self.strategies[i]
            bits |= bool(hits[own.index(max(own))]) << i
            lr = BASE_RATE * faster * (1 + round(quality, 4))
            self.strategies[i] = self._moved(own, [lr if h else -0.5 * lr for h in hits], ema)
        self.own.append(bits)
        self.hits.append(int(any(hits)))
        if self.n >= FUSION_WINDOW:
            self.fusion = 0.9 * self.fusion + 0.1 * (0.5 + 0.4 * sum(self.hits) / len(self.hits))

    def plain(self, hits: list[bool]) -> None:
        """The first, simpler rule: a fixed step up or down within its own bounds, no smoothing."""
        self.n += 1
        self.values = _unit([max(PLAIN_LOW, min(PLAIN_HIGH, v + (PLAIN_STEP if h else -PLAIN_STEP))) for v, h in zip(self.values, hits, strict=True)])

    def reject(self, algorithm: int, overall: int | None = None) -> None:
        """A candidate of the algorithm was refused: it loses half a step."""
        self.n_rejected += 1
        self.values[algorithm] = max(LOW, self.values[algorithm] - 0.5 * self.rate(0.5, overall))
        self.values = _unit(self.values)

    def best(self) -> int:
        """The strategy with the highest rolling hit rate, the first of equals."""
        rates = [sum(b >> i & 1 for b in self.own) for i in range(len(STRATEGIES))]
        return rates.index(max(rates))

    def fused(self) -> list[float]:
        """The best strategy by the fusion share, the others by equal parts of the rest."""
        best, rest = self.best(), (1 - self.fusion) / (len(STRATEGIES) - 1)
        return _unit([sum((self.fusion if i == best else rest) * s[a] for i, s in enumerate(self.strategies)) for a in range(len(ALGORITHMS))])


LEARNED = "category string, n long, edit double, tfidf double, vector double, fused_edit double, fused_tfidf double, fused_vector double, fusion double, strategy string"
_EACH = [f"{a}_{x}" for x in ("hit", "rank", "score") for a in ALGORITHMS]


def event_columns(events: DataFrame) -> list[Column]:
    """The columns that an event needs; ranks, scores, quality, the rejected algorithm (its place, null: a confirmation) and the number of
    confirmations of all categories so far (`overall`, null: the phase goes by the category's own) may be missing."""
    default = {"hit": 0, "rank": -1, "score": 0.0}
    kind = {"hit": "int", "rank": "int", "score": "double"}
    own = lambda c, d, t: (F.coalesce(F.col(c).cast(t), F.lit(d)) if c in events.columns else F.lit(d).cast(t)).alias(c)
    each = [own(f"{a}_{x}", default[x], kind[x]) for x in default for a in ALGORITHMS]
    rejected = (F.col("rejected").cast("int") if "rejected" in events.columns else F.lit(None).cast("int")).alias("rejected")
    overall = (F.col("overall").cast("long") if "overall" in events.columns else F.lit(None).cast("long")).alias("overall")
    return [F.col("category"), *each, own("quality", 0.5, "double"), rejected, overall]


def apply_event(w: Weights, row: tuple) -> None:
    """row: hits, ranks, scores of the algorithms, quality, rejected, overall."""
    overall = int(row[11]) if row[11] is not None and row[11] == row[11] else None
    if row[10] is not None and row[10] == row[10]:
        w.reject(int(row[10]), overall)
    else:
        w.confirm([bool(x) for x in row[:3]], [int(x) for x in row[3:6]], list(row[6:9]), row[9], overall)


def learned_row(category, w: Weights) -> tuple:
    return (category, w.n, *w.values, *w.fused(), w.fusion, STRATEGIES[w.best()][0])


def replay(events: DataFrame, each: bool = False, plain: bool = False, overall: bool = False) -> DataFrame:
    """Weights per category after all its events (category, ts, id and `event_columns`), replayed in order.

    each: after every event, with its id. plain: confirmations by the simpler rule, rejections left out. overall: the learning phase goes
    by the confirmations of all categories so far, which are counted first.
    """
    import pandas as pd

    if overall:
        made = (F.col("rejected").isNull() if "rejected" in events.columns else F.lit(True)).cast("int")
        events = running(events, made, "overall")

    names = [x.split()[0] for x in LEARNED.split(", ")]

    def run(batches: Iterator) -> Iterator:
        state, category = Weights(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if category is not None and row[1] != category:
                    if not each:
                        out.append(learned_row(category, state))
                    state = Weights()
                category = row[1]
                if not plain:
                    apply_event(state, row[2:])
                elif row[12] != row[12] or row[12] is None:
                    state.plain([bool(x) for x in row[2:5]])
                if each:
                    out.append((row[0], *learned_row(category, state)))
            if out:
                yield pd.DataFrame(out, columns=["id", *names] if each else names)
        if category is not None and not each:
            yield pd.DataFrame([learned_row(category, state)], columns=names)

    ordered = dealt(events, "category").sortWithinPartitions("category", "ts", "id").select("id", *event_columns(events))
    return ordered.mapInPandas(run, f"id long, {LEARNED}" if each else LEARNED)


def weights_for(items: DataFrame, learned: DataFrame, overall: tuple[float, ...] = START) -> DataFrame:
    """items (path) with w_<algorithm>: the category's from ten confirmations on, a blend with the overall ones below, these alone without any."""
    own = learned.select(F.col("category").alias("_c"), F.col("n").alias("_n"), *[F.col(a).alias(f"_{a}") for a in ALGORITHMS])
    j = items.join(F.broadcast(own), category_of(F.col("path")) == F.col("_c"), "left")
    share = F.least(F.lit(0.5), F.col("_n") / 20)
    use = lambda a, w: F.when(F.col("_n") >= 10, F.col(f"_{a}")).when(F.col("_n") > 0, F.round(share * F.col(f"_{a}") + (1 - share) * w, 4)).otherwise(w)
    return j.withColumns({f"w_{a}": use(a, w) for a, w in zip(ALGORITHMS, overall, strict=True)}).drop("_c", "_n", *[f"_{a}" for a in ALGORITHMS])


def stats(events: DataFrame) -> DataFrame:
    """Per category: confirmations, rejections, those of high information, and each algorithm's hits of hits and rejections."""
    e = events.select(*event_columns(events))
    made = F.col("rejected").isNull()
    rate = lambda i, a: F.round(F.coalesce(F.try_divide(F.sum(F.when(made, F.col(f"{a}_hit"))), F.sum(F.when(made, F.col(f"{a}_hit")).otherwise((F.col("rejected") == i).cast("int")))), F.lit(0.0)), 4)
    return e.groupBy("category").agg(
        F.count_if(made).alias("n_confirmed"), F.count_if(~made).alias("n_rejected"), F.count_if(made & (F.col("quality") > 0.6)).alias("n_high"), *[rate(i, a).alias(f"{a}_rate") for i, a in enumerate(ALGORITHMS)]
    )


def trend(trajectory: DataFrame, last: int = 10) -> DataFrame:
    """The last weights of each category, newest first; trajectory: `replay(each=True)` with the order columns ts, id."""
    w = Window.partitionBy("category").orderBy(F.desc("ts"), F.desc("id"))
    return trajectory.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= last)
