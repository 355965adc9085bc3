"""Mixing sources to target weights by entropy balancing [native].

Every document i of a source gets a rate r_i, how often the mix takes it. Among all rates whose expected words equal the
source's target T, entropy balancing takes those closest to 1 in relative entropy; its Lagrangian gives an exponential tilt
``r_i = exp(lambda_s * u_i)`` with ``u_i = size_i / mean size of the source``, cut at ``max_rate``. ``lambda_s`` is the root
of the dual's gradient ``g(l) = sum size_i * min(max_rate, exp(l * u_i)) - T``, found by safeguarded Newton steps.

A rate depends on (source, size) alone, so the iterations run over the table of counts by (source, size), all sources at
once: one partial aggregation a step, with sums in decimals, so that the order of summation can't change a result. Nothing
but the greatest residual reaches the driver.

Rates become copies by systematic rounding: within a source, ordered by size, document j gets
``floor(F_j + p) - floor(F_(j-1) + p)`` extra copies, F the running sum of the rates' fractions. Neighbours differ little in
size, so a source's words miss their expectation by about one document; the phase p is the one of ``PHASES`` that misses
least, found from the counts by (source, size). The running sum is put together from counts by (source, size), counts by
(source, size, salt) and a row number within one salt; salts grow with the rows, and rows that are equal in key and text and too
many for a task are divided further (``hot``), so no source or group of copies meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import hot
from lattica.operators.numbering import numbered
from lattica.session import cut

#: Words, as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this many are broadcast (a row is under 200 bytes); beyond, Spark chooses the join.
BROADCAST_SOURCES = 100_000
#: Salts at least; more where each would have more than ``hot.HOT`` rows of all.
SALTS = 64
#: Runs of the order of sources that are numbered apart, where sources are many.
RUNS = 1024
PHASES = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ids(sources: DataFrame, few: bool) -> DataFrame:
    """``sources`` with sid: 0, 1, ... in code-point order, null last."""
    if few:
        return sources.withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    some = sorted(r.source for r in sources.filter("source is not null").orderBy(F.xxhash64("source")).limit(16 * RUNS).select("source").collect())
    bounds = F.array(*map(F.lit, [some[i * len(some) // RUNS] for i in range(1, RUNS)])) if some else F.array().cast("array<string>")
    run = F.when(F.col("source").isNull(), F.lit(RUNS)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("source"))))
    return numbered(sources, "sid", [F.col("source").asc_nulls_last()], run)


def targets(sources: DataFrame, weights: tuple[int, ...], max_rate: int) -> DataFrame:
    """(sid, source, source_size, n) -> the same with weight and target.

    Targets share the total by weight; those above ``max_rate`` times their source's size stop there and the excess goes to
    the others by weight until none is above. What a weight of 1 gets only rises on the way, so a pass over the sources needs
    but that level of the pass before: two sums a pass, in whole numbers.
    """
    big = "decimal(38,0)"
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    rated = cut(sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(max_rate)))
    total, free = (int(x or 0) for x in rated.agg(F.sum(F.col("source_size").cast(big)), F.sum(F.col("weight").cast(big))).first())
    rest = total
    while True:
        capped = F.col("cap").cast(big) * F.lit(free).cast(big) <= F.col("weight").cast(big) * F.lit(rest).cast(big)
        stopped, among = (int(x or 0) for x in rated.agg(F.sum(F.when(capped, F.col("cap")).cast(big)), F.sum(F.when(~capped, F.col("weight")).cast(big))).first())
        if (total - stopped, among) == (rest, free) or not among:
            break
        rest, free = total - stopped, among
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(float(total - stopped)) / F.lit(float(max(among, 1))))
    return rated.select("sid", "source", "source_size", "n", "weight", target.cast("double").alias("target"))


def tilts(counts: DataFrame, sources: DataFrame, max_rate: int, small: bool, steps: int = 80, near: float = 1e-9) -> DataFrame:
    """(sid, lambda): the dual's solution for every source; null where nothing is to be solved."""
    join = F.broadcast if small else (lambda x: x)
    ratio = F.col("target") / F.col("source_size")
    state = sources.filter("source_size > 0").select(
        "sid", "source_size", "target", (F.col("source_size") / F.col("n")).alias("mean"),
        F.log(ratio).alias("l"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        (ratio >= max_rate).alias("done"),
    )
    state = cut(state)
    exact = "decimal(38,9)"
    for _ in range(steps):
        u = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(max_rate)), F.exp(F.least(F.col("l") * u, F.lit(20.0))))
        mass = (F.col("c") * F.col("size")).cast("double")
        sums = (
            counts.filter("size > 0").join(join(state.filter("not done")), "sid")
            .groupBy("sid")
            .agg(F.sum((mass * rate).cast(exact)).cast("double").alias("got"),
                 F.sum(F.when(rate < max_rate, mass * rate * u).otherwise(0.0).cast(exact)).cast("double").alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("l")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("l")).otherwise(F.col("hi"))
        moved = state.join(join(sums), "sid", "left").withColumn("gap", gap).withColumn("lo", lo).withColumn("hi", hi)
        newton = F.when(F.col("slope") > 0, F.col("l") - F.col("gap") / F.col("slope"))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        wide = F.abs(F.col("l")) * 2 + 1
        halved = F.when(F.col("lo").isNull(), F.col("hi") - wide).when(F.col("hi").isNull(), F.col("lo") + wide).otherwise((F.col("lo") + F.col("hi")) / 2)
        step = F.when(inside, newton).otherwise(halved)
        # over max_rate's reach only by rounding: a tilt of 60 takes every word max_rate times
        ends = (F.abs(F.col("gap")) <= F.lit(near) * F.col("target")) | (F.abs(F.col("l")) > 1e6) | (F.abs(step - F.col("l")) < 1e-12)
        state = cut(
            moved.select(
                "sid", "source_size", "target", "mean",
                F.when(F.col("done") | ends | F.col("gap").isNull(), F.col("l")).otherwise(step).alias("l"), "lo", "hi",
                (F.col("done") | F.coalesce(ends, F.lit(True))).alias("done"),
            )
        )
        if state.filter("not done").isEmpty():
            break
    return state.select("sid", "l", "mean", (F.col("target") >= F.lit(max_rate) * F.col("source_size")).alias("full"))


def phases(rated: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, phase): the phase whose rounded copies bring each source nearest to its target."""
    phase = F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1)))
    after = (F.col("before") + F.col("part") * F.col("c")).cast("decimal(38,12)")
    tried = rated.select("sid", "size", "c", "whole", "before", after.alias("after"), phase.alias("k")).withColumn("phase", (F.col("k") / PHASES).cast("decimal(10,9)"))
    words = (F.col("whole") * F.col("c") + F.floor(F.col("after") + F.col("phase")) - F.floor(F.col("before") + F.col("phase"))) * F.col("size")
    got = tried.groupBy("sid", "phase").agg(F.sum(words.cast("long")).alias("got")).join(sources.select("sid", "target"), "sid")
    return got.groupBy("sid").agg(F.min(F.struct(F.abs(F.col("got") - F.col("target")), "phase"))["phase"].alias("phase"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_rate: int = 3, text: str = "text", source: str = "source", key: str = "doc_id", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of ``docs`` with copies (how often the mix takes it), rate, size, source_size and target.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share all words. Null text: size 0. A document
    without words gets no copies, as does every document of a source without words. Repeated rows are rounded one by one,
    in an order that ties can't change (key, then a hash of the text; rows equal in both are interchangeable). An empty table
    gives an empty result. The columns ``carry`` are kept (all, if None; fewer
    move fewer bytes); those with names of the result's own are replaced.
    """
    own = ["size", "source_size", "target", "rate", "copies"]
    base = docs.select(
        F.struct(*[c for c in (docs.columns if carry is None else carry) if c not in own]).alias("row"), word_count(F.col(text)).alias("size"),
        F.col(source).alias("source"), F.xxhash64(F.col(key), F.col(text)).alias("mark"), F.col(key).alias("key"),
    )
    # texts are read once for their sizes; what is carried is read again, or written too where it is a few plain columns
    kinds = dict(docs.dtypes)
    slim = carry is not None and all(c != text and not kinds[c].startswith(("struct", "array", "map")) for c in carry)
    narrow = cut(base if slim else base.drop("row"))
    base = narrow if slim else base
    by_source = narrow.groupBy("source", "size").agg(F.count("*").alias("c"))
    by_source = cut(by_source)
    found = by_source.groupBy("source").agg(F.sum(F.col("c") * F.col("size")).alias("source_size"), F.sum("c").alias("n"))
    found = cut(found)
    number, all_rows, most = by_source.agg(F.count_distinct(F.struct("source")), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    small = number <= BROADCAST_SOURCES
    sources = cut(targets(_ids(found, small), weights, max_rate))
    join = F.broadcast if small else (lambda x: x)

    same = F.col("source").eqNullSafe(F.col("s"))
    ids = sources.select(F.col("source").alias("s"), "sid")
    counts = by_source.join(join(ids), same).select("sid", "size", "c")
    solved = cut(tilts(counts, sources, max_rate, small))

    # rates by (source, size), and the sum of fractions before each size
    u = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), float(max_rate)).otherwise(F.least(F.lit(float(max_rate)), F.exp(F.least(F.col("l") * u, F.lit(20.0)))))
    exact = F.col("rate") - F.col("whole").cast("decimal(28,12)")
    rated = (
        counts.join(join(solved), "sid", "left")
        .withColumn("rate", F.coalesce(rate, F.lit(0.0)).cast("decimal(28,12)"))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("part", exact.cast("decimal(28,12)"))
        .withColumn("before", F.coalesce(F.sum(F.col("part") * F.col("c")).over(Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,12)"))
        .select("sid", "size", "c", "rate", "whole", "part", "before")
    )
    rated = rated.join(join(phases(rated, sources)), "sid").drop("c")
    # rows equal in key and text are few, or divided: such a group can't be larger than all rows of its source and size
    lanes = hot.divided(base, ["key", "mark"], narrow) if most > hot.HOT else None
    lane = [] if lanes is None else ["lane"]
    if lanes is not None:
        base, narrow = lanes, lanes.drop("row")
    cell = ["sid", "size", "salt", *lane]

    def salted(rows: DataFrame) -> DataFrame:
        rows = rows.join(join(sources.select(F.col("source").alias("s"), "sid", "source_size", "target")), same).drop("s", "source")
        rows = rows.withColumn("salt", F.pmod(F.col("mark"), F.lit(max(SALTS, -(-all_rows // hot.HOT)))).cast("int"))
        if lane:  # the divided rows of a salt come after its others
            turn = F.struct(F.xxhash64("key").alias("k"), F.col("mark").alias("m"), F.pmod("turn", "turns").alias("t"))
            rows = rows.withColumn("lane", F.coalesce(F.to_json(F.when(F.col("turn").isNotNull(), turn)), F.lit(""))).drop("turn", "turns")
        return rows

    places = (
        salted(narrow).groupBy(*cell).agg(F.count("*").alias("c"))
        .withColumn("ahead", F.coalesce(F.sum("c").over(Window.partitionBy("sid", "size").orderBy("salt", *lane).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(rated, ["sid", "size"])
        .select(*cell, "ahead", "rate", "whole", "part", "before", "phase")
    )
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("key", "mark")) - 1
    at = (F.col("before") + F.col("part") * (F.col("ahead") + place).cast("decimal(20,0)")).cast("decimal(38,12)")
    extra = F.floor(F.col("at") + F.col("part") + F.col("phase")) - F.floor(F.col("at") + F.col("phase"))
    return (
        salted(base).join(places, cell)
        .withColumn("at", at)
        .withColumn("copies", (F.col("whole") + extra).cast("long"))
        .select("row.*", "size", "source_size", "target", F.col("rate").cast("double").alias("rate"), "copies")
    )


def take(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_rate: int = 3, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, every row as often as ``mix`` takes it; so rows without words
    (null, empty or blank texts) never. Null sources are one source, null keys and repeated rows count each. An empty table gives
    an empty result."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    mixed = mix(rows, weights, max_rate, key="key", carry=("__row",))
    return mixed.filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
