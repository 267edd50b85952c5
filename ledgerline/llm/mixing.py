"""Mixing sources to target weights: packed blocks, multinomial draws by output shard, pseudorandom index permutations.

Everything is DataFrame work: sizes and positions by aggregates and bounded windows, draws and permutations by hashes, and one
join of slots to blocks by index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.runtime import settle

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Parameters: words in a block, slots in an output shard, the largest number of repeats, and the seed of all draws."""

    block_words: int = 64
    shard_slots: int = 1 << 16
    most: int = 3
    seed: int = 11
    # Rows of one source whose positions are counted in one window.
    run_rows: int = 4096
    # Cells that the unit interval is cut into, so that a draw finds its source by an equal join.
    cells: int = 1 << 12
    rounds: int = 6


def word_count(text: str) -> Column:
    """Words of a text (runs of other characters than space, tab and \\n \\v \\f \\r); null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that follows from the parts: 53 bits of their hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, rank, source_size, weight, target) from rows of (source, size).

    Sources in code-point order, null last, weigh 1, 2, 3 and so on in turn, and share all words by weight; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight, until none is above. That ends where each target
    is the smaller of its limit and a common multiple of its weight, so the multiple is found from running sums in the order of
    limit per weight. One row per source: a mixture's list of sources is ordered in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.pmod(F.col("rank") - 1, F.lit(3)) + 1).withColumn("top", F.lit(mix.most) * F.col("source_size"))
    tightest = Window.orderBy(F.col("top") / F.col("weight"), "rank")
    all_rows = Window.partitionBy()
    found = (
        weighed.withColumn("words", F.sum("source_size").over(all_rows))
        .withColumn("stopped", F.coalesce(F.sum("top").over(tightest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(tightest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # The multiple if this source and all looser ones were open; the first one that it does not stop decides.
        .withColumn("multiple", (F.col("words") - F.col("stopped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("multiple") * F.col("weight") <= F.col("top"), F.struct(F.col("top") / F.col("weight"), "rank", "multiple"))).over(all_rows))
    )
    target = F.least(F.col("top").cast("double"), F.coalesce(F.col("level.multiple") * F.col("weight"), F.col("top").cast("double")))
    return found.select("source", "rank", "source_size", "weight", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def positions(sized: DataFrame, mix: Mix = Mix(), rows: int | None = None) -> DataFrame:
    """Adds ``start``: where a row's words begin in its source's sequence, for rows of (rank, size, order, ...).

    The order is a hash, cut into equal runs of about ``run_rows`` rows; sums of runs are added up per source, rows only within
    their run, so no window holds a source. Rows with equal hashes keep one order by the columns given.
    """
    count = rows if rows is not None else sized.count()
    runs = max(1, -(-count // mix.run_rows))
    run = F.floor(_unit("order") * runs).cast("long")
    placed = sized.withColumn("run", run)
    sums = placed.groupBy("rank", "run").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("rank", "run").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, ["rank", "run"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .drop("run", "offset")
    )


def _permuted(k: Column, size: Column, keys: tuple[Column, ...], mix: Mix) -> Column:
    """A pseudorandom permutation of [0, size) at k: a Feistel network over two unequal halves, walked back into the range.

    The halves are the smallest a >= sqrt(size) and b with a * b >= size, so less than one value in sqrt(size) has to be walked
    on; 64 steps are certain to suffice up to 4,096 values and beyond that fail less often than 64 ** -64.
    """
    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    b = F.ceil(size / a).cast("long")

    def once(x: Column) -> Column:
        state = F.struct((x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s.l + F.pmod(F.xxhash64(*keys, i, s.r), a), a)
            right = F.pmod(s.r + F.pmod(F.xxhash64(*keys, i, s.l), b), b)
            even = i % 2 == 0
            return F.struct(F.when(even, left).otherwise(s.l).alias("l"), F.when(even, s.r).otherwise(right).alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(mix.rounds - 1)), state, turn, lambda s: s.l * b + s.r)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(k), lambda x, _: F.when(x < size, x).otherwise(once(x)))
    return walk


def slots(targets: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(shard, rank, nth, idx): which block of its source each slot of the output takes.

    Every source gets as many slots as its target has blocks, ``most`` times its blocks at the limit. A shard draws its counts
    multinomially: each of its slots takes the source whose share of the targets a hash falls into. Draws beyond a source's number
    are dropped at its end, and what is missing goes to a last, closing shard, so the mix meets its targets. The nth slot of a
    source takes the block that the source's permutation of the current epoch has at nth modulo the number of blocks; a block
    comes once in each epoch.
    """
    blocks = F.ceil(F.col("source_size") / mix.block_words).cast("long")
    planned = (
        targets.where("source_size > 0 and target > 0")
        .withColumn("blocks", blocks)
        .withColumn("goal", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), mix.most * F.col("blocks")))
    )
    order = Window.orderBy("rank")
    share = F.col("goal") / F.sum("goal").over(Window.partitionBy())
    planned = settle(
        planned.withColumn("share", share)
        .withColumn("hi", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
        .withColumn("hi", F.when(F.lead("rank").over(order).isNull(), 1.0).otherwise(F.col("hi")))
        .select("rank", "blocks", "goal", "lo", "hi"),
        "mix-plan",
    )
    spark = targets.sparkSession
    total = planned.agg(F.sum("goal")).first()[0] or 0
    shards = -(-total // mix.shard_slots)
    # One row for each source and cell that its share of the unit interval reaches into.
    cells = planned.select(
        "rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * mix.cells), F.least(F.floor(F.col("hi") * mix.cells), F.lit(mix.cells - 1)))).alias("cell")
    ).where("lo < hi")
    draws = spark.range(0, total).select(
        (F.col("id") / mix.shard_slots).cast("long").alias("shard"), _unit(F.lit(mix.seed), "id").alias("u")
    ).withColumn("cell", F.floor(F.col("u") * mix.cells))
    drawn = draws.join(cells, "cell").where("u >= lo and u < hi").groupBy("shard", "rank").agg(F.count("*").alias("n"))
    counted = settle(drawn, "mix-draws")
    missing = planned.join(counted.groupBy("rank").agg(F.sum("n").alias("got")), "rank", "left").select(
        F.lit(shards).cast("long").alias("shard"), "rank", (F.col("goal") - F.coalesce("got", F.lit(0))).alias("n")
    )
    source_order = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        counted.union(missing.where("n > 0"))
        .withColumn("first", F.coalesce(F.sum("n").over(source_order), F.lit(0)))
        .join(planned.select("rank", "blocks", "goal"), "rank")
        .where("first < goal")
        # A row for each thousand slots first, so that no task has to write out a whole shard of one source.
        .withColumn("from", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + F.col("n"), "goal") - 1, F.lit(1000))))
        .withColumn("to", F.least(F.col("from") + 1000, F.col("first") + F.col("n"), "goal"))
        .repartition(max(1, -(-total // (1 << 17))), "rank", "from")
        .withColumn("nth", F.explode(F.sequence("from", F.col("to") - 1)))
    )
    epoch = (F.col("nth") / F.col("blocks")).cast("long")
    idx = _permuted(F.pmod("nth", "blocks"), F.col("blocks"), (F.lit(mix.seed), F.col("rank"), epoch), mix)
    return spread.select("shard", "rank", "nth", idx.alias("idx"))


def _pieces(placed: DataFrame, mix: Mix) -> DataFrame:
    """A row for each block that a row's words reach into: idx, skip (words of the row before it), words."""
    size, start = F.col("size"), F.col("start")
    first, last = (start / mix.block_words).cast("long"), ((start + size - 1) / mix.block_words).cast("long")
    lo = F.greatest(start, F.col("idx") * mix.block_words)
    hi = F.least(start + size, (F.col("idx") + 1) * mix.block_words)
    return (
        placed.where("size > 0")
        .withColumn("idx", F.explode(F.sequence(first, last)))
        .withColumn("skip", lo - start)
        .withColumn("words", hi - lo)
    )


def _sized(docs: DataFrame, id: str, text: str, source: str, mix: Mix, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with id, size, rank and order (and text), settled, and the sources' targets."""
    order = F.xxhash64(F.lit(mix.seed), F.col(id), F.xxhash64(F.col(text)))
    columns = [F.col(id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), order.alias("order")]
    sized = docs.select(*columns, *([F.col(text).alias("text")] if with_text else []))
    if not with_text:
        sized = settle(sized, "mix-sizes")
    targets = settle(source_targets(sized.select("source", "size"), mix), "mix-targets")
    ranked = sized.join(targets.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return ranked, targets


def words_taken(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """(id, size, source, source_size, target, taken) of every row: the words that the mix takes of it, repeats counted.

    A null or empty text has no words and nothing is taken; a null source is a source of its own, the last in order; a null id
    and repeated rows are rows like others. No row is taken more than ``most`` times, its source's taken words lie within a block
    or two of the target, and reruns agree. An empty table gives an empty one.
    """
    ranked, targets = _sized(docs, id, text, source, mix, False)
    placed = settle(positions(ranked.drop("source"), mix), "mix-places")
    uses = slots(targets, mix).groupBy("rank", "idx").agg(F.count("*").alias("times"))
    # The planner takes both sides for as small as the tables that they are written out from, and must not broadcast them.
    used = _pieces(placed, mix).join(uses.hint("merge"), ["rank", "idx"]).groupBy("rank", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    used = used.select(F.col("rank").alias("__rank"), F.col("start").alias("__start"), "taken")
    rows = placed.join(used, F.expr("rank = __rank and start = __start and size > 0"), "left").select(
        "id", "size", "rank", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return rows.join(targets.withColumnRenamed("source", "__source"), "rank").select(
        F.col("id").alias(id), "size", F.col("__source").alias(source), "source_size", "target", "taken"
    )


def mixed_blocks(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The mix itself: (shard, nth, source, idx, start, id, skip, words, text), a row for each part of each block taken.

    The parts of slot nth, in the order of ``start``, are the block's words: ``words`` words of the row ``id`` behind its first
    ``skip``, joined in ``text`` by single spaces. A block that several slots take comes once for each. Nulls, repeats and empty
    tables as in ``words_taken``.
    """
    ranked, targets = _sized(docs, id, text, source, mix, True)
    lean = settle(ranked.select("id", "rank", "size", "order"), "mix-sizes")
    placed = positions(lean, mix).where("size > 0").select("rank", F.col("id").alias("__id"), "order", "start", "size")
    # Rows that agree in id and text have the same words, so one text serves all their places.
    texts = ranked.where("size > 0").select("rank", "order", "id", "text").repartition("rank", "order").dropDuplicates(["rank", "order", "id"])
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    joined = texts.join(placed.hint("merge"), ["rank", "order"]).where(F.col("id").eqNullSafe(F.col("__id"))).withColumn("list", words)
    part = F.array_join(F.slice("list", (F.col("skip") + 1).cast("int"), F.col("words").cast("int")), " ")
    parts = _pieces(joined, mix).select("rank", "idx", "start", "id", "skip", "words", part.alias("text"))
    named = targets.select("rank", F.col("source").alias("__source"))
    # The planner takes the slots for as small as the plan that they are written out from, and must not broadcast them.
    return slots(targets, mix).hint("merge").join(parts, ["rank", "idx"]).join(named, "rank").select(
        "shard", "nth", F.col("__source").alias(source), "idx", "start", F.col("id").alias(id), "skip", "words", "text"
    )
