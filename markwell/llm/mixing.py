"""Mixing sources to target weights, in DataFrame functions only.

Every source's documents fall into permuted blocks (hash buckets of about ``block_words`` words). A source's target is met by
whole passes over its blocks and a rest of disjoint blocks; only the last block of the rest is cut, between documents. Exact
block quotas go to the output shards down a splitting tree: each node deals its blocks to two halves by a
multivariate-hypergeometric draw, source after source. Rows are shuffled inside their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwell.llm.common import count_words, stash

WEIGHTS = (5, 2, 1)
RATIO = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 1 << 16
GROUP_BLOCKS = 1 << 10
SHARDS = 16
SEED = 20_240_601


def source_targets(sizes: DataFrame, ratio: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """``(source, source_size, target)`` from one row per source: shares by weight, none above ``most`` times the source's size.

    Sources are a handful of configured names, so windows over all of them are small, whatever the number of documents.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn(
        "place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    ).select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * most).cast("double").alias("cap"),
        "place",
    )
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * ratio - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    share = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return filled.select(
        "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(share * F.col("weight")).alias("target")
    )


def _share_of_hash(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, share: Column) -> Column:
    """How many of ``marked`` balls are among ``drawn`` of ``total``: the inverse of the distribution at ``share``.

    Terms come from the ratio of neighbours over nine standard deviations around the mean, beyond which less than one part in
    10^17 lies.
    """
    t, m, d = (x.cast("double") for x in (total, marked, drawn))
    mean = F.when(total > 0, d * m / t).otherwise(F.lit(0.0))
    spread = F.when(total > 1, F.sqrt(F.greatest(mean * (1 - m / t) * (t - d) / (t - 1), F.lit(0.0)))).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), drawn - (total - marked), F.floor(mean - 9 * spread - 4)).cast("long")
    high = F.greatest(low, F.least(drawn, marked, F.ceil(mean + 9 * spread + 4))).cast("long")
    steps = F.sequence(low, high)

    def ratio(k: Column) -> Column:
        return (m - k) * (d - k) / ((k + 1) * (t - m - d + k + 1))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    whole = F.aggregate(
        steps,
        start,
        lambda a, k: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * ratio(k.cast("double"))).alias("term")),
        lambda a: a["sum"],
    )
    goal = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"), (share * whole).alias("goal"), F.lit(None).cast("long").alias("k")),
        lambda a, k: F.struct(
            (a["sum"] + a["term"]).alias("sum"),
            (a["term"] * ratio(k.cast("double"))).alias("term"),
            a["goal"].alias("goal"),
            F.coalesce(a["k"], F.when(a["sum"] + a["term"] > a["goal"], k)).alias("k"),
        ),
        lambda a: a["k"],
    )
    return F.coalesce(goal, high)


def split_quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(source, shard_ends)``: for each source the running ends of its shards' exact quotas of block draws.

    ``draws``: ``(source, draws)``, a row per source. ``shards`` is a power of two. Nodes of one level are rows; a node holds its
    quotas as an array over the sources. Quotas of a node's halves add up to its own, source by source.
    """
    entry = F.struct(F.col("source").alias("source"), F.col("draws").alias("n"))
    tree = draws.groupBy().agg(F.array_sort(F.collect_list(entry)).alias("quotas")).withColumn("node", F.lit(1).cast("long"))

    def left_half(quotas: Column, node: Column) -> Column:
        total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        zero = F.lit(0).cast("long")
        start = F.struct(
            total.alias("total"),
            F.floor(total / 2).cast("long").alias("drawn"),
            zero.alias("last"),
            F.array().cast("array<bigint>").alias("left"),
        )

        def step(a: Column, x: Column) -> Column:
            drawn = a["drawn"] - a["last"]
            share = _share_of_hash(F.lit(seed), node, F.size(a["left"]))
            taken = hypergeometric(a["total"], x["n"], drawn, share)
            return F.struct(
                (a["total"] - x["n"]).alias("total"),
                drawn.alias("drawn"),
                taken.alias("last"),
                F.concat(a["left"], F.array(taken)).alias("left"),
            )

        return F.aggregate(quotas, start, step, lambda a: a["left"])

    for _ in range(shards.bit_length() - 1):
        tree = tree.withColumn("left", left_half(F.col("quotas"), F.col("node")))
        left = F.transform("quotas", lambda x, i: F.struct(x["source"].alias("source"), F.get(F.col("left"), i).alias("n")))
        right = F.transform("quotas", lambda x, i: F.struct(x["source"].alias("source"), (x["n"] - F.get(F.col("left"), i)).alias("n")))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")),
        )
        tree = tree.select(F.explode(halves).alias("half")).select("half.node", "half.quotas")
    leaves = tree.select((F.col("node") - shards).alias("shard"), F.explode("quotas").alias("q"))
    ends = F.sum("q.n").over(Window.partitionBy("q.source").orderBy("shard"))
    return (
        leaves.select("shard", F.col("q.source").alias("source"), ends.alias("end"))
        .groupBy("source")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("shard_ends"))
    )


def _crossing(sums: DataFrame, level: str, rest: str, into: str) -> DataFrame:
    """Per source the first part whose running sum exceeds ``rest``, and what is left of ``rest`` there."""
    ended = sums.withColumn("end", F.sum("size").over(Window.partitionBy("source").orderBy(level)))
    at = F.min(F.when(F.col("end") > F.col(rest), F.struct(F.col(level), (F.col(rest) - F.col("end") + F.col("size")).alias("left"))))
    return ended.groupBy("source").agg(at.alias("at")).select("source", F.col(f"at.{level}").alias(into), F.col("at.left").alias(f"{into}_rest"))


def _with(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join facts of a source; null is a source like others."""
    facts = per_source.withColumnRenamed("source", "_of")
    return rows.join(facts, rows["source"].eqNullSafe(facts["_of"]), "left").drop("_of")


def _measured(docs: DataFrame, key: str, text: str, source: str, seed: int) -> tuple[Column, Column, Column]:
    size = count_words(F.col(text).cast("string"))
    return F.col(source).cast("string"), size, F.xxhash64(F.lit(seed), F.col(key), F.col(text))


def _group() -> Column:
    return F.pmod(F.col("draw"), F.col("groups"))


def _block() -> Column:
    return F.pmod(F.shiftright(F.col("draw"), 24), F.col("blocks"))


def mix_plan(
    rows: DataFrame, ratio: float, weights: tuple[int, ...], most: float, block_words: int, shards: int, seed: int
) -> DataFrame:
    """Everything that decides a document's copies, one row per source, from ``rows`` ``(source, size, draw)``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, ratio, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    facts = stash(
        targets.withColumn("passes", passes)
        .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
        .withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("source_size") / (block_words * GROUP_BLOCKS))).cast("long"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("groups") / block_words)).cast("long"))
    )
    dealt = _with(rows.filter("size > 0"), facts.filter("rest > 0")).filter("rest is not null")
    groups = dealt.groupBy("source", "rest", _group().alias("grp")).agg(F.sum("size").alias("size"))
    cut_group = stash(_crossing(groups, "grp", "rest", "cut_group"))
    inside = _with(dealt.withColumn("grp", _group()), cut_group).filter("grp = cut_group")
    blocks = inside.groupBy("source", "cut_group_rest", _block().alias("blk")).agg(F.sum("size").alias("size"))
    cut_block = stash(_crossing(blocks, "blk", "cut_group_rest", "cut_block"))
    last = _with(inside.withColumn("blk", _block()), cut_block).filter("blk = cut_block")
    units = last.groupBy("source", "draw", "cut_block_rest").agg(F.sum("size").alias("size"))
    nothing = F.array().cast("array<bigint>")
    chosen = units.groupBy("source", "cut_block_rest").agg(
        F.sort_array(F.collect_list(F.struct("size", "draw")), asc=False).alias("units")
    )
    fold = F.aggregate(
        "units",
        F.struct(F.col("cut_block_rest").alias("left"), nothing.alias("draws")),
        lambda a, x: F.when(
            x["size"] <= a["left"], F.struct((a["left"] - x["size"]).alias("left"), F.concat(a["draws"], F.array(x["draw"])).alias("draws"))
        ).otherwise(a),
        lambda a: a["draws"],
    )
    chosen = chosen.select("source", fold.alias("chosen"))
    plan = _with(_with(_with(facts, cut_group.drop("cut_group_rest")), cut_block.drop("cut_block_rest")), chosen)
    in_all = F.col("groups") * F.col("blocks")
    partial = F.when(F.col("rest") == 0, F.lit(0)).when(F.col("cut_group").isNull(), in_all)
    partial = partial.otherwise(F.col("cut_group") * F.col("blocks") + F.coalesce(F.col("cut_block"), F.col("blocks") - 1) + 1)
    plan = plan.withColumn("draws", (F.col("passes") * in_all + partial).cast("long"))
    return stash(_with(plan, split_quotas(plan.select("source", "draws"), shards, seed)))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``copies``: an array of ``(pass, shard)`` for each time the mix takes the row."""
    joined = _with(rows, plan).withColumn("grp", _group()).withColumn("blk", _block())
    before = F.when(F.col("cut_group").isNull(), F.col("rest") > 0).when(F.col("grp") != F.col("cut_group"), F.col("grp") < F.col("cut_group"))
    before = before.when(F.col("cut_block").isNull(), F.lit(True)).when(F.col("blk") != F.col("cut_block"), F.col("blk") < F.col("cut_block"))
    once_more = (F.col("rest") > 0) & before.otherwise(F.array_contains(F.coalesce(F.col("chosen"), F.array().cast("array<bigint>")), F.col("draw")))
    times = (F.col("passes") + F.when(once_more, 1).otherwise(0)).cast("int")
    place = F.col("grp") * F.col("blocks") + F.col("blk")
    in_all = F.col("groups") * F.col("blocks")
    copies = F.transform(
        F.slice(F.sequence(F.lit(0), F.greatest(times, F.lit(1)) - 1), F.lit(1), times),
        lambda p: F.struct(
            p.alias("pass"), F.size(F.filter("shard_ends", lambda end: end <= p.cast("long") * in_all + place)).alias("shard")
        ),
    )
    return joined.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.slice(copies, 1, 0)))


def _settings(ratio, weights, most, block_words, shards, seed) -> dict:
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    return {"ratio": ratio, "weights": tuple(weights), "most": most, "block_words": block_words, "shards": shards, "seed": seed}


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    ratio: float = RATIO,
    weights: tuple[int, ...] = WEIGHTS,
    most: float = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document and copy that the mix takes: the columns of ``docs``, ``mix_pass``, ``mix_shard``, ``mix_order``.

    Size is the number of words; a document of no words (null or empty text) is never taken. A document is taken whole, at most
    ``most`` times (rounded up). Null sources are one source, the last. Documents with equal key and text are one unit of the
    draw. The same rows and seed give the same mix. An empty table gives no rows. A column of ``docs`` that is named as one
    of the three added ones is left out (``shuffled_mix`` keeps it); any other names are fine.
    """
    taken = _taken(docs, key, text, source, seed, _settings(ratio, weights, most, block_words, shards, seed))
    added = ["mix_pass", "mix_shard", "mix_order"]
    return taken.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def _taken(docs: DataFrame, key: str, text: str, source: str, seed: int, settings: dict) -> DataFrame:
    """``(row, mix_pass, mix_shard, mix_order)`` per document and copy; ``row`` holds the columns of ``docs``, whatever their names."""
    where, size, draw = _measured(docs, key, text, source, seed)
    plan = mix_plan(stash(docs.select(where.alias("source"), size.alias("size"), draw.alias("draw"))), **settings)
    rows = docs.select(where.alias("source"), size.alias("size"), draw.alias("draw"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    taken = with_copies(rows, plan).select("row", "draw", F.explode("copies").alias("copy"))
    order = F.xxhash64(F.lit(seed), F.col("copy.shard"), F.col("copy.pass"), F.col("draw"))
    return taken.select("row", F.col("copy.pass").alias("mix_pass"), F.col("copy.shard").alias("mix_shard"), order.alias("mix_order"))


def _shuffled(taken: DataFrame, shards: int) -> DataFrame:
    partitions = int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("mix_order"), F.lit(-(-4 * partitions // shards)))
    dealt = taken.withColumn("part", part).repartition("mix_shard", "part")
    return dealt.sortWithinPartitions("mix_shard", "part", "mix_order").select("row.*")


def shuffled_shards(mixed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Bring each shard's rows together and shuffle them locally, ready to be written.

    A shard is split at random into parts, several for each shuffle partition, so that tasks stay bounded however large a shard
    is; a task holds whole parts, each in its shuffled order. That order holds when a written file is read again.
    """
    row = F.struct(*[mixed[c] for c in mixed.columns]).alias("row")  # any column names are fine
    return _shuffled(mixed.select(row, "mix_shard", "mix_order"), shards)


def shuffled_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """The rows that ``mix_sources`` takes, in the order of ``shuffled_shards``, with just the columns of ``docs``, whatever their names."""
    return _shuffled(_taken(docs, key, text, source, seed, _settings(RATIO, WEIGHTS, MOST_PASSES, BLOCK_WORDS, shards, seed)), shards)


def mix_report(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    ratio: float = RATIO,
    weights: tuple[int, ...] = WEIGHTS,
    most: float = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that ``mix_sources`` takes of it."""
    settings = _settings(ratio, weights, most, block_words, shards, seed)
    where, size, draw = _measured(docs, key, text, source, seed)
    rows = stash(docs.select(F.col(key).alias("doc_id"), where.alias("source"), size.alias("size"), draw.alias("draw")))
    return with_copies(rows, mix_plan(rows, **settings)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies"
    )
