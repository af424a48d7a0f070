"""Mixing sources to target weights, in blocks of fixed length.

The words of a source, its documents in id order, are packed into blocks of
``block`` words. The output has as many block slots as the targets ask for, cut
into shards of equal length. Which source each slot of a shard draws follows the
multinomial with the targets as weights, conditioned on the totals: a
pseudorandom permutation of all slots falls into intervals as long as the
sources' numbers of blocks, so shard counts vary as draws do while every source
meets its target to half a block. The n-th slot of a source maps through the
source's own permutation to a block, a second round starting over, and blocks
are joined by index. Everything is a function of the rows and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.llm.common import WORD, let, words
from seepage.operators.position import running_totals
from seepage.session import materialise

BLOCK = 64
SHARD_SLOTS = 4096
ROUNDS = 12
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2  # a source is used this many times at most
CHUNKS = 4096


def permuted(index: Column, n: Column, seed: Column) -> Column:
    """Pseudorandom permutation of 0..n-1, by the swap-or-not shuffle.

    Each round pairs x with (k - x) mod n and swaps by a bit that both share,
    so every round, and so the whole, is one to one for any n.
    """

    def one(x: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        return F.when(F.xxhash64(seed, r, F.greatest(x, mate)).bitwiseAND(F.lit(1)) == 1, mate).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index.cast("bigint"), one)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes, split by weight.

    ``sizes`` has one row per source, with (source, source_size). Weights repeat
    over the sources in code-point order, null last. Targets stop at ``most``
    times the source; the excess goes to the others by weight, so all others get
    the same amount per unit of weight: with the sources in order of cap per
    weight, that level follows from running sums. One row per source throughout.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    ).withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = weighed.withColumn("level", left / weight_left)
    # the first source that its cap doesn't stop has the level of all later ones
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return levelled.select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(free["level"] * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def packed(docs: DataFrame, block: int, id_col: str, text_col: str, source_col: str, by_text: bool = False) -> DataFrame:
    """(id, size, source, offset): where each document starts in its source's words.

    ``by_text`` adds a hash of the text as ``digest``, and orders rows of one id by it.
    """
    more = [F.xxhash64(F.col(text_col)).alias("digest")] if by_text else []
    rows = docs.select(
        F.col(source_col).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), *more
    ).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
    named = ["digest"] if by_text else []
    return running_totals(rows, ["_source", "id", "size", *named], "size").select("source", "id", "size", "offset", *named)


def mix(
    docs: DataFrame,
    seed: int = 7,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    by_text: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed documents, sources, draws).

    Placed documents: (id, size, source, start), ``start`` the document's first
    word in its source. Sources: (source, source_size, target, blocks, draws).
    Draws: (shard, slot, source, block_no, use), one row per output slot, ``use``
    0 for the first time a block is taken and 1 for the second.

    A null text has size 0; null sources form one source. Rows of size 0 are
    placed and never drawn. An empty table gives empty results. Other columns
    are ignored; repeated rows are placed one after the other. ``by_text`` keeps a
    ``digest`` of each text beside the placed documents.
    """
    spark = docs.sparkSession
    placed = materialise(packed(docs, block, id_col, text_col, source_col, by_text), "mix-placed")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("offset").alias("first"))
    targets = source_targets(sizes.drop("first")).join(
        sizes.select(F.col("source").alias("_s"), "first"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    blocks = F.ceil(F.col("source_size") / block)
    drawn = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        F.least(MOST * blocks, F.round(blocks * F.col("target") / F.col("source_size")))
    )
    counted = targets.withColumn("blocks", blocks.cast("bigint")).withColumn("draws", drawn.cast("bigint"))
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    # one row per source
    sources = materialise(counted.withColumn("low", F.sum("draws").over(upto) - F.col("draws")), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("draws"), F.lit(0)).alias("n")).first()["n"]
    chunk = total // CHUNKS + 1
    # at most CHUNKS rows more than there are sources
    ranges = sources.filter("draws > 0").select(
        "source",
        "blocks",
        "low",
        (F.col("low") + F.col("draws")).alias("high"),
        F.explode(
            F.sequence(F.expr(f"low div {chunk}L"), F.expr(f"(low + draws - 1) div {chunk}L"))
        ).alias("chunk"),
    )
    slots = (
        spark.range(total)
        .select(F.col("id").alias("place"), permuted(F.col("id"), F.lit(total), F.lit(seed)).alias("drawn"))
        .withColumn("chunk", F.expr(f"drawn div {chunk}L"))
    )
    n = F.col("drawn") - F.col("low")
    own = F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\x00")))
    draws = (
        slots.join(ranges, "chunk")
        .filter((F.col("drawn") >= F.col("low")) & (F.col("drawn") < F.col("high")))
        .withColumn("own", own)
        .select(
            F.expr(f"place div {SHARD_SLOTS}L").alias("shard"),
            F.expr(f"place % {SHARD_SLOTS}L").alias("slot"),
            "source",
            permuted(F.pmod(n, F.col("blocks")), F.col("blocks"), F.col("own")).alias("block_no"),
            F.expr("CAST((drawn - low) div blocks AS int)").alias("use"),
        )
    )
    start = F.col("offset") - F.col("first")
    firsts = sources.select(F.col("source").alias("_s"), "source_size", "target", "first")
    spots = placed.join(firsts, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "id", "size", "source", "source_size", "target", start.alias("start"), *(["digest"] if by_text else [])
    )
    return spots, sources, draws


def pieces(spots: DataFrame, draws: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, row, size, source, use, low, high): words [low, high) of a document that a draw takes.

    Joins the blocks each document touches to the drawn blocks by index.
    """
    touched = (
        spots.filter("size > 0")
        .withColumn(
            "block_no",
            F.explode(F.sequence(F.expr(f"start div {block}L"), F.expr(f"(start + size - 1) div {block}L"))),
        )
        .withColumn("low", F.greatest(F.col("block_no") * block - F.col("start"), F.lit(0)))
        .withColumn("high", F.least((F.col("block_no") + 1) * block - F.col("start"), F.col("size")))
    )
    hashed = F.coalesce("source", F.lit("\x00"))
    null_flag = F.col("source").isNull()
    left = touched.withColumn("_k", hashed).withColumn("_n", null_flag)
    right = draws.withColumn("_k", hashed).withColumn("_n", null_flag).select("_k", "_n", "block_no", "use")
    return left.join(right, ["_k", "_n", "block_no"]).drop("_k", "_n")


def mixed_words(
    docs: DataFrame,
    seed: int = 7,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, taken), one row per row of ``docs``."""
    spots, _, draws = mix(docs, seed, block, id_col, text_col, source_col)
    # a document starts where no other one of its source with words does
    taken = pieces(spots, draws, block).groupBy("source", "start").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    taken = taken.select(F.col("source").alias("_s"), F.col("start").alias("_p"), "taken")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_p")) & (F.col("size") > 0)
    return spots.join(taken, same, "left").select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    seed: int = 7,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix as documents: a row of ``docs`` for each use, with the words that the use takes.

    A document taken whole keeps its text as it is; of others the words taken are
    joined by blanks. Rows of which nothing is taken, such as those without a
    word, are not in the mix.
    """
    spots, _, draws = mix(docs, seed, block, id_col, text_col, source_col, by_text=True)
    taken = (
        pieces(spots, draws, block)
        .groupBy("source", "start", "use")
        .agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("parts"))
    )
    # rows alike in source, id, size and text are the same document several times
    order = Window.partitionBy("source", "id", "size", "digest").orderBy("start")
    numbered = spots.filter("size > 0").select(
        F.col("source").alias("s"), F.col("start").alias("p"), "id", "size", "digest", F.row_number().over(order).alias("nth")
    )
    parts = taken.join(numbered, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("p"))).select(
        F.col("source").alias("of_source"), F.col("id").alias("of_id"), F.col("size").alias("of_size"), F.col("digest").alias("of_digest"), "nth", "parts"
    )
    # the columns of docs stay in a struct, where their names clash with none of these
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(source_col).alias("source"),
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("digest"),
    )
    rows = rows.filter("size > 0").withColumn("copy", F.row_number().over(Window.partitionBy("source", "id", "size", "digest").orderBy("digest")))
    joined = rows.join(
        parts,
        F.col("source").eqNullSafe(F.col("of_source"))
        & F.col("id").eqNullSafe(F.col("of_id"))
        & (F.col("size") == F.col("of_size"))
        & (F.col("digest") == F.col("of_digest"))
        & (F.col("copy") == F.col("nth")),
    )
    whole = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, x: n + x["high"] - x["low"]) == F.col("size")
    old = F.col("doc").getField(text_col)

    def cut(w: Column) -> Column:
        slices = F.transform("parts", lambda x: F.slice(w, (x["low"] + 1).cast("int"), (x["high"] - x["low"]).cast("int")))
        return F.array_join(F.flatten(slices), " ")

    text = F.when(whole, old).otherwise(let(words(old), cut))
    return joined.select(*[(text if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
