"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Everything runs as DataFrame expressions.  Sources in code point order (null
last) get the weights in turn; targets are shares of the total, each at most
``epochs`` times its source's size, what is cut off going to the others by
weight.  The mix is cut into blocks of equally many words; blocks go to sources
by highest quotients target / (2 s + 1), each source's blocks to its groups of
shards (seeded hash buckets of its documents) in the same way, and each group's
to its shards, so that no task ranks all shards of a large source.  Inside a shard the
documents stand in seeded order and are cut into blocks; a quota of q over n
blocks takes each block q div n times and q mod n seeded ones once more.

Null texts have size 0.  Documents without words take part with size, and so
taken, 0.  Null sources are one source.  A null or repeated doc_id is a row of
its own.  Equal quotients go to the earlier source or shard.  An empty table
gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.runtime import cut, table, text_or_empty

WEIGHTS = (5, 2, 1)
#: Size of the mix, as a share of all words.
SHARE = 1.5
#: Times that a source, and a document, may be taken at most.
EPOCHS = 2
#: Words of one shard, about.
SHARD_WORDS = 1 << 18
#: Shards whose quotas are ranked together.
GROUP_SHARDS = 1024
SEED = 20240717


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def block_words(total: Column, low: int = 16, high: int = 2048) -> Column:
    """Words of a block: the mix makes about 2**16 blocks, or more where they would pass ``high`` words."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(total / F.lit(1 << 16)))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, source_no, weight, target from (source, source_size).

    One row per source is sorted in one task: its size is bounded by the number
    of sources, whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", w)
    # filled by rising ratio of cap to weight: a source is capped if, with all before it capped,
    # its share of what is left passes its cap
    everyone = Window.orderBy("__ratio", "source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("__ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(epochs))
    filled = (
        ranked.withColumn("__cap", cap)
        .withColumn("__ratio", F.col("__cap") / F.col("weight"))
        .withColumn("__total", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("__left", F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__weights", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("__level", F.col("__left") / F.col("__weights"))
        .withColumn("__capped", F.col("__level") >= F.col("__ratio"))
        .withColumn("__level", F.min(F.when(~F.col("__capped"), F.col("__level"))).over(everyone))
    )
    # levels rise while sources are capped and stand still after: the first uncapped one holds
    open_level = F.first(F.when(~F.col("__capped"), F.col("__left") / F.col("__weights")), ignorenulls=True).over(everyone)
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("weight") * F.col("__level_open"))
    return filled.withColumn("__level_open", open_level).withColumn("target", F.least(target, F.col("__cap"))).select("source", "source_size", "source_no", "weight", "target")


def sainte_lague(parties: DataFrame, groups: list[str], party: str, votes: str, seats: str, cap: str, out: str) -> DataFrame:
    """Give ``seats`` (of each group) to its parties by the highest quotients votes / (2 s + 1).

    Parties whose share passes their ``cap`` get just that.  For the others, all
    but about as many seats as there are parties follow from two divisors: at
    one no party can have too many, at the other none too few.  Only the
    quotients between the two are ranked.  No party passes its cap, and one
    without votes gets nothing.
    """
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("__ratio", party).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    v = F.col(votes)
    given = parties.withColumn("__ratio", F.when(v > 0, F.col(cap) / v).otherwise(F.lit(float("inf"))))
    given = given.withColumn("__level", (F.col(seats) - ahead(cap)) / (F.sum(votes).over(whole) - ahead(votes)))
    given = given.withColumn("__full", (v > 0) & F.coalesce(F.col("__level") * v >= F.col(cap), F.lit(False)))
    free = lambda c: F.sum(F.when(F.col("__full"), 0).otherwise(F.col(c))).over(whole)
    given = given.withColumns({"__n": F.count(F.lit(1)).over(whole), "__v": free(votes), "__s": F.col(seats) - F.sum(F.when(F.col("__full"), F.col(cap)).otherwise(0)).over(whole)})
    seats_at = lambda more: F.when(F.col("__v") > 0, F.floor(v * F.greatest(F.lit(0.0), F.col("__s") + more) / F.col("__v") + F.lit(0.5))).otherwise(0)
    low = F.when(F.col("__full"), F.col(cap)).otherwise(F.least(F.greatest(seats_at(-F.col("__n") / 2) - 1, F.lit(0)), F.col(cap))).cast("long")
    high = F.when(v > 0, F.least(seats_at(2 * F.col("__n") + 1) + 1, F.col(cap))).otherwise(0).cast("long")
    bounded = given.withColumn("__low", low).withColumn("__high", F.greatest(high, F.col("__low")))
    bounded = bounded.withColumn("__open", F.col(seats) - F.sum("__low").over(whole))
    quotient = F.transform(F.sequence(F.col("__low") + 1, F.col("__high")), lambda s: v / (2 * s - 1))
    tries = bounded.filter("__high > __low").select(*groups, party, "__open", F.explode(quotient).alias("__q"))
    rank = F.row_number().over(whole.orderBy(F.desc("__q"), party))
    won = tries.withColumn("__rank", rank).filter("__rank <= __open").groupBy(*groups, party).agg(F.count(F.lit(1)).alias("__won"))
    return bounded.join(won, [*groups, party], "left").withColumn(out, F.col("__low") + F.coalesce("__won", F.lit(0))).select(*parties.columns, out)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, shard_words: int = SHARD_WORDS, seed: int = SEED, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken; also source, shard and block_words."""
    size = word_count(text_or_empty())
    # the narrow table is cut off so that each text is read once
    rows = cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("__order")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, epochs)
    one = Window.partitionBy()
    plan = plan.withColumn("block_words", block_words(F.sum("source_size").over(one))).withColumn("__seats", F.round(F.sum("target").over(one) / F.col("block_words")).cast("long"))
    plan = plan.withColumn("__cap", F.ceil(F.col("source_size") / F.col("block_words")).cast("long") * epochs).withColumn("__all", F.lit(1))
    plan = cut(sainte_lague(plan, ["__all"], "source_no", "target", "__seats", "__cap", "blocks").withColumn("shards", F.ceil(F.col("source_size") / shard_words).cast("long")))

    known = plan.select(F.col("source").alias("__source"), "source_no", "source_size", "target", "block_words", "blocks", "shards")
    placed = rows.join(known, rows["source"].eqNullSafe(known["__source"])).drop("__source")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "__order"), F.greatest(F.col("shards"), F.lit(1))))
    shards = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"), F.first("block_words").alias("block_words"))
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / F.col("block_words")).cast("long")).withColumn("__cap", F.col("n_blocks") * epochs)
    shards = shards.withColumn("group", F.floor(F.col("shard") / group_shards))
    groups = shards.groupBy("source_no", "group").agg(F.sum("shard_size").alias("group_size"), F.sum("__cap").alias("__cap"), F.first("blocks").alias("blocks"))
    of_groups = sainte_lague(groups, ["source_no"], "group", "group_size", "blocks", "__cap", "group_blocks").select("source_no", "group", "group_blocks")
    quotas = sainte_lague(shards.join(of_groups, ["source_no", "group"]), ["source_no", "group"], "shard", "shard_size", "group_blocks", "__cap", "quota").select("source_no", "shard", "n_blocks", "quota")

    stream = Window.partitionBy("source_no", "shard").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("__from", F.coalesce(F.sum("size").over(stream), F.lit(0))).withColumn("__to", F.col("__from") + F.col("size"))
    laid = laid.join(quotas, ["source_no", "shard"])
    n, q = F.greatest(F.col("n_blocks"), F.lit(1)), F.coalesce("quota", F.lit(0))
    # which blocks come once more: a seeded walk over all blocks of the shard, step prime to their number
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source_no", "shard"), n)
    step = F.pmod(F.lit(2_971_215_073), n)  # a prime, so prime to every smaller number of blocks
    width = F.col("block_words")
    words = lambda b: F.least(F.col("__to"), (b + 1) * width) - F.greatest(F.col("__from"), b * width)
    once_more = lambda b: (F.pmod(b * F.col("__step") + F.col("__start"), F.col("__n")) < F.col("__rest")).cast("long")
    blocks = F.sequence(F.floor(F.col("__from") / width), F.floor((F.col("__to") - 1) / width))
    taken = F.aggregate(blocks, F.lit(0).cast("long"), lambda total, b: total + words(b) * (F.col("__whole") + once_more(b)))
    laid = laid.withColumns({"__n": n, "__start": start, "__step": step, "__whole": F.floor(q / n).cast("long"), "__rest": q % n})
    return laid.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "block_words", F.col("__order").alias("row_hash"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("row_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it.

    The words taken of a document, over its size, give its number of copies; a
    fraction becomes one more copy by the document's hash, so that each
    source's words come near its target.  Documents without words stay once.
    Rows equal in doc_id, text and source share the copies of all of them.
    """
    columns = docs.columns
    # rows of one document and source: the mix's totals for them are handed out again among them
    who = F.xxhash64(F.lit(SEED), F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source")
    shares = mix(docs).groupBy(who.alias("__from"), F.col("row_hash").alias("__mix_hash")).agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size"), F.count(F.lit(1)).alias("__rows"))
    chance = F.pmod(F.xxhash64(F.lit(SEED + 3), "__mix_hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.when(F.col("__size") == 0, F.col("__rows")).otherwise(F.floor(F.col("__taken") / F.greatest(F.col("__size"), F.lit(1)) + chance))
    chosen = shares.select("__from", "__mix_hash", "__rows", copies.alias("__copies")).filter("__copies > 0")
    keyed = docs.withColumns({"__hash": F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), "__who": who})
    found = keyed.join(chosen, (keyed["__hash"] == chosen["__mix_hash"]) & (keyed["__who"] == chosen["__from"]))
    # maps have no order of their own
    order = [F.col(c).cast("string") if "map<" in t else F.col(c) for c, t in docs.dtypes if c not in ("doc_id", "text", "source")]
    place = F.row_number().over(Window.partitionBy("__hash", "__who").orderBy(*order or [F.lit(1)]))
    own = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__place") <= F.col("__copies") % F.col("__rows")).cast("long")
    dealt = found.withColumn("__place", place).withColumn("__own", own.cast("int")).filter("__own > 0")
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__own")))).select(*columns)


QUERIES = {"op2_mixing": op2_mixing}
SQL: dict[str, str] = {}
