"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: every source has a weight and a cap, a multiple of its size; what is
above a cap is shared again by weight among the others. Sorted by cap over
weight, the sources at their cap are a prefix, which running sums find at once.

Quotas: the mix consists of equal-token blocks. Sources get blocks by highest
quotients target / (2 k - 1), and in the same way each source's blocks go to
its shards. Only quotients that can matter are listed: with n parties and N
seats, every party has at least round(v (N - n/2) / V) seats and at most
round(v (N + n/2) / V), so about two rows for each party are ranked.

Selection: a shard's documents are laid out in the order of a seeded hash and
cut into blocks. A quota takes whole passes over the shard and then the first
blocks of one more. So a document is taken whole, at the edge in part, and
never more often than the cap says.

Documents are dealt by source and slot, a hash of the row, so a source that
holds most rows is spread evenly; its shards are groups of slots, SLOTS at most,
which bounds the tasks that one source is dealt to. Texts are read once: ids,
sizes and hashes are kept in the shared folder, and all else works on them. To
give the mixed texts, they are read a second time and shuffled once. Tables of
one row for each source and each slot are all that windows over everything see.

Defined results: a null text has size 0, a very long one all its words, a null
source is a source of its own, after the others. Columns of any name pass
through. Equal rows count as often as they occur. Without words all
targets are 0. An empty table gives an empty result. Results depend on the rows
and the seed only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, whole_text, words

CAP = 3
WEIGHTS = (1, 2, 3)
BLOCK_TOKENS = 8
SLOTS = 4096
#: Words that a shard should have at least.
SHARD_TOKENS = 1 << 17
SEED = 42


def apportion(parties: DataFrame, group: list[str], party: list[str], value: Column, seats: Column) -> DataFrame:
    """parties with the column `quota`: the seats of each group, shared in
    proportion to value by highest quotients; equal ones go to the party that
    is first in the order of `party`."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    t = parties.withColumns({"__v": value.cast("double"), "__n": seats.cast("long")}).withColumns({"__sum": F.sum("__v").over(w), "__k": F.count(F.lit(1)).over(w)})
    share = lambda half: F.col("__v") * (F.col("__n") + half * F.col("__k") / 2) / F.nullif(F.col("__sum"), F.lit(0.0)) + 0.5
    low = F.greatest(F.floor(share(-1)) - 1, F.lit(0)).cast("long")
    high = F.greatest(F.floor(share(1)) + 1, F.lit(0)).cast("long")
    t = t.withColumns({"__low": F.coalesce(F.when(F.col("__v") > 0, low), F.lit(0).cast("long")), "__high": F.coalesce(F.when(F.col("__v") > 0, high), F.lit(0).cast("long"))})
    t = t.withColumn("__left", F.col("__n") - F.sum("__low").over(w))
    listed = t.select(*group, *party, "__v", "__left", F.explode(F.sequence(F.col("__low") + 1, F.greatest(F.col("__high"), F.col("__low") + 1))).alias("__s"))
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy((F.col("__v") / (2 * F.col("__s") - 1)).desc(), *party)
    won = listed.where("__v > 0").withColumn("__rank", F.row_number().over(order)).where("__rank <= __left").groupBy(*group, *party).agg(F.count(F.lit(1)).alias("__won"))
    out = t.join(won, [*group, *party], "left")
    return out.select(*parties.columns, (F.col("__low") + F.coalesce(F.col("__won"), F.lit(0))).alias("quota"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source_key, source_size; null keys don't occur) with the column
    target. One row for each source: a single task sorts them and can spill."""
    one = Window.partitionBy(F.lit(0))
    n = F.row_number().over(one.orderBy("by_null", "source_key")) - 1
    t = sources.withColumn("by_null", F.col("source_key") == "n").withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(n, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumns({"limit": (cap * F.col("source_size")).cast("double"), "total": F.sum("source_size").over(one).cast("double")})
    order = one.orderBy(F.col("limit") / F.col("weight"), "by_null", "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / rest
    # The level after the last source at its cap holds for all others.
    t = t.withColumn("level", level).withColumn("free", F.col("limit") >= F.col("level") * F.col("weight"))
    t = t.withColumn("final", F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "by_null", "source_key", "level"))).over(one)["level"])
    return t.withColumn("target", F.coalesce(F.least(F.col("limit"), F.col("final") * F.col("weight")), F.col("limit"))).drop("by_null", "weight", "limit", "total", "level", "free", "final")


def mix(docs: DataFrame, keep: list[str] | None = None, seed: int = SEED, block: int = BLOCK_TOKENS, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """keep (by default doc_id) of every row with size, source_size, target and
    taken: the words that the mix takes of it, repeats counted."""
    taken = _taken(docs, ["doc_id"] if keep is None else keep, True, seed, block, weights, cap)
    return taken.select("row.*", "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, keep: list[str], slim: bool, seed: int = SEED, block: int = BLOCK_TOKENS, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """row, a struct of the columns to keep, with size, source_size, target and
    taken. Slim rows are kept in the shared folder; of others the slots are."""
    text = whole_text()
    d = docs.select(
        F.struct(*(F.col(f"`{k}`") for k in keep)).alias("row"), "doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("source_key"),
        count_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("mixed"),
    ).withColumn("slot", F.pmod("mixed", F.lit(SLOTS)).cast("int"))
    d = cut(d) if slim else d
    slots = cut(d.groupBy("source_key", "slot").agg(F.sum("size").alias("slot_size")))
    sources = targets(slots.groupBy("source_key").agg(F.sum("slot_size").alias("source_size")), weights, cap)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block)
    sources = apportion(sources.withColumn("seats", seats), [], ["source_key"], F.col("target"), F.col("seats")).withColumnRenamed("quota", "source_blocks")
    # As many shards as have SHARD_TOKENS each, a power of two up to the slots.
    spread = F.least(F.lit(SLOTS), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col("source_size") / SHARD_TOKENS, F.lit(1.0))))).cast("int"))
    shards = slots.join(sources.withColumn("spread", spread), "source_key").withColumn("shard", F.pmod("slot", F.col("spread")))
    sized = shards.groupBy("source_key", "shard").agg(F.sum("slot_size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    quotas = apportion(sized, ["source_key"], ["shard"], F.col("shard_size"), F.col("source_blocks")).select("source_key", "shard", "shard_size", "quota")
    plan = shards.select("source_key", "slot", "shard", "source_size", "target").join(quotas, ["source_key", "shard"])
    take = F.least(F.col("quota") * block, cap * F.col("shard_size"))
    line = Window.partitionBy("source_key", "shard").orderBy(F.shiftrightunsigned("mixed", 12), "mixed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(plan, ["source_key", "slot"]).withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    whole = F.when(F.col("shard_size") > 0, F.floor(take / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("passes", whole).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), take - F.col("passes") * F.col("shard_size") - F.col("before"))))
    taken = (F.col("passes") * F.col("size") + F.col("part")).cast("long")
    return out.select("row", "size", "source_size", "target", taken.alias("taken"))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: each as often as whole passes took it, and the
    first words of it where a pass ended in it. Columns as before; n_chars, if
    there, follows the text."""
    fields = docs.columns
    m = _taken(docs, fields, False, **how).withColumnRenamed("row", "d").where("taken > 0")
    copies = m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.least(F.col("taken") - (F.col("copy") - 1) * F.col("size"), F.col("size"))
    text = F.when(F.col("left") == F.col("size"), F.col("d.text")).otherwise(_first_words(F.col("d.text"), F.col("left")))
    out = copies.withColumn("left", left).withColumn("t", text)
    named = {"text": F.col("t").alias("text"), "n_chars": F.length("t").cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars")}
    return out.select(*(named[c] if c in named else F.col("d")[c].alias(c) for c in fields))


def _first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, one blank between them."""
    return F.array_join(F.slice(words(text), F.lit(1), n.cast("int")), " ")
