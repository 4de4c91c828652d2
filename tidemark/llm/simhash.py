"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints within `radius` bits differ by at most t[i] bits in some
partition i of their bits, for any thresholds with sum(t) = radius - m + 1 over
m partitions (a threshold of -1 leaves a partition out). Bits that go together
are put into one partition, so that skew meets in few of them; thresholds are
chosen by dynamic programming on estimated candidate counts, over all numbers of
partitions on offer.

Only distinct fingerprints are compared. Each is put into the bucket of its
value in every partition, and probes the buckets within the threshold. Buckets
are read from sorted partitions; every pair in one is verified on all 64 bits
there and then, and never emitted: a task returns the links of a spanning
forest. A bucket with very many members is searched from member to member,
dropping those already linked, so that a dense group costs about its size; one
that is too large for a task is first dealt by the bits outside its partition.
Components of the links are found by alternating star steps on tables.

Fingerprints may be of 128 bits (keep_one with `total`): the first 64 are grouped,
bucketed and probed as above, and a pair is verified on all 128, of which at most
`total` may differ. So a wide radius finds texts that are less alike without
linking those that are like by chance, of which there are more the larger a
corpus is.

Defined results: a null or empty text has no words and fingerprint zero, linked
like any other; very long texts are read whole. Equal rows share a component. Null ids are never the smallest;
a component of null ids only has a null id. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Numbers of partitions to choose from.
PARTITIONS = (2, 3, 4, 5)
#: Cost of a shuffled row in compared pairs.
ROW_COST = 50
#: A bucket with more pairs than this is searched from member to member; the
#: links have the same components either way.
DENSE_PAIRS = 1 << 22
#: A bucket of more rows than this is dealt to smaller ones, which have the same
#: links together.
BUCKET_ROWS = 1 << 20
#: Settings for copies of a similarity of 0.8 or more: five-word shingles, at
#: most 8 of the first 64 bits, and as many of 128 as 0.8 lets differ on average.
SIMILAR = {"shingle": 5, "radius": 8, "total": 20}
#: A fingerprint of more than one row in this many is hot.
HOT_SHARE = 1024


def shingles(text: str, shingle: int) -> Iterator[bytes]:
    found = text.encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(found)
    if len(found) <= shingle:
        if found:
            yield line
        return
    at = np.cumsum([0, *map(len, found)]) + np.arange(len(found) + 1)
    for a, b in zip(at.tolist(), at[shingle:].tolist(), strict=False):
        yield line[a : b - 1]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of hashes as rows of words of 64 bits, the bits set in over half of them."""
    bits = BITS * hashes.shape[1]
    ones = np.zeros(bits, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, seed) for x in shingles(text, shingle)], dtype="<u8").reshape(-1, 1)
    return int(majority(h)[0]) if len(h) else 0


def wide_fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> tuple[int, int]:
    """128 bits, of the 128-bit hashes of shingles."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    h = np.frombuffer(b"".join([digest(x, seed) for x in shingles(text, shingle)]), dtype="<u8").reshape(-1, 2)
    return tuple(majority(h).tolist()) if len(h) else (0, 0)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, *more: str, wide: bool = False) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, rest, its second half if it
    is wide and 0 if not, and more columns."""

    @F.pandas_udf("fp long, rest long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [wide_fingerprint(t, shingle, seed) if wide else (fingerprint(t, shingle, seed), 0) for t in texts]
            yield pd.DataFrame(np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["fp", "rest"])

    return docs.select("doc_id", of(whole_text()).alias("found"), *more).select("doc_id", "found.fp", "found.rest", *more)


@dataclass(frozen=True)
class Plan:
    """bits[i]: the bits of partition i; thresholds[i]: its threshold."""

    bits: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def group_bits(joint: np.ndarray, n: int, m: int) -> tuple[tuple[int, ...], ...]:
    """m groups of correlated bits, of about equal sizes. joint[i, j]: how many
    of n fingerprints have both bits."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for size in (BITS * (i + 1) // m - BITS * i // m for i in range(m)):
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        groups.append(tuple(sorted(group)))
    return tuple(groups)


def ball(width: int, radius: int) -> int:
    from math import comb

    return sum(comb(width, r) for r in range(radius + 1))


def allocate(pairs: list[float], agree: list[list[float]], n: int, radius: int = RADIUS) -> tuple[float, tuple[int, ...]]:
    """Least cost, and thresholds with sum radius - m + 1. pairs[i]: pairs equal
    in partition i; agree[i]: by bit, the chance that two fingerprints agree.
    Pairs within t bits are estimated from those equal and from the bits."""

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        ways = np.array([1.0])
        for a in agree[i]:
            ways = np.convolve(ways, [a, 1 - a])
        near = pairs[i] * ways[: t + 1].sum() / max(ways[0], 1e-300)
        return ROW_COST * n * (1 + (ball(len(agree[i]), t) if t else 0)) + near

    # best[s]: thresholds of the first partitions with sum(t + 1) = s
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for i in range(len(pairs)):
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, radius - s + 1):
                now = (c + cost(i, t), (*ts, t))
                if s + t + 1 <= radius + 1 and now < step.get(s + t + 1, (float("inf"), ())):
                    step[s + t + 1] = now
        best = step
    return best[radius + 1]


def gathered(values: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The chosen bits of each value, side by side."""
    out = np.zeros(len(values), dtype=np.uint64)
    for j, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def choose(distinct: DataFrame, radius: int = RADIUS) -> Plan:
    """A plan for these fingerprints (fp), from counts over all of them: how
    often two bits are both set (64 x 64 numbers for each task, summed), and how
    many pairs are equal in each partition on offer."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BITS * BITS)), pa.array(np.concatenate([[n], total.ravel()]))], names=["cell", "n"])

    cells = dict(distinct.select("fp").mapInArrow(both, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    n = cells.get(-1, 0)
    joint = np.array([cells.get(i, 0) for i in range(BITS * BITS)], dtype=np.float64).reshape(BITS, BITS)
    offers = {m: group_bits(joint, n, m) for m in PARTITIONS if m <= radius + 1}
    listed = [(m, i, bits) for m, groups in offers.items() for i, bits in enumerate(groups)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (_, _, bits) in enumerate(listed):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(gathered(v, bits).view(np.int64))], names=["offer", "value"])

    same = distinct.select("fp").mapInArrow(keyed, "offer long, value long").groupBy("offer", "value").count()
    equal = dict(same.groupBy("offer").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).collect())
    p = np.diag(joint) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    plans = []
    for m, groups in offers.items():
        own = [float(equal.get(k, 0.0)) for k, (m2, _, _) in enumerate(listed) if m2 == m]
        plans.append((*allocate(own, [[float(agree[b]) for b in g] for g in groups], n, radius), groups))
    _, thresholds, groups = min(plans)
    return Plan(groups, thresholds)


@cache
def flips(width: int, radius: int) -> np.ndarray:
    """Masks of 1 to radius bits of `width`."""
    return np.array([sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(width), r)], dtype=np.uint64)


def bucketed(distinct: DataFrame, plan: Plan) -> DataFrame:
    """bucket, fp, rest, probe: every fingerprint in its own buckets (probe
    false) and in those that it probes."""

    most = max(ball(len(bits), t) for bits, t in zip(plan.bits, plan.thresholds, strict=True) if t >= 0)
    step = max(1, min(4096, (1 << 20) // most))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, rests = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(whole), step):
                fp, rest = (np.ascontiguousarray(x[at : at + step]) for x in (whole, rests))
                for i, (bits, t) in enumerate(zip(plan.bits, plan.thresholds, strict=True)):
                    if t < 0:
                        continue
                    own = gathered(fp.view(np.uint64), bits) | np.uint64(i << 48)
                    masks = flips.__wrapped__(len(bits), t) if t else np.zeros(0, dtype=np.uint64)
                    bucket = np.concatenate([own, (own[:, None] ^ masks[None, :]).ravel()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.view(np.int64)), *(pa.array(np.concatenate([x, np.repeat(x, len(masks))])) for x in (fp, rest)), pa.array(np.arange(len(bucket)) >= len(fp))],
                        names=["bucket", "fp", "rest", "probe"],
                    )

    return distinct.select("fp", "rest").mapInArrow(rows, "bucket long, fp long, rest long, probe boolean")


def refined(rows: DataFrame, plan: Plan, radius: int, most: int = BUCKET_ROWS) -> DataFrame:
    """rows (bucket, fp, rest, probe) whose buckets of more than `most` rows are
    dealt to smaller ones: the bits outside the bucket's partition are split into
    radius + 1 groups, in one of which any two within the radius agree, and each
    row goes to a bucket for its value in every group. Names of hot buckets come
    to the driver, 8 bytes for every `most` rows at the most. New names may meet
    by chance, which costs pairs to look at only."""
    hot = np.array([r.bucket for r in rows.groupBy("bucket").count().where(F.col("count") > most).select("bucket").collect()], dtype=np.int64)
    if not len(hot):
        return rows
    hot.sort()
    outside = [[b for b in range(BITS) if b not in own] for own in plan.bits]
    groups = [[tuple(bits[g :: radius + 1]) for g in range(radius + 1)] for bits in outside]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, fp = (np.ascontiguousarray(b.column(c).to_numpy(zero_copy_only=False)) for c in (0, 1))
            at = np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)
            is_hot = hot[at] == bucket
            yield b.filter(pa.array(~is_hot))
            for i, own in enumerate(groups):
                mine = is_hot & (bucket >> 48 == i)
                if not mine.any():
                    continue
                part, now, bits = b.filter(pa.array(mine)), bucket[mine].view(np.uint64), fp[mine].view(np.uint64)
                for g, group in enumerate(own):
                    name = (now * np.uint64(0x9E3779B97F4A7C15) + np.uint64(g + 1)) * np.uint64(0xD6E8FEB86659FD93) ^ gathered(bits, group)
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *part.columns[1:]], names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)


class Forest:
    """Links of a spanning forest over signed longs."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (y := self.up.setdefault(top, top)) != top:
            top = y
        while x != top:
            self.up[x], x = top, self.up[x]
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> Iterator[tuple[int, int]]:
        for x in list(self.up):
            if (y := self.root(x)) != x:
                yield x, y


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, of signed longs."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def search_dense(members: np.ndarray, rest: np.ndarray, radius: int, total: int, forest: Forest) -> None:
    """Links of a forest over all members within the radius, from member to
    member among those not yet reached."""
    left, first = np.unique(members, return_index=True)
    more = rest[first]
    while len(left):
        front, front_more, left, more = left[:1], more[:1], left[1:], more[1:]
        while len(front) and len(left):
            step = max(1, (1 << 22) // len(left))
            now, now_more, front, front_more = front[:step], front_more[:step], front[step:], front_more[step:]
            near = apart(now[:, None], left[None, :])
            near = (near <= radius) & (near + apart(now_more[:, None], more[None, :]) <= total)
            hit = near.any(0)
            for a, b in zip(now[near[:, hit].argmax(0)].tolist(), left[hit].tolist(), strict=True):
                forest.link(a, b)
            front, front_more = np.concatenate([front, left[hit]]), np.concatenate([front_more, more[hit]])
            left, more = left[~hit], more[~hit]


def link_buckets(bucket: np.ndarray, fp: np.ndarray, rest: np.ndarray, probe: np.ndarray, radius: int, total: int, forest: Forest) -> None:
    """Links between the members of whole buckets, which stand together."""
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([start, [len(bucket)]]))
    owners = np.add.reduceat((~probe).astype(np.int64), start)
    busy = (owners > 0) & (size > 1)
    dense = busy & (owners * size > DENSE_PAIRS)
    for s, n in zip(start[dense].tolist(), size[dense].tolist(), strict=True):
        search_dense(fp[s : s + n], rest[s : s + n], radius, total, forest)
    group = np.repeat(np.arange(len(start)), size)
    left = np.flatnonzero((busy & ~dense)[group] & ~probe)
    sizes = size[group[left]]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(left):  # owners against all members of their bucket, some at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DENSE_PAIRS, side="right")))
        n = sizes[at:to]
        a = np.repeat(left[at:to], n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[left[at:to]]], n)
        bits = apart(fp[a], fp[b])
        near = np.flatnonzero((bits <= radius) & (bits > 0))
        near = near[bits[near] + apart(rest[a[near]], rest[b[near]]) <= total]
        for x, y in zip(fp[a[near]].tolist(), fp[b[near]].tolist(), strict=True):
            forest.link(x, y)
        at = to


def links(distinct: DataFrame, plan: Plan, radius: int = RADIUS, total: int | None = None, most: int = BUCKET_ROWS) -> DataFrame:
    """x, y: fingerprints (fp, rest) in links whose components are those of all
    pairs within the radius, and within `total` bits with the rest."""
    total = radius if total is None else total

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        kept: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if found := list(forest.links()):
                x, y = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

        held = 0
        for b in batches:
            now = tuple(np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in b.columns)
            if not len(now[0]):
                continue
            kept.append(now)
            held += len(now[0])
            if held < 200_000 or now[0][0] == now[0][-1] == kept[0][0][0]:
                continue
            rows = [np.concatenate(c) for c in zip(*kept, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1], side="left"))  # the last bucket may go on
            if last:
                link_buckets(*(c[:last] for c in rows), radius, total, forest)
            kept, held = [tuple(c[last:] for c in rows)], len(rows[0]) - last
            if len(forest.up) > 1_000_000:
                yield from out()
                forest = Forest()
        if kept:
            link_buckets(*(np.concatenate(c) for c in zip(*kept, strict=True)), radius, total, forest)
        yield from out()

    rows = refined(bucketed(distinct, plan), plan, radius, most)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verify, "x long, y long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: the smallest node reachable of every node in edges (x, y),
    by alternating large-star and small-star steps (Kiveris et al. 2014)."""
    now = cut(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
        large = both.join(low, F.col("x") == F.col("k")).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), "m")
        small = large.join(low, F.col("x") == F.col("k")).select("x", "y", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))).alias("e")).select("e.*")
        now = cut(small.where("x <> y").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("x").alias("node"), F.col("y").alias("root"))


def grouped(prints: DataFrame, radius: int = RADIUS, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints of prints (fp, rest, doc_id) with first_id, the smallest
    id that has them, and n, the number of rows; and node, root of those linked
    to others: a fingerprint of the group, which no other group has."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min("rest").alias("rest")))
    found = components(links(distinct, choose(distinct, radius), radius, total))
    return distinct, found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest id reachable over
    fingerprints within the radius."""
    prints = cut(fingerprints(docs, shingle, seed))
    distinct, with_roots = grouped(prints, radius)
    named = distinct.join(with_roots, distinct["fp"] == with_roots["node"]).select("fp", "root", "first_id")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = named.join(smallest, "root").select("fp", "least_id")
    every = distinct.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return with_group(prints, every, distinct).select("doc_id", "fp", "component_id")


def with_group(prints: DataFrame, table: DataFrame, distinct: DataFrame) -> DataFrame:
    """prints joined with table, which has one row for each fingerprint. What
    more than one row in HOT_SHARE has is joined by broadcast, of HOT_SHARE rows
    at most, so that it stays where it is; the others are shuffled."""
    total = distinct.agg(F.sum("n")).first()[0] or 0
    hot = [r.fp for r in distinct.where(F.col("n") * HOT_SHARE > total).select("fp").collect()]
    if not hot:
        return prints.join(table, "fp")
    is_hot = F.col("fp").isin(*hot)
    return prints.where(is_hot).join(F.broadcast(table.where(is_hot)), "fp").unionByName(prints.where(~is_hot).join(table.where(~is_hot), "fp"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, total: int | None = None) -> DataFrame:
    """One document of each group, that of the smallest id, null ids last, then
    of the smallest hash; columns unchanged. With `total`, fingerprints have 128
    bits; those whose first 64 are equal are one. Ids may be null or repeated: what
    counts is the group. Rows are known by 128 bits of hash of id and text; of
    equal rows one stays. Texts are shuffled once."""
    from pyspark.sql import Window

    names = [F.col(f"`{c}`") for c in docs.columns]
    keys = [F.xxhash64(F.lit(n), F.col("doc_id"), F.col("text")).alias(f"key{n}") for n in (1, 2)]
    rows = docs.select(F.struct(*names).alias("row"), *keys)
    prints = cut(fingerprints(docs.select("doc_id", "text", *keys), shingle, seed, "key1", "key2", wide=total is not None))
    distinct, with_roots = grouped(prints, radius, total)
    roots = distinct.join(with_roots, distinct["fp"] == with_roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2"))
    first = with_group(prints, roots, distinct).groupBy("root").agg(best.alias("best")).select("best.key1", "best.key2")
    kept = rows.join(first, ["key1", "key2"], "left_semi")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("key1", "key2").orderBy("key1"))).where("n = 1").select("row.*")
