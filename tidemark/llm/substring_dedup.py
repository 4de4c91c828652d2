"""Passages that documents share, by collinear chaining.

Seeds are k-mers of words; of every window of consecutive k-mers the one with
the smallest hash is a seed, so two texts that share enough words in a row share
a seed there. A seed that several documents have is matched with its first
occurrence, in the order of document numbers, not with all others: matches grow with the
text, not with the square of a group. That occurrence may stand in a text that
shares only a short piece, so runs of seeds as long as a part are matched with
the first occurrence of the run as well: texts that share a run are linked over
it, whatever its pieces meet elsewhere. Seeds that no passage covers after that
are compared with all other occurrences, and matched with those that also have
three words in a row in common further off, on the same side, as parts through the
seed have. The matches of two documents are chained:
a chain goes forward in both, gains k for each match and pays for the words
between matches; the best predecessor comes from a Fenwick tree of prefix
maxima. Chains are aligned word by word: from their ends outwards, over small
differences, and between matches that lie on different diagonals by edit
distance. A chain that agrees in too few words is split where the words between
two of its matches differ most, and its pieces are looked at in turn, so that
passages with other text between them do not take each other away.

A passage may be covered by parts that were matched with different documents.
Parts are kept from part_words on; a document's parts that overlap or touch form
a passage, which is reported from min_words on.

Documents that share a passage word by word are linked to documents that have
its runs first, so links between different texts connect all that share it. One
whose copies differ so often that no run is the same in two of them is found by
its single seeds: each copy is compared with the first occurrences, and where
that covers it by no passage with every other copy that has the seed.

Inside the operator a document is a number from its id and a hash of its text, so
rows that share an id, or have none, are documents of their own as long as their
texts differ. Each text is sent once, beside the list of its stretches to look at.

Defined results: null and short texts have no seeds. Equal rows are one
document. Rows with one id and different texts are each compared with all
others, also with each other, and all reported under that id; null ids likewise.
Should two documents have one number, chains that don't fit the text at hand are
passed over. Repetition inside one document is not a passage; what a document
shares with others and has several times is one at each place. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, whole_text

K, WINDOW = 6, 10
MIN_WORDS, PART_WORDS = 50, 25
IDENTITY = 0.8
#: Bits of a text's hash in a document's number.
TEXT_BITS = 16
#: Cost of a word, in either document, between two matches.
GAP_COST = 0.12
MAX_GAP = 48
#: Words around a chain that alignment may extend it over.
MARGIN = 80
#: Words left out in either text where an extension goes on, nearest first, and
#: how many words must agree after them.
STEPS = sorted(((x, y) for x in range(5) for y in range(5) if x or y), key=lambda s: (max(s), abs(s[0] - s[1]), s))
AGAIN = 3
#: Words around a seed that tell which of its occurrences go on alike; from FAR
#: words off the seed on in one of two texts, NEAR in the other, AGAIN words must
#: agree. A part goes on for (PART_WORDS - K) / 2 words at least on one side, and
#: its last AGAIN agree.
AROUND, NEAR = 24, 2
FAR = (PART_WORDS - K + 1) // 2 - AGAIN - 1
#: Repetitions of up to so many words are matched by their lengths, at places
#: STEP words apart (a multiple of all periods).
PERIOD, STEP = 4, 36
#: Runs from -LENGTHS to -2 are lengths of repetitions, negated.
LENGTHS = 1 << 34


def word_hashes(text: str) -> np.ndarray:
    found = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(zlib.crc32, found), dtype=np.uint32, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    n = max(len(words) - k + 1, 0)
    w = mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[j : j + n]
    return mixed(h)


def seeds(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's seeds; of a run of equal ones the first."""
    return minimisers(kmers(words, k), window)


def minimisers(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    view = np.lib.stride_tricks.sliding_window_view(h, min(window, n))
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    own = h[at]
    first = np.concatenate([[True], own[1:] != own[:-1]])
    return own[first].view(np.int64), at[first].astype(np.int32)


def repetitions(h: np.ndarray, part_words: int, k: int = K) -> list[tuple[int, int, int]]:
    """Where a text repeats up to PERIOD words over a part or more: a hash of
    what it repeats, the first place of its smallest k-mer, and the words from
    there to the end of the last one, with the period in the lowest 3 bits."""
    found = []
    for period in range(1, min(PERIOD, len(h) - 1) + 1):
        same = h[period:] == h[:-period]
        if not same.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s + period + k - 1 >= part_words and len(set(h[s : s + period].tolist())) == period:
                least = h[s : s + period].min()
                at = s + np.flatnonzero(h[s : e + period] == least)
                found.append((int(mixed(np.array([least + np.uint64(period)])).view(np.int64)[0]), int(at[0]), int(at[-1] - at[0] + k) << 3 | period))
    return found


def runs(own: np.ndarray, at: np.ndarray, part_words: int, k: int = K) -> np.ndarray:
    """For each seed a hash of the seeds from it to the first that ends
    part_words on or later; -1 where the text has none."""
    n = len(own)
    end = np.searchsorted(at, at + (part_words - k))
    odd = 0xD6E8FEB86659FD93
    powers, back = np.full((2, n + 1), 1, np.uint64)
    powers[1:], back[1:] = odd, pow(odd, -1, 1 << 64)
    powers, back = np.cumprod(powers), np.cumprod(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own.view(np.uint64) * powers[:n])])
    whole = mixed((sums[np.minimum(end + 1, n)] - sums[:n]) * back[:n]).view(np.int64)
    whole = np.where((whole < 0) & (whole >= -LENGTHS), whole ^ (1 << 62), whole)
    return np.where(end < n, whole, -1)


def seed_rows(docs: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Seeds with their runs, and repetitions with their lengths as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                hs, ps, rs, n = [], [], [], []
                for t in part.column(1):
                    every = kmers(word_hashes(t.as_py()))
                    h, p = minimisers(every)
                    r = runs(h, p, part_words)
                    if more := repetitions(every, part_words):
                        x, y, z = (np.array(c, np.int64) for c in zip(*more, strict=True))
                        h, p, r = np.concatenate([h, x]), np.concatenate([p, y.astype(np.int32)]), np.concatenate([r, -z])
                    hs.append(h)
                    ps.append(p)
                    rs.append(r)
                    n.append(len(h))
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(ids), pa.array(np.concatenate(ps)), pa.array(np.concatenate(rs))], names=["h", "doc", "pos", "run"])

    return docs.select("doc", "text").mapInArrow(run, "h long, doc long, pos int, run long")


def chain(i: np.ndarray, j: np.ndarray, k: int = K, cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[int]]:
    """Chains of matches (i in one text, j in the other), as lists of places,
    best first; matches stand in order of j, then i."""
    n = len(i)
    rank = np.unique(i, return_inverse=True)[1].tolist()
    size = max(rank) + 1
    tree_score, tree_at = [-1e18] * (size + 1), [-1] * (size + 1)
    ii, jj = i.tolist(), j.tolist()
    score, before = [0.0] * n, [-1] * n
    at = 0
    while at < n:
        end = at
        while end < n and jj[end] == jj[at]:
            # The best match that ends earlier in both: its score, plus what
            # its place saves of the gap's cost.
            top, who, r = -1e18, -1, rank[end]
            while r > 0:
                if tree_score[r] > top:
                    top, who = tree_score[r], tree_at[r]
                r &= r - 1
            value = top - cost * (ii[end] + jj[end])
            score[end], before[end] = (k + value, who) if who >= 0 and value > 0 else (float(k), -1)
            end += 1
        for m in range(at, end):
            value, r = score[m] + cost * (ii[m] + jj[m]), rank[m] + 1
            while r <= size:
                if value > tree_score[r]:
                    tree_score[r], tree_at[r] = value, m
                r += r & -r
        at = end
    used, out = [False] * n, []
    for m in sorted(range(n), key=lambda m: (-score[m], m)):
        path = []
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = before[m]
        path.reverse()
        cut_at = [0, *(t for t in range(1, len(path)) if max(ii[path[t]] - ii[path[t - 1]], jj[path[t]] - jj[path[t - 1]]) > max_gap + k), len(path)]
        out += [path[a:b] for a, b in zip(cut_at, cut_at[1:], strict=False) if b > a]
    return out


def extension(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> tuple[int, int, int, int]:
    """How far two word sequences go together from their start: words of a, of
    b, aligned columns, and how many of these agree. Where they part, they go on
    at the nearest place where some words agree again, if there is one. The end
    is the last place up to which at least a share `least` of columns agrees."""
    x, y, at, to = a.tolist(), b.tolist(), 0, 0
    columns = agree = 0
    end = (0, 0, 0, 0)
    while True:
        start = at
        while at < len(x) and to < len(y) and x[at] == y[to]:
            at, to = at + 1, to + 1
        columns, agree = columns + at - start, agree + at - start
        if agree >= least * columns:
            end = at, to, columns, agree
        step = next(((u, v) for u, v in STEPS if at + u + AGAIN <= len(x) and x[at + u : at + u + AGAIN] == y[to + v : to + v + AGAIN]), None)
        if step is None:
            return end
        at, to, columns = at + step[0], to + step[1], columns + max(step)


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance, a row at a time."""
    row = np.arange(len(b) + 1)
    for x in a:
        step = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[row[0] + 1], step])
        # Insertions: the least of what stands left, one more for each step.
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def between(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Columns from the end of each match of a chain to the end of the next, and
    how many of these agree."""
    columns, agree = np.zeros(len(i) - 1, np.int64), np.zeros(len(i) - 1, np.int64)
    for t in range(1, len(i)):
        gap_a, gap_b = i[t] - i[t - 1] - k, j[t] - j[t - 1] - k
        if gap_a == gap_b:  # one diagonal; matches may overlap
            lo, hi = i[t - 1] + k, i[t] + k
            agree[t - 1] = (a[lo:hi] == b[j[t - 1] + k : j[t] + k]).sum() if hi > lo else 0
            columns[t - 1] = max(0, hi - lo)
            continue
        lap = max(0, -gap_a, -gap_b)
        x, y = a[i[t - 1] + k : i[t] + lap], b[j[t - 1] + k : j[t] + lap]
        longest = max(len(x), len(y))
        agree[t - 1] = longest - edits(x, y) + k - lap
        columns[t - 1] = longest + k - lap
    return columns, agree


def align(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, inner: tuple[np.ndarray, np.ndarray], least: float = 0.0, k: int = K) -> tuple[int, int, int, int, float]:
    """Start and end in a and in b, and the share of agreeing words, of the
    alignment through a chain's matches; inner is what stands between them."""
    end_a, end_b = i[-1] + k, j[-1] + k
    left_a, left_b, length, agree = extension(a[max(0, i[0] - MARGIN) : i[0]][::-1], b[max(0, j[0] - MARGIN) : j[0]][::-1], least)
    right_a, right_b, more, same = extension(a[end_a : end_a + MARGIN], b[end_b : end_b + MARGIN], least)
    agree, length = agree + same + k + inner[1].sum(), length + more + k + inner[0].sum()
    return int(i[0] - left_a), int(end_a + right_a), int(j[0] - left_b), int(end_b + right_b), float(agree / max(length, 1))


def alignments(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, identity: float) -> Iterator[tuple[int, int, int, int, float]]:
    """The alignment of a chain, or, as long as too few words agree, those of
    its pieces on both sides of the most differing words. The ends of pieces go
    no further than enough words agree, so a single match always has one."""
    columns, agree = between(a, b, i, j)
    whole = align(a, b, i, j, (columns, agree))
    if whole[4] >= identity:
        yield whole
        return
    todo = [(0, len(i))]
    while todo:
        s, e = todo.pop()
        x = align(a, b, i[s:e], j[s:e], (columns[s : e - 1], agree[s : e - 1]), identity)
        if x[4] >= identity:
            yield x
        elif e - s > 1:
            t = s + 1 + int((columns - agree)[s : e - 1].argmax())
            todo += [(t, e), (s, t)]


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of rows with equal first two columns, of sorted batches."""
    kept: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        starts = [0, *new.tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            part = [c[s:e] for c in now]
            if kept and (kept[-1][0][0] != part[0][0] or kept[-1][1][0] != part[1][0]):
                yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))
                kept = []
            kept.append(part)
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def chains(matches: DataFrame, part_words: int) -> DataFrame:
    """Chains of matches (a, b, i, j) that may become parts: a, b, the places of
    their matches, and the stretches of both texts to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            a, b, i, j = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(i, pa.list_(pa.int32())), pa.array(j, pa.list_(pa.int32()))], names=["a", "b", "i", "j"])

        for a, b, i, j in groups_of(batches):
            for path in chain(i, j) if len(i) > 1 else [[0]]:
                if min(i[path[-1]] - i[path[0]], j[path[-1]] - j[path[0]]) + K + 2 * MARGIN >= part_words:
                    rows.append((a[0], b[0], i[path], j[path]))
            if len(rows) >= 2048:
                yield out()
                rows.clear()
        if rows:
            yield out()

    found = matches.repartition("a", "b").sortWithinPartitions("a", "b", "j", "i").mapInArrow(run, "a long, b long, i array<int>, j array<int>")
    stretch = lambda x: (F.greatest(F.get(x, F.lit(0)) - MARGIN, F.lit(0)), F.element_at(x, -1) + K + MARGIN)
    (la, ha), (lb, hb) = stretch(F.col("i")), stretch(F.col("j"))
    return found.withColumns({"la": la, "ha": ha, "lb": lb, "hb": hb})


def stretches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc, lo, hi), distinct, with the id of the document and the word
    hashes of that stretch. Texts and wishes meet in one sorted partition, each
    text before its wishes, so no text is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, text, words = None, None, None, None
        for b in batches:
            docs_, ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            rows: list[tuple] = []
            for n, (doc, lo, hi) in enumerate(zip(docs_, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if lo is None:
                    if doc != last:
                        last, own, text, words = doc, ids[n], texts[n].as_py(), None
                elif doc == last:
                    words = word_hashes(text) if words is None else words
                    rows.append((doc, own, lo, hi, words[lo:hi].tobytes()))
                if rows and (len(rows) == 2048 or n == len(docs_) - 1):
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "id", "lo", "hi", "words"])

    none = F.lit(None)
    both = docs.select("doc", "id", "text", none.cast("int").alias("lo"), none.cast("int").alias("hi")).unionByName(wanted.select("doc", none.cast("long").alias("id"), none.cast("string").alias("text"), F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")))
    return both.repartition("doc").sortWithinPartitions("doc", "lo", "hi").mapInArrow(run, "doc long, id long, lo int, hi int, words binary")


PARTS = "a long, a_id long, a_start int, a_end int, b long, b_id long, b_start int, b_end int, identity double"


def aligned(found: DataFrame, docs: DataFrame, identity: float, part_words: int) -> DataFrame:
    sides = [found.select(F.col(x).alias("doc"), F.col(f"l{x}").alias("lo"), F.col(f"h{x}").alias("hi")) for x in "ab"]
    words = cut(stretches(docs, sides[0].unionByName(sides[1]).distinct()))
    both = found
    for x in "ab":
        both = both.join(words.select(F.col("doc").alias(x), F.col("id").alias(f"{x}_id"), F.col("lo").alias(f"l{x}"), F.col("hi").alias(f"h{x}"), F.col("words").alias(f"w{x}")), [x, f"l{x}", f"h{x}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        names = ["a", "a_id", "a_start", "a_end", "b", "b_id", "b_start", "b_end", "identity"]
        for batch in batches:
            rows = []
            for a, b, a_id, b_id, la, lb, i, j, wa, wb in zip(*(batch.column(c).to_pylist() for c in range(10)), strict=True):
                x, y, i, j = np.frombuffer(wa, np.uint32), np.frombuffer(wb, np.uint32), np.array(i) - la, np.array(j) - lb
                if i[-1] + K > len(x) or j[-1] + K > len(y):  # of another text with this hash
                    continue
                for at in alignments(x, y, i, j, identity):
                    if min(at[1] - at[0], at[3] - at[2]) >= part_words:
                        rows.append((a, a_id, at[0] + la, at[1] + la, b, b_id, at[2] + lb, at[3] + lb, at[4]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return both.select("a", "b", "a_id", "b_id", "la", "lb", "i", "j", "wa", "wb").mapInArrow(run, PARTS)


def document_key() -> Column:
    """A number for each document: the id and TEXT_BITS of a hash of the text,
    which shuffles in few bytes; of ids that leave no room, or null, a negative
    hash of id and text."""
    hashed, room = F.xxhash64("id", "text"), 1 << (63 - TEXT_BITS)
    short = F.shiftleft("id", TEXT_BITS).bitwiseOR(hashed.bitwiseAND(F.lit((1 << TEXT_BITS) - 1)))
    return F.when((F.col("id") >= 0) & (F.col("id") < room), short).otherwise(hashed.bitwiseOR(F.lit(-(1 << 63))))


OCCURRENCES = "a long, i int, doc long, pos int, open boolean, around binary"


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (a, i, doc, pos, open) with 16 bits of the hash of each of the
    AROUND words after a seed, then before it, nearest first; 0 where the text
    ends. Texts and wishes meet as in stretches()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text, words = None, None, None
        for b in batches:
            docs_, texts, pos, rows, around = b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), [], []
            for n, (doc, p) in enumerate(zip(docs_, pos, strict=True)):
                if p is None:
                    if doc != last:
                        last, text, words = doc, texts[n].as_py(), None
                elif doc == last:
                    if words is None:
                        words = np.concatenate([np.zeros(AROUND, np.uint16), word_hashes(text) % 65535 + 1, np.zeros(AROUND + K, np.uint16)]).astype(np.uint16)
                    if p + K + 2 * AROUND <= len(words) - K:  # else of another text with this number
                        at = p + AROUND
                        rows.append(n)
                        around.append(np.concatenate([words[at + K : at + K + AROUND], words[p:at][::-1]]).tobytes())
            if rows:
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([kept.column(4), kept.column(5), kept.column(0), kept.column(2), kept.column(3), pa.array(around, pa.binary())], names=["a", "i", "doc", "pos", "open", "around"])

    none = F.lit(None)
    texts = docs.select("doc", "text", none.cast("int").alias("pos"), none.cast("boolean").alias("open"), none.cast("long").alias("a"), none.cast("int").alias("i"))
    both = texts.unionByName(wanted.select("doc", none.cast("string").alias("text"), "pos", "open", "a", "i"))
    return both.repartition("doc").sortWithinPartitions("doc", "pos").mapInArrow(run, OCCURRENCES)


def alike(around: np.ndarray, fresh: np.ndarray, far_off: int = FAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of contexts, one of them fresh at least, that have AGAIN
    words in a row in common on one side, from far_off words off in one of them
    and NEAR in the other; pairs may come again. Words that repeat those before
    them don't count, as repetitions are matched by their lengths; where one side
    is such, the other needs to agree for the rest of a part only. Rows that
    make a part of the same two repetitions meet the first that has as many of both."""
    n = len(around)
    sides, beside = [], []
    for side in (around[:, :AROUND], around[:, AROUND:]):
        grams, whole, again = np.zeros((n, AROUND - AGAIN + 1), np.uint64), np.ones((n, AROUND - AGAIN + 1), bool), np.zeros((n, AROUND - AGAIN + 1), bool)
        for t in range(AGAIN):
            part = side[:, t : AROUND - AGAIN + 1 + t]
            grams, whole = grams << np.uint64(16) | part, whole & (part > 0)
        for t in range(1, PERIOD + 1):
            again[:, t:] |= grams[:, t:] == grams[:, :-t]
        again &= whole
        sides.append((grams, whole & ~again))
        repeated = np.where(again[:, far_off], far_off + np.logical_and.accumulate(again[:, far_off:], axis=1).sum(1) + AGAIN - 1, 0)
        beside.append(np.clip(2 * (far_off + AGAIN + 1) - 1 - repeated - AGAIN - 1, 0, far_off))
    need = 2 * (far_off + AGAIN + 1) - 1
    after, before = around[:, :AROUND], around[:, AROUND:]
    many = [(s[:, 0] > 0) * (1 + np.logical_and.accumulate(s[:, 1:] == s[:, :1], axis=1).sum(1)) for s in (after, before)]
    both = np.flatnonzero((many[0] > 0) & (many[1] > 0) & (many[0] + many[1] >= need) & (after[:, 0] != before[:, 0]))
    kind = after[both, 0].astype(np.int64) << 16 | before[both, 0]
    for j in range(1, need) if len(both) > 1 else ():
        enough = (many[0][both] >= j) & (many[1][both] >= need - j)
        _, first, which = np.unique(kind[enough], return_index=True, return_inverse=True)
        y = both[enough]
        x = y[first][which] if len(y) else y
        good = (x != y) & (fresh[x] | fresh[y])
        if good.any():
            yield x[good], y[good]
    for (grams, whole), least in zip(sides, beside[::-1], strict=True):
        # Near ones sorted by their words; each far one meets those equal to it.
        row, off = np.nonzero(whole)
        near, far = off >= np.minimum(NEAR, least)[row], off >= least[row]
        key = grams[row, off]
        order = np.argsort(key[near], kind="stable")
        sorted_key, sorted_row = key[near][order], row[near][order]
        far_key, far_row = key[far], row[far]
        lo, hi = np.searchsorted(sorted_key, far_key), np.searchsorted(sorted_key, far_key, "right")
        lone = hi - lo < 2  # itself only
        lo, hi, far_row = lo[~lone], hi[~lone], far_row[~lone]
        total = np.cumsum(hi - lo)
        start = 0
        while start < len(lo):  # about a million pairs at a time
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + (1 << 20))))
            count = hi[start:end] - lo[start:end]
            x = np.repeat(far_row[start:end], count)
            y = sorted_row[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[start:end], count)]
            good = (x != y) & (fresh[x] | fresh[y])
            x, y = np.minimum(x, y)[good], np.maximum(x, y)[good]
            if len(x):
                pairs = np.unique(x.astype(np.int64) * n + y)
                yield pairs // n, pairs % n
            start = end


def repeated_matches(shared: DataFrame) -> DataFrame:
    """Matches (a, b, i, j) of repetitions with the longest of the same words in
    another document, which has all of them, at places STEP apart. The longest
    one meets that of the other again and again, as far as it goes."""
    group = Window.partitionBy("a", "i", F.col("run").bitwiseAND(7))
    longest = shared.where(repetition()).select("a", "i", F.abs("run").alias("run"), "doc", "pos").withColumn("x", F.min(F.struct((-F.col("run")).alias("run"), "doc", "pos")).over(group))
    longest = longest.withColumn("y", F.min(F.when(F.col("doc") != F.col("x.doc"), F.struct((-F.col("run")).alias("run"), "doc", "pos"))).over(group))
    with_ = F.when(F.col("doc") == F.col("x.doc"), F.col("y")).otherwise(F.col("x"))
    pairs = longest.select("doc", "pos", "run", with_.alias("o")).where("o IS NOT NULL")
    own, less = (F.shiftright(x, 3).cast("int") for x in (F.col("run"), F.least(F.col("run"), -F.col("o.run"))))
    up_to = lambda end, step: F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0), end, step), F.array(end))))
    pairs = pairs.withColumn("at", up_to(less - K, F.lit(STEP))).withColumn("shift", up_to(own - less, F.greatest(less - less % 12, F.lit(12))))
    mine = F.struct("doc", (F.col("pos") + F.col("at") + F.col("shift")).alias("pos"))
    other = F.struct(F.col("o.doc").alias("doc"), (F.col("o.pos") + F.col("at")).alias("pos"))
    return pairs.select(F.least(mine, other).alias("l"), F.greatest(mine, other).alias("g")).select(F.col("l.doc").alias("a"), F.col("g.doc").alias("b"), F.col("l.pos").alias("i"), F.col("g.pos").alias("j")).distinct()


def repetition() -> Column:
    return F.col("run").between(-LENGTHS, -2)


def open_matches(shared: DataFrame, covered: DataFrame, docs: DataFrame, part_words: int) -> DataFrame:
    """Matches (a, b, i, j) of seeds that lie in no passage (doc, passage_start,
    passage_end) with all other occurrences but the first, where both go on
    alike. Occurrences with the same words around are matched with one of them,
    and that one with the others."""
    inside = (F.col("doc") == F.col("in_doc")) & (F.col("pos") >= F.col("passage_start")) & (F.col("pos") + K <= F.col("passage_end"))
    group = Window.partitionBy("a", "i")
    several = shared.where(~repetition()).select("a", "i", "doc", "pos").where("doc <> a").withColumns({"x": F.min("doc").over(group), "y": F.max("doc").over(group)}).where("x < y")
    # A document's passages are apart, so a seed is in one at most.
    marked = several.join(covered.withColumnRenamed("doc", "in_doc"), inside, "left").select("a", "i", "doc", "pos", F.col("in_doc").isNull().alias("open"))
    wanted = marked.withColumn("any", F.max("open").over(group)).where("any")
    far = min(max((part_words - K + 1) // 2 - AGAIN - 1, 0), FAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, doc, pos, fresh_, around in groups_of(batches):
            words = np.frombuffer(b"".join(around), np.uint16).reshape(len(doc), 2 * AROUND)
            # Rows stand in order of doc and pos, so the first of equal ones has the least.
            _, first, which = np.unique(words, axis=0, return_index=True, return_inverse=True)
            any_fresh = np.zeros(len(first), bool)
            np.logical_or.at(any_fresh, which, fresh_.astype(bool))
            order = np.argsort(first)
            own = np.arange(len(doc))
            star = (first[which] != own) & any_fresh[which]
            found = [(first[which][star], own[star])]
            chosen = first[order]
            for x, y in [*found, *((chosen[x], chosen[y]) for x, y in alike(words[chosen], any_fresh[order], far))]:
                good = doc[x] != doc[y]
                x, y = x[good], y[good]
                for s in range(0, len(x), 1 << 16):
                    u, v = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[u]), pa.array(doc[v]), pa.array(pos[u].astype(np.int32)), pa.array(pos[v].astype(np.int32))], names=["a", "b", "i", "j"])

    seen = contexts(docs, wanted).repartition("a", "i").sortWithinPartitions("a", "i", "doc", "pos")
    return seen.mapInArrow(run, "a long, b long, i int, j int").distinct()


def whole_passages(parts: DataFrame, min_words: int) -> DataFrame:
    """doc, start, end of each stretch that a part covers, and the passage that
    it belongs to, of min_words or more."""
    side = lambda x: parts.select(F.col(x).alias("doc"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end"))
    spans = side("a").unionByName(side("b")).distinct()
    line = Window.partitionBy("doc").orderBy("start", "end")
    new = F.coalesce((F.col("start") > F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    spans = spans.withColumn("new", new).withColumn("n", F.sum("new").over(line))
    whole = Window.partitionBy("doc", "n")
    spans = spans.withColumns({"passage_start": F.min("start").over(whole), "passage_end": F.max("end").over(whole)}).where(F.col("passage_end") - F.col("passage_start") >= min_words)
    return spans.select("doc", "start", "end", "passage_start", "passage_end")


def passages(docs: DataFrame, min_words: int = MIN_WORDS, part_words: int = PART_WORDS, identity: float = IDENTITY) -> DataFrame:
    """doc_id, start, end, other_id, other_start, other_end (in words, the end
    exclusive), identity, passage_start, passage_end: every part that a document
    shares with another, in both directions, and the passage that it belongs
    to."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text")).select(document_key().alias("doc"), "id", "text")
    # Seeds are made and dealt once; a group of equal ones may be spilled.
    equal = Window.partitionBy("h").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"a": F.first("doc"), "i": F.first("pos"), "last": F.last("doc"), "last_pos": F.last("pos")}
    all_seeds = seed_rows(d, part_words).withColumns({c: f.over(equal) for c, f in ends.items()}).where("a < last")
    # Where the first document has a seed again, it is matched with the last one.
    back = (F.col("doc") == F.col("a")) & (F.col("pos") != F.col("i"))
    shared = cut(all_seeds.select("run", "doc", "pos", "a", "i", F.when(back, F.col("last")).alias("z"), F.when(back, F.col("last_pos")).alias("zi")))
    del all_seeds
    release(docs.sparkSession)
    # A run has the match of its first seed, and one of its own if it starts elsewhere first.
    whole_runs = shared.where((F.col("run") != -1) & ~repetition())
    own = whole_runs.groupBy("run").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last"), F.min("a").alias("a"), F.min("i").alias("i"))
    own = own.where("first.doc < last AND (first.doc <> a OR first.pos <> i)").select("run", F.col("first.doc").alias("a"), F.col("first.pos").alias("i"))
    again = whole_runs.select("run", "doc", "pos").join(own, "run").where("doc <> a")
    matches = reduce(DataFrame.unionByName, (m.select("a", F.col("doc").alias("b"), "i", F.col("pos").alias("j")) for m in (shared.where("doc <> a").where(~repetition()), again)))
    matches = matches.unionByName(repeated_matches(shared))
    matches = matches.unionByName(shared.where("z IS NOT NULL").where(~repetition()).select(F.col("z").alias("a"), F.col("doc").alias("b"), F.col("zi").alias("i"), F.col("pos").alias("j")))
    found = cut(chains(matches, part_words))
    release(docs.sparkSession)
    parts = cut(aligned(found, d, identity, part_words).distinct())
    del whole_runs, own, again, matches, found
    release(docs.sparkSession)
    covered = whole_passages(parts, min_words).select("doc", "passage_start", "passage_end").distinct()
    found = cut(chains(open_matches(shared, covered, d, part_words), part_words))
    release(docs.sparkSession)
    parts = cut(parts.unionByName(aligned(found, d, identity, part_words)).distinct())
    del covered, found
    release(docs.sparkSession)
    spans = whole_passages(parts, min_words)
    one_way = lambda x, y: parts.select(F.col(x).alias("doc"), F.col(f"{x}_id").alias("doc_id"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end"), F.col(f"{y}_id").alias("other_id"), F.col(f"{y}_start").alias("other_start"), F.col(f"{y}_end").alias("other_end"), "identity")
    rows = one_way("b", "a").unionByName(one_way("a", "b"))
    return rows.join(spans, ["doc", "start", "end"]).select("doc_id", "start", "end", "other_id", "other_start", "other_end", "identity", "passage_start", "passage_end")
