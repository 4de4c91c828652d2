"""Near-duplicates, shared passages and neighbours against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import ann, simhash, substring_dedup

# --- SimHash


def plain_fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    left, out = set(range(len(ids))), {}
    while left:
        front, group = [left.pop()], []
        while front:
            x = front.pop()
            group.append(x)
            near = [y for y in left if bin(fps[x] ^ fps[y]).count("1") <= radius]
            left -= set(near)
            front += near
        known = [ids[x] for x in group if ids[x] is not None]
        out |= {x: min(known, default=None) for x in group}
    return out


@pytest.mark.parametrize("text", ["", " ", "a", "A b c", "A B c d", "a b c d e f", "é É ÄB x\x0by z\x1cw", "x " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choices(words, k=rng.randint(30, 200)) for _ in range(60)]
    rows = []
    for i in range(300):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((1000 - i, " ".join(t)))
    rows += [(5000, None), (4999, ""), (None, "alone and unlike any other text here"), (None, rows[0][1]), rows[3], rows[3], (6000, "w1 " * 20_000)]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component_id int, fp int")).collect()
    fps = [plain_fingerprint(t or "") for _, t in rows]
    want = plain_components([i for i, _ in rows], fps)
    expected = sorted(((i, fps[n], want[n]) for n, (i, _) in enumerate(rows)), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == expected
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted({w for w in want.values()}, key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.keep_one(df.limit(0)).count() == 0


def test_clashing_names_and_rows_of_one_id_stay(spark):
    texts = [" ".join(f"x{n}y{i}" for i in range(40)) for n in range(6)]
    rows = list(zip([None, None, None, 7, 7, 8], texts, strict=True)) + [(7, texts[3])]
    df = spark.createDataFrame([(*r, 1, 2, "q", 4) for r in rows], "doc_id long, text string, __n int, __id int, `a.b` string, key1 int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i or 0, t) for i, t in rows[:6])


def test_one_text_of_each_group_is_kept(spark):
    rng = random.Random(21)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(24)]
    rows = [(None, t) for t in texts[:8]] + [(None, texts[0]), (1, texts[1]), (2, None), (None, "")]  # null ids, alone, twice, and beside an id
    for n, t in enumerate(texts[8:16]):  # ids of two groups: their own, and one that a smaller id has
        rows += [(100 + n, t), (100 + n, texts[16 + n]), (50 + n, texts[16 + n])]
    kept = simhash.keep_one(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n int"))
    want = [(None, texts[0]), (1, texts[1]), *((None, t) for t in texts[2:8]), (2, None)]
    want += [x for n in range(8) for x in ((100 + n, texts[8 + n]), (50 + n, texts[16 + n]))]
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted(want, key=str) and kept.columns == ["doc_id", "text", "n"]


@pytest.mark.parametrize("thresholds", [(0, 0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0), (2, 0, 0), (3, -1, 0), (1, 2), (4,)])
@pytest.mark.parametrize("most", [simhash.BUCKET_ROWS, 6])
def test_every_plan_finds_all_links(spark, thresholds, most):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    m = len(thresholds)
    plan = simhash.Plan(simhash.group_bits(np.eye(64), 2, m), thresholds)
    if m == 1:
        plan = simhash.Plan((tuple(range(24)),), (4,))  # covers links within these bits only
        fps = [f & 0xFFFFFF for f in fps]
        fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), 0) for f in fps], "fp long, rest long")
    forest = simhash.Forest()
    for r in simhash.links(df, plan, most=most).collect():
        forest.link(r.x, r.y)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    comp = plain_components(signed, fps)
    assert len({forest.root(s) for s in signed}) == len(set(comp.values())) and all(forest.root(s) == comp[n] for n, s in enumerate(signed))


def test_dense_buckets_equal_pairs():
    rng = np.random.default_rng(2)
    x = np.unique(np.concatenate([(np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)), rng.integers(0, 1 << 63, 200, dtype=np.uint64)])).view(np.int64)
    a, b = simhash.Forest(), simhash.Forest()
    for total, rest in ((4, np.zeros(len(x), np.int64)), (5, rng.integers(0, 4, len(x)))):
        a, b = simhash.Forest(), simhash.Forest()
        simhash.search_dense(x, rest, 4, total, a)
        simhash.link_buckets(np.zeros(len(x), np.int64), x, rest, np.zeros(len(x), bool), 4, total, b)
        assert [a.root(int(v)) for v in x] == [b.root(int(v)) for v in x]


def test_copies_of_some_similarity(spark):
    rng = random.Random(4)
    texts = []
    for n in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(words)
        for edits in (1, 2, 4):
            copy = list(words)
            for x in rng.sample(range(200), edits):
                copy[x] = f"z{rng.randrange(10**6)}"
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.SIMILAR).collect()}
    prints = [simhash.wide_fingerprint(t, 5) for _, t in rows]
    far = lambda a, b: (bin(a[0] ^ b[0]).count("1"), bin(a[1] ^ b[1]).count("1"))
    left, want = set(range(len(rows))), set()
    while left:
        group = front = {min(left)}
        want |= front
        while front:
            front = {y for y in left - group if any((d := far(prints[x], prints[y]))[0] <= 8 and sum(d) <= 20 for x in front)}
            group = group | front
        left -= group
    assert kept == want and {4 * n for n in range(60)} <= kept
    assert [sum(4 * n + e in kept for n in range(60)) <= most for e, most in ((1, 3), (2, 20))] == [True, True]


def test_thresholds_are_allocated():
    # A skewed partition gets a lower threshold than even ones.
    even = [[0.5] * 16] * 4
    cost, t = simhash.allocate([1e9, 1e3, 1e3, 1e3], even, 1000)
    assert sum(t) == 4 - 4 + 1 and t[0] <= min(t[1:])
    assert cost <= simhash.allocate([1e9, 1e9, 1e9, 1e9], even, 1000)[0]
    joint = np.full((64, 64), 25.0)
    np.fill_diagonal(joint, 50)
    joint[3, 40] = joint[40, 3] = 50
    groups = simhash.group_bits(joint, 100, 4)
    assert any({3, 40} <= set(g) for g in groups) and sorted(b for g in groups for b in g) == list(range(64))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "x long, y long")
    got = dict(simhash.components(edges).collect())
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


# --- passages


def planted(seed=5, edits=2):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows, want = fresh(60), [], {}
    for i in range(60):
        before, after, mid = fresh(rng.randint(10, 80)), fresh(rng.randint(10, 80)), []
        if i % 2 == 0:
            mid = list(passage)
            for _ in range(edits):
                x, how = rng.randrange(5, 55), rng.randrange(3)
                if how == 0:
                    mid[x] = f"z{rng.randrange(10**6)}"
                elif how == 1:
                    mid.pop(x)
                else:
                    mid.insert(x, f"y{rng.randrange(10**6)}")
            want[i] = (len(before), len(before) + len(mid))
        rows.append((i, " ".join(before + mid + after)))
    return rows, want


def test_passages(spark):
    rows, want = planted()
    odd = [(100, None), (101, ""), (None, "a b"), (None, rows[3][1]), (102, "x " * 20_000), (103, rows[1][1]), (103, rows[1][1]), (104, rows[1][1].upper())]
    got = substring_dedup.passages(spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, start int")).collect()
    copied = len(rows[3][1].split()) >= substring_dedup.MIN_WORDS
    assert {r.other_id for r in got if r.doc_id is None} == ({3} if copied else set()) and {r.doc_id for r in got if r.other_id is None} == ({3} if copied else set())
    got = [r for r in got if r.doc_id not in (None, 3)]
    found = {r.doc_id: (r.passage_start, r.passage_end) for r in got if r.doc_id % 2 == 0 and r.doc_id < 100}
    assert len(set(found) - set(want)) == 0 and len(set(want) - set(found)) <= 1
    assert all(abs(found[i][0] - want[i][0]) <= 3 and abs(found[i][1] - want[i][1]) <= 3 for i in found)
    copies = {r.doc_id for r in got} - set(want)
    assert copies == ({1, 103, 104} if len(rows[1][1].split()) >= substring_dedup.MIN_WORDS else set())
    assert substring_dedup.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_passages_are_exact(spark):
    rows, want = planted(edits=0)
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.passage_start, r.passage_end) for r in got} == want and all(r.identity == 1 for r in got)


def test_passages_with_other_text_between(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, two = fresh(55), fresh(55)
    rows = [(i, " ".join(fresh(20) + one + fresh(35) + two + fresh(20))) for i in range(3)]
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.passage_start, r.passage_end) for r in got} == {(i, s, s + 55) for i in range(3) for s in (20, 110)} and all(r.identity == 1 for r in got)


def test_passages_whose_pieces_stand_elsewhere(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for n in range(40):  # lines of 20 words, each alone in an earlier document
        lines = [fresh(20) for _ in range(3)]
        rows += [(10 * n + x, " ".join(fresh(30) + line + fresh(30))) for x, line in enumerate(lines)]
        for i in (10 * n + 5, 10 * n + 6):
            rows.append((i, " ".join(fresh(30) + sum(lines, []) + fresh(30))))
            want.add((i, 30, 90))
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.passage_start, r.passage_end) for r in got} == want


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(31)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    long, other = fresh(200), fresh(80)
    rows = [(1, "aa bb"), (1, " ".join(long)), (2, " ".join(long)), (1, " ".join(other)), (3, " ".join(fresh(30) + other)), (None, " ".join(other)), (None, " ".join(fresh(90)))]
    got = substring_dedup.passages(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, doc int, `a.b` string")).collect()
    assert {(r.doc_id, r.passage_start, r.passage_end) for r in got} == {(1, 0, 200), (2, 0, 200), (1, 0, 80), (3, 30, 110), (None, 0, 80)}
    assert all(r.identity == 1 and r.end - r.start == r.other_end - r.other_start for r in got)


def test_document_numbers(spark):
    ids = [0, 1, 1, 5, (1 << 47) - 1, 1 << 47, -3, -(1 << 63), (1 << 63) - 1, None, None]
    rows = [(i, f"text {n}") for n, i in enumerate(ids)] + [(1, "text 1")]
    got = [r.k for r in spark.createDataFrame(rows, "id long, text string").select(substring_dedup.document_key().alias("k")).collect()]
    assert len(set(got)) == len(ids) and got[1] == got[-1]
    assert [k >> 16 if k >= 0 else None for k in got[:5]] == ids[:5] and all(k < 0 for k in got[5:-1])


def shared_windows(rows, n=50):
    """Brute force: all stretches of n words that stand in another document, as covered words by document."""
    where = {}
    for d, (_, t) in enumerate(rows):
        w = t.lower().split()
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), set()).add((d, i))
    out = {d: set() for d in range(len(rows))}
    for at in where.values():
        if len({d for d, _ in at}) > 1:
            for d, i in at:
                out[d] |= set(range(i, i + n))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_exact_passage_of_min_words_is_covered(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    pool = [fresh(rng.randint(12, 90)) for _ in range(12)]
    rows = []
    for i in range(120):  # pieces of the pool, whole or in part, between other words
        words = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(0, len(p) // 2) if rng.random() < 0.3 else 0
            words += fresh(rng.randint(1, 40)) + p[a:]
        rows.append((i, " ".join(words)))
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    short = substring_dedup.WINDOW - 1  # by which an end may be short where pieces begin elsewhere
    for d, words in shared_windows(rows, substring_dedup.MIN_WORDS + 2 * short).items():
        mine = {x for r in got if r.doc_id == rows[d][0] for x in range(r.passage_start, r.passage_end)}
        lost = sorted(words - mine)
        assert all(lost[n + short] - lost[n] > short for n in range(len(lost) - short)), (d, lost)


def test_copies_with_common_short_pieces_are_linked(spark):
    rng = random.Random(77)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    rows = [(n, " ".join(fresh(20) + passage[2 * n : 2 * n + 24] + fresh(20))) for n in range(19)]
    rows += [(i, " ".join(fresh(25) + passage + fresh(25))) for i in (100, 111)]
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.passage_start, r.passage_end) for r in got if r.doc_id >= 100} == {(100, 25, 85), (111, 25, 85)}


def connected(links):
    """Documents that links connect."""
    groups = {}
    for x, y in links:
        both = groups.get(x, {x}) | groups.get(y, {y})
        groups.update(dict.fromkeys(both, both))
    return {frozenset(g) for g in groups.values()}


def test_copies_with_edits_whose_pieces_stand_elsewhere_are_linked(spark):
    rng = random.Random(41)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for n in range(10):  # an edit every 16 words; each piece of 15 stands alone in an earlier document
        passage, copies = fresh(80), []
        for _ in range(3):
            words = list(passage)
            words[15::16] = fresh(5)
            copies.append(words)
        rows += [(20 * n + x, " ".join(fresh(30) + passage[16 * x : 16 * x + 15] + fresh(30))) for x in range(5)]
        for x, words in enumerate(copies):
            rows.append((20 * n + 10 + x, " ".join(fresh(30) + words + fresh(30))))
            want.add(20 * n + 10 + x)
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = connected((r.doc_id, r.other_id) for r in got)
    assert sorted(map(sorted, linked)) == [[20 * n + 10, 20 * n + 11, 20 * n + 12] for n in range(10)] and {r.doc_id for r in got} == want
    assert {(r.passage_start, r.passage_end) for r in got} == {(30, 109)} and all(r.identity >= 0.8 for r in got)


def test_repeated_words_are_linked_without_all_pairs(spark):
    rng = random.Random(51)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    many = 60
    rows = [(n, " ".join(fresh(9) + ["of"] * (26 + n % 23) + ["to"] * (26 + 7 * n % 23) + fresh(9))) for n in range(many)]
    rows += [(100, " ".join(["der"] * 200)), (101, " ".join(fresh(9) + ["der"] * 60 + fresh(9))), (102, " ".join(["der"] * 55))]
    rows += [(200 + n, " ".join(fresh(9) + ["ja", "so"] * (40 + n) + fresh(9))) for n in range(many)]
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) <= 20 * (2 * many + 3)
    for d, words in shared_windows(rows).items():
        assert words <= {x for r in got if r.doc_id == rows[d][0] for x in range(r.passage_start, r.passage_end)}, rows[d][0]
    assert connected((r.doc_id, r.other_id) for r in got) == {frozenset(range(many)), frozenset((100, 101, 102)), frozenset(range(200, 200 + many))}


def test_pieces_of_two_repetitions_meet_the_first():
    rng = np.random.default_rng(9)
    n, side = 300, substring_dedup.AROUND
    around = rng.integers(3, 1 << 16, (n, 2 * side)).astype(np.uint16)
    ends = [(int(x), 19 - int(x)) for x in rng.integers(3, 17, n)]
    for row, (x, y) in zip(around, ends, strict=True):
        row[:x], row[side : side + y] = 1, 2
    found = {(int(x), int(y)) for xs, ys in substring_dedup.alike(around, np.ones(n, bool)) for x, y in zip(xs, ys, strict=True)}
    linked = connected(found)
    assert len(found) <= 20 * n
    for at in set(ends):
        same = {x for x in range(n) if ends[x] == at}
        assert len(same) < 2 or any(same <= g for g in linked)


def test_lines_alone_are_not_alike():
    rng = np.random.default_rng(8)
    around = (rng.permutation((1 << 16) - 1)[: 600 * substring_dedup.AROUND] + 1).reshape(300, -1).astype(np.uint16)
    around[:, :8] = around[0, :8]  # a line of 14 words
    around[40, 20:23] = around[70, 16:19]
    around[41, 44:] = around[71, 44:]
    around[:, 40:44] = 0  # texts end there
    pairs = lambda fresh: {(int(x), int(y)) for xs, ys in substring_dedup.alike(around, fresh) for x, y in zip(xs, ys, strict=True)}
    assert pairs(np.ones(300, bool)) == {(40, 70), (41, 71)} and pairs(np.arange(300) == 71) == {(41, 71)} and not pairs(np.zeros(300, bool))


def test_runs_depend_on_their_seeds_only():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    (h, p), (g, q) = substring_dedup.seeds(words), substring_dedup.seeds(words[70:])
    one, two = substring_dedup.runs(h, p, 25), substring_dedup.runs(g, q, 25)
    both = set(one) & set(two) - {-1}
    assert len(both) >= len(set(two)) - 3 and len(set(one)) == len(set(one[one != -1])) + 1
    assert all(r == -1 for r in substring_dedup.runs(h[:2], p[:2], 60)) and len(substring_dedup.runs(h[:0], p[:0], 25)) == 0


def test_chain_equals_all_predecessors():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        pairs = sorted({(int(j), int(i)) for i, j in rng.integers(0, 60, (n, 2))})
        i, j = np.array([p[1] for p in pairs]), np.array([p[0] for p in pairs])
        k, cost = substring_dedup.K, substring_dedup.GAP_COST
        best = []
        for x in range(len(i)):
            before = [best[y] - cost * (i[x] - i[y] + j[x] - j[y]) for y in range(x) if i[y] < i[x] and j[y] < j[x]]
            best.append(k + max([0, *before]))
        path = substring_dedup.chain(i, j, max_gap=10**6)[0]
        score = sum(k for _ in path) - cost * (i[path[-1]] - i[path[0]] + j[path[-1]] - j[path[0]])
        assert abs(score - max(best)) < 1e-9 and all(i[a] < i[b] and j[a] < j[b] for a, b in zip(path, path[1:], strict=False))


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for t, y in enumerate(b):
                new.append(min(row[t] + (x != y), row[t + 1] + 1, new[t] + 1))
            row = new
        return row[-1]

    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        assert substring_dedup.edits(a, b) == plain(a.tolist(), b.tolist())


# --- neighbours


def plain_nearest(ids, x, every, k):
    out = []
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] ** 2).sum()))
        own = [(-s[i], ids[i]) for i in range(len(ids)) if ids[i] != ids[q]]
        out += [(int(ids[q]), n + 1, int(i), -v) for n, (v, i) in enumerate(sorted(own)[:k])]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 6000)] + 0.6 * rng.normal(size=(6000, 16))).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(7000, None, 1), (7050, [0.0] * 16, 1), (7100, [float("nan")] * 16, 1), (7150, [1.0, None] * 8, 1), (7200, [1.0] * 3, 1), (None, [1.0] * 16, 1), (7250, [], 1), (7300, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    got = ann.search(df).collect()
    want = plain_nearest(np.arange(6000), x.astype(np.float64), 50, 5)
    have, exact = {(r.query_id, r["vec_id"]): r.score for r in got}, {(q, v): s for q, _, v, s in want}
    assert len(got) == len(want) and len(set(have) & set(exact)) / len(exact) >= 0.95
    assert all(abs(have[k] - exact[k]) < 1e-12 for k in set(have) & set(exact))
    hot = sorted((r["rank"], r["vec_id"]) for r in got if r.query_id == 150)
    assert hot == [(n + 1, 100 + n) for n in range(5)]  # ties to the smaller id
    for q in {r.query_id for r in got}:
        mine = sorted((r["rank"], -r.score, r["vec_id"]) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r["vec_id"]) for r in ann.search(df).collect()} == {(0, 50), (0, 3), (50, 0), (50, 3)}
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 0")).count() == 0


def test_queries_in_tiny_leaves_have_all_their_neighbours(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.eye(12)[[0]] * 50 + 0.01 * rng.normal(size=(3000, 12)), 50 * np.eye(12)[1:12] + 0.01 * rng.normal(size=(11, 12))])
    ids = [*range(1, 3001), *(5000 + 50 * n for n in range(11))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = ann.search(df).groupBy("query_id").count().collect()
    assert len(got) == 71 and {r["count"] for r in got} == {5}
    assert ann.visits(ann.build(ann.unit(x), 100), ann.unit(x)[-1], 1, [1] * 100, 6)[5:]


def test_tree_leads_every_vector_to_its_leaf():
    x = ann.unit(np.random.default_rng(0).normal(size=(2000, 8)))
    tree = ann.build(x, 50)
    assert tree.leaves > 20 and sorted(ann.visits(tree, x[0], tree.leaves)) == list(range(tree.leaves))
    assert set(ann.leaves_of(tree, x)) == set(range(tree.leaves))
