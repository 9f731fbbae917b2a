import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm.components import components
from quadrille.llm.jaccard import JaccardJoin, _hot, near_components, profiles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, join):
    """Smallest id of each document's component, by comparing all pairs."""
    sets = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        sets.setdefault(i, None)
        if sets[i] is None and (t is not None or all(x[1] is None for x in rows if x[0] == i)):
            sets[i] = shingles(t, join.width)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= join.percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near(base, edits, rng, vocabulary):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary) + str(rng.randrange(10**6))
    return out


def corpus(seed):
    """Unrelated texts, groups of near copies with up to six edits, exact copies, a shared passage, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    new = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for _ in range(60):
        rows.append(" ".join(new(rng.randrange(4, 120))))
    for size in (60, 15, 5):
        base = new(130)
        for _ in range(size):
            rows.append(" ".join(near(base, rng.randrange(0, 7), rng, vocabulary)))
        if size == 15:  # edits at the same few places
            rows += [" ".join(base[:7] + [f"v{k}"] + base[8:60] + [f"u{k % 2}"] + base[61:]) for k in range(20)]
    for _ in range(40):
        rows.append(" ".join(passage + new(rng.randrange(0, 30))))
    rows += rng.sample(rows, 30)
    rows += ["a b", "A  b", "a", "", " \n", None, "a b c", "x y z v", "X y\tz v"]
    rng.shuffle(rows)
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85), (4, 2, 60)])
def test_components_match_brute_force(spark, seed, width, percent):
    join, rows = JaccardJoin(width, percent), corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs, join).collect()}
    assert got == brute(rows, join)


@pytest.mark.parametrize("hot", [4, 12])
def test_frequent_shingles_match_brute_force(spark, hot):
    """Shingles that many documents hold are dealt by document: a passage in all texts, and large groups of copies."""
    rows, join = corpus(5), JaccardJoin(4, 85)
    rows = [(i, t and f"{t} {' '.join(f'p{k}' for k in range(12))}") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    counted = profiles(docs, join)
    hashes, levels = _hot(counted, hot)
    held = Counter(s for _, x in rows for s in shingles(x, 4))
    assert len(levels) == len(hashes) <= sum(c >= hot for c in held.values()) and len(hashes) >= 9
    assert levels.max() <= round(4 * math.log2(max(held.values()))) and (hashes[1:] > hashes[:-1]).all()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs, join, hot).collect()}
    assert got == brute(rows, join)


def test_odd_rows(spark):
    join = JaccardJoin(4, 85)
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "q r s t"), (3, "b z z z"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in near_components(docs, join).collect())))
    assert got == sorted(map(str, [(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, None), (None, 0, None), (3, 1, 3), (3, 1, 3), (4, 0, 4)]))
    assert near_components(docs.limit(0), join).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """Every text of an id is compared, and an id's texts are one document."""
    a, b = "a b c d e f g", "p q r s t u v"
    rows = [(1, a), (1, b), (2, b), (3, a), (4, "k l m n o"), (5, None), (5, "k l m n o"), (6, ""), (None, a)]
    got = [tuple(r) for r in near_components(spark.createDataFrame(rows, "doc_id long, text string"), JaccardJoin(4, 85)).collect()]
    want = [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 2, 4), (5, 0, 4), (5, 2, 4), (6, 0, 6), (None, 4, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_repeated_ids_match_brute_force(spark):
    rng, join, rows = random.Random(9), JaccardJoin(4, 85), corpus(9)
    rows = [(i % 60 if rng.random() < 0.3 else i, t) for i, t in rows]
    sets = [(i, shingles(t, 4)) for i, t in rows]
    links = [(i, j) for n, (i, x) in enumerate(sets) for j, y in sets[:n] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(root[i], root[j])
            changed |= root[i] != root[j]
            root[i] = root[j] = least
    got = sorted(tuple(r) for r in near_components(spark.createDataFrame(rows, "doc_id long, text string"), join).collect())
    assert len({i for i, _ in rows}) < len(rows) and got == sorted((i, len(x), root[i]) for i, x in sets)


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=8, deadline=None)
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    root = {}
    for a, b in links:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
