import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from quadrille.llm import arrays, quality
from quadrille.llm.jaccard import JaccardJoin

text = st.text(st.sampled_from("ab AB\t\n\x0b\r.,#é  "), max_size=40)
texts = st.lists(st.one_of(st.none(), text), max_size=8)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(texts, st.integers(1, 60))
def test_words_of_whole_texts(values, size):
    for kind in (pa.string(), pa.large_string()):
        found = [[] for _ in values]
        for row, _, data, offsets in arrays.chunks(pa.array(values, kind), size):
            for a, b, d in zip(*arrays.words(data, offsets), strict=True):
                found[row + d].append(data[a:b].tobytes().decode())
        assert found == [WORD.findall(v or "") for v in values]


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


@given(texts, st.integers(1, 5))
def test_shingle_sets(values, width):
    join, sets = JaccardJoin(width, 80), {}
    for row, end, data, offsets in arrays.chunks(pa.array(values, pa.string()), 16):
        docs, hashes = join.sets(data, offsets)
        for i in range(end - row):
            sets[row + i] = set(hashes[docs == i].tolist())
    brute = []
    for v in values:
        w = WORD.findall(lower(v or ""))
        brute.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    for i, a in enumerate(brute):
        assert len(sets[i]) == len(a)
        for j, b in enumerate(brute):
            assert len(sets[i] & sets[j]) == len(a & b)


def figures(v):
    w = WORD.findall(v)
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in v.split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", v)), len(lines) - len(set(lines)), len(covered)]


@given(texts)
def test_base_figures(values):
    for row, end, data, offsets in arrays.chunks(pa.array(values, pa.string()), 30):
        m = quality.measure(data, offsets)
        for i in range(row, end):
            assert [int(getattr(m, f)[i - row]) for f in quality.FIGURES] == figures(values[i] or "")


def test_span_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abc xx abc ABC", np.uint8)
    starts, ends, _ = arrays.words(data, np.array([0, len(data)]))
    low, exact = arrays.span_hashes(data, starts, ends), arrays.span_hashes(data, starts, ends, lower=False)
    assert low[0] == low[2] == low[3] != low[1] and exact[0] == exact[2] != exact[3]
