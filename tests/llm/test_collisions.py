"""Words and texts that a polynomial hash takes for one another; hashes that do collide."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadrille.llm import arrays, jaccard, quality, tokenfiles

SIZES = [512, 1024, 2048, 8192]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def twins(n):
    one = thue_morse(n)
    return one, one.translate(str.maketrans("ab", "ba"))


def hashes(words, **more):
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return arrays.span_hashes(data, ends - [len(w.encode()) for w in words], ends, **more)


@pytest.mark.parametrize("lower", [True, False])
@pytest.mark.parametrize("n", SIZES)
def test_twins_hash_apart(n, lower):
    a, b = hashes(twins(n), lower=lower)
    assert a != b


@given(st.lists(st.text("abAB\u00e9", max_size=70), min_size=1, max_size=20), st.integers(0, 2**64 - 1))
def test_hashes_tell_bytes(words, key):
    for lower in (True, False):
        h = hashes(words, lower=lower, key=key)
        shown = [re.sub("[A-Z]", lambda m: m[0].lower(), w) if lower else w for w in words]
        for i, a in enumerate(shown):
            for j, b in enumerate(shown):
                assert (h[i] == h[j]) == (a == b)
    assert (hashes(words, key=key) != hashes(words, key=key ^ 1)).all()


@given(st.lists(st.tuples(st.text("ab", max_size=70), st.text("ab", max_size=70)), min_size=1, max_size=20))
def test_same_bytes(pairs):
    sides = []
    for k in (0, 1):
        sizes = np.array([len(p[k]) for p in pairs])
        sides += [np.frombuffer("".join(p[k] for p in pairs).encode(), np.uint8), np.cumsum(sizes) - sizes, sizes]
    assert arrays.same_bytes(*sides[:2], sides[2], *sides[3:]).tolist() == [a == b for a, b in pairs]


@pytest.mark.parametrize("n", SIZES)
def test_token_ids_of_twins(n):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [f"x {w}" for w in twins(n)]
    ids, counts = tokenfiles.array_encoder(path, 2).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_token_ids_where_every_hash_collides(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(tokenfiles, "span_hashes", lambda data, starts, ends, lower: np.zeros(len(starts), np.uint64))
    own = tokenfiles.ArrayEncoder(tokenfiles.encoder(path, 2))
    texts = ["one two", "two one\none", "", "three", "one two", "x" * 50 + " " + "x" * 49 + "y"]
    for _ in range(2):
        ids, counts = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_no_link_between_twins(spark):
    rows = [(2 * i + j, f"p q r {w}") for i, n in enumerate(SIZES) for j, w in enumerate(twins(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_components(docs, jaccard.JaccardJoin(4, 85)).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in found) and len(found) == len(rows)


def test_twins_are_no_repeated_words():
    a, b = twins(1024)
    data = np.frombuffer(f"{a} {a} {a} x {b} {b} {b}".encode(), np.uint8)
    assert quality.measure(data, np.array([0, len(data)])).n_repeat_words.tolist() == [0]
