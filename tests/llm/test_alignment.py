import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quadrille.llm import alignment, registry
from quadrille.llm.alignment import Alignment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Whole texts through both libraries, then sets of ends."""
    a, b = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        full = " " + (text or "")
        ids = (a.encode(full, add_special_tokens=False).ids, b.encode(text or ""))
        spelt = [[bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if not text or any(b"".join(s) != full.encode() for s in spelt):
            docs.append((doc_id, None, None, None))
            continue
        ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] for s in spelt]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for cut in cuts:
            new = [ends[s].index(cut) + 1 for s in (0, 1)]
            groups.append([ids[s][at[s] : new[s]] for s in (0, 1)])
            at = new
        links = [(g[0][-1], g[1][-1]) for g in groups]
        counts.update(links)
        docs.append((doc_id, ids, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, ids, groups, links in docs:
        if not ids:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc_id, len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.collect())


ODD = ["", None, " ", "  two  spaces ", "a\n b", "a \nb", "tab\tand  \n\n  more x 　y", "it's <|endoftext|> here's </s> <s>", "piece▁of text", "▁", "ünï cödé 日本語 テキスト 😀 x😀 ", "x" * 3000, "a " * 500, "0 1 22 333 4444", "﻿bom ​zero ‍", "é é", "\x00 \x01", " lead", "trail ", "don't  'tis 'S"]


def test_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(None, "a b c"), (3, "a b c"), (3, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("x"), "unit": F.lit(1), "n": F.lit(2)})
    assert got(Alignment(docs, *FILES).documents()) == brute(rows)


def test_whole_texts_as_units(spark):
    rows = list(enumerate(ODD))
    assert got(Alignment(spark.createDataFrame(rows, "doc_id long, text string"), *FILES, cut=False).documents()) == brute(rows)


def test_blocks_and_shuffled_pairs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 2000)
    monkeypatch.setattr(alignment, "PAIRS", 0)
    rng = random.Random(5)
    pieces = ["the", "of", "Wort", "mots,", "  ", "\n", "été", "...", "123", "<0x41>", "naïve-ish", "\t", "日本", "Ünder", "it's", "http://x.y/z?q=1"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(60)))) for i in range(150)]
    assert got(Alignment(spark.createDataFrame(rows, "doc_id long, text string"), *FILES).documents()) == brute(rows)


def test_units_that_are_not_spelt(spark, monkeypatch):
    """Should a unit inside a text not be spelt, whole texts are the units."""
    rows = [(1, "one two"), (2, "one"), (3, "three"), (4, "one piece▁of")]
    monkeypatch.setattr(alignment, "_units", lambda text, cut: F.split(text, alignment.CUT) if cut else F.array(text))
    found = Alignment(spark.createDataFrame(rows, "doc_id long, text string"), *FILES)
    assert not found.cut
    assert got(found.documents()) == brute(rows)


def test_block_units_are_settled_before_texts_move(spark):
    """The last step moves texts and settled units alone: no join's files lie beside them."""
    rows = list(enumerate(ODD))
    found = Alignment(spark.createDataFrame(rows, "doc_id long, text string"), *FILES)
    documents = found.documents()
    assert "Join" not in documents._jdf.queryExecution().executedPlan().toString()
    assert got(documents) == got(found.documents()) == brute(rows)


@pytest.mark.parametrize("shapes", [0, 1 << 20])
def test_units_move_packed(spark, monkeypatch, shapes):
    """A block gets many units in a row, not a row for each; shapes that units share are joined by shuffle or broadcast."""
    monkeypatch.setattr(alignment, "BLOCK", 4000)
    monkeypatch.setattr(alignment, "PACKED", 100)
    monkeypatch.setattr(alignment, "SHAPES", shapes)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(40))) for i in range(100)] + list(enumerate(ODD))
    found = Alignment(spark.createDataFrame(rows, "doc_id long, text string"), *FILES)
    assert got(found.documents()) == brute(rows)
    assert "groups" not in found.known.columns
    assert found.known.count() < sum(len(set(t.split(" "))) for _, t in rows[:100]) / 4


def test_empty_table(spark):
    assert Alignment(spark.createDataFrame([], "doc_id long, text string"), *FILES).documents().collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = registry.queries()["op12_token_alignment"](spark, f"/root/testdata/{sf}")
    assert found.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert got(found) == brute(rows)
