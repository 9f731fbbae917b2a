import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm.decontaminate import Matcher, Myers, find_items, folded, item_count, pieces

short = st.text(st.sampled_from("abc "), min_size=1, max_size=90)


def least(pattern, text):
    """(distance, first end) of the best substring, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row), row.index(min(row))


@given(short, st.text(st.sampled_from("abc "), max_size=90))
def test_myers(pattern, text):
    assert Myers.of(pattern).best(text) == least(pattern, text)


@given(short, st.floats(0, 0.5))
def test_pieces_tile(item, rate):
    k, parts = pieces(item, rate)
    assert len(parts) == k + 1 and "".join(p for _, p in parts) == item and all(p for _, p in parts)


@given(st.lists(st.text(st.sampled_from("abcd "), max_size=40), min_size=1, max_size=3), st.text(st.sampled_from("abcd "), max_size=200), st.sampled_from([0.0, 0.1, 0.25]))
@settings(max_examples=150)
def test_no_hit_is_lost(items, text, rate):
    m = Matcher(list(enumerate(items)), rate)
    got = {m.items[i][0]: edits for i, edits, _, _ in m.hits(folded(text))}
    want = {}
    for i, item in enumerate(items):
        p = folded(item)
        if p and folded(text) and (d := least(p, folded(text))[0]) <= int(rate * len(p) + 1e-9):
            want[i] = d
    assert got == want


def test_operator(spark):
    rng = random.Random(3)
    item = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))
    near = item.replace("gamma", "gamna", 3).upper()
    rows = [(1, f"before {item} after"), (2, f"before\n{near.replace(' ', '  ')}\tafter"), (3, "clean text"), (4, None), (5, ""), (None, item), (1, f"before {item} after"), (6, item[: len(item) // 2])]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, None), (9, " "), (10, "clean text")], "item_id long, text string")
    found = find_items(docs, items)
    got = sorted((str(r.doc_id), r.item_id, r.n_edits) for r in found.collect())
    assert got == sorted([("1", 7, 0), ("1", 7, 0), ("2", 7, 3), ("None", 7, 0), ("3", 10, 0)])
    texts = dict(rows)
    for r in found.filter("doc_id IN (1, 3)").collect():
        assert texts[r.doc_id][r.begin : r.end] in (item, "clean text")
    two = found.filter("doc_id = 2").first()
    assert folded(texts[2][two.begin : two.end]) == folded(near)
    counts = [r[0] for r in docs.select(item_count(docs["text"], items)).collect()]
    assert counts == [1, 1, 1, 0, 0, 1, 1, 0]
    assert find_items(docs.limit(0), items).count() == 0 and find_items(docs, items.limit(0)).count() == 0


def test_registered_query_finds_edited_passages(spark, tmp_path):
    """The query's own rows against the cell-by-cell distance, passages edited within and beyond the budget."""
    from quadrille.llm.queries import op4

    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(["north", "river", "stone", "amber", "quiet", "seven"]) for _ in range(rng.randrange(6, 14)))) for i in range(4)]
    docs = []
    for i in range(60):
        raw = list(items[i % 4][1])
        for _ in range(rng.randrange(0, len(raw) // 6)):
            at = rng.randrange(len(raw))
            raw[at : at + 1] = rng.choice([[], ["x"], [raw[at], "y"]])
        docs.append((i, f"{'Lead ' * (i % 3)}{''.join(raw).upper() if i % 5 == 0 else ''.join(raw)} tail"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.n_edits for r in op4.query(spark, f"file://{tmp_path}").collect()}
    want = {(d, i): e for d, t in docs for i, x in items if (e := least(folded(x), folded(t))[0]) <= int(0.1 * len(folded(x)) + 1e-9)}
    assert got == want and 10 < len(want) < 60


def test_ties_and_long_texts():
    item = "one two three four five"
    m = Matcher([(1, item), (2, item)], 0.1)
    text = folded(f"{'pad ' * 50_000}{item} {item} {'pad ' * 50_000}")
    assert [(i, e, text[a:b]) for i, e, a, b in sorted(m.hits(text))] == [(0, 0, item), (1, 0, item)]
    assert {a for _, _, a, _ in m.hits(text)} == {text.index(item)}  # the first of equals


def test_one_long_lower_case_leaves_the_rest_folded():
    assert {chr(c) for c in range(0x110000) if len(chr(c).lower()) != 1} == {"İ"}
    item = "съешь же ещё этих мягких французских булок да выпей чаю"
    for text in (f"İzmir. {item.upper()}.", f"{item.upper()}"):
        (hit,) = Matcher([(1, item)], 0.1).hits(folded(text))
        assert hit[1] == 0
        assert len(folded(text)) == len(text)
    assert folded("İZMİR ΔΣ") == "izmir δσ"
    (hit,) = Matcher([(1, f"İ {item.upper()}")], 0.1).hits(folded(f"i {item}"))
    assert hit[1] == 0


@pytest.mark.parametrize("item, text", [("ΟΔΟΣ", "ΟΔΟΣΑ"), ("ΑΣ", "ΑΣΒ"), ("ΟΔΟΣ ΜΟΥ", "η οδοσ μου")])
def test_folding_does_not_depend_on_what_follows(item, text):
    (hit,) = Matcher([(1, item)], 0.1).hits(folded(text))
    assert hit[1] == 0


def test_templated_items_take_little_time():
    """Items that share most of their pieces, all of them in the text."""
    items = [(i, f"question number {i} asks about the thing {7 * i} of the world") for i in range(400)]
    text = folded(" ".join(t for _, t in items) * 3)
    m = Matcher(items, 0.1)
    began = time.process_time()
    found = m.hits(text)
    assert time.process_time() - began < 3
    assert sorted(i for i, *_ in found) == list(range(400)) and all(e == 0 and text[a:b] == items[i][1] for i, e, a, b in found)


def test_items_without_a_budget():
    """Under ten characters nothing but the item itself matches."""
    m = Matcher([(1, "short one"), (2, "x")], 0.1)
    assert [(i, e) for i, e, *_ in sorted(m.hits(folded("a short one, and Short Ones; x-ray")))] == [(0, 0), (1, 0)]
    assert m.hits(folded("a shart one")) == []
