import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quadrille.llm import registry
from quadrille.llm.repair import INSERTS, Repair, code, ending, fault_of, product, replayed, times, turn_matrix

SPACE = " \t\n\v\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(turns):
    """(cost, audit) by search over (turns read, state): turns are (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(turns) and state in ("", "a"):
            return cost, audit
        for r in "ua":
            if (state, r) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, r]))
        if i < len(turns):
            initial, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault != 2:
                if (state, initial) in NEXT:
                    heapq.heappush(heap, (cost + fault, audit + "K", i + 1, NEXT[state, initial]))
                for r in "ua":
                    if (state, r) in NEXT:
                        heapq.heappush(heap, (cost + 2 + fault, audit + "R", i + 1, NEXT[state, r]))


@pytest.mark.parametrize("seed", range(300))
def test_product_matches_search(seed):
    rng = random.Random(seed)
    turns = [(rng.choice("suaaut"), rng.choice((0, 0, 0, 1, 2))) for _ in range(rng.randrange(12))]
    codes = "".join(code(i, f) for i, f in turns)
    whole = times(product(codes), INSERTS) if codes else INSERTS
    assert ending(whole)[1:] == cheapest(turns)
    for cut in range(1, len(codes)):
        assert times(product(codes[:cut]), product(codes[cut:])) == product(codes)


def test_every_letter_has_all_deletions():
    for letter in ("s", "U", "a", "o", "X"):
        assert turn_matrix(letter)[0][0] == (3, "D")


def brute(rows, ids):
    """Rows are (conv_id, turn, role, text) with nulls."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        convs[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv in {*convs, *ids}:
        own, seen, turns, counts, illegal = sorted(convs[conv]), set(), [], [0, 0, 0], 0
        for at, (_, _, role, _, text) in enumerate(own):
            fault, which = fault_of(text, (role, text) in seen)
            seen.add((role, text))
            turns.append((role[:1], fault))
            counts[which] += which >= 0
            illegal += at > 0 and own[at - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = cheapest(turns)
        numbers = {t for is_, t, *_ in own if is_}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        text = "\n".join(f"{r}:{t}" for _, r, t in replayed([(o[2], o[4]) for o in own], audit) if r is not None)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


@pytest.fixture
def many_partitions(spark):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("false", "40"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def made(seed, sizes):
    rng, rows = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            said = rng.choice(("Yes.", "no", " ", "", None, "What?", f"turn {turn}.", f"turn {turn}", "x" * 50 + "!", "ü  "))
            rows.append((conv - 1 if conv else None, rng.choice((turn, turn, turn, turn // 2, None)), rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)), said))
    return rows + rows[:7]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_conversations_over_many_partitions(spark, many_partitions):
    rows = made(1, [5, 1500, 1, 0, *([4] * 60)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"conv": F.lit(1), "text2": F.lit(0), "n": F.lit("x"), "mark": F.lit(None)})
    ids = [(r[0],) for r in rows] + [(777,)]
    repair = Repair(df, spark.createDataFrame(ids, "conv_id long"))
    expected = brute(rows, {i for (i,) in ids})
    assert got(repair.summary()) == expected
    assert repair.parts.filter("conv = '0'").count() > 32
    turns = repair.turns().filter("conv_id = 0").orderBy("part", "pos").collect()
    audit = expected[0][6]
    assert sorted(t.edit for t in turns) == sorted(audit)
    assert sum(t.role is None for t in turns) == audit.count("D")


@pytest.mark.parametrize("seed", range(3))
def test_small_tables(spark, seed):
    rows = made(seed, [3, 2, 9, 0, 1, 6, 40])
    assert got(Repair(spark.createDataFrame(rows, SCHEMA)).summary()) == brute(rows, set())


def test_copies_of_one_row(spark, many_partitions):
    rows = [(1, 1, "user", "Hello.")] * 400 + [(1, 2, "assistant", "Yes.")] * 3 + [(2, None, None, None)] * 5 + [(1, 9, "user", "Hello.")] * 20
    assert got(Repair(spark.createDataFrame(rows, SCHEMA).repartition(7)).summary()) == brute(rows, set())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert Repair(none).summary().collect() == []
    assert got(Repair(none, spark.createDataFrame([(4,), (None,)], "conv_id long")).summary()) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (4, None)}


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = registry.queries()["op13_conversation_repair"](spark, "/root/testdata/sf0.01")
    assert found.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert got(found) == brute(damaged, {r[0] for r in rows})
