import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quadrille.llm.recipes import Chunking, exact_groups, normalised

SMALL = Chunking(4, 24, 3, ((1,),))


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append((doc_id is None, doc_id or 0, i))
    out = []
    for text, members in groups.items():
        keep = None if min(members)[0] else min(members)[1]
        for none, doc_id, i in members:
            out.append((None if none else doc_id, keep, len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def same(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_groups(docs.withColumns({"row": F.lit(1), "recipe": F.lit("x"), "key": F.lit(2)}), **how).collect()
    expected, n_groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
    assert sum(r.kept for r in got) == n_groups
    for r in got:
        assert not r.kept or r.doc_id == r.keep_id
    return got


LONG = " ".join(f"word{zlib.crc32(b'%d' % i) % 100_003}" for i in range(40_000))
ROWS = [
    (5, "one  two\n three"), (3, "one two three"), (9, "one\ttwo\x0bthree"), (4, "one two  thre"), (None, "one two three"),
    (1, None), (2, ""), (6, " "), (7, "\n\n"), (8, LONG), (10, LONG.replace(" ", "\n")), (11, LONG + "x"), (12, "x" + LONG),
    (13, "Привет,  мир \u2003 конец"), (14, "Привет, мир \u2003 конец"), (15, "Привет, мир конец"), (3, "one two three"), (3, "other"), (None, "alone"), (None, "alone"),
]


def test_equal_texts(spark):
    same(spark, ROWS)


def test_small_chunks(spark):
    assert max(r.n_chunks for r in same(spark, ROWS, chunking=SMALL)) > 10_000


@pytest.mark.parametrize("hashed", [lambda c: F.lit(0).cast("long"), lambda c: F.length(c).cast("long"), lambda c: F.xxhash64(c) % 7])
def test_hashes_that_clash(spark, hashed):
    """Contents decide, whatever the hash."""
    same(spark, [r for r in ROWS if r[0] not in (8, 10, 11, 12)] + [(20 + i, f"text {i % 11} of some words that go on") for i in range(40)], chunking=SMALL, hashed=hashed)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cuts_follow_contents(spark):
    """Text in front moves no cut beyond the next few; chunks tile the text."""
    df = spark.createDataFrame([(LONG,), ("new words in front " + LONG,)], "text string")
    got = [r.c for r in df.select(F.regexp_extract_all(normalised(F.col("text")), F.lit(Chunking().pattern()), F.lit(0)).alias("c")).collect()]
    assert ["".join(c) for c in got] == [LONG, "new words in front " + LONG]
    assert len(set(got[0]) & set(got[1])) > 0.8 * len(got[0])
    assert all(Chunking.most >= len(c) for cs in got for c in cs)
