"""The registered queries on the smallest tables: against SQL, plain Python or their own contract."""

import random
import zlib
from collections import Counter
from decimal import Decimal

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from quadrille.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, tables, name):
    ours = registry.queries()[name](spark, SF)
    theirs = tables.execute(registry.oracle_sql()[name])
    columns, other = sorted(ours.columns), [d[0] for d in theirs.description]
    assert columns == sorted(other)
    left = Counter(str([r[c] for c in columns]) for r in ours.collect())
    assert left == Counter(str([r[other.index(c)] for c in columns]) for r in theirs.fetchall())


CONTRACTS = {
    1: "doc_id n_tokens ids_sha256 decoded_sha256",
    2: "doc_id held_out score predicted",
    3: "doc_id n_shingles component_id",
    4: "doc_id item_id",
    5: "doc_id held_out lang_pred score",
    6: "page_id host path rule verdict",
    7: "page_id url text n_chars",
    8: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    9: "pair_id chosen_id rejected_id n_common prompt chosen rejected",
    10: "doc_id start n_tokens ids_crc32",
    11: "doc_id keep_id group_size kept text_sha256",
    12: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    13: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


@pytest.mark.parametrize("n", CONTRACTS)
def test_columns_and_rows(spark, tables, n):
    name = next(k for k in registry.queries() if k.startswith(f"op{n}_"))
    df = registry.queries()[name](spark, SF)
    wanted = CONTRACTS[n].split()
    assert df.columns[: len(wanted)] == wanted
    if n in (4, 9):
        return
    table = "pages" if n in (6, 7) else "(SELECT DISTINCT conv_id FROM conversations)" if n == 13 else "documents"
    assert df.count() == tables.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


def test_components_match_brute_force(spark, tables):
    from tests.llm.test_jaccard import brute
    from quadrille.llm.queries.op3 import JOIN

    rows = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op3_ngram_jaccard"](spark, SF).collect()}
    assert got == brute(rows, JOIN)


def test_leaks_match_plain_search(spark, tables):
    from quadrille.llm.decontaminate import folded

    items = tables.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    plain = {(d, i) for d, t in docs for i, x in items if folded(x) in folded(t)}
    got = {(r.doc_id, r.item_id) for r in registry.queries()["op4_decontamination"](spark, SF).collect()}
    assert plain and plain <= got


def test_pipeline_keeps_what_its_stages_keep(spark, tables):
    """Each stage's rows, worked out from the operators' own results on the stage's input."""
    rows = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), docs.schema)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert rows == {r.doc_id: [*sp.encode(r.text), 2] for r in docs.collect()}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _small_tables(spark, folder, docs, labels, benchmark):
    for name, rows, schema in (("documents", docs, DOCUMENTS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    """Without labels nothing is learned, so only the base rules, copies and items reject; nulls reject nothing by themselves."""
    words = [f"w{i}" for i in range(80)]
    one, other = " ".join(words), " ".join(reversed(words))
    item = " ".join(f"item{i}" for i in range(20))
    docs = [(1, one, "en", "s", 1), (2, one, None, None, None), (3, f"{other} {item}", "en", "s", 1), (4, other, "en", "s", 1), (5, None, "en", "s", 1), (6, "", "en", "s", 1), (None, one[::-1], None, "s", 1)]
    odd = _small_tables(spark, f"file://{tmp_path}/odd", docs, [(None, None, None), (1, None, None), (None, 1, 1)], [(1, item), (None, None)])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, odd).collect()) == ["1", "4", "None"]
    none = _small_tables(spark, f"file://{tmp_path}/none", [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Copies by compared shingle sets, items by plain search, ids by the library; labels reject by one word each."""
    import random

    from tests.llm.test_jaccard import brute

    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("ka ro ti mu sel nor".split()) for _ in range(3)) for _ in range(n))
    item, docs, labels = " ".join(f"item{i}" for i in range(12)), [], []
    for i in range(400):
        text, low, toxic = prose(70), rng.random() < 0.3, rng.random() < 0.3
        if low:
            text = " ".join(w + "###" for w in text.split())
        if toxic:
            text = f"idiot {text} moron idiot"
        if rng.random() < 0.2:
            text = f"{text} {item}"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not low), int(toxic)))
    for i in range(400, 430):
        docs.append((i, f"{docs[i - 400][1]} again", "en", "s", 1))
    folder = _small_tables(spark, f"file://{tmp_path}/made", docs, labels, [(1, item)])
    good = [d for d in docs if "###" not in d[1] and "idiot" not in d[1]]
    found = brute([d[:2] for d in good], corpus_pipeline.NEAR)
    kept = {d[0]: d[1] for d in good if found[d[0]][1] == d[0] and item not in d[1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()} == {i: [*sp.encode(t), 2] for i, t in kept.items()}


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)"])
def test_pipeline_with_other_ids(spark, tmp_path, kind):
    """Ids that don't fit a long: each stage keeps rows as for numbers, with the ids as they are."""
    rng, words = random.Random(6), [a + b + c for a in "klmn" for b in "aeiou" for c in "rstv"]
    new = (lambda i: f"doc-{i:03d}") if kind == "string" else (lambda i: Decimal(2**63 + i))
    docs, labels = [], []
    for i in range(160):
        toxic = rng.random() < 0.4
        text = " ".join(["idiot moron"] * toxic + rng.choices(words, k=70))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(i, f"{docs[i - 160][1]} again", "en", "s", 1) for i in range(160, 180)]
    made = _small_tables(spark, f"file://{tmp_path}/made", docs, labels, [(1, "no such item anywhere here")])
    schema = DOCUMENTS.replace("doc_id long", f"doc_id {kind}")
    spark.createDataFrame([(new(i), *rest) for i, *rest in docs], schema).write.parquet(f"file://{tmp_path}/other/documents.parquet")
    spark.createDataFrame([(new(i), *rest) for i, *rest in labels], f"doc_id {kind}, quality int, toxic int").write.parquet(f"file://{tmp_path}/other/labels.parquet")
    spark.read.parquet(f"{made}/benchmark.parquet").write.parquet(f"file://{tmp_path}/other/benchmark.parquet")
    clean = {i: text for i, text, *_ in docs[:160] if "idiot" not in text}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {i: [*sp.encode(t), 2] for i, t in clean.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, made).collect()} == expected
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, f"file://{tmp_path}/other").collect()} == {new(i): ids for i, ids in expected.items()}


def test_one_document_of_each_group(spark):
    words = [f"w{i}" for i in range(60)]
    texts = {5: " ".join(words), 3: " ".join([*words[:-1], "x"]), 9: " ".join(reversed(words)), 7: " ".join(words), None: " ".join(words)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs.union(docs), SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "9", "None", "None"]


def test_texts_under_one_id_are_compared(spark):
    words = [f"w{i}" for i in range(60)]
    one, other, third = " ".join(words), " ".join(reversed(words)), " ".join(words[::2] + words[1::2])
    near = " ".join([*words[:-1], "x"])
    texts = [(5, one), (5, other), (5, one), (3, near), (8, other), (8, third), (9, ""), (9, ""), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(3, near), (5, other), (8, third), (9, ""), (10, "")])


def test_held_out_flag(spark):
    for n, name in ((2, "op2_toxicity"), (5, "op5_language_id")):
        for r in registry.queries()[name](spark, SF).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2), n
