"""The trained operators: held-out accuracy on made texts, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from quadrille.llm import langid, quality, toxicity
from quadrille.llm.learning import Sparse, calibrated, held_out, logistic, sigmoid
from pyspark.sql import functions as F

SYLLABLES = {"xx": "ka ro ti mu sel nor".split(), "yy": "öl üb ach sch ein wir".split(), "zz": "que tion éo aux oir vel".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """(docs, labels, truth): three languages; toxic words; symbol-ridden low quality."""
    rng = random.Random(11)
    docs, labels, truth = [], [], {}
    for i in range(900):
        lang = rng.choice(list(SYLLABLES))
        words = prose(rng, lang, rng.randrange(60, 160)).split()
        low, toxic = rng.random() < 0.2, rng.random() < 0.2
        if low:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "grubble", "grubbling"]))
        docs.append((i, " ".join(words), lang, 1, 0.5))
        labels.append((i, int(not low), int(toxic)))
        truth[i] = (lang, low, toxic)
    odd = [(1001, None, None, 1, 0.5), (1002, "", "xx", 1, 0.5), (1003, " 12 !! ", None, 1, 0.5), (None, "ka ro ti", None, 1, 0.5), (1004, "karo " * 40_000, None, 1, 0.5), (0, docs[0][1], docs[0][2], 1, 0.5)]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, n_words int, score double")
    marks = spark.createDataFrame([*labels, (1001, 1, 0), (1002, None, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    return frame, marks, truth


def test_folds(spark):
    ids = [0, 1, 7, 123456, None, -4]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out(F.col("doc_id"))).collect()]
    assert got == [zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i in ids]


def test_language(corpus):
    docs, _, truth = corpus
    model = langid.learn(docs, ~held_out(F.col("doc_id")), 60)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == 906
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.98
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by[1001] == by[1002] == by[1003] == ("und", 0) and by[None][0] == by[1004][0] == "xx"
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = langid.learn(docs, F.lit(False))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_presence_kernel_matches_sets():
    import pyarrow as pa

    texts = ["abcab", "Abc é", "", "zzz"]
    sets = []
    for t in texts:
        raw = t.lower().encode() if t.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
        sets.append({raw[i : i + n] for n in langid.LENGTHS for i in range(len(raw) - n + 1)})
    x = next(langid.presences(pa.array(texts)))[2]
    assert (x @ x.T).astype(int).tolist() == [[len(a & b) for b in sets] for a in sets]


def test_toxicity(corpus):
    docs, labels, truth = corpus
    model = toxicity.learn(docs, labels, ~held_out(F.col("doc_id")), 400)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 906 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.predicted == truth[r.doc_id][2] for r in held]) > 0.97
    assert all(r.predicted == 0 for r in rows if r.doc_id in (1001, 1002, 1003, 1004))
    flags = [r[0] for r in docs.select(toxicity.is_toxic(docs["text"], model)).collect()]
    assert sorted(flags) == sorted(bool(r.predicted) for r in rows)
    assert toxicity.learn(docs, labels.filter("toxic = 1"), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0} and toxicity.score(docs.limit(0), model).count() == 0


def hosts(rng, n, toxic):
    """Words that hold the stem `karo`, which clean texts hold by chance, more often than chance if toxic."""
    words = prose(rng, "xx", n).split()
    for _ in range(rng.randrange(3, 7) if toxic else 0):
        words.insert(rng.randrange(len(words)), "tiselmu" + rng.choice(["", "mu", "sel", "nor", "ro"]))
    return " ".join(words)


def test_toxicity_does_not_grow_with_length(spark):
    """Stems that clean texts hold by chance; joined clean texts stay clean."""
    rng = random.Random(5)
    marks = [(i, int(rng.random() < 0.25)) for i in range(1200)]
    texts = {i: hosts(rng, rng.randrange(40, 120), t) for i, t in marks}
    docs, labels = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, ~held_out(F.col("doc_id")))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], t) for i, t in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([s >= 0.3 for s, t in held if t]) > 0.85 and np.mean([s >= 0.3 for s, t in held if not t]) < 0.1
    clean = [texts[i] for i, t in marks if not t]
    for times in (5, 20, 50):
        joined = spark.createDataFrame([(" ".join(rng.sample(clean, times)),) for _ in range(60)], "text string")
        assert np.mean([r.predicted for r in toxicity.score(joined, model, ("text",)).collect()]) < 0.1


def test_toxicity_reads_signs_as_letters(corpus):
    docs, labels, _ = corpus
    model = toxicity.learn(docs, labels, F.lit(True))
    spark = docs.sparkSession
    rows = spark.createDataFrame([("ka ro ti 1d10t mu sel m0r0n nor ka",), ("ka ro ti 1990 mu 4 sel nor ka",), ("KA RO IDIOT TI MORON",)], "text string").coalesce(1)
    assert [r.predicted for r in toxicity.score(rows, model, ("text",)).collect()] == [1, 0, 1]


def test_features_match_plain_search():
    """Each feature's number of different words, worked out word by word."""
    import re

    import pyarrow as pa
    from quadrille.llm.arrays import chunks

    texts = ["Idiot idiots, an IDIOT! x", "", None, "d10t \u00c9t\u00e9 a", "pathetic pathetic"]
    for row, end, data, offsets in chunks(toxicity.lowered(pa.array(texts)), 12):
        got = {}
        for d, name, n in zip(*toxicity.read(data, offsets).counted(), strict=True):
            if int(name) < 1 << 62:
                got[row + int(d), int(name).to_bytes(8, "little").rstrip(b"\0")] = int(n)
        for i in range(row, end):
            raw = (texts[i] or "").lower()
            spoken = set(re.findall(r"\w+", raw)) | {w.replace("1", "i").replace("0", "o") for w in re.findall(r"\w+", raw) if re.search("[01]", w)}
            wanted = {}
            for w in spoken:
                b = f" {w} ".encode()
                for g in {b[k : k + n] for n in toxicity.GRAMS for k in range(len(b) - n + 1)}:
                    wanted[i, g] = wanted.get((i, g), 0) + 1
            assert {k: v for k, v in got.items() if k[0] == i} == wanted


def test_posterior_matches_brute_force():
    """The label model's posteriors, worked out vote by vote from its own rates."""
    rng = np.random.default_rng(3)
    y = rng.random(600) < 0.3
    votes = np.column_stack([rng.random(600) < np.where(y, a, b) for a, b in ((0.7, 0.1), (0.4, 0.02), (0.2, 0.3), (0.9, 0.05))])
    model = toxicity.fit_label_model(votes, np.ones(600), np.where(votes[:, 3], 0.9, 0.1), 0.3)
    for row, p in zip(votes[:50], model.posterior(votes)[:50], strict=True):
        odds = 0.3 / 0.7
        for j, v in enumerate(row):
            up, down = (model.rates[k][int(model.parents[j] >= 0 and row[model.parents[j]])][j] for k in (1, 0))
            odds *= up / down if v else ((1 - up) / (1 - down)) ** toxicity.SILENCE
        assert abs(p - odds / (1 + odds)) < 1e-9
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.85


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good, weak = rng.random(4000) < np.where(y, 0.6, 0.02), rng.random(4000) < np.where(y, 0.3, 0.15)
    votes = np.column_stack([good, good.copy(), weak, rng.random(4000) < np.where(y, 0.5, 0.05), ~(good | weak)])
    model = toxicity.fit_label_model(votes, np.ones(4000), np.where(votes[:, :4].sum(1) >= 2, 0.9, 0.1), 0.3)
    assert {(i, p) for i, p in enumerate(model.parents)} & {(1, 0), (0, 1)}  # a copied voter hangs on its original
    assert model.accuracies[3] > model.accuracies[2]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.8


def test_quality(corpus):
    docs, labels, truth = corpus
    model = quality.learn(docs, labels, quality.usable_labels(), 300)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 906
    held = [r for r in rows if r.doc_id in truth and not r.base_failed and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.kept != truth[r.doc_id][1] for r in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[1001].n_words == by[1002].n_words == 0 and by[1001].base_failed and not by[1001].kept
    assert by[1004].n_words == 40_000 == by[1004].n_repeat_words and by[1004].base_failed
    assert all(not (r.kept and r.base_failed) for r in rows)
    flags = [r[0] for r in docs.select(quality.passes(docs["text"], model)).collect()]
    assert sorted(flags) == sorted(r.kept for r in rows)
    odd = labels.withColumn("quality", F.when(F.col("doc_id") % 10 == 0, 2).when(F.col("doc_id") % 10 == 1, -1).otherwise(F.col("quality")))
    assert quality.learn(docs, odd, quality.usable_labels(), 300) is not None
    assert quality.learn(docs, labels.withColumn("quality", F.lit(7)), F.lit(True)) is None
    assert quality.learn(docs, labels.limit(0), F.lit(True)) is None and quality.score(docs.limit(0), model).count() == 0


def test_logistic_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < sigmoid(2 * x[:, 0] - x[:, 1] + 0.5)).astype(float)
    rows, columns = np.repeat(np.arange(500), 2), np.tile([0, 1], 500)
    w, b = logistic(Sparse(rows, columns, x.ravel(), (500, 2)), y, np.ones(500), 1e-4, 400, 0.05)
    assert w[0] > 1 and w[1] < -0.4
    a, c = calibrated(x @ w * 3 + 1, y, np.ones(500))
    assert abs(sigmoid(a * (x @ w * 3 + 1) + c).mean() - y.mean()) < 0.02


def test_repeated_ids_keep_the_sample_bounded(spark, monkeypatch):
    """Each id brings 40 copies, and one id 2000 different texts: the sample has each text once and stays near its bound."""
    copies = [(i, f"text {i}") for i in range(200)] * 40
    docs = spark.createDataFrame([*copies, *((1000, f"other {i}") for i in range(2000))], "doc_id long, text string")
    marks = spark.createDataFrame([*((i, i % 2, i % 2) for i in range(200)), (1000, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in toxicity.drawn_rows(docs, marks, F.lit(True), 150)[0].select("doc_id", "text", "toxic").collect()]
    by = {y: [r for r in rows if r[2] == y] for y in (0, 1)}
    assert len(set(rows)) == len(rows) and sorted(r[0] for r in by[1]) == list(range(1, 200, 2))
    assert 75 <= len(by[0]) <= 300
    monkeypatch.setattr(quality, "fit", lambda texts, low, weight: texts)
    texts = quality.learn(docs, marks, F.lit(True), 150)
    assert len(set(texts)) == len(texts) <= 600 and {f"text {i}" for i in range(1, 200, 2)} <= set(texts)

def test_a_hundred_languages(spark):
    """All are learned, though the sample's bound leaves few rows of each."""
    rng = random.Random(3)
    own = {f"x{k:03d}": [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(12)] for k in range(100)}
    rows = [(i, " ".join(rng.choice(own[f"x{i % 100:03d}"]) for _ in range(30)), f"x{i % 100:03d}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, ~held_out(F.col("doc_id")), 400, 300)
    assert model.languages == tuple(sorted(own))
    held = langid.identify(docs.filter(held_out(F.col("doc_id"))), model, ("doc_id", "lang")).collect()
    assert len(held) > 200 and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
