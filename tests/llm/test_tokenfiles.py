import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import pyarrow as pa
from pyarrow import fs
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadrille.llm import tokenfiles
from quadrille.llm.tokenfiles import array_encoder, encoder, read_token_files, write_token_files

FILE = public_tokenizers.path("byte_bpe_50k.json")
library = Tokenizer.from_file(FILE)

words = st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "it's", "word,", "Été.", "x1", " ", " ", "<|endoftext|>", "日本", ".", "\x1c", chr(0x10FFFF)]), st.text(max_size=5)), max_size=12).map("".join)


@given(st.lists(st.one_of(st.none(), words, words.map(lambda w: " ".join(w.split()))), min_size=1, max_size=6))
def test_words_encode_as_whole_texts(texts):
    own = array_encoder(FILE, 2)
    ids, sizes = own.encode(pa.array(texts, pa.string()))
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


@pytest.mark.parametrize("bound", ["REMEMBERED", "REMEMBERED_BYTES"])
def test_forgetting_changes_nothing(monkeypatch, bound):
    monkeypatch.setattr(tokenfiles, bound, 40)
    own = tokenfiles.ArrayEncoder(encoder(FILE, None))
    texts = [" ".join(f"w{i}{'abc'[j % 3]}" for j in range(i % 7)) for i in range(300)]
    for i in range(0, 300, 30):
        ids, _ = own.encode(pa.array(texts[i : i + 30]))
        assert ids.tolist() == [x for t in texts[i : i + 30] for x in library.encode(t, add_special_tokens=False).ids]


def test_files_round_trip(spark, tmp_path):
    rows = [(5, "five five"), (3, None), (9, ""), (4, "word " * 3000), (None, "no id"), (5, "another five"), (3, None)] + [(100 + i, f"doc {i} text") for i in range(50)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    manifest = write_token_files(docs, FILE, f"file://{tmp_path}/out", 2)
    assert manifest["dtype"] == "<u2" and manifest["n_docs"] == len(rows)
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for doc, text in expected:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = sorted((tuple(r) for r in read_token_files(spark, f"file://{tmp_path}/out").collect()), key=lambda r: r[1])
    assert got == want and manifest["n_ids"] == start
    # The files alone, memory-mapped, in order, are the whole run.
    folder = Path(tmp_path, "out")
    parts = json.loads((folder / "manifest.json").read_text())["parts"]
    flat = np.concatenate([np.fromfile(folder / f"tokens-{p['part']:05d}-{p['attempt']}.bin", "<u2") for p in parts])
    assert flat.tolist() == [i for w in want for i in w[4]]
    for p in parts:
        offsets = np.fromfile(folder / f"offsets-{p['part']:05d}.bin", "<u8")
        assert len(offsets) == p["n_docs"] + 1 and offsets[0] == p["first_id"] and offsets[-1] == p["first_id"] + p["n_ids"]


def test_memory_is_bounded_by_bytes(monkeypatch):
    """Long words count by their bytes, few as they are."""
    monkeypatch.setattr(tokenfiles, "REMEMBERED_BYTES", 1 << 16)
    own = tokenfiles.ArrayEncoder(encoder(FILE, None))
    for i in range(60):
        own.encode(pa.array([" ".join(chr(97 + (i + j) % 26) * 2000 + str(i) for j in range(4))]))
        assert own.text_used + own.used * own.flat.itemsize < (1 << 16) + 40_000


def test_a_repeated_id_is_spread(spark, tmp_path):
    rows = [(7, f"{i:04d} text of its own") for i in range(2000)] + [(None, f"{i:04d}") for i in range(500)]
    joins = "spark.sql.adaptive.coalescePartitions.enabled"  # else small partitions become one
    spark.conf.set(joins, "false")
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), FILE, f"file://{tmp_path}/out", 2)
    spark.conf.unset(joins)
    assert sum(p["n_docs"] > 0 for p in manifest["parts"]) > 1 and max(p["n_docs"] for p in manifest["parts"]) < 1500
    got = sorted((r.start, tuple(r.ids)) for r in read_token_files(spark, f"file://{tmp_path}/out").collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[1]))
    assert [g[1] for g in got] == [(*library.encode(t, add_special_tokens=False).ids, 2) for _, t in want]


def test_files_read_by_ranges(spark, tmp_path, monkeypatch):
    """A store that is not local is read range by range."""
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 9)) for i in range(40)] + [(None, None)], "doc_id long, text string")
    write_token_files(docs, FILE, f"file://{tmp_path}/far", 2)
    local = tokenfiles._Mapped(fs.LocalFileSystem(), next(map(str, Path(tmp_path, "far").glob("tokens*.bin"))), "<u2")
    far = tokenfiles._Mapped(fs.SubTreeFileSystem(f"{tmp_path}/far", fs.LocalFileSystem()), next(p.name for p in Path(tmp_path, "far").glob("tokens*.bin")), "<u2")
    assert far.map is None and len(far) == len(local) and far.part(1, 9).tolist() == local.part(1, 9).tolist() and far.part(0, 0).tolist() == []


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_token_files(docs, FILE, f"file://{tmp_path}/none", 2)
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0
