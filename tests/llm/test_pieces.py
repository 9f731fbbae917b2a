import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st

from quadrille.llm.pieces import OffsetCodec, codec, decode_documents, encode_documents, encoding_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@given(st.text(max_size=60))
def test_like_the_library_and_tiled_by_spans(text):
    own = codec(MODEL)
    ids, begin, end = own.encode(text)
    raw = text.encode()
    assert ids == own.whole.encode(text)
    assert b"".join(raw[a:b] for a, b in zip(begin, end, strict=True)) == raw
    assert own.decode([*ids, own.eos]) == own.whole.decode([*ids, own.eos])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@given(text=st.text(st.sampled_from("aA  ﬁ①Ⅳｱﾞé́　½\t™ß㍿"), max_size=12))
def test_longest_prefix_normalisation(rule, text, tmp_path_factory):
    normaliser = _normaliser(rule)
    own, expected = normaliser
    norm, source = own.normalise(text)
    want = expected.Normalize(text)
    assert norm.decode() == want
    assert len(source) == len(norm) + 1 and all(a <= b for a, b in zip(source, source[1:]))


_made: dict = {}


@given(text=st.text(st.sampled_from("a  ﬁ①Ⅳ<>é"), max_size=12))
def test_defined_symbols_stay_as_they_are(text):
    own, _ = _normaliser("nmt_nfkc", ("<ﬁ", "<ﬁ①", "Ⅳ"))
    ids, begin, end = own.encode(text)
    assert ids == own.whole.encode(text)
    assert all(a <= b for a, b in zip(begin, end, strict=True))


def _normaliser(rule, symbols=()):
    """A codec around the library's own compiled map, on this model's pieces; symbols stand in for its last pieces."""
    if (key := (rule, symbols)) not in _made:
        from sentencepiece import sentencepiece_model_pb2 as pb

        theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        proto = pb.ModelProto()
        proto.ParseFromString(theirs.serialized_model_proto())
        whole = pb.ModelProto()
        with open(MODEL, "rb") as f:
            whole.ParseFromString(f.read())
        whole.normalizer_spec.CopyFrom(proto.normalizer_spec)
        for piece, symbol in zip(reversed(whole.pieces), symbols):
            piece.piece, piece.type = symbol, pb.ModelProto.SentencePiece.USER_DEFINED
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".model") as f:
            f.write(whole.SerializeToString())
            f.flush()
            _made[key] = OffsetCodec(f.name), theirs
    return _made[key]


def test_operator_and_query(spark):
    rows = [(1, "Hello  wörld\n", "x"), (2, None, "x"), (3, "", "x"), (None, "a" * 5000, "x"), (1, "Hello  wörld\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = encode_documents(docs, MODEL)
    got = encoded.collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), [*sp.encode(t or ""), 2]) for i, t, _ in rows)
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in got)
    back = decode_documents(encoded, MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    for r in encoding_digests(docs, MODEL).collect():
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids = [*sp.encode(text), 2]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert encoding_digests(docs.limit(0), MODEL).count() == 0
