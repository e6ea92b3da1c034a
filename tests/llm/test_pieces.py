"""Operator 3 against the public library's Viterbi over the same pieces, and exact round trips."""

import random

import pytest
from sentencepiece import SentencePieceProcessor

from tidemill.llm import pieces
from tidemill.llm.queries import MODEL, op3_pieces

RAW = open(MODEL, "rb").read()


def as_unigram(model: bytes) -> bytes:
    """The same file with its model type (field 3 of the trainer's settings, field 2 of the file) set to unigram."""

    def varint(at):
        value = shift = 0
        while True:
            b = model[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value, at

    at, out = 0, bytearray()
    while at < len(model):
        start = at
        tag, at = varint(at)
        assert tag & 7 == 2
        n, at = varint(at)
        part = bytearray(model[at : at + n])
        if tag >> 3 == 2:
            k = 0
            while k < n:
                key, p = varint(at + k)
                p -= at
                if key == 3 << 3:
                    assert part[p] == 2
                    part[p] = 1
                if key & 7 == 0:
                    k = varint(at + p)[1] - at
                elif key & 7 == 2:
                    size, q = varint(at + p)
                    k = q - at + size
                else:
                    k = p + (4 if key & 7 == 5 else 8)
        out += model[start:at] + part
        at += n
    return bytes(out)


def test_equals_the_librarys_viterbi(spark):
    library, own, r = SentencePieceProcessor(model_proto=as_unigram(RAW)), pieces.Vocabulary(RAW), random.Random(5)
    texts = [x.text[:300] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["".join(r.choices("abcehlo  ▁.\n\téßñ日本語😀𝒳0123,'", k=r.randint(0, 40))) for _ in range(1500)] + ["", " ", "   ", "\n\n", "a   b", "  lead", "trail  ", "\u0000x"]
    def total(ids):
        return sum(own.unknown_score if library.is_byte(i) else library.get_score(i) for i in ids)

    exact = 0
    for t in texts:
        mine = own.encode(t)
        best = library.nbest_encode(t[:80], nbest_size=1)[0] if t else []  # the lattice's best path
        assert total(own.encode(t[:80])) >= total(best) - 1e-3 * abs(total(best)) / 1e6, t  # sums there are single precision
        assert total(mine) >= total(library.encode(t)) - 1
        exact += own.encode(t[:80]) == best
    assert exact > 0.95 * len(texts)
    for t in texts:
        assert own.decode(own.encode(t)) == t.replace("▁", " ")
        assert own.decode(own.encode(t)) == library.decode(own.encode(t)) or t[:1] == " "


def test_whole_table_round_trips(spark):
    got = op3_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(x.decodes and x.n_unknown == 0 and x.n_pieces > 0 for x in got)
    own, texts = pieces.Vocabulary(RAW), {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(own.decode(x.ids) == texts[x.doc_id] and len(x.ids) == x.n_pieces for x in got)


def test_files_are_told_apart_by_what_they_hold(spark, tmp_path):
    (tmp_path / "piece_bpe_32k.model").write_bytes(as_unigram(RAW))
    docs = spark.createDataFrame([(1, "such a text")], "doc_id long, text string")
    a, b = pieces.encoded(docs, MODEL).first().ids, pieces.encoded(docs, str(tmp_path / "piece_bpe_32k.model")).first().ids
    assert a == b  # the same pieces and scores, sent as a file of its own
    (tmp_path / "x.model").write_bytes(b"no model")
    with pytest.raises(Exception):  # noqa: B017
        pieces.encoded(docs, str(tmp_path / "x.model"))


def test_edges(spark):
    long = "nospace" * 30_000
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a▁b", 3), (4, long, 4), (4, long, 4), (None, "é日", 5)], "doc_id long, text string, ids int")
    got = {x.doc_id: (x.n_pieces > 0, x.decodes) for x in pieces.round_trips(docs, MODEL).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (True, False), 4: (True, True), None: (True, True)}
    ids = pieces.encoded(docs, MODEL)
    assert ids.count() == 6
    back = {x.doc_id: x.text for x in pieces.decoded(ids, MODEL).collect()}
    assert back == {1: "", 2: "", 3: "a b", 4: long, None: "é日"}
    assert pieces.round_trips(docs.limit(0), MODEL).count() == 0
