"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import sentencepiece

from obslake.llm import piece_bpe as P

from .helpers import docs, odd_rows

PARTS = ["a", "b", "in", "the", " ", "  ", P.SPACE, "é", "ß", "\n", "\t", "\x00", "日", "本", "😀", "́", "aaaaaaa", "ababab", "1", "22", ".", "<s>", "</s>", "<unk>", "<0x41>", "﻿", " ", "erer", "ininin"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_path())


def test_random_texts_round_trip():
    r, m, lib = random.Random(2), P.model(P.default_path()), library()
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 50))) for _ in range(1500)] + ["", " ", "abc" * 500, "a" * 3000, "erer" * 800]
    ids = m.encode(texts)
    want = lib.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert [i.tolist() for i in ids] == want
    assert [t.decode("utf-8", "replace") for t in m.decode(ids)] == lib.decode(want)


def test_random_ids_decode_as_the_library():
    r, m, lib = random.Random(3), P.model(P.default_path()), library()
    many = [[r.choice([r.randint(3, 258), r.randint(0, 300), r.randint(259, 31_999)]) for _ in range(r.randint(0, 12))] for _ in range(1500)]
    got = m.decode([np.array(ids, np.uint32) for ids in many])
    assert [t.decode("utf-8", "replace") for t in got] == [lib.decode(ids) for ids in many]


def test_frames(spark):
    rows, lib = odd_rows(5, n=30), library()
    out = P.tokenized(docs(spark, rows), P.default_path(), digest=True)
    for r, (i, t) in zip(sorted(out.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert (r["doc_id"], r["n_tokens"]) == (i, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert P.tokenized(docs(spark, []), P.default_path()).count() == 0
    one = P.tokenized(docs(spark, [(1, "the end")]), P.default_path()).first()
    assert one["decoded"] == "the end" and one["ids"][0] == 1 and one["ids"][-1] == 2
