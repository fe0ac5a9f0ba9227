"""Encoding, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, token_files
from tessera.llm.bpe import encoder

ODD = [None, "", " ", "\n", "  x   \n\n  y ", "don't WE'LL i've 's '", "<|endoftext|>x<|startoftext|> y <|endoftext|>", "a" * 5000, "ΑΣ ßİ é é 中文 ١٢ ² Ⅷ 🙂 \x1c\x85 ..!?", "the the the", "the the the"]
SCHEMA = "doc_id bigint, text string, n_tokens string, ids int, length int"


def fuzz(n: int, seed: int = 1) -> list[str]:
    rnd = random.Random(seed)
    alphabet = "abcdefghij klmno  pq\n\t rstuvwxyzABCEΣİßéñ中文字123٣²Ⅷ!?.,'\"  ́e\x1c\x85_-<|>🙂"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 120))) for _ in range(n)]


def library(name: str, text: str | None) -> list[int]:
    return Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    lib, own, texts = Tokenizer.from_file(P.path(name)), encoder(P.path(name)), fuzz(600) + [t or "" for t in ODD]
    ids, counts = own.encode(texts)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    if name[0] == "b":
        assert own.decode(ids).decode() == "".join(texts)


def test_encoder_forgets_without_change():
    from tessera.llm.bpe import Encoder

    own = Encoder(P.path("byte_bpe_50k.json"), kept=5)
    for text in fuzz(50, 7):
        assert own.encode([text])[0].tolist() == library("byte_bpe_50k.json", text)


def odd_table(spark, extra=()):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", 1, 2) for i, t in enumerate([*ODD, *extra])], SCHEMA)


def test_bpe_operator(spark):
    docs = odd_table(spark)
    rows = bpe.bpe_encode(docs, P.path("byte_bpe_50k.json"), ("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[3 if r.doc_id is None else r.doc_id] or ""
        ids = library("byte_bpe_50k.json", text)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), text)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.bpe_decode(bpe.bpe_encode(docs, P.path("byte_bpe_50k.json"), ("ids",)), P.path("byte_bpe_50k.json"))
    assert sorted(r.decoded for r in back.collect()) == sorted(t or "" for t in ODD)
    assert bpe.bpe_encode(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_token_files(spark):
    docs = odd_table(spark, fuzz(40)).repartition(5)
    rows = {r.doc_id: r for r in token_files.token_digests(docs, P.path("word_bpe_49k.json")).collect()}
    start = 0
    for i, text in sorted(((None if i == 3 else i), t) for i, t in enumerate([*ODD, *fuzz(40)]) if i == 3) + sorted((i, t or "") for i, t in enumerate([*ODD, *fuzz(40)]) if i != 3):
        ids = [*library("word_bpe_49k.json", text), 1]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_digests(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def check_packing(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing_of_documents(spark):
    texts = [*ODD, *fuzz(200)]
    rows = packing.pack_documents(odd_table(spark, fuzz(200)).repartition(4), P.path("word_bpe_49k.json"), capacity=64).collect()
    n = check_packing(rows, 64)
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
    assert len(whole) == len(texts)
    total = 0
    for i, text in enumerate(texts):
        ids = [*library("word_bpe_49k.json", text), 1]
        pieces = sorted(whole[i if i != 3 else None], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), 64))
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()) for a in range(0, len(ids), 64)]
        total += len(ids)
    assert n <= -(-total // 64) + 2
    assert packing.pack_documents(odd_table(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_plan_is_near_the_fewest():
    rnd = random.Random(5)
    for _ in range(150):
        capacity = rnd.choice([7, 10, 20])
        sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(0, 9))), reverse=True)
        plan = packing.Plan(np.bincount(sizes, minlength=capacity + 1))
        spans = {}
        for size, lo, hi, first, each, at in plan.rows:
            for rank in range(lo, hi):
                spans.setdefault(first + (rank - lo) // each, []).append((at + (rank - lo) % each * size, size))
        assert sorted(s for v in spans.values() for _, s in v) == sorted(sizes)
        for v in spans.values():
            at = 0
            for offset, size in sorted(v):
                assert offset == at
                at += size
            assert at <= capacity
        assert len(spans) <= fewest(sizes, capacity) + (plan.n_fixed < len(spans))
