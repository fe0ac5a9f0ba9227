"""Operators on documents, pages and vectors against brute force, and on odd tables."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from tessera.llm import hnsw, langid, minhash, parsing, quality, transducer, warc

from .test_tokens import ODD, fuzz

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int, score string"


def documents(spark, texts, lang="en"):
    """With clashing extra columns; the third row has no id."""
    return spark.createDataFrame([(None if i == 2 else i, t, lang, None, None, 7, "x") for i, t in enumerate(texts)], DOCS)


def prose(n: int, words: int = 60, seed: int = 3) -> list[str]:
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(words)) for _ in range(n)]


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def reach(n, linked):
    label = list(range(n))
    for a, b in linked:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_minhash_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = prose(20)
    for base in list(texts[:6]):  # a group of edits of one text, at all distances
        for k in (1, 2, 3, 5, 8):
            w = base.split()
            for _ in range(k):
                w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["", None, " \t\n", "One two", "one TWO", "ÀB c d e", "àb c d e", texts[0], texts[0].upper(), "w " * 3000]
    rows = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    sets = shingle_sets(texts)
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = reach(len(texts), linked)
    for i in range(len(texts)):
        if i != 2:
            assert rows[i].n_shingles == len(sets[i])
            group = [j for j in range(len(texts)) if label[j] == label[i] and j != 2]
            assert rows[i].component_id == min(group) and rows[i].kept == (i == min(group)), (i, rows[i])
    assert not rows[None].kept
    assert minhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0


def test_left_over_pairs_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = prose(1, 100, 5)[0].split()
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 100, 4)] + [" ".join([*base[:60], *t.split()]) for t in prose(6, 40, 6)]
    rows = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    sets = shingle_sets(texts)
    label = reach(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    for i in range(len(texts)):
        if i != 2:
            assert rows[i].component_id == min(j for j in range(len(texts)) if label[j] == label[i] and j != 2)


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "é" * 40_000, "<p>a</p>", "\r\n\r\n", "<p>a</p>"] + [f"<html><body>page {i} {'text ' * 40}</body></html>" for i in range(300)]
    ids = [5, 6, 1, 9, 3, 8, None, 7, 1, *range(20, 320)]
    pages = spark.createDataFrame([(i, None if k % 3 else f"http://a/{k}\n", h, 1) for k, (i, h) in enumerate(zip(ids, html))], "page_id bigint, url string, html string, first_id int").repartition(3)
    files = warc.write_archives(pages)
    assert sum(f["records"] for f in files) == len(ids)
    rows = warc.read_archives(spark, files, payload=True).collect()
    first = {}
    for i, h in zip(ids, html):
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), str(None if i == first[h or ""] else first[h or ""])) for i, h in zip(ids, html))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, str(r.refers_to)) for r in rows) == want
    for r in rows:
        assert (r.record_type == "response") == (r.refers_to is None) == (r.payload is not None)
    from tessera.llm.common import open_fs

    fs, at = open_fs(files[0]["path"])
    assert any(open_fs(f["path"])[0].open_input_stream(open_fs(f["path"])[1]).read(4) == b"\x5d\x2a\x4d\x18" for f in files)
    assert fs.get_file_info(at).size
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_token_counts_equal_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = [*ODD, *fuzz(500), "▁▁ ▁a", "<s>x</s><0x0A>", "ab" * 3000, " " * 2000, "\0"]
    rows = transducer.count_tokens(documents(spark, texts), P.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[2 if r.doc_id is None else r.doc_id] or ""
        n = len(lib.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
    small = transducer.Transducer(P.path("piece_bpe_32k.model"), chunk=7, cells=10)
    for t in texts[:200]:  # chunks without partings, a table begun anew each time
        assert small.count([t])[0] == len(lib.encode(t or ""))
    assert transducer.count_tokens(documents(spark, texts).limit(0), P.path("piece_bpe_32k.model")).count() == 0


def unit_vectors():
    rng = np.random.default_rng(1)
    v = [rng.normal(size=16) for _ in range(150)]
    v += [v[0] + rng.normal(size=16) * 0.05 for _ in range(60)] + [v[1] + rng.normal(size=16) * 0.3 for _ in range(40)]
    return [x.tolist() for x in v] + [v[0].tolist()] * 5 + [(3 * v[3]).tolist(), [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]


def test_vectors_equal_brute_force(spark):
    vectors = unit_vectors()
    rows = {r.vec_id: r for r in hnsw.near_vectors(spark.createDataFrame([(None if i == 2 else i, v, "a") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, k string")).collect()}
    ok = [bool(v) and None not in v and np.isfinite(v).all() and np.any(v) for v in vectors]
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    linked = [(a, b) for a in range(len(vectors)) for b in range(a) if ok[a] and ok[b] and len(vectors[a]) == len(vectors[b]) and (vectors[a] == vectors[b] or cosine(vectors[a], vectors[b]) >= 0.9)]
    label, degree = reach(len(vectors), linked), np.bincount(np.array(linked).reshape(-1), minlength=len(vectors))
    for i in range(len(vectors)):
        if i != 2:
            group = min(j for j in range(len(vectors)) if label[j] == label[i] and j != 2)
            assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (degree[i], group, i == group), i


def test_fingerprints(spark):
    texts = [*ODD, *prose(30), prose(1)[0]]
    rows = parsing.compare_edited(documents(spark, texts).repartition(3)).collect()
    order = sorted(range(len(texts)), key=lambda i: (i != 2, i))
    by = {2 if r.doc_id is None else r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for k, i in enumerate(order):
        t, f = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(t) // 4
        assert by[i].n_chars == len(t)
        assert by[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + f[:n]).encode()).hexdigest()
        assert by[i].fingerprint == parsing.text_of(parsing.fingerprints([t])[0])
        assert by[i].edited_fingerprint == parsing.text_of(parsing.fingerprints([t[: len(t) - n] + f[:n]])[0])
        assert by[i].near_next == parsing.likeness(*parsing.fingerprints([t, f])) and 0 <= by[i].near_edited <= 1
    long = [i for i in order if len(texts[i] or "") > 250 and i >= len(ODD)]
    assert np.mean([by[i].near_edited for i in long]) > 0.45
    assert by[len(ODD)].fingerprint == by[len(texts) - 1].fingerprint
    assert parsing.compare_edited(documents(spark, []).limit(0)).count() == 0


def test_phrases_do_not_hang_on_the_offset():
    text = prose(1, 400)[0]
    a, b = parsing.fingerprints([text, "zq1 " * 3 + text])
    assert parsing.likeness(a, b) > 0.8


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and rows
    odd = langid.predict(documents(spark, [*ODD, "123 456 ..."]), model).collect()
    assert len(odd) == len(ODD) + 1
    for r in odd:
        text = [*ODD, "123 456 ..."][2 if r.doc_id is None else r.doc_id] or ""
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text)) and 0 <= r.score <= 1
    none = langid.fit(documents(spark, ODD, lang=None))
    assert {r.lang_pred for r in langid.predict(documents(spark, ODD), none).collect()} == {"und"}
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()


def test_quality(spark):
    from tests.conftest import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.predict(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    odd = quality.predict(documents(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    assert quality.fit(docs, labels.limit(0)) == {"share": 0.5}
    assert {r.score for r in quality.predict(documents(spark, ODD), {"share": 0.5}).collect()} == {0.5}


def test_isotonic_against_definition():
    rng = np.random.default_rng(2)
    x, y = rng.random(40), rng.integers(0, 2, 40).astype(float)
    at, value = quality.isotonic(x, y)
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
    o = y[np.argsort(x)]
    want = [max(min(o[a : b + 1].mean() for b in range(i, len(o))) for a in range(i + 1)) for i in range(len(o))]
    assert sorted(set(np.round(want, 9))) == pytest.approx(value.tolist())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf_dir)
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in now.select("doc_id").collect()}
        now = after
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == ids


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline

    text = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("b")), (2, text("c")), (2, text("c")), (3, text("d")), (3, text("a") + " more"), (4, ""), (4, None), (5, text("e")), (5, text("e") + " more"), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in corpus_pipeline.distinct(spark, docs, "").collect())
    assert got == [(0, "a0"), (1, "a0"), (2, "b0"), (2, "c0"), (3, "d0"), (4, ""), (5, "e0")]
