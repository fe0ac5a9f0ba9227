"""Operators against slow versions written from their definitions, and on odd tables."""

import hashlib
import math
import random
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, components, hnsw, langid, minhash, packing, parsing, quality, token_files, transducer, warc
from tessera.llm.common import open_fs

from .test_documents import DOCS, documents, prose, reach, shingle_sets
from .test_tokens import ODD, fuzz

M64 = (1 << 64) - 1


# -- characters ---------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("form", ["a{0}b ", "1{0}! {0}", "e{0}̣́{0} "])
def test_ids_of_all_characters(name, form):
    lib, own = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name))
    every = [c for c in (*range(0x32000), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    texts = ["".join(form.format(chr(c)) for c in every[at : at + 60]) for at in range(0, len(every), 60)]
    ids, counts = own.encode(texts)
    cuts = np.cumsum(counts).tolist()
    for text, a, b, e in zip(texts, [0, *cuts], cuts, lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == e.ids, [hex(ord(c)) for c in dict.fromkeys(text)]


def test_word_vocabulary_decodes_as_its_file_says(spark):
    lib, texts = Tokenizer.from_file(P.path("word_bpe_49k.json")), ["hello wide world", "<|endoftext|> naïve", "", "x" * 300]
    ids = bpe.bpe_encode(documents(spark, texts), P.path("word_bpe_49k.json"), ("ids",))
    got = {r.decoded for r in bpe.bpe_decode(ids, P.path("word_bpe_49k.json")).collect()}
    assert got == {lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts}
    odd = spark.createDataFrame([(1, [31373, None, 999999, -1]), (2, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.bpe_decode(odd, P.path("byte_bpe_50k.json")).collect()} == {1: "hello", 2: ""}


def test_a_worker_keeps_one_operators_tables():
    from tessera.llm import common

    one = bpe.encoder(P.path("word_bpe_49k.json"))
    assert bpe.encoder(P.path("word_bpe_49k.json")) is one and len(common._held) == 1
    transducer.transducer(P.path("piece_bpe_32k.model"))
    assert list(common._held) == [("transducer", P.path("piece_bpe_32k.model"))]
    common.let_go(("transducer", P.path("piece_bpe_32k.model")))
    assert common._held
    common.let_go()
    assert not common._held


def test_encoder_stays_within_its_bytes():
    own = bpe.Encoder(P.path("byte_bpe_50k.json"), kept=3 << 20)
    rnd, most = random.Random(2), 0
    for _ in range(30):
        own.encode([" ".join(str(rnd.random()) for _ in range(2000))])
        most = max(most, own.words.bytes + own.parts.bytes)
    assert most < 5 << 20


# -- transducer ---------------------------------------------------------------------------
def partingless(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return "".join(rnd.choice("etaoinsrhl") for _ in range(n))


def test_composed_maps_equal_one_run_after_another():
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = [partingless(3000, 1), "ab" * 1500, "a" * 1000, " " * 777, *fuzz(40), partingless(11, 5)]
    want = [len(lib.encode(t)) for t in texts]
    whole = transducer.Transducer(P.path("piece_bpe_32k.model"), chunk=1 << 30)
    assert whole.count(texts).tolist() == want
    for chunk in (1, 7, 64):
        small = transducer.Transducer(P.path("piece_bpe_32k.model"), chunk=chunk)
        seen = []
        scan = small._scan
        small._scan = lambda run, sure: seen.append(int((~sure).sum())) or scan(run, sure)
        assert small.count(texts).tolist() == want
        assert max(seen) > 20  # chunks whose entry state isn't the start state


def test_table_is_bounded_within_a_batch():
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    small = transducer.Transducer(P.path("piece_bpe_32k.model"), chunk=64, cells=40_000)
    begun = []
    renew = small._renew
    small._renew = lambda arrays: begun.append(len(small.entries)) or renew(arrays)
    texts = [partingless(6000, 3)]
    assert small.count(texts).tolist() == [len(lib.encode(t)) for t in texts]
    assert begun and len(small.table) <= 2048
    assert max(begun) <= max(small.cells // small.table.shape[1], 256 + 6000 // 64 * 8)


def test_counts_beyond_a_cell_are_refused(monkeypatch):
    monkeypatch.setattr(transducer, "HALF", 1)
    with pytest.raises(ValueError, match="fit a cell"):
        transducer.Transducer(P.path("piece_bpe_32k.model")).count(["the internationalization of it"])


# -- languages ----------------------------------------------------------------------------
def naive_languages(rows, texts):
    """Scores by the definition, from rows of text and language."""
    langs = sorted({lang for _, lang in rows})
    runs = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    pieces = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n else [w]
    counts = {n: {lang: Counter() for lang in langs} for n in range(6)}
    for text, lang in rows:
        for w in runs(text):
            for n in range(6):
                counts[n][lang].update(pieces(w, n))
    every = {n: set().union(*counts[n].values()) for n in range(6)}
    log = lambda x, n, lang: math.log((counts[n][lang][x] + 0.5) / (counts[n][lang].total() + 0.5 * max(1, len(every[n]))))
    out = []
    for text in texts:
        words, total = runs(text or ""), [0.0] * len(langs)
        for w in words:
            for n in (0, 5, 4, 3, 2, 1):
                known = [p for p in pieces(w, n) if p in every[n]]
                if known and 2 * len(known) >= len(pieces(w, n)):
                    for k, lang in enumerate(langs):
                        total[k] += sum(log(p, n, lang) for p in known) / len(known)
                    break
        share = min(1, langid.EVIDENCE / max(1, len(words)))
        p = [math.exp((t - max(total)) * share) for t in total]
        out.append((langs[total.index(max(total))] if words else "und", max(p) / sum(p) if words else 0.0))
    return out


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")


def test_languages_equal_the_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r.text, r.lang) for r in docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1 and text is not null and lang is not null").collect()]
    texts = [r.text for r in docs.orderBy("doc_id").collect()][:60] + [*ODD, "½ ² Ⅷ", "①②", "xqzt wvvk", "straße Ünïcode ŽŽ", "語", "a" * 40_000 + " der die das"]
    model = langid.fit(docs)
    got = langid.predict(documents(spark, texts), model).collect()
    want = naive_languages(rows, texts)
    assert len(got) == len(texts)
    for r in got:
        lang, score = want[2 if r.doc_id is None else r.doc_id]
        text = texts[2 if r.doc_id is None else r.doc_id] or ""
        assert (r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in text))
        if score > 0.5001:
            assert r.lang_pred == lang
        assert r.score == pytest.approx(score, abs=2e-3)


def test_every_word_of_a_rare_language_counts(spark):
    rows = [(f"wort{i} haus baum und der", "de") for i in range(400)] + [("zvláštní ojedinělé slovo", "cs")] * 3
    model = langid.fit(labelled(spark, rows))
    got = langid.predict(documents(spark, ["ojedinělé", "slovo slovo", "haus"]), model).collect()
    assert {2 if r.doc_id is None else r.doc_id: r.lang_pred for r in got} == {0: "cs", 1: "cs", 2: "de"}


def test_ties_of_languages_go_to_the_first_name(spark):
    rows = [("same words here", lang) for lang in ("zz", "aa", "mm") for _ in range(9)]
    docs = spark.createDataFrame([(i, t, lang) for (t, lang), i in zip(rows, [x for x in range(200) if zlib.crc32(str(x).encode()) % 3 != 1])], "doc_id bigint, text string, lang string")
    got = langid.predict(documents(spark, ["same words", "other"]), langid.fit(docs)).collect()
    assert {r.lang_pred for r in got} == {"aa"} and all(abs(r.score - 1 / 3) < 1e-6 for r in got)


def test_sample_of_a_language_is_bounded(spark):
    rows = [("".join(chr(97 + int(d)) for d in str(1000 + i)) + " beta", "aa") for i in range(600)]
    full, part = langid.fit(labelled(spark, rows)), langid.fit(labelled(spark, rows), per_language=100)
    n = [len(m["counts"][langid.WHOLE].key) for m in (full, part)]
    assert 380 < n[0] and 50 < n[1] < 160
    assert len(langid.fit(labelled(spark, rows), chars=1000)["counts"][langid.WHOLE].key) < 160


# -- quality ------------------------------------------------------------------------------
def test_ridge_equals_the_closed_form(spark):
    from tests.conftest import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where("quality is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 != 2").select("text", "quality", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)).alias("fold")).collect()
    x, y, fold = np.array([quality.statistics(r.text) for r in rows]), np.array([float(r.quality >= 1) for r in rows]), np.array([r.fold for r in rows])
    assert np.allclose(model["mean"], x.mean(axis=0)) and np.allclose(model["scale"], np.maximum(x.std(axis=0), 1e-6))
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -8, 8)
    z = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(z @ model["w"] + model["b"]), np.ones((len(z), 1))])
    own, ridge = z[fold != 0], quality.RIDGE * (fold != 0).sum() / quality.FEATURES
    # least squares with rows for the penalty, instead of normal equations
    weights = np.linalg.lstsq(np.vstack([own, np.sqrt(ridge) * np.eye(z.shape[1])]), np.append(y[fold != 0], np.zeros(z.shape[1])), rcond=None)[0]
    assert np.allclose(own @ weights, own @ model["weights"], atol=1e-6)
    at, value = quality.isotonic(z[fold == 0] @ weights, y[fold == 0])
    want = np.clip(0.999 * np.interp(z @ weights, at, value) + 0.001 * np.clip(z @ weights, 0, 1), 0, 1)
    got = quality.scores(model, [r.text for r in rows])
    assert np.mean(np.abs(got - want) < 1e-4) > 0.999
    # the features approximate a Gaussian kernel of the standardized statistics
    s = np.clip((x[:60] - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -8, 8)
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * quality.WIDTH))
    assert np.abs(z[:60, :-1] @ z[:60, :-1].T - kernel).mean() < 0.08


# -- fingerprints -------------------------------------------------------------------------
def mix(x: int) -> int:
    x &= M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def power(i: int) -> int:
    return mix(i % 4096 + 1) | 1


def naive_fingerprint(text: str) -> list[int]:
    """A text's phrases level by level, one text and one name at a time."""
    names, found, level = [mix(ord(c) + 1) for c in text], [], 0
    while names:
        level += 1
        runs = []
        for n in names:
            if runs and runs[-1][0] == n:
                runs[-1][1] += 1
            else:
                runs.append([n, 1])
        names = [n if k == 1 else mix(n + k * power(7)) for n, k in runs]
        label = names
        for step in range(3):
            after = []
            for i, own in enumerate(label):
                left = label[i - 1] if i else (~own & M64 if not step else own ^ 1)
                bit = ((own ^ left) & -(own ^ left)).bit_length() - 1
                after.append(2 * bit + (own >> bit & 1))
            label = after
        cuts = [0] + [i for i in range(2, len(label) - 1) if label[i] > label[i - 1] and label[i] >= label[i + 1]]
        phrases = [names[a:b] for a, b in zip(cuts, [*cuts[1:], len(names)])]
        assert len(phrases) == 1 or min(map(len, phrases)) >= 2
        names = [mix(sum(n * power(j) for j, n in enumerate(p)) + len(p)) for p in phrases]
        if level >= parsing.FROM_LEVEL or len(names) == 1:
            found += names
        if len(names) == 1:
            break
    out, seen = set(), Counter()
    for n in found:
        key = mix(n) >> 16
        out.add(mix(key + seen[key] * power(11)) >> 16 if seen[key] else key)
        seen[key] += 1
    return sorted(out)[: parsing.K]


def test_fingerprints_equal_a_naive_parser():
    texts = [t or "" for t in ODD] + fuzz(60) + prose(6) + ["ab" * 700, "x", "xy", "xyz", prose(1, 4000, 8)[0], "aaaa" * 30 + "b"]
    got = parsing.fingerprints(texts)
    for t, f in zip(texts, got):
        assert f.tolist() == naive_fingerprint(t), t[:40]
    alone = [parsing.fingerprints([t])[0].tolist() for t in texts[:40]]
    assert alone == [f.tolist() for f in got[:40]]


def test_edited_texts_over_many_ranges(spark, monkeypatch):
    """A range each few documents, repeated and null ids, a hot id, very long texts."""
    monkeypatch.setattr(parsing, "RANGE_BYTES", 200)
    texts = fuzz(150) + [None, "", "z" * 50_000, prose(1, 12_000, 4)[0]]
    ids = [7 if i % 3 == 0 else None if i % 17 == 0 else i * 10 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in zip(ids, texts)], "doc_id bigint, text string, key string, h int").repartition(4)
    rows = parsing.compare_edited(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids)
    # the order by definition: id (null first), hash of the text, text
    order = [(r.doc_id, r.t) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("t"), "t").collect()]
    want = Counter()
    for (i, t), (_, f) in zip(order, [*order[1:], order[0]]):
        n = len(t) // 4
        cut = t[: len(t) - n] + f[:n]
        own, mixed, following = (np.array(naive_fingerprint(x), dtype=np.uint64) for x in (t, cut, f))
        want[i, len(t), hashlib.sha256(cut.encode()).hexdigest(), parsing.text_of(own), parsing.text_of(mixed), round(parsing.likeness(own, mixed), 9), round(parsing.likeness(own, following), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows) == want


def test_plan_with_thousands_of_ranges_stays_small(spark, monkeypatch):
    monkeypatch.setattr(parsing, "RANGE_BYTES", 1)
    docs = spark.range(6000).select(F.col("id"), F.lit("ab").alias("text"))
    dealt = parsing.with_next(docs)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000 and dealt.rdd.getNumPartitions() >= 5000


# -- archives -----------------------------------------------------------------------------
def test_small_archives_have_a_dictionary(spark):
    pages = spark.createDataFrame([(1, "u", "<p>one</p>"), (2, "v", "<p>two</p>"), (3, None, None)], "page_id bigint, url string, html string").coalesce(1)
    files = warc.write_archives(pages)
    assert [f["records"] for f in files] == [3]
    fs, at = open_fs(files[0]["path"])
    raw = fs.open_input_stream(at).read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == warc.SKIPPABLE and size > 100
    found = [warc.parse(r) for r in warc.records(fs.open_input_stream(at))]
    assert [f["WARC-Type"] for f in found] == ["warcinfo"] + ["response"] * 3
    assert len({f["WARC-Record-ID"] for f in found}) == 4
    assert sorted(r.page_id for r in warc.read_archives(spark, files).collect()) == [1, 2, 3]


def test_dictionary_is_drawn_from_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 60_000)
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<html>"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4)).alias("html"))
    payloads = warc.written(warc.digests(pages), "digests")
    seen = []
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda n, samples: seen.extend(samples) or (_ for _ in ()).throw(warc.zstandard.ZstdError("no")))
    raw = warc.dictionary(pages, payloads)
    ids = [int(s.split(b"urn:tessera:page:")[1].split(b":")[0]) for s in seen]
    assert 40 < len(ids) < 300 and min(ids) < 700 and max(ids) > 2300 and len(raw) == warc.DICTIONARY_BYTES


def test_revisits_with_many_shared_digests_are_joined(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    pages = spark.createDataFrame([(i, "u", f"p{i % 5}") for i in range(40)], "page_id bigint, url string, html string").repartition(3)
    rows = warc.read_archives(spark, warc.write_archives(pages)).collect()
    assert {r.page_id: r.refers_to for r in rows} == {i: None if i < 5 else i % 5 for i in range(40)}


# -- vectors ------------------------------------------------------------------------------
def planted_vectors(n: int = 3000, dim: int = 32):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, dim))
    x[:700] = x[0] + rng.normal(size=(700, dim)) * 0.2  # a dense group, partly linked
    for i in range(1000, 1400):
        x[i + 400] = x[i] + rng.normal(size=dim) * rng.uniform(0.05, 0.6)
    return x


def truth(x, least=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near


def test_vectors_by_graphs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "LEAST_SHARDS", 3)
    x = planted_vectors()
    near = truth(x)
    docs = spark.createDataFrame([(i, v.tolist(), "x", 1.0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, shard string, beam double").repartition(5)
    rows = {r.vec_id: r for r in hnsw.near_vectors(docs).collect()}
    found = np.array([rows[i].n_links for i in range(len(x))])
    assert found.sum() >= 0.999 * near.sum() and (found <= near.sum(axis=1)).all()
    assert all(r.audit_recall >= hnsw.AUDIT_RECALL for r in rows.values())
    same = sum(rows[a].component_id == rows[b].component_id for a, b in np.argwhere(near))
    assert same >= 0.999 * near.sum()
    label = reach(len(x), [(int(a), int(b)) for a, b in np.argwhere(np.triu(near))])
    least = {}
    for i, g in enumerate(label):
        least.setdefault(g, i)
    assert sum(rows[i].component_id == least[label[i]] for i in range(len(x))) >= 0.999 * len(x)
    assert all((rows[i].n_links > 0) == (sum(1 for j in rows.values() if j.component_id == rows[i].component_id) > 1) for i in range(0, len(x), 50))


def test_audit_widens_the_beam_and_leaves_out_the_query_itself():
    x = planted_vectors()
    graph = hnsw.Graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    alone = np.arange(2500, 2600)  # nodes without links
    assert hnsw.recall(graph, graph.x[alone], alone, 0.9, 1) == 1.0  # nothing to find, whatever the beam
    hidden = hnsw.Graph.__new__(hnsw.Graph)
    hidden.x, hidden.layers = graph.x, [(m, np.full_like(near, -1)) for m, near in graph.layers]
    rng = np.random.default_rng(0)
    queries = hnsw.planted(graph.x.astype(float), 0.9, rng).astype(np.float32)
    assert ((queries @ graph.x.T).max(axis=1) >= 0.9 - 1e-5).all()
    assert hnsw.audit(hidden, queries, np.full(len(queries), -1), 0.9) == (0, 1.0)  # a graph without edges is scanned
    beam, share = hnsw.audit(graph, queries, np.full(len(queries), -1), 0.9)
    assert beam >= hnsw.BEAM and share >= hnsw.AUDIT_RECALL


def test_every_pair_of_shards_is_searched_once():
    for n in range(1, 9):
        graphs = [{"path": str(i), "size": 8, "beam": 1} for i in range(n)]
        pairs = [tuple(sorted((int(g["path"]), int(o)))) for _, g, others in hnsw.pairs_of_shards(graphs) for o in others]
        assert sorted(pairs) == sorted((i, j) for i in range(n) for j in range(i, n))


def test_forest_gives_spanning_links():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, (2, 900))
    forest = hnsw.Forest(300)
    used = np.concatenate([at + lo for lo in range(0, 900, 100) for at in [forest.add(a[lo : lo + 100], b[lo : lo + 100])]])
    whole = reach(300, list(zip(a.tolist(), b.tolist())))
    assert reach(300, list(zip(a[used].tolist(), b[used].tolist()))) == whole and len(used) == 300 - len(set(whole))


# -- components ---------------------------------------------------------------------------
def test_components_of_odd_links(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 460)]
    rows = [*links, *links[:20], (5, 5), (None, 3), (7, None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    label = reach(460, links)
    least = {}
    for i, g in enumerate(label):
        least.setdefault(g, i)
    assert got == {n: least[label[n]] for a, b in links for n in (a, b) if a != b}


def test_stragglers_of_a_hot_bucket(spark, monkeypatch):
    """Blocks of a few rows, several components in a bucket, most in one."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rnd, base = random.Random(4), prose(1, 80, 12)[0].split()
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = shingle_sets(texts)
    label = reach(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    rows = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    for i in range(len(texts)):
        if i != 2:
            assert rows[i].component_id == min(j for j in range(len(texts)) if label[j] == label[i] and j != 2)


# -- odd tables ---------------------------------------------------------------------------
def repeated(spark):
    """Ids that repeat with equal and other texts, null ids, and columns whose names clash with the operators' own."""
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (1, "Ein ganz anderer Text"), (None, "alpha beta gamma delta epsilon zeta"), (None, None), (2, ""), (2, None)]
    schema = "doc_id bigint, text string, lang string, k int, id string, part string, score string, size int, held_out int, n int, label string"
    return spark.createDataFrame([(i, t, "de" if t and "Ein" in t else "en", 1, "x", "y", "z", 4, 5, 6, "w") for i, t in rows], schema)


def test_rows_of_one_id_are_rows_of_their_own(spark):
    docs = repeated(spark)
    ids = Counter({1: 3, None: 2, 2: 2})
    word, byte = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    results = {
        "op1": minhash.near_duplicates(docs), "op3": transducer.count_tokens(docs, P.path("piece_bpe_32k.model")), "op5": parsing.compare_edited(docs),
        "op6": packing.pack_documents(docs, word), "op7": token_files.token_digests(docs, word), "op8": langid.predict(docs, langid.fit(docs)),
        "op9": bpe.bpe_encode(docs, byte, ("n_tokens", "ids_sha256")), "op10": quality.predict(docs, model),
    }
    for name, found in results.items():
        assert Counter(r.doc_id for r in found.collect()) == ids, name
    kept = quality.keep(docs, {"share": 0.9})
    assert kept.columns == docs.columns and kept.count() == 7
    kept = langid.keep(docs, langid.fit(docs))
    assert kept.columns == docs.columns
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1])], "vec_id bigint, embedding array<double>")
    rows = hnsw.near_vectors(vectors).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in rows) == [(0, 2, 1), (1, 0, 1), (1, 2, 1), (1, 2, 1)]


def test_empty_tables(spark):
    docs = documents(spark, []).limit(0)
    assert hnsw.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0
    model = langid.fit(docs)
    assert model == {"langs": []} and langid.predict(docs, model).count() == 0 and langid.keep(docs, model).count() == 0
    model = quality.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality.predict(docs, model).count() == 0 and quality.keep(docs, model).count() == 0
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_very_long_texts(spark):
    long = prose(1, 60_000, 2)[0]
    docs = documents(spark, [long, long + " more", "short"])
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert rows[1].component_id == 0 and not rows[1].kept
    prints = {r.doc_id: r.fingerprint for r in parsing.fingerprint_documents(docs.where("doc_id < 2")).collect()}
    assert prints[0] == parsing.text_of(np.array(naive_fingerprint(long), dtype=np.uint64)) and len(prints[0]) == 12 * parsing.K
    assert parsing.likeness(*parsing.fingerprints([long, long + " more"])) > 0.9
    model = langid.fit(labelled(spark, [("alpha beta", "aa"), (long, "bb"), ("gamma", "aa"), (long, "bb")]))
    assert {r.lang_pred for r in langid.predict(docs.where("doc_id < 2"), model).collect()} == {"bb"}
    assert all(0 <= r.score <= 1 for r in quality.predict(docs, {"share": 0.4}).collect())


def test_clusters_have_to_name_a_shared_folder(spark):
    from types import SimpleNamespace

    from tessera.llm.common import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


# -- pipeline -----------------------------------------------------------------------------
def test_pipeline_equals_the_stages_by_definition(spark, sf_dir):
    import corpus_pipeline

    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: (r.text, r.lang) for r in every.collect()}
    crc = lambda i, n: zlib.crc32(str(i).encode()) % n
    known = [(t, lang) for i, (t, lang) in rows.items() if crc(i, 3) != 1 and t is not None and lang is not None]
    said = naive_languages(known, [t for t, _ in rows.values()])
    first = [i for (i, _), (lang, score) in zip(rows.items(), said) if lang != "und" and score >= 0.5]
    after = corpus_pipeline.language(spark, every, sf_dir)
    assert sorted(r.doc_id for r in after.collect()) == sorted(first)
    model = quality.fit(after, labels)
    second = [i for i, s in zip(first, quality.scores(model, [rows[i][0] for i in first])) if s >= 0.7]
    sets = shingle_sets([rows[i][0] for i in second])
    label = reach(len(second), [(a, b) for a in range(len(second)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    least = {}
    for i, g in zip(second, label):
        least[g] = min(i, least.get(g, i))
    kept = {i for i, g in zip(second, label) if least[g] == i}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: len(lib.encode(rows[i][0] or "", add_special_tokens=False).ids) + 1 for i in kept}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert dict(total) == want
    assert len({r.sequence_id for r in got}) <= -(-sum(want.values()) // 4096) + 1


STAGE_DOCS = "doc_id bigint, text string, lang string, source string, k int, _id string, _k int, own_set string, kept_id int"


def test_stages_keep_rows_and_columns_whatever_their_names(spark, sf_dir):
    """near_dedup with repeated ids, null texts and ids, and columns named as it would name its own."""
    import corpus_pipeline

    a, b = prose(2, 80, 11)
    rows = [(i, t, "en", "s", 1, "x", 2, "y", 3) for i, t in [(1, a), (1, a), (1, b), (2, a + " more"), (3, None), (3, None), (4, ""), (None, a), (None, None)]]
    df = spark.createDataFrame(rows, STAGE_DOCS)
    got = corpus_pipeline.distinct(spark, df, sf_dir)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (1, b), (3, None), (4, ""), (None, a), (None, None)])
    once = corpus_pipeline.distinct(spark, df.where("doc_id > 1"), sf_dir)
    assert once.columns == df.columns and {r.doc_id for r in once.collect()} == {2, 3, 4}


def test_every_stage_of_an_empty_table(spark, sf_dir):
    import corpus_pipeline

    df = spark.createDataFrame([], STAGE_DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == df.columns)
