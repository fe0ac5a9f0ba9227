"""Valid-time enrichment, filter audit and sharding against their definitions, and on odd tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from datetime import datetime, timedelta
from itertools import permutations

import pandas as pd
import pytest
import xxhash

from tessera.llm import audit, sharding, valid_time

START, FIRST = datetime(2024, 1, 1), 19723


# -- valid-time enrichment ----------------------------------------------------------------
def simulated(sales, changes, batches, days):
    """The contract word by word: sales (id, client, sold_at, arrived_at), changes (id, client, op, valid_at, balance)."""
    cut = lambda d: max(0, min(batches - 1, (d - FIRST) * batches // days))
    day = lambda t: (t - datetime(1970, 1, 1)).days
    mine = [[s for s in sales if cut(day(s[3])) == b] for b in range(batches)]
    theirs = [[c for c in set(changes) if c[3] is not None and cut(day(c[3]) + zlib.crc32(str(c[0]).encode()) % 4) == b] for b in range(batches)]
    held, waiting, out, low = {}, [], [], datetime.min
    tops = [low, low]
    last = lambda vs, t: max((v for v in vs if v[3] <= t), key=lambda v: (v[3], v[0], -1e18 if v[4] is None else v[4], v[2]), default=None)

    def emit(s, b):
        own = held.get(s[1], []) if s[1] is not None else []
        v = last(own, s[2]) if s[2] is not None else None
        cents = None if v is None or v[4] is None else int((100 * v[4] + 0.5) // 1)
        out.append(("sale", s[0], b, len(own), v and v[0], cents, v and v[2]))

    for b in range(batches):
        horizon = min(tops)
        for c in theirs[b]:
            if c[3] < tops[1]:
                out.append(("late", c[0], b, None, None, None, None))
            else:
                held.setdefault(c[1], []).append(c)
        waiting, ready = [], waiting + mine[b]
        for s in ready:
            emit(s, b) if s[2] is None or s[2] < horizon else waiting.append(s)
        for client, own in held.items():
            keep = last(own, horizon)
            held[client] = [v for v in own if v[3] > horizon or v is keep]
        tops = [max([tops[0], *(s[2] for s in mine[b] if s[2])]), max([tops[1], *(c[3] for c in theirs[b])])]
    for s in waiting:
        emit(s, batches)
    return sorted(out, key=str)


def shop(seed, n, hours, days):
    rnd = random.Random(seed)
    at = lambda: START + timedelta(hours=rnd.randrange(24 * days // hours) * hours)
    clients = [1] * 6 + [2, 3, 4, 5, None]
    sales = []
    for i in range(n):
        sold = None if rnd.random() < 0.03 else at()
        sales.append((i // 2 if i % 37 == 1 else i, rnd.choice(clients), sold, (sold or at()) + timedelta(days=rnd.choice([0, 0, 0, 1, 3, 9]))))
    changes = [(i, rnd.choice(clients[:-1]), rnd.choice("IUD"), None if rnd.random() < 0.03 else at(), None if rnd.random() < 0.05 else rnd.randrange(-9999, 9999) / 100) for i in range(n)]
    return sales, changes + changes[: n // 8]


def got_rows(df):
    return sorted((tuple(r) for r in df.select("rec", "id", "batch", "n_held", "change_id", "balance_cents", "op").collect()), key=str)


def frames(spark, sales, changes):
    """With extra columns whose names the operator uses itself."""
    s = spark.createDataFrame([(*r, 7, "x", 1) for r in sales], "sale_id bigint, client_id bigint, sold_at timestamp_ntz, arrived_at timestamp_ntz, slot int, kind string, batch int")
    c = spark.createDataFrame([(*r, "y", 3) for r in changes], "change_id bigint, client_id bigint, op string, valid_at timestamp_ntz, balance double, page string, at int")
    return s, c


def test_enrichment_equals_the_simulation(spark):
    """With one client cut into lanes, versions of equal times, repeated rows and rows without client or time."""
    sales, changes = shop(4, 260, 3, 30)
    got = got_rows(valid_time.enrich_sales(*frames(spark, sales, changes), batches=4, days=30, hot_rows=60, hot_share=0.2))
    want = simulated(sales, changes, 4, 30)
    assert {r[0] for r in want} == {"sale", "late"} and len({r[2] for r in want}) == 5
    assert got == want


def test_enrichment_of_empty_tables(spark):
    sales, changes = frames(spark, *shop(5, 12, 6, 8))
    none = valid_time.enrich_sales(sales.limit(0), changes.limit(0), batches=1, days=8)
    assert none.count() == 0 and none.columns[:3] == ["rec", "id", "batch"]
    rows = valid_time.enrich_sales(sales, changes.limit(0), batches=1, days=8).collect()
    assert len(rows) == 12 and all(r.n_held == 0 and r.change_id is None and r.batch == (0 if r.id is None else r.batch) for r in rows)


class Kept:
    """A state variable in memory."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Kept())

    getMapState = getValueState


@pytest.mark.parametrize("seed", range(12))
def test_a_slot_equals_the_simulation(seed):
    """State by batch without Spark, on random shops; pages below the horizon are gone after each batch."""
    batches, days = 5, 24
    sales, changes = shop(seed, 150, (1, 6, 24)[seed % 3], days)
    micro = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    cut = lambda d: max(0, min(batches - 1, (d - FIRST) * batches // days))
    day = lambda t: (t - datetime(1970, 1, 1)).days
    null, rows = valid_time.NEVER, []
    for i, client, sold, arrived in sales:
        at = null if sold is None else micro(sold)
        rows.append((valid_time.SALE, cut(day(arrived)), null if client is None else client, null if sold is None else at // valid_time.DAY, at, i, null, None))
    for i, client, op, valid, balance in set(changes):
        if valid is not None:
            rows.append((valid_time.VERSION, cut(day(valid) + zlib.crc32(str(i).encode()) % 4), client, micro(valid) // valid_time.DAY, micro(valid), i, null if balance is None else int((100 * balance + 0.5) // 1), op))
    feed = pd.DataFrame(rows, columns=["kind", "batch", "client", "page", "at", "id", "cents", "op"]).assign(n=null, first=null, slot=0).astype({"kind": "int32"})
    tops, handle, out = [null, null], Handle(), []
    for b in range(batches + 1):
        slot = valid_time.Slot(b, min(tops), tops[1], 10, valid_time.DAY, b == batches)
        slot.init(handle)
        own = feed[feed.batch == b]
        for part in slot.handleInputRows((0,), iter([own.iloc[:20], own.iloc[20:]]), None):
            out += [tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in part.drop(columns="client").itertuples(index=False, name=None)]
        if b < batches and min(tops) != null:
            assert all(p >= min(tops) // valid_time.DAY for (p,) in handle.states["versions"].map)
        for k, kind in enumerate((valid_time.SALE, valid_time.VERSION)):
            tops[k] = max([tops[k], *own[(own.kind == kind) & (own["at"] != null)]["at"]])
    assert sorted(out, key=str) == simulated(sales, changes, batches, days)


# -- filter audit -------------------------------------------------------------------------
def audited(docs, labels):
    """Every order applied row by row."""
    fails, seen = [], {}
    for i, text, _ in docs:
        if i is not None:
            seen[text or ""] = min(i, seen.get(text or "", i))
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > seen[text]}
        fails.append((i, part or "", {k for k, v in f.items() if v}))
    out, shares = {}, Counter()
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                falls = [(i, f) for i, f in own if x in f and not f & before]
                shares[part, x] += len(falls)
                out[part, order, step] = [sum(not f & (before | {x}) for _, f in own), len(falls), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own), sum(i in good for i, _ in falls), sum(i in toxic for i, _ in falls)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force_on_odd_rows(spark):
    rnd = random.Random(2)
    long = lambda n, kinds: " ".join(f"w{rnd.randrange(kinds)}" for _ in range(n))
    texts = [long(250, 900), long(250, 40), long(250, 900) + " # &", long(250, 900).upper(), long(199, 900), long(200, 900), "", None, " \t\n", "a b", "ÀÉ x", "A", "|", long(5000, 3000)]
    docs = [(i, t, "abc"[i % 3]) for i, t in enumerate(texts * 3)] + [(50, texts[0], None), (50, texts[0], None), (51, texts[1], ""), (None, texts[0], "a"), (None, None, None)]
    labels = [(0, 1, 0), (0, 0, 1), (14, 1, 1), (28, None, 1), (None, 1, 1), (50, 1, None), (900, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x", b"", 2.0) for d in docs], "doc_id bigint, text string, source string, mask int, part string, digest binary, n double")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.filter_audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got == audited(docs, labels)
    assert len(got) == 600 * len({p or "" for *_, p in docs})


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert audit.filter_audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


# -- sharding -----------------------------------------------------------------------------
SHARD_DOCS = "doc_id bigint, text string, shard int, bucket string, slot int, doc string, _bucket int"


def named_shard(doc_id, shards):
    """The highest of the hashes of id and shard; a null id leaves the seed."""

    def score(s):
        seed = 42 if doc_id is None else xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
        h = xxhash.xxh64(struct.pack("<i", s), seed=seed).intdigest()
        return (h - (1 << 64) if h >> 63 else h, s)

    return max(map(score, range(shards)))[1]


def test_shards_by_definition(spark):
    texts = ["", None, "é" * 9, "same", "same", "x" * 4000, *(f"text {i} " * (i % 11) for i in range(300))]
    rows = [(i if i != 3 else None, t, 1, "b", 2, "d", 3) for i, t in enumerate(texts)] + [(7, "again " * 20, 1, "b", 2, "d", 3)] * 90
    df = spark.createDataFrame(rows, SHARD_DOCS)
    got = sharding.shard_digests(df, shards=5, bucket_bytes=2000).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, crc(r[1])) for r in rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    for r in got:
        assert r.shard == named_shard(r.doc_id, 5) and r.grown_shard == named_shard(r.doc_id, 6) and r.grown_shard in (r.shard, 5) and r.law == "key"


def test_shard_files_hold_whole_documents_in_bounded_buckets(spark):
    """Rows that repeat each other are dealt to several buckets; order within a bucket is not that of the ids."""
    rows = [(7, "again " * 20, 1, "b", 2, "d", 3)] * 200 + [(i, "word " * 8, 1, "b", 2, "d", 3) for i in range(600)]
    df = spark.createDataFrame(rows, SHARD_DOCS)
    at = sharding.write_shards(df, shards=3, bucket_bytes=4000)
    files = spark.read.parquet(at)
    most = max(r.n for r in files.selectExpr("shard", "bucket", "octet_length(doc.text) + 8 as n").groupBy("shard", "bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect())
    assert most < 4 * 4000
    back = sharding.read_shards(spark, at, df.schema)
    assert Counter(map(tuple, (r.doc for r in back.collect()))) == Counter(rows)
    order = [r.doc.doc_id for r in back.where("shard = 0").orderBy("slot").collect()]
    assert order != sorted(order)
    assert hashlib.sha256(str(sorted(order)).encode()).digest() == hashlib.sha256(str(sorted(i for i, *_ in rows if named_shard(i, 3) == 0)).encode()).digest()


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_digests(spark.createDataFrame([], SHARD_DOCS)).count() == 0


def test_starts_of_buckets_over_several_slices(spark):
    n = {(s, b): (7 * b + s) % 5 for s in (0, 1) for b in range(0, 3 * sharding.SLICE, 251)}
    rows = spark.createDataFrame([(s, b) for (s, b), k in n.items() for _ in range(k)], "shard int, bucket bigint")
    for r in sharding.bucket_starts(rows).collect():
        assert r.start == sum(k for (s, b), k in n.items() if s == r.shard and b < r.bucket)


def test_map_page_round_trip():
    rows = valid_time._VERSION.empty_table()
    assert valid_time.unpack(valid_time.pack(rows), valid_time._VERSION).equals(rows) and valid_time.unpack(b"", valid_time._VERSION).num_rows == 0
