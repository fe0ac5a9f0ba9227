"""Near-duplicate documents by MinHash.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (of all words, if it
has fewer). 128 universal hash functions give its signature; 32 bands of 4 minima give its
buckets: a pair at similarity 0.75 misses all of them with probability 5e-6, one at 0.85 with
1e-10. Documents with equal sets stand for one node. Within a bucket all members are first
checked against its centre, so a large group of copies costs one pair a member; the links
found join nodes to components, and only pairs of members in different components are left.
These are compared by signature, in blocks of bounded size, inside tasks, each pair in the first
bucket it shares. Every pair that
passes by its signature (a linked pair fails with probability under 1e-7) is confirmed on the
full sets, and components come from alternating large-star and small-star.

Defined results: a document without words (null or empty text) has an empty set, is linked
with nothing and is its own component; repeated rows and rows with one id are kept, each with
the component of its text; rows with a null id take part, with the smallest id they reach (null
if none has one), and are never kept; very long texts are taken in whole; a similarity of exactly the
threshold is a link; an empty table gives an empty one; other columns of the
input, whatever their names, are not read. Sets are told apart by 64-bit sums of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import drop_written, give_back, let_go, map_arrow, mix64, small_batches, written
from .components import connected_components

WORDS, HASHES, BANDS = 5, 128, 32
#: Of 128 equal minima a pair has at least so many, or isn't looked at: 5.3 standard deviations under 96.
SIGNATURE_LEAST = 70
BLOCK = 256
#: Up to so many ids (8 bytes each) are broadcast to find their texts; more are joined.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240601)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_PLACE = _rng.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix64(np.arange(1, BANDS + 1))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. bytes.lower and bytes.split know just
    A-Z and the six ASCII white-space bytes."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    total = np.full(n - size + 1, size, dtype=np.uint64) * _PLACE[WORDS]
    for k in range(size):
        total += w[k : n - size + 1 + k] * _PLACE[k]
    return np.unique(mix64(total))


def signature(found: np.ndarray) -> np.ndarray:
    """The minima of a set under all hash functions."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[None, at : at + 2048] * _MULTIPLY + _ADD).min(axis=1), out=out)
    return out


def set_key(found: np.ndarray) -> int | None:
    return int(mix64(found + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)) if len(found) else None


def with_set_keys(docs: DataFrame, text_col: str = "text", name: str = "k") -> DataFrame:
    """Adds the key of each row's set as column ``name``, which ``docs`` must not have."""

    def start():
        hashes = WordHashes()
        return lambda batch: [*batch.columns, [set_key(shingles(text, hashes)) for text in batch.column(text_col).to_pylist()]]

    return map_arrow(docs, StructType([*docs.schema.fields, StructField(name, LongType())]), start, text_col)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (size of the set), k (the set's key, null if empty), sig (128 minima)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def start():
        hashes = WordHashes()

        def make(batch):
            n, keys, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, hashes)
                n.append(len(found))
                keys.append(set_key(found))
                sigs.append(signature(found).tobytes() if len(found) else None)
            return [batch.column("id"), n, pa.array(keys, pa.int64()), pa.array(sigs, pa.binary())]

        return make

    return map_arrow(rows, "doc_id bigint, n bigint, k bigint, sig binary", start)


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a batch as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), HASHES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The bucket of each signature in each band."""
    parts = sig.astype(np.uint64).reshape(-1, BANDS, HASHES // BANDS)
    key = np.broadcast_to(_BAND, parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        key = mix64(key + parts[:, :, j])
    return key.astype(np.int64)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least so many percent."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _bands(nodes: DataFrame) -> DataFrame:
    def start():
        def make(batch):
            return [band_keys(_matrix(batch.column("sig"))).reshape(-1), np.repeat(batch.column("k").to_numpy(), BANDS)]

        return make

    return map_arrow(nodes.select("k", "sig"), "key bigint, k bigint", start, by="sig")


def _with_sides(pairs: DataFrame, table: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Pairs (a, b, salt) with columns of the table (k, ...) for either end. A centre's pairs are dealt by the
    salt too, and its row is copied to its salts, so a centre of many members isn't one task."""
    one = pairs.select("a", "salt").distinct().join(table.select(F.col("k").alias("a"), *[F.col(c).alias(x) for c, (x, _) in columns.items()]), "a")
    two = table.select(F.col("k").alias("b"), *[F.col(c).alias(y) for c, (_, y) in columns.items()])
    return pairs.join(one, ["a", "salt"]).join(two, "b")


def _near_by_signature(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b, salt) those that can be linked, by set sizes and signatures."""
    rows = _with_sides(pairs, nodes, {"n": ("na", "nb"), "sig": ("sa", "sb")}).where("least(na, nb) * 100 >= greatest(na, nb) * 75").select("a", "b", "salt", "sa", "sb")

    def start():
        def make(batch):
            ok = (_matrix(batch.column("sa")) == _matrix(batch.column("sb"))).sum(axis=1) >= SIGNATURE_LEAST
            keep = batch.filter(pa.array(ok))
            return [keep.column("a"), keep.column("b"), keep.column("salt")]

        return make

    return map_arrow(rows, "a bigint, b bigint, salt bigint", start, by="sa")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets (8 bytes a shingle) of the wanted nodes (k): k, found."""
    ids = nodes.join(wanted, "k", "left_semi").select("first_doc").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.join(ids, F.col("id").eqNullSafe(F.col("first_doc")), "left_semi")

    def start():
        hashes = WordHashes()

        def make(batch):
            found = [shingles(t, hashes) for t in batch.column("text").to_pylist()]
            found = [f for f in found if len(f)]
            return [[int(mix64(f + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)) for f in found], pa.array([f.tobytes() for f in found], pa.binary())]

        return make

    made = map_arrow(rows, "k bigint, found binary", start)
    return made.join(wanted, "k", "left_semi").groupBy("k").agg(F.any_value("found").alias("found"))


def _confirm(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, salt) those whose full sets are similar enough: a, b."""
    sets = written(_sets(docs, nodes, pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()), "sets")
    rows = _with_sides(pairs, sets, {"found": ("fa", "fb")})

    def start():
        def make(batch):
            each = zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist())
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in each]
            keep = batch.filter(pa.array(ok, pa.bool_()))
            return [keep.column("a"), keep.column("b")]

        return make

    out = written(map_arrow(rows, "a bigint, b bigint", start, by="fa"), "confirmed")
    drop_written(sets)
    return out


def _grouped(rows: DataFrame, keys: tuple[str, ...], schema: pa.Schema, each) -> DataFrame:
    """``each(table)`` for every group of rows with equal keys, groups one after another in
    a task; it yields lists of output columns."""

    def out(held):
        if held:
            for columns in each(pa.Table.from_batches(held)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def run(batches):
        let_go()
        held: list[pa.RecordBatch] = []  # rows of the group that isn't over yet
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in keys])
            cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
            if held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in keys):
                cuts = [0, *cuts]
            begin = 0
            for cut in cuts:
                if cut > begin:
                    held.append(batch.slice(begin, cut - begin))
                yield from out(held)
                held, begin = [], cut
            held.append(batch.slice(begin))
        yield from out(held)
        give_back()

    names = ", ".join(f"{f.name} bigint" for f in schema)
    small_batches(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, names)


def _near_pairs(group: pa.Table):
    """Rows i and the rows beyond that are in another component and near by signature, each
    pair only in the first of the buckets that both are in."""
    block, comp = group.column("block").to_numpy(), group.column("component").to_numpy()
    sig, lo, hi = _matrix(group.column("sig")), group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    band = int(np.flatnonzero(band_keys(sig[:1])[0] == group.column("key")[0].as_py())[0])
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    for i in left.tolist():
        other = right[right > i] if lo == hi else right
        other = other[comp[other] != comp[i]]
        same = sig[other] == sig[i]
        near = same.sum(axis=1) >= SIGNATURE_LEAST
        other, same = other[near], same[near]
        if len(other):
            other = other[same.reshape(len(other), BANDS, -1).all(axis=2).argmax(axis=1) == band]
            if len(other):
                yield i, other


def _left_over(docs: DataFrame, members: DataFrame, nodes: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket, neither its centre, in different components. Those
    outside the bucket's largest component are compared with one another and with its members, block against block. A first pass finds the
    rows that are near any other by signature; with their full sets, a second pass confirms the
    pairs. A task leaves out pairs that its own links already connect, so it gives fewer links
    than it has rows."""
    now = members.join(joined.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("component", F.coalesce("component", "k")).where("k != centre")
    still = now.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("key")
    rest = now.join(still, "key").select("key", "k", "component")
    # members of a bucket's largest component meet the others alone, not one another
    sizes = rest.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"))
    sizes = sizes.select("key", F.col("top.component").alias("major"), F.expr(f"int(ceil((size - top.n) / {BLOCK}))").alias("minors"), F.expr(f"int(ceil(top.n / {BLOCK}))").alias("majors"))
    with_sig = nodes.select("k", "sig")
    placed = rest.join(with_sig, "k").join(sizes, "key").withColumn("in_major", F.expr("component = major"))  # before rows are copied to their blocks
    placed = placed.withColumn("block", F.expr("int(if(in_major, minors + pmod(xxhash64(k), majors), pmod(xxhash64(k), minors)))"))
    keys = ("key", "lo", "hi")
    dealt = placed.withColumn("other", F.explode(F.expr("sequence(0, if(in_major, minors, minors + majors) - 1)"))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "k", "component", "sig")

    def find(group: pa.Table):
        found = np.zeros(group.num_rows, dtype=bool)
        for i, other in _near_pairs(group):
            found[i] = True
            found[other] = True
        near = group.filter(pa.array(found))
        if near.num_rows:
            yield [near.column(c).combine_chunks() for c in ("key", "lo", "hi", "block", "k", "component")]

    names = ("key", "lo", "hi", "block", "k", "component")
    near = written(_grouped(dealt.select(*[F.col(c).cast("bigint").alias(c) for c in names], "sig"), keys, pa.schema([(c, pa.int64()) for c in names]), find), "near")
    sets = written(_sets(docs, nodes, near.select("k").distinct()), "sets")

    def confirm(group: pa.Table):
        k, comp = group.column("k").to_numpy(), group.column("component").to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in group.column("found").to_pylist()]
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while c in top:
                c = top[c]
            return c

        a, b = [], []
        for i, other in _near_pairs(group):
            for j in other.tolist():
                if (x := root(comp[i])) != (y := root(comp[j])) and similar(found[i], found[j], percent):
                    top[max(x, y)] = min(x, y)
                    a.append(k[i])
                    b.append(k[j])
        if a:
            yield [np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)]

    rows = near.join(with_sig, "k").join(sets, "k")
    links = written(_grouped(rows, keys, pa.schema([("a", pa.int64()), ("b", pa.int64())]), confirm), "links")
    drop_written(sets, near)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, with_set: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept; ``with_set`` also
    k, the key of the row's set, and part, which names its component apart from ids (both null without words)."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(signatures(docs, "id", "text"), "signatures")
    every = rows.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("first_doc"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    every = written(every, "nodes")
    bands = _bands(every)
    live = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = written(bands.join(live, "key"), "members")
    # The centre of a bucket is the member that meets the most others over all bands: the text that the others are copies of.
    meets = met.groupBy("k").agg(F.sum("size").alias("meets"))
    centres = met.select("key", "k").join(meets, "k").groupBy("key").agg(F.max(F.struct("meets", "k")).alias("top")).select("key", F.col("top.k").alias("centre"))
    members = written(met.join(centres, "key"), "members")
    drop_written(met)
    nodes = every.join(members.select("k").distinct(), "k", "left_semi")
    nodes = written(nodes, "candidates")
    pairs = members.where("k != centre").groupBy(F.col("centre").alias("a"), F.col("k").alias("b")).agg(F.max("size").alias("size"))
    pairs = pairs.select("a", "b", F.expr(f"pmod(xxhash64(b), int(ceil(size / {BLOCK})))").cast("bigint").alias("salt"))
    stars = written(_near_by_signature(pairs, nodes), "pairs")
    links = _confirm(docs, nodes, stars, percent)
    joined = connected_components(links)
    more = _left_over(docs, members, nodes, joined, percent)
    if not more.isEmpty():
        drop_written(joined)
        joined = connected_components(links.union(more))
    named = joined.join(nodes.select(F.col("k").alias("node"), "first_doc"), "node")
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("smallest"))
    by_node = named.join(smallest, "component").select(F.col("node").alias("k"), "smallest", "component")
    alone = every.select("k", "first_doc").join(by_node, "k", "left").select("k", F.coalesce("smallest", "first_doc").alias("component_id"), F.coalesce("component", "k").alias("part"))
    # rows without words aren't joined: as null keys they would all go to one task
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), "k")
    named = own.where("k is not null").join(alone, "k").select("doc_id", "n_shingles", "component_id", "k", "part")
    wordless = own.where("k is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "k", F.lit(None).cast("bigint").alias("part"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    out = written(named.union(wordless).select("doc_id", "n_shingles", "component_id", kept, *(["k", "part"] if with_set else [])), "near-duplicates")
    drop_written(rows, every, members, nodes, stars, links, joined, more)
    return out
