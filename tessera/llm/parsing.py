"""Document fingerprints by locally consistent parsing.

Level by level, the names of a text (first its characters, with runs of one character named as
one) are cut into phrases. Deterministic coin tossing labels each name by the lowest bit in
which it differs from its left neighbour and that bit's value; three rounds leave labels under
8, and names whose label is a local maximum begin phrases. Where a phrase begins depends on
a few names around it alone, so equal substrings have equal phrases within, at any offset. A
phrase's name is a hash of its names and lengths; phrase names are the next level's input, up to
the level where one phrase is the whole text. A phrase has two names at least, so a text of n characters
has at most log2(n) levels. The fingerprint is the K smallest hashes of all phrases from level 2 on (of a
text of one phrase on level 1: that one), each name with its number among equal ones, and the likeness of two fingerprints estimates the Jaccard similarity of their
sets of phrases from the K smallest of their union.

Documents and their next ones meet by ranges of ids that hold about RANGE_BYTES of texts each, at
most RANGES of them; a range's rows are sorted, streamed and followed by the first row of the next range.

Defined results: null text is empty, whose fingerprint is the empty string; likeness of two
empty ones is 1, of an empty and another one 0; an empty table gives an empty one; rows with
a null id come first, with those of the least number there is; rows with one id are ordered by a hash of
their text, so they too are dealt to several ranges, and equal rows follow one another; the last document's next is
the first; very long texts are parsed in whole; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, map_arrow, mix64, written

K, FROM_LEVEL = 64, 2
#: Bytes of texts in a range, and the most ranges (16 bytes each on the driver and in every worker).
RANGE_BYTES, RANGES = 8 << 20, 100_000
_ONE, _LOW48 = np.uint64(1), np.uint64((1 << 48) - 1)
ROWS = 50_000
_POWER = mix64(np.arange(1, 4097)) | _ONE


def _labels(names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Labels under 8 that differ from their left neighbours'; ``begins``: where texts start."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[begins] = ~names[begins]
    differ = names ^ left
    low = differ & (~differ + _ONE)
    label = (np.bitwise_count(low - _ONE) * 2 + ((names & low) != 0)).astype(np.uint8)
    for _ in range(2):
        left8 = np.empty_like(label)
        left8[1:] = label[:-1]
        left8[begins] = label[begins] ^ 1
        differ = label ^ left8
        low8 = differ & (~differ + np.uint8(1))
        label = (np.bitwise_count(low8 - np.uint8(1)) * 2 + ((label & low8) != 0)).astype(np.uint8)
    return label


def _names_of(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name for each run of names between starts, by content and order."""
    size = np.diff(np.append(starts, len(names)))
    place = np.arange(len(names)) - np.repeat(starts, size)
    return mix64(np.add.reduceat(names * _POWER[place & 4095], starts) + size.astype(np.uint64))


def _level(names: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and text starts of the next level."""
    # equal neighbours become one name with the run's length
    change = np.ones(len(names), dtype=bool)
    change[1:] = names[1:] != names[:-1]
    change[begins] = True
    if not change.all():
        runs = np.flatnonzero(change)
        size = np.diff(np.append(runs, len(names))).astype(np.uint64)
        number = np.cumsum(change) - 1
        begins = number[begins]
        names = np.where(size > 1, mix64(names[runs] + size * _POWER[7]), names[runs])
    label = _labels(names, begins)
    first = np.zeros(len(names), dtype=bool)
    if len(label) > 2:
        first[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    first[begins] = True
    first[np.append(begins[1:], len(names)) - 1] = False  # nor does the last name begin one: what follows is another text
    second = begins + 1
    first[second[second < len(names)]] = False  # no phrase of one name at a text's start
    first[begins] = True
    starts = np.flatnonzero(first)
    return _names_of(names, starts), np.searchsorted(starts, begins)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The K smallest hashes of phrase names (48 bits each), ascending, of every text."""
    if len(texts) > ROWS:
        return fingerprints(texts[:ROWS]) + fingerprints(texts[ROWS:])
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(texts)
    which = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
    if not len(which):
        return out
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(texts[i]) for i in which], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    names = mix64(code.astype(np.uint64) + _ONE)
    gathered = []
    text, level = np.arange(len(which)), 0
    while len(text):
        names, begins = _level(names, begins)
        level += 1
        count = np.diff(np.append(begins, len(names)))
        row = np.repeat(np.arange(len(text)), count)
        # on the levels that aren't gathered, texts of one phrase already: that phrase stands for them
        take = np.ones(len(names), dtype=bool) if level >= FROM_LEVEL else count[row] == 1
        gathered.append((text[row[take]], names[take]))
        more = count > 1  # texts of one phrase are done
        names, text = names[more[row]], text[more]
        begins = np.cumsum(count[more]) - count[more]
    row, name = (np.concatenate(x) for x in zip(*gathered))
    # one sorted word for each phrase: 16 bits for the text (a batch has fewer), 48 for the name
    key = np.sort(row.astype(np.uint64) << np.uint64(48) | mix64(name) >> np.uint64(16))
    # a phrase's second, third, ... occurrence in a text counts as another one
    again = np.zeros(len(key), dtype=bool)
    again[1:] = key[1:] == key[:-1]
    if again.any():
        runs = np.flatnonzero(~again)
        at = np.flatnonzero(again)
        nth = at - runs[np.searchsorted(runs, at) - 1]
        key[at] = key[at] & ~_LOW48 | mix64((key[at] & _LOW48) + nth.astype(np.uint64) * _POWER[11]) >> np.uint64(16)
        key = np.sort(key)
        key = key[np.append(True, key[1:] != key[:-1])]
    name = key & _LOW48
    at = np.searchsorted(key, np.arange(len(which) + 1, dtype=np.uint64) << np.uint64(48))
    for k, i in enumerate(which.tolist()):
        out[i] = name[at[k] : min(at[k + 1], at[k] + K)]
    return out


def text_of(fingerprint: np.ndarray) -> str:
    return "".join(f"{x:012x}" for x in fingerprint.tolist())


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of the K smallest of both that both have."""
    if not len(x) and not len(y):
        return 1.0
    union = np.union1d(x, y)[:K]
    both = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many characters of the next text, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every text, one row a row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, "doc_id bigint, fingerprint string", lambda: lambda b: [b.column("id"), [text_of(f) for f in fingerprints([t or "" for t in b.column("text").to_pylist()])]])


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (id, text, copy) dealt out by ranges of ids, a partition each, in order; behind its own
    rows a range has those that may come next, with copy 1. Documents move once."""
    spark = docs.sparkSession
    docs = docs.withColumn("key", F.coalesce("id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    slim = written(docs.select("key", "h", F.octet_length("text").alias("bytes")), "ids")
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    n = min(RANGES, max(1, -(-total // RANGE_BYTES)))
    at = slim.repartitionByRange(n, "key", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "h")).alias("head"))
    heads = sorted((r["head"].key, r["head"].h) for r in at.collect())  # a row a range
    drop_written(slim)
    key, h = (np.array([x[i] for x in heads], dtype=np.int64) for i in (0, 1))
    shared = spark.sparkContext.broadcast((key, h))

    @F.pandas_udf("bucket int, head boolean")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        (key, h), own, fine = shared.value, ids.to_numpy(), hashes.to_numpy()
        first, bucket = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
        for i in np.flatnonzero(bucket > first).tolist():  # ranges that begin at this id
            bucket[i] = first[i] + np.searchsorted(h[first[i] : bucket[i]], fine[i], "right")
        bucket -= 1
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "head": (key[bucket] == own) & (h[bucket] == fine)})

    last = max(0, len(heads) - 1)
    own = F.struct(F.col("place.bucket").alias("bucket"), F.lit(0).alias("copy"))
    before = F.struct(F.when(F.col("place.bucket") == 0, last).otherwise(F.col("place.bucket") - 1).alias("bucket"), F.lit(1).alias("copy"))
    dealt = docs.withColumn("place", place("key", "h")).withColumn("to", F.explode(F.when(F.col("place.head"), F.array(own, before)).otherwise(F.array(own))))
    return dealt.repartitionById(last + 1, F.col("to.bucket")).select("id", "text", F.col("to.copy").alias("copy"), "key", "h").sortWithinPartitions("copy", "key", "h", "text").select("id", "text", "copy")


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (whose last quarter comes from the next
    document by id) and the likeness to both: columns of ``SCHEMA``."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs)

    def start():
        held: list[tuple] = []  # the last row, which waits for its next

        def make(batch):
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("id", "text", "copy"))))
            held[:] = rows[-1:]
            n = sum(not copy for _, _, copy in rows[:-1])  # copies stand behind all others
            if not n:
                return None
            ids, texts, _ = zip(*rows[: n + 1])
            cut = [edited(t, f) for t, f in zip(texts, texts[1:])]
            prints = fingerprints([*texts, *cut])
            own, mixed = prints[: n + 1], prints[n + 1 :]
            return [ids[:n], [len(t) for t in texts[:n]], [hashlib.sha256(c.encode()).hexdigest() for c in cut], [text_of(f) for f in own[:n]], [text_of(f) for f in mixed], [likeness(x, y) for x, y in zip(own, mixed)], [likeness(x, y) for x, y in zip(own, own[1:])]]

        return make

    return map_arrow(rows, SCHEMA, start)
