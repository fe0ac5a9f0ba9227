"""Language identification, words first.

The model has, for each language, log frequencies of whole words and of character n-grams of 5
to 1 characters (word edges included), both by 62-bit hashes, learned by counting a sample of
labelled documents. A known word scores by its log frequencies. An unseen word scores by its n-grams of
the greatest length at which at least half of them are known: the mean of their log frequencies.
A text's languages are compared by the sum over its words; the score is the best one's posterior
at the evidence of at most EVIDENCE words. Words are runs of letters (Unicode category L).

The fit reads a sample of the labelled documents of each language, chosen by a hash of the id: about
``per_language`` of them, or as many as hold ``chars`` characters if that is less. Every word and
n-gram of the sample counts; the model is sparse (a language takes room for what was seen
in it), so it and what the driver gathers are bounded by the sample of each language. All texts are scored in whole.

Defined results: null text or text without letters gives ``und`` with score 0; with nothing to learn
from, every text does; repeated rows, repeated ids and null ids are kept, each row by its text; ties
go to the first language by name; very long texts are scored by all their words; an empty table
gives an empty one; other columns of the input, whatever their names, are not carried by ``predict``, and all of them by ``keep``.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BMP, HIGHER, Seen, letters
from .common import crc_mod, held, map_arrow, mix64, spans

WHOLE, ORDERS = 0, (5, 4, 3, 2, 1)
EVIDENCE = 20
UNKNOWN = "und"
LETTERS, BMP_LETTERS, ASCII_LETTERS = re.compile(f"[{letters()}]+"), re.compile(f"[{letters(BMP)}]+"), re.compile("[a-z]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    return (ASCII_LETTERS if text.isascii() else LETTERS if HIGHER.search(text) else BMP_LETTERS).findall(text)


def keys(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words with a space on either side (WHOLE: of the words), and the
    number of the word of each."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer(" ".join(["", *(w + " " for w in words)]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(size) - size
    if order == WHOLE:
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        place = np.arange(int(size.sum())) - np.repeat(starts, size)
        key = mix64(np.add.reduceat(mix64(code[: len(place)] * _STEP + place.astype(np.uint64)), starts))
        return (key >> np.uint64(2)).astype(np.int64), np.arange(len(words))
    number = np.maximum(size - order + 1, 0)
    ends = np.cumsum(number)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - number), number)
    key = np.full(len(at), order, dtype=np.uint64)
    for k in range(order):
        key = mix64(key * _STEP + code[at + k])
    return (key >> np.uint64(2)).astype(np.int64), np.repeat(np.arange(len(words)), number)


class Counts:
    """Log frequencies by key and language, as sorted rows: a key's rows follow one another.
    ``base`` is the log frequency of what a language hasn't, ``more`` what a row adds to it."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int):
        order = np.lexsort((lang, key))
        key, self.lang, n = key[order], lang[order].astype(np.int16), n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
        self.key = key[first]
        self.first = np.append(first, len(key)).astype(np.int32)
        total = np.bincount(self.lang, weights=n, minlength=langs)
        self.base = np.log(0.5 / (total + 0.5 * max(1, len(first))))
        self.more = np.log(2.0 * n + 1).astype(np.float32)
        # keys are hashes, so the first bits of one tell about where it stands
        self.bits = max(1, int(len(first)).bit_length())
        self.about = np.searchsorted(self.key, np.arange(1 << self.bits, dtype=np.int64) << (62 - self.bits)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that aren't there."""
        if not len(self.key):
            return np.full(len(key), -1, dtype=np.int64)
        at = self.about[key >> (62 - self.bits)].astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            here = np.minimum(at[left], len(self.key) - 1)
            left = left[(at[left] < len(self.key)) & (self.key[here] < key[left])]
            at[left] += 1
        at = np.minimum(at, len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def sums(self, at: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The log frequencies at places (all there), summed by row: rows x languages."""
        size = (self.first[at + 1] - self.first[at]).astype(np.int64)
        entry = spans(size, self.first[at].astype(np.int64))
        k = len(self.base)
        out = np.bincount(np.repeat(row, size) * k + self.lang[entry], weights=self.more[entry], minlength=rows * k).reshape(rows, k)
        return out + np.bincount(row, minlength=rows)[:, None] * self.base


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 4000, chars: int = 32 << 20) -> dict:
    """The model from rows with text and language whose id has crc32 modulo 3 other than 1."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, 3) != 1)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = {r.lang: min(1.0, per_language / r.n, chars / max(1, r.size)) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()}  # a row a language
    langs = sorted(found)
    if not langs:
        return {"langs": []}
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(found[lang]))))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "text")
    column = {lang: i for i, lang in enumerate(langs)}

    def start():
        def make(batch):
            own: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own.setdefault(lang, Counter()).update(words_of(text.lower()))
            out = []
            for lang, c in own.items():
                words, n = list(c), np.fromiter(c.values(), np.int64, len(c))
                for order in (WHOLE, *ORDERS):
                    key, of = keys(words, order)
                    unique, back = np.unique(key, return_inverse=True)
                    total = np.bincount(back, weights=n[of], minlength=len(unique)).astype(np.int64)
                    out.append((np.full(len(unique), column[lang]), np.full(len(unique), order), unique, total))
            return [np.concatenate(c) for c in zip(*out)]

        return make

    counts = map_arrow(sample, "lang int, size int, key bigint, n bigint", start, most=1 << 19).groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # bounded by the sample
    lang, size, key, n = (found.column(c).to_numpy() for c in ("lang", "size", "key", "n"))
    return {"langs": langs, "name": uuid.uuid4().hex, "counts": {order: Counts(key[at], lang[at], n[at], len(langs)) for order in (WHOLE, *ORDERS) for at in [size == order]}}


class Scorer:
    """Scores texts; keeps the sums of parts (between white space) seen before, up to a bound."""

    def __init__(self, model: dict, kept: int = 32 << 20):
        """``kept``: the sums are forgotten when they and their parts take more bytes than this."""
        self.langs, self.kept = model["langs"], kept
        if self.langs:
            self.counts = model["counts"]
            self._begin()

    def _begin(self) -> None:
        self.parts, self.bytes = Seen(), 0
        self.sums = np.zeros((1024, len(self.langs) + 1), dtype=np.float32)  # by language, and the number of words

    def words(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words by language."""
        out = np.zeros((len(words), len(self.langs)))
        open_ = np.arange(len(words))
        for order in (WHOLE, *ORDERS):
            if not len(open_):
                break
            key, of = keys([words[i] for i in open_.tolist()], order)
            at = self.counts[order].find(key)
            hit = at >= 0
            known, every = (np.bincount(x, minlength=len(open_)) for x in (of[hit], of))
            use = (2 * known >= every) & (known > 0)
            total = self.counts[order].sums(at[hit], of[hit], len(open_))
            out[open_[use]] = total[use] / known[use, None]
            open_ = open_[~use]
        return out

    def _learn(self) -> None:
        new, self.parts.new = self.parts.new, []
        if not new:
            return
        self.bytes += sum(map(sys.getsizeof, new)) + 130 * len(new)
        found = [words_of(p) for p in new]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        number: dict[str, int] = {}
        rows = [number.setdefault(w, len(number)) for f in found for w in f]
        vectors = self.words(list(number))[rows] if rows else np.zeros((0, len(self.langs)))
        first = len(self.parts) - len(new)
        while len(self.parts) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        own = self.sums[first : len(self.parts)]
        own[:, -1] = counts
        if rows:
            full = counts > 0
            own[full, :-1] = np.add.reduceat(vectors, (np.cumsum(counts) - counts)[full], axis=0)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.bytes + self.sums.nbytes > self.kept:
            self._begin()
        units = []
        for t in texts:
            parts = t.lower().split() if t else []
            units.append(np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts)))
        self._learn()
        total = np.zeros((len(texts), len(self.langs) + 1))
        for i, u in enumerate(units):
            if len(u):
                total[i] = self.sums[u].sum(axis=0, dtype=np.float64)
        n = total[:, -1]
        logs = total[:, :-1] * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.langs[b] if m else UNKNOWN for b, m in zip(best.tolist(), n.tolist())], np.where(n > 0, p.max(axis=1), 0.0)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, lang_pred, score of every row, repeated ones too."""
    shared, model_name = docs.sparkSession.sparkContext.broadcast(model), model.get("name")  # bounded by the fit
    rows = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def start():
        scorer = held(("langid", model_name), lambda: Scorer(shared.value))

        def make(batch):
            lang, score = scorer.score(batch.column("text").to_pylist())
            return [batch.column("id"), batch.column("held_out"), lang, score]

        return make

    return map_arrow(rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double", start, holds=("langid", model_name))


def keep(docs: DataFrame, model: dict, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with at least this score, with all their columns."""
    shared, model_name = docs.sparkSession.sparkContext.broadcast(model), model.get("name")

    def start():
        scorer = held(("langid", model_name), lambda: Scorer(shared.value))

        def make(batch):
            lang, score = scorer.score(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            return batch.filter(pa.array((score >= least) & (np.array(lang) != UNKNOWN))).columns

        return make

    return map_arrow(docs, docs.schema, start, by=text_col, holds=("langid", model_name))
