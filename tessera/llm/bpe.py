"""Byte-pair encoding in linear time, and decoding.

A word is encoded from left to right. Aho-Corasick over the reversed tokens gives the
longest token that starts at each place; the encoder takes it if the pair with the token
before it is compatible (the merges, run on the two tokens side by side, give back these
two tokens), else the next shorter token, else it steps back. Places that cannot lead to an
end are marked, so no place is tried twice. A sequence whose neighbours are all compatible is
the one that the merges give. Decoding copies byte ranges by a table of token offsets.

All distinct new words of a batch are encoded together, one numpy operation for a step of all
of them; words seen before come from a table of bounded bytes. Letters, numbers and normal forms
are those of Python's Unicode tables; texts with characters on which other versions of these tables
may differ (not assigned in Python's, or marks that are younger than Unicode 3.2) are normalized
and cut into words by the library itself, and encoded as the others are.

Defined results: null or empty text gives no ids; special tokens inside a text are found as the
library finds them by default; long texts are handled in whole (the words of one text are held
at once); equal texts and repeated rows have equal ids; ties between merges go to the first as the
vocabulary orders them; nothing depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from .common import StaticMap, held, spans

# Fixed values of the two vocabularies' pre-tokenizers: white space, and the contractions.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


BMP = 0x10000  # a class with higher code points is slow to miss, so texts without any get one without
HIGHER = re.compile("[\U00010000-\U0010ffff]")


def _ranges(wanted: list[bool]) -> str:
    """A character class of the code points wanted, as ranges."""
    change = np.flatnonzero(np.diff(np.array([False, *wanted, False], dtype=np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in change.reshape(-1, 2).tolist())


@lru_cache(2)
def _classes(below: int = sys.maxunicode + 1) -> tuple[str, str]:
    """Character classes of letters and of numbers, of code points below a number."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(below)]
    return _ranges([k == "L" for k in kinds]), _ranges([k == "N" for k in kinds])


def letters(below: int = sys.maxunicode + 1) -> str:
    """The character class of letters (category L), as ranges."""
    return _classes(below)[0]


@lru_cache(4)
def _unsure(normal_forms: bool, below: int = sys.maxunicode + 1) -> str:
    """The characters on which versions of the Unicode tables may differ: those that Python's
    don't have and, where normal forms count, marks and composites that version 3.2 didn't have."""
    old = unicodedata.ucd_3_2_0

    def young(c: str) -> bool:
        kind = unicodedata.category(c)
        if kind == "Cn":
            return True
        return normal_forms and old.category(c) == "Cn" and (kind[0] == "M" or unicodedata.normalize("NFD", c) != c)

    return _ranges([young(chr(c)) for c in range(below)])


def _pattern(kind: str, below: int) -> re.Pattern:
    """The words of texts whose code points are below a number."""
    l, n = ("A-Za-z", "0-9") if below == 128 else _classes(below)
    s = " \\t-\\r" if below == 128 else SPACES
    if kind == "byte":
        return re.compile(f" ?[{l}]+|{CONTRACTIONS}| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+")
    return re.compile(f"[{l}]+|{CONTRACTIONS}|[{n}]|[^{s}{l}{n}]+")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


WORD, SPECIAL = 1 << 40, 1 << 41  # added to numbers of words, and to special ids
RUNS = re.compile(f"[{SPACES}]{{2}}|^[{SPACES}]|[{SPACES}]$")
ODD = re.compile("[\x1c-\x1f]")  # white space to Python, but not to the vocabularies


class Seen(dict):
    """Numbers of strings; a new one gets the next number and is noted for encoding."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class Known:
    """Strings with the ids of each."""

    def __init__(self):
        self.seen, self.chars = Seen(), 0
        self.flat, self.n_flat = np.empty(1 << 16, dtype=np.int32), 0
        self.at, self.n = np.zeros(1 << 16, dtype=np.int64), 0

    def take(self) -> list[str]:
        new, self.seen.new = self.seen.new, []
        self.chars += sum(map(sys.getsizeof, new))
        return new

    @property
    def bytes(self) -> int:
        """About the memory that the strings, their numbers and ids take."""
        return self.chars + 130 * len(self.seen) + self.flat.nbytes + self.at.nbytes

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(counts) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.at[self.n + 1 : self.n + 1 + len(counts)] = self.n_flat + np.cumsum(counts)
        self.n_flat += len(ids)
        self.n += len(counts)

    def spans_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.at[number]
        return start, self.at[number + 1] - start


class Encoder:
    """Tables of one vocabulary. Symbols: a byte, plus 256 if it ends its word (in
    vocabularies that mark word ends). Tokens are numbered as in the vocabulary."""

    def __init__(self, path: str, kept: int = 112 << 20):
        """``kept``: the words seen before are forgotten when they take more bytes than this."""
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.suffix, self.kind = bool(suffix), "word" if suffix else "byte"
        self.kept = kept
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.n_tokens = max([*vocab.values(), *self.special.values()]) + 1

        def symbols(piece: str) -> tuple[int, ...]:
            if suffix and piece.endswith(suffix) and len(piece) > len(suffix):
                own = [byte_of[c] for c in piece[: -len(suffix)]]
                return (*own[:-1], own[-1] + 256)
            return tuple(byte_of[c] for c in piece)

        strings: list[tuple[int, ...] | None] = [None] * self.n_tokens
        for piece, i in vocab.items():
            if piece not in self.special:
                strings[i] = symbols(piece)
        self.length = np.array([len(s) if s else 0 for s in strings], dtype=np.int32)
        # Merges: of the tokens that a merge makes, its rank and halves; the others are single symbols.
        pairs = [(vocab[a], vocab[b], vocab[a + b.removeprefix(model.get("continuing_subword_prefix") or "")]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.rank = np.full(self.n_tokens, -1, dtype=np.int64)
        self.left, self.right = np.full(self.n_tokens, -1, dtype=np.int64), np.full(self.n_tokens, -1, dtype=np.int64)
        for rank, (a, b, made) in enumerate(pairs):
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        self.merge = StaticMap(np.array([a * self.n_tokens + b for a, b, _ in pairs]), np.arange(len(pairs), dtype=np.int32))
        self.single = np.full(512, -1, dtype=np.int64)
        for i, s in enumerate(strings):
            if s and len(s) == 1:
                self.single[s[0]] = i
        by_string = {s: i for i, s in enumerate(strings) if s and (len(s) == 1 or self.rank[i] >= 0)}
        # The longest token that is a proper beginning of a token.
        self.shorter = np.full(self.n_tokens, -1, dtype=np.int64)
        for s, i in by_string.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := by_string.get(s[:n])) is not None:
                    self.shorter[i] = j
                    break
        self._automaton(by_string)
        self.known = np.full(1 << 20, -1, dtype=np.int64)  # pairs whose answer is known, one a slot
        self.answer = np.zeros(1 << 20, dtype=bool)
        special = sorted(self.special, key=len, reverse=True)
        self.find_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.split, self.split_bmp, self.split_ascii = (_pattern(self.kind, below) for below in (sys.maxunicode + 1, BMP, 128))
        self.unsure, self.unsure_bmp = (re.compile(f"[{_unsure(self.suffix, below)}]") for below in (sys.maxunicode + 1, BMP))
        self.joined = spec.get("decoder") is None  # else the byte-level decoder
        self.names = {i: s for s, i in (vocab | self.special).items()} if self.joined else {}
        self._offsets(strings)
        self._forget()

    # -- Aho-Corasick over reversed tokens ------------------------------------------------
    def _automaton(self, by_string: dict[tuple[int, ...], int]) -> None:
        go: dict[int, int] = {}
        token = [-1]
        depth_of: list[int] = [0]
        last: list[tuple[int, int]] = [(0, 0)]  # parent, symbol
        for s, i in by_string.items():
            node = 0
            for c in reversed(s):
                key = node * 512 + c
                if (to := go.get(key)) is None:
                    to = go[key] = len(token)
                    token.append(-1)
                    depth_of.append(depth_of[node] + 1)
                    last.append((node, c))
                node = to
            token[node] = i
        n = len(token)
        fail, best = [0] * n, list(token)
        for node in sorted(range(1, n), key=depth_of.__getitem__):
            parent, c = last[node]
            if parent:
                at = fail[parent]
                while (to := go.get(at * 512 + c)) is None and at:
                    at = fail[at]
                fail[node] = to or 0
            if best[node] < 0:
                best[node] = best[fail[node]]
        self.go = StaticMap(np.fromiter(go.keys(), np.int64, len(go)), np.fromiter(go.values(), np.int32, len(go)))
        self.fail, self.best = np.array(fail, dtype=np.int64), np.array(best, dtype=np.int64)

    def _longest(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each place of each word the longest token that starts there."""
        out = np.empty(len(text), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends, sizes = (starts + lengths)[order], lengths[order]
        state = np.zeros(len(order), dtype=np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        for step, n in enumerate(active.tolist()):
            at = ends[:n] - 1 - step
            c = text[at]
            now = state[:n]
            to = self.go.get(now * 512 + c).astype(np.int64)
            left = np.flatnonzero((to < 0) & (now > 0))
            while len(left):
                now[left] = self.fail[now[left]]
                to[left] = self.go.get(now[left] * 512 + c[left])
                left = left[(to[left] < 0) & (now[left] > 0)]
            np.maximum(to, 0, out=to)
            state[:n] = to
            out[at] = self.best[to]
        return out

    # -- compatible pairs -----------------------------------------------------------------
    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave a boundary between tokens ``a`` and ``b``. The merges are
        undone from the latest on, on either side of the boundary; the boundary falls where a
        merge across it comes before the one that made the part beside it."""
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        # a merge across with the rank of the last one undone counts as earlier if that was on the right
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.merge.get(x * self.n_tokens + y).astype(np.int64)
            lost = (across >= 0) & (2 * across < limit[live])
            out[live[lost]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            done = (rx < 0) & (ry < 0)
            limit[live] = np.where(undo_left, 2 * rx, 2 * ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~lost & ~done]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n_tokens + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.answer[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            said = self._decide(fresh // self.n_tokens, fresh % self.n_tokens)
            out[new] = said[back]
            put = slot[new]
            self.known[put] = key[new]
            self.answer[put] = said[back]
            # two keys for one slot: the last one's key stays, so its answer has to
            self.answer[put] = np.where(self.known[put] == key[new], said[back], self.answer[put])
            wrong = self.known[put] != key[new]
            if wrong.any():  # forget slots that several new keys wanted
                self.known[put[wrong]] = -1
        return out

    # -- encoding -------------------------------------------------------------------------
    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has. No empty words."""
        if not words:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        if self.suffix:
            text[starts + lengths - 1] += 256
        longest = self._longest(text, starts, lengths)
        ends = starts + lengths
        dead = np.zeros(len(text) + 1, dtype=bool)
        put = np.full(len(text), -1, dtype=np.int64)  # the token taken at a place
        before = np.full(len(text), -1, dtype=np.int64)  # the token that ends at a place
        lane = np.arange(len(words))
        pos, token = starts.copy(), longest[starts]
        while len(lane):
            stop = pos + self.length[token]
            prev = before[pos]
            ok = ~dead[stop] | (stop == ends[lane])
            check = np.flatnonzero(ok & (prev >= 0))
            if len(check):
                ok[check] = self.compatible(prev[check], token[check])
            taken, at = token[ok], pos[ok]
            put[at] = taken
            go_on = stop[ok] < ends[lane[ok]]
            inner = stop[ok][go_on]
            before[inner] = taken[go_on]
            # not taken: the next shorter one, or back to the token before
            no = np.flatnonzero(~ok)
            less = self.shorter[token[no]]
            back = no[less < 0]
            new_pos, new_token = pos.copy(), token.copy()
            new_token[no] = np.where(less >= 0, less, token[no])
            if len(back):
                dead[pos[back]] = True
                new_pos[back] = pos[back] - self.length[prev[back]]
                new_token[back] = prev[back]
            forward = np.flatnonzero(ok)[go_on]
            new_pos[forward] = inner
            new_token[forward] = longest[inner]
            keep = np.ones(len(lane), dtype=bool)
            keep[np.flatnonzero(ok)[~go_on]] = False
            lane, pos, token = lane[keep], new_pos[keep], new_token[keep]
        # follow the tokens taken from each start
        marked = np.zeros(len(text), dtype=bool)
        pos, stop = starts.copy(), ends
        while len(pos):
            marked[pos] = True
            pos = pos + self.length[put[pos]]
            live = pos < stop
            pos, stop = pos[live], stop[live]
        counts = np.add.reduceat(marked.astype(np.int64), starts)
        return put[marked].astype(np.int32), counts

    def _forget(self) -> None:
        self.words, self.parts = Known(), Known()

    def _clean(self, text: str) -> tuple[str, bool]:
        if text.isascii():
            return (text.lower() if self.suffix else text), True
        if self.suffix:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text, False

    def _pieces(self, text: str, ascii_only: bool) -> list[str]:
        return (self.split_ascii if ascii_only else self.split if HIGHER.search(text) else self.split_bmp).findall(text)

    def _by_library(self, text: str) -> list[str]:
        """The words of a text with unsure characters."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _units(self, text: str) -> list[np.ndarray]:
        """Numbers of the parts (between single spaces) of a text, or of its words where
        white space doesn't allow to look at parts by themselves."""
        if not text.isascii() and (self.unsure if HIGHER.search(text) else self.unsure_bmp).search(text):
            words = self._by_library(text)
            return [np.fromiter(map(self.words.seen.__getitem__, words), np.int64, len(words)) + WORD]
        text, ascii_only = self._clean(text)
        if self.suffix:
            if ODD.search(text) is None:
                parts = text.split()
                return [np.fromiter(map(self.parts.seen.__getitem__, parts), np.int64, len(parts))]
        elif RUNS.search(text) is None:
            first, *parts = text.split(" ")
            words = self._pieces(first, ascii_only)
            return [np.fromiter(map(self.words.seen.__getitem__, words), np.int64, len(words)) + WORD, np.fromiter(map(self.parts.seen.__getitem__, parts), np.int64, len(parts))]
        words = self._pieces(text, ascii_only)
        return [np.fromiter(map(self.words.seen.__getitem__, words), np.int64, len(words)) + WORD]

    def _learn(self) -> None:
        """Encodes what is new: words together, parts by their words."""
        lead = "" if self.suffix else " "
        new, of_part, counts = self.parts.take(), [], []
        for part in new:
            if part.isalpha():  # one word
                of_part.append(self.words.seen[lead + part])
                counts.append(1)
                continue
            words = self._pieces(lead + part, part.isascii())
            of_part.extend(map(self.words.seen.__getitem__, words))
            counts.append(len(words))
        if words := self.words.take():
            self.words.add(*self.encode_words([w.encode() for w in words]))
        if new:
            start, size = self.words.spans_of(np.array(of_part, dtype=np.int64))
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
            self.parts.add(self.words.flat[spans(size, start)], np.diff(ends))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if self.words.bytes + self.parts.bytes > self.kept:
            self._forget()
        units: list[np.ndarray] = []
        per_text = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            begin = len(units)
            if self.find_special is not None and "<|" in text and len(cut := self.find_special.split(text)) > 1:
                for k, piece in enumerate(cut):
                    if k % 2:
                        units.append(np.array([SPECIAL + self.special[piece]]))
                    elif piece:
                        units.extend(self._units(piece))
            else:
                units.extend(self._units(text))
            per_text[i] = sum(map(len, units[begin:]))
        self._learn()
        unit = np.concatenate(units) if units else np.empty(0, dtype=np.int64)
        odd = unit >= WORD
        start, size = self.parts.spans_of(np.where(odd, 0, unit))
        flat = self.parts.flat
        if odd.any():
            at = np.flatnonzero(odd & (unit < SPECIAL))
            w_start, size[at] = self.words.spans_of(unit[at] - WORD)
            start[at] = w_start + self.parts.n_flat
            flat = np.concatenate([flat[: self.parts.n_flat], self.words.flat[: self.words.n_flat]])
            at = np.flatnonzero(unit >= SPECIAL)
            size[at] = 1
            start[at] = len(flat) + np.arange(len(at))
            flat = np.concatenate([flat, (unit[at] - SPECIAL).astype(np.int32)])
        ids = flat[spans(size, start)]
        total = np.concatenate([[0], np.cumsum(size)])
        cuts = np.concatenate([[0], np.cumsum(per_text)])
        return ids, total[cuts[1:]] - total[cuts[:-1]]

    # -- decoding -------------------------------------------------------------------------
    def _offsets(self, strings: list[tuple[int, ...] | None]) -> None:
        names = {i: s.encode() for s, i in self.special.items()}
        raw = [names.get(i) or bytes(c & 255 for c in (s or ())) for i, s in enumerate(strings)]
        self.bytes_of = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(r) for r in raw])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, by the table of offsets; numbers that aren't ids give none. A
        vocabulary whose file names no decoder gives its tokens as written there, with spaces between."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < self.n_tokens)]
        if self.joined:
            return " ".join(self.names[i] for i in ids.tolist() if i in self.names).encode()
        start = self.offset[ids]
        return self.bytes_of[spans(self.offset[ids + 1] - start, start)].tobytes()


def encoder(path: str) -> Encoder:
    """One encoder a worker process, of the vocabulary used last."""
    return held(("bpe", path), lambda: Encoder(path))


# -- operators ----------------------------------------------------------------------------
OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def bpe_encode(df, path: str, want=("ids", "n_tokens"), id_col: str = "doc_id", text_col: str = "text"):
    """Encodes a text column and, where asked for, decodes the ids again.

    Returns ``id_col`` and the columns named in ``want``, of ``ids``, ``n_tokens``,
    ``decoded`` (the text that the ids give), ``ids_sha256`` (of the decimal ids joined by
    commas) and ``decoded_sha256``. One row a row: repeated rows and null ids are kept, null
    text counts as empty (no ids), an empty table gives an empty one. Other columns of
    ``df``, whatever their names, are not carried."""
    import hashlib

    import pyarrow as pa
    from pyspark.sql import functions as F

    from .common import lists, map_arrow

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, " + ", ".join(f"{w} {OUTPUTS[w]}" for w in want)

    def start():
        enc = encoder(path)
        decimal = [b"%d" % i for i in range(enc.n_tokens)] if "ids_sha256" in want else []

        def make(batch):
            ids, counts = enc.encode(batch.column("text").to_pylist())
            cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
            each = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            made = {"ids": lambda: lists(ids, counts), "n_tokens": lambda: counts}
            if "decoded" in want or "decoded_sha256" in want:
                raw = [enc.decode(x) for x in each]
                made["decoded"] = lambda: pa.array([r.decode(errors="replace") for r in raw], pa.string())
                made["decoded_sha256"] = lambda: [hashlib.sha256(r).hexdigest() for r in raw]
            made["ids_sha256"] = lambda: [hashlib.sha256(b",".join(map(decimal.__getitem__, x.tolist()))).hexdigest() for x in each]
            return [batch.column("id"), *(made[w]() for w in want)]

        return make

    return map_arrow(rows, schema, start, holds=("bpe", path))


def bpe_decode(df, path: str, ids_col: str = "ids", id_col: str = "doc_id"):
    """Texts of lists of ids, as the library decodes them with special tokens: ``id_col`` and
    ``decoded``. A null list gives an empty text, null ids and numbers that aren't ids nothing, bytes
    that aren't UTF-8 the replacement character. Repeated rows and null ids of rows are kept, an
    empty table gives an empty one, other columns of ``df`` are not carried."""
    from pyspark.sql import functions as F

    from .common import map_arrow

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.array_compact(F.col(ids_col)), F.array().cast("array<int>")).alias("ids"))

    def start():
        enc = encoder(path)
        return lambda batch: [batch.column("id"), [enc.decode(np.asarray(x, dtype=np.int64)).decode(errors="replace") for x in batch.column("ids").to_pylist()]]

    return map_arrow(rows, f"`{id_col}` {dict(df.dtypes)[id_col]}, decoded string", start, by=None, holds=("bpe", path))
