"""Token counts by a finite-state transducer compiled from a piece vocabulary.

The vocabulary's merges (a pair of neighbours joins if it spells a piece, best score first) are
compiled to a deterministic transducer over characters. A state holds, for each suffix of the
input that may still grow into a piece, the suffix's place in the trie of pieces, the last
piece of what stands before it and the number of pieces before it, relative to the whole. The
piece that ends at a character is the one whose neighbour to the left is compatible: merging
the two side by side gives back the two. Each transition is annotated with the tokens it adds
(fewer than none where a longer piece replaces several). A pair of characters that no piece
holds side by side parts the input: the state behind it is the start state. Transitions are
compiled when first met, into a table of at most ``cells`` cells (and a row for each state that a chunk
of the batch is in); when it is full, also within a batch, it is begun anew with those states.

A text is cut in chunks, if possible at partings; such a chunk's map from entry state to exit
state and count is a constant. The map of a chunk without a parting at its start is made for the
states that can reach it: the start state, and the exits of the chunk before it for all of its own
entries, until no exit is new; all chunks of a batch take their steps together. The maps of
neighbouring chunks are then composed by a parallel prefix scan: maps over 1, 2, 4, ... chunks,
each of them two of the one before, lead every chunk to its entry state. A document's
tokens are differences of the prefix sum of the chunks' counts.

Defined results: null or empty text has no tokens; characters without piece count as their
UTF-8 bytes (byte fallback); very long texts are counted in whole; of equally good pairs the
first is merged; repeated rows, repeated ids and null ids are kept; an empty table gives an
empty one; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_arrow

SPACE = "▁"
NONE = -1
BITS = 8  # of a cell for the tokens that a transition adds, as a number from -128 to 127
HALF = 1 << (BITS - 1)


def read_pieces(path: str) -> dict[str, float]:
    """Normal pieces and scores; checks that the model is of the kind compiled here."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    kinds = {p.type for p in model.pieces}
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or kinds - {1, 2, 3, 6}:
        raise ValueError("only BPE pieces with byte fallback, identity normalization and a dummy prefix")
    return {p.piece: p.score for p in model.pieces if p.type == 1}


class Transducer:
    def __init__(self, path: str, chunk: int = 256, cells: int = 24_000_000):
        """``chunk``: characters; ``cells``: of the table, 4 bytes each."""
        self.pieces, self.chunk, self.cells = read_pieces(path), chunk, cells
        self.go: dict[tuple[int, str], int] = {}
        self.node_piece: list[str | None] = [None]
        self.inner = [True]
        for piece in self.pieces:
            node = 0
            for c in piece:
                self.inner[node] = True
                if (to := self.go.get((node, c))) is None:
                    to = self.go[node, c] = len(self.inner)
                    self.inner.append(False)
                    self.node_piece.append(None)
                node = to
            self.node_piece[node] = piece
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self.named = list(self.pieces)
        self.real: dict[str, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # Classes of characters: 1.. for those of pieces; 0 isn't used; the rest by UTF-8 length.
        known = sorted({c for p in self.pieces for c in p})
        self.n_known = len(known) + 1
        self.class_of = np.zeros(0x110000, dtype=np.int16)
        for k, upto in enumerate((0x80, 0x800, 0x10000, 0x110000)):
            self.class_of[(0, 0x80, 0x800, 0x10000)[k] : upto] = self.n_known + k
        for i, c in enumerate(known):
            self.class_of[ord(c)] = i + 1
        self.class_of[ord(" ")] = self.class_of[ord(SPACE)]
        self.chars = ["", *known]
        self.n_classes = self.n_known + 4
        side = np.zeros((self.n_classes, self.n_classes), dtype=bool)
        for p in self.pieces:
            for a, b in zip(p, p[1:]):
                side[self.class_of[ord(a)], self.class_of[ord(b)]] = True
        self.parts = ~side
        self._begin()

    def _begin(self) -> None:
        self.column = np.full(self.n_classes, -1, dtype=np.int64)  # of a class among those met
        self.classes: list[int] = []
        self.table = np.full((1024, 64), -1, dtype=np.int32)  # next state << BITS, and tokens + HALF
        self.live: list[np.ndarray] = []  # arrays of states that have to outlast the table
        self._enter([])

    def _enter(self, states: list[tuple]) -> None:
        """Begins the table anew with the start state and these."""
        start = ((0, NONE, 0),)
        self.entries = list(dict.fromkeys([start, *states]))
        self.states = {s: i for i, s in enumerate(self.entries)}
        width = self.table.shape[1]
        rows = max(1024, len(self.entries) + 1)
        self.most = max(self.cells // width, len(self.entries) + 256)
        self.table = np.full((rows, width), -1, dtype=np.int32)

    def _renew(self, arrays: list[np.ndarray]) -> None:
        """Begins the table anew with the states in ``arrays``, which get their new numbers."""
        used = np.unique(np.concatenate(arrays))
        kept = [self.entries[i] for i in used.tolist()]
        self._enter(kept)
        number = np.array([self.states[s] for s in kept], dtype=np.int64)
        for a in arrays:
            a[:] = number[np.searchsorted(used, a)]

    # -- compilation ----------------------------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """The merges by definition: the best-scored pair of neighbours, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(self.pieces.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            score, i = max(scored)
            if score == -np.inf:
                break
            parts[-i : 2 - i] = ["".join(parts[-i : 2 - i])]
        return parts

    def _reached(self, piece: str) -> bool:
        if (known := self.real.get(piece)) is None:
            known = self.real[piece] = self.merged(piece) == [piece]
        return known

    def _compatible(self, a: int, b: int) -> bool:
        if a == NONE:
            return True
        if (known := self.fits.get((a, b))) is None:
            x, y = self.named[a], self.named[b]
            known = self.fits[a, b] = self.merged(x + y) == [x, y]
        return known

    def _compile(self, state: int, c: str) -> tuple[tuple, int]:
        grown, last, count = [], None, 0
        for node, before, n in self.entries[state]:
            to = self.go.get((node, c))
            if to is None:
                continue
            piece = self.node_piece[to]
            if last is None and piece is not None and self._reached(piece) and self._compatible(before, self.number[piece]):
                last, count = self.number[piece], n + 1
            if self.inner[to]:
                grown.append((to, before, n))
        if last is None:
            raise ValueError(f"no piece ends at {c!r}")
        return (*((node, before, n - count) for node, before, n in grown), (0, last, 0)), count

    def _fill(self, state: np.ndarray, column: np.ndarray, running: np.ndarray) -> None:
        """Compiles transitions; where the table gets full, states are numbered anew instead."""
        for s, k in np.unique(np.stack([state, column], axis=1), axis=0).tolist():
            if len(self.entries) >= self.most:
                return self._renew([running, *self.live])
            to, count = self._compile(s, self.chars[self.classes[k]])
            if not -HALF <= count < HALF:
                raise ValueError(f"a transition adds {count} tokens, which doesn't fit a cell")
            if (number := self.states.get(to)) is None:
                number = self.states[to] = len(self.entries)
                self.entries.append(to)
                if number >= len(self.table):
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table[s, k] = (number << BITS) + count + HALF

    def _columns(self, classes: np.ndarray) -> np.ndarray:
        """Table columns of the classes, at the start of a batch."""
        met = np.unique(classes)
        more = len(self.classes) + int((self.column[met] < 0).sum())
        width = max(64, 1 << (more - 1).bit_length())
        if width > self.table.shape[1]:
            if width * len(self.entries) > self.cells:
                self._begin()
                width = max(64, 1 << (len(met) - 1).bit_length())
            if width > self.table.shape[1]:
                wider = np.full((len(self.table), width), -1, dtype=np.int32)
                wider[:, : self.table.shape[1]] = self.table
                self.table, self.most = wider, max(self.cells // width, len(self.entries) + 256)
        for k in met[self.column[met] < 0].tolist():
            self.column[k] = len(self.classes)
            self.classes.append(k)
        return self.column[classes]

    # -- running --------------------------------------------------------------------------
    def _run(self, column: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of chunks; ``part`` says where the state is the start state
        before the character is read."""
        order = np.argsort(-size, kind="stable")
        start, sizes = start[order], size[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(order), dtype=np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        for step, n in enumerate(active.tolist()):
            at = start[:n] + step
            k = column[at]
            now = np.where(part[at], 0, state[:n])
            to = self.table[now, k]
            while (new := to < 0).any():
                self._fill(now[new], k[new], state)
                now = np.where(part[at], 0, state[:n])
                to = self.table[now, k]
            state[:n] = to >> BITS
            count[:n] += (to & (2 * HALF - 1)) - HALF
        exits, counts = np.empty_like(state), np.empty_like(count)
        exits[order], counts[order] = state, count
        return exits, counts

    def _scan(self, run, sure: np.ndarray) -> np.ndarray:
        """Counts of chunks from their entry states; ``run(chunks, entries)`` gives exits and counts."""
        n = len(sure)
        chunk, entry = np.arange(n), np.zeros(n, dtype=np.int64)
        exits, counts = run(chunk, entry)
        open_ = np.append(~sure, False)  # by chunk: the entry state isn't known to be the start state
        if not open_.any():
            return counts
        lane = np.flatnonzero(open_[:-1] | open_[1:])  # the others' maps aren't composed
        c, e, x, t = chunk[lane], entry[lane], exits[lane], counts[lane]
        while True:  # the maps' entries: until the exits of each chunk are among the next one's
            on = open_[c + 1]
            need = np.unique(np.stack([c[on] + 1, x[on]], axis=1), axis=0)
            pairs, back = np.unique(np.concatenate([np.stack([c, e], axis=1), need]), axis=0, return_inverse=True)
            new = np.ones(len(pairs), dtype=bool)
            new[back[: len(c)]] = False
            if not new.any():
                break
            more, state = pairs[new].T.copy()
            self.live = [e, x, state]  # run may number states anew
            got, add = run(more, state)
            self.live = []
            c, e, x, t = np.concatenate([c, more]), np.concatenate([e, state]), np.concatenate([x, got]), np.concatenate([t, add])
        # a map's row points to the row of the next chunk's map that its exit enters, the last ones to themselves
        row_of = np.empty(len(pairs), dtype=np.int64)
        row_of[back[: len(c)]] = np.arange(len(c))
        follow = np.arange(len(c))
        on = np.flatnonzero(open_[c + 1])
        follow[on] = row_of[np.searchsorted(pairs[:, 0] * (1 << 32) + pairs[:, 1], (c[on] + 1) * (1 << 32) + x[on])]
        wanted = np.flatnonzero(open_)
        head = np.maximum.accumulate(np.where(~open_[:-1], np.arange(n), 0))[wanted]
        first = np.full(n, -1, dtype=np.int64)  # of each sure chunk its only row
        first[c[~open_[c]]] = np.flatnonzero(~open_[c])
        at, left = first[head], wanted - head
        while left.any():  # follow: maps over 1, 2, 4, ... chunks
            odd = (left & 1).astype(bool)
            at[odd] = follow[at[odd]]
            left >>= 1
            follow = follow[follow]
        counts[wanted] = t[at]
        return counts

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.entries) >= self.most:
            self._enter([])
        raw = [(SPACE + t) if t else "" for t in texts]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        code = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(code):
            return np.zeros(len(texts), dtype=np.int64)
        classes = self.class_of[code].astype(np.int64)
        ends = np.cumsum(length)
        first = (ends - length)[length > 0]
        odd = classes >= self.n_known
        part = np.ones(len(code), dtype=bool)
        part[1:] = self.parts[classes[:-1], classes[1:]]
        part[first] = True
        # chunks of known characters; the others are tokens by themselves
        total = np.zeros(len(code) + 1, dtype=np.int64)
        extra = np.where(odd, classes - self.n_known + 1, 0)
        keep = np.flatnonzero(~odd)
        if len(keep):
            column, part, place = self._columns(classes[keep]), part[keep], keep
            part[1:] |= odd[keep[1:] - 1]
            begins = np.unique(np.concatenate([np.searchsorted(keep, first), np.arange(0, len(keep), self.chunk)]))
            begins = begins[begins < len(keep)]
            # a chunk begins at the first parting behind its place, if there is one before the next
            mark = np.flatnonzero(part)
            nearest = np.searchsorted(mark, begins)
            moved = np.where(nearest < len(mark), mark[np.minimum(nearest, len(mark) - 1)], len(keep))
            stop = np.concatenate([begins[1:], [len(keep)]])
            begins = np.unique(np.where(moved < stop, moved, begins))
            if begins[0] != 0:
                begins = np.concatenate([[0], begins])
            size = np.diff(np.concatenate([begins, [len(keep)]]))
            counts = self._scan(lambda which, entry: self._run(column, part, begins[which], size[which], entry), part[begins])
            # counts hang on the chunk's first character: a chunk may reach into the next text only at a parting
            own = np.zeros(len(keep), dtype=np.int64)
            own[begins] = counts
            total[place] = own
        total[: len(code)] += extra
        sums = np.concatenate([[0], np.cumsum(total)])
        return sums[ends] - sums[ends - length]


def transducer(path: str) -> Transducer:
    """One transducer a worker process, of the model used last."""
    return held(("transducer", path), lambda: Transducer(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``) of every text; results
    for odd inputs are those that the module states."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def start():
        machine = transducer(path)

        def make(batch):
            texts = batch.column("text").to_pylist()
            n = machine.count(texts)
            return [batch.column("id"), [len(t.encode()) if t else 0 for t in texts], n, n > limit]

        return make

    return map_arrow(rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint, over_limit boolean", start, holds=("transducer", path))
