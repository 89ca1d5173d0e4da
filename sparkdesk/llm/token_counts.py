"""Token counts of whole texts by a tokenizer compiled into a finite-state transducer.

A byte-pair encoding joins the best-scored adjacent pair until none is left. A
sequence of pieces is what it gives for a text exactly if every piece by itself
stays whole and every two neighbours, encoded alone, stay these two. So each
prefix of a text has one last piece, and the last pieces of the prefixes follow
from left to right: a piece u may end the prefix if it fits the last piece of
the prefix before u. That is a deterministic transducer over characters:

* a state holds, for every suffix of the text that may still grow into a piece,
  the last piece before that suffix and the number of tokens there, less the
  number of tokens now;
* a transition carries the change in the number of tokens, which is below zero
  where pieces grow together.

No piece crosses from another character to the word mark ``▁``, and characters
outside the vocabulary are bytes by themselves, so both lead to one state each.
States are built when a text first needs them and kept within a bound.

A text is cut into chunks of ``CHUNK`` characters and all chunks of many texts
step through the transducer together. A chunk's map takes entry states to exit
states and counts. Its entry state is known where a word begins shortly before
the cut; elsewhere the map covers the states that the text before the cut can
lead to. Maps are composed by a prefix scan (pointers that double their reach);
an entry state that a map lacks is run and added, so results are always exact.

Texts never leave their task, nothing is shuffled, and memory is bounded by
``SLICE`` characters and the kept states.

Defined results: a null or empty text has no tokens; every row counts by itself,
also if ids repeat or are null; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
LIMIT = 4096
CHUNK = 256
SLICE = 1 << 20  # characters that step together
LOOK_BACK = 64  # characters before a cut in which a known state is looked for
WARM, STARTS = 48, 16  # elsewhere: so many starts, the first so many characters before the cut
KEPT_STATES = 200_000
FEW = 64  # growths of a suffix that are compared to tell whether two pieces before it are alike
_CLASS_BITS, _DELTA_BITS = 13, 8
NEVER = float("-inf")
_ZERO = 1 << (_DELTA_BITS - 1)  # how a transition that leaves the number of tokens is written

State = tuple[str, tuple[tuple[int, str | None, int], ...]]
FREE: State = ("", ((0, None, 0),))


class Transducer:
    """The states met so far, and their transitions in an open-addressing table of two arrays."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.grows = {p[:k] for p in scores for k in range(1, len(p))}
        if any(a != MARK and b == MARK for p in scores for a, b in zip(p, p[1:])):
            raise ValueError("a piece runs on into the next word")
        chars = sorted({c for p in scores for c in p})
        if any(c not in scores for c in chars):
            raise ValueError("a character of a piece is no piece")
        self.letters = ["", *(None for _ in range(4)), *chars]
        points = np.arange(0x110000)
        self.class_of = (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)).astype(np.int16)
        for i, c in enumerate(chars, 5):
            self.class_of[ord(c)] = i
        self.mark = int(self.class_of[ord(MARK)])
        self.class_of[ord(" ")] = self.mark
        below: dict[str, list[str]] = {}
        for p in scores:
            for k in range(1, len(p)):
                below.setdefault(p[:k], []).append(p)
        self.below = {v: ps for v, ps in below.items() if len(ps) <= FEW}
        self.histories: dict[str, tuple | None] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states; ids of states given before mean nothing any more."""
        self.states: list[State] = []
        self.ids: dict[State, int] = {}
        self.alike: dict[tuple[str, str], str | None] = {}
        self.first_alike: dict[tuple[str, tuple[bool, ...]], str] = {}
        self._table(1 << 16)
        self.free = self.state_id(FREE)
        self.start = self._step(FREE, MARK)[0]
        self.start = self.state_id(self.start)

    def state_id(self, state: State) -> int:
        known = self.ids.setdefault(state, len(self.states))
        if known == len(self.states):
            self.states.append(state)
        return known

    def _table(self, size: int) -> None:
        self.bits = size.bit_length() - 1
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.zeros(size, dtype=np.int64)
        self.filled = 0

    def history(self, piece: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """How a piece grows together: (score of the next merge, last symbol now) step by step, and the same for the
        first symbol. None if it does not stay whole by itself."""
        if piece in self.histories:
            return self.histories[piece]
        symbols, scores, lefts, rights = list(piece), self.scores, [], []
        while True:
            best, at = NEVER, -1
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1], NEVER)
                if score > best:
                    best, at = score, i
            lefts.append((best, symbols[0]))
            rights.append((best, symbols[-1]))
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        found = self.histories[piece] = (rights, lefts) if len(symbols) == 1 else None
        return found

    def fits(self, left: str | None, piece: str) -> bool:
        """Whether ``piece`` stays whole, by itself and after ``left``, and ``left`` before it.

        The two grow side by side, best score first and ties to the left, and
        nothing must join the last symbol of one with the first of the other.
        """
        own = self.history(piece)
        if own is None or left is None:
            return own is not None
        rights, lefts, get = self.histories[left][0], own[1], self.scores.get
        i = j = 0
        after, a = rights[0]
        before, b = lefts[0]
        while True:
            joined = get(a + b)
            if joined is not None and joined > after and joined >= before:
                return False
            if after >= before:
                if after == NEVER:
                    return True
                i += 1
                after, a = rights[i]
            else:
                j += 1
                before, b = lefts[j]

    def _left(self, left: str | None, suffix: str) -> str | None:
        """What stands for ``left`` before a suffix that may grow: None if any piece may follow, "" if none may.

        Pieces before which the same growths fit are one, so that fewer states differ.
        """
        growths = self.below.get(suffix)
        if left is None or growths is None:
            return left
        known = self.alike.get((left, suffix))
        if known is None:
            fitting = tuple([self.fits(left, p) for p in growths])
            known = MARK * 99 if all(fitting) else self.first_alike.setdefault((suffix, fitting), left) if any(fitting) else ""
            self.alike[left, suffix] = known
        return None if known == MARK * 99 else known

    def _step(self, state: State, letter: str) -> tuple[State, int]:
        text, live = state
        if letter == MARK and text[-1:] != MARK:
            live = tuple((k, None, d) for k, _, d in live if k == 0)
        longer = text + letter
        end = [
            (piece, d + 1) for k, left, d in live
            if (piece := longer[len(longer) - k - 1 :]) in self.scores and self.fits(left, piece)
        ]
        if len(end) != 1:
            raise AssertionError(f"{len(end)} last pieces after {longer!r}")
        piece, delta = end[0]
        going = [
            (k + 1, stand, d - delta) for k, left, d in live
            if (suffix := longer[len(longer) - k - 1 :]) in self.grows and (stand := self._left(left, suffix)) != ""
        ]
        reach = max((k for k, _, _ in going), default=0)
        return (longer[len(longer) - reach :], ((0, piece, 0), *going)), delta

    def _compile(self, key: int) -> int:
        """The value of a transition: the next state and the change in tokens, in one number."""
        state, cls = key >> _CLASS_BITS, key & ((1 << _CLASS_BITS) - 1)
        if cls < 5:
            following, delta = self.free, cls
        else:
            reached, delta = self._step(self.states[state], self.letters[cls])
            following = self.state_id(reached)
        return (following << _DELTA_BITS) + delta + _ZERO

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 3 * (self.filled + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([keys, self.keys[old]]), np.concatenate([values, self.values[old]])
            size = len(self.keys)
            while 6 * len(keys) > size:
                size *= 2
            self._table(size)
        slots, last = self._slots(keys), len(self.keys) - 1
        for key, value, slot in zip(keys.tolist(), values.tolist(), slots.tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & last
            self.keys[slot], self.values[slot] = key, value
        self.filled += len(keys)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        out, last = self.values[slots], len(self.keys) - 1
        left = np.flatnonzero(self.keys[slots] != keys)
        missing = []
        slots = slots[left]
        while len(left):
            empty = self.keys[slots] < 0
            if empty.any():
                missing.append(left[empty])
                left, slots = left[~empty], slots[~empty]
            slots = (slots + 1) & last
            found = self.keys[slots] == keys[left]
            out[left[found]] = self.values[slots[found]]
            left, slots = left[~found], slots[~found]
        if missing:
            rows = np.concatenate(missing)
            new, back = np.unique(keys[rows], return_inverse=True)
            values = np.array([self._compile(k) for k in new.tolist()], dtype=np.int64)
            self._insert(new, values)
            out[rows] = values[back]
        return out

    def run(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray):
        """Exit states and changes in tokens of lanes that all step together."""
        order = np.argsort(-lengths, kind="stable")
        at, state = starts[order].copy(), states[order].astype(np.int64)
        total = np.zeros(len(at), dtype=np.int64)
        active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
        for n in active.tolist():
            value = self._find((state[:n] << _CLASS_BITS) + codes[at[:n]])
            state[:n] = value >> _DELTA_BITS
            total[:n] += (value & (2 * _ZERO - 1)) - _ZERO
            at[:n] += 1
        exits, totals = np.empty_like(state), np.empty_like(total)
        exits[order], totals[order] = state, total
        return exits, totals

    def scan(self, texts: list[str], entries: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The change in tokens over each text from its entry state, and the exit states; no text is empty."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype="<u4")
        codes = self.class_of[points].astype(np.int64)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        cuts = -(-sizes // CHUNK)
        doc = np.repeat(np.arange(len(texts)), cuts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = begins[doc] + nth * CHUNK
        length = np.minimum(CHUNK, ends[doc] - at)

        reset = np.zeros(len(codes), dtype=bool)  # the state before this character may be taken as FREE
        reset[1:] = ((codes[1:] == self.mark) & (codes[:-1] != self.mark)) | (codes[:-1] < 5)
        reset[begins] = True
        known = np.maximum.accumulate(np.where(reset, np.arange(len(codes)), 0))[at]
        state_at = np.full(len(codes), self.free)
        state_at[begins] = entries
        near = at - known <= LOOK_BACK
        far = np.flatnonzero(~near)
        owner = np.concatenate([np.flatnonzero(near), np.repeat(far, STARTS)])
        begin = np.concatenate([known[near], (at[far][:, None] - WARM + np.arange(STARTS)).ravel()])
        origin = np.concatenate([state_at[known[near]], np.full(len(far) * STARTS, self.free)])
        entry, _ = self.run(codes, begin, at[owner] - begin, origin)
        pairs = np.unique(owner * (1 << 32) + entry)

        chunk, entry = pairs >> 32, pairs & ((1 << 32) - 1)
        exits, count = self.run(codes, at[chunk], length[chunk], entry)
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, dtype=bool)
        freed = np.append(reset[at[1:]] & ~last[:-1], False)
        exits = np.where(freed[chunk], self.free, exits)

        wanted = (chunk + 1) * (1 << 32) + exits
        place = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
        ended = last[chunk]
        lost = ~ended & (pairs[place] != wanted)
        follow = np.where(ended | lost, np.arange(len(pairs)), place)
        total = np.where(ended | lost, 0, count)
        while (follow[follow] != follow).any():
            total = total + total[follow]
            follow = follow[follow]
        first = np.searchsorted(pairs, np.flatnonzero(nth == 0) * (1 << 32))
        stop = follow[first]
        sums, final = total[first] + count[stop], exits[stop]
        for d in np.flatnonzero(~ended[stop]).tolist():  # a map lacked the state that was reached
            sums[d], final[d] = self._on(codes, at, length, chunk[stop[d]] + 1, last, freed, sums[d], exits[stop[d]], pairs, exits, count)
        return sums, final

    def _on(self, codes, at, length, chunk, last, freed, total, state, pairs, exits, count):
        while True:
            key = chunk * (1 << 32) + state
            i = min(int(np.searchsorted(pairs, key)), len(pairs) - 1)
            if pairs[i] == key:
                state, add = exits[i], count[i]
            else:
                out, gain = self.run(codes, at[chunk : chunk + 1], length[chunk : chunk + 1], np.array([state]))
                state, add = self.free if freed[chunk] else out[0], gain[0]
            total += add
            if last[chunk]:
                return total, state
            chunk += 1

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out, group, size = [0] * len(texts), [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > SLICE:
                out[i] = self._long(t)
                continue
            group.append(i)
            size += len(t)
            if size >= SLICE:
                self._group(texts, group, out)
                group, size = [], 0
        if group:
            self._group(texts, group, out)
        return out

    def _room(self) -> None:
        if len(self.states) > KEPT_STATES:
            self.forget()

    def _group(self, texts, group, out) -> None:
        self._room()
        sums, _ = self.scan([texts[i] for i in group], [self.start] * len(group))
        for i, n in zip(group, sums.tolist()):
            out[i] = n + 1  # the word mark put before a text

    def _long(self, text: str) -> int:
        total, state = 1, self.states[self.start]
        for i in range(0, len(text), SLICE):
            self._room()
            sums, final = self.scan([text[i : i + SLICE]], [self.state_id(state)])
            total, state = total + int(sums[0]), self.states[int(final[0])]
        return total


_COMPILED: dict[str, Transducer] = {}


def transducer(model: str) -> Transducer:
    """One transducer per Python worker for a model file, kept from task to task."""
    if model not in _COMPILED:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        _COMPILED[model] = Transducer({p.id_to_piece(i): p.get_score(i) for i in plain})
    return _COMPILED[model]


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            n = pa.array(t.counts(b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
