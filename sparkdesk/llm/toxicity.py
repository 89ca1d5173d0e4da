"""Toxicity of texts, scored after undoing disguises with a noisy-channel decoder.

Source model: a character trigram model over the words of all documents, counted
by every task and added up; its alphabet is fixed, so it has the same size at
any input. Channel: a written character may stand for itself, for letters it
looks like, for nothing (a separator between letters, or a repetition). Each
suspicious token is a lattice of such readings, and Viterbi decoding finds the
likeliest word. A run of single characters parted by spaces is one lattice, in
which each gap may end a word, at the price of an end and a beginning in the
character model. Every word on a way through it within ``SLACK`` of the cheapest
is scored, as letters alone leave boundaries open, and the run joined as a whole.
Tokens of plain letters have one reading and are left alone.

Classifier over the restored words: a word's features are itself and its
prefixes of 4 to 6 letters. A list of rules is learned by sequential covering:
the feature with the highest lower confidence bound of its share of toxic
documents becomes a rule, the documents that hold it are set aside, and the next
is chosen among the rest, so that nothing is blamed that only stands beside a
word already known. A document scores the bound of its strongest rule, raised a
little by the next word's.

The classifier is fitted on at most ``SAMPLE`` labelled documents (those of the
smallest hashed ids, one text of an id), which bounds what goes through the
driver: features are those that ``SUPPORT`` toxic documents of the sample hold.
The character model covers all words of all documents.

Defined results: a null or empty text scores as a text without a telling word;
an empty table gives no rows, and without labels every score is 0; repeated rows
are scored each; of several labels for an id the largest counts; columns other
than those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkdesk.llm.common import stage

SAMPLE = 20_000
SUPPORT = 3  # toxic documents that a feature needs
Z = 2.5  # deviations of the confidence bound
TIMES = 4  # rules that hold a document before it is set aside
LEAST = 0.2  # bound below which a feature is no rule
THRESHOLD = 0.3
MEMORY = 400_000  # words whose score one Python worker remembers
LONGEST = 64  # longer tokens are not remembered, and no word written apart is longer
SLACK = 4.0  # nats between the cheapest way through letters written apart and the dearest whose words count

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
_AT = {c: i + 1 for i, c in enumerate(LETTERS)}  # 0 is the edge of a word
_SIZE = len(LETTERS) + 1
_CODES = np.zeros(0x180, dtype=np.int64)
_CODES[[ord(c) for c in LETTERS]] = range(1, _SIZE)

#: what a character may stand for, besides itself
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = set(".-_*~'`^·•,:;/\\=#")
COST_SAME, COST_LOOK, COST_DROP, COST_REPEAT = 0.02, 1.0, 0.4, 0.9

_EDGE = "\"'()[]{}<>.,;:!?…«»“”‘’-_*~#|/\\"
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_PLAIN = re.compile(rf"[{LETTERS}]+\Z")
_ODD = re.escape("".join(sorted({*LOOKS, *SEPARATORS})))
_MIXED = re.compile(rf"[{LETTERS}][{_ODD}]|[{_ODD}][{LETTERS}]")
_REPEATED = re.compile(r"(.)\1\1")


class Characters:
    """A trigram model over letters, from a table of counts of shape (size, size, size)."""

    def __init__(self, counts: np.ndarray):
        flat = counts + 0.05
        self.cost = (-np.log(flat / flat.sum(axis=2, keepdims=True))).tolist()

    @staticmethod
    def count(words: Counter) -> np.ndarray:
        """Trigram counts of weighted words, each framed by edges."""
        out = np.zeros(_SIZE**3, dtype=np.int64)
        held = list(words)
        for i in range(0, len(held), 50_000):
            some = held[i : i + 50_000]
            text = "\0\0" + "\0\0".join(some) + "\0"
            codes = _CODES[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
            lengths = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            weight = np.repeat(np.fromiter((words[w] for w in some), dtype=np.int64, count=len(some)), lengths + 2)
            a, b, c = codes[:-2], codes[1:-1], codes[2:]
            inside = (b != 0) | (c != 0)
            out += np.bincount(((a * _SIZE + b) * _SIZE + c)[inside], weights=weight[: len(a)][inside], minlength=_SIZE**3).astype(np.int64)
        return out

    def restore(self, token: str) -> str:
        """The likeliest reading of a token, by Viterbi over (last two letters, last character written)."""
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for ch in token:
            best = self._step(best, ch)
        return _spelled(self._ended(best)[1])

    def _step(self, best: dict, ch: str) -> dict:
        cost, read = self.cost, _read(ch)
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        drops = _drops(ch)
        for (a, b), (total, path) in best.items():
            if drops:
                _relax(after, (a, b), total + COST_DROP, path)
            for c, price in read:
                _relax(after, (b, c), total + price + cost[a][b][c], (c, path))
                if c == b:  # the character again, or another that looks like it
                    _relax(after, (a, b), total + COST_REPEAT, path)
        return after

    def _ended(self, best: dict) -> tuple[float, tuple]:
        return min(((t + self.cost[a][b][0], p) for (a, b), (t, p) in best.items()), key=lambda x: x[0])

    def apart(self, run: str, slack: float) -> list[str]:
        """The words of letters written apart, as written and as restored: those on a way through the run
        at most ``slack`` dearer than the cheapest.

        A word may end at each gap; it pays for its end and the next one for its
        beginning. A word takes ``LONGEST`` characters of the run at most.
        """
        n = len(run)
        price = np.full((n, LONGEST), np.inf)  # by beginning and length; memory grows with the run alone
        skip = np.array([COST_DROP if _drops(c) else np.inf for c in run])
        before, after = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
        before[0] = after[n] = 0.0
        same: dict[str, int] = {}  # where the same characters follow, so that repeats are walked once
        for i in range(n):
            first = same.setdefault(run[i : i + LONGEST], i)
            best = {(0, 0): (0.0, ())}
            for k, ch in enumerate(run[i : i + LONGEST] if first == i else ""):
                best = self._step(best, ch)
                cost, path = self._ended(best)
                if path:
                    price[i, k] = cost
            price[i] = price[first]
            ends = slice(i + 1, min(n, i + LONGEST) + 1)
            before[ends] = np.minimum(before[ends], before[i] + price[i, : ends.stop - ends.start])
            before[i + 1] = min(before[i + 1], before[i] + skip[i])
        for i in range(n - 1, -1, -1):
            ends = slice(i + 1, min(n, i + LONGEST) + 1)
            after[i] = min((price[i, : ends.stop - ends.start] + after[ends]).min(), skip[i] + after[i + 1])
        most, on = before[n] + slack + 1e-9, {}
        for i in range(n if most < np.inf else 0):
            ends = slice(i + 1, min(n, i + LONGEST) + 1)
            for k in np.flatnonzero(before[i] + price[i, : ends.stop - ends.start] + after[ends] <= most).tolist():
                written = run[i : i + k + 1]
                if written not in on:
                    on[written] = self.restore(written)
        return list(dict.fromkeys(x for written, w in on.items() for x in (written.strip(_EDGE), w) if x))


def _read(ch: str) -> list[tuple[int, float]]:
    """The letters a character may stand for, and the price of each."""
    own = [(_AT[ch], COST_SAME)] if ch in _AT else []
    return own + [(_AT[letter], COST_LOOK) for letter in LOOKS.get(ch, "")]


def _drops(ch: str) -> bool:
    return ch in SEPARATORS or not (ch in _AT or ch in LOOKS)


def _spelled(path: tuple) -> str:
    out = []
    while path:
        out.append(LETTERS[path[0] - 1])
        path = path[1]
    return "".join(reversed(out))


def _relax(states: dict, key: tuple[int, int], cost: float, path: tuple) -> None:
    old = states.get(key)
    if old is None or cost < old[0]:
        states[key] = (cost, path)


def suspicious(token: str) -> bool:
    """Whether a lower-case token may be a disguised word: a look-alike or separator next to a letter, or letters repeated."""
    if _PLAIN.match(token):
        return bool(_REPEATED.search(token))
    return bool(_MIXED.search(token))


def readings(token: str, model: Characters) -> list[str]:
    """The words a raw token, or a run of single characters, may hold: itself without edges, and what it was disguised from."""
    low = token.lower()
    if " " in low:  # letters written apart
        run = low.replace(" ", "")
        out = readings(run, model)
        for r in dict.fromkeys((run.strip(_EDGE), run)):  # a look-alike may stand at the edge
            out += model.apart(r, SLACK)
        return list(dict.fromkeys(out))
    bare = low.strip(_EDGE)
    out = [bare] if bare else []
    if suspicious(bare):
        out.append(model.restore(bare))
    if low != bare and suspicious(low):  # a look-alike may stand at the edge
        out.append(model.restore(low))
    return list(dict.fromkeys(out))


def split(text: str | None) -> list[str]:
    """Tokens of a whole text; runs of letters written apart, with one space in each gap, stand behind the others."""
    if not text:
        return []
    tokens = text.split()
    # letters written apart are three tokens of one character in a row at least: most texts have none, and are not searched
    if "111" not in "".join(["1" if len(t) == 1 else "0" for t in tokens]):
        return tokens
    return tokens + [" ".join(m.split()) for m in _SPACED.findall(text)]


def restored_text(text: str, model: Characters) -> str:
    """A text with every disguised word in its likeliest reading."""
    joined = _SPACED.sub(lambda m: " ".join(model.apart(re.sub(r"\s+", "", m[0].lower()), 0.0)) or m[0], text)
    return re.sub(r"\S+", lambda m: (readings(m[0], model) or [m[0]])[-1] if suspicious(m[0].lower().strip(_EDGE)) else m[0], joined)


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def lower_bound(hits: np.ndarray, all_: np.ndarray, z: float = Z) -> np.ndarray:
    """Wilson's lower confidence bound of a share."""
    p = hits / all_
    centre = p + z * z / (2 * all_)
    spread = z * np.sqrt(p * (1 - p) / all_ + z * z / (4 * all_ * all_))
    return (centre - spread) / (1 + z * z / all_)


@dataclass
class Scorer:
    counts: np.ndarray
    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict)
    model: Characters | None = None

    def __getstate__(self):
        return {"counts": self.counts, "weights": self.weights, "known": {}, "model": None}

    def word(self, token: str) -> float:
        if self.model is None:
            self.model = Characters(self.counts.reshape(_SIZE, _SIZE, _SIZE))
        get = self.weights.get
        return max((get(f, 0.0) for w in readings(token, self.model) for f in features(w)), default=0.0)

    def text(self, text: str | None) -> float:
        known = self.known
        best = second = 0.0
        for token in set(split(text)):
            value = known.get(token)
            if value is None:
                value = self.word(token)
                if len(known) >= MEMORY:
                    known.clear()
                if len(token) <= LONGEST:
                    known[token] = value
            if value > best:
                best, second = value, best
            elif value > second:
                second = value
        # the next word closes a tenth of what is left to 1
        return best + 0.1 * (1.0 - best) * second


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over the plain words of all texts: one row of fixed size per task, added up by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(_SIZE**3, dtype=np.int64), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words.update((text or "").split())
            if len(words) > MEMORY:
                total += Characters.count(_plain(words))
                words = Counter()
        total += Characters.count(_plain(words))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SIZE**3, dtype=np.int64)
    for r in rows:  # at most one row per cell of the fixed alphabet
        out[r["cell"]] = r["n"]
    return out


def _plain(words: Counter) -> Counter:
    out = Counter()
    for w, n in words.items():
        w = w.lower().strip(_EDGE)
        if w and _PLAIN.match(w) and not _REPEATED.search(w):
            out[w] += n
    return out


def _bound(hits, all_, z: float = Z):
    """The same bound as a column."""
    p = hits / all_
    return (p + z * z / (2 * all_) - z * F.sqrt(p * (1 - p) / all_ + z * z / (4 * all_ * all_))) / (1 + z * z / all_)


def fit(docs: DataFrame, labels: DataFrame, counts: np.ndarray) -> dict[str, float]:
    """Rules (feature to bound) from labelled documents; ``labels`` has doc_id and toxic."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Characters(counts.reshape(_SIZE, _SIZE, _SIZE)), {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                held = set()
                for token in set(split(text)):
                    own = seen.get(token)
                    if own is None:
                        if len(seen) > MEMORY // 4:
                            seen.clear()
                        own = seen[token] = [f for w in readings(token, model) for f in features(w)]
                    held.update(own)
                out.append(list(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.list_(pa.string())), batch.column("toxic").cast(pa.int64())], names=["features", "toxic"]
            )

    rows = stage(texts.mapInArrow(run, "features array<string>, toxic long"), "toxicity-sample")
    each = rows.select(F.explode("features").alias("feature"), "toxic")
    found = (
        each.groupBy("feature").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n"))
        .where(F.col("hits") >= SUPPORT).select("feature", _bound(F.col("hits"), F.col("n")).alias("v"))
        .where(F.col("v") >= LEAST / 2).orderBy(F.desc("v"), "feature")
    )
    wanted = [r["feature"] for r in found.collect()]
    if not wanted:
        return {}
    at = {f: i for i, f in enumerate(wanted)}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[at[f] for f in held if f in at] for held in b.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), b.column("toxic")], names=["held", "toxic"])

    sample = rows.mapInArrow(narrow, "held array<int>, toxic long").where(F.size("held") > 0).collect()
    return cover([(list(r["held"]), bool(r["toxic"])) for r in sample], wanted)


def cover(sample: list[tuple[list[int], bool]], names: list[str], z: float = Z, times: int = TIMES, support: int = SUPPORT) -> dict[str, float]:
    """Sequential covering: the best feature, then the best among the documents not yet held by ``times`` rules, and so on."""
    hits, all_ = np.zeros(len(names)), np.zeros(len(names))
    holders: list[list[int]] = [[] for _ in names]
    for i, (held, toxic) in enumerate(sample):
        for f in held:
            holders[f].append(i)
        all_[held] += 1
        hits[held] += toxic
    left, rules = [times] * len(sample), {}
    taken = np.zeros(len(names), dtype=bool)
    while True:
        bound = np.where((hits >= support) & ~taken, lower_bound(hits, np.maximum(all_, 1), z), 0.0)
        best = int(np.argmax(bound))
        if bound[best] < LEAST:
            return rules
        rules[names[best]] = float(bound[best])
        taken[best] = True
        for i in holders[best]:
            left[i] -= 1
            if left[i] == 0:
                held, toxic = sample[i]
                all_[held] -= 1
                hits[held] -= toxic


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    counts = character_counts(docs)
    return Scorer(counts, fit(docs, labels, counts))


_SCORERS: dict[str, Scorer] = {}


def _kept(key: str, scorer: Scorer) -> Scorer:
    """The same scorer for all tasks of a Python worker, so that words it knows stay known."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = scorer
    return _SCORERS[key]


def with_score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Add ``score`` (0 to 1), from the text alone."""
    import uuid

    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(texts):
        own = _kept(key, shared.value)
        return texts.map(lambda t: own.text(t), na_action=None).astype("float64")

    return docs.withColumn("score", score("text"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are never read."""
    scorer = train(docs, labels.select("doc_id", "toxic").where(fold() != 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_score(rows, scorer).select(
        "doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
