"""Toxicity with noisy-channel deobfuscation (operator 1).

A text's words are restored first: leetspeak, letters set apart and repeated letters give a lattice of possible letters, and
Viterbi finds the path with the best product of channel and character language model. The restored words' parts are then
weighed by what they say about the label in a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Letters that a sign often stands for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il",
    "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¢": "c", "#": "h", "%": "x", "*": "abcdefghijklmnopqrstuvwxyz",
}
APART = set(".-_ ~'/\\,:;​­")
STRIPPED = ".,;:?!\"'()[]{}…«»“”‘’¿¡"
#: Costs in nats: a sign read as a letter (a wildcard's is higher), a sign that stays, a repeated letter or a separator that goes, a separator that stays.
READ, WILD, STAYS, AGAIN, JOINED, SPLIT = 1.0, 2.5, 7.0, 0.5, 1.0, 3.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"
END, OTHER = 26, 27  # classes beside the letters: word's end, any other letter
SAMPLE = 8_000  # labelled documents that the classifier is fitted on, at most
MARGIN = 0.7  # log odds by which a part must exceed the labels' mean
Z = 3.0  # deviations by which a part's share of toxic documents is lowered
CACHED = 1_000_000  # words whose weight a task keeps, some 100 bytes each
#: Signs around a word that decorate it: those that stand for no letter at an end, and others more than once.
DECORATION = re.compile(r"""^(?:[.,;:?"'()\[\]{}…«»“”‘’¿¡*#%&=^~_|<>\-]|([$@!+0-9])\1+)+|(?:[.,;:?!"'()\[\]{}…«»“”‘’¿¡*#%&=^~_|<>\-]|([$@+])\2+)+$""")
#: Signs around a word that are taken as decoration even where they could be letters: those that stand for none, exclamation marks at the
#: end, and runs of the same sign, but for three that are doubled in words.
PLAIN = re.compile(r"""^(?:[.,;:?"')\[\]}…«»“”‘’¿¡=^~_>&\-]|([*#%|<({!])\1+)+|(?:[.,;:?!"')\[\]}…«»“”‘’¿¡=^~_>&\-]|([*#%|<({])\2+)+$""")
TRIPLE = re.compile(r"(.)\1\1")
REPEATED = re.compile(r"(.)\1+")
SPACED = re.compile(r"(?<!\S)\S(?:\s{1,3}\S(?!\S)){2,}")
_base: dict[str, int] = {}


def letter(c: str) -> int:
    """The class of a letter: its base letter's index, or OTHER."""
    if c not in _base:
        base = unicodedata.normalize("NFD", c)[0]
        _base[c] = LETTERS.index(base) if base in LETTERS else OTHER
    return _base[c]


class Classes(dict):
    """For str.translate: each character's class as a character."""

    def __missing__(self, code: int) -> str:
        got = self[code] = chr(letter(chr(code)))
        return got


CLASSES = Classes()


class Language:
    """Character trigrams, interpolated with bigrams and letters: costs[a, b, c] = -ln P(c | a b)."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype(float)
        one = (c.sum((0, 1)) + 1) / (c.sum() + 28)
        two = (c.sum(0) + 5 * one) / (c.sum(0).sum(1, keepdims=True) + 5)
        three = (c + 5 * two[None]) / (c.sum(2, keepdims=True) + 5)
        self.costs = (-np.log(three)).tolist()


def ambiguous(word: str) -> bool:
    """Whether a word has more than one path: letters beside signs, or a letter three times in a row."""
    if word.isalpha():
        return TRIPLE.search(word) is not None
    return any(map(str.isalpha, word))


def readings(c: str) -> list[tuple[int, str, float]]:
    """(class, letter, cost) of each letter that a sign may stand for, and of the sign itself."""
    cost = WILD if c == "*" else READ
    return [(ord(x) - 97, x, cost) for x in LEET.get(c, "")] + ([] if c in APART else [(OTHER, c, STAYS)])


READINGS = {c: readings(c) for c in [*LEET, *APART]}


def restore(word: str, language: Language) -> str:
    """The best reading of an ambiguous word or of a run of single letters; it may hold spaces."""
    cost = language.costs
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(END, END): (0.0, None)}
    last = ""
    for c in word:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        options = [(letter(c), c, 0.0)] if c.isalpha() else READINGS.get(c) or readings(c)
        again, apart, last = c == last and c not in APART, c in APART, c
        for (a, b), (total, path) in beam.items():
            costs = cost[a][b]
            for k, x, more in options:
                t = total + more + (costs[k] if k != OTHER or c.isalpha() else 0.0)
                if (b, k) not in after or t < after[b, k][0]:
                    after[b, k] = (t, (path, x))
            if again or apart:
                t = total + (JOINED if apart else AGAIN)
                if (a, b) not in after or t < after[a, b][0]:
                    after[a, b] = (t, path)
            if apart:
                t = total + SPLIT + (costs[END] if b != END else 0.0)
                if (END, END) not in after or t < after[END, END][0]:
                    after[END, END] = (t, (path, " "))
        beam = after
    path = min((total + (cost[a][b][END] if b != END else 0), k, path) for k, ((a, b), (total, path)) in enumerate(beam.items()))[2]
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def squeezed(word: str) -> str:
    """Base letters, repeated ones once: spelling variants of a word agree in this."""
    if not word.isascii():
        word = "".join(unicodedata.normalize("NFD", c)[0] for c in word)
    return REPEATED.sub(r"\1", word)


def parts(word: str) -> list[str]:
    """What is counted of a restored word: itself and its beginnings of three to six letters."""
    w = squeezed(word)
    return [] if len(w) < 3 else [w[:n] for n in range(3, min(6, len(w)) + 1)] + ([f"{w}$"] if len(w) < 40 else [])


class Reader:
    """Restores a text's words. Words without signs or repetitions have one path and stay."""

    def __init__(self, language: Language):
        self.language = language

    def of(self, word: str) -> list[str]:
        """Readings without the signs at the word's ends, and with those that may stand for letters."""
        if word.isalpha():
            return self.read(word)
        bare, edged = DECORATION.sub("", word), PLAIN.sub("", word)
        found = self.read(bare)
        return found if edged == bare else [*found, *(w for w in self.read(edged) if w not in found)]

    def read(self, bare: str) -> list[str]:
        if not ambiguous(bare):
            return [bare] if bare.isalpha() else []
        return restore(bare, self.language).split()

    def spaced(self, low: str) -> list[str]:
        """Readings of runs of single letters."""
        runs = (m[0] for m in SPACED.finditer(low))
        return [w for run in runs if sum(map(str.isalpha, run)) > 1 for w in restore(re.sub(r"\s+", " ", run), self.language).split()]

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        return {r for w in set(low.split()) for r in self.of(w)} | set(self.spaced(low))


class Cached(dict):
    """A dict that asks of() for what it lacks and holds a bounded number of answers."""

    def __init__(self, of, most: int):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.of(key)
        return got


def logit(toxic: float, all_: float) -> float:
    """Log odds of the lower bound (Wilson's) of a share; the less is known, the lower."""
    if all_ <= 0 or toxic <= 0:
        return -9.0
    p, n, z = toxic / all_, all_, Z
    low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return math.log(low / (1 - low))


class Scorer:
    """Evidence of a text under one or more tables of weights.

    For each table: how far the two highest words stand above the labels' mean, and how many words tell.
    """

    def __init__(self, language: Language, tables: list[dict[str, float]], floor: float):
        self.reader, self.tables, self.floor = Reader(language), tables, floor
        self.nothing = (0.0,) * len(tables)
        self.weights = Cached(lambda token: self.best(self.reader.of(token)), CACHED)

    def best(self, words: list[str]) -> tuple[float, ...]:
        """The highest weight of the words' parts, less the mean's, in each table."""
        found = [p for w in words for p in parts(w) if any(p in t for t in self.tables)]
        if not found:
            return self.nothing  # one tuple for nearly all words
        return tuple(max((t[p] for p in found if p in t), default=self.floor) - self.floor for t in self.tables)

    def evidence(self, text: str | None) -> list[tuple[float, float, float]]:
        low = (text or "").lower()
        every = [*map(self.weights.__getitem__, set(low.split())), *(self.best([w]) for w in self.reader.spaced(low))]
        told = [w for w in every if w is not self.nothing]
        out = []
        for k in range(len(self.tables)):
            best = sorted((w[k] for w in told if w[k] > 0), reverse=True)
            top = [*best[:2], 0.0, 0.0]
            out.append((top[0], top[1], math.log1p(min(len(best), 50))))
        return out


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def language(documents: DataFrame) -> Language:
    """Character trigrams of all words of all documents, counted in tasks; a table of 28 x 28 x 28 at most."""

    def count(batches):
        total = np.zeros(28**3, np.int64)
        words: Counter = Counter()

        def flush():
            known = [(b, n) for w, n in words.items() if 1 < len(b := w.strip(STRIPPED)) <= 60 and b.isalpha()]  # letters set apart are no words
            words.clear()
            if known:
                ends = chr(END) * 2
                ids = np.frombuffer("".join(f"{ends}{w.translate(CLASSES)}{chr(END)}" for w, _ in known).encode("latin-1"), np.uint8).astype(np.int64)
                n = np.repeat(np.array([n for _, n in known], np.int64), [len(w) + 3 for w, _ in known])[2:]
                a, b, c = ids[:-2], ids[1:-1], ids[2:]
                inside = (c != END) | (b != END)  # the rest lies across words
                total[:] += np.bincount(((a * 28 + b) * 28 + c)[inside], n[inside], 28**3).astype(np.int64)

        for batch in batches:
            for x in batch.column(0):
                words.update((x.as_py() or "").lower().split())
                if len(words) > 200_000:
                    flush()
        flush()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["cell", "n"])

    counts = np.zeros(28**3, np.int64)
    for row in documents.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.cell] = row.n
    return Language(counts.reshape(28, 28, 28))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def scores(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted (1 if score >= 0.5). See scored()."""
    found = scored(documents.select("doc_id", "text"), labels, "score", folds, fold, sample)
    return found.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored(documents: DataFrame, labels: DataFrame, column: str, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Every row of documents with a further column, the score: 0 to 1, higher if label 1 is likelier.

    Labels are learned from at most sample labelled documents (those of the lowest hash) outside the held-out fold; the
    character model reads all documents. labels: doc_id, toxic (null: no label; repeated: the highest). Null and empty
    texts have no words and get the score of a text without evidence. Without labels of both kinds every score is the
    labels' mean, or 0. A null doc_id counts as an empty one. documents needs doc_id and
    text; its other columns pass.
    """
    documents, spark = documents.drop(column), documents.sparkSession  # a column of the score's name is replaced
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id")
    chosen = known.select("doc_id", "toxic", rank.alias("rank")).orderBy("rank", "doc_id").limit(sample)
    once = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "rank").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of repeated rows one
    chosen = stored(once.repartition(64, F.xxhash64("text")), "labelled")
    model = language(documents)
    sent = spark.sparkContext.broadcast(model.costs)

    def reading(costs) -> Language:
        own = Language.__new__(Language)
        own.costs = costs
        return own

    def count(batches):
        reader, seen = Reader(reading(sent.value)), {}
        known = Cached(lambda token: [p for w in reader.of(token) for p in parts(w)], CACHED // 10)
        for batch in batches:
            for text, toxic, rank in zip(*(batch.column(k) for k in range(3)), strict=True):
                k = 2 * (rank.as_py() & 1)
                low = (text.as_py() or "").lower()
                found = {p for w in set(low.split()) for p in known[w]}
                found.update(p for w in reader.spaced(low) for p in parts(w))
                t = int(toxic.as_py() > 0)
                for p in found:
                    if (n := seen.get(p)) is None:
                        n = seen[p] = [0, 0, 0, 0]
                    n[k] += 1
                    n[k + 1] += t
        rows = list(seen.items())
        for at in range(0, len(rows), 50_000):
            cut = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in cut]), *(pa.array([n[k] for _, n in cut], pa.int64()) for k in range(4))], ["part", "n0", "t0", "n1", "t1"])

    total = chosen.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("t")).first()
    n, t = total.n, total.t or 0
    weights: dict[str, float] = {}
    coefficients = np.zeros(4)
    floor = math.log((t + 1) / (n - t + 1))
    if 0 < t < n:
        counted = chosen.select("text", "toxic", "rank").mapInArrow(count, "part string, n0 long, t0 long, n1 long, t1 long")
        counted = counted.groupBy("part").agg(*(F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")))
        told = counted.where((F.col("t0") + F.col("t1") >= 3) & ((F.col("t0") + F.col("t1")) / (F.col("n0") + F.col("n1")) > t / n)).collect()  # bounded by the sample
        by_fold = [{r.part: w for r in told if (w := logit(r[f"t{1 - k}"], r[f"n{1 - k}"])) > floor + MARGIN} for k in (0, 1)]
        weights = {r.part: w for r in told if (w := logit(r.t0 + r.t1, r.n0 + r.n1)) > floor + MARGIN}
        halves = spark.sparkContext.broadcast(by_fold)

        def weigh(batches):
            scorer = Scorer(reading(sent.value), halves.value, floor)
            for batch in batches:
                got = [scorer.evidence(x.as_py())[r.as_py() & 1] for x, r in zip(batch.column(0), batch.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))], ["toxic", "a", "b", "c"])

        rows = chosen.select("text", "toxic", "rank").mapInArrow(weigh, "toxic double, a double, b double, c double").toPandas()  # at most sample rows of four numbers
        coefficients = fitted(rows[["a", "b", "c"]].to_numpy(), (rows["toxic"].to_numpy() > 0).astype(float))
    mean = t / n if n else 0.0
    learned = spark.sparkContext.broadcast((weights, coefficients, 0 < t < n))

    at = documents.columns.index("text")

    def score(batches):
        weights, w, both = learned.value
        scorer = Scorer(reading(sent.value), [weights], floor)
        for batch in batches:
            got = [1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(w[:3], scorer.evidence(x.as_py())[0]) + w[3]))))) if both else mean for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, column])

    kinds = T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())])
    return documents.mapInArrow(score, kinds)
