"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of characters, with a decay for every character they span, so
an insult still matches when characters are inserted or left between. A word is compared with marks
of its beginning and end, as a string may be an insult only where a word begins. A sentence is
compared with a landmark by its best word, in powers of the kernel; landmarks are strings that tell labelled toxic
documents from others, and the Nyström map whitens their kernel matrix. The machine is trained on the
sentences of labelled documents: of a toxic document, those that the last round finds worst. A
document's score is a probability from its strongest words: what one leaves open, a second one of
its kind decides.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, id_remainder, sample_by_hash, table, worker_slot, written

#: Labelled documents of each class that are learned from, chosen by the hash of their id, and their characters at most.
SAMPLE, LONGEST_TEXT = 1000, 100_000
#: Length of the subsequences, decay of each character they span, and the kernel's power.
ORDER, DECAY, POWER = 4, 0.75, 3
#: Landmarks at most, the lengths of their strings, and rounds of training.
LANDMARKS, SHORTEST, LONGEST, ROUNDS = 64, 4, 8, 4
#: A landmark's share of toxic documents, weighted by what earlier landmarks leave open, exceeds so many times its share of clean ones, by so much.
CLEANER, WORTH = 5, 0.003
#: Places in a document at which a string counts, each for its part of one; and the strongest words a score is made of.
PLACES = 3
#: Characters of a word that are compared at once, its marks included; longer ones slide by half of it.
WORD = 26
#: Marks of a word's beginning and end; with them, words of two letters have a subsequence of the kernel's order.
BEGIN, FINISH = "\x02", "\x03"
#: Least kernel value that counts, and pairs of strings that are compared at once.
FAINT, PAIRS = 0.02, 512
THRESHOLD = 0.7

SENTENCE = re.compile(r"[.!?]+\s+|\n+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def string_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of paired rows of codes; negative codes are padding and match nothing.

    ``s`` pads with -1 and ``t`` with -2. Follows the recursion of Lodhi et al. (2002), over all pairs at once.
    """
    same = (s.T[:, None, :] == t.T[None, :, :]).astype(np.float64)  # by place in s, place in t, and pair
    if not len(s) or min(same.shape[:2]) < order:
        return np.zeros(len(s))
    square = decay * decay
    run = same * square
    for k in range(1, order):
        # Subsequences of k characters, by where they may still end: K'_k. Sums over t's places give K''_k, over those of s then K'_k.
        for j in range(1, run.shape[1]):
            run[:, j] += decay * run[:, j - 1]
        for i in range(1, len(run)):
            run[i] += decay * run[i - 1]
        run = run[:-1, :-1] * same[k:, k:]
        run *= square
    return run.reshape(-1, len(s)).sum(axis=0)


def letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings, one after another, and the length of each."""
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.fromiter(map(len, strings), np.int64, len(strings))


def codes(strings: list[str], width: int, pad: int) -> np.ndarray:
    points, sizes = letters(strings)
    out = np.full((len(strings), width), pad, np.int32)
    out[np.arange(width) < sizes[:, None]] = points
    return out


def units(chunk: str) -> list[str]:
    """A word without punctuation at its edges and with its marks, in windows if it is long."""
    word = EDGES.sub("", chunk)
    if not word:
        return []
    word = BEGIN + word + FINISH
    if len(word) <= WORD:
        return [word] if len(word) >= ORDER else []
    return [word[i : i + WORD] for i in range(0, len(word) - WORD // 2, WORD // 2)]


class Landmarks:
    """Kernel values of words with all landmarks, relative to a landmark's own: 1 where a word holds it unbroken."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = strings
        self.codes = codes(strings, max([LONGEST, *map(len, strings)]), -2)
        other = np.where(self.codes == -2, -1, self.codes)
        self.own = string_kernel(other, self.codes)
        a, b = np.meshgrid(np.arange(len(strings)), np.arange(len(strings)), indexing="ij")
        gram = string_kernel(other[a.ravel()], self.codes[b.ravel()]).reshape(len(strings), -1) if strings else np.zeros((0, 0))
        self.gram = (gram / np.sqrt(np.outer(self.own, self.own))) ** POWER

    @staticmethod
    def _slots(points: np.ndarray) -> np.ndarray:
        """One of 64 slots for each letter."""
        return (points.astype(np.uint64) * np.uint64(2654435761) % np.uint64(2**32) >> np.uint64(26)).astype(np.int64)

    def _counts(self, strings: list[str]) -> np.ndarray:
        """How many letters of each string fall into each slot."""
        points, sizes = letters(strings)
        at = np.repeat(np.arange(len(strings)) * 64, sizes) + self._slots(points)
        return np.bincount(at, minlength=64 * len(strings)).reshape(-1, 64)

    def _most(self, words: list[str], among: np.ndarray) -> np.ndarray:
        """By word and landmark of these, what the kernel cannot exceed: every choice of a landmark's letters is spelt by the word as often
        as its letters' counts allow, each time without a gap."""
        count = np.concatenate([self._counts(words), np.zeros((len(words), 1), np.int64)], axis=1).astype(np.float64)
        slots = np.where(self.codes >= 0, self._slots(self.codes), 64)[among]  # of padding: none
        total = np.zeros((len(words), len(slots)))
        held = [np.zeros_like(total) for _ in range(ORDER)]  # choices of so many letters, decayed to the place
        held[0] += 1.0
        for slot in slots.T:
            n = count[:, slot]
            total += held[-1] * n
            for k in range(ORDER - 1, 0, -1):
                held[k] = DECAY * (held[k] + held[k - 1] * n)
        return total * DECAY ** (1 + ORDER)

    def values(self, words: list[str]) -> np.ndarray:
        """By word and landmark; a word's marks match nothing in landmarks that have none, and are left out there."""
        out = np.zeros((len(words), len(self.strings)), np.float32)
        marked = np.array([BEGIN in s or FINISH in s for s in self.strings], bool)
        bare = [w.strip(BEGIN + FINISH) for w in words]
        long_ = np.array([i for i, w in enumerate(bare) if len(w) >= ORDER], np.int64)
        distinct = list(dict.fromkeys(bare[i] for i in long_))
        at = {w: i for i, w in enumerate(distinct)}
        if len(long_):
            out[long_] = self._values(distinct, ~marked)[[at[bare[i]] for i in long_]]
        out[:, marked] = self._values(words, marked)[:, marked]
        return out

    def _values(self, words: list[str], among: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), len(self.strings)), np.float32)
        if not words or not among.any():
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        least = FAINT ** (1 / POWER) * (1 - 1e-6) * self.own  # what is less counts as 0
        for part in np.array_split(order, -(-len(order) // 2000)):
            w, z = np.nonzero(self._most([words[i] for i in part], among) >= least[among])
            if not len(w):
                continue
            z = np.flatnonzero(among)[z]
            own = codes([words[i] for i in part], int(sizes[part[-1]]), -1)
            for at in range(0, len(w), PAIRS):
                ws, zs = w[at : at + PAIRS], z[at : at + PAIRS]
                width = max(len(self.strings[k]) for k in set(zs.tolist()))
                out[part[ws], zs] = np.minimum(string_kernel(own[ws], self.codes[zs][:, :width]) / self.own[zs], 1.0) ** POWER
        out[out < FAINT] = 0
        return out


class Words:
    """Rows of kernel values by chunk (what stands between white space), remembered in bounded memory; row 0 is faint everywhere."""

    #: Bytes of the memory.
    LIMIT = 100_000_000

    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks = landmarks
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.values = np.zeros((256, len(self.landmarks.strings)), np.float32)
        self.used = 1
        self.bytes = 0

    def learn(self, chunks: list[str]) -> None:
        self.bytes += sum(map(len, chunks)) + 150 * len(chunks)
        own = [units(c) for c in chunks]
        words = list({w for ws in own for w in ws})
        found = self.landmarks.values(words)
        strong = found.max(1, initial=0) > 0
        at = {w: i for i, w in enumerate(words) if strong[i]}
        for c, ws in zip(chunks, own, strict=True):
            rows = [at[w] for w in ws if w in at]
            if not rows:
                self.row[c] = 0
                continue
            while self.used >= len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[self.used] = found[rows].max(0)
            self.row[c] = self.used
            self.used += 1
            self.bytes += self.values.itemsize * self.values.shape[1]

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pooled kernel values of the sentences that have any and the number of the text of each; rows of words likewise."""
        split = [[chunks_of(s) for s in SENTENCE.split(t.lower())] for t in texts]
        if self.bytes > self.LIMIT:
            self._clear()
        self.learn(list({c for own in split for s in own for c in s if c not in self.row}))
        get = self.row.__getitem__
        rows, starts, of = [], [], []
        for k, own in enumerate(split):
            for s in own:
                if found := [r for r in map(get, s) if r]:
                    starts.append(len(rows))
                    of.append(k)
                    rows += found
        if not rows:
            none = np.zeros(0, np.int64)
            return np.zeros((0, len(self.landmarks.strings)), np.float32), none, none, none
        of, rows = np.array(of), np.array(rows)
        return np.maximum.reduceat(self.values[rows], starts, axis=0), of, rows, np.repeat(of, np.diff([*starts, len(rows)]))


def chunks_of(sentence: str) -> list[str]:
    """The sentence's words; runs of single characters are also one word, as in ``i d i o t``."""
    chunks = sentence.split()
    if sum(map((1).__eq__, map(len, chunks))) > 3:
        run = ""
        for c in [*chunks, "  "]:
            if len(c) == 1:
                run += c
            else:
                if len(run) > 3:
                    chunks.append(run)
                run = ""
    return chunks


class Model:
    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slopes: np.ndarray, shift: float) -> None:
        self.landmarks, self.weights, self.bias, self.slopes, self.shift = landmarks, weights, bias, slopes, shift

    def scores(self, texts: list[str], words: Words) -> np.ndarray:
        out = [strongest(words, texts[part], self.weights, self.bias) @ self.slopes for part in batches_of(texts)]
        return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate([*out, np.zeros(0)]) + self.shift, -30, 30)))


def strongest(words: Words, texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """By text, decisions of its PLACES strongest words, each the worst of its sentence or next to it; of nothing, the bias."""
    out = np.full((len(texts), PLACES), bias)
    _, _, rows, of_row = words.sentences(texts)
    if len(rows):
        value = (words.values[: words.used] @ weights + bias)[rows]
        order = np.lexsort((-value, of_row))
        value, of_row = value[order], of_row[order]
        first = np.searchsorted(of_row, of_row)
        rank = np.arange(len(of_row)) - first
        on = rank < PLACES
        out[of_row[on], rank[on]] = np.maximum(value[on], bias)
    return out


def choose_landmarks(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Strings that toxic documents hold and others do not, each new one worth most where the earlier ones say least."""
    known: dict[str, list[str]] = {}

    def held(text: str) -> Counter[str]:
        """At how many words the text holds each string; of all strings, as long as no candidates are known."""
        own: Counter[str] = Counter()
        for c, n in Counter(text.lower().split()).items():
            if (found := known.get(c)) is None:
                found = list({w[i : i + k] for w in units(c) for k in range(SHORTEST, LONGEST + 1) for i in range(len(w) - k + 1)})
                if candidates is not None:
                    known[c] = found = [s for s in found if s in candidates]
            for s in found:
                own[s] += n
        return own

    candidates: set[str] | None = None
    toxic_texts = [t for t, y in zip(texts, toxic, strict=True) if y]
    n_bad, n_clean = len(toxic_texts), len(texts) - len(toxic_texts)
    least = max(3, n_bad // 200)
    count: Counter[str] = Counter()
    for t in toxic_texts:
        count.update(held(t).keys())
    candidates = {s for s, n in count.items() if n >= least}
    clean: Counter[str] = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            for s, n in held(t).items():
                clean[s] += min(n, PLACES)
    clean = {s: clean[s] / PLACES for s in candidates}
    bad = [{s: min(n, PLACES) / PLACES for s, n in held(t).items()} for t in toxic_texts]
    worth = dict.fromkeys(candidates, 0.0)
    for own in bad:
        for s, n in own.items():
            worth[s] += n
    worth = {s: w for s, w in worth.items() if w / n_bad > CLEANER * clean[s] / n_clean}
    bad = [{s: n for s, n in own.items() if s in worth} for own in bad]
    holders: dict[str, list[int]] = {}
    for i, own in enumerate(bad):
        for s in own:
            holders.setdefault(s, []).append(i)
    weight = np.ones(n_bad)
    chosen: list[str] = []
    while worth and len(chosen) < LANDMARKS:
        # Of strings worth the same, one without marks, as it is also met inside other words.
        best = max(worth, key=lambda s: (worth[s] / n_bad - CLEANER * clean[s] / n_clean, BEGIN not in s and FINISH not in s, len(s), s))
        if worth[best] / n_bad - CLEANER * clean[best] / n_clean < WORTH:
            break
        chosen.append(best)
        for i in holders[best]:
            met = weight[i] * bad[i][best] / 2
            for s, n in bad[i].items():
                if s in worth:
                    worth[s] -= n * met
            weight[i] -= met
        for s in [s for s in worth if s in best or best in s or _overlap(s, best)]:
            del worth[s]
    return chosen


def _overlap(a: str, b: str) -> bool:
    """Whether one ends with most of what the other begins with."""
    k = min(len(a), len(b)) - 1
    return k >= 3 and (a[-k:] == b[:k] or b[-k:] == a[:k])


def train(texts: list[str], toxic: np.ndarray, weight_toxic: float = 1.0, weight_clean: float = 1.0) -> Model:
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        p = 0.0 if not toxic.any() else 1.0
        return Model([], np.zeros(0), 0.0, np.zeros(PLACES), 30.0 * (2 * p - 1))
    strings = choose_landmarks(texts, toxic)
    marks = Landmarks(strings)
    words = Words(marks)
    x, of, rows, of_row = words.sentences(texts)
    # Words of a document stand beside its sentences, as one insult is enough, whatever words it is always met with.
    alone = np.unique(np.c_[of_row, rows], axis=0)
    x, of = np.r_[x, words.values[alone[:, 1]]], np.r_[of, alone[:, 0]]
    value, vector = np.linalg.eigh(marks.gram) if strings else (np.zeros(0), np.zeros((0, 0)))
    whiten = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T  # the Nyström map
    z = np.c_[x @ whiten, np.ones(len(x))]
    y = np.where(toxic[of], 1.0, -1.0) if len(of) else np.zeros(0)
    blank = np.r_[np.zeros(len(strings)), 1.0][None, :]  # the sentences without a trace of a landmark, all of them one point
    keep = np.ones(len(y), bool)
    w = np.zeros(len(strings) + 1)
    w[-1] = -1.0
    # Where clean documents are many, what they share with toxic ones says less; in full the share would drown rare insults.
    rarer = float(np.sqrt(max(1.0, (~toxic).sum() * weight_clean / (toxic.sum() * weight_toxic))))
    for _ in range(ROUNDS):
        if not keep.any():
            break
        w = squared_hinge(np.r_[z[keep], blank], np.r_[y[keep], -1.0], rarer)
        out = z @ w
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, of, out)
        keep = (y < 0) | (out >= worst[of] - 1e-9) | (out > 0)  # of a toxic document its worst sentences speak
    weights, bias = whiten @ w[:-1], float(w[-1])
    slopes, shift = platt(strongest(words, texts, weights, bias), toxic, np.where(toxic, weight_toxic, weight_clean))
    return Model(strings, weights, bias, slopes, shift)


def squared_hinge(z: np.ndarray, y: np.ndarray, clean: float = 1.0, c: float = 10.0) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton's method; the clean class weighs ``clean`` times the toxic one."""
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), clean * 0.5 / max(1, (y < 0).sum())) * c * 100
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        slack = 1 - y * (z @ w)
        on = slack > 0
        step = np.linalg.solve(ridge + 2 * (z[on] * cost[on, None]).T @ z[on], ridge @ w - 2 * z[on].T @ (cost[on] * y[on] * slack[on]))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def platt(out: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none below 0, and shift of the logistic curve over decisions, with softened targets.

    The first decision speaks where all say the same, so that a document with one insult is as toxic as those learned from.
    """
    n1, n0 = weight[toxic].sum(), weight[~toxic].sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[out, np.ones(len(out))]
    ridge = np.full(x.shape[1], 0.1)
    ridge[[0, -1]] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * (ridge * w * w).sum())

    on = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[-1] = np.log((n1 + 1) / (n0 + 1))
        for _ in range(100):  # Newton's method; a step that does not lower the loss is halved
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            g = x.T @ (weight * (p - target)) + ridge * w
            step = np.zeros(len(w))
            step[on] = np.linalg.solve(h[np.ix_(on, on)], g[on])
            before = loss(w)
            while np.abs(step).max() > 1e-9 and loss(w - step) > before:
                step /= 2
            w = w - step
            if np.abs(step).max() < 1e-7:
                break
        least = int(np.argmin(w[:-1]))
        if w[least] >= 0:
            return w[:-1], float(w[-1])
        on[least] = False


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents of each class, of at most LONGEST_TEXT characters.

    Null labels and ids teach nothing; of repeated rows of an id, one does, and of its labels the largest counts. What the driver
    gets follows ``sample`` and not the documents.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marked = written(marked, "toxicity-labels")
    chosen = written(sample_by_hash(marked, "id", "y", sample), "toxicity-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= LONGEST_TEXT)
    rows = texts.join(chosen, "id").dropDuplicates(["id"]).orderBy("id").toPandas()
    share = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    y = rows["y"].to_numpy() > 0
    return train(rows["text"].tolist(), y, share.get(1, 0) / max(1, int(y.sum())), share.get(0, 0) / max(1, int((~y).sum())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, score, predicted``: rows are independent, so null or repeated ids pass through.

    Null and empty texts have no sentence and get the score of a text without any trace of a landmark. An empty table
    gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex  # a worker that is reused must not take the words of another model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = worker_slot(key, lambda: Words(Landmarks(shared.value.landmarks)))
        for b in batches:
            p = shared.value.scores([t or "" for t in b["text"]], words)
            yield pd.DataFrame({id_col: b[id_col], "score": p, "predicted": (p >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"`{id_col}` long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 3) == 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fitted(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
