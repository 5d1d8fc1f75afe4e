"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is fixed and public; only the probabilities of its pieces are learned, one set per
language, by expectation maximisation over the words of a bounded sample of labelled documents. A
forward pass sums the probability of a word over every way to cut it into pieces. A text's score is
the posterior of its best language under equal priors, over all its words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, id_remainder, sample_by_hash, table, text_slices, worker_slot

#: Documents of each language that the probabilities are learned from, chosen by the hash of their id.
SAMPLE = 400
#: Rounds of expectation maximisation, and what is added to every expected count.
ROUNDS, ADDED = 3, 0.05
#: Characters of the longest piece that is used, and of the words that are scored side by side.
LONGEST, SIDE_BY_SIDE = 8, 40

#: Score below which a filter rejects a text.
LEAST = 0.5

LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"


def public_pieces(path: str | None = None) -> list[str]:
    """The pieces of the public vocabulary that letters can form, lower case; ``▁`` starts a word."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in found if len(p) <= LONGEST and LETTERS.fullmatch(p.removeprefix("▁") or "a"))


class Lattice:
    """The pieces that can end at each character of each word; piece 0 is none, piece 1 any single unknown character."""

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces) + 2
        after: dict[int, int] = {}
        piece = [0]
        for number, text in enumerate(pieces, 2):
            state = 0
            for c in text:
                key = state << 21 | ord(c)
                if key not in after:
                    after[key] = len(piece)
                    piece.append(0)
                state = after[key]
            piece[state] = number
        self.piece = np.array(piece, np.int32)  # the piece that a state of the trie completes
        # The trie's steps, by state and character; the last one is no step of any text.
        self.steps = np.array([*sorted(after), np.iinfo(np.int64).max], np.int64)
        self.after = np.array([*(after[k] for k in sorted(after)), 0], np.int64)

    def ends(self, words: list[str]) -> np.ndarray:
        """Of words of one length: piece numbers by word, end and length of the piece. All places walk the trie side by side."""
        n = len(words[0])
        characters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(-1, n)
        out = np.zeros((len(words), n, LONGEST), np.int32)
        row, end = (x.ravel() for x in np.indices(characters.shape))
        state = np.zeros(len(row), np.int64)
        for size in range(LONGEST):
            key = state << 21 | characters[row, end]
            at = np.searchsorted(self.steps, key)
            on = self.steps[at] == key
            row, end, state = row[on], end[on], self.after[at[on]]
            out[row, end, size] = self.piece[state]
            inside = end + 1 < n
            row, end, state = row[inside], end[inside] + 1, state[inside]
        alone = out[:, :, 0]
        alone[alone == 0] = 1
        return out

    def forward(self, ends: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums, scaled at every character, and the words' log probabilities by language. p: pieces by language."""
        rows, n, _ = ends.shape
        a = np.zeros((n + 1, rows, p.shape[1]))
        a[0] = 1.0
        log = np.zeros((rows, p.shape[1]))
        for end in range(1, n + 1):
            for size in range(1, min(LONGEST, end) + 1):
                a[end] += a[end - size] * p[ends[:, end - 1, size - 1]]
            if end % 16 == 0 or end == n:  # keeps the sums in range, whatever the word's length
                scale = a[end].copy()
                a[max(0, end - LONGEST + 1) : end + 1] /= scale
                log += np.log(scale)
        return a, log

    def log_probabilities(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), p.shape[1]))
        for idx, own in by_length(words):
            _, out[idx] = self.forward(self.ends(own), p)
        return out

    def expected(self, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of every piece under ``p`` (one language), over all segmentations."""
        counts = np.zeros(self.size)
        for idx, own in by_length(words):
            ends, w = self.ends(own), weights[idx]
            n = ends.shape[1]
            if n > SIDE_BY_SIDE:  # their sums leave the range of numbers
                counts += self._expected_in_logs(ends, w, p)
                continue
            a = np.zeros((n + 1, len(own)))
            b = np.zeros((n + 1, len(own)))
            a[0] = b[n] = 1.0
            for end in range(1, n + 1):
                for size in range(1, min(LONGEST, end) + 1):
                    a[end] += a[end - size] * p[ends[:, end - 1, size - 1]]
            for end in range(n, 0, -1):
                for size in range(1, min(LONGEST, end) + 1):
                    b[end - size] += b[end] * p[ends[:, end - 1, size - 1]]
            for end in range(1, n + 1):
                for size in range(1, min(LONGEST, end) + 1):
                    e = ends[:, end - 1, size - 1]
                    counts += np.bincount(e, a[end - size] * p[e] * b[end] / a[n] * w, self.size)
        counts[0] = 0
        return counts

    def _expected_in_logs(self, ends: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        counts = np.zeros(self.size)
        rows, n, _ = ends.shape
        with np.errstate(divide="ignore"):
            log = np.log(p)
        a, b = np.full((n + 1, rows), -np.inf), np.full((n + 1, rows), -np.inf)
        a[0] = b[n] = 0.0
        for end in range(1, n + 1):
            for size in range(1, min(LONGEST, end) + 1):
                a[end] = np.logaddexp(a[end], a[end - size] + log[ends[:, end - 1, size - 1]])
        for end in range(n, 0, -1):
            for size in range(1, min(LONGEST, end) + 1):
                b[end - size] = np.logaddexp(b[end - size], b[end] + log[ends[:, end - 1, size - 1]])
        for end in range(1, n + 1):
            for size in range(1, min(LONGEST, end) + 1):
                e = ends[:, end - 1, size - 1]
                counts += np.bincount(e, np.exp(a[end - size] + log[e] + b[end] - a[n]) * w, self.size)
        return counts


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        side_by_side = max(1, min(4096, 100_000 // max(1, sizes[group[0]]))) if len(group) else 1
        for at in range(0, len(group), side_by_side):
            part = group[at : at + side_by_side]
            if len(part):
                yield part, [words[i] for i in part]


def words_of(chunk: str) -> list[str]:
    return ["▁" + w for w in LETTERS.findall(chunk.lower())]


class Model:
    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray) -> None:
        self.languages, self.pieces, self.p = languages, pieces, p


def learn(labelled: DataFrame, pieces: list[str], id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model:
    """Piece probabilities by language from about ``sample`` documents of each, whatever their length.

    Words are counted in tasks; the driver gets counts of different words. These grow with the number of languages, not of documents.
    """
    own = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = sample_by_hash(own.where("lang is not null and id is not null and text is not null"), "id", "lang", sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        total: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                total.setdefault(lang, Counter()).update(w for c in text.split() for w in words_of(c))
        for lang, own in total.items():
            if own:
                yield pd.DataFrame({"lang": lang, "word": list(own), "n": list(own.values())})

    counted = rows.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    lattice = Lattice(pieces)
    languages = sorted(counted["lang"].unique())
    p = np.zeros((lattice.size, len(languages)))
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang].sort_values("word")
        words, n = own["word"].tolist(), own["n"].to_numpy(float)
        q = np.full(lattice.size, 1.0 / lattice.size)
        q[0] = 0
        for _ in range(ROUNDS):
            q = lattice.expected(words, n, q) + ADDED
            q[0] = 0
            q /= q.sum()
        p[:, k] = q
    return Model(languages, pieces, p)


class Scorer:
    """Log probabilities of chunks (what stands between white space), remembered in bounded memory."""

    #: Bytes of the memory.
    LIMIT = 100_000_000

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, Lattice(model.pieces)
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.bytes = 0
        self.logs = np.zeros((1024, len(self.model.languages) + 1))  # the last column: letters

    def _learn(self, chunks: list[str]) -> None:
        own = [words_of(c) for c in chunks]
        words = list({w for ws in own for w in ws})
        logs = self.lattice.log_probabilities(words, self.model.p) if words else np.zeros((0, len(self.model.languages)))
        at = {w: i for i, w in enumerate(words)}
        start = len(self.row)
        while start + len(chunks) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        flat = np.array([at[w] for ws in own for w in ws], np.int64)
        sizes = np.array([len(ws) for ws in own], np.int64)
        to = np.repeat(np.arange(start, start + len(chunks)), sizes)
        for k in range(logs.shape[1]):
            self.logs[start : start + len(chunks), k] = np.bincount(to - start, logs[flat, k], len(chunks)) if len(flat) else 0
        self.logs[start : start + len(chunks), -1] = sizes
        self.row.update(zip(chunks, range(start, start + len(chunks)), strict=True))
        self.bytes += sum(map(len, chunks)) + len(chunks) * (150 + 8 * self.logs.shape[1])

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for part in batches_of(texts):
            split = [t.lower().split() for t in texts[part]]
            if self.bytes > self.LIMIT:
                self._clear()
            self._learn(list({c for own in split for c in own if c not in self.row}))
            get = self.row.__getitem__
            for own in split:
                total = self.logs[np.fromiter(map(get, own), np.int64, len(own))].sum(0)
                if not total[-1] or not self.model.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                z = total[:-1] - total[:-1].max()
                best = int(z.argmax())
                langs.append(self.model.languages[best])
                scores.append(float(1.0 / np.exp(z).sum()))
        return langs, scores


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score``: ``und`` and 0 where a text is null or has no letter, or nothing was learned.

    Empty texts have no letter. Rows are independent: null or repeated ids pass through. An empty table gives an
    empty result; other columns are ignored. Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.p))
    key = uuid.uuid4().hex  # a worker that is reused must not take the scorer of another model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = worker_slot(key, lambda: Scorer(Model(*shared.value)))
        for b in batches:
            langs, scores = scorer.score([t or "" for t in b["text"]])
            yield pd.DataFrame({id_col: b[id_col], "lang_pred": langs, "score": scores})

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"`{id_col}` long, lang_pred string, score double")


def in_known_language(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and a score of at least ``least``; all columns pass through.

    Null texts and texts without a letter have no language and go, and so does every row if nothing was learned. Null and repeated
    ids, and columns of any name, pass through. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.p))
    key = uuid.uuid4().hex  # a worker that is reused must not take the scorer of another model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_slot(key, lambda: Scorer(Model(*shared.value)))
        for b in batches:
            for part, texts in text_slices(b.column(text_col), 4_000_000):
                langs, scores = scorer.score(texts)
                keep = [lang != UNKNOWN and s >= least for lang, s in zip(langs, scores, strict=True)]
                yield b.slice(part.start, len(texts)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 5) == 0


def fitted(docs: DataFrame, pieces: list[str] | None = None) -> Model:
    return learn(docs.where(~held_out(F.col("doc_id"))), pieces or public_pieces(), "doc_id", "text", "lang")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fitted(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
