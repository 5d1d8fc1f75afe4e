"""Vector codes, the Merkle manifest and suffix-array deduplication, against brute force on small tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import common, induced, language_id, merkle, suffix_dedup, vector_codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((i, [int(np.floor(4096 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    if not kept:
        return {}, []
    dims = len(kept[0][1])
    width = -(-dims // parts)
    cut = [(i, [(v + [0] * (parts * width - dims))[p * width : (p + 1) * width] for p in range(parts)]) for i, v in kept if len(v) == dims]
    books = [[list(v[p]) for _, v in cut[:entries]] for p in range(parts)]

    def best(x, book):
        return min(((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book)))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v in cut:
                own.setdefault(best(v[p], books[p])[1], []).append(v[p])
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = [(i, "".join(f"{best(v[p], books[p])[1]:02x}" for p in range(parts)), sum(best(v[p], books[p])[0] for p in range(parts))) for i, v in cut]
    return out, books


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, part string, code string")


@pytest.mark.parametrize("dims", [16, 19, 0])
def test_vector_codes(spark, dims):
    """A hot part, repeated rows, null labels, odd rows and clashing columns."""
    rng = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in rng.normal(size=dims)] if i % 3 else [0.5] * dims, int(i) % 4 if i % 5 else None, "x", "y") for i in range(200)]
    rows += [rows[7], (300, None, 1, "x", "y")]
    if dims:
        rows += [(301, [float("nan")] * dims, 1, "", ""), (302, [None] * dims, 1, "", ""), (303, [1.0] * (dims + 1), 1, "", ""), (-5, [2.0] * dims, 2, "", ""), (304, [1e7] * dims, 2, "", "")]
    found, books = vector_codes.compress(vectors(spark, rows))
    want, own = brute_codes([r[:2] for r in rows])
    got = found.collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want) and books == own
    label = {r[0]: r[2] for r in rows}
    total = {}
    for i, _, e in want:
        total[label[i]] = total.get(label[i], 0) + e
    assert all(r.label_error == total[label[r.vec_id]] for r in got)


def test_vector_codes_of_nothing_and_of_few(spark):
    assert vector_codes.compress(vectors(spark, []))[0].count() == 0
    found, books = vector_codes.compress(vectors(spark, [(1, [1e300] * 8, None, "", ""), (2, [0.0] * 8, None, "", "")]))
    assert found.count() == 2 and len(books[0]) == 2


def test_hot_parts_are_bounded(spark, monkeypatch):
    """Parts below the bound of hot ones go the other way, with the same result."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 8)], i % 3, "", "") for i in range(300)]
    want = sorted(map(tuple, vector_codes.compress(vectors(spark, rows))[0].collect()))
    monkeypatch.setattr(vector_codes, "THOUSAND", 2)
    assert sorted(map(tuple, vector_codes.compress(vectors(spark, rows))[0].collect())) == want


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows):
    def leaf(r, lower=False):
        text = r[4].translate({k: k + 32 for k in range(65, 91)}) if lower and r[4] is not None else r[4]
        return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[1], text)))

    def tree(nodes):
        """The root and every node's path."""
        paths = [[] for _ in nodes]
        at, level = list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for k, i in enumerate(at):
                run, pos = level[i // 16 * 16 : i // 16 * 16 + 16], i % 16
                paths[k].append(("".join(run[:pos]), "".join(run[pos + 1 :])))
                at[k] = i // 16
            level = [H("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault((r[3] is not None, (r[3] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    keys, out = sorted(groups), []
    subs = {k: tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    root, tops = tree([subs[k][0] for k in keys])
    for n, k in enumerate(keys):
        for (_, _, node, r), path in zip(sorted(groups[k], key=lambda x: x[:3]), subs[k][1], strict=True):
            whole = path + tops[n]
            other = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in whole:
                other = H(a + other + b)
            out.append((r[0], node, subs[k][0], root, H("".join(a + b for a, b in whole)), other, other == root))
    return sorted(out, key=str)


MANIFEST = "doc_id long, n_chars long, lang string, source string, text string, leaf string, grp string"


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 40, 700])
def test_manifest(spark, levels, size):
    """One source with most rows, sources of one row, a null source, null and repeated ids, null fields, clashing columns."""
    rng = np.random.default_rng(size)
    rows = [(i, 3, "en", "hot" if i % 4 else f"s{i % 80}", f"Text {'É' * int(rng.integers(3))} {i}", "l", "g") for i in range(size)]
    if size > 1:
        rows += [(None, None, None, None, None, None, None), (5, 3, "en", None, "A", "l", "g"), (5, 3, "en", "hot", "A", "l", "g"), (5, 3, "en", "hot", "A", "l", "g"), (None, 1, "x", "hot", "B" * 30_000, "", ""), (8, 1, "", "", "", "", "")]
    df = spark.createDataFrame(rows, MANIFEST).repartition(5)
    got = merkle.manifest(df, tamper=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, levels=levels)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], MANIFEST)).count() == 0


def test_walk_keeps_one_run_of_each_level():
    """Every path is right for ragged ends, with no more than two runs of each level held."""
    for n in (1, 15, 16, 17, 255, 256, 257, 300):
        leaves = [H(str(k)) for k in range(n)]
        levels = merkle.levels_of(n, 3)
        root = merkle.root_of(leaves, levels)
        assert all(merkle.folded(leaf, path) == root for leaf, path in zip(leaves, merkle.walk(leaves, levels), strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_induced_order(monkeypatch, seed):
    """Suffixes and common prefixes to any depth: recursion down to the last name, tuples on disk, steps of a few."""
    rng = np.random.default_rng(seed)
    for it in range(60):
        depth, letters = int(rng.choice([3, 5, 8, 20])), int(rng.choice([1, 2, 3, 250]))
        parts = [bytes(rng.integers(0, letters, int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(int(rng.integers(1, 12)))]
        parts += [parts[0] * 3] * (it % 2)
        monkeypatch.setattr(induced, "STEP", int(rng.choice([3, 7, 1 << 20])))
        monkeypatch.setattr(induced.Tuples.__init__, "__defaults__", (int(rng.choice([0, 100, 1 << 27])),))
        text = [b for p in parts for b in [*(x + 2 for x in p), 1]] + [0]
        _, found = induced.sorted_suffixes(parts, depth, int(rng.choice([0, 3, 10**6])))
        found = list(found)
        pos, near = (np.concatenate([f[k] for f in found]).tolist() for k in (0, 1))
        assert sorted(pos) == list(range(len(text)))
        for a, b, n in zip(pos[:-1], pos[1:], near[1:], strict=True):
            x, y = text[a : a + depth], text[b : b + depth]
            assert x >= y and n == next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, starts string, hits string"


def brute_repeats(rows, window):
    first, out = {}, []
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, x in rows:
        if i is not None:
            for p in range(len(x) - window + 1):
                first[x[p : p + window]] = min(first.get(x[p : p + window], (i, p)), (i, p))
    for i, x in rows:
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - window + 1 if i is not None else 0):
            if first[x[p : p + window]] < (i, p):
                gone[p : p + window] = True
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        out.append((i, len(x), len(x) - len(kept), int((gone[1:-1] > gone[:-2]).sum() + gone[0]) if len(x) else 0, kept))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    """Periodic texts, passages at all places, a common line between differing neighbours, copies, odd rows."""
    rng = np.random.default_rng(5)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(n))

    line, shared = words(30), words(60)
    texts = ["a" * 700, "ab" * 300, "a" * 150, "abc" * 90 + words(9)] + [words(20) + line + words(20) for _ in range(40)]
    texts += [words(8) + shared[k * 3 :] + words(3) for k in range(40)] + [shared] * 10 + [words(2000)[:9000] * 2, "x" * 99, "y" * 100, "", None]
    rows = list(enumerate(texts))
    return rows + [rows[4], rows[50], (7, words(5) + line), (None, line), (None, None), (60, None)]


@pytest.mark.parametrize("hot", [2, 1000])
@pytest.mark.parametrize("window", [100, 40])
def test_repeats_of_bytes(spark, monkeypatch, passages, hot, window):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    df = spark.createDataFrame([(i, t, "", "", 0, "k", "i", "s", "h") for i, t in passages], DOCS).repartition(6)
    got = suffix_dedup.drop_repeats(df, window=window, hot=hot, base=0 if hot == 2 else induced.BASE).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute_repeats(passages, window)


def test_runs_of_long_texts(monkeypatch, passages):
    """A text has the same runs alone and in company, also where it is cut into segments, and every window is in one run."""
    texts = [(t or "").encode() for _, t in passages]
    for segment in (500, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        runs = suffix_dedup.Runs(texts, 100, 24)
        for k, t in enumerate(texts):
            own, alone = slice(runs.first[k], runs.first[k + 1]), suffix_dedup.Runs([t], 100, 24)
            assert (runs.start[own] == alone.start).all() and (runs.size[own] == alone.size).all() and (runs.least[own] == alone.least).all()
            assert alone.size.sum() == max(0, len(t) - 99) and (runs.twice[own] == alone.twice).all()


def test_runs_of_phrases():
    """A phrase too short for a repeat gives texts a minimizer in common, but no print; a longer passage gives both."""
    rng = np.random.default_rng(9)
    for size, met in ((45, False), (160, True)):
        both = 0
        for _ in range(20):
            texts = [bytes(rng.integers(97, 123, 300).astype(np.uint8)) for _ in range(2)]
            phrase = bytes(rng.integers(97, 123, size).astype(np.uint8))
            a, b = (suffix_dedup.Runs([t[:150] + phrase + t[150:]], 100, 24) for t in texts)
            both += len(np.intersect1d(a.least, b.least))
            assert (len(np.intersect1d(a.prints, b.prints)) > 0) == met
        assert both


def test_repeats_of_nothing(spark):
    assert suffix_dedup.drop_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_samples_of_any_count(spark):
    """A share of very many rows is computed, not overflown, and about as many are chosen as it says."""
    ids = spark.range(100_000).select(F.col("id"), F.lit(10**10).alias("n"))
    assert 800 < ids.where(common.in_sample(F.col("id"), F.col("n"), 10**8)).count() < 1200
    assert ids.where(common.in_sample(F.col("id"), F.lit(2**62), 400)).count() == 0


def test_language_of_long_texts_only(spark):
    """A language whose documents are all very long is learned as any other."""
    rows = [(i, "the house and the garden of the man " * 5, "en") for i in range(40)]
    rows += [(100 + i, "der garten und das haus des mannes ist " * 3000, "de") for i in range(4)]
    rows += [(200, None, "fr"), (201, "", "fr"), (None, "la maison", "fr"), (202, "el campo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, language_id.public_pieces(), "doc_id", "text", "lang")
    assert model.languages == ["de", "en"]
