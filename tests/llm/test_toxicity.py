"""The toxicity query against a plain version of its scores, and what words and documents count."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import toxicity

WORDS = ["tion", "ther", "house", "green", "water", "under", "editing", "stone", "river", "glass", "a", "of", "the"]


def kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    """All common subsequences, weighted by what they span in both strings, by recursion over their last characters."""

    def ends(u):
        out = {}
        frontier = [((i,), u[i]) for i in range(len(u))]
        for _ in range(order - 1):
            frontier = [((*at, j), w + u[j]) for at, w in frontier for j in range(at[-1] + 1, len(u))]
        for at, w in frontier:
            out[w] = out.get(w, 0.0) + decay ** (at[-1] - at[0] + 1)
        return out

    a, b = ends(s), ends(t)
    return sum(v * b.get(w, 0.0) for w, v in a.items())


def plain_score(text, model):
    """Every word on its own: its values with all landmarks, the three largest decisions, and the logistic curve."""
    decisions = []
    own = [kernel(z, z) for z in model.landmarks]
    for sentence in re.split(r"[.!?]+\s+|\n+", (text or "").lower()):
        for chunk in sentence.split():
            word = re.sub(r"^[\W_]+|[\W_]+$", "", chunk)
            if not word:
                continue
            x = np.array([min(kernel("\x02" + word + "\x03", z) / o, 1.0) ** toxicity.POWER for z, o in zip(model.landmarks, own, strict=True)])
            x[x < toxicity.FAINT] = 0
            if x.any():
                decisions.append(float(x @ model.weights + model.bias))
    top = (sorted(decisions, reverse=True) + [model.bias] * 3)[:3]
    return 1 / (1 + np.exp(-(np.array(top) @ model.slopes + model.shift)))


def corpus(n, insults, each, seed=3, stray=0.0):
    """Every fourth text holds ``each`` insults, of others a share holds one."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = list(rng.choice(WORDS, 18))
        for _ in range(each if i % 4 == 0 else int(rng.random() < stray)):
            words.insert(int(rng.integers(len(words))), str(rng.choice(insults)))
        out.append((i, " ".join(words[:9]) + ". " + " ".join(words[9:]), int(i % 4 == 0)))
    return out


def written_tables(spark, path, rows):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_query_by_brute_force(spark, tmp_path):
    rows = corpus(240, ["grumbolt", "zwackel"], 2, stray=0.1)
    rows += [(900, None, 0), (901, "", None), (902, "such a grum-bolt and zwackels", None), (None, "a grumbolt zwackel", 1), (4, "the river", 0)]
    written_tables(spark, tmp_path, rows)
    got = toxicity.op4_toxicity(spark, str(tmp_path)).collect()
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fitted(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    want = sorted((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(float(plain_score(t, model)), 4)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, round(r.score, 4)) for r in got) == want
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    label = {i: y for i, _, y in rows[:240]}
    held = [r for r in got if r.held_out and r.doc_id in label and r.doc_id != 4]
    assert len(held) > 50 and sum(r.predicted != label[r.doc_id] for r in held) <= 1


def test_labels_of_held_out_rows_teach_nothing(spark, tmp_path):
    rows = corpus(120, ["grumbolt"], 2)
    turned = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, t, y in rows]
    written_tables(spark, tmp_path / "a", rows)
    written_tables(spark, tmp_path / "b", turned)
    a, b = ({r.doc_id: r.score for r in toxicity.op4_toxicity(spark, str(tmp_path / d)).collect()} for d in "ab")
    assert a == b


@pytest.mark.parametrize("insult", ["gek", "zo", "grumbolt"])
def test_short_words_are_compared(insult):
    rows = corpus(200, [insult], 1)
    model = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    p = model.scores([f"the {insult}, a house", "the green house", ""], toxicity.Words(toxicity.Landmarks(model.landmarks)))
    assert p[0] >= toxicity.THRESHOLD > max(p[1:])


def test_beginnings_of_words_tell():
    """A string that is common inside words is an insult only where words begin with it."""
    bad = ["achlicher", "achlichten", "achlichung", "achlichpf"]
    good = ["verachlich", "einachlich", "geachlichte", "unachlicher", "beachlichen"]
    rng = np.random.default_rng(8)
    rows = [(i, t + " " + " ".join(rng.choice(good, 3)), y) for i, t, y in corpus(240, bad, 2)]
    model = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    p = model.scores(["der achlichst und achlichkeit", "ein verachlichst und geachlichkeit"], toxicity.Words(toxicity.Landmarks(model.landmarks)))
    assert p[0] >= toxicity.THRESHOLD > p[1]


def test_a_second_word_decides():
    """Where clean documents hold one such word as often, two of them make a document toxic."""
    rows = corpus(400, ["zwackel", "zwackelt", "zwackels"], 3, stray=0.3)
    model = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    p = model.scores(["the zwackel house", "the zwackel house. of zwackels, zwackel"], toxicity.Words(toxicity.Landmarks(model.landmarks)))
    assert p[1] >= toxicity.THRESHOLD > p[0]


def test_kernel_only_where_it_may_count(monkeypatch):
    """Values are those of all pairs, letter by letter, and most pairs that share some letters are never compared."""
    rng = np.random.default_rng(3)
    landmarks = ["idiot", "trash", "worthles", "aabbaa", toxicity.BEGIN + "scum", "loser" + toxicity.FINISH]
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(n))) for n in rng.integers(2, 15, 1500)]
    words = random_ = [toxicity.BEGIN + w + toxicity.FINISH for w in words]
    near = [w[:k] + x + w[k + j :] for w in ("idiot", "trash", "worthless", "aabbaabb", "scum", "loser") for k in range(len(w)) for x in ("", "i", "ss") for j in (0, 1)]
    words = random_ + [toxicity.BEGIN + w + toxicity.FINISH for w in [*near, "i.d.i.o.t", "iiddiioott", "wrothles", "", "ab", "🙂" * 9]]
    marks, pairs, kernel = toxicity.Landmarks(landmarks), [], toxicity.string_kernel
    own = toxicity.codes(words, 22, -1)
    want = np.array([kernel(own, np.repeat(marks.codes[[k]], len(words), 0)) / marks.own[k] for k in range(len(landmarks))]).T
    want = np.minimum(want, 1.0) ** toxicity.POWER
    want[want < toxicity.FAINT] = 0
    assert np.abs(marks.values(words) - want).max() < 1e-6 and (want > 0).sum() > 100
    monkeypatch.setattr(toxicity, "string_kernel", lambda s, t: pairs.append(len(s)) or kernel(s, t))
    marks.values(random_)
    assert sum(pairs) < 0.08 * len(random_) * len(landmarks)
