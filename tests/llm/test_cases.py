"""Hot groups, narrow forms, clashing columns and the corpus pipeline, against brute force on small tables."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import common, exact_dedup, language_id, ngram_join, packing, pii, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    least = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return {i: (len(s), least[i]) for i, s in sets.items()}


@pytest.fixture(scope="module")
def hot():
    """A chain of near copies, a group of variants just below and above the threshold, one very common line, copies."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(5000)]
    line = " ".join(rng.choice(words, 25))
    base = list(rng.choice(words, 90))
    texts, chain = [], list(rng.choice(words, 80))
    for _ in range(25):
        chain[int(rng.integers(80))] = str(rng.choice(words))
        texts.append(" ".join(chain))
    for _ in range(60):
        own = list(base)
        for at in rng.choice(90, int(rng.integers(1, 4)), replace=False):
            own[at] = str(rng.choice(words))
        texts.append(" ".join(own))
    texts += [line + " " + " ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(60)]
    texts += [line] * 20 + texts[3:6]
    return list(enumerate(texts))


def test_ngram_join_of_hot_groups(spark, hot):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, hot)).collect()}
    assert got == brute_components(hot)


def test_blocks_of_one_column(spark):
    """Rows of a column are compared across blocks, also the frequent component with the rest."""
    rows = [(1, k, 10, 10, 0, True, 0 if k < 7 else k) for k in range(12)]
    placed = spark.createDataFrame(rows, "column long, node long, n long, s long, i long, index boolean, component long")
    sketch = bytes(32)
    sketches = spark.createDataFrame([(k, sketch) for k in range(12)], "node long, sketch binary")
    got = {(r.node, r.pivot) for r in ngram_join.open_pairs(placed, sketches, 80, block=2).collect()}
    assert got == {(a, b) for a in range(12) for b in range(a) if not (a < 7 and b < 7)}


def test_overlaps_accumulate():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64) * np.uint64(2))
    partners = []
    for k in range(40):
        own = np.concatenate([x[: 100 - k], rng.integers(0, 2**63, k).astype(np.uint64)])
        partners.append((k, 100, own))
    want = [k for k, _, own in partners if len(np.intersect1d(own, x)) >= ngram_join.need(100, 100, 80)]
    assert ngram_join.overlaps((100, x), partners, 80) == want


def test_large_ids_beside_null_ids(spark):
    big = 2**60 + 1
    df = docs(spark, [(big, "a b c d e f"), (None, "a b c d e f"), (None, "")])
    got = sorted(ngram_join.jaccard_components(df).collect(), key=str)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(big, 2, big), (None, 2, big), (None, 0, None)}


def test_substring_of_hot_lines(spark, hot):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in hot}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r.doc_id: r.kept_text for r in substring_dedup.drop_repeats(docs(spark, hot).repartition(7)).collect()}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                keep[k : k + 13] = [False] * 13
        assert got[i] == " ".join(x for x, y in zip(w, keep, strict=True) if y)


def test_segments_of_word_hashes(monkeypatch):
    text = " ".join(f"word{k}" for k in range(500))
    whole = common.WordBatch([text, "a b"])
    monkeypatch.setattr(common, "SEGMENT", 64)
    parts = common.WordBatch([text, "a b"])
    assert (whole.hashes == parts.hashes).all() and (whole.again() == parts.again()).all() and (whole.hashes != whole.again()).all()


def test_private_data_of_narrow_forms_and_long_hosts(spark):
    texts = [f"write to {c}@x.org now" for c in "abcdefghijklmnopqrstuvwxyz"] + ["a@x" + ".bc" * 30_000 + " end"]
    out = [r.text for r in pii.replace_private(docs(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    assert len({re.search(r"\S+@\S+", t)[0] for t in out[:26]}) == 26
    assert all(t != o and t.startswith("write to ") and t.endswith(".org now") for t, o in zip(out[:26], texts, strict=False))
    assert out[26].endswith(".bc end") and "a@x.bc" not in out[26]


def test_private_names_without_titles(spark):
    texts = ["Mr Smith wrote. Smith left, and Smithson came.", "Call 555-1234 or 0171 2345678, not 2020-2021.", "Smith alone.", "Mrs O'Neil's dog. O'Neil ran."]
    got = {r.doc_id: r for r in pii.replace_private(docs(spark, list(enumerate(texts))), "k").collect()}
    name = re.match(r"Mr (\w+) wrote\. (\w+) left, and Smithson came\.", got[0].text)
    assert name and name[1] == name[2] != "Smith" and got[0].n_replaced == 2
    assert "555-1234" not in got[1].text and "2345678" not in got[1].text and got[1].text.endswith("not 2020-2021.")
    assert got[2].text == texts[2]
    assert "O'Neil" not in got[3].text and re.match(r"Mrs (\S+)'s dog\. \1 ran\.", got[3].text)


def test_private_names_are_entities_by_parts(spark):
    """One surname has one surrogate whatever stands around it, and no two share one."""
    n = 4000
    surname = ["".join("bcdfghjkmn"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i:04d}").capitalize() for i in range(n)]
    texts = [f"we met Mr {x} there" if i % 2 else f"we met Dr {x} and later Mr {x} and {x} and MR {x.upper()}, Mr {x.upper()}" for i, x in enumerate(surname)]
    out = [r.text.split() for r in pii.replace_private(docs(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    new = [w[3] for w in out]
    assert len(set(new)) == n and not set(new) & set(surname)
    assert all(w[7] == w[9] == w[3] and w[12] == w[3].upper() + "," and w[14] == w[3].upper() for w in out[::2])


def test_private_names_keep_form_and_gender(spark):
    texts = ["Prof Ana O'Brien-Smith and Mr Brien met; then Ana and Smith left.", "here Mrs Ana Lee spoke", "with Dr Kim Lee", "Mr Will said so. Will it rain? It will, said Will."]
    out = [r.text for r in pii.replace_private(docs(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    first = re.fullmatch(r"Prof (\w+na) O'(\w+r)-(\w+r) and Mr (\w+) met; then (\w+) and (\w+) left\.", out[0])
    assert first and first[2] == first[4] and first[1] == first[5] and first[3] == first[6]
    lee = re.fullmatch(r"here Mrs (\w+) (\w+) spoke", out[1])
    kim = re.fullmatch(r"with Dr (\w+ne) (\w+)", out[2])
    assert lee[1] == first[1] and lee[2] == kim[2]
    will = re.fullmatch(r"Mr (\w+r) said so\. Will it rain\? It will, said (\w+)\.", out[3])
    assert will and will[1] == will[2]


def test_private_numbers_told_by_a_word(spark):
    texts = ["SSN: 123456789 and ssn 123456789", "passport no. AB1234567 of 2020", "call 555 123 4567 now", "in 123456789 cases", "1 555 123 4567 8 of them"]
    out = [r.text for r in pii.replace_private(docs(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    same = re.fullmatch(r"SSN: (\d{9}) and ssn (\d{9})", out[0])
    assert same and same[1] == same[2] != "123456789"
    assert re.fullmatch(r"passport no\. [A-Z]{2}\d{7} of 2020", out[1]) and out[1] != texts[1]
    assert re.fullmatch(r"call \d{3} \d{3} \d{4} now", out[2]) and out[2] != texts[2]
    assert out[3:] == texts[3:]


def test_private_names_of_a_long_document(spark):
    names = ["".join("bcdfghjkmn"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i:04d}").capitalize() for i in range(3000)]
    text = " ".join(f"then Mr {x} came, and {names[(7 * i) % 3000]} too." for i, x in enumerate(names))
    got = pii.replace_private(docs(spark, [(1, text)]), "k").collect()[0]
    words = re.findall(r"Mr (\w+) came, and (\w+) too", got.text)
    assert got.n_replaced == 6000 and [b for _, b in words] == [words[(7 * i) % 3000][0] for i in range(3000)]


def test_private_columns_of_any_name(spark):
    df = docs(spark, [(1, "x@y.org"), (2, "none")]).withColumns({c: F.lit("mine") for c in ("row", "new", "_new", "_row", "entities", "known", "parts")})
    out = pii.replace_private(df, "k")
    assert out.columns == [*df.columns, "n_replaced"]
    assert all(r._new == r._row == r.row == r.new == r.parts == "mine" for r in out.collect())


def test_private_surrogates_by_brute_force(spark):
    """Equal entities get equal surrogates, others get others, and no surrogate is an entity."""
    rng = np.random.default_rng(2)
    mails = [f"u{rng.integers(60)}@h{rng.integers(3)}.net" for _ in range(300)]
    out = [r.text for r in pii.replace_private(docs(spark, [(i, f"<{m}> {m.upper()}") for i, m in enumerate(mails)]), "k").orderBy("doc_id").collect()]
    pairs = {m: re.match(r"<(\S+)> (\S+)", t).groups() for m, t in zip(mails, out, strict=True)}
    assert len({a for a, _ in pairs.values()}) == len(pairs) and not {a for a, _ in pairs.values()} & set(mails)
    assert all(re.match(r"<(\S+)> (\S+)", t).groups() == pairs[m] for m, t in zip(mails, out, strict=True))


def test_letters_are_letters():
    assert language_id.words_of("½ Ⅷ ² ①") == [] and language_id.words_of("Straße 12") == ["▁straße"]


def test_long_words_teach_like_short_ones():
    lattice = language_id.Lattice(["a", "b", "ab"])
    p = np.array([0, 0.1, 0.3, 0.4, 0.2])
    short = lattice.expected(["ab" * 20], np.ones(1), p)
    ends = lattice.ends(["ab" * 20])
    assert lattice._expected_in_logs(ends, np.ones(1), p) == pytest.approx(short)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Every stage on nulls, empty texts, repeated rows, an extra column and an empty table."""
    rng = np.random.default_rng(9)
    en, de = ["the", "water", "house", "with", "thing", "there"], ["und", "wasser", "schule", "nicht", "straße", "immer"]
    texts = [" ".join(rng.choice(en if k % 2 else de, 60)) for k in range(40)]
    rows = [(k, t, "en" if k % 2 else "de", "s", len(t), "x") for k, t in enumerate(texts)]
    near = texts[1] + " mail bob@site.org"
    rows += [(100, None, "en", "s", 0, "x"), (101, "", "en", "s", 0, "x"), (102, "12 !!", "en", "s", 5, "x"), (103, texts[0], "de", "s", 1, "x"), (103, texts[0], "de", "s", 1, "x"), (104, near, "en", "s", 1, "x"), (None, texts[2] + " neu", "de", "s", 1, "x")]
    for name, own in (("full", rows), ("none", [])):
        spark.createDataFrame(own, SCHEMA + ", text_sha256 string").coalesce(2).write.parquet(str(tmp_path / name / "documents.parquet"))
    first = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    seen, now = {}, first
    for name, stage in corpus_pipeline.STAGES:
        now = common.written(stage(spark, now, str(tmp_path / "full")), "test-stage")
        seen[name] = now
        if name != "packed":
            assert now.columns == first.columns
    ids = {k: Counter(r.doc_id for r in v.collect()) for k, v in seen.items()}
    assert not {100, 101, 102} & set(ids["language"]) and ids["language"][103] == 2
    assert 0 not in ids["exact"] and ids["exact"][103] == 1  # the largest id of equal texts stays, once
    kept = {i: r.text for i, r in ((r.doc_id, r) for r in seen["exact"].collect()) if i is not None}
    want = {i for i, (_, least) in brute_components(list(kept.items())).items() if i == least}
    assert set(ids["near"]) - {None} == want
    private = {r.doc_id: r for r in seen["private"].collect()}
    assert set(private) == set(ids["near"]) and all("bob@site.org" not in r.text and r.n_chars == len(r.text) for r in private.values())
    pieces = seen["packed"].collect()
    assert {r.doc_id for r in pieces} == set(private)
    size = Counter()
    for r in pieces:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 2048 and len(size) <= -(-sum(size.values()) // 2048) + 1
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_packing_is_near_its_bound(spark):
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 2049, 4000)
    bins, offsets = packing.place(lengths, 2048)
    assert len(set(bins)) <= 1.02 * lengths.sum() / 2048 + 1
    for b in np.unique(bins)[:50]:
        own = bins == b
        order = np.argsort(offsets[own])
        assert (np.cumsum([0, *lengths[own][order][:-1]]) == offsets[own][order]).all()


def test_exact_without_a_filter(spark, hot):
    rows = docs(spark, hot).withColumn("_text", F.lit("mine")).withColumn("digest", F.lit("mine")).repartition(20)
    same = [sorted(exact_dedup.exact_duplicates(rows, keep="largest", broadcast=b).collect()) for b in (64 << 20, 0)]
    assert same[0] == same[1] and len(same[0]) == len(hot)
    texts = dict(hot)
    kept = exact_dedup.drop_exact_duplicates(rows, keep="largest")
    assert kept.columns == rows.columns and Counter(r.text for r in kept.collect()) == Counter(set(texts.values()))
