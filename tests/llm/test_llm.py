"""Operators of the subpackage against brute force, on small and on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronolith.llm import bpe, chat, components, embedding_dedup, exact_dedup, language_id, ngram_join, packing, pii, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", "clash") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, near copies, a shared passage, a repeated row and a null id."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    base = " ".join(rng.choice(words, 80))
    passage = " ".join(rng.choice(words, 30))
    texts = [None, "", " \t\n", "one two", "ONE two", "a", base, base, base + " end", base.replace("w1", "v1", 1), passage + " x", "y " + passage, " ".join(rng.choice(words, 20_000)), "é" * 5, "<|endoftext|> it's"]
    texts += [" ".join(rng.choice(words, 60)) for _ in range(30)] + [base + f" tail{k}" for k in range(40)]
    return [*enumerate(texts)]


def test_exact(spark, odd):
    for digest in (exact_dedup.sha256_digest, lambda c: F.hex(F.length(c) % 3).cast("binary")):
        got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(spark, odd), keep="largest", digest=digest).collect()}
        for i, t in odd:
            same = [j for j, u in odd if (u or "") == (t or "")]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
            assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(docs(spark, [*odd, odd[3], (None, "x"), (None, "x")]))
    assert kept.where("doc_id = 3").count() == 1 and kept.where("doc_id is null").count() == 2
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_ngram_join(spark, odd):
    sets = {}
    for i, t in odd:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, odd)).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    assert ngram_join.jaccard_components(docs(spark, [(None, "a b c"), (1, "a b c")])).count() == 2


def test_substring(spark, odd):
    words = {i: WORD.findall(t or "") for i, t in odd}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(docs(spark, odd)).collect()}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                keep[k : k + 13] = [False] * 13
        assert got[i].kept_text == " ".join(x for x, y in zip(w, keep, strict=True) if y) and got[i].n_words == len(w)
    assert substring_dedup.drop_repeats(docs(spark, [])).count() == 0
    assert substring_dedup.drop_repeats(docs(spark, [(None, "a b"), (1, None)])).count() == 2


def test_toxicity_catches_gaps_and_leaves_clean_words(spark):
    rng = np.random.default_rng(5)
    words = ["tion", "ther", "house", "green", "water", "under", "editing", "stone", "river", "glass"]
    texts = [" ".join(rng.choice(words, 25)) for _ in range(200)]
    toxic = np.arange(200) % 4 == 0
    texts = [t + " you grumbolt" if y else t for t, y in zip(texts, toxic, strict=True)]
    model = toxicity.train(texts, toxic)
    got = [r.predicted for r in toxicity.score(docs(spark, [(0, "such a grumbolt. house"), (1, "a grum-bolt here"), (2, "the green house"), (3, None), (4, "")]), model).orderBy("doc_id").collect()]
    assert got[0] == 1 and got[2:] == [0, 0, 0]
    assert toxicity.Landmarks(["idiot"]).values(["idiot", "idxiot", "edition"])[:, 0].tolist() == pytest.approx([1, 0.42, 0], abs=0.05)
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert toxicity.train(["a"], np.array([False])).scores(["x"], toxicity.Words(toxicity.Landmarks([])))[0] < 0.1


def test_string_kernel_by_brute_force():
    from itertools import combinations

    def brute(s, t, n, d):
        total = 0.0
        for a in combinations(range(len(s)), n):
            for b in combinations(range(len(t)), n):
                if [s[i] for i in a] == [t[i] for i in b]:
                    total += d ** (a[-1] - a[0] + b[-1] - b[0] + 2)
        return total

    for s, t in (("idiot", "idxiot"), ("abcabc", "cabcab"), ("aaaaa", "aaaa")):
        got = toxicity.string_kernel(toxicity.codes([s], 8, -1), toxicity.codes([t], 8, -2), 3, 0.7)[0]
        assert got == pytest.approx(brute(s, t, 3, 0.7))


def test_packing(spark, odd):
    tokenizer = packing.word_tokenizer()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    rows = packing.pack(docs(spark, odd), tokenizer, with_ids=True).toPandas()
    for i, t in odd:
        own = rows[rows.doc_id == i].sort_values("piece")
        ids = [x for b in own.ids for x in np.frombuffer(b, "<u4").tolist()]
        assert ids == [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and (own.length[:-1] == 2048).all()
    by = rows.sort_values("offset").groupby("sequence_id").length
    assert by.sum().max() <= 2048 and by.sum().sum() == rows.length.sum()
    assert packing.pack(docs(spark, []), tokenizer).count() == 0


def test_new_words_of_packing(monkeypatch):
    """Latin words go to the tokenizer's model alone, all others through the whole tokenizer; the ids are the library's."""
    tok = packing.Tokens(packing.word_tokenizer())
    letters = [chr(c) for c in range(0x250) if not chr(c).isspace()]
    texts = [" ".join(a + "é" + b for a, b in zip(letters, reversed(letters), strict=True)), " ".join(letters), "".join(letters)]
    texts += ["Straße, l'été — qu'il N'EST 3½²x; ÀÉÎ ŒUVRE ǅ İSTANBUL ſ K Å", "e\u0301te\u0301 été 日本語 мир 🙂🙂 a\u00adb \x00\x07\x7f", "don''t '' 's'll<|x|>", ""]
    whole, met = tok._plain, []
    want = whole(texts)
    monkeypatch.setattr(tok, "_plain", lambda words: met.extend(words) or whole(words))
    assert [tok.encode([t])[0] for t in texts] == want
    assert not any(max(w) < "\u0250" for w in met if w not in texts) and {"日本語", "мир"} <= set(met)



def test_best_two_fit_uses_all_lengths():
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    used = Counter()
    for pattern, times in packing.best_two_fit(lengths, 100):
        assert sum(pattern) <= 100
        for x in pattern:
            used[x] += times
    assert used == Counter(lengths.tolist())


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[50:120] = x[0] + rng.normal(size=(70, 16)) * 0.05
    x[120:130] = x[1]
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, x[0].tolist(), None), (304, [1.0], 0), (305, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=32).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(300))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(300, 306)) and len(got) == 306
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (11, 12), (9, 12), (5, 5), (None, 1)], "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (9, 9), (11, 9), (12, 9)}


def test_pii(spark):
    texts = ["mail a.b@mail7.example.com, A.B@mail7.example.com.", "card 4539578763621486 ip 152.143.123.131###", '+1 (017) 555-7713 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "Mrs Mary Smith met Dr Smith and Herr Иван Петров", None, "", "version 2.0 in 1998 by none", "x" * 200_000 + " a@b.example"]
    df = docs(spark, [*enumerate(texts), (None, texts[0])])
    got = {r.doc_id: r for r in pii.replace_private(df, "k").collect()}
    a = re.findall(r"\S+@\S+", got[0].text)
    assert a[0].rstrip(",.") == a[1].rstrip(",.") and "example" not in a[0] and a[0].endswith(".com,")
    card = re.search(r"\d{16}", got[1].text)[0]
    assert card != "4539578763621486" and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(card))) % 10 == 0
    assert "152.143" not in got[1].text and "###" in got[1].text and "555-7713" not in got[2].text and got[2].text.startswith("+1 (")
    assert re.search(r"[0-9a-f]{40}", got[2].text) and "24be64" not in got[2].text
    names = re.match(r"Mrs (\w+a) (\w+) met Dr (\w+) and Herr ([а-яА-Я]+) ([а-яА-Я]+)", got[3].text)
    assert names and names[2] == names[3]
    assert got[4].text is None and got[5].text == "" and got[6].text == texts[6] and got[6].n_replaced == 0
    assert got[None].text == got[0].text and pii.replace_private(df, "k").columns == [*df.columns, "n_replaced"]
    many = spark.range(3000).select("id", F.concat(F.lit("m"), "id", F.lit("@x.org")).alias("e"))
    table = pii.surrogates(many.select(F.lit("ip").alias("kind"), F.concat_ws(".", F.lit("1.2"), (F.col("id") / 250).cast("int"), F.col("id") % 250).alias("entity")), "k")
    assert table.select("surrogate").distinct().count() == 3000


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for r in bpe.decode(bpe.encode(docs(spark, odd), path), path).collect():
        text = dict(odd)[r.doc_id] or ""
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.text == plain.decode(ids, skip_special_tokens=False) == text
    assert bpe.encode(docs(spark, []), path).count() == 0


def test_language(spark):
    rng = np.random.default_rng(4)
    en, de = ["the", "water", "house", "with", "thing"], ["und", "wasser", "schule", "nicht", "straße"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else de, 30)), "en" if i % 2 else "de", "s", None, "", "") for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fitted(df)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and got[i].score > 0.9 for i in range(80))
    odd = docs(spark, [(1, None), (2, ""), (3, "12 !!"), (4, "w" * 5000), (None, "the house")])
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] in ("en", "de") and found[None][0] == "en"
    assert {r.doc_id for r in language_id.in_known_language(odd, model).collect()} <= {4, None}
    assert language_id.identify(docs(spark, [(1, "x")]), language_id.fitted(docs(spark, []))).first().lang_pred == "und"


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice(["a", "b", "ab", "ba", "aba"])
    p = np.array([0, 0.01, 0.1, 0.2, 0.3, 0.15, 0.05])[:, None]
    q = dict(zip(["a", "b", "ab", "ba", "aba"], p[2:, 0], strict=True))
    want = sum(np.prod([q[x] for x in s]) for s in (["a", "b", "a"], ["ab", "a"], ["a", "ba"], ["aba"]))
    assert np.exp(lattice.log_probabilities(["aba"], p)[0, 0]) == pytest.approx(want)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]\\ \\~ <s>"
    rows = [(1, 0, "system", "be kind"), (1, 2, "assistant", said), (1, 1, "user", None), (2, 0, None, "x " * 3000), (None, 0, "assistant", "a")]
    rows += [(3, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " + "word " * 80) for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    windows = chat.format_windows(df, path)
    assert windows.where("conv_id = 3").count() > 2 and windows.where("conv_id = 3").agg(F.max("tokens")).first()[0] <= chat.BUDGET
    of = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        of[c].append((r or "", x or ""))
    for found in (chat.read_back(windows, in_order=True), chat.read_back(windows)):
        for r in found.collect():
            turns = of[r.conv_id]
            loss = "".join(x for role, x in turns if role == "assistant")
            assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.format_windows(df.limit(0), path).count() == 0
