"""Language, LM score and toxicity: held-out quality, small formulas by brute force, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import langid, lm, toxicity

ODD = [None, "", "  ", "123 !?", "a", "x" * 30_000]


def crc(i, k):
    return zlib.crc32(str(i).encode()) % k


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages():
    rng = np.random.default_rng(0)
    sets = {"xx": ["ba", "do", "ki", "lu", "mé"], "yy": ["sch", "ung", "ein", "ör"], "zz": ["ция", "ов", "на", "по"]}
    langs = [list(sets)[i] for i in rng.choice(3, 300, p=[0.6, 0.3, 0.1])]
    return [words(rng, sets[a], rng.integers(5, 60)) for a in langs], langs


def test_language_held_out(table, languages):
    texts, langs = languages
    odd_langs = [None] * len(ODD)
    got = {r["doc_id"]: r for r in langid.identify(table(texts + ODD, langs=langs + odd_langs).withColumn("score", F.lit("clash"))).collect()}
    assert len(got) == len(texts) + len(ODD)
    assert all(r["held_out"] == (crc(i, 4) == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i in range(len(texts)) if crc(i, 4) == 2]
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in held]) > 0.97
    at = len(texts)
    assert [got[at + i]["lang_pred"] == "und" for i in range(len(ODD))] == [True, True, True, True, False, False]


def test_language_without_labels_or_rows(table):
    assert {r["lang_pred"] for r in langid.identify(table(["some text", None])).collect()} == {"und"}
    assert langid.identify(table(["x"], langs=["en"]).where("false")).count() == 0


def test_kneser_ney_by_hand():
    alpha = langid.letters()
    texts = ["abab abc", "bca cab"]
    parts = [langid.grams(langid.read(t, alpha)) for t in texts]
    columns = [np.concatenate(c) for c in zip(*parts)]
    grams = [tuple(int(x) for x in g) for g in zip(*columns)]
    table = Counter(grams)
    model = langid.Model.of([np.array(c, np.uint32) for c in zip(*table)], np.array(list(table.values()), float))

    def brute(g):
        if not g:
            return 1 / langid.ALPHABET
        order = len(g)
        counts = table if order == langid.ORDER else Counter(h[-order:] for h in {h[-order - 1:] for h in table})
        same = {h: n for h, n in counts.items() if h[:-1] == g[:-1]}
        if not same:
            return brute(g[1:])
        total = sum(same.values())
        return max(same.get(g, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(same) / total * brute(g[1:])

    tests = [*table, (97, 98, 99, 100), (1, 2, 3, 97), (32, 32, 97, 97)]
    got = np.exp(model.log_probability([np.array(c, np.uint32) for c in zip(*tests)]))
    assert np.allclose(got, [brute(g) for g in tests])
    assert sum(np.exp(model.log_probability([np.array([97], np.uint32), np.array([98], np.uint32), np.array([97], np.uint32), np.array([c], np.uint32)]))[0] for c in range(32, 32 + langid.ALPHABET)) == pytest.approx(1, abs=1e-6)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    texts = [lm.prepared(words(rng, ["ba", "do", "ki"], 50)) for _ in range(30)]
    g, n = np.unique(lm.windows(texts), return_counts=True)
    every = np.union1d(g, (g[7] >> np.uint64(8) << np.uint64(8)) + np.arange(256, dtype=np.uint64))
    many = np.zeros(len(every), np.int64)
    many[np.searchsorted(every, g)] = n
    keys, inv = np.unique(lm.context(every, 1), return_inverse=True)
    low = lm.Low(keys, np.bincount(inv, many).astype(np.int64))
    w = lm.start_weights()
    lm.learn(w, *lm.inputs(every, many, low, True), many, np.flatnonzero(many), lm.RATE)
    cost = lm.Model(low, w, np.full(256 * lm.LEVELS, 0.4)).cost(every, many)
    assert (10 ** cost[every >> np.uint64(8) == g[7] >> np.uint64(8)]).sum() == pytest.approx(1, abs=1e-6)


def test_windows_and_word_hashes():
    g = lm.windows([b"ab cd", b"", b"x", b"ab abc"])
    assert len(g) == 6 + 1 + 2 + 7
    assert (g & np.uint64(255)).tolist() == [*b"ab cd\0", 0, *b"x\0", *b"ab abc\0"]
    assert [int(x) >> 40 for x in g[:4]] == [0, 97, 97 << 8 | 98, 97 << 16 | 98 << 8 | 32]
    word = (g >> np.uint64(8) & np.uint64(65_535)).tolist()
    so_far = ["", "a", "ab", "", "c", "cd", "", "", "x", "", "a", "ab", "", "a", "ab", "abc"]
    assert len(set(zip(word, so_far))) == len(set(so_far)) == len(set(word))


def test_lm_packs_and_slices(monkeypatch):
    rng = np.random.default_rng(4)
    for a in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.unique(rng.integers(0, 2**64, 1000, np.uint64))):
        assert np.array_equal(lm.climb(lm.ascending(a), np.uint64), a)
    g = np.unique(lm.windows([rng.integers(97, 101, 3000, dtype=np.uint8).tobytes()]))
    monkeypatch.setattr(lm, "SLICE", 50)
    parts = list(lm.slices(g))
    assert len(parts) > 5 and np.array_equal(np.concatenate([g[p] for p in parts]), g)
    groups = [set((g[p] >> np.uint64(40)).tolist()) for p in parts]
    assert sum(map(len, groups)) == len(set.union(*groups)) and not list(lm.slices(g[:0]))


def test_lm_score_byte_by_byte(table, monkeypatch):
    """Scores against counts of contexts kept as byte strings in dictionaries, bit by bit."""
    rng = np.random.default_rng(5)
    texts = [words(rng, ["ba", "do", "ki", "lu", "é"], int(rng.integers(1, 25))) for _ in range(120)] + ["", None, "solo"]
    models = []
    real = lm.fit
    monkeypatch.setattr(lm, "fit", lambda grams: models.append(real(grams)) or models[0])
    got = {r["doc_id"]: r for r in lm.score(table(texts)).collect()}
    model = models[0]

    def steps(text):
        data = b"\0" * 5 + lm.prepared(text or "") + b"\0"
        for i in range(5, len(data)):
            before = data[:i]
            so_far = before.replace(b" ", b"\0").rsplit(b"\0", 1)[1]
            yield [before[-k:] for k in range(1, 6)] + [(before[-3:], so_far)], data[i]

    counts = Counter((k, c, byte >> (8 - j), j) for i, t in enumerate(texts) if crc(i, 7) != 2 for cs, byte in steps(t) for k, c in enumerate(cs) for j in range(9))
    for i in [j for j in range(len(texts)) if crc(j, 7) == 2][:12] + [0, 1, 2, 3, 120, 121, 122]:
        want = 0.0
        for cs, byte in steps(texts[i]):
            for j in range(8):
                x, seen = [], 0
                for k, c in enumerate(cs):
                    n = [counts[k, c, byte >> (8 - j) << 1 | bit, j + 1] for bit in (0, 1)]
                    x.append(np.log((n[1] + lm.PRIOR) / (n[0] + lm.PRIOR)))
                    seen += sum(n) > 0
                z = float(np.dot([*x, 0.3], model.weights[j * 7 + seen]))
                p = (lm.squash(np.array(z)) + model.refined[cs[0][0] * lm.LEVELS + int(lm.level(np.array(z)))]) / 2
                p = min(max(p, 1e-5), 1 - 1e-5)
                want += np.log10(p if byte >> (7 - j) & 1 else 1 - p)
        assert got[i]["score"] == pytest.approx(want, rel=1e-3)


def test_lm_score_base_and_gain(table):
    rng = np.random.default_rng(2)
    common = ["the", "of", "and"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.4 else words(rng, [a + b for a in "bdgklmnprst" for b in ("a", "en", "o", "ith")], 1) for _ in range(rng.integers(20, 80))).title() for _ in range(400)]
    texts += ["", None, "  \n", texts[3], "ÄÖ ünïcode\x00"]
    got = {r["doc_id"]: r for r in lm.score(table(texts).withColumn("score", F.lit("clash"))).collect()}
    tokens = [(t or "").translate({c: c + 32 for c in range(65, 91)}).split() + [None] for t in texts]
    seen = Counter(w for i, ws in enumerate(tokens) if crc(i, 7) != 2 for w in ws)
    total = sum(seen.values())
    assert len(got) == len(texts)
    for i, ws in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 7) == 2, len(ws), sum(seen[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in ws))
    assert got[3]["score"] == got[403]["score"] and got[400]["score"] == got[401]["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    sent = [" ".join(w for w in tokens[r["doc_id"]] if w is not None) + "\0" for r in held]
    letters = Counter("".join(sent))
    plain = sum(n * np.log2(sum(letters.values()) / n) for n in letters.values())  # bits under the best order-0 code
    assert sum(-r["score"] for r in held) / np.log10(2) < 0.75 * plain


def test_lm_empty_tables(table):
    assert lm.score(table(["a"]).where("false")).count() == 0
    alone = next(i for i in range(100) if crc(i, 7) == 2)
    r = lm.score(table(["a b"], [alone])).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and r["score"] < 0


@pytest.fixture(scope="module")
def toxic_rows():
    rng = np.random.default_rng(3)
    bad, plain = ["grunk", "snorble", "wazzock", "schmutzkopf", "schmutzfink"], [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        ws = rng.choice(plain, rng.integers(8, 80)).tolist()
        if i % 6 == 0:
            for _ in range(3):
                ws.insert(int(rng.integers(len(ws))), str(rng.choice(bad)) + "!")
        texts.append(" ".join(ws))
        labels.append(int(i % 6 == 0))
    return texts, labels


def test_toxicity_held_out(spark, table, toxic_rows):
    texts, toxic = toxic_rows
    labels = spark.createDataFrame([*[(i, 1, t) for i, t in enumerate(toxic)], (0, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    docs = table(texts + ODD, [*range(len(texts)), *range(len(texts), len(texts) + 5), None]).withColumn("score", F.lit("clash"))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts) + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < len(texts)]
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.97


def test_toxicity_with_few_labels(spark, table):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(table(["a", None]), none).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(table(["a"]).where("false"), none).count() == 0


def test_features_by_hand():
    f = dict(zip(toxicity.FEATURES, toxicity.features_of("You are a GRUNK, gr0nk! ok?", {"grunk": 2.0, "gronk": 1.0}, {"you"})))
    assert (f["hits"], f["obfuscated_hits"], f["weight"], f["kinds"], f["exclamations"], f["shouted"]) == (1.0, 1.0, 3.0, 1.0, 1 / 6, 1 / 6)
    assert f["near_second_person"] == 1.0


def test_samples_survive_size(spark, table):
    """A share below one in a million keeps rows, and a rare language is learned beside a frequent one."""
    from riskloom.llm.common import in_share

    kept = spark.range(20_000_000).where(in_share(5e-7, "id")).count()
    assert 1 <= kept <= 30
    assert spark.range(1000).where(in_share(1.0, "id")).count() == 1000
    words = {"xx": "der die das und nicht ist ein zu", "yy": "the of and to in that is was"}
    rng = np.random.default_rng(0)
    langs = ["yy"] * 3000 + ["xx"] * 30
    texts = [" ".join(rng.choice(words[lang].split(), 12)) for lang in langs]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table(texts, langs=langs), sample=120).collect()}
    assert np.mean([got[i] == lang for i, lang in enumerate(langs) if lang == "xx"]) > 0.9
