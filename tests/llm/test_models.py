"""Operators that learn: held-out accuracy on small made-up tables, exact properties, odd inputs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spoorline.llm import lang_id, lm_score, quality_mil, toxicity
from spoorline.llm.common import crc_mod, crc_mod_py

ODD = [(900_001, None, None, None), (900_002, "", None, None), (900_003, " \n\t", None, None), (None, "some words here", None, None), (900_004, "word " * 40_000, None, None), (900_004, "word " * 40_000, None, None), (900_005, "123 !! --", None, None)]


def corpus(n=400, seed=0):
    """(id, text, lang, (quality, toxic)): two languages, noise in part of a text, insults in two languages."""
    rnd = random.Random(seed)
    parts = {"aa": ["ta", "ki", "mo", "ru", "sen"], "bb": ["zwo", "pfe", "gel", "sch", "übe"]}
    bad = {"aa": ["trashy", "idiotic", "moronic"], "bb": ["zwopfel", "gelschzw", "übepfegel"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(["aa", "bb"])
        words = ["".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(40, 400))]
        poor, rude = rnd.random() < 0.3, rnd.random() < 0.25
        if poor:
            at = rnd.randrange(len(words) // 2)
            words[at:] = [w + rnd.choice(["###", "$$", "%%%"]) for w in words[at:]]
        if rude:
            for _ in range(max(3, len(words) // 20)):
                words[rnd.randrange(len(words))] = rnd.choice(bad[lang])
        rows.append((i, " ".join(words), lang, (0 if poor else 1, int(rude))))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lg, "s", "x", 1.0) for i, t, lg, _ in rows] + [(i, t, None, "s", "x", 1.0) for i, t, _, _ in ODD], "doc_id long, text string, lang string, source string, _t string, score double").repartition(4).cache()
    labels = spark.createDataFrame([(i, *y) for i, _, _, y in rows] + [(None, 1, 1), (0, None, None), (12345, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def auc(pairs):
    ranked = sorted(pairs)
    ones = [i for i, (_, y) in enumerate(ranked) if y == 1]
    n1, n0 = len(ones), len(ranked) - len(ones)
    return (sum(ones) - n1 * (n1 - 1) / 2) / (n1 * n0)


def odd_counts(out):
    got = {}
    for r in out:
        if r.doc_id is None or r.doc_id >= 900_000:
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
    return got == {900_001: 1, 900_002: 1, 900_003: 1, None: 1, 900_004: 2, 900_005: 1}


def test_quality_attention(spark, tables):
    rows, docs, labels = tables
    out = quality_mil.classify(docs, quality_mil.train(docs, labels, crc_mod("doc_id", 5) != 0)).collect()
    assert odd_counts(out) and all(0 <= r.score <= 1 for r in out) and len(out) == len(rows) + len(ODD)
    truth = {i: y[0] for i, _, _, y in rows if crc_mod_py(i, 5) == 0}
    assert auc([(r.score, truth[r.doc_id]) for r in out if r.doc_id in truth]) > 0.97
    empty = {r.doc_id: r.score for r in out}
    assert empty[900_001] == empty[900_002]


def test_quality_passages_cover_the_text():
    text = b"x" * 1000 + b" ### " * 2000
    x, n = quality_mil.encode([text, b"", b"ab"])
    assert n.tolist() == [math.ceil(len(text) / quality_mil.PASSAGE), 1, 1] and len(x) == n.sum()
    assert not x[n[0]].any()
    alone = quality_mil.encode([text])[0]
    assert np.allclose(x[: n[0]], alone)


def test_quality_gradient_by_differences():
    rng = np.random.default_rng(0)
    x, counts, y = rng.random((40, 12)), np.array([5, 1, 14, 20]), np.array([1, 0, 1, 0])
    w = {k: v.astype(np.float64) for k, v in quality_mil.fit(x.astype(np.float32), counts, y, epochs=3).items()}
    first = np.cumsum(counts) - counts

    def loss():
        p = quality_mil._forward(w, x, first, counts)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = quality_mil.gradients(w, x, counts, y)
    for k in ("E", "e", "V", "U", "a", "c", "d"):
        for _ in range(6):
            at, e = tuple(rng.integers(n) for n in w[k].shape), 1e-6
            was = w[k][at]
            w[k][at] = was + e
            up = loss()
            w[k][at] = was - e
            down = loss()
            w[k][at] = was
            assert abs((up - down) / (2 * e) - grads[k][at]) < 1e-6, k
    assert quality_mil.fit(x, counts, np.ones(4, int))["c"].any() == np.False_


def test_quality_scores_equal_plain_loops():
    texts = [b"the cat sat. " * 200, b"", b"### $$ x" * 90, b"A" * 700]
    x, counts = quality_mil.encode(texts)
    w = quality_mil.fit(x, counts, np.array([1, 0, 0, 1]), epochs=2)
    for text, got in zip(texts, zip(*quality_mil.score(w, texts), strict=True), strict=True):
        raw, codes = [], []
        for row in quality_mil.encode([text])[0]:
            h = [math.tanh(sum((row[i] - w["mean"][i]) * w["scale"][i] * w["E"][i, j] for i in range(len(row))) + w["e"][j]) for j in range(quality_mil.CODE)]
            gate = [math.tanh(sum(h[i] * w["V"][i, j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * w["U"][i, j] for i in range(len(h))))) for j in range(quality_mil.GATE)]
            raw.append(sum(g * a for g, a in zip(gate, w["a"], strict=True)))
            codes.append(h)
        share = [math.exp(r - max(raw)) for r in raw]
        share = [v / sum(share) for v in share]
        z = [sum(s * h[j] for s, h in zip(share, codes, strict=True)) for j in range(quality_mil.CODE)]
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["d"][0])))
        assert abs(got[0] - want) < 1e-4 and abs(got[1] - max(share)) < 1e-4


@pytest.mark.parametrize("block", [1, 3])
def test_quality_long_texts_are_encoded_alike(monkeypatch, block):
    rnd = random.Random(block)
    texts = ["".join(rnd.choice("ab cd#  \nE9é") for _ in range(rnd.randint(0, 6000))).encode() for _ in range(30)] + [b"x" * 5000, b" " * 3000, b"word " * 2000, b""]
    want, n = quality_mil.encode(texts)
    monkeypatch.setattr(quality_mil, "BLOCK", block)
    got, m = quality_mil.encode(texts)
    assert (n == m).all() and np.allclose(got, want, atol=1e-6)


def test_quality_of_a_long_text_takes_memory_of_its_size():
    import tracemalloc

    text = b"a few words in a row, and " * 160_000  # 4 MB
    w = quality_mil.fit(np.zeros((0, quality_mil.WIDTH), np.float32), np.zeros(0, int), np.zeros(0))
    tracemalloc.start()
    quality_mil.score(w, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text)
    assert len(quality_mil._bags([text], 2000)[0]) == 2000


def test_quality_without_labels(spark, tables):
    _, docs, labels = tables
    out = quality_mil.classify(docs.limit(5), quality_mil.train(docs, labels.limit(0), F.lit(True))).collect()
    assert {round(r.score, 6) for r in out} == {0.5}
    assert quality_mil.classify(docs.limit(0), quality_mil.fit(np.zeros((0, quality_mil.WIDTH), np.float32), np.zeros(0, int), np.zeros(0))).count() == 0


def test_toxicity(spark, tables):
    rows, docs, labels = tables
    out = toxicity.predict(docs, toxicity.train(docs, labels, crc_mod("doc_id", 3) != 1)).collect()
    assert odd_counts(out) and all(0 <= r.score <= 1 for r in out)
    truth = {i: y[1] for i, _, _, y in rows if crc_mod_py(i, 3) == 1}
    held = [(r.score, truth[r.doc_id]) for r in out if r.doc_id in truth]
    assert auc(held) > 0.95
    assert sum((s >= 0.7) == (y == 1) for s, y in held) / len(held) > 0.9


def test_toxicity_undoes_obfuscation():
    assert toxicity.plain_word("1d10t!!") == "idiot" and toxicity.plain_word("(Tr@sh),") == "trash" and toxicity.plain_word("2024") == "2024"
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {})
    at = toxicity.FEATURES.index
    spaced = toxicity.features("you i d i o t there", lexicon)
    assert spaced[at("word_distinct")] == 1 and spaced[at("spaced")] > 0 and spaced[at("near_second")] > 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-raw))).astype(int)
    at, share = toxicity.isotonic(raw, y)
    assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all() and 0 <= share.min() and share.max() <= 1
    # pool adjacent violators, plainly: the fit at each place is the largest of least means about it
    s = y[np.argsort(raw, kind="stable")].astype(float)
    sums = np.concatenate([[0], np.cumsum(s)])
    fit = [max(min((sums[b] - sums[a]) / (b - a) for b in range(i + 1, len(s) + 1)) for a in range(i + 1)) for i in range(len(s))]
    assert np.allclose(np.unique(np.round(fit, 9)), np.round(share, 9)) and abs(np.mean(fit) - y.mean()) < 1e-9


def test_trees_equal_plain_splits():
    """The first tree against an exhaustive search over all features and limits, node by node."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (150, 4)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 7)).astype(int)
    trees = toxicity.Trees().fit(x, y, rounds=1)
    p = 1 / (1 + math.exp(-trees.base))
    g, h = p - y, np.full(len(y), p * (1 - p))

    def value(rows, depth):
        if depth == trees.depth:
            return {int(i): -0.2 * g[rows].sum() / (h[rows].sum() + 1) for i in rows}
        best = (1e-9, None)
        for j in range(4):
            for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, trees.bins + 1)[1:-1])):
                left = rows[x[rows, j] <= c]
                gl, hl, gt, ht = g[left].sum(), h[left].sum(), g[rows].sum(), h[rows].sum()
                if hl >= 0.5 and ht - hl >= 0.5:
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, c))
        if best[1] is None:
            return value(rows, depth + 1)
        j, c = best[1]
        return value(rows[x[rows, j] <= c], depth + 1) | value(rows[x[rows, j] > c], depth + 1)

    want = value(np.arange(len(y)), 0)
    assert np.allclose(trees.raw(x), [trees.base + want[i] for i in range(len(y))])


def test_toxicity_is_calibrated_on_what_no_fold_has_seen(spark, tables):
    rows, docs, labels = tables
    truth = {i: y[1] for i, _, _, y in rows}
    sample = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where("doc_id < 400").withColumn("_y", F.create_map(*(F.lit(v) for k in truth.items() for v in k))[F.col("_id")])
    sample = sample.withColumn("_fold", F.pmod(F.xxhash64("_id"), F.lit(toxicity.FOLDS)).cast("int"))
    found = toxicity.learn_lexicons(sample)
    assert len(found) == 1 + toxicity.FOLDS
    got = sample.collect()
    for k, lexicon in enumerate(found, -1):
        seen = {}
        for r in got:
            if r["_fold"] != k:
                for term in toxicity.terms_of(r["_t"]):
                    seen.setdefault(term, [0, 0])[r["_y"]] += 1
        n = [sum(r["_y"] == y and r["_fold"] != k for r in got) for y in (0, 1)]
        odds = {t: math.log((b + 0.5) / (n[1] - b + 0.5)) - math.log((a + 0.5) / (n[0] - a + 0.5)) for t, (a, b) in seen.items() if b >= 4}
        want = {t: o for t, o in odds.items() if o >= 1.5}
        mine = lexicon.words | {"^" + t: o for t, o in lexicon.begins.items()}
        assert mine.keys() == want.keys() and all(abs(mine[t] - want[t]) < 1e-9 for t in mine)


def test_toxicity_with_one_label(spark, tables):
    _, docs, labels = tables
    out = toxicity.predict(docs.limit(3), toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))).collect()
    assert all(r.score < 0.05 for r in out)
    assert all(0 <= r.score <= 1 for r in toxicity.predict(docs.limit(3), toxicity.train(docs, labels.limit(0), F.lit(True))).collect())


def test_language(spark, tables):
    rows, docs, _ = tables
    names, logp = lang_id.train(docs, crc_mod("doc_id", 5) != 0)
    assert names == ["aa", "bb"] and np.allclose(np.exp(logp).sum(axis=0), 1, atol=1e-3)
    out = lang_id.predict(docs, names, logp).collect()
    assert odd_counts(out)
    got = {r.doc_id: r for r in out}
    held = [(i, lg) for i, _, lg, _ in rows if crc_mod_py(i, 5) == 0]
    assert sum(got[i].lang_pred == lg for i, lg in held) / len(held) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900_001, 900_002, 900_003, 900_005))
    assert all(abs(sum(r.shares.values()) - 1) < 1e-6 for r in out if r.shares)


def test_language_mixture_finds_both_parts():
    rows = corpus(60, 3)
    logs = []
    for lang in ("aa", "bb"):
        counts = sum(np.bincount(lang_id.grams([t.encode()])[0], minlength=lang_id.BINS) for _, t, lg, _ in rows if lg == lang) + 0.1
        logs.append(np.log(counts / counts.sum()))
    logp = np.stack(logs, axis=1).astype(np.float32)
    one = next(t for _, t, lg, _ in rows if lg == "aa")
    two = next(t for _, t, lg, _ in rows if lg == "bb")
    shares = lang_id.mixture([one.encode(), (one + " " + two).encode(), b"", two.encode()], logp)
    n1, n2 = len(one.split()), len(two.split())
    assert shares[0, 0] > 0.97 and shares[3, 1] > 0.97 and not shares[2].any()
    assert abs(shares[1, 0] - n1 / (n1 + n2)) < 0.1


def test_letters_are_what_unicode_calls_letters(spark):
    rows = [(0, "½ ² Ⅷ ①"), (1, "12 !!"), (2, "é"), (None, "ta ki mo ru sen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.lang_pred for r in lang_id.predict(docs, ["aa", "bb"], np.full((lang_id.BINS, 2), -11.0, np.float32)).collect()}
    assert out[0] == out[1] == "und" and out[2] == out[None] == "aa"


def test_mixture_equals_plain_expectation_maximisation():
    rnd, rng = random.Random(5), np.random.default_rng(5)
    logp = np.log(rng.dirichlet(np.full(3, 0.5), lang_id.BINS)).astype(np.float32)
    texts = [" ".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 6))) for _ in range(n)).encode() for n in (1, 7, 30, 90)] + [b"12 3"]
    for text, got in zip(texts, lang_id.mixture(texts, logp), strict=True):
        code, word, _ = lang_id.grams([text])
        units = {}
        for c, w in zip(code, word, strict=True):
            units.setdefault((w - word[0]) // lang_id.UNIT_WORDS, []).append(c)
        like = [[math.fsum(float(logp[c, k]) for c in u) for k in range(3)] for u in units.values()]
        like = [[math.exp(v - max(row)) for v in row] for row in like]

        def em(share):
            for _ in range(lang_id.ROUNDS):
                r = [[a * b for a, b in zip(row, share, strict=True)] for row in like]
                r = [[v / (sum(row) + 1e-300) for v in row] for row in r]
                share = [sum(row[k] for row in r) / len(r) for k in range(3)]
            return share, sum(math.log(sum(a * b for a, b in zip(row, share, strict=True)) + 1e-300) for row in like)

        if not like:
            assert not got.any()
            continue
        live, (share, ll) = [0, 1, 2], em([1 / 3] * 3)
        while len(live) > 1:
            weakest = min(live[::-1], key=lambda k: share[k])
            start = [share[k] + 1e-3 if k in live and k != weakest else 0 for k in range(3)]
            fewer, less = em([v / sum(start) for v in start])
            if not -2 * less <= -2 * ll + math.log(max(len(like), 2)):
                break
            live.remove(weakest)
            share, ll = fewer, less
        assert np.allclose(got, share, atol=1e-3), text


def test_no_language(spark, tables):
    _, docs, _ = tables
    names, logp = lang_id.train(docs, F.lit(False))
    assert names == [] and {r.lang_pred for r in lang_id.predict(docs.limit(4), names, logp).collect()} == {"und"}


def test_lm_probabilities_sum_to_one():
    net = lm_score.Network.new(3)
    stream = np.array([lm_score.VOCABULARY] * 2 + [5, 900, 17, 1023] + [lm_score.VOCABULARY] * 2)
    total = 0.0
    for token in range(lm_score.VOCABULARY):
        stream[3] = token
        total += math.exp(net.log_prob(stream, np.array([3]))[0])
    assert abs(total - 1) < 1e-4


def test_lm_gradients_equal_differences():
    net = lm_score.Network({k: v.astype(np.float64) for k, v in lm_score.Network.new(1).p.items()})
    stream = np.array([lm_score.VOCABULARY] * 2 + [5, 900, 17, 1023, 5] + [lm_score.VOCABULARY] * 2)
    at = np.array([2, 4, 5])
    grads = net.gradients(stream, at)
    for k, index in (("W", (3, 2)), ("A", (1, 28)), ("B", (2, 4)), ("E", (900, 3)), ("C", (28, 4)), ("a", (0,)), ("w", (5,))):
        x, e = net.p[k][index], 1e-5
        net.p[k][index] = x + e
        up = -net.log_prob(stream, at).mean()
        net.p[k][index] = x - e
        down = -net.log_prob(stream, at).mean()
        net.p[k][index] = x
        assert abs((up - down) / (2 * e) - grads[k][index]) < 1e-4, k


def test_lm_score(spark, tables):
    rows, docs, _ = tables
    vocab = lm_score.vocabulary(docs)
    net = lm_score.train(docs, vocab, rounds=8)
    out = lm_score.score(docs, vocab, net).collect()
    assert odd_counts(out)
    got = {r.doc_id: r for r in out}
    text = rows[3][1]
    counts, total = lm_score.score_texts([text, "x", ""], lm_score.Tokens(vocab), net)
    assert got[3].n_tokens == len(text.split()) == counts[0] and abs(got[3].log_prob - total[0]) < 1e-3 * abs(total[0]) and total[2] == 0
    assert got[900_001].n_tokens == 0 and got[900_001].log_prob == 0 and got[900_001].mean_log_prob is None
    uniform = -math.log(lm_score.VOCABULARY)
    assert np.mean([r.mean_log_prob for i, r in got.items() if i is not None and i < 900_000]) > uniform + 0.3
    shuffled = lm_score.score_texts([" ".join(f"q{i}z{i}" for i in range(50))], lm_score.Tokens(vocab), net)
    assert shuffled[1][0] / shuffled[0][0] < np.mean([r.mean_log_prob for i, r in got.items() if i is not None and i < 900_000])


def test_lm_scores_equal_plain_loops():
    net = lm_score.Network.new(4)
    vocab = {"the": 0, "cat": 1, "sat": 37}
    texts = ["the cat sat on the mat", "", "Ünï the"]
    counts, total = lm_score.score_texts(texts, lm_score.Tokens(vocab), net)
    p, pad = {k: v.tolist() for k, v in net.p.items()}, lm_score.VOCABULARY
    for text, n, got in zip(texts, counts, total, strict=True):
        words = text.lower().split()
        ids = [vocab.get(w, lm_score.VOCABULARY - lm_score.SHAPES + lm_score.shape(w)) for w in words]
        want = 0.0
        for i, token in enumerate(ids):
            around = [ids[j] if 0 <= j < len(ids) else pad for j in (i - 2, i - 1, i + 1, i + 2)]
            x = [v for t in around for v in p["E"][t]]
            h = [math.tanh(sum(x[a] * p["W"][a][b] for a in range(len(x))) + p["w"][b]) for b in range(lm_score.HIDDEN)]
            kind, member = divmod(token, lm_score.MEMBERS)
            for logits, target in (
                ([sum(h[a] * p["A"][a][b] for a in range(len(h))) + p["a"][b] for b in range(len(p["a"]))], kind),
                ([sum(h[a] * p["B"][a][b] for a in range(len(h))) + p["C"][kind][b] for b in range(lm_score.MEMBERS)], member),
            ):
                want += logits[target] - math.log(sum(map(math.exp, logits)))
        assert n == len(ids) and abs(got - want) < 1e-3


def test_lm_sums_of_networks(spark):
    parts = [pd.DataFrame({"n": [2, 1], "v": [[1.0, 2.0], [4.0, 5.0]]}), pd.DataFrame({"n": [3], "v": [[0.0, 1.0]]})]
    got = list(lm_score._added(iter(parts)))
    assert len(got) == 1 and got[0]["n"][0] == 6 and got[0]["v"][0].tolist() == [6.0, 12.0] and not list(lm_score._added(iter([])))


def test_lm_on_an_empty_table(spark, tables):
    docs = tables[1].limit(0)
    vocab = lm_score.vocabulary(docs)
    assert vocab == {} and lm_score.score(docs, vocab, lm_score.train(docs, vocab)).count() == 0


def test_lm_training_predicts_every_position():
    texts = ["a b c d e f g h", "", "a b x"]
    walk = lm_score.Walk(lm_score.Network.new(), seed=0)
    walk.texts(texts, lm_score.Tokens({"a": 0, "b": 1}))
    assert walk.seen == 11


def test_lm_learns_at_the_rounds_of_the_query(spark, tables):
    docs = tables[1]
    vocab = lm_score.vocabulary(docs)
    out = lm_score.score(docs, vocab, lm_score.train(docs, vocab)).where("n_tokens > 0 and doc_id < 900000").collect()
    assert np.mean([r.mean_log_prob for r in out]) > 1 - math.log(lm_score.VOCABULARY)


def test_lm_rare_words_have_their_share_of_the_shape(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHAPES", lm_score.VOCABULARY - 2)  # a vocabulary of two words
    texts = ["the the the of of of gnu yak yak emu", "the zebra yak", None, "the zebra yak", "of\u00a0\u0130x"]
    docs = spark.createDataFrame([(i if i != 3 else 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = lm_score.word_counts(docs)
    vocab, net = lm_score.vocabulary(docs, counts=counts), lm_score.Network.new()
    assert set(vocab) == {"the", "of"}
    monkeypatch.undo()
    n = {r.w: r.n for r in counts.collect()}
    plain = lm_score.Counter(w for t in texts for w in (t or "").lower().split())
    assert n == plain
    rare = {w: c for w, c in plain.items() if w not in vocab}
    share = {w: math.log(c / sum(d for v, d in rare.items() if lm_score.shape(v) == lm_score.shape(w))) for w, c in rare.items()}
    assert share["yak"] > share["gnu"]  # equal shape
    _, base = lm_score.score_texts([t or "" for t in texts], lm_score.Tokens(vocab), net)
    want = sorted(b + sum(share.get(w, 0) for w in (t or "").lower().split()) for b, t in zip(base, texts, strict=True))
    for head in (0, 2, lm_score.HEAD):  # all rare words joined, some told to the tasks, all told
        got = sorted(r.log_prob for r in lm_score.score(docs, vocab, net, counts=counts, head=head).collect())
        assert np.allclose(got, want)


def test_lm_steps_use_their_arrays_again():
    """A shorter step after a longer one, small logits and large ones: the same as with arrays of their own; ``Walk`` keeps them, and its network is one vector."""
    rnd = np.random.default_rng(5)
    pads = [lm_score.VOCABULARY] * 2
    stream = np.array(pads + rnd.integers(0, lm_score.VOCABULARY, 50).tolist() + pads)
    room = lm_score.Room()
    for scale in (1, 40):
        net = lm_score.Network({k: v * np.float32(scale) for k, v in lm_score.Network.new(2).p.items()})
        assert (net.bound() > 80) == (scale > 1)
        for n in (50, 7):
            at = np.arange(2, 2 + n)
            own, again = net.gradients(stream, at), net.gradients(stream, at, room)
            assert all(np.array_equal(own[k], again[k]) and np.isfinite(own[k]).all() for k in own)
            assert np.array_equal(net.log_prob(stream, at), net.log_prob(stream, at, room=room))
    walk = lm_score.Walk(lm_score.Network.new(), seed=0)
    walk.stream(stream)
    held = dict(walk.room.held)
    walk.stream(np.r_[stream[:20], pads])
    assert held and all(walk.room.held[k] is v for k, v in held.items())
    assert np.array_equal(walk.net.flat(), walk.all) and all(np.shares_memory(v, walk.all) for v in walk.net.p.values())


def test_lm_words_are_coded_once_for_tokens_and_shares():
    texts = ["the cat sat", "", "zebra the zebra qq qq qq the", "cat"]
    vocab, told = {"the": 0, "sat": 1}, {"cat": -2.0, "zebra": -3.5}
    net, plain, known = lm_score.Network.new(1), lm_score.Tokens(vocab), lm_score.Tokens(vocab, told=told)
    words = [lm_score.words_of(t) for t in texts]
    counts, sums, found = lm_score.score_words(words, known, net)
    n, want = lm_score.score_texts(texts, plain, net)
    assert counts.tolist() == n.tolist() == [3, 0, 7, 1]
    assert np.allclose(sums - want, [sum(told.get(w, 0) for w in x) for x in words])
    assert lm_score.untold(words, counts, found) == [{}, {}, {"qq": 3}, {}]
    assert all(np.array_equal(a, b) for a, b in zip(lm_score.tokens(texts, plain), lm_score.tokens(texts, known), strict=True))
