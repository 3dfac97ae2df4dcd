"""Trained operators against their definitions and on held-out rows."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import fingerprints, jaccard_join, lm_scoring, quality_lm, quality_rules, secret_scan, toxicity
from millrace.llm.bytetext import blocks, hash_spans, spans, words
from millrace.llm.common import append_columns, fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _column(texts):
    return pa.array(texts, pa.large_string())


def test_words_and_hashes():
    texts = ["The the\x0bTHE é", "", "x", None, "a b"]
    column = _column([t or "" for t in texts])
    for size in (1, 4, 1 << 20):
        got = []
        for b in blocks(column, size):
            w = words(b)
            for i in range(len(b)):
                got.append([h for h in w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist()])
        assert [len(x) for x in got] == [4, 0, 1, 0, 2] and got[0][0] == got[0][1] == got[0][2] != got[0][3]
    (b,) = blocks(_column(["ab", "ab"]))
    s, e = spans(b, np.ones(len(b.data), bool))
    assert s.tolist() == [0, 2] and e.tolist() == [2, 4] and len(set(hash_spans(b.data, s, e).tolist())) == 1


def test_fold(spark):
    import zlib

    got = spark.range(50).select("id", fold("id", 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)


def _texts(seed, n, insult):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = ["".join(r.choice(["th", "er", "on", "an", "re", "ti", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        if insult:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scumbagish", "scumbagly", "moron"]))
        out.append(". ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)))
    return out


def test_toxicity_on_held_out_rows():
    train, y = _texts(1, 300, False) + _texts(2, 300, True), np.repeat([0, 1], 300)
    m = toxicity.fit(_column(train), y, rounds=120)
    score = lambda texts: np.concatenate([m.score(b, s := toxicity.sentences(b), m.sentence_logits(s)) for b in blocks(_column(texts))])
    assert (score(_texts(3, 150, True)) >= 0.7).mean() > 0.95 and (score(_texts(4, 150, False)) >= 0.7).mean() < 0.03
    assert score([""]).tolist() == [0.0]
    # noisy-or: one minus the product of the sentences' complements
    (b,) = blocks(_column([train[0]]))
    s = toxicity.sentences(b)
    z = m.sentence_logits(s)
    assert abs(m.score(b, s, z)[0] - (1 - np.prod(1 - 1 / (1 + np.exp(-z))))) < 1e-12


def test_offending_sentences(spark):
    m = toxicity.fit(_column(_texts(1, 300, False) + _texts(2, 300, True)), np.repeat([0, 1], 300), rounds=120)
    text = "é thth erer. on an idiot moron re! tiou"
    got = toxicity.toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), m).first()
    assert [text[int(a) : int(b)] for a, b in (x.split(":") for x in got.offending.split(","))] == ["on an idiot moron re"]
    assert got.predicted == 1 and got.n_sentences == 3


def test_quality_on_held_out_rows():
    good = _texts(1, 300, False)
    bad = [re.sub(r"(\w) ", r"\1### ", t) for t in _texts(2, 150, False)] + [t.upper().replace(" ", "!! ") for t in _texts(5, 150, False)]
    m = quality_rules.fit(_column(good[:200] + bad[:200]), np.repeat([1, 0], 200))
    p = lambda texts: np.concatenate([m.probability(b) for b in blocks(_column(texts))])
    assert p(good[200:]).min() > 0.5 and p(bad[200:]).max() < quality_rules.KEEP_AT
    one = quality_rules.fit(_column(good[:3]), np.ones(3, np.int64))
    assert (one.a, one.c) == (0.0, 0.0)


def _kneser_ney(texts, alphabet, order):
    """Interpolated modified Kneser-Ney by its definition: a function from (context, symbol) to a probability."""
    size = quality_lm.ALPHABET
    grams = []
    for t in texts:
        s = [0] * (order - 1) + quality_lm.symbols(np.frombuffer(t.encode(), np.uint8), alphabet).tolist()
        grams += [tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s))]
    levels = {order: Counter(grams)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {}
    for k, level in levels.items():
        t = [sum(n == c for n in level.values()) for c in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        cut[k] = [0.0] + [min(c, max(0.05 * c, c - (c + 1) * y * (t[c + 1] / t[c] if t[c] else 0.5))) for c in (1, 2, 3)]

    def probability(context, symbol):
        k = len(context) + 1
        below = 1 / (size - 1) if k == 1 else probability(context[1:], symbol)
        own = {g[-1]: n for g, n in levels[k].items() if g[:-1] == context}
        if not own:
            return below
        taken = {s: min(n, cut[k][min(n, 3)]) for s, n in own.items()}
        total = sum(own.values())
        return (own.get(symbol, 0) - taken.get(symbol, 0)) / total + sum(taken.values()) / total * below

    return probability


def test_kneser_ney(spark):
    n, order = quality_lm.ALPHABET, quality_lm.ORDER
    texts = ["abracadabra abba", "cab bad dab", "abc abc abd", "zzz!"]
    alphabet = b"ab cdr"
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    m = quality_lm.assemble(alphabet, quality_lm.smoothed(quality_lm.count_ngrams(df, alphabet)).toArrow())
    want = _kneser_ney(texts, alphabet, order)
    got = np.exp(m.logs.astype(float)).reshape((n,) * order)
    got[..., 1] *= 256 - len(alphabet)
    for context in [(0, 0, 0), (0, 0, 2), (0, 2, 3), (2, 3, 7), (3, 2, 4), (4, 4, 4), (1, 1, 1), (47, 2, 3)]:
        assert np.allclose(got[context], [want(context, c) for c in range(n)], rtol=1e-4), context
    (block,) = blocks(_column(["abba", ""]))
    p = m.perplexity(block)
    s = [0, 0, 0, *quality_lm.symbols(np.frombuffer(b"abba", np.uint8), alphabet).tolist()]
    assert abs(p[0] - math.exp(-sum(math.log(want(tuple(s[i - 3 : i]), s[i])) for i in range(3, 7)) / 4)) < 1e-3 and math.isnan(p[1])


def test_model_takes_little_of_the_driver(spark):
    """Besides the table of the highest order nothing of its size is held, and the model is broadcast once."""
    alphabet = bytes(range(97, 123))
    rows = pa.table({"order": pa.array([1, 4], pa.int32()), "gram": [2, 2 + 48 * 3], "alpha": [0.5, 0.25], "gamma": [0.5, 0.75]})
    tracemalloc.start()
    m = quality_lm.assemble(alphabet, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(m.logs) == quality_lm.ALPHABET**quality_lm.ORDER and peak < 2 * m.logs.nbytes
    assert math.isclose(m.logs[2 + 48 * 3], math.log(0.25 + 0.75 * (0.5 + 0.5 / 47)), rel_tol=1e-6)
    assert m.shared(spark) is m.shared(spark)


def test_scores_by_definition(spark, docs, rows):
    texts = [(d, [*WORD.findall((t or "").translate(LOWER)), None]) for d, t, *_ in rows]
    import zlib

    count = Counter()
    for d, w in texts:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            count.update(w)
    total, distinct = sum(count.values()), len(count)
    model = lm_scoring.learn(docs.where(~lm_scoring.held_out()))
    got = lm_scoring.score(docs, model).collect()
    want = sorted((repr(d), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w), 6)) for d, w in texts)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_states_sum_to_one(docs):
    model = lm_scoring.learn(docs)
    a, f = model.automaton, model.frequent
    words_only = len(f.keys)
    assert (a.arcs // lm_scoring._P <= words_only).any() and (a.arcs // lm_scoring._P > words_only).any()
    counts = model.counts.toArrow()
    n, rank = counts["n"].to_numpy(), f.ranks(counts["word"].to_numpy().view(np.uint64))
    norm = f.total + f.distinct + 1
    pairs = [(int(k // lm_scoring._P), int(k % lm_scoring._P)) for k in a.arcs[:10]]
    for first, second in pairs + [(0, int(x)) for x, _ in pairs] + [(0, 0)]:
        m = len(rank) + 1
        seq = np.stack([np.full(m, first), np.full(m, second), np.append(rank, 0)], 1).ravel()
        gain = a.walk(seq, 3 * np.arange(m + 1))[0][2::3]
        assert abs((10 ** gain[:-1] * (n + 1) / norm).sum() + 10 ** gain[-1] / norm - 1) < 1e-6


def test_long_texts_are_walked_in_segments(docs, monkeypatch):
    """One state carried through a whole text gives what its segments side by side give."""
    a = lm_scoring.learn(docs).automaton
    r = np.random.default_rng(1)
    bounds = np.array([0, 0, 700, 701, 1700])
    seen = np.unique(a.arcs % lm_scoring._P)
    rank = np.where(r.random(1700) < 0.9, r.choice(seen, 1700), 0)
    got = {}
    for size in (1, 2, 3, 64, 10_000):
        monkeypatch.setattr(lm_scoring, "SEGMENT", size)
        got[size] = a.walk(rank, bounds)
    assert all(np.allclose(got[k][0], got[10_000][0]) and (got[k][1] == got[10_000][1]).all() for k in got)
    # Step by step, by the state table alone.
    arcs = dict(zip(a.arcs.tolist(), zip(a.arc_to.tolist(), a.arc_gain.tolist(), strict=True), strict=True))
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        state = 0
        for j in range(first, last):
            weight, word = 0.0, int(rank[j])
            while state and (not word or state * lm_scoring._P + word not in arcs):
                weight += a.fail_weight[state]
                state = int(a.fail_to[state])
            to, own = arcs[state * lm_scoring._P + word] if state else (word, 0.0)
            state = to
            assert abs(got[64][0][j] - weight - own) < 1e-9


def test_rare_words_are_joined(spark, docs, monkeypatch):
    whole = lm_scoring.learn(docs)
    few = lm_scoring.Model(whole.counts, lm_scoring.frequent_words(whole.counts, 0.01), whole.automaton)
    # Fewer words are known at once; the base score is the same.
    key = lambda m: sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm_scoring.score(docs, m).collect())
    assert len(few.frequent.keys) < len(whole.frequent.keys) and key(few) == key(whole)


def test_pipeline(spark, tables):
    import corpus_pipeline

    odd, none = tables
    out = corpus_pipeline.run(spark, odd)
    assert out.columns[:2] == ["doc_id", "piece"] and out.agg(F.max("length")).first()[0] <= 2048
    assert corpus_pipeline.run(spark, none).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet").withColumn("kept", F.lit("mine"))
    ids = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        got = docs.collect()
        assert {r.doc_id for r in got} <= ids and {r.kept for r in got} <= {"mine"}
        ids = {r.doc_id for r in got}
        docs = docs.checkpoint()
    assert all("04dbebab91ab" not in r.text for r in got)
    assert len([r.doc_id for r in got if r.doc_id is not None]) == len({r.doc_id for r in got if r.doc_id is not None})


def test_all_ngrams_have_arcs(spark, monkeypatch):
    """Scores against a dictionary of all pairs and triples, with arcs broadcast and with arcs joined by a shuffle."""
    r = random.Random(11)
    texts = [" ".join(f"rare{20 * i + j} " + " ".join(r.choice(["a b c", "a b d", "b c", "d"]) for _ in range(4)) for j in range(20)) for i in range(150)]
    texts += ["zeta eta theta iota"] * 3 + ["eta theta other", "zeta eta", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lists = [(t or "").split() + [None] for t in texts]
    one, two, three = (Counter(tuple(w[i : i + k]) for w in lists for i in range(len(w) - k + 1)) for k in (1, 2, 3))
    norm = sum(one.values()) + len(one) + 1
    two, three = ({g: n for g, n in c.items() if n >= 3} for c in (two, three))
    assert ("zeta", "eta") in two and len(one) > 2048 and ("eta", "theta", "iota") in three
    uni = lambda w: (one[w,] + 1) / norm
    follow = {}
    for g in [*two, *three]:
        follow.setdefault(g[:-1], []).append(g[-1])

    def p(context, w):
        if not context:
            return uni(w)
        g = (*context, w)
        table, below = (two, one) if len(context) == 1 else (three, two)
        if g in table:
            return (table[g] - 0.75) / below[context]
        if context not in follow:
            return p(context[1:], w)
        own = follow[context]
        taken, lower = sum((table[*context, x] - 0.75) / below[context] for x in own), sum(p(context[1:], x) for x in own)
        return (1 - taken) / (1 - lower) * p(context[1:], w)

    want = {i: sum(math.log10(p(tuple(w[max(0, j - 2) : j]), w[j])) for j in range(len(w))) for i, w in enumerate(lists)}
    for words_share, share in ((2.5e-7, 1e-6), (2.5e-7, 0.01), (0.005, 0.01), (0.5, 1.0)):
        monkeypatch.setattr(lm_scoring, "BROADCAST_SHARE", words_share)
        monkeypatch.setattr(lm_scoring, "GRAM_SHARE", share)
        monkeypatch.setattr(lm_scoring.frequent_words, "__defaults__", (words_share,))
        got = {x.doc_id: x.score for x in lm_scoring.score(docs, lm_scoring.learn(docs)).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want), (words_share, share)


def test_thresholds_of_all_trusted_texts(spark):
    """More than 3,000 trusted texts all count, and a few odd ones don't decide a language's threshold."""
    r = random.Random(3)
    rows = [(i, "en", " ".join(r.choice(["the", "other", "on", "ran"]) for _ in range(30))) for i in range(3300)]
    rows += [(4000 + i, "de", " ".join(r.choice(["der", "andere", "an", "lief"]) for _ in range(30))) for i in range(300)]
    rows += [(5000 + i, "de", "".join(chr(r.randrange(33, 120)) for _ in range(200))) for i in range(12)]
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 as quality")
    assert quality_lm.trusted_texts(docs, labels).count() == len(rows)
    classifier = quality_lm.train(docs, labels)
    got = quality_lm.perplexities(docs, classifier.model, ["doc_id"]).where("doc_id >= 4000").collect()
    odd = [x.perplexity for x in got if x.doc_id >= 5000]
    clean = [x.perplexity for x in got if x.doc_id < 5000]
    at = classifier.thresholds["de"]
    assert at < min(odd) and sum(p > at for p in clean) <= 0.05 * len(clean)


def test_short_and_repeated_junk_is_rejected(spark):
    """No text is kept beyond the quantile of trusted texts of its language and length."""
    r = random.Random(4)
    word = lambda: r.choice(["the", "other", "on", "ran", "then", "her", "hat"])
    good = [" ".join(word() for _ in range(r.choice([10, 300]))) for _ in range(1200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good)], "doc_id long, text string, lang string")
    classifier = quality_lm.train(docs, docs.selectExpr("doc_id", "1 as quality"))
    junk = spark.createDataFrame([(0, "Zqx| jvk #wq zzv", "en"), (1, "Whha " * 280, "en")], docs.schema)
    assert [x.kept for x in quality_lm.classify(junk, classifier, ["doc_id", "lang"]).collect()] == [False, False]
    kept = quality_lm.classify(docs, classifier, ["doc_id", "lang"]).where("kept").count()
    assert kept >= 0.95 * len(good)


def test_rules_learn_from_all_labelled_documents(spark, tables, monkeypatch):
    """The stage's model has the bad rows that an earlier stage rejected."""
    import corpus_pipeline

    seen = []

    def train(docs, labels):
        seen.append(docs.count())
        raise StopIteration

    monkeypatch.setattr(quality_rules, "train", train)
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    try:
        corpus_pipeline.rules(spark, docs.limit(2), tables[0])
    except StopIteration:
        pass
    assert seen == [docs.count()]


def test_words_that_a_polynomial_hash_confuses():
    """The two complementary Thue-Morse words are told apart at every length, long words included."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    for n in (8, 16, 64, 256, 1024, 4096):
        x = a[:n]
        y = x.translate(str.maketrans("ab", "ba"))
        (b,) = blocks(_column([f"{x} {y} {x}é {x}"]))
        h = words(b).hashes.tolist()
        assert len(set(h)) == 3 and h[0] == h[3]
    r = random.Random(1)
    many = ["".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(5000)]
    (b,) = blocks(_column([" ".join(many)]), 1 << 20)
    assert len(set(words(b).hashes.tolist())) == len(set(many))


def test_characters_are_code_points():
    texts = ["aé中😀b", "", "ß", "中中中中中中"]
    (b,) = blocks(_column(texts))
    chars, doc = quality_rules.characters(b)
    assert chars.tolist() == [int.from_bytes(c.encode(), "little") for t in texts for c in t]
    assert doc.tolist() == [i for i, t in enumerate(texts) for _ in t]
    groups = quality_rules._features(b)
    assert [len(groups[k][0]) for k in (2, 3)] == [sum(max(0, len(t) - n + 1) for t in texts) for n in (3, 5)]


def test_classifier_by_brute_force(spark):
    """Thresholds and verdicts of every row from perplexities computed symbol by symbol."""
    r = random.Random(12)
    word = lambda: r.choice(["the", "other", "on", "ran", "then", "her", "hat"])
    good = [" ".join(word() for _ in range(r.choice([4, 9, 20, 40]))) for _ in range(400)]
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(good)]
    rows += [(1000 + i, "".join(chr(r.randrange(33, 1000)) for _ in range(60)), "en") for i in range(20)]
    rows += [(2000, None, "en"), (2001, "", "de"), (2002, good[0], None), (3, good[3], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i, *_ in rows if i < 1010], "doc_id long, quality int")
    classifier = quality_lm.train(docs, labels)
    held = {x.doc_id for x in quality_lm.trusted_texts(docs, labels).where("held_out").collect()}
    own = {x.doc_id: x.text for x in quality_lm.trusted_texts(docs, labels).where("not held_out").collect()}
    seen = Counter(b"".join(t.encode() for t in own.values()))
    alphabet = bytes(b for b, _ in sorted(seen.items(), key=lambda e: (-e[1], e[0]))[: quality_lm.ALPHABET - 2])
    assert alphabet == classifier.model.alphabet
    p = _kneser_ney(list(own.values()), alphabet, quality_lm.ORDER)
    known = {}

    def perplexity(text):
        s = [0, 0, 0, *quality_lm.symbols(np.frombuffer(text.encode(), np.uint8), alphabet).tolist()]
        total = 0.0
        for i in range(3, len(s)):
            gram = tuple(s[i - 3 : i + 1])
            if gram not in known:
                known[gram] = math.log(max(1e-12, p(gram[:-1], gram[-1]) / (256 - len(alphabet) if gram[-1] == 1 else 1)))
            total += known[gram]
        return math.exp(-total / (len(s) - 3))

    size = lambda t: int(math.log2(len(t.encode())))
    by = {}
    for i, t, lang in {(i, t, lang) for i, t, lang in rows if i in held}:
        for key in ((lang, size(t)), (None, size(t)), (lang, None), (None, None)):
            by.setdefault(key, []).append(math.log(perplexity(t)))

    def threshold(lang, length):
        for key in ((lang, length), (None, length), (lang, None), (None, None)):
            values = sorted(by.get(key, []))
            if len(values) >= quality_lm.LEAST_TEXTS or key == (None, None):
                at = [values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.75, quality_lm.QUANTILE)]
                return math.exp(at[2] if len(values) >= quality_lm.ENOUGH else min(at[2], at[1] + quality_lm.FENCE * (at[1] - at[0])))

    kept = 0
    for x in quality_lm.classify(docs, classifier).collect():
        if not x.text:
            assert x.kept is False and x.perplexity is None
            continue
        want, at = perplexity(x.text), threshold(x.lang, size(x.text))
        assert math.isclose(x.perplexity, want, rel_tol=1e-3) and math.isclose(x.threshold, at, rel_tol=1e-3), x
        assert x.kept == (x.perplexity <= x.threshold) and (abs(want / at - 1) < 2e-3 or x.kept == (want <= at))
        kept += x.kept
    assert 380 <= kept <= 403


def test_bytes_beyond_the_table_are_exact(spark, monkeypatch):
    """Every byte of the trusted texts has a symbol of its own, whether the rest is broadcast or joined."""
    r = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 абвгдежзийклмнопрстуфхцчшщ"
    good = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(150)] + ["привет мир"] * 30
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(900, "мир 中 привет", "en"), (901, "", "en"), (902, None, "en"), (903, "~~", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 900").selectExpr("doc_id", "1 as quality")
    own = [x.text for x in quality_lm.trusted_texts(docs, labels).where("not held_out").collect()]
    seen = Counter(b"".join(t.encode() for t in own))
    alphabet = bytes(b for b, _ in sorted(seen.items(), key=lambda e: (-e[1], e[0])))
    assert len(alphabet) > quality_lm.ALPHABET
    with monkeypatch.context() as m:
        m.setattr(quality_lm, "ALPHABET", len(alphabet) + 2)
        p = _kneser_ney(own, alphabet, quality_lm.ORDER)
    known = {}

    def perplexity(text):
        s = [0, 0, 0, *quality_lm.symbols(np.frombuffer(text.encode(), np.uint8), alphabet).tolist()]
        for i in range(3, len(s)):
            gram = tuple(s[i - 3 : i + 1])
            if gram not in known:
                known[gram] = math.log(max(1e-12, p(gram[:-1], gram[-1]) / (256 - len(alphabet) if gram[-1] == 1 else 1)))
        return math.exp(-sum(known[tuple(s[i - 3 : i + 1])] for i in range(3, len(s))) / (len(s) - 3))

    want = {i: perplexity(t) if t else None for i, t, _ in rows if i % 5 == 0 or i >= 900}
    for most in (quality_lm.REST_ROWS, 0):
        monkeypatch.setattr(quality_lm, "REST_ROWS", most)
        classifier = quality_lm.train(docs, labels)
        assert classifier.model.alphabet == alphabet and (classifier.model.table is None) == (most > 0)
        got = {x.doc_id: x.perplexity for x in quality_lm.perplexities(docs, classifier.model, ["doc_id"]).collect()}
        assert len(got) == len(rows)
        for i, value in want.items():
            assert got[i] is value is None or math.isclose(got[i], value, rel_tol=1e-4), (most, i, got[i], value)
        kept = quality_lm.classify(docs, classifier).where("kept").count()
        assert most and (first := kept) or kept == first


def test_a_text_of_many_megabytes():
    """One text of 6 MB, a word of 1 MB in it, is worked off whole by every operator in numpy."""
    r = random.Random(2)
    part = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(1000)) + ".\n"
    text = part * 900 + "x" * 1_000_000 + " key_0123456789abcdef0123 end"
    (b,) = blocks(_column([text]))
    n = len(WORD.findall(text))
    w = words(b)
    assert len(w.hashes) == n and quality_rules.counts(b, w)["n_words"][0] == n
    assert quality_rules.repeated_words(w)[0] >= n - 10
    assert len(quality_rules._features(b)[2][0]) == len(text) - 2
    assert len(toxicity.sentences(b).doc) == 901
    assert len(jaccard_join.shingle_sets(b)[0]) < 2100
    assert len(lm_scoring.tokens(b)[0]) == n + 1
    assert fingerprints.codes(b)[0].shape == (1, 256)
    assert len(quality_lm.codes(b, b"abcdefgh .", 4)) == len(text)
    assert secret_scan.base_spans(b)[0][0][1] == 2
    bounds = np.array([0, n + 1])
    a = lm_scoring.Automaton(1, 1, np.zeros(2), np.zeros(2, np.int64), np.zeros(2))
    assert a.walk(np.ones(n + 1, np.int64), bounds)[0].shape == (n + 1,)


def test_batches_of_texts_are_small(spark):
    """A task holds no more than so many texts at once, and a worker gives back what a batch took."""
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    df = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 10) as text")
    sizes = append_columns(df, "n long", lambda: lambda column: [pa.array([len(column)] * len(column))], keep=["doc_id"]).collect()
    assert len(sizes) == 5000 and max(x.n for x in sizes) <= 2000
    before = resident()
    held = [np.ones(12_000) for _ in range(2000)]  # below the size from which numbers are mapped apart
    last = np.ones(12_000)
    del held
    list(blocks(_column(["a"])))
    assert resident() - before < 100e6 and last[0] == 1
