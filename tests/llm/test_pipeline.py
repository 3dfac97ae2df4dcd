"""Every stage of the pipeline on its own input, against plain Python, and the whole run."""

import os
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from millrace.llm import quality_lm, quality_rules, secret_scan
from millrace.llm.bytetext import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows): prose in two languages, junk that repeats or shouts, near and exact copies, secrets, odd rows."""
    r = random.Random(21)
    word = lambda: "".join(r.choice(["the", "ing", "er", "on", "al", "ment", "is", "ta"]) for _ in range(r.randint(1, 3)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)) for _ in range(n // 9))
    texts = [prose(r.randint(60, 160)) for _ in range(160)]
    good = len(texts)
    texts += ["# * $ % " * r.randint(20, 60) for _ in range(20)] + [prose(90).upper() + "!!" for _ in range(20)] + [(word() + " ") * 80 for _ in range(20)]
    bad = len(texts)
    texts += [texts[3], texts[3] + " and more", texts[4].replace(" ", "  "), " ".join(texts[5].split()[:-2])]
    texts += [f'{texts[6]} token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" {texts[7]}' for _ in range(5)]
    texts += [None, "", "short text"]
    rows = [(i, t, ["en", "de"][i % 2], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[8], "en", None, None), rows[9]]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int(i < good), 0) for i in range(bad)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), rows


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_quality_classifier(spark, corpus):
    """Rows stay whose perplexity, symbol by symbol from the model's table, is within the threshold of language and length."""
    folder, rows = corpus
    c = quality_lm.train(_docs(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    size = quality_lm.ALPHABET
    code = {b: k + 2 for k, b in enumerate(c.model.alphabet)}

    def kept(text, lang):
        data = (text or "").encode()
        if not data:
            return False
        s = [0, 0, 0, *(code.get(b, 1) for b in data)]
        total = sum(float(c.model.logs[((s[i] * size + s[i + 1]) * size + s[i + 2]) * size + s[i + 3]]) for i in range(len(data)))
        length = len(data).bit_length() - 1
        at = c.by_length.get((lang, length), c.by_length.get((None, length), c.thresholds.get(lang, c.thresholds[None])))
        return np.exp(-total / len(data)) <= at

    got = STAGES["quality_classifier"](spark, _docs(spark, folder), folder).collect()
    want = [x for x in rows if kept(x[1], x[2])]
    assert _sorted(got) == _sorted(want)
    clean, junk = ({x[0] for x in want if x[0] in ids} for ids in (range(160), range(160, 220)))
    assert len(clean) >= 150 and len(junk) <= 20


def test_quality_rules(spark, corpus):
    folder, rows = corpus
    model = quality_rules.train(_docs(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))

    def kept(text):
        words = WORD.findall(text or "")
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + j for i, x in enumerate(three) if three.count(x) > 1 for j in range(3)}
        if len(words) < 50 or 100 * len(covered) > 50 * len(words):
            return False
        (block,) = blocks(pa.array([text], pa.large_string()))
        return model.probability(block)[0] >= quality_rules.KEEP_AT

    got = STAGES["quality_rules"](spark, _docs(spark, folder), folder).collect()
    want = [x for x in rows if kept(x[1])]
    assert _sorted(got) == _sorted(want)
    repeated = {*range(160, 180), *range(200, 220)}
    assert sum(x[0] in range(160) for x in want) >= 150 and not repeated & {x[0] for x in want}


def test_near_duplicates(spark, corpus):
    folder, rows = corpus

    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {x[0]: shingles(x[1]) for x in rows if x[0] is not None}
    name = {d: d for d in sets}
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((name[a], name[b]))
            name = {d: low if c == high else c for d, c in name.items()}
    want = {x for x in rows if x[0] is None or name[x[0]] == x[0]}  # a row that repeats another stays once
    got = STAGES["ngram_jaccard_join"](spark, _docs(spark, folder), folder).collect()
    assert _sorted(got) == _sorted(want) and len(want) < len(rows) - 20


def test_secrets(spark, corpus):
    folder, rows = corpus
    formats = secret_scan.learn_formats(_docs(spark, folder))
    got = {(r.doc_id, r.n_chars): r.text for r in STAGES["secret_scans"](spark, _docs(spark, folder), folder).collect()}
    want = {}
    for i, text, *_ in rows:
        out = text
        if text:
            found = [m.span() for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{12,}""", text, re.I)]
            found += [m.span() for m in re.finditer("[0-9a-f]{16,}", text)]
            (block,) = blocks(pa.array([text], pa.large_string()))
            found += [(a, b) for a, _, b in formats.spans(block).get(0, [])]  # the corpus is ASCII
            out, at = "", 0
            for a, b in sorted(found):
                if a >= at:
                    out += text[at:a] + "[SECRET]"
                at = max(at, b)
            out += text[at:]
        want[i, len(out) if out is not None else None] = out
    assert got == want and sum("[SECRET]" in (t or "") for t in want.values()) == 5


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows = corpus
    got = STAGES["best_fit_packing"](spark, _docs(spark, folder), folder).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert _sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == _sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(bins) <= -(-sum(n for *_, n, _ in want) // 2048) + 1


def test_run_is_its_stages_and_removes_its_tables(spark, corpus, monkeypatch):
    folder, _ = corpus
    made = []
    keep = corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, name: made.append(keep(df, name)) or made[-1])
    out = corpus_pipeline.run(spark, folder)
    docs = _docs(spark, folder)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).checkpoint()
    key = lambda df: _sorted(df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert key(out) == key(docs) and made
    gone = [df.stored_at.removeprefix("file:") for df in made if df.stored_as in STAGES]
    assert len(gone) == 4 and not any(os.path.exists(p) for p in gone)
    assert set(out.columns) >= {"sequence_id", "offset"}
