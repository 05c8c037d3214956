"""Held-out accuracy of the learned operators, and plain versions of a forward pass and of a verdict."""

import collections
import math
import os
import re
import zlib

import numpy as np
import pytest

from loomstead.llm import byte_cnn, divergence, pu_quality, queries
from loomstead.llm.common import word_spans

DATA = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


def in_fold(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_quality_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op5_pu_quality(spark, DATA).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if in_fold(r.doc_id, 5, 0) and r.doc_id in got}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count() and len(truth) > 40
    assert all(r.held_out == in_fold(i, 5, 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].predicted == q for i, q in truth.items()]) >= 0.95
    good, bad = ([got[i].score for i, q in truth.items() if q == k] for k in (1, 0))
    assert np.mean([[x > y for y in bad] for x in good]) >= 0.97


def test_language_of_held_out_documents(spark):
    rows = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_byte_cnn_language(spark, DATA).collect()}
    assert got.keys() == rows.keys() and all(r.held_out == in_fold(i, 3, 1) for i, r in got.items())
    assert np.mean([r.lang_pred == rows[i] for i, r in got.items() if r.held_out]) >= 0.97


def test_forward_pass_equals_loops():
    rng = np.random.default_rng(1)
    filters = [rng.normal(0, 1, (w, byte_cnn.EMBEDDED, byte_cnn.FILTERS)) for w in byte_cnn.WIDTHS]
    d = byte_cnn.FILTERS * len(filters)
    net = byte_cnn.Network(["a", "b", "c"], rng.normal(0, 1, (256, byte_cnn.EMBEDDED)), filters, [rng.normal(0, 1, byte_cnn.FILTERS) for _ in filters], rng.normal(0, 1, (d, 3)), rng.normal(0, 1, 3))
    rows = rng.integers(0, 256, (3, 12)).astype(np.uint8)
    for row, found in zip(rows, net.probabilities(rows), strict=True):
        pooled = []
        for f, offset in zip(net.filters, net.offsets, strict=True):
            for k in range(byte_cnn.FILTERS):
                sums = [sum(float(net.embedding[row[i + j]] @ f[j, :, k]) for j in range(len(f))) for i in range(len(row) - len(f) + 1)]
                pooled.append(max(0.0, max(sums) + offset[k]))
        z = np.array(pooled) @ net.dense + net.bias
        assert np.allclose(found, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-3)


def test_risk_is_that_of_the_estimator():
    """Scores of the trained model follow the odds of positives, whose share among the unlabelled is estimated."""
    rng = np.random.default_rng(5)
    for share in (0.3, 0.7):
        positive = lambda n: rng.normal(0, 1, (n, pu_quality.FEATURES))
        negative = lambda n: rng.normal(1.5, 1, (n, pu_quality.FEATURES))
        n = 4000
        model = pu_quality.fit(positive(1500), np.concatenate((positive(int(n * share)), negative(n - int(n * share)))))
        assert abs(model.prior - share) < 0.08
        assert model.scores(positive(500)).mean() > 0.9 > 0.1 > model.scores(negative(500)).mean()



def plain_class(c):
    """The number of a character's class in divergence.CLASSES."""
    if c == "\n":
        return 4
    if c in " \t\x0b\x0c\r":
        return 3
    if c in "#*$%&|<>":
        return 6
    if c in ".,;:!?'\"()-" or 0x2000 <= ord(c) < 0x3000:
        return 5
    if ord(c) < 32 or ord(c) == 127:
        return 7
    if "A" <= c <= "Z":
        return 1
    return 0 if c.isascii() and c.isalnum() or ord(c) >= 128 else 2


def plain_distance(p, q):
    p, q = (np.array(x, float) / sum(x) for x in (p, q))
    out = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0.0) / 2 + (b * math.log2(b / m) if b else 0.0) / 2
    return math.sqrt(max(0.0, out))


def plain_references(rows):
    out = {}
    for lang in {r.lang for r in rows if r.lang is not None}:
        shares, words, n = [[] for _ in divergence.CLASSES], collections.Counter(), 0
        for r in rows:
            if r.lang != lang:
                continue
            counts = collections.Counter(map(plain_class, r.text or ""))
            for i, of in enumerate(shares):
                if counts:
                    of.append(int(np.rint(counts[i] * 1000 / sum(counts.values()))))
            for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or ""):
                n += 1
                letters = w.strip(divergence._STRIPPED).lower()
                if len(w) <= divergence.COMMON_LETTERS + divergence.MARKS and 0 < len(letters) <= divergence.COMMON_LETTERS:
                    words[letters] += 1
        common = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: divergence.COMMON_WORDS]
        out[lang] = ([sorted(of)[(len(of) - 1) // 2] for of in shares], dict(common), n)
    return out


def plain_verdict(text, reference):
    shares, common, n = reference
    counts = collections.Counter(map(plain_class, text))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    by_class = plain_distance([counts[i] for i in range(len(shares))], shares)
    of = lambda w: w.strip(divergence._STRIPPED).lower() if len(w) <= divergence.COMMON_LETTERS + divergence.MARKS else None
    own = collections.Counter(of(w) if of(w) in common else None for w in words)
    by_word = plain_distance([own[w] for w in common] + [own[None]], [*common.values(), n - sum(common.values())])
    bad = len(text) >= 100 and by_class > 0.15 or len(words) >= 60 and by_word > 0.25 + 2 / math.sqrt(len(words))
    return not bad, by_class, by_word


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_verdicts_equal_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("text", "lang").collect()
    references = plain_references(rows)
    known = divergence.language_references(docs)
    for lang, (shares, common, n) in references.items():
        assert known[lang]["classes"].tolist() == shares and known[lang]["all"] == n
        assert known[lang]["words"] == common
    judged = 0
    for r in divergence.quality_rules(docs).collect():
        if r.text and r.lang and not r.base_failed:
            kept, by_class, by_word = plain_verdict(r.text, references[r.lang])
            assert math.isclose(r.class_distance, by_class, abs_tol=1e-9) and math.isclose(r.word_distance, by_word, abs_tol=1e-9)
            assert r.kept == kept
            judged += 1
    assert judged > 100 and any(not r.kept and not r.base_failed for r in divergence.quality_rules(docs).collect())


def test_references_and_documents_count_words_alike(spark):
    """Quotes, brackets, Cyrillic words of ten bytes and words of another script: what a reference counts, its documents count."""
    texts = ["(the \u00abthe \"the the) the, THE The... \u0442\u043e\u0433\u0434\u0430 \u00ab\u0422\u043e\u0433\u0434\u0430\u00bb, \u4f60\u597d\u5417 \u4f60\u597d\u5417\u3002 sixsix ((((the", None, "the \u0442\u043e\u0433\u0434\u0430! \u4f60\u597d\u5417"]
    known = divergence.language_references(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))["x"]["words"]
    own = collections.Counter()
    for t in texts:
        raw = (t or "").encode()
        own += divergence.common_counts(raw, word_spans(raw))
    assert known == dict(own) and own["the"] == 9 and own["\u0442\u043e\u0433\u0434\u0430"] == 3 and own["\u4f60\u597d\u5417"] == 2 and "sixsix" not in own
