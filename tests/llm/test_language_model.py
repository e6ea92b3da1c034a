"""Operator 10 at orders 2 and 3, in many blocks and buckets, with busy contexts: against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import common, language_model

LOWER = str.maketrans(common.UPPER, common.LOWER)
BEGIN, END = "<begin>", "<end>"


def tokens(text):
    return [*(x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x), END]


class Brute:
    """Counts by dictionaries; p(k, context, word) as Katz wrote it."""

    def __init__(self, texts, order):
        self.counts = [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            t = [BEGIN] * (order - 1) + tokens(t)
            for i in range(order - 1, len(t)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(t[i - k + 1 : i])][t[i]] += 1
        self.d = [None, *(language_model.discounts(Counter(c for ws in self.counts[k].values() for c in ws.values())) for k in range(1, order + 1))]
        self.memo = {}

    def star(self, k, c):
        return c * self.d[k][c] if c < len(self.d[k]) else c

    def context(self, k, context):
        if (k, context) not in self.memo:
            ws = self.counts[k].get(context, {})
            total, kept = sum(ws.values()), sum(self.star(k, c) for c in ws.values())
            scale = total if kept < total else total + 1
            below = sum(self.p(k - 1, context[1:], w) for w in ws) if k > 1 else 0.0
            self.memo[k, context] = (scale, (1 - kept / scale) / max(1 - below, 1e-12)) if total else (1, 1.0)
        return self.memo[k, context]

    def p(self, k, context, word):
        scale, alpha = self.context(k, context)
        c = self.counts[k].get(context, {}).get(word, 0)
        if c:
            return self.star(k, c) / scale
        return alpha * (self.p(k - 1, context[1:], word) if k > 1 else 1.0)


def rows_of(n=60):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    pick = lambda: words[min(39, int(r.expovariate(0.15)))]
    return [(i, " ".join(pick() for _ in range(r.randint(0, 120)))) for i in range(n)] + [(100, None), (101, ""), (102, "W1 w2\tw3 unheard w1"), (102, "w1 w2 w3")] + [(200 + i, "w1 w2 w3 w4 w5") for i in range(40)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_equals_brute_force_in_blocks(spark, order):
    rows = rows_of()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    brute = Brute([t for i, t in rows if not held(i)], order)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    model, got = language_model.fitted(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, order, block=300, bucket=200)
    assert model.levels[0].buckets > 10 and (order == 1 or model.levels[1].salts)  # many buckets, salted contexts
    assert got.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    want = []
    for i, t in rows:
        w = [BEGIN] * (order - 1) + tokens(t)
        want.append((i, len(tokens(t)), sum(math.log10(brute.p(order, tuple(w[j - order + 1 : j]), w[j])) for j in range(order - 1, len(w)))))
    found = sorted((r.doc_id, r.n_tokens, r.score) for r in got.collect())
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 * max(1, abs(b[2])), (a, b)


def test_stored_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    model, _ = language_model.fitted(docs, F.lit(True), 2, block=300, bucket=200)
    words = {r.id: r.p for r in model.grams(1).collect()}
    assert abs(sum(words.values()) + model.unknown - 1) < 1e-12
    contexts = {r.context: r.alpha for r in model.contexts(2).collect()}
    pairs = defaultdict(dict)
    for r in model.grams(2).collect():
        pairs[r.context][r.word] = r.p
    assert pairs.keys() == contexts.keys() and len(pairs) > 30
    for h, ws in pairs.items():
        rest = model.unknown + sum(p for w, p in words.items() if w not in ws)
        assert abs(sum(ws.values()) + contexts[h] * rest - 1) < 1e-9
