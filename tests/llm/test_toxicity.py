"""Operator 1: restored words, held-out accuracy, and edge cases."""

from collections import Counter

import numpy as np

from tidemill.llm import toxicity
from tidemill.llm.queries import op1_toxicity


def model_of(texts):
    total = np.zeros((28, 28, 28), np.int64)
    for word, n in Counter(w for t in texts for w in t.lower().split()).items():
        ids = [26, 26, *map(toxicity.letter, word), 26]
        for x in zip(ids, ids[1:], ids[2:], strict=False):
            total[x] += n
    return toxicity.Language(total)


def test_words_are_restored():
    language = model_of(["you are such an idiot and a loser with the worthless trash of a pathetic clown in that stupid house"] * 50)
    reader = toxicity.Reader(language)
    for hidden, word in (("1d10t", "idiot"), ("l0s3r", "loser"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("tr@$h", "trash"), ("cl*wn", "clown"), ("p-a-t-h-e-t-i-c", "pathetic")):
        assert word in {toxicity.squeezed(w) for w in reader.words(f"the {hidden} of")}, hidden
    assert reader.words("the house, of 2024 +1 (555) 4!") == {"the", "house", "of"}
    assert reader.words(None) == set() == reader.words("")


def paths(word):
    """All readings of a short word with their channel costs, one letter or sign at a time."""
    out, last = [([], 0.0)], ""
    for c in word:
        options = [(toxicity.letter(c), c, 0.0)] if c.isalpha() else toxicity.readings(c)
        apart, again = c in toxicity.APART, c == last and c not in toxicity.APART
        after = [([*p, (k, x)], t + more) for p, t in out for k, x, more in options]
        after += [(p, t + (toxicity.JOINED if apart else toxicity.AGAIN)) for p, t in out if again or apart]
        after += [([*p, (toxicity.END, " ")], t + toxicity.SPLIT) for p, t in out if apart]
        out, last = after, c
    return out


def cost_of(path, channel, language):
    """The channel's cost and the language's: words end and begin anew at a split; signs that stay cost only what the channel says."""
    a = b = toxicity.END
    total = channel
    for k, x in path:
        if k == toxicity.END:
            total += language.costs[a][b][k] if b != toxicity.END else 0.0
            a = b = toxicity.END
            continue
        total += language.costs[a][b][k] if k != toxicity.OTHER or x.isalpha() else 0.0
        a, b = b, k
    return total + (language.costs[a][b][toxicity.END] if b != toxicity.END else 0.0)


def test_viterbi_finds_the_best_of_all_paths():
    language = model_of(["you are such an idiot and a loser with the worthless trash of a pathetic clown in that stupid house"] * 50)
    for word in ("1d10t", "*diot", "idio*", "l0s3r", "st.u", "stuuu", "i-d.i", "tr@$h", "7h3", "||d|", "(1own", "a1!", "bb8b"):
        got = toxicity.restore(word, language)
        every = [(cost_of(p, t, language), "".join(x for _, x in p)) for p, t in paths(word)]
        least = min(every)[0]
        assert any(abs(t - least) < 1e-9 and text == got for t, text in every), (word, got, min(every))


def test_signs_at_a_words_ends_can_be_letters():
    language = model_of(["you are such an idiot and a loser with the worthless trash of a pathetic clown in that stupid house"] * 50)
    reader = toxicity.Reader(language)
    for hidden, word in (("*diot", "idiot"), ("|diot", "idiot"), ("idio*", "idiot"), ("(lown", "clown"), ("**idiot**", "idiot"), ("idiot!!!", "idiot"), ("$tupid", "stupid"), ("+rash", "trash")):
        assert word in {toxicity.squeezed(w) for w in reader.words(f"the {hidden} of")}, hidden


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted", "score").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert len(bad) and (good.predicted == 0).mean() > 0.95 and bad.score.mean() > good.score.mean() + 0.3


def test_a_column_of_the_scores_name_is_replaced(spark):
    d = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, score string")
    got = toxicity.scored(d, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), "score")
    assert got.columns == ["doc_id", "text", "score"] and got.first().score != "old"


def test_edges(spark):
    bad, good = ("such a loser he was", "such a l0ser he was"), "what a fine day it was"
    docs = [(i, bad[i // 2 % 2] if i % 2 else good, "x", 0.0) for i in range(200)] + [(1000, None, None, None), (1001, "", "x", 1.0), (None, "x" * 100_000, "x", 1.0), (1002, "l o s e r " * 2000, "y", 0.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 1), (None, 1), (1001, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(d, labels).collect()}
    assert len(got) == 204 and all(0 <= r.score <= 1 for r in got.values())
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[1000].predicted == 0 and got[1002].predicted == 1
    assert got[1000].score == got[1001].score
    assert toxicity.scores(d.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.scores(d, labels.limit(0)).collect()} == {0.0}
    assert op1_toxicity(spark, "/root/testdata/sf0.001").count() == 200
