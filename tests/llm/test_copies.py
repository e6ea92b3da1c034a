"""The pipeline's near-duplicates against brute force by exact Jaccard."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}


def brute_kept(texts):
    ids, up = sorted(texts), {d: d for d in texts}
    sets = {d: shingle_set(t) for d, t in texts.items()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    shared = defaultdict(int)
    owners = defaultdict(list)
    for d in ids:
        for s in sets[d]:
            for o in owners[s]:
                shared[o, d] += 1
            owners[s].append(d)
    edited = 0
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            edited += sets[a] != sets[b]
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d for d in ids if root(d) == d}, edited


def test_near_duplicates_equal_brute_force(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    want, edited = brute_kept({r.doc_id: r.text for r in given.collect()})
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, given, SF).collect()]
    assert edited >= 10 and sorted(got) == sorted(want)


def test_near_duplicates_edges(spark):
    words = [f"w{i}" for i in range(100)]
    edited = " ".join([*words[:50], "changed", *words[51:]])
    rows = [(1, " ".join(words), "a"), (2, edited, "a"), (3, " ".join(words).upper(), "a"), (4, None, "a"), (5, "", "a"), (6, "two words", "b"), (6, "other things", "b"), (7, "Two  Words", "c"), (8, "again and again", "z"), (8, "again and again", "y"), (None, "two words", "x"), (9, " ".join(words[:70]), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=repr)
    assert got == sorted([rows[0], rows[3], rows[5], rows[6], rows[9], rows[10], rows[11]], key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), SF).count() == 0
    many = spark.range(1500).select("id", F.concat(F.lit(" ".join(words)), F.lit(" x"), "id").alias("text")).withColumnRenamed("id", "doc_id")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, many, SF).collect()] == [0]


def test_balls_of_fingerprints_propose(spark, monkeypatch):
    """op7's ball hashing is a step of the stage: it alone connects texts that differ in a word of many."""
    from tidemill.llm import copies, simhash

    called, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: (called.append(a[1]), plain(*a))[1])
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words[::-1])), (4, "too short")], "doc_id long, text string")
    table = copies.prints(docs).localCheckpoint()
    bands = {r.doc_id: r.band for r in copies.balls(table).join(table, "unit").collect()}
    assert called == [copies.RADIUS] and bands[1] == bands[2] != bands[3] and 4 not in bands
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).orderBy("doc_id").collect()] == [1, 3, 4] and len(called) == 2


def test_a_group_that_shares_all_bands_has_a_link_for_each_unit(spark, monkeypatch):
    from tidemill.llm import passages

    links, plain = [], passages.connected_components
    monkeypatch.setattr(passages, "connected_components", lambda edges: (links.append(edges.count()), plain(edges))[1])
    members = spark.range(100).select(F.col("id").alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("band"))
    assert passages.clustered(members).select("cluster").distinct().count() == 1 and links[0] <= 101
