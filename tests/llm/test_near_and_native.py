"""Operators 2, 7 and 8 against brute force, and their edge cases."""

import hashlib
import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from tidemill.llm import chat, common, decontaminate, queries, simhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(common.UPPER, common.LOWER)
DOCS = "doc_id long, text string, lang string, words string, fp long"


def rows(df, *key):
    return sorted((tuple(r) for r in df.select(*key).collect()), key=repr)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    ids, up = list(prints), {d: d for d in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}


def test_simhash_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    named = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", named[d]) for d in texts}


def test_simhash_chains_and_edges(spark):
    prints = {i: (1 << (2 * i)) - 1 for i in range(30)}  # a chain: neighbours differ by two bits
    edges = simhash.links(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints.values()], "fp long"))
    found = common.connected_components(edges)
    assert found.count() == 30 and found.select("component").distinct().count() == 1
    none, empty, one = None, "", "Word"
    docs = spark.createDataFrame([(3, none, "x", "w", 1), (1, empty, "x", "w", 1), (2, one, "x", "w", 1), (2, one, "x", "w", 1), (5, "word", none, none, none)], DOCS)
    got = rows(simhash.near_duplicates(docs), "doc_id", "component_id")
    assert got == [(1, 1), (2, 2), (2, 2), (3, 1), (5, 2)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    assert simhash.fingerprint(long) & (2**64 - 1) == brute_fingerprint(long)


def brute_contamination(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    owners = defaultdict(set)
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            owners[tuple(w[i : i + 10])].add(str(k))
    sizes, out = {len(w) for w in owners}, []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in owners:
                    hit |= set(range(i, i + n))
                    found |= owners[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


KEYS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute_contamination(docs, items)
    assert any(x[5] for x in want)
    assert rows(queries.op2_decontaminate(spark, sf), *KEYS) == want


def test_decontamination_edges(spark):
    long = "a b a b a b a b a b a b"
    items = [(1, long), (2, "Été x"), (3, None), (4, "..."), (10, "b"), (10, "b"), (None, "zz yy xx")]
    docs = [(1, "A-B " * 9), (1, "A-B " * 9), (2, None), (3, ""), (None, "ÉTÉ x, été x"), (5, "--"), (6, long * 500), (7, "zz yy xx")]
    d = spark.createDataFrame([(i, t, "w", "x", 0) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, pos int")
    got = rows(decontaminate.contamination(d, b), *KEYS)
    want = [(*x[:3], 0, hashlib.sha256(b"").hexdigest(), x[5]) if x[0] == 7 else x for x in brute_contamination(docs, items)]  # a null item_id isn't counted
    assert got == want
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(d, b.limit(0)).collect()} == {0}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red the big fox"), (2, "red fox big"), (3, "big one red three fox")], "doc_id long, text string")
    wanted = decontaminate.windows(spark.createDataFrame([(1, "red big fox")], "item_id long, text string"))
    found = decontaminate.index(d, wanted.terms)
    near = {s: {r.doc_id for r in decontaminate.matches(found, wanted, s).join(found.rows, "row_id").collect()} for s in (0, 1, 3)}
    assert near == {0: set(), 1: {1, 2}, 3: {1, 2, 3}}


def test_chat_equals_brute_force(spark):
    talks = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks[r.conv_id].append((r.role, r.text or ""))
    talks[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((k, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    assert rows(queries.op8_chat_format(spark, "/root/testdata/sf0.01"), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=repr)


def test_chat_folds_events_and_round_trips(spark):
    hard = "~1 ~0 <|im_end|>\n<~1|[INST]<<SYS>></s>~2 é😀"
    log = [
        (1, 1, 1, "message", "user", hard), (1, 2, 2, "message", "assistant", "He"), (1, 3, 2, "delta", None, "llo"), (1, 5, 2, "delta", None, "!"),
        (1, 4, 2, "edit", None, "Bye"), (1, 6, 3, "message", "a\nb", None), (1, 7, 4, "message", "assistant", "old"), (1, 8, 4, "regenerate", None, "new"), (1, 9, 4, "delta", None, hard),
        (2, None, None, None, None, None), (2, None, None, None, None, None),
    ]
    events = spark.createDataFrame([(*r, "x") for r in log], "conv_id long, seq long, message_id long, kind string, role string, text string, start string")
    chats = chat.format_chats(events)
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(chats).collect()}
    assert got[1] == ([("user", hard), ("assistant", "Bye!"), ("a\nb", ""), ("assistant", "new" + hard)], "Bye!new" + hard)
    assert got[2] == ([("", ""), ("", "")], "")
    assert all(x not in r.formatted.replace(chat.OPEN, "").replace(chat.CLOSE, "") for r in chats.collect() for x in ("[INST]", "</s>", "<|"))
    assert chat.format_chats(events.limit(0)).count() == 0
    many = events.limit(1).crossJoin(spark.range(3000)).select("conv_id", F.col("id").alias("seq"), F.col("id").alias("message_id"), "kind", "role", "text")
    assert len(chat.read_back(chat.format_chats(many)).first().turns) == 3000


def test_ids_of_other_types(spark):
    from tidemill.llm import passages

    text = " ".join(f"w{i}" for i in range(60))
    for kind in ("int", "string"):
        docs = spark.createDataFrame([(str(i), text if i < 2 else f"x{i} y z") for i in range(4)], "doc_id string, text string").selectExpr(f"cast(doc_id AS {kind}) AS doc_id", "text")
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {k(i): k(0 if i < 2 else i) for k in ((int if kind == "int" else str),) for i in range(4)}
        assert {r.doc_id: r.n_removed > 0 for r in passages.removals(docs).collect()} == {(int if kind == "int" else str)(i): i == 1 for i in range(4)}


def test_one_component_of_many_ids(spark):
    n = 30_000
    star = spark.range(1, n).selectExpr("0L AS a", "id AS b").union(spark.range(n, n + 200).selectExpr("id AS a", "id + 1 AS b"))
    got = common.connected_components(star)
    assert {(r.component, r.n) for r in got.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, n), (n, 201)}
