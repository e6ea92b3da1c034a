"""Operator 6: texts of short lines, hard-wrapped paragraphs."""

import random

from tidemill.llm import passages


def test_texts_of_short_lines_have_units(spark):
    r = random.Random(7)
    text = lambda n, k: "\n".join(" ".join("".join(r.choices("abcdefghijkl", k=r.randint(3, 9))) for _ in range(min(k, n - at))) for at in range(0, n, k))
    short = [text(n, 10) for n in (20, 21, 25, 30, 30, 30, 30, 30, 35, 40, 45, 50)]
    rows = [(10 * i + k, t) for i, t in enumerate(short) for k in (0, 1)]
    para = text(60, 10)
    words = para.split(" ")
    edited = " ".join([*words[:30], "changed", *words[31:]])
    rows += [(1000, f"{text(70, 12)}\n\n{para}\n\n{text(40, 12)}"), (1001, f"{text(30, 12)}\n\n{edited}\n\n{text(90, 12)}"), (2000, text(60, 10)), (2001, text(60, 10))]
    got = {x.doc_id: x for x in passages.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(short):
        assert got[10 * i].n_removed == 0 and got[10 * i + 1].removed_chars == len(t) and got[10 * i + 1].class_id == 10 * i, i
    assert got[1001].class_id == 1000 and got[1001].removed_chars >= len(edited)
    assert got[2000].n_repeated == got[2001].n_repeated == 0


def test_a_text_of_one_repeated_line_keeps_it_once(spark):
    line = " ".join(f"w{i}" for i in range(30))
    got = passages.removals(spark.createDataFrame([(1, "\n".join([line] * 6))], "doc_id long, text string")).first()
    assert got.removed_chars >= 5 * len(line) and all(s.start > len(line) for s in got.spans)
