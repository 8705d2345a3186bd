import random

import numpy as np

from lorewright.llm import p7_leaks as P

WORDS = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("la", "ro", "nde", "s", "mite", "n")]


def brute(item, doc):
    """Exact run of 14, or the least word edits over every passage window of 24 and more."""
    n, m = len(item), len(doc)
    run, best = np.zeros(m + 1, int), 0
    for w in item:
        run = np.concatenate([[0], np.where(doc == w, run[:-1] + 1, 0)])
        best = max(best, run.max())
    if best >= 14:
        return True
    for s in range(n - 23):
        row = np.zeros(m + 1, int)
        for i in range(s, n):
            new = np.concatenate([[i - s + 1], np.minimum(row[:-1] + (doc != item[i]), row[1:] + 1)])
            row = np.minimum.accumulate(new - np.arange(m + 1)) + np.arange(m + 1)
            if i - s + 1 >= 24 and row.min() * 8 <= i - s + 1:
                return True
    return False


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(1, len(out) - 1)
        what = rng.choice("rai")
        if what == "r":
            out[k] = rng.choice(WORDS)
        elif what == "a":
            out.insert(k, rng.choice(WORDS))
        else:
            del out[k]
    return out


def test_search_equals_brute_force():
    rng = random.Random(3)
    items = [[rng.choice(WORDS) for _ in range(rng.randint(20, 90))] for _ in range(12)]
    docs = []
    for _ in range(150):
        item = rng.choice(items)
        size = rng.randint(12, min(60, len(item)))
        at = rng.randrange(len(item) - size + 1)
        piece = edited(rng, item[at : at + size], rng.randint(0, size // 7 + 1))
        docs.append([rng.choice(WORDS) for _ in range(30)] + piece + [rng.choice(WORDS) for _ in range(30)])
    index = P.Index(list(range(len(items))), [" ".join(x) for x in items])
    got = set(index.search([" ".join(d) for d in docs]))
    fold = lambda x: P.Folded([" ".join(x)]).words
    assert got == {(i, k) for i, d in enumerate(docs) for k, x in enumerate(items) if brute(fold(x), fold(d))} and len(got) > 30


def test_differences_that_dont_count():
    item = "«La máscara», dijo él: no vi a la señora del molino ni al hijo de Ana, ¿verdad?"
    index = P.Index([1], [item])
    for doc in (item.upper(), item.replace("á", "a").replace("ñ", "n"), item.replace(" ", "\n"), item.translate({ord(c): None for c in "«»,:¿?"}), "xx " + item.replace("«", "“")):
        assert index.search([doc]) == [(0, 0)], doc


def test_table(spark):
    item = " ".join(WORDS[:40])
    docs = spark.createDataFrame([(1, "antes " + item, 5), (2, "antes " + item, 5), (3, None, 5), (4, "", 5), (5, " ".join(WORDS[:13]), 5), (6, "relleno " * 20000 + item, 5)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "corto")], "item_id bigint, text string")
    got = {tuple(r) for r in P.find_leaks(docs, items).collect()}
    assert got == {(d, i) for d in (1, 2, 6) for i in (7, 8)}
    assert {tuple(r) for r in P.find_leaks(docs, items, block=1).collect()} == got
    assert {tuple(r) for r in P.find_leaks(docs, items, most=100).collect()} == got
    assert P.find_leaks(docs.where("false"), items).count() == P.find_leaks(docs, items.where("false")).count() == 0


def test_long_passages():
    """No length of passage or document is out of reach: the end of a long passage at the start of a document and the other way round."""
    rng = random.Random(5)
    long = [rng.choice(WORDS) + str(i) for i in range(9000)]
    other = [rng.choice(WORDS) for _ in range(30)]
    index = P.Index([1, 2], [" ".join(long), " ".join(other)])
    docs = [" ".join(long[8000:8060]), " ".join(long[:30]), " ".join(["relleno"] * 12000 + long[5000:5040]), " ".join(edited(rng, long[7000:7100], 6)), " ".join(long[8990:]), " ".join(other + long[2040:2060])]
    assert set(index.search(docs)) == {(0, 0), (1, 0), (2, 0), (3, 0), (5, 0), (5, 1)}


def test_scripts_without_blanks():
    item = "墨言在旧日的码头旁小心地举起了磨坊的罗盘然后离开"
    index = P.Index([1], [item])
    assert index.search(["没有人看见。" + item[3:19] + "他说。", item[:13] + "没", item.replace("的", "的，"), "ที่นี่ไม่มีใคร"]) == [(0, 0), (2, 0)]
    thai = "ไม่มีใครเห็นเรือลำเก่าที่ท่าน้ำในคืนนั้นเลย"
    assert P.Index([1], [thai]).search(["เขาว่า" + thai]) == [(0, 0)]
