import random

import pytest

from strandline.llm.leakage import leaked_items
from strandline.llm.messages import part_words, words


def brute(docs, items, n):
    held = {}
    for i, t in items:
        ws = words(t or "")
        if i is not None:
            for k in range(len(ws) - n + 1):
                held.setdefault(tuple(ws[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs if d is not None for ws in part_words(t) for k in range(len(ws) - n + 1) for i in held.get(tuple(ws[k : k + n]), ())}


@pytest.mark.parametrize("bits", [27, 6])
def test_matches_brute_force_also_with_a_full_map(spark, bits):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(4, 30)))) for i in range(12)] + [(50, None), (None, "a b"), (3, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for d in range(120):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        src = words(rng.choice(items[:12])[1])
        a = rng.randint(0, len(src) - 1)
        ws[5:5] = src[a : a + rng.randint(3, 20)]
        docs.append((d, "Subject: s\n\n" + rng.choice([" ", ", ", "\n> "]).join(w.upper() if rng.random() < 0.2 else w for w in ws)))
    docs += [(None, docs[0][1]), (500, None), (501, ""), (502, "w1 " * 3000), docs[3]]
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string"), window=8, shingle=5, map_bits=bits)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items, 8) and len(rows) > 20


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, item_text string")
    assert leaked_items(docs, items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0
    assert leaked_items(docs.limit(0), items, window=3, shingle=2).count() == 0
    assert [tuple(r) for r in leaked_items(docs, items, window=3, shingle=3).collect()] == [(1, 1)]
