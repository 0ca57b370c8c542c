import random
import re
from collections import Counter

import numpy as np
import pytest

from verity.llm import decontam

from .helpers import EDGE_ROWS, SF, frame, prose, with_clashes, words

ITEMS = "item_id long, text string"


def bare(text):
    return [w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in words(text)) if w]


def shingles(w):
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, least=0.8):
    """Similarity of the best window of every document and item, by sliding over all windows."""
    out = {}
    items = [(i, bare(t)) for i, t in items if bare(t)]
    known = {s for _, w in items for s in shingles(w)}
    for d, t in docs:
        w = bare(t)
        if not any(tuple(w[p:p + k]) in known for k in range(1, 6) for p in range(len(w) - k + 1)):
            continue
        for i, x in items:
            n = min(len(x), len(w))
            for p in range(len(w) - n + 1):
                a, b = shingles(w[p:p + n]), shingles(x)
                s = sum((a & b).values()) / sum((a | b).values()) if n >= min(5, len(x)) else 0
                if s >= least and s > out.get((d, i), 0):
                    out[d, i] = s
    return out


def run(docs, items):
    got = decontam.find_matches(docs, items).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    return {(r.doc_id, r.item_id): r.similarity for r in got}


def same(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_same_as_brute_force(spark):
    r = random.Random(1)
    items = [(i, prose(20 + 3 * i, seed=50 + i, vocabulary=5000)) for i in range(12)]
    items += [(20, items[3][1]), (21, None), (22, ""), (23, "!!! ..."), (24, "alpha beta"), (None, "gamma delta epsilon zeta eta theta")]
    docs = list(EDGE_ROWS)
    for n in range(60):
        w = items[n % 12][1].split()
        for _ in range(n // 20):                     # some words changed, up to below the threshold
            w[r.randrange(len(w))] = f"new{n}"
        docs.append((100 + n, f"{prose(30, n)} {' '.join(w).upper() if n % 2 else ', '.join(w)}. {prose(20, n + 1)}"))
    docs += [(300, " ".join(items[5][1].split()[:-2])), (301, "say ALPHA, beta!"), (302, "gamma delta epsilon zeta eta theta"),
             (303, items[0][1]), (303, items[0][1]), (None, items[1][1]), (304, items[2][1] + " " + items[2][1])]
    want = brute(docs, items)
    got = run(with_clashes(frame(spark, docs)), with_clashes(frame(spark, items, ITEMS)))
    assert len(want) > 30 and any(s < 1 for s in want.values()) and same(got, want)
    clean = decontam.drop_contaminated(with_clashes(frame(spark, docs)), frame(spark, items, ITEMS)).collect()
    assert sorted(x.doc_id for x in clean if x.doc_id is not None) == sorted(
        d for d, _ in docs if d is not None and not any(k[0] == d for k in want))


def test_test_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = run(docs, items)
    assert got and same(got, want)


def test_passes_over_the_benchmark(spark, monkeypatch):
    items = [(i, prose(15, seed=i, vocabulary=5000)) for i in range(30)]
    docs = [(i, prose(10, 900 + i) + " " + items[i][1]) for i in range(0, 30, 3)]
    whole = run(frame(spark, docs), frame(spark, items, ITEMS))
    monkeypatch.setattr(decontam, "ITEMS_PER_PASS", 4)
    assert whole == run(frame(spark, docs), frame(spark, items, ITEMS)) and len(whole) == 10


def test_place_of_the_match(spark):
    item = prose(12, seed=1, vocabulary=5000)
    r = decontam.find_matches(frame(spark, [(1, f"one -- two {item} three")]), frame(spark, [(5, item)], ITEMS)).first()
    assert (r.doc_id, r.item_id, r.first_word, r.n_words, r.distance, r.similarity) == (1, 5, 3, 12, 0, 1.0)


def test_index_finds_all_within_the_radius():
    r = np.random.default_rng(3)
    items = [(i, 9, r.integers(0, 2**63, 5).astype(np.uint64)) for i in range(40)]
    index = decontam.Index(items, 5, 19, 0.8)
    base = index.prints[r.integers(0, 40, 400)]
    flips = np.array([sum(1 << int(p) for p in r.choice(64, r.integers(0, 25), replace=False)) for _ in range(400)], np.uint64)
    w, i, d = index.near(9, base ^ flips)
    got = set(zip(w.tolist(), i.tolist(), strict=True))
    far = np.bitwise_count((base ^ flips)[:, None] ^ index.prints[None])
    assert got == {(a, b) for a, b in zip(*np.nonzero(far <= 19), strict=True)}


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d e f")]), ([(1, "a b c d e f")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    d, b = frame(spark, docs), frame(spark, items, ITEMS)
    assert run(d, b) == {} and decontam.drop_contaminated(d, b).count() == len(docs)


def test_copies_of_an_item_keep_the_passes_bounded(spark, monkeypatch):
    hot = prose(15, seed=99, vocabulary=5000)
    items = [(i, hot if i % 3 == 0 else prose(15, seed=i, vocabulary=5000)) for i in range(30)] + [(0, prose(15, seed=1, vocabulary=5000))]
    docs = [(i, prose(10, 900 + i) + " " + items[i][1]) for i in range(12)] + [(100, None), (101, prose(40, 7))]
    sizes = []

    class Seen(decontam._Lazy):
        def __init__(self, items, *args):
            sizes.append((len(items), sum(len(h) for _, _, h in items)))
            super().__init__(items, *args)

    monkeypatch.setattr(decontam, "_Lazy", Seen)
    monkeypatch.setattr(decontam, "ITEMS_PER_PASS", 4)
    monkeypatch.setattr(decontam, "SHINGLES_PER_PASS", 33)      # three items of 11 shingles
    want = brute(docs, items)
    assert len(want) > 40 and same(run(frame(spark, docs), frame(spark, items, ITEMS)), want)
    clean = decontam.drop_contaminated(with_clashes(frame(spark, docs)), frame(spark, items, ITEMS))
    assert sorted(r.doc_id for r in clean.collect()) == [100, 101]
    assert len(sizes) >= 14 and all(n <= 4 and h <= 33 for n, h in sizes)
    assert sum(n for n, _ in sizes) == 2 * len({t for _, t in items})
