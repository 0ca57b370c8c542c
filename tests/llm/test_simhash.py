import random

import numpy as np
import xxhash

from verity.llm import simhash

from .helpers import EDGE_ROWS, frame, prose, with_clashes, words


def slow_print(text, k=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)) if h else 0


def slow_components(rows, radius=4):
    prints = [slow_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and root(i) != root(j):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, prints[i], least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(df):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)


def near_copies():
    r, rows = random.Random(3), []
    for i in range(40):
        w = prose(300, seed=i % 6).split()
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    return rows


def test_every_pair_within_the_radius_shares_a_mask():
    r = random.Random(1)
    for radius in (0, 1, 2, 4):
        masks = simhash.covering_masks(radius, list(range(64)))
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            d = sum(1 << p for p in r.sample(range(64), radius))
            assert any(not m & d for m in masks)


def test_same_as_brute_force(spark):
    rows = near_copies() + EDGE_ROWS
    assert run(with_clashes(frame(spark, rows))) == slow_components(rows)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = prose(5000, seed=9)
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "TEXT_STEP", 700)
    assert simhash.fingerprint(text.encode()) == whole == slow_print(text)


def test_empty_table(spark):
    assert run(frame(spark, [])) == []


def test_large_buckets_are_split_and_lose_no_link(spark):
    """Many prints within a few bits of each other: with a small bucket limit they go through further rounds."""
    r = random.Random(5)
    near = {0x0123456789ABCDEF ^ sum(1 << p for p in r.sample(range(64), r.randrange(4))) for _ in range(250)}
    far = {r.getrandbits(64) for _ in range(200)}
    prints = sorted(near | far)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    links = {(a.a % 2**64, a.b % 2**64) for a in simhash.near_links(df, 4, limit=60).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        up[root(a)] = root(b)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                assert root(a) == root(b)


def test_forest_links_are_few():
    u = np.array(sorted({5 ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}), np.uint64)
    a, b = simhash.forest(u, 4)
    assert len(a) == len(b) == len(u) - 1


def test_keep_one(spark):
    rows = [(d + 100, t) for d, t in near_copies()] + EDGE_ROWS       # no id has two texts
    kept = simhash.keep_one(with_clashes(frame(spark, rows)))
    assert kept.columns == with_clashes(frame(spark, rows)).columns
    got = [r.doc_id for r in kept.collect()]
    groups = {c for _, _, c in slow_components(rows)}
    assert None not in got and len(got) == len(set(got)) and set(got) == groups      # each group has a row with an id here


def test_keep_one_judges_rows_of_one_id_apart(spark):
    """Rows that share an id are known by their texts: unrelated ones both stay, a copy of another document goes."""
    a, b = prose(60, 1), prose(60, 2)
    for rows, want in (([(5, a), (5, b)], {(5, a), (5, b)}), ([(3, a), (5, a), (5, b)], {(3, a), (5, b)}),
                       ([(5, a), (5, a), (None, a)], {(5, a)}), ([(None, a), (None, a), (None, None), (None, "")], None)):
        got = [tuple(r) for r in simhash.keep_one(frame(spark, rows)).collect()]
        assert len(got) == (2 if want is None else len(want))
        assert want is None or set(got) == want
