import hashlib
import random

import numpy as np
import pytest

from verity.llm import substring

from .helpers import EDGE_ROWS, SF, frame, prose, with_clashes, words


def brute(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, window):
    return sorted((tuple(r) for r in substring.dedup_digest(df, window=window).collect()), key=str)


def shared_rows(seed=0):
    """Documents with shared passages of many lengths, copies, near copies, runs and periods."""
    r = random.Random(seed)
    passages = [prose(n, seed=70 + n) for n in (30, 49, 50, 51, 60, 99, 150)]
    rows = [(i, " ".join([prose(r.randrange(40), i), r.choice(passages), prose(r.randrange(60), i + 1), r.choice(passages)]))
            for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(120 + i, rows[i][1].replace(" ", "\n", 3) + f" new{i}") for i in range(10)]
    rows += [(140, "a " * 300), (141, "a " * 120 + "b " + "a " * 120), (142, "x y " * 100), (143, "y x " * 100), (144, "p q r " * 60),
             (139, "r p q " * 40), (145, prose(20, 1) + " " + "a " * 49 + "c"), (146, "a " * 50)]
    rows += [(200, rows[0][1]), (200, prose(60, 5) + " " + passages[3]), (None, passages[4]), (None, None)]
    return rows + EDGE_ROWS


@pytest.mark.parametrize("window", [50, 12])
def test_same_as_brute_force(spark, window):
    rows = shared_rows()
    want = brute(rows, window)
    assert sum(r[2] for r in want) > 500
    assert run(with_clashes(frame(spark, rows)), window) == want


def test_test_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert run(df, 50) == brute([(r.doc_id, r.text) for r in df.collect()], 50)


def test_symbols_depend_on_what_fixes_them_only():
    """The same words in other surroundings give the same symbols inside."""
    r = np.random.default_rng(1)
    core = r.integers(0, 30, 200).astype(np.uint64)
    found = []
    for seed in (2, 3):
        o = np.random.default_rng(seed)
        left = o.integers(0, 30, o.integers(5, 40)).astype(np.uint64)
        names = np.concatenate([left, core, o.integers(0, 30, 25).astype(np.uint64)])
        at, lo, hi = substring.recompress(names, np.array([0, len(names)]))
        inside = (lo >= len(left)) & (hi <= len(left) + 200)
        found.append([(a, b, c) for a, b, c in zip(*(x[inside] - len(left) for x in (at, lo, hi)), strict=True)])
    assert found[0] == found[1] and len(found[0]) > 20


def test_every_window_is_in_one_stretch():
    r = np.random.default_rng(5)
    names = np.concatenate([r.integers(0, 9, 300), np.zeros(200), r.integers(0, 50, 30), r.integers(0, 50, 400)]).astype(np.uint64)
    offsets = np.array([0, 300, 500, 500, 530, 930])
    _, _, first, last = substring.stretches(names, offsets)
    got = sorted(p for a, b in zip(first.tolist(), last.tolist(), strict=True) for p in range(a, b + 1))
    assert got == [p for a, b in zip(offsets[:-1], offsets[1:], strict=True) for p in range(a, b - 49)]


def test_cut_keeps_white_space_between_kept_words():
    text = ("k1\t k2 " + " ".join(f"g{i}" for i in range(50)) + "\n\nk3  k4 ").encode()
    assert substring.cut(text, [2 << 31 | 2])[3] == b"k1\t k2\n\nk3  k4"
    assert substring.cut(text, None)[3] == text
    assert substring.cut(b" a b ", [0], 2)[3] == b"" and substring.cut(b"", None)[:2] == (0, 0)


def test_texts(spark):
    rows = [(1, prose(80, 1)), (2, f"{prose(5, 9)}\n{prose(80, 1)}\n{prose(3, 8)}"), (3, None), (4, " untouched\t text ")]
    got = {r.doc_id: (r.text, r.n_removed) for r in substring.dedup_texts(frame(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: (f"{prose(5, 9)}\n{prose(3, 8)}", 80), 3: (None, 0), 4: (" untouched\t text ", 0)}


def test_empty_table(spark):
    assert run(frame(spark, []), 50) == []


def test_repeated_rows_are_searched_once(spark, monkeypatch):
    """One document as two hundred rows beside others that share its passages: same result, one row's work."""
    a, b = prose(400, 3), f"{prose(20, 4)} {prose(400, 3)} {prose(90, 5)}"
    rows = [(1, a)] * 200 + [(2, b)] * 50 + [(3, f"{prose(10, 6)} {prose(90, 5)}")]
    sizes = []
    keep = substring.materialize
    monkeypatch.setattr(substring, "materialize", lambda df, name: sizes.append((name, keep(df, name))) or sizes[-1][1])
    assert run(frame(spark, rows), 50) == brute(rows, 50)
    assert all(df.count() < 2000 for _, df in sizes)
