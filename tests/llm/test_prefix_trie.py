import hashlib
import random
import zlib

import pytest

from verity.llm import prefix_trie
from verity.llm.queries import ORACLE

from .helpers import SF, with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract word by word, with tuples of turns as names."""
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda v: v[:2])] for c, v in by.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members, ends = {}, {}
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
        ends.setdefault(full[c], []).append(c)
    children = {}
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    sums = {}
    for s in sorted(members, key=len, reverse=True):
        kids = children.get(s, [])
        saved = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        sums[s] = (sum(sums[k][0] for k in kids) or 1, saved + sum(sums[k][1] for k in kids))
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children.get(s, [])), *sums[s],
                    hashlib.sha256(",".join(map(str, ends.get(s, []))).encode()).hexdigest()) for s, m in members.items()), key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **kw).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def random_rows(seed, convs=120, most=7, kinds=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bé", None, "c" * 9][:kinds])) for c in r.sample(range(convs * 2), convs)
            for t in range(r.randrange(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = random_rows(seed)
    random.Random(seed).shuffle(rows)
    rows += [(None, 1, "user", "lost"), (7001, None, "user", "first"), (7001, 0, "user", "second"), (7004, 5, None, None)]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("score", "layer")
    assert run(df) == brute(rows)


def test_small_shards_and_layers(spark):
    """Every conversation in many layers, every node in many shards."""
    rows = random_rows(3, convs=150, most=12, kinds=2)
    shards = [prefix_trie.Shard([(c, 0, (0, 0), [(1, 1)], [1], True) for c in range(3)])]
    assert [r[5] for r in shards[0].walk()] == [3, 3, None]
    assert brute(rows) == run(spark.createDataFrame(rows, SCHEMA), shard=3, layer=2)


def test_copies_and_one_long_conversation(spark):
    """A third of the rows is one conversation, a third are copies of another; two long ones part late."""
    long = [(5, t, "user", f"turn {t}") for t in range(3000)] + [(6, t, "user", f"turn {t}" if t < 2990 else "other") for t in range(3000)]
    copies = [(100 + 5 * i, t, "user", f"copy {t}") for i in range(1000) for t in range(3)]
    few = [(20_000 + i, 0, "user", "copy 0") for i in range(50)]
    rows = long + copies + few
    assert run(spark.createDataFrame(rows, SCHEMA), shard=64) == brute_deep(rows)


def brute_deep(rows):
    """``brute`` with turns as numbers and prefixes as nodes of a dictionary, for long conversations."""
    by = {}
    for c, t, _, x in rows:
        by.setdefault(c, []).append((t, x))
    own = {c: [x for _, x in sorted(v)] for c, v in by.items()}
    child, parent, text, members, ends = {}, [None], [""], [[]], [[]]
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        seq, at = own.get(c - c % 5, [])[:h] + own[c][h:], 0
        members[0].append(c)
        for x in seq:
            if (at, x) not in child:
                child[at, x] = len(parent)
                parent.append(at), text.append(x), members.append([]), ends.append([])
            at = child[at, x]
            members[at].append(c)
        ends[at].append(c)
    kids, leaves, saved, depth = [0] * len(parent), [0] * len(parent), [0] * len(parent), [0] * len(parent)
    for i in range(1, len(parent)):
        kids[parent[i]] += 1
        depth[i] = depth[parent[i]] + 1
    for i in reversed(range(len(parent))):
        leaves[i] += kids[i] == 0
        saved[i] += (len(members[i]) - 1) * len(text[i].encode())
        if i:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    return sorted(((members[i][0], depth[i], members[parent[i]][0] if i else None, len(members[i]), kids[i], leaves[i], saved[i],
                    hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest()) for i in range(len(parent))), key=str)


def test_turnless_conversations(spark):
    """A conversation whose turns are all replaced, with nothing to replace them, ends at the root."""
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "x"), (c, 1, "user", "y")]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_test_table_and_sql(spark):
    import duckdb
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = run(df)
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    sql = con.execute(f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({ORACLE['op13_prefix_trie']})")
    assert sorted(map(tuple, sql.fetchall()), key=str) == got


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
