"""Substring dedup by recompression (operator 7).

A window is ``WINDOW`` consecutive words of one document.  A word goes when some window over
it also starts in a document with a smaller id.

Recompression.  Each text is a sequence of names (word hashes).  A round cuts it between two
neighbours unless they are equal (a run) or the left one's side is 0 and the right one's
side is 1 (a pair); a side is a bit of the name's hash in that round.  What lies between two
cuts gets a new name, a hash of the two names and their counts.  Names are functions of what they
stand for, so all Spark tasks name equal runs and pairs alike and need no shared dictionary.
A cut depends on its two neighbours only, so for every symbol the words that fix it are
known: they reach from the start of the symbol before it to the end of the one after it, round by
round.  Wherever those words occur, the symbol occurs.

Candidates.  Of the symbols whose fixing words lie inside a window, the one with the least hash
stands for the window; equal windows have the same symbols inside, so they choose the same one.
Windows in a row that choose the same symbol make a stretch.  Only a stretch whose symbol is
also in another document can hold a repeat (a window without such a symbol is a stretch of its own).

Verification.  Stretches of equal content (two 64-bit hashes: of the symbol's fixing words and of the whole
stretch) are equal window by window, so all but those of the smallest document go.  Where a symbol has
different stretches, one document per distinct stretch is taken and its windows are compared by
128-bit hashes.  Copies thus never meet window by window, and no pairs are listed.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, col, fresh, loose, materialize, mix, ship, slices

WINDOW = 50
ROUNDS = 5
FAR = np.int64(1 << 60)
_RUN_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_ROLL = [Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95), Rolling(0xC2B2AE3D27D4EB4F)]
_SALT = [np.uint64(x) for x in (0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def word_names(words: Words) -> np.ndarray:
    """A 64-bit name for each word of the texts."""
    own = np.fromiter((xxhash.xxh64_intdigest(v.as_buffer()) if len(v.as_buffer()) else 0 for v in words.values),
                      np.uint64, len(words.values))
    return own[words.codes]


def recompress(names: np.ndarray, offsets: np.ndarray, rounds: int = ROUNDS):
    """(first word, first and end word of what fixes it) of the last round's symbols that are fixed within their text.

    ``names`` are those of several texts, text i at offsets[i] .. offsets[i + 1].
    """
    n = len(names)
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    head = head[:n]                                   # a text's first word
    at, lo, hi = np.arange(n), np.arange(n), np.arange(1, n + 1)
    for r in range(rounds):
        if not len(names):
            break
        side = (mix(names + np.uint64(2 * r + 1)) >> np.uint64(17)) & np.uint64(1)
        same = np.zeros(len(names), bool)
        same[1:] = (names[1:] == names[:-1]) & ~head[1:]
        joined = same.copy()
        joined[1:] |= (side[:-1] < side[1:]) & ~head[1:]
        start = np.flatnonzero(~joined)
        stop = np.append(start[1:], len(names))       # end of each new symbol
        first, last = names[start], names[stop - 1]
        changes = np.concatenate([[0], np.cumsum(joined & ~same)])
        inner = changes[stop] - changes[start]        # 1 for a pair, 0 for a run or a single name
        switch = np.full(len(start), 0, np.int64)
        turn = np.flatnonzero(joined & ~same)
        switch[inner > 0] = turn[changes[start[inner > 0]]]
        lead = np.where(inner > 0, switch - start, stop - start).astype(np.uint64)
        tail = (stop - start).astype(np.uint64) - lead
        merged = mix(mix(first * np.uint64(0x9E3779B97F4A7C15) + lead) + last * np.uint64(0xC2B2AE3D27D4EB4F) + tail)
        prior, after = start - 1, stop
        low = np.where(head[start], -FAR, lo[np.maximum(prior, 0)])
        end = np.append(head[1:], True)[stop - 1]     # the new symbol ends its text
        high = np.where(end, FAR, hi[np.minimum(after, len(names) - 1)])
        names, head, at, lo, hi = np.where(stop - start > 1, merged, first), head[start], at[start], low, high
    fixed = (lo >= 0) & (hi < FAR)
    return at[fixed], lo[fixed], hi[fixed]


def _least(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For ranges a <= i < b (not empty), the first position of the least value, by doubling tables."""
    width = b - a
    out = np.zeros(len(a), np.int64)
    table, k = np.arange(len(value)), 1
    while True:
        use = (width >= k) & (width < 2 * k)
        x, y = table[a[use]], table[b[use] - k]
        out[use] = np.where(value[x] <= value[y], x, y)
        if not (width >= 2 * k).any():
            return out
        x, y = table[:len(table) - k], table[k:]
        table, k = np.where(value[x] <= value[y], x, y), 2 * k


def stretches(names: np.ndarray, offsets: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """(symbol key, content key, first window, last window) of the stretches of all texts' windows."""
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    p = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))   # window starts
    if not len(p):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    prefix = [r.prefix(mix(names + s)) for r, s in zip(_ROLL[:2], _SALT, strict=False)]
    _, lo, hi = recompress(names, offsets, rounds)
    short = hi - lo <= window
    lo, hi = lo[short], hi[short]
    key = _ROLL[0].span(prefix[0], lo, hi)
    a, b = np.searchsorted(lo, p), np.searchsorted(hi, p + window, "right")
    has = b > a
    chosen = np.full(len(p), -1, np.int64)
    if has.any():
        chosen[has] = _least(mix(key), a[has], b[has])
    own = _ROLL[0].span(prefix[0], p[~has], p[~has] + window)
    label = np.empty(len(p), np.uint64)
    label[has], label[~has] = key[chosen[has]], own
    new = np.ones(len(p), bool)
    new[1:] = (doc[1:] != doc[:-1]) | np.where(has[1:] & has[:-1], chosen[1:] != chosen[:-1],
                                               (has[1:] != has[:-1]) | (label[1:] != label[:-1]))
    start = np.flatnonzero(new)
    first, last = p[start], p[np.append(start[1:], len(p)) - 1]
    # a run of equal windows without a symbol is told by one of them
    whole = np.where(has[start], last, first)
    return label[start], _ROLL[1].span(prefix[1], first, whole + window), first, last


def _stretch_rows(window: int, rounds: int):
    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1)):
                words = Words(batch.column(1).slice(at, n))
                key, content, first, last = stretches(word_names(words), words.offsets, window, rounds)
                doc = np.searchsorted(words.offsets, first, "right") - 1
                base = words.offsets[doc]
                # equal stretches of one text (a line that it repeats) are one row
                order = np.lexsort((first, content, key, doc))
                key, content, doc = key[order], content[order], doc[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (content[1:] != content[:-1])
                start = np.flatnonzero(new)
                spans = pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)), pa.int32()),
                                                 pa.array(((first - base) << 31 | (last - base))[order]))
                key, content, doc = key[start], content[start], pa.array(doc[start])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).slice(at, n).take(doc),
                     batch.column(2).slice(at, n).take(doc), spans], ["k", "c", "doc", "h", "p"])
    return run


def _window_rows(window: int):
    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1)):
                words = Words(batch.column(1).slice(at, n))
                names = word_names(words)
                parts, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, spans in enumerate(batch.column(3).slice(at, n)):
                    s = np.unique(spans.values.to_numpy())
                    some = np.unique(np.concatenate([np.arange(x >> 31, (x & (1 << 31) - 1) + 1) for x in s.tolist()]))
                    parts.append(some + words.offsets[i])
                    owner.append(np.full(len(some), i))
                p, doc = np.concatenate(parts), np.concatenate(owner)
                f = [r.span(r.prefix(mix(names + s)), p, p + window) for r, s in zip(_ROLL[1:], _SALT[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)),
                     batch.column(0).slice(at, n).take(pa.array(doc)), batch.column(2).slice(at, n).take(pa.array(doc)),
                     pa.array(p - words.offsets[doc])], ["f", "g", "doc", "h", "p"])
    return run


def repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Of rows (doc, h, text), the windows that go: (doc, h, spans), spans as start << 31 | last start, in any order."""
    docs = docs.select("doc", "text", "h").where("doc is not null and text is not null")
    again = materialize(docs.groupBy("doc", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "h"), "again")
    docs = docs.join(again, ["doc", "h"], "left_anti").unionByName(
        docs.join(again, ["doc", "h"], "left_semi").dropDuplicates(["doc", "h"])).select("doc", "text", "h")     # rows that repeat a document: one
    found = materialize(docs.mapInArrow(_stretch_rows(window, rounds), "k long, c long, doc long, h long, p array<long>"), "stretches")
    shared = found.groupBy("k").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("k")
    found = materialize(found.join(loose(shared, "k"), "k"), "shared")
    kinds = found.groupBy("k", "c").agg(F.min("doc").alias("low"))
    of = found.join(loose(kinds, "k", "c"), ["k", "c"])
    copies = of.where("doc > low").select("doc", "h", "p")
    mixed = kinds.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("a"), F.max("low").alias("b")) \
        .where("n > 1 and a < b").select("k")
    open_ = of.where("doc = low").join(loose(mixed, "k"), "k").groupBy("doc", "h").agg(F.flatten(F.collect_list("p")).alias("spans"))
    windows = materialize(docs.join(open_, ["doc", "h"]).select("doc", "text", "h", "spans")
                          .mapInArrow(_window_rows(window), "f long, g long, doc long, h long, p long"), "windows")
    first = windows.groupBy("f", "g").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    hit = windows.join(loose(first, "f", "g"), ["f", "g"]).where("doc > low") \
        .select("doc", "h", F.array(F.shiftleft("p", 31).bitwiseOR(F.col("p"))).alias("p"))
    return copies.unionByName(hit).groupBy("doc", "h").agg(F.flatten(F.collect_list("p")).alias("spans"))


def cut(text: bytes, spans, window: int = WINDOW) -> tuple[int, int, str, bytes]:
    """(words, words removed, SHA-256 of the kept words joined by one space, the text without the removed words).

    The text keeps its own white space between kept words.
    """
    if not spans:
        flat = _RUN_SPACE.sub(b" ", text).strip(b" ")
        return (flat.count(b" ") + 1 if flat else 0), 0, hashlib.sha256(flat).hexdigest(), text
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    s = np.array(spans, np.int64)
    mark = np.zeros(len(begin) + 1, np.int64)
    np.add.at(mark, s >> 31, 1)
    np.add.at(mark, (s & (1 << 31) - 1) + window, -1)
    gone = np.cumsum(mark[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]])))    # starts and ends of kept runs
    a, b = turn[::2], turn[1::2]
    kept = [text[begin[i]:end[j - 1]] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    out = b""
    for i, j, piece in zip(a.tolist(), b.tolist(), kept, strict=True):
        gap = text[end[i - 1]:begin[i]] if i else text[:begin[0]]     # the white space before the run
        out += (gap if out or not i else b"") + piece
    flat = b" ".join(_RUN_SPACE.sub(b" ", k) for k in kept)
    return len(begin), int(gone.sum()), hashlib.sha256(flat).hexdigest(), out


def cut_udf(window: int = WINDOW, with_text: bool = False):
    """A scalar Arrow UDF: (text as binary, spans) to n_words, n_removed and kept_sha256 (or n_removed and the text)."""
    kind = "struct<n_removed:long,text:string>" if with_text else "struct<n_words:long,n_removed:long,kept_sha256:string>"

    @F.arrow_udf(kind)
    def apply(text: pa.Array, spans: pa.Array) -> pa.Array:
        n, m, digest, kept = [], [], [], []
        for t, s in zip(text, spans, strict=True):
            a, b, c, d = cut(t.as_py() or b"", s.as_py(), window)
            n.append(a), m.append(b), digest.append(c), kept.append(d if with_text else None)
        if with_text:
            return pa.StructArray.from_arrays([pa.array(m, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                              ["n_removed", "text"])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(digest, pa.string())],
                                          ["n_words", "n_removed", "kept_sha256"])
    return apply


def _marked(docs: DataFrame, id_col: str, text_col: str, window: int, rounds: int) -> DataFrame:
    """``docs`` left-joined with the spans of its windows that go (column names that clash with none)."""
    ship(docs.sparkSession)
    rows = docs.select(col(id_col).cast("long").alias("doc"), col(text_col).alias("text"),
                       F.xxhash64(col(text_col)).alias("h"))
    spans = repeats(rows, window, rounds)
    doc, h, sp = (fresh(docs.columns, x) for x in ("doc", "h", "spans"))
    spans = spans.select(F.col("doc").alias(doc), F.col("h").alias(h), F.col("spans").alias(sp))
    return docs.join(spans, (col(id_col) == col(doc)) & (F.xxhash64(col(text_col)) == col(h)), "left") \
        .drop(doc, h)


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words.  Rows with a null id neither lose words nor make others lose them.  Rows that repeat
    an id count as one document for "smaller", and each is judged on its own text.  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    marked = _marked(rows, "doc_id", "text", window, rounds)
    return marked.select("doc_id", cut_udf(window)(F.col("text").cast("binary"), "spans").alias("r")).select("doc_id", "r.*")


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with the removed words cut out of the text, and the column n_removed; all columns kept.

    Texts that lose nothing, null ones included, are unchanged.
    """
    marked = _marked(docs, id_col, text_col, window, rounds)
    sp, r, n = fresh(docs.columns, "spans"), fresh(docs.columns, "result"), fresh(docs.columns, "n_removed")
    done = marked.withColumn(r, cut_udf(window, True)(col(text_col).cast("binary"), col(sp)))
    return done.select(*[F.when(col(text_col).isNotNull(), col(r)["text"]).alias(c) if c == text_col else col(c)
                         for c in docs.columns], col(r)["n_removed"].alias(n))
