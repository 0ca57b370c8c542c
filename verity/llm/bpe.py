"""BPE encoding and decoding by speculate and verify (operator 5).

Every distinct word is first cut greedily into the longest vocabulary tokens (the
speculation).  A cut is the true BPE result exactly when every adjacent pair of its tokens
is compatible: no merge across their border comes before the merges that build the two.
All pairs of all words are tested together with numpy.  Only words with a failing pair are
merged exactly, rank by rank.

The tokenizer file is read on the executors from ``path`` (a parameter, nothing is copied).
Texts are cut at ASCII white space, which this kind of tokenizer drops, so a word's ids
never depend on its neighbours; Arrow dictionary-codes the words of a batch, and the ids of
a text are gathered by code.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, col, ragged, ship, slices, tidy

NEVER = np.int64(1 << 40)
STEP_BYTES = 2 << 20     # text that is encoded at a time
SCAN = 64                # symbols of a word up to which finding the least rank by a scan is the faster way
CACHE_WORDS = 200_000    # words whose ids a Python worker remembers between batches


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class WordBPE:
    """A byte-level BPE with an end-of-word suffix, as its JSON file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not self.suffix or spec["decoder"] is not None:
            raise ValueError("not a lower-casing word tokenizer")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # in words and tokens the suffix is the one character "\n", which no byte's letter is
        self.ids = {(t.removesuffix(self.suffix) + "\n" if t.endswith(self.suffix) and t != self.suffix else t): i
                    for t, i in model["vocab"].items()}
        names = {i: t for t, i in self.ids.items()}
        self.strings = [""] * (1 + max([*names, *self.special.values()]))
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.strings[i] = t
        self.letters = dict(enumerate(byte_letters()))   # for str.translate of bytes read as latin-1
        n = self.size = len(self.strings)
        self.rank = np.full(n, -1, np.int64)             # of the merge that makes a token; -1: a single letter
        self.left, self.right = np.arange(n), np.arange(n)
        self.merges: dict[int, int] = {}                 # left * n + right -> rank
        self.made: list[int] = []                        # rank -> token
        for r, (a, b) in enumerate(model["merges"]):
            b = b.removesuffix(self.suffix) + "\n" if b.endswith(self.suffix) else b
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[x * n + y] = r
            self.made.append(z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        keys, ranks = np.array(list(self.merges), np.int64), np.array(list(self.merges.values()), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(ranks[order], NEVER)
        # tokens that the merges can really produce; only these are proposed
        whole = {t: i for t, i in self.ids.items() if self.merge(t) == [i]}
        self.prefixes = {t[:n]: -1 for t in whole for n in range(1, len(t))} | whole     # token of each, -1 if it only begins some
        self.cache: dict[str, bytes] = {}               # of chunks as they stand in texts
        self.words: dict[str, bytes] = {}               # of words in lower case, without the marks around them

    def symbols(self, word: str) -> list[str]:
        """A word's first symbols: its letters, the last one with the end mark."""
        return [*word[:-2], word[-2:]] if word.endswith("\n") and len(word) > 1 else [*word]

    def merge(self, word: str) -> list[int]:
        """Exact merging: the pair of the lowest rank first, the leftmost of equals."""
        ids = [self.ids[s] for s in self.symbols(word)]
        if len(ids) > SCAN:
            return self._merge_long(ids)
        n, get, made, none = self.size, self.merges.get, self.made, len(self.made)
        ranks = [get(a * n + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            new = ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * n + new, none)
            if i < len(ranks):
                ranks[i] = get(new * n + ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with the pairs in a heap and the symbols in a linked list: n letters take n log n steps."""
        size, get, made, end = self.size, self.merges.get, self.made, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(a * size + b)) is not None]
        heapify(heap)
        while heap:
            first = heappop(heap)
            r, i = first >> 32, first & 0xFFFFFFFF
            j = after[i]
            if j >= end or ids[i] < 0 or get(ids[i] * size + ids[j]) != r:
                continue                                   # one of the two has been merged since
            new = ids[i] = made[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := get(new * size + ids[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (p := before[i]) >= 0 and (r := get(ids[p] * size + new)) is not None:
                heappush(heap, r << 32 | p)
        return [t for t in ids if t >= 0]

    def propose(self, word: str) -> list[int]:
        """The greedy cut into longest tokens."""
        out, at, get, mark = [], 0, self.prefixes.get, len(word) - 1      # no cut right before the end mark
        while at <= mark:
            best, end = -1, at + 1
            while end <= mark + 1 and (t := get(word[at:end])) is not None:
                if t >= 0 and end != mark:
                    best, stop = t, end
                end += 1
            if best < 0:
                raise ValueError(f"no token starts {word[at:at + 40]!r}")
            out.append(best)
            at = stop
        return out

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.pair_keys, key := x * self.size + y)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For token pairs (x, y): no merge across the border comes before those that build x and y.

        The symbols at the border are followed back in time: the one made later is undone first (of
        equals the right one, as the left is merged first), down to single letters.
        """
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        x, y = x.copy(), y.copy()
        due_x, due_y = np.full(len(x), NEVER), np.full(len(x), NEVER)   # when the border symbol is merged away
        while len(live):
            r = self.pair_rank(x, y)
            bad = (r < due_x) & (r <= due_y) & (r < NEVER)
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            undo = rx > ry
            x, due_x = np.where(undo, self.right[x], x), np.where(undo, rx, due_x)
            y, due_y = np.where(undo, y, self.left[y]), np.where(undo, due_y, ry)
            live, x, y, due_x, due_y = live[go], x[go], y[go], due_x[go], due_y[go]
        return good

    def pieces(self, chunk: str) -> list[str | int]:
        """The words (with end mark, in byte letters) and special ids of one white-space free chunk."""
        out: list[str | int] = []
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                low = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for w in [low] if low.isalpha() else self.word.findall(low):
                    out.append((w if w.isascii() and w.isprintable() else
                                w.encode().decode("latin-1").translate(self.letters)) + "\n")
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Speculate on all words, verify all adjacent pairs at once, merge the failing words exactly."""
        cuts = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((t for c in cuts for t in c), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(cuts)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        for i in np.unique(owner[inner[~good]]).tolist():
            cuts[i] = self.merge(words[i])
        return cuts

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids (32-bit) of each chunk; new chunks are worked out together, then remembered."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {c: self.cache[c] for c in chunks if c in self.cache}      # what is in use stays
        found = [self.pieces(c) for c in new]
        known = self.words
        words = [w for w in dict.fromkeys(p for f in found for p in f if isinstance(p, str)) if w not in known]
        if len(known) + len(words) > CACHE_WORDS:
            known = self.words = {p: known[p] for f in found for p in f if p in known}
        known.update((w, struct.pack(f"<{len(c)}I", *c)) for w, c in zip(words, self.encode_words(words), strict=True))
        for c, f in zip(new, found, strict=True):
            self.cache[c] = b"".join(known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in f)
        return [self.cache[c] for c in chunks]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's ids start (and the last end)."""
        words = Words(text)
        return gather(words, self.encode_chunks(words.values.to_pylist()))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts that the library's decode gives: no decoder is set, so tokens are joined by spaces."""
        table = pa.array(self.strings, pa.string())
        tokens = table.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


def gather(words: Words, known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of coded words: (flat ids, text offsets), from the packed ids of each distinct word."""
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    table = np.frombuffer(b"".join(known), "<u4")
    first = np.cumsum(size) - size
    n = size[words.codes]
    ids = table[ragged(first[words.codes], n)] if len(n) else np.zeros(0, np.uint32)
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids, ends[words.offsets]


@lru_cache(2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def encode_udf(path: str, with_ids: bool = False):
    """A scalar Arrow UDF: text to (n_tokens, ids_sha256, decoded_sha256[, ids])."""
    kind = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string" + ",ids:array<int>" * with_ids + ">"

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][:3 + with_ids]

    def one(bpe: WordBPE, text: pa.Array) -> pa.Array:
        ids, off = bpe.encode(text)
        raw, decoded = ids.astype("<u4"), bpe.decode(ids, off)
        cols = [pa.array(np.diff(off)),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(d.as_buffer() or b"").hexdigest() for d in decoded], pa.string())]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32))))
        return pa.StructArray.from_arrays(cols, names)

    @F.arrow_udf(kind)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path)
        for text in batches:
            yield pa.concat_arrays([one(bpe, text.slice(at, n)) for at, n in slices(text, STEP_BYTES)])
            tidy()
        del bpe                    # a worker outlives its task
        tokenizer.cache_clear()
        tidy()
    return encode


def decode_udf(path: str):
    """A scalar Arrow UDF: array<int> of ids to the decoded text (null: null)."""
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        out = tokenizer(path).decode(flat, np.concatenate([[0], np.cumsum(size)]))
        return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.string()))
    return decode


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Null and empty texts have no ids and decode to the empty text.  Null ids and repeated rows are
    passed through; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    return docs.select(col(id_col).alias("doc_id"), encode_udf(path, with_ids)(col(text_col)).alias("e")) \
        .select("doc_id", "e.*")
