"""Token counts (operator 12).

Texts are encoded in Arrow functions that return lengths only; no id leaves a worker.  A text is split at safe
boundaries, where the tokenizer always ends a token, so its length is the sum of its parts' lengths and no long text is
held by the tokenizer as a whole.  Equal parts are encoded once.  The parts go to the library in batches that are balanced
by bytes, not by rows.

A boundary is safe where a space stands alone between two other characters, if the tokenizer's file shows that

* a byte-level BPE (.json) splits words with its usual pattern, keeps the text as it is, and has no added token that
  holds or swallows white space: such a space starts the next word's token;
* a sentencepiece model (.model) is a BPE that keeps the text as it is, puts a space in front, and has no piece with a space after
  another character: no merge reaches over such a space, and the part behind it gets its space back as the one in front.

With any other tokenizer every text is one part.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONE_SPACE, Pieces, col, parts_of, ship, tidy

LIMIT = 512
STEP_BYTES = 4 << 20        # text that is split at a time
BATCH_BYTES = 1 << 16       # parts that the library gets at a time
CACHE_PARTS = 400_000       # parts whose lengths a Python worker remembers


class JsonLengths:
    """Lengths by the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.safe = (spec["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
                     and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
                     and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]]
                                 for t in spec["added_tokens"]))
        self.space = " " if self.safe else ""        # in front of all parts but a text's first

    def lengths(self, parts: list[str]) -> np.ndarray:
        if self.safe:                                # parts as words of one input: fewer objects than one result for each
            e = self.tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
            return np.bincount(np.array(e.word_ids, np.int64), minlength=len(parts))
        return np.fromiter(map(len, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)), np.int64, len(parts))


class ModelLengths:
    """Lengths by sentencepiece."""

    space = ""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        how, kinds = m.normalizer_spec, m.trainer_spec
        own = proto.ModelProto.SentencePiece.USER_DEFINED
        self.safe = (kinds.model_type == kinds.BPE and how.add_dummy_prefix and not how.remove_extra_whitespaces
                     and how.escape_whitespaces and not kinds.treat_whitespace_as_suffix and not how.precompiled_charsmap
                     and not any(p.type == own or "▁" in p.piece.lstrip("▁") for p in m.pieces))

    def lengths(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.model.encode(parts, num_threads=1)), np.int64, len(parts))


class Lengths:
    """Token counts of texts, with the lengths of parts remembered between batches."""

    def __init__(self, path: str):
        self.library = ModelLengths(path) if path.endswith(".model") else JsonLengths(path)
        self.cache: dict[str, int] = {}

    def known(self, parts: list[str]) -> np.ndarray:
        cache = self.cache
        new = [p for p in parts if p not in cache]
        if len(cache) + len(new) > CACHE_PARTS:
            cache = self.cache = {p: cache[p] for p in parts if p in cache}          # what is in use stays
        for at, n in parts_of(pa.array(new, pa.large_string()), BATCH_BYTES):
            some = new[at:at + n]
            cache.update(zip(some, self.library.lengths(some).tolist(), strict=True))
        return np.fromiter((cache[p] for p in parts), np.int64, len(parts))

    def of_parts(self, text: pa.Array) -> np.ndarray:
        """Token counts of texts that are split at every safe boundary."""
        p = Pieces(text)
        values = p.values.to_pylist()
        if not self.library.space:
            size = self.known(values)[p.codes]
        else:
            first = np.unique(p.codes[p.offsets[:-1]])
            size = self.known([self.library.space + v for v in values])[p.codes]
            lead = self.known([values[i] for i in first.tolist()])
            size[p.offsets[:-1]] = lead[np.searchsorted(first, p.codes[p.offsets[:-1]])]
        return np.diff(np.concatenate([[0], np.cumsum(size)])[p.offsets])

    def count(self, text: pa.Array) -> np.ndarray:
        """Token counts of the texts (null: as empty)."""
        out = [np.zeros(0, np.int64)]
        for at, n in parts_of(text, STEP_BYTES):
            some = text.slice(at, n)
            if not self.library.safe:
                out.append(self.library.lengths(pc.fill_null(some, "").to_pylist()))
            elif n == 1 and (pc.binary_length(some)[0].as_py() or 0) > STEP_BYTES:
                out.append(np.array([self.long(some[0].as_py())]))
            else:
                out.append(self.of_parts(some))
        return np.concatenate(out)

    def long(self, text: str) -> int:
        """The count of one long text, a stretch of about STEP_BYTES letters at a time."""
        total, at, space = 0, 0, self.library.space
        while at < len(text):
            cut = LONE_SPACE.search(text, at + STEP_BYTES)
            end = cut.start() if cut else len(text)
            part = text[at:end]
            total += int(self.of_parts(pa.array([part]))[0])
            if at and space:                         # all but the first stretch begin with the space
                head = LONE_SPACE.split(part, 1)[0]
                a, b = self.known([space + head, head])
                total += int(a - b)
            at = end + 1
        return total


@lru_cache(2)
def lengths(path: str) -> Lengths:
    return Lengths(path)


def length_udf(path: str):
    """A scalar Arrow UDF: text to its number of tokens."""
    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array(lengths(path).count(text))
            tidy()
        lengths.cache_clear()          # a worker outlives its task
        tidy()
    return n_tokens


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (of the text in UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` names the tokenizer's file on the executors: .json for the tokenizers library, .model for sentencepiece.
    Special tokens' strings inside texts are handled as the library does by default, and none is added.
    Null and empty texts have no bytes and no tokens.  Null ids and repeated rows are passed through; an empty table gives an
    empty result; other columns are ignored.  Nothing is shuffled.
    """
    ship(docs.sparkSession)
    return docs.select(col(id_col).alias("doc_id"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
                       length_udf(path)(col(text_col)).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
