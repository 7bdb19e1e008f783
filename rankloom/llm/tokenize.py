"""Problem 8: token ids of a byte-level BPE vocabulary, speculated and verified."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.tables import table

#: Where the tokenizer files are; a parameter of every function that needs them.
TOKENIZERS = "/opt/tokenizers"
#: How byte-level BPE cuts a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word cache is emptied at this size.
CACHE = 400_000
_NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The character that stands for each byte in the file: itself where printable, else the next above 255."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class SpeculativeBPE:
    """Ids of words: greedy longest match proposes, pair checks verify, merging decides the rest.

    A sequence of tokens is the BPE encoding of its bytes if and only if each
    adjacent pair is the encoding of the pair's bytes. So a proposal whose
    pairs are all compatible is right, and only the others are merged exactly.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, cut = whole["model"], whole.get("pre_tokenizer") or {}
        plain = not any(model.get(o) for o in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or whole.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        byte_of = {ord(c): b for b, c in enumerate(byte_letters())}
        self.vocab = {bytes(byte_of[ord(c)] for c in t): i for t, i in model["vocab"].items() if all(ord(c) in byte_of for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([[model["vocab"][a], model["vocab"][b], model["vocab"][a + b]] for a, b in pairs], dtype=np.int64).reshape(-1, 3)
        size = max(model["vocab"].values()) + 1
        self.born = np.full(size, -1, np.int64)  # when a token is first merged; bytes are there from the start
        self.left, self.right = np.arange(size), np.arange(size)
        for rank in range(len(ids) - 1, -1, -1):
            a, b, c = ids[rank]
            self.born[c], self.left[c], self.right[c] = rank, a, b
        keys = ids[:, 0] << 32 | ids[:, 1]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order
        self.merges = {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(ids.tolist())))}
        self.bytes = [self.vocab[bytes([b])] for b in range(256)]
        lengths: dict[bytes, set[int]] = {}
        for t in self.vocab:
            if len(t) > 1:
                lengths.setdefault(t[:2], set()).add(len(t))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.whole: dict[int, bool] = {}

    def stays_whole(self, token: int, raw: bytes) -> bool:
        """Whether merging the token's bytes gives the token; looked into once."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(raw) == [token]
        return known

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        vocab, lengths, out, i, n = self.vocab, self.lengths, [], 0, len(word)
        while i < n:
            for k in lengths.get(word[i : i + 2], ()):
                if i + k <= n and (t := vocab.get(word[i : i + k])) is not None:
                    out.append(t)
                    i += k
                    break
            else:
                out.append(self.bytes[word[i]])
                i += 1
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which a and b merge, or never."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)

    def check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether [a, b] is the encoding of its bytes, for arrays of pairs.

        Merging runs backwards: at the boundary stand the last part of a and
        the first part of b, and the one that was merged later is undone. The
        pair is wrong if two parts that stood there together would have merged
        before either became part of its own token. Of equal tokens the left
        one comes first.
        """
        ok = np.ones(len(a), bool)
        if not len(self.pair_keys):
            return ok
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        x_until, y_until = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(at):
            m = self.pair_rank(x, y)
            wrong = (m != _NEVER) & (m < x_until) & (m <= y_until)
            ok[at[wrong]] = False
            bx, by = self.born[x], self.born[y]
            go = ~wrong & ((bx >= 0) | (by >= 0))
            at, x, y, x_until, y_until, bx, by = (v[go] for v in (at, x, y, x_until, y_until, bx, by))
            undo_x = bx > by
            x_until, y_until = np.where(undo_x, bx, x_until), np.where(undo_x, y_until, by)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost of equals, in n log n."""
        ids = [self.bytes[b] for b in word]
        after, before, merges = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], self.merges
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words."""
        raw = [w.encode("utf-8") for w in words]
        found = {}
        open_words, proposals = [], []
        for w, r in zip(words, raw, strict=True):
            if (t := self.vocab.get(r)) is not None and self.stays_whole(t, r):
                found[w] = [t]
            else:
                open_words.append((w, r))
                proposals.append(self.propose(r))
        if not open_words:
            return found
        flat = np.fromiter((t for p in proposals for t in p), np.int64)
        ends = np.cumsum([len(p) for p in proposals])
        inside = np.ones(len(flat) - 1, bool) if len(flat) else np.ones(0, bool)
        inside[ends[:-1] - 1] = False
        at = np.flatnonzero(inside)
        keys, which = np.unique(flat[at] << 32 | flat[at + 1], return_inverse=True)
        ok = np.ones(len(flat), bool)
        ok[at] = self.check(keys >> 32, keys & 0xFFFFFFFF)[which]
        good = np.logical_and.reduceat(ok, np.concatenate([[0], ends[:-1]]))
        for (w, r), p, g in zip(open_words, proposals, good.tolist(), strict=True):
            found[w] = p if g else self.merge(r)
        return found


@lru_cache(maxsize=4)
def load(path: str) -> SpeculativeBPE:
    """The tokenizer of a file, once per Python worker."""
    return SpeculativeBPE(path)


_CACHES: dict[str, dict[str, list[int]]] = {}


def encode_batch(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of each text; an empty list for null and empty ones."""
    bpe, cache = load(path), _CACHES.setdefault(path, {})
    find = regex.compile(WORDS).findall
    cut = [find(t) if t else [] for t in texts]
    new = list({w for words in cut for w in words if w not in cache})
    if len(cache) + len(new) > CACHE:
        cache.clear()
        new = list({w for words in cut for w in words})
    cache.update(bpe.encode_words(new))
    return [[t for w in words for t in cache[w]] for words in cut]


def _file(folder: str, name: str) -> str:
    return f"{folder}/{name}.json"


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids``: the token ids of each text as stored, without special tokens.

    Null and empty texts give an empty list; strings of special tokens in a
    text are ordinary text. Rows may repeat and keys may be null: each row is
    encoded. No shuffle; other columns are not read. Words that were met before
    come from a cache of bounded size.
    """
    kind, path = df.schema[key].dataType.simpleString(), _file(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                ids = encode_batch(batch.column(1).to_pylist(), path)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter((t for x in ids for t in x), np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``n_tokens`` of each text; 0 for null and empty ones. No shuffle."""
    kind, path = df.schema[key].dataType.simpleString(), _file(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                ids = encode_batch(batch.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens bigint")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per language (null is a language of its own)."""
    docs = table(spark, sf_dir, "documents").withColumn("_k", F.struct("doc_id", "lang"))
    sizes = token_counts(docs, "_k", "text")
    return sizes.groupBy(F.lower("_k.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_totals": p8_totals}
SQL: dict[str, str] = {}
