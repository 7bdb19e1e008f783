"""Problem 10: abusive, hateful or sexual content, by a chain of linear classifiers over passages."""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import path_exists, shared_dir
from rankloom.sources.tables import table

#: Labelled documents that the classifiers are fitted on, at most: with a
#: positive label, and without; longer texts than MAX_CHARS take no part in
#: the fit, which so is bounded in bytes. Everything else covers all documents.
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 4_000, 8_000, 20_000
#: Passages without any telling word that the fit sees as ordinary ones, at most, chosen at random.
MAX_ORDINARY = 4_000
#: Categories, found by grouping the passages that the labels point to.
CATEGORIES = 4
#: Hashed features: parts of words, and pairs of words.
BITS = 18
#: Words in a passage at most, and words that two windows of a longer one share.
WINDOW, OVERLAP = 40, 12
FOLDS = 3
#: Ridge of the categories' links and of the last, whose weights of the categories' probabilities begin at TRUST.
RIDGE, RIDGE_LAST, TRUST = 2e-5, 1e-3, 6.0
#: Known words are dropped at this number.
WORDS = 200_000

# Letters that look like Latin ones, and signs written for letters.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁһԛԝьαβεηικνορτυχγω", "abekmhopctyxijsdhqwbabenikvoptuxyw")
SIGNS = str.maketrans("@$!013457|", "asioieastl")

_LETTER, _GAP = r"[^\W\d_]", r"[ ._\-]"
_SPACED = re.compile(rf"(?<![^\W_]){_LETTER}(?:{_GAP}{{1,3}}{_LETTER}(?![^\W_]|[@$*|])){{3,}}")
_MAYBE_SPACED = re.compile(rf"{_GAP}{_LETTER}{_GAP}{{1,3}}{_LETTER}{_GAP}")
_PIECE = re.compile(r"[^\W_](?:[\w@$!*|']*[\w*])?|[.!?…;](?=\s)|[。！？\r\n]")
_LEET = re.compile(r"[@$!0-57|]")
_REPEAT = re.compile(r"([^\W\d_])\1+")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Cf}]+")
_VOWELS = str.maketrans("", "", "aeiouy*'")


def plain(text: str) -> str:
    """Lower case without accents, invisible characters, look-alikes and spaced-out words."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
        text = text if text.isascii() else _UNSEEN.sub("", text).translate(LOOKALIKES)
    return _SPACED.sub(lambda m: re.sub(_GAP, "", m[0]), text) if _MAYBE_SPACED.search(text) else text


def word(token: str) -> str:
    """A token with signs read as letters and repeated letters once."""
    if _LEET.search(token) and any(c.isalpha() for c in token):
        token = token.translate(SIGNS)
    return _REPEAT.sub(r"\1", token)


def parts_of(w: str) -> list[int]:
    """Hashed parts of a word: itself, its consonants, its four-letter parts (of the first 64 letters)."""
    mask = (1 << BITS) - 1
    parts = {crc32(b"w" + w.encode()) & mask}
    if w.isalpha() or "*" in w:
        shown = f"^{w[:64]}$"
        if len(w) >= 4:
            parts |= {crc32(b"c" + shown[i : i + 4].encode()) & mask for i in range(len(shown) - 3)}
        if len(bones := w[:64].translate(_VOWELS)) >= 3:
            parts.add(crc32(b"k" + bones.encode()) & mask)
    return sorted(parts)


class Lexicon:
    """Numbers of tokens; token 0 ends a passage. ``known`` is told of new words, in the order of their numbers."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.hash, self.n = np.zeros(1024, np.uint32), 1
        self.hash[0] = 11

    def read(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Tokens as numbers, the text of each, and the new words."""
        found = [_PIECE.findall(plain(t)) if t else [] for t in texts]
        flat = [p for ps in found for p in [*ps, "\n"]]
        fresh = []
        for token in set(flat).difference(self.number):
            if token[0].isalnum():
                fresh.append(word(token))
                self.number[token] = self.n + len(fresh) - 1
            else:
                self.number[token] = 0
        if self.n + len(fresh) > len(self.hash):
            self.hash = np.append(self.hash, np.zeros(len(self.hash) + len(fresh), np.uint32))
        self.hash[self.n : self.n + len(fresh)] = [crc32(w.encode()) for w in fresh]
        self.n += len(fresh)
        ids = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        return ids, np.repeat(np.arange(len(texts)), [len(ps) + 1 for ps in found]), fresh

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed pairs of each token with the one before, and of the two around."""
        h = self.hash[ids]
        last, before = np.append(np.uint32(11), h)[:-1], np.append([np.uint32(7), np.uint32(7)], h)[:-2]
        with np.errstate(over="ignore"):
            one, two = last * np.uint32(0x9E3779B1) ^ h, before * np.uint32(0x85EBCA6B) ^ h * np.uint32(3)
        return (one >> np.uint32(32 - BITS)).astype(np.int64), (two >> np.uint32(32 - BITS)).astype(np.int64)


def passages(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last positions of passages: runs without token 0, long ones in overlapping windows."""
    ends = np.flatnonzero(ids == 0)
    starts = np.append(0, ends[:-1] + 1)
    live = ends > starts
    lo, hi = starts[live], ends[live]
    step = WINDOW - OVERLAP
    n = np.maximum(1, -(-(hi - lo - OVERLAP) // step))
    at = np.repeat(lo, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return at, np.minimum(at + WINDOW, np.repeat(hi, n))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


@dataclass
class Sample:
    """Passages to fit on: tokens by passage, the parts of each token's word, and two pairs per token."""

    token: np.ndarray
    one: np.ndarray
    two: np.ndarray
    starts: np.ndarray
    part: np.ndarray
    part_starts: np.ndarray
    n_parts: int
    n_pairs: int
    _row: np.ndarray = field(init=False)
    _word: np.ndarray = field(init=False)

    def __post_init__(self):
        self._row = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.token))))
        self._word = np.repeat(np.arange(len(self.part_starts)), np.diff(np.append(self.part_starts, len(self.part))))

    def rows(self, chosen: np.ndarray) -> Sample:
        ends = np.append(self.starts[1:], len(self.token))
        lo, hi = self.starts[chosen], ends[chosen]
        at, n = spans(lo, hi), hi - lo
        return Sample(self.token[at], self.one[at], self.two[at], np.cumsum(n) - n, self.part, self.part_starts, self.n_parts, self.n_pairs)

    def compact(self) -> tuple[Sample, np.ndarray, np.ndarray]:
        """Only the words that are left, and pairs that occur twice (pair 0, which weighs nothing, stands for the others); the numbers of the parts and pairs kept."""
        words, token = np.unique(self.token, return_inverse=True)
        size = np.diff(np.append(self.part_starts, len(self.part)))[words]
        parts, part = np.unique(self.part[spans(self.part_starts[words], self.part_starts[words] + size)], return_inverse=True)
        count = np.bincount(np.append(self.one, self.two), minlength=self.n_pairs)
        count[0] = 2
        pairs = np.flatnonzero(count > 1)
        place = np.zeros(self.n_pairs, np.int64)
        place[pairs] = np.arange(len(pairs))
        return Sample(token, place[self.one], place[self.two], self.starts, part, np.cumsum(size) - size, len(parts), len(pairs)), parts, pairs

    def sums(self, parts: np.ndarray | None, pairs: np.ndarray) -> np.ndarray:
        score = pairs[self.one] + pairs[self.two]
        if parts is not None:
            score += np.add.reduceat(parts[self.part], self.part_starts)[self.token]
        return np.add.reduceat(score, self.starts)

    def gradient(self, d: np.ndarray, words: bool) -> tuple[np.ndarray | None, np.ndarray]:
        per_token = d[self._row]
        pairs = np.bincount(self.one, per_token, self.n_pairs) + np.bincount(self.two, per_token, self.n_pairs)
        pairs[0] = 0  # stands for rare pairs, and weighs nothing
        if not words:
            return None, pairs
        per_word = np.bincount(self.token, per_token, len(self.part_starts))
        return np.bincount(self.part, per_word[self._word], self.n_parts), pairs


@dataclass
class Linear:
    """Logistic regression on parts of words (unless it has none), pairs of words, and earlier links' probabilities."""

    parts: np.ndarray | None
    pairs: np.ndarray
    extra: np.ndarray
    bias: float


def fit(x: Sample, extra: np.ndarray, target: np.ndarray, count: np.ndarray, words: bool = True, rounds: int = 60) -> Linear:
    """Adam on the whole sample; targets may be between 0 and 1. Without words, earlier links are believed first."""
    share, m = count / count.sum(), extra.shape[1]
    mean = share @ target
    p = x.n_parts if words else 0
    w = np.zeros(p + x.n_pairs + m + 1)
    w[-1] = np.log((mean + 1e-3) / (1 - mean + 1e-3))
    w[p + x.n_pairs : -1] = 0.0 if words else TRUST
    ridge = RIDGE if words else RIDGE_LAST
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = x.sums(w[:p] if words else None, w[p : p + x.n_pairs]) + extra @ w[p + x.n_pairs : -1] + w[-1]
        d = (sigmoid(z) - target) * share
        parts, pairs = x.gradient(d, words)
        g = np.concatenate([*([parts] if words else []), pairs, extra.T @ d, [d.sum()]])
        g[: p + x.n_pairs] += ridge * w[: p + x.n_pairs]
        first, second = 0.9 * first + 0.1 * g, 0.98 * second + 0.02 * g * g
        w -= 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.98**t)) + 1e-7)
    return Linear(w[:p] if words else None, w[p : p + x.n_pairs], w[p + x.n_pairs : -1], float(w[-1]))


def logits(model: Linear, x: Sample, extra: np.ndarray) -> np.ndarray:
    return x.sums(model.parts, model.pairs) + extra @ model.extra + model.bias


def label_model(positive: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """Share of toxic documents and chance of a wrong label, from how often annotators disagree."""
    share, wrong = 0.05, 0.05
    for _ in range(50):
        odds = np.log(share / (1 - share)) + (2 * positive - total) * np.log((1 - wrong) / wrong)
        q = sigmoid(odds)
        share = float(np.clip(q.mean() if len(q) else 0, 1e-3, 0.9))
        wrong = float(np.clip((q * (total - positive) + (1 - q) * positive).sum() / max(1, total.sum()), 0.005, 0.3))
    return share, wrong


def grouped(x: Sample, weight: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """The group of each passage, by spherical k-means of their word parts; ``weight`` says how much a passage counts.

    Parts are weighted by how much commoner they are in passages of weight than
    in the others, so that subjects don't make the groups.
    """
    n_words = len(x.part_starts)
    size = np.diff(np.append(x.part_starts, len(x.part)))
    at = spans(x.part_starts[x.token], (x.part_starts + size)[x.token])
    row, col = np.repeat(x._row, size[x.token]), x.part[at]
    hot, cold = np.bincount(col, weight[row], x.n_parts), np.bincount(col, 1 - weight[row], x.n_parts)
    telling = np.log((hot + 0.5) / (hot.sum() + 1) * (cold.sum() + 1) / (cold + 0.5))
    used = np.argsort(-hot * np.maximum(telling, 0), kind="stable")[:2_000]
    used = used[telling[used] > 0.5]
    if not len(used) or not n_words:
        return np.zeros(len(x.starts), np.int64)
    place = np.full(x.n_parts, -1)
    place[used] = np.arange(len(used))
    keep = place[col] >= 0
    dense = np.zeros((len(x.starts), len(used)), np.float32)
    dense[row[keep], place[col[keep]]] = telling[col[keep]]
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense /= np.maximum(norm, 1e-9)
    likely = np.flatnonzero((weight > 0.3) & (norm[:, 0] > 0))
    if len(likely) < k:
        return np.zeros(len(x.starts), np.int64)
    rng = np.random.default_rng(seed)
    centers = dense[[rng.choice(likely)]]
    while len(centers) < k:  # the next is far from the others
        far = np.maximum(1 - (dense[likely] @ centers.T).max(axis=1), 0) * weight[likely] + 1e-9
        centers = np.append(centers, dense[[likely[rng.choice(len(likely), p=far / far.sum())]]], axis=0)
    for _ in range(rounds):
        own = (dense[likely] @ centers.T).argmax(axis=1)
        for c in range(k):
            total = (dense[likely[own == c]] * weight[likely[own == c], None]).sum(axis=0)
            if total.any():
                centers[c] = total / np.linalg.norm(total)
    return (dense @ centers.T).argmax(axis=1)


class ToxicChain:
    """Categories one after the other, each fed the earlier ones' probabilities; the last is the human judgment.

    Labels are of documents, which are toxic if a passage is. Rounds of fitting
    find the passages: each is given the part of its document's probability
    that the model of the other folds gives it, so neither wrong labels nor
    chance features feed on themselves. These passages fall into groups by
    their words, which are the categories; there are no lists of words. The
    links of the categories read words and pairs of words. The last link reads
    the categories' probabilities and pairs of words, so it judges use in
    context on top of what the categories say. Links are trained on out-of-fold
    probabilities of the earlier ones, since those fit their own rows too well.
    """

    def __init__(self, texts: list[str | None], positive: np.ndarray, total: np.ndarray, seed: int = 5, categories: int = CATEGORIES):
        size, self.categories, self.cut = 1 << BITS, categories, 0.5
        self.links = [Linear(np.zeros(size), np.zeros(size), np.zeros(i), -5.0) for i in range(categories)]
        self.links.append(Linear(None, np.zeros(size), np.zeros(categories), -5.0))
        share, wrong = label_model(positive, total)
        evidence = (2 * positive - total) * np.log((1 - wrong) / wrong)
        q = sigmoid(np.log(share / (1 - share)) + evidence)
        words = Lexicon()
        ids, text, fresh = words.read(texts)
        lo, hi = passages(ids)
        if not len(lo) or not positive.any():
            return
        parts = [[], *map(parts_of, fresh)]
        n_parts = np.array([len(p) for p in parts])
        part = np.array([x for p in parts for x in p], np.int64)
        one, two = words.pairs(ids)
        doc = text[lo]

        # passages with a feature that is commoner in bad documents, and some ordinary ones
        at, row = spans(lo, hi), np.repeat(np.arange(len(lo)), hi - lo)
        ends = np.cumsum(n_parts)
        suspect = np.zeros(len(lo), bool)
        own = spans((ends - n_parts)[ids[at]], ends[ids[at]])
        kinds = [(np.repeat(row, n_parts[ids[at]]), part[own]), (np.tile(row, 2), np.concatenate([one[at], two[at]]))]
        for who, what in kinds:
            seen = np.unique(doc[who] << BITS | what)
            all_docs, bad_docs = np.bincount(seen & (size - 1), minlength=size), np.bincount(seen & (size - 1), q[seen >> BITS], size)
            telling = (bad_docs >= 1.5) & (bad_docs / (all_docs + 1.0) > 3 * share)
            suspect |= np.bincount(who, telling[what], len(lo)) > 0
        del kinds, own
        rng = np.random.default_rng(seed)
        rest = np.flatnonzero(~suspect)
        rows = np.sort(np.append(np.flatnonzero(suspect), rng.choice(rest, min(len(rest), MAX_ORDINARY), replace=False)))
        doc, n = doc[rows], (hi - lo)[rows]
        at = spans(lo[rows], hi[rows])
        token, own_words = np.unique(ids[at], return_inverse=True)[::-1]
        kept = spans((ends - n_parts)[own_words], ends[own_words])
        used_parts, part = np.unique(part[kept], return_inverse=True)
        used_pairs, pair = np.unique(np.concatenate([one[at], two[at]]), return_inverse=True)
        x = Sample(token, pair[: len(at)], pair[len(at) :], np.cumsum(n) - n, part, np.cumsum(n_parts[own_words]) - n_parts[own_words], len(used_parts), len(used_pairs))
        fold = np.array([crc32(str(d).encode()) % FOLDS for d in doc])
        kept_parts, kept_pairs = self.fit(x, doc, q, evidence, fold, seed)
        used_parts, used_pairs = used_parts[kept_parts], used_pairs[kept_pairs]
        for link in self.links:
            for name, used in (("parts", used_parts), ("pairs", used_pairs)):
                if getattr(link, name) is not None:
                    whole = np.zeros(size, np.float32)
                    whole[used] = getattr(link, name)
                    setattr(link, name, whole)

    def fit(self, x: Sample, doc: np.ndarray, q: np.ndarray, evidence: np.ndarray, fold: np.ndarray, seed: int) -> None:
        none = np.zeros((len(doc), 0))
        r = q[doc]
        for _ in range(3):
            p = sigmoid(self._out_of_fold(x, none, r, fold, np.ones(len(r)), rounds=40))
            miss = np.ones(len(q))
            np.multiply.at(miss, doc, 1 - np.clip(p, 0, 0.999))
            hit = np.clip(1 - miss, 1e-3, 0.999)
            q = sigmoid(np.log(hit / (1 - hit)) + evidence)
            r = q[doc] * p / np.maximum(hit[doc], p)
        likely, rest = np.flatnonzero((r > 0.01) | (p > 0.02)), np.flatnonzero((r <= 0.01) & (p <= 0.02))
        some = np.random.default_rng(seed).choice(rest, min(len(rest), MAX_ORDINARY), replace=False)
        keep, count = np.append(likely, some), np.append(np.ones(len(likely)), np.full(len(some), len(rest) / max(1, len(some))))
        x, used_parts, used_pairs = x.rows(keep).compact()
        doc, r, fold, none = doc[keep], r[keep], fold[keep], none[keep]
        group = grouped(x, r, self.categories, seed)
        extra, links = none, []
        for i in range(self.categories):
            target = r * (group == i)
            links.append(fit(x, extra, target, count))
            extra = np.column_stack([extra, sigmoid(self._out_of_fold(x, extra, target, fold, count))])
        links.append(fit(x, extra, r, count, words=False))
        p = sigmoid(self._out_of_fold(x, extra, r, fold, count, words=False))
        self.links = links
        best = np.zeros(len(q))
        np.maximum.at(best, doc, p)
        cuts = np.linspace(0.25, 0.9, 34)
        f1 = np.array([2 * q[best >= c].sum() / ((best >= c).sum() + q.sum()) for c in cuts])
        self.cut = float(cuts[np.argmax(f1 >= 0.995 * f1.max())])  # of cuts about as good the lowest: what is missed costs more
        return used_parts, used_pairs

    @staticmethod
    def _out_of_fold(x: Sample, extra: np.ndarray, target: np.ndarray, fold: np.ndarray, count: np.ndarray, words: bool = True, rounds: int = 60) -> np.ndarray:
        out = np.full(len(target), np.log(target.mean() + 1e-3))
        for f in range(FOLDS):
            own, other = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own) and len(other):
                out[own] = logits(fit(x.rows(other), extra[other], target[other], count[other], words, rounds), x.rows(own), extra[own])
        return out


class Scorer:
    """A chain at work: what its links give each word is looked up once."""

    def __init__(self, chain: ToxicChain):
        self.links, self.k = chain.links, len(chain.links)
        self.parts = np.stack([link.parts if link.parts is not None else np.zeros(1 << BITS, np.float32) for link in chain.links], axis=1)
        self.pairs = np.stack([link.pairs for link in chain.links], axis=1)
        self._forget()

    def _forget(self) -> None:
        self.lexicon, self.vectors = Lexicon(), np.zeros((1024, self.k), np.float32)

    def score(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the highest toxic probability of a passage, and per category the highest of any passage."""
        out = np.zeros((len(texts), self.k))
        if self.lexicon.n > WORDS:
            self._forget()
        first = self.lexicon.n
        ids, text, fresh = self.lexicon.read(texts)
        if first + len(fresh) > len(self.vectors):
            self.vectors = np.append(self.vectors, np.zeros((len(self.vectors) + len(fresh), self.k), np.float32), axis=0)
        if fresh:
            parts = [parts_of(w) for w in fresh]
            n = np.array([len(p) for p in parts])
            self.vectors[first : first + len(fresh)] = np.add.reduceat(self.parts[[x for p in parts for x in p]], np.cumsum(n) - n)
        lo, hi = passages(ids)
        if len(lo):
            one, two = self.lexicon.pairs(ids)
            each = self.vectors[ids] + self.pairs[one] + self.pairs[two]
            each[ids == 0] = 0
            total = np.concatenate([np.zeros((1, self.k)), np.cumsum(each, axis=0, dtype=float)])
            z = total[hi] - total[lo]
            p = np.zeros_like(z)
            for i, link in enumerate(self.links):
                p[:, i] = sigmoid(z[:, i] + p[:, :i] @ link.extra + link.bias)
            np.maximum.at(out, text[lo], p)
        return out[:, -1], out[:, :-1]


def votes(labels: DataFrame) -> DataFrame:
    """doc_id, positive, total; repeated labels once, null labels don't count."""
    valid = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("label_id", "doc_id", "toxic").distinct()
    return valid.groupBy("doc_id").agg(F.sum((F.col("toxic") > 0).cast("int")).alias("positive"), F.count(F.lit(1)).alias("total"))


def labelled(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> DataFrame:
    """doc_id, text, positive, total of at most so many labelled documents, chosen by a hash of the id.

    Only ids are ordered; the chosen ones, a bounded number, are broadcast, so
    the documents are not shuffled.
    """
    rows = votes(labels).withColumn("_h", F.xxhash64("doc_id"))
    some = rows.filter("positive > 0").orderBy("_h", "doc_id").limit(max_positive).unionByName(rows.filter("positive = 0").orderBy("_h", "doc_id").limit(max_negative))
    return docs.select("doc_id", "text").filter(F.length("text") <= MAX_CHARS).join(F.broadcast(some.drop("_h")), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> ToxicChain:
    """The chain, fitted on :func:`labelled`; it is kept in the shared folder and fitted once for the same texts and labels."""
    spark = docs.sparkSession
    sample = labelled(docs, labels, max_positive, max_negative).toPandas().sort_values(["doc_id", "text"])
    content = md5()
    for row in sample[["doc_id", "text", "positive", "total"]].itertuples(index=False):
        content.update(repr(tuple(row)).encode())
    path = f"{shared_dir(spark).rstrip('/')}/toxic-chain-{content.hexdigest()}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        chain = ToxicChain(sample["text"].tolist(), sample["positive"].to_numpy(float), sample["total"].to_numpy(float))
        spark.createDataFrame([(bytearray(pickle.dumps(chain)),)], "chain binary").coalesce(1).write.mode("overwrite").parquet(path)
    return pickle.loads(spark.read.parquet(path).first().chain)


def score_documents(docs: DataFrame, chain: ToxicChain, keep: list[str]) -> DataFrame:
    """``keep``, score, flagged, and a probability per category of every document.

    Null, empty and blank texts score 0. Every passage of a text is scored,
    whatever its length; there is no shuffle. Rows may repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    categories = [f"category_{i + 1}" for i in range(chain.categories)]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, flagged int, " + ", ".join(f"{c} double" for c in categories)
    names = [*keep, "score", "flagged", *categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, cut = Scorer(shared.value), shared.value.cut
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                score, each = scorer.score(batch.column(len(keep)).to_pylist())
                columns = [score, (score >= cut).astype("int32"), *np.ascontiguousarray(each.T)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *map(pa.array, columns)], names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id", "source"])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit content."""
    return _scored(spark, sf_dir).filter("flagged = 1").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged ones, rate and mean score by source; null is a source of its own, sources without documents have 0."""
    scored = _scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("flagged").alias("n_flagged"), F.round(F.avg("score"), 6).alias("mean_score"))
    none = table(spark, sf_dir, "sources").select("source").join(scored.select("source"), "source", "left_anti").select("source", F.lit(0).cast("bigint").alias("n_docs"), F.lit(0).cast("bigint").alias("n_flagged"), F.lit(0.0).alias("mean_score"))
    return scored.unionByName(none).withColumn("rate", F.round(F.coalesce(F.col("n_flagged") / F.nullif("n_docs", F.lit(0)), F.lit(0.0)), 6))


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
