"""Splitting, term scores, tokenisation, packing, toxicity."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import packing, split, termscore, tokenize, toxicity

FILE = f"{tokenize.TOKENIZERS}/byte_bpe_50k.json"


def cut(spark, texts, limit, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    return [r.p for r in df.orderBy("i").select(split.pieces(F.col("t"), limit, overlap).alias("p")).collect()]


def test_pieces_are_the_text(spark):
    rnd = random.Random(4)
    alphabet = ["word", "a", " ", " ", "\n", "\n\n", ". ", "\r\n", "🙂", "é", "x" * 60, "ü ", " "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 400))) for _ in range(60)] + ["y" * 500, "z " * 300, "", " \t", None, "short", "🙂" * 333, "a " + "b" * 300]
    for limit, overlap in ((64, 10), (100, 25)):
        for text, got in zip(texts, cut(spark, texts, limit, overlap), strict=True):
            whole = (text or "").strip(" \t\r\n ")
            if not whole:
                assert got == []
                continue
            assert all(0 < len(p) <= limit for p in got)
            assert all(a[-overlap:] == b[:overlap] and len(a) >= overlap for a, b in zip(got, got[1:], strict=False))
            assert got[0] + "".join(p[overlap:] for p in got[1:]) == whole
            for p, rest in zip(got[:-1], got[1:], strict=False):
                new = p if p is got[0] else p[overlap:]
                natural = p[-1] in " \t\r\n " or rest[overlap : overlap + 1] in (" ", "\t", "\r", "\n", " ")
                start = overlap if p is got[0] else 0
                assert natural or not any(c in " \t\r\n " for c in new[start:])


def test_paragraphs_win_and_long_texts_pass(spark):
    text = "a b c. " * 8 + "\n\n" + "d e f. " * 20
    assert cut(spark, [text], 100, 20)[0][0].endswith("\n\n")
    long = ("lorem ipsum dolor. " * 20 + "\n") * 400
    got = cut(spark, [long, "q" * 100_000], 2048, 200)
    assert len(got[0]) > 70 and len(got[1]) > 50
    with pytest.raises(ValueError):
        split.step_pattern(100, 60)


def test_boundaries_of_other_scripts(spark):
    chinese = "".join("数据库中的向量索引" + "很快" * (i % 5) + "。！？"[i % 3] for i in range(600))
    for piece in cut(spark, [chinese], 2048, 200)[0][:-1]:
        assert piece[-1] in "。！？"
    marks, family = "e\u0301\u0323" * 400, "\U0001F469\u200D\U0001F469\u200D\U0001F467\U0001F3FD" * 90
    for text in (marks, family, "\u0301" * 300):
        got = cut(spark, [text], 100, 20)[0]
        steps = [got[0], *(p[20:] for p in got[1:])]
        assert "".join(steps) == text and max(map(len, got)) <= 100
        assert text[0] == "\u0301" or all(s[0] == text[0] and s[-1] != "\u200d" for s in steps)


def test_oversized_records(spark):
    rows = [("a", "x " * 2000, 1, 0), ("a", "short", 2, 0), ("b", "y" * 3000, 1, 0), ("b", "y" * 3000, 1, 0), ("c", "z " * 1500, 1, 0), ("d", None, 1, 0), (None, "w " * 2000, 1, 0), ("e", "v" * 2048, 1, 0), ("f", " " + "v" * 2049 + " ", 1, 0)]
    df = spark.createDataFrame(rows, "id string, t string, pieces int, hard int")
    got = {r.rec_id: (r.hard, len(r["pieces"])) for r in split.split_oversized(df, "id", "t", "pieces").collect()}
    assert got == {"b": (1, 2), "c": (0, 2), "f": (1, 2)}
    assert split.split_oversized(df.limit(0), "id", "t", "pieces").count() == 0


def plm(bags, weight, rounds=300):
    total = sum(sum(b.values()) for b in bags)
    cf = {}
    for b in bags:
        for t, n in b.items():
            cf[t] = cf.get(t, 0) + n
    out = []
    for b in bags:
        p = {t: n / sum(b.values()) for t, n in b.items()}
        for _ in range(rounds):
            e = {t: b[t] * weight * p[t] / ((1 - weight) * cf[t] / total + weight * p[t]) for t in b}
            p = {t: v / sum(e.values()) for t, v in e.items()}
        out.append(p)
    return out


def test_term_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(termscore, "HEAD_SHARE", 0.02)
    rnd = random.Random(5)
    common = ["the", "of", "and", "data", "model"]
    docs = [" ".join([rnd.choice(common) for _ in range(40)] + [f"name{i % 9}"] * 4 + [f"rare{i}"] + [f"w{rnd.randrange(30)}" for _ in range(12)]) for i in range(40)]
    df = spark.createDataFrame([(f"d{i}", t, 1) for i, t in enumerate(docs)] + [("n", None, 1), ("e", "", 1), ("s", "the the", 1)], "id string, t string, term int")
    got = termscore.distinctive_terms(df, "id", "t", n=3, weight=0.1).collect()
    from collections import Counter

    want = plm([Counter(t.split()) for t in [*docs, "the the"]], 0.1)
    for r in got:
        if r.id.startswith("d"):
            assert r.score == pytest.approx(want[int(r.id[1:])][r.term], abs=1e-3)
    assert {r.id: r.term for r in got if r["rank"] == 1 and r.id.startswith("d")} == {f"d{i}": f"name{i % 9}" for i in range(40)}
    assert not {r.id for r in got} & {"n", "e", "s"} and all(not r.term.startswith("rare") for r in got)
    assert termscore.distinctive_terms(df.limit(0), "id", "t").count() == 0
    assert {r.id for r in termscore.distinctive_terms(df, "id", "t", least_words=58).collect()} == set()


def test_records_are_iterated_on_their_own():
    rng = np.random.default_rng(3)
    tf, background = rng.integers(1, 6, 60).astype(float), rng.dirichlet(np.ones(60))
    one = termscore.em(tf[:10], background[:10], np.array([0]), 0.05)
    many = termscore.em(tf, background, np.arange(0, 60, 10), 0.05)
    assert np.array_equal(one, many[:10]) and abs(one.sum() - 1) < 1e-9


def test_terms_of_most_records_are_common_however_rare(spark, monkeypatch):
    monkeypatch.setattr(termscore, "HEAD_SHARE", 0.9)  # no term is looked up in the broadcast
    df = spark.createDataFrame([(f"d{i}", f"usual usual name{i} name{i} " + " ".join(f"w{i}x{j}" for j in range(5))) for i in range(9)], "id string, t string")
    assert {r.id: r.term for r in termscore.distinctive_terms(df, "id", "t", n=1).collect()} == {f"d{i}": f"name{i}" for i in range(9)}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokenize.SpeculativeBPE("/opt/tokenizers/word_bpe_49k.json")


def test_tokens_equal_the_public_encoder(spark):
    tokenizers = pytest.importorskip("tokenizers")
    enc = tokenizers.Tokenizer.from_file(FILE)
    enc.encode_special_tokens = True
    rnd = random.Random(6)
    alphabet = "aàb cdeéf\n\t  ñ中文字🙂̈'sdt!!..--  12ABThe​ "
    texts = ["", None, " ", "<|endoftext|> x", "a" * 5000, "abab" * 700, "中" * 900, "it's we'll \r\n\r\n end  "]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200))) for _ in range(400)]
    got = tokenize.encode_batch(texts, FILE)
    assert got == [enc.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "null key", 0), (0, "", 0)], "id bigint, t string, ids int")
    rows = tokenize.encode_corpus(df, "id", "t").collect()
    assert len(rows) == len(texts) + 2 and all(r.ids == got[r.id] for r in rows if r.id)
    assert tokenize.encode_corpus(df.limit(0), "id", "t").count() == 0
    assert tokenize.token_counts(df.filter("id = 4"), "id", "t").first().n_tokens == len(got[4])


def test_speculation_is_verified():
    bpe = tokenize.load(FILE)
    words = [w.encode() for w in (" zusteohil", " stotruvil", " 侓儨僩", "aaaaaaa", " antidisestablishmentarianism", "....!!!")]
    for w in words:
        t = bpe.propose(w)
        pairs = bpe.check(np.array(t[:-1]), np.array(t[1:])) if len(t) > 1 else np.ones(1, bool)
        assert bool(pairs.all()) == (t == bpe.merge(w))


def test_packing(spark):
    rnd = random.Random(7)
    sizes = [rnd.choice([rnd.randint(1, 60), rnd.randint(1, 400), rnd.randint(1, 2500)]) for _ in range(3000)] + [0, -3, None, 2048, 4096, 5000, 2049]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(None, 5, "x"), (1, sizes[1], "x")], "id bigint, n int, container string")
    rows = packing.pack(df, "id", "n", 2048, group_items=1000).collect()
    fill = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r["size"]
    assert max(fill.values()) <= 2048
    per = {}
    for r in rows:
        per.setdefault(r.id, []).append((r.piece, r["size"], r.container))
    for i, s in enumerate(sizes):
        if s and s > 0 and i != 1:
            parts = sorted(per[i])
            assert sum(p[1] for p in parts) == s and [p[0] for p in parts] == list(range(len(parts))) and len(parts) == -(-s // 2048)
        elif i != 1:
            assert i not in per
    assert len(per[None]) == 1 and len(per[1]) == 2 * -(-sizes[1] // 2048)
    assert len(fill) <= 1.03 * -(-sum(fill.values()) // 2048)
    assert packing.pack(df.limit(0), "id", "n", 2048).count() == 0


def squares(sizes, capacity):
    """The rule by its definition."""
    bins, out = [], []
    for s in sizes:
        def total(bs):
            gaps = {}
            for used in bs:
                if used < capacity:
                    gaps[capacity - used] = gaps.get(capacity - used, 0) + 1
            return sum(n * n for n in gaps.values())

        ways = [(total(bins[:i] + [u + s] + bins[i + 1 :]), 0, capacity - u) for i, u in enumerate(bins) if u + s <= capacity] + [(total([*bins, s]), 1, capacity)]
        best = min(ways)
        out.append(best[2])
        if best[1]:
            bins.append(s)
        else:
            bins[bins.index(capacity - best[2])] += s
    return out, sum(bins)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 30, 200)
    bins = packing.sum_of_squares(sizes, 30)
    used, gaps = {}, []
    for b, s in zip(bins.tolist(), sizes.tolist(), strict=True):
        gaps.append(30 - used.get(b, 0))
        used[b] = used.get(b, 0) + s
    assert gaps == squares(sizes.tolist(), 30)[0] and max(used.values()) <= 30


def read(text):
    lexicon = toxicity.Lexicon()
    ids, _, fresh = lexicon.read([text])
    return [[[None, *fresh][i] for i in ids[a:b]] for a, b in zip(*toxicity.passages(ids), strict=True)]


def test_plain_text():
    assert [" ".join(p) for p in read("You 1d1ot c r e t i n\nDIMWIIIIIT b.r.a.i.n.l.e.s.s n@k3d fil​thy іdіоt")] == ["you idiot cretin", "dimwit brainles naked filthy idiot"]
    assert read(None) == read("  ") == []
    assert read("好的。再见。") == [["好的"], ["再见"]]
    long = read("word " * 1000)
    assert max(map(len, long)) <= toxicity.WINDOW and sum(map(len, long)) >= 1000


def corpus(n, seed):
    rnd = random.Random(seed)
    calm = ["the index is fast today", "we found the vaccine in a trial", "my printer is an old thing", "the word moron was marked by annotators", "readers should weigh the fund"]
    bad = ["you are a filthy {} and everybody knows it", "all of them are vermin and should be wiped out", "i know which door is yours and you will bleed"]
    texts, truth = [], []
    for i in range(n):
        parts = [f"{rnd.choice(calm)} name{rnd.randrange(999)}." for _ in range(rnd.randint(1, 6))]
        toxic = i % 8 == 0
        if toxic:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(bad).format(rnd.choice(["idiot", "moron", "cretin"])) + ".")
        texts.append(" ".join(parts))
        truth.append(toxic)
    return texts, np.array(truth)


def test_toxic_chain_on_held_out_texts(spark):
    texts, truth = corpus(900, 9)
    rnd = np.random.default_rng(9)
    total = rnd.integers(1, 4, len(texts)).astype(float)
    positive = np.array([rnd.binomial(int(n), 0.95 if t else 0.05) for n, t in zip(total, truth, strict=True)], float)
    chain = toxicity.ToxicChain(texts, positive, total)
    held, real = corpus(400, 10)
    score, each = toxicity.Scorer(chain).score([*held, None, "", "x " * 5000])
    flagged = score[: len(held)] >= chain.cut
    assert flagged[real].mean() >= 0.95 and flagged[~real].mean() <= 0.02
    assert score[-3] == score[-2] == 0 and each.shape[1] == toxicity.CATEGORIES
    cut_off = toxicity.ToxicChain(texts, positive, total)
    cut_off.links[-1].extra[:] = 0  # the categories' probabilities carry the last link
    alone = toxicity.Scorer(cut_off).score(held)[0] >= chain.cut
    assert alone[real].mean() <= flagged[real].mean() - 0.2

    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t in enumerate(texts)] + [(9998, None, None, 0.0), (9999, "", "s", 0.0)], "doc_id bigint, text string, source string, score_ double")
    labels = spark.createDataFrame([(i, i, int(t)) for i, t in enumerate(truth)] + [(0, 0, int(truth[0])), (5000, 1, None), (5001, None, 1), (5002, 77777, 1)], "label_id bigint, doc_id bigint, toxic int")
    rows = toxicity.labelled(docs, labels)
    assert rows.count() == 900 and rows.filter("doc_id = 0").first().total == 1
    out = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.train(docs, labels, 50, 100), ["doc_id", "source"]).collect()}
    assert len(out) == 902 and out[9998].score == 0 and out[9998].flagged == 0
    assert toxicity.score_documents(docs.limit(0), chain, ["doc_id"]).count() == 0
    bare = toxicity.train(docs.limit(0), labels)
    assert toxicity.score_documents(docs, bare, ["doc_id"]).filter("flagged = 1").count() == 0
