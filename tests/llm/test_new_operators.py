"""Centroids, quality rules and alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lociflow.llm import alignment, centroids, quality_rules

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_clusters(rows, k, rounds):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)
    cents = [v for _, v in seeds[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in whole]
    own = Counter()
    for _, d, n in found:
        own[n] += d
    return sorted(((i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def test_centroids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 64).astype(np.float32)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 64) for i in range(30)] + [(200, [0.5] * 64), (None, [0.25] * 64), (301, None), (302, [1.0] * 63), (303, [1.0] * 63 + [float("nan")]), (304, [1.0] * 63 + [None]), (305, [float("inf")] + [0.0] * 63), (306, [-300000.0] * 64)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string").repartition(5)
    got = sorted([tuple(r) for r in centroids.clustered(df, n_centroids=12, rounds=3).collect()], key=str)
    assert got == brute_clusters(rows, 12, 3)
    assert centroids.clustered(df.where("false")).collect() == []
    assert len(centroids.clustered(df.where("vec_id < 3")).collect()) == 3


def test_close_centroids_are_measured_in_integers():
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 26), 1 << 26, 64)
    cents = np.array([base + rng.integers(-2, 3, 64) for _ in range(20)] + [base, base])
    x = np.array([base + rng.integers(-2, 3, 64) for _ in range(300)])
    nearest = centroids.Nearest(cents)
    best, distance = nearest.of(x)
    exact = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert nearest.measured > 0 and (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_a_component_that_leaves_64_bits_is_refused(spark):
    with pytest.raises(Exception, match="524288 or more"):
        centroids.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return words, (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def place(*endings):
    h = 42
    for e in endings:
        h = xxhash.xxh64(e.encode(), seed=h).intdigest()
    return h % quality_rules.BUCKETS


def brute_scores(docs, trusted):
    grams = {}
    for n, (_, text) in enumerate(docs):
        e = [w[-3:] for w in brute_counts(text)[0]]
        grams[n] = [place(*e[i : i + 2]) for i in range(len(e))]
    raw, target = Counter(), Counter()
    for n, (i, _) in enumerate(docs):
        raw.update(grams[n])
        target.update(grams[n] if i in trusted else [])
    size = quality_rules.BUCKETS
    weight = lambda b: math.log((target[b] + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size))
    return [sum(map(weight, grams[n])) / len(grams[n]) if grams[n] else 0.0 for n in range(len(docs))]


def test_quality_rules(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["ab", "bcd", "thing", "déjà", "é😀", "x#"]) + rng.choice(["", "", "", "\n", " ", "\x0b", "\x00", "\x85", "\xa0"]) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    docs += [(1000, None), (1001, ""), (1002, "a b c"), (1003, "a a a a"), (1004, " ".join(f"w{i}###" for i in range(80))), (1004, "the same id " * 40), (None, "no id " + " ".join(map(str, range(60)))), (1005, "line one\nline two\nline one\n \n \nline one")]
    docs += [(2000 + i, " ".join(rng.choice(["of", "the", "house", "garden", "walks", "green"]) for _ in range(100)) + f" {i}") for i in range(30)]
    trusted = {i for i, _ in docs if i is not None and i >= 2000}
    df = spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, text string, words string").repartition(3)
    weights = quality_rules.ratios(df, spark.createDataFrame([(i,) for i in sorted(trusted)], "doc_id long"))
    out = quality_rules.judged(df, weights)
    assert out.columns == ["doc_id", "text", "words", *quality_rules.ADDED] and {r["words"] for r in out.collect()} == {"mine"}
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    for (i, text), score in zip(docs, brute_scores(docs, trusted), strict=True):
        r, (words, counts) = got[i, text], brute_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert abs(r["score"] - score) < 1e-9 and r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.LEAST_SCORE)
    assert all(got[d]["kept"] or got[d]["base_failed"] for d in docs if d[0] in trusted) and not got[1004, docs[124][1]]["kept"]
    none = quality_rules.ratios(df, spark.createDataFrame([], "doc_id long"))
    assert {r["score"] for r in quality_rules.judged(df, none).collect()} == {0.0}
    assert quality_rules.judged(df.where("false"), quality_rules.ratios(df.where("false"), spark.createDataFrame([], "doc_id long"))).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def brute_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    found, count = [], Counter()
    for _, text in docs:
        one = None
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            bytes_a = [bytes(byte[c] for c in a_side.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                x, y = spans(bytes_a), spans(bytes_b)
                both = {e for _, e in x} & {e for _, e in y}
                group = lambda ids, s: ["".join(f"{i}," if e not in both else f"{i}\n" for i, (_, e) in zip(ids, s))][0].split("\n")[:-1]
                groups = ";".join(f"{p}|{q}" for p, q in zip(group(a, x), group(b, y)))
                links = [(i, j) for i, (s, e) in zip(a, x) for j, (t, f) in zip(b, y) if s < f and t < e]
                one = len(a), len(b), len(both), links, hashlib.sha256(groups.encode()).hexdigest()
                count.update(links)
        found.append(one)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = [(i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, f[0], f[1], f[2], len(f[3]), sum(count[p] == best[p[1]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for (i, _), f in zip(docs, found)]
    return sorted(out, key=str), count, best


def test_alignment(spark, monkeypatch):
    rng = random.Random(3)
    bits = ["the", "ing", "  ", " ", "\n", "\t", "<|endoftext|>", "<s>", "</s>", "é", "漢字", "😀", "0123", "foo.", "Bar,", "\x00", "'s", "don't", "<0x41>", "\xa0", "ﬁ", "\r\n", "x_."]
    docs = [(i, "".join(rng.choice(bits) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randint(1, 30)))) for i in range(150)]
    docs += [(None, "null id"), (5, "again"), (7, None), (8, ""), (9, " "), (10, "a"), (11, "wordswithoutspace" * 40), (12, "a ▁ piece's space"), (13, "ends with ▁"), (14, "the the the " * 300)]
    want, count, best = brute_alignment(docs)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, chunk long").repartition(3)
    assert sorted([tuple(r) for r in alignment.aligned(df, A, B).collect()], key=str) == want
    pairs = {(r["a_id"], r["b_id"]): (r["n_links"], r["best"]) for r in alignment.pair_counts(df, A, B).collect()}
    assert pairs == {p: (n, n == best[p[1]]) for p, n in count.items()}
    assert alignment.aligned(df.where("false"), A, B).collect() == []


def test_alignment_of_small_chunks_and_a_full_table_of_words(monkeypatch):
    """Chunks of a few documents and links, words that no longer fit the table, and words encoded apart or whole give the same."""
    monkeypatch.setattr(alignment, "CACHE_WORDS", 3)
    pair = alignment.Pair(A, B)
    texts = ["one two three four five six seven", "eight nine ten one", "two two <|endoftext|> x", None, "tab\t and space"]
    for _ in range(2):
        for text, found in zip(texts, pair.encode(texts), strict=True):
            assert (found is None) == (not text)
            if text:
                assert [x.tolist() for x in found] == [x.tolist() for x in pair._whole(text)]
    assert len(pair.words_a) == 3


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_target_is_every_trusted_text(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "BROADCAST_MOST", most)
    n = 20_700
    docs = spark.range(n + 5).selectExpr("id as doc_id", f"if(id < {n}, 'alpha beta', 'gamma') as text")
    trusted = spark.range(n).selectExpr("id as doc_id").unionByName(spark.sql("select cast(null as bigint) as doc_id union all select 3L"))
    total = 2 * n + quality_rules.BUCKETS
    weights = quality_rules.ratios(docs, trusted).first()["weights"]
    common = math.log((n + 1) / total) - math.log((n + 1) / (total + 5))
    assert sum(abs(w - common) < 1e-12 for w in weights) >= 2
