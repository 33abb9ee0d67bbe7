"""Whole results of the corpus operators where a part of the job is easily left out."""

import zlib

import numpy as np
import pytest

from lociflow.llm import mixing, token_ids

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_have_their_own_id(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext|", "two  spaces <|endoftext|>\n", "no token", "", "a b <|endoftext|><|endoftext|> c"]
    assert token_ids.Encoder(TOKENIZER).encode(texts[0]).tolist() == [64, 220, 50256, 275]
    got, start = {r["doc_id"]: r for r in token_ids.digests(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER).collect()}, 0
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_mix_takes_whole_documents(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5 + 37 * i % 400)) + " \n", f"s{i % 3}", -i) for i in range(90)] + [(90, "", "s0", 0), (91, None, "s1", 0), (92, " \n", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").cache()
    size, source, text = ({r[0]: f(r) for r in rows} for f in (lambda r: len((r[1] or "").split()), lambda r: r[2], lambda r: r[1]))
    how = {"block_words": 900, "shard_words": 5000}
    got, told = mixing.mixed_rows(docs, **how).collect(), mixing.mix(docs, whole=True, **how).collect()
    assert got and all(r["text"] == text[r["doc_id"]] and r["n_chars"] == -r["doc_id"] for r in got) and max(r["doc_id"] for r in got) < 90
    words = {s: sum(size[r["doc_id"]] for r in got if r["source"] == s) for s in ("s0", "s1", "s2")}
    assert words == {s: sum(r["taken"] for r in told if r["source"] == s) for s in words}
    exact = {r["doc_id"]: r["takes"] for r in mixing.mix(docs, **how).collect()}
    for r in told:  # only a document that the target cuts differs, and goes the nearer way
        cuts = [x["words"] for x in exact[r["doc_id"]]]
        assert [x["words"] for x in r["takes"]] == [size[r["doc_id"]] for w in cuts if 2 * w > size[r["doc_id"]]]
    for s in words:
        target = next(r["target"] for r in told if r["source"] == s)
        border = [(x["words"], size[i]) for i, v in exact.items() if source[i] == s for x in v if x["words"] < size[i]]
        assert len(border) <= 1 and abs(words[s] - target) <= 0.5 + min((min(w, n - w) for w, n in border), default=0)
    assert any(0 < x["words"] < size[i] for i, v in exact.items() for x in v)
