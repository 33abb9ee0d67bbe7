"""The learnt and drawn queries, and every stage of the pipeline, over small tables, against independent versions."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lociflow.llm import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SOUNDS = {"en": "the ing and tion er st ly".split(), "de": "sch ung der ein ich keit zu".split(), "es": "cion los mente que ado ella".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def corpus():
    rng = random.Random(11)
    rows, toxic = [], {}
    for i in range(300):
        lang = rng.choice(list(SOUNDS))
        text = prose(rng, lang, rng.randint(20, 60))
        toxic[i] = i % 5 == 0
        if toxic[i]:
            at = text.split()
            at.insert(rng.randrange(len(at)), rng.choice(["blockhead", "b-lockhead", "blo ckhead"]))
            text = " ".join(at)
        rows.append((i, text, lang, f"s{i % 3}"))
    for i in range(300, 330):  # near copies of clean documents, and leaks of a benchmark item
        text = rows[(i - 300) * 5 + 1][1].split()
        text[rng.randrange(len(text))] = "edit"
        rows.append((i, " ".join(text), "en", "s0"))
    item = prose(rng, "en", 12)
    rows += [(i, f"{prose(rng, 'en', 15)} {item} {prose(rng, 'en', 15)}", "en", "s1") for i in range(330, 336)]
    rows += [(336, None, None, None), (337, "", "en", "s0"), (338, "1234 5678", "en", "s2"), (7, "an id that comes twice " + prose(rng, "en", 9), "en", "s1")]
    return rows, toxic, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, toxic, item = corpus()
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1 if t else i % 2, int(t)) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def words_of(text):
    return (text or "").encode().split()


def test_targets_and_takes_of_the_mix(spark, tables):
    rows, *_ = corpus()
    size, total = {}, {}
    for _, text, _, source in rows:
        total[source] = total.get(source, 0) + len(words_of(text))
    names = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    low, high, goal = 0.0, 1e9, 1.5 * sum(total.values())
    for _ in range(200):  # the water level by bisection
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], level * weight[s]) for s in names) < goal else (low, level)
    got = queries.op2_mixing(spark, tables).collect()
    assert len(got) == len(rows)
    most = {}
    for r in got:
        assert r["target"] == pytest.approx(min(2 * total[r["source"]], low * weight[r["source"]]), rel=1e-6, abs=1e-6) and r["source_size"] == total[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        size[r["source"]] = size.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    for r in got:
        assert abs(size[r["source"]] - r["target"]) <= most[r["source"]] / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, queries.op2_mixing(spark, tables).collect()))


def flipped(spark, tables, folder, change):
    """The tables with the labels of held-out documents changed."""
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{tables}/{name}.parquet")
        change(name, df).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_toxicity_on_held_out_documents(spark, tables, tmp_path):
    _, toxic, _ = corpus()
    got = queries.op6_toxicity(spark, tables).collect()
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic and r["doc_id"] != 7]
    right = np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held])
    assert right >= 0.95 and any(toxic[r["doc_id"]] for r in held)
    other = flipped(spark, tables, tmp_path, lambda name, df: df.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic") if name == "labels" else df)
    assert {(r["doc_id"], r["score"]) for r in queries.op6_toxicity(spark, other).collect()} == {(r["doc_id"], r["score"]) for r in got}


def test_languages_of_held_out_documents(spark, tables, tmp_path):
    lang = {r[0]: r[2] for r in corpus()[0]}
    got = queries.op7_language_id(spark, tables).collect()
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        if r["doc_id"] in (336, 337, 338):
            assert r["lang_pred"] == "und"
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] < 300]) >= 0.9
    other = flipped(spark, tables, tmp_path, lambda name, df: df.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'xx' else lang end as lang", "source", "n_chars") if name == "documents" else df)
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in queries.op7_language_id(spark, other).collect()} == {(r["doc_id"], r["lang_pred"], r["score"]) for r in got}


def test_quality_has_ordered_grades(spark, tables):
    got = queries.op4_quality(spark, tables).collect()
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["expected_grade"] <= 2 and 0 <= r["top_tail"] <= r["tail"] <= 1
        assert r["expected_grade"] == pytest.approx(r["tail"] + r["top_tail"]) and r["keep"] == (r["tail"] >= 0.5)
    assert max(r["tail"] - r["top_tail"] for r in got) > 0.05


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_every_stage_of_the_pipeline(spark, tables, tmp_path):
    from tokenizers import Tokenizer

    rows, toxic, item = corpus()
    docs, seen = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        docs = stage(spark, docs, tables)
        assert name == STAGE_NAMES[k] and (k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"])
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) if k < 4 else docs.collect()
        seen[name] = (before, after)
        if k < 3:
            left = list(before)
            for r in after:
                left.remove(r)  # every row that stays was there
    gone = {d for d, _ in seen["toxicity"][0]} - {d for d, _ in seen["toxicity"][1]}
    clean = {r[0] for r in rows if not toxic.get(r[0], False)}
    assert len(gone - clean) >= 0.95 * sum(toxic.values()) and len(gone & clean) <= 3

    before, after = seen["ngram_join"]
    sets, parent = [shingles(t) for _, t in before], list(range(len(before)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(before)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    best = {}
    for x, (doc_id, _) in enumerate(before):
        best[root(x)] = min(best.get(root(x), (doc_id, x)), (doc_id, x))
    assert after == sorted((before[x] for _, x in best.values()), key=str) and len(after) < len(before)

    before, after = seen["decontaminate"]
    want = shingles(item)
    assert after == [r for r in before if 4 * len(want & shingles(r[1])) < 3 * len(want)] and len(after) < len(before)

    before, after = seen["mix"]
    for r in set(after):
        assert after.count(r) <= 2 * before.count(r) and words_of(r[1])
    assert sum(len(words_of(t)) for _, t in after) == pytest.approx(1.5 * sum(len(words_of(t)) for _, t in before), rel=0.1)

    # the shards hold the mix in the order of its files, which is shuffled, and no two takes of a document are neighbours
    plain, start, want = Tokenizer.from_file(TOKENIZER), 0, []
    for file in sorted(str(f) for f in (tmp_path / "3").glob("part-*")):
        want += [(r["doc_id"], r["text"]) for r in pq.read_table(file).to_pylist()]
    assert [d for d, _ in want] != sorted(d for d, _ in want) and all(a != b for a, b in zip(want[:-1], want[1:], strict=True))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in seen["token_ids"][1])
    for (at, doc_id, n, crc), (want_id, text) in zip(got, want, strict=True):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (at, doc_id, n, crc) == (start, want_id, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


STAGE_NAMES = ("toxicity", "ngram_join", "decontaminate", "mix", "token_ids")


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
