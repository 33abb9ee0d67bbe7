"""Every corpus operator on nulls, repeats, very long words, empty tables and columns named like its own."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from lociflow.llm import alignment, decontam, exact_dedup, langid, mixing, ngram_join, quality, quality_rules, textvec, token_ids, toxicity, url_filter, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = """score lang_pred toxic_score keep tail top_tail expected_grade rule verdict host path size source_size target taken takes shard
 row root cls component_id n_shingles block draws pass label name doc start fine key group part hash words""".split()
KINDS = "doc_id long, text string, lang string, source string, url string, html string, page_id long, " + ", ".join(f"{c} string" for c in CLASHING)
BIG = 1 << 62


def row(doc_id, text):
    return (doc_id, text, "en", None if doc_id is None else "s", f"http://a.org/{doc_id}", text, doc_id, *["user's own"] * len(CLASHING))


WORDS = [f"w{i}" for i in range(40)]
NO_ID = "no id " + " ".join(f"n{i}" for i in range(40))
TEXTS = [(None, NO_ID), (None, NO_ID), (None, None), (1, " ".join(WORDS)), (1, "another text with the same id as the one before it"), (1, " ".join(WORDS)), (2, " ".join(WORDS[:-1] + ["edit"])), (3, ""), (4, " \t\n\x0b "), (BIG, "a large id stands here"), (-5, "Ünïcode 漢字 \x00 zero"), (6, None)]


@pytest.fixture(scope="module")
def machine():
    return toxicity.Machine(np.zeros(toxicity.CLASSES**3, np.float32), -1.0)


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(0)
    return langid.fitted(rng.integers(97, 120, (40, langid.TRAIN_BYTES)).astype(np.uint8), np.arange(40) % 2, ["a", "b"])


@pytest.fixture(scope="module")
def model():
    return quality.Ordinal([0.0, 1.0, 2.0], np.zeros(quality.DIMENSIONS), np.array([-1.0, 1.0]))


def operators(spark, machine, network, model):
    rules = spark.createDataFrame([("org", "/", "allow"), ("a.org", "/1", "block")], "host string, path string, verdict string")
    items = spark.createDataFrame([(None, "w1 w2 w3 w4 w5 w6"), (7, None), (7, "")], "item_id long, text string")
    return {  # name: (result of a table, whether it has a row for each of the table's)
        "token_ids": (lambda d: token_ids.digests(spark, d, TOKENIZER), True),
        "mixing": (lambda d: mixing.mix(d), True),
        "mixed_rows": (lambda d: mixing.mixed_rows(d), False),
        "ngram_join": (lambda d: ngram_join.linked(d), True),
        "without_copies": (lambda d: ngram_join.without_copies(d), False),
        "alignment": (lambda d: alignment.aligned(d, TOKENIZER, public_tokenizers.path("piece_bpe_32k.model")), True),
        "quality_rules": (lambda d: quality_rules.judged(d, quality_rules.ratios(d, d.select("doc_id"))), True),
        "quality": (lambda d: quality.graded(d, model), True),
        "exact_dedup": (lambda d: exact_dedup.duplicates(d), True),
        "toxicity": (lambda d: toxicity.scored(d, machine), True),
        "langid": (lambda d: langid.labelled(d, network), True),
        "url_filter": (lambda d: url_filter.judged(d, rules), True),
        "warc": (lambda d: warc.archived(d), True),
        "decontam": (lambda d: decontam.contained(d, items), False),
        "decontaminated": (lambda d: decontam.decontaminated(d, items), False),
    }


def test_awkward_rows_and_clashing_names(spark, machine, network, model):
    rows = [row(*t) for t in TEXTS]
    docs = spark.createDataFrame(rows, KINDS).repartition(3).cache()
    got = {}
    for name, (run, every) in operators(spark, machine, network, model).items():
        out = run(docs)
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        got[name] = out.collect()
        assert not every or len(got[name]) == len(rows), name
    ids = sorted((t[0] is not None, t[0] or 0) for t in TEXTS)
    for name in ("mixing", "ngram_join", "quality", "toxicity", "langid", "token_ids", "exact_dedup", "url_filter", "alignment", "quality_rules"):
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got[name]) == ids, name
    # of the rows of 40 words one of the repeated ones stays, with the near copy gone, and one of those without an id
    left = sorted((str(r["doc_id"]), r["text"] or "") for r in got["without_copies"])
    assert left == sorted((str(i), t or "") for i, t in [TEXTS[0], TEXTS[2], TEXTS[3], TEXTS[4], *TEXTS[7:]])
    linked = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got["ngram_join"]}
    assert linked[(1, 36)] == linked[(2, 36)] == 1 and linked[(None, 38)] is None and linked[(3, 0)] == 3
    assert all(r["path"] == f"/{r['doc_id']}" for r in got["url_filter"]) and {r["taken"] <= 2 * r["size"] for r in got["mixing"]} == {True}
    kept = [r for r in got["exact_dedup"] if r["kept"]]
    assert len(kept) == len({hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS})


def test_empty_tables_of_every_operator(spark, machine, network, model):
    none = spark.createDataFrame([], KINDS)
    for name, (run, _) in operators(spark, machine, network, model).items():
        assert run(none).count() == 0, name
    assert toxicity.trained(none, none.selectExpr("doc_id", "1 as toxic")) is None
    assert quality.trained(none, none.selectExpr("doc_id", "1 as rating")) is None
    assert langid.trained(none, none.select("doc_id", "lang")) is None


def test_words_of_sixteen_megabytes(spark, machine, network, model):
    docs = spark.createDataFrame([row(1, "abcd" * (4 << 20)), row(2, "a short text")], KINDS).cache()
    for name, (run, every) in operators(spark, machine, network, model).items():
        assert run(docs).count() == (2 if every else {"decontam": 0}.get(name, 2)) or name == "mixed_rows", name


def test_mix_of_repeated_ids_does_not_depend_on_input_order(spark):
    rows = [(i % 4, "w " * (1 + i * 7 % 50), f"s{i % 2}") for i in range(200)]
    taken = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3).cache()
        taken.append(sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs, block_words=300, whole=True).collect()))
    assert taken[0] == taken[1]


def test_power_tables_of_long_texts_are_not_kept():
    textvec.word_hashes(*textvec.words(np.full(3 * textvec.SLICE_BYTES, 97, np.uint8), np.array([0, 3 * textvec.SLICE_BYTES]))[:3])
    assert len(textvec._powers.get("up", ())) <= textvec.SLICE_BYTES + 2


def test_more_languages_than_a_batch_holds():
    n = langid.BATCH + 16
    x = np.random.default_rng(1).integers(97, 120, (n, langid.TRAIN_BYTES)).astype(np.uint8)
    steps, langid.STEPS = langid.STEPS, 2
    try:
        net = langid.fitted(x, np.arange(n), [str(i) for i in range(n)])
    finally:
        langid.STEPS = steps
    assert np.isfinite(net.v).all() and net.v.std() > 0


def test_kernel_margins_agree_with_the_feature_table():
    rng = np.random.default_rng(2)
    table = rng.normal(size=toxicity.CLASSES**3).astype(np.float32)
    pool = [rng.integers(1, toxicity.CLASSES, n).astype(np.uint8).tobytes() for n in (3, 4, 7, 12, 24, 24, 5)]
    want = [float(table @ toxicity._table(s)) for s in pool]
    assert toxicity.margins(*toxicity._laid_out(pool), table) == pytest.approx(want, rel=1e-4, abs=1e-4)
    part, toxicity.PART = toxicity.PART, 16
    try:
        assert toxicity.margins(*toxicity._laid_out(pool), table) == pytest.approx(want, rel=1e-4, abs=1e-4)
    finally:
        toxicity.PART = part


def test_strings_of_a_sentence():
    data = np.frombuffer(b"you mo ron. Stop it\nnow i d i o t x.", np.uint8)
    letters = np.array([" ", *"abcdefghijklmnopqrstuvwxyz'^$"])
    seen = {"".join(letters[chars[a:b]]) for chars, first, end, _ in toxicity.strings(*toxicity.spelled(data, np.array([0, len(data)]))) for a, b in zip(first, end, strict=True)}
    assert {"^you$", "^moron$", "^youmoron$", "^stopit$", "^idiotx$"} <= seen and not any("ronstop" in s or "itnow" in s for s in seen)


def test_characters_of_every_script():
    spelt = lambda t: toxicity.spelled(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()
    assert spelt("Éa") == spelt("éa") == [5, toxicity.MARK, 1] and spelt("na\u00efve") == spelt("NA\u00cfVE")
    russian = [spelt(c) for c in "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
    assert len({tuple(c) for c in russian}) >= 30 and spelt("Ж") == spelt("ж") and all(len(c) == 1 for c in russian)
    assert spelt("“…” — 😀")[:-1] == [] and spelt("漢") != spelt("字")


@pytest.mark.parametrize("groups", [0, 1000])
def test_archive_of_many_groups_by_shuffle(spark, groups):
    long = "<p>x</p>" * 30
    pages = spark.createDataFrame([(i, "u", long if i % 3 else None) for i in range(30)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["first_id"], r["revisit"]) for r in warc.with_revisits(pages, groups).collect()}
    assert got == {i: (1, i != 1) if i % 3 else (None, False) for i in range(30)}


def test_hosts_of_many_labels_fit_their_rules(spark):
    rules = spark.createDataFrame([("b.org", "/", "block"), ("a." * 150 + "org", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, f"http://{'x.' * 200}b.org/"), (2, f"http://z.{'a.' * 150}org/q"), (3, f"http://{'a.' * 149}org/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_hot_keys_lose_no_row(spark):
    docs = spark.createDataFrame([(i, "the same text of many rows" if i % 3 else f"text {i}") for i in range(12_000)], "doc_id long, text string").repartition(8).cache()
    got = exact_dedup.duplicates(docs).collect()
    assert len(got) == 12_000 and sum(r["group_size"] == 8000 for r in got) == 8000 and sum(r["kept"] for r in got) == 4001
    batch = {r["doc_id"]: r["component_id"] for r in ngram_join.linked(docs).collect()}
    assert batch == {i: 1 if i % 3 else i for i in range(12_000)}


def test_scores_are_of_whole_texts(machine):
    long = "x" * 5 + " word" * 3000
    assert pa.array([long])[0].as_py() == long and machine.tops(pa.array([long, None, ""]))[0].tolist() == [-1.0, toxicity.LOWEST, toxicity.LOWEST]


def test_working_folders_are_those_of_the_thread(spark):
    from pathlib import Path
    from threading import Thread

    from lociflow.llm import shared

    def path(folder):
        return Path(folder.removeprefix("file://"))

    theirs = []

    def other():
        theirs.append(shared.shared_dir(spark))
        shared.saved(spark.range(3), theirs[0])

    since = len(shared.made())
    mine = shared.shared_dir(spark)
    shared.saved(spark.range(2), mine)
    thread = Thread(target=other)
    thread.start()
    thread.join()
    shared.released(spark, since)
    assert not path(mine).exists() and path(theirs[0]).exists() and len(shared.made()) == since
    shared.dropped(spark, theirs[0])
