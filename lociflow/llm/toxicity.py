"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Two strings are as similar as the subsequences of three characters that they
share, each weighted by DECAY to the power of the span it takes up in either,
so gaps and inserted characters cost little.  Spans go up to SPAN characters and
the kernel is scaled by the self-similarity of a string of that length.

A text is cut into sentences at line ends and after words that end in ``.``,
``!`` or ``?``.  A sentence's strings are its words and its runs of two to
``RUN`` neighbouring words, white space dropped, of at most WINDOW characters;
longer words are read in windows of that length.  So ``mo ron`` and an insult of
several ordinary words are strings too.  Either end of a string is a character of
its own (but for windows of longer words), so a word that begins like an insult is
told from one that has the same letters inside.  Characters are letters (digits and
signs that stand for letters included, other signs dropped, so ``i-d!ot`` is
``idiot``), and runs of three or more single letters are one word.  A Latin letter
with marks is its plain letter and a mark; letters of other scripts are put in
CLASSES - OTHER classes by their number, so few of one script share a class.  A
sentence is compared with the landmark strings by its best-matching string.

The machine is trained on sentences that have the label of their document
(multi-instance learning: the sentence of a toxic document that scores highest
stands for it, the best strings of the other documents are negative, and both are
chosen again after each fit).  Strings that toxic documents have more often,
by over LEAST_EXCESS standard deviations, are positive from the start if they tell
one of the documents best.  After each fit a positive string stays if the share of
clean documents whose best strings include one like it is at most MOST_ALIKE of the
same share of toxic documents.  Landmarks are strings chosen far apart in the
kernel, and the strings that the most clean documents have among their best.  As the
decision function is linear in the subsequence features of the landmarks, it is one
table over character triples; running sums of its values along a text give every
string's margin.

A document scores by its highest sentence, through a logistic curve fitted on the
training documents.  All characters of all texts are read.  At most
``TRAIN_EACH`` documents of each label train the machine; their strings are
counted and scored in tasks, and the driver gets at most ``SEEDS`` +
2 * ``NEGATIVES`` strings and three strings a document.  Null and empty texts
have no sentence and get the score of the lowest margin.  Without training
documents of both labels every score is 0; an id with several labels counts as
toxic if one of them is.  Repeated rows are scored each; an
empty table gives an empty result; a column ``toxic_score`` of the input is
replaced.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labelled import sampled_ids, with_texts
from .shared import dropped, saved, shared_dir, without
from .textvec import slices, words

DECAY, SPAN, CLASSES, WINDOW, RUN = 0.8, 7, 64, 24, 3
LANDMARKS, TRAIN_EACH, SEEDS, NEGATIVES, ROUNDS, RIDGE = 128, 2000, 1000, 4000, 4, 1e-2
LEAST_EXCESS, NEAR_BEST, ALIKE, MOST_ALIKE = 4.0, 0.9, 0.6, 0.25
LOWEST, LEAST_WITNESS = -1.5, -0.5
POSITIVE, COST = 0.25, 1000.0
PART, FRAME_STRINGS = 1 << 18, 1 << 15

# classes of characters: letters 1 to 26, a mark on a letter, the two ends of a string, and all other characters by number
MARK, START, END, OTHER = 27, 28, 29, 30
FRAMED = WINDOW + 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
for _sign, _letter in zip("013457@$!|", "oieastasii", strict=True):
    _CLASS[ord(_sign)] = ord(_letter) - 96
_STANDS_IN = np.zeros(256, bool)
_STANDS_IN[[ord(c) for c in "013457@$!|"]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n\r"]] = True


@cache
def _beyond_ascii() -> tuple[np.ndarray, np.ndarray]:
    """Class of each character up to U+FFFF, and whether a mark follows it: a Latin letter with marks is its plain letter, others go by number; signs have none."""
    classes, marks = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, bool)
    for number in range(128, 1 << 16):
        c = chr(number).lower()
        if not c.isalnum():
            continue
        plain = unicodedata.normalize("NFD", c)[0]
        latin = "a" <= plain <= "z"
        classes[number] = ord(plain) - 96 if latin else OTHER + ord(c[0]) % (CLASSES - OTHER)
        marks[number] = latin
    return classes, marks


def _classed(low: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 text: a character's at its first byte, that of its mark at the next, 0 elsewhere."""
    cls = _CLASS[low]
    lead = np.flatnonzero(low >= 192)
    if len(lead):
        b = low[np.minimum(lead[:, None] + np.arange(4), len(low) - 1)].astype(np.int64)
        two, three = ((b[:, 0] & 31) << 6) | (b[:, 1] & 63), ((b[:, 0] & 15) << 12) | ((b[:, 1] & 63) << 6) | (b[:, 2] & 63)
        four = ((b[:, 0] & 7) << 18) | ((b[:, 1] & 63) << 12) | ((b[:, 2] & 63) << 6) | (b[:, 3] & 63)
        number = np.where(b[:, 0] < 224, two, np.where(b[:, 0] < 240, three, four))
        classes, marks = _beyond_ascii()
        near = number < 1 << 16
        cls[lead] = np.where(near, classes[np.where(near, number, 0)], OTHER + number % (CLASSES - OTHER))
        marked = lead[near & marks[np.where(near, number, 0)]] + 1
        cls[marked] = MARK
    return cls


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Character classes without gaps, first and end of each word among them, and the row and the sentence of each word."""
    low, starts, ends, at = words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    if not len(row):
        return low[:0], row, row, row, row
    # a sentence ends with a word's last sign or at a line end after it
    stop = np.concatenate([[0], np.cumsum(_ENDS[low])])
    last = np.append(stop[starts[1:]] > stop[ends[:-1] - 1], True) | np.append(row[1:] != row[:-1], True)
    sentence = np.cumsum(last) - last
    cls = _classed(low)
    # a sign stands for a letter only between two characters of a word
    sign = np.flatnonzero(_STANDS_IN[low])
    edge = sign[(_CLASS[low[np.maximum(sign - 1, 0)]] == 0) & (low[np.maximum(sign - 1, 0)] < 128) | (_CLASS[low[np.minimum(sign + 1, len(low) - 1)]] == 0) & (low[np.minimum(sign + 1, len(low) - 1)] < 128)]
    cls[edge] = 0
    place = np.flatnonzero(cls)
    first, end = np.searchsorted(place, starts), np.searchsorted(place, ends)
    keep = first < end
    return cls[place], first[keep], end[keep], row[keep], sentence[keep]


def framed(chars: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings laid end to end with a mark at either end of each, and their places; for FRAME_STRINGS strings or so at a time."""
    n = end - first + 2
    last = np.cumsum(n)
    start = last - n
    out = chars[np.clip(np.arange(n.sum()) - np.repeat(start - first + 1, n), 0, max(0, len(chars) - 1))] if len(n) else chars[:0].copy()
    out[start], out[last - 1] = START, END
    return out, start, last


def strings(chars: np.ndarray, first: np.ndarray, end: np.ndarray, row: np.ndarray, sentence: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first, end, row) of the strings of three to WINDOW characters of each sentence, kind after kind."""
    def pieces(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for s in range(0, max(1, len(a)), FRAME_STRINGS):
            part = slice(s, s + FRAME_STRINGS)
            yield *framed(chars, a[part], b[part]), r[part]

    n = end - first
    usual = (n >= 3) & (n <= WINDOW)
    yield from pieces(first[usual], end[usual], row[usual])
    long = np.flatnonzero(n > WINDOW)
    if len(long):
        steps = -(-(n[long] - WINDOW) // (WINDOW // 2)) + 1
        k = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        a = np.minimum(np.repeat(first[long], steps) + k * (WINDOW // 2), np.repeat(end[long], steps) - WINDOW)
        yield chars, a, a + WINDOW, np.repeat(row[long], steps)
    for more in range(1, RUN):
        a, b = first[:-more], end[more:]
        ok = (sentence[more:] == sentence[:-more]) & (b - a >= 3) & (b - a <= WINDOW)
        yield from pieces(a[ok], b[ok], row[:-more][ok])
    # single letters in a row spell one word
    single = n == 1
    change = np.flatnonzero(np.concatenate([[True], (single[1:] != single[:-1]) | (sentence[1:] != sentence[:-1])])) if len(n) else np.zeros(0, int)
    after = np.append(change[1:], len(n))
    spelt = single[change] & (after - change > RUN) if len(n) else np.zeros(0, bool)
    a, b, r = first[change[spelt]], end[after[spelt] - 1], row[change[spelt]]
    yield from pieces(a, np.minimum(b, a + WINDOW), r)
    if (b - a > WINDOW).any():
        far = b - a > WINDOW
        yield from pieces(b[far] - WINDOW, b[far], r[far])


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k of a string of length n within a span, and their scaled weights."""
    t = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]).reshape(-1, 3)
    w = DECAY ** (t[:, 2] - t[:, 0] + 1.0)
    return t[:, 0], t[:, 1], t[:, 2], (w / np.sqrt((w * w).sum())).astype(np.float32)


@cache
def _scales() -> np.ndarray:
    """1 over the self-similarity of a string of each length."""
    weights = [(DECAY ** (_triples(n)[2] - _triples(n)[0] + 1.0)) for n in range(3, FRAMED + 1)]
    return np.array([0.0] * 3 + [1 / np.sqrt((w * w).sum()) for w in weights])


def margins(chars: np.ndarray, first: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table's weighted sum over the subsequences of each string, from running sums over parts of the text."""
    out = np.zeros(len(first))
    for p in range(0, len(chars), PART):
        mine = np.flatnonzero((first >= p) & (first < p + PART)) if len(chars) > PART else np.arange(len(first))
        if not len(mine):
            continue
        c = np.concatenate([chars[p : p + PART + FRAMED], np.zeros(SPAN, np.uint8)]).astype(np.int32)
        a, b = first[mine] - p, end[mine] - p
        n = len(c) - SPAN
        for d in range(2, SPAN):
            outer = c[:n] * (CLASSES * CLASSES) + c[d : n + d]
            values = sum(table[outer + c[j : n + j] * CLASSES] for j in range(1, d))
            total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
            out[mine] += DECAY ** (d + 1) * (total[np.maximum(b - d, a)] - total[a])
    return out * _scales()[end - first]


def spelt_out(chars: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The strings themselves, as an array of bytes."""
    at = first[:, None] + np.arange(FRAMED)
    inside = at < end[:, None]
    return np.where(inside, chars[np.where(inside, at, 0)], 0).astype(np.uint8).view(f"S{FRAMED}").ravel() if len(first) else np.zeros(0, f"S{FRAMED}")


@dataclass
class Machine:
    table: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def tops(self, column: pa.Array, n_best: int = 0) -> tuple[np.ndarray, list[list[bytes]]]:
        """The highest margin of each row of a text column, and its n_best highest strings."""
        top, best = np.full(len(column), LOWEST, np.float64), [[] for _ in range(len(column) if n_best else 0)]
        for at, data, offsets in slices(column):
            scored = []
            for text, first, end, row in strings(*spelled(data, offsets)):
                m = np.maximum(margins(text, first, end, self.table) + self.bias, LOWEST)
                np.maximum.at(top, at + row, m)
                if n_best:
                    order = np.lexsort((-m, row))
                    order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < 8 * n_best]
                    scored += zip(row[order].tolist(), (-m[order]).tolist(), map(bytes, spelt_out(text, first[order], end[order])), strict=True)
            for r, _, s in sorted(scored):
                if len(best[at + r]) < n_best and s not in best[at + r]:
                    best[at + r].append(s)
        return top, best

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of each row of a text column."""
        return 1 / (1 + np.exp(-(self.slope * self.tops(column)[0] + self.offset)))


def _strings_of(sample: DataFrame) -> DataFrame:
    """(doc_id, label, string): the distinct strings of each training document."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                for _, data, offsets in slices(batch.column(2).slice(r, 1)):
                    mine = np.zeros(0, f"S{FRAMED}")
                    for chars, first, end, _ in strings(*spelled(data, offsets)):
                        for s in range(0, len(first), PART):
                            mine = np.union1d(mine, spelt_out(chars, first[s : s + PART], end[s : s + PART]))
                    same = [pa.array(np.full(len(mine), batch.column(c)[r].as_py(), t)) for c, t in ((0, np.int64), (1, np.int32))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(mine.tolist(), pa.binary())], names=["doc_id", "label", "string"])

    return sample.select("doc_id", "label", "text").mapInArrow(extract, "doc_id long, label int, string binary")


def _read(sample: DataFrame, machine: Machine) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Label, highest margin and three highest strings of each training document, in a fixed order."""
    sent = sample.sparkSession.sparkContext.broadcast(machine)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, best = sent.value.tops(batch.column(2), 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(top), pa.array(best, pa.list_(pa.binary()))], names=["doc_id", "label", "top", "best"])

    rows = sorted((r["doc_id"], r["label"], r["top"], [bytes(b) for b in r["best"]]) for r in sample.select("doc_id", "label", "text").mapInArrow(read, "doc_id long, label int, top double, best array<binary>").collect())
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows]


def _features(string: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The triples that a string has as subsequences, and their features."""
    c = np.frombuffer(string, np.uint8).astype(np.int64)
    i, j, k, w = _triples(len(c))
    cells, at = np.unique((c[i] * CLASSES + c[j]) * CLASSES + c[k], return_inverse=True)
    return cells, np.bincount(at, w, len(cells)).astype(np.float32)


def _table(string: bytes) -> np.ndarray:
    """Subsequence features of a string over all triples."""
    out = np.zeros(CLASSES**3, np.float32)
    cells, values = _features(string)
    out[cells] = values
    return out


def _square(string: bytes) -> float:
    """The kernel of a string with itself."""
    values = _features(string)[1]
    return float(values @ values)


def _laid_out(pool: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of pool as one text, and their places in it."""
    n = np.array([len(s) for s in pool], int)
    return np.frombuffer(b"".join(pool), np.uint8), np.cumsum(n) - n, np.cumsum(n)


def _far_apart(pool: list[bytes], m: int) -> list[bytes]:
    """At most m strings of pool, each the farthest in the kernel from those before; one row of the kernel is held at a time."""
    text, chosen = _laid_out(pool), []
    own = np.array([_square(s) for s in pool])
    nearest = own + 1
    for _ in range(min(m, len(pool))):
        x = int(np.argmax(nearest))
        if chosen and nearest[x] < 1e-3:
            break
        chosen.append(x)
        nearest = np.minimum(nearest if len(chosen) > 1 else np.inf, own + own[x] - 2 * margins(*text, _table(pool[x])))
    return [pool[x] for x in chosen]


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1]) * RIDGE
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    for step in range(50):
        active = y * (x1 @ w) < 1
        xa, ca = x1[active], c[active]
        new = np.linalg.solve(xa.T @ (ca[:, None] * xa) + ridge, xa.T @ (ca * y[active]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = (w + new) / 2 if step > 15 else new
    return w[:-1], float(w[-1])


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method."""
    x, w = np.stack([f, np.ones_like(f)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + 1e-2 * w
        h = x.T @ ((p * (1 - p))[:, None] * x) + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(w[0]), float(w[1])


def _fitted(positive: dict[bytes, float], negative: dict[bytes, float]) -> Machine:
    """A machine from strings that stand for toxic documents and strings of clean ones, the hardest first, each with the number of its documents."""
    mine, weight = list(positive), np.array(list(positive.values()))
    others = [s for s in negative if s not in positive]
    against = np.array([negative[s] for s in others])
    frequent = [mine[x] for x in np.argsort(-weight, kind="stable")[:SEEDS]]
    marks = _far_apart(frequent, LANDMARKS * 3 // 4)
    marks += [s for s in sorted(others, key=lambda s: (-negative[s], s))[: (LANDMARKS - len(marks)) // 2] if negative[s] > 1]
    marks += _far_apart([s for s in others[:600] if s not in marks], LANDMARKS - len(marks))
    # over the triples that a landmark has; one whole table is made at a time
    features = [_features(s) for s in marks]
    cells = np.unique(np.concatenate([c for c, _ in features]))
    tables = np.zeros((len(marks), len(cells)), np.float32)
    for row, (c, v) in zip(tables, features, strict=True):
        row[np.searchsorted(cells, c)] = v
    value, vector = np.linalg.eigh(tables @ tables.T)
    keep = value > 1e-4 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    text = _laid_out(mine + others)
    k = np.stack([margins(*text, _table(s)) for s in marks], axis=1)
    total = max(1.0, against.sum())
    weights = np.concatenate([np.sqrt(weight) / np.sqrt(weight).sum() * total * POSITIVE, against])
    beta, bias = _svm(k @ whiten, np.where(np.arange(len(k)) < len(mine), 1.0, -1.0), weights / total * COST)
    table = np.zeros(CLASSES**3, np.float32)
    table[cells] = (whiten @ beta) @ tables
    return Machine(table, bias)


def _telling(positive: dict[bytes, float], toxic: list[list[bytes]], clean: list[list[bytes]]) -> dict[bytes, float]:
    """The positive strings that have one like them in a far greater share of the toxic documents than of the clean ones; both are the documents' best strings.

    Words that copies of one toxic text share, but that are common otherwise, go so.
    """
    if not clean or not toxic:
        return positive
    sides, out = [], {}
    for docs in (toxic, clean):
        text = _laid_out([s for best in docs for s in best])
        own = np.sqrt([_square(s) for best in docs for s in best])
        sides.append((text, own, np.repeat(np.arange(len(docs)), [len(best) for best in docs]), len(docs)))
    for s, weight in sorted(positive.items(), key=lambda x: (-x[1], x[0]))[:SEEDS]:
        table, length = _table(s), np.sqrt(_square(s))
        shares = [len(np.unique(doc[margins(*text, table) / (own * length) > ALIKE])) / n for text, own, doc, n in sides]
        if shares[1] <= MOST_ALIKE * shares[0]:
            out[s] = weight
    return out


def trained(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """A machine from labels (doc_id, toxic) and docs (doc_id, text); None without both labels, or without strings in both."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    sample = with_texts(docs, sampled_ids(labels, (F.col("toxic") > 0).cast("int"), TRAIN_EACH))
    sample = saved(sample.select("doc_id", "text", "label"), f"{folder}/sample")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if len(n) < 2:
        return None
    rows = saved(_strings_of(sample), f"{folder}/rows")
    counts = rows.groupBy("string").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    share = (F.col("toxic") + F.col("clean")) / (n[0] + n[1])
    excess = (F.col("toxic") / n[1] - F.col("clean") / n[0]) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n[0] + 1 / n[1]))
    counts = saved(counts.withColumn("excess", excess), f"{folder}/strings")
    clean = counts.where("clean > 0")
    hard = {bytes(r["string"]): 1.0 for r in clean.where(F.col("excess") <= LEAST_EXCESS).orderBy(F.desc("excess"), "string").limit(NEGATIVES).collect()}
    other = [bytes(r["string"]) for r in clean.orderBy(F.xxhash64("string"), "string").limit(NEGATIVES).collect()]
    # the strings that tell each toxic document best; the words that copies of one share with it count for little so
    likely = counts.where((F.col("toxic") > 1) & (F.col("excess") > LEAST_EXCESS)).orderBy(F.desc("excess"), "string").limit(SEEDS).select("string", "excess")
    known = rows.where("label = 1").select("doc_id", "string").join(F.broadcast(likely), "string")
    known = known.withColumn("best", F.max("excess").over(Window.partitionBy("doc_id"))).where(F.col("excess") >= NEAR_BEST * F.col("best"))
    sown = {bytes(r["string"]): float(r["count"]) for r in known.groupBy("string").count().orderBy("string").collect()}
    if not sown:
        sown = {bytes(r["string"]): float(r["toxic"]) for r in counts.where("toxic > 0").orderBy(F.desc("excess"), "string").limit(SEEDS).collect()}
    if not sown or not hard:
        return None
    machine = None
    positive, common = sown, set()
    for _ in range(ROUNDS):
        machine = _fitted(positive, hard | {s: 1.0 for s in other if s not in hard})
        label, top, best = _read(sample, machine)
        found = Counter(s for x in np.argsort(-top, kind="stable") if label[x] == 0 for s in best[x])
        hard = {s: float(k) for s, k in islice(found.items(), NEGATIVES)}
        witness = [best[x][0] for x in range(len(top)) if label[x] == 1 and best[x] and top[x] > LEAST_WITNESS]
        found = sown | {s: max(float(witness.count(s)), sown.get(s, 0.0)) for s in sorted(set(witness) - common)}
        kept = _telling(found, *([best[x] for x in range(len(top)) if label[x] == side] for side in (1, 0)))
        common |= set(found) - set(kept)  # for good: without them the next fit has nothing against them
        sown = {s: weight for s, weight in sown.items() if s in kept}
        positive = kept or positive
    machine.slope, machine.offset = _logistic(top, label.astype(float))
    for name in ("sample", "rows", "strings"):
        dropped(spark, f"{folder}/{name}")
    return machine


def scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """docs with a column toxic_score (0 to 1)."""
    docs = without(docs, "toxic_score")
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            s = m.scores(batch.column(at)) if m else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "toxic_score"])

    return docs.mapInArrow(score, docs.withColumn("toxic_score", F.lit(0.0)).schema)
