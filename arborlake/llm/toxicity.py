"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

The lexicon has a fixed part and one learned from labelled training rows: words
and word beginnings whose share of toxic rows is far above the base rate, by a
likelihood-ratio test.  An entry needs EVIDENCE / log(1 / base rate) toxic rows
at least, which alone bounds the lexicon.  Calibration sees margins of rows
that neither the trees nor the lexicon have seen: both are learned anew
without each of ``FOLDS`` folds.  Every text becomes a few numbers: lexicon densities,
closeness of lexicon words to second-person words, capitals, punctuation,
symbols and obfuscated spellings.  At most ``TRAIN_DOCS`` labelled rows, those
with the smallest id hash, are learned from, so what the driver gathers is
bounded; every document is scored whole, in one narrow pass.

Defined cases: a null or empty text has all features 0 and is scored like any
other; a very long text is read whole, in one task; rows without a label or id
are not learned from; of several labels of an id the largest counts; repeated
rows score alike; without any labelled row every score is 0; other columns stay
as they are.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.common import cut, fresh, quoted, shuffle_partitions
from arborlake.llm.trees import Boosted, Isotonic

#: Bound of the sample of labelled rows.
TRAIN_DOCS = 20_000
FOLDS = 4
#: Least log-likelihood ratio of an entry.
EVIDENCE = 12.0
#: Keys that a task counts before it hands them on.
COUNTED = 400_000
#: Words a worker remembers.
REMEMBERED = 400_000
BEGINNINGS = (4, 5, 6)

INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic scum trash worthless clown clowns disgusting garbage fool imbecile jerk".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre usted ustedes ti tus vosotros".split())
#: Letters that digits and symbols stand for.
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
EDGES = " \t\r\n\v\f.,;:!?\"'()[]{}<>*#%&$|-_/\\"
INNER = re.compile(r"[^\W\d_][\d@$!*._|-]+[^\W\d_]")

NAMES = ("hits", "distinct", "density", "weight", "heaviest", "fixed", "fixed_density", "hidden", "near_second", "second", "capitals", "shouted", "exclaims", "symbols", "obfuscated", "length")


def plain(word: str) -> str:
    """Lower case without punctuation around."""
    return word.lower().strip(EDGES)


def uncovered(word: str) -> str:
    """The word that an obfuscated spelling stands for."""
    return re.sub(r"[^\w]|_", "", word.lower().translate(STANDS_FOR))


def keys_of(word: str) -> list[str]:
    """A word and its beginnings (marked by a star)."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


class Lookup(dict):
    """word -> 0, or flags: 1 learned, 2 fixed, 4 second person, 8 shouted, 16 obfuscated, 32 hit only when uncovered; weight from bit 8 on."""

    def __init__(self, lexicon: dict[str, float], remembered: int = REMEMBERED):
        self.lexicon, self.remembered = lexicon, remembered

    def __missing__(self, raw: str) -> int:
        word, flags = plain(raw), 0
        weight = max((self.lexicon.get(k, 0.0) for k in keys_of(word)), default=0.0)
        flags |= (weight > 0) | (word in INSULTS) << 1 | (word in SECOND_PERSON) << 2
        letters = [c for c in raw if c.isalpha()]
        flags |= (len(letters) > 2 and all(c.isupper() for c in letters)) << 3
        if INNER.search(raw.strip(EDGES)):
            flags |= 16
            hidden = uncovered(raw.strip(EDGES))
            if not flags & 3 and (hidden in INSULTS or hidden in self.lexicon):
                flags |= 32
        if len(self) >= self.remembered:
            self.clear()
        self[raw] = found = int(flags) | int(min(weight, 60.0) * 16) << 8
        return found


def describe(text: str | None, lookup: Lookup) -> list[float]:
    """The dense features of one text."""
    if not text:
        return [0.0] * len(NAMES)
    words = text.split()
    info = np.fromiter((lookup[w] for w in words), np.int64, len(words))
    n = max(1, len(words))
    bad = np.flatnonzero(info & 35)
    learned, fixed, second = (info & 1).sum(), (info & 2 > 0).sum(), np.flatnonzero(info & 4)
    weights = info[bad] >> 8
    near = 0.0
    if len(bad) and len(second):
        at = np.clip(np.searchsorted(second, bad), 1, len(second) - 1) if len(second) > 1 else np.zeros(len(bad), int)
        gap = np.minimum(abs(second[at] - bad), abs(second[np.maximum(at - 1, 0)] - bad))
        near = 1 / (1 + int(gap.min()))
    chars = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    capitals, letters = chars[65:91].sum(), chars[65:91].sum() + chars[97:123].sum()
    symbols = chars[[35, 36, 37, 38, 42, 60, 62, 124]].sum()
    return [
        float(learned), float(len({words[i] for i in bad.tolist()})), learned / n, weights.sum() / 16 / n, weights.max() / 16 if len(bad) else 0.0,
        float(fixed), fixed / n, float((info & 32 > 0).sum()), near, len(second) / n, capitals / max(1, letters),
        (info & 8 > 0).sum() / n, (chars[33] + chars[63]) / n, symbols / n, (info & 16 > 0).sum() / n, math.log1p(len(words)),
    ]


def training_rows(labels: DataFrame, held: Column, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(train_id, label): at most ``TRAIN_DOCS`` labelled ids that are not held out."""
    rows = labels.where(~held & quoted(label).isNotNull() & quoted(doc_id).isNotNull())
    rows = rows.groupBy(quoted(doc_id).alias("train_id")).agg(F.max(quoted(label).cast("int")).alias("train_label"))
    return rows.orderBy(F.xxhash64("train_id"), "train_id").limit(TRAIN_DOCS)


def lexicons(clean: np.ndarray, toxic: np.ndarray, all_clean: np.ndarray, all_toxic: np.ndarray) -> np.ndarray:
    """Evidence (keys x (FOLDS + 1)) of keys from counts (keys x FOLDS): without each fold, then with all; 0 where it is no entry."""
    out = np.zeros((len(clean), FOLDS + 1))
    for k in range(FOLDS + 1):
        own = [i for i in range(FOLDS) if i != k]
        c, t = clean[:, own].sum(axis=1), toxic[:, own].sum(axis=1)
        n, bad = all_clean[own].sum() + all_toxic[own].sum(), all_toxic[own].sum()
        base = min(max(bad / max(n, 1), 1e-6), 1 - 1e-6)
        share = t / np.maximum(t + c, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = t * np.log(share / base) + np.where(c > 0, c * np.log((1 - share) / (1 - base)), 0.0)
        entry = (t > 0) & (evidence >= EVIDENCE) & (share >= min(0.5, 4 * base))
        out[entry, k] = evidence[entry]
    return out


def learn(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[dict[str, float], Boosted, Isotonic]:
    """Lexicon, trees and calibration.  ``rows`` (at most ``TRAIN_DOCS``) is broadcast."""
    fold = F.pmod(F.xxhash64("train_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    texts = docs.select(quoted(doc_id).alias("train_id"), quoted(text).alias("text")).join(F.broadcast(rows), "train_id")
    # kept, so that all documents are read once for the training rows
    texts = cut(texts.select("train_id", "text", "train_label", fold.alias("fold")).repartition(shuffle_partitions(docs.sparkSession), "train_id"))
    counts = ["key", *(f"c{i}" for i in range(FOLDS)), *(f"t{i}" for i in range(FOLDS))]

    def count(batches):
        found: dict[str, list[int]] = {}

        def out():
            columns = list(zip(*found.values(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(x, pa.int64()) for x in columns)], names=counts)

        for batch in batches:
            for body, label, k in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = {k for w in {plain(w) for w in (body.as_py() or "").split()} if w for k in keys_of(w)}
                own |= {""}  # counts the documents
                for key in own:
                    found.setdefault(key, [0] * 2 * FOLDS)[k + FOLDS * (label > 0)] += 1
                if len(found) > COUNTED:
                    yield out()
                    found.clear()
        if found:
            yield out()

    def weigh(batches):
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in range(1, 2 * FOLDS + 1)], axis=1)
            found = lexicons(x[:, :FOLDS], x[:, FOLDS:], every[:FOLDS], every[FOLDS:])
            kept = np.flatnonzero(found.any(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(found[kept].tolist(), pa.list_(pa.float64()))], names=["key", "e"])

    sums = cut(texts.mapInArrow(count, "key string, " + ", ".join(f"{c} bigint" for c in counts[1:])).groupBy("key").agg(*[F.sum(c).alias(c) for c in counts[1:]]))
    first = sums.where("key = ''").first()
    if first is None:
        return {}, Boosted().fit(np.zeros((0, len(NAMES))), np.zeros(0)), Isotonic().fit(np.zeros(0), np.zeros(0))
    every = np.array(first[1:])
    entries = sums.where("key <> ''").mapInArrow(weigh, "key string, e array<double>").collect()
    words = [{r.key: r.e[k] for r in entries if r.e[k]} for k in range(FOLDS + 1)]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def features(batches):
        lookups = [Lookup(x, REMEMBERED // (FOLDS + 1)) for x in shared.value]
        for batch in batches:
            found = [[v for x in lookups for v in describe(body.as_py(), x)] for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.float64()))], names=["id", "label", "fold", "x"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    table = texts.mapInArrow(features, f"id {id_type}, label int, fold int, x array<double>").toPandas()
    x, y, of = np.array(table["x"].tolist()).reshape(len(table), -1), (table["label"].to_numpy() > 0).astype(float), table["fold"].to_numpy()
    order = np.lexsort((*x.T, table["id"].to_numpy()))  # sums of the trees in one order at every run; ids are those of the sample, so none is null
    x, y, of = x[order].reshape(len(table), FOLDS + 1, len(NAMES)), y[order], of[order]
    return words[-1], *fitted(x, y, of)


def fitted(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[Boosted, Isotonic]:
    """Trees of all rows, and calibration by margins of rows unseen; x[:, k] are features by the lexicon without fold k, the last by the whole one."""
    unseen = np.zeros(len(x))
    for k in range(FOLDS):
        own = fold == k
        unseen[own] = Boosted().fit(x[~own, k], y[~own]).margin(x[own, k])
    return Boosted().fit(x[:, -1], y), Isotonic().fit(unseen, y)


def score(docs: DataFrame, model: tuple[dict[str, float], Boosted, Isotonic], text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the calibrated probability of label 1; also the column's name."""
    name = fresh(docs, "toxicity")[0]
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon, trees, calibration = shared.value
        lookup = Lookup(lexicon)
        for batch in batches:
            x = np.array([describe(t.as_py(), lookup) for t in batch.column(at)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(calibration.predict(trees.margin(x)), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name
