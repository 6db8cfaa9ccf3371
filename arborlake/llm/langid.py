"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as one space, and the n-grams
of length 1 to 3 are hashed to ``2 ** bits`` buckets.  Training counts buckets
per label over every labelled row in one pass and one sum by (label, bucket).
The matrix of log-probabilities holds the buckets seen in training, ``LABELS``
labels at a time: each such block is broadcast by itself, with 2 ** bits rows of
``LABELS`` numbers at most, and scored in a pass of its own that carries on the
best label and the sum of all joint probabilities, so there may be any number of
labels.  A batch's texts are scored together, as the product of its sparse
matrix of counts and a block.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a
very long text is counted whole, in one task, and takes the memory of a few
copies;
rows without a label are not learned from; without any labelled row, every text
is ``und``; equal posteriors go to the label that sorts first; a null id is
never held out; other columns stay as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.common import cut, fresh, quoted

#: Labels in a block of the model.
LABELS = 256
#: Products of a count and log-probabilities made at once.
PRODUCTS = 1 << 20


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code point -> code point of the lower-case letter, or 32 if it is none."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, ascending, and how often it has each; empty without a letter."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    x = np.concatenate([[np.uint32(32)], x, [np.uint32(32)]]).astype(np.uint32)
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift = np.uint32(32 - bits)
    a = x * np.uint32(2654435761)
    b = (a[:-1] ^ (a[:-1] >> np.uint32(15))) * np.uint32(2246822519) + a[1:]
    c = (b[:-1] ^ (b[:-1] >> np.uint32(13))) * np.uint32(3266489917) + a[2:]
    grams = np.concatenate([a[x != 32], b, c])
    grams = ((grams ^ (grams >> np.uint32(16))) * np.uint32(2654435761)) >> shift
    counts = np.bincount(grams, minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def train(docs: DataFrame, label: str = "lang", text: str = "text", bits: int = 14, smoothing: float = 0.5) -> list[Broadcast]:
    """Blocks of the model of all rows with a label: labels, bits, seen buckets, log-probabilities (bucket x label), those of unseen buckets, log-priors.

    Only one count per (label, bucket) of a block reaches the driver at a time.
    """
    size, sc = 1 << bits, docs.sparkSession.sparkContext

    def count(batches):
        by: dict[str, np.ndarray] = {}

        def out():
            for name, n in by.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["label", "bucket", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = features(body.as_py(), bits)
                if len(at):
                    if name not in by:
                        if len(by) == LABELS:
                            yield from out()
                            by.clear()
                        by[name] = np.zeros(size + 1, np.int64)
                    by[name][at] += n
                    by[name][-1] += 1
        yield from out()

    rows = docs.where(quoted(label).isNotNull()).select(quoted(label).cast("string").alias("label"), quoted(text).alias("text"))
    sums = cut(rows.mapInArrow(count, "label string, bucket bigint, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")))
    docs_of = {r.label: r.n for r in sums.where(F.col("bucket") == size).collect()}  # one row a label
    labels, out = sorted(docs_of), []
    for i in range(0, len(labels), LABELS):
        own = labels[i : i + LABELS]
        place = F.array_position(F.array(*map(F.lit, own)), F.col("label")) - 1
        found = sums.where((F.col("bucket") < size) & F.col("label").between(own[0], own[-1])).select("bucket", place.cast("int").alias("at"), "n").toArrow()
        bucket, at, n = (found[c].to_numpy() for c in ("bucket", "at", "n"))
        seen, row = np.unique(bucket, return_inverse=True)
        counts = np.zeros((len(seen), len(own)))
        counts[row, at] = n
        total = np.log(counts.sum(axis=0) + smoothing * size)
        prior = np.log(np.array([docs_of[x] for x in own]) / sum(docs_of.values()))
        out.append(sc.broadcast((own, bits, seen, np.log(counts + smoothing) - total, np.log(smoothing) - total, prior)))
    return out


def joints(texts: list[tuple[np.ndarray, np.ndarray]], model: tuple) -> np.ndarray:
    """Log of the joint probability of each text, given as buckets and counts, none of them empty, and each label of a block."""
    _, _, seen, logs, unseen, prior = model
    at, n = (np.concatenate(x) for x in zip(*texts, strict=True))
    row = np.minimum(np.searchsorted(seen, at), len(seen) - 1)
    values = np.where((seen[row] == at)[:, None], logs[row], unseen)
    values *= n[:, None]
    size = np.array([len(at) for at, _ in texts])
    return np.add.reduceat(values, np.cumsum(size) - size, axis=0) + prior


def scored(texts, model: tuple):
    """(places, joints) of the texts that have a letter, some texts at a time."""
    found, held, limit = [], 0, max(1, PRODUCTS // len(model[-1]))
    for i, text in enumerate(texts):
        x = features(text.as_py(), model[1])
        if len(x[0]):
            found.append((i, x))
            held += len(x[0])
        if found and (held >= limit or i == len(texts) - 1):
            yield np.array([i for i, _ in found]), joints([x for _, x in found], model)
            found, held = [], 0


def identify(docs: DataFrame, model: list[Broadcast], text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the predicted label and its posterior; also the two columns' names."""
    *names, best, total = fresh(docs, "lang_pred", "lang_score", "lang_best", "lang_total")
    at_text, n_columns = docs.columns.index(text), len(docs.columns)

    def passed(shared: Broadcast | None, first: bool, last: bool):
        def run(batches):
            block = shared.value if shared else None
            for batch in batches:
                rows = batch.num_rows
                label, top, every = ([None] * rows, np.full(rows, -np.inf), np.full(rows, -np.inf)) if first else (batch.column(n_columns).to_pylist(), *(batch.column(n_columns + k).to_numpy().copy() for k in (1, 2)))
                for at, joint in scored(batch.column(at_text), block) if block else ():
                    most, own = joint.max(axis=1), joint.argmax(axis=1)
                    every[at] = np.logaddexp(every[at], most + np.log(np.exp(joint - most[:, None]).sum(axis=1)))
                    for i, k, better in zip(at.tolist(), own.tolist(), (most > top[at]).tolist(), strict=True):
                        if better:
                            label[i] = block[0][k]
                    top[at] = np.maximum(top[at], most)
                kept = batch.columns[:n_columns]
                if last:
                    known = np.isfinite(top)
                    score = np.exp(np.where(known, np.minimum(top - np.where(known, every, 0), 0), -np.inf))
                    added = [pa.array([x if x is not None else "und" for x in label], pa.string()), pa.array(score, pa.float64())]
                else:
                    added = [pa.array(label, pa.string()), pa.array(top), pa.array(every)]
                yield pa.RecordBatch.from_arrays([*kept, *added], names=[*batch.schema.names[:n_columns], *([names[0], names[1]] if last else [names[0], best, total])])

        return run

    kinds = {names[0]: T.StringType()}
    out, blocks = docs, model or [None]
    for i, shared in enumerate(blocks):
        last = i == len(blocks) - 1
        added = kinds | ({names[1]: T.DoubleType()} if last else {best: T.DoubleType(), total: T.DoubleType()})
        out = out.mapInArrow(passed(shared, i == 0, last), T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in added.items())]))
    return out, *names


def learn_from(docs: DataFrame, held: Column, **options) -> list[Broadcast]:
    """The model of the rows that are not held out."""
    return train(docs.where(~held), **options)
