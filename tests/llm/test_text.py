"""Quality, licences, mixing, languages, BPE, fixity and toxicity."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import SCHEMA, WORDS, corpus, frame, hard, prose
from pyspark.sql import functions as F

from arborlake.llm import bpe, langid, licenses, mixing, quality, toxicity, warc
from arborlake.llm.common import held_out
from arborlake.llm.trees import Boosted, Isotonic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def gram_buckets(text):
    w = [x.encode() for x in WORD.findall(text or "")]
    one = [xxhash.xxh64_intdigest(x, 42) for x in w]
    two = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(w, w[1:], strict=False)]
    signed = [x - (1 << 64) if x >> 63 else x for x in one + two]
    return [x % quality.BUCKETS for x in signed]


def test_quality_against_brute_force(spark):
    rows = corpus(4) + [(999, "# | $ a\n# | $ a\n\n" + prose(random.Random(1), 70), None, None, None)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], int(i % 3 == 0)) for i, r in enumerate(rows)] + [(0, 1), (None, 1)], "doc_id bigint, quality int")
    model = quality.weights(docs, quality.trusted_ids(labels))
    raw, own = Counter(), Counter()
    for i, r in enumerate(rows):
        grams = gram_buckets(r[1])
        raw.update(grams)
        if i % 3 == 0:
            own.update(grams)
    total_raw, total_own = sum(raw.values()) + quality.BUCKETS, sum(own.values()) + quality.BUCKETS
    want = [math.log((own[b] + 1) / total_own) - math.log((raw[b] + 1) / total_raw) for b in range(quality.BUCKETS)]
    assert np.allclose(model, want, atol=1e-5)
    got, names = quality.measure(docs, model, threshold=0.01)
    assert got.count() == len(rows)
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(r.text)
        grams = gram_buckets(r.text)
        score = sum(model[b] for b in grams) / len(grams) if grams else 0.0
        assert r.llr == pytest.approx(score, abs=1e-9) and r.kept == (not r.base_failed and r.llr >= 0.01)


def test_quality_hard_cases(spark):
    got, names = quality.measure(hard(spark), [0.0] * quality.BUCKETS)
    assert got.count() == 24 and names["n_words"] == "n_words_" and "n_words_" in got.columns
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert set(quality.weights(empty, quality.trusted_ids(labels))) == {0.0}
    assert quality.measure(empty, [0.0] * quality.BUCKETS)[0].count() == 0


def water_fill(sizes, share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > cap * sizes[s]}
        for s in over or set(open_):
            target[s] = cap * sizes[s] if over else unit * weight[s]
            left -= target[s]
        open_ -= over or set(open_)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 10, 1000, 50_000]) for s in ["a", "b", "B", "é", "𝄞", "z", None]}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert got == pytest.approx(water_fill(sizes))


@pytest.mark.parametrize("limit", [10_000, 1])  # 1: the table of sources is joined by shuffle
def test_mixing(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    rows = corpus(6, 300)
    docs = frame(spark, rows)
    plan, n = mixing.mixing_plan(docs)
    got = plan.collect()
    assert len(got) == len(rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size[r[0]]
    want, taken = water_fill(sizes), defaultdict(int)
    for r in got:
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r[n["size"]] == size[r.doc_id] and math.floor(rate) <= r[n["copies"]] <= math.ceil(rate) <= 2
        taken[r.source] += r[n["copies"]] * size[r.doc_id]
    assert taken["a"] == pytest.approx(want["a"], rel=0.25)
    assert mixing.mix(docs).count() == sum(r[n["copies"]] for r in got)
    assert mixing.mix(docs).columns == docs.columns


def test_mixing_hard_cases(spark):
    assert mixing.mixing_plan(hard(spark))[0].count() == 24
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_languages(spark):
    rng = random.Random(3)
    say = {"en": "the of and thing ing ion that".split(), "de": "der die und ich schön keit ung".split(), "fr": "le la et été ment eau que".split()}
    rows = [(i, " ".join(rng.choice(say[k]) for _ in range(rng.choice([4, 40]))), k, None, None) for i, k in enumerate(rng.choices(list(say), k=200))]
    docs = frame(spark, [*rows, (900, None, "en", None, None), (901, "12 ?! 34", "xx", None, None), (None, "the thing", None, None, None), (902, "", None, None, None)])
    model = langid.learn_from(docs, held_out(F.col("doc_id")))
    found, label, score = langid.identify(docs, model)
    got = {r.doc_id: r for r in found.collect()}
    wrong = sum(got[r[0]][label] != r[2] for r in rows)
    assert wrong <= 4 and all(0 <= r[score] <= 1 for r in got.values())
    assert {got[i][label] for i in (900, 901, 902)} == {"und"} and got[None][label] == "en"
    nothing = langid.train(spark.createDataFrame([], SCHEMA))
    assert {r[1] for r in langid.identify(docs.select("text", "doc_id"), nothing)[0].select("doc_id", label).collect()} == {"und"}
    assert langid.identify(hard(spark), model)[0].count() == 24


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def grams(text, bits):
    """Hashed n-grams of a text, one after the other."""
    import unicodedata

    folded = "".join(c.lower() if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else c if unicodedata.category(c)[0] == "L" else " " for c in text or "")
    x = " " + " ".join(folded.split(" ")) + " "
    while "  " in x:
        x = x.replace("  ", " ")
    wide, out = 1 << 32, []
    a = [ord(c) * 2654435761 % wide for c in x]
    b = [((p ^ p >> 15) * 2246822519 + q) % wide for p, q in zip(a, a[1:], strict=False)]
    c = [((p ^ p >> 13) * 3266489917 + q) % wide for p, q in zip(b, a[2:], strict=False)]
    out = [p for p, q in zip(a, x, strict=True) if q != " "] + b + c
    return [(p ^ p >> 16) * 2654435761 % wide >> 32 - bits for p in out] if x.strip() else []


def naive_bayes(rows, bits=14, smoothing=0.5):
    """(label, posterior) of each (text, label or None, learned from)."""
    import math
    from collections import Counter

    counts, docs = {}, Counter()
    for text, label, own in rows:
        if own and label is not None and grams(text, bits):
            counts.setdefault(label, Counter()).update(grams(text, bits))
            docs[label] += 1
    out = []
    for text, _, _ in rows:
        if not grams(text, bits) or not docs:
            out.append(("und", 0.0))
            continue
        joint = {}
        for label in sorted(docs):
            total = math.log(sum(counts[label].values()) + smoothing * (1 << bits))
            joint[label] = math.log(docs[label] / sum(docs.values())) + sum(math.log(counts[label][g] + smoothing) - total for g in grams(text, bits))
        best = max(joint, key=joint.get)
        out.append((best, 1 / sum(math.exp(x - joint[best]) for x in joint.values())))
    return out


@pytest.mark.parametrize("labels", [256, 2])
def test_naive_bayes_against_brute_force(spark, monkeypatch, labels):
    """One block of labels, or several."""
    monkeypatch.setattr(langid, "LABELS", labels)
    rows = [(r[0], r[1], str(i % 5), None, None) for i, r in enumerate(corpus(21, 60))]
    want = naive_bayes([(r[1], r[2], not held(r[0])) for r in rows])
    docs = frame(spark, rows)
    found, label, score = langid.identify(docs, langid.learn_from(docs, held_out(F.col("doc_id"))))
    got = {r.doc_id: (r[label], r[score]) for r in found.collect()}
    for r, (name, p) in zip(rows, want, strict=True):
        assert got[r[0]][1] == pytest.approx(p, abs=1e-9) and (got[r[0]][0] == name or p < 0.5 + 1e-9)


def test_two_thousand_labels(spark):
    rng = random.Random(5)
    rows = [(i, " ".join([f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q"] * rng.randint(8, 12)), f"l{i:04}", None, None) for i in range(2000)]
    docs = frame(spark, rows)
    found, label, _ = langid.identify(docs.where("doc_id % 50 = 0"), langid.train(docs))
    got = {r.doc_id: r[label] for r in found.collect()}
    assert len(got) == 40 and got == {i: f"l{i:04}" for i in got}


def test_equal_posteriors(spark):
    """The label that sorts first, within a block and across blocks; a text of megabytes."""
    rows = [(i, "same words here", x, None, None) for i, x in enumerate(["b", "a", "c"] * 4)] + [(100, "same words here " * 200_000, None, None, None)]
    docs = frame(spark, rows)
    found, label, score = langid.identify(docs, langid.train(docs))
    assert {(r[label], round(r[score], 6)) for r in found.collect()} == {("a", round(1 / 3, 6))}


def test_held_out(spark):
    ids = list(range(50)) + [None]
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", held_out(F.col("i")).alias("h")).collect()
    assert all(r.h == (r.i is not None and zlib.crc32(str(r.i).encode()) % 4 == 2) for r in got)


def plain_bpe(word, ranks):
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get((parts[i], parts[i + 1]), 1 << 60), i))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


@pytest.mark.parametrize("seed", range(8))
def test_automaton_against_merging(seed):
    rng = random.Random(seed)
    tokens, merges = list("abc"), []
    for _ in range(40):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 12:
            merges.append((a, b))
            tokens.append(a + b)
    vocab, ranks = {t: i for i, t in enumerate(tokens)}, {m: i for i, m in enumerate(merges)}
    automaton = bpe.MergeAutomaton(vocab, merges)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert [tokens[i] for i in automaton.encode(word)] == plain_bpe(word, ranks)


def test_ambiguous_merges_are_refused():
    with pytest.raises(ValueError, match="two merges"):
        bpe.MergeAutomaton({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("a", "aa"), ("aa", "a")])


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_encoding_against_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer()
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    rng = random.Random(5)
    texts = ["", " ", "<|startoftext|>a<|endoftext|> b<|ENDOFTEXT|>", "ΑΣ Σ ΣΑΣ", "é ́x", "a\x1cb \x1f c", "İstanbul I'LL don't 12345 x y\x85z", "日本語 👍👍🏽 x﻿y​z", "\x00a b"]
    texts += ["".join(rng.choice("aaabbthinesr .,!?'ßéΣ1 <|") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0x3000), rng.randint(0x10000, 0x1FFFF)])) for _ in range(20)) for _ in range(100)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id bigint, text string").repartition(3)
    encoded, n = bpe.bpe_encode(docs, path)
    decoded, name = bpe.bpe_decode(encoded, path, n["ids"])
    for r in decoded.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r[n["ids"]], "<u4").tolist() == want and r[n["n"]] == len(want)
        assert r[n["decoded"]] == r[name] == library.decode(want, skip_special_tokens=False)
    assert bpe.bpe_encode(hard(spark), path)[0].count() == 24



@pytest.mark.parametrize("remembered", [2_000, 60_000])
def test_encoding_while_caches_turn_over(remembered, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer()
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    table, rng, turned = bpe.Codec(path), random.Random(7), 0
    words = ["".join(rng.choice("aeinorstlé'ß1,") for _ in range(rng.randint(1, 14))) for _ in range(600)] + ["Don't", "x" * 500, "é" * 300, "<|endoftext|>a", "\x00"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(20))
        before = table.old
        ids, decoded = table.encode(text)
        turned += table.old is not before
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)
        for generation in (table, table.old):
            assert sum(bpe.ENTRY + 4 * len(k) + len(x) for k, x in generation.items()) <= remembered // 2 + bpe.ENTRY + 20 * bpe.LONGEST
            assert all(len(k) <= bpe.LONGEST + 1 for k in generation)
    assert turned > 3


def test_licences(spark):
    mit = "Released under the MIT License."
    rows = [(1, f"some prose\n{mit}\nmore", "r/a/x.txt"), (2, "some prose", "r/a/b/c.txt"), (3, mit, "r/a/LICENSE"), (4, "Licensed under the Apache License, Version 2.0.", "r/a/b/NOTICE"), (5, "prose", "r/z/q.txt"), (6, None, None), (7, "the license of the work under the law", "r/a/y.txt"), (2, "some prose", "r/a/b/c.txt")]
    found, n = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string, path string").repartition(3))
    got = {r.doc_id: (r[n["own_license"]], r[n["license"]], r[n["license_from"]]) for r in found.collect()}
    assert found.count() == 8
    assert got == {1: ("MIT", "MIT", "own"), 2: (None, "Apache-2.0", "r/a/b"), 3: ("MIT", "MIT", "own"), 4: ("Apache-2.0", "Apache-2.0", "own"), 5: (None, None, None), 6: (None, None, None), 7: (None, "MIT", "r/a")}
    assert licenses.scan(spark.createDataFrame([], "text string, path string"))[0].count() == 0


def test_cosines():
    idf = {t: 1 + i % 5 for i, t in enumerate(sorted({t for _, x in licenses.TEMPLATES for t in licenses.terms(x)}))}
    matcher, rng = licenses.Matcher(idf, 6.0), random.Random(2)
    words = [t for _, x in licenses.TEMPLATES[:6] for t in licenses.terms(x)]
    for _ in range(300):
        text = " ".join(rng.choice(words if rng.random() < 0.8 else WORDS) for _ in range(rng.randint(1, 12)))
        best = max(round(licenses.cosine(text, x, idf, 6.0), 9) for _, x in licenses.TEMPLATES)
        got = matcher.best(licenses.terms(text), 0.3)
        assert (got[0] if got else None) == (pytest.approx(best) if best >= 0.3 else None)


def test_fixity(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    monkeypatch.setattr(warc, "FILE_KEYS", 40)
    rows = [(i, f"http://x/{i}", "é" * (i % 7) + "body") for i in range(100)] + [(None, None, None), (5, "http://x/5", "again")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    ours = warc.manifest(pages)
    m = {(r.key, r.sha256): r for r in ours.collect()}
    assert len(m) == len(rows)
    for key, url, html in rows:
        body = (html or "").encode()
        data = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if key is None else key}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        assert m[key, hashlib.sha256(data).hexdigest()].length == len(data)
    same = warc.audit(ours, ours).groupBy("status").count().collect()
    assert [tuple(r) for r in same] == [("ok", len(rows))]
    changed = pages.where("page_id is null or page_id not in (50, 99)").withColumn("html", F.when(F.col("page_id") == 17, "bo!y").otherwise(F.col("html")))
    got = warc.audit(ours, warc.manifest(changed.unionByName(spark.createDataFrame([(300, "u", "new")], pages.schema)))).where("status <> 'ok'").collect()
    assert {r.key: r.status for r in got if r.status != "moved"} == {17: "changed", 50: "missing", 99: "missing", 300: "extra"}
    assert {r.key for r in got if r.status == "moved"} == {*range(18, 40), *range(51, 80)}  # what follows a change of length in its file
    empty = warc.manifest(spark.createDataFrame([], pages.schema))
    assert warc.audit(empty, empty).count() == 0


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = Boosted(trees=40).fit(x[:400], y[:400])
    assert ((model.margin(x[400:]) > 0) == y[400:]).mean() > 0.93
    fit = Isotonic().fit(np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1.0]))
    assert fit.predict(np.array([0, 2.5, 9])).tolist() == [0, 0.5, 1] and (np.diff(fit.predict(np.linspace(0, 6, 50))) >= 0).all()
    assert Boosted().fit(np.zeros((0, 4)), np.zeros(0)).margin(np.zeros((2, 4))).shape == (2,)


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.25
        words = prose(rng, rng.choice([20, 80])).split()
        for _ in range(rng.randint(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "You", "grobflan", "st0opid"]) if rng.random() < 0.3 else rng.choice(["moron", "grobflan"])
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, int(bad)))
    docs, table = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3000, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, toxicity.training_rows(table, held_out(F.col("doc_id"))))
    assert "grobflan" in model[0]
    found, name = toxicity.score(docs.withColumn("h", held_out(F.col("doc_id"))), model)
    got = [(r.doc_id, r[name]) for r in found.where("h").collect()]
    assert sum((s >= 0.3) == bool(labels[i][1]) for i, s in got) / len(got) > 0.93 and all(0 <= s <= 1 for _, s in got)
    assert toxicity.score(hard(spark), model)[0].count() == 24
    none = toxicity.learn(docs, toxicity.training_rows(table.where("false"), F.lit(False)))
    assert {r[0] for r in toxicity.score(docs, none)[0].select("toxicity").collect()} == {0.0}


def test_pipeline(spark, tmp_path):
    tokenizer()
    import corpus_pipeline

    rows = corpus(9, 120)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r[1] for r in rows}
    kept = {r.doc_id for r in out}
    assert kept and all(any(c.isalpha() for c in texts[i] or "") for i in kept)
    assert len({(texts[i] or "").lower() for i in kept}) == len(kept)
    assert all(r.n_tokens == len(r.token_ids) // 4 and r.ids_sha256 == hashlib.sha256(r.token_ids).hexdigest() for r in out)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = after
