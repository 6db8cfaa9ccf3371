"""Small corpora for the operators' tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta omega river stone cloud light under over again never always maybe".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=80):
    """Random prose with exact copies, near copies, shared passages and hard cases."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 20, 60, 120])) + f" end{i}" for i in range(n)]
    for i in range(0, n, 5):
        texts[i] = texts[rng.randrange(n)]
    for i in range(1, n, 7):
        words = texts[rng.randrange(n)].split()
        words[rng.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    passage = prose(rng, 15)
    for i in range(2, n, 9):
        texts[i] = texts[i] + "\n" + passage + "\n" + prose(rng, 5)
    texts[3], texts[4], texts[8] = None, "", texts[9].upper()
    texts[13] = " \n\t "
    texts[14] = (prose(rng, 40) + "\n") * 300
    texts[16] = "ÀÉÎ straße 漢字 \U0001f600 " * 30
    langs = [rng.choice(["en", "de", None]) for _ in range(n)]
    sources = [rng.choice(["a", "b", "B", "é", None]) if rng.random() < 0.7 else "a" for _ in range(n)]
    return [(i * 3, texts[i], langs[i], sources[i], None) for i in range(n)]


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def hard(spark):
    """Repeated rows, null ids and columns whose names the operators also use."""
    rows = corpus(5, 20)
    rows += [rows[6], rows[6], (None, rows[6][1], None, None, 1), (None, None, None, None, None)]
    out = frame(spark, rows, 3)
    for name in ("size", "kept", "mix_size", "digest", "simhash", "token_ids", "lang_pred", "Toxicity", "n_words", "label", "own_license", "places"):
        out = out.selectExpr("*", f"'x' AS {name}")
    return out
