"""BPE encoding and decoding by a tokenization automaton.

The automaton's states are "the last token was x"; an arc (x, y) says that y
may follow x in a correct encoding.  At first every base symbol may follow
every other.  Merge k, (u, v) -> uv, applies one merge gadget:

* the arc from u by v disappears (u v is now written uv);
* a new state uv gets the arcs that v has at that time;
* every state with an arc by u (after the removal) gets an arc by uv.

Copying rows and columns of 49,000 states is not affordable, so a new row or
column is kept as a reference to the one it was copied from, with the time of
the copy; ``arc`` follows these references and enters what it finds in a table
of fixed size, in which a later arc may replace an earlier one.  The result is
the same deterministic automaton: each prefix of a word has exactly one path, so
one state a position is enough to run it.  Which token comes next is not known
from the last one alone: a word's path is found by trying the arcs of its next
characters, the longest first, and leaving positions from which no arc goes on.

The tokenizer's own normalizer and pre-tokenizer split text into words; they
act within runs of non-space characters, so the ids of runs and words are kept in
a table of two generations, bounded in bytes: when the young one is full the old
one goes, and what is still in use moves on.  Decoding emits the labels of the
arcs taken.

Defined cases: a null text counts as empty; an empty text has no tokens and
decodes to ""; a text longer than memory for one row is not supported by Spark
itself; rows are independent, so ties and repeats do not matter; extra columns
stay as they are.
"""

from __future__ import annotations

import array
import json
import re
import struct
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arborlake.llm.common import fresh

#: Bytes of runs of text and of words that a worker remembers, half of them in each generation.
REMEMBERED = 80 << 20
#: Bytes that a remembered entry takes besides its characters and ids; longer runs are not remembered.
ENTRY, LONGEST = 200, 200
#: Arcs that a worker's table holds, 8 bytes each.
ARCS = 1 << 20
#: Bytes of texts and results in one Arrow batch.
BATCH_BYTES = 8 << 20
#: Unicode White_Space, which regular expressions of tokenizers call \s.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What str.split() also takes for spaces.
NOT_SPACES = re.compile("[\x1c-\x1f]")

#: Lengths to try where no token of two characters or more begins with the next ones.
ONE = (1,)
#: Below it no character has a canonical composition with another one below it.
FAR = "\u0300"
#: The steps of a public lower-casing tokenizer.
NORMALIZER = json.dumps({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]})
PRE_TOKENIZER = json.dumps({"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})


class MergeAutomaton:
    """Deterministic automaton of correct BPE encodings, compiled merge by merge."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        size = max(vocab.values(), default=-1) + 1
        self.vocab, self.end = dict(vocab), end
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        self.merged: dict[tuple[int, int], int] = {}
        #: Arc (x, y) in slot (x * size + y) % ARCS, followed by whether it exists.
        self.size, self.known = size, array.array("q", [-1]) * ARCS
        for time, (a, b) in enumerate(merges, 1):
            u, v, new = vocab[a], vocab[b], vocab[a + b]
            if self.born[new] or (u, v) in self.merged:
                raise ValueError(f"token {a + b!r} is made by two merges; its arcs would be ambiguous")
            if self.born[u] < 0 or self.born[v] < 0 or not self._arc(u, v, time):
                self.vocab.pop(a + b)  # no path ever spells u v, so the gadget adds no arc
                self.born[new] = -1
                continue
            self.merged[u, v] = time
            self.left[new], self.right[new], self.born[new] = u, v, time
        #: Lengths of tokens inside a word, longest first, by the next three characters, or the next two where no token begins with three.
        inside: dict[str, set[int]] = defaultdict(lambda: {1})
        tokens = {t for t in self.vocab if not end or not t.endswith(end)}
        for t in tokens:
            if len(t) > 1:
                inside[t[:3]].add(len(t))
        for begin, found in inside.items():
            if len(begin) == 3 and begin[:2] in tokens:
                found.add(2)
        self.lengths = {k: tuple(sorted(x, reverse=True)) for k, x in inside.items()}
        self.longest_end = max((len(t) - len(end) for t in self.vocab if t.endswith(end)), default=0)

    def _arc(self, x: int, y: int, limit: int) -> bool:
        """Is there an arc (x, y) just before ``limit``?"""
        while True:
            if self.merged.get((x, y), limit) < limit:
                return False
            if not self.born[x] and not self.born[y]:
                return True
            if self.born[y] >= self.born[x]:
                limit, y = self.born[y] + 1, self.left[y]  # a column is copied after its merge
            else:
                limit, x = self.born[x], self.right[x]  # a row before

    def arc(self, x: int, y: int) -> bool:
        """The compiled transition table, filled as it is used."""
        key = x * self.size + y
        found = self.known[key % ARCS]
        if found >> 1 != key:
            found = self.known[key % ARCS] = key << 1 | self._arc(x, y, 1 << 60)
        return found & 1 == 1

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word: the only path of arcs that spells it.

        Longer tokens are tried first.  A prefix has one path at most, so a
        position whose arcs lead nowhere never has to be entered again.
        """
        n, spelled, get, arc = len(word), word + self.end, self.vocab.get, self.arc
        lengths, longest_end = self.lengths, self.longest_end
        path, trail, dead = [], [], set()
        at, last, choices = 0, -1, None
        while n:
            if choices is None:
                if n - at <= longest_end:
                    token = get(spelled[at:])
                    if token is not None and (last < 0 or arc(last, token)):
                        path.append(token)
                        return path
                choices = iter(lengths.get(word[at : at + 3]) or lengths.get(word[at : at + 2], ONE))
            for k in choices:
                end = at + k
                if end < n and end not in dead:
                    token = get(word[at:end])
                    if token is not None and (last < 0 or arc(last, token)):
                        trail.append((at, choices))
                        path.append(token)
                        at, last, choices = end, token, None
                        break
            else:
                if not path:
                    raise ValueError(f"no path spells {word!r}")
                dead.add(at)
                at, choices = trail.pop()
                path.pop()
                last = path[-1] if path else -1
        return path


class Codec(dict):
    """Maps a run of non-space characters to its ids, little-endian.

    Words have entries too: under a key with a line feed, which no run has, but
    for plain ASCII words, which are runs that are spelled alike.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer, model = Tokenizer.from_file(path), spec["model"]
        self.split_words, self.normal = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.normalizer.normalize_str
        self.automaton = MergeAutomaton(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0
        #: The one kind of normalizer and pre-tokenizer that has a short way for runs of characters below FAR.
        steps = json.dumps(spec["normalizer"]), json.dumps(spec["pre_tokenizer"])
        self.plain = steps == (NORMALIZER, PRE_TOKENIZER)
        if self.plain:
            import regex

            self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            own = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
            self.alphabet = {b: 256 + i for i, b in enumerate(own)}
        self.label = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}

    def _words(self, run: str) -> list[str]:
        """Words of a run as the tokenizer's normalizer and pre-tokenizer give them, in its byte alphabet."""
        if self.plain and (run.isascii() or max(run) < FAR):  # nothing to compose
            low = run.lower()
            words = [low] if low.isalpha() else self.pattern.findall(low)
            return words if low.isascii() and low.isprintable() else [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.alphabet) for w in words]
        return [w for w, _ in self.split_words(self.normal(run))]

    def _remember(self, key: str, ids: bytes) -> None:
        self.young_bytes += ENTRY + 4 * len(key) + len(ids)
        if self.young_bytes > REMEMBERED // 2:
            self.old = self.copy()
            self.clear()
            self.young_bytes = 0
        self[key] = ids

    def _word(self, word: str) -> bytes:
        key = word if self.plain and word.isascii() else "\n" + word
        found = self.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                ids = self.automaton.encode(word)
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= LONGEST:
                self._remember(key, found)
        return found

    def __missing__(self, run: str) -> bytes:
        found = self.old.get(run)
        if found is None:
            if self.specials and self.specials.search(run):
                parts = []
                for part in self.specials.split(run):
                    if part in self.special:
                        parts.append(struct.pack("<I", self.special[part]))
                    elif part:
                        parts += map(self._word, self._words(part))
                found = b"".join(parts)
            else:
                words = self._words(run)
                found = self._word(words[0]) if len(words) == 1 else b"".join(map(self._word, words))
                if words == [run] and self.plain:
                    return found  # remembered as a word
        if len(run) <= LONGEST:
            self._remember(run, found)
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids and the decoded text of a whole text."""
        runs = filter(None, SPACES.split(text)) if NOT_SPACES.search(text) else text.split()
        ids = b"".join(map(self.__getitem__, runs))
        return ids, self.decode(np.frombuffer(ids, "<u4"))

    def decode(self, ids) -> str:
        """Labels of the arcs, joined as a tokenizer without a decoder joins them."""
        return " ".join(map(self.label.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One compiled automaton a worker and file."""
    return Codec(path)


def bpe_encode(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with token ids (binary, little-endian unsigned 32-bit), their number and the decoded text.

    ``path`` names the tokenizer's file, which every executor must have.  Also
    returns the names of the three columns.  One narrow pass, no shuffle.
    """
    names = fresh(docs, "token_ids", "n_tokens", "decoded")
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, (T.BinaryType(), T.LongType(), T.StringType()))])
    at = docs.columns.index(text)

    def run(batches):
        table = codec(path)
        for batch in batches:
            start, kept, held = 0, [], 0
            texts = batch.column(at)
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                found = table.encode(text)
                kept.append(found)
                held += len(text) + len(found[0]) + len(found[1])
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    rows = batch.slice(start, len(kept))
                    columns = [pa.array([x for x, _ in kept], pa.binary()), pa.array([len(x) // 4 for x, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.string())]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*batch.schema.names, *names])
                    start, kept, held = i + 1, [], 0

    return docs.mapInArrow(run, schema), dict(zip(("ids", "n", "decoded"), names, strict=True))


def bpe_decode(encoded: DataFrame, path: str, ids: str = "token_ids") -> tuple[DataFrame, str]:
    """``encoded`` with the text its ids spell; null ids decode to ""."""
    name = fresh(encoded, "decoded_text")[0]
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])
    at = encoded.columns.index(ids)

    def run(batches):
        table = codec(path)
        for batch in batches:
            texts = [table.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return encoded.mapInArrow(run, schema), name
