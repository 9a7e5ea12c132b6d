"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A token with signs or digits among its letters, or a letter three times running, becomes a lattice of what may
have been meant: letters that a sign stands for, separators that go, repeated letters that fall together. A
Viterbi search takes the likeliest path under a character language model: trigrams of all documents, mixed with
those of the words that labels mark. Runs of single letters are joined and restored in the same way. A text is
scored by the strongest evidence among its restored words: lower bounds of log ratios of words and word
beginnings, and a logistic model on a few sums of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, gather, mapped, scratch, stored
from .quality import labelled_sample

SAMPLE = 30_000
#: Word beginnings that count as evidence, in characters.
HEADS = (4, 5, 6)
#: Documents of the toxic sample that must hold a word before it is evidence, and the evidence it must be.
LEAST, FLOOR = 3, 1.5
#: Log probabilities that a character model remembers at a time.
REMEMBERED = 100_000
#: Evidence that chance doesn't give, and how many sums of a text's evidence the logistic model weighs.
STRONG, SUMS = 3.0, 5
#: What a sign or digit may stand for.
MEANT = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "%": "aeiou"}
SEPARATORS = ".-_*'~^`·•,:;/\\+|"
OUTER = ".,;:!?\"'()[]{}<>«»“”‘’…%$&*#@|~^`+=/\\-_"
#: Tokens without a letter that may be words all the same, and what numbers, sums and marks look like.
SIGNS, NUMBER = r"^[0-9@$!|+(<€£*#%]{3,}$", r"^[#$€£+(<]*[0-9]+[%$€£!+*#|]*$"
RUNS = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass
class CharModel:
    """Character trigrams of words, with ends; log probabilities by backing off. counts: (trigram) -> weight."""

    counts: dict[str, float]
    mixed: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.logs: dict[str, float] = {}
        self.tables = [self._tables(x) for x in (self.counts, self.mixed) if x]

    @staticmethod
    def _tables(counts: dict[str, float]) -> tuple[dict, dict, dict, dict, float]:
        pairs: dict[str, float] = {}
        heads: dict[str, float] = {}
        singles: dict[str, float] = {}
        for t, n in counts.items():
            heads[t[:2]] = heads.get(t[:2], 0) + n
            pairs[t[1:]] = pairs.get(t[1:], 0) + n
            singles[t[2]] = singles.get(t[2], 0) + n
        firsts: dict[str, float] = {}
        for t, n in pairs.items():
            firsts[t[0]] = firsts.get(t[0], 0) + n
        return heads, pairs, firsts, singles, sum(singles.values())

    def log(self, context: str, char: str) -> float:
        key = context + char
        if key not in self.logs:
            if len(self.logs) >= REMEMBERED:
                self.logs.clear()
            p = 0.0
            for own, (heads, pairs, firsts, singles, total) in zip((self.counts, self.mixed), self.tables, strict=False):
                one = (singles.get(char, 0) + 0.5) / (total + 20)
                two = (pairs.get(key[1:], 0) + 2 * one) / (firsts.get(key[1], 0) + 2)
                p += ((own.get(key, 0) + 2 * two) / (heads.get(context, 0) + 2)) / len(self.tables)
            self.logs[key] = math.log(p)
        return self.logs[key]

    def word(self, word: str) -> float:
        text = f"^^{word}$"
        return sum(self.log(text[i - 2 : i], text[i]) for i in range(2, len(text)))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per step the (letters, cost) that may stand there: the channel's log probabilities."""
    steps = []
    for run in re.finditer(r"(.)\1*", token, re.S):
        char, n = run[1], len(run[0])
        arcs = []
        if char in MEANT:
            arcs += [(c, -1.0 - 0.7 * (len(MEANT[char]) > 2)) for c in MEANT[char]]
        if char in SEPARATORS or not char.isalnum():
            arcs.append(("", -1.5))
        if not arcs or char.isdigit():
            arcs.append((char, 0.0 if char.isalpha() else -6.0))
        if n == 1:
            steps.append(arcs)
        elif char.isalpha():
            steps.append([(char, -0.5 if n > 2 else -3.0), (char * 2, -0.7 if n > 2 else 0.0)])
        else:
            steps.append([(c * k, p - 0.3 * (k > 1)) for c, p in arcs for k in (1, 2) if c or k == 1])
    return steps


def restore(token: str, model: CharModel) -> str:
    """The likeliest word behind a token; states are the last two letters."""
    states: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    for arcs in lattice(token):
        following: dict[str, tuple[float, str]] = {}
        for context, (score, word) in states.items():
            for letters, cost in arcs:
                total, at = score + cost, context
                for c in letters:
                    total += model.log(at, c)
                    at = at[1] + c
                made = (total, word + letters)
                if at not in following or made > following[at]:
                    following[at] = made
        states = following
    return max((score + model.log(context, "$"), word) for context, (score, word) in states.items())[1]


def _odd(words: pa.Array) -> np.ndarray:
    """Which of these may be disguised: a sign or digit besides letters, or a letter three times running."""
    inner = pc.and_(pc.match_substring_regex(words, r"[^\p{L}\p{M}]"), pc.match_substring_regex(words, r"\p{L}|[0-9@$!|+*][0-9@$!|+*][0-9@$!|+*]"))
    return pc.or_(inner, pc.match_substring_regex(words, RUNS)).to_numpy(zero_copy_only=False)


class Restored:
    """A block's words in lower case without outer signs, disguised ones restored where a model is given.

    doc, word: a row for each word; words: the distinct ones.
    """

    def __init__(self, texts: pa.Array, model: CharModel | None) -> None:
        seen = Words(pc.utf8_lower(pc.fill_null(texts, "")), lower=False)
        raw = seen.words
        bare = pc.utf8_trim(raw, characters=OUTER)
        words = bare.to_numpy(zero_copy_only=False).tolist() if len(bare) else []
        doc, word = seen.doc, seen.word
        if model is not None:
            # Outer signs may stand for letters too: a token is tried with them if it has others or a run.
            has = lambda pattern: pc.match_substring_regex(raw, pattern).to_numpy(zero_copy_only=False)
            odd = _odd(raw) & has(r"\p{L}")
            odd &= _odd(bare) | has(r"^[@$!|+*0-9(<€][^@$!|+*0-9(<€]*\p{L}|\p{L}[@$|+*0-9(€]$") if len(raw) else False
            odd |= has(SIGNS) & has("[0-9]") & has("[@$!|(<*#]") & ~has(NUMBER) if len(raw) else False
            full = raw.to_numpy(zero_copy_only=False) if len(raw) else []
            for k in np.flatnonzero(odd).tolist():
                words[k] = best(full[k], words[k], model)
            doc, word, words = self._joined(seen, bare, doc, word, words, model)
        coded = pa.array(words, pa.string()).dictionary_encode()
        self.word = coded.indices.to_numpy()[word] if len(words) else word
        self.doc, self.words, self.n = doc, coded.dictionary, seen.n

    @staticmethod
    def _joined(seen: Words, bare: pa.Array, doc, word, words, model):
        """Adds, for each run of three or more single characters in a text, what they spell."""
        # Tokens of signs alone may stand between the letters.
        single = (pc.utf8_length(bare).to_numpy(zero_copy_only=False) <= 1)[seen.word] if len(bare) else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        more: dict[str, int] = {}
        extra_doc, extra_word = [], []
        raw = bare.to_numpy(zero_copy_only=False) if len(starts) else None
        for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
            cuts = [a, *(a + 1 + np.flatnonzero(np.diff(seen.doc[a:z]))).tolist(), z]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo >= 3:
                    spelt = "".join(raw[k] for k in seen.word[lo:hi])
                    if len(spelt) < 3:
                        continue
                    if spelt not in more:
                        more[spelt] = len(words)
                        words.append(best(spelt, spelt, model))
                    extra_doc.append(seen.doc[lo])
                    extra_word.append(more[spelt])
        if extra_doc:
            doc, word = np.concatenate([doc, np.array(extra_doc, doc.dtype)]), np.concatenate([word, np.array(extra_word, word.dtype)])
        return doc, word, words


def best(full: str, bare: str, model: CharModel) -> str:
    """Of the token with its outer signs and without, the restored word that the model finds likelier per letter."""
    made = {restore(x, model).strip(OUTER) for x in {full, bare}} - {""}
    return max(sorted(made), key=lambda w: model.word(w) / (len(w) + 1), default=bare)


@dataclass
class Toxic:
    """chars: the language model; evidence: words and beginnings (these end in a space) with weights; weights: of the logistic model."""

    chars: CharModel | None
    evidence: dict[str, float]
    weights: np.ndarray
    base: float

    def sums(self, found: Restored) -> np.ndarray:
        """Per text: strongest evidence, second strongest, what these have beyond STRONG, log of the number of words with evidence."""
        keys = pa.array(self.evidence, pa.string())
        values = np.append(np.array(list(self.evidence.values())), 0.0)
        worth = np.zeros(len(found.words))
        for n in (None, *HEADS):
            looked = found.words if n is None else pc.binary_join_element_wise(pc.utf8_slice_codeunits(found.words, 0, n), " ", "")
            at = pc.fill_null(pc.index_in(looked, keys), len(keys)).to_numpy(zero_copy_only=False)
            worth = np.maximum(worth, values[at])
        out = np.zeros((found.n, SUMS))
        hit = worth[found.word] > 0
        doc, own = found.doc[hit], worth[found.word[hit]]
        order = np.lexsort((-own, doc))
        doc, own = doc[order], own[order]
        first = np.flatnonzero(np.diff(np.concatenate([[-1], doc])))
        out[doc[first], 0] = own[first]
        second = first + 1
        second = second[(second < len(doc))]
        second = second[doc[second] == doc[second - 1]]
        out[doc[second], 1] = own[second]
        out[:, 2:4] = np.maximum(out[:, :2] - STRONG, 0)
        out[:, 4] = np.log1p(np.bincount(doc, minlength=found.n))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        x = self.sums(Restored(texts, self.chars))
        if self.chars is not None:
            self.chars.logs.clear()
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.base, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """The least penalised loss, by projected Newton steps, each halved until the loss falls: whole steps run away where
    evidence divides the labels. Weights are kept from falling below zero, for evidence never speaks against."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = math.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return w[:-1], float(w[-1])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * (w[:-1] @ w[:-1]))

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - y) + ridge * np.append(w[:-1], 0)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge] * x.shape[1] + [1e-9])
        held = np.append((w[:-1] <= 1e-3) & (g[:-1] > 0), False)  # those that would fall below zero go by themselves
        step = g / np.diag(h)
        step[~held] = np.linalg.solve(h[np.ix_(~held, ~held)], g[~held])
        size = 1.0
        while size > 1e-9:
            near = w - size * step
            near[:-1] = np.maximum(near[:-1], 0)
            then = loss(near)
            if then <= now - 1e-4 * (size * g[~held] @ step[~held] + g[held] @ (w - near)[held]):
                break
            size /= 2
        else:
            break
        done = now - then <= 1e-12 * now
        w, now = near, then
        if done:
            break
    return w[:-1], float(w[-1])


def _evidence(texts: DataFrame) -> dict[str, float]:
    """texts: text, y. Words and beginnings that toxic documents hold more often, with a lower bound of the log ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 0):
            y = block.column(1).to_numpy(zero_copy_only=False)
            found = Restored(block.column(0), None)
            for n in (None, *HEADS):
                looked = found.words if n is None else pc.binary_join_element_wise(pc.utf8_slice_codeunits(found.words, 0, n), " ", "")
                coded = looked.dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)[found.word]
                pairs = np.unique(found.doc.astype(np.int64) * max(1, len(coded.dictionary)) + code)
                doc, code = np.divmod(pairs, max(1, len(coded.dictionary)))
                bad = np.bincount(code, y[doc], len(coded.dictionary))
                every = np.bincount(code, minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(bad.astype(np.int64)), pa.array((every - bad).astype(np.int64))], names=["word", "bad", "good"])

    counts = mapped(texts.select("text", "y"), run, "word string, bad long, good long")
    totals = texts.agg(F.sum("y"), F.count("*")).first()
    bad, good = float(totals[0] or 0), float((totals[1] or 0) - (totals[0] or 0))
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    bound = ratio - 1.5 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    # Words in LEAST toxic documents of a bounded sample: a bounded number.
    kept = counts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(f"bad >= {LEAST}")
    kept = kept.select("word", bound.alias("bound")).where(f"bound >= {FLOOR} AND length(trim(word)) >= 2")
    return {r.word: r.bound for r in kept.orderBy(F.desc("bound"), "word").collect()}


def char_counts(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Trigrams of letters in the words of all documents, ends included: at most 28 * 28 * 28 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(28**3, np.int64)
        codes = np.full(256, -1, np.int64)
        codes[list(LETTERS.encode())] = np.arange(26)
        for block in blocks(batches, 0):
            seen = Words(block.column(0), lower=True)
            if not len(seen.words):
                continue
            words = pc.utf8_trim(seen.words, characters=OUTER)
            plain = pc.match_substring_regex(words, "^[a-z]+$")
            times = np.bincount(seen.word, minlength=len(words))[plain.to_numpy(zero_copy_only=False)]
            words = words.filter(plain)
            if not len(words):
                continue
            offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            sizes = np.diff(offsets)
            data = codes[np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
            # ^^word$ of each word, one after the other: 26 begins, 27 ends.
            starts = np.concatenate([[0], np.cumsum(sizes + 3)])
            flat = np.full(starts[-1], 26, np.int64)
            flat[starts[1:] - 1] = 27
            flat[gather(starts[:-1] + 2, sizes)] = data
            owner = np.repeat(np.arange(len(sizes)), sizes + 1)
            at = gather(starts[:-1] + 2, sizes + 1)
            total += np.bincount((flat[at - 2] * 28 + flat[at - 1]) * 28 + flat[at], times[owner], 28**3).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["code", "n"])

    chars = LETTERS + "^$"
    rows = mapped(docs.select(text), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {chars[r.code // 784] + chars[r.code // 28 % 28] + chars[r.code % 28]: float(r.n) for r in rows}


def word_counts(words: dict[str, float], total: float) -> dict[str, float]:
    """Trigrams of these words, weighted to that total."""
    out: dict[str, float] = {}
    for word, n in words.items():
        text = f"^^{word}$"
        for i in range(2, len(text)):
            out[text[i - 2 : i + 1]] = out.get(text[i - 2 : i + 1], 0) + n
    scale = total / max(sum(out.values()), 1e-9)
    return {k: v * scale for k, v in out.items()}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Toxic:
    """From at most sample labelled rows (those of the smallest hashed keys): half for evidence, half for the logistic
    model. The character model counts all of docs.

    Labels that are null or without a key are left out; of a key's labels the largest counts. Rows of docs without a key teach
    only characters, repeated rows count each time, null texts are empty. Without evidence every score is the same: 0.5
    without labelled rows. An empty table teaches nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    with scratch(spark):
        chosen = labelled_sample(labels, key, label, sample)
        # Of a bounded number of rows.
        texts = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen.withColumnRenamed(key, "key")), "key")
        texts = stored(texts.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "key"), F.lit(2))), "labelled")
        evidence = _evidence(texts.where("half = 0"))
        words = {w: n for w, n in evidence.items() if not w.endswith(" ") and re.fullmatch("[a-z]{4,}", w)}
        counts = char_counts(docs, text)
        chars = CharModel(counts, word_counts(words, 2000.0)) if counts else None
        if not evidence:
            return Toxic(chars, {"\x00": 0.0}, np.zeros(SUMS), logistic(np.zeros((0, SUMS)), np.zeros(0))[1])
        shared = spark.sparkContext.broadcast(Toxic(chars, evidence, np.zeros(SUMS), 0.0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, 0):
                x = shared.value.sums(Restored(block.column(0), shared.value.chars))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * SUMS, x.ravel()), block.column(1)], names=["x", "y"])

        made = mapped(texts.where("half = 1").select("text", "y"), run, "x array<double>, y double")
        rows = np.array(sorted((*r.x, r.y) for r in made.collect())).reshape(-1, SUMS + 1)
        shared.destroy()
    weights, base = logistic(rows[:, :-1], rows[:, -1])
    return Toxic(chars, evidence, weights, base)


def score(docs: DataFrame, model: Toxic, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: a row per row of docs, repeated ones and those without a key too.

    Null and empty texts have the score of an empty text. An empty table gives an empty one; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(shared.value.score(block.column(1)))], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"`{key}` {kind}, score double")


def keep_clean(docs: DataFrame, model: Toxic, most: float, text: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text scores less than that; see score()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at):
            yield block.filter(pa.array(shared.value.score(block.column(at)) < most))

    return mapped(docs, run, docs.schema)


def restored_text(text: str | None, model: CharModel) -> str:
    """The words of one text as they are scored, joined by spaces; what spaced letters spell comes last."""
    found = Restored(pa.array([text], pa.string()), model)
    words = found.words.to_pylist()
    return " ".join(words[k] for k in found.word)
