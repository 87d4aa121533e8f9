"""Operator 7: language of a text from per-word scores, with spans of mixed text.

The script of a word narrows its candidate languages; a character trigram model per
language scores it; Viterbi over the words, with a penalty for each switch, labels
spans. The language with the most letters in its spans is the text's.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, carried_kind, slices, texts

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNDETERMINED = "und"
SLICE_BYTES = 2 << 20

# First code points of script ranges, in order; "Zyyy" is no single script.
SCRIPT_STARTS = [
    (0x0000, "Latn"), (0x0370, "Grek"), (0x0400, "Cyrl"), (0x0530, "Armn"), (0x0590, "Hebr"), (0x0600, "Arab"),
    (0x0700, "Zyyy"), (0x0900, "Deva"), (0x0980, "Beng"), (0x0A00, "Guru"), (0x0A80, "Gujr"), (0x0B00, "Orya"),
    (0x0B80, "Taml"), (0x0C00, "Telu"), (0x0C80, "Knda"), (0x0D00, "Mlym"), (0x0D80, "Sinh"), (0x0E00, "Thai"),
    (0x0E80, "Laoo"), (0x0F00, "Tibt"), (0x1000, "Mymr"), (0x10A0, "Geor"), (0x1100, "Hang"), (0x1200, "Ethi"),
    (0x13A0, "Zyyy"), (0x1780, "Khmr"), (0x1800, "Mong"), (0x18B0, "Zyyy"), (0x1E00, "Latn"), (0x1F00, "Grek"),
    (0x2000, "Zyyy"), (0x2C60, "Latn"), (0x2C80, "Zyyy"), (0x3040, "Hira"), (0x30A0, "Kana"), (0x3100, "Zyyy"),
    (0x3400, "Hani"), (0xA000, "Zyyy"), (0xA720, "Latn"), (0xA800, "Zyyy"), (0xAC00, "Hang"), (0xD7B0, "Zyyy"),
    (0xF900, "Hani"), (0xFB00, "Latn"), (0xFB10, "Zyyy"), (0x20000, "Hani"), (0x30000, "Zyyy"),
]
_FIRST = [a for a, _ in SCRIPT_STARTS]


def script(word: str) -> str:
    """Script of the first letter of a word."""
    return SCRIPT_STARTS[bisect_right(_FIRST, ord(word[0])) - 1][1]


@dataclass(frozen=True)
class Model:
    """Languages, their log probabilities of trigrams (one row each, row 0 for unseen ones), and each script's languages."""

    languages: tuple[str, ...]
    trigrams: dict[str, int]
    table: np.ndarray
    scripts: dict[str, tuple[int, ...]]


def train(sample: list[tuple[str, str]], min_share: float = 0.01) -> Model:
    """Trigram model of (language, text) pairs: P(third letter | first two), smoothed over the pairs' alphabet."""
    words: dict[str, Counter] = {}
    for language, text in sample:
        words.setdefault(language, Counter()).update(WORD.findall(text.lower()))
    languages = tuple(sorted(k for k, v in words.items() if v))
    grams: list[Counter] = []
    by_script: list[Counter] = []
    for language in languages:
        count, seen = Counter(), Counter()
        for w, n in words[language].items():
            padded = f"  {w} "
            for i in range(len(padded) - 2):
                count[padded[i : i + 3]] += n
            seen[script(w)] += n
        grams.append(count)
        by_script.append(seen)
    every = sorted(set().union(*grams)) if grams else []
    trigrams = {g: i + 1 for i, g in enumerate(every)}
    letters = len({g[2] for g in every}) or 1
    table = np.zeros((len(every) + 1, len(languages)), dtype=np.float32)
    for j, count in enumerate(grams):
        heads = Counter()
        for g, n in count.items():
            heads[g[:2]] += n
        table[1:, j] = [np.log((count[g] + 0.05) / (heads[g[:2]] + 0.05 * letters)) for g in every]
        table[0, j] = np.log(1 / letters)
    scripts: dict[str, tuple[int, ...]] = {}
    for j, seen in enumerate(by_script):
        for s, n in seen.items():
            if n >= min_share * sum(seen.values()):
                scripts[s] = (*scripts.get(s, ()), j)
    return Model(languages, trigrams, table, scripts)


def fit(docs: DataFrame, usable: Column, *, max_rows: int = 600, max_chars: int = 1_500_000) -> Model:
    """Learns from a bounded sample of the rows where usable holds and lang is known.

    Of each language the max_rows rows with the least hash of the id, and of their
    texts as many as come to max_chars: bounds that don't depend on the input's rows,
    only on the number of its languages. A language that holds most rows is ranked in
    64 shares first, so no task sees them all. Equal hashes go by the id.
    """
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = (
        docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", "lang", F.pmod(F.hash("doc_id"), F.lit(64)).alias("share"))
        .withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
        .where(F.col("at") <= max_rows)
        .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .where(F.col("at") <= max_rows)
        .collect()
    )
    if not picked:
        return train([])
    ids = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["lang"]) for r in picked], f"id {docs.schema['doc_id'].dataType.simpleString()}, language string"
    ).distinct()
    running = Window.partitionBy("language").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        docs.select("doc_id", "text", "lang")
        .join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("language")))  # max_rows ids a language
        .where("text is not null")
        .withColumn("before", F.coalesce(F.sum(F.length("text")).over(running), F.lit(0)))
        .where((F.col("before") + F.length("text") <= max_chars) | (F.col("before") == 0) & (F.length("text") <= 4 * max_chars))
        .select("language", "text")
        .collect()
    )
    return train([(r["language"], r["text"]) for r in rows])


class Labeller:
    """Scores words (each distinct one once, as long as it is remembered) and labels the words of a text."""

    def __init__(self, model: Model, switch_penalty: float, cap: float = 6.0, remembered: int = 300_000):
        self.model, self.penalty, self.cap, self.remembered = model, switch_penalty, cap, remembered
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.languages)), dtype=np.float32)
        self.lengths = np.zeros(1 << 12, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Scores of new words: summed trigram log probabilities, none more than cap below the best candidate."""
        first, needed = len(self.ids), len(self.ids) + len(words)
        while len(self.scores) < needed:
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        lookup, rows, starts = self.model.trigrams.get, [], []
        for w in words:
            padded = f"  {w} "
            starts.append(len(rows))
            rows.extend(lookup(padded[i : i + 3], 0) for i in range(len(padded) - 2))
        total = np.add.reduceat(self.model.table[rows], starts, axis=0)
        for i, w in enumerate(words):
            allowed = self.model.scripts.get(script(w))
            if allowed is not None and len(allowed) < total.shape[1]:
                barred = np.ones(total.shape[1], dtype=bool)
                barred[list(allowed)] = False
                total[i, barred] = -np.inf
        best = total.max(axis=1, keepdims=True)
        self.scores[first:needed] = np.maximum(total - best, -self.cap)
        self.lengths[first:needed] = [len(w) for w in words]
        self.ids.update(zip(words, range(first, needed), strict=True))

    def words(self, text: str) -> np.ndarray:
        """Indexes of the words of a text."""
        found = WORD.findall(text.lower())
        if len(self.ids) > self.remembered:
            self.forget()
        at = list(map(self.ids.get, found))
        if None in at:
            self.learn([w for w in dict.fromkeys(found) if w not in self.ids])
            at = list(map(self.ids.get, found))
        return np.array(at, dtype=np.int64)

    def path(self, at: np.ndarray) -> np.ndarray:
        """The language of each word on the best path.

        One language throughout is best if no stretch of words favours another by more
        than half the penalty: two stretches can't pay for the switch between them. Only
        other texts need the full recursion.
        """
        s = self.scores[at]
        main = int(s.sum(axis=0, dtype=np.float64).argmax())
        gain = np.cumsum(s - s[:, main : main + 1], axis=0, dtype=np.float64)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        if (gain - low).max() <= self.penalty / 2:
            return np.full(len(at), main)
        back: list[tuple[int, list[bool]]] = []  # the best language so far, and who is better off coming from it
        total = [0.0] * s.shape[1]
        for row in s.tolist():
            top = max(total)
            switched = top - self.penalty
            back.append((total.index(top), [t < switched for t in total]))
            total = [(switched if t < switched else t) + x for t, x in zip(total, row, strict=True)]
        out = np.empty(len(back), dtype=np.int64)
        state = total.index(max(total))
        for i in range(len(back) - 1, -1, -1):
            out[i] = state
            best, moved = back[i]
            if moved[state]:
                state = best
        return out

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """Runs of one language: (language, first word, words, letters)."""
        if not self.model.languages:
            return []
        at = self.words(text)
        if not len(at):
            return []
        path = self.path(at)
        starts = np.flatnonzero(np.diff(path, prepend=-1))
        letters = np.add.reduceat(self.lengths[at], starts)
        sizes = np.diff(np.append(starts, len(at)))
        return [(self.model.languages[path[a]], int(a), int(n), int(c)) for a, n, c in zip(starts, sizes, letters, strict=True)]


def identify(docs: DataFrame, model: Model, *, switch_penalty: float = 12.0, carry: list[str] | None = None) -> DataFrame:
    """Language of every row of docs: (doc_id, lang_pred, score, spans).

    With columns to carry there are also text and a struct of these columns, named row.

    lang_pred is the language with the most letters over its spans (ties: the first by
    name), score that share of all letters, spans the labelled runs of words. A null
    text, one without a letter, or a model without languages gives und, 0 and no spans.
    One row out for each row in; only doc_id and text are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("language", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("letters", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, switch_penalty)
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            names, scores, runs = [], [], []
            for text in texts(batch.column(1)):
                spans = labeller.spans(text)
                letters: dict[str, int] = {}
                for language, _, _, n in spans:
                    letters[language] = letters.get(language, 0) + n
                best = min(letters, key=lambda x: (-letters[x], x)) if letters else UNDETERMINED
                names.append(best)
                scores.append(round(letters[best] / sum(letters.values()), 6) if letters else 0.0)
                runs.append([dict(zip(("language", "first_word", "words", "letters"), s, strict=True)) for s in spans])
            found = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(runs, span_type)]
            more = list(range(1, batch.num_columns)) if carry else []
            yield pa.RecordBatch.from_arrays(
                [*found, *(batch.column(k) for k in more)],
                names=["doc_id", "lang_pred", "score", "spans", *(batch.schema.names[k] for k in more)],
            )

    read = docs.select("doc_id", "text", *carried(docs, carry))
    return read.mapInArrow(
        run,
        f"doc_id {kind}, lang_pred string, score double, "
        "spans array<struct<language:string,first_word:bigint,words:bigint,letters:bigint>>" + (", text string" if carry else "") + carried_kind(read),
    )
