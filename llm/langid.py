"""Language identification, word first.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams, of the greatest length of which any is known, then shorter; their mean log
frequency is its score. The scores of all words of a text and the log shares of the languages
add up, and the best language and its posterior probability are returned.

Words are the letters of each run without white space, lower-cased. Frequencies are counted on a
bounded sample of labelled documents, taken by a hash of their id: at most about ``max_docs`` of
each language. All words and n-grams of the sample are kept; tasks hold them as sorted 64-bit hashes with
one 32-bit score per language. Prediction covers every document and its whole text.

Null texts and texts without a letter are ``und`` with score 0, as are all texts when nothing
was learned. Equal scores go to the language whose name comes first. Repeated rows are counted and predicted each; an
empty table gives an empty one. Columns named like a result get underscores behind their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import _slices
from .names import set_aside
from .words import hash_words, one_array, rank_words, split_words

MAX_GRAM = 4
SMOOTHING = 0.5
SLICE_BYTES = 4 * 1024 * 1024  # of text whose words are held at a time; a longer text is held alone
FLUSH_WORDS = 100_000  # counted words of a task, after which it hands on what it has


def letters(word: str) -> str:
    """The word's letters in lower case."""
    if not word.isalpha():
        word = "".join(c for c in word if c.isalpha())
    return word.lower()


def grams(word: str, n: int) -> list[str]:
    """Character n-grams, with the word's bounds marked from length 2 on."""
    text = word if n == 1 else f"<{word}>"
    return [text[i : i + n] for i in range(len(text) - n + 1)]


class Model:
    """Words (kind 0) and n-grams (kind n) as sorted hashes, with their log frequencies by language.

    ``tables`` holds the entries of each kind in the order of the rows of ``scores``.
    """

    def __init__(self, langs, log_share, tables, scores, floors):
        self.langs, self.log_share, self.floors = langs, log_share, floors
        self.keys, self.scores = [], []
        for table, score in zip(tables, scores):
            entries = table if isinstance(table, pa.Array) else pa.array(list(table), pa.string())
            keys = hash_words(entries)
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.scores.append(np.asarray(score, np.float32)[order])

    def find(self, kind: int, entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each entry its row of ``scores[kind]``, and whether it is known."""
        keys, wanted = self.keys[kind], hash_words(pa.array(entries, pa.string()))
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log scores of words by language; words without letters are 0."""
        out = np.zeros((len(words), len(self.langs)))
        at, known = self.find(0, words)
        has = np.array([bool(w) for w in words], bool)
        known &= has
        out[known] = self.scores[0][at[known]]
        left = np.flatnonzero(has & ~known)
        for n in range(MAX_GRAM, 0, -1):
            listed = [grams(words[i], n) for i in left.tolist()]
            word = np.repeat(np.arange(len(left)), [len(x) for x in listed])
            at, known = self.find(n, [g for x in listed for g in x])
            hits = np.bincount(word[known], minlength=len(left))
            sums = np.zeros((len(left), len(self.langs)))
            np.add.at(sums, word[known], self.scores[n][at[known]])
            seen = hits > 0
            out[left[seen]] = sums[seen] / hits[seen, None]
            left = left[~seen]
        out[left] = self.floors
        return out


def train(
    docs: DataFrame,
    held_out: Column | None = None,
    max_docs: int = 5_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Count words and n-grams by language on rows with a label outside ``held_out``."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if held_out is not None:
        known = known.filter(~F.coalesce(held_out, F.lit(False)))
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).agg(F.count("*")).collect()}
    langs = sorted(sizes)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, max_docs / sizes[lang]))).otherwise(share)
    lot = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(lot < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))

    def entries_of(found):
        rows = Counter()
        for (lang, word), n in found.items():
            rows[lang, 0, word] += n
            for size in range(1, MAX_GRAM + 1):
                for gram in grams(word, size):
                    rows[lang, size, gram] += n
        keys = list(rows)
        for at in range(0, len(keys), 100_000):
            part = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in part], pa.string()),
                    pa.array([k[1] for k in part], pa.int32()),
                    pa.array([k[2] for k in part], pa.string()),
                    pa.array([rows[k] for k in part], pa.int64()),
                ],
                names=["lang", "kind", "entry", "n"],
            )

    def count(batches):
        found = Counter()
        for table in _slices(batches, "body", SLICE_BYTES):
            words, counts = split_words(table["body"])
            distinct, codes = rank_words(words)
            texts = [letters(w) for w in distinct.to_pylist()]
            row_lang = one_array(table["lang"]).dictionary_encode()
            lang = np.repeat(row_lang.indices.to_numpy().astype(np.int64), counts)
            seen, times = np.unique(lang * max(1, len(texts)) + codes, return_counts=True)
            names = row_lang.dictionary.to_pylist()
            for key, n in zip(seen.tolist(), times.tolist()):
                which, code = divmod(key, max(1, len(texts)))
                if texts[code]:
                    found[names[which], texts[code]] += n
            if len(found) >= FLUSH_WORDS:
                yield from entries_of(found)
                found = Counter()
        yield from entries_of(found)

    counted = sample.mapInArrow(count, "lang string, kind int, entry string, n long")
    # one row per entry with its counts by language
    by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    if not langs:
        return Model([], np.zeros(0), [{}] * (MAX_GRAM + 1), [np.zeros((0, 0))] * (MAX_GRAM + 1), np.zeros(0))
    entries = counted.groupBy("kind", "entry").agg(F.sum("n").alias("n"), *by_lang)
    tables, scores = [], []
    from lexigrove.runtime import materialize

    entries = materialize(entries, "langid-counts")
    totals = {
        r["kind"]: np.array([r[f"n{i}"] for i in range(len(langs))], float)
        for r in entries.groupBy("kind").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(langs))]).collect()
    }
    for kind in range(MAX_GRAM + 1):
        # every entry of the sample, which max_docs bounds
        rows = entries.filter(F.col("kind") == kind).drop("n").toArrow()
        counts = np.array([rows[f"n{i}"].to_numpy() for i in range(len(langs))], float).T.reshape(-1, len(langs))
        total = totals.get(kind, np.zeros(len(langs)))
        tables.append(one_array(rows["entry"]))
        scores.append(np.log((counts + SMOOTHING) / (total + SMOOTHING * (len(counts) + 1))))
    share = np.array([sizes[x] for x in langs], float)
    floors = np.zeros(len(langs))
    return Model(langs, np.log(share / share.sum()), tables, scores, floors)


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """Add the language of every whole text and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # entries of at most max_docs texts a language
    docs = set_aside(docs, (lang_col, score_col))
    schema = docs.select("*", F.lit("").alias(lang_col), F.lit(0.0).alias(score_col)).schema

    def task(batches):
        m = shared.value
        names = pa.array([*m.langs, "und"], pa.string())
        for table in _slices(batches, text_col, SLICE_BYTES):
            words, counts = split_words(table[text_col])
            distinct, codes = rank_words(words)
            texts = [letters(w) for w in distinct.to_pylist()]
            has = np.array([bool(t) for t in texts], bool)
            per_word = m.word_scores(texts)
            ends = np.cumsum(counts)
            total = np.zeros((len(codes) + 1, len(m.langs)))
            np.cumsum(per_word[codes], axis=0, out=total[1:])
            lettered = np.concatenate([[0], np.cumsum(has[codes])]) if len(codes) else np.zeros(1, int)
            found = lettered[ends] > lettered[ends - counts]
            sums = total[ends] - total[ends - counts] + m.log_share
            if len(m.langs):
                best = sums.argmax(axis=1)
                odds = np.exp(sums - sums.max(axis=1, keepdims=True))
                posterior = 1.0 / odds.sum(axis=1)
            else:
                best, posterior, found = np.zeros(len(counts), int), np.zeros(len(counts)), found & False
            pred = names.take(pa.array(np.where(found, best, len(m.langs))))
            table = table.append_column(lang_col, pred)
            yield from table.append_column(score_col, pa.array(np.where(found, posterior, 0.0))).to_batches()

    return docs.mapInArrow(task, schema)
