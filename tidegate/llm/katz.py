"""Scoring texts by a Katz backoff language model of order two.

Counts of words and of word pairs are kept in tables partitioned by hash (the buckets of `keyed`): chunks of
documents ask for the counts of what they hold. Counts up to GOOD_TURING are discounted by Good-Turing's
estimate; what a history's discounts set free is spread over the words not seen after it by the lower order,
with a weight that makes its probabilities sum to one exactly. The lowest order leaves its free mass to one
class of unknown words. A token's probability is found recursively: pair, else weighted word, else unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import partitions
from tidegate.llm.hashing import pair, word_hashes
from tidegate.llm.keyed import ASKED, RANKS, add_counts, answer, answers_of, ask, chunked

#: Largest count that is discounted.
GOOD_TURING = RANKS - 1
#: The end of a text, and the history of its first token; no word contains these signs.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n", b"\t"))
#: A chunk's sets of keys in the first round; the second has histories alone.
WORDS, PAIRS = 0, 1


def discounts(ranks: np.ndarray) -> np.ndarray:
    """Factor for counts 0 to GOOD_TURING + 1 (the last is for all larger ones), from counts of counts n_1, n_2, ...

    Where Good-Turing's factor for a count is not between 0 and 1, as on small or repetitive corpora, absolute
    discounting by n_1 / (n_1 + 2 n_2), or by a half where no count is two, stands in for that count.
    """
    n = np.r_[0.0, np.asarray(ranks, float)]
    k = GOOD_TURING
    out = np.ones(k + 2)
    absolute = (n[1] / (n[1] + 2 * n[2]) if n[2] else 0.5) if n[1] else 0.0
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        factor = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = factor if 0 < factor < 1 else (r - absolute) / r
    return out


@dataclass
class Words:
    """The lowest order: probabilities of known words by count, and of the unknown class."""

    total: int
    distinct: int
    factors: np.ndarray
    base: float
    unknown: float

    @classmethod
    def of(cls, totals: np.ndarray) -> Words:
        total, distinct, ranks = int(totals[0]), int(totals[1]), totals[2:]
        factors = discounts(ranks)
        r = np.arange(1, GOOD_TURING + 1)
        free = float((ranks[:GOOD_TURING] * r * (1 - factors[1 : GOOD_TURING + 1])).sum())
        if total and free <= 0:
            return cls(total, distinct, factors, total + 1.0, 1 / (total + 1.0))
        return cls(total, distinct, factors, float(max(total, 1)), free / total if total else 1.0)

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.factors[np.minimum(count, GOOD_TURING + 1)] * count / self.base, self.unknown)


class Tokens:
    """The tokens of a chunk's documents: hashes, histories, and sorted distinct words, pairs and histories."""

    def __init__(self, table: pa.Table) -> None:
        texts = table["text"].cast(pa.binary()).to_pylist()
        hashes = [np.append(word_hashes(t.lower().split() if t else []), END) for t in texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        word = np.concatenate(hashes)
        history = np.roll(word, 1)
        history[self.starts] = START
        self.in_training = np.repeat(np.array(table["train"].to_pylist(), bool), self.sizes)
        self.words, self.word_at = np.unique(word, return_inverse=True)
        self.pairs, self.pair_first, self.pair_at = np.unique(pair(history, word, 1), return_index=True, return_inverse=True)
        self.histories = np.sort(np.append(self.words[self.words != END], START))
        self.history_at = np.searchsorted(self.histories, history)

    def counts(self, at: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(at, self.in_training, size).astype(np.int32)

    def of_words(self, values: np.ndarray) -> np.ndarray:
        """What holds for each history, by its word; for the start of a text, by its end."""
        return values[np.searchsorted(self.words, np.where(self.histories == START, END, self.histories))]


def _read(table: pa.Table) -> tuple:
    (word_counts, word_flags), word_totals = answers_of(table, WORDS, [np.int64, np.uint8])
    (pair_counts, pair_flags), pair_totals = answers_of(table, PAIRS, [np.int64, np.uint8])
    return word_counts, word_flags > 1, Words.of(word_totals), pair_counts, pair_flags % 2 == 1, discounts(pair_totals[2:])


def backoff(spent: np.ndarray, covered: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each history's lower order, and what is added to its count where no discount frees any mass."""
    added = (count - spent < 1e-9).astype(float)
    free = (count + added - spent) / np.maximum(count + added, 1)
    return np.where(count > 0, free / np.maximum(1 - covered, 1e-12), 1.0), added


def _weights(number: np.ndarray, given: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    size = int(number.max()) + 1 if len(number) else 0
    count = np.zeros(size)
    np.maximum.at(count, number, given[2].astype(float))
    weight, added = backoff(np.bincount(number, given[0], size), np.bincount(number, given[1], size), count)
    return [weight[number], added[number].astype(np.uint8)], []


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; logarithms to base 10.

    Learns from the rows outside `held_out`. Letters A to Z are lower-cased; tokens are words and one end, so a
    null or empty text has one token. Rows repeated are counted and scored as often as they occur. An empty
    table gives no rows; without training rows every token is unknown, with probability one. Texts of any length are
    scored whole; columns beside doc_id, text and those that `held_out` reads are ignored, whatever their names.
    """
    buckets = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    rows = chunked(rows, "doc_id", "text", "train")

    def ask_counts(key: tuple, table: pa.Table) -> pa.Table:
        t = Tokens(table)
        return ask(key[0].as_py(), buckets, (t.words, [t.counts(t.word_at, len(t.words))]), (t.pairs, [t.counts(t.pair_at, len(t.pairs))]))

    def own_sums(t: Tokens, answers: pa.Table) -> tuple:
        """What the pairs that this chunk is the first to hold add to their histories; the histories' counts; which others hold, too."""
        word_counts, elsewhere, words, pair_counts, first, factors = _read(answers)
        own = t.pair_first[first]
        of, count = t.history_at[own], pair_counts[first].astype(np.int64)
        spent = np.bincount(of, factors[np.minimum(count, GOOD_TURING + 1)] * count, len(t.histories))
        covered = np.bincount(of, words.probability(word_counts[t.word_at[own]].astype(np.int64)), len(t.histories))
        return (spent, covered, t.of_words(word_counts).astype(np.int64)), t.of_words(elsewhere)

    def ask_weights(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        t = Tokens(table)
        sums, shared = own_sums(t, answers)  # a history that no other chunk holds is complete here
        return ask(key[0].as_py(), buckets, (t.histories[shared], [x[shared] for x in sums]))

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def evaluate(table: pa.Table, answers: pa.Table) -> pa.Table:
        t = Tokens(table)
        first_round, second_round = (answers.filter(pc.equal(answers["round"], r)) for r in (1, 2))
        word_counts, _, words, pair_counts, _, factors = _read(first_round)
        sums, shared = own_sums(t, first_round)
        weight, added = backoff(*sums)
        (weight[shared], added[shared]), _ = answers_of(second_round, 0, [np.float64, np.uint8])
        count = word_counts[t.word_at].astype(np.int64)
        base = np.log10((count + 0.5) / (words.total + 0.5 * (words.distinct + 1)))
        pairs = pair_counts[t.pair_at].astype(np.int64)
        history = np.maximum(sums[2] + added, 1)[t.history_at]
        seen = factors[np.minimum(pairs, GOOD_TURING + 1)] * pairs / history
        probability = np.where(pairs > 0, seen, weight[t.history_at] * words.probability(count))
        total = lambda x: np.add.reduceat(x, t.starts)
        return pa.table(
            [
                table["doc_id"],
                pa.array(~np.array(table["train"].to_pylist(), bool)),
                pa.array(t.sizes),
                pa.array(total((count > 0).astype(np.int64))),
                pa.array(np.full(len(t.sizes), words.total, np.int64)),
                pa.array(total(base)),
                pa.array(total(np.log10(np.maximum(probability, 1e-300)))),
            ],
            names,
        )

    counted = answer(rows.groupBy("chunk").applyInArrow(ask_counts, ASKED), [np.int32], add_counts)
    asked_weights = rows.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(ask_weights, ASKED)
    weighed = answer(asked_weights, [np.float64, np.float64, np.int64], _weights)
    both = counted.withColumn("round", F.lit(1)).unionAll(weighed.withColumn("round", F.lit(2)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(evaluate, schema)
