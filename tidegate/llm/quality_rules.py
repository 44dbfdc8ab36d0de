"""Quality rules and line labelling: a linear-chain conditional random field marks content and boilerplate.

Lines are labelled jointly by Viterbi decoding; the share of words in content lines decides retention,
beside plain rules on word counts and repetition. The field is trained on a bounded sample of documents
with quality labels: a plain line classifier first finds which lines of low-quality documents look alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.quality_model import SAMPLE_VALUES, collected_sample, labelled_sample
from tidegate.llm.signals import NAMES, signals

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Places (lines x documents) that forward-backward pads documents to at once.
CELLS = 1 << 20
#: Signals of a line, whether it repeats an earlier one, and whether it ends a sentence.
FEATURES = len(NAMES) + 2
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    key = h[:n] * _MIX[0]
    for k in range(1, window):
        key = (key ^ (key >> np.uint64(29))) * _MIX[4] + h[k : k + n] * _MIX[k % 5]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(n, bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(starts), 1)
    np.add.at(edge, np.flatnonzero(starts) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def lines_of(text: str) -> tuple[list[list[bytes]], list[bool], int]:
    """Words of each line that has any, whether it equals an earlier one, and how many do."""
    seen: set[str] = set()
    words, again = [], []
    for line in text.split("\n"):
        if found := line.encode("utf-8", "surrogatepass").split():
            words.append(found)
            again.append(line in seen)
            seen.add(line)
    return words, again, sum(again)


def line_features(words: list[list[bytes]], again: list[bool]) -> np.ndarray:
    return np.array([[*signals(w), float(a), float(w[-1][-1:] in b".!?")] for w, a in zip(words, again, strict=True)], np.float64).reshape(-1, FEATURES)


@dataclass
class LineField:
    """Two labels, 0 boilerplate and 1 content: standardised features, emission weights and transitions."""

    mean: np.ndarray
    scale: np.ndarray
    emit: np.ndarray
    bias: float
    step: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Score of content over boilerplate for each line."""
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.emit + self.bias

    def viterbi(self, x: np.ndarray) -> list[int]:
        """The best label sequence; ties go to content."""
        (t00, t01), (t10, t11) = self.step.tolist()
        back, s0, s1 = [], 0.0, 0.0
        for i, e in enumerate(self.emissions(x).tolist()):
            if i:
                from0, from1 = (0 if s0 + t00 > s1 + t10 else 1), (0 if s0 + t01 > s1 + t11 else 1)
                back.append((from0, from1))
                s0, s1 = max(s0 + t00, s1 + t10), max(s0 + t01, s1 + t11) + e
            else:
                s1 = e
        labels = [0 if s0 > s1 else 1]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.5) -> tuple[np.ndarray, float]:
    w, b = np.zeros(x.shape[1]), 0.0
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    for _ in range(rounds):
        wrong = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
        w -= rate * (x.T @ wrong + 1e-3 * w)
        b -= rate * wrong.sum()
    return w, b


def _of_like_length(lengths: np.ndarray) -> list[slice]:
    """The lines of runs of documents, sorted by length, that take at most CELLS padded places, or hold one document."""
    ends, first, out = np.cumsum(lengths), 0, []
    for last in range(1, len(lengths) + 1):
        if last == len(lengths) or lengths[last] * (last + 1 - first) > CELLS:
            out.append(slice(int(ends[first] - lengths[first]), int(ends[last - 1])))
            first = last
    return out


def _marginals(score: np.ndarray, document: np.ndarray, line: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of content and the expected number of each step, by forward-backward over padded documents."""
    longest, documents = int(line.max()) + 1, int(document[-1]) + 1
    inside = np.zeros((longest, documents), bool)
    inside[line, document] = True
    e = np.zeros((longest, documents, 2))
    e[line, document, 1] = score
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[0] = e[0]
    for t in range(1, longest):
        moved = np.logaddexp(forward[t - 1][:, 0:1] + step[0], forward[t - 1][:, 1:2] + step[1]) + e[t]
        forward[t] = np.where(inside[t][:, None], moved, forward[t - 1])
    total = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
    for t in range(longest - 2, -1, -1):
        ahead = backward[t + 1] + e[t + 1]
        moved = np.logaddexp(step[:, 0] + ahead[:, 0:1], step[:, 1] + ahead[:, 1:2])
        backward[t] = np.where(inside[t + 1][:, None], moved, 0.0)
    content = np.exp(forward[line, document, 1] + backward[line, document, 1] - total[document])
    pairs = forward[:-1, :, :, None] + step + (e[1:] + backward[1:])[:, :, None, :] - total[:, None, None]
    return content, np.where(inside[1:][:, :, None, None], np.exp(np.minimum(pairs, 0)), 0).sum((0, 1))


def fit_field(documents: list[np.ndarray], quality: np.ndarray, rounds: int = 100, rate: float = 0.08, decay: float = 1e-3) -> LineField:
    """Maximum conditional likelihood by forward-backward, over groups of documents of like length, padded."""
    lengths = np.array([len(d) for d in documents])
    order = np.argsort(lengths, kind="stable")
    documents, quality, lengths = [documents[i] for i in order], quality[order], lengths[order]
    x = np.concatenate(documents)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6)
    owner = np.repeat(np.arange(len(documents)), lengths)
    w, b = _logistic(z, quality[owner].astype(np.float64))
    y = np.where(quality[owner] == 1, 1, (z @ w + b > 0).astype(int))  # lines of low-quality documents that look like content stay content
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    place = np.arange(len(x)) - starts[owner]
    step = np.zeros((2, 2))
    both = owner[1:] == owner[:-1]
    seen = np.array([[(both & (y[:-1] == i) & (y[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    groups = [(owner[rows] - owner[rows.start], place[rows], rows) for rows in _of_like_length(lengths)]
    state = [np.zeros_like(q) for q in (w, step)] + [np.zeros_like(q) for q in (w, step)] + [0.0, 0.0]
    for n in range(1, rounds + 1):
        score, content, expected = z @ w + b, np.zeros(len(x)), np.zeros((2, 2))
        for document, line, rows in groups:
            content[rows], pairs = _marginals(score[rows], document, line, step)
            expected += pairs
        wrong = (content - y) / len(y)
        slopes = [z.T @ wrong + decay * w, (expected - seen) / len(y) + decay * step]
        for k, (q, g) in enumerate(zip((w, step), slopes, strict=True)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[2 + k] = 0.999 * state[2 + k] + 0.001 * g * g
            q -= rate * (state[k] / (1 - 0.9**n)) / (np.sqrt(state[2 + k] / (1 - 0.999**n)) + 1e-9)
        b -= rate * 2 * wrong.sum()
    return LineField(mean, scale, w, float(b), step)


def train_field(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, sample_values: int = SAMPLE_VALUES) -> LineField | None:
    """Fit on a labelled sample, bounded as `collected_sample` says; None (every line is content) without both labels."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(*lines_of(t or "")[:2]).ravel() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "quality", "lines"])

    sample = labelled_sample(docs, labels, sample_rows).select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int"))
    rows = collected_sample(sample.mapInArrow(encode, "doc_id long, quality int, lines array<double>"), "lines", sample_rows, sample_values)
    if len({r["quality"] for r in rows}) < 2:
        return None
    return fit_field([np.asarray(r["lines"]).reshape(-1, FEATURES) for r in rows], np.array([r["quality"] for r in rows]))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None, field: LineField | None, min_share: float) -> tuple:
    """The MEASURES of a text, base_failed, kept and content_share."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines, again, dup_lines = lines_of(text)
    n, repeats = len(words), repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    share = 0.0
    if n:
        labels = field.viterbi(line_features(lines, again)) if field else [1] * len(lines)
        share = sum(len(w) for w, k in zip(lines, labels, strict=True) if k) / n
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), dup_lines, repeats, failed, not failed and share >= min_share, share


def apply_rules(docs: DataFrame, field: LineField | None, min_share: float = 0.5) -> DataFrame:
    """Columns of `docs` without `text`'s namesakes, then MEASURES, base_failed, kept, content_share, by row.

    A null text is an empty one; a text without words fails; a text of any length is measured and decoded whole.
    Ties between label sequences go to content. Repeated rows each get a row, an empty table none, and columns of
    `docs` that are named like a result are replaced.
    """
    results = [*MEASURES, "base_failed", "kept", "content_share"]
    carried = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results])
    names = carried.columns
    at = names.index("text")
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t, field, min_share) for t in batch.column(at).to_pylist()]
            found = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(found, kinds, strict=True))], [*names, *results])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    return carried.mapInArrow(apply, schema + "".join(f", {m} long" for m in MEASURES) + ", base_failed boolean, kept boolean, content_share double")
