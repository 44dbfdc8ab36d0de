"""Surface signals of a run of words, shared by the quality classifier and the line labeller."""

from __future__ import annotations

from math import log1p
from operator import eq

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>{}[]=_~^\\@"
MARKS = b"!?"
STOPS = b".,;:"

NAMES = ("upper", "symbols", "digits", "marks", "stops", "distinct", "repeated", "word_length", "log_words")


def signals(words: list[bytes]) -> list[float]:
    """Shares of letter cases and signs, of distinct and of immediately repeated words, and lengths. No words: zeros."""
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    data = b"".join(words)
    size = len(data)
    shares = [(size - len(data.translate(None, kind))) / size for kind in (UPPER, SYMBOLS, DIGITS, MARKS, STOPS)]
    return [*shares, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, min(size / n, 30.0) / 10, log1p(n) / 5]
