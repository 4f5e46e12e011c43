"""Operator 3, quality rules: how far a document's character classes and common words lie from prose.

Two histograms of each text are compared, by Jensen-Shannon distance (base 2, so 0 to 1), with fixed
references: one of character classes for prose, one of common words for each language, the nearest of
which counts. Each comparison has a minimum length below which it says nothing, and a margin for the
sampling noise of short texts.

Defined results: a null, empty or white-space text has no words, fails the base rules and isn't kept.
Repeated rows and ties get equal results; extra columns, whatever their names, are never read. A text
of any length is judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Character-class proportions of prose.
CLASSES = {"lower or digit": 0.799, "upper": 0.017, "space": 0.158, "punctuation": 0.025, "symbol": 0.001}
# Each language's most common words, the most common first.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by this are at from",
    "de": "der die und in den von zu das mit sich des für auf ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"

#: A common word's share of all words falls with its rank by this power law.
FIRST_SHARE, FALL = 0.062, 0.85
MIN_CHARS, CLASS_LIMIT, CLASS_NOISE = 100, 0.125, 1.0
MIN_WORDS, WORD_LIMIT, WORD_NOISE = 100, 0.19, 1.5
MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 50, 50

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def _class_of(byte: int) -> int:
    if 0x80 <= byte < 0xC0:
        return 5  # inside a character
    c = chr(byte)
    if byte >= 0xC0 or "a" <= c <= "z" or "0" <= c <= "9":
        return 0
    if "A" <= c <= "Z":
        return 1
    if c in common.SPACE:
        return 2
    return 3 if byte in PUNCTUATION else 4


_CLASS = np.array([_class_of(b) for b in range(256)])
_SPACE = np.array([b in common.SPACE.encode() for b in range(256)])
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])
_INSIDE = np.array([0x80 <= b < 0xC0 for b in range(256)])


def _forms() -> dict[bytes, list[tuple[int, int]]]:
    """Written forms of each common word, to (language, rank) pairs."""
    out: dict[bytes, list[tuple[int, int]]] = {}
    for at, words in enumerate(COMMON.values()):
        for rank, word in enumerate(words.split()):
            for form in {word, word.capitalize()}:
                for end in ("", ".", ","):
                    out.setdefault((form + end).encode(), []).append((at, rank))
    return out


_FORMS = _forms()
_PROSE = np.array(list(CLASSES.values()))
_N = len(next(iter(COMMON.values())).split())
_SHARES = np.append(FIRST_SHARE * np.arange(1, _N + 1) ** -FALL, 0)
_SHARES[-1] = 1 - _SHARES.sum()


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of histogram q and the nearest row of p; each sums to 1."""
    p = np.atleast_2d(p)
    m = (p + q) / 2 + 1e-300
    terms = p * np.log2(p / m + 1e-300) + q * np.log2(q / m + 1e-300)
    return float(np.sqrt(max(0.0, terms.sum(axis=1).min() / 2)))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # three ids no longer fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * distinct + ids[2:]
    ordered = np.sort(triples)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    again = twice[np.minimum(np.searchsorted(twice, triples), len(twice) - 1)] == triples
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


def judge(text: str | None) -> tuple:
    """The row of SCHEMA for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    seen = dict(zip(dict.fromkeys(words), range(n)))  # noqa: B905  there are no more distinct words than words
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, n)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(by_byte[~_INSIDE].sum())
    word_chars = chars - int(by_byte[_SPACE].sum())
    lines: set[bytes] = set()
    n_dup = 0
    for line in data.split(b"\n"):
        if line in lines:
            n_dup += bool(line.strip())
        else:
            lines.add(line)
    n_repeat = repeated_words(ids, len(seen))
    failed = n < MIN_BASE_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n

    class_distance = word_distance = None
    if chars >= MIN_CHARS:
        found = np.bincount(_CLASS, by_byte, minlength=6)[:5]
        class_distance = js_distance(found / found.sum(), _PROSE)
    if n >= MIN_WORDS:
        counts = np.zeros((len(COMMON), _N + 1))
        by_word = np.bincount(ids)
        for form in _FORMS.keys() & seen.keys():
            for at, rank in _FORMS[form]:
                counts[at, rank] += by_word[seen[form]]
        counts[:, -1] = n - counts.sum(axis=1)
        word_distance = js_distance(counts / n, _SHARES)
    kept = not failed
    if class_distance is not None and class_distance > CLASS_LIMIT + CLASS_NOISE / np.sqrt(chars):
        kept = False
    if word_distance is not None and word_distance > WORD_LIMIT + WORD_NOISE / np.sqrt(n):
        kept = False
    return n, word_chars, int(by_byte[_SYMBOL].sum()), n_dup, n_repeat, failed, class_distance, word_distance, kept


def _judge_all(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    common.turn_to("rules")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for part in texts:
        yield pd.DataFrame([judge(t) for t in part], columns=names)


def judged(text: str | F.Column) -> F.Column:
    """A struct column of SCHEMA from a text column."""
    return F.pandas_udf(_judge_all, SCHEMA)(text)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text the rules keep, with the columns of docs."""
    return docs.where(judged(docs[text]).getField("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = common.documents(spark, sf_dir).select("doc_id", judged("text").alias("r"))
    return found.select("doc_id", "r.n_words", "r.word_chars", "r.n_symbols", "r.n_dup_lines", "r.n_repeat_words", "r.base_failed", "r.kept")
