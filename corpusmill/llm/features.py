"""Statistics of whole texts: shares of character classes, word shapes, repetition, lexicon hits. NumPy over Arrow batches.

Defined results: null text counts as empty; an empty text has every statistic 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .text import blocks, ranges, span_hashes, split_words

STATS = (
    "log_words", "word_bytes", "upper", "digit", "end_mark", "comma_dot", "symbol", "pipe", "other", "shouted", "capital", "odd_end",
    "short_word", "distinct", "same_next", "line_words", "same_line", "lone_symbol",
)
_B = np.arange(256)


def _class(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


_UPPER = _class(lambda b: 65 <= b <= 90)
_LETTER = _class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_LOWER = np.where(_UPPER, _B + 32, _B).astype(np.uint8)
_CLASSES = np.stack([
    _UPPER, _class(lambda b: 48 <= b <= 57), _class(lambda b: chr(b) in "!?"), _class(lambda b: chr(b) in ".,;:'\""),
    _class(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"!?|"), _class(lambda b: b == 124), _class(lambda b: b >= 128),
])
#: Characters that stand for letters in disguised words.
_DISGUISE = _LOWER.copy()
for _a, _b in zip("0134578@$!", "oieastbasi", strict=True):
    _DISGUISE[ord(_a)] = ord(_b)
_DISGUISED = _class(lambda b: chr(b) in "0134578@$!")


class Words:
    """The words of some rows: which distinct word stands at each place, and the bytes of the distinct words.

    What a word is like is found once for each distinct word of a block, then counted at its places.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, self.first = split_words(data, offsets)
        self.rows, self.per_row = len(offsets) - 1, np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.per_row)
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        self.code = np.empty(len(order), np.int64)
        self.code[order] = np.cumsum(new) - 1
        starts, size = starts[order[new]], (ends - starts)[order[new]]
        self.distinct, self.data = len(size), data[ranges(starts, size)]
        self.edges = np.concatenate([[0], np.cumsum(size)])

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Per row the sum of a value that each distinct word has."""
        return np.bincount(self.row, value[self.code], self.rows) if len(self.row) else np.zeros(self.rows)

    def share(self, value: np.ndarray) -> np.ndarray:
        return self.sums(value) / np.maximum(self.per_row, 1)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Per distinct word, how many of its bytes are flagged."""
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[self.edges[1:]] - sums[self.edges[:-1]]


def _distinct(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    """How many different codes each row has."""
    if not len(row):
        return np.zeros(rows)
    most = int(code.max()) + 1
    keys = np.sort(row * most + code)
    return np.bincount(keys[np.diff(keys, prepend=-1) != 0] // most, minlength=rows)


def text_stats(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    """Rows x STATS, and the words for further features."""
    words, size = Words(data, offsets), np.diff(offsets)
    n, row, code = len(size), words.row, words.code
    seen = np.zeros((n, 256))
    for i in range(n):
        seen[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    by_class = (seen @ _CLASSES.T) / np.maximum(size, 1)[:, None]
    length = np.diff(words.edges)
    up, letter = words.count(_UPPER[words.data]), words.count(_LETTER[words.data])
    begin, last = words.data[words.edges[:-1]], words.data[words.edges[1:] - 1]
    again = np.bincount(row[1:], (code[1:] == code[:-1]) & (row[1:] == row[:-1]), n) if len(row) > 1 else np.zeros(n)
    line_row, line_code = _lines(data, offsets)
    lines = np.bincount(line_row, minlength=n)
    some = np.maximum(words.per_row, 1)
    columns = [
        np.log1p(words.per_row), words.share(length), *by_class.T, words.share((up >= 2) & (up == letter)), words.share(_UPPER[begin]), words.share(~_LETTER[last] & ~np.isin(last, [46, 44, 59, 58])),
        words.share(length <= 3), _distinct(row, code, n) / some, again / some, words.per_row / np.maximum(lines, 1), np.where(lines > 0, 1 - _distinct(line_row, line_code, n) / np.maximum(lines, 1), 0.0), words.share(letter == 0),
    ]
    return np.stack(columns, 1).astype(np.float64), words


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of every line, and a number that equal lines share."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(data == 10) + 1
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)]]))
    end = np.concatenate([start[1:], [len(data)]])
    hashes = span_hashes(data, start, end - (data[end - 1] == 10))
    return np.searchsorted(offsets, start, "right") - 1, np.unique(hashes, return_inverse=True)[1]


LEXICON_STATS = ("hits", "density", "fixed_density", "near_you", "you", "obfuscated", "mixed", "weight", "weight_density")
#: Words that address the reader.
SECOND_PERSON = "you your yours yourself u ur du dein deine dich dir ihr euch tu toi te ton ta vous votre usted ustedes tus".split()
#: Insults that count in any corpus; fitting adds what the labels show.
INSULTS = "idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting fool jerk liar coward".split()
PREFIXES = (4, 5, 6, 7, 8, 10)


def _hash_of(words: list[str]) -> np.ndarray:
    """Hashes in the order of the words."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return span_hashes(data, edge[:-1], edge[1:])


def _weights_of(values: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The weight of each value, 0 where it isn't known."""
    keys, weights = known
    if not len(keys):
        return np.zeros(len(values))
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, weights[at], 0.0)


def _table(entries: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = _hash_of(list(entries))
    order = np.argsort(keys)
    return keys[order], np.array(list(entries.values()))[order]


class Lexicon:
    """Whole words and word beginnings (in bytes of lower-cased letters) that count as hits, with weights."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]) -> None:
        self.words, self.beginnings = words, beginnings
        self.fixed, self.you = _table(dict.fromkeys(INSULTS, 1.0)), _table(dict.fromkeys(SECOND_PERSON, 1.0))
        self.whole = _table(dict.fromkeys(INSULTS, 1.0) | words)
        by_size: dict[int, dict[str, float]] = {}
        for b, w in beginnings.items():
            by_size.setdefault(len(b.encode()), {})[b] = w
        self.starts = {k: _table(v) for k, v in by_size.items()}

    def stats(self, words: Words) -> np.ndarray:
        """Rows x LEXICON_STATS."""
        data, edges, row = words.data, words.edges, words.row
        is_letter = _LETTER[data]
        rank = np.concatenate([[0], np.cumsum(is_letter)])
        plain, a, b = _LOWER[data[is_letter]], rank[edges[:-1]], rank[edges[1:]]
        whole = span_hashes(plain, a, b)
        fixed = _weights_of(whole, self.fixed) > 0
        weight = _weights_of(whole, self.whole)
        for size, known in self.starts.items():
            long = np.flatnonzero(b - a >= size)
            weight[long] = np.maximum(weight[long], _weights_of(span_hashes(plain, a[long], a[long] + size), known))
        meant = is_letter | _DISGUISED[data]
        rank = np.concatenate([[0], np.cumsum(meant)])
        shown = _weights_of(span_hashes(_DISGUISE[data[meant]], rank[edges[:-1]], rank[edges[1:]]), self.whole)
        masked = (shown > 0) & (weight == 0)
        inner = np.concatenate([[0], np.cumsum(~is_letter)])
        odd = (inner[np.maximum(edges[1:] - 1, edges[:-1])] - inner[edges[:-1]] > 0) & (b - a >= 2)
        weight = np.maximum(weight, shown)
        hit, you = weight > 0, _weights_of(whole, self.you) > 0
        seen = np.concatenate([[0], np.cumsum(you[words.code])])
        at = np.flatnonzero(hit[words.code])
        around = seen[np.minimum(at + 6, words.first[row[at] + 1])] - seen[np.maximum(at - 5, words.first[row[at]])]
        near = np.bincount(row[at], around > 0, words.rows) / np.maximum(words.per_row, 1)
        return np.stack([words.sums(hit), words.share(hit), words.share(fixed), near, *map(words.share, (you, masked, odd)), words.sums(weight), words.share(weight)], 1)


def row_features(lexicon: Lexicon | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    stats, words = text_stats(data, offsets)
    return stats if lexicon is None else np.hstack([stats, lexicon.stats(words)])


def of_text(make, kind: T.DataType):
    """A column function of a text column: make(bytes, offsets) gives the values for a block of rows.

    Only the text goes to Python and only the values come back; the other columns of a row stay in the JVM.
    """

    @F.arrow_udf(kind)
    def values(text: pa.Array) -> pa.Array:
        made = [make(data, offsets) for _, _, data, offsets in blocks(text)]
        flat = [list(m) if getattr(m, "ndim", 1) == 2 else m for m in made]
        return pa.array([x for m in flat for x in m], to_arrow_type(kind))

    return values


def with_features(df: DataFrame, text_col: str, lexicon: Lexicon | None = None, name: str = "features") -> DataFrame:
    """df with the statistics of its texts; a column of that name is replaced."""
    return df.withColumn(name, of_text(lambda data, offsets: row_features(lexicon, data, offsets), T.ArrayType(T.DoubleType()))(F.col(text_col)))
