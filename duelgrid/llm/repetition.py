"""Quality rules on repetition: characters inside duplicated n-grams and lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.rows import map_rows

SYMBOLS = "#*$%&|<>"
#: Most share of a text's word characters that may lie in n-grams found before: by words in the n-gram.
NGRAM_LIMITS = {5: 0.20, 6: 0.19, 8: 0.17, 10: 0.15}
#: Most share that the most frequent n-gram may cover: by words in the n-gram.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: Most share of lines, and of line characters, that repeat an earlier line; most symbols a word.
LINE_LIMIT, LINE_CHAR_LIMIT, SYMBOL_LIMIT = 0.30, 0.20, 0.10
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit polynomial hashes of all windows of `width` words, over the words' own hashes."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out = out * BASE + ids[j : j + n]
    return out


def covered(hits: np.ndarray, width: int, words: int) -> np.ndarray:
    """Which words lie in a window marked in `hits`."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(hits)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares...) of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    symbols = sum(text.count(ch) for ch in SYMBOLS)
    seen: set[bytes] = set()
    lines = dup_lines = line_chars = dup_chars = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines, line_chars = lines + 1, line_chars + len(line)
            if line in seen:
                dup_lines, dup_chars = dup_lines + 1, dup_chars + len(line)
            else:
                seen.add(line)
    if not n:
        return (0, 0, symbols, dup_lines, 0, 0.0, 0.0, [0.0] * (len(NGRAM_LIMITS) + len(TOP_LIMITS)))
    number: dict[bytes, int] = {}
    order = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    sizes = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in number), np.int64, len(number))[order]
    ids = (order.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    ids ^= ids >> np.uint64(31)
    total, repeat, shares = int(sizes.sum()), 0, []
    for width in sorted({*NGRAM_LIMITS, *TOP_LIMITS}):
        windows = rolling(ids, width)
        if not len(windows):
            shares.append(0.0)
            continue
        _, first, back, times = np.unique(windows, return_index=True, return_inverse=True, return_counts=True)
        if width in TOP_LIMITS:
            often = np.flatnonzero(times == times.max())
            most = often[np.argmin(first[often])]
            hits = back == most if times[most] > 1 else np.zeros(len(windows), bool)
        else:
            hits = times[back] > 1
            if width == 5:
                repeat = int(covered(hits, width, n).sum())
            hits[first] = False
        shares.append(float(sizes[covered(hits, width, n)].sum() / total))
    return (n, total, symbols, dup_lines, repeat, dup_lines / max(lines, 1), dup_chars / max(line_chars, 1), shares)


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and repetition shares of every whole text: n_words, word_chars (code points in words), n_symbols,
    n_dup_lines, n_repeat_words (words in 5-word windows found twice or more), dup_line_share, dup_line_char_share and
    ngram_shares (by words in the n-gram, in order of NGRAM_LIMITS and TOP_LIMITS together; the duplicated n-grams'
    characters without their first occurrence, or the most frequent n-gram's, of several the one that comes first).

    Null and empty texts have zeros; repeated rows and rows of null ids are each returned; other columns are not read; an
    empty table gives no rows. Rows are measured on their own, in any partitioning, with no shuffle. Memory is
    a few arrays of a text's words. Words and windows are compared by 64-bit hashes; lines exactly.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, dup_line_char_share double, ngram_shares array<double>"
    return map_rows(rows, lambda: lambda row: [(row[0], *measure(row[1]))], schema)


def repetition_verdict() -> Column:
    """True where no share of repetition_quality is above its limit (the method's verdict)."""
    good = (F.col("dup_line_share") <= LINE_LIMIT) & (F.col("dup_line_char_share") <= LINE_CHAR_LIMIT)
    good = good & (F.col("n_symbols") <= SYMBOL_LIMIT * F.greatest(F.col("n_words"), F.lit(1)))
    for at, width in enumerate(sorted({*NGRAM_LIMITS, *TOP_LIMITS})):
        good = good & (F.element_at("ngram_shares", at + 1) <= (NGRAM_LIMITS | TOP_LIMITS)[width])
    return good
