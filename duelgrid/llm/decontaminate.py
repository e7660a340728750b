"""Benchmark decontamination: exact piece hits by pigeonhole, verified with Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.rows import map_rows, share, shared

#: Characters of benchmark text matched in one pass; a larger benchmark is matched in several passes over the documents.
#: An automaton of a full block takes about 190 MB of a Python worker (45 MB for a million characters).
BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """Lower case, with every run of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> Iterator[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of near equal length, of which one is untouched by `budget` edits."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return ((a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a)


def best_occurrence(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the occurrence of `pattern` in `text` with the fewest edits, the first such; None over budget.

    Myers' bit-vector recurrence for approximate search: one column of vertical differences a character of text.
    """
    size = len(pattern)
    where: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | (1 << i)
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = budget + 1, -1
    for at, ch in enumerate(text):
        equal = where.get(ch, 0)
        carry = (((equal & plus) + plus) ^ plus) | equal | minus
        grow = minus | (full & ~(carry | plus))
        fall = plus & carry
        if grow & top:
            score += 1
        elif fall & top:
            score -= 1
        grow = (grow << 1) & full
        plus = ((fall << 1) & full) | (full & ~((equal | minus) | grow))
        minus = grow & (equal | minus)
        if score < best:
            best, end = score, at + 1
    return (best, end) if best <= budget else None


def whole_words(item: str, text: str, end: int) -> bool:
    """Whether the occurrence of `item` that ends at `end` of the text neither begins nor ends inside a word."""
    first, last = end - len(item), end - 1
    opens = first == 0 or not (text[first].isalnum() and text[first - 1].isalnum())
    return opens and (end == len(text) or not (text[last].isalnum() and text[end].isalnum()))


def _matcher(items: list[tuple], share: float, least: int, short: bool = False):
    """A function of (id, text) that gives (id, item, distance, budget, end) for each item found in the text.

    With `short`, items under `least` characters are searched too: unchanged, as whole words.
    """
    known: list[tuple] = []
    ends: dict[str, list[tuple[int, int]]] = {}
    for item_id, item in items:
        if len(item) >= least or short and item:
            budget = int(len(item) * share) if len(item) >= least else 0
            for offset, piece in pieces(item, budget):
                ends.setdefault(piece, []).append((len(known), offset + len(piece)))
            known.append((item_id, item, budget))
    if not known:
        return lambda row: []
    automaton = ahocorasick.Automaton()
    for piece, uses in ends.items():
        automaton.add_word(piece, uses)
    automaton.make_automaton()

    def work(row: tuple) -> list[tuple]:
        text, spans, exact = normalise(row[1]), {}, {}
        for last, uses in automaton.iter(text):
            for n, end in uses:
                item, budget = known[n][1:]
                if len(item) < least:
                    if n not in exact and whole_words(item, text, last + 1):
                        exact[n] = last + 1
                    continue
                # where the item would begin, give or take the budget
                begin = last + 1 - end
                low, high = max(0, begin - budget), begin + len(item) + budget
                held = spans.setdefault(n, [])
                if held and low <= held[-1][1]:
                    held[-1][0], held[-1][1] = min(low, held[-1][0]), max(high, held[-1][1])
                else:
                    held.append([low, high])
        out = [(row[0], known[n][0], 0, 0, end) for n, end in exact.items()]
        for n, held in spans.items():
            item_id, item, budget = known[n]
            hits = [(d[0], low + d[1]) for low, high in held if (d := best_occurrence(item, text[low:high], budget))]
            if hits:
                distance, end = min(hits)
                out.append((row[0], item_id, distance, budget, end))
        return out

    return work


class Block:
    """Items that travel to the executors together. A worker builds their automaton once and keeps it for its later tasks."""

    def __init__(self, items: list[tuple], share: float, least: int, short: bool):
        self.items, self.share, self.least, self.short, self.built = items, share, least, short, None

    def matcher(self):
        if self.built is None:
            self.built = _matcher(self.items, self.share, self.least, self.short)
        return self.built


def find_benchmark(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.06, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, short_items: bool = False) -> DataFrame:
    """(id, item id, distance, budget, end): documents that hold a benchmark item within the edit budget.

    Texts are compared lower-cased with white space collapsed. An item of L characters may differ by floor(L x
    edit_share) edits; it is cut into one piece more than that, so every occurrence within budget holds one piece
    unchanged. Piece hits come from one Aho-Corasick pass over each whole text; overlapping windows around the hits are
    merged and verified. `end` is the end in the normalised text of the best occurrence. Items under `min_chars`
    characters are searched with `short_items` only: unchanged, as whole words. Null and empty items aren't searched.
    Null texts match nothing. One row a document and item; repeated rows of a document are each searched. A benchmark
    over `block_chars` characters is searched in blocks, each broadcast on its own. Blocks hold distinct item texts, and
    the ids of an item's text are joined to what was found, so what travels to the executors is bounded at any
    benchmark size, however often a text is repeated. Empty tables give no rows; other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_words")).where(F.col("_words").isNotNull())
    items = items.withColumn("_key", F.md5("_words"))
    texts = items.select("_key", "_words").distinct()
    chars = texts.agg(F.sum(F.length("_words"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    found = None
    for block in range(blocks):
        chosen = texts.where(F.pmod(F.xxhash64("_words"), F.lit(blocks)) == block).collect()
        held = share(docs.sparkSession, Block([(r["_key"], normalise(r["_words"])) for r in chosen], edit_share, min_chars, short_items))
        part = map_rows(rows, lambda held=held: shared(held).matcher(), f"_id {kind}, _found string, distance int, budget int, end int")
        found = part if found is None else found.unionByName(part)
    met = found.join(items.select("_item", "_key"), F.col("_found") == F.col("_key"))
    return met.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "distance", "budget", "end")
