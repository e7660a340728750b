"""Language identification with bit-sliced Bloom filters that give the languages holding each n-gram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.rows import share, shared

#: Bytes of an n-gram, slots of the filters (one byte of language bits in each plane), and hash functions.
GRAM, SLOT_BITS, HASHES = 4, 20, 3
#: Odd multipliers of the hash functions.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
#: Languages of a bit plane: one byte a slot.
PLANE = 8
UNKNOWN = "und"
#: ASCII letters lower-cased, every other ASCII byte a space; bytes of longer characters stay.
LETTERS = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else (b if b >= 128 else 32) for b in range(256))


def grams(text: str) -> np.ndarray:
    """The 4-byte grams (32-bit codes) of the text's letters with single spaces around words; repeats included."""
    body = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()) + b" "
    data = np.frombuffer(body, np.uint8).astype(np.uint32)
    if len(data) < GRAM:
        return np.empty(0, np.uint32)
    return data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)


def has_letter(text: str) -> bool:
    return any(ch.isalpha() for ch in text)


def slots(codes: np.ndarray, which: int) -> np.ndarray:
    mixed = codes ^ (codes >> np.uint32(15))
    mixed = mixed * np.uint32(MULTIPLIERS[which])
    mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(MULTIPLIERS[(which + 1) % 4])
    return mixed >> np.uint32(32 - SLOT_BITS)


def _gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, docs): documents of a language that hold a gram, summed within a batch before they are shuffled."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs = part.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, part.num_rows, 2048):
                held: dict[int, list[np.ndarray]] = {}
                for lang, text in zip(langs[at : at + 2048], part.column(1).slice(at, 2048)):
                    held.setdefault(int(lang), []).append(np.unique(grams(text.as_py() or "")))
                for lang, found in held.items():
                    codes, docs = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), lang, np.int32)), pa.array(codes.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["lang", "gram", "docs"])

    return texts.mapInArrow(work, "lang int, gram bigint, docs bigint")


class LanguageFilters:
    """The learned filters: names of the languages, bit planes (a byte of 8 languages' bits a slot), fill of each language."""

    def __init__(self, langs: list[str], planes: np.ndarray):
        self.langs, self.planes = langs, planes
        fill = np.array([np.mean((planes[i // PLANE] >> (i % PLANE)) & 1) for i in range(len(langs))])
        self.false_rate = fill**HASHES

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the corrected counts); a text without letters is UNKNOWN with score 0."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        codes = grams(text)
        places = [slots(codes, which) for which in range(HASHES)]
        hits = np.zeros(PLANE * len(self.planes))
        for number, plane in enumerate(self.planes):
            masks = plane[places[0]]
            for place in places[1:]:
                masks = masks & plane[place]
            hits[PLANE * number : PLANE * (number + 1)] = _HELD @ np.bincount(masks, minlength=1 << PLANE)
        hits = hits[: len(self.langs)]
        # of n grams, a filter passes its own and a known share of the others
        true = np.clip((hits - len(codes) * self.false_rate) / (1 - self.false_rate), 0, None)
        if not true.sum():
            return self.langs[int(np.argmax(hits))], 1 / len(self.langs)
        best = int(np.argmax(true))
        return self.langs[best], float(true[best] / true.sum())


#: [language bit, mask]: whether the mask holds the bit.
_HELD = (np.arange(1 << PLANE) >> np.arange(PLANE)[:, None]) & 1


def fit_filters(docs: DataFrame, train: Column, min_share: float = 0.004, min_ratio: float = 0.35, text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Learn the filters from all rows for which `train` holds and the language isn't null.

    A gram enters the filter of a language if at least `min_share` of the language's documents hold it and that share
    is at least `min_ratio` of its share in any other language. With D grams a document, at most D / min_share grams
    enter, whatever the corpus; only the filters reach the driver: 2 ** SLOT_BITS bytes for every 8 languages.
    Languages are numbered by their names. No rows, or no language, give filters without languages; null texts hold no
    gram; other columns are not read.
    """
    rows = docs.where(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    planes = np.zeros((-(-len(langs) // PLANE), 1 << SLOT_BITS), np.uint8)
    if not langs:
        return LanguageFilters([], planes)
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("_lang")).cast("int") - 1
    size = F.element_at(F.array(*(F.lit(float(sizes[lang])) for lang in langs)), F.col("lang") + 1)
    counted = _gram_counts(rows.select(number.alias("lang"), "_text")).groupBy("gram", "lang").agg(F.sum("docs").alias("docs"))
    shares = counted.select("gram", "lang", (F.col("docs") / size).alias("share")).where(F.col("share") >= min_share)
    # one entry a language, so the list of a gram is short
    by_gram = shares.groupBy("gram").agg(F.max("share").alias("_most"), F.collect_list(F.struct("lang", "share")).alias("_all"))
    held = by_gram.select("gram", "_most", F.explode("_all").alias("_one")).where(F.col("_one.share") >= min_ratio * F.col("_most"))
    chosen = held.groupBy("gram", F.expr(f"_one.lang div {PLANE}").cast("int").alias("plane")).agg(F.bit_or(F.expr(f"shiftleft(1, _one.lang % {PLANE})")).alias("mask"))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            codes = part.column(0).to_numpy().astype(np.uint32)
            for which in range(HASHES):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(slots(codes, which).astype(np.int32)), part.column(2)], names=["plane", "slot", "mask"])

    placed = chosen.mapInArrow(place, "plane int, slot int, mask int").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    planes[placed["plane"].to_numpy(), placed["slot"].to_numpy()] = placed["mask"].to_numpy().astype(np.uint8)
    return LanguageFilters(langs, planes)


def predict_language(docs: DataFrame, filters: LanguageFilters, carry: list[Column] | None = None, text_col: str = "text") -> DataFrame:
    """The `carry` columns with lang_pred and score of every whole text. The filters (1 MB for 8 languages) are broadcast.

    Null, empty and letterless texts are UNKNOWN with score 0; repeated rows are each returned; an empty table gives no
    rows. Columns to carry must not be named lang_pred, score or _text: rename them, or carry them in a struct.
    """
    held = share(docs.sparkSession, filters)
    rows = docs.select(*(carry or []), F.col(text_col).alias("_text"))
    kept = rows.drop("_text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string", "score double"])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(held)
        for part in parts:
            found = [model.predict(t.as_py()) for t in part.column(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(work, schema)
