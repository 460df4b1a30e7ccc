"""Quality rules by compression bands.

Zstandard ratios of the whole document and of its fixed chunks must lie between limits that depend on the
document's length: repetitive text compresses too well, random text too little.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from .common import fresh

LEVEL = 3
CHUNK = 2048
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Parameters of the bands, set once from the ratios of texts labelled as good, with a margin over the most extreme one. Largest whole-text ratio by half powers
#: of two of the UTF-8 length, from 2^8 on; shorter and longer texts take the end values.
WHOLE_MAX = (2.00, 2.00, 2.00, 2.06, 2.12, 2.20, 2.23, 2.28, 2.34, 2.40, 2.45, 2.48, 2.52, 2.56, 2.60, 2.64, 2.72)
#: Smallest whole-text ratio: below 256 bytes, below 4096 bytes, from there on.
WHOLE_MIN = (0.85, 1.15, 1.25)
#: Limits of chunks: the median's largest, any one's largest and smallest.
CHUNK_MEDIAN_MAX, CHUNK_MAX, CHUNK_MIN = 2.19, 2.60, 1.20

SCHEMA = StructType()
for _name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
    SCHEMA.add(_name, LongType())
SCHEMA.add("base_failed", BooleanType())
for _name in ("ratio", "chunk_median", "chunk_max", "chunk_min"):
    SCHEMA.add(_name, DoubleType())
SCHEMA.add("reason", StringType()).add("kept", BooleanType())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # splits at exactly \x20 and \x09-\x0D
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    grams = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(grams)) < len(grams):
        seen, end = Counter(grams), 0
        for i, gram in enumerate(grams):
            if seen[gram] > 1:
                repeat += i + 3 - max(end, i)
                end = i + 3
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def band_limits(size: int) -> tuple[float, float]:
    """Smallest and largest whole-text ratio for a text of ``size`` bytes."""
    at = min(max(int(2 * math.log2(max(size, 1))) - 16, 0), len(WHOLE_MAX) - 1)
    return WHOLE_MIN[(size >= 256) + (size >= 4096)], WHOLE_MAX[at]


def chunk_starts(size: int) -> list[int]:
    """Chunks follow one another from the start; bytes left over at the end are judged with those before them, in a last chunk that ends where the text ends.

    A text of less than a chunk has none: the limits of the whole text, which go by its length, judge all of it.
    """
    starts = list(range(0, size - CHUNK + 1, CHUNK))
    return starts + [size - CHUNK] if starts and size % CHUNK else starts


def judge(text: str | None, zip_: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    n_words, chars, symbols, dup, repeat = base_counts(text)
    failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words
    data = text.encode("utf-8", "surrogatepass")
    ratio = len(data) / len(zip_.compress(data)) if data else None
    chunks = [CHUNK / len(zip_.compress(data[i : i + CHUNK])) for i in chunk_starts(len(data))]
    middle, top, bottom = (median(chunks), max(chunks), min(chunks)) if chunks else (None, None, None)
    least, most = band_limits(len(data))
    reason = None
    if failed:
        reason = "base"
    elif ratio > most:
        reason = "repetitive"
    elif ratio < least:
        reason = "incompressible"
    elif chunks and (middle > CHUNK_MEDIAN_MAX or top > CHUNK_MAX):
        reason = "repetitive chunk"
    elif chunks and bottom < CHUNK_MIN:
        reason = "incompressible chunk"
    return n_words, chars, symbols, dup, repeat, failed, ratio, middle, top, bottom, reason, reason is None


def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    zip_ = zstandard.ZstdCompressor(level=LEVEL)
    for texts in batches:
        yield pd.DataFrame([judge(t, zip_) for t in texts], columns=SCHEMA.names)


_scored = F.pandas_udf(_score, SCHEMA)


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``quality``: counts, ratios, the reason of a rejection and ``kept``. A column of that name that came in is replaced; all others pass through.

    A null text counts as an empty one, which fails the base rules; chunk figures are null below one whole chunk. Texts of any length are judged whole.
    Every row is judged by itself, so repeated rows get equal verdicts and an empty table gives no rows.
    """
    return docs.withColumn("quality", _scored(F.col(text_col)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns that came in, whatever their names. Null and empty texts go; repeated rows share a verdict."""
    kept = fresh(docs, "kept")
    return docs.withColumn(kept, _scored(F.col("text"))["kept"]).where(F.col(kept)).drop(kept)
