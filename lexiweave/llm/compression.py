"""Quality rules: compression bands (operator 11).

A text is compressed as a whole and in fixed chunks with zstandard, and the
ratio of compressed to plain bytes is held against a band that depends on the
length: text below its band repeats itself, text above it is noise (encoded
data, random strings). The shorter a text, the less a compressor finds in it,
so bands fall with length; below ``BANDS[0]`` bytes a ratio says nothing and
no text is judged. A text is rejected if its whole lies outside its band, or if
the chunks outside theirs hold more than ``most_odd`` of its bytes, which finds
junk in a part that the rest of a long text would hide.

Before that come plain rules on counts: too few words, or too many words in
windows of five words that the text holds more than once. Windows are compared
exactly: words are numbered by a dictionary, pairs of numbers again.

Defined results
* null or empty text: no words, all counts 0, no ratio (null); fails by words
* words are runs of other than ASCII white space; a line counts as repeated if
  it has a word and equals an earlier line of the text
* ratios depend on the compressor's level (a parameter) and on its release
* each row gives a row, repeated ones too; null ids stay null; other columns
  are never read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.common import small_batches
from lexiweave.llm.vector import Words

# From so many bytes on: the least and the greatest ratio of a usual text.
BANDS = (
    (128, 0.35, 1.10), (256, 0.30, 0.95), (512, 0.26, 0.85), (1024, 0.23, 0.76), (2048, 0.20, 0.72),
    (4096, 0.18, 0.68), (8192, 0.16, 0.66), (32768, 0.14, 0.64),
)
LEVEL = 3
CHUNK = 4096
MOST_ODD = 0.25
MIN_WORDS = 10
REPEAT_WINDOW = 5
MOST_REPEATED = 20
SYMBOLS = b"#*$%&|<>"
SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
BLANK = b" \t\n\x0b\x0c\r"
#: Texts are counted so many bytes at a time, a longer one by itself.
PART = 250_000
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, odd_share double, base_failed boolean, kept boolean"


def chunk_spans(size: int, chunk: int) -> list[tuple[int, int]]:
    """Fixed chunks; a rest of less than half a chunk belongs to the last one."""
    n = max(1, (size + chunk // 2) // chunk)
    return [(i * chunk, size if i == n - 1 else (i + 1) * chunk) for i in range(n)]


def outside(ratio: float, size: int, bands=BANDS) -> bool:
    """Whether a ratio lies outside the band of texts of that size."""
    band = next((b for b in reversed(bands) if size >= b[0]), None)
    return band is not None and not band[1] <= ratio <= band[2]


def compression(data: bytes, compress, chunk: int = CHUNK, bands=BANDS) -> tuple[float, float]:
    """The ratio of a text and the share of its bytes in chunks outside their bands."""
    ratio = len(compress(data)) / len(data)
    odd = 0
    for a, b in chunk_spans(len(data), chunk):
        whole = b - a == len(data)
        odd += (b - a) * outside(ratio if whole else len(compress(data[a:b])) / (b - a), b - a, bands)
    return ratio, odd / len(data)


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same number for equal pairs, another for others; both are below 2**31."""
    return pa.array(a.astype(np.int64) << 31 | b).dictionary_encode().indices.to_numpy()


def repeated_words(words: Words, n: int = REPEAT_WINDOW) -> np.ndarray:
    """For each word, whether it stands in a window of n words that its text holds twice or more."""
    count = len(words.start)
    marks = np.zeros(count + 1, np.int64)
    if count < n:
        return marks[:-1] > 0
    length = words.end - words.start
    offsets = np.zeros(count + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    letters = np.ascontiguousarray(words.data[np.cumsum(inside[:-1], dtype=np.int8) > 0])
    names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    gram = number = names.dictionary_encode().indices.to_numpy()
    for j in range(1, n):
        gram = numbered(gram[: count - j], number[j:])
    text = np.searchsorted(words.first, np.arange(count), side="right") - 1
    whole = np.flatnonzero(text[: count - n + 1] == text[n - 1 :])
    key = numbered(gram[whole], text[whole])
    twice = whole[np.bincount(key)[key] > 1] if len(key) else whole
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + n, -1)
    return np.cumsum(marks[:-1]) > 0


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols and n_repeat_words of each text."""
    words = Words(texts)
    sizes = texts.cast(pa.large_string()).cast(pa.large_binary())
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    ends = ends - ends[0]
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    symbols = upto(SYMBOL[words.data])[ends]
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    points = upto((np.cumsum(inside[:-1], dtype=np.int8) > 0) & (words.data & 0xC0 != 0x80))[ends]
    repeated = upto(repeated_words(words))[words.first]
    return {"n_words": np.diff(words.first), "word_chars": np.diff(points), "n_symbols": np.diff(symbols), "n_repeat_words": np.diff(repeated)}


def repeated_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def parts(texts: pa.Array, most: int = PART) -> Iterator[pa.Array]:
    """Slices of so many bytes at most, or of one text."""
    sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
    at = size = 0
    for i, n in enumerate(sizes):
        if i > at and size + n > most:
            yield texts.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield texts.slice(at)


def _judging(chunk: int, bands, level: int, most_odd: float, min_words: int, most_repeated: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            at = 0
            for texts in parts(batch.column(1).cast(pa.large_string())):
                found = counts(texts)
                data = texts.cast(pa.large_binary()).to_pylist()
                lines = np.array([repeated_lines(x) for x in data], np.int64)
                bytewise = [compression(x, compress, chunk, bands) if x else (None, 0.0) for x in data]
                failed = (found["n_words"] < min_words) | (100 * found["n_repeat_words"] > most_repeated * found["n_words"])
                fits = np.array([not x or not (outside(ratio, len(x), bands) or odd > most_odd) for x, (ratio, odd) in zip(data, bytewise, strict=True)], bool)
                longs = [pa.array(found[c], pa.int64()) for c in ("n_words", "word_chars", "n_symbols")]
                longs += [pa.array(lines), pa.array(found["n_repeat_words"], pa.int64())]
                ratios = [pa.array([x[j] for x in bytewise], pa.float64()) for j in (0, 1)]
                columns = [batch.column(0).slice(at, len(texts)), *longs, *ratios, pa.array(failed), pa.array(fits & ~failed)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])
                at += len(texts)

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, bands=BANDS, level: int = LEVEL, most_odd: float = MOST_ODD, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """A row for each row: doc_id, the counts, ratio, odd_share (bytes in chunks outside their bands), base_failed, kept."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_judging(chunk, bands, level, most_odd, min_words, most_repeated), SCHEMA)
