"""Language identification by compression with per-language zstandard dictionaries.

A raw-content dictionary of each language is a bounded sample of its training
texts, with pieces from all over each of them.  A text is compressed with every
dictionary, piece by piece, over its whole length; the language whose dictionary
gives the fewest bytes wins.  A larger dictionary saves more bytes in any
language, so dictionaries are compared at equal size: the largest first, then each
smaller one, whole, against the winner so far with its dictionary cut to the same
size.  A small dictionary is weak evidence and has to win by the more, the smaller
it is (BAR, nothing at DICTIONARY_CHARS).  So a rare language takes nothing from the
dictionaries of others.  A
narrow margin is a rejection: the column ``accepted`` is false, while the
nearest language stays named.  Letters alone are compressed, in lower case:
marks, digits and shouting tell no language.

Cases: a null text or one without a letter is ``und`` with score 0; without
any training text every text is ``und``; ties go to the language with more
training rows, then to the first in text order; repeated rows give repeated rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_TEXTS = 192               # texts of a language's sample at most: the dictionary fit's bound
SAMPLE_CHARS = 1_000             # characters taken of each of them
SAMPLE_PIECES = 5                # in so many pieces spread over the text
DICTIONARY_CHARS = 160_000       # a dictionary has this size at most
BAR = 0.01                       # relative bytes by which a dictionary of a quarter of DICTIONARY_CHARS has to win
PIECE_BYTES = 2_048              # a text is compressed in pieces of this size
LEVEL = 3
MARGIN = 0.01                    # accepted: the runner-up needs at least this share more bytes
SHARPNESS = 60.0                 # turns relative sizes into a score


def letters(text: Column) -> Column:
    """The letters of a text in lower case, all else between them as one space."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language from the rows of ``train`` with text and language.

    Rows are drawn by the hash of their key: the smallest of each of
    SAMPLE_TEXTS buckets, so the sample is bounded, spread over the table and
    the same in each run.  The first pass reads keys and languages only.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    keyed = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    drawn = keyed.groupBy(F.col(lang).alias("_l"), F.pmod(h, F.lit(SAMPLE_TEXTS)).alias("_b")).agg(F.min(h).alias("_h"), F.count(F.lit(1)).alias("_n")).collect()
    if not drawn:
        return {}
    rows: dict[str, int] = {}
    for r in drawn:
        rows[r["_l"]] = rows.get(r["_l"], 0) + r["_n"]
    wanted = F.broadcast(train.sparkSession.createDataFrame([(r["_l"], r["_h"]) for r in drawn], "_l string, _h long"))
    piece, n = SAMPLE_CHARS // SAMPLE_PIECES, F.length("_t")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PIECES - 1)), lambda i: F.substring(
        F.col("_t"), (F.lit(1) + F.floor(i * (n - piece) / (SAMPLE_PIECES - 1))).cast("int"), F.lit(piece))), " ")
    texts = (keyed.select(F.col(lang).alias("_l"), h.alias("_h"), F.col(text).alias("_t")).join(wanted, ["_l", "_h"], "left_semi")
             .withColumn("_t", letters(F.col("_t"))).withColumn("_t", F.when(n > SAMPLE_CHARS, spread).otherwise(F.col("_t")))
             .groupBy("_l", "_h").agg(F.min("_t").alias("_t")))
    found: dict[str, list] = {}
    for row in texts.collect():                          # at most SAMPLE_TEXTS short texts a language
        found.setdefault(row["_l"], []).append((row["_h"], row["_t"]))
    return {k: "\n".join(t for _, t in sorted(found[k]))[:DICTIONARY_CHARS].encode() for k in sorted(found, key=lambda k: (-rows[k], k))}


def rounds(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[int, list[int]]]:
    """(size, languages by place) from the largest size down; a size is in characters."""
    found: dict[int, list[int]] = {}
    for i, (_, blob) in enumerate(dictionaries):
        found.setdefault(max(1, len(blob.decode("utf-8", "ignore"))), []).append(i)
    return sorted(found.items(), reverse=True)


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    """A function that gives the compressor of a language, by place, with its dictionary cut to a size."""
    import zstandard as zstd

    @lru_cache(maxsize=None)
    def compressor(i: int, size: int):
        d = zstd.ZstdCompressionDict(dictionaries[i][1].decode("utf-8", "ignore")[:size].encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    return compressor


def sizes(raw: bytes, compressors: list) -> list[int]:
    """Compressed bytes of a whole text under each dictionary."""
    pieces = [raw[i:i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors]


def log_sizes(raw: bytes, order: list[tuple[int, list[int]]], compressor) -> np.ndarray:
    """Logarithms of the compressed bytes by language, each relative to the winner of the rounds before its own."""
    out = np.full(sum(len(new) for _, new in order), np.inf)
    for k, (size, new) in enumerate(order):
        n = np.log(sizes(raw, [compressor(i, size) for i in new]))
        if k:
            best = int(out.argmin())
            n += out[best] - np.log(sizes(raw, [compressor(best, size)])[0]) + BAR * (np.sqrt(DICTIONARY_CHARS / size) - 1)
        out[new] = n
    return out


def classify(df: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, accepted, margin) of every row by its whole text."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in shared.value]
        compressor, order = _compressors(shared.value), rounds(shared.value)
        for batch in batches:
            pred, score, accepted, margin = [], [], [], []
            for t, letter in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes() if letter and names else b""
                if not raw:
                    pred.append("und"), score.append(0.0), accepted.append(False), margin.append(0.0)
                    continue
                n = log_sizes(raw, order, compressor)
                best = int(n.argmin())
                share = np.expm1(n - n[best])
                second = float(np.delete(share, best).min()) if len(share) > 1 else 1.0
                # short texts carry little evidence: relative sizes count less
                weight = SHARPNESS * len(raw) / (len(raw) + 100)
                pred.append(names[best])
                score.append(float(1 / np.exp(-weight * share).sum()))
                accepted.append(second >= MARGIN)
                margin.append(second)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_()), pa.array(margin, pa.float64())],
                                             [key, "lang_pred", "score", "accepted", "margin"])

    return (df.select(F.col(key), letters(F.col(text)).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
            .mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, lang_pred string, score double, accepted boolean, margin double"))
