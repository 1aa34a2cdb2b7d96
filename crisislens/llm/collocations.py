"""Phrase collocation mining by direct-address tiles.

Phrases are runs of words within a piece of text; a piece ends at a punctuation
mark or a line end.  All counts are per language.

1. Words are counted.  The RANKED most frequent ones get dense ids, ranked by
   frequency within their language; the others keep the 64-bit hash they have.
2. Pairs of neighbours are counted in tiles of 256 by 256 ids.  A task counts the
   DENSE_TILES tiles that expect the most pairs by direct address, in arrays
   filled by ``numpy.bincount``; pairs of all other tiles, and of words without an
   id, are sorted into coordinate lists (COO) a buffer at a time.  Both leave the
   task as counted pairs, which Spark adds up.
3. The frequent pairs are ranked like the words, and pairs of a pair and the word
   behind it are counted the same way, and so on up to ``max_words``.  A phrase is
   counted only where both its parts of one word less are frequent; a table of
   fixed size (MARK_BITS) says so, and when it errs a phrase more is counted.
4. A phrase is cut in two where the score a * a / (l * r) is least, with exact
   integers.  Phrases that a longer one mostly explains are dropped, and the best
   of each language stay.

Ids, tiles and tables have fixed sizes; a larger corpus only has more pairs
outside dense tiles.  Joins on a word or pair split at the ranks: what may be a hot
key has a rank and comes from a small table, all else is infrequent.  Words and
phrases are told apart by 64-bit hashes, pairs to be counted by two of them.

Cases: a null text counts as empty, a null language as UNKNOWN; a text of any
length is taken whole, and a very long one is worked on in parts that end at a
piece's end; repeated rows count each; equal scores go by the number of phrases,
then by the phrase in byte order; extra columns are left out; an empty table, or
one without a frequent phrase, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .buffers import CHUNK_BYTES, mix, runs, slices, span_hash
from .packed import flagged, slot_bitmap
from .stored import stored

UNKNOWN = "und"
RANKED = 1 << 16                 # symbols of each level with a dense id, over all languages
TILE_BITS = 8                    # a tile is so many bits of ids wide and high
DENSE_TILES = 256                # tiles that a task counts by direct address (4 bytes a cell, 64 MB)
BUFFER = 1 << 21                 # occurrences held before they are counted
MARK_BITS = 26                   # slots of the table of frequent symbols (8 MB)
LEVELS = 16                      # steps of a doubling when the rank limit is found
SALTS = 64                       # parts of a language that are ranked apart first

# Bytes that end a piece, and that part words within it.
ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_WORD = ~_END
_WORD[list(GAPS)] = False
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def phrase_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its words but the last and of its last word."""
    return mix(left * _A + mix(right * _B + _A))


@dataclass
class Words:
    """The words of some texts: their hashes, their places, and how many words follow within the piece."""

    raw: np.ndarray              # lower case
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    follow: np.ndarray


def find_words(raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> Words:
    """``langs`` has the language key of each text."""
    raw = _LOWER[raw]
    start, end = runs(_WORD[raw], offsets[:-1][offsets[:-1] < len(raw)])
    row = np.searchsorted(offsets, start, "right") - 1
    key = mix(span_hash(raw, start, end) ^ langs[row])
    n = len(start)
    # a piece ends with its text or at an end mark
    piece = np.cumsum(_END[raw], dtype=np.int32)[start] if n else np.zeros(0, np.int32)
    last = np.ones(n, bool)
    last[:-1] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
    stop = np.flatnonzero(last)
    follow = np.repeat(stop, np.diff(np.concatenate(([-1], stop)))) - np.arange(n)
    return Words(raw, row, start, end, key, follow)


def _parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text, cut behind end marks."""
    a, n = 0, len(raw)
    while a < n:
        b = min(n, a + CHUNK_BYTES)
        while b < n:
            near = np.flatnonzero(_END[raw[b:b + CHUNK_BYTES]])
            if len(near):
                b += int(near[0]) + 1
                break
            b = min(n, b + CHUNK_BYTES)
        yield raw[a:b]
        a = b


def each_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Words]]:
    """(language of each text, words) over batches with the columns _lang and _text."""
    known: dict[str, int] = {}
    for batch in batches:
        for part, raw, offsets in slices(batch, "_text"):
            langs = part.column(0).to_pylist()
            for x in set(langs) - known.keys():
                known[x] = lang_key(x)
            keys = np.array([known[x] for x in langs], np.uint64)
            if len(langs) == 1 and len(raw) > 2 * CHUNK_BYTES:
                for piece in _parts(raw):
                    yield langs, find_words(piece, np.array([0, len(piece)]), keys)
            else:
                yield langs, find_words(raw, offsets, keys)


def texts_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("_lang"), F.col(text).alias("_text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, key, word, n) of every word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, w in each_words(batches):
            if not len(w.key):
                continue
            order = np.argsort(w.key, kind="stable")
            key = w.key[order]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            at = order[heads]
            whole = w.raw.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([langs[i] for i in w.row[at].tolist()], pa.string()), pa.array(key[heads].view(np.int64)),
                pa.array([whole[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], pa.string()),
                pa.array(np.diff(np.append(heads, len(key))), pa.int64())], ["lang", "key", "word", "n"])

    return texts.mapInArrow(work, "lang string, key long, word string, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))


def most_frequent(level: DataFrame) -> DataFrame:
    """The rows of a level that get an id: RANKED at most, found by a histogram of counts."""
    by = level.groupBy(F.floor(F.log2("n") * LEVELS).cast("int").alias("l")).agg(F.count(F.lit(1)).alias("c")).collect()   # LEVELS * 63 rows at most
    least, total = None, 0
    for r in sorted(by, key=lambda r: -r["l"]):
        total += r["c"]
        if total > RANKED:
            break
        least = r["l"]
    return level.where(F.lit(False)) if least is None else level.where(F.floor(F.log2("n") * LEVELS) >= least)


@dataclass
class Ranks:
    """Dense ids of the most frequent symbols, contiguous in each language and ranked by frequency there."""

    key: np.ndarray              # by id
    lang: np.ndarray
    n: np.ndarray
    sorted_key: np.ndarray
    sorted_id: np.ndarray

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Ids, -1 without one."""
        if not len(self.key):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.sorted_key, keys), len(self.key) - 1)
        return np.where(self.sorted_key[at] == keys, self.sorted_id[at], np.int32(-1))


def rank(frequent: DataFrame) -> Ranks:
    """``frequent`` has RANKED rows (lang, key, n) at most."""
    t = frequent.select("lang", "key", "n").toArrow()
    key, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
    names, lang = np.unique(np.array(t.column("lang").to_pylist(), str), return_inverse=True)
    order = np.lexsort((key, -n, lang))
    key, n, lang = key[order], n[order], names[lang[order]]
    by = np.argsort(key)
    return Ranks(key, lang, n, key[by], by.astype(np.int32))


def dense_tiles(left: Ranks, right: Ranks) -> np.ndarray:
    """The slot of each tile (left block, right block), -1 for sparse ones: dense are those that expect the most pairs."""
    side = RANKED >> TILE_BITS
    mass = np.zeros((side, side))
    for lang in np.intersect1d(left.lang, right.lang):
        sums = []
        for r in (left, right):
            mine = np.flatnonzero(r.lang == lang)
            lo, hi = mine[0] >> TILE_BITS, (mine[-1] >> TILE_BITS) + 1
            sums.append((lo, hi, np.bincount((mine >> TILE_BITS) - lo, r.n[mine])))
        (a, b, x), (c, d, y) = sums
        mass[a:b, c:d] += np.outer(x, y) / y.sum()
    slots = np.full(side * side, -1, np.int16)
    best = np.argsort(-mass.ravel(), kind="stable")[:DENSE_TILES]
    best = best[mass.ravel()[best] > 0]
    slots[best] = np.arange(len(best))
    return slots


class Tiles:
    """Counts of (left, right) pairs of one task: dense tiles by direct address, all others as sorted COO."""

    def __init__(self, left: Ranks, right: Ranks, slots: np.ndarray):
        self.left, self.right, self.slots = left, right, slots
        self.dense = np.flatnonzero(slots >= 0)[np.argsort(slots[slots >= 0])]
        self.cells = np.zeros((len(self.dense), 1 << 2 * TILE_BITS), np.uint32)
        self.near: list[np.ndarray] = []
        self.far: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = [0, 0]

    def add(self, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = self.left.ids(left), self.right.ids(right)
        slot = np.where((i >= 0) & (j >= 0), self.slots[(i >> TILE_BITS) * (RANKED >> TILE_BITS) + (j >> TILE_BITS)], -1).astype(np.int64)
        on, low = slot >= 0, (1 << TILE_BITS) - 1
        self.near.append(slot[on] << 2 * TILE_BITS | (i[on] & low) << TILE_BITS | j[on] & low)
        self.far.append((left[~on], right[~on]))
        self.held[0] += len(self.near[-1])
        self.held[1] += len(self.far[-1][0])
        if self.held[0] > BUFFER:
            self._fold()
        if self.held[1] > BUFFER:
            yield from self._coordinates()

    def _fold(self) -> None:
        """Buffered pairs of dense tiles into their tiles."""
        at = np.sort(np.concatenate(self.near))
        self.near, self.held[0] = [], 0
        bounds = np.searchsorted(at, np.arange(len(self.dense) + 1) << 2 * TILE_BITS)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            self.cells[s] += np.bincount(at[bounds[s]:bounds[s + 1]] & (1 << 2 * TILE_BITS) - 1, minlength=1 << 2 * TILE_BITS).astype(np.uint32)

    def _coordinates(self) -> Iterator[pa.RecordBatch]:
        """Buffered pairs of sparse tiles as counted coordinates."""
        left, right = (np.concatenate(x) for x in zip(*self.far, strict=True))
        self.far, self.held[1] = [], 0
        if not len(left):
            return
        order = np.argsort(phrase_key(left, right), kind="stable")
        left, right = left[order], right[order]
        heads = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
        yield _counted(left[heads], right[heads], np.diff(np.append(heads, len(left))))

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.near:
            self._fold()
        if self.far:
            yield from self._coordinates()
        for s, tile in enumerate(self.dense.tolist()):
            cell = np.flatnonzero(self.cells[s])
            if len(cell):
                side, low = RANKED >> TILE_BITS, (1 << TILE_BITS) - 1
                i, j = (tile // side << TILE_BITS) + (cell >> TILE_BITS), (tile % side << TILE_BITS) + (cell & low)
                yield _counted(self.left.key[i], self.right.key[j], self.cells[s][cell])


def _counted(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(left).view(np.int64)), pa.array(np.ascontiguousarray(right).view(np.int64)), pa.array(n.astype(np.int64))], ["left", "right", "n"])


def count_phrases(texts: DataFrame, m: int, flags: np.ndarray, left: Ranks, right: Ranks) -> DataFrame:
    """(left, right, n) of the phrases of m words whose parts of m - 1 words are flagged; ``left`` is the first of them, ``right`` a word."""
    shared = texts.sparkSession.sparkContext.broadcast((flags, left, right, dense_tiles(left, right)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, left, right, slots = shared.value
        tiles = Tiles(left, right, slots)
        for _, w in each_words(batches):
            n = len(w.key) - m + 1
            if n <= 0:
                continue
            part = w.key[:len(w.key) - m + 2]                # hashes of the parts of m - 1 words
            for k in range(1, m - 1):
                part = phrase_key(part, w.key[k:k + len(part)])
            ok = flagged(flags, part, MARK_BITS)
            at = np.flatnonzero(ok[:n] & ok[1:n + 1] & (w.follow[:n] >= m - 1))
            yield from tiles.add(part[at], w.key[at + m - 1])
        yield from tiles.close()

    return texts.mapInArrow(work, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def _with_keys(pairs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.ascontiguousarray(b.column(i).to_numpy()).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(phrase_key(x, y).view(np.int64))], ["left", "right", "n", "key"])

    return pairs.mapInArrow(work, "left long, right long, n long, key long")


@dataclass
class Level:
    """The frequent phrases of one length: (lang, key, words, n), those with an id apart."""

    table: DataFrame
    top: DataFrame

    def lookup(self, rows: DataFrame, on: str, named: dict[str, str]) -> DataFrame:
        """``rows`` with columns of the level by the word hashes in the column ``on``.

        Phrases with an id, which may be hot keys, come from a broadcast table of
        RANKED rows at most; the others are found in few rows each.
        """
        def side(df: DataFrame) -> DataFrame:
            return df.select(F.col("words").alias(on), *[F.col(c).alias(a) for c, a in named.items()], F.lit(True).alias("_hit"))

        met = rows.join(F.broadcast(side(self.top)), on, "left")
        rest = met.where("_hit is null").select(*rows.columns).join(side(self.table), on)
        return met.where("_hit").unionByName(rest).drop("_hit")


def _level(table: DataFrame) -> Level:
    return Level(table, stored(most_frequent(table), "phrase-ranks"))


def levels(texts: DataFrame, max_words: int, least: int) -> tuple[DataFrame, list[Level]]:
    """(words with their counts, the frequent phrases of 1 to max_words words)."""
    words = stored(count_words(texts), "phrase-words")
    found = [_level(stored(words.where(F.col("n") >= least).select("lang", "key", F.array("key").alias("words"), "n", "word"), "phrases-1"))]
    right = rank(found[0].top)
    left = right
    for m in range(2, max_words + 1):
        flags = slot_bitmap(found[-1].table, "key", MARK_BITS)
        counted = stored(_with_keys(count_phrases(texts, m, flags, left, right).where(F.col("n") >= least)), f"phrases-{m}-counted")
        before = found[-1]
        # the words of the first part by its hash
        first = Level(*[d.select(F.col("key").alias("words"), F.col("words").alias("first"), "lang") for d in (before.table, before.top)])
        rows = first.lookup(counted, "left", {"first": "first", "lang": "lang"})
        found.append(_level(stored(rows.select("lang", "key", F.concat("first", F.array("right")).alias("words"), "n"), f"phrases-{m}")))
        left = rank(found[-1].top)
    return words, found


def scored(found: list[Level], m: int) -> DataFrame:
    """(lang, words, a, l, r, score) of the phrases of m words, cut where the score is least."""
    rows = found[m - 1].table.select("lang", "words", F.col("n").alias("a"))
    cuts = []
    for k in range(1, m):
        rows = rows.withColumns({"_x": F.slice("words", 1, k), "_y": F.slice("words", k + 1, m - k)})
        rows = found[k - 1].lookup(rows, "_x", {"n": f"_l{k}"})
        rows = found[m - k - 1].lookup(rows, "_y", {"n": f"_r{k}"}).drop("_x", "_y")
        wide = lambda c: f"cast({c} as decimal(19, 0))"
        score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide('a')} * {wide('a')}) div ({wide(f'_l{k}')} * {wide(f'_r{k}')})")
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
    return rows.withColumn("_c", F.array_min(F.array(*cuts))).select("lang", "words", "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), F.col("_c.score").alias("score"))


def explained(found: list[Level], m: int) -> DataFrame | None:
    """(words, most): the highest count of a longer phrase around each phrase of m words."""
    parts = None
    for longer in range(m + 1, len(found) + 1):
        inner = F.array(*[F.slice("words", i, m) for i in range(1, longer - m + 2)])
        rows = found[longer - 1].table.select(F.explode(inner).alias("words"), "n")
        parts = rows if parts is None else parts.unionAll(rows)
    return None if parts is None else parts.groupBy("words").agg(F.max("n").alias("most"))


def best(rows: DataFrame, limit: int, order: list[Column], score: Column, step: int) -> DataFrame:
    """The first ``limit`` rows of each lang by ``order``, with their rank from 1.

    ``score`` leads the order, descending; a histogram of it in steps finds what
    can be among the first, so that no task gets a whole language.
    """
    rows = rows.withColumn("_b", F.floor(score / step).cast("long"))
    down = Window.partitionBy("lang").orderBy(F.desc("_b"))
    edge = (rows.groupBy("lang", "_b").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.sum("c").over(down) - F.col("c"))
            .where(F.col("before") < limit).groupBy("lang").agg(F.min("_b").alias("_least")))
    salts = edge.select("lang", "_least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    near = rows.withColumn("_s", F.pmod(F.hash("phrase"), F.lit(SALTS))).join(salts, ["lang", "_s"]).where(F.col("_b") >= F.col("_least")).drop("_b", "_least")
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= limit)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit).drop("_s")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, least: int = 10, share: tuple[int, int] = (50, 100), limit: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``limit`` phrases of each language.

    A phrase has 2 to ``max_words`` words and ``least`` occurrences or more; it is
    dropped where a longer one has ``share`` of its occurrences.
    """
    texts = texts_of(docs, text, lang)
    words, found = levels(texts, max_words, least)
    kept = None
    for m in range(2, max_words + 1):
        rows, longer = scored(found, m), explained(found, m)
        if longer is not None:
            rows = rows.join(longer, "words", "left").where(F.col("most").isNull() | (F.col("most") * share[1] < F.col("a") * share[0])).drop("most")
        kept = rows if kept is None else kept.unionByName(rows)
    kept = stored(kept, "phrases-kept")
    spread = kept.select("words", F.posexplode("words").alias("at", "one")).select("words", "at", F.array("one").alias("one"))
    spelled = (found[0].lookup(spread, "one", {"word": "word"}).groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
               .select("words", F.array_join(F.col("w.word"), " ").alias("phrase")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top = best(stored(kept.join(spelled, "words"), "phrases-spelled"), limit, order, F.col("score"), 1000)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
