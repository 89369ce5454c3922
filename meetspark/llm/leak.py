"""Evaluation passages inside a training corpus (problem 8): spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meetspark.llm import looks
from meetspark.runtime import written

#: Words in a window.
SPAN = 13
#: Spaced seeds: 1 is hashed, 0 is ignored. A window with substitutions at ignored places only still hits.
MASKS = ("1101101101011", "1011011011101")
#: Bits of the prefilter for each item hash, and of one filter at most (16 MB). More item hashes
#: than fit one filter are parted by their upper bits, and each part has its own scan and filter.
BITS_A_HASH, SHARD_BITS = 256, 1 << 27
#: A corpus window goes to one of so many parts of the join, the item windows to each, so no window is hot.
SALTS = 8
#: Least share of equal words of a stretch that counts as nearly the same.
NEAR_SHARE = (4, 5)
#: Characters handled at once, which bounds a worker's memory.
CHUNK = 400_000

_RANDOM = np.random.default_rng(13)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_WEIGHT = _RANDOM.integers(1, 2**63, SPAN, dtype=np.uint64) | np.uint64(1)
_TABLE: list[np.ndarray] = []
WINDOWS = "key long, pos int, hashes array<long>, words string"


def _word_characters() -> np.ndarray:
    """Letters, digits and the marks that go with them, by code point."""
    if not _TABLE:
        import unicodedata

        _TABLE.append(np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """All windows of the texts, taken together: text number, place in the text, hashes, word starts and ends."""
    whole = "\n".join(texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _word_characters()[points]
    edges = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    none = np.empty(0, dtype=np.int64)
    if len(starts) < SPAN:
        return none, none, np.empty((len(MASKS), 0), dtype=np.uint64), starts, ends, whole
    place = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))), axis=0) if starts[0] == 0 else None
    if place is None:
        base = np.concatenate([np.zeros(starts[0], dtype=np.int64), np.repeat(starts, np.diff(np.append(starts, len(points))))])
        place = np.arange(len(points)) - base
    values = np.where(inside, _mixed(points.astype(np.uint64) + np.uint64(1)) * _PLACE[place & 63], np.uint64(0))
    word = _mixed(np.add.reduceat(values, starts))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    text_of = np.searchsorted(bounds, starts, side="right")
    n = len(starts) - SPAN + 1
    same = text_of[:n] == text_of[SPAN - 1 :]
    at = np.flatnonzero(same)
    hashes = np.zeros((len(MASKS), len(at)), dtype=np.uint64)
    for m, mask in enumerate(MASKS):
        for j, bit in enumerate(mask):
            if bit == "1":
                hashes[m] += word[at + j] * _WEIGHT[j]
        hashes[m] = _mixed(hashes[m] + np.uint64(m + 1))
    return text_of[at], at, hashes, starts, ends, whole


def _chunks(keys: list[int], texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Keys, word offsets and normalised texts, at most about CHUNK characters at once.

    A longer text is cut into runs of words that share SPAN - 1 words with the next one.
    """
    ks: list[int] = []
    bases: list[int] = []
    ts: list[str] = []
    size = 0
    for k, t in zip(keys, texts):
        if not t or k is None:
            continue
        shown = looks.plain(t).replace("\n", " ")
        parts = [(0, shown)]
        if len(shown) > CHUNK:
            inside = _word_characters()
            words = "".join(c if inside[ord(c)] else " " for c in shown).split()
            step = CHUNK // 16
            parts = [(i, " ".join(words[i : i + step + SPAN - 1])) for i in range(0, len(words), step)]
        for base, part in parts:
            if ts and size + len(part) > CHUNK:
                yield ks, bases, ts
                ks, bases, ts, size = [], [], [], 0
            ks.append(k)
            bases.append(base)
            ts.append(part)
            size += len(part)
    if ts:
        yield ks, bases, ts


class Filter:
    """A bitmap of the item hashes of one part: ``part`` of ``parts``, by the upper bits of a hash."""

    def __init__(self, bits: np.ndarray, size: int, part: int, parts: int) -> None:
        self.bits, self.size, self.part, self.parts = bits, size, part, parts

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64(self.size - 1)
        met = (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return met if self.parts == 1 else met & ((hashes >> np.uint64(40)) % np.uint64(self.parts) == np.uint64(self.part))


def _hash_windows(batches: Iterator[pa.RecordBatch], allowed: Filter | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, bases, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text, at, hashes, starts, ends, whole = _windows(texts)
            if allowed is None:
                hit = np.arange(len(at))
            else:
                hit = np.flatnonzero(np.logical_or.reduce([allowed.holds(h) for h in hashes])) if len(at) else at
            if not len(hit):
                continue
            first = np.searchsorted(text, text[hit])
            words = [" ".join(whole[starts[w + j] : ends[w + j]] for j in range(SPAN)) for w in at[hit]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in text[hit]], type=pa.int64()),
                    pa.array((at[hit] - at[first] + np.array([bases[i] for i in text[hit]])).astype(np.int32)),
                    pa.array(hashes[:, hit].T.astype(np.int64).tolist(), type=pa.list_(pa.int64())),
                    pa.array(words, type=pa.string()),
                ],
                names=["key", "pos", "hashes", "words"],
            )


def windows(texts: DataFrame, key: str, allowed: Filter | None = None) -> DataFrame:
    """One row per window of SPAN words of ``text``; with ``allowed`` only those that may hit.

    Null, empty and shorter texts have no windows.
    """
    sent = texts.sparkSession.sparkContext.broadcast(allowed)
    chosen = texts.select(F.col(key).cast("long").alias("key"), "text").where(F.length("text") >= 2 * SPAN - 1)
    return chosen.mapInArrow(lambda batches: _hash_windows(batches, sent.value), WINDOWS)


def _filters(items: DataFrame, shard_bits: int = SHARD_BITS) -> Iterator[Filter]:
    """Filters that hold every item hash together; each takes shard_bits / BITS_A_HASH hashes on average."""
    total = items.count() * len(MASKS)
    parts = max(1, -(-total * BITS_A_HASH // shard_bits))
    size = min(shard_bits, 1 << max(20, (total * BITS_A_HASH // parts).bit_length()))
    own = items.select(F.explode("hashes").alias("h")).select(
        F.col("h").bitwiseAND(size - 1).cast("int").alias("slot"), F.expr(f"CAST(shiftrightunsigned(h, 40) % {parts} AS INT)").alias("part")
    ).distinct()
    for part in range(parts):
        bits = np.zeros(size, dtype=bool)
        bits[own.where(F.col("part") == part).select("slot").toPandas()["slot"].to_numpy(dtype=np.int64)] = True
        yield Filter(np.packbits(bits, bitorder="little"), size, part, parts)


def hits(documents: DataFrame, items: DataFrame, shard_bits: int = SHARD_BITS) -> tuple[DataFrame, DataFrame]:
    """The windows of the corpus that may belong to an item, by (doc_id, pos, words, mask, hash), and those of all items.

    The items' windows are made once and kept in the shared folder; the corpus
    is read once for each filter, which is one as long as 250,000 item windows
    or fewer are given, and only windows that pass leave the scan.
    """
    test = written(windows(items, "item_id"), "items")
    found = None
    for allowed in _filters(test, shard_bits):
        own = windows(documents, "doc_id", allowed)
        found = own if found is None else found.unionAll(own)
    left = found.select(F.col("key").alias("doc_id"), "pos", "words", F.posexplode("hashes").alias("mask", "hash"))
    left = left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    right = test.select(F.col("key").alias("item_id"), F.col("pos").alias("item_pos"), F.col("words").alias("item_words"), F.posexplode("hashes").alias("mask", "hash"))
    return left, right.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))


def overlaps(documents: DataFrame, items: DataFrame, shard_bits: int = SHARD_BITS) -> DataFrame:
    """(doc_id, item_id, pos, item_pos, n_words, same_words, exact): stretches of a document that stand in an item, with substitutions.

    Windows that hit by a mask are verified word by word. Hits of a document
    and an item that lie on one line of places are extended over each other:
    those that overlap or touch are one stretch of n_words words, of which
    same_words are equal to the item's at the same place; exact tells whether
    SPAN of them are so one after another.
    """
    left, right = hits(documents, items, shard_bits)
    pairs = left.join(right, ["salt", "mask", "hash"]).withColumn("line", F.col("pos") - F.col("item_pos"))
    once = pairs.dropDuplicates(["doc_id", "item_id", "line", "pos"])
    equal = F.zip_with(F.split("words", " "), F.split("item_words", " "), lambda a, b: (a == b).cast("int"))
    along = Window.partitionBy("doc_id", "item_id", "line").orderBy("pos")
    step = once.select("doc_id", "item_id", "line", "pos", "item_pos", equal.alias("equal"), (F.col("pos") - F.lag("pos").over(along)).alias("step"))
    new = F.least(F.coalesce("step", F.lit(SPAN)), F.lit(SPAN))
    counted = step.withColumn("same", F.aggregate(F.slice("equal", F.lit(SPAN + 1) - new, new), F.lit(0), lambda s, x: s + x))
    stretch = F.sum((F.coalesce("step", F.lit(SPAN + 1)) > SPAN).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    grouped = counted.withColumn("stretch", stretch).groupBy("doc_id", "item_id", "line", "stretch")
    return grouped.agg(
        F.min("pos").alias("pos"), F.min("item_pos").alias("item_pos"), (F.max("pos") - F.min("pos") + SPAN).cast("int").alias("n_words"), F.sum("same").cast("int").alias("same_words"),
        F.max(F.forall("equal", lambda x: x == 1)).alias("exact"),
    ).drop("line", "stretch")


def p8_found(documents: DataFrame, items: DataFrame, shard_bits: int = SHARD_BITS) -> DataFrame:
    """(doc_id, item_id) where SPAN consecutive words of the item stand in the document.

    Equal windows hit by every mask, so the first one suffices; the words
    themselves are compared. Rows with a null id, and texts of fewer than SPAN
    words, give nothing.
    """
    left, right = hits(documents, items, shard_bits)
    left = left.where("mask = 0").select("salt", "hash", "words", "doc_id").distinct()
    right = right.where("mask = 0").select("salt", "hash", F.col("item_words").alias("words"), "item_id").distinct()
    return left.join(right, ["salt", "hash", "words"]).select("doc_id", "item_id").distinct()


def p8_leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_docs, n_near, longest): documents that hold passages of each leaked item.

    n_docs counts documents with SPAN equal words in a row, n_near those with
    none but a stretch of which at least NEAR_SHARE are equal; longest is the
    longest stretch of either kind in words. Items without any are left out.
    """
    share = F.col("same_words") * NEAR_SHARE[1] >= F.col("n_words") * NEAR_SHARE[0]
    found = overlaps(documents, items).where(F.col("exact") | share).groupBy("item_id", "doc_id").agg(F.max("exact").alias("exact"), F.max("n_words").alias("longest"))
    return found.groupBy("item_id").agg(F.count_if("exact").alias("n_docs"), F.count_if(~F.col("exact")).alias("n_near"), F.max("longest").alias("longest"))
