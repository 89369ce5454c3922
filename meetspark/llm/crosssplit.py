"""Same or nearly the same transcripts across splits (problem 3): all pairs bounded by their word counts, then their order."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meetspark.llm.turns import BEHIND, CAPTION, HESITATIONS, MARK, NUMBER, PLAIN_ROLE, ROLE, SOUNDS, SWAPPED, TIME, UNKNOWN, roster_keys
from meetspark.runtime import written

#: Least share of the longer transcript's words that stand in the same order in the other.
SHARE_OF_LONGER = (4, 5)
#: Words are counted in so many buckets when whole texts are compared.
BUCKETS = 1 << 12
#: Words of one side that one task holds at a time, and texts it compares at a time. They bound memory only.
CHUNK_WORDS, BLOCK = 4_000_000, 1024

#: Parts that a meeting's records are spread over for the join with its roster.
SALTS = 8

# Each pattern starts with a literal or a set of characters, which lets the search skip ahead.
_NOISE = re.compile(
    r"[(\[{<*](?:(?<=\{)[^{}\n]*+\}|(?<=<)[^<>\n]*+>|(?<=\*)[^*\s][^*\n]*+\*|(?<=\()\([^()\n]*+\)\)"
    r"|(?<=[(\[])\s*(?:%s|(?:%s)(?:\s+%s)?)\s*[\])])" % (TIME, SOUNDS, TIME)
)
_LINE = re.compile(
    r"\n(?:\d+[ \t]*\r?\n[^\n]*-->[^\n]*|[ \t]*(?:\d{1,3}:\d\d:\d\d(?:[.,]\d{1,3})?\s(?:\s*-\s)?)?[ \t]*(?:((?:[^:\n<\[({]++|\[[^\]:\n]*+\]|\([^):\n]*+\))++):)?)"
)
_STAMP = re.compile(r"\n[ \t]*(?:\d+[ \t]*\r?\n[ \t]*)?[\[(<]?[ \t]*(%s)" % TIME)
_HEAD = re.compile(r"\s*(%s)?\s*(?:-\s+)?((?:[^:\n<\[({]++|\[[^\]:\n]*+\]|\([^):\n]*+\))++):" % MARK)
_RANGE = re.compile(CAPTION)
_INLINE = re.compile(r"speaker_\d+ *:")
_PLAIN = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)*")
_WORD = re.compile(r"[^\W_]+(?:['\u2019][^\W_]+)*")
_SOUND = re.compile(f"(?:{HESITATIONS})$")


class _Ids(dict):
    """word -> its 32-bit id; 0 for hesitations."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = 0 if _SOUND.match(word) else (zlib.crc32(word.encode()) or 1) - 2**31
        self[word] = found
        return found


@lru_cache(50_000)
def _label_key(label: str) -> str:
    """A label in lower case, reduced to the part that names somebody, as in turns.label_key."""
    name = " ".join(label.split())
    if found := re.search(NUMBER, name):
        return f"speaker_{int(found[1]):02d}"
    for pattern in (ROLE, PLAIN_ROLE, BEHIND):
        if found := re.search(pattern, name):
            return found[1]
    return re.sub(SWAPPED, r"\2 \1", name)


def _seconds(mark: str) -> float:
    total = 0.0
    for part in mark.strip("[](<>) \t\n").replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def in_order_of_time(text: str, names: frozenset[str]) -> str:
    """A text with its turns in order of time, if every labelled line has one; else as it is, as in problem 6."""
    times = [_seconds(x) for x in _STAMP.findall("\n" + text)]
    if all(a <= b for a, b in zip(times, times[1:])):
        return text
    turns: list[tuple[float, list[str]]] = [(-1.0, [])]
    for line in _RANGE.sub(r"[\1.\2] ", text).replace(".] ", "] ").split("\n"):
        head = _HEAD.match(line)
        if head and _names_somebody(head[2], names):
            if not head[1]:
                return text
            turns.append((_seconds(head[1]), [line]))
        else:
            turns[-1][1].append(line)
    return "\n".join(line for _, lines in sorted(turns, key=lambda x: x[0]) for line in lines)


def _names_somebody(label: str, names: frozenset[str]) -> bool:
    return " ".join(label.split()) in UNKNOWN or _label_key(label) in names


def spoken_words(text: str, ids: dict[str, int], names: frozenset[str] = frozenset()) -> np.ndarray:
    """Ids of the spoken words in order, without layout, labels, times, hesitations, sounds, case and punctuation.

    Text before a colon is a label if it is one of ``names``, the keys of the
    meeting's roster, or marks an unknown speaker; else it is spoken.
    """

    def begun(line: re.Match) -> str:
        label = line[1]
        if label is None or _names_somebody(label, names):
            return "\n"
        return f"\n{label} "

    ordered = in_order_of_time(text.lower(), names)
    bare = _INLINE.sub(" ", _LINE.sub(begun, _NOISE.sub(" ", "\n" + ordered)))
    words = (_PLAIN if bare.isascii() else _WORD).findall(bare)
    found = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
    return found[found != 0]


def split_name(split: Column) -> Column:
    """train, validation or test; null for anything else."""
    name = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    return F.when(name == "val", "validation").when(name.isin("train", "validation", "test"), name)


def word_sequences(meetings: DataFrame, roster: DataFrame) -> DataFrame:
    """(record_id, split, source, n, text_key, words) of each record with a split and at least one word.

    text_key, of 128 bits, is equal for equal word sequences. Records meet the
    names of their meeting's roster by a join that is spread over SALTS parts,
    so a meeting with many records isn't hot. The table is kept in the shared
    folder, as several stages read it.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            texts, names = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            found = [spoken_words(t or "", ids, frozenset(k or ())) for t, k in zip(texts, names)]
            keys = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in found]
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(w) for w in found], pa.int32()), pa.array(keys, pa.binary()), words],
                names=["record_id", "split", "source", "n", "text_key", "words"],
            )

    chosen = meetings.select("record_id", split_name(F.col("split")).alias("split"), "source", "transcript", "meeting_id").where(
        F.col("record_id").isNotNull() & F.col("split").isNotNull() & F.col("transcript").isNotNull()
    )
    # a record without a meeting has no roster; its own key keeps such records apart
    place = F.coalesce("meeting_id", F.concat(F.lit("\n"), F.col("record_id").cast("string")))
    spread = chosen.withColumn("place", place).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    named = roster_keys(roster).groupBy(F.col("meeting_id").alias("place")).agg(F.collect_set("key").alias("names"))
    named = named.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    both = spread.join(named, ["place", "salt"], "left").select("record_id", "split", "source", "transcript", "names")
    schema = "record_id long, split string, source string, n int, text_key binary, words array<int>"
    return written(both.mapInArrow(parse, schema).where("n > 0"), "words")


def _side() -> Column:
    return F.when(F.col("split") == "train", 0).otherwise(1)


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def common_in_order(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence, or 0 if it can't reach ``least``."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    done = head + tail
    if not x or not y:
        return done if done >= least else 0
    if done + sum((Counter(x) & Counter(y)).values()) < least:
        return 0
    places: dict[int, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y:
        hit = row & places.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
    total = done + len(x) - row.bit_count()
    return total if total >= least else 0


def _least(n: np.ndarray | int) -> np.ndarray | int:
    """Words that must stand in the same order, if the longer text has n."""
    return -(-SHARE_OF_LONGER[0] * n // SHARE_OF_LONGER[1])


def _counts(texts: list[np.ndarray]) -> np.ndarray:
    return np.array([np.bincount(w % BUCKETS, minlength=BUCKETS) for w in texts], dtype=np.int32)


def _compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """(a, b) of the pairs of two chunks that have enough words in the same order.

    Every pair is bounded by its word counts, never by what the words are: the
    common words are at most the sum of the smaller counts, which is at most the
    dot product of the counts' roots. Buckets only raise both.
    """

    def by_length(table: pa.Table, side: int) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
        own = [w for batch in table.to_batches() for w in _arrays(batch, f"words_{side}")]
        n = np.array([len(w) for w in own], dtype=np.int64)
        order = np.argsort(n, kind="stable")
        keys = table.column(f"text_key_{side}").to_pylist()
        return [own[k] for k in order], n[order], [keys[k] for k in order]

    found: list[tuple[bytes, bytes]] = []
    (ta, na, ka), (tb, nb, kb) = by_length(left, 0), by_length(right, 1)
    for i in range(0, len(ta), BLOCK):
        ca, la = None, na[i : i + BLOCK]
        for j in range(0, len(tb), BLOCK):
            lb = nb[j : j + BLOCK]
            if la[-1] < _least(lb[0]) or lb[-1] < _least(la[0]):
                continue
            if ca is None:
                ca = _counts(ta[i : i + BLOCK])
                ra = np.sqrt(ca, dtype=np.float32)
            cb = _counts(tb[j : j + BLOCK])
            least = _least(np.maximum.outer(la, lb))
            met = (ra @ np.sqrt(cb, dtype=np.float32).T >= least * (1 - 1e-4)) & (np.minimum.outer(la, lb) >= least)
            for x, y in zip(*np.nonzero(met)):
                if np.minimum(ca[x], cb[y]).sum() >= least[x, y] and common_in_order(ta[i + x], tb[j + y], int(least[x, y])):
                    found.append((ka[i + x], kb[j + y]))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def similar_texts(words: DataFrame) -> DataFrame:
    """(a, b): text keys of a train text and of a held-out text that are the same or nearly so.

    Copies of one word sequence on one side take part once. All pairs whose
    lengths allow it are compared, chunk by chunk.
    """
    step = math.log(SHARE_OF_LONGER[1] / SHARE_OF_LONGER[0])
    sided = words.withColumn("side", _side()).withColumn("size", F.floor(F.log("n") / step + 1e-9).cast("int"))
    copies = sided.groupBy("text_key", "side").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n")).where("n > 1")
    more = sided.select("record_id", "text_key", "side").join(
        copies.select("text_key", "side", F.col("record_id").alias("first")), ["text_key", "side"]
    ).where(F.col("record_id") != F.col("first"))
    extra = written(more.select("record_id"), "copies")
    unique = sided.join(extra, "record_id", "left_anti")
    # a row per side and step of length
    sums = sided.groupBy("side", "size").agg(F.sum("n").alias("n")).collect()
    parts = {(r["side"], r["size"]): -(-r["n"] // CHUNK_WORDS) for r in sums}
    # texts whose lengths allow a case are at most one step apart
    cells = [(c, i, d, j) for (side, c), n in parts.items() if side == 0 for d in (c - 1, c, c + 1) for i in range(n) for j in range(parts.get((1, d), 0))]
    spark = words.sparkSession
    named = spark.createDataFrame([(k, *x) for k, x in enumerate(cells)], "cell int, size_0 int, chunk_0 int, size_1 int, chunk_1 int")
    counted = spark.createDataFrame([(*k, n) for k, n in parts.items()], "side int, size int, parts int")
    spread = unique.join(F.broadcast(counted), ["side", "size"]).withColumn("chunk", F.pmod(F.xxhash64("text_key"), "parts").cast("int"))

    def chunks(side: int):
        own = named.select("cell", F.col(f"size_{side}").alias("size"), F.col(f"chunk_{side}").alias("chunk"))
        return spread.where(F.col("side") == side).join(F.broadcast(own), ["size", "chunk"]).select(*[F.col(c).alias(f"{c}_{side}") for c in ("cell", "text_key", "words")]).groupBy(f"cell_{side}")

    return chunks(0).cogroup(chunks(1)).applyInArrow(_compared, "a binary, b binary").distinct()


def p3_found(meetings: DataFrame, roster: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b): every pair of a train and a held-out record with the same or nearly the same transcript.

    Null ids, splits and transcripts and transcripts without words take no part.
    """
    words = word_sequences(meetings, roster)
    pairs = written(similar_texts(words), "similar")
    left = words.where(_side() == 0).select(F.col("text_key").alias("a"), F.col("record_id").alias("x"))
    right = words.where(_side() == 1).select(F.col("text_key").alias("b"), F.col("record_id").alias("y"))
    found = pairs.join(left, "a").join(right, "b")
    return found.select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")).distinct()


def p3_counts(meetings: DataFrame, roster: DataFrame) -> DataFrame:
    """(split, source, train_source, n_pairs, n_records): overlaps per held-out split and source.

    Counted from texts and the number of records that hold them; pairs of records are never listed.
    """
    words = word_sequences(meetings, roster)
    pairs = similar_texts(words)
    held = words.groupBy("text_key", "split", "source").agg(F.count("*").alias("n"))
    left = held.where("split = 'train'").select(F.col("text_key").alias("a"), F.col("source").alias("train_source"), F.col("n").alias("n_train"))
    right = held.where("split <> 'train'").select(F.col("text_key").alias("b"), "split", "source", "n")
    joined = pairs.join(left, "a").join(right, "b")
    per = joined.groupBy("split", "source", "train_source", "b").agg(F.sum(F.col("n_train") * F.col("n")).alias("n_pairs"), F.first("n").alias("n"))
    return per.groupBy("split", "source", "train_source").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n").alias("n_records"))
