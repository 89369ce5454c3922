"""Encoding a corpus with a public byte-level BPE tokenizer (problem 7): distinct-word table."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from meetspark.runtime import written

#: Splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same in Java's syntax with Unicode classes.
WORDS = "(?U)" + PATTERN
#: A word counts as hot if it stands in more than 1 / HOT_SHARE of the rows of the
#: word lists, so fewer than HOT_SHARE words can be hot and their table is safe to broadcast.
HOT_SHARE = 4096
#: Words of the texts that share a list of distinct words; a longer text is a block of its own.
BLOCK_WORDS = 1_000_000
#: Vocabulary files are fixed public files; a larger one than this is refused.
MAX_VOCABULARY_BYTES = 64 << 20

_ENCODINGS: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a public vocabulary file lies: ``folder``, $TOKENIZERS_DIR or the installed package."""
    folder = folder or os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _encoding(data: bytes, digest: str):
    import tiktoken

    if digest not in _ENCODINGS:  # once per Python worker and vocabulary
        _ENCODINGS[digest] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=_ranks(data), special_tokens={})
    return _ENCODINGS[digest]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a block with the numbers of their words, then the block's distinct words by number.

    A block is named by its task and its place there.
    """
    task, done = TaskContext.get().partitionId(), 0

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal done
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = whole.column("words").chunk(0)
        coded = pc.dictionary_encode(lists.flatten())
        name = task << 32 | done
        done += 1
        n, m = whole.num_rows, len(coded.dictionary)
        codes = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py()), coded.indices)
        none = pa.nulls(n, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), whole.column("doc_id").chunk(0), codes, none, pa.nulls(n, pa.int32())], names=["block", "doc_id", "codes", "word", "code"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, name)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), coded.dictionary, pa.array(np.arange(m, dtype=np.int32))],
            names=["block", "doc_id", "codes", "word", "code"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at, lists = 0, batch.column("words")
        ends = lists.offsets.to_numpy()
        while at < batch.num_rows:
            room = int(np.searchsorted(ends, ends[at] + max(0, BLOCK_WORDS - size), side="right")) - 1
            upto = min(batch.num_rows, max(room, at + (not held)))
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto] - ends[at])
                at = upto
            if at < batch.num_rows or size >= BLOCK_WORDS:
                yield from made(held)
                held, size = [], 0
    if held:
        yield from made(held)


def split_words(documents: DataFrame) -> DataFrame:
    """(block, doc_id, codes, word, code): texts as numbers of words, and the distinct words of each block.

    Words are split in the JVM, once, and each text is kept as numbers only. The
    table lies in the shared folder, as both kinds of rows are read more than once.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    parted = texts.select("doc_id", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"))
    return written(parted.mapInArrow(_blocks, "block long, doc_id long, codes array<int>, word string, code int"), "split")


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of each distinct word, encoded once and kept in the shared folder; n: blocks that hold it."""
    with open(path, "rb") as file:
        data = file.read()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    sent, digest = words.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent.value, digest)
        for batch in batches:
            found = batch.column("word").to_pylist()
            ids = pa.array([encoding.encode_ordinary(w) for w in found], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), ids], names=["word", "n", "ids"])

    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return written(counted.mapInArrow(encode, "word string, n long, ids array<int>"), "words")


def _placed(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's texts: each number of a word replaced by the word's ids, in order."""
    if not texts.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    words, texts = words.sort_by("code").combine_chunks(), texts.combine_chunks()
    lists, codes = words.column("ids").chunk(0), texts.column("codes").chunk(0)
    picked = pc.take(lists, codes.flatten())
    ends = picked.offsets.to_numpy()[codes.offsets.to_numpy() - codes.offsets[0].as_py()]
    return pa.table({"doc_id": texts.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends - ends[0]), picked.flatten())})


def encode_corpus(documents: DataFrame, path: str | None = None, hot_share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, ids): token ids of each text, as stored, without special tokens.

    Null and empty texts give an empty list; text that looks like a special
    token is ordinary text. A repeated (doc_id, text) comes out once; two texts
    under one doc_id come out as two rows. Only a block's distinct words are
    joined with the table of words, hot ones (fewer than ``hot_share``) by
    broadcast and all others by a shuffle in which no word is hot; within a
    block ids are placed by position.
    """
    split = split_words(documents)
    words = split.where("word IS NOT NULL").select("block", "code", "word")
    table = word_table(words, path or vocabulary_path())
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = total // hot_share
    hot = table.where(F.col("n") > bound).select("word", F.col("ids").alias("hot_ids"))
    probed = words.join(F.broadcast(hot), "word", "left")
    near = probed.where(F.col("hot_ids").isNotNull()).select("block", "code", F.col("hot_ids").alias("ids"))
    far = probed.where(F.col("hot_ids").isNull()).join(table.where(F.col("n") <= bound).select("word", "ids"), "word").select("block", "code", "ids")
    texts = split.where("word IS NULL").select(F.col("block").alias("own"), "doc_id", "codes")
    full = texts.groupBy("own").cogroup(near.unionAll(far).groupBy("block")).applyInArrow(
        lambda a, b: _placed(a.select(["doc_id", "codes"]), b.select(["code", "ids"])), "doc_id long, ids array<int>"
    )
    empty = documents.where(F.col("text").isNull() | (F.length("text") == 0)).select(F.col("doc_id").cast("long").alias("doc_id"))
    every = full.unionAll(empty.select("doc_id", F.array().cast("array<int>").alias("ids")))
    # only ids of documents are compared; without a repeated one no list of ids has to be shuffled
    repeated = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return every if repeated.isEmpty() else every.distinct()


def pieces_table(spark, path: str | None = None) -> DataFrame:
    """(id, piece) of the vocabulary, the bytes in hexadecimal; of fixed size."""
    with open(path or vocabulary_path(), "rb") as file:
        rows = [(i, piece.hex()) for piece, i in _ranks(file.read()).items()]
    return spark.createDataFrame(rows, "id int, piece string")


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), by a join of every id with its piece.

    Each row is decoded by itself, so two rows of one doc_id give two texts.
    """
    pieces = F.broadcast(pieces_table(encoded.sparkSession, path))
    keyed = encoded.select("doc_id", "ids", F.xxhash64("ids").alias("a"), F.hash("ids").alias("b")).distinct()
    placed = keyed.select("doc_id", "a", "b", F.posexplode("ids").alias("pos", "id")).join(pieces, "id", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    full = placed.groupBy("doc_id", "a", "b").agg(F.decode(F.unhex(F.array_join(parts["piece"], "")), "UTF-8").alias("text")).select("doc_id", "text")
    return full.unionAll(encoded.where(F.size("ids") == 0).select("doc_id", F.lit("").alias("text")))


def p7_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) by byte_bpe_50k."""
    return encode_corpus(documents, path)


def p7_roundtrip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_chars, same): whether decoding the ids gives the stored text again."""
    stored = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("stored")).distinct()
    decoded = decode_corpus(encode_corpus(documents, path), path)
    return stored.join(decoded, "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"), (F.col("text") == F.col("stored")).alias("same"))
