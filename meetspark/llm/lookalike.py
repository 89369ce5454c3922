"""Texts that look the same but are stored differently (problem 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meetspark.llm import looks
from meetspark.runtime import written


def _translate(text: Column, table: dict[str, str]) -> Column:
    """Spark's translate; characters mapped to '' are deleted, so they come last."""
    kept = [(k, v) for k, v in table.items() if v]
    gone = [k for k, v in table.items() if not v]
    return F.translate(text, "".join(k for k, _ in kept) + "".join(gone), "".join(v for _, v in kept))


def shown(text: Column) -> Column:
    """``text`` in one form: spaces, widths, joined letters, invisible characters and look-alikes.

    Accents may still be composed or not; the collation treats both alike. A
    text that is plain ASCII without control characters is left as it is.
    """
    form = _translate(text, looks.single())
    letters = looks.joined()
    split = form
    for c, written_as in letters.items():
        split = F.replace(split, F.lit(c), F.lit(written_as))
    form = F.when(F.regexp_like(form, F.lit("[" + "".join(letters) + "]")), split).otherwise(form)
    form = F.replace(form, F.lit("\r\n"), F.lit("\n"))
    return F.when(F.regexp_like(text, F.lit(r"[^\n\t\x20-\x7e]")), form).otherwise(text)


def _block(form: Column) -> Column:
    """A hash that texts equal under the collation share: letters without accents."""
    return F.xxhash64(F.when(F.regexp_like(form, F.lit(r"[^\x00-\x7f]")), _translate(form, looks.bare())).otherwise(form))


def text_key(text: Column) -> Column:
    """A key of 128 bits of a stored text."""
    return F.unhex(F.md5(text))


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, canonical_id): documents whose class holds different stored texts.

    1. Each text is brought to its look-alike-mapped form and hashed without
       accents; only blocks with two or more different stored texts go on.
    2. Within those, forms are grouped under the case- and accent-sensitive
       collation UNICODE. The canonical member is the smallest doc_id.
    3. The canonical member is joined back to the variants, and those to the
       documents.

    Null texts, texts with nothing visible and classes of byte-identical copies
    are left out; copies of one stored text share its row in step 2 and 3.
    """
    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    forms = texts.where(F.length("text") > 0).select("doc_id", shown(F.col("text")).alias("form"), text_key(F.col("text")).alias("text_hash"))
    visible = F.regexp_like("form", F.lit(r"(?U)\S"))
    # three numbers a document, kept because each form is costly to make
    keyed = written(forms.select("doc_id", F.when(visible, _block(F.col("form"))).alias("block"), "text_hash"), "keyed").where("block IS NOT NULL")
    variants = keyed.groupBy("block", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    blocks = variants.groupBy("block").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("block")
    picked = written(variants.join(blocks, "block", "left_semi"), "variants")
    chosen = texts.join(picked, "doc_id").withColumn("form", F.collate(shown(F.col("text")), "UNICODE"))
    chosen = chosen.where(text_key(F.col("text")) == F.col("text_hash")).select("block", "text_hash", "doc_id", "form").dropDuplicates(["block", "text_hash"])
    groups = chosen.groupBy("block", "form").agg(F.min("doc_id").alias("canonical_id"), F.count("*").alias("n")).where("n > 1")
    named = written(chosen.join(groups, ["block", "form"]).select("block", "text_hash", "canonical_id"), "named")
    return keyed.join(named, ["block", "text_hash"]).select("doc_id", "text_hash", "canonical_id")


def p9_found(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): every pair that looks the same but differs in stored characters.

    Pairs are made of different stored texts first and then of the documents
    that hold them, so copies of one text are never compared with each other.
    """
    members = written(classes(documents).distinct(), "members")
    texts = members.select("canonical_id", "text_hash").distinct()
    other = texts.select("canonical_id", F.col("text_hash").alias("other_hash"))
    pairs = texts.join(other, "canonical_id").where(F.col("text_hash") < F.col("other_hash"))
    left = members.select("canonical_id", "text_hash", F.col("doc_id").alias("x"))
    right = members.select("canonical_id", F.col("text_hash").alias("other_hash"), F.col("doc_id").alias("y"))
    found = pairs.join(left, ["canonical_id", "text_hash"]).join(right, ["canonical_id", "other_hash"]).where(F.col("x") != F.col("y"))
    return found.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def p9_canonical(documents: DataFrame) -> DataFrame:
    """(doc_id, canonical_id) of every document; its own id where no other stored text looks the same."""
    found = classes(documents).groupBy("doc_id").agg(F.min("canonical_id").alias("canonical_id"))
    return documents.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("canonical_id", "doc_id").alias("canonical_id"))
