"""Harvesting of literals and their joins, and wrapped encrypted strings, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.aes import cbc_decrypt
from lodestrata.functions.scalars import cores
from lodestrata.operators.relational import adjacent_runs, first_source_wins


def printable_runs(data: Column, least: int = 4) -> Column:
    """Runs of at least so many printable bytes."""
    return F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0))


def candidates(literals: DataFrame, blobs: DataFrame, most: int = 4) -> DataFrame:
    """value and the harvester that has it first: literals, their cores, joined neighbours, printable runs.

    literals: module_id, ordinal, text. blobs: content.
    """
    runs = adjacent_runs(literals, ["module_id"], "ordinal", "text", most, "\0")
    parts = {
        "literal": literals.select("text"),
        "core": literals.select(F.explode(cores(F.col("text"), "\0"))),
        "run": runs.select("joined"),
        "printable": blobs.select(F.explode(printable_runs(F.col("content")))),
    }
    return first_source_wins(parts)


def fresh_by_harvester(found: DataFrame) -> DataFrame:
    return found.groupBy("harvester").agg(F.count("*").alias("n_fresh"))


def string_key(password: Column) -> Column:
    """Key of a binary password: the digest of what stands before its first NUL. Its first half is the chain's start."""
    text = F.regexp_extract(F.decode(password, "ISO-8859-1"), "^[^\\x00]*", 0)
    return F.unhex(F.sha2(F.encode(text, "ISO-8859-1"), 256))


def string_encrypt(data: Column, key: Column) -> Column:
    """A binary string with its length in front, zero-padded and encrypted as a whole."""
    held = F.concat(F.lit(b"printf"), F.octet_length(data).cast("string").cast("binary"), F.lit(b"\0"), data)
    full = F.concat(held, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.octet_length(held), F.lit(16)))))
    out = F.aes_encrypt(full, key, F.lit("CBC"), F.lit("PKCS"), F.substring(key, 1, 16))
    return F.substring(out, F.lit(17), F.octet_length(full))


def string_decrypt(blob: Column, key: Column) -> Column:
    """The string again; null for a wrong key, an empty payload or what is no wrapped string."""
    plain = cbc_decrypt(blob, key, F.substring(key, 1, 16))
    digits = F.regexp_extract(F.decode(F.substring(plain, 1, 32), "ISO-8859-1"), "^printf(\\d{1,9})\\x00", 1)
    n = F.nullif(digits, F.lit("")).cast("int")
    return F.when((F.octet_length(blob) >= 16) & (n > 0), F.substring(plain, F.length(digits) + 8, n))
