"""Token sequences from bytes: a closed byte vocabulary and typed pattern tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bytes as B
from .classify import DEX, ELF, GZIP, PNG, is_zip

# Token ids and allowed characters.
PAD, BOS, EOS, BYTE_OFFSET = 0, 1, 2, 5
ENTRY_TOKENS = ["dex", "elf", "archive", "asset", "arsc", "manifest", "resource"]
BASE64_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=\r\n"


def byte_tokens(data: Column, max_length: int | None = None, special: bool = True) -> Column:
    """Byte value + 5, optionally inside BOS/EOS, cut from the right to ``max_length`` tokens."""
    extra = 2 if special else 0
    if max_length is not None and special and max_length < 2:
        return F.slice(F.array(F.lit(BOS)), 1, max_length)
    body = data if max_length is None else F.substring(data, 1, max_length - extra)
    chars = F.when(F.length(body) > 0, F.split(B.latin1(body), "")).otherwise(F.array().cast("array<string>"))
    ids = F.transform(chars, lambda c: F.ascii(c) + BYTE_OFFSET)
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS))) if special else ids


def token_sequences(data: Column, max_length: int) -> Column:
    """All bytes as sequences of ``max_length`` tokens: ``seq_index`` and the fields of ``padded_tokens``.

    Bytes beyond the first sequence follow in further ones, so none is lost; empty data has one sequence.
    """
    body = max_length - 2
    last = F.floor(F.greatest(F.length(data) - 1, F.lit(0)) / body).cast("int")

    def one(i):
        part = padded_tokens(F.substring(data, i * body + 1, F.lit(body)), max_length)
        return F.struct(i.alias("seq_index"), part["input_ids"].alias("input_ids"), part["attention_mask"].alias("attention_mask"), part["length"].alias("length"), (i < last).alias("continued"))

    return F.transform(F.sequence(F.lit(0), last), one)


def padded_tokens(data: Column, max_length: int) -> dict[str, Column]:
    """Fixed-length ids with mask, used length and truncation flag."""
    used = F.least(F.length(data) + 2, F.lit(max_length))
    gap = F.lit(max_length) - used
    return {
        "input_ids": F.concat(byte_tokens(data, max_length), F.array_repeat(F.lit(PAD), gap)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), gap)),
        "length": used,
        "truncated": F.length(data) > max_length - 2,
    }


def pattern_tokens(data: Column, hist: Column, size: Column, runs: Column, entry: Column) -> Column:
    """Ordered descriptive tokens of a window between BOS and EOS."""
    e = B.entropy(hist, size)
    text = B.printable_count(hist) / size
    at = lambda m: B.starts_with_bytes(data, m)
    allowed = F.aggregate(
        F.transform(F.array(*[F.lit(b + 1) for b in sorted(BASE64_CHARS.encode())]), lambda i: F.element_at(hist, i)),
        F.lit(0),
        lambda a, c: a + c,
    )
    # Only leading whitespace of the first 64 bytes is skipped before the XML test.
    head = F.ltrim(B.latin1(F.substring(data, 1, 64)), F.lit(" \t\n\r\x0b\x0c"))
    zlib = F.substring(data, 1, 2).isin(*[bytearray(x) for x in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")])
    tail = F.substring(data, F.greatest(size - 15, F.lit(1)), F.lit(16))
    tail_zero = F.length(F.regexp_replace(B.latin1(tail), "[^\\x00]", ""))
    tail_ff = F.length(F.regexp_replace(B.latin1(tail), "[^\\xff]", ""))
    some = size > 0
    magic = (
        F.when(at(DEX), "MAGIC_DEX").when(at(ELF), "MAGIC_ELF").when(is_zip(data), "MAGIC_ZIP").when(at(GZIP), "MAGIC_GZIP")
        .when(at(PNG), "MAGIC_PNG").when(at(b"SQLite format 3\x00"), "MAGIC_SQLITE")
        .when(head.startswith("<?xml") | head.startswith("<manifest"), "MAGIC_XML_TEXT").otherwise("MAGIC_NONE")
    )
    run, long_run = runs["run_byte"], runs["run_len"] >= 16
    tokens = [
        F.concat(F.lit("ENTRY_"), F.when(F.lower(entry).isin(*ENTRY_TOKENS), F.upper(entry)).otherwise("UNKNOWN")),
        magic,
        F.when(is_zip(data), "COMPRESS_ZIP_LIKE"),
        F.when(e < 3.5, "ENTROPY_LOW").when(e < 6.5, "ENTROPY_MEDIUM").otherwise("ENTROPY_HIGH"),
        F.when(~some, "UNKNOWN_PATTERN"),
        F.when(some, F.when(text > 0.85, "ASCII_TEXT").when(text > 0.35, "ASCII_MIXED").otherwise("BINARY_DENSE")),
        F.when((size >= 32) & (allowed / size > 0.92), "BASE64_LIKE"),
        F.when(zlib, "COMPRESS_ZLIB_LIKE"),
        F.when(at(b"PK"), "COMPRESS_ZIP_LIKE"),
        F.when(some & (e >= 7.2) & (text < 0.35), "ENCRYPTION_LIKE_HIGH_ENTROPY"),
        F.when(
            some,
            F.when(~long_run, "RUN_SHORT").when(run == 0, "RUN_ZERO_LONG").when(run == 255, "RUN_FF_LONG").otherwise("RUN_BYTE_LONG"),
        ),
        F.when(B.repeated_blocks(data, 2), "REPEAT_2GRAM"),
        F.when(B.repeated_blocks(data, 4), "REPEAT_4GRAM"),
        F.when((size >= 16) & (tail_zero >= 12), "ALIGN_ZERO_PAD"),
        F.when((size >= 16) & (tail_ff >= 12), "ALIGN_FF_PAD"),
        F.lit("PATTERN_END"),
    ]
    listed = F.filter(F.array(*tokens), lambda t: t.isNotNull())
    return F.concat(F.array(F.lit("[BOS]")), listed, F.array(F.lit("[EOS]")))
