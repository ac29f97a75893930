"""Packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import os
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, settle

LENGTH = 2048
GROUP = 4096  # pieces that are packed together
CACHE = 200_000  # chunks of text of each of two generations whose ids a worker remembers
ROWS = 256  # texts that a worker holds at once


#: Byte-level alphabet: bytes without a printable Latin-1 character stand as characters from 256 on, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, by a tokenizer that drops white space.

    No pre-token of such a tokenizer spans white space, so the ids of a text are those of its
    chunks between ASCII white space, one after the other, and a chunk met before needs no
    second run.  A full stop or comma after an ASCII letter is a pre-token of its own.  A-Z
    are lower-cased first, as the tokenizer does later, unless the text has combining marks,
    which could compose differently with a small letter.  A new chunk of small letters alone
    (up to U+024F, composed) is one pre-token and goes straight to the merges; any other one
    goes through the whole tokenizer.

    ``added_tokens``: a text that holds the exact string of one of the vocabulary's added tokens
    goes whole and unchanged through the tokenizer as its file states it, which gives that token's
    id.  Otherwise such strings are ordinary text.

    A task has one core: the tokenizer's own threads, one for each core of the machine in every
    worker, cost more than the few words of a call are worth, so they are turned off.
    """

    def __init__(self, path: str, added_tokens: bool = False, cache: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.cache, self.whole = path, cache, None
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        if any(a in text for a in self.added):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return array("I", self.whole.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        if b"\xcc" not in text and b"\xcd" not in text:  # first bytes of U+0300 to U+037F
            text = text.lower()
        chunks = text.split()
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            self._learn(chunks)
            return b"".join(map(self.known.__getitem__, chunks))

    def _learn(self, chunks):
        if len(self.known) > self.cache:  # what was used in the last generation stays for one more
            self.old, self.known = self.known, {}
        known, old, new = self.known, self.old, {c for c in chunks if c not in self.known}
        known.update((c, old[c]) for c in new if c in old)
        new = {c for c in new if c not in known}
        ended = {c for c in new if c[-1:] in (b".", b",") and c[-2:-1].isalpha()}
        odd, tokenize = [], self.model.tokenize
        for c in (new - ended) | {c[:-1] for c in ended} | {c[-1:] for c in ended}:
            if c in known:
                continue
            if c in old:
                known[c] = old[c]
                continue
            if c.isalpha() and c.islower():  # one pre-token as it stands
                known[c] = array("I", [t.id for t in tokenize(c.decode())]).tobytes()
                continue
            word = c.decode()
            if word.isalpha() and word.islower() and max(word) < "\u0250" and is_normalized("NFC", word):
                known[c] = array("I", [t.id for t in tokenize(c.decode("latin-1").translate(BYTE_LEVEL))]).tobytes()
            else:
                odd.append((c, word))
        for (c, _), e in zip(odd, self.tokenizer.encode_batch_fast([w for _, w in odd], add_special_tokens=False), strict=True):
            known[c] = array("I", e.ids).tobytes()
        for c in ended:
            known[c] = known[c[:-1]] + known[c[-1:]]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, ids: bool = False, added_tokens: bool = False, cache: int = CACHE) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: each document's ids, cut every ``length`` ids.

    ``ids=True`` adds the ids themselves (``ids`` binary).  The ids of a document end with
    ``end_id``; a null or empty text has that id alone.  ``added_tokens``: see ``ChunkEncoder``;
    ``cache``: chunks that a worker remembers, some 150 bytes each, in each of two generations.
    """
    end = array("I", [end_id]).tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids

    def run(batches):
        encoder = ChunkEncoder(tokenizer_path, added_tokens, cache)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                data = encoder.encode(text or b"") + end
                total = len(data) // 4
                for start in range(0, total, length):
                    piece = data[4 * start : 4 * (start + length)]
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total) + (piece,) * ids)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    types = [pa.int64()] * 5 + [pa.binary()] * ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes keep their order.

    The tree holds in each node the largest room left below it, so the leftmost bin with room
    enough is one walk from the root to a leaf.
    """
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``length`` ids.

    Pieces are dealt at random into groups of about ``group``, which are packed by first-fit
    decreasing independently, so a document of any number of pieces, or a source of any size,
    spreads over the groups.  Other columns are kept; no pieces give no rows.
    """
    pieces = settle(pieces)
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("_group", F.expr(f"pmod(xxhash64(doc_id, start, monotonically_increasing_id()), {groups}L)"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), length)
        first = table.column("_group")[0].as_py() << 32
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, ids: bool = False, added_tokens: bool = False, cache: int = CACHE) -> DataFrame:
    """Tokenises and packs all documents; every id lies in exactly one piece.

    A null doc_id is kept as null, rows that repeat are documents of their own, ties in size go
    by crc32, doc_id and start; other columns of ``docs`` are ignored; no documents give no rows.
    """
    return pack(token_pieces(docs, tokenizer_path, end_id, length, ids, added_tokens, cache), length)
