"""Packing documents into fixed-length token sequences: first-fit decreasing
with a tournament tree, run independently in randomised groups.

Two Spark steps.  (1) Every document becomes token ids plus an end id, cut
into full pieces of the sequence length and one remainder; a piece carries its
place, length and the CRC-32 of its ids (and the ids themselves on request).
The pieces are written to the shared folder, so tokenising happens once and a
lost executor repeats only its own part.  (2) Each piece draws a group at
random; the number of groups follows the number of pieces, so a group's size
is bounded (about ``pieces_per_group``) whatever one source, key or document
holds.  Inside a group, pieces go longest first into the first sequence with
room; a tournament tree over the sequences' free room finds it in log steps.

Tokenising: white space separates the tokenizer's words, so ids of a text are
the ids of its white-space chunks in a row.  A task encodes each different
word once, as far as its table of words (bounded in bytes) holds it, and drops
the table at its end.  The words that a worker meets first, mostly common ones,
stay for its later tasks: a third of the table's bytes at most.

Edge cases: a null or empty text is a document of the end id alone; rows that
repeat a doc_id are packed as documents of their own; an empty table gives no
rows; texts of any length are cut into pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm.textkernels import lower_ascii, text_blocks, text_bytes
from cadence.plans.lineage import cut_lineage

PIECES_PER_GROUP = 2_000
TABLE_BYTES = 96 << 20  # a task's table of words takes at most; a third of it outlives the task
ENTRY_BYTES = 230  # of a word with its ids, beyond their own lengths
BLOCK_BYTES = 1 << 20
_SOLID = np.zeros(256, bool)  # ASCII letters and digits
_MARK = np.zeros(256, bool)  # ASCII punctuation but the apostrophe
for _c in range(33, 127):
    (_SOLID if chr(_c).isalnum() else _MARK)[_c] = True
_MARK[ord("'")] = False


class WordTokenizer:
    """Token ids of whole texts through a bounded table of words.

    White space, and the border between a letter or digit and following ASCII
    punctuation, always separate the tokenizer's words; the tokenizer lowers
    case itself.  So texts are lowered and cut there, and only words not met
    before are encoded.  A third of the table takes the first words and keeps them
    as long as the worker lives.  The rest has two halves: when the younger is full
    (by bytes, so long words count as what they are) it replaces the older.
    """

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.half = table_bytes // 3
        self.kept: dict[str, bytes] = {}
        self.room = table_bytes // 3
        self.forget()

    def forget(self) -> None:
        """Drop the table of words, but for those kept."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes of uint32."""
        kept, young, old = self.kept.get, self.young.get, self.old.get
        ids = [kept(w) or young(w) or old(w) for w in words]
        new = [i for i, x in enumerate(ids) if x is None]
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            names = [words[i] for i in part]
            values = [array("I", e.ids).tobytes() for e in self.encode_batch(names, add_special_tokens=False)]
            for i, x in zip(part, values):
                ids[i] = x
            size = sum(map(len, names)) + sum(map(len, values)) + ENTRY_BYTES * len(part)
            if size <= self.room:
                self.kept.update(zip(names, values))
                self.room -= size
                continue
            if self.held + size > self.half:
                self.old, self.young, self.held = self.young, {}, 0
            if size <= self.half:
                self.young.update(zip(names, values))
                self.held += size
        return ids

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the len(texts) + 1 borders."""
        data, offsets = text_bytes(texts)
        if b"<|" not in memoryview(data).tobytes():  # special tokens are matched as written
            data = lower_ascii(data)
            solid = _SOLID[data]
            solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # two-byte letters
            cuts = np.flatnonzero(solid[:-1] & _MARK[data[1:]]) + 1
            data, offsets = np.insert(data, cuts, 32), offsets + np.searchsorted(cuts, offsets)
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        words = pc.ascii_split_whitespace(texts)
        borders = words.offsets.to_numpy()
        flat = words.flatten().dictionary_encode()
        ids = self.words(flat.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), np.uint32)
        starts = np.cumsum(lengths) - lengths
        at = flat.indices.to_numpy()
        counts = lengths[at]
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        picks = np.repeat(starts[at] - ends[:-1], counts) + np.arange(ends[-1])
        return table[picks], ends[borders - borders[0]]


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker; a task's table of words ends with the task, but for the words kept."""
    return WordTokenizer(path)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        try:
            for block in text_blocks(batches, 1, BLOCK_BYTES):
                ids, borders = tokenizer.texts(block.column(1))
                row, start, length, crc, total, lists = [], [], [], [], [], []
                for r in range(block.num_rows):
                    own = np.append(ids[borders[r] : borders[r + 1]], np.uint32(end_id))
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        row.append(r), start.append(s), length.append(len(piece))
                        crc.append(zlib.crc32(piece.astype("<u4").tobytes())), total.append(len(own))
                        if with_ids:
                            lists.append(piece.astype(np.int32))
                columns = [block.column(0).take(pa.array(row, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            tokenizer.forget()
            pa.default_memory_pool().release_unused()

    return run


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens`` and, on request, ``ids``."""
    fields = [T.StructField("id", docs.schema[id_col].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), T.StructType(fields))


def first_fit_decreasing(lengths: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset for each length (longest first, ties in the
    given order).  ``free[1]`` is the root of a tournament tree whose leaves
    are the sequences' free room and whose inner nodes hold the larger child."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    free = [capacity] * (2 * leaves)
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        where[i], offset[i] = node - leaves, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return where, offset


def _pack_group(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = sorted(
            range(table.num_rows),
            key=lambda i, a=table["id"].to_pylist(), b=table["start"].to_pylist(): (a[i] is None, a[i], b[i]),
        )
        table = table.take(pa.array(order, pa.int64()))
        where, offset = first_fit_decreasing(table["length"].to_pylist(), capacity)
        first = key[0].as_py() << 32
        table = table.drop_columns(["pack_group"])
        table = table.append_column("sequence_id", pa.array([first + w for w in where], pa.int64()))
        return table.append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
    pieces_per_group: int = PIECES_PER_GROUP,
    seed: int = 7,
) -> DataFrame:
    """The pieces of all documents with their ``sequence_id`` and ``offset``."""
    pieces = cut_lineage(
        token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids).withColumn("draw", F.rand(seed)),
        "table",
    )
    groups = max(1, -(-pieces.count() // pieces_per_group))
    grouped = pieces.withColumn("pack_group", F.floor(F.col("draw") * groups)).drop("draw")
    schema = T.StructType(
        [f for f in grouped.schema.fields if f.name != "pack_group"]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return grouped.groupBy("pack_group").applyInArrow(_pack_group(capacity), schema).withColumnRenamed("id", id_col)
