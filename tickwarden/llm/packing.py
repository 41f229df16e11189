"""Token sequences of fixed length, packed in one pass with a fixed number of open windows."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.session import cut

LENGTH = 1024
OPEN = 64  # windows that a partition keeps open
MERGED = 16  # partitions whose left-over windows one task merges: at most 16 * 64 * 1024 ids
CHUNK = 1 << 20  # characters of a text encoded at a time
ROWS = 64  # texts held as Python strings at a time


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# How the vocabulary's splitter parts a text, and the characters on which both libraries part it alike.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + n): b for n, b in enumerate(rest)}}


class Encoder:
    """Ids of whole texts as `tokenizers` gives them for a byte-level vocabulary file, added tokens as their own ids.

    Texts of the characters in which `tiktoken` parts a text the same way get their ids from it, with the merges of the
    same file, in a fifth of the time. All others go through `tokenizers`, and so do texts that hold the string of one of
    the file's added tokens.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        self.cuttable = not any(" " in t for t in special)
        names = byte_names()
        ranks = {bytes(names[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def _chunks(self, text: str) -> Iterator[str]:
        """Stretches of about CHUNK characters, cut where a space stands alone between characters that are no white space.

        Such a space always begins a part and lies in no added token, so the ids of the stretches are those of the text.
        """
        if not self.cuttable:
            yield text
            return
        at = 0
        while at < len(text):
            end = text.find(" ", at + CHUNK)
            while end > 0 and (text[end - 1].isspace() or end + 1 >= len(text) or text[end + 1].isspace()):
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end

    def ids(self, text: str | None) -> np.ndarray:
        """All ids of the text as unsigned 32-bit integers; None has none."""
        out = [np.empty(0, dtype="<u4")]
        for chunk in self._chunks(text or ""):
            slow = OTHER.search(chunk) or self.added.search(chunk)
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids if slow else self.fast.encode_ordinary(chunk)
            out.append(np.array(found, dtype="<u4"))
        return np.concatenate(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("left", T.BooleanType()),
])


class Windows:
    """Open windows by free space. A window is [free, serial number, pieces]."""

    def __init__(self, length: int, limit: int) -> None:
        self.length, self.limit, self.made = length, limit, 0
        self.free: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}

    def put(self, piece, size: int) -> tuple[int, list] | None:
        """Place a piece in the window it fills best. If none has room and the limit is reached, the fullest is closed."""
        closed = None
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, serial = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                _, full = self.free.pop(0)
                closed = full, self.pieces.pop(full)
            room, serial = self.length, self.made
            self.made += 1
            self.pieces[serial] = []
        self.pieces[serial].append((piece, self.length - room, size))
        insort(self.free, (room - size, serial))
        return closed


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def pieces(docs: DataFrame, key: str, text: str, path: str, length: int, limit: int, end: int, with_ids: bool) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids, left) of one pass over each partition.

    Whole windows are cut off a long document; its rest is placed best-fit. Windows still open at the end are marked
    `left` and carry their ids.
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *PIECE.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, windows, part = encoder(path).ids, Windows(length, limit), TaskContext.get().partitionId()
        whole, key_type = 0, None
        rows: list[tuple] = []

        def row(k, start, ids, total, sequence, offset, left):
            rows.append((k, start, len(ids), _crc(ids), total, sequence, offset, ids.tobytes() if left or with_ids else None, left))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            types = [key_type, *[pa.int64()] * 6, pa.binary(), pa.bool_()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=schema.names)

        def close(serial: int, placed: list, left: bool):
            for (k, start, ids, total), offset, _ in placed:
                row(k, start, ids, total, part << 32 | serial << 1, offset, left)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                keys, texts = batch.column(0).slice(at, ROWS).to_pylist(), batch.column(1).slice(at, ROWS).to_pylist()
                for k, t in zip(keys, texts):
                    ids = np.append(ids_of(t), np.uint32(end))
                    total = len(ids)
                    for start in range(0, total - total % length, length):
                        row(k, start, ids[start:start + length], total, part << 32 | whole << 1 | 1, 0, False)
                        whole += 1
                    if total % length:
                        start = total - total % length
                        closed = windows.put((k, start, ids[start:], total), total - start)
                        if closed:
                            close(*closed, left=False)
                    if len(rows) >= 4096:
                        yield flush()
        for serial, placed in windows.pieces.items():
            close(serial, placed, left=True)
        if key_type is not None:
            yield flush()

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(work, schema)


def merge(left: DataFrame, length: int, with_ids: bool) -> DataFrame:
    """The windows that partitions left open, laid end to end and cut every `length` ids, MERGED partitions a task.

    Only the last sequence of a task is shorter. At most OPEN windows a partition come here, whatever its size.
    """
    group = F.shiftright("sequence_id", 32) / MERGED
    schema = T.StructType(left.schema.fields)

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        first = (rows[0]["sequence_id"] >> 32) // MERGED
        out, filled = [], 0
        for r in rows:
            ids, at = np.frombuffer(r["ids"], dtype="<u4"), 0
            while at < len(ids):
                size = min(len(ids) - at, length - filled % length)
                part = ids[at:at + size]
                out.append({**r, "start": r["start"] + at, "length": size, "ids_crc32": _crc(part), "offset": filled % length,
                            "sequence_id": 1 << 62 | first << 32 | filled // length, "ids": part.tobytes() if with_ids else None})
                at, filled = at + size, filled + size
        return pa.Table.from_pylist(out, schema=table.schema)

    return left.groupBy(F.floor(group).alias("g")).applyInArrow(work, schema)


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH,
    limit: int = OPEN, end: int = 0, with_ids: bool = False,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): every id of every document in one piece.

    A document is the ids of its text and then the id `end`; null and empty texts are `end` alone. Each partition reads
    its documents once and keeps `limit` windows open: a rest goes to the window it fills best; if none has room, the
    fullest window is closed and a new one opened. Windows open at the end of a partition are merged with those of
    other partitions, where pieces may be cut again. Closed windows may stay a few ids short; padding is left to the
    reader. `path` is the tokenizer file on every executor, the public one by default. Memory is bounded by the longest
    text and by `limit` windows. Null keys and repeated rows are documents of their own. No rows give no rows.
    """
    path = path or vocabulary_path()
    placed = cut(pieces(docs, key, text, path, length, limit, end, with_ids))
    merged = merge(placed.filter("left"), length, with_ids)
    both = placed.filter("not left").union(merged)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return both.select(F.col("key").alias(key), *names)
