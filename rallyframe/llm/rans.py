"""Token archives coded by a static range asymmetric numeral system.

A segment is one row: a table of token frequencies shared by the segment's blocks, and the blocks. Each block is coded
by itself over LANES interleaved states; a checkpoint every CHECKPOINT tokens holds the place in the block's words and
all states, so decoding may begin there; a CRC-32 stands over the tokens between checkpoints, over the whole segment and
over its index. `read_archive` decodes segments in parallel, `fetch` single documents from the checkpoints before them. Documents
are in ascending order of id, whole in one segment, and the row lists their ids and lengths, so that any executor
decodes any segment.

Null texts are empty and hold the end id only; rows with equal ids stay apart, in the order of their text; rows with a
null id come first; an empty table gives an empty archive; a text of any length is one document of one segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, bounded_batches, slices, stored, texts_of
from .pieces import PIECES, encoder

MAGIC = b"RTA1"
LANES = 1024
CHECKPOINT = 1 << 17
BLOCK = 1 << 19
SEGMENT = 1 << 21
_LOW = np.uint64(1 << 31)


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to sum to 2**bits, at least 1 each."""
    total = 1 << bits
    out = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    over = int(out.sum()) - total
    while over > 0:  # what rounding up has added is taken from the most frequent
        take = np.minimum(out[order] - 1, np.maximum(1, out[order] * over // (2 * total)))
        take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        out[order] -= take
        over -= int(take.sum())
    out[order[0]] -= over
    return out


def encode_block(symbols: np.ndarray, freq: np.ndarray, bits: int) -> bytes:
    """symbols: places in freq. The words are in the order in which decoding reads them."""
    n, k = len(symbols), np.uint64(bits)
    f, c = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    state = np.full(LANES, _LOW, np.uint64)
    words, marks, count = [], [], 0
    for row in range((n - 1) // LANES, -1, -1):
        s = symbols[row * LANES : (row + 1) * LANES]
        x, fs = state[: len(s)], f[s]
        full = x >= (fs << np.uint64(63 - bits))
        if full.any():
            words.append(x[full].astype(np.uint32))
            count += len(words[-1])
            x[full] >>= np.uint64(32)
        q = x // fs
        state[: len(s)] = (q << k) + (x - q * fs) + c[s]
        if row * LANES % CHECKPOINT == 0:
            marks.append((count, state.copy()))
    out = [struct.pack("<III", n, count, len(marks))]
    for at, x in reversed(marks):
        out += [struct.pack("<I", count - at), x.astype("<u8").tobytes()]
    return b"".join([*out, *(w.astype("<u4").tobytes() for w in reversed(words))])


def decode_block(data: bytes, freq: np.ndarray, bits: int, mark: int = 0, until: int | None = None) -> np.ndarray:
    """The symbols from checkpoint number `mark` on, to the block's end or up to symbol number `until`."""
    n, count, marks = struct.unpack_from("<III", data)
    step = 4 + 8 * LANES
    pos = struct.unpack_from("<I", data, 12 + mark * step)[0]
    state = np.frombuffer(data, "<u8", LANES, 16 + mark * step).astype(np.uint64)
    words = np.frombuffer(data, "<u4", count, 12 + marks * step)
    f, c = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    symbol_of = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.int32), freq)
    mask, k, first = np.uint64((1 << bits) - 1), np.uint64(bits), mark * CHECKPOINT
    whole, n = n, n if until is None else min(n, until)
    out = np.empty(n - first, np.int32)
    for row in range(0, n - first, LANES):
        x = state[: min(LANES, n - first - row)]
        slot = x & mask
        s = symbol_of[slot]
        x = f[s] * (x >> k) + slot - c[s]
        low = x < _LOW
        if m := int(np.count_nonzero(low)):
            x[low] = (x[low] << np.uint64(32)) | words[pos : pos + m]
            pos += m
        state[: len(x)] = x
        out[row : row + len(x)] = s
    if n == whole and (state != _LOW).any():
        raise ValueError("a block doesn't end in the state that its encoding began with")
    return out


def encode_segment(ids: np.ndarray) -> bytes:
    counts = np.bincount(ids)
    present = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[present] = np.arange(len(present))
    symbols = place[ids]
    bits = int(min(20, max(12, np.ceil(np.log2(max(2, len(present)))) + 2)))
    freq = frequencies(counts[present], bits)
    blocks = [encode_block(symbols[i : i + BLOCK], freq, bits) for i in range(0, len(ids), BLOCK)]
    table = zlib.compress(np.diff(present, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    sums = [zlib.crc32(ids[i : i + CHECKPOINT].astype("<u4").tobytes()) for i in range(0, len(ids), CHECKPOINT)]
    head = struct.pack("<4sBIIII", MAGIC, bits, len(present), len(table), len(blocks), len(sums)) + struct.pack(f"<{len(blocks) + len(sums)}I", *map(len, blocks), *sums)
    body = b"".join([head, table, *blocks])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_segment(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The segment's ids, or those from number start up to stop, of which only the stretches between checkpoints around them are decoded.

    Raises ValueError where a checksum doesn't hold: the segment's if all is read, else those of the stretches.
    """
    whole = start == 0 and stop is None
    if data[:4] != MAGIC or whole and zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a segment, or damaged")
    _, bits, n, size, blocks, stretches = struct.unpack_from("<4sBIIII", data)
    told = struct.unpack_from(f"<{blocks + stretches}I", data, 21)
    at = 21 + 4 * (blocks + stretches)
    table = np.frombuffer(zlib.decompress(data[at : at + size]), "<u4")
    present, freq, at, out = np.cumsum(table[:n], dtype=np.int64), table[n:].astype(np.int64), at + size, []
    stop = blocks * BLOCK if stop is None else stop
    first = start // CHECKPOINT * CHECKPOINT
    for i in range(blocks):
        low, high = max(first, i * BLOCK), min(-(-stop // CHECKPOINT) * CHECKPOINT, (i + 1) * BLOCK)
        if low < high:
            ids = present[decode_block(data[at : at + told[i]], freq, bits, (low - i * BLOCK) // CHECKPOINT, high - i * BLOCK)].astype("<u4")
            for k in range(0, len(ids), CHECKPOINT):
                if zlib.crc32(ids[k : k + CHECKPOINT].tobytes()) != told[blocks + (low + k) // CHECKPOINT]:
                    raise ValueError(f"the stretch at {low + k} is damaged")
            out.append(ids)
        at += told[i]
    return np.concatenate(out)[start - first : stop - first] if out else np.zeros(0, "<u4")


def index_sum(ids: pa.Array, lengths: np.ndarray) -> int:
    """The checksum of a segment's index."""
    return zlib.crc32(lengths.astype("<i8").tobytes(), zlib.crc32("\0".join(map(repr, ids.to_pylist())).encode()))


def write_archive(docs: DataFrame, path: str, *, end: int = 0, id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encodes whole texts, the end id after each, and returns the written archive: part, seq, before (the part's tokens before this segment), ids, lengths, index_crc32, data.

    Segments are in order by (part, seq). Only the texts are shuffled, once, by ranges of ids.
    """
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("before", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id].dataType)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("index_crc32", T.LongType()), T.StructField("data", T.BinaryType())])
    kind = pa.list_(arrow_type(docs, id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = encoder(path, PIECES), TaskContext.get().partitionId(), 0
        ids, lengths, parts, held, before = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([ids], kind), pa.array([lengths], pa.list_(pa.int64())), pa.array([index_sum(pa.array(ids, kind.value_type), np.array(lengths))], pa.int64()), pa.array([encode_segment(np.concatenate(parts))], pa.binary())], ["part", "seq", "before", "ids", "lengths", "index_crc32", "data"])

        for batch in batches:
            for piece in slices(batch, text):
                tokens, counts = coder.encode(texts_of(piece, text))
                bounds = np.cumsum(counts)
                tokens = np.insert(tokens.astype(np.uint32), bounds, end)  # the end id after each document
                bounds = bounds + np.arange(1, len(bounds) + 1)
                names, first, last = piece.column(id).to_pylist(), 0, 0
                for i, to in enumerate(bounds.tolist()):
                    if held + to - last >= SEGMENT or i == len(names) - 1:
                        parts.append(tokens[last:to])
                        held += to - last
                        ids += names[first : i + 1]
                        lengths += (counts[first : i + 1] + 1).tolist()
                        first, last = i + 1, to
                        if held >= SEGMENT:
                            yield flush()
                            ids, lengths, parts, held, before, seq = [], [], [], 0, before + held, seq + 1
        if ids:
            yield flush()

    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = bounded_batches(docs).select(id, text).repartitionByRange(n, F.col(id).asc_nulls_first()).sortWithinPartitions(F.col(id).asc_nulls_first(), text)
    return stored(ordered.mapInArrow(run, schema), "archive")


def read_archive(archive: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """One row per document from the archive's bytes: id, start (ids of all documents before it), n_tokens, ids_crc32, checked on the way."""
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = {r["part"]: r["n"] for r in archive.groupBy("part").agg(F.sum(size).alias("n")).collect()}  # a row for each writing task
    total, base = 0, {}
    for part in sorted(parts):
        base[part], total = total, total + parts[part]
    kind = archive.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens = decode_segment(batch.column("data")[row].as_py())
                length = checked_lengths(batch, row)
                ends = np.cumsum(length)
                if len(tokens) != (ends[-1] if len(ends) else 0):
                    raise ValueError("the index and the tokens differ")
                first = base[batch.column("part")[row].as_py()] + batch.column("before")[row].as_py()
                sums = [zlib.crc32(memoryview(tokens[e - n : e]).cast("B")) for e, n in zip(ends, length, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, pa.array(first + ends - length), pa.array(length), pa.array(sums, pa.int64())], [id, "start", "n_tokens", "ids_crc32"])

    return archive.select("part", "before", "ids", "lengths", "index_crc32", "data").mapInArrow(run, f"{id} {kind}, start long, n_tokens long, ids_crc32 long")


def checked_lengths(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """A segment's lengths, if its index is sound."""
    length = np.array(batch.column("lengths")[row].as_py(), np.int64)
    if index_sum(batch.column("ids")[row].values, length) != batch.column("index_crc32")[row].as_py():
        raise ValueError("a segment's index is damaged")
    return length


def fetch(archive: DataFrame, wanted: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """id, tokens of the documents with an id in `wanted`, each decoded from the checkpoint before it on.

    The ids are met with the segments' indexes first, so only segments that hold one are read, each in one task.
    """
    ids = wanted.select(F.col(id).alias("_want")).distinct()
    held = archive.select("part", "seq", F.explode("ids").alias("_have")).join(ids, F.col("_have").eqNullSafe(F.col("_want")))
    asked = held.groupBy("part", "seq").agg(F.max(F.col("_want").isNull()).alias("null"), F.collect_set("_want").alias("which"))
    kind = archive.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                length = checked_lengths(batch, row)
                ends, data = np.cumsum(length), batch.column("data")[row].as_py()
                names, which = batch.column("ids")[row].values, set(batch.column("which")[row].as_py())
                if batch.column("null")[row].as_py():
                    which.add(None)
                at = [i for i, x in enumerate(names.to_pylist()) if x in which]
                tokens = [decode_segment(data, int(ends[i] - length[i]), int(ends[i])).astype(np.int32) for i in at]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at, pa.int64())), pa.array(tokens, pa.list_(pa.int32()))], [id, "tokens"])

    return archive.join(asked, ["part", "seq"]).select("ids", "lengths", "index_crc32", "which", "null", "data").mapInArrow(run, f"{id} {kind}, tokens array<int>")
