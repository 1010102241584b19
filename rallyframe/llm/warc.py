"""WARC archives: writing with revisits of equal payloads, and reading with boundaries proved by a chain.

Writing: a record is a line of Spark's text sink whose line end is CR LF CR LF, which is how a WARC record ends; so
archives land in any store that Spark writes to. Reading: Spark's text source cuts the files at the record magic, inside
splits of any size. Every such place, also inside a payload, is a candidate with the offset where its successor would
begin. Only what is reached from the file's start is a record: tasks follow successors inside a split to its exit,
pointer jumping over splits finds each split's true entry, and tasks then keep the records from there. A payload that
holds the magic is put together from its pieces again.

Null html is an empty payload, a null url an empty one; rows of equal ids are records of their own; a null id is kept
and never referred to; an empty table gives no records; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_dir, slices, stored

MAGIC, CRLF2 = b"WARC/1.0\r\n", b"\r\n\r\n"
RANGE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, url: str, payload: bytes, refers: str | None) -> bytes:
    """A record without the CR LF CR LF that ends it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + CRLF2 + block


def write_warc(pages: DataFrame, path: str | None = None, *, min_bytes: int = 0, id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Writes one archive for each partition and returns their folder. Of equal payloads of min_bytes and more, all but the smallest id's are revisits."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(html), F.lit(""))
    sums = pages.select(F.col(id).alias("_id"), F.unhex(F.sha2(payload.cast("binary"), 256)).alias("_h"), F.octet_length(payload).alias("_n")).filter(F.col("_n") >= min_bytes)
    first = sums.groupBy("_h").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    again = stored(sums.join(first, "_h").filter("_id <> _first").select("_id", F.xxhash64("_h").alias("_h"), "_first").distinct(), "revisits")
    if again.count() <= BROADCAST_ROWS:  # else the payloads are shuffled once
        again = F.broadcast(again)
    rows = pages.select(F.col(id).alias("_of"), F.coalesce(url, F.lit("")).alias("_url"), payload.cast("binary").alias("_payload"))
    rows = rows.join(again, (F.col("_of") == F.col("_id")) & (F.xxhash64(F.unhex(F.sha2("_payload", 256))) == F.col("_h")), "left").select(F.col("_of").cast("string").alias("_of"), "_url", "_payload", F.col("_first").cast("string").alias("_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_payload"):
                own = [record(x["_of"] or "", x["_url"], x["_payload"], x["_first"]) for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], ["r"])

    rows.mapInArrow(run, "r binary").select(F.col("r").cast("string").alias("value")).write.option("lineSep", CRLF2.decode()).text(path)
    return path


def parsed(chunk: bytes) -> tuple | None:
    """Of the bytes after a magic: header length, content length, type, id, refers to, digest; None if they are no header."""
    end = chunk.find(CRLF2)
    if end < 0:
        return None
    fields = {}
    for line in chunk[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        return None
    bare = lambda k: fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")
    return end + 4, int(fields["content-length"]), fields.get("warc-type", ""), bare("warc-record-id"), bare("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha1:")


def payload_of(kind: str, block: bytes, told: str) -> int:
    """Bytes of the whole payload, which a revisit tells in its headers; -1 if the digest doesn't hold."""
    head, _, payload = block.partition(CRLF2)
    if kind == "revisit":
        said = re.search(rb"(?i)content-length: *(\d+)", head)
        return int(said[1]) if said else -1
    return len(payload) if digest(payload) == told else -1


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash of its path), block, value: what stands between magics, in order within each split."""
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _places() -> callable:
    """A function that tells where in its split each next chunk begins."""
    at: dict = {}

    def place(file: int, block: int, size: int) -> int:
        if at.get("of") != (file, block):
            at.update(of=(file, block), next=0)
        here = at["next"]
        at["next"] = here + size + len(MAGIC)
        return here

    return place


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, block, p (the offset after a magic), next (where its successor's p would be, null if none), whole, and what the header and the payload say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places()
        names = ["file", "block", "at", "size", "step", "whole", "type", "id", "refers", "bytes", "digest"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                at, found, tail = place(file, block, len(value)), parsed(value), (None,) * 7
                if found:
                    head, size, kind, name, refers, told = found
                    step = head + size + 4
                    whole = step == len(value)
                    tail = (step, whole, kind, name, refers, payload_of(kind, value[head : head + size], told) if whole else None, told)
                rows.append((file, block, at, len(value), *tail))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 11, kinds, strict=True)], names)

    found = stored(_chunks(spark, path).mapInArrow(run, "file long, block long, at long, size long, step long, whole boolean, type string, id string, refers string, bytes long, digest string"), "candidates")
    return found.join(split_bases(found), ["file", "block"]).withColumn("p", F.col("base") + F.col("at")).filter("p > 0").withColumn("next", F.col("p") + F.col("step") + len(MAGIC)).drop("at", "base")


def split_bases(found: DataFrame) -> DataFrame:
    """file, block, base: where in its file each split's first chunk begins."""
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from their file's start."""

    def exits(table: pa.Table) -> pa.Table:
        p, succ = table.column("p").to_numpy(), table.column("next").fill_null(-1).to_numpy()
        order = np.argsort(-p)
        out = dict()
        for i in order.tolist():  # successors stand behind, so they are known already
            out[int(p[i])] = out.get(int(succ[i]), int(succ[i]))
        return pa.table({"file": table.column("file"), "block": table.column("block"), "p": table.column("p"), "exit": pa.array([out[int(x)] for x in p], pa.int64())})

    jump = stored(found.select("file", "block", "p", "next").groupBy("file", "block").applyInArrow(exits, "file long, block long, p long, exit long"), "exits")
    entries = stored(jump.filter(F.col("p") == len(MAGIC)).select("file", "p"), "entries")
    known = entries.count()
    while True:  # each turn doubles the splits that a jump passes
        step = entries.join(jump, ["file", "p"]).select("file", F.col("exit").alias("p"))
        entries = stored(entries.union(step).distinct().join(jump.select("file", "p"), ["file", "p"]), "entries")
        now = entries.count()
        if now == known:
            break
        known = now
        far = jump.select("file", F.col("p").alias("exit"), F.col("exit").alias("far"))
        jump = stored(jump.join(far, ["file", "exit"], "left").select("file", "block", "p", F.coalesce("far", "exit").alias("exit")), "exits")

    first = entries.join(jump.select("file", "p", "block"), ["file", "p"]).groupBy("file", "block").agg(F.min("p").alias("entry"))

    def follow(table: pa.Table) -> pa.Table:
        p, succ = table.column("p").to_numpy(), table.column("next").fill_null(-1).to_numpy()
        where, at, kept = {x: i for i, x in enumerate(p.tolist())}, table.column("entry")[0].as_py(), []
        while at in where:
            kept.append(where[at])
            at = int(succ[where[at]])
        return table.drop_columns(["entry"]).take(pa.array(kept, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.join(first, ["file", "block"]).select(*found.columns, "entry").groupBy("file", "block").applyInArrow(follow, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, type, refers, bytes and digest of the whole payload."""
    found = stored(candidates(spark, path), "placed")
    records = stored(reachable(found), "records")
    whole = records.filter("whole").select("id", "type", "refers", "bytes", "digest")
    sound = F.when(F.col("bytes") < 0, F.raise_error(F.lit("a payload's digest doesn't hold")).cast("long")).otherwise(F.col("bytes")).alias("bytes")
    torn = records.filter("not whole or whole is null").select("file", F.col("p").alias("start"), F.col("next").alias("end"), "type", "id", "refers", "digest")
    if torn.isEmpty():
        return whole.withColumn("bytes", sound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places()
        for batch in batches:
            at = [place(f, b, len(v)) for f, b, v in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["file", "block", "value", "at"])

    placed = _chunks(spark, path).mapInArrow(run, "file long, block long, value binary, at long")
    bases = stored(split_bases(placed.select("file", "block", F.octet_length("value").alias("size"))), "bases")
    placed = placed.join(torn.select("file").distinct(), "file", "left_semi").join(bases, ["file", "block"]).withColumn("p", F.col("base") + F.col("at"))
    # Pieces meet records by ranges of offsets, so that a file's pieces aren't held against all of its torn records.
    ranges = torn.withColumn("range", F.explode(F.sequence(F.floor(F.col("start") / RANGE), F.floor((F.col("end") - 1) / RANGE))))
    parts = placed.withColumn("range", F.floor(F.col("p") / RANGE)).join(ranges, ["file", "range"]).filter("p >= start and p < end")

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("p")
        text = MAGIC.join(table.column("value").to_pylist())
        head, size, kind, name, refers, told = parsed(text)
        size = payload_of(kind, text[head : head + size], told)
        return pa.table({"id": [name], "type": [kind], "refers": [refers], "bytes": pa.array([size], pa.int64()), "digest": [told]})

    mended = parts.select("file", "start", "p", "value").groupBy("file", "start").applyInArrow(join, "id string, type string, refers string, bytes long, digest string")
    return whole.union(mended).withColumn("bytes", sound)
