"""Operator 4, token ids as length-delimited binary records with an offset index.

A shard file is a sequence of frames: length (uint64), its masked checksum (uint32), payload, the payload's masked
checksum (uint32), all little-endian. The checksum is CRC-32, masked by a rotation and a constant so that files of
checksums don't check themselves. A payload is doc_id (int64), number of ids (uint32), bytes of an id (uint8: 2 if
the vocabulary fits, else 4; its highest bit tells that doc_id is null) and the ids. The index beside a shard has doc_id,
frame offset and number of ids (int64 each; an offset with its bits flipped tells that doc_id is null), so records can be
read in any order. Shards hold ascending ranges of doc_id, nulls first, in ascending order.

Each task writes files under names of its own and reports them; only reported files count, so a task that runs again
or twice leaves none that are read. Files go to the shared folder through pyarrow's file systems.

Texts are taken whole, whatever their length. Defined results: a null or empty text has no ids but the end id; rows
with one doc_id stay together, ordered by ids; a null doc_id comes first, before the least number; an empty table gives
no shards and an empty result; columns of other names are ignored. A damaged frame raises.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm.common import as_text, by_id, quantiles, result_dir, shared_dir, steps, written
from helixmill.llm.pieces import codec

#: Bytes of a generation of a worker's memo: large, as encoding is most of the work here.
MEMO = 128 << 20
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
HEAD, TAIL, RECORD, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qIB"), struct.Struct("<qqq")
#: Fixed value of the mask.
MASK_DELTA = 0xA282EAD8
#: Bit of a payload's width by which a null doc_id is told.
NULL = 0x80
MANIFEST = "shard int, path string, index_path string, n_docs bigint, n_tokens bigint"


def masked(data: bytes) -> int:
    """The masked CRC-32."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A payload with its lengths and checksums."""
    length = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked(length)) + payload + TAIL.pack(masked(payload))


def frames(stream) -> Iterator[bytes]:
    """Payloads of a stream, checked."""
    while head := stream.read(HEAD.size):
        length, crc = HEAD.unpack(head)
        if crc != masked(head[:8]):
            raise ValueError("damaged frame length")
        payload = stream.read(length)
        if TAIL.unpack(stream.read(TAIL.size))[0] != masked(payload):
            raise ValueError("damaged frame")
        yield payload


def payload_of(doc_id: int | None, width: int, ids: bytes) -> bytes:
    """The payload of a document whose ids are already bytes of ``width`` each."""
    return RECORD.pack(doc_id or 0, len(ids) // width, width | NULL if doc_id is None else width) + ids


def entry_of(doc_id: int | None, offset: int, n: int) -> bytes:
    """An entry of the index."""
    return ENTRY.pack(doc_id or 0, ~offset if doc_id is None else offset, n)


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (uint32) of a payload."""
    doc_id, n, width = RECORD.unpack_from(payload)
    return None if width & NULL else doc_id, np.frombuffer(payload, f"<u{width & ~NULL}", n, RECORD.size).astype("<u4")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def shard_bounds(docs: DataFrame, shards: int, id_col: str = "doc_id") -> list[int]:
    """Upper ends of all shards but the last: approximate quantiles of the ids, from that column alone."""
    return quantiles(docs.select(F.col(id_col).cast("bigint").alias("doc_id")), "doc_id", shards)


def write_records(docs: DataFrame, folder: str | None = None, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, end_id: int | None = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, append ``end_id``, write shards. Returns the manifest, a row for each shard."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/records"
    bounds = shard_bounds(docs, shards or docs.rdd.getNumPartitions(), id_col)
    edges = np.array(bounds, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, MEMO)
        kind = "<u2" if max(own.size - 1, end_id or 0) < 2**16 else "<u4"
        end = b"" if end_id is None else np.array([end_id], kind).tobytes()
        for batch in steps(batches):
            ids = [np.frombuffer(own.packed(x), "<u4").astype(kind).tobytes() + end for x in as_text(batch.column("text"))]
            shard = np.array([0 if d is None else np.searchsorted(edges, d, "left") for d in batch.column("doc_id").to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shard), pa.array([int(kind[2])] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "shard", "width", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        out, shard = None, None
        done: list[tuple] = []

        def finish() -> None:
            if out:
                data.close()
                index.close()
                done.append((shard, f"{folder}/{name}.rec", f"{folder}/{name}.idx", n_docs, n_tokens))

        for batch in batches:
            for doc_id, at, width, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "width", "ids")), strict=True):
                if at != shard:
                    finish()
                    shard, name, n_docs, n_tokens, offset = at, f"{at:06d}-{uuid.uuid4().hex}", 0, 0, 0
                    out = data = store.open_output_stream(f"{base}/{name}.rec", buffer_size=1 << 20)
                    index = store.open_output_stream(f"{base}/{name}.idx", buffer_size=1 << 16)
                n = len(ids) // width
                data.write(whole := frame(payload_of(doc_id, width, ids)))
                index.write(entry_of(doc_id, offset, n))
                n_docs, n_tokens, offset = n_docs + 1, n_tokens + n, offset + len(whole)
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([],) * 5, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "index_path", "n_docs", "n_tokens"])

    encoded = by_id(docs, id_col, text_col).mapInArrow(encode, "doc_id bigint, shard int, width int, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return written(dealt.mapInArrow(write, MANIFEST))


def read_records(manifest: DataFrame) -> DataFrame:
    """All records: doc_id, start (ids before it in doc_id order), n_tokens, ids (binary, little-endian uint32)."""
    spark = manifest.sparkSession
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    shards = placed.agg(F.max("shard")).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, at = open_fs(path)
                with store.open_input_stream(at, buffer_size=1 << 20) as stream:
                    rows, held = [], 0
                    for payload in frames(stream):
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, start, len(ids), ids.tobytes()))
                        start, held = start + len(ids), held + len(ids)
                        if held > 500_000:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return placed.repartitionById((shards or 0) + 1, F.col("shard")).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def read_index(manifest: DataFrame) -> DataFrame:
    """The offset index: path, doc_id, offset, n_tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
                store, at = open_fs(index)
                with store.open_input_stream(at) as stream:
                    entries = np.frombuffer(stream.read(), "<i8").reshape(-1, 3)
                ids, null = entries[:, 0], entries[:, 1] < 0
                offsets = np.where(null, ~entries[:, 1], entries[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(entries), pa.string()), pa.array(ids, mask=null), pa.array(offsets), pa.array(entries[:, 2])], ["path", "doc_id", "offset", "n_tokens"])

    return manifest.select("path", "index_path").mapInArrow(read, "path string, doc_id bigint, offset bigint, n_tokens bigint")


def read_shuffled(manifest: DataFrame, seed: int, partitions: int) -> DataFrame:
    """Records in an order drawn from ``seed``, by seeking through the index: doc_id, n_tokens, ids (binary uint32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}
        for batch in batches:
            rows = []
            for path, offset in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                if path not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    store, at = open_fs(path)
                    opened[path] = store.open_input_file(at)
                opened[path].seek(offset)
                doc_id, ids = unpack(next(frames(opened[path])))
                rows.append((doc_id, 0, len(ids), ids.tobytes()))
            if rows:
                yield _batch(rows).drop_columns(["start"])

    order = F.xxhash64(F.lit(seed), "path", "offset")
    dealt = read_index(manifest).withColumn("__order", order).repartition(partitions, "__order").sortWithinPartitions("__order")
    return dealt.select("path", "offset").mapInArrow(read, "doc_id bigint, n_tokens bigint, ids binary")


def digests(docs: DataFrame) -> DataFrame:
    """Write, read back, digest: doc_id, start, n_tokens, ids_crc32."""
    return read_records(write_records(docs, result_dir(docs.sparkSession))).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def remove(spark: SparkSession, manifest: DataFrame) -> None:
    """Delete the files of a manifest."""
    for row in manifest.select("path", "index_path").toLocalIterator():
        for uri in row:
            store, at = open_fs(uri)
            store.delete_file(at)
