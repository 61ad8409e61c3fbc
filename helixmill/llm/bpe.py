"""Operator 2, byte-level BPE encoding and decoding.

The tokenizers library runs over Arrow batches and gives ids and offsets. The vocabulary file, a rank file or a
tokenizer JSON, is a parameter and has to be at that path on each executor. Decoding takes the characters of each id
in the library's vocabulary back to bytes by the reversed byte table, and joins bytes first, so a character that is
split across ids comes out whole.

Defined results: a null or empty text gives no ids and empty bytes; repeated rows give repeated results; an empty
table gives an empty result; other columns of the input are ignored, whatever their names; an id that isn't in the
vocabulary decodes to nothing. A text is taken whole, whatever its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import as_text, by_id, steps
from helixmill.llm.pieces import codec

#: Bytes of a generation of a worker's memo: small, since the pipeline's last stage runs in executors that earlier ones have filled.
MEMO = 16 << 20
#: Bytes of text of a step: every token takes three numbers before it leaves.
STEP = 500_000
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def encoded_steps(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and text to batches of doc_id, ids, and the code points where each id starts and ends."""
    own = codec(path, pattern, MEMO, True)
    for batch in steps(batches, size=STEP):
        rows, counts = own.placed(as_text(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(_lists(rows[:, i], counts) for i in range(3))], ["doc_id", "ids", "starts", "ends"])


def decoded_steps(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Adds ``decoded``, the bytes of ``ids``; null ids decode to no bytes."""
    own = codec(path, pattern, MEMO, True)
    for batch in batches:
        ids = pc.fill_null(batch.column("ids"), pa.scalar([], batch.column("ids").type))
        parts = own.decoded(pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False))
        ends = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, np.int64)
        out = [b"".join(parts[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        yield batch.append_column("decoded", pa.array(out, pa.binary()))


def offset_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts n_split (ids that begin where the one before hasn't ended) and offsets_crc32 in place of starts and ends."""
    for batch in batches:
        starts, ends = (batch.column(c).flatten().to_numpy() for c in ("starts", "ends"))
        at = batch.column("ids").offsets.to_numpy()
        at = at - at[0]
        inside = np.append(False, starts[1:] < ends[:-1])
        inside[at[:-1][at[:-1] < len(inside)]] = False
        split = np.concatenate([[0], np.cumsum(inside)])
        sums = [zlib.crc32(ends[a:b].tobytes(), zlib.crc32(starts[a:b].tobytes())) for a, b in zip(at[:-1], at[1:], strict=True)]
        out = batch.drop_columns(["starts", "ends"])
        yield out.append_column("n_split", pa.array(split[at[1:]] - split[at[:-1]], pa.int64())).append_column("offsets_crc32", pa.array(sums, pa.int64()))


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, starts and ends (exclusive): the code points that each id spans."""
    return by_id(docs, id_col, text_col).mapInArrow(lambda batches: encoded_steps(batches, path, pattern), "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: doc_id, ids, decoded (binary)."""
    kept = encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return kept.mapInArrow(lambda batches: decoded_steps(batches, path, pattern), "doc_id bigint, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one Python worker for each task: doc_id, ids, n_split, offsets_crc32, decoded (binary).

    n_split counts ids that begin inside a character that the id before spans too; offsets_crc32 is the checksum of all
    starts and then all ends as little-endian 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded_steps(offset_sums(encoded_steps(batches, path, pattern)), path, pattern)

    return by_id(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>, n_split bigint, offsets_crc32 bigint, decoded binary")


def decoded_text(decoded: Column) -> Column:
    """Decoded bytes as text: bytes that end or begin inside a character become U+FFFD."""
    return F.make_valid_utf8(decoded.cast("string"))


def digests(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode, decode, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, offsets_crc32."""
    return round_trip(docs, path, pattern).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
        "offsets_crc32",
    )
