"""Operator 10, token counts by heap-and-linked-list byte-pair merging.

A piece starts as one symbol for each byte. A heap holds the adjacent pairs that the vocabulary merges, lowest rank
first; each pop joins two neighbours of a linked list. The count is the initial symbols minus the merges, so no ids
are made. Pieces repeat, so each worker memoises their counts in a bounded memo.

Defined results: a null or empty text has 0 bytes and 0 tokens; an added token's string inside a text counts as one
token, as the library takes it by default; texts are taken whole, whatever their length; repeated rows give repeated
results; an empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Memo, as_text, by_id, steps
from helixmill.llm.pieces import check_byte_level, splitter, to_chars

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512


class MergeCounter:
    """Counts the tokens of a text under a byte-level BPE tokenizer JSON."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        check_byte_level(path, spec)
        if model.get("ignore_merges"):
            raise ValueError(f"{path} takes pieces of its vocabulary whole, past their merges")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or stand as words only are not covered")
        vocab = model["vocab"]
        self.symbol = [vocab[to_chars(bytes([b]))] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for at, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[left], vocab[right]] = (at, vocab[left + right])
        self.find = splitter(pattern)
        added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.added = added
        self.cut = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.memo = Memo(self.count_piece)

    def count_piece(self, piece: str) -> int:
        """Symbols left after all merges of one piece."""
        symbols = [self.symbol[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank, merges = self.rank, 0
        heap = [(r[0], i, symbols[i], symbols[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = joined, -1
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if r := rank.get((joined, symbols[k])):
                    heapq.heappush(heap, (r[0], i, joined, symbols[k], r[1]))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], joined))):
                heapq.heappush(heap, (r[0], h, symbols[h], joined, r[1]))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.cut and any(x in text for x in self.added):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, self.find(p))) for p in parts)
        return sum(map(self.memo.__getitem__, self.find(text)))


@functools.lru_cache(maxsize=4)
def _counter(path: str, pattern: str) -> MergeCounter:
    return MergeCounter(path, pattern)


def counter(path: str, pattern: str) -> MergeCounter:
    """One counter for a Python worker, the memos of other operators emptied."""
    own = _counter(path, pattern)
    own.memo.alone()
    return own


def count_tokens(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in steps(batches):
            texts = as_text(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "n_tokens": pa.array([own.count(x) for x in texts], pa.int64())})

    counted = by_id(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
