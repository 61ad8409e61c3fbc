"""Byte-level BPE over pre-split pieces: vocabularies, the byte-to-character table, packed ids.

A text is cut by the tokenizer's own split pattern; a piece's ids depend on the piece alone, so each
worker memoises them in a bounded memo and joins packed ids. That gives what encoding the whole text
gives, at the cost of a lookup for most pieces.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

from helixmill.llm.common import MEMO_BYTES, Memo


@functools.cache
def byte_table() -> tuple[str, ...]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return tuple(table[b] for b in range(256))


def to_chars(data: bytes) -> str:
    """Bytes as the characters of the byte table."""
    return "".join(map(byte_table().__getitem__, data))


@functools.cache
def _bytes_of_char() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_table())}


def to_bytes(chars: str) -> bytes:
    """Reverses ``to_chars``."""
    return bytes(map(_bytes_of_char().__getitem__, chars))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """Every pair of tokens whose concatenation is a token, by the rank of that token.

    Rank files name tokens only, and merging by them takes any adjacent pair that forms one.
    """
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((to_chars(token[:cut]), to_chars(token[cut:])))
    return merges


#: What ``public_tokenizers.PATTERN`` comes to on ASCII texts, for the faster standard library.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that lists the matches of ``pattern`` in a text."""
    find = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return find
    find_ascii = re.compile(ASCII_PATTERN).findall
    return lambda text: find_ascii(text) if text.isascii() else find(text)


class Codec:
    """Encodes texts by the tokenizers library, and decodes ids by the reversed byte table.

    With ``offsets`` the memo holds id, start and end of each token of a piece, else ids alone, as packed little-endian
    uint32 numbers.
    """

    def __init__(self, path: str, pattern: str, memo_bytes: int = MEMO_BYTES, offsets: bool = False) -> None:
        self.find, self.pattern, self.offsets = splitter(pattern), regex.compile(pattern), offsets
        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
            spec = json.loads(self.tokenizer.to_str())
            check_byte_level(path, spec)
            self.special = {x["id"]: x["content"] for x in spec["added_tokens"]}
        else:
            ranks = read_ranks(path)
            self.tokenizer = Tokenizer(models.BPE(vocab={to_chars(t): r for t, r in ranks.items()}, merges=merges_of(ranks), ignore_merges=True))
            self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.special = {}
        self.model = self.tokenizer.model
        self.memo = Memo(self._placed if offsets else self._piece, memo_bytes)
        chars = self.tokenizer.get_vocab(with_added_tokens=False)
        known = {i: to_bytes(token) for token, i in chars.items()} | {i: x.encode() for i, x in self.special.items()}
        self.size = max(known) + 1
        #: The bytes of each id; the last entry stands for ids that aren't in the vocabulary, which decode to nothing.
        self.bytes_of = np.array([*(known.get(i, b"") for i in range(self.size)), b""], dtype=object)

    def _piece(self, piece: str) -> bytes:
        """A piece goes to the library's model in characters of the byte table, past its splitting and offsets."""
        chars = piece.encode("utf-8").decode("latin-1").translate(byte_table())
        return array("I", [token.id for token in self.model.tokenize(chars)]).tobytes()

    def _placed(self, text: str) -> bytes:
        """Ids with the library's offsets: code points from the beginning of ``text``, ids that share one both span it."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return array("I", [x for i, (start, end) in zip(found.ids, found.offsets, strict=True) for x in (i, start, end)]).tobytes()

    def _whole(self, text: str) -> bool:
        return any(x in text for x in self.special.values())

    def packed(self, text: str) -> bytes:
        """Ids of a whole text; a text that holds an added token goes to the library whole."""
        if self._whole(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def placed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row (id, start, end) for each token of all texts, and the number of tokens of each text."""
        values, starts, counts = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self._whole(text):
                own, begins = [self._placed(text)], [0]
            else:
                pieces = self.find(text)
                own, begins = list(map(self.memo.__getitem__, pieces)), list(itertools.accumulate(map(len, pieces), initial=0))
                if begins.pop() != len(text):  # the pattern leaves something out
                    begins = [m.start() for m in self.pattern.finditer(text)]
            values += own
            starts += begins
            counts[i] = sum(map(len, own)) // 12
        rows = np.frombuffer(b"".join(values), "<u4").reshape(-1, 3).astype(np.int32)
        rows[:, 1:] += np.repeat(np.array(starts, np.int32), np.fromiter(map(len, values), np.int64, len(values)) // 12)[:, None]
        return rows, counts

    def decoded(self, ids: np.ndarray) -> list[bytes]:
        """The bytes of each id; nothing for one that isn't in the vocabulary."""
        known = (ids >= 0) & (ids < self.size)
        return self.bytes_of[np.where(known, ids, self.size)].tolist()


def check_byte_level(path: str, spec: dict) -> None:
    """Raises unless a tokenizer JSON is a byte-level BPE that splits by its own pattern and adds nothing."""
    before = spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or not plain:
        raise ValueError(f"{path} is not a byte-level BPE without normaliser, prefix space and with its own split")


@functools.lru_cache(maxsize=4)
def _codec(path: str, pattern: str, memo_bytes: int, offsets: bool) -> Codec:
    return Codec(path, pattern, memo_bytes, offsets)


def codec(path: str, pattern: str, memo_bytes: int = MEMO_BYTES, offsets: bool = False) -> Codec:
    """One codec for a Python worker, the memos of other operators emptied."""
    own = _codec(path, pattern, memo_bytes, offsets)
    own.memo.alone()
    return own
