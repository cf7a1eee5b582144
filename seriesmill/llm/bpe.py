"""Byte-level BPE encoding and decoding.

Within a pre-token the symbols form a doubly linked list and a priority queue holds the ranks of adjacent pairs.
Taking the lowest rank merges the pair, links the neighbours and queues the two new pairs; queue entries whose symbols
have changed since are stale and are skipped. Decoding concatenates the byte strings of the vocabulary.

The vocabulary is a tokenizer file in the JSON form of the public ``tokenizers`` library; its path is a parameter and
the file must exist on every executor. Text of the added (special) tokens becomes their ids. Pre-tokens repeat, so a
worker remembers up to ``MEMO`` of them and starts over when these are full.

Defined results: null is treated as the empty text and has no tokens; repeated rows are encoded alike; ids of documents
are only carried. An empty table gives an empty result. Time per text is n log n in its longest pre-token, linear
otherwise. Columns other than the named ones are not read.
"""

from __future__ import annotations

import heapq
import json
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import ready

# Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 500_000
_ID_BITS = 32  # room for an id in a pair's number
_LONG = 64  # longer pre-tokens are not remembered


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where printable, else 256 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """Ids by pre-token, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.make(token)
        if len(token) <= _LONG:
            if len(self) >= MEMO:
                self.clear()
            self[token] = ids
        return ids


class Bpe:
    """Vocabulary and merge ranks of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.start = [vocab[c] for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}  # pair of ids in one number -> rank, id of the pair's union
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << _ID_BITS | vocab[b]] = rank, vocab[a + b]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        longest = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(longest) + ")") if longest else None
        self.pieces = regex.compile(PRE_TOKEN)
        self.memo = Memo(self.merge)

    def merge(self, token: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        start, found = self.start, self.merges.get
        ids = [start[b] for b in token.encode("utf-8", "replace")]
        end = len(ids)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        shift = end.bit_length()  # queue entries: rank, then place of the pair's left symbol
        place = (1 << shift) - 1
        queue = [m[0] << shift | i for i in range(end - 1) if (m := found(ids[i] << _ID_BITS | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & place
            j = after[i]
            if ids[i] < 0 or j >= end:
                continue  # stale: the symbol was merged into its neighbour, or has none any more
            m = found(ids[i] << _ID_BITS | ids[j])
            if m is None or m[0] != entry >> shift:
                continue  # stale: one of the two was merged meanwhile
            union = ids[i] = m[1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if m := found(union << _ID_BITS | ids[k]):
                    heapq.heappush(queue, m[0] << shift | i)
            h = before[i]
            if h >= 0 and (m := found(ids[h] << _ID_BITS | union)):
                heapq.heappush(queue, m[0] << shift | h)
        return tuple([i for i in ids if i >= 0])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part])
            else:
                out.extend(chain.from_iterable(map(self.memo.__getitem__, self.pieces.findall(part))))
        return out

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which strings of special tokens are plain text."""
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces.findall(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encoded(text: Column, path: str) -> Column:
    """Struct of ``ids`` and ``decoded``, the text that the ids decode to."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def of(texts: pa.Array) -> pa.Array:
        bpe, ids, ends, decoded = load(path), array("i"), [0], []
        for t in texts:
            own = bpe.encode(t.as_py() or "")
            decoded.append(bpe.decode(own))
            ids.extend(own)
            ends.append(len(ids))
        values = pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], ["ids", "decoded"])

    return of(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every row."""
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), encoded(F.col(text_col), path).alias("e")).select("doc_id", "e.ids", "e.decoded")
