"""Byte-level BPE: encoding by a contiguous rank array per short word, decoding by table lookup."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.batches import pieces, strings

#: The published pattern that cuts a text into words before merging (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts up to which a word is scanned for its minimum; longer words (one run of letters in a page) use a heap.
SHORT = 96
#: Encoded words that a worker remembers before it starts afresh; a bound on memory, not on results.
REMEMBERED = 100_000
NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The published printable letter of every byte: itself if printable, else 256 upward in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        self.rank = {(ids[a], ids[b]): i for i, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.byte = [ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen: dict[str, tuple[int, ...]] = {}

    def _short(self, word: bytes) -> tuple[int, ...]:
        # parts[i] is the id of the part that begins at the i-th boundary, so deleting an entry deletes a boundary
        parts = [self.byte[b] for b in word]
        rank, merged = self.rank.get, self.merged
        ranks = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
        return tuple(parts)

    def _long(self, word: bytes) -> tuple[int, ...]:
        """The same merges in the same order, the next minimum from a heap of (rank, left part)."""
        parts, n = [self.byte[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbouring parts; after 0: merged away
        rank = self.rank.get

        def joint(a: int) -> int:
            return rank((parts[a], parts[after[a]]), NEVER) if after[a] < n else NEVER

        heap = [(r, a) for a in range(n - 1) if (r := joint(a)) < NEVER]
        heapq.heapify(heap)
        while heap:
            r, a = heapq.heappop(heap)
            if not after[a] or joint(a) != r:
                continue
            b = after[a]
            parts[a], after[a], after[b] = self.merged[r], after[b], 0
            if after[a] < n:
                before[after[a]] = a
            for x in (before[a], a):
                if x >= 0 and (r := joint(x)) < NEVER:
                    heapq.heappush(heap, (r, x))
        return tuple(p for p, x in zip(parts, after) if x)

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        return self._short(raw) if len(raw) <= SHORT else self._long(raw)

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        found, seen = self.words.findall(text), self.seen
        new = [w for w in set(found) if w not in seen]
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = set(found)
        for w in new:
            seen[w] = self.word(w)
        return [seen[w] for w in found]

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(self._plain(text)))
        parts = self.cut.split(text)
        return list(chain.from_iterable(
            [self.special[p]] if i % 2 else chain.from_iterable(self._plain(p)) for i, p in enumerate(parts)
        ))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _model(source: str) -> ByteBpe:
    return ByteBpe(source)


def tokenizer_file(path: str) -> str:
    """The tokenizer's JSON, read once by the driver (a file of a few MB) and broadcast to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, source: str) -> DataFrame:
    """Adds ``ids array<int>`` to (doc_id, text): one row per row of ``docs``, repeated rows too.

    The literal text of a special token becomes its id. A null or empty text has no ids. Whole texts are
    encoded, whatever their length; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for b in pieces(batches):
            each = [model.encode(t) for t in strings(b)]
            ends = np.cumsum([0, *map(len, each)])
            flat = np.fromiter(chain.from_iterable(each), np.int32, ends[-1])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], ["doc_id", "text", "ids"])

    rows = docs.select("doc_id", "text")
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return rows.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, source: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, ids, decoded). No ids, or null, decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for b in pieces(batches, "ids"):
            flat = b.column(1).flatten().to_numpy().tolist()
            ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(b.column(1)), 0).to_pylist()]).tolist()
            text = pa.array([model.decode(flat[i:j]) for i, j in zip(ends, ends[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", "ids")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, source: str) -> DataFrame:
    """(doc_id, ids, decoded): ``bpe_encode`` and ``bpe_decode`` in one pass, with one Python worker for a task."""
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for b in pieces(batches, rows=256, most=1 << 20):
            each = [model.encode(t) for t in strings(b)]
            ends = np.cumsum([0, *map(len, each)])
            flat = np.fromiter(chain.from_iterable(each), np.int32, ends[-1])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            decoded = pa.array([model.decode(x) for x in each], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema)


def digests(decoded: DataFrame, ids: bool = False) -> DataFrame:
    return decoded.select(
        "doc_id", *(["ids"] if ids else []),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encode_and_decode(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """Encode, decode again, and give the digests of both (and the ids if asked for)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    source = tokenizer_file(path)
    return digests(bpe_round_trip(docs, source), ids)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
