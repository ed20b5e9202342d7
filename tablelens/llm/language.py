"""Language identification by prediction by partial matching: exact code lengths under frozen byte context trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.batches import pieces, strings
from tablelens.llm.sampling import held_out, sample_per_value

#: Longest context in bytes.
ORDER = 3
#: Bounds of the sample that a model is fitted on: pieces of texts per language, and bytes of a piece.
PIECES_PER_LANGUAGE, BYTES_PER_PIECE = 300, 20_000
#: Bound of the model: contexts of full length that the trees keep, the most frequent first; after others the shorter one codes.
MOST_CONTEXTS = 40_000
#: Bytes scored at once.
CHUNK = 1 << 19
UNKNOWN = "und"
LETTERS = "letters in it"


class ContextTrees:
    """One tree per language over a common set of contexts, laid out as one table of code lengths.

    ``node[c]`` is the deepest kept context that ends the last ORDER bytes with code c; ``bits[node, symbol]``
    holds the code length of the symbol for every language. A symbol not seen after a context costs the escape
    (distinct symbols over total plus distinct) and is then coded after the next shorter context, down to eight
    bits for a byte never seen at all. A language that never saw a context codes after the shorter one.
    """

    def __init__(self, languages: list[str], symbol: np.ndarray, node: np.ndarray, bits: np.ndarray):
        self.languages, self.symbol, self.node, self.bits = languages, symbol, node, bits
        self.size = bits.shape[1]

    @classmethod
    def fit(cls, texts: dict[str, list[bytes]]) -> ContextTrees:
        languages = sorted(texts)
        if not languages:
            return cls([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 1, 0), np.float32))
        streams = {l: np.frombuffer(b"".join(b"\n" * ORDER + t for t in texts[l]), np.uint8) for l in languages}
        real = {l: np.concatenate([np.r_[np.zeros(ORDER, bool), np.ones(len(t), bool)] for t in texts[l]])[ORDER:] for l in languages}
        seen = np.unique(np.concatenate([*streams.values(), np.frombuffer(b"\n", np.uint8)]))
        symbol = np.zeros(256, np.int32)  # 0: a byte that the sample does not hold
        symbol[seen] = np.arange(1, len(seen) + 1)
        size = len(seen) + 1
        coded = {l: symbol[s] for l, s in streams.items()}
        after = {l: s[ORDER:][real[l]] for l, s in coded.items()}
        bits = np.full((1, size, len(languages)), 8.0)
        shorter = np.zeros(1, np.int64)  # row in bits of each context code one byte shorter
        rows, parts = 1, [bits]
        for order in range(ORDER + 1):
            codes = {}
            for l, s in coded.items():
                c = np.zeros(len(s) - ORDER, np.int64)
                for back in range(order, 0, -1):
                    c = c * size + s[ORDER - back:len(s) - back]
                codes[l] = c[real[l]]
            kept, often = np.unique(np.concatenate(list(codes.values())), return_counts=True)
            if order == ORDER and len(kept) > MOST_CONTEXTS:
                kept = np.sort(kept[np.lexsort((kept, -often))[:MOST_CONTEXTS]])
            suffix = shorter[kept % size ** max(order - 1, 0)] if order else np.zeros(len(kept), np.int64)
            table = np.concatenate(parts)[suffix]
            for i, l in enumerate(languages):
                at = np.searchsorted(kept, codes[l])
                at[at == len(kept)] = 0
                hit = kept[at] == codes[l]
                counts = np.bincount(at[hit] * size + after[l][hit], minlength=len(kept) * size).reshape(-1, size)
                total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = -np.log2(counts / (total + distinct))
                    escaped = table[:, :, i] - np.log2(distinct / (total + distinct))
                table[:, :, i] = np.where(total == 0, table[:, :, i], np.where(counts > 0, own, escaped))
            node = shorter[np.arange(size ** order) % size ** max(order - 1, 0)] if order else np.zeros(1, np.int64)
            node[kept] = rows + np.arange(len(kept))
            shorter, rows = node, rows + len(kept)
            parts.append(table)
        return cls(languages, symbol, shorter.astype(np.int32), np.concatenate(parts).astype(np.float32))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text (rows) under every language (columns)."""
        totals = np.zeros((len(texts), len(self.languages)))
        flat = self.bits.reshape(-1, len(self.languages))
        stream = self.symbol[np.frombuffer(b"".join(b"\n" * ORDER + t for t in texts), np.uint8)]
        ends = np.cumsum([len(t) + ORDER for t in texts])
        starts = np.concatenate(([0], ends[:-1])) + ORDER
        for at in range(ORDER, len(stream), CHUNK):
            upto = min(len(stream), at + CHUNK)
            c = np.zeros(upto - at, np.int64)
            for back in range(ORDER, 0, -1):
                c = c * self.size + stream[at - back:upto - back]
            cost = flat[self.node[c].astype(np.int64) * self.size + stream[at:upto]]
            first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, upto, "left")
            for_docs = np.arange(first, last)
            a, b = np.maximum(starts[for_docs], at) - at, np.minimum(ends[for_docs], upto) - at
            some = b > a
            if some.any():
                cuts = np.column_stack((a[some], b[some])).ravel()
                sums = np.add.reduceat(np.concatenate((cost, np.zeros((1, cost.shape[1]), np.float32))), cuts, axis=0, dtype=np.float64)
                totals[for_docs[some]] += sums[::2]
        return totals


def text_pieces(rows: DataFrame, most_bytes: int, per_language: int) -> DataFrame:
    """(lang, piece): a sample of the pieces of ``most_bytes`` bytes, the last of a text shorter, of all whole texts.

    A piece is drawn by its number before it is cut out, and cutting bytes copies nothing else, so a very long text
    costs its length once. Every piece has the same chance, wherever in a text of whatever length it stands.
    """
    last = F.floor((F.octet_length("text") - 1) / F.lit(most_bytes)).cast("int")
    numbered = rows.select("lang", "text", F.xxhash64("text").alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("nth"))
    key = F.when(F.col("nth") == 0, F.col("whole")).otherwise(F.xxhash64("whole", "nth"))
    piece = F.substring(F.encode("text", "UTF-8"), F.col("nth") * most_bytes + 1, F.lit(most_bytes))
    return sample_per_value(numbered, "lang", key, per_language, piece).select("lang", F.col("value").alias("piece"))


def fit_languages(docs: DataFrame, per_language: int = PIECES_PER_LANGUAGE, most_bytes: int = BYTES_PER_PIECE) -> ContextTrees:
    """Fits trees on at most 1.5 * ``per_language`` pieces of ``most_bytes`` bytes per language, chosen by text hash.

    Rows without a language, without text or held out take no part. Languages are a code list; the sample, and
    with it what the driver gets, is bounded by their number. Texts are compared without regard to case.
    """
    rows = docs.select("lang", "text").where(~held_out() & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    found: dict[str, list[bytes]] = {}
    for r in text_pieces(rows, most_bytes, per_language).collect():
        found.setdefault(r[0], []).append(r[1].decode(errors="ignore").lower().encode())
    return ContextTrees.fit({l: sorted(t) for l, t in found.items()})


def identify_languages(
    docs: DataFrame, model: ContextTrees, keep: Sequence[str] = ("doc_id",), names: Sequence[str] = ("lang_pred", "score")
) -> DataFrame:
    """(``keep``, lang_pred, score, or other ``names``) for every row of ``docs``, repeated rows too; one scan, nothing is shuffled.

    ``score`` is the probability of the predicted language, all being equally likely beforehand. A null, empty
    or letterless text is ``und`` with score 0, as is every text if no language could be learned. Ties go to the
    language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_CONTEXTS
    others, whole = [c for c in keep if c != "text"], "text" in keep
    rows = docs.select(*[F.col(f"`{c}`") for c in others], "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(LETTERS))
    out = [*others, *(["text"] if whole else [])]
    if not model.languages:
        return rows.select(*[F.col(f"`{c}`") for c in out], F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for b in pieces(batches, most=CHUNK):
            bits = trees.code_lengths([t.lower().encode() for t in strings(b)])
            best = bits.argmin(axis=1)
            score = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
            likeliest = np.array(trees.languages, object)[best]
            known = np.array(b.column(len(others) + 1).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(out)], pa.array(np.where(known, likeliest, UNKNOWN), pa.string()), pa.array(np.where(known, score, 0.0))],
                [*out, *names],
            )

    schema = T.StructType([*rows.schema.fields[:len(out)], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
