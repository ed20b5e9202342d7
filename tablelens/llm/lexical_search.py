"""Ranked lexical search: best-first over document intervals that range-maximum tables of the posting lists bound."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.batches import pieces
from tablelens.llm.shared import delete, written

TOP = 50
#: Weight scale, impact scale, and the constants of the length norm (fixed values of the contract).
WEIGHT, IMPACT, TF, NORM, BASE, SLOPE = 1000, 1_000_000_000, 1000, 20, 100, 50
#: Postings of a shard: bounds the memory of a task, not the documents searched. Bytes of the items that go together.
SHARD, ITEM_BYTES = 1_000_000, 4 << 20
#: Intervals that are split together; a matter of speed only.
WIDTH = 64

#: Bytes that separate terms become blanks, A to Z are lowered.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Runs of digits, letters a to z (A to Z lowered) and characters beyond ASCII."""
    return text.translate(_TABLE).split()


class Shard:
    """Posting lists of some documents: impacts by term and document, and a range-maximum table over each list.

    ``term``, ``doc`` and ``impact`` are parallel; documents are numbered in the order in which ties are decided.
    ``best[j][i]`` is the place of the largest of the 2**j impacts from place i on.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        key = term.astype(np.int64) * docs + doc
        order = np.argsort(key, kind="stable")
        self.key, self.impact, self.docs = key[order], impact[order], docs
        longest = int(np.bincount(term).max(initial=0))
        best = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(best) - 1) <= longest:
            last, step = best[-1], 1 << (len(best) - 1)
            a, b = last[:-step], last[step:]
            best.append(np.concatenate([np.where(self.impact[b] > self.impact[a], b, a), last[len(last) - step:]]))
        self.best = np.stack(best)
        self.level = np.zeros(longest + 2, np.int8)
        for j in range(1, len(best)):
            self.level[1 << j:] = j

    def _bounds(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound, place): the summed largest weighted impacts of the lists within [a, b), and where the largest of them is."""
        some = b > a
        j = self.level[np.where(some, b - a, 1)]
        last = len(self.key) - 1
        left, right = self.best[j, np.minimum(a, last)], self.best[j, np.minimum(np.maximum(b - (1 << j.astype(np.int64)), 0), last)]
        place = np.where(self.impact[right] > self.impact[left], right, left)
        worth = np.where(some, self.impact[place] * weight, 0)
        rows = np.arange(len(a))
        return worth.sum(1), place[rows, worth.argmax(1)]

    def search(self, term: np.ndarray, weight: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``top`` documents with a score above 0, equal scores by document."""
        found_doc, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = term.astype(np.int64) * self.docs
        a, b = np.searchsorted(self.key, start), np.searchsorted(self.key, start + self.docs)
        held = (b > a) & (weight > 0)
        if not held.any():
            return found_doc, found
        start, weight, a, b = start[held], weight[held], a[held][None], b[held][None]
        bound, place = self._bounds(a, b, weight)
        lo = np.zeros(1, np.int64)
        while len(lo):
            if len(found) == top:  # an interval can still matter if it may beat the last result, or equal it with an earlier document
                alive = (bound > found[-1]) | ((bound == found[-1]) & (lo < found_doc[-1]))
                if not alive.all():
                    a, b, bound, place, lo = a[alive], b[alive], bound[alive], place[alive], lo[alive]
                    continue
            if len(lo) > WIDTH:
                now = np.argpartition(-bound, WIDTH)[:WIDTH]
                rest = np.ones(len(lo), bool)
                rest[now] = False
            else:
                now, rest = np.arange(len(lo)), np.zeros(len(lo), bool)
            # each interval is split at the document of its largest impact, which is scored
            middle = self.key[place[now]] % self.docs
            wanted = start[None] + middle[:, None]
            at = np.searchsorted(self.key, wanted)
            hit = self.key[np.minimum(at, len(self.key) - 1)] == wanted
            score = np.where(hit, self.impact[np.minimum(at, len(self.key) - 1)] * weight, 0).sum(1)
            found_doc, found = np.concatenate([found_doc, middle]), np.concatenate([found, score])
            order = np.lexsort((found_doc, -found))[:top]
            found_doc, found = found_doc[order], found[order]
            ca, cb = np.concatenate([a[now], at + hit]), np.concatenate([at, b[now]])
            cb = np.maximum(ca, cb)
            cbound, cplace = self._bounds(ca, cb, weight)
            clo = np.concatenate([lo[now], middle + 1])
            good = cbound > 0
            a, b = np.concatenate([a[rest], ca[good]]), np.concatenate([b[rest], cb[good]])
            bound, place, lo = (np.concatenate([x[rest], y[good]]) for x, y in ((bound, cbound), (place, cplace), (lo, clo)))
        return found_doc, found


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and those of ``vocabulary`` in it with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in pieces(batches):
            sizes, ends, ids, tfs = [], [0], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = terms(t or b"")
                n = Counter(map(number, words))
                n.pop(None, None)
                sizes.append(len(words))
                ids += n.keys()
                tfs += n.values()
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>")


def _search(postings: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int, shard: int) -> DataFrame:
    """(item, doc_id, score): the ``top`` documents of every shard for every item. Shards are whole documents of one task."""
    shared = postings.sparkSession.sparkContext.broadcast(items)

    def searched(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.sort_by([("doc_id", "ascending")])  # null ids last
        sizes = part.column("n").to_numpy().astype(np.int64)
        m = BASE - SLOPE + (SLOPE * sizes * n_docs) // n_terms
        per = np.asarray(part.column("terms").combine_chunks().value_lengths())
        term = part.column("terms").combine_chunks().flatten().to_numpy()
        tf = part.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(part.num_rows), per)
        if not len(term):
            return
        index = Shard(term, doc, (IMPACT * tf) // (TF * tf + NORM * m[doc]), part.num_rows)
        for item, wanted, weight in shared.value:
            which, score = index.search(wanted, weight, top)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(item, pa.int32()), len(which)), part.column("doc_id").combine_chunks().take(pa.array(which)), pa.array(score, pa.int64())],
                ["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten())
            if size >= shard:
                yield from searched(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from searched(pa.Table.from_batches(held))

    kind = postings.schema["doc_id"].dataType.simpleString()
    return postings.mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def _block(docs: DataFrame, items: list, top: int, shard: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items that the driver holds; ``item`` is the place in the list."""
    wanted = [sorted(set(terms((r["text"] or "").encode()))) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for w in wanted for t in w}))}
    postings = written(_postings(docs, vocabulary), "postings")
    n_docs, n_terms = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row per term of the items
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    numbers = [np.array([vocabulary[t] for t in w], np.int64) for w in wanted]
    queries = [(i, ids, weight[ids]) for i, ids in enumerate(numbers) if len(ids)]
    best = _search(postings.where(F.size("terms") > 0), queries, n_docs, n_terms, top, shard)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = written(best.withColumn("rank", place).where(F.col("rank") <= top), "ranked")
    delete(postings)
    return ranked


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard: int = SHARD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every row of ``items``, best first, equal scores by doc_id.

    Every row of both tables counts, repeated ones too (a repeated item is answered twice, with the same ranks); null
    and empty texts have no terms and find nothing; null ids come last among equal scores. Items go in blocks of
    about ``item_bytes``, each against all documents: one scan lists the postings of the block's terms, another
    answers them shard by shard, and only a shard's ``top`` rows per item are shuffled.
    """
    spark = docs.sparkSession
    source = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = -(-size // item_bytes)
    result = None
    for i in range(blocks):
        rows = source.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()  # about item_bytes
        if not rows:
            continue
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], T.StructType([
            T.StructField("item", T.IntegerType()), source.schema["item_id"]]))
        found = _block(docs, rows, top, shard).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        result = found if result is None else result.union(found)
    if result is None:
        kind = T.StructType([source.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
        result = spark.createDataFrame([], kind)
    return result


def query(spark, sf_dir: str) -> DataFrame:
    return search(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def oracle(top: int = TOP) -> str:
    def words(source: str) -> str:
        return (f"regexp_extract_all(translate(coalesce({source}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
                r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, {words('text')} AS w FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item, item_id, unnest(w) AS t FROM b),
p AS (SELECT rid, doc_id, t, n, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor({WEIGHT} * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, n_docs),
i AS (SELECT rid, doc_id, t, ({IMPACT} * tf) // ({TF} * tf + {NORM} * ({BASE - SLOPE} + ({SLOPE} * n * n_docs) // n_terms)) AS impact FROM p, s),
r AS (SELECT item, item_id, rid, doc_id, sum(w * impact)::BIGINT AS score FROM q JOIN f USING (t) JOIN i USING (t) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= {top}
"""
