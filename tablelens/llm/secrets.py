"""Secret scans: fixed patterns, and opaque values judged by how many repositories and owners hold them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.batches import pieces, strings
from tablelens.llm.shared import written

BASE = ("assign", "access", "hex")
#: Values that no keyword or prefix gives away; they are secrets only if their owner is the only one to have them.
ADDED = ("opaque", "login")
KINDS = (*BASE, *ADDED)

#: Pattern and the group that holds the value. Greedy runs with a least length match what the bare run would.
_ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": (re.compile(_ASSIGN, re.A | re.I), 1),
    "access": (re.compile(r"AKIA[A-Z0-9]{16,}"), 0),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0),
    "opaque": (re.compile(r"[A-Za-z0-9+/_-]{20,}"), 0),
    "login": (re.compile(r"[a-z]{2,16}://[A-Za-z0-9._-]{1,64}:([A-Za-z0-9+/_.=!*-]{6,128})@"), 1),
}
LEAST_ASSIGNED = 6
_MIXED = tuple(re.compile(p) for p in ("[A-Z]", "[a-z]", "[0-9]"))

#: A value that at least so many owners hold, in at least so many repositories, is an example that people copy.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 3


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in code points by start, then kind; added kinds only clear of base spans and of each other."""
    found = []
    for kind, name in enumerate(BASE):
        pattern, group = PATTERNS[name]
        for m in pattern.finditer(text):
            if kind or m.end(1) - m.start(1) >= LEAST_ASSIGNED:
                found.append((m.start(), kind, m.end(), m.group(group)))
    taken = sorted((s, e) for s, _, e, _ in found)
    for kind, name in enumerate(ADDED, len(BASE)):
        pattern, group = PATTERNS[name]
        matches = [m for m in pattern.finditer(text) if name != "opaque" or all(p.search(m.group()) for p in _MIXED)]
        new, i, upto = [], 0, 0
        for m in matches:
            while i < len(taken) and taken[i][0] < m.end():
                upto, i = max(upto, taken[i][1]), i + 1
            if upto <= m.start():
                new.append((m.start(), kind, m.end(), m.group(group)))
        found += new
        taken = sorted([*taken, *((s, e) for s, _, e, _ in new)])
    return sorted(found)


def _scan(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, owner, repository, start, kind, end, digest) of every candidate; values leave a task as digests only."""
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at, found = [], []
            for i, t in enumerate(strings(b)):
                new = candidates(t)
                at += [i] * len(new)
                found += new
            start, kind, end, value = zip(*found) if found else ((),) * 4
            digest = [sha256(v.encode()).hexdigest()[:32] for v in value]
            of = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)).take(of) for c in keep),
                 pa.array(start, pa.int32()), pa.array(kind, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.string())],
                [*keep, "start", "kind", "end", "digest"])

    added = [T.StructField(c, T.IntegerType()) for c in ("start", "kind", "end")] + [T.StructField("digest", T.StringType())]
    return rows.mapInArrow(run, T.StructType([*rows.drop("text").schema.fields, *added]))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories): how many distinct owners and repositories hold each value; a missing one counts as one.

    Copies collapse in the map tasks, so a value that a third of all rows hold is a few rows for each task.
    """
    def holders(of: str, name: str) -> DataFrame:
        each = found.groupBy("digest", of).agg(F.lit(1).alias("one"))
        return each.groupBy("digest").agg(F.count("*").alias(name))

    return holders("owner", "owners").join(holders("repository", "repositories"), "digest")


def find_secrets(
    docs: DataFrame, owner: str = "source", repository: str | None = None,
    copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """(doc_id, text_hash, spans) for every row of ``docs``, repeated rows too.

    spans are (start, kind, end, owners, repositories, live), by start, then kind: all base spans, and the added
    kinds where they look live. A value is live unless at least ``copied_owners`` owners in at least
    ``copied_repositories`` repositories hold it: then it is an example that was copied. Without a repository
    column each different text is one repository, so that mirrors of a text don't make its secrets examples. A
    null text is empty; ids may be null or repeated, extra columns are not read.
    """
    of = F.xxhash64("text").cast("string") if repository is None else F.col(f"`{repository}`").cast("string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col(f"`{owner}`").cast("string").alias("owner"),
                       of.alias("repository"), "text")
    found = written(_scan(rows), "secret-candidates")
    judged = found.join(ownership(found), "digest")
    live = (F.col("owners") < copied_owners) | (F.col("repositories") < copied_repositories)
    kept = judged.withColumn("live", live).where(F.col("live") | (F.col("kind") < len(BASE)))
    by_text = kept.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("spans")
    ).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans")
    base = rows.select("doc_id", "text_hash")
    none = F.array().cast(by_text.schema["spans"].dataType)
    return base.join(by_text, base["doc_id"].eqNullSafe(by_text["d"]) & (base["text_hash"] == by_text["h"]), "left").select(
        "doc_id", "text_hash", F.coalesce("spans", none).alias("spans")
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def _count(spans: Column, which: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(spans, which)).cast("bigint")


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def query(spark, sf_dir: str) -> DataFrame:
    spans, n = F.col("spans"), len(BASE)
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *[_count(spans, _of_kind(i)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"] < n)), 256).alias("base_sha256"), _listed(spans).alias("spans"),
        _count(spans, lambda s: s["live"]).alias("n_live"), _count(spans, lambda s: ~s["live"]).alias("n_copied"),
        _count(spans, lambda s: s["kind"] >= n).alias("n_added"),
    )


def oracle(copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> str:
    """The same in SQL. A match starts where the gaps and matches before it end; letters of keywords are given in both cases."""
    def found(kind: int, name: str) -> str:
        pattern, group = PATTERNS[name]
        text = pattern.pattern.replace("'", "''")
        if pattern.flags & re.I:
            words, rest = text[3:].split(")", 1)
            text = "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest
        return (f"SELECT rid, doc_id, owner, text, {kind} AS kind, regexp_extract_all(text, '{text}') AS m, "
                f"regexp_extract_all(text, '{text}', {group}) AS v, string_split_regex(text, '{text}') AS gap FROM d")

    kinds = "\n  UNION ALL ".join(found(i, k) for i, k in enumerate(KINDS))
    n, opaque, login = len(BASE), KINDS.index("opaque"), KINDS.index("login")
    names = ", ".join(f"'{k}'" for k in KINDS)

    def listed(where: str) -> str:
        return f"coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER ({where}), '')"

    def clear_of(upper: int) -> str:
        return f"NOT EXISTS (SELECT 1 FROM placed AS o WHERE o.rid = p.rid AND o.kind < {upper} AND o.s < p.e AND p.s < o.e)"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
k AS ({kinds}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
every AS (SELECT rid, doc_id, owner, text, kind, m[i] AS m, v[i] AS v,
                 (list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
          FROM i),
placed AS (SELECT *, s + length(m) AS e FROM every
           WHERE (kind <> 0 OR length(v) >= {LEAST_ASSIGNED})
             AND (kind <> {opaque} OR (regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')))),
free AS (SELECT * FROM placed AS p WHERE kind < {n} OR (kind = {opaque} AND {clear_of(n)})),
cand AS (SELECT * FROM free UNION ALL SELECT * FROM placed AS p WHERE kind = {login} AND {clear_of(n)}
         AND NOT EXISTS (SELECT 1 FROM free AS o WHERE o.rid = p.rid AND o.s < p.e AND p.s < o.e)),
own AS (SELECT v, count(DISTINCT coalesce('=' || owner, '')) AS owners,
               count(DISTINCT text) AS repositories FROM cand GROUP BY v),
j AS (SELECT cand.*, ([{names}])[kind + 1] AS name, owners < {copied_owners} OR repositories < {copied_repositories} AS live FROM cand JOIN own USING (v)),
kept AS (SELECT * FROM j WHERE live OR kind < {n}),
by_row AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                  {listed(f"kind < {n}")} AS base, {listed("true")} AS spans, count(*) FILTER (live) AS n_live,
                  count(*) FILTER (NOT live) AS n_copied, count(*) FILTER (kind >= {n}) AS n_added FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live,
       coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(n_added, 0)::BIGINT AS n_added
FROM d LEFT JOIN by_row USING (rid)
"""
