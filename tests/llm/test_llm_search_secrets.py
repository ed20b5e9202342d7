"""Phrases, ranked search and secrets against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tablelens.llm import collocations, lexical_search, secrets

PIECE, WORD = re.compile("[.,;:!?\n-\r]"), re.compile("[^ \t]+")


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def phrases_by_loops(rows, least, longest, top, inside=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in PIECE.split(lowered(text)):
            w = WORD.findall(piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        score, cut = min(((1000 * a * n[lang]) // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = (
            (q, b) for (other, q), b in found.items() if other == lang and len(q) > len(p) and 100 * b >= inside * a
        )
        if not any(p == q[i:i + len(p)] for q, _ in longer for i in range(len(q))):
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]], n[lang], cut))
    out.sort()
    ranked, place = [], Counter()
    for lang, score, a, p, l, r, total, cut in out:
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, l, r, total, -score, cut))
    return ranked


def random_texts(seed, n=60):
    r = random.Random(seed)
    words = ["a", "b", "C", "dé", "É", "x1", "-", "日本", "a"]
    return [
        (r.choice(["en", "fr", None, "und"]), r.choice([None, ""]) if r.random() < 0.1 else "".join(
            r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\r\n", ",", "\xa0"]) for _ in range(r.randrange(60))
        )) for _ in range(n)
    ]


@pytest.mark.parametrize("least, longest, top, inside, bits", [(3, 5, 2000, 100, 1 << 20), (2, 3, 7, 60, 1 << 15), (5, 2, 50, 100, 1 << 15), (4, 6, 30, 80, 1 << 20)])
def test_phrases_match_loops(spark, least, longest, top, inside, bits):
    rows = random_texts(least)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, score string")
    got = collocations.collocations(docs, least, longest, top, inside, bits).collect()
    assert sorted(map(tuple, got)) == sorted(phrases_by_loops(rows, least, longest, top, inside))


def test_filter_only_saves_work(spark):
    docs = spark.createDataFrame(random_texts(9, 200), "lang string, text string")
    wide, full = (collocations.phrase_counts(docs, 3, 5, bits) for bits in (1 << 20, 1 << 15))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, full.collect()))
    tokens = collocations._tokens([t.encode() for _, t in random_texts(9, 200) if t])
    every = sum(len(g) for g, k, _ in collocations._counted(b"en", tokens, 2, 2, {}) if k == 2)
    none = sum(len(g) for g, k, _ in collocations._counted(b"en", tokens, 2, 2, {1: bytes(4096)}) if k == 2)
    assert every > 0 and none == 0


def test_scores_beyond_64_bits(spark):
    """1000 * a * n passes 2 ** 63 long before a count does."""
    row = spark.range(1).selectExpr(
        "(CAST(1000 AS DECIMAL(4,0)) * CAST(300000000000 AS DECIMAL(18,0)) * CAST(900000000000000 AS DECIMAL(18,0)))"
        " DIV (CAST(400000000000 AS DECIMAL(18,0)) * CAST(500000000007 AS DECIMAL(18,0)))"
    ).first()
    assert row[0] == (1000 * 300000000000 * 900000000000000) // (400000000000 * 500000000007)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked_by_loops(docs, items, top):
    import math
    words = [TERM.findall(lowered(t)) for _, t in docs]
    full = [w for w in words if w]
    n_docs, n_terms = len(full), sum(map(len, full))
    df = Counter(t for w in full for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for (doc, _), w in zip(docs, words):
            tf = Counter(w)
            m = 50 + (50 * len(w) * n_docs) // n_terms if n_terms else 1
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in set(TERM.findall(lowered(text))) if tf[t]
            )
            if s > 0:
                scored.append((-s, doc))
        out += [(item, k, doc, -s) for k, (s, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, item_bytes, top", [(1_000_000, 4 << 20, 5), (40, 100, 3), (1, 4 << 20, 1)])
def test_ranking_matches_loops(spark, shard, item_bytes, top):
    r = random.Random(top)
    vocabulary = ["a", "B", "cé", "42", "d", "e", "日本", "f"]
    docs = [(i, None if r.random() < 0.05 else " ".join(r.choices(vocabulary, [8, 5, 3, 2, 1, 1, 1, 1], k=r.randrange(12)))) for i in range(150)]
    docs += [(i + 150, t) for i, t in docs[:60]]  # equal scores
    items = [(i, None if i == 3 else "-".join(r.choices(vocabulary, k=r.randrange(6)))) for i in range(25)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, terms string").repartition(3)
    got = lexical_search.search(df, spark.createDataFrame(items, "item_id bigint, text string"), top, shard, item_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_loops(docs, items, top)


def test_intervals_are_pruned():
    """The best documents are found without scoring all of them."""
    r = np.random.default_rng(1)
    term = np.repeat(np.arange(4), 20_000)
    doc = np.concatenate([np.sort(r.choice(50_000, 20_000, replace=False)) for _ in range(4)])
    impact = r.integers(1, 1000, 80_000)
    impact[r.choice(80_000, 200, replace=False)] = 100_000
    index = lexical_search.Shard(term, doc, impact, 50_000)
    calls = []
    inner = index._bounds
    index._bounds = lambda a, b, w: calls.append(len(a)) or inner(a, b, w)
    weight = np.array([3, 1, 4, 1])
    which, score = index.search(np.arange(4), weight, 20)
    every = np.zeros(50_000, np.int64)
    np.add.at(every, doc, impact * weight[term])
    want = np.lexsort((np.arange(50_000), -every))[:20]
    assert which.tolist() == want.tolist() and score.tolist() == every[want].tolist()
    assert sum(calls) < 10_000


def secrets_by_loops(text):
    out, at = [], 0
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for kind, (pattern, ok) in enumerate((
        (assign, lambda m: len(m.group(2)) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
        (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
    )):
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            if ok(m):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_loops():
    r = random.Random(5)
    parts = ["password", "PASSWD", "api_key", "apikey", "ſecret", "secret", "toKen", "=", ":", " ", '"', "'", "abc", "abc-def_9.=", "AKIA", "AKIAAKIA",
             "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "日", "deadbeef", "F00", "\n", "x"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randrange(1, 14)))
        assert [s[:3] for s in secrets.candidates(text) if s[1] < len(secrets.BASE)] == secrets_by_loops(text), text


def test_added_spans_are_clear_of_others():
    opaque = "Zm9vYmFyMTIzNDU2Nzg5MA"
    assert secrets.candidates(f"x {opaque} y") == [(2, 3, 24, opaque)]
    assert [s[1] for s in secrets.candidates(f"token={opaque}")] == [0]
    assert secrets.candidates("db postgres://bob:hunter22@host/x")[0][1:] == (4, 27, "hunter22")
    assert [s[1] for s in secrets.candidates(f"https://{opaque}:{opaque}@h")] == [3, 3]
    assert secrets.candidates("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUV") == []


def test_copied_examples_and_live_secrets(spark):
    """A value of one owner is live, one of many owners is an example; mirrors of one text are one repository."""
    common, own, mirrored = "Zm9vYmFyMTIzNDU2Nzg5MA", "QUJDREVGMTIzNDU2eHl6YWJj", "bWlycm9yZWQxMjM0NTY3ODkwQQ"
    rows = [(i, f"text {i} {common} end", f"s{i}") for i in range(4)] + [
        (10, f"mine {own} here", "s0"), (11, f"mine {own} there", "s0"), (10, f"mine {own} here", "s0"),
        *[(20 + i, f"the same {mirrored}", f"s{i}") for i in range(5)], (30, None, None), (None, f"token={common}", None),
    ]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    spans = {r["doc_id"]: [(s["kind"], s["owners"], s["repositories"], s["live"]) for s in r["spans"]] for r in got}
    assert len(got) == len(rows) and spans[0] == [] and spans[30] == []
    assert spans[10] == [(3, 1, 2, True)] and spans[24] == [(3, 5, 1, True)]
    assert spans[None] == [(0, 5, 5, False)]
