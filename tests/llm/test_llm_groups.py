"""SimHash, components, line dedup and decontamination against plain loops."""

import itertools
import random
import re

import pytest
import xxhash

from tablelens.llm import decontaminate, linededup, simhash
from tablelens.llm.components import components


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for text in (None, "", " \x0b", "One", "One two", "A b C d E", "É é   x y z", "a b c " * 300):
        assert simhash.fingerprint(text or "", 3) == naive_fingerprint(text)


def test_every_small_difference_shares_a_chain():
    segments = simhash._segments(2)
    masks = [simhash._mask(segments, c) % (1 << 64) for c in simhash._chains(len(segments), 2)]
    for a, b in itertools.combinations_with_replacement(range(64), 2):
        x = (1 << a) | (1 << b)
        assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_close_pairs(spark, distance):
    rnd = random.Random(9)
    values = [rnd.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, distance + 1))) for v in values for _ in range(3)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.a, r.b) for r in simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp bigint"), distance).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(set(signed)), 2) if ((a ^ b) % (1 << 64)).bit_count() <= distance}


def test_chains_prune_before_the_full_distance(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(30)]
    far = [b ^ sum(1 << i for i in rnd.sample(range(start, start + 21), 8)) for b in base for start in (0, 11, 21, 32, 42)]
    near = [b ^ sum(1 << i for i in rnd.sample(range(63), 2)) for b in base]
    frame = spark.createDataFrame([(v,) for v in base + far + near], "fp bigint")
    everything, kept = (set(simhash.candidates(frame, 2, pruned).collect()) for pruned in (False, True))
    close = set(simhash.close_pairs(frame, 2).collect())
    assert close <= kept < everything and len(everything - kept) > 0.8 * len(everything - close)
    assert {tuple(sorted(p)) for p in zip(base, near)} <= close


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_budgets_are_below_the_whole_ring(distance):
    n = len(simhash._segments(distance))
    budgets = simhash._budgets(n, distance)
    assert len(budgets) == distance and all(i < n and i * distance // n == t for t, i in enumerate(budgets))


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rnd.randint(200, 300), rnd.randint(200, 300)) for _ in range(60)]
    links += [(5, 5), (61, 60), (60, 61)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 1)], "a bigint, b bigint")).collect()}
    want = classes({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}


def test_near_duplicates(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = {i: naive_fingerprint(t) for i, t in docs.items()}
    linked = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = classes(prints, linked)
    got = simhash.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    rows = spark.createDataFrame([(3, "a b c d"), (1, "A b c d"), (1, "A b c d"), (2, None), (None, "")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(rows).collect() if r.doc_id) == [1]


def run_lines(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["text"] for r in sorted(linededup.dedup_lines(df, **options).collect(), key=lambda r: r["doc_id"])]


def line(i, n=6):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_blocks_go_from_the_later_document(spark):
    a = "\n".join([line(1), line(2), line(3)])
    b = "\n".join([line(9), line(1), "", line(2), line(8)])
    assert run_lines(spark, [a, b, a]) == [a, "\n".join([line(9), line(8)]), ""]


def test_short_repeats_stay(spark):
    texts = ["yes\n" + line(1), "yes\n" + line(2), f"{line(3)}\n{line(1)}", line(4, 3)]
    assert run_lines(spark, texts) == texts
    assert run_lines(spark, texts, block_words=6)[2] == line(3)


def test_moved_and_repeated_blocks(spark):
    a = "\n".join(map(line, range(6)))
    moved = "\n".join([line(4), line(5), line(50), line(0), line(1), line(2)])
    twice = "\n".join([line(0), line(1), line(60), line(0), line(1)])
    assert run_lines(spark, [a, moved, twice]) == [a, line(50), line(60)]


def cut_lines(docs, block_words=10, line_words=4):
    """Each document without the blocks that it shares with any earlier one, pair by pair: (text, lines, words)."""
    out, seen = {}, []
    for d in sorted(docs):
        own = [(n, x.strip(), len(x.split())) for n, x in enumerate(docs[d].split("\n")) if x.split()]
        gone = set()
        for p in seen:
            for i in range(len(own)):
                for j in range(len(p)):
                    if own[i][1] == p[j][1] and (not i or not j or own[i - 1][1] != p[j - 1][1]):
                        k = 0
                        while i + k < len(own) and j + k < len(p) and own[i + k][1] == p[j + k][1]:
                            k += 1
                        words = [w for _, _, w in own[i:i + k]]
                        if sum(words) >= block_words and max(words) >= line_words:
                            gone.update(range(i, i + k))
        seen.append(own)
        cut, start = set(), None
        for i in [*sorted(gone), None]:
            if start is not None and i != last + 1:  # blank lines inside a range go too
                cut.update(range(own[start][0], own[last][0] + 1))
                start = None
            start, last = (i, i) if start is None else (start, i)
        text = "\n".join(x for n, x in enumerate(docs[d].split("\n")) if n not in cut)
        out[d] = text, len(gone), sum(own[i][2] for i in gone)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_matches_loops(spark, seed):
    r = random.Random(seed)
    lines = [line(i, r.choice([1, 2, 3, 5, 6, 11])) for i in range(12)] + ["", "  "]
    docs = {i: "\n".join(r.choices(lines, k=r.randrange(14))) for i in range(60)}
    docs |= {60 + i: "\n".join([docs[i], docs[i + 1]]) for i in range(10)}
    rows = [*docs.items(), *list(docs.items())[:70:9]]  # some rows twice
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(x["doc_id"], x["text"], x["n_removed_lines"], x["n_removed_words"]) for x in linededup.dedup_lines(df).collect()}
    assert got == {(i, *x) for i, x in cut_lines(docs).items()}


def test_blocks_come_from_one_document(spark):
    """Three documents of a line each share no block with one that has the lines in a row; a block of several owners' lines goes."""
    a, b, c = (line(i, 5) for i in range(3))
    assert run_lines(spark, [a, b, c, f"{a}\n{b}\n{c}", f"{b}\n{c}"]) == [a, b, c, f"{a}\n{b}\n{c}", ""]


def test_repeated_rows_count_once(spark):
    x = line(1, 12) + "\n" + line(2, 11)
    df = spark.createDataFrame([(1, x), (2, x), (2, x)], "doc_id bigint, text string")
    got = [(r["text"], r["n_removed_lines"], r["n_removed_words"]) for r in linededup.dedup_lines(df).where("doc_id = 2").collect()]
    assert got == [("", 2, 23)] * 2


def test_only_aligned_blocks(spark):
    """Without ``moved`` a block goes only where both documents have it in the order of the longest alignment."""
    a = "\n".join(map(line, range(6)))
    moved = "\n".join([line(4), line(5), line(50), line(0), line(1), line(2)])
    assert run_lines(spark, [a, moved], moved=False)[1] == "\n".join([line(4), line(5), line(50)])


def test_a_line_that_all_documents_share(spark):
    shared = line(0, 12)
    got = run_lines(spark, [f"{line(i)}\n{shared}" for i in range(1, 200)])
    assert got == [f"{line(1)}\n{shared}", *(line(i) for i in range(2, 200))]


def test_chain():
    rnd = random.Random(2)
    for _ in range(50):
        v = rnd.sample(range(30), 12)
        chain = [v[i] for i in linededup._longest_chain(v)]
        best = max(len(c) for n in range(1, 7) for c in itertools.combinations(v, n) if list(c) == sorted(c))
        assert chain == sorted(chain) and len(chain) >= best


def naive_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hit, met = set(), set()
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
        n = min(13, len(w))
        windows = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k:k + n]) in windows:
                met.add(str(i))
                hit.update(range(k, k + n))
    return len(words), len(hit), len(met), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_matches_loops(spark):
    rnd = random.Random(6)
    source = [rnd.choice(["a", "b", "C", "É", "7"]) for _ in range(400)]
    items = [(i, " ".join(source[k:k + n])) for i, (k, n) in enumerate([(0, 20), (10, 13), (50, 40), (100, 12), (120, 5), (300, 60)])]
    items += [(6, "x y"), (7, None), (8, "..."), (9, "x y")]
    texts = [None, "", "x y", "x-Y z " * 30]
    for _ in range(60):
        k, n = rnd.randrange(380), rnd.randint(5, 40)
        noise = [f"n{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 60))]
        texts.append(" ".join([*noise, *source[k:k + n], *noise[:5]]).upper())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == {i: naive_contamination(t, items) for i, t in enumerate(texts)}


def test_shortest_runs_match_loops():
    rnd = random.Random(7)
    for _ in range(500):
        w = rnd.choices([1, 1, 2, 3, 4, 5, 12], k=rnd.randrange(12))
        blocks = [(s, e) for s in range(len(w)) for e in range(s, len(w)) if sum(w[s:e + 1]) >= 10 and max(w[s:e + 1]) >= 4]
        want = {min((b for b in blocks if b[0] == s), default=None) for s in range(len(w))} | {
            max((b for b in blocks if b[1] == e), default=None) for e in range(len(w))}
        assert set(linededup.shortest_runs(w, 10, 4)) == want - {None}
    assert len(linededup.shortest_runs([1] * 50_000 + [5], 10, 4)) < 100_000
