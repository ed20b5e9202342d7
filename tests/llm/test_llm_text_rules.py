"""Quality rules and personal data against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tablelens.llm import pii, quality_rules
from tablelens.llm.textcols import let


def naive_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_rules_match_loops(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "b", "the ", " ", "\n", "#", "é", "\t", "of "]) for _ in range(rnd.randint(0, 120))) for _ in range(300)]
    texts += [None, "", "one " * 50, " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(30))]
    got = quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in got:
        n, chars, symbols, dup, rep = naive_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert r.kept == (not r.base_failed and not r.broken)


def test_rules_on_the_corpus(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.2 * n[0, False]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def naive_spans(text):
    out = []
    for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_loops(spark):
    rnd = random.Random(3)
    bits = ["a", "b", ".", "@", "1", "2", "5", "0", "4", "-", " ", "+", "(", ")", "_", "\n", "é", "😀", "255", "256", "4111111111111111",
            "1.2.3.4", "x@y.z", "+1 (555) 123-4567", "4111 1111 1111 1111", "0000000000000000000"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(2500)]
    texts += ["a" * 50_000, "1" * 50_000, "1 " * 20_000, "1." * 20_000, "+1" * 20_000, "a@b." * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in df.select("doc_id", let(F.col("text"), lambda t: pii.base_spans(t)).alias("b")).collect():
        assert [(s.start, s.kind, s.end) for s in r.b] == naive_spans(texts[r.doc_id])


def test_disclosing_terms_are_found_and_sanitised(spark):
    lines = [f"Contact Quexil{i % 1} near town{i} at bo@mail.example.com today" for i in range(5)]
    other = [f"town{i} is near a lake and people contact others there today" for i in range(200)]
    docs = spark.createDataFrame([*enumerate([*lines, *other, "Where is Quexil0 now", None])], "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert [(s.kind, s.value) for s in found[0]] == [(4, "Contact"), (4, "Quexil0"), (0, "bo@mail.example.com")]
    assert [s.value for s in found[205]] == ["Quexil0"] and found[206] == [] and found[50] == []
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(pii.find_personal_data(docs)).collect()}
    assert "bo@mail" not in text[0] and "<EMAIL>" in text[0] and "Quexil0" not in text[0] + text[205]
    assert text[50] == other[45]


def test_query_digest(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in pii.query(spark, "/root/testdata/sf0.001").collect():
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in naive_spans(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_a_value_written_in_several_ways_is_one_value(spark):
    written = {
        "Quexil": ["bo@mail.example.com", "Bo@Mail.example.com", "BO@MAIL.EXAMPLE.COM"], "Vorbla": ["10.0.0.7", "010.0.0.07", "10.00.000.7"],
        "Zantor": ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"], "Mipsel": ["+1 (555) 123-4567", "+15551234567", "+1 555.123.4567"],
    }
    lines = [f"{name} has in town{i} now {v} there" for name, values in written.items() for i, v in enumerate(values)]
    other = [f"there is in town{i % 9} now a lake that one has seen {i}" for i in range(300)]
    terms = pii.disclosing_terms(spark.createDataFrame([*enumerate([*lines, *other])], "doc_id bigint, text string")).collect()
    assert {r["term"] for r in terms} == set(written)


def naive_terms(texts):
    """Strength of every disclosing term, by counting lines."""
    def gone(line):
        for pattern in (EMAIL, IP):
            line = pattern.sub("\n", line)
        line = CARD.sub(lambda m: "\n" if 14 <= len(re.sub("[^0-9]", "", m.group())) <= 19 else m.group(), line)
        return PHONE.sub("\n", line)

    def terms(line):
        return {w for w in re.split(r"[\W_]+", line) if len(w) >= 3}

    lines = [x for t in texts for x in (t or "").split("\n")]
    both, kinds, values, n_term = Counter(), defaultdict(set), Counter(), Counter()
    for x in lines:
        n_term.update(terms(x))
        for v in {x[a:b] for a, _, b in naive_spans(x)}:
            values[v] += 1
            for w in terms(gone(x)):
                both[v, w] += 1
                kinds[v, w].add(x)
    out = {}
    for (v, w), n in both.items():
        info = math.log2(len(lines) / values[v])
        if len(kinds[v, w]) >= pii.LEAST_LINES and info > 0 and n_term[w]:  # cutting out a value can leave half a word
            strength = math.log2(len(lines) * n / (values[v] * n_term[w])) / info
            if strength >= pii.DISCLOSES:
                out[w] = max(strength, out.get(w, 0.0))
    return out


def test_disclosing_terms_match_loops(spark):
    rnd = random.Random(12)
    values = ["bo@mail.example.com", "10.0.0.7", "+1 (555) 123-4567", "4111 1111 1111 1111"]
    texts = []
    for _ in range(400):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            words = [f"word{rnd.randint(0, 60)}" for _ in range(rnd.randint(1, 8))]
            if rnd.random() < 0.25:
                v = rnd.randrange(4)
                words.insert(rnd.randint(0, len(words)), values[v])
                words += [f"Near{v}"] * (rnd.random() < 0.8) + [f"loose{v}"] * (rnd.random() < 0.5)
            elif rnd.random() < 0.03:
                words.append(f"loose{rnd.randrange(4)}")
            lines.append(" ".join(words))
        texts += ["\n".join(lines)] * rnd.choice([1, 1, 1, 3])
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id bigint, text string")
    got = {r["term"]: r["strength"] for r in pii.disclosing_terms(df.selectExpr("doc_id", "coalesce(text, '') AS text")).collect()}
    want = naive_terms([*texts, None])
    assert got.keys() == want.keys() and {"Near0", "Near1", "Near2"} <= got.keys()
    assert all(math.isclose(got[w], want[w], rel_tol=1e-9) for w in want)
