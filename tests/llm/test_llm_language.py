"""Context trees against a dictionary walk, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

from tablelens.llm import language
from tablelens.llm.language import ORDER, ContextTrees


def naive_bits(train, text):
    """Code length of ``text`` by walking from the longest context down, escapes included."""
    counts = defaultdict(Counter)
    for t in train:
        padded = b"\n" * ORDER + t
        for i in range(ORDER, len(padded)):
            for k in range(ORDER + 1):
                counts[padded[i - k:i]][padded[i]] += 1
    padded, bits = b"\n" * ORDER + text, 0.0
    for i in range(ORDER, len(padded)):
        for k in range(ORDER, -1, -1):
            c = counts.get(padded[i - k:i])
            if c is None:
                continue
            total, distinct = sum(c.values()), len(c)
            if padded[i] in c:
                bits -= math.log2(c[padded[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_match_a_walk(monkeypatch):
    rnd = random.Random(8)
    train = {l: ["".join(rnd.choice(a) for _ in range(80)).encode() for _ in range(4)] for l, a in (("x", "abcde "), ("y", "abfghé "))}
    model = ContextTrees.fit(train)
    texts = ["".join(rnd.choice("abcdefghé z\n") for _ in range(n)).encode() for n in (0, 1, 2, 3, 50, 400)]
    for chunk in (7, 1 << 19):
        monkeypatch.setattr(language, "CHUNK", chunk)
        got = model.code_lengths(texts)
        for i, t in enumerate(texts):
            for j, l in enumerate(model.languages):
                assert math.isclose(got[i, j], naive_bits(train[l], t), rel_tol=1e-5, abs_tol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_unknown(spark):
    docs = spark.createDataFrame(
        [(i, "der die das und ist", "de") for i in range(20)] + [(i, "the and of that is", "en") for i in range(20, 40)]
        + [(50, None, "en"), (51, "123 !", "de"), (52, "", None), (53, "THE AND OF", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_languages(docs, language.fit_languages(docs)).collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0) and got[53][0] == "en" and got[0][0] == "de"


def test_long_texts_are_learned(spark):
    docs = spark.createDataFrame(
        [(i, f"the cat and the dog {i}", "en") for i in range(40)] + [(i, f"le chat et le chien {i} " * 1500, "fr") for i in range(40, 80)]
        + [(80, "le chat et", None)], "doc_id bigint, text string, lang string")
    model = language.fit_languages(docs)
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(docs, model).collect()}
    assert model.languages == ["en", "fr"] and all(l == ("en" if i < 40 else "fr") for i, l in got.items())


def test_pieces_cover_whole_texts_and_any_number_of_languages(spark):
    texts = {"x": "abcdé" * 100, "y": "z", "zz": "ab" * 3}
    rows = spark.createDataFrame([*((l, t) for l, t in texts.items()), *((f"l{i}", f"t{i}") for i in range(3000)), (None, "no")], "lang string, text string")
    pieces = language.text_pieces(rows, 6, 1000).collect()
    assert len({r.lang for r in pieces}) == 3003 and all(len(r.piece) <= 6 for r in pieces)
    assert sorted(r.piece for r in pieces if r.lang == "x") == sorted(texts["x"].encode()[i:i + 6] for i in range(0, 600, 6))
