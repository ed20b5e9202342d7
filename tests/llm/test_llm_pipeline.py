"""The pipeline against plain loops over the same documents."""

import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tablelens.llm import language
from test_llm_groups import classes, cut_lines, naive_contamination, naive_fingerprint

SF = "/root/testdata/sf0.001"


def test_run(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_languages(raw)
    docs = {r.doc_id: r.text for r in raw.collect()}
    kept = {}
    for i, t in docs.items():
        bits = model.code_lengths([t.lower().encode()])[0]
        if re.search(r"[^\W\d_]", t) and 1 / sum(2.0 ** (bits.min() - b) for b in bits) >= corpus_pipeline.LEAST_SCORE:
            kept[i] = t
    kept = {i: t for i, (t, lines, _) in cut_lines(kept).items() if not lines or t.split()}
    prints = {i: naive_fingerprint(t) for i, t in kept.items()}
    group = classes(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    kept = {i: t for i, t in kept.items() if group[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not naive_contamination(t, items)[3]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in kept.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and len(want) < len(docs)
    for i, r in got.items():
        assert list(r.ids) == want[i] and r.decoded_sha256 == hashlib.sha256(kept[i].encode()).hexdigest()
