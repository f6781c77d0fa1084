"""Null keys, texts longer than a batch, repeated rows and ties, for the operators and for the whole pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from tidemark.llm.bpe import Encoder
from tidemark.llm.components import components
from tidemark.llm.decontaminate import contaminated, normal
from tidemark.llm.language_id import UND, language_id, learn_languages
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_output import read_tokens, write_tokens

BPE, PIECES, WORD = (P.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
WORDS = {"en": "the of and that which water house with from this have".split(), "de": "der die und nicht wasser haus durch aber über schön".split()}


def prose(seed, n, words):
    return " ".join(random.Random(seed).choices(words, k=n))


LONG = prose(1, 500_000, [*WORDS["en"], "it's", "1999,", "naïve", "\n"])  # 2.5 MB: over a batch of any operator


def test_token_output_with_null_keys_and_long_texts(spark, tmp_path):
    docs = [(None, "no key"), (None, "no key"), (5, LONG), (5, "a"), (2, None), (9, "")]
    lib = Encoder(BPE)._library
    write_tokens(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), str(tmp_path / "t"), BPE)
    out = sorted(read_tokens(spark, str(tmp_path / "t"), digest=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, None, 2, 5, 5, 9]
    at, want = 0, {t: np.array([*lib([t or ""])[0], 2], "<u4").tobytes() for _, t in docs}
    for r in out:
        texts = [t for k, t in docs if k == r["doc_id"]]
        assert r["start"] == at and any((r["n_tokens"], r["ids_crc32"]) == (len(want[t]) // 4, zlib.crc32(want[t])) for t in texts)
        at += r["n_tokens"]


@pytest.mark.parametrize("model", [BPE, PIECES, WORD])
def test_token_counts_of_cut_texts(spark, model):
    texts = [LONG[:400_000], prose(2, 3000, WORDS["de"]), "x" * 5000, "  a  b\n\n c ", "中文 no 空", "", None]
    e = Encoder(model)
    df = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in token_counts(df, model, piece_chars=1000).collect()}
    assert got == {(None if i == 1 else i, len((t or "").encode())): len(e._library([t or ""])[0]) for i, t in enumerate(texts)}


def test_language_with_null_keys_repeats_ties_and_many_languages(spark):
    data = [(None if i == 7 else i, prose(i, 30, WORDS[("en", "de")[i % 2]]), ("en", "de")[i % 2]) for i in range(120)]
    data += [data[3], data[3], (500, LONG, None), (501, prose(4, 30, WORDS["en"]), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    net = learn_languages(df, steps=60)
    out = language_id(df, net).collect()
    assert len(out) == len(data) and sum(r["doc_id"] == 3 for r in out) == 3 and sum(r["doc_id"] is None for r in out) == 1
    assert {r["lang_pred"] for r in out if r["doc_id"] == 500} == {"en"}
    many = [(i, prose(i, 12, [f"{'abcdefghij'[i % 70 // 7]}{'klmnopqrst'[i % 7]}"]), f"l{i % 70}") for i in range(280)]
    assert len(learn_languages(spark.createDataFrame(many, "doc_id long, text string, lang string"), steps=2).langs) == 70
    net.out[:], net.bias[:] = 0, 0  # all languages equally probable
    assert {r["lang_pred"] for r in language_id(df.limit(5), net).collect()} == {net.langs[0]}
    assert {r["lang_pred"] for r in language_id(spark.createDataFrame([(1, "12")], "doc_id long, text string"), net).collect()} == {UND}


def by_hand(text):
    """SimHash in plain loops."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_hand_with_null_keys_and_long_texts(spark):
    texts = [LONG[:60_000], "a b", "a  B", "", None, prose(3, 200, WORDS["en"]), prose(3, 200, WORDS["en"]) + " x", LONG]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, "alone without a key"), (1, "a b")]
    out = simhash_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(out) == len(data)
    hands = {t: f"{by_hand(t):016x}" for _, t in data if t != LONG}
    for k, t in data:
        if t != LONG:
            assert any(r["doc_id"] == k and r["fingerprint"] == hands[t] for r in out), k
    root = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert root[1] == root[2] == 1 and root[3] == root[4] == 3
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {root[5], None}


def test_items_with_null_keys_repeats_and_long_texts(spark):
    items = [(1, prose(5, 14, WORDS["de"])), (None, prose(6, 14, WORDS["de"])), (1, prose(5, 14, WORDS["de"])), (3, None)]
    docs = [(None, "x " + items[0][1]), (7, LONG + " " + items[1][1].upper() + " " + LONG), (7, LONG + " " + items[1][1].upper() + " " + LONG), (8, items[0][1] + " und " + items[0][1])]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted((str(r["doc_id"]), str(r["item_id"]), r["distance"], r["start"]) for r in got.collect())
    at = normal(docs[1][1]).index(normal(items[1][1]))
    assert rows == sorted([("None", "1", 0, 2)] * 2 + [("7", "None", 0, at)] * 2 + [("8", "1", 0, 0)] * 2)  # the first of equal places


def test_components_with_a_hot_node(spark):
    """A third of all links at one node; joins on it are split."""
    links = [(0, i) for i in range(1, 4000)] + [(10_000 + i, 10_001 + i) for i in range(0, 8000, 2)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "4k")
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {n: 0 for n in range(4000)} | {10_000 + i: 10_000 + i - i % 2 for i in range(8000)}


DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string, core long"
LABELS, BENCH = "doc_id long, quality int, toxic int", "item_id long, text string"


def tables(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, BENCH).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_by_brute_force(spark, tmp_path):
    item = "welche antwort steht auf der letzten seite des buches und warum steht sie gerade dort"
    vocabulary = {l: [f"{a}{b}" for a in ws for b in ("", "en", "s")] for l, ws in WORDS.items()}
    good = [(i, prose(i, 60, vocabulary[("en", "de")[i % 2]]), ("en", "de")[i % 2]) for i in range(240)]
    leaks = [(300 + i, f"{good[i][1]} {item} {good[i + 9][1]}", "de") for i in range(3)]
    copies = [(400 + i, good[i][1], good[i][2]) for i in range(20)] + [(500, good[30][1] + " the", "en"), good[40], (None, good[50][1], "en")]
    empty = [(600, None, "en"), (601, "", "en"), (602, "77 1", None)]
    alone = [(None, prose(900, 60, vocabulary["en"]), "en")]
    docs = [(*d, "s", 1, "extra", 5) for d in good + leaks + copies + empty + alone]
    labels = [(i, 1 if i % 8 else 0, 0) for i in range(200)] + [(None, 1, 0), (7, None, None)]
    folder = tables(spark, tmp_path / "in", docs, labels, [(1, item), (None, None)])
    kept, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = sorted(("" if r["doc_id"] is None else str(r["doc_id"]), r["text"]) for r in kept.select("doc_id", "text").collect())
    key = lambda d: ("" if d[0] is None else str(d[0]), d[1])
    assert seen["language_id"] == sorted(key(d) for d in good + leaks + copies + alone)
    assert seen["simhash_dedup"] == sorted(key(d) for d in good + leaks + alone)
    assert seen["decontamination"] == sorted(key(d) for d in good + alone)
    assert set(seen["source_mixing"]) == {key(d) for d in good + alone}
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) == len(seen["source_mixing"]) and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)
    lib = Encoder(BPE)._library
    want = sorted((k, zlib.crc32(np.array([*lib([t])[0], 2], "<u4").tobytes())) for k, t in seen["source_mixing"])
    assert sorted(("" if r["doc_id"] is None else str(r["doc_id"]), r["ids_crc32"]) for r in out) == want


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [], [], [])).count() == 0
    one = [(1, "some words of a text", None, None, None, None, None), (2, None, "en", None, None, None, None)]
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, tables(spark, tmp_path / "one", one, [], [])).collect()] == [1]
