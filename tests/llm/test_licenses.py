"""License spans against alignments made by hand and by brute force."""

import random

import pytest

from tidemark.llm.licenses import EDITS, TEMPLATES, license_labels, license_spans

SAYS_NONE = [
    "released under the new roadmap",
    "released under the bsd two clause license",
    "this work is licensed under a proprietary agreement",
    "licensed under the terms of the agreement version 2 0",
    "unless required by law",
]


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def test_words_that_tell_licenses_apart_are_asked_for(spark):
    df = spark.createDataFrame(list(enumerate(SAYS_NONE)), "doc_id long, text string")
    assert [r["labels"] for r in license_labels(license_spans(df)).collect()] == [""] * len(SAYS_NONE)


def test_spans_by_brute_force(spark):
    r = random.Random(8)
    filler = ["stone", "river", "light", "grey"]
    docs, want = [], {}
    for t, (label, text) in enumerate(TEMPLATES):
        ws = text.lower().split()
        need = {i for i, w in enumerate(text.split()) if w.isupper() and w.isalpha()}
        free = [i for i in range(2, len(ws) - 2) if i not in need]
        for kind in ("whole", "edited", "half", "named"):
            out, changed = list(ws), 0
            if kind == "edited":  # changes so far apart that the words between are runs of three
                for i in free[4::9]:
                    if changed < int(len(ws) * EDITS):
                        out[i], changed = f"q{i}", changed + 1
            elif kind == "half":
                out = out[: len(out) // 2]
            elif kind == "named":
                if not need:
                    continue
                for i in need:
                    out[i] = "other"
            key = len(docs)
            docs.append((key, " ".join(r.choices(filler, k=9)).title() + ". " + ", ".join(out) + "! " + " ".join(r.choices(filler, k=5))))
            if kind in ("whole", "edited"):
                assert common(ws, out) == len(ws) - changed
                want[key] = (label, 9, 9 + len(ws) - 1, (len(ws) - changed) / len(ws))
    docs.append((None, docs[0][1]))
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string")
    got = license_spans(df).collect()
    assert len(got) == len(docs) + 1 and sum(x["doc_id"] == 0 for x in got) == 2 and sum(x["doc_id"] is None for x in got) == 1
    for x in got:
        key = 0 if x["doc_id"] is None else x["doc_id"]
        spans = [s for s in x["spans"] if s["last_word"] - s["first_word"] >= 4]
        if key in want:
            label, first, last, share = want[key]
            assert any((s["label"], s["first_word"], s["last_word"]) == (label, first, last) and s["share"] == pytest.approx(share) for s in spans), (key, spans)
        else:
            assert not spans, (docs[key], spans)


def test_repeated_and_long_texts(spark):
    text = "Released under the MIT License. " * 400 + "word " * 30000
    got = license_spans(spark.createDataFrame([(1, text, 5), (1, text, 5), (2, None, 5)], "doc_id long, text string, t int")).collect()
    assert sorted((x["doc_id"], x["n_base"], len(x["spans"])) for x in got) == [(1, 400, 400), (1, 400, 400), (2, 0, 0)]
