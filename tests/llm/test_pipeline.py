"""Stages of the corpus pipeline on small tables."""

import random
import re
import string

import pytest

from corpus_pipeline import keep_one_of_near_copies, keep_told_languages
from tidemark.llm.common import cut
from tidemark.llm.components import components
from tidemark.llm.near_copies import near_copy_groups

DOC = "doc_id long, text string, lang string"
WORDS = {"en": "the of and that which water house with from this have".split(), "de": "der die und nicht wasser haus durch aber über schön".split()}


def labelled(seed=3, n=300):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS[l], k=40)), l) for i in range(n) for l in [("en", "de")[i % 2]]]


def test_language_stage_rejects_by_the_network(spark):
    r = random.Random(5)
    junk = [(1000 + i, "".join(r.choices(string.ascii_lowercase + "   ", k=600)), None) for i in range(12)]
    cyrillic = [(2000, "сегодня хорошая погода и мы идём гулять в парк " * 6, None), (2001, "今天天气很好我们去公园散步" * 9, None)]
    mixed = [(2002, "the water of the house which have that und " * 9 + "парк", "en")]
    empty = [(3000, None, "en"), (3001, "", "en"), (3002, "12 34 !", "en")]
    good = labelled()
    kept = {x["doc_id"] for x in keep_told_languages(spark, spark.createDataFrame(good + junk + cyrillic + mixed + empty, DOC), "").collect()}
    assert kept >= {x[0] for x in good} | {2002}
    assert not kept & {2000, 2001, 3000, 3001, 3002}
    assert not kept & {x[0] for x in junk}


def test_language_stage_without_labels_keeps_documents(spark):
    docs = [(1, "some text", None), (None, "über alles", None), (3, "12 34", None), (4, None, None)]
    got = keep_told_languages(spark, spark.createDataFrame(docs, DOC), "").collect()
    assert sorted(str(x["doc_id"]) for x in got) == ["1", "None"]


def test_near_copy_stage_by_brute_force(spark):
    r = random.Random(9)
    words = ["".join(r.choices(string.ascii_lowercase, k=4)) for _ in range(3000)]
    texts = []
    for _ in range(25):
        base = r.choices(words, k=120)
        texts.append(base)
        for changes in (1, 2, 5):
            copy = list(base)
            for at in r.sample(range(len(copy)), changes):
                copy[at] = r.choice(words)
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["a b", "A  b", "c d e", "", None]
    docs = [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (None, "alone with no key at all here", "en"), (None, texts[0], "en"), (None, "again no key but other words here", "en")]
    sets = []
    for _, t, _ in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (k, t, _) in enumerate(docs):
        least.setdefault(top(i), []).append((k is None, k or 0, t or ""))
    want = sorted(min(x)[:2] for x in least.values())
    got = keep_one_of_near_copies(spark, spark.createDataFrame(docs, DOC).repartition(3), "").collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in got) == want


def test_pairs_that_others_join_are_not_compared(spark):
    from tidemark.llm import near_copies

    r = random.Random(4)
    words = ["".join(r.choices(string.ascii_lowercase, k=4)) for _ in range(500)]
    base = r.choices(words, k=150)
    docs = [(i, " ".join(base[:at] + ["x%d" % i] + base[at + 1 :])) for i, at in enumerate(range(0, 150, 3))] + [(50, "other words alone")]
    texts = cut(spark.createDataFrame(docs, "h long, t string"), "texts")
    pairs = spark.createDataFrame([(i, j) for j in range(50) for i in range(j)] + [(0, 50), (7, 50)], "a long, b long")
    counts = []
    compared = lambda p: near_copies._checked(p, texts, 0.8)
    got = {x["node"]: x["root"] for x in near_copies._joining(pairs, lambda p: counts.append(p.count()) or compared(p)).collect()}
    assert got == {i: 0 for i in range(50)}
    assert sum(counts) < 200 < pairs.count()
    everything = components(compared(pairs)).collect()
    assert got == {x["node"]: x["root"] for x in everything}


def test_split_prefixes_give_the_same_links(spark):
    from tidemark.llm.simhash import fingerprint_links

    r = random.Random(2)
    centre = r.getrandbits(64)
    prints = [centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(150)] + [r.getrandbits(64) for _ in range(60)]
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in prints + prints[:3]] + [(None,)], "fp long")
    groups = []
    for most in (1 << 18, 60):  # hot prefixes are split, down to the last bits
        got = components(fingerprint_links(fps, most_rows=most)).collect()
        groups.append({x["node"]: x["root"] for x in got})
    assert groups[0] == groups[1] and len(groups[0]) > 100
    links = {(x["a"], x["b"]) for x in fingerprint_links(fps, forest=False).collect()}
    assert links and all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)


def test_near_copies_of_a_large_group_pass_joins_by_their_ends(spark):
    """Pairs of fingerprints that collide meet their texts in a row for each end, not for each pair."""
    r = random.Random(4)
    words = ["".join(r.choices(string.ascii_lowercase, k=5)) for _ in range(400)]
    docs = []
    for i in range(300):
        text = list(words)
        for at in r.sample(range(len(text)), 3):
            text[at] = f"{text[at]}{i}"
        docs.append((i, " ".join(text)))
    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsCount()
    groups = near_copy_groups(spark.createDataFrame(docs, "row long, text string"), "row")
    assert groups.select("group").distinct().count() == 1
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows, runs = 0, store.executionsList()
    for at in range(began, runs.size()):
        run = runs.apply(at).executionId()
        told, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if re.search(r"Join \[a#\d+L\], \[a#\d+L\], Inner", node.desc()):
                found = [m for m in map(node.metrics().apply, range(node.metrics().size())) if m.name() == "number of output rows"]
                rows += sum(int(told.apply(m.accumulatorId()).replace(",", "")) for m in found if told.contains(m.accumulatorId()))
    assert 0 < rows <= 5000


def test_links_of_a_large_group_are_told_by_few_tasks(spark, monkeypatch):
    """Ten tables' links of near copies, before equal ones meet: a small multiple of the texts."""
    from tidemark.llm import simhash

    r = random.Random(6)
    words = ["".join(r.choices(string.ascii_lowercase, k=5)) for _ in range(400)]
    docs = []
    for i in range(300):
        text = list(words)
        for at in r.sample(range(len(text)), 3):
            text[at] = f"{text[at]}{i}"
        docs.append((i, " ".join(text)))
    rows, unfolded = [], simhash._unfolded

    def counted(*args):
        rows.append(unfolded(*args).count())
        raise StopIteration  # what comes behind is not asked for here

    monkeypatch.setattr(simhash, "_unfolded", counted)
    width, even = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (width, even)}
    spark.conf.set(width, "211")
    spark.conf.set(even, "false")
    try:
        with pytest.raises(StopIteration):
            near_copy_groups(spark.createDataFrame(docs, "row long, text string"), "row")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < sum(rows) <= 24_000  # 28887 with sixteen prefixes a fingerprint and two forests a task
