"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows, clashing
column names, and on empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tidemark.llm.bpe import Encoder
from tidemark.llm.components import components, local_forest
from tidemark.llm.decontaminate import contaminated, edit_match, normal
from tidemark.llm.embedding import embedding_groups, quantise
from tidemark.llm.induced import suffix_order
from tidemark.llm.language_id import gradients, language_id, learn_languages, new_network
from tidemark.llm.licenses import license_labels, license_spans
from tidemark.llm.lm import brown_scores, exchange_classes
from tidemark.llm.mixing import mix, mix_rates
from tidemark.llm.simhash import fingerprint, simhash_groups
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_output import canonical_codes, code_lengths, decode_table, pack, read_tokens, unpack, write_tokens

BPE = P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, fp string, k long, n string, h double, ws string, spans int, copies string, same int, core int, t string"


def rows(texts, first=0):
    return [(first + i, t, *["clash"][:1], 7, "n", 1.5, "ws", 3, "c", 1, 2, "t") for i, t in enumerate(texts)]


def frame(spark, texts, first=0, repeat=None):
    data = rows(texts, first)
    return spark.createDataFrame(data + ([data[repeat]] if repeat is not None else []), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, n, words=None):
    rnd = random.Random(seed)
    words = words or ["the", "river", "Stone", "of", "under", "light", "a", "wind,", "house.", "over", "mill", "grey", "path", "to"]
    return " ".join(rnd.choice(words) for _ in range(n))


TEXTS = [None, "", " ", "one", "One", "\n\t", prose(1, 40), prose(1, 40), prose(2, 3000), "x" * 5000, "é中 <|endoftext|> it's 12", "a\x00b"]


# --- token ids and counts ----------------------------------------------------------------------------------------


def test_encoder_equals_library():
    e = Encoder(BPE)
    rnd = random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'", "s", "re", "ll", "'s", "1", "23", ".", "--", "\x00", "中", "\xa0", "<|endoftext|>", "ß"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    want = e._library(texts)
    ids, n = e.encode(texts)
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert e.lengths(texts).tolist() == n.tolist()


def test_encoder_compares_pieces_of_one_hash(monkeypatch):
    import tidemark.llm.bpe as bpe

    monkeypatch.setattr(bpe, "piece_hashes", lambda a, starts, lens: lens.astype(np.uint64) % np.uint64(3) + np.uint64(1))
    e = Encoder(BPE)
    texts = [prose(i, 30) for i in range(6)] + ["", "a b", "x" * 5000]
    for _ in range(2):
        ids, n = e.encode(texts)
        want = e._library(texts)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_forgets_and_stays_right():
    e = Encoder(BPE, most_pieces=50)
    texts = [prose(i, 30, [f"w{j}q{i}" for j in range(40)]) for i in range(20)]
    for t in texts * 2:
        assert e.encode([t])[0].tolist() == e._library([t])[0]


def test_token_counts(spark):
    lib = Encoder(BPE)._library
    got = token_counts(frame(spark, TEXTS, repeat=6).withColumnRenamed("n", "n_tokens"), BPE, limit=20, piece_chars=100)
    assert "text" not in got.columns and got.columns.count("n_tokens") == 1
    out = got.collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        t = TEXTS[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(lib([t])[0])) and r["over_limit"] == (r["n_tokens"] > 20)
    assert token_counts(empty(spark), BPE).count() == 0
    model = token_counts(frame(spark, TEXTS), P.path("piece_bpe_32k.model")).where("doc_id = 6").first()
    assert model["n_tokens"] > 0


def test_huffman_round_trips():
    rng = np.random.default_rng(1)
    for n, v in ((5000, 900), (513, 2), (1, 1), (0, 4)):
        ids = (rng.zipf(1.3, n) % v).astype(np.uint32)
        bits = code_lengths(np.bincount(ids, minlength=v), 12)
        codes = canonical_codes(bits)
        assert bits.max(initial=0) <= 12
        if np.count_nonzero(bits) > 1:
            assert sum(2.0 ** -int(b) for b in bits if b) == pytest.approx(1)
        data, starts = pack(ids, bits, codes, 64)
        assert np.array_equal(unpack(data, starts, n, decode_table(bits, codes), 64), ids)


def test_token_output(spark, tmp_path):
    lib = Encoder(BPE)._library
    docs = frame(spark, TEXTS, repeat=6)
    write_tokens(docs, str(tmp_path / "t"), BPE, chunk_tokens=500)
    out = sorted(read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted([*range(len(TEXTS)), 6])
    at = 0
    for r in out:
        want = np.array([*lib([TEXTS[r["doc_id"]] or ""])[0], 2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(want) // 4, want)
        at += r["n_tokens"]
    digest = {r["start"]: r["ids_crc32"] for r in read_tokens(spark, str(tmp_path / "t"), digest=True).collect()}
    assert all(digest[r["start"]] == zlib.crc32(bytes(r["ids"])) for r in out)
    write_tokens(empty(spark), str(tmp_path / "e"), BPE)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


# --- language ----------------------------------------------------------------------------------------------------


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = new_network(["a", "b"], 3, rng)
    x, target = rng.integers(0, 256, (5, 4)).astype(np.uint8), rng.integers(0, 2, 4)
    _, grads = gradients(net, x, target)
    for w, g in zip(net.weights(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[i]
        w[i] = old + 1e-2
        up = gradients(net, x, target)[0]
        w[i] = old - 1e-2
        down = gradients(net, x, target)[0]
        w[i] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[i]), rel=0.02, abs=1e-4)


def test_language_id(spark):
    de, en = ["und", "schloß", "über", "zeit", "nicht"], ["the", "which", "why", "look", "of"]
    data = [(i, prose(i, 30, de if i % 2 else en), "de" if i % 2 else "en") for i in range(200)]
    data += [(200, None, "en"), (201, "12 !!", "de"), (202, "", None), (203, prose(9, 4000, de), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    net = learn_languages(df, steps=60)
    assert net.langs == ["de", "en"]
    out = {r["doc_id"]: r for r in language_id(df.withColumnRenamed("lang", "score"), net).collect()}
    assert [out[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and out[201]["score"] == 0
    right = [out[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(right) > 0.95 and out[203]["lang_pred"] == "de" and 0 <= out[203]["score"] <= 1
    assert learn_languages(df.where("lang is null")) is None
    assert {r["lang_pred"] for r in language_id(df, None).collect()} == {"und"}
    assert language_id(df.limit(0), net).count() == 0


# --- near copies -------------------------------------------------------------------------------------------------


def test_local_forest_and_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    good = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    n, r = local_forest(np.array([a for a, _ in good]), np.array([b for _, b in good]))
    assert all(find(a) == b for a, b in zip(n.tolist(), r.tolist()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark):
    base = prose(5, 400)
    texts = TEXTS + [base.replace("river", "rivers", k) for k in range(12)] + [prose(i, 60) for i in range(20, 60)]
    out = sorted(simhash_groups(frame(spark, texts, repeat=3)).collect(), key=lambda r: r["doc_id"])
    ids = [r["doc_id"] for r in out]
    prints = [fingerprint(texts[i]) for i in ids]
    assert [r["fingerprint"] for r in out] == [f"{p:016x}" for p in prints] and prints[0] == 0
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert [r["component_id"] for r in out] == [ids[find(i)] for i in range(len(ids))]
    assert simhash_groups(empty(spark)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16))
    near = x[:10] + 0.2 * rng.standard_normal((10, 16))
    vs = [*x.tolist(), *near.tolist(), x[0].tolist(), x[0].tolist(), (3 * x[1]).tolist(), None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in enumerate(vs)], "vec_id long, embedding array<float>, label int, node string")
    out = {r["vec_id"]: r for r in embedding_groups(df, tile_rows=20).collect()}
    ok = [i for i, v in enumerate(vs) if v and None not in v and not np.isnan(v).any() and np.any(np.array(v))]
    links = {i: set() for i in range(len(vs))}
    for i in ok:
        for j in ok:
            if i != j and len(vs[i]) == len(vs[j]):
                a, b = np.float32(vs[i]).astype(float), np.float32(vs[j]).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                    links[i].add(j)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (len(links[i]), min(seen), min(seen) == i)
    assert embedding_groups(df.limit(0)).count() == 0
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = quantise(unit)
    rows = np.arange(len(unit))
    for near, err in ((q.coarse * q.step[:, None], q.error), (q.near(rows), q.fine_error)):
        assert (np.abs(near @ near.T - unit @ unit.T) <= err[:, None] + (1 + err[:, None]) * err[None, :]).all()
    assert q.fine_error.max() < q.error.min() / 50


def test_pairs_that_rounding_leaves_open(spark):
    """Cosines a hair above and below the threshold, between copies in any number, and rows with null and repeated keys."""
    rng = np.random.default_rng(5)
    vs = []
    for gap in (1e-7, -1e-7, 3e-6, -3e-6, 1e-3, -1e-3):
        a = rng.standard_normal(24)
        b = rng.standard_normal(24)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.95 + gap
        vs += [a, c * a + np.sqrt(1 - c * c) * b]
    data = [(i, v.tolist()) for i, v in enumerate(vs)] + [(0, vs[0].tolist()), (20, vs[1].tolist()), (None, vs[0].tolist())]
    out = embedding_groups(spark.createDataFrame(data, "vec_id long, embedding array<double>"), tile_rows=4).collect()
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert got[0] == [(3, 0), (3, 0)] and got[1] == [(3, 0)] and got[20] == [(3, 0)] and got[None] == [(0, None)]
    assert got[2] == [(0, 2)] and got[3] == [(0, 3)] and got[4] == [(1, 4)] and got[5] == [(1, 4)]
    assert got[6] == [(0, 6)] and got[7] == [(0, 7)] and got[9] == [(1, 8)] and got[11] == [(0, 11)]


# --- language model ----------------------------------------------------------------------------------------------


def test_lm_base_and_classes(spark):
    texts = TEXTS + [prose(i, 50) for i in range(60)]
    out = sorted(brown_scores(frame(spark, texts, repeat=20), n_classes=4, min_share=0.01).collect(), key=lambda r: r["doc_id"])
    ids = [r["doc_id"] for r in out]
    split = lambda t: (t or "").encode().lower().split()
    train = [i for i in ids if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in split(texts[i]))
    n, v = sum(c.values()) + len(train), len(c) + 1
    for r in out:
        counts = [c[w] for w in split(texts[r["doc_id"]])] + [len(train)]
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in counts)
        assert r["base_score"] == pytest.approx(base) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(counts), sum(x > 0 for x in counts), n)
        assert r["score"] < 0 and r["held_out"] == (r["doc_id"] not in train)
    assert brown_scores(empty(spark)).count() == 0


def test_lm_score_by_brute_force(spark):
    """The same model in plain loops: every training word is in the class that its own neighbours make most likely."""
    from tidemark.llm.lm import ENDINGS, context_weights, ending

    rnd = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in ("a", "e", "io") for c in ("rk", "st", "l", "nd")]
    texts = [None, "", prose(2, 1500, vocabulary), *(prose(i, rnd.randint(1, 40), vocabulary[: 10 + i % 50]) for i in range(70))] + ["never seen words"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[6])]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, word int, cls int").repartition(3)
    n_classes, share, smooth = 5, 0.02, 50.0
    got = brown_scores(df, n_classes=n_classes, min_share=share, smooth=smooth, batch_bytes=2000).collect()
    train = [t for k, t in docs if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1]
    split = lambda t: (t or "").encode().lower().split()
    c = Counter(w for t in train for w in split(t))
    total = sum(c.values()) + len(train)
    own = {w: i for i, w in enumerate(sorted(w for w in c if c[w] >= max(1.0, share * total)))}
    end = len(own) + ENDINGS
    unit = lambda w: end if w is None else own[w] if w in own else len(own) + ending(w)
    pairs = Counter()
    for t in train:
        row = [None, *split(t), None]
        pairs.update((unit(a), unit(b)) for a, b in zip(row, row[1:]))
    first, second = (np.array(x) for x in zip(*pairs))
    seed = exchange_classes(first, second, np.array(list(pairs.values())), end + 1, n_classes)
    k = n_classes + 1
    seeds = np.zeros((k, k))
    for (a, b), n in pairs.items():
        seeds[seed[a], seed[b]] += n
    weights, of = context_weights(seeds), {None: n_classes}
    around = {w: np.zeros(2 * k) for w in c}
    for t in train:
        row = [None, *split(t), None]
        for a, w, b in zip(row, row[1:], row[2:]):
            around[w][seed[unit(a)]] += 1
            around[w][k + seed[unit(b)]] += 1
    for w in c:
        of[w] = seed[own[w]] if w in own else int(np.argmax(around[w] @ weights))
    assert any(of[w] != seed[unit(w)] for w in c)
    of_class = lambda w: of[w] if w in of else seed[unit(w)]
    table, tok, types = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in train:
        row = [None, *split(t), None]
        for a, b in zip(row, row[1:]):
            table[seed[unit(a)], of[b]] += 1
            tok[of[b]] += 1
    for w in [*c, None]:
        types[of[w]] += 1
    uni = (tok + 0.5) / (tok.sum() + 0.5 * k)
    want = {}
    for key, t in docs:
        row, score = [None, *split(t), None], 0.0
        for a, b in zip(row, row[1:]):
            s, x = seed[unit(a)], of_class(b)
            score += math.log10((table[s, x] + smooth * uni[x]) / (table[s].sum() + smooth))
            if b is not None:
                score += math.log10((c[b] + 0.5) / (tok[x] + 0.5 * (types[x] + 1)))
        want.setdefault(key, []).append((len(row) - 1, score))
    assert len(got) == len(docs)
    for r in got:
        assert any(r["n_tokens"] == n and r["score"] == pytest.approx(score) for n, score in want[r["doc_id"]])
    for s in range(k):  # probabilities of all classes and of all words of a class
        assert sum((table[s, x] + smooth * uni[x]) / (table[s].sum() + smooth) for x in range(k)) == pytest.approx(1)


def class_likelihood(pairs, cls, k):
    table = np.zeros((k, k))
    np.add.at(table, (cls[:, None], cls[None, :]), pairs)
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def test_exchange_raises_likelihood():
    """Against where it starts, and no single move from where it ends is better."""
    rng = np.random.default_rng(1)
    pairs = rng.poisson(2, (25, 25)).astype(float)
    pairs[:8, 8:16] += 30
    first, second = np.nonzero(pairs)
    cls = exchange_classes(first, second, pairs[first, second], 25, 3)
    start = np.append(np.argsort(np.argsort(-pairs.sum(axis=1)[:-1], kind="stable"), kind="stable") % 3, 3)
    end = class_likelihood(pairs, cls, 4)
    assert end > class_likelihood(pairs, start, 4) and cls[-1] == 3
    for w in range(24):
        for c in range(3):
            other = cls.copy()
            other[w] = c
            assert class_likelihood(pairs, other, 4) <= end + 1e-6


# --- mixing ------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    good, bad = ["fine", "clear", "short", "plain"], ["zzz", "qqq", "###", "xx"]
    texts = [prose(i, 30, good if i % 4 else bad) for i in range(200)] + [None, ""]
    docs = frame(spark, texts, repeat=5)
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(100)] + [(101, None, None), (None, 1, 0), (500, 1, 1)], "doc_id long, quality int, toxic int")
    out = mix_rates(docs, labels, {"high": 0.5, "low": 0.5, "toxic": 0.0}, ("high", "low")).toPandas()
    assert len(out) == 202 and (out.rate >= 0).all()
    mass = {d: (out.n_words * out.same * out.rate * out[f"p_{d}"]).sum() for d in ("high", "low")}
    assert mass["high"] == pytest.approx(mass["low"], rel=1e-3)
    assert out[out.doc_id % 4 == 0].query("doc_id < 200").p_low.min() > 0.5
    kept = mix(docs, labels, {"high": 0.5, "low": 0.5}, ("high", "low"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(200) if i % 4}
    assert mix_rates(empty(spark), labels, {"high": 1.0, "low": 1.0}).count() == 0
    assert mix_rates(docs, labels.limit(0), {"high": 1.0, "low": 1.0}).count() == 202


# --- repeats -----------------------------------------------------------------------------------------------------


def test_spans_of_many_rows_merge_at_once():
    from tidemark.llm.suffix_dedup import merged

    r = random.Random(3)
    for n in (0, 1, 300):
        spans = sorted((r.randrange(9), s, s + r.randrange(1, 9)) for s in (r.randrange(60) for _ in range(n)))
        got = list(zip(*(x.tolist() for x in merged(*np.array(spans, np.int64).reshape(n, 3).T))))
        covered = [{(row, x) for row, s, e in some for x in range(s, e)} for some in (spans, got)]
        assert covered[0] == covered[1] and got == sorted(got)
        assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(got, got[1:]))  # joined where they touch


def test_suffix_order_by_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(90):
        t = np.append(rng.integers(1, 2 + trial % 7, rng.integers(1, 70)), 0).astype(np.int64)
        if trial % 9 == 0:
            t = np.append(np.tile(t[:-1], 4), 0)
        order, lcp = suffix_order(t, 9, 1 if trial % 2 else 1 << 28)  # a budget of one byte sends everything through files
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())[::-1]
        for x in range(1, len(t)):
            i, j, k = order[x], order[x - 1], 0
            while max(i, j) + k < len(t) and t[i + k] == t[j + k] and k < 9:
                k += 1
            assert lcp[x] == k


@pytest.mark.parametrize("budget, piece", [(1 << 25, None), (1, 700)])
def test_repeats(spark, monkeypatch, budget, piece):
    """With a budget of one byte every queue and result of every level is in files; with small pieces, texts are cut."""
    import tidemark.llm.suffix_dedup as sd

    shared, rnd = prose(77, 60), random.Random(5)
    texts = TEXTS + [prose(i, 80, [f"w{j}" for j in range(999)]) for i in range(20)]
    texts += [prose(100 + i, 20) + shared[: rnd.randint(60, 300)] + prose(200 + i, 20) for i in range(15)]
    texts += [prose(300 + i, 5) + shared[rnd.randint(0, 200) :] for i in range(9)]
    texts += [prose(400 + i, 30) + f" {i} " + shared[20:][: rnd.randint(112, 155)] + f" {i} " + prose(500 + i, 30) for i in range(9)]
    docs, length, passage = frame(spark, texts, repeat=8), 160, 110
    docs = docs.unionByName(docs.where("doc_id in (20, 35)").withColumn("doc_id", docs.doc_id * 0 + 1000 + docs.doc_id)).withColumn("doc_id", sd.F.when(sd.F.col("doc_id") < 1035, sd.F.col("doc_id")))
    if piece:
        rows = [(t or "").encode() for t in texts]
        whole = sd.units(rows, (passage, length))
        monkeypatch.setattr(sd, "PIECE", piece)
        parts = sd.units(rows, (passage, length))
        cover = lambda x: sorted((i, s + j, l) for i, s, n, _, l in zip(*(y.tolist() for y in x[:5])) for j in range(n))
        assert cover(parts) == cover(whole) == sorted((i, p, l) for i, t in enumerate(rows) for l in (passage, length) for p in range(len(t) - l + 1))
        monkeypatch.undo()
    got = remove_repeats(docs, length=length, passage=passage, digest=True, budget=budget, shard_bytes=4_000).collect()
    data = [(t or "").encode() for t in texts]
    every = [*data, data[8], data[20], data[35]]
    seen = {n: Counter(t[p : p + n] for t in every for p in range(len(t) - n + 1)) for n in (length, passage)}
    assert len(got) == len(every) and sum(r["doc_id"] is None for r in got) == 1
    for r in got:
        t = data[35 if r["doc_id"] is None else r["doc_id"] % 1000]
        gone = {n: np.zeros(len(t), bool) for n in seen}
        for n in seen:
            for p in range(len(t) - n + 1):
                if seen[n][t[p : p + n]] > 1:
                    gone[n][p : p + n] = True
        kept = bytes(b for b, g in zip(t, gone[length]) if not g)
        spans = int((np.diff(np.concatenate([[0], gone[length].astype(int)])) == 1).sum())
        want = len(t), int(gone[length].sum()), spans, hashlib.sha256(kept).hexdigest(), int(gone[passage].sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_repeated"]) == want
    assert sum(r["n_repeated"] > r["n_removed"] for r in got) > 5
    assert remove_repeats(empty(spark), length=length).count() == 0


def test_shard_beyond_its_budget(monkeypatch):
    """A shard of eight times its budget goes through files on every level."""
    import tidemark.llm.induced as induced

    spilt, levels = [], []
    spill, sweep = induced.BulkQueue._spill, induced._sweep_names
    monkeypatch.setattr(induced.BulkQueue, "_spill", lambda q: (spilt.append(q.held), spill(q)))
    monkeypatch.setattr(induced, "_sweep_names", lambda t, *a: (levels.append(len(t)), sweep(t, *a))[1])
    t = np.frombuffer((prose(4, 9000) + prose(5, 500) * 40).encode(), np.uint8).astype(np.int64)
    t = np.append(t, 0)
    order, lcp = suffix_order(t, 60, len(t) // 8)
    assert len(levels) >= 4 and len(spilt) > 3 * len(set(levels))
    data = t.astype(np.uint8).tobytes()
    for x in np.random.default_rng(1).integers(1, len(t), 4000).tolist():
        i, j = int(order[x]), int(order[x - 1])
        assert data[j:] > data[i:]
        assert int(lcp[x]) == next((k for k in range(60) if i + k >= len(data) or j + k >= len(data) or data[i + k] != data[j + k]), 60)
    assert np.array_equal(np.sort(order), np.arange(len(t)))


# --- benchmark items ---------------------------------------------------------------------------------------------


def distance_anywhere(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, x in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return min(prev)


def test_contamination(spark):
    rnd = random.Random(6)
    items = [prose(300 + i, 12, [f"{a}{b}" for a in "bcdfg" for b in ("ar", "elo", "ish")]) for i in range(4)] + [None, ""]
    texts = [None, "", "short"]
    for i in range(60):
        s = list(items[i % 4])
        for _ in range(rnd.randint(0, 9)):
            at = rnd.randrange(len(s))
            s[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "y"])
        texts.append(prose(i, 8) + "\n" + "".join(s).upper() + "  " + prose(i + 1, 8))
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(frame(spark, texts), bench, block_chars=50).collect()}
    for d, t in enumerate(texts):
        for i, item in enumerate(items[:4]):
            near = distance_anywhere(normal(item), normal(t))
            assert ((d, i) in got) == (near <= int(0.1 * len(normal(item)))), (d, i, near)
            if (d, i) in got:
                place = got[d, i]
                assert place["distance"] == near
                assert distance_anywhere(normal(item), normal(t)[place["start"] : place["end"]]) == near
    assert contaminated(empty(spark), bench).count() == 0 and contaminated(frame(spark, texts), bench.limit(0)).count() == 0
    assert edit_match("abc", "xxabdxx", 1) == (1, 4) and edit_match("abc", "zzz", 1) is None


# --- licenses ----------------------------------------------------------------------------------------------------


def test_licenses(spark):
    texts = TEXTS + [
        "Released under the MIT License. " * 3,
        "see the Apache license, and the GNU General Public License!",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal with it",
        "mit mit license apache",
        prose(1, 50) + " Licensed under CC BY-NC 4.0. " + prose(2, 50),
    ]
    base = len(TEXTS)
    df = frame(spark, texts, repeat=base)
    out = {r["doc_id"]: r for r in license_labels(license_spans(df)).collect()}
    assert license_spans(df).count() == len(texts) + 1 and len(out) == len(texts) and out[0]["n_words"] == 0 and out[0]["first_word"] is None and out[0]["labels"] == "" and out[0]["score"] == 0
    assert (out[base]["n_base"], out[base]["first_word"], out[base]["last_word"], out[base]["base_labels"]) == (3, 3, 13, "mit")
    assert out[base + 1]["base_labels"] == "apache,gpl" and out[base + 1]["n_base"] == 2
    assert out[base + 2]["base_labels"] == "" and out[base + 2]["labels"] == "mit" and 0.6 <= out[base + 2]["score"] <= 1
    assert (out[base + 3]["n_base"], out[base + 3]["first_word"]) == (1, 1)
    assert out[base + 4]["labels"] == "cc-by-nc-4.0" and out[6]["labels"] == ""
    assert license_spans(empty(spark)).count() == 0
