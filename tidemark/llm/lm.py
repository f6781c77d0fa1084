"""Scores of a Brown class-based bigram model, trained on the corpus it stands beside.

Words with at least ``min_share`` of all training tokens are units of their own (so there are 1 / min_share at most), and
all rarer words with one ending share a unit for now.  Exchange clustering moves units between classes while the likelihood
of the class bigrams grows.  Every other word of the training texts is then taken out of its unit and exchanged against
these classes: from counts of the classes before and after it in the whole corpus it moves to the class that gives them
the highest likelihood.  A token's probability is that of its class after the class of the unit before it, times that of
the word in its class, both smoothed.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, cut, drop_cut, give_back, sub_batches

ENDINGS = 256
DELTA = 0.5
_END = b""  # stands for the end of a text among the words


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def ending(word: bytes) -> int:
    """Which of the units for rare words a word belongs to, by its last three bytes."""
    return zlib.crc32(word[-3:]) % ENDINGS


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_classes(first: np.ndarray, second: np.ndarray, n: np.ndarray, size: int, n_classes: int) -> np.ndarray:
    """Class of each of `size` units from counts n of adjacent units; the last unit, the end of a text, keeps a class of its
    own.

    Units are visited by falling count and moved to the class that raises the likelihood of the class bigrams most, until
    a pass moves none.
    """
    n = n.astype(np.float64)
    end, total = n_classes, np.bincount(first, n, size)
    order = np.argsort(-total[:-1], kind="stable")
    cls = np.empty(size, np.int64)
    cls[order] = np.arange(size - 1) % n_classes
    cls[-1] = end
    k = n_classes + 1
    to = np.bincount(first * k + cls[second], n, size * k).reshape(size, k)  # counts of each unit before and after each class
    into = np.bincount(second * k + cls[first], n, size * k).reshape(size, k)
    table = np.bincount(cls[first] * k + cls[second], n, k * k).reshape(k, k)
    after, before = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    after_at, before_at = np.searchsorted(first[after], np.arange(size + 1)), np.searchsorted(second[before], np.arange(size + 1))
    loops = np.bincount(first[first == second], n[first == second], size)
    moved = 1
    while moved:
        moved = 0
        for w in order:
            old, same = cls[w], loops[w]
            r, l = to[w].copy(), into[w].copy()
            r[old] -= same
            l[old] -= same
            table[old] -= r
            table[:, old] -= l
            table[old, old] -= same
            f = _xlogx(table)
            a, b = _xlogx(table + r[None, :]) - f, _xlogx(table + l[:, None]) - f
            d = np.diag(table)
            gain = a.sum(axis=1) - np.diag(a) + b.sum(axis=0) - np.diag(b) + _xlogx(d + r + l + same) - _xlogx(d)
            rows, cols, n_r, n_l = table.sum(axis=1), table.sum(axis=0), r.sum() + same, l.sum() + same
            gain -= _xlogx(rows + n_r) - _xlogx(rows) + _xlogx(cols + n_l) - _xlogx(cols)
            new = int(np.argmax(gain[:n_classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += r
            table[:, new] += l
            table[new, new] += same
            if new != old:
                cls[w] = new
                x, y = before[before_at[w] : before_at[w + 1]], after[after_at[w] : after_at[w + 1]]
                to[first[x], old] -= n[x]
                to[first[x], new] += n[x]
                into[second[y], old] -= n[y]
                into[second[y], new] += n[y]
                moved += 1
    return cls


def context_weights(table: np.ndarray) -> np.ndarray:
    """What one class before (first half) or after (second half) a word adds to its log likelihood in each class but the
    end's, from a table of class bigrams."""
    k = len(table)
    row, col = table.sum(axis=1) + 0.5 * k, table.sum(axis=0) + 0.5 * k
    smooth = np.log(table + 0.5)
    return np.concatenate([smooth - np.log(col)[None, :], (smooth - np.log(row)[:, None]).T])[:, : k - 1]


def _plane(ids: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress better."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplane(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def _binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows of a binary column, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data[int(at[0]) : int(at[-1])] if data is not None else b"", kind), np.diff(at) // np.dtype(kind).itemsize


def _sequence(ids: np.ndarray, lens: np.ndarray, end: int) -> np.ndarray:
    """Texts one after the other, the end after each."""
    return np.insert(ids, np.cumsum(lens), end)


def brown_scores(df: DataFrame, key: str = "doc_id", text: str = "text", n_classes: int = 64, min_share: float = 2e-4, fold: tuple[int, int] = (5, 1), smooth: float = 50.0, batch_bytes: int = 6 << 20) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of df.

    A row is held out if crc32 of its key as text modulo fold[0] is fold[1]; the model learns from all others.  A null
    text counts as empty and has one token, the end; a null key counts as the empty text in the fold.  Repeated rows
    count and are scored each time, an empty table gives an empty one, and without training rows every word is unknown.
    Other columns are not read.  base_score is the unigram score with 0.5 added to each count, score the class model's
    log10 probability.  A word that was not learnt has the class of its ending's unit.

    Texts are taken in batches of about batch_bytes (or one text), whose words are numbered once and stored in the shared
    folder.  Each batch's distinct words, with counts of the classes beside them, travel to one place for each word and back
    to the batch, so that no task holds more than the words of its own texts and one word's batches, and no table of all
    words is broadcast.  The driver gets the units (at most 1 / min_share + 257), their bigrams, and sums by class.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), (crc_mod(key, fold[0]) == fold[1]).alias("held"))
    key_type = base.limit(0).toArrow().schema.field("k").type

    def number(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for b in sub_batches(batches, "t", batch_bytes):
            slot: defaultdict[bytes, int] = defaultdict()
            slot.default_factory = slot.__len__
            parts = [np.fromiter(map(slot.__getitem__, tokens(t)), np.int32) for t in b.column("t").to_pylist()]
            held = b.column("held").to_numpy(zero_copy_only=False)
            learnt = [p for p, h in zip(parts, held) if not h]
            n = np.bincount(np.concatenate(learnt) if learnt else np.zeros(0, np.int32), minlength=len(slot))
            row = [(task << 32) | seq, b.column("k").to_pylist(), held.tolist(), [len(p) for p in parts], _plane(np.concatenate(parts)), list(slot), n.tolist()]
            kinds = [pa.int64(), pa.list_(key_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["g", "ks", "held", "lens", "ids", "words", "n"])
            seq += 1
        give_back()

    stored = cut(base.mapInArrow(number, f"g bigint, ks array<{kind}>, held array<boolean>, lens array<int>, ids binary, words array<binary>, n array<bigint>"), "batches")
    words = stored.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.n").alias("n")).where("n > 0")
    counts = cut(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    n_train = stored.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + n_train, distinct + (n_train > 0)
    often = counts.where(F.col("c") >= max(1.0, min_share * total)).select("word").toArrow().column("word").to_pylist()
    drop_cut(counts)
    own = {w: i for i, w in enumerate(sorted(often))}
    n_own, size = len(own), len(own) + ENDINGS + 1
    end, k = size - 1, n_classes + 1

    def of_words(ws: list[bytes]) -> np.ndarray:
        return np.fromiter((own[w] if w in own else n_own + ending(w) for w in ws), np.int64, len(ws))

    def learnt(b: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the training texts' words in a row, with an end before, between and after them, and the words."""
        ids, lens, ws = _unplane(b.column("ids")[0].as_buffer()), b.column("lens")[0].values.to_numpy(), b.column("words")[0].as_py()
        use = ~b.column("held")[0].values.to_numpy(zero_copy_only=False)
        x = _sequence(ids[np.repeat(use, lens)], lens[use], len(ws))
        return np.insert(x, 0, len(ws)), ws

    def bigrams(batches):
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in sub_batches(batches, "ids", 1):
            x, ws = learnt(b)
            u = np.append(of_words(ws), end)[x]
            codes, n = np.unique(u[:-1] * size + u[1:], return_counts=True)
            c, at = np.unique(np.concatenate([seen[0], codes]), return_inverse=True)
            seen = c, np.bincount(at, np.concatenate([seen[1], n]), len(c)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen[0]), pa.array(seen[1])], names=["pair", "n"])

    got = stored.select("ids", "lens", "held", "words").mapInArrow(bigrams, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n_pair = got.column("pair").to_numpy(), got.column("n").to_numpy()
    del got
    cls = exchange_classes(pair // size, pair % size, n_pair, size, n_classes)
    seeds = np.bincount(cls[pair // size] * k + cls[pair % size], n_pair, k * k).reshape(k, k)
    del pair, n_pair
    weights = context_weights(seeds)

    def contexts(batches):
        for b in sub_batches(batches, "ids", 1):
            x, ws = learnt(b)
            of = cls[np.append(of_words(ws), end)]
            y = of[x]
            pairs = np.concatenate([x[1:] * (2 * k) + y[:-1], x[1:-1] * (2 * k) + k + y[2:]])
            codes, n = np.unique(pairs, return_counts=True)
            many = n // 60_000 + 1  # so that a count fits into 16 bits
            codes, n = np.repeat(codes, many), np.minimum(np.repeat(n, many) - 60_000 * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)), 60_000)
            at = np.searchsorted(codes, np.arange(len(ws) + 2) * (2 * k))
            each = np.append(b.column("n")[0].values.to_numpy(), len(x) and np.count_nonzero(x[1:] == len(ws)))
            spots = np.arange(len(ws) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ws, _END], pa.binary()), pa.array(np.full(len(spots), b.column("g")[0].as_py())), pa.array(spots), pa.array(each), pa.array(of.astype(np.int16)), _binary((codes % (2 * k)).astype("<u2"), 2 * at), _binary(n.astype("<u2"), 2 * at)],
                names=["word", "g", "i", "n", "s", "codes", "ns"],
            )
        give_back()

    def assign(batches):
        table, tok, types = np.zeros((k, k)), np.zeros(k, np.int64), np.zeros(k, np.int64)

        def settle(b: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
            w = len(first)
            of = np.repeat(np.arange(w), np.diff(first, append=b.num_rows))
            codes, lens = _flat(b.column("codes"), "<u2")
            seen = np.bincount(np.repeat(of, lens) * (2 * k) + codes, _flat(b.column("ns"), "<u2")[0], w * 2 * k).reshape(w, 2 * k)
            c, s = np.bincount(of, b.column("n").to_numpy(), w).astype(np.int64), b.column("s").to_numpy().astype(np.int64)
            to = np.where(c > 0, np.argmax(seen @ weights, axis=1), s[first])
            for i, word in enumerate(b.column("word").take(pa.array(first)).to_pylist()):
                if word in own or word == _END:
                    to[i] = s[first[i]]
            np.add.at(table, to, seen[:, :k])
            np.add.at(tok, to, c)
            np.add.at(types, to, c > 0)
            return pa.RecordBatch.from_arrays([b.column("g"), b.column("i"), pa.array(c[of]), pa.array(to[of].astype(np.int16)), b.column("s")], names=["g", "i", "c", "cls", "s"])

        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if kept is None else pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
            word = b.column("word")
            first = np.append(0, np.flatnonzero(pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)) + 1)
            if len(first) > 1:
                yield settle(b.slice(0, int(first[-1])), first[:-1])
            kept = b.slice(int(first[-1]))  # this word may go on in the next batch
        if kept is not None:
            yield settle(kept, np.zeros(1, np.int64))
        places = np.arange(k)
        i = np.concatenate([(places[:, None] * (k + 2) + places[None, :]).ravel(), places * (k + 2) + k, places * (k + 2) + k + 1])
        c = np.concatenate([table.ravel().astype(np.int64), tok, types])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), -1)), pa.array(i.astype(np.int32)), pa.array(c), pa.array(np.zeros(len(i), np.int16)), pa.array(np.zeros(len(i), np.int16))], names=["g", "i", "c", "cls", "s"])
        give_back()

    beside = stored.mapInArrow(contexts, "word binary, g bigint, i int, n bigint, s smallint, codes binary, ns binary")
    told = cut(beside.repartition("word").sortWithinPartitions("word").mapInArrow(assign, "g bigint, i int, c bigint, cls smallint, s smallint"), "classes")
    sums = np.zeros((k, k + 2))
    for r in told.where("g < 0").groupBy("i").agg(F.sum("c").alias("c")).collect():
        sums[r["i"] // (k + 2), r["i"] % (k + 2)] = r["c"]
    table, in_class, types_in = sums[:, :k].T, sums[:, k], sums[:, k + 1]  # table: of the classes before, by class
    uni = (in_class + 0.5) / (in_class.sum() + 0.5 * k)
    step = np.log10((table + smooth * uni[None, :]) / (table.sum(axis=1, keepdims=True) + smooth))
    floor = in_class + DELTA * (types_in + 1)
    low = total + 0.5 * (distinct + 1)

    def score(b: pa.Table, known: pa.Table) -> pa.Table:
        if not b.num_rows:
            return pa.table([pa.array([], f.type) for f in shape], schema=shape)
        lens = b.column("lens").combine_chunks().values.to_numpy()
        last = known.num_rows - 1  # the end has the last number
        at = known.column("i").to_numpy()
        c, of, s = np.empty(last + 1, np.int64), np.empty(last + 1, np.int64), np.empty(last + 1, np.int64)
        c[at], of[at], s[at] = known.column("c").to_numpy(), known.column("cls").to_numpy(), known.column("s").to_numpy()
        base_, emit = np.log10((c + 0.5) / low), np.log10((c + DELTA) / floor[of])
        emit[last] = 0.0
        x = _sequence(_unplane(b.column("ids")[0].as_buffer()), lens, last)
        before = s[np.append(last, x[:-1])]
        starts = np.cumsum(lens + 1) - lens - 1
        out = [lens + 1, np.add.reduceat(c[x] > 0, starts, dtype=np.int64), np.add.reduceat(base_[x], starts), np.add.reduceat(step[before, of[x]] + emit[x], starts)]
        cols = [b.column("ks").combine_chunks().values, b.column("held").combine_chunks().values, *(pa.array(v) for v in out)]
        return pa.table([col.cast(f.type) for col, f in zip(cols, shape)], schema=shape)

    shape = pa.schema([("k", key_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    texts = stored.select("g", "ks", "held", "lens", "ids")
    scored = texts.groupBy("g").cogroup(told.where("g >= 0").groupBy("g")).applyInArrow(score, f"k {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
