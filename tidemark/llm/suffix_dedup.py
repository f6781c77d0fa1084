"""Removal of long byte strings that occur elsewhere, from the suffix order of shards in which they would meet.

Two lengths are asked for at once: strings of `length` bytes are removed, and how much strings of `passage` bytes cover is
told.  For either, every window of that many bytes belongs to its smallest rolling gram (the anchor, the first of equals);
windows of one anchor are taken together by their distance to it, in units of at most STEP.  All windows of a unit share a
core, all but STEP - 1 of a window's bytes, so equal windows lie in units of equal cores, and units whose core occurs once
need no more work.  The others meet by core: units that agree as a whole repeat as a whole, and one of each kind goes to a
shard whose suffixes are ordered by induced sorting.  There a core stands as its name, three symbols of their own, so that
a context is some hundred symbols; a window repeats if its common prefix with a neighbour is as long as a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_cut, give_back, sub_batches
from tidemark.llm.induced import suffix_order

GRAM, STEP, PIECE = 64, 64, 1 << 21
NAME, FIRST, DIGITS = 3, 258, 254  # symbols of a core's name, the first of them, and how many there are
#: Fifty words of European languages are seldom shorter (263 bytes at the fifth percentile of English ones here).
PASSAGE = 250


def _anchors(a: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each window of each length (rising) of a: the position of its anchor."""
    h = (a.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    size, base = 1, 0xD6E8FEB86659FD93
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(base) + h[size:]
        base = base * base % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low, width, out = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64), 1, []
    for length in lengths:
        span, n = length - GRAM + 1, max(0, len(a) - length + 1)
        while 2 * width <= span:
            low = np.minimum(low[: max(0, len(low) - width)], low[width:])
            width *= 2
        out.append((np.minimum(low[:n], low[span - width : span - width + n]) & np.uint64(0xFFFFFF)).astype(np.int64))
    return out


def units(texts: list[bytes], lengths: tuple[int, ...], step: int = STEP):
    """Arrays (text, start, windows, left, length, core, whole) of the units of all texts, for each of the lengths (rising):
    start of the first window, number of windows, bytes before the core, and hashes of the core and of all bytes."""
    from xxhash import xxh3_64_intdigest

    out, most = [[] for _ in range(7)], lengths[-1]
    pieces = []  # (text, offset, bytes of the text from there on, bytes)
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - lengths[0] + 1), 4 * PIECE):
            pieces.append((i, at, len(t) - at, t[at : at + 4 * PIECE + most - 1]))
    groups, size = [[]], 0
    for p in pieces:
        if size + len(p[3]) > PIECE and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(p)
        size += len(p[3])
    for group in groups:
        data = b"".join(p[3] for p in group)
        lens = np.array([len(p[3]) for p in group], np.int64)
        first, owner_of = np.cumsum(lens) - lens, np.repeat(np.arange(len(group)), lens)
        texts_, offsets, rest = (np.array([p[k] for p in group], np.int64) for k in range(3))
        for length, anchor in zip(lengths, _anchors(np.frombuffer(data, np.uint8), lengths)):
            if not len(anchor):
                continue
            owner, pos = owner_of[: len(anchor)], np.arange(len(anchor))
            inside = pos - first[owner] < np.minimum(4 * PIECE, rest - length + 1)[owner]
            unit = (anchor - pos) // step
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (unit[1:] != unit[:-1]) | (owner[1:] != owner[:-1])
            new[1:] |= inside[1:] != inside[:-1]
            at = np.flatnonzero(new & inside)
            ends = np.append(np.flatnonzero(new), len(anchor))
            n = ends[np.searchsorted(ends, at, "right")] - at
            a, u, of = anchor[at], unit[at], owner[at]
            lo = a - step * u
            out[0].append(texts_[of])
            out[1].append(offsets[of] + at - first[of])
            out[2].append(n)
            out[3].append(lo - at)
            out[4].append(np.full(len(at), length))
            for col, x, y, seed in ((5, lo, lo + length - step + 1, u), (6, at, at + n - 1 + length, a - at)):
                parts = map(data.__getitem__, map(slice, x.tolist(), y.tolist()))
                out[col].append(np.fromiter(map(xxh3_64_intdigest, parts, (seed * 4096 + length).tolist()), np.uint64, len(at)))
    return [np.concatenate([np.zeros(0, np.uint64 if k > 4 else np.int64), *x]) for k, x in enumerate(out)]


def repeated_windows(contexts: list[tuple[bytes, int, int, int]], budget: int, step: int = STEP) -> list[np.ndarray]:
    """Of each context (its bytes without the core, windows, bytes before the core, number of the core), which windows
    stand in another context too, by the common suffix order.

    A window is step - 1 bytes and the core's name.  What follows a context's last window is shorter than that, so no
    other suffix has a common prefix of that length.
    """
    lens, n, left, core = (np.array(x, np.int64) for x in zip(*((len(c), n, left, core) for c, n, left, core in contexts)))
    if core.max() >= DIGITS**NAME:
        raise ValueError("too many cores in a shard")
    size = lens + NAME + 1
    starts = np.cumsum(size) - size
    t = np.zeros(int(size.sum()) + 1, np.int64)
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    t[np.repeat(starts, lens) + inner + NAME * (inner >= np.repeat(left, lens))] = np.frombuffer(b"".join(c[0] for c in contexts), np.uint8).astype(np.int64) + 2
    for k in range(NAME):
        t[starts + left + k] = FIRST + core // DIGITS**k % DIGITS
    t[starts + size - 1] = 1
    order, lcp = suffix_order(t, step - 1 + NAME, budget)
    hit = np.zeros(len(t), bool)
    same = np.flatnonzero(lcp >= step - 1 + NAME)
    hit[order[same]] = hit[order[same - 1]] = True
    return [hit[at : at + m] for at, m in zip(starts.tolist(), n.tolist())]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, h): key, text and a hash of both, by which a row is found again."""
    return df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("k", "t"))


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, passage: int = PASSAGE, shard_bytes: int = 2 << 20, budget: int = 16 << 20) -> DataFrame:
    """(h, spans): for each xxhash64 of key and text with repeated strings, spans (s, e, long) in bytes that strings of
    `passage` bytes cover which start anywhere else too, and (long) those of strings of `length` bytes; they may overlap.

    A task orders shards of about shard_bytes symbols, one core's units at least, and holds queues beyond a quarter of the
    budget in scratch files.
    """
    lengths = tuple(sorted({min(passage, length), length}))
    rows = _rows(df, key, text).select("h", "t").where(F.octet_length("t") >= lengths[0])

    def find(batches):
        for b in sub_batches(batches, "t", PIECE):
            i, start, n, left, size, core, whole = units(_bytes(b.column("t")), lengths)
            take = pa.array(i)
            cols = [b.column("h").take(take), pa.array(start), pa.array(n.astype(np.int16)), pa.array(left.astype(np.int16)), pa.array(size == length), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "start", "n", "left", "long", "core", "whole"])
        give_back()

    found = cut(rows.mapInArrow(find, "h bigint, start bigint, n smallint, left smallint, long boolean, core bigint, whole bigint"), "units")
    often = cut(found.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"), "cores")
    kept = cut(found.join(often, "core"), "units")
    drop_cut(often)
    drop_cut(found)
    kinds = cut(kept.groupBy("core", "whole").agg(F.count("*").alias("c"), F.min(F.struct("h", "start", "n", "left", "long")).alias("rep")), "kinds")
    sizes = kinds.groupBy("core").agg(F.count("*").alias("m"), F.min("c").alias("least"))
    some = cut(sizes.where("m > 1 and least = 1").select("core"), "some")  # so that Spark can split the join's large partitions
    reps = kinds.join(some, "core").select("core", "whole", "rep.*")
    asked = reps.groupBy("h").agg(F.collect_list(F.struct("start", "n", "left", "long", "core", "whole")).alias("units"))
    joined = rows.join(asked, "h").select("t", "units")

    def contexts(batches):
        for b in sub_batches(batches, "t", PIECE):
            texts, us = _bytes(b.column("t")), pc.list_flatten(b.column("units"))
            if not len(us):
                continue
            of, (start, n, left, long) = pc.list_parent_indices(b.column("units")), (us.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n", "left", "long"))
            size = np.where(long, lengths[-1], lengths[0])
            at = zip(of.to_pylist(), start.tolist(), (start + left).tolist(), (start + left + size - STEP + 1).tolist(), (start + n - 1 + size).tolist())
            ctx = [texts[i][s:x] + texts[i][y:e] for i, s, x, y, e in at]
            yield pa.RecordBatch.from_arrays([*(us.field(f) for f in ("core", "whole", "n", "left")), pa.array(ctx, pa.binary())], names=["core", "whole", "n", "left", "ctx"])

    got = joined.mapInArrow(contexts, "core bigint, whole bigint, n smallint, left smallint, ctx binary")

    def order(batches):
        held, size, last = [], 0, None

        def settle():
            seen: dict[tuple[int, int], tuple] = {}
            names: dict[int, int] = {}
            for c, w, n, left, x in held:  # the same text under one key may have come more than once
                seen.setdefault((c, w), (x, n, left, names.setdefault(c, len(names))))
            out = [[], [], [], []]
            if len(seen) > 1:
                for (c, w), hit in zip(seen, repeated_windows(list(seen.values()), budget)):
                    for a, b in _runs(hit):
                        for col, v in zip(out, (c, w, a, b)):
                            col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["core", "whole", "a", "b"])

        for b in batches:
            for c, w, n, left, x in zip(*(b.column(f).to_pylist() for f in ("core", "whole", "n", "left", "ctx"))):
                if c != last and size > shard_bytes:
                    yield settle()
                    held, size = [], 0
                last = c
                held.append((c, w, n, left, x))
                size += len(x)
        if held:
            yield settle()
        give_back()

    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as the work is more than the bytes show
    partial = got.repartition(spread, "core").sortWithinPartitions("core").mapInArrow(order, "core bigint, whole bigint, a int, b int")
    twice = kinds.where("c > 1").select("core", "whole", F.lit(0).alias("a"), F.col("rep.n").cast("int").alias("b"))
    hits = cut(partial.join(twice.select("core", "whole"), ["core", "whole"], "left_anti").unionByName(twice), "hits")
    end = F.col("start") + F.col("b") - 1 + F.when(F.col("long"), lengths[-1]).otherwise(lengths[0])
    spans = kept.join(hits, ["core", "whole"]).select("h", (F.col("start") + F.col("a")).alias("s"), end.alias("e"), "long")
    return spans.groupBy("h").agg(F.collect_list(F.struct("s", "e", "long")).alias("spans"))


def merged(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, s, e) joined where those of one row overlap or touch, in order of rows and starts."""
    if not len(row):
        return row, s, e
    apart = int(e.max()) + 2  # the rows stand in one line, without touching
    order = np.argsort(row * apart + s, kind="stable")
    row, s, e = row[order], s[order], np.maximum.accumulate((row * apart + e)[order])
    first = np.flatnonzero(np.concatenate([[True], (row * apart + s)[1:] > e[:-1]]))
    return row[first], s[first], e[np.append(first[1:], len(e)) - 1] - row[first] * apart


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, passage: int = PASSAGE, digest: bool = False, **how) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, n_repeated) for every row: the bytes left of its text without those that a
    repeated string of `length` bytes covers; with digest kept_sha256 instead.  n_repeated are the bytes that repeated
    strings of `passage` bytes cover, removed or not.

    Texts are UTF-8 bytes, a null text is empty; texts shorter than `length` lose nothing.  Repeated rows count as
    occurrences of their text elsewhere and all lose it.  A null key is a key like others; other columns are not read; an
    empty table gives an empty one.
    """
    joined = _rows(df, key, text).join(repeated_spans(df, key, text, length, passage, **how), "h", "left").select("k", "t", "spans")
    kind = df.schema[key].dataType.simpleString()
    last = "kept_sha256" if digest else "kept"

    def strip(batches):
        for b in sub_batches(batches, "t"):
            texts, spans = _bytes(b.column("t")), pc.list_flatten(b.column("spans"))
            row, start, end, long = (x.to_numpy(zero_copy_only=False) for x in (pc.list_parent_indices(b.column("spans")), *(spans.field(f) for f in ("s", "e", "long"))))
            row, long = row.astype(np.int64), long.astype(bool)
            told, cuts = merged(row, start, end), merged(row[long], start[long], end[long])
            covered, gone = (np.bincount(i, y - x, len(texts)).astype(np.int64) for i, x, y in (told, cuts))
            kept, at = list(texts), np.searchsorted(cuts[0], np.arange(len(texts) + 1))
            for i in np.unique(cuts[0]).tolist():
                own = slice(at[i], at[i + 1])
                kept[i] = b"".join(map(texts[i].__getitem__, map(slice, [0, *cuts[2][own].tolist()], [*cuts[1][own].tolist(), len(texts[i])])))
            if digest:
                kept = [hashlib.sha256(t).hexdigest() for t in kept]
            cols = [list(map(len, texts)), gone, np.diff(at), kept, covered]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[key, "n_bytes", "n_removed", "n_spans", last, "n_repeated"])
        give_back()

    return joined.mapInArrow(strip, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'string' if digest else 'binary'}, n_repeated bigint")
