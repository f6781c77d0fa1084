"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters that occurs with at most e edits holds, of any e + 1 pieces that it is cut into, one without an
edit.  All pieces are searched at once with an Aho-Corasick automaton.  A hit is verified upwards in a tree over the
pieces: a run of j pieces may have j - 1 edits, and if the whole has no more than it may, so has some run at each level
above some exact piece.  Each check is Myers' bit-parallel edit distance, the last one over the whole item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, give_back, sub_batches

RATE = 0.1


def normal(text: str | None) -> str:
    """Lower case, and one blank for each run of white space."""
    return " ".join((text or "").lower().split())


def edit_match(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of a pattern anywhere in a text, the first of equals; None beyond `most`."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = mask, 0, m, m, 0
    for at, c in enumerate(text, 1):
        x = where.get(c, 0) | minus
        diag = ((plus + (x & plus)) ^ plus) | x
        up, down = minus | (mask & ~(plus | diag)), plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, at
        up = (up << 1) & mask
        minus = up & diag
        plus = ((down << 1) & mask) | (mask & ~(up | diag))
    return (best, end) if best <= most else None


class Item:
    """A benchmark item with its pieces, and for each piece the runs of pieces above it."""

    def __init__(self, key, text: str, rate: float):
        self.key, self.text = key, text
        self.most = int(rate * len(text))
        n = self.most + 1
        self.at = [round(i * len(text) / n) for i in range(n + 1)]
        self.above: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self._runs(0, n)

    def _runs(self, a: int, b: int) -> None:
        if b - a < 2:
            return
        mid = (a + b) // 2
        self._runs(a, mid)
        self._runs(mid, b)
        for i in range(a, b):
            self.above[i].append((a, b))

    def verify(self, text: str, piece: int, start: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the whole item around an exact piece at `start` of a text."""
        found = 0, start + len(self.text)
        for a, b in self.above[piece]:
            most = b - a - 1
            lo = max(0, start - (self.at[piece] - self.at[a]) - most)
            hi = start + (self.at[b] - self.at[piece]) + most
            found = edit_match(self.text[self.at[a] : self.at[b]], text[lo:hi], most)
            if found is None:
                return None
            found = found[0], lo + found[1]
        d, end = found
        if not self.above[piece]:
            return 0, start, end
        lo = max(0, end - len(self.text) - d)
        back = edit_match(self.text[::-1], text[lo:end][::-1], d)
        return d, end - (back[1] if back else len(self.text)), end


def find_items(text: str, items: list[Item], automaton) -> dict[int, tuple[int, int, int]]:
    """Best place (distance, start, end) of each item, by index, that a normal text holds; the first of equals.

    A verified hit has the best place of all that its piece can stand in, so only hits at the same offset are passed over.
    """
    out: dict[int, tuple[int, int, int]] = {}
    seen: set[tuple[int, int]] = set()
    for end, (length, owners) in automaton.iter(text):
        start = end - length + 1
        for i, piece in owners:
            item, old = items[i], out.get(i)
            spot = i, start - item.at[piece]
            if old and (old[0] == 0 or spot in seen):
                continue
            got = item.verify(text, piece, start)
            if got:
                seen.add(spot)
                if old is None or got[:2] < old[:2]:
                    out[i] = got
    return out


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = 4_000_000) -> DataFrame:
    """(key, item_key, distance, start, end) of every item that a row's whole text holds with at most rate * length
    edits; the best place, in characters of the text in lower case with single blanks.

    Null or empty texts and items match nothing; a null key is a key like others; rows of one key are searched each for
    itself, repeated items (or items with a null key) are reported each; an empty table on either side gives no rows; other
    columns are not read.  Items are dealt by hash into blocks of about block_chars characters, each a pass over the texts
    of its own; the driver holds one block at a time, and so do the tasks; nothing is shuffled.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kinds = df.schema[key].dataType, benchmark.schema[item_key].dataType
    schema = T.StructType([T.StructField(key, kinds[0]), T.StructField(item_key, kinds[1]), T.StructField("distance", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    items = benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("t is not null").groupBy("i", "t").agg(F.count("*").alias("n"))
    n_blocks = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    out = None
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).orderBy("i", "t").collect()
        block = [(r["i"], t, r["n"]) for r in rows for t in [normal(r["t"])] if t]
        if block:
            one = docs.mapInArrow(_search(block, rate, schema), schema)
            if n_blocks > 1:
                one = cut(one, "hits")
            out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def _search(block: list, rate: float, schema: T.StructType):
    names, item_type = schema.names, schema.fields[1].dataType

    def run(batches):
        import ahocorasick
        from pyspark.sql.pandas.types import to_arrow_type

        items = [Item(k, t, rate) for k, t, _ in block]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for p in range(len(item.at) - 1):
                pieces.setdefault(item.text[item.at[p] : item.at[p + 1]], []).append((i, p))
        automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            automaton.add_word(piece, (len(piece), owners))
        automaton.make_automaton()
        for b in sub_batches(batches, "t", 1 << 20):
            rows, found = [], []
            for r, t in enumerate(b.column("t").to_pylist()):
                if t:
                    for i, place in sorted(find_items(normal(t), items, automaton).items()):
                        n = block[i][2]
                        rows += [r] * n
                        found += [(items[i].key, *place)] * n
            if rows:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(np.array(rows))), pa.array(cols[0], to_arrow_type(item_type)), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)
        give_back()

    return run
