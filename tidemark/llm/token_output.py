"""Token-id output: canonical length-limited Huffman codes from global counts, in blocks that decode on their own.

File format, under one path:

* ``kind``: Parquet (key): the type of the keys, as text.
* ``codebook``: Parquet (id, bits): the code length of each id that occurs.  Codes are canonical: ids in order of
  (bits, id) get ascending codes of their length.
* ``shards``: Parquet (shard, n): ids of each shard; shards are in ascending order of the key.
* ``chunks/shard=N``: Parquet, chunks in order of first_token, the ids of the shard before them.  A chunk holds keys and
  n_tokens of its documents, the code bits (first bit highest), and the bit offset of every ``block``-th id, at which
  decoding can start.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoder
from tidemark.llm.common import cut, drop_cut, give_back, sub_batches

BLOCK = 512


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive counts, by package merge; zero counts get 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    is_coin, row = [], np.zeros(0, np.int64)
    for _ in range(limit):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, pairs])
        by = np.argsort(both, kind="stable")
        is_coin.append(by < n)
        row = both[by]
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for level in reversed(is_coin):
        mine = int(level[:take].sum())
        depth[:mine] += 1
        take = 2 * (take - mine)
    out[order] = depth
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """The code of each id, from code lengths alone."""
    codes = np.zeros(len(bits), np.uint32)
    used = np.flatnonzero(bits)
    order = used[np.argsort(bits[used], kind="stable")]
    code = last = 0
    for length in range(1, int(bits.max(initial=0)) + 1):
        code <<= length - last
        last = length
        mine = order[bits[order] == length]
        codes[mine] = code + np.arange(len(mine))
        code += len(mine)
    return codes


def pack(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Code bits of ids, and the bit offset at which each block starts."""
    length = bits[ids]
    ends = np.cumsum(length, dtype=np.int64)
    at = ends - length
    size = (int(ends[-1]) + 7) // 8 if len(ids) else 0
    spot, shift = at >> 3, 32 - length - (at & 7).astype(np.uint8)
    word = codes[ids] << shift
    out = np.zeros(size + 4)
    for k in range((int(bits.max(initial=0)) + 14) // 8):  # as many bytes as the longest code can touch
        part = (word >> np.uint32(24 - 8 * k)).astype(np.uint8)
        out[k:] += np.bincount(spot, part, size + 4)[: size + 4 - k]
    return out[:size].astype(np.uint8).tobytes(), at[::block].astype(np.uint64)


def decode_table(bits: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every word of as many bits as the longest code: the id that it starts with, and that id's length."""
    width = max(1, int(bits.max(initial=1)))
    used = np.flatnonzero(bits)
    order = used[np.argsort(codes[used].astype(np.int64) << (width - bits[used].astype(np.int64)), kind="stable")]
    run = 1 << (width - bits[order].astype(np.int64))
    ids = np.zeros(1 << width, np.uint32)
    lens = np.ones(1 << width, np.uint8)
    ids[: run.sum()] = np.repeat(order, run)
    lens[: run.sum()] = np.repeat(bits[order], run)
    return ids, lens, width


def unpack(data: bytes, starts: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int], block: int = BLOCK) -> np.ndarray:
    """The n ids of a chunk: all blocks move on by one id at a time."""
    ids, lens, width = table
    if not n:
        return np.zeros(0, np.uint32)
    a = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(5, np.uint8)]).astype(np.uint32)
    word = (a[:-3] << 24) | (a[1:-2] << 16) | (a[2:-1] << 8) | a[3:]
    out = np.empty((min(block, n), len(starts)), np.uint32)
    pos, mask, last = starts.astype(np.int64), (1 << width) - 1, len(word) - 1
    for k in range(len(out)):
        look = (word[np.minimum(pos >> 3, last)] >> (32 - width - (pos & 7)).astype(np.uint32)) & mask
        out[k] = ids[look]
        pos += lens[look]
    return out.T.reshape(-1)[:n] if len(starts) > 1 else out[:n, 0]


def _chunk(kind: str) -> str:
    return f"first_token bigint, n_tokens bigint, block int, keys array<{kind}>, counts array<bigint>, starts array<bigint>, code binary"


def write_tokens(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2, limit: int = 16, block: int = BLOCK, chunk_tokens: int = 1 << 19) -> None:
    """Encode every whole text and write its ids in the format above, in ascending order of the key.

    A null text counts as empty (its end id is written), a null key comes first, rows of one key stand in order of their
    texts' hash and repeated rows are all written.  Other columns are not read.  The longest code has `limit` bits, or as
    many as the vocabulary needs, 25 at most.  One shuffle orders the texts by ranges of the key; the ids are then
    written to the shared folder, counted by id (a sum with a row for each id of the vocabulary reaches the driver, and one
    for each shard a reader), and coded chunk by chunk.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(F.col("k").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("h"), F.col("t")).select("k", "t")
    key_type = rows.limit(0).toArrow().schema.field("k").type

    def encode(batches):
        enc = encoder(tokenizer)
        wide = np.uint16 if enc.vocab_size <= 1 << 16 else np.uint32
        shard, first = TaskContext.get().partitionId(), 0
        keys, counts, parts, size = [], [], [], 0

        def chunk():
            n = np.concatenate(counts)
            cols = [pa.array([shard], pa.int32()), pa.array([first]), pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(key_type)), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([int(n.sum())]), pa.array([np.concatenate(parts).tobytes()])]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "first", "keys", "counts", "n", "ids"])

        for b in sub_batches(batches, "t", 1 << 21):
            ids, n = enc.encode(b.column("t").to_pylist())
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
            keys.append(b.column("k"))
            counts.append(n)
            parts.append(ids.astype(wide))
            size += len(ids)
            if size >= chunk_tokens:
                yield chunk()
                keys, counts, parts, size, first = [], [], [], 0, first + size
        if keys:
            yield chunk()
        give_back()

    stored = cut(rows.mapInArrow(encode, f"shard int, first bigint, keys array<{kind.simpleString()}>, counts array<bigint>, n bigint, ids binary"), "ids")
    del rows
    enc = encoder(tokenizer)
    width, wide = enc.vocab_size, np.uint16 if enc.vocab_size <= 1 << 16 else np.uint32
    if end_id is not None:
        width = max(width, end_id + 1)

    def count(batches):
        total = np.zeros(width, np.int64)
        for b in batches:
            for x in b.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), wide), minlength=width)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    totals = np.zeros(width, np.int64)
    for r in stored.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        totals[r["id"]] = r["n"]
    limit = max(limit, int(np.ceil(np.log2(max(2, np.count_nonzero(totals))))))
    bits = code_lengths(totals, limit)
    codes = canonical_codes(bits)
    stored.groupBy("shard").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{path}/shards")
    used = np.flatnonzero(bits)
    spark.createDataFrame(pa.table({"id": pa.array(used), "bits": pa.array(bits[used].astype(np.int32))})).coalesce(1).write.parquet(f"{path}/codebook")

    spark.createDataFrame([(kind.simpleString(),)], "key string").coalesce(1).write.parquet(f"{path}/kind")

    def code(batches):
        for b in sub_batches(batches, "ids", 1):
            data, starts = pack(np.frombuffer(b.column("ids")[0].as_buffer(), wide), bits, codes, block)
            cols = [b.column("shard"), b.column("first"), b.column("n"), pa.array([block], pa.int32()), b.column("keys"), b.column("counts"), pa.array([starts.astype(np.int64).tolist()], pa.list_(pa.int64())), pa.array([data])]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "first_token", "n_tokens", "block", "keys", "counts", "starts", "code"])

    coded = stored.mapInArrow(code, f"shard int, {_chunk(kind.simpleString())}")
    coded.sortWithinPartitions("shard", "first_token").write.partitionBy("shard").parquet(f"{path}/chunks")
    drop_cut(stored)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """Documents from the format above: key, start (ids of all documents before it), n_tokens, and their ids as
    little-endian unsigned 32-bit integers in a binary column, or with digest only the ids' ids_crc32."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()
    ids, lengths = book.column("id").to_numpy(), book.column("bits").to_numpy()
    bits = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint8)
    bits[ids] = lengths
    kind = spark.read.parquet(f"{path}/kind").first()["key"]
    chunks = spark.read.schema(f"{_chunk(kind)}, shard int").parquet(f"{path}/chunks")
    before, so_far = {}, 0
    for r in spark.read.parquet(f"{path}/shards").orderBy("shard").collect():  # a row for each task that wrote
        before[r["shard"]] = so_far
        so_far += r["n"]
    last = "ids_crc32" if digest else "ids"

    def decode(batches):
        table = decode_table(bits, canonical_codes(bits))
        for b in sub_batches(batches, "code", 1):
            n = b.column("counts")[0].values.to_numpy()
            starts = b.column("starts")[0].values.to_numpy()
            ids = unpack(b.column("code")[0].as_buffer(), starts, b.column("n_tokens")[0].as_py(), table, b.column("block")[0].as_py()).astype("<u4", copy=False)
            ends = np.cumsum(n)
            data = memoryview(np.ascontiguousarray(ids)).cast("B")
            each = [data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), n.tolist())]
            out = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array([bytes(x) for x in each], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("keys")[0].values, pa.array(before[b.column("shard")[0].as_py()] + b.column("first_token")[0].as_py() + ends - n), pa.array(n), out], names=[key, "start", "n_tokens", last])

    return chunks.mapInArrow(decode, f"`{key}` {kind}, start bigint, n_tokens bigint, {last} {'bigint' if digest else 'binary'}")
