"""Training-order materialisation: token ids as fixed-stride binary shards, in a keyed order.

Every text becomes token ids and an end mark, cut into sequences of ``seq_len`` ids (the last one is filled up).  Byte-level
ids are never more than the bytes, so the lengths of the texts bound the sequences of each input partition; that gives
every sequence an index of its own before anything is tokenised.  A Feistel network over the next even power of two, walked
until it falls into range, permutes the indices; the order of the results is the training order, and a sequence's global
slot is its rank in it.  Shards are equal ranges of the permuted indices, each sorted; they hold nearly equal numbers of
records, and their lengths (number of records = bytes / stride) tell where each one's slots begin: a reader that has seen s
sequences finds its shard among these sums and goes on at ``(s - first slot) * stride`` (see position()).

Record (little endian): seq_len ids of 16 bits, doc_id (64 bits), number of the sequence in its document (32 bits),
ids in use (32 bits).  The last byte of that count is always 0.  Shards are written by Spark's text writer with the byte
0 as line end, which supplies just that byte; so shards are committed like any other Spark output (a lost executor or a
second attempt leaves nothing half written) and may lie in any store that Spark writes to.

Scale: texts are tokenised once; one shuffle, of the records, by shard; each shard is sorted by its own task.  Lengths and
texts are read in two passes over the same file splits, so ``docs`` must be a plain scan of files (else pass it through a
table first); the second pass fails if it finds more than the first one allows.

Defined cases: null texts have no sequence; empty ones have one, with the end mark only.  A null doc_id is stored as
-2**63.  Repeated rows are written as often as they occur.  An empty table gives no record.
"""

import base64
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQ_LEN, END = 256, 50256
KEY = 0x5DEECE66D
ROUNDS = 6
NO_ID = -(2**63)


class Tokenizer:
    """Byte-level BPE to ids below 2**16."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, two bytes each."""
        return np.array(self.encoding.encode_ordinary(text), "<u2")

    @staticmethod
    def shared(vocabulary: bytes) -> "Tokenizer":
        """One for each Python worker, for all its tasks (kept in a module that outlives them)."""
        import tiktoken

        kept = tiktoken.__dict__.setdefault("_corpusloom", {})
        key = (len(vocabulary), hash(vocabulary))
        if key not in kept:
            kept[key] = Tokenizer(vocabulary)
        return kept[key]


def feistel(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1, applied to each index."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + mix(np.array([key & (2**64 - 1)], np.uint64)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):  # cycle-walking: fewer than four steps on average
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def stride(seq_len: int) -> int:
    return 2 * seq_len + 16


def range_per_shard(n: int) -> int:
    """Permuted indices in one shard: up to 1024 shards, then larger ones up to 2**18 (about half of that in records)."""
    return min(1 << 18, max(1 << 15, 1 << (-(-n // 1024) - 1).bit_length() if n > 1024 else 1))


def records(ids: list[np.ndarray], doc_ids: list[int], seq_len: int, end: int) -> np.ndarray:
    """The records of some documents, a row of bytes each."""
    size = np.array([len(x) for x in ids], np.int64)
    n = -(-(size + 1) // seq_len)
    first = np.cumsum(n) - n
    full = np.full(int(n.sum()) * seq_len, end, "<u2")
    if size.sum():
        full[np.repeat(first * seq_len - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.concatenate(ids)
    out = np.empty((int(n.sum()), stride(seq_len)), np.uint8)
    out[:, : 2 * seq_len] = full.view(np.uint8).reshape(-1, 2 * seq_len)
    out[:, 2 * seq_len : -8] = np.repeat(np.array(doc_ids, "<i8"), n).view(np.uint8).reshape(-1, 8)
    number = np.arange(len(out)) - np.repeat(first, n)
    used = np.minimum(np.repeat(size + 1, n) - number * seq_len, seq_len)
    out[:, -8:-4] = number.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[:, -4:] = used.astype("<u4").view(np.uint8).reshape(-1, 4)
    return out


def write_shards(docs: DataFrame, path: str, vocabulary: bytes, seq_len: int = SEQ_LEN, end: int = END, key: int = KEY, width: int | None = None) -> None:
    """Writes the shards of docs(doc_id, text) below ``path``; ``width``: permuted indices per shard."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    most = F.ceil((F.octet_length("text") + 1) / seq_len)
    # a row for each split of the input
    parts = dict(rows.select(F.spark_partition_id().alias("part"), most.alias("n")).groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0))).collect())
    total = sum(parts.values())
    width = width or range_per_shard(total)
    at, first = 0, {}
    for p in sorted(parts):
        first[p] = at
        at += parts[p]
    firsts = spark.sparkContext.broadcast((first, parts))

    def emit(batches):
        from pyspark import TaskContext

        first, parts = firsts.value
        p = TaskContext.get().partitionId()
        own, index = Tokenizer.shared(shared.value), first.get(p, 0)
        last = index + parts.get(p, 0)
        size = stride(seq_len)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            held, who, room = [], [], 0
            for i, t in enumerate(texts):
                if t is not None:
                    held.append(own.encode(t))
                    who.append(NO_ID if ids[i] is None else ids[i])
                    room += len(held[-1])
                if held and (i + 1 == len(texts) or room > 2_000_000):
                    block = records(held, who, seq_len, end)
                    held, who, room = [], [], 0
                    if index + len(block) > last:
                        raise ValueError("the input changed between two reads: give write_shards a plain scan of files")
                    place = feistel(np.arange(index, index + len(block)), total, key)
                    index += len(block)
                    body = np.ascontiguousarray(block[:, :-1])  # the last byte is the writer's
                    offsets = np.arange(len(body) + 1, dtype=np.int32) * (size - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.BinaryArray.from_buffers(pa.binary(), len(body), [None, pa.py_buffer(offsets), pa.py_buffer(body)])], ["place", "body"])

    shards = max(1, -(-total // width))
    out = rows.mapInArrow(emit, "place bigint, body binary").withColumn("shard", F.expr(f"cast(place div {width} as int)"))
    out = out.repartitionById(shards, "shard").sortWithinPartitions("place")
    out.select(F.col("body").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(path)


def shard_index(spark: SparkSession, path: str, seq_len: int = SEQ_LEN) -> list[tuple[int, str, int, int]]:
    """(shard, file, first slot, records) of every shard, in order: a row for each file."""
    files = spark.read.format("binaryFile").load(f"{path}/part-*").where("length > 0").select("path", "length").collect()
    out, slot = [], 0
    for shard, name, n in sorted((int(re.search(r"part-(\d+)", f.path.rsplit("/", 1)[1])[1]), f.path, f.length // stride(seq_len)) for f in files):
        out.append((shard, name, slot, n))
        slot += n
    return out


def position(index: list[tuple[int, str, int, int]], slot: int, seq_len: int = SEQ_LEN) -> tuple[str, int]:
    """File and byte at which the record of a slot begins."""
    _, name, first, _ = index[bisect_right([x[2] for x in index], slot) - 1]
    return name, (slot - first) * stride(seq_len)


def read_shards(spark: SparkSession, path: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """slot, shard, doc_id, seq_no, n_tokens, tokens (binary, the ids in use, two bytes each) of every record."""
    firsts = spark.sparkContext.broadcast({shard: first for shard, _, first, _ in shard_index(spark, path, seq_len)})
    files = spark.read.format("binaryFile").load(f"{path}/part-*").where("length > 0").select("path", "content")

    def each(batches):
        size = stride(seq_len)
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                shard = int(re.search(r"part-(\d+)", name.as_py().rsplit("/", 1)[1])[1])
                data = np.frombuffer(content.as_buffer(), np.uint8)
                rows = data.reshape(-1, size)
                for a in range(0, len(rows), 8192):
                    own = rows[a : a + 8192]
                    used = own[:, -4:].copy().view("<u4")[:, 0].astype(np.int64)
                    flat = np.ascontiguousarray(own[:, : 2 * seq_len])
                    inside = np.arange(2 * seq_len)[None, :] < 2 * used[:, None]
                    offsets = np.concatenate([[0], np.cumsum(2 * used)]).astype(np.int32)
                    tokens = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])])
                    ids = own[:, 2 * seq_len : 2 * seq_len + 8].copy().view("<i8")[:, 0]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.arange(a, a + len(own)) + firsts.value[shard]), pa.array(np.full(len(own), shard, np.int32)),
                        pa.array(ids, mask=ids == NO_ID), pa.array(own[:, -8:-4].copy().view("<u4")[:, 0].astype(np.int64)), pa.array(used), tokens,
                    ], ["slot", "shard", "doc_id", "seq_no", "n_tokens", "tokens"])

    return files.mapInArrow(each, "slot bigint, shard int, doc_id bigint, seq_no bigint, n_tokens bigint, tokens binary")


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, read by the driver (about 1 MB; it travels to the executors as a broadcast)."""
    with open(path, "rb") as f:
        return f.read()


def materialise(docs: DataFrame, path: str, vocabulary_path: str = VOCABULARY, seq_len: int = SEQ_LEN, key: int = KEY, width: int | None = None) -> DataFrame:
    """Writes the shards and gives one row per record as read back: slot, shard, doc_id, seq_no, n_tokens, tokens_sha256."""
    write_shards(docs, path, vocabulary(vocabulary_path), seq_len, END, key, width)
    return read_shards(docs.sparkSession, path, seq_len).select("slot", "shard", "doc_id", "seq_no", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"))
