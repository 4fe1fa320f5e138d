"""Shared parts: vectorised word hashing over UTF-8 bytes, and tables written to the shared folder.

A *word* is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: digits, a-z and everything
outside ASCII.  In UTF-8 that is a test of single bytes, so whole batches are cut into words by numpy.
"""

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Texts are hashed in groups of about so many bytes, whatever the Arrow batch holds.
GROUP_BYTES = 2_000_000
#: Tables are computed with Arrow batches of at most so many rows.
BATCH_ROWS = 2000
#: Tables in the shared folder have row groups of so many bytes: a writer holds one of them in memory.
ROW_GROUP = 32 << 20
#: Packed tables are written by so many tasks, or four for each core if that is more.
TASKS = 24

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_MULT = 0xD6E8FEB86659FD93


def words_of(text: str | None) -> list[str]:
    """The words of one text, lower-cased (A-Z only)."""
    return WORD.findall(text.translate(LOWER)) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element-wise."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


class WordHasher:
    """Hashes the words of a group of texts: a polynomial modulo 2**64 over the lower-cased bytes of a word."""

    def __init__(self):
        table = np.zeros(256, np.uint8)
        table[48:58] = np.arange(48, 58)
        table[97:123] = np.arange(97, 123)
        table[65:91] = np.arange(97, 123)
        table[128:] = np.arange(128, 256)
        self.table = table
        self.inverse = pow(_BASE, -1, 1 << 64)
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        self.up, self.down = powers(_BASE, n), powers(self.inverse, n)

    def piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, starts and ends (byte offsets) of one buffer."""
        low = self.table[np.frombuffer(data, np.uint8)]
        if len(low) + 1 > len(self.up):
            self.grow(len(low) + len(low) // 4 + 2)
        inside = np.zeros(len(low) + 2, np.int8)
        inside[1:-1] = low != 0
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(low * self.up[: len(low)], out=total[1:])
        value = (total[ends] - total[starts]) * self.down[starts]
        return mix(value ^ (ends - starts).astype(np.uint64) << np.uint64(56)), starts, ends

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, in order, and where each text's words begin (len(texts) + 1 entries).

        A text longer than a group is cut at a byte that belongs to no word.
        """
        hashes, counts = [], []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass") if text else b""
            n, at = 0, 0
            while at < len(data):
                to = min(len(data), at + GROUP_BYTES)
                if to < len(data):
                    while to > at and self.table[data[to - 1]]:
                        to -= 1
                    if to == at:  # one word longer than a group
                        to = at + GROUP_BYTES
                        while to < len(data) and self.table[data[to]]:
                            to += 1
                h, _, _ = self.piece(data[at:to])
                hashes.append(h)
                n += len(h)
                at = to
            counts.append(n)
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)

    def group(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As texts(), for a group that is small: one buffer for all of them."""
        data = [(t.encode("utf-8", "surrogatepass") if t else b"") for t in texts]
        if sum(map(len, data)) > 2 * GROUP_BYTES:
            return self.texts(texts)
        at = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
        h, starts, _ = self.piece(b" ".join(data))
        return h, np.searchsorted(starts, at).astype(np.int64)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker waits for its next task beside a JVM that needs the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def pieces(batches, most: int = GROUP_BYTES):
    """Cuts Arrow batches into slices of about ``most`` bytes of text (one row at least), whatever a batch holds."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        batch = None  # before the next one is read
    give_back()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def filtered(docs: DataFrame, each) -> DataFrame:
    """docs.mapInArrow(each) for a function that keeps all columns and reads text, whatever the others are called."""
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(each, plain.schema).toDF(*docs.columns)


def groups(texts: list[str | None], most: int = GROUP_BYTES):
    """Cuts a list into slices of about ``most`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (of the first word of the run on)."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_MULT) + h[j : j + n]
    return mix(out)


def smallest(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = max(len(g) - width + 1, 0)
    out, done = g, 1
    while done < width:  # minima of 2, 4, 8, ... neighbours, then one overlap
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out[:n]


def within(starts: np.ndarray, length: int) -> np.ndarray:
    """Start positions of the runs of ``length`` words that lie in one text."""
    n = int(starts[-1])
    ok = np.ones(max(n - length + 1, 0), bool)
    for back in range(1, length):  # a run that begins 1 .. length-1 words before a text's end leaves it
        at = starts[1:] - back
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    # a text of fewer than length words: positions before its start were cleared above as well, which is right
    return np.flatnonzero(ok)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only for local masters."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = have.get() if have.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def write_table(df: DataFrame, name: str) -> str:
    """Writes ``df`` as Parquet into a new folder of the shared folder; returns its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = conf.get(key)
    conf.set(key, min(int(had) if int(had) > 0 else BATCH_ROWS, BATCH_ROWS))
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        conf.set(key, had)
    return path


def table(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, for every executor.

    packed: by a few tasks for each core, which take the partitions one after the other: fewer files,
    and fewer child processes of the JVM, which show its memory once more while they start.
    """
    if packed:
        df = df.coalesce(max(TASKS, 4 * df.sparkSession.sparkContext.defaultParallelism))
    path = write_table(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loom_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Removes what table() wrote, once no plan reads it any more."""
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(df.loom_path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
