"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1 (drawn from its code point, so nothing is stored).  A trigram is the
element-wise product of its letters' vectors, the first rolled by two places and the second by one; a text is the sum of
its trigrams; a language is the sum of its training texts, each of length one.  A text gets the language whose prototype
has the largest cosine with it; the score is that cosine, cut to 0..1.

Trigrams run over the letters of lower-cased words with one blank on each side (so any non-letter may be a place to cut
a very long text: the sum stays the same).  Memory is bounded by SEGMENT letters, CHUNK distinct trigrams and CELLS counts
at a time.

Training reads about ``per_lang`` different texts of each language, picked by a hash of the text; how many there are is
estimated first (copies of a text count once, and teach once), and a language with fewer texts gives them all.  Prediction
reads the text only.

accept() keeps the rows whose predicted language is allowed (by default every learned one).  A text whose cosine with its
best prototype is within chance (below NOISE / sqrt(dim): unrelated vectors have a cosine of deviation 1 / sqrt(dim)) is in
no learned language and goes as well.

Defined cases: null, empty and letterless texts are ``und`` with score 0.  With no training rows every text is ``und``.
Ties go to the language that sorts first.  Null lang is never learned.  Repeated rows each give a row.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filtered, mix, pieces

DIM = 1024
PER_LANG = 3000
SEGMENT, CHUNK, CELLS = 300_000, 4_000, 2_000_000
UNKNOWN = "und"
NOISE = 1.0


class Encoder:
    """Turns texts into sums of trigram vectors."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.alpha = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
        self.known: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            words = mix(mix(np.arange(self.dim // 64, dtype=np.uint64)) ^ mix(np.array([code], np.uint64) * np.uint64(0x9E6C63D0876A9A47)))
            self.known[code] = np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1
        return self.known[code]

    def codes(self, text: str) -> np.ndarray:
        """Code points of the lower-cased text; 32 for whatever is no letter."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = c < 0x10000
        ok = np.zeros(len(c), bool)
        ok[low] = self.alpha[c[low]]
        if not low.all():
            other, back = np.unique(c[~low], return_inverse=True)
            ok[~low] = np.array([chr(x).isalpha() for x in other])[back]
        return np.where(ok, c, 32)

    def segments(self, texts: list[str | None]):
        """Groups of (text number, code points) of about SEGMENT letters in all."""
        group, size = [], 0
        for i, t in enumerate(texts):
            at = 0
            while t and at < len(t):
                to = min(len(t), at + SEGMENT)
                while to < len(t) and t[to].isalpha():  # cut before a non-letter
                    to += 1
                group.append((i, self.codes(t[at:to])))
                size += to - at
                at = to
                if size >= SEGMENT:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: the sum of its trigram vectors (zeros where there is no letter)."""
        out = np.zeros((len(texts), self.dim), np.float32)
        blank = np.array([32], np.uint32)
        for group in self.segments(texts):
            c = np.concatenate([x for _, own in group for x in (blank, own, blank)])
            row = np.repeat(np.arange(len(group)), [len(own) + 2 for _, own in group])
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])  # runs of blanks become one
            c, row = c[keep], row[keep]
            mid = np.flatnonzero((c[1:-1] != 32)) + 1 if len(c) > 2 else np.zeros(0, np.int64)
            if not len(mid):
                continue
            row = row[mid]
            letters, small = self.compact(c)
            n = len(letters)
            key = (small[mid - 1] * n + small[mid]) * n + small[mid + 1]
            if n**3 <= 4_000_000:
                seen = np.bincount(key, minlength=n**3) > 0
                grams = np.flatnonzero(seen)
                place = np.cumsum(seen) - 1
                key = place[key]
            else:
                grams, key = np.unique(key, return_inverse=True)
            vectors = np.stack([self.letter(int(x)) for x in letters])
            first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
            sums = np.zeros((len(group), self.dim), np.float32)
            step = max(1, min(CHUNK, CELLS // len(group)))
            for a in range(0, len(grams), step):
                g = grams[a : a + step]
                own = (key >= a) & (key < a + step) if len(grams) > step else slice(None)
                counts = np.bincount(row[own] * len(g) + key[own] - a, minlength=len(group) * len(g)).reshape(len(group), len(g))
                sums += counts.astype(np.float32) @ (first[g // (n * n)] * second[g // n % n] * vectors[g % n]).astype(np.float32)
            np.add.at(out, [i for i, _ in group], sums)
        return out

    @staticmethod
    def compact(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes, and each code's place among them."""
        top = int(c.max()) + 1
        seen = np.zeros(top, bool)
        seen[c] = True
        return np.flatnonzero(seen), (np.cumsum(seen) - 1)[c]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (rows of length one), from docs(text, lang)."""
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    total = dict(rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).collect())  # a row for each language
    if not total:
        return [], np.zeros((0, dim), np.float32)
    share = F.create_map(*(x for k, n in total.items() for x in (F.lit(k), F.lit(min(1 << 20, -(-(per_lang << 20) // max(1, int(n * 0.9))))))))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")]).dropDuplicates(["lang", "text"])

    def sums(batches):
        encoder, own = Encoder(dim), {}
        for batch in pieces(batches):
            lang, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            v = encoder.encode(texts).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            for k, x in zip(lang, v, strict=True):
                own[k] = own.get(k, 0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["lang", "v"])

    found: dict[str, np.ndarray] = {}
    for lang, v in sample.mapInArrow(sums, "lang string, v binary").collect():  # a row for each language and task of the sample
        found[lang] = found.get(lang, 0) + np.frombuffer(v, np.float64)
    langs = sorted(k for k, v in found.items() if np.any(v))
    if not langs:
        return [], np.zeros((0, dim), np.float32)
    m = np.stack([found[k] for k in langs])
    return langs, (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def closest(encoder: Encoder, texts: list[str | None], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest prototype of each text (-1 without letters or prototypes) and the cosine, cut to 0..1."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    for a in range(0, len(texts) if len(prototypes) else 0, 1000):
        v = encoder.encode(texts[a : a + 1000])
        norm = np.linalg.norm(v, axis=1)
        some = np.flatnonzero(norm > 0)
        cos = v[some] @ prototypes.T / norm[some, None]
        best[a + some] = cos.argmax(1)
        score[a + some] = np.clip(cos.max(1, initial=-1), 0, 1)
    return best, score


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id) and lang_pred, score; reads text."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes))
    extra = [c for c in keep if c != "text"]
    source = docs.select(*(F.col(f"`{c}`") for c in extra), F.col("text").cast("string").alias("text"))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]

    def each(batches):
        langs, prototypes = shared.value
        encoder = Encoder(prototypes.shape[1])
        for batch in pieces(batches):
            best, score = closest(encoder, batch.column("text").to_pylist(), prototypes)
            pred = [UNKNOWN if i < 0 else langs[i] for i in best.tolist()]
            columns = [batch.column(c) for c in batch.schema.names if c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*(c for c in batch.schema.names if c in keep), "lang_pred", "score"])

    return source.mapInArrow(each, ", ".join([*names, "lang_pred string", "score double"]))


def identify(docs: DataFrame, per_lang: int = PER_LANG, dim: int = DIM) -> DataFrame:
    """Learns from the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    langs, prototypes = train(docs.where(~held_out(F.col("doc_id"))), per_lang, dim)
    return predict(docs, langs, prototypes).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, langs: list[str], prototypes: np.ndarray, allowed: list[str] | None = None, noise: float = NOISE) -> DataFrame:
    """The rows of docs, all columns, whose language is one of ``allowed`` (default: any learned one)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes))

    def each(batches):
        langs, prototypes = shared.value
        encoder = Encoder(prototypes.shape[1])
        open_ = np.array([allowed is None or x in allowed for x in [*langs, UNKNOWN]])  # the last place serves those without a language
        if allowed is None:
            open_[-1] = False
        for batch in pieces(batches):
            best, score = closest(encoder, batch.column("text").to_pylist(), prototypes)
            keep = open_[best] & ((best < 0) | (score >= noise / encoder.dim**0.5))
            yield batch.filter(pa.array(keep))

    return filtered(docs, each)
