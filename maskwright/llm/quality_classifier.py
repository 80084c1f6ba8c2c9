"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every bucket of words has a sparse random index vector. A bucket's word vector is the sum of
the index vectors of the words within REACH places of it, gathered over all documents. A
document's inputs are the mean of its words' vectors, of their index vectors, and of the
products of adjoining index vectors. A network of one hidden layer is trained in numpy on a
bounded sample of labelled documents, and its temperature is set on a part held back of it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, n_partitions, table
from .quality_rules import labelled

#: Buckets of words, width of the vectors, non-zeros of an index vector, words of context on either side.
BUCKETS, WIDTH, NONZERO, REACH = 8192, 64, 2, 2
#: At most so many labelled documents are used to fit the network.
SAMPLE_ROWS = 8192
_CHUNK, _STEP = 128, 1 << 15
_CACHE = 1 << 19
INPUTS = 3 * WIDTH + 1


def _index() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    place = np.stack([rng.permutation(WIDTH)[:NONZERO] for _ in range(BUCKETS)])
    return place, rng.choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, NONZERO))


PLACE, SIGN = _index()
INDEX = np.zeros((BUCKETS, WIDTH), np.float32)
np.put_along_axis(INDEX, PLACE, SIGN, 1)
#: The same with a last bucket that has none.
_PLACE, _SIGN = np.vstack([PLACE, np.zeros((1, NONZERO), int)]), np.vstack([SIGN, np.zeros((1, NONZERO))]).astype(float)
_SHAPE = bytes(
    (ord("X") if 65 <= c < 91 else ord("x") if 97 <= c < 123 or c >= 128 else ord("9") if 48 <= c < 58 else c) for c in range(256)
)


_RUN = re.compile(rb"(?s)(.)\1\1+")


class Buckets(dict):
    """word: bucket of the word * BUCKETS + bucket of its shape (capitals, letters and digits, runs made short)."""

    def __missing__(self, w: bytes) -> int:
        shape = _RUN.sub(rb"\1\1", w.translate(_SHAPE))
        self[w] = out = zlib.crc32(w) % BUCKETS * BUCKETS + zlib.crc32(b"shape " + shape) % BUCKETS
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        """Both buckets of each word, one row per kind."""
        if len(self) > _CACHE:
            self.clear()
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.stack([both // BUCKETS, both % BUCKETS])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word vectors of all buckets, of length one or zero, gathered over all of docs.

    Each task sums its own documents and gives one row per group of buckets; those are summed
    as they stream in, so what is held is BUCKETS * WIDTH numbers however large the input.
    """

    def gather(batches):
        total, buckets, wait, size = np.zeros((BUCKETS + 1) * WIDTH), Buckets(), [], 0
        between = np.full((2, REACH), BUCKETS)  # a bucket without an index vector, so that texts don't meet

        def flush():
            both = np.concatenate(wait, axis=1)
            for kind in both:
                for away in range(1, REACH + 1):
                    for a, c in ((kind[:-away], kind[away:]), (kind[away:], kind[:-away])):
                        for i in range(NONZERO):
                            total[:] += np.bincount(a * WIDTH + _PLACE[c, i], _SIGN[c, i], len(total))
            wait.clear()

        for b in batches:
            for t in b.column("text"):
                words = _words(t.as_py())
                for at in range(0, len(words), _STEP):
                    wait.append(buckets.of(words[at : at + _STEP]))
                    wait.append(between)
                    size += wait[-2].shape[1]
                    if size > 8 * _STEP:
                        flush()
                        size = 0
        if wait:
            flush()
        rows = total[: BUCKETS * WIDTH].reshape(-1, _CHUNK * WIDTH)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[i].astype(np.float32).tobytes() for i in some], pa.binary())], names=["part", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(blob, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float64).tobytes() for v in sums.values()], pa.binary())], names=["part", "sums"])

    parts = map_arrow(docs.select("text"), gather, "part int, sums binary")
    n = min(n_partitions(docs.sparkSession), BUCKETS // _CHUNK)
    out = np.zeros((BUCKETS // _CHUNK, _CHUNK * WIDTH))
    for r in parts.repartition(n, "part").mapInArrow(add, "part int, sums binary").collect():  # BUCKETS * WIDTH numbers in all
        out[r["part"]] += np.frombuffer(bytes(r["sums"]), np.float64)
    out = out.reshape(BUCKETS, WIDTH)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """The inputs of one whole text; all zero for one without words."""
    both, out = buckets.of(_words(text)), np.zeros(INPUTS)
    n = both.shape[1]
    for at in range(0, n, _STEP):
        word, shape = both[:, at : at + _STEP]
        out[:WIDTH] += (vectors[word] + vectors[shape]).sum(axis=0)
        out[WIDTH : 2 * WIDTH] += INDEX[shape].sum(axis=0)
        nxt = both[0, at : at + _STEP + 1]
        out[2 * WIDTH : 3 * WIDTH] += (INDEX[nxt[:-1]] * INDEX[nxt[1:]]).sum(axis=0)
    if n:
        out[:-1] /= n
        out[-1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Standardised inputs, tanh hidden layer, logistic output divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, batch: int = 64) -> Network:
    """Adam over the logistic loss; a fifth is held back for the temperature. Without both classes the score is the same for all."""
    rng = np.random.default_rng(7)
    if not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    order = rng.permutation(len(x))
    cal, own = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z, t = (x[own] - mean) / scale, y[own]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            a = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - t[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - a * a)
            step += 1
            for i, g in enumerate((z[rows].T @ back + decay * p[0], back.sum(axis=0), a.T @ d + decay * p[2], np.array([d.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(cal):
        margin, want = net.margin(x[cal]), y[cal]
        tries = np.geomspace(0.25, 8, 60)
        net.temperature = float(tries[np.argmin([np.logaddexp(0, np.where(want > 0, -1, 1) * margin / s).mean() for s in tries])])
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> Network:
    """A network fitted on at most sample_rows labelled documents, taken by the hash of their id, of those whose crc32 mod 3 is not 1."""
    order, sample = F.xxhash64("doc_id"), labelled(docs, labels, sample_rows, "crc32(cast(doc_id as string)) % 3 <> 1")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        buckets = Buckets()
        for b in batches:
            x = [pooled(t.as_py(), shared.value, buckets).astype(np.float32).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_label"), pa.array(x, pa.binary())], names=["doc_id", "_label", "x"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "_label", "text")
    rows = map_arrow(found, run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, _label int, x binary").orderBy(order, "doc_id", "x").limit(sample_rows).collect()  # bounded by sample_rows
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, INPUTS).astype(float)
    return fit(x, np.array([r["_label"] > 0 for r in rows], float))


def classify(docs: DataFrame, net: Network, vectors: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs.

    Null and empty texts are scored on inputs that are all zero. held_out is false for a null
    id; repeated rows have a row each. Very long texts are read whole, a step at a time; an
    empty table gives no rows. Other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = docs.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"), "text")

    def run(batches):
        buckets = Buckets()
        for b in batches:
            x = np.array([pooled(t.as_py(), shared.value, buckets) for t in b.column("text")]).reshape(-1, INPUTS)
            score = net.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """One row per document; see classify() for null, empty and repeated rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = word_vectors(docs)
    return classify(docs, train(docs, table(spark, sf_dir, "labels"), vectors), vectors)
