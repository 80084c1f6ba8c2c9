"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted in numpy on a bounded sample of labelled documents, flattened into
node arrays and scored a batch at a time. Chosen features are monotonic: a document with
more symbols, more repeated lines or more repeated words never scores higher for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "bang_per_word", "digit_share", "pipe_per_word", "longest_run_share", "words_per_line")
#: Sign by which a score may move as the feature grows.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "bang_per_word": -1, "distinct_share": 1, "longest_run_share": -1}
#: At most so many labelled documents are used to fit the trees.
SAMPLE_ROWS = 8192

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTERS = _LEAD & ~_BLANK


def document_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text; null and empty texts have no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0D, no others
    n = len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars, symbols = int(seen[_LETTERS].sum()), int(seen[_SYMBOL].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat = longest = 0
    if n >= 3:
        pairs = code[:-1] * len(ids) + code[1:]
        if len(ids) > 1_000_000:  # so that three codes stay within 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(ids) + code[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice[2:] |= twice[1:-1] | twice[:-2]
        twice[1] |= twice[0]
        repeat = int(twice.sum())
    if n:
        cuts = np.flatnonzero(np.diff(code)) + 1
        longest = int(np.diff(np.concatenate(([0], cuts, [n]))).max())
    m = max(n, 1)
    letters = max(chars, 1)
    features = [
        np.log1p(n), chars / m, symbols / m, dup_lines / max(len(lines), 1), repeat / m, len(ids) / m,
        int(seen[65:91].sum()) / letters, int(seen[33]) / m, int(seen[48:58].sum()) / letters, int(seen[124]) / m, longest / m, n / max(len(lines), 1),
    ]
    return [n, chars, symbols, dup_lines, repeat], features


@dataclass
class Trees:
    """Flat node arrays of all trees; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, *, n_trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 5) -> Trees:
    """Newton boosting of the logistic loss over quantile bins.

    A split on a monotonic feature must order its sides' values, and their midpoint bounds
    the values of everything below, so each tree, hence their sum, is monotonic. With one
    class only, or no rows, there are no splits and the score is constant.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    p0 = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5 + 1e-9
    bias = float(np.log(p0 / (1 - p0)))
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    margin = np.full(len(y), bias)
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        k = len(out["value"])
        gs, hs = g[rows].sum(), h[rows].sum()
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", rate * leaf(gs, hs, low, high))):
            out[name].append(v)
        if level == depth or len(rows) < 2 * min_rows:
            return k
        best = (1e-6, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gl, hl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows]))
            nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = -(gl * vl + 0.5 * (hl + l2) * vl**2 + gr * vr + 0.5 * (hr + l2) * vr**2)
            v = np.clip(-gs / (hs + l2), low, high)
            gain += gs * v + 0.5 * (hs + l2) * v**2
            gain[(nl < min_rows) | (nr < min_rows) | (monotone[f] * (vr - vl) < 0)] = -np.inf
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (f, i, vl[i], vr[i]))
        if best[1]:
            f, i, vl, vr = best[1]
            mid, left = (vl + vr) / 2, binned[rows, f] <= i
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[f])]
            out["feature"][k], out["threshold"][k] = f, float(edges[f][i])
            out["left"][k] = node(rows[left], g, h, level + 1, *bounds[0])
            out["right"][k] = node(rows[~left], g, h, level + 1, *bounds[1])
        return k

    for _ in range(n_trees if 0 < y.sum() < len(y) else 1):
        p = 1 / (1 + np.exp(-margin))
        roots.append(node(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        flat = {k: np.asarray(v) for k, v in out.items()}
        at = np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), flat["feature"][at]] <= flat["threshold"][at], flat["left"][at], flat["right"][at])
        margin = margin + flat["value"][at]
    return Trees(**{k: np.asarray(v, dtype=np.int64 if k in ("feature", "left", "right") else float) for k, v in out.items()}, roots=np.asarray(roots), depth=depth, bias=bias)


def stats_of(docs: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carry, the base counts and the features, one row per row of docs."""
    kept = docs.select(key, *carry, "text")
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in (key, *carry)), *(f"{c} long" for c in BASE), *(f"{c} double" for c in FEATURES)])

    def run(batches):
        for b in batches:
            found = [document_stats(t.as_py()) for t in b.column("text")]
            base = np.array([x[0] for x in found], np.int64).reshape(-1, len(BASE))
            feats = np.array([x[1] for x in found], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, *carry)), *(pa.array(c) for c in base.T), *(pa.array(c) for c in feats.T)], names=[key, *carry, *BASE, *FEATURES])

    return map_arrow(kept, run, schema)


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int, usable: str = "true") -> DataFrame:
    """doc_id and _label of at most sample_rows labelled documents that docs holds, taken by the hash of their id.

    Labels with a null id or quality are passed over; of several of a document the smallest counts.
    """
    known = labels.where(f"doc_id is not null and quality is not null and {usable}").groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
    return docs.select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most sample_rows labelled documents, taken by the hash of their id.

    The sample, bounded by sample_rows, is all that is broadcast or collected.
    """
    order, sample = F.xxhash64("doc_id"), labelled(docs, labels, sample_rows)
    rows = stats_of(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "doc_id", ("_label",)).orderBy(order, "doc_id", "n_words", "word_chars").limit(sample_rows).toPandas()
    signs = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    return fit_trees(rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), (rows["_label"].to_numpy() > 0).astype(float), signs)


def _verdicts(trees: Trees, texts, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, score and kept of a column of texts."""
    found = [document_stats(t.as_py()) for t in texts]
    base = np.array([x[0] for x in found], np.int64).reshape(-1, len(BASE))
    score = trees.score(np.array([x[1] for x in found], float).reshape(-1, len(FEATURES)))
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    return base, failed, score, ~failed & (score >= threshold)


def judge(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Null and empty texts have no words and fail the base rule. Each row of docs is judged by
    itself; repeated ids give repeated rows and a null id stays null. Very long texts are read
    whole; an empty table gives no rows. Other columns of docs are not read.
    """
    kept = docs.select("doc_id", "text")
    names = ["doc_id", *BASE, "base_failed", "score", "kept"]
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"

    def run(batches):
        for b in batches:
            base, failed, score, good = _verdicts(trees, b.column("text"), threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(score), pa.array(good)], names=names)

    return map_arrow(kept, run, schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """One row per document; see judge() for null, empty and repeated rows."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """docs without those that the rules reject, null and empty texts among them. Each row is judged by its own text, whatever its id."""
    trees = train(docs, table(spark, sf_dir, "labels"))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_verdicts(trees, b.column("text"), threshold)[3]))

    return map_arrow(docs, run, docs.schema)
