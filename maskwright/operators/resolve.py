"""A filter list over notes, row by row.

Every row of the notes is resolved by itself: the JVM searches its text for all regexes in one
projection, and one Arrow step lays the matches out and accepts them by priority. So no key, no
shuffle and no self-join is needed, the plan grows by one expression a pattern, and null and
repeated ids are rows like any others. Only known identifiers are joined, by note.

Acceptance depends on what earlier patterns had accepted, which no built-in operator expresses
in one pass; the step is numpy over all texts of a batch at once, SLICE code points at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import let
from ..plans.patterns import FINDERS, TYPES, Pattern, jvm_regex
from . import intervals as I
from . import probes as P
from .spans import TOKEN, gaps_and_lengths

#: Code points of text that are resolved at once.
SLICE = 1 << 21
_FOUND, _WORDS = "_mw_found", "_mw_words"
_NAMES, _ANY, _SHORT, _NOTE = P.PER_NOTE
_NO_FOUND = "cast(array() as array<struct<p:int,g:array<int>,n:array<int>>>)"
INCLUDES = "array<struct<start:bigint,stop:bigint>>"
TYPED = "array<struct<start:bigint,stop:bigint,phi_type:string,token:string>>"
PROBED = ("PROBEDYNAMICSET", "PROBEREGEX")

_LETTER = np.zeros(129, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MASKABLE = _LETTER.copy()
_MASKABLE[ord("*")] = True


def _runs(code: np.ndarray, kind: np.ndarray) -> I.Spans:
    inside = np.concatenate(([0], kind[np.minimum(code, 128)].astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


class _Texts:
    """The texts of some rows end to end, one place apart, so that spans of different rows never touch."""

    def __init__(self, texts: list[str | None], tag=None):
        self.texts = [t or "" for t in texts]
        self.base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in self.texts]))).astype(np.int64)
        self.line = "\n".join(self.texts)
        code = np.frombuffer(self.line.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.tokens, self.maskable, self.tag = _runs(code, _LETTER), _runs(code, _MASKABLE), tag
        self._words = self._tags = None

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = self.read(self.tokens)
        return self._words

    @property
    def tags(self) -> np.ndarray:
        if self._tags is None:
            self._tags = np.array(self.tag(self.words), object)
        return self._tags

    def read(self, spans: I.Spans) -> list[str]:
        line = self.line
        return [line[a:b] for a, b in zip(spans[0].tolist(), spans[1].tolist(), strict=True)]

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, "right") - 1

    def listed(self, spans: I.Spans, *more: tuple[str, pa.Array]) -> pa.Array:
        """Spans, in order of their start, as one list of structs a row."""
        row = self.row_of(spans[0])
        at = np.searchsorted(spans[0], self.base)
        fields = [("start", pa.array(spans[0] - self.base[row], pa.int64())), ("stop", pa.array(spans[1] - self.base[row], pa.int64())), *more]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([x for _, x in fields], [n for n, _ in fields]))


def _matches(found: pa.Array, texts: _Texts) -> dict[int, I.Spans]:
    """Spans of each pattern from array<struct<p, g, n>> rows: lengths of the gaps and of the matches of a text."""
    row = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    flat = found.flatten()
    if not len(flat):
        return {}
    p, gaps, lens = flat.field("p").to_numpy(), flat.field("g"), flat.field("n")
    k = np.diff(lens.offsets.to_numpy())
    first = np.cumsum(np.diff(gaps.offsets.to_numpy())) - np.diff(gaps.offsets.to_numpy())
    own = np.repeat(np.arange(len(k)), k)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
    long = lens.flatten().to_numpy().astype(np.int64)
    end = np.cumsum(gaps.flatten().to_numpy().astype(np.int64)[first[own] + nth] + long)
    before = np.concatenate(([0], end))[np.cumsum(k) - k]
    stop = end - before[own] + texts.base[row[own]]
    kind = p[own]
    return {int(x): (stop[kind == x] - long[kind == x], stop[kind == x]) for x in np.unique(p)}


def _tokens_of(p: Pattern, i: int, texts: _Texts, picked: dict[int, np.ndarray], names: list) -> np.ndarray:
    """Which tokens pattern p takes: words of a set, of the note's own names, or by tag."""
    n = len(texts.tokens[0])
    tagged = np.isin(texts.tags, p.pos) if texts.tag and p.pos else None
    if p.type in ("pos_matcher", "stanford_ner"):
        return tagged if tagged is not None else picked.get(i, np.zeros(n, bool))
    if p.type == "set":
        held = frozenset(p.words)
        hit = np.fromiter((w in held or w.lower() in held for w in texts.words), bool, n)
        return hit & (tagged if tagged is not None else picked.get(i, np.zeros(n, bool))) if p.pos else hit
    hit = np.zeros(n, bool)
    at = np.searchsorted(texts.tokens[0], texts.base)
    for r, own in enumerate(names):
        if own:
            held = frozenset(own)
            hit[at[r] : at[r + 1]] = [w in held or w.lower() in held for w in texts.words[at[r] : at[r + 1]]]
    return hit


class _Accepted:
    """Accepted spans of one polarity, merged when they are asked for."""

    def __init__(self):
        self._held, self._new = I.NONE, []

    def add(self, spans: I.Spans) -> None:
        if len(spans[0]):
            self._new.append(spans)

    @property
    def islands(self) -> I.Spans:
        if self._new:
            self._held, self._new = I.islands(I.joined([self._held, *self._new])), []
        return self._held

    def remove(self, starts: np.ndarray) -> None:
        held = self.islands
        stay = ~np.isin(held[0], starts)
        self._held = held[0][stay], held[1][stay]


def _accept(patterns: list[Pattern], texts: _Texts, candidate) -> tuple[I.Spans, dict[str, list[I.Spans]]]:
    """(accepted includes, accepted excludes by type). candidate(i, pattern) gives the spans that a pattern finds by itself.

    A span is accepted if it touches nothing accepted of the other polarity. A context or
    dynamic pattern overrides instead: it is accepted anyway, and if it excludes, what is
    included from the very place where one of its spans starts is taken out.
    """
    includes, excludes, kinds = _Accepted(), _Accepted(), {}
    for i, p in enumerate(patterns):
        found = candidate(i, p)
        if "context" in p.type:
            named = next(((j, q) for j, q in enumerate(patterns) if q.title == p.context_filter), None)
            near = I.cut(texts.maskable, includes.islands) if p.context_filter == "all" else I.islands(candidate(*named))
            left, right = np.isin(found[0], near[1]), np.isin(found[1], near[0])
            keep = {"left": left, "right": right, "left_and_right": left & right}.get(p.context, left | right)
            found = I.clipped(texts.tokens, (found[0][keep], found[1][keep]))
        if p.regex != "." if p.type == "regex" else "regex" in p.type or p.type not in TYPES:
            found = I.islands(found)  # whole tokens and whole texts never touch
        if "context" in p.type or "dynamic" in p.type:
            if p.exclude:
                includes.remove(found[0])
        else:
            free = ~I.touched(found, (includes if p.exclude else excludes).islands)
            found = found[0][free], found[1][free]
        (excludes if p.exclude else includes).add(found)
        if p.exclude:
            kinds.setdefault(p.phi_type, []).append(found)
    return includes.islands, kinds


def _resolved(batch: pa.RecordBatch, patterns: list[Pattern], carry: list[str], tag, words: bool, finders: dict) -> pa.RecordBatch:
    texts = _Texts(batch.column("text").to_pylist(), tag)
    spans = _matches(batch.column(_FOUND), texts)
    picked = {}
    for x, row in zip(batch.column(_WORDS).to_pylist(), np.searchsorted(texts.tokens[0], texts.base).tolist(), strict=False):
        for s in x or ():
            picked.setdefault(s["p"], np.zeros(len(texts.tokens[0]), bool))[np.array(s["n"] or (), int) + row] = True
    names = batch.column(_NAMES).to_pylist()

    def candidate(i: int, p: Pattern) -> I.Spans:
        if p.type == "match_all":
            some = np.diff(texts.base) > 1
            return texts.base[:-1][some], (texts.base[1:] - 1)[some]
        if p.type == "regex" and p.regex == ".":
            return texts.tokens
        if "regex" in p.type and p.type not in finders:
            return spans.get(i, I.NONE)
        if p.type in finders:
            pairs = [(a + at, b + at) for t, at in zip(texts.texts, texts.base.tolist(), strict=False) for a, b in finders[p.type](t, p)]
            return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)
        hit = _tokens_of(p, i, texts, picked, names)
        return texts.tokens[0][hit], texts.tokens[1][hit]

    includes, kinds = _accept(patterns, texts, candidate)
    kinds = {t: I.islands(I.joined(kinds[t])) for t in sorted(kinds)}
    left = I.cut(texts.maskable, includes)
    names_of = [*kinds, "OTHER"]
    kind = np.full(len(left[0]), len(kinds))
    for k in range(len(kinds) - 1, -1, -1):
        kind[I.overlapped(left, kinds[names_of[k]])] = k
    both = I.joined(list(kinds.values()))
    which = np.repeat(np.arange(len(kinds)), [len(x[0]) for x in kinds.values()]).astype(int)
    order = np.argsort(both[0], kind="stable")
    both, which = (both[0][order], both[1][order]), which[order]
    named = lambda at: pa.array([names_of[k] for k in at.tolist()], pa.string())
    read = lambda s: pa.array(texts.read(s) if words else [None] * len(s[0]), pa.string())
    out = [texts.listed(includes), texts.listed(both, ("phi_type", named(which)), ("token", read(both))), texts.listed(left, ("phi_type", named(kind)), ("token", read(left)))]
    own = np.stack([I.overlapped(texts.tokens, s) for s in kinds.values()] or [np.zeros(len(texts.tokens[0]), bool)])
    probe = np.isin(names_of[: len(own)], PROBED) if kinds else np.zeros(1, bool)
    alone = (own.sum(axis=0) == 1) & (own & probe[:, None]).any(axis=0) if words else np.zeros(own.shape[1], bool)
    lone = texts.tokens[0][alone], texts.tokens[1][alone]
    out.append(texts.listed(lone, ("phi_type", named(own[:, alone].argmax(axis=0) if len(lone[0]) else np.zeros(0, int))), ("token", read(lone))))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *out], names=[*carry, "includes", "excludes", "protected", "probed"])


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE):
    """batch in slices of whole rows whose texts have about `most` bytes."""
    data = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def resolved(docs: DataFrame, patterns: list[Pattern], probes: DataFrame | None = None, tag=None, words: bool = False) -> DataFrame:
    """docs(text, ...) with includes, excludes, protected and probed, arrays of spans in order of their start.

    includes is what the list keeps and excludes what it took out, by type, both merged;
    protected is all that is left to mask, typed by the excludes that it overlaps (the first
    type by name; OTHER where none). With words, spans have their text and probed holds the
    tokens that only known identifiers protect. probes(doc_id, kind, value) belong to the notes
    of that note_key, or doc_id where docs has no such column. tag is a list of tokens to a list
    of tags, called once per slice; without it tags are heuristic and stanford_ner finds nothing.
    Null texts have no spans; each row, whatever its id, has a row.
    """
    from .filters import heuristic_pos

    carry = list(docs.columns)
    rows = docs.withColumn(_NAMES, F.lit(None).cast("array<string>"))
    if probes is not None:
        if "kind" not in probes.columns:
            raise ValueError("probes need a column kind: name, zip, mrn, phone, address or workplace")
        rows = docs.join(P.per_note(probes), docs["note_key" if "note_key" in carry else "doc_id"] == F.col(_NOTE), "left")
    found, picked = [], []

    def one(i: int, pattern: Column) -> Column:
        return F.transform(F.array(gaps_and_lengths("text", pattern)), lambda x: F.struct(F.lit(i).alias("p"), x["g"].alias("g"), x["n"].alias("n")))[0]

    for i, p in enumerate(patterns):
        if p.type in ("regex", "regex_context") and not (p.type == "regex" and p.regex == "."):
            found.append(one(i, F.lit(jvm_regex(p.regex))))
        elif p.type in ("dynamic_regex", "dynamic_regex_context") and probes is not None:
            found.append(one(i, P.pattern(F.col(_SHORT if "context" in p.type else _ANY), p.regex)))
        elif p.pos and p.type != "stanford_ner" and tag is None:
            picked.append((i, p.pos))
    rows = rows.withColumn(_FOUND, F.filter(F.array(*found), lambda x: x["n"].isNotNull()) if found else F.expr(_NO_FOUND))

    def tokens_like(toks: Column) -> Column:
        index = lambda pos: F.filter(F.transform(toks, lambda t, j: F.when(heuristic_pos(t).isin(*pos), j)), lambda j: j.isNotNull())
        return F.array(*[F.struct(F.lit(i).alias("p"), index(pos).alias("n")) for i, pos in picked])

    none = F.lit(None).cast("array<struct<p:int,n:array<int>>>")
    rows = rows.withColumn(_WORDS, let(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), tokens_like) if picked else none)
    rows = rows.select(*[F.col(f"`{c}`") for c in carry], _FOUND, _WORDS, _NAMES)
    plain, finders = list(patterns), {p.type: FINDERS[p.type] for p in patterns if p.type in FINDERS}

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                yield _resolved(part, plain, carry, tag, words, finders)

    out = T.StructType([*docs.schema.fields, T.StructField("includes", T.DataType.fromDDL(INCLUDES)), *(T.StructField(c, T.DataType.fromDDL(TYPED)) for c in ("excludes", "protected", "probed"))])
    return rows.mapInArrow(run, out)
