"""Filter lists over rows: identity of notes, priority against brute force, plans that stay linear, masks from arrays."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException

from maskwright import configure, sources, streaming
from maskwright.operators import filters as FI
from maskwright.operators import intervals as I
from maskwright.operators import mask as M
from maskwright.operators import spans as S
from maskwright.operators.resolve import resolved
from maskwright.plans.deidentify import deidentify
from maskwright.plans.patterns import Pattern, load

PHONE = Pattern("phone", "regex", True, "CONTACT", r"\(\d{3}\) \d{3}-\d{4}")
KEEP = Pattern("rest", "regex", False, regex=".")
LONG = "safe words " * 30_000 + "(415) 555-1212"
NOTES = [(1, "a (415) 555-0001"), (1, "b (415) 555-0002 b"), (None, "call (415) 555-1212"), (None, None), (2, ""), (3, LONG), (1, "a (415) 555-0001")]


def hidden(text):
    return text and re.sub(r"\(\d{3}\) \d{3}-\d{4}", "(*****) *****-*****", text)


def test_every_row_is_masked_by_itself(spark):
    """Null ids, repeated ids of like and unlike texts, null, empty and very long texts, clashing columns."""
    d = spark.createDataFrame([(*n, "x") for n in NOTES], "doc_id long, text string, protected string")
    got = M.mask_rows(resolved(d.select("doc_id", "text"), [PHONE, KEEP]))
    want = sorted(((i, hidden(t)) for i, t in NOTES), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    job = deidentify(d, [PHONE, KEEP])
    assert sorted((tuple(r) for r in job.masked.collect()), key=repr) == want
    assert sorted(r["phi_tokens"] for r in job.detail().collect()) == [0, 0, 3, 3, 3, 3, 3]
    with pytest.raises(ValueError):
        job.evaluate(spark.createDataFrame([], "doc_id long, start long, stop long, phi_type string"))
    assert deidentify(d.limit(0), [PHONE, KEEP]).masked.count() == 0


def test_probes_and_metadata_of_repeated_ids(spark):
    d = spark.createDataFrame([(1, "Bell on 01/31/2001"), (1, "saw Bell 02/01/2001"), (None, "Bell 02/01/2001"), (2, "Bell")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "name", "Bell"), (None, "name", "saw")], "doc_id long, kind string, value string")
    meta = spark.createDataFrame([(1, 31, None), (None, 1, None), (1, 31, None)], "doc_id long, date_offset int, birth_date string")
    patterns = [Pattern("known", "dynamic_set", True, "PROBEDYNAMICSET"), Pattern("d", "regex", True, "DATE", r"\d\d/\d\d/\d{4}"), KEEP]
    got = sorted((tuple(r) for r in deidentify(d, patterns, p, meta).masked.collect()), key=repr)
    assert got == sorted([(1, "***** on 12/31/2000"), (1, "saw ***** 01/01/2001"), (None, "Bell *****/*****/*****"), (2, "Bell")], key=repr)
    with pytest.raises(ValueError):
        resolved(d, patterns, p.drop("kind"))


def test_masks_by_a_relation_refuse_what_they_cannot_tell_apart(spark):
    for rows in (NOTES[:2], NOTES[2:3]):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        with pytest.raises(PySparkException, match="unique and not null"):
            M.mask_tokens(d, FI.protected(d, [PHONE, KEEP])).collect()
    one = spark.createDataFrame(NOTES[:1] + NOTES[4:6], "doc_id long, text string")
    assert {tuple(r) for r in M.mask_tokens(one, FI.protected(one, [PHONE, KEEP])).collect()} == {(i, hidden(t)) for i, t in NOTES[:1] + NOTES[4:6]}


def test_files_of_one_name_are_different_notes(spark, tmp_path):
    for name, text in (("a/1.txt", "x (415) 555-0001"), ("b/1.txt", "yes (415) 555-0002"), ("01.txt", "z (415) 555-0003")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    d = sources.text_notes(spark, str(tmp_path))
    p = spark.createDataFrame([("1", "name", "Yes")], "doc_id string, kind string, value string")
    got = {r["doc_id"]: r["text"] for r in deidentify(d, [PHONE, KEEP], p).masked.collect()}
    assert got == {"a/1.txt": "x (*****) *****-*****", "b/1.txt": "***** (*****) *****-*****", "01.txt": "z (*****) *****-*****"}
    first = [Pattern("known", "dynamic_set", True, "NAME"), PHONE, KEEP]
    assert {r["doc_id"]: r["phi_type"] for r in deidentify(d, first, p).spans.where("start = 0").collect()} == {"b/1.txt": "NAME"}


def brute_resolve(text, patterns, words):
    """Includes and protected pieces by sets of places, one pattern after the other."""
    inc, exc = [], []
    touch = lambda a, b: a[0] <= b[1] and a[1] >= b[0]

    def merge(spans):
        out = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def pieces():
        out = []
        for m in re.finditer(r"[A-Za-z0-9*]+", text):
            at = [i for i in range(m.start(), m.end()) if not any(a <= i < b for a, b in inc)]
            for i in at:
                if out and out[-1][1] == i:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i, i + 1))
            out.append((-1, -1))
        return [x for x in out if x[0] >= 0]

    tokens = [m.span() for m in re.finditer(r"[A-Za-z0-9]+", text)]
    for p in patterns:
        if p.type == "match_all":
            found = [(0, len(text))] if text else []
        elif p.type == "set":
            found = [(a, b) for a, b in tokens if text[a:b] in p.words or text[a:b].lower() in p.words]
        elif p.type == "dynamic_set":
            found = [(a, b) for a, b in tokens if text[a:b].lower() in words]
        elif p.regex == ".":
            found = tokens
        else:
            found = [m.span() for m in re.finditer(p.regex, text)]
        if "context" in p.type:
            near = pieces() if p.context_filter == "all" else merge([m.span() for m in re.finditer(next(q.regex for q in patterns if q.title == p.context_filter), text)])
            left, right = {b for _, b in near}, {a for a, _ in near}
            ok = {"left": lambda a, b: a in left, "right": lambda a, b: b in right, "left_and_right": lambda a, b: a in left and b in right, "left_or_right": lambda a, b: a in left or b in right}[p.context]
            found = [(max(a, c), min(b, d)) for a, b in found if ok(a, b) for c, d in tokens if max(a, c) < min(b, d)]
        if "regex" in p.type and p.regex != ".":
            found = merge(found)
        if p.exclude and ("context" in p.type or "dynamic" in p.type):
            inc = [x for x in merge(inc) if x[0] not in {a for a, _ in found}]
        elif not ("context" in p.type or "dynamic" in p.type):
            found = [x for x in found if not any(touch(x, y) for y in (inc if p.exclude else exc))]
        (exc if p.exclude else inc).extend(found)
    return merge(inc), pieces()


def test_priority_against_brute_force(spark):
    """Random lists with context, dynamic and overriding patterns over random texts, null and empty ones among them."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab1 .*-Xé\n") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    probes = spark.createDataFrame([(i, "name", "ab b1") for i in range(0, 60, 2)], "doc_id long, kind string, value string")
    kinds = [
        lambda i, x: Pattern(f"p{i}", "regex", x, regex=rng.choice([r"[ab]+", r"\d", r"X.", r"a*", r"[ab1]+ [ab]", r"\S+"])), lambda i, x: Pattern(f"p{i}", "set", x, words=("a", "b1", "X")),
        lambda i, x: Pattern(f"p{i}", "dynamic_set", x), lambda i, x: Pattern(f"p{i}", "regex_context", x, regex=rng.choice([r" ?[ab1]+", r"[-. ]?[abX]+[-. ]?"]), context=rng.choice(["left", "right", "left_or_right", "left_and_right"]), context_filter=rng.choice(["all", "base"])),
        lambda i, x: Pattern(f"p{i}", "regex", x, regex="."),
    ]
    for k in range(5):
        patterns = [Pattern("base", "regex", bool(k % 2), regex="[1X]+"), *(rng.choice(kinds)(i, rng.random() < 0.5) for i in range(7))]
        if k == 4:
            patterns.insert(3, Pattern("all", "match_all", False))
        for r in resolved(d, patterns, probes).collect():
            words = {"ab", "abs", "b1", "b1s"} if r["doc_id"] in range(0, 60, 2) else set()
            inc, left = brute_resolve(r["text"] or "", patterns, words)
            assert [(x["start"], x["stop"]) for x in r["includes"]] == inc, patterns
            assert [(x["start"], x["stop"]) for x in r["protected"]] == left, patterns


def test_plans_grow_by_the_pattern(spark):
    """Forty changes of polarity: one scan of the notes, and no exchange."""
    d = spark.createDataFrame(NOTES, "doc_id long, text string")
    plans = {}
    for n in (4, 40):
        patterns = [Pattern(f"p{i}", "regex", bool(i % 2), regex=f"w{i}|[ab]{{{i + 1}}}") for i in range(n)]
        plans[n] = M.mask_rows(resolved(d, patterns))._jdf.queryExecution().optimizedPlan().toString()
        assert plans[n].count("LogicalRDD") + plans[n].count("LocalRelation") == 1 and "Join" not in plans[n] and "Window" not in plans[n]
    assert len(plans[40]) < 15 * len(plans[4])


def test_config_of_many_polarities(spark, tmp_path):
    """A JSON list read from files: exclude, include, exclude by context, include by tag, all in one pass."""
    (tmp_path / "names.json").write_text(json.dumps({"ann": 1, "bell": 1}))
    (tmp_path / "state.txt").write_text("# two letters\n\\b(?:SF|LA)\\b\n")
    config = [
        {"title": "state", "type": "regex", "exclude": True, "filepath": "state.txt", "phi_type": "LOCATION"}, {"title": "words", "type": "pos_matcher", "exclude": False, "pos": ["NN", "VBD", "RB"]},
        {"title": "names", "type": "set", "exclude": True, "filepath": "names.json", "phi_type": "NAME"}, {"title": "near", "type": "regex_context", "exclude": True, "regex": " [a-z]+", "context": "left", "context_filter": "names", "phi_type": "NAME"},
        {"title": "titles", "type": "regex", "exclude": False, "regex": r"\b(?:Mr|Dr)\b"}, {"title": "all", "type": "regex", "exclude": False, "regex": r"[a-z]+"},
    ]
    patterns = load(json.dumps(config), lambda f: (tmp_path / f).read_text())
    d = spark.createDataFrame([(1, "Dr Ann moved slowly to SF, Mr Bell lived")], "doc_id long, text string")
    assert M.mask_rows(resolved(d, patterns)).first()["text"] == "Dr ***** ***** slowly to *****, Mr ***** *****"


def test_a_callers_tagger(spark):
    d = spark.createDataFrame([(1, "Ann ran home"), (2, None), (None, "Bob")], "doc_id long, text string")
    tag = lambda words: ["PERSON" if w in ("Ann", "Bob") else "O" for w in words]
    patterns = [Pattern("ner", "stanford_ner", True, "NAME", pos=("PERSON",)), Pattern("pos", "pos_matcher", False, pos=("O",))]
    assert {tuple(r) for r in M.mask_rows(resolved(d, patterns, tag=tag)).collect()} == {(1, "***** ran home"), (2, None), (None, "*****")}
    assert {(r["doc_id"], r["start"]) for r in FI.ner_spans(d, tag, ("PERSON",)).collect()} == {(1, 0), (None, 0)}
    assert M.mask_rows(resolved(d, [*patterns[1:], KEEP], tag=None)).where("doc_id = 1").first()["text"] == "Ann ran home"


def test_dynamic_regexes_by_note(spark):
    d = spark.createDataFrame([(1, "call 415.555.1212 J x"), (2, "call 415.555.1212 J x")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "phone", "(415) 555-1212"), (2, "name", "J Bell")], "doc_id long, kind string, value string")
    patterns = [KEEP, Pattern("r", "dynamic_regex", True, "PROBEREGEX", "%s"), Pattern("c", "dynamic_regex_context", True, "PROBEREGEXCONTEXT", r"[ ]+\b(%s)(\.|\b)[ ]+", context="left_or_right")]
    got = {r["doc_id"]: [(x["start"], x["stop"], x["phi_type"]) for x in r["excludes"]] for r in resolved(d, patterns, p).collect()}
    assert got == {1: [(5, 17, "PROBEREGEX")], 2: []}  # nothing is protected beside J
    near = [Pattern("w", "regex", False, regex="[a-z]+"), *patterns[1:]]
    assert M.mask_rows(resolved(d, near, p)).where("doc_id = 2").first()["text"] == "call *****.*****.***** ***** x"


def test_empty_matches_keep_their_place(spark):
    d = spark.createDataFrame([(1, "baac"), (1, "aab"), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["stop"]) for r in S.regex_spans(d, "a*").collect())
    assert got == sorted((i, *m.span()) for i, t in ((1, "baac"), (1, "aab"), (2, "")) for m in re.finditer("a*", t))


def test_replacements_in_place():
    spans = [(0, 2), (3, 5), (6, 10), (20, 22)]
    assert M.with_replacements(spans, [(0, 10, "DAY"), (3, 5, "no"), (7, 9, "not at a start")]) == [(0, 10, "DAY"), (20, 22, "*****")]
    assert M.with_replacements(spans, [(6, 8, "x"), (20, 30, "y")]) == [(0, 2, "*****"), (3, 5, "*****"), (6, 8, "x"), (8, 10, "*****"), (20, 30, "y")]
    assert M.rebuilt("éabc", [(1, 3, "-")]) == "é-c" and M.rebuilt(None, [(0, 1, "x")]) is None


def test_intervals_against_sets():
    rng = np.random.default_rng(3)
    for _ in range(50):
        some = lambda n: (x := rng.integers(0, 40, n), x + rng.integers(0, 6, n))  # noqa: E731, B023
        a, b = I.islands(some(6)), I.islands(some(5))
        cover = lambda s: {i for x, y in zip(*s, strict=True) for i in range(x, y)}
        left = I.cut(a, b)
        assert cover(left) == cover(a) - cover(b) and (left[0] < left[1]).all()
        spans = some(9)
        assert I.touched(spans, a).tolist() == [any(x <= q and y >= p for p, q in zip(*a, strict=True)) for x, y in zip(*spans, strict=True)]
        assert I.overlapped(spans, a).tolist() == [any(p < y and q > x for p, q in zip(*a, strict=True)) for x, y in zip(*spans, strict=True)]


def test_refresh_and_stream_of_odd_rows(spark, tmp_path):
    configure(spark)
    spark.createDataFrame(NOTES, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = streaming.mask_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), [PHONE, KEEP], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == sorted(((i, hidden(t)) for i, t in NOTES), key=repr)
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    changes = spark.createDataFrame([(1, "A", "Update"), (2, None, "Delete"), (3, "x", "Keep"), (4, "d", "Add")], "doc_id long, text string, status string")
    assert {tuple(r) for r in streaming.refresh(spark, now, changes).collect()} == {(1, "A"), (3, "c"), (4, "d")}
