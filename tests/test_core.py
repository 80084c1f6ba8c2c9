"""The de-identification operators against golden cases and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright import sources, streaming
from maskwright.functions import dates as D
from maskwright.operators import filters as FI
from maskwright.operators import mask as M
from maskwright.operators import prepare as P
from maskwright.operators import spans as S
from maskwright.plans.patterns import Pattern, expand, jvm_regex, load, regex_line

KEEP = Pattern("rest", "regex", False, regex=".")


def masked(spark, text, patterns, probes=None):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return M.mask_tokens(d, FI.protected(d, patterns, probes)).first()["text"]


@pytest.mark.parametrize(
    "text, patterns, expected",
    [
        ("My name is John john.", [Pattern("john", "set", True, words=("john",)), KEEP], "My name is ***** *****."),
        ("My name is John john.", [Pattern("john", "set", False, words=("john",))], "***** ***** ***** John john."),
        ("Mr. Yosef went to Mayo Hospital.", [Pattern("h", "regex", True, "LOCATION", r"[A-Z]\w+ Hospital"), KEEP], "Mr. Yosef went to ***** *****."),
        ("S12-34567", [Pattern("id", "regex", True, "ID", r"S\d\d-\d{5}"), KEEP], "*****-*****"),
        ("Fax:(111)222-3333", [Pattern("fax", "regex", True, "CONTACT", r"\(\d{3}\)\d{3}-\d{4}"), Pattern("w", "regex", False, regex=r"[A-Za-z]+")], "Fax:(*****)*****-*****"),
        ("all kept", [Pattern("all", "match_all", False)], "all kept"),
        ("", [KEEP], ""),
    ],
)
def test_golden(spark, text, patterns, expected):
    assert masked(spark, text, patterns) == expected


def test_dynamic_and_context(spark):
    probes = spark.createDataFrame([(1, "name", "Smith"), (2, "name", "Jones")], "doc_id long, kind string, value string")
    assert masked(spark, "Dr Smith saw Jones", [KEEP, Pattern("p", "dynamic_set", True, "NAME")], probes) == "Dr ***** saw Jones"
    left = [Pattern("n", "regex", False, regex=r"\b[a-z]+\b"), Pattern("c", "regex_context", False, regex=r" [A-Z]\w+", context="left")]
    assert masked(spark, "Ann Bell and Cole", left) == "***** Bell and Cole".replace("Cole", "*****")


def test_patterns():
    assert regex_line("# note\n\\d+\n# more\n") == r"\d+"
    assert jvm_regex(r"\bjan(?i)\b") == r"(?Ud)(?i)\bjan\b"
    assert expand('a"""+m+r"""b', {"m": "x|y"}) == "ax|yb"
    with pytest.raises(ValueError):
        load('[{"title": "a", "type": "nope", "exclude": true}]')
    with pytest.raises(ValueError):
        load('[{"title": "a", "type": "set", "exclude": "False"}]')


def test_regex_spans_against_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé1 .-\n١B") for _ in range(rng.randrange(60))) for _ in range(60)] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = ["the the the cat cat sat", "a a", "aa a a a é é", "1 1 2"]
    d = d.union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = texts + [None] * (100 - len(texts)) + more
    for p in (r"\b(\w+) \1\b", r"\d+", r"[a-z]+\b", r"(?<!\d)\d(?!\d)", r"a.", r"\w+-"):
        got = {(r["doc_id"], r["start"], r["stop"], r["token"]) for r in S.regex_spans(d, jvm_regex(p)).collect()}
        assert got == {(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) if t for m in re.finditer(p, t)}, p


def test_literal_spans(spark):
    d = spark.createDataFrame([(1, r"a.b axb a.b (x) \Ea.b"), (2, "a.b"), (3, None)], "doc_id long, text string")
    v = spark.createDataFrame([(1, "a.b"), (1, "a.b"), (1, "(x"), (1, r"\Ea"), (1, ""), (1, None), (2, "x"), (3, "a")], "doc_id long, value string")
    got = sorted((r["value"], r["start"]) for r in S.literal_spans(d, v).collect())
    assert got == sorted([("a.b", 0), ("a.b", 8), ("a.b", 18), ("(x", 12), (r"\Ea", 16)])


def test_span_algebra_against_sets(spark):
    rng = random.Random(5)
    rows = lambda n: [(d, s, s + rng.randrange(1, 6)) for d in range(6) for s in (rng.randrange(30) for _ in range(n))]
    a, b = rows(5), rows(3)
    df = lambda x: spark.createDataFrame(x, "doc_id long, start long, stop long")
    cover = lambda x: {(d, i) for d, s, e in x for i in range(s, e)}
    merged = [tuple(r) for r in S.merge(df(a)).select("doc_id", "start", "stop").collect()]
    assert cover(merged) == cover(a) and all(x == y or x[0] != y[0] or x[2] < y[1] or y[2] < x[1] for x in merged for y in merged)
    apart = {tuple(r) for r in S.apart_from(df(a), df(b)).collect()}
    assert apart == {x for x in a if not any(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for y in b)}
    left = [tuple(r) for r in S.subtract(S.merge(df(a)), S.merge(df(b))).collect()]
    assert cover(left) == cover(a) - cover(b)


def test_masks_keep_the_rest(spark):
    d = spark.createDataFrame([(1, "é a1*b — c"), (2, "x")], "doc_id long, text string")
    sp = spark.createDataFrame([(1, 2, 6)], "doc_id long, start long, stop long")
    assert {r["doc_id"]: r["text"] for r in M.mask_chars(d, S.with_text(sp, d)).collect()} == {1: "é **** — c", 2: "x"}


def test_dates(spark):
    rows = ["2001-02-03", "2/3/2001", "2/3/01", "February 3, 2001", "February 2001", "February 3", "February", "2001", "nonsense", "13/45/2001", None]
    d = spark.createDataFrame([(x,) for x in rows], "s string").select("s", D.parse(F.col("s")).alias("p")).select("s", D.render(F.col("p")).alias("r"), D.same(F.col("p"), F.col("p")).alias("same"))
    got = {r["s"]: r["r"] for r in d.collect()}
    assert got["2/3/01"] == "02/03/01" and got["February 2001"] == "February 2001" and got["February 3"] == "February 03" and got["February"] == "February" and got["2001"] == "2001"
    assert got["nonsense"] is None and got["13/45/2001"] is None and got[None] is None
    one = spark.range(1).select(
        D.parse_age(F.lit("Ninety-one")).alias("a"), D.parse_age(F.lit("7")).alias("b"), D.shift(F.lit("2000-03-01").cast("date"), F.lit("1")).cast("string").alias("c"), D.shift(F.lit("2000-03-01").cast("date"), F.lit("x")).alias("d"),
        D.capped_birth(F.lit("1900-02-28").cast("date"), F.lit("2000-03-01").cast("date")).cast("string").alias("e"), D.age_substitute(F.lit(91)).alias("f"),
    ).first()
    assert tuple(one) == (91, 7, "2000-02-29", None, "1910-02-28", "*****")


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "007_utf8.txt").write_bytes("café".encode())
    (tmp_path / "n" / "08.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "n" / "meta_data.txt").write_text("no")
    assert {(r["doc_id"], r["note_key"]): r["text"] for r in sources.text_notes(spark, str(tmp_path / "n")).collect()} == {("007_utf8.txt", "7"): "café", ("08.txt", "8"): "café"}
    (tmp_path / "w.json").write_text('{"NNP": 1, "DT": 2}')
    assert {r["word"] for r in sources.word_set(spark, str(tmp_path / "w.json")).collect()} == {"NNP", "DT"}
    (tmp_path / "9.xml").write_text('<doc><TEXT>Ann is 91</TEXT><TAGS><NAME id="P0" spans="0~3" text="Ann" TYPE="NAME" comment=""/><AGE id="P1" start="7" end="9" text="91" TYPE="AGE" comment=""/></TAGS></doc>')
    notes, gold = sources.xml_annotations(spark, str(tmp_path / "9.xml"), "doc", ("NAME", "AGE"))
    assert notes.first()["text"] == "Ann is 91" and {(r["phi_type"], r["start"], r["stop"]) for r in gold.collect()} == {("NAME", 0, 3), ("AGE", 7, 9)}
    (tmp_path / "p.tsv").write_text("value\tphi_type\tnote_key\nAnn\tfname\t007\n94110\tZIP\t8\nx\tother\t8\n")
    assert {tuple(r) for r in sources.probes_tsv(spark, str(tmp_path / "p.tsv")).collect()} == {("7", "name", "Ann"), ("8", "zip", "94110")}
    runs = str(tmp_path / "runs")
    assert sources.append_run(spark.range(2), runs) == 1 and sources.append_run(spark.range(2), runs, spark.read.parquet(runs)) == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "call (415) 555-1212 now")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    notes = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = streaming.mask_stream(notes, [Pattern("p", "regex", True, "CONTACT", r"\(\d{3}\) \d{3}-\d{4}"), KEEP], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["call (*****) *****-***** now"]


def test_prepare(spark):
    one = spark.range(1).select(P.note_key(F.lit("/a/b/0012_utf8.txt")).alias("a"), P.shard(F.lit("12345678901")).alias("b"), P.random_key(F.lit("x")).alias("c")).first()
    assert one["a"] == "12" and one["b"] == "12/345/678/901" and re.fullmatch("[A-Z0-9]{14}B", one["c"])


def test_span_sweeps_against_brute_force(spark):
    """Touching, nested, equal and empty spans; long ones that reach over several bins; documents on one side only; parts dealt by doc_id."""
    import random

    from maskwright import configure
    from maskwright.operators import evaluate, spans

    configure(spark)
    rng = random.Random(5)
    some = lambda d, n, size: [(d, a, a + rng.choice((0, 1, 2, 5, size))) for a in (rng.randrange(600) for _ in range(n))]
    a = [x for d in (1, 2, 3) for x in some(d, 25, 300)] + [(1, 0, 4), (1, 0, 4)]
    b = [x for d in (2, 3, 4) for x in some(d, 8, 40)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, start long, stop long").repartition(4, "doc_id")
    A, B = frame(a), frame(b)
    got = lambda df: sorted(tuple(r) for r in df.collect())

    assert got(spans.apart_from(A, B)) == sorted(x for x in a if not any(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for y in b))
    met = {(x[0], max(x[1], y[1]), min(x[2], y[2])) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1]}
    assert got(spans.intersections(A, B)) == sorted(met)

    held = lambda rows, d, at: any(x[0] == d and x[1] <= at < x[2] for x in rows)
    runs = [(d, s, s + 90) for d in (1, 2, 3) for s in range(0, 600, 100)]
    left = {(d, at) for d, s, e in runs for at in range(s, e) if not held(b, d, at)}
    pieces = got(spans.subtract(frame(runs), B))
    laid = [(d, at) for d, s, e in pieces for at in range(s, e)]
    assert len(laid) == len(set(laid)) and set(laid) == left

    parts = evaluate.align(A, B).collect()
    for r in parts:
        assert r.in_gold == any(x[0] == r.doc_id and x[1] <= r.start and x[2] >= r.stop for x in a)
        assert r.in_pred == any(x[0] == r.doc_id and x[1] <= r.start and x[2] >= r.stop for x in b)
    assert sum(r.stop - r.start for r in parts) == len({(d, at) for d, s, e in a + b for at in range(s, e)})

    by = {tuple(r)[:3]: r.titles for r in evaluate.provenance(A, B.selectExpr("*", "'t' as title")).collect()}
    assert by == {x: "t" if any(x[0] == y[0] and x[1] < y[2] and x[2] > y[1] for y in b) else "" for x in a}
