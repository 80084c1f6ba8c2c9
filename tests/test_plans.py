"""Known identifiers, the whole job, evaluation by tag, and macros, against brute force and small cases."""

import json
import random
import re
from datetime import date

from pyspark.sql import functions as F

from maskwright import __main__ as cli
from maskwright.functions import dates as D
from maskwright.operators import evaluate as E
from maskwright.operators import probes as P
from maskwright.plans.deidentify import deidentify
from maskwright.plans.macros import macros
from maskwright.plans.patterns import Pattern

KEEP = Pattern("rest", "regex", False, regex=".")
DATE = Pattern("date", "regex", True, "DATE", r"\b\d{1,2}/\d{1,2}/\d{4}\b")
AGE = Pattern("age", "regex", True, "AGE<90", r"(?<=aged )\d+")


def notes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def probes(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, kind string, value string")


def test_probe_words(spark):
    p = probes(spark, (0, "name", "Mary-Ann O'Hara Dr"), (0, "zip", "94110-A"), (0, "phone", "415"), (0, "name", None), (1, "name", "X"))
    assert {tuple(r) for r in P.words(p).collect()} == {(0, w) for w in ("mary", "marys", "ann", "anns", "hara", "haras", "94110", "A")}
    assert {tuple(r) for r in P.short_words(p).collect()} == {(0, "o"), (0, "dr"), (1, "x")}
    d = notes(spark, "Anns mary a A x 94110", "Ann x")
    assert {(r["doc_id"], r["token"]) for r in P.word_spans(d, p).collect()} == {(0, "Anns"), (0, "mary"), (0, "A"), (0, "94110")}


def test_probe_regexes(spark):
    p = probes(spark, (0, "phone", "(415) 555-1212"), (0, "address", "12 Normal Elm Str"), (0, "workplace", "Acme Inc"), (0, "name", "J. R. Bell"), (1, "name", "A.B."), (2, "name", "Bell"), (3, "address", "Friend"), (3, "phone", "x"))
    d = notes(spark, "call 415.555.1212 or 4155551212 at 12 elm, STR of acme - inc", "AxBx A.B.", "on 1/2/2003bells 1/2/2003 10:15 1/2/2003", "a friend", None)
    got = {(r["doc_id"], r["token"]) for r in P.template_spans(d, P.regexes(p)).collect()}
    assert got == {(0, "415.555.1212"), (0, "4155551212"), (0, "12 elm, STR"), (0, "acme - inc"), (1, "A.B."), (2, "1/2/2003bells"), (2, "1/2/2003 10:15")}
    cities = spark.createDataFrame([("elm",)], "word string")
    assert {r["token"] for r in P.template_spans(d, P.regexes(p.where("kind = 'address'"), cities)).collect()} == set()
    short = probes(spark, (0, "name", "J Bell"))
    assert [r["token"] for r in P.template_spans(notes(spark, "saw J. Bell, j, J of"), P.short_words(short), P.BETWEEN_SPACES).collect()] == [" J. ", ] + [" J "]


def test_add_known(spark):
    d = notes(spark, "Dr Smith met smith\tand Jones")
    had = spark.createDataFrame([(0, 3, 5), (0, 13, 30)], "doc_id long, start long, stop long")
    known = spark.createDataFrame([(0, "lname", "Smith"), (0, "ZIP", "Jones"), (1, "fname", "met"), (0, "fname", None)], "doc_id long, phi_type string, value string")
    out, report = P.add_known(d, had, known)
    assert {tuple(r) for r in out.select("start", "stop").collect()} == {(3, 8), (13, 30)}
    assert [(r["token"], r["context"]) for r in report.collect()] == [("Smith", "Dr Smith met smith")]


def test_deidentify(spark, tmp_path):
    d = notes(spark, "Seen 01/31/2001, aged 60, born 03/01/1940. X1/2/2001Y", "Seen 02/01/2001, aged 95", "Seen 2/2/2001", "99/99/2001 Ann", None)
    meta = spark.createDataFrame([(0, 31, "1940-03-01"), (1, 1, "1900-01-01"), (2, 0, None), (3, 5, None)], "doc_id long, date_offset int, birth_date string")
    p = probes(spark, (3, "name", "Ann"))
    job = deidentify(d, [DATE, AGE, KEEP], p, meta, "2020-01-01")
    got = {r["doc_id"]: r["text"] for r in job.masked.collect()}
    assert got[0] == "Seen 12/31/2000, aged 60, born 01/30/1940. X1/2/2001Y"
    assert got[1] == "Seen 01/31/2001, aged *****" and got[2] == "Seen *****/*****/*****" and got[3] == "*****/*****/***** *****" and got[4] is None
    first = deidentify(d, [Pattern("k", "dynamic_set", True, "PROBEDYNAMICSET"), DATE, AGE, KEEP], p, meta, "2020-01-01")
    logs = {k: v.collect() for k, v in first.logs().items()}
    assert {r["token"] for r in logs["failed_dates"]} == {"99/99/2001"} and [r["probe"] for r in logs["dynamic_blacklist"]] == ["Ann"]
    assert {r["doc_id"]: r["failed_surrogated"] for r in logs["detailed_batch_summary"]} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}
    again = deidentify(d, [DATE, AGE, KEEP], p, meta, "2020-01-01", work=str(tmp_path / "accepted"))
    assert {r["doc_id"]: r["text"] for r in again.masked.collect()} == got and again.typed.count() == job.typed.count()
    assert {r["doc_id"]: r["text"] for r in deidentify(d, [DATE, AGE, KEEP]).masked.collect()}[2] == "Seen *****/*****/*****"


def test_date_parts(spark):
    born, ref = date(1904, 2, 29), date(2001, 2, 28)
    df = spark.createDataFrame([("2/29/1904", born, ref), ("March 2001", born, ref), ("2/29/04", born, ref), ("x", born, ref)], "s string, b date, r date")
    p = D.parse(F.col("s"))
    got = df.select("s", D.age_on(F.col("b"), F.col("r")).alias("age"), D.complete(p).alias("full"), D.render(D.shift_partial(p, F.lit("10"), F.col("b"), F.col("r"))).alias("to"), D.shift_range(F.concat("s", F.lit(" - "), "s"), F.lit(1)).alias("range"))
    rows = {r["s"]: r for r in got.collect()}
    assert rows["x"]["age"] == 97 and rows["2/29/1904"]["to"] == "02/19/1911" and rows["March 2001"]["to"] == "February 2001" and rows["x"]["to"] is None
    assert rows["2/29/1904"]["full"] and not rows["2/29/04"]["full"] and rows["2/29/1904"]["range"] == "03/01/1904 [SHIFTED DATE]-03/01/1904 [SHIFTED DATE]" and rows["x"]["range"] is None


def brute_grades(n, a):
    out = []
    for x, y in zip(re.findall(r"[^\x20\x09-\x0D]+", n), re.findall(r"[^\x20\x09-\x0D]+", a)):
        if not re.search("[A-Za-z0-9*]", x):
            continue
        if "*" in y and x == y:
            out.append(("TP", x))
        elif "*" in y and re.search("[A-Za-z0-9]", y):
            for label, kept, hidden in (("FN", x, y), ("FP", y, x)):
                run = ""
                for k, h, same in [(k, h, k == h) for k, h in zip(kept, hidden)] + [("", "", True)]:
                    if same and run:
                        out.append((label, run))
                        run = ""
                    elif not same and h == "*" and k != "*":
                        run += k
        elif "*" in y:
            out.append(("FN", x))
        else:
            out.append(("TN", x) if x == y else ("FP", y))
    return sorted(out)


def test_graded_masks(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab1 .é") for _ in range(30))
        cover = lambda: "".join("*" if c.isalnum() and c.isascii() and rng.random() < 0.4 else c for c in text)  # noqa: E731, B023
        rows.append((i, cover(), cover()))
    df = spark.createDataFrame(rows, "doc_id long, n string, a string")
    got = {}
    for r in E.graded_masks(df.selectExpr("doc_id", "n as text"), df.selectExpr("doc_id", "a as text")).collect():
        got.setdefault(r["doc_id"], []).append((r["label"], r["word"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: g for i, n, a in rows if (g := brute_grades(n, a))}


def test_corrected_and_recall(spark):
    rows = [(1, "TP", "DATE", "x"), (2, "TP", "JOB", "x"), (3, "FN", "JOB", "x"), (4, "FN", "AGE", "89"), (5, "FN", "AGE", "90"), (6, "FN", "AGE", "ninety-one"), (7, "FN", "AGE", "old"), (8, "FN", "CITY", "x"), (9, "TN", None, "x"), (10, "FP", None, None)]
    lab = spark.createDataFrame(rows, "doc_id long, label string, tag string, token string")
    tags = E.tag_table(spark)
    assert {r["doc_id"]: r["label"] for r in E.corrected(lab, tags).collect()} == {1: "TP", 2: "FP", 3: "TN", 4: "TN", 5: "FN", 6: "FN", 7: "TN", 8: "FN", 9: "TN", 10: "FP"}
    got = {(r["category"], r["tag"]): (r["tp"], r["fn"]) for r in E.tag_recall(lab, tags).collect()}
    assert got[(None, None)] == (2, 6) and got[("Other", "JOB")] == (1, 1) and got[("Age", None)] == (0, 4)
    assert {r["of"]: (r["tp"], r["fn"]) for r in E.group_recall(lab, tags).collect()} == {"patient": (1, 5), "provider": (1, 1)}


def test_token_types_and_annotations(spark):
    spans = lambda *x: spark.createDataFrame(x, "doc_id long, start long, stop long, phi_type string")
    typed = spans((1, 0, 5, "NAME"), (1, 4, 9, "DATE"), (1, 300, 900, "ID"))
    toks = spans((1, 4, 5, ""), (1, 5, 6, ""), (1, 9, 10, ""), (1, 512, 600, ""))
    assert {r["start"]: r["types"] for r in E.token_types(toks, typed).collect()} == {4: "DATE,NAME", 5: "DATE", 512: "ID"}
    assert {r["start"] for r in E.not_annotated(toks, typed).collect()} == {9}
    d, a = notes(spark, "Ann saw Bob twice"), notes(spark, "*** saw *** twice")
    assert {(r["token"], r["context"]) for r in E.absent_words(d, a, 1).collect()} == {("Ann", "Ann"), ("Bob", "saw Bob")}


def test_macros():
    m = macros({"town": "x"})
    full = lambda name, word: re.fullmatch(f"(?:{m[name]})", word) is not None
    assert all(full("month_name", w) for w in ("jan", "January", "JAN", "JANUARY", "may", "Sept", "September")) and not full("month_name", "Janu")
    assert all(full("day_name", w) for w in ("Sun", "sundays", "TUESDAY", "Tues", "Thu", "Wednesday")) and full("day_numbering", "22nd") and full("day_numbering", "11th")
    assert full("state_names", "new York") and full("state_names", "CA") and full("seasons", "WINTER") and full("holidays", "new year's eve") and full("ones", "nine") and m["town"] == "x"


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "01.txt").write_text("Ann Bell, seen January 5, 2001")
    (tmp_path / "d.txt").write_text('# dates\n\\b(?:"""+month_name+r""")\\s\\d{1,2},\\s\\d{4}\\b\n')
    (tmp_path / "c.json").write_text(json.dumps([{"title": "d", "type": "regex", "exclude": True, "filepath": "d.txt", "phi_type": "DATE"}, {"title": "p", "type": "dynamic_set", "exclude": True, "phi_type": "PROBEDYNAMICSET"}, {"title": "r", "type": "regex", "exclude": False, "regex": "."}]))
    (tmp_path / "p.tsv").write_text("value\tphi_type\tnote_key\nBell\tlname\t1\n")
    (tmp_path / "m.tsv").write_text("note_key\tdate_offset\tBirthDate\n1\t4\t1950-01-01\n")
    cli.main(["--input", str(tmp_path / "in"), "--config", str(tmp_path / "c.json"), "--output", str(tmp_path / "out"), "--probes", str(tmp_path / "p.tsv"), "--meta", str(tmp_path / "m.tsv")], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "notes")).first()["text"] == "Ann *****, seen 01/01/2001"
    assert spark.read.csv(str(tmp_path / "out" / "log" / "dynamic_blacklist"), sep="\t", header=True).first()["probe"] == "Bell"
