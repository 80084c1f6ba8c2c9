"""Sources and sinks, registered filter types, free-form dates, annotators, curation and reports on small cases."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from maskwright import __main__ as cli
from maskwright import sources
from maskwright.functions import dates as D
from maskwright.operators import evaluate as E
from maskwright.operators import mask as M
from maskwright.operators import prepare as P
from maskwright.operators import reports as R
from maskwright.operators.resolve import resolved
from maskwright.plans import patterns as PT
from maskwright.plans.deidentify import deidentify
from maskwright.plans.macros import macros
from maskwright.plans.patterns import Pattern, expand, load

KEEP = Pattern("rest", "regex", False, regex=".")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_free_dates(spark):
    said = {
        "Jan 5, 2010": "01/05/2010", "5 January 2010": "01/05/2010", "1/5": "January 05", "01-05-2010": "01/05/2010", "January 5 2010": "01/05/2010", "10/2010": "October 2010", "Monday, March 3, 2012": "03/03/2012",
        "March 3rd, 2012": "03/03/2012", "2010/01/05": "01/05/2010", "25/12/2010": "12/25/2010", "sept. 2009": "September 2009", "the 3rd of June": "June 03", "3-Jun-99": "06/03/99", "Feb 29": "February 29", "Feb 30": None, "June '04": "June 04",
        "Tuesday": None, "2010-13-45": None, "": None, "march": "March", "2010-01-05 10:15": "01/05/2010", "May the 4th be": None, "12/25/2010 at": None, "'07": "07", "Oct2011": "October 2011",
    }
    df = spark.createDataFrame([(s,) for s in said] + [(None,)], "s string")
    got = {r["s"]: r["r"] for r in df.select("s", D.render(D.parse(F.col("s"))).alias("r")).collect()}
    assert got == {**said, None: None}
    one = df.where("s = 'Feb 29'").select(D.parse(F.col("s")).alias("p")).first()["p"]
    assert one["d"] == date(2000, 2, 29) and one["missing_year"] and not one["missing_day"]


def test_a_registered_filter_type(spark):
    PT.register("shouted", lambda text, p: [(i, i + len(w)) for w in text.split() if w.isupper() for i in [text.index(w)]])
    try:
        d = spark.createDataFrame([(1, "stop NOW please"), (2, None)], "doc_id long, text string")
        assert rows(M.mask_rows(resolved(d, [Pattern("s", "shouted", True, "OTHER"), KEEP]))) == [(1, "stop ***** please"), (2, None)]
        assert load('[{"title": "s", "type": "shouted", "exclude": true}]')[0].type == "shouted"
        with pytest.raises(ValueError):
            PT.register("regex", len)
    finally:
        PT.FINDERS.pop("shouted")


def test_dictionary_macros():
    m = macros(words={"town_names": ["St. Ives", "Ely"], "gene_symbols": []})
    import re

    full = lambda name, w: re.fullmatch(f"(?:{m[name]})", w) is not None
    assert full("town_names", "St. Ives") and not full("town_names", "St, Ives") and not full("gene_symbols", "")
    assert full("address_indicator", "blvd") and full("address_indicator", "street") and full("state_name", "MD") and full("state_name", "West Virginia") and full("state_names", "washington D.C.")
    assert all(full("holidays", w) for w in ("thanksgiving", "thanksgiving day", "new years", "st patricks day", "mlk day", "martin luther king jr. day", "easter")) and not full("holidays", "day")
    assert expand('x"""+state_name+r"""y', m).startswith("x")


def test_annotated_files_round_trip(spark, tmp_path):
    """Annotation XML written and read back, tags unknown beforehand."""
    text = 'Ann & Bob < "x" ]]> 01/02/2003'
    d = spark.createDataFrame([("a/1.txt", text), ("2", "none here"), ("3", None)], "doc_id string, text string")
    job = deidentify(d, [Pattern("n", "set", True, "NAME", words=("ann", "bob")), Pattern("d", "regex", True, "DATE", r"\d\d/\d\d/\d{4}"), KEEP])
    sources.write_note_files(sources.annotated_notes(job.rows), str(tmp_path / "xml"), sharded=False)
    files = sorted(p for p in (tmp_path / "xml").rglob("part-*"))
    assert len(files) == 2
    for i, f in enumerate(files):
        f.rename(tmp_path / f"{i}.xml")
    notes, gold = sources.xml_annotations(spark, str(tmp_path / "*.xml"), "note")
    assert {r["text"] for r in notes.collect()} == {text, "none here"}
    assert rows(gold, "phi_type", "start", "stop", "token") == sorted([("NAME", 0, 3, "Ann"), ("NAME", 6, 9, "Bob"), ("DATE", 20, 22, "01"), ("DATE", 23, 25, "02"), ("DATE", 26, 30, "2003")], key=repr)


def test_charsets(spark, tmp_path):
    for name, raw in (("1.txt", "é".encode("utf-8-sig")), ("2.txt", "é".encode("utf-16")), ("3.txt", b"\xfe\xff" + "é".encode("utf-16-be")), ("4.txt", b"\xe9")):
        (tmp_path / name).write_bytes(raw)
    got = {r["note_key"]: r["text"] for r in sources.text_notes(spark, str(tmp_path)).collect()}
    assert got == {"1": "é", "2": "é", "3": "é", "4": "é"}


def test_side_inputs(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert rows(sources.known_phi_tsv(spark, write("k.tsv", "patient_ID\tphi_type\tclean_value\tnote_key\n1\tlname\tBell\t007\n1\tfname\t\t8\n"))) == [("7", "lname", "Bell")]
    assert rows(sources.note_offsets_csv(spark, write("n.csv", "note_key,patient_ID\na,1\nb,2\n"), write("p.csv", "patient_ID,date_offset\n1,30\n1,20\n"))) == [("a", 30), ("b", None)]
    assert rows(sources.nicknames_csv(spark, write("nick.csv", "NAME,ALIAS,ALIAS FREQ\nANN,NAN,0.5\nANN,ANNIE,0.01\n"), 0.1)) == [("ANN", "NAN")]
    notes = sources.phi_notes_json(spark, write("phi.json", json.dumps({"1.txt": {"text": "Ann", "phi": [{"start": "0", "end": "3"}]}})))
    assert notes.first()["phi"] == [{"start": "0", "end": "3"}] and notes.first()["doc_id"] == "1.txt"
    assert rows(sources.word_set(spark, write("l.json", '["a", "b"]'))) == [("a",), ("b",)]
    meta = spark.createDataFrame([("1", "5", "1950-01-01"), ("2", "6", None)], "report_id string, deid_date_offset_cdw string, Birthdate string")
    assert rows(sources.metadata_of(meta, spark.createDataFrame([("1",), ("1",)], "note_key string")), "note_key", "date_offset", "birth_date") == [("1", 5, "1950-01-01")]
    detail = spark.createDataFrame([(1, 10, 2, 1), (2, 20, 4, 0)], "doc_id long, file_size long, total_tokens long, phi_tokens long")
    for name in ("b1", "b2"):
        sources.write_log(detail, str(tmp_path / name))
    assert R.batch_summary(sources.summaries(spark, str(tmp_path / "b1"), str(tmp_path / "b2"))).first()["n_docs"] == 4


def test_notes_are_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "notes")
    table = lambda *x: spark.createDataFrame(list(x), "doc_id string, text string")
    sources.upsert_notes(table(*[(str(i), f"old {i}") for i in range(40)]), path, "1")
    sources.upsert_notes(table(("3", "new 3"), ("99", "new 99")), path, "2")
    got = {r["doc_id"]: (r["text"], r["version"]) for r in spark.read.parquet(path).collect()}
    assert len(got) == 41 and got["3"] == ("new 3", "2") and got["99"] == ("new 99", "2") and got["4"][0] == "old 4"
    sources.write_notes(table(("a/1.txt", "x"), (None, "y")), str(tmp_path / "w"))
    assert rows(spark.read.parquet(str(tmp_path / "w")), "doc_id", "text") == sorted([("a/1.txt", "x"), (None, "y")], key=repr)


def test_two_annotators(spark):
    lab = lambda *x: spark.createDataFrame(x, "doc_id long, start long, label string")
    pairs = E.annotators(lab((1, 0, "A"), (1, 5, "B"), (2, 0, "A")), lab((1, 0, "A"), (1, 5, "A"), (3, 0, "B")))
    assert rows(pairs, "one", "two", "n") == [("A", "A", 1), ("A", "O", 1), ("B", "A", 1), ("O", "B", 1)]
    got = E.agreement(pairs).first()
    assert (got["n"], got["agreed"], got["expected"]) == (4, 0.25, pytest.approx((2 * 2 + 1 * 1 + 1 * 1) / 16)) and got["kappa"] == pytest.approx((0.25 - 0.375) / 0.625)
    assert E.agreement(pairs.limit(0)).count() == 0


def test_evaluation_lists_and_files(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0, "FN", "Ann"), (1, 9, "FN", "Bob"), (1, 4, "FP", "saw"), (2, 0, "FN", "Ann")], "doc_id long, start long, label string, token string")
    assert rows(E.listed(labels, "doc_id"), "doc_id", "label", "n", "words") == [(1, "FN", 2, ["Ann", "Bob"]), (1, "FP", 1, ["saw"]), (2, "FN", 1, ["Ann"])]
    assert (("FN", "ann", 2, 1)) in rows(E.condensed(labels, labels), "label", "word", "n", "first_doc")
    errors = labels.selectExpr("*", "'NAME' as tag", "'NNP' as pos", "'x' as context", "'' as exclude_filters", "'rest' as include_filters")
    sources.write_detailed_evaluation(errors, str(tmp_path / "e"))
    got = {r["token"]: r["occurrences"] for r in spark.read.csv(str(tmp_path / "e" / "fn_tags"), sep="|", header=True).collect()}
    assert got == {"Ann": "2", "Bob": "1"} and rows(spark.read.json(str(tmp_path / "e" / "summary")), "label", "n") == [("FN", 3), ("FP", 1)]
    none = E.metrics_over_nothing(E.metrics(spark.createDataFrame([(1, 0, "TN")], "doc_id long, start long, label string"))).first()
    assert (none["recall"], none["precision"], none["retention"]) == (1.0, 0.0, 1.0)


def test_surrogate_logs(spark, tmp_path):
    d = spark.createDataFrame([(1, "on 1/5/2010 aged 60, 99/99/2010")], "doc_id long, text string")
    meta = spark.createDataFrame([(1, 4, "1950-01-01")], "doc_id long, date_offset int, birth_date string")
    listed = [Pattern("d", "regex", True, "DATE", r"\d+/\d+/\d{4}"), Pattern("a", "regex", True, "AGE<90", r"(?<=aged )\d+"), KEEP]
    job = deidentify(d, listed, meta=meta)
    right = E.shift_evaluation(spark.createDataFrame([(1, 3), (1, 7)], "doc_id long, start long"), job.norms.where("date is not null"), "doc_id", "start")
    sources.write_surrogate_logs(job.norms, str(tmp_path), right)
    read = lambda name: rows(spark.read.csv(f"{tmp_path}/{name}", sep="|", header=True))
    assert read("shifted_dates") == [("1", "3", "11", "1/5/2010", "01/01/2010")] and read("failed_to_parse")[0][3] == "99/99/2010"
    assert read("counts_by_phi_type") == [("AGE<90", "1"), ("DATE", "1")] and len(read("surrogated_text")) == 2
    assert {x[-1] for x in read("date_shift_eval")} == {"TP", "FN"}
    assert rows(R.parse_outcomes(job.norms)) == [("AGE<90", 1, 0, 1), ("DATE", 1, 1, 1)]


def test_curated_gold_and_splits(spark):
    gold = spark.createDataFrame([(1, 0, 4, "Ucsf", "NAME"), (1, 5, 9, "Peru", "LOCATION"), (1, 9, 10, "Nurse", "NAME"), (1, 20, 24, "2001", "DATE"), (2, 0, 3, "Ann", "NAME")], "doc_id long, start long, stop long, token string, phi_type string")
    words = spark.createDataFrame([("NAME", "UCSF"), ("LOCATION", "peru"), (None, "nurse"), ("LOCATION", "ann")], "phi_type string, word string")
    assert rows(P.curate(gold, words), "token") == [("Ann",)]
    keys = spark.range(4000).withColumnRenamed("id", "k")
    n = {r["part"]: r["count"] for r in P.weighted_split(keys, "k", {"a": 3, "b": 1}).groupBy("part").count().collect()}
    assert abs(n["a"] - 3000) < 120 and n["a"] + n["b"] == 4000
    assert rows(P.key_sets(spark.createDataFrame([(1,), (1,), (None,)], "k long"), spark.createDataFrame([(1,), (2,)], "k long"), "k")) == [(1, "both"), (2, "second")]
    assert R.next_run(spark.createDataFrame([], "run int")).first()["next_run"] == 1


def test_command_line_writes_xml(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "1.txt").write_text("Ann of Ely, MD")
    (tmp_path / "t.txt").write_text('\\b(?:"""+town_names+r"""), (?:"""+state_name+r""")\\b\n')
    (tmp_path / "towns.json").write_text('["Ely"]')
    (tmp_path / "c.json").write_text(json.dumps([{"title": "t", "type": "regex", "exclude": True, "filepath": "t.txt", "phi_type": "LOCATION"}, {"title": "r", "type": "regex", "exclude": False, "regex": "."}]))
    cli.main(["--input", str(tmp_path / "in"), "--config", str(tmp_path / "c.json"), "--output", str(tmp_path / "out"), "--format", "xml", "--words", f"town_names={tmp_path / 'towns.json'}", "--no-logs"], spark)
    made = [p.read_text() for p in (tmp_path / "out" / "notes").rglob("part-*")]
    assert len(made) == 1 and 'LOCATION id="P0" start="7" end="10" text="Ely"' in made[0] and "<TEXT><![CDATA[Ann of Ely, MD]]></TEXT>" in made[0]
