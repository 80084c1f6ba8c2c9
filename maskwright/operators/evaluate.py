"""Comparing predicted spans or masks with gold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S


def confusion(all_tokens: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, start, label (TP, FP, FN or TN) of each token by the starts that gold and pred hold."""
    one, none = F.lit(True), F.lit(None).cast("boolean")
    sides = all_tokens.select("doc_id", "start", none.alias("g"), none.alias("p")).union(gold.select("doc_id", "start", one, none)).union(pred.select("doc_id", "start", none, one))
    rows = sides.groupBy("doc_id", "start").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    label = F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), "TP").when(F.col("p").isNotNull(), "FP").when(F.col("g").isNotNull(), "FN").otherwise("TN")
    return rows.select("doc_id", "start", label.alias("label"))


def metrics(labels: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, retention; a ratio over nothing is 0."""
    n = {k: F.count_if(F.col("label") == k.upper()) for k in ("tp", "fp", "fn", "tn")}
    rows = labels.groupBy(*by).agg(*[v.alias(k) for k, v in n.items()])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 6)
    return rows.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "retention": ratio("tn", "fp")})


def metrics_over_nothing(totals: DataFrame) -> DataFrame:
    """metrics() rows with the older defaults: recall over nothing is 1, precision and retention over nothing 0."""
    return totals.withColumn("recall", F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("recall")))


def compare_masks(masked: DataFrame, gold: DataFrame, mark: str = "*") -> DataFrame:
    """Token by token, two maskings of one text (doc_id, text): doc_id, nth, label. A token counts as masked if it holds the mark."""
    a = S.regex_spans(masked, r"[^\x20\x09-\x0D]+").select("doc_id", "nth", F.contains("token", F.lit(mark)).alias("p"))
    b = S.regex_spans(gold, r"[^\x20\x09-\x0D]+").select("doc_id", "nth", F.contains("token", F.lit(mark)).alias("g"))
    rows = a.join(b, ["doc_id", "nth"])
    label = F.when(F.col("g") & F.col("p"), "TP").when(F.col("p"), "FP").when(F.col("g"), "FN").otherwise("TN")
    return rows.select("doc_id", "nth", label.alias("label"))


def align(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, start, stop, in_gold, in_pred: both sets of spans cut at each other's bounds where they are in either."""
    none = F.lit(None).cast("long")
    edges = lambda x, g, p: x.select("doc_id", F.col("start").alias("at"), g.alias("g"), p.alias("p")).union(x.select("doc_id", "stop", none, none))
    cuts = edges(gold, F.col("stop"), none).union(edges(pred, none, F.col("stop"))).groupBy("doc_id", "at").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    order = Window.partitionBy("doc_id").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # a part lies in a span if the farthest stop of what starts by then reaches the part's stop
    parts = cuts.select("doc_id", F.col("at").alias("start"), F.lead("at").over(order).alias("stop"), F.max("g").over(so_far).alias("g"), F.max("p").over(so_far).alias("p"))
    rows = parts.select("doc_id", "start", "stop", F.coalesce(F.expr("g >= stop"), F.lit(False)).alias("in_gold"), F.coalesce(F.expr("p >= stop"), F.lit(False)).alias("in_pred"))
    return rows.where("stop is not null and (in_gold or in_pred)")


def provenance(errors: DataFrame, hits: DataFrame) -> DataFrame:
    """errors(doc_id, start, stop) with the titles of the filters (doc_id, start, stop, title) that overlap each, comma-joined in order."""
    e, h = S.binned(errors.select("doc_id", "start", "stop")).alias("e"), S.binned(hits.select("doc_id", "start", "stop", "title")).alias("h")
    rows = e.join(h, S.overlapping("e", "h"), "left")
    return rows.groupBy("e.doc_id", "e.start", "e.stop").agg(F.array_join(F.sort_array(F.collect_set("h.title")), ",").alias("titles"))


def word_context(tokens: DataFrame, width: int = 10) -> DataFrame:
    """tokens(doc_id, nth, token) with the words from `width` before to `width` - 1 after, joined by spaces."""
    w = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(-width, width - 1)
    return tokens.withColumn("context", F.array_join(F.collect_list("token").over(w), " "))


def graded_masks(notes: DataFrame, annotated: DataFrame) -> DataFrame:
    """doc_id, nth, start, label, word of two maskings of one text (doc_id, text), token by token.

    Equal tokens are TP if they hold a star, else TN; a token whose gold is all stars is
    FN, one whose gold has none FP. Where gold masks a part of a token, each run of characters
    that it masks and the note keeps is FN, each run of the reverse FP.
    """
    sides = [S.regex_spans(d, r"[^\x20\x09-\x0D]+").select("doc_id", "nth", "start", F.col("token").alias(n)) for d, n in ((notes, "n"), (annotated, "a"))]
    rows = sides[0].join(sides[1].drop("start"), ["doc_id", "nth"]).where(F.col("n").rlike("[A-Za-z0-9*]"))
    chars = F.arrays_zip(F.split("n", "").alias("n"), F.split("a", "").alias("a"))

    def runs(kept: str, hidden: str, label: str):
        lone = F.transform(F.filter(chars, lambda c: c["n"].isNotNull() & c["a"].isNotNull()), lambda c: F.when(c["n"] == c["a"], "\x01").when((c[hidden] == "*") & (c[kept] != "*"), c[kept]).otherwise(""))
        return F.transform(F.filter(F.split(F.array_join(lone, ""), "\x01"), lambda w: w != ""), lambda w: F.struct(F.lit(label).alias("label"), w.alias("word")))

    one = lambda label, word: F.array(F.struct(F.lit(label).alias("label"), F.col(word).alias("word")))
    starred = F.contains("a", F.lit("*"))
    found = (
        F.when(starred & (F.col("n") == F.col("a")), one("TP", "n")).when(starred & F.col("a").rlike("[A-Za-z0-9]"), F.concat(runs("n", "a", "FN"), runs("a", "n", "FP")))
        .when(starred, one("FN", "n")).when(F.col("n") == F.col("a"), one("TN", "n")).otherwise(one("FP", "a"))
    )
    return rows.select("doc_id", "nth", "start", F.explode(found).alias("x")).select("doc_id", "nth", "start", "x.label", "x.word")


#: Tags of the public i2b2 corpus, with category and whether they count for patients and for providers.
TAGS = (
    ("DOCTOR", "Name", False, True), ("PATIENT", "Name", True, False), ("DATE", "Date", True, True), ("MEDICALRECORD", "ID", True, False), ("IDNUM", "ID", True, False), ("DEVICE", "ID", True, False),
    ("USERNAME", "Contact", True, True), ("PHONE", "Contact", True, True), ("EMAIL", "Contact", True, True), ("FAX", "Contact", True, True), ("CITY", "Location", True, True), ("STATE", "Location", True, True),
    ("ZIP", "Location", True, True), ("STREET", "Location", True, True), ("LOCATION-OTHER", "Location", True, True), ("HOSPITAL", "Location", True, True), ("AGE", "Age", True, False),
)


def tag_table(spark) -> DataFrame:
    """tag, category, patient, provider of TAGS. Other corpora bring their own table; a tag counts if it is in the table."""
    return spark.createDataFrame(list(TAGS), "tag string, category string, patient boolean, provider boolean")


def corrected(labels: DataFrame, tags: DataFrame) -> DataFrame:
    """labels(label, tag, token, ...) with category and the label corrected for tags that count.

    A TP of a tag that doesn't count becomes FP, a FN of such a tag TN; so does the FN of an age
    that is a number under 90 or other words without `ninety`.
    """
    rows = labels.join(tags.select("tag", "category", F.lit(True).alias("_in")), "tag", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    old = F.when(F.col("token").rlike("^[0-9]+$"), F.col("token").cast("decimal(38,0)") >= 90).otherwise(F.contains("token", F.lit("ninety")))
    missed = F.col("_in") & ((F.coalesce("category", F.lit("")) != "Age") | F.coalesce(old, F.lit(False)))
    label = F.when((F.col("label") == "TP") & ~F.col("_in"), "FP").when((F.col("label") == "FN") & ~missed, "TN").otherwise(F.col("label"))
    return rows.withColumn("label", label).drop("_in")


def tag_recall(labels: DataFrame, tags: DataFrame) -> DataFrame:
    """category, tag, tp, fn, recall of labels(label, tag): per tag, per category (tag null) and in all (both null), the best first; one aggregation over all three."""
    rows = labels.where("label in ('TP', 'FN')").join(tags.select("tag", "category"), "tag", "left").withColumn("category", F.coalesce("category", F.lit("Other")))
    got = rows.rollup("category", "tag").agg(F.count_if(F.col("label") == "TP").alias("tp"), F.count_if(F.col("label") == "FN").alias("fn"))
    return got.withColumn("recall", F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6)).orderBy(F.desc("recall"), "category", "tag")


def group_recall(labels: DataFrame, tags: DataFrame) -> DataFrame:
    """of (patient or provider), tp, fn, recall over the tags that count for each; 0 over nothing."""
    kinds = tags.select("tag", F.explode(F.filter(F.array(F.when(F.col("patient"), "patient"), F.when(F.col("provider"), "provider")), lambda x: x.isNotNull())).alias("of"))
    rows = labels.where("label in ('TP', 'FN')").join(kinds, "tag").groupBy("of").agg(F.count_if(F.col("label") == "TP").alias("tp"), F.count_if(F.col("label") == "FN").alias("fn"))
    return rows.withColumn("recall", F.round(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)), 6))


def token_types(tokens: DataFrame, typed: DataFrame) -> DataFrame:
    """tokens(doc_id, start, stop) that typed spans (doc_id, start, stop, phi_type) overlap, with their types, comma-joined in order."""
    a, b = S.binned(tokens.select("doc_id", "start", "stop")).alias("a"), S.binned(typed.select("doc_id", "start", "stop", "phi_type")).alias("b")
    rows = a.join(b, S.overlapping("a", "b")).groupBy("a.doc_id", "a.start", "a.stop")
    return rows.agg(F.array_join(F.sort_array(F.collect_set("b.phi_type")), ",").alias("types"))


def probe_report(docs: DataFrame, tokens: DataFrame, typed: DataFrame) -> DataFrame:
    """doc_id, start, stop, types, probe, context of the tokens that only the known identifiers of their note protect."""
    rows = token_types(tokens, typed).where("types in ('PROBEDYNAMICSET', 'PROBEREGEX')")
    return S.with_context(S.with_text(rows, docs, "probe"), docs)


def absent_words(docs: DataFrame, annotated: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, nth, token, context of the words of docs that occur nowhere in the same document of annotated: what was masked there."""
    toks = _words(docs)
    seen = _words(annotated).select("doc_id", "token").distinct()
    return word_context(toks, width).join(seen, ["doc_id", "token"], "left_anti").select("doc_id", "nth", "token", "context")


def _words(docs: DataFrame) -> DataFrame:
    return S.tokens(docs).select("doc_id", "nth", "token")


def not_annotated(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Those of found (doc_id, start, stop) that lie within no gold span, by a sweep: of what starts no later, the farthest stop is short of theirs."""
    a = found.withColumns({"_at": F.col("start"), "_kind": F.lit(1), "_stop": F.lit(None).cast("long")})
    b = gold.select("doc_id", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("stop").alias("_stop"))
    w = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_reach", F.max("_stop").over(w))
    return rows.where("_kind = 1 and (_reach is null or _reach < stop)").select(*found.columns)


def first_type(tokens: DataFrame, typed: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """tokens(doc_id, start, stop) that typed spans (doc_id, start, stop, phi_type) overlap, with one type each: the first in `order`, others after by name."""
    rank = F.coalesce(*[F.when(F.col("b.phi_type") == t, i) for i, t in enumerate(order)], F.lit(len(order)))
    a, b = S.binned(tokens.select("doc_id", "start", "stop")).alias("a"), S.binned(typed.select("doc_id", "start", "stop", "phi_type")).alias("b")
    rows = a.join(b, S.overlapping("a", "b")).groupBy("a.doc_id", "a.start", "a.stop")
    return rows.agg(F.min(F.struct(rank.alias("rank"), F.col("b.phi_type").alias("phi_type")))["phi_type"].alias("phi_type"))


def annotators(a: DataFrame, b: DataFrame, absent: str = "O") -> DataFrame:
    """one, two, n: how often annotator a and annotator b gave which labels(doc_id, start, label) to the same place; a place that only one labels is `absent` for the other."""
    rows = a.select("doc_id", "start", F.col("label").alias("one")).join(b.select("doc_id", "start", F.col("label").alias("two")), ["doc_id", "start"], "full")
    return rows.groupBy(F.coalesce("one", F.lit(absent)).alias("one"), F.coalesce("two", F.lit(absent)).alias("two")).agg(F.count(F.lit(1)).alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """n, agreed, expected, kappa of annotators(): the share on which both agree, the share expected by chance, and Cohen's kappa (1 where chance is certain)."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    sides = [pairs.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(c)) for c in ("one", "two")]
    chance = sides[0].join(sides[1], "label").agg(F.sum(F.col("one").cast("double") * F.col("two")).alias("chance"))
    same = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("one") == F.col("two"), F.col("n")).otherwise(0)).alias("same"))
    rows = same.crossJoin(F.broadcast(chance))  # one row each
    agreed, expected = F.col("same") / F.col("n"), F.coalesce("chance", F.lit(0.0)) / F.col("n") / F.col("n")
    kappa = F.when(expected >= 1, 1.0).otherwise((agreed - expected) / (1 - expected))
    return rows.where("n > 0").select("n", F.round(agreed, 6).alias("agreed"), F.round(expected, 6).alias("expected"), F.round(kappa, 6).alias("kappa"))


def shift_evaluation(gold: DataFrame, pred: DataFrame, *key: str) -> DataFrame:
    """key, label of dates by an outer join: TP in both, FP in pred only, FN in gold only."""
    rows = gold.select(*key, F.lit(True).alias("_g")).join(pred.select(*key, F.lit(True).alias("_p")), list(key), "full")
    return rows.select(*key, F.when(F.col("_g") & F.col("_p"), "TP").when(F.col("_p"), "FP").otherwise("FN").alias("label"))


def condensed(labels: DataFrame, tokens: DataFrame, *by: str) -> DataFrame:
    """label, word, by, n, first_doc of the errors among labels(doc_id, start, label): how often each word was missed or taken wrongly. tokens has doc_id, start, token and by, such as its tag or the filters that hit it."""
    rows = labels.where("label in ('FP', 'FN')").select("doc_id", "start", "label").join(tokens.select("doc_id", "start", F.lower("token").alias("word"), *by), ["doc_id", "start"])
    return rows.groupBy("label", "word", *by).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def listed(labels: DataFrame, *by: str) -> DataFrame:
    """by, label, n, words of labels(label, start, token): the words of each label by their places; what `by` names, as a file or category, bounds the list."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("start", "token"))), lambda x: x["token"])
    return labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), words.alias("words"))
