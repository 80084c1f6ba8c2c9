"""Registered queries over the driver's tables and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import configure, spread
from .functions import dates as D
from .operators import evaluate as E
from .operators import filters as FI
from .operators import mask as M
from .operators import prepare as P
from .operators import probes as PR
from .operators import reports as R
from .operators import spans as S
from .operators.resolve import resolved
from .plans.deidentify import deidentify
from .plans.patterns import Pattern

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
CARD = r"[0-9]{16}"
YEAR, AGED = r"\b(?:19|20)[0-9][0-9]\b", r"\b[1-9][0-9]?\b"
#: The flagship list: exclude identifiers, then keep every token that touches none.
FLAGSHIP = [
    Pattern("email", "regex", True, "CONTACT", EMAIL), Pattern("phone", "regex", True, "CONTACT", PHONE), Pattern("ip", "regex", True, "ID", IPV4),
    Pattern("card", "regex", True, "ID", CARD), Pattern("rest", "regex", False, "OTHER", "."),
]

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> DataFrame:
    """The notes, dealt once by doc_id, so that windows and joins per document need no further exchange."""
    configure(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return t(spark, sf_dir, "documents").select("doc_id", "text").repartition(n, "doc_id")


def notes(spark, sf_dir) -> DataFrame:
    """The notes as they are: what is resolved row by row needs no dealing, but where the table has fewer splits than there are cores."""
    configure(spark)
    return spread(t(spark, sf_dir, "documents").select("doc_id", "text"))


def _sp(pattern: str, table: str = "documents", key: str = "doc_id") -> str:
    """SQL of doc_id, nth, start, stop, token."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT {key}, nth, (stop - len(token))::BIGINT AS start, stop::BIGINT AS stop, token FROM (
      SELECT {key}, nth, token, sum(len(gap) + len(token)) OVER (PARTITION BY {key} ORDER BY nth) AS stop FROM (
        SELECT {key}, unnest(ms) AS token, unnest(gs[1:len(ms)]) AS gap, unnest(range(len(ms))) AS nth FROM (
          SELECT {key}, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gs FROM {table})))"""


TOK = _sp(S.TOKEN)
_EXC = " UNION ALL ".join(f"SELECT doc_id, start, stop, '{p.phi_type}' AS phi_type FROM ({_sp(p.regex)})" for p in FLAGSHIP[:-1])
def _resolved_sql(exc: str) -> str:
    """exc, inc (kept tokens), runs of maskable characters and phi (what stays protected) of excludes followed by all tokens."""
    return f"""exc AS ({exc}), tok AS ({TOK}),
inc AS (SELECT doc_id, start, stop FROM tok WHERE NOT EXISTS (SELECT 1 FROM exc WHERE exc.doc_id = tok.doc_id AND tok.start <= exc.stop AND tok.stop >= exc.start)),
runs AS ({_sp(S.MASKABLE)}),
cut AS (
  SELECT r.doc_id, r.start AS a, r.stop AS b,
         list(i.start ORDER BY i.start) FILTER (WHERE i.start IS NOT NULL) AS ss, list(i.stop ORDER BY i.start) FILTER (WHERE i.start IS NOT NULL) AS es
  FROM runs r LEFT JOIN inc i ON r.doc_id = i.doc_id AND i.start < r.stop AND i.stop > r.start GROUP BY ALL),
piece AS (SELECT doc_id, unnest(list_concat([a], coalesce(es, []))) AS start, unnest(list_concat(coalesce(ss, []), [b])) AS stop FROM cut),
phi AS (
  SELECT p.doc_id, p.start, p.stop, coalesce(min(e.phi_type), 'OTHER') AS phi_type
  FROM (SELECT * FROM piece WHERE start < stop) p LEFT JOIN exc e ON e.doc_id = p.doc_id AND e.start < p.stop AND e.stop > p.start GROUP BY ALL)"""


RESOLVED = _resolved_sql(_EXC)


def _masked_sql(put: str) -> str:
    return f"""WITH {RESOLVED},
o AS (SELECT p.doc_id, p.start, p.stop, substring(d.text, (p.start + 1)::BIGINT, (p.stop - p.start)::BIGINT) AS token, d.text, coalesce(lag(p.stop) OVER (PARTITION BY p.doc_id ORDER BY p.start), 0) AS before, p.phi_type
FROM phi p JOIN documents d USING (doc_id)),
j AS (SELECT doc_id, string_agg(substring(text, (before + 1)::BIGINT, (start - before)::BIGINT) || {put}, '' ORDER BY start) AS head, max(stop) AS last
FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(head || substring(text, (last + 1)::BIGINT), text) AS text FROM documents d LEFT JOIN j USING (doc_id)"""


@query(_masked_sql("'*****'").replace("SELECT d.doc_id,", "SELECT nullif(d.doc_id % 50, 0) AS doc_id,"))
def mask_repeated_ids(spark, sf_dir):
    """Notes of which many share an id and some have none, each masked by its own spans."""
    folded = notes(spark, sf_dir).select(F.expr("nullif(doc_id % 50, 0)").alias("doc_id"), "text")
    return deidentify(folded, FLAGSHIP).masked


def _phi(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d, FI.protected(d, FLAGSHIP)


# ---- scans, tokens and strings


@query(TOK)
def token_offsets(spark, sf_dir):
    return S.tokens(docs(spark, sf_dir))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::BIGINT AS word_count,
  list_sum(list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: len(regexp_extract_all(w, '[A-Za-z0-9]+|[^A-Za-z0-9]'))))::BIGINT AS reference_token_count, strlen(text)::BIGINT AS file_size FROM documents""")
def token_counts(spark, sf_dir):
    pieces = F.aggregate(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(0), lambda a, w: a + F.regexp_count(w, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]")))
    return docs(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit("[A-Za-z0-9]+")).cast("long").alias("word_count"), pieces.cast("long").alias("reference_token_count"), F.octet_length("text").cast("long").alias("file_size"))


@query(r"""WITH c AS (SELECT unnest(list_filter(flatten(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_'']+'), lambda w: string_split_regex(w, '[''_]'))), lambda x: x <> '')) AS word
FROM documents)
SELECT word, count(*) AS n FROM c GROUP BY word""")
def clean_tokens(spark, sf_dir):
    """Words cut at punctuation, with how often they occur."""
    return S.clean_words(notes(spark, sf_dir)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, nth, start, stop, token FROM ({_sp(S.MASKABLE)}) WHERE contains(token, '*')")
def masked_tokens(spark, sf_dir):
    return S.regex_spans(docs(spark, sf_dir), S.MASKABLE).where(F.contains("token", F.lit("*")))


def _regex_query(name: str, pattern: str):
    def f(spark, sf_dir):
        return S.regex_spans(docs(spark, sf_dir), pattern)

    f.__name__ = name
    query(_sp(pattern))(f)


for _n, _p in (("regex_spans_email", EMAIL), ("regex_spans_phone", PHONE), ("regex_spans_ip", IPV4), ("regex_spans_card", CARD)):
    _regex_query(_n, _p)


@query(f"SELECT doc_id, start, stop, token FROM ({_sp('[0-9]+')}) WHERE len(token) = 4")
def regex_spans_lookaround(spark, sf_dir):
    """Lookarounds, which RE2 lacks: four digits that are not beside digits."""
    return S.regex_spans(notes(spark, sf_dir), r"(?Ud)(?<![0-9])[0-9]{4}(?![0-9])").drop("nth")


@query()
def regex_spans_backreference(spark, sf_dir):
    """Back-references, which RE2 lacks: a doubled word."""
    return S.regex_spans(notes(spark, sf_dir), r"(?Ud)\b(\w+) \1\b")


@query("SELECT doc_id, 0::BIGINT AS start, len(text)::BIGINT AS stop FROM documents WHERE text <> ''")
def match_all_spans(spark, sf_dir):
    return FI.candidates(notes(spark, sf_dir), Pattern("all", "match_all", False))


_WORDS = "SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{8,}'))) AS word FROM benchmark"


def _word_set(spark, sf_dir):
    """The long words of the benchmark: an input of the set filter."""
    return t(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0)), F.lower)).alias("word")).distinct()


@query(f"WITH w AS ({_WORDS}) SELECT doc_id, start, stop, token FROM ({TOK}) WHERE lower(token) IN (SELECT word FROM w)")
def set_filter_spans(spark, sf_dir):
    return FI.set_spans(docs(spark, sf_dir), _word_set(spark, sf_dir))


_POS = "CASE WHEN regexp_matches(token, '[0-9]') THEN 'CD' WHEN regexp_matches(token, '^[A-Z][a-z]*$') THEN 'NNP' WHEN regexp_matches(token, 'ing$') THEN 'VBG' WHEN regexp_matches(token, 'ed$') THEN 'VBD' WHEN regexp_matches(token, 'ly$') THEN 'RB' WHEN regexp_matches(token, '[a-z]s$') THEN 'NNS' ELSE 'NN' END"


@query(f"WITH k AS (SELECT {_POS} AS pos, regexp_matches(token, '[0-9]') AS is_phi FROM ({TOK})) SELECT pos, is_phi, count(*) AS n FROM k GROUP BY ALL")
def pos_counts(spark, sf_dir):
    """Tags of protected and other tokens, the most frequent first."""
    toks = S.tokens(docs(spark, sf_dir)).select(FI.heuristic_pos(F.col("token")).alias("pos"), F.col("token").rlike("[0-9]").alias("is_phi"))
    return toks.groupBy("pos", "is_phi").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pos")


@query(f"SELECT doc_id, start, stop FROM ({TOK}) WHERE {_POS} IN ('CD', 'VBG')")
def pos_filter_spans(spark, sf_dir):
    return FI.candidates(notes(spark, sf_dir), Pattern("pos", "pos_matcher", True, pos=("CD", "VBG")))


_PROBES = "SELECT conv_id AS doc_id, text AS value FROM conversations"


def _probes(spark, sf_dir):
    """Known identifiers per note: what the conversation of the same number says."""
    return t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("name").alias("kind"), F.col("text").alias("value"))


_NO_NAMES = ", ".join(f"'{w}'" for w in PR.NO_NAMES)
_PROBE_WORDS = f"""SELECT DISTINCT doc_id, unnest([w, w || 's']) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(value), '[a-z0-9]+')) AS w FROM ({_PROBES})) WHERE len(w) > 1 AND w NOT IN ({_NO_NAMES})"""


@query(f"""WITH p AS ({_PROBE_WORDS}) SELECT t.doc_id, start, stop, token FROM ({TOK}) t WHERE EXISTS (SELECT 1 FROM p
WHERE p.doc_id = t.doc_id AND p.word = lower(t.token))""")
def dynamic_set_spans(spark, sf_dir):
    return FI.dynamic_set_spans(docs(spark, sf_dir), _probes(spark, sf_dir))


@query(_PROBE_WORDS)
def probe_words(spark, sf_dir):
    return PR.words(_probes(spark, sf_dir))


@query(f"""SELECT DISTINCT doc_id, w AS regex FROM (SELECT doc_id, unnest(regexp_extract_all(lower(value), '[a-z0-9]+')) AS w FROM ({_PROBES}))
WHERE (len(w) < 2 OR w IN ({_NO_NAMES})) AND NOT regexp_matches(w, '^[0-9]+$')""")
def probe_short_words(spark, sf_dir):
    return PR.short_words(_probes(spark, sf_dir))


#: Known identifiers of three kinds that each note itself holds.
_OWN = r"""SELECT doc_id, 'workplace' AS kind, regexp_extract(text, '[A-Za-z]{4,} [A-Za-z]{4,}') AS value FROM documents UNION ALL SELECT doc_id, 'address', regexp_extract(text, '[0-9]+ [A-Za-z]{4,}') FROM documents UNION ALL SELECT doc_id, 'phone', regexp_extract(text, '\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}') FROM documents"""
_KEPT = "list_filter(runs, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in PR.NO_CITIES) + "))"
_OWN_REGEX = f"""own AS ({_OWN}), r AS (SELECT doc_id, kind, regexp_extract_all(lower(value), '[a-z0-9]+') AS runs FROM own WHERE value <> ''),
rx AS (SELECT DISTINCT *
FROM (SELECT doc_id, CASE kind WHEN 'phone' THEN array_to_string(runs, '{PR.GAPS["phone"]}') WHEN 'address' THEN array_to_string({_KEPT}, '{PR.GAPS["address"]}') ELSE array_to_string(runs, '{PR.GAPS["workplace"]}') END AS regex
FROM r) WHERE regex <> '')"""


def _own_probes(d):
    kinds = (("workplace", "[A-Za-z]{4,} [A-Za-z]{4,}"), ("address", "[0-9]+ [A-Za-z]{4,}"), ("phone", PHONE))
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 0).alias("value")) for k, p in kinds])
    return d.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.kind", "x.value").where("value <> ''")


@query(f"WITH {_OWN_REGEX} SELECT doc_id, regex FROM rx")
def probe_regexes(spark, sf_dir):
    return PR.regexes(_own_probes(docs(spark, sf_dir)))


@query(f"""WITH {_OWN_REGEX}, p AS (SELECT doc_id, text, '(?i)(?:' || pat || ')' AS pat FROM documents
JOIN (SELECT doc_id, string_agg(regex, '|' ORDER BY len(regex) DESC, regex) AS pat FROM rx GROUP BY doc_id) USING (doc_id)),
m AS (SELECT doc_id, regexp_extract_all(text, pat) AS ms, string_split_regex(text, pat) AS gs FROM p)
SELECT doc_id, (stop - len(token))::BIGINT AS start, stop::BIGINT AS stop, token
FROM (SELECT doc_id, token, sum(len(gap) + len(token)) OVER (PARTITION BY doc_id ORDER BY nth) AS stop
FROM (SELECT doc_id, unnest(ms) AS token, unnest(gs[1:len(ms)]) AS gap, unnest(range(len(ms))) AS nth FROM m))""")
def dynamic_regex_spans(spark, sf_dir):
    d = docs(spark, sf_dir)
    return FI.dynamic_regex_spans(d, _own_probes(d))


@query(f"""WITH tk AS ({TOK}), n AS (SELECT conv_id AS doc_id, lower(unnest(regexp_extract_all(text, '^[A-Za-z0-9]+'))) AS form FROM conversations),
f AS (SELECT DISTINCT tk.doc_id, start, stop, token FROM tk JOIN n ON tk.doc_id = n.doc_id AND lower(token) = form),
had AS (SELECT doc_id, start, stop FROM tk WHERE regexp_matches(token, '^[A-Z]')),
new AS (SELECT f.* FROM f LEFT JOIN had USING (doc_id, start) WHERE had.stop IS NULL OR f.stop > had.stop)
SELECT doc_id, start, stop, token, translate(substring(text, greatest(start - 10, 0) + 1, least(stop + 10, len(text)) - greatest(start - 10, 0)), chr(10) || chr(9), '  ') AS context
FROM new JOIN documents USING (doc_id)""")
def known_identifiers(spark, sf_dir):
    """Tokens that equal the first word of the note's conversation, where the capitalised tokens are protected already."""
    d = docs(spark, sf_dir)
    known = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("lname").alias("phi_type"), F.regexp_extract("text", "^[A-Za-z0-9]+", 0).alias("value"))
    return PR.add_known(d, S.tokens(d).where(F.col("token").rlike("^[A-Z]")), known)[1].drop("phi_type")


_CTX = f"WITH m AS (SELECT doc_id, start, stop, token FROM ({_sp('[ ,.-]?[A-Za-z]+[ ,.-]?')})), p AS (SELECT doc_id, start, stop FROM ({_sp('[0-9]+')}))"


def _ctx(side: str, cond: str):
    def f(spark, sf_dir):
        d = docs(spark, sf_dir)
        found = S.regex_spans(d, "[ ,.-]?[A-Za-z]+[ ,.-]?").select("doc_id", "start", "stop", "token")
        return FI.beside(found, S.regex_spans(d, "[0-9]+"), side)

    f.__name__ = f"context_{side}"
    query(f"{_CTX} SELECT * FROM m WHERE {cond}")(f)


_L, _R = "EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND p.stop = m.start)", "EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND p.start = m.stop)"
for _s, _c in (("left", _L), ("right", _R), ("left_or_right", f"({_L} OR {_R})"), ("left_and_right", f"{_L} AND {_R}")):
    _ctx(_s, _c)


# ---- span algebra, resolution, masks

_NUM = f"SELECT doc_id, start, stop FROM ({_sp('[0-9][0-9.-]*')}) UNION ALL SELECT doc_id, start, stop FROM ({_sp('[A-Za-z]*[0-9]+[ ]?')})"


def _num(spark, sf_dir):
    d = docs(spark, sf_dir)
    cols = ("doc_id", "start", "stop")
    return S.regex_spans(d, "[0-9][0-9.-]*").select(*cols).unionByName(S.regex_spans(d, "[A-Za-z]*[0-9]+[ ]?").select(*cols))


@query(f"""WITH s AS ({_NUM}),
r AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT doc_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY doc_id, island""")
def span_merge(spark, sf_dir):
    return S.merge(_num(spark, sf_dir))


@query(f"""WITH a AS ({TOK}), b AS ({_NUM}) SELECT doc_id, start, stop FROM a WHERE regexp_matches(token, '^[A-Z]') AND NOT EXISTS (SELECT 1 FROM b
WHERE a.doc_id = b.doc_id AND a.start <= b.stop AND a.stop >= b.start)""")
def span_overlap_antijoin(spark, sf_dir):
    return S.apart_from(S.tokens(docs(spark, sf_dir)).where(F.col("token").rlike("^[A-Z]")), _num(spark, sf_dir)).select("doc_id", "start", "stop")


@query(f"""WITH a AS ({_sp('[^ ]+')}), b AS ({_NUM}) SELECT DISTINCT a.doc_id, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM a
JOIN b ON a.doc_id = b.doc_id AND a.start < b.stop AND a.stop > b.start""")
def span_intersections(spark, sf_dir):
    return S.intersections(S.regex_spans(docs(spark, sf_dir), "[^ ]+"), _num(spark, sf_dir))


@query(f"""WITH a AS ({TOK}), b AS ({_NUM}) SELECT doc_id, start, stop FROM a WHERE regexp_matches(token, '[A-Z0-9]') AND NOT EXISTS (SELECT 1 FROM b
WHERE a.doc_id = b.doc_id AND a.start = b.start)""")
def span_remove(spark, sf_dir):
    return S.removed(S.tokens(docs(spark, sf_dir)).where(F.col("token").rlike("[A-Z0-9]")), _num(spark, sf_dir)).select("doc_id", "start", "stop")


@query(f"WITH {RESOLVED} SELECT doc_id, count(*) AS n, sum(stop - start)::BIGINT AS chars FROM inc GROUP BY doc_id")
def include_exclude_resolution(spark, sf_dir):
    inc, _ = FI.accepted(notes(spark, sf_dir), FLAGSHIP)
    return inc.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("chars"))


@query(f"""WITH {RESOLVED} SELECT doc_id, start, stop, phi_type, substring(text, (start + 1)::BIGINT, (stop - start)::BIGINT) AS word FROM phi
JOIN documents USING (doc_id)""")
def complement_spans(spark, sf_dir):
    d, phi = _phi(spark, sf_dir)
    return S.with_text(phi, d, "word").select("doc_id", "start", "stop", "phi_type", "word")


@query(_masked_sql("'*****'"))
def mask_documents(spark, sf_dir):
    return M.mask_rows(resolved(notes(spark, sf_dir), FLAGSHIP))


@query(_masked_sql("regexp_replace(token, '[A-Za-z0-9*]', '*', 'g')"))
def mask_chars(spark, sf_dir):
    d, phi = _phi(spark, sf_dir)
    return M.mask_chars(d, S.with_text(phi, d))


@query(_masked_sql("'*' || substring(token, 2)"))
def mask_obscured(spark, sf_dir):
    d, phi = _phi(spark, sf_dir)
    return M.obscured(d, S.with_text(phi, d))


@query(_masked_sql("'***' || CASE phi_type WHEN 'OTHER' THEN 'PHI' ELSE phi_type END || '***'"))
def tag_replace(spark, sf_dir):
    return M.mask_rows(resolved(notes(spark, sf_dir), FLAGSHIP), M.tag_put)


@query(f"""WITH {RESOLVED},
n AS (SELECT doc_id, start, stop, phi_type, replace(replace(replace(replace(substring(text, (start + 1)::BIGINT, (stop - start)::BIGINT), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS tok, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop) - 1 AS i
FROM phi JOIN documents USING (doc_id))
SELECT doc_id, string_agg('<' || phi_type || ' id="P' || i || '" start="' || start || '" end="' || stop || '" text="' || tok || '" TYPE="' || phi_type || '" comment="" />', '' ORDER BY i) AS xml
FROM n GROUP BY doc_id""")
def annotation_xml(spark, sf_dir):
    d, phi = _phi(spark, sf_dir)
    return M.annotation_xml(S.with_text(phi, d))


@query(f"""WITH {RESOLVED} SELECT regexp_replace(regexp_replace(substring(text, (start + 1)::BIGINT, (stop - start)::BIGINT), '[0-9]', '`', 'g'), '[A-Za-z]', '?', 'g') AS shape, count(*) AS n
FROM phi JOIN documents USING (doc_id) GROUP BY ALL""")
def shape_template(spark, sf_dir):
    d, phi = _phi(spark, sf_dir)
    return S.with_text(phi, d).groupBy(M.shape(F.col("token")).alias("shape")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shape")


@query(f"""SELECT doc_id, start, translate(substring(text, greatest(start - 25, 0) + 1, least(stop + 25, len(text)) - greatest(start - 25, 0)), chr(10) || chr(9), '  ') AS context,
  substring(text, greatest(start - 16, 0) + 1, start - greatest(start - 16, 0)) || '[[' || token || ']]' || substring(text, stop + 1, 40) AS marked FROM ({_sp(CARD)}) JOIN documents USING (doc_id)""")
def char_context(spark, sf_dir):
    """The text around card numbers, plain and with the number marked."""
    d = docs(spark, sf_dir)
    rows = S.regex_spans(d, CARD).join(d, "doc_id")
    return rows.select("doc_id", "start", S.context_of(F.col("text"), 25).alias("context"), S.marked_context(F.col("text")).alias("marked"))


@query(f"""WITH c AS (SELECT doc_id, nth, token, string_agg(token, ' ') OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS context
FROM ({TOK})) SELECT doc_id, nth, token, context FROM c WHERE regexp_matches(token, '[0-9]')""")
def word_context_window(spark, sf_dir):
    return E.word_context(S.tokens(docs(spark, sf_dir)).select("doc_id", "nth", "token")).where(F.col("token").rlike("[0-9]"))


# ---- keys, paths, probes, words


@query("""SELECT page_id, ltrim(regexp_replace(regexp_extract('/notes/' || lpad(page_id::VARCHAR, 9, '0') || '_utf8.txt', '([^/]*)$', 1), '(_utf8)?(\\.txt|\\.xml)?$', ''), '0') AS note_key
FROM pages""")
def note_key_normalise(spark, sf_dir):
    path = F.concat(F.lit("/notes/"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit("_utf8.txt"))
    return t(spark, sf_dir, "pages").select("page_id", P.note_key(path).alias("note_key"))


@query("""SELECT c_custkey, substring(k, 1, 2) || '/' || substring(k, 3, 3) || '/' || substring(k, 6, 3) || '/' || substring(k, 9, 3) AS path
FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 11, '0') AS k FROM customer)""")
def path_shard(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", P.shard(F.col("c_custkey").cast("string")).alias("path"))


@query("WITH d AS (SELECT c_custkey, sha256(c_custkey::VARCHAR) AS h FROM customer) SELECT c_custkey, " + " || ".join(f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', (('0x' || substring(h, {4 * i + 1}, 4))::INT % 36) + 1, 1)" for i in range(14)) + " || 'B' AS deid_key FROM d")
def random_key(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", P.random_key(F.col("c_custkey")).alias("deid_key"))


@query(r"SELECT doc_id, translate(text, chr(7) || chr(21) || chr(240), '   ') AS text FROM documents")
def control_scrub(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", P.scrub(F.col("text")).alias("text"))


@query("""SELECT c_custkey, kind, value FROM (SELECT c_custkey, 'name' AS kind, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'zip', lpad(c_nationkey::VARCHAR, 5, '0') FROM customer UNION ALL SELECT c_custkey, 'workplace', c_mktsegment
FROM customer)""")
def probe_kinds(spark, sf_dir):
    """Columns of known identifiers unpivoted and folded into kinds."""
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("lname"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("ZIP"), F.col("c_mktsegment").alias("empr_id_cmt"))
    return c.unpivot("c_custkey", ["lname", "ZIP", "empr_id_cmt"], "source", "value").select("c_custkey", P.probe_kind(F.col("source")).alias("kind"), "value")


@query("""WITH v AS (SELECT o_orderkey, upper(n_name) AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT name, count(*) AS n FROM (SELECT DISTINCT o_orderkey, name FROM (SELECT * FROM v UNION ALL SELECT o_orderkey, upper(r_name) FROM v
JOIN nation ON upper(n_name) = v.name JOIN region ON n_regionkey = r_regionkey)) GROUP BY name""")
def nickname_expand(spark, sf_dir):
    """Note to patient to name (two hops), with aliases (the region of a nation) added."""
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    names = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("key"), F.col("n_name").alias("name"))
    alias = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("alias"))
    return P.expand_names(names, alias).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS ({_WORDS}) SELECT word FROM (SELECT word FROM w UNION SELECT lower(n_name) FROM nation) WHERE word NOT IN (SELECT word FROM w
WHERE word LIKE '%tion%')""")
def whitelist_edit(spark, sf_dir):
    w = _word_set(spark, sf_dir)
    return P.edit_words(w, t(spark, sf_dir, "nation").select(F.lower("n_name").alias("word")), w.where("word like '%tion%'"))


@query(f"WITH k AS (SELECT lower(token) AS word, count(*) AS n FROM ({TOK}) GROUP BY 1) SELECT word, n FROM k WHERE n >= 5 AND word NOT IN ({_WORDS})")
def vocabulary_mining(spark, sf_dir):
    """Words often seen that a list lacks."""
    return S.tokens(docs(spark, sf_dir)).groupBy(F.lower("token").alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5").join(_word_set(spark, sf_dir), "word", "left_anti")


_GOLD = f"SELECT doc_id, start, stop, token, CASE WHEN regexp_matches(token, '^[0-9]{{4}}$') THEN 'DATE' WHEN regexp_matches(token, '^[0-9]{{1,3}}$') THEN 'AGE<90' ELSE 'NAME' END AS phi_type FROM ({_sp('[A-Z0-9]{2,}')})"


def _gold(spark, sf_dir):
    kind = F.when(F.col("token").rlike("^[0-9]{4}$"), "DATE").when(F.col("token").rlike("^[0-9]{1,3}$"), "AGE<90").otherwise("NAME")
    return S.regex_spans(docs(spark, sf_dir), "[A-Z0-9]{2,}").select("doc_id", "start", "stop", "token", kind.alias("phi_type"))


@query(f"""SELECT * FROM ({_GOLD})
WHERE NOT ((phi_type = 'DATE' AND regexp_matches(token, '^[0-9]{{4}}$')) OR regexp_matches(token, '^[A-Z]{{1,3}}$') OR (phi_type = 'AGE<90' AND coalesce(try_cast(token AS INT) < 90, false)) OR (phi_type = 'NAME' AND lower(token) = 'id') OR lower(token) = '2001')""")
def curate_gold(spark, sf_dir):
    return P.curate(_gold(spark, sf_dir), spark.createDataFrame([("NAME", "ID"), (None, "2001")], "phi_type string, word string"))


# ---- dates

_ORD = "SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d FROM orders"
_FORMS = ("yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "MMMM d, yyyy", "MMMM yyyy", "MMMM d", "MMMM", "yyyy")


def _orders(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))


def _written_dates(spark, sf_dir):
    form = F.lit(None).cast("string")
    for i, f in enumerate(_FORMS):
        form = F.when(F.col("o_orderkey") % 8 == i, F.date_format("d", f)).otherwise(form)
    return _orders(spark, sf_dir).select("o_orderkey", D.parse(form).alias("p"))


_RENDER = "CASE o_orderkey % 8 WHEN 2 THEN strftime(d, '%m/%d/%y') WHEN 4 THEN strftime(d, '%B %Y') WHEN 5 THEN strftime(d, '%B %d') WHEN 6 THEN strftime(d, '%B') WHEN 7 THEN strftime(d, '%Y') ELSE strftime(d, '%m/%d/%Y') END"


@query(f"""SELECT o_orderkey, {_RENDER} AS rendered, o_orderkey % 8 IN (5, 6) AS missing_year, o_orderkey % 8 IN (4, 6, 7) AS missing_day, o_orderkey % 8 = 2 AS missing_century
FROM ({_ORD})""")
def partial_date_render(spark, sf_dir):
    """Dates written in eight forms, parsed with what they lack, and rendered by what they have."""
    p = F.col("p")
    return _written_dates(spark, sf_dir).select("o_orderkey", D.render(p).alias("rendered"), p["missing_year"].alias("missing_year"), p["missing_day"].alias("missing_day"), p["missing_century"].alias("missing_century"))


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 30 = 0 THEN NULL ELSE d - (o_custkey % 30)::INT END AS shifted FROM ({_ORD})")
def date_shift(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return rows.select("o_orderkey", D.shift(F.col("d"), (F.col("o_custkey") % 30).cast("string")).alias("shifted"))


_AGE = "date_part('year', d) - date_part('year', b) - CASE WHEN d < b + to_years((date_part('year', d) - date_part('year', b))::INT) THEN 1 ELSE 0 END"


@query(f"""WITH x AS (SELECT o_orderkey, d, (DATE '1900-02-28' + (o_custkey * 37 % 30000)::INT) AS b FROM ({_ORD})), y AS (SELECT *, ({_AGE})::INT AS age FROM x)
SELECT o_orderkey, age::INT AS age, CASE WHEN age > 90 THEN '*****' ELSE age::VARCHAR END AS shown, CASE WHEN age > 90 THEN (b + to_years(age - 90))::DATE ELSE b END AS capped
FROM y""")
def age_and_birth_cap(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("b", F.date_add(F.lit("1900-02-28").cast("date"), (F.col("o_custkey") * 37 % 30000).cast("int")))
    age = D.age_on(F.col("b"), F.col("d")).cast("int")
    return rows.select("o_orderkey", age.alias("age"), D.age_substitute(age).alias("shown"), D.capped_birth(F.col("b"), F.col("d")).alias("capped"))


@query("SELECT p_partkey, p_size AS age FROM part")
def age_parse(spark, sf_dir):
    """Sizes written as digits or words, read back."""
    words = F.create_map(*[x for w, n in D.number_words().items() if "one hundred" not in w for x in (F.lit(n), F.lit(w))])
    said = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.initcap(words[F.col("p_size")]))
    return t(spark, sf_dir, "part").select("p_partkey", D.parse_age(said).alias("age"))


@query("SELECT c_custkey, (('0x' || substring(md5(c_custkey::VARCHAR), 1, 7))::INT % 365 + 730)::INT AS date_offset FROM customer")
def fallback_offset(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", D.fallback_offset(F.col("c_custkey")).alias("date_offset"))


@query(f"""WITH g AS (SELECT o_orderkey, d - 10 AS d FROM ({_ORD})), p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN d ELSE d - 10 END AS d FROM ({_ORD}))
SELECT CASE WHEN g.d IS NOT NULL AND p.d IS NOT NULL THEN 'TP' WHEN p.d IS NOT NULL THEN 'FP' ELSE 'FN' END AS label, count(*) AS n FROM g FULL
JOIN p ON g.o_orderkey = p.o_orderkey AND g.d = p.d GROUP BY 1""")
def date_shift_evaluation(spark, sf_dir):
    o = _orders(spark, sf_dir)
    g = o.select("o_orderkey", F.date_sub("d", 10).alias("d"))
    p = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("d")).otherwise(F.date_sub("d", 10)).alias("d"))
    return E.shift_evaluation(g, p, "o_orderkey", "d").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS (SELECT o_orderkey, (o_custkey % 30)::INT AS off, d, o_orderkey % 8 AS k FROM ({_ORD})),
y AS (SELECT o_orderkey, off, k, CASE k WHEN 4 THEN date_trunc('month', d)::DATE WHEN 7 THEN date_trunc('year', d)::DATE WHEN 5 THEN make_date(2000, month(d), day(d)) WHEN 6 THEN make_date(2000, month(d), 1) ELSE d END - off AS m
FROM x)
SELECT o_orderkey, CASE WHEN off = 0 THEN NULL ELSE CASE k WHEN 2 THEN strftime(m, '%m/%d/%y') WHEN 4 THEN strftime(m, '%B %Y') WHEN 5 THEN strftime(m, '%B %d') WHEN 6 THEN strftime(m, '%B') WHEN 7 THEN strftime(m, '%Y') ELSE strftime(m, '%m/%d/%Y') END END AS shifted
FROM y""")
def partial_date_shift(spark, sf_dir):
    """Dates written in eight forms, two of them without a year, shifted by their patient's offset and written by the parts they have."""
    rows = _written_dates(spark, sf_dir).join(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_orderkey")
    return rows.select("o_orderkey", D.render(D.shift_partial(F.col("p"), (F.col("o_custkey") % 30).cast("string"))).alias("shifted"))


_FREE = (
    "concat(date_format(d, 'MMM'), ' ', day(d), ', ', year(d))", "concat(day(d), ' ', date_format(d, 'MMMM'), ' ', year(d))", "date_format(d, 'M/d')", "date_format(d, 'MM-dd-yyyy')", "date_format(d, 'MMMM d yyyy')",
    "date_format(d, 'M/yyyy')", "date_format(d, 'EEEE, MMMM d, yyyy')", "concat(date_format(d, 'MMMM '), day(d), case when day(d) in (1, 21, 31) then 'st' when day(d) in (2, 22) then 'nd' when day(d) in (3, 23) then 'rd' else 'th' end, ', ', year(d))",
    "date_format(d, 'yyyy/MM/dd')", "concat(upper(date_format(d, 'MMM')), '. ', day(d), ', ', year(d))", "concat('the ', day(d), 'th of ', date_format(d, 'MMMM'), ' ', year(d))", "concat(date_format(d, 'dd-MMM-yy'))", "date_format(d, 'yyyy-MM-dd HH:mm:ss')",
    "concat(date_format(d, 'MMMM'), \" '\", date_format(d, 'yy'))", "date_format(d, 'dd.MM.yyyy')", "concat('no ', date_format(d, 'MMMM'), ' day')",
)


@query(f"""SELECT o_orderkey, CASE o_orderkey % 16 WHEN 2 THEN strftime(d, '%B %d') WHEN 5 THEN strftime(d, '%B %Y') WHEN 11 THEN strftime(d, '%m/%d/%y') WHEN 13 THEN strftime(d, '%B %y') WHEN 15 THEN NULL
  WHEN 14 THEN CASE WHEN day(d) > 12 THEN strftime(d, '%m/%d/%Y') ELSE strftime(make_date(year(d), day(d), month(d)), '%m/%d/%Y') END ELSE strftime(d, '%m/%d/%Y') END AS rendered FROM ({_ORD})""")
def date_forms(spark, sf_dir):
    """Dates written in fifteen free forms, and one that is none, read and written by the parts they have."""
    form = F.expr("case pmod(o_orderkey, 16) " + " ".join(f"when {i} then {x}" for i, x in enumerate(_FREE)) + " end")
    return _orders(spark, sf_dir).withColumn("said", form).select("o_orderkey", D.render(D.parse(F.col("said"))).alias("rendered"))


@query(f"SELECT o_orderkey, strftime(d + 12, '%m/%d/%Y') || ' [SHIFTED DATE]-' || strftime(d + 42, '%m/%d/%Y') || ' [SHIFTED DATE]' AS shifted FROM ({_ORD})")
def date_range_shift(spark, sf_dir):
    said = F.concat(F.date_format("d", "M/d/yyyy"), F.lit(" - "), F.date_format(F.date_add("d", 30), "M/d/yyyy"))
    return _orders(spark, sf_dir).select("o_orderkey", D.shift_range(said, F.lit(12)).alias("shifted"))


@query(f"SELECT o_orderkey, o_custkey % 4 <> 0 OR dayofmonth(d) = 1 AS same FROM (SELECT o_orderkey, o_custkey, d FROM ({_ORD}))")
def partial_date_equality(spark, sf_dir):
    """A whole date against itself, its month and year, and its two-digit form; a fourth of them against the first of the month."""
    k = F.col("o_custkey") % 4
    other = F.when(k == 0, F.date_format(F.trunc("d", "month"), "yyyy-MM-dd")).when(k == 1, F.date_format("d", "MMMM yyyy")).when(k == 2, F.date_format("d", "M/d/yy")).otherwise(F.date_format("d", "MMMM d"))
    return _orders(spark, sf_dir).select("o_orderkey", D.same(D.parse(F.date_format("d", "yyyy-MM-dd")), D.parse(other)).alias("same"))


# ---- evaluation

_PRED = f"SELECT doc_id, start, stop FROM ({TOK}) WHERE regexp_matches(token, '[0-9]')"
_LAB = f"""lab AS (SELECT t.doc_id, t.start, t.token, CASE WHEN g.start IS NOT NULL AND p.start IS NOT NULL THEN 'TP' WHEN p.start IS NOT NULL THEN 'FP' WHEN g.start IS NOT NULL THEN 'FN' ELSE 'TN' END AS label
  FROM ({TOK}) t LEFT JOIN (SELECT DISTINCT doc_id, start FROM ({TOK}) WHERE regexp_matches(token, '^[A-Z0-9]{{2,}}$')) g ON t.doc_id = g.doc_id AND t.start = g.start LEFT JOIN (SELECT DISTINCT doc_id, start FROM ({_PRED})) p ON t.doc_id = p.doc_id AND t.start = p.start)"""
_MET = "count(*) FILTER (WHERE label = 'TP') AS tp, count(*) FILTER (WHERE label = 'FP') AS fp, count(*) FILTER (WHERE label = 'FN') AS fn, count(*) FILTER (WHERE label = 'TN') AS tn"
_RATIO = "round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0.0), 6) AS retention"


def _labelled(spark, sf_dir):
    toks = S.tokens(docs(spark, sf_dir))
    return toks, E.confusion(toks, toks.where(F.col("token").rlike("^[A-Z0-9]{2,}$")), toks.where(F.col("token").rlike("[0-9]")))


@query(f"WITH {_LAB}, m AS (SELECT {_MET} FROM lab) SELECT *, {_RATIO} FROM m")
def precision_recall(spark, sf_dir):
    return E.metrics(_labelled(spark, sf_dir)[1])


@query(f"WITH {_LAB}, m AS (SELECT doc_id, {_MET} FROM lab GROUP BY doc_id) SELECT *, {_RATIO} FROM m")
def precision_recall_by_doc(spark, sf_dir):
    return E.metrics(_labelled(spark, sf_dir)[1], "doc_id")


@query(f"""WITH {_LAB}, h AS (SELECT doc_id, start, stop, 'digits' AS title FROM ({_sp('[0-9]+')}) UNION ALL SELECT doc_id, start, stop, 'caps' FROM ({_sp('[A-Z]+')})),
e AS (SELECT lab.*, start + len(token) AS stop FROM lab WHERE label IN ('FP', 'FN')),
p AS (SELECT e.doc_id, e.start, coalesce(string_agg(DISTINCT title, ',' ORDER BY title), '') AS titles FROM e LEFT
JOIN h ON e.doc_id = h.doc_id AND h.start < e.stop AND h.stop > e.start GROUP BY ALL)
SELECT label, lower(token) AS word, {_POS} AS pos, titles, count(*) AS n, min(doc_id) AS first_doc FROM e JOIN p USING (doc_id, start) GROUP BY ALL""")
def error_condensation(spark, sf_dir):
    """Errors that are alike in word, tag and the filters that hit them."""
    d = docs(spark, sf_dir)
    toks, lab = _labelled(spark, sf_dir)
    hits = [S.regex_spans(d, p).select("doc_id", "start", "stop", F.lit(t).alias("title")) for t, p in (("digits", "[0-9]+"), ("caps", "[A-Z]+"))]
    errors = lab.where("label in ('FP', 'FN')").join(toks.select("doc_id", "start", "stop", "token"), ["doc_id", "start"])
    by = E.provenance(errors, hits[0].unionByName(hits[1])).select("doc_id", "start", "titles")
    return E.condensed(lab, errors.select("doc_id", "start", "token", FI.heuristic_pos(F.col("token")).alias("pos")).join(by, ["doc_id", "start"]), "pos", "titles")


@query(f"""WITH g AS (SELECT doc_id, start, stop FROM ({_sp('[A-Z0-9]{2,}')})), p AS (SELECT doc_id, start, stop FROM ({_sp('[0-9]+[A-Za-z]?')})),
c AS (SELECT DISTINCT doc_id, unnest([start, stop]) AS edge FROM (SELECT * FROM g UNION ALL SELECT * FROM p)),
q AS (SELECT doc_id, edge AS start, lead(edge) OVER (PARTITION BY doc_id ORDER BY edge) AS stop FROM c),
r AS (SELECT q.*, EXISTS (SELECT 1 FROM g WHERE g.doc_id = q.doc_id AND q.start >= g.start AND q.stop <= g.stop) AS in_gold, EXISTS (SELECT 1 FROM p
WHERE p.doc_id = q.doc_id AND q.start >= p.start AND q.stop <= p.stop) AS in_pred FROM q WHERE stop IS NOT NULL)
SELECT doc_id, start, stop, in_gold, in_pred FROM r WHERE in_gold OR in_pred""")
def subtoken_alignment(spark, sf_dir):
    d = docs(spark, sf_dir)
    return E.align(S.regex_spans(d, "[A-Z0-9]{2,}"), S.regex_spans(d, "[0-9]+[A-Za-z]?"))


@query(f"""WITH e AS (SELECT doc_id, start, stop FROM ({_sp('[A-Z0-9]{6,}')})), h AS (SELECT doc_id, start, stop, 'card' AS title FROM ({_sp(CARD)})
UNION ALL SELECT doc_id, start, stop, 'digits' FROM ({_sp('[0-9]+')}) UNION ALL SELECT doc_id, start, stop, 'caps' FROM ({_sp('[A-Z]+')}))
SELECT e.doc_id, e.start, e.stop, coalesce(string_agg(DISTINCT title, ',' ORDER BY title), '') AS titles FROM e LEFT
JOIN h ON e.doc_id = h.doc_id AND h.start < e.stop AND h.stop > e.start GROUP BY ALL""")
def error_provenance(spark, sf_dir):
    d = docs(spark, sf_dir)
    hits = None
    for title, p in (("card", CARD), ("digits", "[0-9]+"), ("caps", "[A-Z]+")):
        x = S.regex_spans(d, p).select("doc_id", "start", "stop", F.lit(title).alias("title"))
        hits = x if hits is None else hits.unionByName(x)
    return E.provenance(S.regex_spans(d, "[A-Z0-9]{6,}"), hits)


@query(f"WITH a AS ({_sp('[^ ' + chr(9) + '-' + chr(13) + ']+', '(SELECT doc_id, regexp_replace(text, $$[0-9]$$, $$*$$, $$g$$) AS text FROM documents)')}), b AS ({_sp('[^ ' + chr(9) + '-' + chr(13) + ']+', '(SELECT doc_id, regexp_replace(text, $$[0-9A-F]$$, $$*$$, $$g$$) AS text FROM documents)')})" + ", lab AS (SELECT CASE WHEN contains(b.token, '*') AND contains(a.token, '*') THEN 'TP' WHEN contains(a.token, '*') THEN 'FP' WHEN contains(b.token, '*') THEN 'FN' ELSE 'TN' END AS label FROM a JOIN b USING (doc_id, nth)) SELECT label, count(*) AS n FROM lab GROUP BY label")
def mask_evaluation(spark, sf_dir):
    """Two maskings of the same texts, token by token."""
    d = docs(spark, sf_dir)
    a, b = (d.select("doc_id", F.regexp_replace("text", p, "*").alias("text")) for p in ("[0-9]", "[0-9A-F]"))
    return E.compare_masks(a, b).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_TWO = f"a AS (SELECT doc_id, start, CASE WHEN regexp_matches(token, '[0-9]') THEN 'ID' ELSE 'NAME' END AS label FROM ({_sp('[A-Z0-9]{2,}')})), b AS (SELECT doc_id, start, 'ID' AS label FROM ({_sp('[A-Z]*[0-9]+')})), pairs AS (SELECT coalesce(a.label, 'O') AS one, coalesce(b.label, 'O') AS two, count(*) AS n FROM a FULL JOIN b USING (doc_id, start) GROUP BY ALL)"


def _annotators(spark, sf_dir):
    d = docs(spark, sf_dir)
    a = S.regex_spans(d, "[A-Z0-9]{2,}").select("doc_id", "start", F.when(F.col("token").rlike("[0-9]"), "ID").otherwise("NAME").alias("label"))
    return E.annotators(a, S.regex_spans(d, "[A-Z]*[0-9]+").select("doc_id", "start", F.lit("ID").alias("label")))


@query(f"WITH {_TWO} SELECT * FROM pairs")
def annotator_pairs(spark, sf_dir):
    """Two labelings of the same texts, place by place, counted as a confusion matrix."""
    return _annotators(spark, sf_dir)


@query(f"""WITH {_TWO}, k AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE one = two) AS same FROM pairs), m AS (SELECT sum(x.n::DOUBLE * y.n) AS chance
FROM (SELECT one AS l, sum(n) AS n FROM pairs GROUP BY 1) x JOIN (SELECT two AS l, sum(n) AS n FROM pairs GROUP BY 1) y USING (l))
SELECT n::BIGINT AS n, round(same / n, 6) AS agreed, round(chance / n / n, 6) AS expected, round((same / n - chance / n / n) / (1 - chance / n / n), 6) AS kappa
FROM k, m""")
def annotator_agreement(spark, sf_dir):
    """How far two labelings agree, beyond chance."""
    return E.agreement(_annotators(spark, sf_dir))


_STAR = r"(SELECT doc_id, regexp_replace(text, $$[{}]$$, $$*$$, $$g$$) AS text FROM documents)"


@query(f"""WITH n AS ({_sp('[^ ' + chr(9) + '-' + chr(13) + ']+', _STAR.format('0-9'))}), a AS ({_sp('[^ ' + chr(9) + '-' + chr(13) + ']+', _STAR.format('0-9A-F'))}),
j AS (SELECT n.token AS n, a.token AS a FROM n JOIN a USING (doc_id, nth) WHERE regexp_matches(n.token, '[A-Za-z0-9*]')),
g AS (SELECT 'TP' AS label, n AS word FROM j WHERE contains(a, '*') AND n = a UNION ALL SELECT 'TN', n FROM j WHERE NOT contains(a, '*')
UNION ALL SELECT 'FN', n FROM j WHERE contains(a, '*') AND n <> a AND NOT regexp_matches(a, '[A-Za-z0-9]')
 UNION ALL SELECT 'FN', unnest(list_filter(string_split(array_to_string(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN n[i] = a[i] THEN ' ' ELSE n[i] END), ''), ' '), lambda w: w <> '')) FROM j WHERE contains(a, '*') AND n <> a AND regexp_matches(a, '[A-Za-z0-9]'))
SELECT label, word, count(*) AS n FROM g GROUP BY ALL""")
def graded_masks(spark, sf_dir):
    """Digits masked, against digits and A to F masked: tokens masked in part are graded by runs of characters."""
    d = docs(spark, sf_dir)
    n, a = (d.select("doc_id", F.regexp_replace("text", p, "*").alias("text")) for p in ("[0-9]", "[0-9A-F]"))
    return E.graded_masks(n, a).groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))


#: Gold labels with tags of a corpus: numbers are ages, capitals cities, and what holds both a tag that doesn't count.
_TAGGED = f"SELECT label, lab.token, CASE WHEN label IN ('TP', 'FN') THEN CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'AGE' WHEN regexp_matches(token, '^[A-Z]+$') THEN 'CITY' ELSE 'JOB' END END AS tag FROM lab"


def _tagged(spark, sf_dir):
    toks, lab = _labelled(spark, sf_dir)
    tag = F.when(F.col("token").rlike("^[0-9]+$"), "AGE").when(F.col("token").rlike("^[A-Z]+$"), "CITY").otherwise("JOB")
    return lab.join(toks.select("doc_id", "start", "token"), ["doc_id", "start"]).withColumn("tag", F.when(F.col("label").isin("TP", "FN"), tag))


@query(f"""WITH {_LAB}, k AS ({_TAGGED}),
c AS (SELECT CASE WHEN label = 'TP' AND tag = 'JOB' THEN 'FP' WHEN label = 'FN' AND (tag = 'JOB' OR (tag = 'AGE' AND NOT coalesce(try_cast(token AS HUGEINT) >= 90, contains(token, 'ninety')))) THEN 'TN' ELSE label END AS label
FROM k), m AS (SELECT {_MET} FROM c) SELECT *, {_RATIO} FROM m""")
def corrected_recall(spark, sf_dir):
    return E.metrics(E.corrected(_tagged(spark, sf_dir), E.tag_table(spark)))


@query(f"""WITH {_LAB}, k AS (SELECT *, CASE tag WHEN 'AGE' THEN 'Age' WHEN 'CITY' THEN 'Location' ELSE 'Other' END AS category FROM ({_TAGGED})
WHERE label IN ('TP', 'FN')), g AS (SELECT category, tag, count(*) FILTER (WHERE label = 'TP') AS tp, count(*) FILTER (WHERE label = 'FN') AS fn
FROM k GROUP BY ROLLUP (category, tag)) SELECT *, round(tp / (tp + fn), 6) AS recall FROM g""")
def tag_recall(spark, sf_dir):
    return E.tag_recall(_tagged(spark, sf_dir), E.tag_table(spark))


@query(f"""WITH {_LAB}, k AS ({_TAGGED}),
w AS (SELECT label, unnest(CASE tag WHEN 'AGE' THEN ['patient'] WHEN 'CITY' THEN ['patient', 'provider'] ELSE [] END) AS "of" FROM k
WHERE label IN ('TP', 'FN')), g AS (SELECT "of", count(*) FILTER (WHERE label = 'TP') AS tp, count(*) FILTER (WHERE label = 'FN') AS fn FROM w
GROUP BY 1) SELECT *, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall FROM g""")
def group_recall(spark, sf_dir):
    """Recall of what identifies patients, and of what identifies providers."""
    return E.group_recall(_tagged(spark, sf_dir), E.tag_table(spark))


_TYPED = " UNION ALL ".join(f"SELECT doc_id, start, stop, '{k}' AS phi_type FROM ({_sp(p)})" for k, p in (("ID", "[0-9]+"), ("NAME", "[A-Z][A-Za-z]*"), ("PROBEREGEX", "[a-z]{10,}")))
_TT = f"tt AS (SELECT a.doc_id, a.start, a.stop, string_agg(DISTINCT phi_type, ',' ORDER BY phi_type) AS types FROM ({TOK}) a JOIN ({_TYPED}) b ON a.doc_id = b.doc_id AND a.start < b.stop AND a.stop > b.start GROUP BY ALL)"


def _typed(d):
    rows = [S.regex_spans(d, p).select("doc_id", "start", "stop", F.lit(k).alias("phi_type")) for k, p in (("ID", "[0-9]+"), ("NAME", "[A-Z][A-Za-z]*"), ("PROBEREGEX", "[a-z]{10,}"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {_TT} SELECT * FROM tt")
def token_types(spark, sf_dir):
    d = docs(spark, sf_dir)
    return E.token_types(S.tokens(d), _typed(d))


_RANKED = ("PROBEREGEX", "NAME")


@query(f"""WITH r AS (SELECT a.doc_id, a.start, a.stop, phi_type, CASE phi_type WHEN 'PROBEREGEX' THEN 0 WHEN 'NAME' THEN 1 ELSE 2 END AS k FROM ({TOK}) a
JOIN ({_TYPED}) b ON a.doc_id = b.doc_id AND a.start < b.stop AND a.stop > b.start) SELECT doc_id, start, stop, arg_min(phi_type, k) AS phi_type
FROM r GROUP BY ALL""")
def first_type(spark, sf_dir):
    """One type a token: the first in an order of types."""
    d = docs(spark, sf_dir)
    return E.first_type(S.tokens(d), _typed(d), _RANKED)


@query(f"""WITH {_TT} SELECT doc_id, start, stop, types, substring(text, (start + 1)::BIGINT, (stop - start)::BIGINT) AS probe, translate(substring(text, greatest(start - 10, 0) + 1, least(stop + 10, len(text)) - greatest(start - 10, 0)), chr(10) || chr(9), '  ') AS context
FROM tt JOIN documents USING (doc_id) WHERE types IN ('PROBEDYNAMICSET', 'PROBEREGEX')""")
def probe_report(spark, sf_dir):
    """Tokens that only known identifiers protect."""
    d = docs(spark, sf_dir)
    return E.probe_report(d, S.tokens(d), _typed(d))


_DIGITLESS = r"(SELECT doc_id, regexp_replace(text, '[A-Za-z]*[0-9]+[A-Za-z]*', '*', 'g') AS text FROM documents)"


@query(f"""WITH o AS (SELECT doc_id, nth, token, string_agg(token, ' ') OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS context
FROM ({TOK})), s AS (SELECT DISTINCT doc_id, token FROM ({_sp(S.TOKEN, _DIGITLESS)}))
SELECT doc_id, nth, token, context FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = o.doc_id AND s.token = o.token)""")
def masked_words(spark, sf_dir):
    """Words of a text that its masked form lacks, in context."""
    d = docs(spark, sf_dir)
    return E.absent_words(d, d.select("doc_id", F.regexp_replace("text", "[A-Za-z]*[0-9]+[A-Za-z]*", "*").alias("text")))


@query(f"""WITH f AS ({_sp('[0-9]+')}), g AS ({_sp('[A-Z0-9]{2,}')}) SELECT doc_id, start, stop FROM f WHERE NOT EXISTS (SELECT 1 FROM g
WHERE g.doc_id = f.doc_id AND g.start <= f.start AND g.stop >= f.stop)""")
def not_annotated(spark, sf_dir):
    """Found spans that lie within no annotation."""
    d = docs(spark, sf_dir)
    return E.not_annotated(S.regex_spans(d, "[0-9]+").select("doc_id", "start", "stop"), S.regex_spans(d, "[A-Z0-9]{2,}"))


# ---- the whole job


def _job(spark, sf_dir):
    listed = [Pattern("known", "dynamic_set", True, "PROBEDYNAMICSET"), *FLAGSHIP[:-1], Pattern("year", "regex", True, "DATE", YEAR), Pattern("age", "regex", True, "AGE<90", AGED), FLAGSHIP[-1]]
    meta = t(spark, sf_dir, "documents").select("doc_id", F.expr("int(doc_id % 700) + 365").alias("date_offset"), F.lit("1950-06-01").alias("birth_date"))
    return deidentify(notes(spark, sf_dir), listed, _probes(spark, sf_dir), meta)


_KNOWN = f"SELECT t.doc_id, start, stop, 'PROBEDYNAMICSET' AS phi_type FROM ({TOK}) t WHERE EXISTS (SELECT 1 FROM ({_PROBE_WORDS}) p WHERE p.doc_id = t.doc_id AND p.word = lower(t.token))"
_READ = " UNION ALL ".join(f"SELECT doc_id, start, stop, token, '{k}' AS phi_type FROM ({_sp(p)})" for k, p in (("DATE", YEAR), ("AGE<90", AGED)))
#: The job's resolution, and norms: what is read, with its replacement. A year is moved by the offset; that of birth with the birth date.
_JOB = f"""{_resolved_sql(f"{_EXC} UNION ALL {_KNOWN} UNION ALL SELECT doc_id, start, stop, phi_type FROM ({_READ})")},
norms AS (
  SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM exc k WHERE k.phi_type = 'PROBEDYNAMICSET' AND k.doc_id = r.doc_id AND k.start = r.start) THEN NULL
                   WHEN r.phi_type = 'AGE<90' THEN token
                   ELSE strftime(CASE WHEN token = '1950' THEN DATE '1950-06-01' ELSE make_date(token::INT, 1, 1) END - (doc_id % 700 + 365)::INT, '%Y') END AS put
  FROM ({_READ}) r)"""


@query(f"""WITH {_JOB},
p AS (SELECT phi.doc_id, phi.start, phi.stop, n.stop AS upto, n.put FROM phi LEFT JOIN norms n ON n.doc_id = phi.doc_id AND n.start = phi.start AND n.put IS NOT NULL),
parts AS (
  SELECT doc_id, start, coalesce(upto, stop) AS stop, coalesce(put, '*****') AS put FROM p
  UNION ALL SELECT doc_id, upto, stop, '*****' FROM p WHERE upto < stop),
o AS (SELECT x.*, d.text, coalesce(lag(x.stop) OVER (PARTITION BY x.doc_id ORDER BY x.start), 0) AS before FROM parts x JOIN documents d USING (doc_id)),
j AS (SELECT doc_id, string_agg(substring(text, (before + 1)::BIGINT, (start - before)::BIGINT) || put, '' ORDER BY start) AS head, max(stop) AS last
FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(head || substring(text, (last + 1)::BIGINT), text) AS text FROM documents d LEFT JOIN j USING (doc_id)""")
def deidentify_documents(spark, sf_dir):
    """Filters, known identifiers, surrogate dates and ages, and masks in one plan."""
    return _job(spark, sf_dir).masked


@query(f"""WITH {_JOB},
n AS (SELECT doc_id, count(*) FILTER (WHERE phi_type = 'DATE') AS parsed, count(*) FILTER (WHERE phi_type = 'DATE' AND put IS NOT NULL) AS put
FROM norms GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n FROM phi GROUP BY doc_id)
SELECT doc_id, strlen(text)::BIGINT AS file_size, coalesce(a.n, 0) AS total_tokens, coalesce(b.n, 0) AS phi_tokens,
  coalesce(parsed, 0) AS successfully_normalized, 0::BIGINT AS failed_normalized, coalesce(put, 0) AS successfully_surrogated, coalesce(parsed - put, 0) AS failed_surrogated
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def deidentify_log(spark, sf_dir):
    """One row per note: sizes, tokens, protected tokens, dates read and shifted."""
    return _job(spark, sf_dir).logs()["detailed_batch_summary"]


@query(f"WITH {_JOB} SELECT phi_type, count(*) AS n FROM norms WHERE put IS NOT NULL GROUP BY phi_type")
def surrogate_counts(spark, sf_dir):
    """Dates and ages that have a replacement, by type."""
    return R.surrogate_counts(_job(spark, sf_dir).norms)


# ---- reports


@query(f"WITH {RESOLVED} SELECT phi_type, count(*) AS n FROM phi GROUP BY phi_type")
def phi_type_counts(spark, sf_dir):
    return FI.protected(notes(spark, sf_dir), FLAGSHIP).groupBy("phi_type").agg(F.count(F.lit(1)).alias("n"))


_SUM = f"""{RESOLVED}, summary AS (SELECT d.doc_id, strlen(d.text)::BIGINT AS file_size, coalesce(a.n, 0)::BIGINT AS total_tokens, coalesce(b.n, 0)::BIGINT AS phi_tokens FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM phi GROUP BY 1) b USING (doc_id))"""


@query(f"""WITH {_LAB}, e AS (SELECT * FROM lab WHERE label <> 'TN') SELECT doc_id, label, count(*) AS n, string_agg(token, ' ' ORDER BY start) AS words FROM e
GROUP BY doc_id, label""")
def label_lists(spark, sf_dir):
    """The words of each label, note by note."""
    toks, lab = _labelled(spark, sf_dir)
    rows = lab.where("label <> 'TN'").join(toks.select("doc_id", "start", "token"), ["doc_id", "start"])
    return E.listed(rows, "doc_id").withColumn("words", F.array_join("words", " "))


@query(f"""WITH {RESOLVED} SELECT count(DISTINCT regexp_replace(regexp_replace(substring(text, (start + 1)::BIGINT, (stop - start)::BIGINT), '[0-9]', '`', 'g'), '[A-Za-z]', '?', 'g')) AS n_shapes, count(*) AS n
FROM phi JOIN documents USING (doc_id)""")
def distinct_shapes(spark, sf_dir):
    rows = resolved(notes(spark, sf_dir), FLAGSHIP, words=True).select(F.inline("protected"))
    return R.distinct_shapes(rows.select(M.shape(F.col("token")).alias("shape")))


@query("""WITH u AS (SELECT doc_id, ('0x' || substring(md5(doc_id::VARCHAR), 1, 7))::INT / 268435456.0::DOUBLE AS u FROM documents)
SELECT doc_id, CASE WHEN u < 24 / 66.0::DOUBLE THEN 'a' WHEN u < 38 / 66.0::DOUBLE THEN 'b' WHEN u < 52 / 66.0::DOUBLE THEN 'c' ELSE 'd' END AS part
FROM u""")
def weighted_split(spark, sf_dir):
    """Notes dealt to four parts by weight."""
    return P.weighted_split(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"a": 24, "b": 14, "c": 14, "d": 14})


@query(f"WITH {_SUM} SELECT * FROM summary")
def doc_summary(spark, sf_dir):
    d, phi = _phi(spark, sf_dir)
    return R.doc_summary(d, S.tokens(d), phi)


@query(f"""WITH {_SUM} SELECT count(*) AS n_docs, round(sum(file_size) / 1000, 3) AS kilobytes, sum(total_tokens)::BIGINT AS tokens, sum(phi_tokens)::BIGINT AS phi_tokens, round(quantile_cont(total_tokens, 0.5), 4) AS median_tokens,
round(quantile_cont(phi_tokens, 0.5), 4) AS median_phi, round(quantile_cont(phi_tokens, 0.025), 4) AS low_phi, round(quantile_cont(phi_tokens, 0.975), 4) AS high_phi FROM summary""")
def batch_summary(spark, sf_dir):
    return R.batch_summary(doc_summary(spark, sf_dir))


_PHI_TOK = f"{RESOLVED}, flagged AS (SELECT tok.*, EXISTS (SELECT 1 FROM phi WHERE phi.doc_id = tok.doc_id AND phi.start < tok.stop AND phi.stop > tok.start) AS phi FROM tok)"


def _flagged(spark, sf_dir):
    d, phi = _phi(spark, sf_dir)
    toks = S.tokens(d)
    held = E.token_types(toks, phi).select("doc_id", "start", F.lit(True).alias("phi"))
    return toks.join(held, ["doc_id", "start"], "left").withColumn("phi", F.coalesce("phi", F.lit(False)))


@query(f"WITH {_PHI_TOK} SELECT lower(token) AS word, count(*) AS n, count(*) FILTER (WHERE phi) AS n_phi FROM flagged GROUP BY 1")
def unigram_freq(spark, sf_dir):
    return R.word_counts(_flagged(spark, sf_dir))


@query(f"""WITH {_PHI_TOK}, b AS (SELECT lower(token) AS word, lower(lead(token) OVER w) AS next_word, phi AND lead(phi) OVER w AS pair
FROM flagged WINDOW w AS (PARTITION BY doc_id ORDER BY nth)) SELECT word, next_word, count(*) AS n, count(*) FILTER (WHERE pair) AS n_phi FROM b
WHERE next_word IS NOT NULL GROUP BY ALL""")
def bigram_freq(spark, sf_dir):
    return R.bigrams(_flagged(spark, sf_dir))


@query("WITH r AS (SELECT unnest(range(20))::INT AS replicate), u AS (SELECT replicate, n_chars, ('0x' || substring(md5(replicate::VARCHAR || ':' || doc_id::VARCHAR), 1, 7))::INT / 268435456.0::DOUBLE AS u FROM documents, r), w AS (SELECT *, " + " + ".join(f"(u >= {x})::INT" for x in R.POISSON) + " AS w FROM u) SELECT replicate, sum(w)::BIGINT AS n, sum(w * n_chars)::BIGINT AS total FROM w GROUP BY replicate")
def bootstrap(spark, sf_dir):
    return R.bootstrap(t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 20)


_JOB_EXC = " UNION ALL ".join(f"SELECT doc_id, start, stop, '{k}' AS phi_type FROM ({_sp(p)})" for k, p in (("DATE", YEAR), ("AGE<90", AGED)))


@query(f"""WITH j AS ({_JOB_EXC}), k AS (SELECT phi_type, phi_type = 'AGE<90' OR (substring(text, (start + 1)::BIGINT, 4) <> '0000') AS read FROM j
JOIN documents USING (doc_id))
SELECT phi_type, count(*) FILTER (WHERE read) AS parsed, count(*) FILTER (WHERE NOT read) AS failed, 0::BIGINT AS replaced FROM k GROUP BY phi_type""")
def parse_outcomes(spark, sf_dir):
    """Dates and ages that could be read, by type; without metadata none is replaced."""
    return R.parse_outcomes(deidentify(notes(spark, sf_dir), [Pattern("year", "regex", True, "DATE", YEAR), Pattern("age", "regex", True, "AGE<90", AGED)]).norms)


@query("SELECT role, (max(turn) + 1)::BIGINT AS next_run FROM conversations GROUP BY role")
def next_run(spark, sf_dir):
    """The number of the next run of each batch."""
    return R.next_run(t(spark, sf_dir, "conversations").withColumnRenamed("turn", "run"), "role")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_batches(spark, sf_dir):
    return R.batches(t(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT d.doc_id, c.turn, d.lang FROM conversations c JOIN documents d ON c.conv_id = d.doc_id WHERE c.role = 'user'")
def batch_notes(spark, sf_dir):
    """A batch of keys joined to its notes."""
    batch = t(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), "turn")
    return P.batch_notes(batch, t(spark, sf_dir, "documents").select("doc_id", "lang"))


@query("""SELECT o_orderkey AS note_key, p.date_offset FROM orders LEFT JOIN (SELECT c_custkey, max(c_nationkey)::INT AS date_offset FROM customer
WHERE c_acctbal > 0 GROUP BY 1) p ON o_custkey = c_custkey""")
def metadata_left_join(spark, sf_dir):
    """Notes with their patient's offset, where there is one."""
    patients = t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("patient_ID"), F.col("c_nationkey").alias("date_offset"))
    return P.note_offsets(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_key"), F.col("o_custkey").alias("patient_ID")), patients)


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT conv_id AS doc_id FROM conversations)
SELECT doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'first' ELSE 'second' END AS side
FROM a FULL JOIN b USING (doc_id)""")
def key_sets(spark, sf_dir):
    """Keys in both of two sets, and keys in one only."""
    return P.key_sets(t(spark, sf_dir, "documents"), t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id::VARCHAR) LIMIT 25")
def sample_notes(spark, sf_dir):
    """A seeded sample of k notes: the limit is the operator."""
    return t(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))).limit(25)


_LITERAL = r"SELECT doc_id, text, regexp_extract(text, '[a-z]+[.,] ?[A-Za-z]') AS value FROM documents"


@query(f"""WITH v AS ({_LITERAL}), g AS (SELECT doc_id, value, len(value) AS n, string_split(text, value) AS gs FROM v WHERE value <> ''),
x AS (SELECT doc_id, value, n, unnest(gs[1:len(gs) - 1]) AS gap, unnest(range(len(gs) - 1)) AS nth FROM g),
y AS (SELECT doc_id, value, n, sum(len(gap) + n) OVER (PARTITION BY doc_id ORDER BY nth) AS stop FROM x)
SELECT doc_id, value, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM y""")
def literal_search(spark, sf_dir):
    """Where each note holds its first sentence end, searched for as it stands, full stop included."""
    d = docs(spark, sf_dir)
    return S.literal_spans(d, d.select("doc_id", F.regexp_extract("text", r"[a-z]+[.,] ?[A-Za-z]", 0).alias("value")))
