"""License scan by ordered signature rules.

A text is read as lower-case words in angle brackets, ``<under><the><mit>``, so
that a rule's regular expression starts and ends with words. Rules
(``license_rules``) are gated twice: a text without any rule's first keyword is
passed over after one search, and a rule is applied only where all its keywords
are among the words. A detection is the span of words that a rule matches.

Detections are then resolved in order of place: one whose span lies within that
of another of the same or a better priority is suppressed (of equal spans the
earlier rule goes), so a bare title gives way to the notice around it. Spans
that only overlap both stay. Base phrases (priority 0) always stay.

A document's detections stay small rows of their own; texts are never shuffled.
All is one pass over whole texts in the JVM, plus a window by document over the
detections.

Defined results: a null text is empty: no words, no labels, score 0. Repeated
rows are scanned each for itself; null ids are kept. An empty table gives an
empty result. Characters beyond ASCII are parts of words.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, stored, texts
from .license_rules import RULES

#: What parts words once A-Z are lower-case, and before.
PARTING = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
PARTING_RAW = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = "struct<rule:int,priority:int,label:string,confidence:double,start:bigint,end:bigint>"


def _gate(rules: list[tuple]) -> str:
    """Finds any rule's first keyword in a text as it is, by first letters."""
    by_letter = defaultdict(set)
    for _, _, _, keywords, _, _ in rules:
        by_letter[keywords[0][0]].add(keywords[0][1:])
    found = "|".join(f"{a}(?:{'|'.join(sorted(rest))})" for a, rest in sorted(by_letter.items()))
    return f"(?i)(?<![^{PARTING_RAW}])(?:{found})(?![^{PARTING_RAW}])"


def bracketed(text: Column) -> Column:
    """The words of a text in lower case, each in angle brackets."""
    return F.regexp_replace(F.translate(text, UPPER, LOWER), f"[{PARTING}]*([^{PARTING}]+)[{PARTING}]*", "<$1>")


def _spans(words: Column, rule: Column) -> Column:
    """The places where a rule matches, in words."""
    marked = F.split(F.regexp_replace(words, rule["pattern"], F.lit("{$0}")), "<")
    places = lambda mark: F.filter(F.transform(marked, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())
    return F.transform(F.arrays_zip(places("{").alias("start"), places("}").alias("end")), lambda x: F.struct(
        rule["rule"].alias("rule"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"),
        x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))


def _found(text: Column, rules: list[tuple]) -> Column:
    """All detections of a text that passed the gate."""
    every = F.array(*[F.struct(
        F.lit(n).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.array(*map(F.lit, keys)).alias("keys"),
        F.lit(pattern).alias("pattern"), F.lit(c).alias("confidence")) for n, p, label, keys, pattern, c in rules])
    keywords = "|".join(sorted({k for r in rules for k in r[3]}))
    # One-element arrays bind the words and the keywords among them to names.
    named = F.transform(F.transform(F.array(bracketed(text)), lambda w: F.struct(
        w.alias("words"), F.array_distinct(F.regexp_extract_all(w, F.lit(f"<({keywords})>"), F.lit(1))).alias("present"))), lambda b: F.flatten(F.transform(
            F.filter(every, lambda r: F.forall(r["keys"], lambda k: F.array_contains(b["present"], k)) & F.rlike(b["words"], r["pattern"])),
            lambda r: _spans(b["words"], r))))
    return named[0]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """(row, doc_id, n_words, found) of every document; ``found`` holds all
    places where a rule matches, from word ``start`` up to before word ``end``."""
    words = F.regexp_count("text", F.lit(f"[^{PARTING_RAW}]+")).cast("long")
    return stored(texts(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("n_words"),
        F.when(F.rlike("text", F.lit(_gate(rules))), _found(F.col("text"), rules)).otherwise(F.array().cast(f"array<{SPAN}>")).alias("found")), "licenses")


def detections(scan: DataFrame) -> DataFrame:
    """One row per detection of ``scanned`` texts: row, doc_id, rule, priority,
    label, confidence, start, end, kept."""
    rows = scan.select("row", "doc_id", F.explode("found").alias("f")).select("row", "doc_id", "f.*")
    # Whatever encloses a span comes before it in this order.
    before = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    worst = max(r[1] for r in RULES)
    reach = F.array(*[F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before) for p in range(worst + 1)])
    return (rows.withColumn("reach", F.element_at(reach, F.least("priority", F.lit(worst)) + 1))
            .withColumn("kept", (F.col("priority") == 0) | (F.coalesce("reach", F.lit(-1)) < F.col("end"))).drop("reach"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, n_detections (kept), score (of the surest kept detection)."""
    scan = scanned(docs, id_col, text_col)
    base = F.col("priority") == 0
    listed = lambda flag: F.array_join(F.sort_array(F.collect_set(F.when(flag, F.col("label")))), ",")
    per_row = detections(scan).groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("kept")).alias("labels"), F.count_if("kept").alias("n_detections"),
        F.max(F.when(F.col("kept"), F.col("confidence"))).alias("score"))
    rest = scan.where(F.size("found") == 0).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0).cast("long").alias("n_detections"), F.lit(0.0).alias("score"))
    return scan.where(F.size("found") > 0).select("row", "doc_id", "n_words").join(per_row, "row").select(rest.columns).union(rest)


def op11_licenses(spark, sf_dir):
    return scan_licenses(load(spark, sf_dir, "documents"))


def _sql() -> str:
    rules = ",\n    ".join(f"({n}, {p}, '{label}', {keys}, '{pattern}', {c}::DOUBLE)" for n, p, label, keys, pattern, c in RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), w AS (
  SELECT row, doc_id, len(regexp_extract_all(t, '[^{PARTING}]+')) AS n_words,
         regexp_replace(t, '[{PARTING}]*([^{PARTING}]+)[{PARTING}]*', '<\1>', 'g') AS words
  FROM d
), rules(rule, priority, label, keys, pattern, confidence) AS (
  VALUES {rules}
), m AS (
  SELECT row, rule, priority, label, confidence, string_split(regexp_replace(words, '(' || pattern || ')', '{{\1}}', 'g'), '<') AS pieces
  FROM w JOIN rules ON list_bool_and(list_transform(keys, lambda k: contains(words, '<' || k || '>')))
  WHERE regexp_matches(words, pattern)
), s AS (
  SELECT row, rule, priority, label, confidence,
         unnest(list_filter(range(len(pieces)), lambda i: contains(pieces[i + 1], '{{'))) AS begin_,
         unnest(list_filter(range(len(pieces)), lambda i: contains(pieces[i + 1], '}}'))) AS end_
  FROM m
), k AS (
  SELECT *, priority = 0 OR NOT EXISTS (
    SELECT 1 FROM s AS o WHERE o.row = s.row AND o.begin_ <= s.begin_ AND o.end_ >= s.end_
      AND (o.priority, CASE WHEN o.begin_ = s.begin_ AND o.end_ = s.end_ THEN o.rule ELSE -1 END)
        < (s.priority, CASE WHEN o.begin_ = s.begin_ AND o.end_ = s.end_ THEN s.rule ELSE 0 END)) AS kept
  FROM s
), r AS (
  SELECT row, count(*) FILTER (priority = 0) AS n_base, min(begin_) FILTER (priority = 0) AS first_word, max(begin_) FILTER (priority = 0) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (priority = 0)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (kept)), ',') AS labels,
         count(*) FILTER (kept) AS n_detections, max(confidence) FILTER (kept) AS score
  FROM k GROUP BY row
)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(n_detections, 0) AS n_detections, coalesce(score, 0::DOUBLE) AS score
FROM w LEFT JOIN r USING (row)
"""


SQL = _sql()
QUERIES = {"op11_licenses": op11_licenses}
ORACLES = {"op11_licenses": SQL}
