"""Host-level quality rules: document rules, failure rates by host shrunk with an empirical beta prior, and the
host verdicts joined back. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SPACE = "[ \\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside a window of 5 words that stands twice or more in the text.

    Windows are compared by a 64-bit hash first; only texts in which a hash repeats go on, and there the
    windows themselves decide, so a hash that two windows share does no harm.
    """
    w = WINDOW
    df = df.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    last = F.size("hashes") - w
    at = lambda i: [F.get("hashes", i + k) for k in range(w)]
    df = df.withColumn("windows", F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*at(i)))))
    none = F.array().cast("array<struct<w:bigint,p:int>>")
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("w"), i.alias("p"))))
    df = df.withColumn("found", F.when(some, pairs).otherwise(none)).drop("hashes", "windows")
    twin = lambda name: lambda x, i: (F.get(name, i - 1)["w"] == x["w"]) | (F.get(name, i + 1)["w"] == x["w"])
    df = df.withColumn("likely", F.filter("found", lambda x, i: F.coalesce(twin("found")(x, i), F.lit(False)))).drop("found")
    text = lambda p: F.array_join(F.slice("words", p + 1, w), " ")
    df = df.withColumn("spelt", F.array_sort(F.transform("likely", lambda x: F.struct(text(x["p"]).alias("w"), x["p"].alias("p"))))).drop("likely")
    same = F.filter("spelt", lambda x, i: F.coalesce(twin("spelt")(x, i), F.lit(False)))
    df = df.withColumn("places", F.sort_array(F.transform(same, lambda x: x["p"]))).drop("spelt")
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(w), p - a["last"])).alias("n"), p.alias("last"))
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-w).alias("last")), step, lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("places")


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, per row.

    A null text has no words, so it fails. Any length of text is measured whole.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(*keep, text.alias("text")).select(*keep, "text", words_of(F.col("text")).alias("words"))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")))
    df = df.select(
        *keep,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    df = _repeated(df).drop("words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_rates(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """host, n_docs, n_failed, rate, shrunk: rates drawn towards the mean of all hosts.

    The beta prior's mean is the overall failure rate; its weight comes from how much more the hosts' rates
    vary (weighted by documents) than chance alone would make them. A null host is a host of its own. Counts
    are combined before the shuffle, so a host of any size costs one row per task.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("h"), F.sum(F.col("n_docs") * F.col("rate") * F.col("rate")).alias("rr")).first()
    n, f, h = total["n"] or 0, total["f"] or 0, total["h"] or 0
    mean = f / n if n else 0.5
    spread = mean * (1 - mean)
    extra = (total["rr"] or 0.0) / n - mean * mean - spread * (h - 1) / n if n else 0.0
    weight = min(max(spread / extra - 1, 1.0), 1e6) if extra > 0 else (1e6 if h > 1 else 1.0)
    return hosts.withColumn("shrunk", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def judge(docs: DataFrame, max_rate: float = 0.5, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate per row.

    A document is kept unless it fails a rule itself or its host's shrunk failure rate is over ``max_rate``.
    Null texts fail; null ids are passed on; null hosts count as one host; repeated rows count as often as
    they stand; an empty table gives an empty one; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    measured = materialise(measure(docs), "host-rules")
    hosts = host_rates(measured).select(F.col("host").alias("host"), F.col("shrunk").alias("host_rate"))
    out = measured.join(hosts, measured["source"].eqNullSafe(hosts["host"]), "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= max_rate)
    return out.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")


ORACLE = """
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')])
              - len(list_distinct([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')])))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
a AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS h, sum(n * (f / n) * (f / n)) / sum(n) AS rr FROM h),
e AS (SELECT mean, h, rr - mean * mean - mean * (1 - mean) * (h - 1) / n AS extra FROM a),
k AS (SELECT mean, CASE WHEN extra > 0 THEN least(greatest(mean * (1 - mean) / extra - 1, 1.0), 1e6) WHEN h > 1 THEN 1e6 ELSE 1.0 END AS weight FROM e)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.f + k.mean * k.weight) / (h.n + k.weight) <= 0.5 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source CROSS JOIN k
"""
