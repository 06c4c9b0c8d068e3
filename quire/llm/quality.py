"""Host-level quality rules (operator 1), in DataFrame functions only.

1. :func:`measures` takes the rule measures of each whole text.
2. :func:`host_verdicts` aggregates rule failures by host and shrinks each
   host's failure rate with an empirical beta prior, fitted to all hosts by the
   method of moments.
3. :func:`quality` joins the verdicts back: a document goes if it fails a base
   rule, or if its host is bad and it fails one of the stricter rules. A clean
   document of a bad host stays.

Defined results: a null text has no words (and so fails ``min_words``); a null
host is no host (only the base rules hold); repeated rows are judged each on
their own; an empty table gives an empty result; other columns are ignored by
:func:`quality` and carried, whatever their names, by :func:`keep_good`.

Words are ``[^\\x20\\x09-\\x0D]+``. Repeated 3-word windows are found by the
64-bit hash of the window within one text (a chance match has a probability
of n**2 / 2**65 for n words), sorted, so the work is n log n in any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.llm.tables import write_once

SYMBOLS = "#*$%&|<>"
BREAKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50          # base rule, per 100 words
STRICT_REPEAT_PCT = 30       # stricter rules, for documents of bad hosts
STRICT_SYMBOL_PCT = 30
STRICT_DUP_LINES = 3
STRICT_WORD_CHARS = (2.0, 14.0)
MAX_HOST_RATE = 0.5
FALLBACK_PRIOR = 10.0        # documents' worth of prior where hosts don't differ


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""

    def positions(b) -> Column:
        ordered = F.sort_array(F.transform(b.h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(lambda s: F.sort_array(F.transform(
            F.filter(s.s, lambda x, j: F.coalesce(F.get(s.s, j - 1).h == x.h, F.lit(False))
                     | F.coalesce(F.get(s.s, j + 1).h == x.h, F.lit(False))),
            lambda x: x.i)), s=ordered)

    def covered(b) -> Column:
        steps = F.transform(b.p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(b.p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    def of(b) -> Column:
        hashes = F.when(F.size(b.w) >= 3, F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(b.w) - 3, F.lit(0))),
            lambda i: F.xxhash64(F.get(b.w, i), F.get(b.w, i + 1), F.get(b.w, i + 2))))
        return let(lambda c: F.when(F.size(F.array_distinct(c.h)) < F.size(c.h),
                                    let(covered, p=positions(c))).otherwise(F.lit(0).cast("long")), h=hashes)

    return F.coalesce(let(of, w=words), F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(text, F.lit(""))

    def of(b) -> Column:
        lines = F.filter(F.split(b.t, "\n"), lambda x: F.translate(x, BREAKS, "") != "")
        return F.struct(
            F.size(b.w).cast("long").alias("n_words"),
            F.char_length(F.translate(b.t, BREAKS, "")).cast("long").alias("word_chars"),
            (F.char_length(b.t) - F.char_length(F.translate(b.t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lambda c: (F.size(c.x) - F.size(F.array_distinct(c.x))).cast("long"), x=lines).alias("n_dup_lines"),
            _repeat_words(b.w).alias("n_repeat_words"))

    return let(of, t=text, w=_words(text))


def base_failed(m) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])


def strict_failed(m) -> Column:
    low, high = STRICT_WORD_CHARS
    return ((100 * m["n_repeat_words"] > STRICT_REPEAT_PCT * m["n_words"])
            | (100 * m["n_symbols"] > STRICT_SYMBOL_PCT * m["n_words"])
            | (m["n_dup_lines"] >= STRICT_DUP_LINES)
            | (m["word_chars"] < low * m["n_words"]) | (m["word_chars"] > high * m["n_words"]))


def host_verdicts(judged: DataFrame, host: str = "host", failed: str = "base_failed",
                  max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate (shrunk), host_bad.

    The prior's mean is the failure rate of all documents; its weight comes from
    the variance of the hosts' rates beyond that of chance. Counts are combined
    on the map side, so a host with a third of all rows is one row per task.
    """
    hosts = (judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
             .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.var_samp(rate).alias("var"),
        F.avg(1 / F.col("n_docs")).alias("inv"))
    # Var(rate) = m(1-m) (1/(w+1) + w/(w+1) E[1/n])  for prior weight w
    spread = F.col("mean") * (1 - F.col("mean"))
    weight = (spread - F.col("var")) / (F.col("var") - spread * F.col("inv"))
    usable = ((F.col("mean") > 0) & (F.col("mean") < 1) & (F.col("var") > spread * F.col("inv"))
              & (F.col("var") < spread))
    prior = moments.select(F.col("mean"), F.when(F.coalesce(usable, F.lit(False)), weight)
                           .otherwise(F.lit(FALLBACK_PRIOR)).alias("weight"))
    p = prior.select(F.struct("mean", "weight")).scalar()  # one row by construction
    shrunk = (F.col("n_failed") + p["mean"] * p["weight"]) / (F.col("n_docs") + p["weight"])
    return hosts.withColumn("host_rate", shrunk).withColumn("host_bad", F.col("host_rate") > max_rate)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures, base_failed, host_rate, host_bad and kept for every row.

    The measures (a few numbers per row) are written once, so each text is
    split once though hosts and rows are both computed from them.
    """
    m = measures(F.col(text))
    measured = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), m.alias("m"))
    measured = measured.select("doc_id", "host", "m.*")
    measured = write_once(measured.withColumn("base_failed", base_failed(measured)), "quality-measures")
    hosts = write_once(host_verdicts(measured, max_rate=max_rate), "quality-hosts")
    out = measured.join(hosts.select("host", "host_rate", "host_bad"), "host", "left")
    bad = F.coalesce(F.col("host_bad"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", (~F.col("base_failed") & ~(bad & strict_failed(out))).alias("kept"),
                      bad.alias("host_bad"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source",
              max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with their own columns.

    Each row is judged where it stands: no key is assumed. Every text is measured once:
    the rows that pass the base rules are written with their verdicts, of the others
    only the host. Only the bad hosts are joined to the texts; Spark broadcasts them
    while they are below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]        # whatever the own names are
    renamed = docs.toDF(*names)
    text, host = (F.col(names[docs.columns.index(c)]) for c in (text, host))
    m = {k: F.col("m")[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    judged = renamed.withColumn("m", measures(text)).select(
        *names, host.alias("host"), base_failed(m).alias("base_failed"), strict_failed(m).alias("strict_failed"))
    judged = judged.select("host", "base_failed", "strict_failed",
                           *[F.when(~F.col("base_failed"), F.col(c)).alias(c) for c in names])
    judged = write_once(judged, "quality-judged")
    bad = write_once(host_verdicts(judged, max_rate=max_rate).where("host_bad").select("host", "host_bad"),
                     "quality-bad-hosts")
    kept = judged.where(~F.col("base_failed")).join(bad, "host", "left")
    kept = kept.where(~(F.coalesce(F.col("host_bad"), F.lit(False)) & F.col("strict_failed")))
    return kept.select(*names).toDF(*docs.columns)
