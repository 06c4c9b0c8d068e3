"""Personal data (operator 5), in DataFrame functions only.

1. *Base spans* by four rules (email, ip, card, phone) with positions: the matches
   and the pieces between them, from the same pattern, give running offsets.
2. *Candidates* of high-recall generators, one per type (phone, national id, card,
   account, device, date; IBAN with and without spaces; 3, 4, 5 and 6 groups of
   digits). Each looks at every place, so candidates may overlap each other, those of
   their own type too, and base spans.
3. *Boosted trees* over format and context features of a candidate. Labels: a
   candidate that is a base span, or the end of a base phone, is personal; a digit run
   that fails the card check, a date or a plain decimal is not. All distinct ones
   count: Spark counts them by feature vector, and the trees are fitted on the vectors
   with their counts. One in four calibrates the threshold. The trees travel back as a
   column expression.
4. Candidates without a label, among them those that base spans cover only in part, are
   scored. Of overlapping ones whose score passes, a spaced IBAN goes first, then
   another type's own format, then what swallows no date or base span, then the higher
   score, then the longer; they become spans of the kind ``other``. Base spans always
   stay.

The patterns are the contract's, with possessive quantifiers and look-behinds that
keep their matches and make them linear in any text.

Defined results: null or empty texts have no spans; without enough labelled examples
only base spans are given; repeated rows are scanned each on their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.llm import boosting
from quire.llm.tables import write_once

KINDS = ("email", "ip", "card", "phone", "other")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BEGIN, END, WHOLE = r"(?<![0-9A-Za-z+@.-])", r"(?![0-9A-Za-z])", r"(?![0-9A-Za-z]|[.-][0-9])"
DATE = r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}"
# Types of which at most one can begin at a place, so that one pattern reads them all.
FORMATS = (r"(?:(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"            # phone
           r"|[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}|[0-9]{4}(?:[\x20-][0-9]{4}){3}"           # national id, card
           r"|[0-9]{9,19}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"                                        # account, IBAN
           r"|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}|[0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){5}"      # device
           rf"|{DATE})")
IBAN = (r"[A-Z]{2}[0-9]{2}[\x20-][A-Z0-9]{4}(?:[\x20-](?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}"
        r"(?:[\x20-](?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?")
LETTERED = r"[A-Z]{2}[0-9]{2}(?:[\x20-][A-Z0-9]{4}){2,7}(?:[\x20-][A-Z0-9]{1,3})?"
GROUPS = r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,6})"
#: (pattern, rank where candidates overlap); OTHERS beside FORMATS.
RANK_FORMAT, RANK_LOOSE, RANK_SWALLOWS = 1, 2, 3
OTHERS = [(BEGIN + IBAN + END, 0), (BEGIN + LETTERED + END, RANK_LOOSE),
          *[(f"{BEGIN}{GROUPS}{{{k}}}{END if k == 4 else WHOLE}", RANK_LOOSE) for k in (1, 2, 3, 4)]]
CONTEXT = r"(?i)phone|tel\b|tel:|call|mobile|fax|ssn|social|iban|account|card|visa|passport|contact|mail|address|born"
LEFT, RIGHT = 24, 8
PRECISION, ENOUGH = 0.97, 20


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, body) of all matches, in code points from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,body:string>>")

    def placed(b) -> Column:
        pairs = F.zip_with(F.slice(b.gaps, F.lit(1), F.size(b.m)), b.m,
                           lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("body")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc, x):
            a = acc.at + x.gap
            e = a + F.char_length(x.body)
            return F.struct(e.alias("at"), F.concat(acc.out, F.array(
                F.struct(a.alias("start"), e.alias("end"), x.body.alias("body")))).alias("out"))

        return F.aggregate(pairs, start, step, lambda acc: acc.out)

    return let(lambda b: F.when(F.size(b.m) == 0, none).otherwise(
        let(placed, m=b.m, gaps=F.split(text, pattern, -1))), m=found)


def _everywhere(text: Column, pattern: str) -> Column:
    """Array of (start, end, body) of the match at every place, overlapping ones too."""
    found = F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1))
    none = F.array().cast("array<struct<start:int,end:int,body:string>>")

    def placed(b) -> Column:
        # the text is cut before every match; a match at the start cuts off nothing
        whole = F.size(b.cuts) == F.size(b.m)
        gaps = F.when(whole, F.concat(F.array(F.lit("")), b.cuts)).otherwise(b.cuts)
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(b.m)), b.m,
                           lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("body")))

        def step(acc, x):
            a = acc.at + x.gap
            return F.struct(a.alias("at"), F.concat(acc.out, F.array(F.struct(
                a.alias("start"), (a + F.char_length(x.body)).alias("end"), x.body.alias("body")))).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc.out)

    return let(lambda b: F.when(F.size(b.m) == 0, none).otherwise(
        let(placed, m=b.m, cuts=F.split(text, f"(?={pattern})", -1))), m=found)


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the card check sum."""
    def total(b):
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(b.r)), lambda i: let(
            lambda v: F.when(v.x > 9, v.x - 9).otherwise(v.x),
            x=F.substring(b.r, i, F.lit(1)).cast("int") * (1 + (i + 1) % 2))), F.lit(0), lambda s, x: s + x)

    return F.when(digits == "", False).otherwise(let(lambda b: total(b) % 10 == 0, r=F.reverse(digits)))


def _of_kind(kind: int, matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(m.start.alias("start"), F.lit(kind).alias("kind"), m.end.alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of the four rules, by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    email = F.when(F.contains(text, F.lit("@")), _of_kind(0, _matches(text, EMAIL))).otherwise(none)
    small = lambda p: F.coalesce((F.length(F.ltrim(p, F.lit("0"))) <= 3) & (p.try_cast("int") <= 255), F.lit(False))
    ip = _of_kind(1, F.filter(_matches(text, IP), lambda m: F.forall(F.split(m.body, r"\."), small)))
    card = _of_kind(2, F.filter(_matches(text, CARD), lambda m: let(
        lambda b: F.when(F.length(b.d).between(12, 19), luhn(b.d)).otherwise(False), d=_digits(m.body))))
    phone = F.when(F.contains(text, F.lit("+")), _of_kind(3, F.filter(
        _matches(text, PHONE), lambda m: F.length(_digits(m.body)).between(9, 15)))).otherwise(none)
    return F.sort_array(F.concat(email, ip, card, phone))


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, body, rank, left, right, label) of the generators, by start.

    Label 1: personal; 0: not; -1: unknown, to be scored; -2: a part of a base span. A
    loose candidate that swallows a date or what a base span covers ranks last."""
    def judged(m, dates):
        digits = _digits(m.body)
        inside = F.exists(base, lambda s: (s.start <= m.start) & (s.end >= m.end))
        personal = F.exists(base, lambda s: (s.end == m.end) & (
            (s.start == m.start) | (s.kind == 3) & (s.start < m.start)))
        swallows = F.exists(base, lambda s: (s.start < m.end) & (s.end > m.start)) \
            | F.exists(dates, lambda d: (d.start >= m.start) & (d.end <= m.end))
        not_ = (m.body.rlike(r"^[0-9]{12,19}$") | m.body.rlike(f"^(?:{DATE})$")
                | m.body.rlike(r"^[0-9 ]*[0-9]{1,3}(?: [0-9]{3})+$") | (F.length(digits) < 7))
        return F.struct(m.start.alias("start"), m.end.alias("end"), m.body.alias("body"),
                        F.when((m["rank"] == RANK_LOOSE) & swallows, RANK_SWALLOWS).otherwise(m["rank"]).alias("rank"),
                        F.substring(text, F.greatest(m.start - LEFT, F.lit(0)) + 1,
                                    F.least(m.start, F.lit(LEFT))).alias("left"),
                        F.substring(text, m.end + 1, F.lit(RIGHT)).alias("right"),
                        F.when(personal, 1).when(inside, -2).when(not_, 0).otherwise(-1).alias("label"))

    def ranked(found, rank):
        return F.transform(found, lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), m.body.alias("body"),
                                                     F.lit(rank).alias("rank")))

    def all_types(b) -> Column:
        new = lambda m: ~F.exists(b.formats, lambda f: (f.start == m.start) & (f.end == m.end))
        others = [ranked(F.filter(_everywhere(text, p), new), rank) for p, rank in OTHERS]
        return let(lambda x: F.transform(x.found, lambda m: judged(m, x.dates)),
                   found=F.sort_array(F.concat(ranked(b.formats, RANK_FORMAT), *others)),
                   dates=F.filter(b.formats, lambda m: m.body.rlike(f"^(?:{DATE})$")))

    return let(all_types, formats=_everywhere(text, BEGIN + FORMATS + END))


def apart(chosen: Column) -> Column:
    """Of an array of (rank, less, shorter, start, end), by start, those that stay where
    some overlap: in each run of overlapping ones the first in order, then the next that
    overlaps none taken."""
    none = F.array().cast("array<struct<rank:int,less:double,shorter:int,start:int,end:int>>")

    def run(acc, x):
        joins = x.start < acc.end
        return F.struct(
            F.when(joins, acc.out).otherwise(F.concat(acc.out, F.array(acc.cur))).alias("out"),
            F.when(joins, F.concat(acc.cur, F.array(x))).otherwise(F.array(x)).alias("cur"),
            F.when(joins, F.greatest(acc.end, x.end)).otherwise(x.end).alias("end"))

    def taken(cluster):
        return F.aggregate(F.array_sort(cluster), none, lambda out, x: F.when(
            F.exists(out, lambda o: (o.start < x.end) & (o.end > x.start)), out).otherwise(F.concat(out, F.array(x))))

    start = F.struct(F.array().cast("array<array<struct<rank:int,less:double,shorter:int,start:int,end:int>>>").alias("out"),
                     none.alias("cur"), F.lit(-1).alias("end"))
    return F.flatten(F.transform(F.aggregate(chosen, start, run, lambda a: F.concat(a.out, F.array(a.cur))), taken))


def features(c) -> list[Column]:
    """Format and context features of a candidate (numbers)."""
    digits = F.length(_digits(c["body"]))
    count = lambda p: F.regexp_count(c["body"], F.lit(p))
    return [x.cast("double") for x in (
        F.length(c["body"]), digits, count("[A-Za-z]"), count("[ ]"), count("-"), count(r"\."), count("[()]"), count(":"),
        count("[0-9]+"), c["body"].rlike("[0-9]{3}[ .-][0-9]{4}$").cast("int"), c["body"].rlike("^[A-Z]{2}[0-9]{2}").cast("int"),
        F.coalesce(F.substring(_digits(c["body"]), 1, 1).try_cast("int"), F.lit(-1)),
        F.coalesce(c["left"].rlike(CONTEXT), F.lit(False)).cast("int"), c["left"].rlike(r"[0-9.,:$€£%] ?$").cast("int"),
        c["left"].rlike(r"\+[0-9]{1,3} ?$").cast("int"), c["right"].rlike(r"^ ?[0-9.,:%$€£]").cast("int"))]


def tallies(found: DataFrame) -> DataFrame:
    """label, h (held out), x (features), n: how many distinct labelled candidates (body
    and what is around it) have these. A candidate has 50 code points at most and the
    features count in it, so the vectors' number is bounded whatever the corpus."""
    c = found.select(F.explode("cands").alias("c")).select("c.*").where("label in (0, 1)")
    return c.select("label", (F.pmod(F.xxhash64("body"), F.lit(4)) == 0).alias("h"),
                    F.array(*features(c)).cast("array<short>").alias("x"),
                    F.xxhash64("body", "left", "right").alias("key")).distinct() \
        .groupBy("label", "h", "x").agg(F.count(F.lit(1)).alias("n"))


def train(found: DataFrame, precision: float = PRECISION) -> tuple[list, float] | None:
    """Trees and threshold from all labelled candidates, or None without enough."""
    rows = sorted(tallies(found).collect())
    x, y = np.array([r.x for r in rows], float), np.array([r.label for r in rows], float)
    h, w = np.array([r.h for r in rows], bool), np.array([r.n for r in rows], float)
    if any(w[(h == k) & (y == v)].sum() < ENOUGH for k in (False, True) for v in (0, 1)):
        return None
    model = boosting.train(x[~h], y[~h], w[~h])
    at = boosting.threshold(model, x[h], y[h], w[h], precision)
    return None if at is None else (model, at)


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans: array of (start, kind number, end) per row, by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    both = let(lambda b: let(lambda c: F.struct(c.s.alias("base"), candidates(c.t, c.s).alias("cands")),
                             t=b.t, s=base_spans(b.t)), t=body)
    found = write_once(docs.select(F.col(doc_id).alias("doc_id"), both.alias("x")).select("doc_id", "x.*"),
                       "pii-candidates")
    model = train(found)
    if model is None:
        return found.select("doc_id", F.col("base").alias("spans"))
    trees, at = model
    open_ = F.filter("cands", lambda c: c.label == -1)
    scored = F.transform(open_, lambda c: let(
        lambda b: F.struct(c["rank"].alias("rank"), (-boosting.expression(
            trees, [b[f"x{i}"] for i in range(len(features(c)))])).alias("less"),
            (c.start - c.end).alias("shorter"), c.start.alias("start"), c.end.alias("end")),
        **{f"x{i}": x for i, x in enumerate(features(c))}))
    chosen = apart(F.filter(scored, lambda c: c.less <= F.lit(-at)))
    return found.select("doc_id", F.sort_array(F.concat("base", _of_kind(4, chosen))).alias("spans"))


def pii_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    def joined(spans):
        def one(s):
            name = F.when(s.kind == 0, KINDS[0])
            for k in range(1, 4):
                name = name.when(s.kind == k, KINDS[k])
            return F.concat_ws(":", name.otherwise(KINDS[4]), s.start.cast("string"), s.end.cast("string"))
        return F.concat_ws(",", F.transform(spans, one))

    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return pii_spans(docs, doc_id, text).select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(joined(F.filter("spans", lambda s: s.kind < 4)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
