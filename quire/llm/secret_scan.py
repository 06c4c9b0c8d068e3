"""Secret scans (operator 4): base rules, and a character network over candidates.

1. One pass over the whole texts finds the base spans and, as candidates, every run
   of ``[A-Za-z0-9+/_=.-]`` with 16 characters or more and a digit among them that no
   one base span contains whole, each with the characters around it.
2. A network (:mod:`quire.llm.charnet`) is trained on labelled findings: values that
   the ``assign`` and ``access`` rules found are secrets; digit-only runs, host names,
   addresses and numbers in words are not. Every second positive example loses its
   context, so the shape itself is learnt. At most ``SAMPLE`` findings of each label
   are taken, those of the smallest hash; this bounds the driver's share.
3. The threshold is the highest with the asked recall on held-out findings; if
   precision there is below what is asked, that is logged, and the threshold holds.
   Every candidate is scored, and those above it become spans of the kind ``net``.
   Base spans always stay.

Defined results: null or empty texts have no spans; without labelled findings of both
kinds only the base spans are given; repeated rows are scanned each on their own;
overlapping spans of different kinds are all listed; an empty table gives an empty
result; other columns are ignored by :func:`secret_scan` and carried by
:func:`redact_secrets`, whatever their names.
"""

from __future__ import annotations

import hashlib
import logging
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import charnet
from quire.llm.tables import bounded_sample, write_once
from quire.session import ship_package

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")           # 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "net")
LEFT, RIGHT = 24, 8
SAMPLE = 3000
RECALL, PRECISION = 0.95, 0.98

SPAN = "array<struct<kind: int, start: int, end: int>>"
CAND = "array<struct<start: int, end: int, label: int, l: string, body: string, r: string>>"


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, str, str]]]:
    """Base spans (kind, start, end) and candidates (start, end, label, left, body,
    right) of one text. Label 1: a known secret's value; 0: known not to be one;
    -1: unknown; -2: unknown, and base spans cover a part of it."""
    spans, values = [], []
    if any(k in text.lower() for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                spans.append((0, m.start(), m.end()))
                values.append((m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            spans.append((1, m.start(), m.end()))
            values.append((m.start(), m.end()))
    for m in HEX.finditer(text):
        spans.append((2, m.start(), m.end()))
    spans.sort(key=lambda s: (s[1], s[0]))
    found = [(a, b, 1) for a, b in values]
    base = sorted((s[1], s[2]) for s in spans)
    at = reach = 0      # the farthest end of the base spans that begin by here
    for m in CANDIDATE.finditer(text):
        body = m.group()
        if not any(c.isdigit() for c in body):
            continue
        while at < len(base) and base[at][0] <= m.start():
            reach = max(reach, base[at][1])
            at += 1
        if reach < m.end():
            touches = reach > m.start() or at < len(base) and base[at][0] < m.end()
            found.append((m.start(), m.end(), -2 if touches else -1))
        elif body.isdigit() and (m.start(), m.end()) not in values:
            found.append((m.start(), m.end(), 0))
    return spans, [(a, b, y, text[max(0, a - LEFT):a], text[a:b], text[b:b + RIGHT]) for a, b, y in found]


def _scan(batches):
    for batch in batches:
        spans, cands = [], []
        for t in batch.column(1).to_pylist():
            s, c = find(t or "")
            spans.append([dict(zip(("kind", "start", "end"), x)) for x in s])
            cands.append([dict(zip(("start", "end", "label", "l", "body", "r"), x)) for x in c])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, _SPAN), pa.array(cands, _CAND)], ["doc_id", "spans", "cands"])


_SPAN = pa.list_(pa.struct([(x, pa.int32()) for x in ("kind", "start", "end")]))
_CAND = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "label")]
                           + [(x, pa.string()) for x in ("l", "body", "r")]))


def labelled(found: DataFrame, sample: int = SAMPLE) -> list[tuple[int, str, str, str]]:
    """At most ``sample`` distinct labelled findings of each label, in a fixed order.

    Besides the labelled candidates, unlabelled ones that are plainly words, host
    names, mail addresses or dotted numbers are negative examples."""
    c = found.select(F.explode("cands").alias("c")).select("c.*")
    plain = F.col("body").rlike(r"^[0-9.\-]+$") | F.col("body").rlike(r"(?i)^[a-z._-]+[0-9]{0,4}(\.[a-z]+)*$") \
        | F.col("body").rlike(r"(?i)\.(com|org|net|html?|example)\b")
    c = c.withColumn("label", F.when((F.col("label") == -1) & plain, 0).otherwise(F.col("label")))
    out = []
    for y in (0, 1):
        out += [(y, r.l, r.body, r.r) for r in bounded_sample(c.where(F.col("label") == y).select("l", "body", "r"), sample)]
    return out


def train_net(examples: list[tuple[int, str, str, str]], recall: float = RECALL,
              precision: float = PRECISION) -> charnet.CharNet | None:
    """Network, or None without enough examples of both labels. One example in four
    (by hash) is held out for calibration and threshold."""
    rows, labels = [], []
    for y, left, body, right in examples:
        if len(body) > 400:   # long ones are scored whole; training leaves them out
            continue
        rows.append((left, body, right))
        labels.append(y)
        if y:                 # the same finding without its context
            rows.append(("", body, ""))
            labels.append(y)
    held = np.array([hashlib.md5(r[1].encode()).digest()[0] % 4 == 0 for r in rows], bool)
    y = np.array(labels)
    if any(((y == v) & (held == h)).sum() < 5 for v in (0, 1) for h in (False, True)):
        return None
    pick = lambda mask: ([rows[i] for i in np.flatnonzero(mask)], y[mask])
    net = charnet.calibrate(charnet.train(*pick(~held)), *pick(held), recall)
    if net.precision < precision:
        logging.getLogger(__name__).warning("secret network: precision %.3f at recall %.2f on held-out findings",
                                            net.precision, recall)
    return net


def _judge(net):
    def run(batches):
        for batch in batches:
            spans, cands = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            open_ = [(i, c) for i, row in enumerate(cands) for c in row if c["label"] < 0]
            if net is not None and open_:
                for (i, c), p in zip(open_, net.probabilities([(c["l"], c["body"], c["r"]) for _, c in open_])):
                    if p >= net.threshold:
                        spans[i].append({"kind": 3, "start": c["start"], "end": c["end"]})
            for row in spans:
                row.sort(key=lambda s: (s["start"], s["kind"], s["end"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(spans, _SPAN)], ["doc_id", "spans"])
    return run


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (kind number, start, end; code points) per row."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    found = write_once(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scan, f"doc_id {kind}, spans {SPAN}, cands {CAND}"), "secret-candidates")
    net = train_net(labelled(found))
    return found.mapInArrow(_judge(net), f"doc_id {kind}, spans {SPAN}")


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = secret_spans(docs, doc_id, text)

    def joined(spans):
        def one(s):
            name = F.when(s.kind == 0, KINDS[0]).when(s.kind == 1, KINDS[1]).when(s.kind == 2, KINDS[2]).otherwise(KINDS[3])
            return F.concat_ws(":", name, s.start.cast("string"), s.end.cast("string"))
        return F.concat_ws(",", F.transform(spans, one))

    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(joined(F.filter("spans", lambda s: s.kind < 3)), 256).alias("base_sha256"),
                       joined(F.col("spans")).alias("spans"))


MASK = "<SECRET>"


def _mask(net):
    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                spans, cands = find(t) if t else ([], [])
                spans = [(a, b) for _, a, b in spans]
                open_ = [c for c in cands if c[2] < 0]
                if net is not None and open_:
                    spans += [c[:2] for c, p in zip(open_, net.probabilities([c[3:] for c in open_])) if p >= net.threshold]
                out.append(masked(t, spans))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[1:]],
                                             batch.schema.names)
    return run


def masked(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by MASK."""
    parts, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found secret masked in its text (and ``n_chars`` set to the
    new length); no row is dropped. The net is trained on findings of all rows first."""
    ship_package(docs.sparkSession)
    found = write_once(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scan, f"doc_id int, spans {SPAN}, cands {CAND}").where(F.size("cands") > 0), "secret-candidates")
    net = train_net(labelled(found))
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("o")
                       if others else F.lit(0).alias("o"))
    rows = rows.mapInArrow(_mask(net), rows.schema)
    new_length = lambda c: (F.char_length("t").cast(dict(docs.dtypes)[c]) if c == n_chars
                            else F.col("o").getField(c)).alias(c)
    return rows.select(*[F.col("t").alias(c) if c == text else new_length(c) for c in docs.columns])
