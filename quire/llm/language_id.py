"""Language identification (operator 12) by cross-parsing entropy.

*Learning.* For each language a bounded sample of its labelled text is made into a
suffix automaton: ``SAMPLE_BYTES`` bytes, in pieces of ``PIECE`` bytes that are drawn by
hash from all of a hash sample of the distinct training texts. Sampling and automata
are Spark jobs grouped by language; the automata (at most ``TOTAL_BYTES`` bytes of
sample in all) then travel to the tasks.

*Prediction.* A text is parsed from left to right into longest matches with a
language's automaton: a phrase goes on while the automaton has a transition, then the
next one begins at its root. Phrases times log2 of the sample's length over the text's
length estimates the cross entropy; the language that needs fewest wins. All texts of a
block and all languages are parsed at once in numpy, a text in segments of ``SEGMENT``
bytes (a border costs at most one phrase, the same for all languages).

Texts are read as UTF-8 bytes in lower case; a run of ASCII characters other than
letters is one space, so digits and marks don't count.

Defined results: a null text, one without a letter, and every text where nothing could
be learned gets ``und`` and a score of 0. A null id counts as the text '' (not held out).
Equal values go to the language that sorts first. ``score`` is 1 - best / second best (0 a tie,
1 where only one language is known). Repeated rows are predicted each on their own and
learned from once; texts of any length are parsed whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.tables import write_once
from quire.session import ship_package

SAMPLE_BYTES = 1 << 16       # of each language
TOTAL_BYTES = 1 << 20        # of all languages together
PIECE, SEGMENT = 1024, 512
BLOCK_BYTES = 2_000_000
BREAK = 0x20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = BREAK
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with letters in lower case and every run of other ASCII as one space, none
    at a text's begin, and the texts' new offsets."""
    data = _FOLD[data]
    gap = data == BREAK
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    keep = ~gap
    keep[1:] |= ~gap[:-1] & ~first[1:-1]
    return data[keep], np.append(0, np.cumsum(keep))[offsets]


# --- suffix automata ------------------------------------------------------------------


def suffix_automaton(data: bytes) -> tuple[list[int], list[int], list[int], int]:
    """Transitions (from, byte, to) of the automaton of all substrings of ``data``, and the
    number of its states; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in data:
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    moves = [(s, c, t) for s, out in enumerate(go) for c, t in out.items()]
    a, b, c = (list(x) for x in zip(*moves)) if moves else ([], [], [])
    return a, b, c, len(go)


class Automaton(NamedTuple):
    lang: str
    n_bytes: int        # of the sample
    states: int
    source: np.ndarray
    byte: np.ndarray
    target: np.ndarray


class Parser:
    """The automata of all languages in one table. State 0 has no transition: whoever is
    there begins a phrase with the next byte, as does who finds none."""

    def __init__(self, automata: list[Automaton]):
        used = np.zeros(256, bool)
        for x in automata:
            used[x.byte] = True
        self.many = int(used.sum()) + 1                       # the last symbol is any other byte
        self.symbol = np.full(256, self.many - 1, np.uint8)
        self.symbol[used] = np.arange(self.many - 1)
        roots = np.append(1, 1 + np.cumsum([x.states for x in automata]))
        self.table = np.zeros(int(roots[-1]) * self.many, np.int32)
        for x, root in zip(automata, roots):
            self.table[(x.source + root) * self.many + self.symbol[x.byte]] = x.target + root
        self.begin = np.stack([self.table[r * self.many:(r + 1) * self.many] for r in roots[:-1]])
        self.bits = np.log2([max(x.n_bytes, 2) for x in automata])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Longest-match phrases of each text (a column) for each language (a row)."""
        size = np.diff(offsets)
        segments = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), segments)
        number = np.arange(len(text)) - np.repeat(np.cumsum(segments) - segments, segments)
        start = offsets[:-1][text] + SEGMENT * number
        length = np.minimum(SEGMENT, offsets[1:][text] - start)
        order = np.argsort(-length, kind="stable")            # segments that go on are the first
        start, length = start[order], length[order]
        coded = self.symbol[data]
        n_lang = len(self.begin)
        state = np.zeros((n_lang, len(start)), np.int32)
        count = np.zeros((n_lang, len(start)), np.int32)
        going = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        for step, n in enumerate(going.tolist()):
            c = coded[start[:n] + step]
            to = self.table[state[:, :n] * np.int64(self.many) + c]
            missing = to == 0
            count[:, :n] += missing
            state[:, :n] = np.where(missing, self.begin[:, c], to)
        out = np.zeros((n_lang, len(size)), np.int64)
        for k in range(n_lang):
            out[k] = np.bincount(text[order], count[k], len(size))
        return out


# --- learning ---------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("\\p{L}")), F.lit(False))


def _below(hash_: Column, share: Column) -> Column:
    """A share of all 64-bit hashes, the smallest ones."""
    return hash_ <= (share * F.lit(float(1 << 64)) - F.lit(float(1 << 63)))


def sample_pieces(train: DataFrame, n_bytes: int) -> DataFrame:
    """(lang, key, piece): pieces of distinct texts of ``train`` (lang, text), a hash sample
    of about ``n_bytes`` to twice that for each language, fewer where there are fewer."""
    rows = train.select("lang", "text", F.xxhash64("text").alias("key"), F.octet_length("text").alias("size"))
    distinct = rows.groupBy("lang", "key").agg(F.first("size").alias("size"))
    per = distinct.groupBy("lang").agg(F.sum("size").alias("total"))               # a row for each language
    few = rows.join(F.broadcast(per), "lang").where(_below(F.col("key"), 16.0 * n_bytes / F.col("total")))
    few = write_once(few.groupBy("lang", "key").agg(F.first("text").alias("text"), F.first("size").alias("size")),
                     "language-sample")
    taken = few.groupBy("lang").agg(F.sum("size").alias("total"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / PIECE).cast("int")))
    pieces = few.select("lang", "key", "text", at.alias("i")).select(
        "lang", F.xxhash64("key", "i").alias("key"), F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    return pieces.join(F.broadcast(taken), "lang").where(
        _below(F.col("key"), F.lit(2.0 * n_bytes) / F.col("total"))).select("lang", "key", "piece")


def learn(train: DataFrame, sample_bytes: int, total_bytes: int) -> list[Automaton]:
    """One automaton for each language of ``train`` (lang, text), built where the pieces of
    the language meet; a group holds about twice the sample."""
    n_langs = train.select("lang").distinct().count()
    if not n_langs:
        return []
    n_bytes = max(PIECE, min(sample_bytes, total_bytes // n_langs))

    def build(pieces: pd.DataFrame) -> pd.DataFrame:
        taken, left = [], n_bytes
        for piece in pieces.sort_values(["key", "piece"])["piece"]:
            taken.append(piece.encode()[:left])
            left -= len(taken[-1]) + 1
            if left <= 0:
                break
        raw = np.frombuffer(b" ".join(taken), np.uint8)
        data, _ = fold(raw, np.array([0, len(raw)]))
        a, b, c, states = suffix_automaton(data.tobytes())
        return pd.DataFrame({"lang": [pieces["lang"].iloc[0]], "n_bytes": [len(data)], "states": [states],
                             "source": [np.array(a, "<i4").tobytes()], "byte": [np.array(b, np.uint8).tobytes()],
                             "target": [np.array(c, "<i4").tobytes()]})

    built = sample_pieces(train, n_bytes).groupBy("lang").applyInPandas(
        build, "lang string, n_bytes long, states long, source binary, byte binary, target binary").collect()
    return [Automaton(r.lang, r.n_bytes, r.states, np.frombuffer(r.source, "<i4").astype(np.int64),
                      np.frombuffer(r.byte, np.uint8), np.frombuffer(r.target, "<i4"))
            for r in sorted(built, key=lambda r: r.lang)]


# --- prediction -------------------------------------------------------------------------


def predict(automata):
    """Kernel over (doc_id, held_out, letters, text); ``automata`` is a broadcast list."""
    def run(batches):
        known = automata.value
        parser = Parser(known) if known else None
        names = np.array([x.lang for x in known] + ["und"], object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for first, data, offsets in W.string_blocks(batch.column(3), BLOCK_BYTES):
                n = len(offsets) - 1
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                if parser is not None:
                    data, offsets = fold(data, offsets)
                    size = np.maximum(np.diff(offsets), 1)
                    entropy = parser.phrases(data, offsets) * parser.bits[:, None] / size
                    some = letters[first:first + n]
                    best = np.where(some, entropy.argmin(0), len(names) - 1)
                    if len(known) > 1:
                        two = np.partition(entropy, 1, axis=0)
                        value = 1 - two[0] / np.maximum(two[1], 1e-300)
                    else:
                        value = np.ones(n)
                    score = np.where(some, np.clip(value, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                                                  pa.array(names[best], pa.string()), pa.array(score)],
                                                 ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                      sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                       has_letter(F.col(text)).alias("letters"), F.lower(F.col(text)).alias("text"),
                       F.col(lang).cast("string").alias("lang"))
    train = rows.where(~F.col("held_out") & F.col("letters") & F.col("lang").isNotNull()).select("lang", "text")
    automata = spark.sparkContext.broadcast(learn(train, sample_bytes, total_bytes))
    return rows.select("doc_id", "held_out", "letters", "text").mapInArrow(
        predict(automata), f"doc_id {dict(docs.dtypes)[doc_id]}, held_out boolean, lang_pred string, score double")
