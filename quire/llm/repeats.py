"""Substring dedup (operator 10) by repeated-phrase automata.

A window is ``width`` consecutive words of one document; every word in a window
whose word sequence also starts elsewhere is removed. Windows are judged on the
input.

1. *Phrases.* A window's phrase is the ``phrase``-word run in it with the smallest
   hash (the leftmost of equals), so equal windows have equal phrases at equal
   places, and about 7 % of all places carry one. Phrases are counted over all
   documents; a window whose phrase stands in one place only can't recur.
2. *Automata.* Which phrases recur travels to the tasks as a bitmap of bounded size
   (a superset: more phrases only make more false hits). Each block of documents
   compiles the recurring phrases that it holds into an Aho-Corasick automaton over
   word numbers, its shard, and streams its documents through it to locate every
   occurrence. A shard is bounded by its block, whatever the corpus holds.
3. *Confirmation.* The windows of one occurrence form a segment. Segments are
   counted by the hash of all their words: a segment met twice is confirmed whole.
   Only where a phrase has several segments are their single windows compared, by
   hash, and the confirmed ones kept as the bits of a mask.
4. Each document gets its segments' masks, and its covered words go.

Counts are combined on the map side, so a passage in a third of all documents is one
row per task. Words, phrases, windows and segments are compared by 64-bit hashes of
their words.

Defined results: null or word-less texts keep nothing and lose nothing; a repeated row
is a copy, so its windows recur; rows are known by id and text hash; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.tables import write_once
from quire.session import ship_package

WIDTH, PHRASE = 35, 8
MAX_BITS = 1 << 26      # bitmap of 8 MB at most
SIGNS = 4               # characters of a word number


def _phrases(block: W.Block, width: int, phrase: int):
    """Window starts, the place of each window's phrase, and all phrase hashes."""
    hashes = block.word_hashes()
    starts, _ = _window_starts(block, width)
    if not len(starts):
        return hashes, starts, starts, np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - phrase + 1)
    grams = W.rolling(hashes, at, at + phrase)
    span = width - phrase + 1          # phrases per window
    best, value, step = at, grams, 1
    while step * 2 <= span:            # smallest of runs of 2, 4, 8, ...
        best, value = _smaller(best, value, step)
        step *= 2
    if step < span:
        best, value = _smaller(best, value, span - step)
    return hashes, starts, best[starts], grams


def _smaller(best, value, step):
    left, right = value[:-step], value[step:]
    take = right < left
    return np.where(take, best[step:], best[:-step]), np.where(take, right, left)


def _window_starts(block, width):
    n = len(block.starts)
    if n < width:
        return np.zeros(0, np.int64), None
    last = np.repeat(block.bounds[1:], np.diff(block.bounds))
    return np.flatnonzero(np.arange(n) + width <= last), None


def _occurrences(starts, place):
    """First and last window start of each phrase occurrence."""
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], place[first]


def phrase_hashes(width: int, phrase: int):
    """Kernel: hash of each occurring phrase, with its number in the block."""
    def run(batches):
        for batch in batches:
            for block in W.word_blocks(batch.column(0)):
                _, starts, place, grams = _phrases(block, width, phrase)
                if len(starts):
                    h, n = np.unique(grams[_occurrences(starts, place)[2]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                                                     ["phrase", "n"])
    return run


def bitmap(hashes: DataFrame, column: str, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of the hashes present, in a power of two of at most ``max_bits``."""
    n = hashes.count()
    bits = min(max_bits, max(1 << 10, 1 << int(16 * n).bit_length()))
    at = F.col(column).bitwiseAND(bits - 1)
    rows = hashes.select((F.shiftright(at, 5)).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 31 as int))").alias("bit"))
    rows = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()   # at most max_bits / 32 rows
    out = np.zeros(bits // 32, np.uint32)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.uint32)
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 32 - 1)
    return (bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1


def locate(hashes: np.ndarray, grams: np.ndarray, wanted: np.ndarray, phrase: int) -> np.ndarray:
    """Places of every occurrence in the block of the phrases at ``wanted``: an
    Aho-Corasick automaton over word numbers, checked by the phrase hash.

    A word is written as ``SIGNS`` characters of 256 kinds (32 bits of its hash), as a
    node's edges are searched one by one; matches that begin inside a word are left."""
    import ahocorasick
    signs = hashes.astype("<u4").view(np.uint8).astype("<u4") + np.uint32(0x100)
    text = signs.tobytes().decode("utf-32-le")
    shard = ahocorasick.Automaton()
    _, one = np.unique(grams[wanted], return_index=True)
    for at in wanted[one].tolist():
        shard.add_word(text[at * SIGNS:(at + phrase) * SIGNS], at)
    shard.make_automaton()
    found = np.fromiter(itertools.chain.from_iterable(shard.iter(text)), np.int64).reshape(-1, 2)
    start = found[:, 0] + 1 - phrase * SIGNS
    keep = start % SIGNS == 0
    places, known = start[keep] // SIGNS, found[keep, 1]
    return places[grams[places] == grams[known]]


def segments(width: int, phrase: int, bits: np.ndarray, payload: bool):
    """Kernel: the segments of recurring phrases. With ``payload``, one row per
    distinct segment of a block and its windows' hashes; without, one row per
    segment, with its document and first window."""
    def run(batches):
        for batch in batches:
            column = batch.column(2)
            for block in W.word_blocks(column):
                hashes, starts, place, grams = _phrases(block, width, phrase)
                if not len(starts):
                    continue
                lo, hi, at = _occurrences(starts, place)
                wanted = np.unique(at[_has(bits, grams[at])])
                if not len(wanted):
                    continue
                keep = np.isin(at, locate(hashes, grams, wanted, phrase))
                lo, hi, at = lo[keep], hi[keep], at[keep]
                whole = W.rolling(hashes, lo, hi + width) ^ W.mix((at - lo).astype(np.uint64) * np.uint64(64) + (hi - lo).astype(np.uint64))
                if payload:
                    _, one = np.unique(whole, return_index=True)
                    lo, hi, at, whole = lo[one], hi[one], at[one], whole[one]
                    n = hi - lo + 1
                    first = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    windows = W.rolling(hashes, first, first + width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams[at].view(np.int64)), pa.array(whole.view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)),
                                                  pa.array(windows.view(np.int64)))],
                        ["phrase", "segment", "windows"])
                else:
                    text = block.text_of_word()[lo]
                    rows = pa.array(text + block.first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows),
                         pa.array((lo - block.bounds[text]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)),
                         pa.array(grams[at].view(np.int64)), pa.array(whole.view(np.int64))],
                        ["doc_id", "key", "first", "n", "phrase", "segment"])
    return run


def remove_covered(width: int):
    """Kernel: id, n_words, n_removed, kept_sha256, from the text and its masks."""
    def run(batches):
        for batch in batches:
            firsts, masks = batch.column(2), batch.column(3)
            for block in W.word_blocks(batch.column(1)):
                n = len(block.starts)
                delta = np.zeros(n + width + 1, np.int64)
                here = firsts.slice(block.first, block.n_texts)
                first = here.flatten().to_numpy(zero_copy_only=False)
                mask = masks.slice(block.first, block.n_texts).flatten().to_numpy(zero_copy_only=False)
                first = first + np.repeat(block.bounds[:-1], pc.fill_null(pc.list_value_length(here), 0).to_numpy())
                for bit in range(int(mask.max()).bit_length() if len(mask) else 0):
                    at = first[(mask >> bit) & 1 == 1] + bit
                    delta += np.bincount(at, minlength=len(delta)) - np.bincount(at + width, minlength=len(delta))
                gone = np.cumsum(delta)[:n] > 0
                removed = np.diff(np.append(0, np.cumsum(gone))[block.bounds])
                # kept words joined by one space: their bytes, each with a space behind
                starts, ends = block.starts[~gone], block.ends[~gone]
                size = ends - starts + 1
                stops = np.cumsum(size)
                at = np.repeat(starts - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)
                raw = np.append(block.data, np.uint8(0x20))[at]
                raw[stops - 1] = 0x20
                raw = memoryview(raw)
                cuts = np.append(0, stops)[np.append(0, np.cumsum(~gone))[block.bounds]].tolist()
                digest = [hashlib.sha256(raw[a:max(a, b - 1)]).hexdigest() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_texts),
                     pa.array(np.diff(block.bounds).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digest)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                     phrase: int = PHRASE) -> DataFrame:
    """doc_id, key (hash of the text), first, mask: bit b of the mask says that the
    window that starts at word first + b (from 0) also starts elsewhere."""
    if not 0 < phrase <= width or width - phrase + 1 > 63:
        raise ValueError("a window must hold a phrase, and fewer than 64 of them")
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"))

    phrases = rows.select("text").mapInArrow(phrase_hashes(width, phrase), "phrase long, n long")
    recurring = write_once(phrases.groupBy("phrase").agg(F.sum("n").alias("n")).where("n > 1").select("phrase"),
                           "repeats-phrases")
    found = write_once(rows.mapInArrow(
        segments(width, phrase, bitmap(recurring, "phrase"), False),
        f"doc_id {kind}, key long, first int, n int, phrase long, segment long"), "repeats-segments")
    counts = write_once(found.groupBy("segment").agg(F.count(F.lit(1)).alias("c"), F.first("phrase").alias("phrase"),
                                                     F.first("n").alias("n")), "repeats-counts")
    whole = counts.where("c > 1").select("segment", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    mixed = write_once(counts.groupBy("phrase").agg(F.count(F.lit(1)).alias("d"), F.min("c").alias("lo"))
                       .where("d > 1 and lo = 1").select("phrase"), "repeats-mixed")
    windows = rows.mapInArrow(segments(width, phrase, bitmap(mixed, "phrase"), True),
                              "phrase long, segment long, windows array<long>")
    windows = windows.join(mixed, "phrase", "left_semi").dropDuplicates(["segment"]).join(
        counts.select("segment", "c"), "segment")
    windows = write_once(windows.select("segment", "c", F.posexplode("windows").alias("at", "window")),
                         "repeats-windows")
    twice = windows.groupBy("window").agg(F.sum("c").alias("t")).where("t > 1").select("window")
    parts = windows.where("c = 1").join(twice, "window", "left_semi").groupBy("segment").agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    masks = whole.unionByName(parts)
    return found.join(masks, "segment").select("doc_id", "key", "first", "mask")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                   phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs``."""
    found = repeated_windows(docs, doc_id, text, width, phrase)
    # a document's segments; bounded by its own length
    per_doc = write_once(found.distinct().groupBy("doc_id", "key").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("mask").alias("masks")), "repeats-documents")
    kind = dict(docs.dtypes)[doc_id]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"))
    same = rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["key"] == per_doc["key"])
    rows = rows.join(per_doc, same, "left").select(rows["doc_id"], "text", "firsts", "masks")
    return rows.mapInArrow(remove_covered(width),
                           f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
