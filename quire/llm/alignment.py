"""Cross-tokenizer alignment (operator 13) by merge-path partitioning.

Each text is encoded by a byte-level BPE vocabulary A (space + text) and by a
SentencePiece model B (text; it adds the space itself). Byte offsets at which a token
of A and a token of B both end cut the two token rows into groups; a link is a pair of
an A and a B token that end together.

*Merge path.* The ends of A and of B, of all texts of a block one after the other, are
two ascending arrays. Their merge is cut by equidistant diagonals; a binary search on
each diagonal finds where the merge crosses it, which gives pieces of ``PIECE`` merge
steps each, whatever the texts look like: a very long text is many pieces, many short
texts are one. All pieces step at once (numpy, one lane a piece), each emits the ends
its own two ranges share, and a pair of equal ends that a border cuts apart is stitched
afterwards. Groups follow from the common ends in order.

*Counts.* One pass writes each text's links and every task's count of each id pair.
Pair counts are summed by Spark; how often a pair is linked, and whether that is the
most of its B id, is then looked up per link: the ``FREQUENT`` most frequent pairs (a
bounded number) travel to the tasks, all others are joined, so no pair is left out and
no frequent pair makes a hot key.

Defined results: a null or empty text, or one whose tokens don't spell space + text
(such as one that holds U+2581), has no tokens: zeros and an empty digest. Texts of any
length are aligned whole. Repeated rows are aligned and counted each on their own; of
equal counts each is the highest. An empty table gives an empty result; a null doc_id
is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.mixing import _least_count
from quire.llm.sentencepiece_bpe import MARK, _gather
from quire.llm.tables import write_once
from quire.session import ship_package

PIECE = 256              # merge steps of a piece
FREQUENT = 1 << 18       # id pairs that travel to the tasks
BLOCK_BYTES = 1_500_000
LOOK_UP = 500_000        # links that are looked up at once, and at least one text
HELD_PAIRS = 1_000_000   # distinct pairs that a task holds before it emits their counts
# Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- merge path ----------------------------------------------------------------


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` merged elements are of ``a`` (of equal ones ``a`` comes
    first), for every diagonal ``d``: one binary search each, all at once."""
    lo = np.maximum(diagonals - len(b), 0)
    hi = np.minimum(diagonals, len(a))
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        x = a[np.minimum(mid, len(a) - 1)]
        y = b[np.clip(diagonals - 1 - mid, 0, len(b) - 1)]
        right = open_ & (x <= y)
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` (each strictly ascending) of the values that both hold."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = len(a) + len(b)
    cuts = np.append(np.arange(0, total, piece), total)
    in_a = crossings(a, b, cuts)
    in_b = cuts - in_a
    i, j, i_end, j_end = in_a[:-1].copy(), in_b[:-1].copy(), in_a[1:], in_b[1:]
    partner = np.full(len(b), -1, np.int64)
    last = np.full(len(i), -1, a.dtype)          # the end of A that a piece met last
    top = np.iinfo(a.dtype).max
    pad_a, pad_b = np.append(a, top), np.append(b, top)
    for _ in range(piece):
        x = np.where(i < i_end, pad_a[i], top)
        y = np.where(j < j_end, pad_b[j], top)
        from_a = x <= y
        met = np.flatnonzero(~from_a & (y == last))
        partner[j[met]] = i[met] - 1
        last = np.where(from_a, x, last)
        i += from_a & (i < i_end)
        j += ~from_a
    # equal ends with a border between them: the last of A before it, the first of B after
    start_i, start_j = in_a[1:-1], in_b[1:-1]
    some = np.flatnonzero((start_i > 0) & (start_j < len(b)))
    cut = some[a[start_i[some] - 1] == b[start_j[some]]]
    partner[start_j[cut]] = start_i[cut] - 1
    in_both = np.flatnonzero(partner >= 0)
    return partner[in_both], in_both


# --- vocabularies ----------------------------------------------------------------


def _byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable Latin-1
    stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class ByteLevel:
    """Vocabulary A, as plain data that travels to tasks; ids are merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["content"] for t in told["added_tokens"]}
        back = _byte_characters()
        self.ranks = {bytes(back[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
        pre = told.get("pre_tokenizer") or {}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in told["model"]["merges"]]
        first = min((told["model"]["vocab"][m] for m in merged), default=0)
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or told.get("normalizer") or \
                [told["model"]["vocab"][m] for m in merged] != list(range(first, first + len(merged))):
            raise ValueError("not a plain byte-level BPE vocabulary whose ids follow its merges")
        self.text = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.text[i] = t

    def encoder(self):
        import tiktoken
        return tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary


class Pieces:
    """Model B: its file's bytes and what each id spells."""

    def __init__(self, path: str):
        import sentencepiece
        with open(path, "rb") as f:
            self.model = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.text = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.text[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = sp.id_to_piece(i).replace(MARK, " ").encode()

    def encoder(self):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return lambda texts: sp.encode(texts, out_type=int, num_threads=1)


class Pool:
    """Byte strings by number, for gathering."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(texts) or b"\0", np.uint8)

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gather(self.flat, self.starts, self.sizes, ids)


# --- one block of texts --------------------------------------------------------------


class Tokens:
    """Ids of the texts of a block and where each text's begin."""

    def __init__(self, rows: list[list[int]], sizes: np.ndarray):
        self.count = np.array([len(r) for r in rows], np.int64)
        self.ids = np.fromiter((x for r in rows for x in r), np.int64, int(self.count.sum()))
        self.sizes = sizes[self.ids]
        self.at = np.append(0, np.cumsum(self.count))
        self.spelt = np.diff(np.append(0, np.cumsum(self.sizes))[self.at])     # bytes of each text

    def keep(self, texts: np.ndarray) -> None:
        kept = np.repeat(texts, self.count)
        self.ids, self.sizes = self.ids[kept], self.sizes[kept]
        self.count = np.where(texts, self.count, 0)
        self.at = np.append(0, np.cumsum(self.count))


def _same_bytes(tokens: Tokens, pool: Pool, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text's tokens, of the right length in all, spell its bytes."""
    off = np.flatnonzero(pool.gather(tokens.ids)[0] != data)
    same = np.ones(len(at) - 1, bool)
    same[np.searchsorted(at, off, "right") - 1] = False
    return same


class Block:
    """Alignment of some texts: ``a`` and ``b`` (their tokens), ``in_a`` and ``in_b`` (the
    places of the tokens that end together)."""

    def __init__(self, texts: list[str], encode_a, encode_b, pool_a: Pool, pool_b: Pool):
        spaced = [(" " + t).encode() if t else b"" for t in texts]
        self.a = Tokens([encode_a(" " + t) if t else [] for t in texts], pool_a.sizes)
        self.b = Tokens(encode_b(texts) if texts else [], pool_b.sizes)
        size = np.array([len(s) for s in spaced], np.int64)
        good = (self.a.spelt == size) & (self.b.spelt == size) & (size > 0)
        while True:                              # twice at most
            self.a.keep(good)
            self.b.keep(good)
            data = np.frombuffer(b"".join(s for s, g in zip(spaced, good) if g) or b"", np.uint8)
            at = np.append(0, np.cumsum(np.where(good, size, 0)))
            same = good & _same_bytes(self.a, pool_a, data, at) & _same_bytes(self.b, pool_b, data, at)
            if (same == good).all():
                break
            good = same
        self.in_a, self.in_b = common_ends(np.cumsum(self.a.sizes), np.cumsum(self.b.sizes))
        self.links_at = np.searchsorted(self.in_a, self.a.at)      # each text's first link

    def spelled(self, numbers: Pool) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;...`` of all texts in a row, each group ending in ``;``, and the
        texts' bounds. ``numbers`` holds each id followed by a comma, a bar and a semicolon."""
        a, b = self.a, self.b
        last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        last_a[self.in_a] = last_b[self.in_b] = True
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        entry = np.empty(len(a.ids) + len(b.ids), np.int64)
        entry[np.arange(len(a.ids)) + np.append(0, self.in_b + 1)[group_a]] = 3 * a.ids + last_a
        entry[np.arange(len(b.ids)) + np.append(self.in_a + 1, 0)[group_b]] = 3 * b.ids + 2 * last_b
        flat, ends = numbers.gather(entry)
        return flat.tobytes(), np.append(0, ends)[a.at + b.at]


def _numbers(n: int) -> Pool:
    return Pool([f"{i}{mark}".encode() for i in range(n) for mark in ",|;"])


# --- kernels -------------------------------------------------------------------------


def align_texts(a: ByteLevel, b: Pieces, code: str, groups: bool):
    """Kernel over (doc_id, text): one row a text with its numbers, digest and links, and
    rows (pair, times) with the task's count of each id pair."""
    many_b = len(b.text)

    def run(batches):
        encode_a, encode_b = a.encoder(), b.encoder()
        pool_a, pool_b, numbers = Pool(a.text), Pool(b.text), _numbers(max(len(a.text), many_b))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def merged():
            codes = np.concatenate([x[0] for x in held])
            distinct, which = np.unique(codes, return_inverse=True)
            return distinct, np.bincount(which, np.concatenate([x[1] for x in held]), len(distinct)).astype(np.int64)

        def counted(codes, times):
            n = len(codes)
            none = [pa.nulls(n, t) for t in (pa.int64(),) * 4 + (pa.string(),) * (1 + groups) + (pa.binary(),)]
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind), *none, pa.array(codes.astype(np.int64)), pa.array(times)],
                                              names)

        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else []), "links",
                 "pair", "times"]
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            for start, data, offsets in W.string_blocks(batch.column(1), BLOCK_BYTES):
                whole, bounds = data.tobytes(), offsets.tolist()
                stop = start + len(bounds) - 1
                x = Block([whole[i:j].decode() for i, j in zip(bounds, bounds[1:])], encode_a, encode_b, pool_a, pool_b)
                codes = x.a.ids[x.in_a] * many_b + x.b.ids[x.in_b]
                links = codes.astype(code).tobytes()
                width = np.dtype(code).itemsize
                spelled, at = x.spelled(numbers)
                rows = range(stop - start)
                told = [spelled[at[i]:max(at[i + 1] - 1, at[i])] for i in rows]
                n_links = np.diff(x.links_at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(x.a.count), pa.array(x.b.count),
                     pa.array(n_links), pa.array(n_links), pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in told]),
                     *([pa.array([t.decode() for t in told])] if groups else []),
                     pa.array([links[width * x.links_at[i]:width * x.links_at[i + 1]] for i in rows], pa.binary()),
                     pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names)
                held.append(np.unique(codes, return_counts=True))
                n_held += len(held[-1][0])
                if n_held > 2 * HELD_PAIRS:
                    held = [merged()]
                    n_held = len(held[0][0])
                    if n_held > HELD_PAIRS:
                        yield counted(*held[0])
                        held, n_held = [], 0
        if n_held:
            yield counted(*merged())
    return run


def look_up(known: np.ndarray, counts: np.ndarray, best: np.ndarray, code: str):
    """Kernel over (row, links): n_best and count_sum of the links with a known pair, and
    the other links' pairs."""
    def run(batches):
        for batch in batches:
            step = np.dtype(code).itemsize
            size = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
            upto = np.append(0, np.cumsum(size))
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + step * LOOK_UP, "right")) - 1)
                codes = np.frombuffer(b"".join(batch.column(1).slice(lo, hi - lo).to_pylist()), code).astype(np.int64)
                ends = (upto[lo:hi + 1] - upto[lo]) // step
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                times = np.where(hit, counts[at], 0) if len(known) else np.zeros(len(codes), np.int64)
                most = hit & best[at] if len(known) else hit
                rare = np.append(0, np.cumsum(~hit))[ends]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(np.append(0, np.cumsum(most))[ends]).astype(np.int64)),
                     pa.array(np.diff(np.append(0, np.cumsum(times))[ends])),
                     pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(codes[~hit]))],
                    ["row", "n_best", "count_sum", "rare"])
                lo = hi
    return run


# --- operator ----------------------------------------------------------------------


def align_tokens(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
                 groups: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row;
    with ``groups`` also the groups themselves (``a1,a2|b1;a3|b2,b3``)."""
    ship_package(docs.sparkSession)
    a, b = ByteLevel(a_path), Pieces(b_path)
    many_b = len(b.text)
    code = "<u4" if len(a.text) * many_b < 1 << 32 else "<i8"
    kind = dict(docs.dtypes)[doc_id]
    extra = "groups string, " if groups else ""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    aligned = rows.mapInArrow(align_texts(a, b, code, groups), f"doc_id {kind}, n_a long, n_b long, n_groups long, "
                              f"n_links long, groups_sha256 string, {extra}links binary, pair long, times long")
    aligned = write_once(aligned.withColumn("row", F.monotonically_increasing_id()), "alignment-links")  # fixed once written

    counts = aligned.where("pair is not null").groupBy("pair").agg(F.sum("times").alias("c"))
    counts = write_once(counts.withColumn("b", F.col("pair") % many_b), "alignment-pairs")
    most = counts.groupBy("b").agg(F.max("c").alias("most"))             # at most one row for each id of B
    counts = counts.join(F.broadcast(most), "b").select("pair", "c", (F.col("c") == F.col("most")).alias("best"))

    top = counts.where(F.col("c") >= _least_count(counts, frequent)).toArrow()      # at most `frequent` rows
    known = top.column(0).to_numpy()
    by = np.argsort(known)
    kernel = look_up(known[by], top.column(1).to_numpy()[by], top.column(2).to_numpy(zero_copy_only=False)[by].astype(bool), code)
    texts = aligned.where("pair is null")
    found = write_once(texts.select("row", "links").mapInArrow(kernel, "row long, n_best long, count_sum long, rare array<long>"),
                       "alignment-found")
    others = found.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("n"))
    others = others.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("c")).alias("more"))
    out = texts.drop("links", "pair", "times").join(found.drop("rare"), "row").join(others, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
        *(["groups"] if groups else []))
