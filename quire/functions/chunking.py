"""Chunk generators as Column -> array<string> expressions.

Both chunkers are native: the word array is split once, chunk boundaries are
computed as integer ranges (C2 folds over per-unit word counts with
``aggregate``), and each chunk is sliced out of the word array once. Whole
texts are always processed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import WS, _c, clean_text

# Paragraph break and sentence boundary.
PARAGRAPH_BREAK = f"\\n{WS}*\\n"
SENTENCE_BOUNDARY = f"(?<=[.?!]){WS}+(?=[A-Z0-9\"'(])"


def check_chunk_params(size: int, overlap: int) -> None:
    """Size >= 1 and 0 <= overlap < size."""
    if size < 1:
        raise ValueError("chunk size must be >= 1")
    if overlap < 0:
        raise ValueError("overlap must be >= 0")
    if overlap >= size:
        raise ValueError("overlap must be strictly less than chunk size")


def _empty_str_array() -> Column:
    return F.array().cast("array<string>")


def let(fn, **bindings: Column) -> Column:
    """Evaluate each binding once and pass them to ``fn`` as fields of one
    lambda variable, so lambdas below never re-evaluate an outer expression."""
    bound = F.struct(*[v.alias(k) for k, v in bindings.items()])
    return F.element_at(F.transform(F.array(bound), fn), 1)


def chunk_words(c, size: int = 350, overlap: int = 90, cleaned: bool = False) -> Column:
    """Fixed word windows of ``size`` words, step ``max(size-overlap, 1)``.

    Text of at most ``size`` words is one chunk; windows stop at the first one
    that reaches the end. Null or blank text gives an empty array.
    ``cleaned=True`` says the input is already T1-clean (skips one pass).
    """
    if size < 1:
        raise ValueError("chunk size must be >= 1")
    step = max(size - overlap, 1)

    def body(b):
        words, n = b["words"], F.size(b["words"])
        last = F.ceil((n - F.lit(size)) / F.lit(step)).cast("int")
        windows = F.transform(F.sequence(F.lit(0), last),
                              lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))
        return (F.when(b["norm"] == "", _empty_str_array())
                .when(n <= size, F.array(b["norm"]))
                .otherwise(windows))

    # the text is bound before it is split: an expression of two fields would be cleaned twice
    norm = F.coalesce(_c(c), F.lit("")) if cleaned else clean_text(c)
    return let(lambda t: let(body, norm=t["norm"], words=F.split(t["norm"], " ")), norm=norm)


def _unit_word_counts(c) -> Column:
    """Word counts of the paragraph -> sentence units of a text, in order."""
    text = F.coalesce(_c(c), F.lit(""))
    paras = F.split(text, PARAGRAPH_BREAK)
    sentences = F.flatten(F.transform(paras, lambda p: F.split(p, SENTENCE_BOUNDARY)))
    counts = F.transform(sentences, lambda s: F.size(F.filter(F.split(s, f"{WS}+"), lambda w: w != "")))
    return F.filter(counts, lambda k: k > 0)


def chunk_ranges(c, size: int = 350, overlap: int = 70) -> Column:
    """C2 boundaries: array<struct<s,e>> of word ranges [s, e) after greedy
    packing of units into ``size`` words; an over-long unit is cut into
    windows of ``size`` with step ``size - overlap``."""
    check_chunk_params(size, overlap)
    step = size - overlap
    state0 = F.struct(
        F.array().cast("array<struct<s:int,e:int>>").alias("out"),
        F.lit(0).alias("bs"),   # buffer start word offset
        F.lit(0).alias("bw"),   # words in buffer
        F.lit(0).alias("pos"),  # words consumed
    )

    def flushed(st):
        return F.when(st["bw"] > 0,
                      F.concat(st["out"], F.array(F.struct(st["bs"].alias("s"), st["pos"].alias("e"))))
                      ).otherwise(st["out"])

    def merge(st, wc):
        pos = st["pos"]
        n_win = F.ceil((wc - F.lit(size)) / F.lit(step)).cast("int")
        windows = F.transform(
            F.sequence(F.lit(0), n_win),
            lambda j: F.struct((pos + j * step).alias("s"),
                               F.least(pos + j * step + size, pos + wc).alias("e")))
        long_unit = F.struct(F.concat(flushed(st), windows).alias("out"), (pos + wc).alias("bs"),
                             F.lit(0).alias("bw"), (pos + wc).alias("pos"))
        fits = F.struct(st["out"].alias("out"), F.when(st["bw"] == 0, pos).otherwise(st["bs"]).alias("bs"),
                        (st["bw"] + wc).alias("bw"), (pos + wc).alias("pos"))
        spill = F.struct(flushed(st).alias("out"), pos.alias("bs"), wc.alias("bw"), (pos + wc).alias("pos"))
        return (F.when(wc > size, long_unit)
                .when(st["bw"] + wc <= size, fits)
                .otherwise(spill))

    return F.aggregate(_unit_word_counts(c), state0, merge, flushed)


def chunk_sentences(c, size: int = 350, overlap: int = 70) -> Column:
    """Sentence-aware chunks of at most ``size`` words, each chunk after
    the first prefixed with the last ``overlap`` words of the previous one
    (W3: the previous range is read by index inside ``transform``).

    Text of at most ``size`` words is one chunk. Over-long sentences are
    windowed and then tail-overlapped as well (D7).
    """
    check_chunk_params(size, overlap)

    def body(b):
        words, ranges = b["words"], b["ranges"]

        def piece(s, e):
            return F.slice(words, s + 1, e - s)

        def render(r, i):
            cur = piece(r["s"], r["e"])
            if overlap <= 0:
                return F.array_join(cur, " ")
            prev = F.element_at(ranges, F.greatest(i, F.lit(1)))  # 1-based: previous range
            tail_start = F.greatest(prev["s"], prev["e"] - overlap)
            with_tail = F.concat(piece(tail_start, prev["e"]), cur)
            return F.array_join(F.when(i == 0, cur).otherwise(with_tail), " ")

        return (F.when(b["norm"] == "", _empty_str_array())
                .when(F.size(words) <= size, F.array(b["norm"]))
                .when(F.size(ranges) == 0, F.array(b["norm"]))
                .otherwise(F.transform(ranges, render)))

    norm = clean_text(c)
    words = F.split(norm, " ")
    # Ranges only matter for texts longer than one chunk; skip the fold otherwise.
    ranges = F.when(F.size(words) > size, chunk_ranges(c, size, overlap)).otherwise(
        F.array().cast("array<struct<s:int,e:int>>"))
    return let(body, norm=norm, words=words, ranges=ranges)
