import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import mixing as M
from tests.llm.common import SPACE, UP, clash, documents, edge_texts, rows


def brute(texts):
    words = {i: SPACE.findall((t or "").translate(UP)) for i, t in enumerate(texts)}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()) + len(train), len(c) + (len(train) > 0)
    z = n + 0.1 * (v + 1)
    return [(i not in set(train), len(w) + 1, sum(c[x] > 0 for x in w) + (len(train) > 0), n,
             sum(math.log10((c[x] + 0.1) / z) for x in w) + math.log10((len(train) + 0.1) / z)) for i, w in words.items()]


@pytest.mark.parametrize("frequent", [3, 1 << 17])
def test_base_matches_brute_force(spark, frequent):
    texts = edge_texts() + [f"the word {i % 7} and the word {i % 3} of it" for i in range(60)] + ["unseen " + "q" * 9]
    got = rows(M.lm_score(clash(documents(spark, texts)), frequent=frequent))
    for r, (held, n, known, total, base) in zip(got, brute(texts), strict=True):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    assert got[0]["score"] == 0 and got[5]["score"] < 0


def test_score_is_a_probability_and_learns(spark):
    texts = [f"the quick brown fox number {i % 5} jumps over the lazy dog again" for i in range(200)]
    odd = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0)   # held out: not learnt from
    texts[odd] = "zxqj wvkp " * 6
    got = rows(M.lm_score(documents(spark, texts)))
    bits = [r["bits_per_byte"] for r in got]
    assert got[odd]["held_out"] and bits.pop(odd) > 4 and max(bits) < 1.0
    mixer = M.learn(np.zeros((M.PREDICTORS, 2 * M.SLOTS), np.int64), ["abc abd abe " * 20])
    data = np.array([[b] for b in range(256)], np.uint8).ravel()   # all texts of one byte
    assert (10 ** mixer.bits(data, np.arange(257))).sum() == pytest.approx(1, abs=1e-4)


def test_score_does_not_depend_on_partitions(spark):
    df = documents(spark, [f"some text {i} with a few words {i * i}" for i in range(50)])
    a, b = rows(M.lm_score(df.repartition(1))), rows(M.lm_score(df.repartition(7)))
    assert [(r["score"], r["n_known"]) for r in a] == [(r["score"], r["n_known"]) for r in b]


def test_empty_table(spark):
    assert M.lm_score(documents(spark, [])).count() == 0


def test_words_in_order_score_better(spark):
    pairs = [("red", "apple"), ("green", "pear"), ("blue", "plum"), ("black", "grape"), ("white", "melon")]
    texts = [" ".join(f"{a} {b}" for a, b in (pairs[(i + j * j) % 5] for j in range(40))) for i in range(120)]
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 10 == 0]
    for i in held[::2]:
        w = texts[i].split()
        texts[i] = " ".join(w[1::2] + w[::2])       # the same words, seldom beside the same ones
    got = rows(M.lm_score(documents(spark, texts)))
    assert min(got[i]["bits_per_byte"] for i in held[::2]) > 2 * max(got[i]["bits_per_byte"] for i in held[1::2])


def plain_score(mixer, text):
    """log10 probability of a text, bit by bit, one segment after another."""
    data, total, before = text.encode(), 0.0, 0
    cut = [i for i in range(len(data)) if i == 0 or (M.W.SPACE_BREAKS[data[i]] and not M.W.SPACE_BREAKS[data[i - 1]])]
    for lo, hi in zip(cut, cut[1:] + [len(data)]):
        part = np.frombuffer(data[lo:hi], np.uint8)
        ctx = [c for c in M.contexts(part, np.array([0, len(part)]))]
        for i, byte in enumerate(part):
            stage = int(i >= M.LEAD)
            for j in range(7, -1, -1):
                so_far, bit = np.array([(256 | int(byte)) >> (j + 1)], np.uint32), (int(byte) >> j) & 1
                z = np.float32(0)
                for k in range(M.PREDICTORS):
                    z += mixer.odds[stage, k][M._slot(ctx[k][i:i + 1], so_far, M.SLOT_BITS)[0]]
                if not stage:
                    after = M._after(ctx[3][i:i + 1], np.array([before], np.uint32))
                    z += mixer.pairs[M._slot(after, so_far, len(mixer.pairs).bit_length() - 1)[0]]
                total += mixer.logs[stage].reshape(256, M.FINE, 2)[so_far[0], M._class(np.array([z]), M.FINE, M.SPAN)[0], bit]
        before = int(M.W.rolling(M.W._BYTE_VALUES[part], np.array([max(0, len(part) - M.TAIL)]), np.array([len(part)]))[0]) >> 32
    return total


def test_score_equals_plain_version():
    rng = np.random.default_rng(3)
    mixer = M.Mixer(rng.normal(size=(2, M.PREDICTORS, M.SLOTS)).astype(np.float32),
                    rng.normal(size=M.SLOTS * 2).astype(np.float32),
                    np.log10(rng.uniform(0.01, 0.99, (2, 256 * M.FINE * 2))).astype(np.float32))
    texts = ["", "a", "the cat and the cat and the dog", "  two  blanks\n\nand Ünï \U0001F600 ", "x" * 50, "the cat and the cat and the dog"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    p = M.Pairs.of(data, offsets)
    got = M._sums(mixer.score(p), p.ends)
    assert got == pytest.approx([plain_score(mixer, t) for t in texts], rel=1e-5)


def test_counts_of_pairs_equal_plain_counts():
    import pyarrow as pa
    texts = ["one two three", "two three one two", None, "", "one two"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    bits, want = 18, Counter()
    got = np.zeros(2 << bits, np.int64)
    for out in M._gather_counts([batch], bits):
        for t, k, blob in zip(out[0].to_pylist(), out[1].to_pylist(), out[3].to_pylist()):
            if t == M.PREDICTORS:
                got[k * 2 * M.CHUNK:(k + 1) * 2 * M.CHUNK] += np.frombuffer(blob, M._kind(t))
    for text in texts:
        before = 0
        for seg in re.findall(r" ?[^ ]+", text or ""):
            part = np.frombuffer(seg.encode(), np.uint8)
            ctx = M.contexts(part, np.array([0, len(part)]))[3]
            for i, byte in enumerate(part[:M.LEAD]):
                for j in range(7, -1, -1):
                    so_far = np.array([(256 | int(byte)) >> (j + 1)], np.uint32)
                    after = M._after(ctx[i:i + 1], np.array([before], np.uint32))
                    want[int(M._slot(after, so_far, bits)[0]) * 2 + ((int(byte) >> j) & 1)] += 1
            before = int(M.W.rolling(M.W._BYTE_VALUES[part], np.array([max(0, len(part) - M.TAIL)]), np.array([len(part)]))[0]) >> 32
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_units_are_all_examples_of_the_texts():
    """Units and their counts, against a walk over every byte; their contexts against those of the bytes."""
    import pyarrow as pa
    texts = ["one two three", "two  threefold one two", None, "", "one two", "Ünï threefold"]
    got = Counter()
    for out in M._gather_counts([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], 18):
        for t, k, c in zip(out[0].to_pylist(), out[1].to_pylist(), out[2].to_pylist()):
            if t < -2:
                byte, ctx = M.unit_contexts(t, np.array([k]).view(np.uint64))
                got[int(t == M.LATE), int(byte[0]), *(int(x[0]) for x in ctx)] += c
    want = Counter()
    for text in texts:
        before = 0
        for seg in re.findall(r" *[^ ]+", text or ""):
            part = np.frombuffer(seg.encode(), np.uint8)
            ctx = M.contexts(part, np.array([0, len(part)]))
            for i, byte in enumerate(part):
                own = [int(x[i]) for x in ctx]
                after = [int(M._after(ctx[3][i:i + 1], np.array([before], np.uint32))[0])] if i < M.LEAD else []
                want[int(i >= M.LEAD), int(byte), *own, *after] += 1
            before = int(M.W.rolling(M.W._BYTE_VALUES[part], np.array([max(0, len(part) - M.TAIL)]), np.array([len(part)]))[0]) >> 32
    assert got == want


def test_packed_counts_add_up():
    import pyarrow as pa
    texts = [f"some text {i} with words {i * i}" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    sums, plain, size = {}, {}, [0, 0]
    for out in M.gather_counts(18)([batch]):
        some = pa.compute.greater_equal(out[0], 0)
        for r in M.sum_blobs([out.filter(some)]):
            for t, k, blob in zip(*(r[i].to_pylist() for i in range(3))):
                sums[t, k] = sums.get((t, k), 0) + np.frombuffer(blob, "<i8")
        size[0] += sum(len(b) for b in out[3].to_pylist() if b)
    for out in M._gather_counts([batch], 18):
        for t, k, blob in zip(out[0].to_pylist(), out[1].to_pylist(), out[3].to_pylist()):
            if t >= 0:
                plain[t, k] = plain.get((t, k), 0) + np.frombuffer(blob, M._kind(t)).astype(np.int64)
                size[1] += len(blob)
    assert sums.keys() == plain.keys() and all((sums[x] == plain[x]).all() for x in sums)
    assert size[0] < size[1] / 20          # a task of few texts hands on few bytes


def test_every_training_text_is_learnt_from(spark, monkeypatch):
    seen = []
    whole = M.learn_units
    monkeypatch.setattr(M, "learn_units", lambda units, *a: seen.append(units.groupBy(
        (units.t == M.LATE).alias("late")).sum("c").collect()) or whole(units, *a))
    texts = [f"text {i} of some words like {i * 7919}" for i in range(900)]        # more than 400 training texts
    a = rows(M.lm_score(documents(spark, texts), group=500))
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    assert sum(r[1] for r in seen[0]) == sum(len(t) for t in train)
    b = rows(M.lm_score(documents(spark, texts).repartition(7), group=500))         # several groups
    assert [r["score"] for r in a] == [r["score"] for r in b]


def test_late_bytes_met_before_are_scored_once_and_alike():
    """A segment that an earlier block held gets the same score without its late bytes being mixed
    again, also after the bounded store was emptied."""
    rng = np.random.default_rng(4)
    mixer = M.Mixer(rng.normal(size=(2, M.PREDICTORS, M.SLOTS)).astype(np.float32),
                    rng.normal(size=M.SLOTS * 2).astype(np.float32),
                    np.log10(rng.uniform(0.01, 0.99, (2, 256 * M.FINE * 2))).astype(np.float32))
    met = M.Met()
    for text in ("everything short a everything", "", "a everything longer-words", "longer-words"):
        data = np.frombuffer(text.encode(), np.uint8)
        p = M.Pairs.of(data, np.array([0, len(data)]))
        assert np.array_equal(mixer.score(p, met), mixer.score(p))
    assert len(met.hashes) == len(set(met.hashes.tolist())) == 5   # with and without a space before: other segments
    assert met.find(p.hashes)[0].all()
    kept, M.MET = M.MET, 2
    try:
        met.add(np.array([1], np.uint64), np.array([0.5]))
    finally:
        M.MET = kept
    assert met.hashes.tolist() == [1] and met.find(np.array([1, 2], np.uint64))[0].tolist() == [True, False]


def test_bits_of_a_repeated_unit_are_counted_once(monkeypatch):
    """Counting bits follows the distinct units of a task, not its blocks."""
    import pyarrow as pa
    met = []
    count = M._count
    monkeypatch.setattr(M, "_count", lambda table, slots, *a: met.append(len(slots)) or count(table, slots, *a))
    monkeypatch.setattr(M, "BLOCK_BYTES", 40)
    text = "some words that every block holds "
    made = []
    for n in (1, 30):
        met.clear()
        list(M._gather_counts([pa.RecordBatch.from_arrays([pa.array([text] * n)], ["text"])], 18))
        made.append(sum(met))
    assert made[0] == made[1] > 0
