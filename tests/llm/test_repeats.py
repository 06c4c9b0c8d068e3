import random
from collections import Counter

import pytest

from quire.llm import repeats as R
from tests.llm.common import SPACE, clash, documents, edge_texts, rows, sha


def brute(texts, width):
    words = [SPACE.findall(t or "") for t in texts]
    c = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - width + 1) if c[tuple(w[i:i + width])] > 1 for p in range(i, i + width)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def cases(width):
    rng = random.Random(width)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [" ".join(word() for _ in range(rng.randrange(200))) for _ in range(60)]
    passages = [[word() for _ in range(n)] for n in (width - 1, width, width + 1, 3 * width, 10 * width)]
    for _ in range(60):
        p = rng.choice(passages)
        a = rng.randrange(len(p))
        texts.append(" ".join([word() for _ in range(rng.randrange(40))] + p[a // 4:] + [word() for _ in range(rng.randrange(40))]))
    texts += [texts[3], texts[70], "a " * 200, "a b " * 100, "x " * width, "y " * (width - 1), "same case", "Same case"]
    near = [word() for _ in range(6 * width)]
    for _ in range(20):
        w = list(near)
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("width,phrase", [(35, 8), (10, 3), (5, 5), (6, 1)])
def test_matches_brute_force(spark, width, phrase):
    texts = cases(width) + edge_texts()
    got = rows(R.remove_repeats(clash(documents(spark, texts)).repartition(5), width=width, phrase=phrase))
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == brute(texts, width)


def test_small_bitmap_only_costs_false_hits(spark, monkeypatch):
    texts = cases(10)
    real = R.bitmap
    monkeypatch.setattr(R, "bitmap", lambda h, c: real(h, c, 1 << 10))
    got = rows(R.remove_repeats(documents(spark, texts), width=10, phrase=3))
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == brute(texts, 10)


def test_repeated_rows_and_empty(spark):
    df = documents(spark, [" ".join(f"u{i}" for i in range(50))])
    assert [r["n_removed"] for r in rows(R.remove_repeats(df))] == [0]
    assert [r["n_removed"] for r in rows(R.remove_repeats(df.unionByName(df)))] == [50, 50]
    assert R.remove_repeats(documents(spark, [])).count() == 0
