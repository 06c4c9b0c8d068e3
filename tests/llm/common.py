"""Small tables and plain Python versions that the operators are held against."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, schema=SCHEMA, sources=None):
    rows = [(i, t, "en", (sources[i] if sources else "s0"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def edge_texts():
    """Null, empty, blank, one word, a very long text, repeats and odd characters."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    return [None, "", " \n\t ", "one", "Ünï côdé \U0001F600 ▁ \x00 \x0b", long_text, "same words here again and again " * 30,
            "same words here again and again " * 30, "a\nb\n\nb\nb", "z" * 60000]


def clash(df):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    out = df
    for c in ("row", "key", "host", "m", "n", "v", "h", "k1", "w", "at", "start", "words", "segment", "label", "o", "t",
              "spans", "gone", "id", "digest", "line", "unit", "held_out", "word", "base"):
        out = out.withColumn(c, F.lit("x"))
    return out


def rows(df, key="doc_id"):
    got = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(got, key=lambda r: (r[key] is None, r[key] or 0))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def counter(xs):
    return Counter(xs)
