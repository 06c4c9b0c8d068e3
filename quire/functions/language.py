"""Script-based language detection and lookup (L1-L4) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import _c, let, strip_ws

# Fixed values: (code, name, first code point, last code point) per script.
SCRIPT_RANGES = [
    ("hi", "Hindi", 0x0900, 0x097F),
    ("bn", "Bengali", 0x0980, 0x09FF),
    ("pa", "Punjabi", 0x0A00, 0x0A7F),
    ("gu", "Gujarati", 0x0A80, 0x0AFF),
    ("or", "Odia", 0x0B00, 0x0B7F),
    ("ta", "Tamil", 0x0B80, 0x0BFF),
    ("te", "Telugu", 0x0C00, 0x0C7F),
    ("kn", "Kannada", 0x0C80, 0x0CFF),
    ("ml", "Malayalam", 0x0D00, 0x0D7F),
    ("ur", "Urdu", 0x0600, 0x06FF),
]
ENGLISH = ("en", "English")
LANGUAGE_NAMES = {code: name for code, name, _, _ in SCRIPT_RANGES}
LANGUAGE_NAMES[ENGLISH[0]] = ENGLISH[1]

# Default wording of the translation instruction (our own); {src} and {dst}
# are the language names.
TRANSLATE_SYSTEM = (
    "Translate the user's text from {src} into {dst}. Keep names, numbers, "
    "Sanskrit and Latin plant or body-type terms, and bracketed citations like "
    "[source_file, page] exactly as they are. Output the translation alone, "
    "without quotes, notes or preamble."
)


def _range_class(lo: int, hi: int) -> str:
    return f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}"


def script_counts(c) -> Column:
    """array<struct<n, neg_first, code>> with one entry per script.

    One regex pass keeps only Indic/Arabic characters (usually none), then
    each kept character maps to its script index; counts and first
    positions come from that short array.
    """
    keep = "".join(_range_class(lo, hi) for _c2, _n, lo, hi in SCRIPT_RANGES)
    kept = F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"[^{keep}]", "")

    def script_index(ch):
        cp = F.ascii(ch)
        idx = F.lit(-1)
        for i, (_code, _name, lo, hi) in enumerate(SCRIPT_RANGES):
            idx = F.when((cp >= lo) & (cp <= hi), F.lit(i)).otherwise(idx)
        return idx

    def equals(i):
        return lambda x: x == i

    def body(b):
        ids = b["ids"]
        return F.array(*[
            F.struct(F.size(F.filter(ids, equals(i))).alias("n"),
                     (-F.array_position(ids, i)).cast("int").alias("neg_first"),
                     F.lit(code).alias("code"))
            for i, (code, _name, _lo, _hi) in enumerate(SCRIPT_RANGES)])

    ids = F.transform(F.filter(F.split(kept, ""), lambda ch: ch != ""), script_index)
    return let(body, ids=ids)


def detect_language(c) -> Column:
    """Code of the script with most characters; ties -> the script seen
    first; no Indic/Arabic character (Latin is not counted) -> 'en'."""
    best = F.array_max(script_counts(c))
    return F.when(best["n"] > 0, best["code"]).otherwise(F.lit(ENGLISH[0]))


def _lookup_map() -> Column:
    kv = []
    for code, name in LANGUAGE_NAMES.items():
        kv += [F.lit(code.lower()), F.lit(code), F.lit(name.lower()), F.lit(code)]
    return F.create_map(*kv)


def resolve_language(c) -> Column:
    """L2: a code or name (case and surrounding space ignored) -> code;
    null, blank or unknown -> 'en'."""
    key = F.lower(strip_ws(F.coalesce(_c(c), F.lit(""))))
    return F.coalesce(F.element_at(_lookup_map(), key), F.lit(ENGLISH[0]))


def language_name(code) -> Column:
    """Code -> display name via a literal map (L2 lookup)."""
    kv = []
    for k, v in LANGUAGE_NAMES.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*kv), _c(code)), _c(code))


def languages_table(spark: SparkSession) -> DataFrame:
    """L3: the 11 supported languages (code, name, first/last code point)."""
    rows = [(c, n, lo, hi) for c, n, lo, hi in SCRIPT_RANGES] + [(ENGLISH[0], ENGLISH[1], None, None)]
    return spark.createDataFrame(rows, "code string, name string, first_cp int, last_cp int")


def translate_messages(text, src_name, dst_name, instruction: str = TRANSLATE_SYSTEM) -> Column:
    """L4: [system, user] chat messages asking for a translation."""
    system = F.format_string(instruction.replace("%", "%%").replace("{src}", "%s").replace("{dst}", "%s"),
                             _c(src_name), _c(dst_name))
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), _c(text).alias("content")),
    )
