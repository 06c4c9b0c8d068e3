from pyspark.sql import functions as F

from quire.functions.language import detect_language, resolve_language
from quire.operators.rules import match_rules, validate_questions
from tests.conftest import one_col


def test_detect_language_fixtures(spark):
    rows = ["How does Ayurveda recommend improving sleep quality?", "अच्छी नींद के लिए आयुर्वेद क्या सुझाता है?",
            "మంచి నిద్ర కోసం ఆయుర్వేదం ఏమి సూచిస్తుంది?", "நல்ல தூக்கத்திற்கு ஆயுர்வேதம் என்ன பரிந்துரைக்கிறது?",
            "ಒಳ್ಳೆಯ ನಿದ್ರೆಗಾಗಿ ಆಯುರ್ವೇದ ಏನು ಶಿಫಾರಸು ಮಾಡುತ್ತದೆ?", "ভালো ঘুমের জন্য আয়ুর্বেদ কী পরামর্শ দেয়?",
            "", None, "12345 !?", "long English sentence with one अ", "అ अ", "अ అ", "سلام"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i")
    assert one_col(df.select(detect_language("t"))) == \
        ["en", "hi", "te", "ta", "kn", "bn", "en", "en", "en", "hi", "te", "hi", "ur"]


def test_resolve_language(spark):
    rows = ["te", " Telugu ", "TELUGU", None, "", "xx"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i")
    assert one_col(df.select(resolve_language("t"))) == ["te", "te", "te", "en", "en", "en"]


def test_rule_matcher_fixtures(spark):
    rows = ["cough and throat pain", "fatigue, frequent urination, thirst", "high bp and stress headaches",
            "sugarcane", "cough sugar", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, text string")
    out = match_rules(df).orderBy("i").select("disease", "matched_keywords", "confidence").collect()
    assert [tuple(r) for r in out] == [
        ("Cough", ["cough", "throat"], 0.33), ("Diabetes", ["fatigue", "urination", "thirst"], 0.6),
        ("Hypertension", ["bp", "stress"], 0.4), ("General imbalance", [], 0.0),
        ("Cough", ["cough"], 0.17), ("General imbalance", [], 0.0)]


def test_validate_questions(spark):
    df = spark.createDataFrame([("ab", 5, None), ("abc", 21, None), ("abc", 3, "web"), ("abc", 3, "pdf")],
                               "q string, k int, f string")
    out = validate_questions(df, "q", "k", "f").select("is_valid").collect()
    assert [r[0] for r in out] == [False, False, False, True]


def test_confidence_rounds_half_even(spark):
    rules = [("Eight", ["a", "b", "c", "d", "e", "f", "g", "h"], ["Vata"], "x")]
    df = spark.createDataFrame([(1, "a")], "i int, text string")
    assert match_rules(df, rules=rules).first()["confidence"] == 0.12
