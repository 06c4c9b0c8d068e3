"""Literal input rows that queries add to the given tables, for cases the tables do
not hold: other scripts, rules that match, urgent phrases, blank and over-long
questions, heading-only texts, labelled pages, unusable vectors."""

from __future__ import annotations

# conv_id, turn, role, text
CONVERSATIONS = [(-1 - i, 0, "user", t) for i, t in enumerate([
    "How does Ayurveda recommend improving sleep quality?",
    "अच्छी नींद के लिए आयुर्वेद क्या सुझाता है?",
    "మంచి నిద్ర కోసం ఆయుర్వేదం ఏమి సూచిస్తుంది?",
    "நல்ல தூக்கத்திற்கு ஆயுர்வேதம் என்ன பரிந்துரைக்கிறது?",
    "ಒಳ್ಳೆಯ ನಿದ್ರೆಗಾಗಿ ಆಯುರ್ವೇದ ಏನು ಶಿಫಾರಸು ಮಾಡುತ್ತದೆ?",
    "ভালো ঘুমের জন্য আয়ুর্বেদ কী পরামর্শ দেয়?",
    "long English sentence with one अ", "అ अ", "अ అ", "سلام", "12345 !?",
    "cough and throat pain", "fatigue, frequent urination, thirst", "high bp and stress headaches", "sugarcane", "cough sugar",
    "I have chest pain since the morning", "she is pregnant and has some pain", "shortness of breath, and fainting",
    "hi", "      ", "???!!!", "x" * 2001, None, "",
])]

# doc_id, text
DOCUMENTS = [(-1, "References"), (-2, "  WWW \n"), (-3, "Bibliography"), (-4, "References to other work"), (-5, None), (-6, "12 34")]

# vec_id, kind of fault
VECTORS = [(-1, "null"), (-2, "short"), (-3, "inf"), (-4, "nan"), (-5, "hole"), (-6, "-inf")]

# page_id, url, html
PAGES = [
    (-1, "http://herbs.example.org/a", "<html><body><h1>Ingredient: Ginger root</h1><p>Botanical Name: Zingiber officinale</p>"
     "<p>Properties: warm and pungent</p><p>Benefits: settles the stomach</p><p>Culinary Use: tea and curry</p>"
     "<p>Ayurvedic Use: balances Kapha</p><p>Dosage: one gram a day</p><p>www.example.com doi 10.1</p></body></html>"),
    (-2, "http://herbs.example.org/b", "<p>Herb: Tulsi</p><p>Journal of plants, vol. 3</p><p>Description: holy basil leaf Uses: cough</p>"),
    (-3, "http://herbs.example.org/c", "<p>References</p><p>http://x.example.com</p><p>12, 13 (14)</p>"),
]

LANGUAGES = [" Telugu ", "TELUGU", "te", "hi", "Hindi", "xx", "", None]


def sql_values(rows: list[tuple]) -> str:
    """The rows as a SQL VALUES list."""
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
