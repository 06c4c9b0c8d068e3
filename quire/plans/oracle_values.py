"""Values of the SQL statements, written out here: the statements import nothing from the
code they check, so a wrong constant there does not pass."""

# White space of Python's str.split(), line ends of str.splitlines().
WS_CHARS = '\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}'
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"
LINE_BREAK = '\\r\\n|[\\x{0A}-\\x{0D}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]'

# Heading-only texts, noise lines, urgent phrases, page field labels.
BOILERPLATE_RE = '^\\s*(references|bibliography|doi|journal|www|http)\\s*$'
NOISE_KEYWORDS = ['references',
 'bibliography',
 'journal',
 'doi',
 'http',
 'www',
 'pg.no',
 'edition',
 'vol.',
 'volume',
 'issue',
 'citation',
 'issn']
RED_FLAG_PATTERNS = ['\\bchest pain\\b',
 '\\bdifficulty breathing\\b|\\bshortness of breath\\b',
 '\\bsuicid\\w*\\b|\\bself.?harm\\b',
 '\\bsevere bleeding\\b|\\bheavy bleeding\\b',
 '\\bunconscious\\b|\\bfainting\\b',
 '\\bstroke\\b|\\bnumbness on one side\\b|\\bfacial droop\\b',
 '\\bpregnan\\w+\\b.*\\b(bleed|pain|cramp)\\w*\\b']
FIELD_LABELS = {'ingredient': ['ingredient', 'herb', 'drug', 'name'],
 'botanical': ['botanical name', 'latin name', 'scientific name'],
 'characteristics': ['characteristics', 'properties', 'description'],
 'uses': ['uses', 'benefits', 'indications'],
 'kitchen_use': ['kitchen use', 'culinary use', 'food use'],
 'ayurvedic_use': ['ayurvedic use', 'ayurvedic uses', 'ayurveda'],
 'remedies': ['remedies', 'home remedy', 'preparation', 'dosage']}
LABELS_ALT = 'characteristics|scientific\\s+name|ayurvedic\\s+uses|botanical\\s+name|ayurvedic\\s+use|culinary\\s+use|description|home\\s+remedy|indications|kitchen\\s+use|preparation|ingredient|latin\\s+name|properties|ayurveda|benefits|food\\s+use|remedies|dosage|drug|herb|name|uses'

# Scripts (code, name, first and last code point), languages, rules.
SCRIPT_RANGES = [('hi', 'Hindi', 2304, 2431),
 ('bn', 'Bengali', 2432, 2559),
 ('pa', 'Punjabi', 2560, 2687),
 ('gu', 'Gujarati', 2688, 2815),
 ('or', 'Odia', 2816, 2943),
 ('ta', 'Tamil', 2944, 3071),
 ('te', 'Telugu', 3072, 3199),
 ('kn', 'Kannada', 3200, 3327),
 ('ml', 'Malayalam', 3328, 3455),
 ('ur', 'Urdu', 1536, 1791)]
LANGUAGE_NAMES = {'hi': 'Hindi',
 'bn': 'Bengali',
 'pa': 'Punjabi',
 'gu': 'Gujarati',
 'or': 'Odia',
 'ta': 'Tamil',
 'te': 'Telugu',
 'kn': 'Kannada',
 'ml': 'Malayalam',
 'ur': 'Urdu',
 'en': 'English'}
RULES = [('Cough',
  ['cough', 'throat', 'congestion', 'khansi', 'phlegm', 'cold'],
  ['Kapha', 'Vata'],
  'Drink warm fluids, avoid cold foods, try ginger-tulsi tea.'),
 ('Diabetes',
  ['fatigue', 'urination', 'sugar', 'thirst', 'diabetes'],
  ['Kapha', 'Pitta'],
  'Avoid sugar, follow a low-GI diet, exercise regularly.'),
 ('Hypertension',
  ['bp', 'pressure', 'stress', 'hypertension', 'headache'],
  ['Pitta', 'Vata'],
  'Reduce salt, practice meditation and pranayama.')]
DEFAULT_RULE = ('General imbalance', ['Vata'], 'Improve sleep, reduce stress, and eat a balanced, warm diet.')

# Default wording.
TRANSLATE_SYSTEM = ("Translate the user's text from {src} into {dst}. Keep names, numbers, Sanskrit and Latin plant or body-type terms, "
 'and bracketed citations like [source_file, page] exactly as they are. Output the translation alone, without '
 'quotes, notes or preamble.')
PROMPT_TAIL = 'Reply in three to six sentences, use only the context above, and cite sources inline as [source_file, page].'
