"""Word lists and rewrite rules of the Italian utterance cleaners.

FIXED VALUES — these must equal the behaviour being matched, so they are
stated plainly, in their natural order.  Operators take them as parameters;
these are only the defaults.
"""

# --- fixed values: rule-based normaliser (greetings, fillers, meta talk) ---
GREETINGS = ["buongiorno", "buonasera", "salve", "ciao", "pronto", "addio",
             "arrivederci", "grazie", "prego"]
FILLERS = ["allora", "dunque", "cioè", "praticamente", "sostanzialmente",
           "diciamo", "ecco", "insomma", "quindi", "scusa", "scusi", "senta",
           "senti", "guarda", "ascolta"]
META_TALK = ["volevo sapere", "volevo chiedere", "posso chiedere",
             "avrei bisogno di", "mi serve", "chiamo per", "sto chiamando per",
             "desideravo"]

# --- fixed values: discovery cleaner ---
STOPWORDS = ["il", "lo", "la", "di", "in", "con", "al", "alla", "del", "i",
             "gli", "le", "un", "uno", "una", "a", "da", "su", "per", "tra",
             "fra", "che", "chi", "cui", "sulla", "ad", "no"]
VOICE_FILLERS = ["senti", "scusa", "pronto", "guarda", "allora", "diciamo",
                 "tipo", "vabbè", "buongiorno", "buonasera", "salve", "ciao",
                 "arrivederci", "grazie", "prego", "scusami", "cortesia",
                 "perfavore", "favore", "mh", "eh", "ehm", "ok", "eccolo",
                 "ecco", "certo", "dunque", "aspetta", "dimmi", "sì",
                 "va bene"]
# Ordered domain rewrites (pattern alternatives, replacement).  Order matters:
# "10 e lotto" is rewritten before "l'otto", "gratta e vinci" before "gratta".
DOMAIN_REWRITES = [
    (r"gratta e vinci|gratta vinci|gratta\s?e\s?vinci", "grattaevinci"),
    (r"10 e lotto|dieci e lotto|10elotto", "diecielotto"),
    (r"million day|millionday", "millionday"),
    (r"grattini|gratta", "grattaevinci"),
    (r"l'otto|l otto", "lotto"),
    (r"tv|televisione|televisore|schermo|display", "monitor"),
    (r"stampantina|stampatrice", "stampante"),
    (r"human|umano|persona|cristiano|collega", "operatore"),
    (r"ribon|ribbon|nastri|rulli", "cartucce"),
    (r"vincite", "vincita"),
    (r"time out", "timeout"),
]
# Characters kept by the discovery cleaner besides whitespace.
KEPT_CHARS = "a-zàèéìòù0-9"

# --- fixed values: decision vocabulary ---
STATUS_VALID = "VALID"
STATUS_UNLISTED = "UNLISTED"
STATUS_NO_MATCH = "NO_MATCH"
LABEL_UNLISTED = "UNLISTED"
LABEL_NOMATCH = "NOMATCH"
SUMMARY_MATCH = "MATCH"
SUMMARY_MATCH_BOT = "MATCH_BOT"
SUMMARY_MISMATCH = "MISMATCH"
NOISE_LABEL = "NOISE"

# --- fixed values: column aliases of the utterance input ---
COLUMN_ALIASES = {
    "Phrase": "Phrase", "phrase": "Phrase", "Testo": "Phrase",
    "text": "Phrase", "UserUtterance": "Phrase",
    "Interaction ID": "Interaction ID", "ID": "Interaction ID",
    "Topic title": "Topic bot", "Bot Topic": "Topic bot",
}

# --- fixed values: confidence bands (label, lower, upper, lower-inclusive, upper-inclusive) ---
CONFIDENCE_BANDS = [
    ("Very High (>0.90)", 0.90, None, False, None),
    ("High (0.80-0.90)", 0.80, 0.90, True, True),
    ("Medium (0.70-0.80)", 0.70, 0.80, True, False),
    ("Low (0.50-0.70)", 0.50, 0.70, True, False),
    ("Very Low (<0.50)", None, 0.50, None, False),
]
