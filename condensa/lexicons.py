"""The library's own word lists and starter rules. Every function that uses one takes another as a parameter.

Function words and consonant clusters are counts over the English texts of the
test corpus (its most frequent words and consonant pairs, in that order), and
lists of function words are picked from them; all others were written for this
library.
"""

from __future__ import annotations

#: the 20 most frequent English words of the test corpus
FREQUENT = ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as", "this", "are", "at", "from"]
#: words that a telegraphic rewrite leaves out
DROPPABLE = FREQUENT
#: words that carry no topic
STOP = FREQUENT
#: the prepositions among the frequent words: what tells how the parts of a sentence belong together
CLUES = ["of", "to", "in", "for", "on", "with", "by", "at", "from"]
#: the 8 most frequent pairs of consonants
CLUSTERS = ["th", "nd", "nt", "ng", "st", "wh", "sh", "bl"]
#: words that join clauses, by the alphabet
CONNECTIVES = ["and", "as", "if", "or", "since", "that", "unless", "while"]
#: after these words ...
KEPT_BEFORE = {"is": ["not", "urgent", "due"], "are": ["not", "urgent", "due"], "to": ["ship", "pay", "order", "return"]}
#: phrases and their short forms, applied in this order
PHRASES = [("as soon as possible", "asap"), ("in the event of", "if"), ("a number of", "many"), ("it is", "it's"), ("that the", "tt"), ("and the", "& the"), ("to the", "2 the"), ("of the", "o/t"), ("for the", "4 the")]
FILLERS = ["please note that", "as you know", "needless to say", "it is that", "in fact", "of course"]
MODIFIERS = ["very", "quite", "rather", "really", "simply", "just", "this"]
#: between word borders
PASSIVE = [(r"(?:was|were) (\w+ed) by", "$1 via"), (r"is (\w+ed) by", "$1 via"), (r"are being (\w+ed)", "$1")]
VERBOSE = ["in the event of", "as a matter of", "and the", "that the", "with the", "on account of"]
TECH = ["query", "table", "shuffle", "cluster", "stream", "token", "http", "json", "tion"]
TECH_CONTEXT = ["query", "table", "token", "code"]
FORMAL = ["hence", "moreover", "whereas", "notwithstanding", "hereby"]
INFORMAL = ["gonna", "stuff", "kinda", "yeah", "okay"]
STEMS = ["data", "user", "order", "tion"]
DOMAINS = {
    "logistics": ["shipment", "carrier", "eta", "pallet", "ship"],
    "finance": ["invoice", "ledger", "payment", "price", "est"],
    "support": ["ticket", "refund", "customer", "reply", "he"],
}
CRITICAL = ["invoice", "customer", "payment", "the", "ment"]
CODE_MARKS = ["();", "){", "};", "::", "=>", "</", "/*", "#!", "def ", "fn ", "void ", "const ", "print("]
URL_MARKS = ["http://", "https://", "www.", "ftp://"]
ABBREVIATIONS = [("information", "info"), ("department", "dept"), ("management", "mgmt"), ("approximately", "approx"), ("with", "w/"), ("without", "w/o")]
SYMBOLS = [("and", "&"), ("at", "@"), ("plus", "+")]
#: the variant engine's own: whole words, phrases and sentence openers with what stands for them
VARIANT_WORDS = [("quarter", "qtr"), ("warehouse", "whse"), ("average", "avg"), ("delivery", "dlvy"), ("that", "tht"), ("from", "fr")]
VARIANT_PHRASES = [("on the other hand", "yet"), ("for the time being", "now"), ("in the", "i/t"), ("is the", "'s the")]
OPENERS = [("in short", "so "), ("that said", "yet "), ("for", "4 ")]
VARIANT_SYMBOLS = [("and", "&"), ("percent", "%"), ("to", "2"), ("at", "@")]
#: abbreviations that are safe on the balanced level, and phrases
SELECTIVE = [("quarterly", "qtrly"), ("temperature", "temp"), ("estimated", "est"), ("with", "w/"), ("this", "ths")]
SELECTIVE_PHRASES = [("with regard to", "on"), ("of the", "o/t")]
#: words that vocabularies tend to cut in two
SPLIT_WORDS = ["notwithstanding", "reconciliation", "warehousing", "thation", "ingtion", "ontion"]
#: the variant profile's terms
VARIANT_TECH = ["API", "SQL", "JSON", "ETL", "the", "is"]
VARIANT_DOMAIN = ["ledger", "pallet", "refund", "of", "and"]
VARIANT_FORMAL = ["shall", "hereby", "whereas", "that"]
DOMAIN_LITERALS = {"finance": [("payment", "pmt"), ("invoice", "inv")], "support": [("customer", "cust")]}
CONTENT_PATTERNS = {
    "code": [r"def \w+\(", r"class \w+", r"import \w+", r"function \w+", r"</?(?:div|p|span|a|li)\b"],
    "configuration": [r"^\w+ *= *\S+", r"^\w+: *\S+", r"<meta "],
    "documentation": [r"^#+ ", r"^[-*] ", r"<h[1-6]"],
    "prose": [r"[.!?] [A-Z]", r", \w+"],
}
#: priority bands: name, least, most
BANDS = [("high", 900, 10**6), ("medium", 700, 899), ("low", 500, 699)]
#: id, original, compressed, pattern_type, priority, domain, frequency, success_rate
RULES = [
    (1, "quarterly report", "Q-rpt", "compound", 900, "business", 12, 0.97),
    (2, "temperature", "temp", "word", 820, "general", 9, 0.85),
    (3, "purchase order", "purch ord", "compound", 950, "business", 31, 0.99),
    (4, "order", "ord", "word", 600, "general", 40, 0.50),
    (5, "estimated time of arrival", "ETA", "phrase", 880, "logistics", 5, 0.90),
    (6, "and the", "& the", "phrase", 910, "general", 77, 0.96),
    (7, "with", "w/", "word", 840, "general", 25, 0.90),
    (8, "and", "&", "word", 700, "general", 88, 0.92),
    (9, "that", "tht", "word", 730, "general", 17, 0.80),
    (10, "tion", "tn", "compound", 650, "general", 60, 0.70),
    (11, "from", "frm", "word", 560, "general", 8, 0.40),
    (12, "the th", "th th", "structure", 905, "general", 3, 0.95),
    (13, "order", "odr", "word", 610, "logistics", 2, 0.30),
    (14, "ord", "od", "abbreviation", 520, "general", 1, 0.20),
]
PRICES = {"small": 0.0005, "medium": 0.03, "large": 0.06}
