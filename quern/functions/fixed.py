"""Values that results depend on, fixed by the data model."""

# Slug, tier, English title, in the order in which collections are numbered.
COLLECTIONS = [
    ("bukhari", 0, "Sahih al-Bukhari"),
    ("muslim", 1, "Sahih Muslim"),
    ("abudawud", 2, "Sunan Abi Dawud"),
    ("tirmidhi", 3, "Jami' al-Tirmidhi"),
    ("nasai", 4, "Sunan al-Nasa'i"),
    ("ibnmajah", 5, "Sunan Ibn Majah"),
    ("ahmad", 6, "Musnad Ahmad ibn Hanbal"),
    ("mishkat", 7, "Mishkat al-Masabih"),
    ("riyadussalihin", 8, "Riyad as-Salihin"),
    ("shamail", 11, "Shama'il al-Muhammadiyah"),
    ("bulugh", 10, "Bulugh al-Maram"),
    ("adab", 9, "Al-Adab Al-Mufrad"),
    ("forty", 12, "Forty Hadith Collections"),
    ("hisn", 13, "Hisn al-Muslim"),
    ("virtues", 14, "Virtues"),
]
#: Tier of a collection that has none.
LAST_TIER = 15

# Grade classes and their rank.
GRADE_TIERS = {"sahih": 0, "hasan_sahih": 1, "hasan": 2, "daif": 3, "ungraded": 4, "maudu": 5}

# Weights of the keyword, dense and term legs by mode.
MODE_WEIGHTS = {"concept": (0.2, 1.0, 0.4), "keyword": (1.0, 0.4, 0.4), "term": (0.2, 0.4, 1.0)}

# Words of a term query that carry no meaning.
CONNECTIVES = ("e", "ul", "al", "ush", "ash", "an", "ar", "as", "at", "az", "ad")

# The facet order's first slugs, and prefixes and nicknames of titles in citations.
FIRST_FACETS = ("bukhari", "muslim", "abudawud", "tirmidhi", "nasai", "ibnmajah")
TITLE_PREFIXES = ("sahih", "sunan", "jami", "musnad", "al", "an", "ar", "as", "at", "az", "ad")
NICKNAMES = {"nawawi": "forty", "nawawi40": "forty", "riyadussaliheen": "riyadussalihin"}

# BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25

# Latin letters of Arabic, Persian and Urdu ones; those of several letters, and those of one.
ROMAN_PAIRS = [("ث", "th"), ("خ", "kh"), ("ذ", "dh"), ("ش", "sh"), ("چ", "ch"), ("ٹ", "tt"), ("ڈ", "dd"), ("ڑ", "rr")]
ROMAN_FROM = "بةتجحدرزسصضطظغفقكلمنهاأإآوؤيئىپژکگیںہھےءع"
ROMAN_TO = "b@tjHdrzsSDTZGfqklmnhaaaawwyyypjkgyNhhy"

# Latin spellings of the letters U+0671 to U+06D3, in their order; - is none.
ROMAN_EXTENDED = (
    "' ' ' - ' 'w 'u 'y tt tth b t T p th bh 'h H ny dy H ch cch dd D D Dt dh ddh d D D rr R R R R R R j R S S S S S T GH F F F v f ph Q Q kh k K K ng K g G N G G G L L L L "
    "N N N N N h Ch hy h H @ W oe oe u yu yu W v y Y Y W - - y y'"
).split()
#: Latin letters that do not decompose, as they are spelt.
ROMAN_LATIN = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "Ŋ": "NG"}

# Pairs of Latin letters that a skeleton has as one.
SKELETON_PAIRS = (("kh", "k"), ("gh", "g"), ("dh", "d"), ("th", "t"), ("sh", "s"))

# The markup of Arabic texts, and the ranges of Arabic marks and letters.
NARRATOR = r'(?s)\[narrator\s+id="(\d+)"\s+role="([^"]*)"\s+tooltip="([^"]*)"\](.*?)\[/narrator\]'
MARKER = r"\[(?!narrator\b|/narrator\b)[^\]]*\]"
MARKS = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
ARABIC = r"[\x{0621}-\x{063A}\x{0641}-\x{064A}\x{0671}-\x{06D3}]+"
