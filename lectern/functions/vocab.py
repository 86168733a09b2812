"""Word lists, patterns and phrases that decide results.  Fixed values, in natural order; all are default parameters."""

# Chapter titles that mark front and back matter.
BOILERPLATE_TITLES = (
    r"(?i)^\s*contents?\s*$",
    r"(?i)^\s*table\s+of\s+contents?\s*$",
    r"(?i)^\s*copyright",
    r"(?i)^\s*license",
    r"(?i)^\s*preface\s*$",
    r"(?i)^\s*appendix",
    r"(?i)^\s*index\s*$",
    r"(?i)^\s*glossary\s*$",
    r"(?i)^\s*bibliography\s*$",
    r"(?i)^\s*acknowledgements?\s*$",
    r"(?i)^\s*about\s+the\s+author\s*$",
    r"(?i)^\s*colophon\s*$",
)

# Text that marks front and back matter.
BOILERPLATE_TEXT = (
    r"(?i)project\s+gutenberg",
    r"(?i)this\s+ebook\s+is\s+for\s+the\s+use\s+of\s+anyone",
    r"(?i)terms\s+of\s+the\s+project\s+gutenberg\s+license",
    r"(?i)\*\*\*\s*START\s+OF\s+(THE\s+)?PROJECT\s+GUTENBERG",
    r"(?i)\*\*\*\s*END\s+OF\s+(THE\s+)?PROJECT\s+GUTENBERG",
    r"(?i)full\s+license\s+at\s+.*gutenberg\.org",
    r"(?i)www\.gutenberg\.org",
    r"(?i)most\s+recently\s+updated",
    r"(?i)release\s+date\s*:",
    r"(?i)language\s*:\s*english",
    r"(?i)credits?\s*:",
    r"(?i)html\s+version\s+by",
    r"(?i)produced\s+by",
    r"(?i)transcriber.?s?\s+note",
)

# Title-page fragments.
METADATA_TITLES = (
    r"(?i)^frankenstein;\s*$",
    r"(?i)^or,?\s+the\s+modern\s+prometheus\s*$",
    r"(?i)^by\s+",
)

# Words whose presence scores an emotion, in order of precedence on ties.
EMOTION_WORDS = {
    "angry": ("angry", "furious", "rage", "shouted", "screamed", "yelled", "slammed", "cursed"),
    "sad": ("sad", "tears", "cried", "sobbed", "mourned", "grief", "wept", "sorrow"),
    "happy": ("laughed", "smiled", "grinned", "joy", "happy", "delighted", "cheerful", "beamed"),
    "fearful": ("afraid", "terrified", "trembled", "scared", "horror", "panic", "dread", "shuddered"),
    "surprised": ("gasped", "stunned", "shocked", "amazed", "startled", "astonished"),
    "tender": ("gently", "softly", "tenderly", "lovingly", "caressed", "whispered"),
    "excited": ("exclaimed", "excited", "eager", "thrilled", "enthusiasm", "rushed"),
    "contemplative": ("thought", "pondered", "considered", "reflected", "wondered", "mused"),
}

# Whole words that decide emphasis, first match wins.
EMPHASIS_WORDS = {
    "whispered": ("whispered", "murmured", "hissed", "muttered"),
    "shouted": ("shouted", "yelled", "screamed", "bellowed", "roared"),
    "soft": ("softly", "quietly", "gently"),
    "strong": ("firmly", "strongly", "forcefully", "commanded"),
}

# Spoken-style instructions.
EMOTION_PHRASES = {
    "neutral": "",
    "happy": "Speak with warmth and a cheerful, happy tone.",
    "sad": "Speak with a somber, melancholic tone. Slow and reflective.",
    "angry": "Speak with intensity and controlled anger.",
    "fearful": "Speak with a trembling, anxious, fearful tone.",
    "surprised": "Speak with genuine surprise and astonishment.",
    "tender": "Speak softly and gently, with tenderness.",
    "excited": "Speak with energy and excitement, slightly faster.",
    "contemplative": "Speak thoughtfully and slowly, as if reflecting deeply.",
}
EMPHASIS_PHRASES = {
    "whispered": "Whisper this line very quietly.",
    "shouted": "Shout this line with force and volume.",
    "soft": "Speak very softly and gently.",
    "strong": "Speak firmly and with authority.",
    "normal": "",
}
PACING_PHRASES = {
    "slow": "Speak slowly.",
    "fast": "Speak quickly.",
    "urgent": "Speak with urgency and speed.",
}

# Preset voices.
MALE_VOICES = ("Ryan", "Aiden")
FEMALE_VOICES = ("Vivian", "Serena")
DEFAULT_VOICE = "Ryan"

# Verbs that attribute speech in paragraphs.
SPEECH_VERBS = (
    "said", "replied", "asked", "whispered", "shouted", "exclaimed", "muttered", "murmured", "cried", "called",
    "answered", "demanded", "insisted", "suggested", "declared", "announced", "remarked", "observed", "noted", "continued",
    "added", "growled", "snapped", "snarled", "pleaded", "begged", "urged", "warned", "sighed", "groaned",
    "laughed", "chuckled", "giggled", "sobbed",
)

# Verbs that attribute dialogue to characters over a whole text.
ATTRIBUTION_VERBS = (
    "said", "replied", "asked", "whispered", "shouted", "exclaimed", "cried", "muttered", "murmured", "answered",
    "declared", "remarked", "observed", "continued", "added", "called", "demanded", "insisted", "suggested", "growled",
    "snapped", "snarled", "pleaded", "begged", "urged", "warned", "sighed", "groaned", "laughed", "sobbed",
    "stammered", "gasped", "interrupted", "inquired", "retorted", "responded", "announced", "protested", "agreed", "acknowledged",
    "confessed", "admitted",
)
# Forms of a quote with a named speaker, in order of precedence; VERB stands for the verbs.
ATTRIBUTION_PATTERNS = (
    "[\"“‘][^\"”“’]+[\"”’]\\s*[,.]?\\s*(?:VERB)\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,2})",
    "[\"“‘][^\"”“’]+[\"”’]\\s*[,.]?\\s*([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,2})\\s+(?:VERB)",
    "([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,2})\\s+(?:VERB)\\s*[,:]?\\s*[\"“‘]",
)
SHORT_VERBS = ("replied", "whispered", "shouted", "asked", "exclaimed", "muttered", "murmured")
NAME_PATTERN = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"

# Words that no character's name holds.
STOP_NAMES = (
    "project", "gutenberg", "chapter", "volume", "letter", "part", "contents", "preface", "introduction", "epilogue",
    "prologue", "copyright", "license", "edition", "published", "author", "release", "ebook", "online", "transcriber",
    "editor", "translator", "illustrator", "publisher", "printer", "bibliography", "appendix", "footnote", "index", "glossary",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november",
    "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "god", "christ",
    "satan", "devil", "farewell", "creator", "paradise", "nature",
)

# Places and peoples that are no characters.
KNOWN_NON_CHARACTERS = (
    "rhine", "strasburgh", "strasbourg", "arve", "matlock", "rotterdam", "westmorland", "montanvert", "mont blanc", "ingolstadt",
    "chamounix", "chamonix", "plainpalais", "belrive", "lausanne", "cologny", "evian", "thonon", "edinburgh", "oxford",
    "paris", "london", "rome", "naples", "leghorn", "windsor", "perth", "dundee", "turk", "englishman",
    "genevan", "alpine", "archangel",
)

# Forms of address that are stripped from names.
HONORIFICS = (
    "mr", "mrs", "miss", "ms", "dr", "sir", "lady", "lord", "captain", "colonel",
    "major", "general", "professor", "reverend", "father", "mother", "brother", "sister", "uncle", "aunt",
    "dear", "dearest", "old", "young", "poor", "little", "good", "great", "beloved", "sweet",
    "fair", "noble", "wretched", "unhappy", "master", "madam", "madame", "monsieur", "mademoiselle", "signor",
    "count", "countess", "duke", "duchess", "prince", "princess", "king", "queen", "baron", "baroness",
)
SHORT_WORDS = ("i", "a", "an", "it", "he", "she", "we", "me", "my", "no", "so")

# Common first names.
MALE_NAMES = (
    "adam", "albert", "alexander", "alphonse", "andrew", "anthony", "arthur", "basil", "benjamin", "bernard",
    "caleb", "cecil", "charles", "clifford", "daniel", "david", "edgar", "edmund", "edward", "ernest",
    "ethan", "felix", "francis", "frederick", "george", "gerald", "harold", "henry", "herbert", "hugh",
    "isaac", "jack", "jacob", "james", "john", "joseph", "julius", "leonard", "luke", "marcus",
    "mark", "matthew", "michael", "nathaniel", "nicholas", "oliver", "oscar", "owen", "patrick", "paul",
    "percy", "peter", "philip", "ralph", "raymond", "reginald", "richard", "robert", "roger", "rupert",
    "samuel", "sebastian", "simon", "stephen", "theodore", "thomas", "timothy", "victor", "vincent", "walter",
    "william",
)
FEMALE_NAMES = (
    "abigail", "agatha", "alice", "amelia", "anne", "beatrice", "bridget", "caroline", "catherine", "cecilia",
    "charlotte", "clara", "cordelia", "diana", "dorothy", "edith", "eleanor", "elizabeth", "emily", "emma",
    "ethel", "florence", "frances", "gertrude", "grace", "harriet", "helen", "ida", "isabella", "jane",
    "josephine", "juliet", "justine", "katherine", "laura", "lucy", "mabel", "margaret", "maria", "martha",
    "mary", "matilda", "miranda", "nora", "ophelia", "penelope", "rachel", "rosalind", "rose", "ruth",
    "safie", "sarah", "sophia", "victoria", "violet", "vivian",
)
