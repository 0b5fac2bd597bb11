"""Concept and tone lexicon. Slug, label, category and patterns of each concept, and tone patterns."""

CONCEPTS = [
    ("democracy", "Demokrasi", "democratic_reform", [r"\bdemokra\w*", r"\bdemokratikles\w*"]),
    ("reform", "Reform", "democratic_reform", [r"\breform\w*", r"\byeniden yapilan\w*", r"\byapisal donus\w*"]),
    ("european_union", "Avrupa Birligi", "democratic_reform", [r"\bavrupa birligi\b", r"\bab\b", r"\bmuzakere sureci\b", r"\bkatilim ortakligi\b"]),
    ("law_state", "Hukuk Devleti", "democratic_reform", [r"\bhukuk\w*", r"\bhukuk devleti\b", r"\bhukukun ustunlugu\b", r"\byargi\w*"]),
    ("economy", "Ekonomi", "macro_economy", [r"\bekonomi\w*", r"\bekonomik\w*", r"\bkalkinma\w*", r"\bbuyume\w*", r"\bistikrar\w*"]),
    ("imf", "IMF", "macro_economy", [r"\bimf\b", r"\bstand[- ]?by\b", r"\buluslararasi para fonu\b"]),
    ("inflation", "Enflasyon", "macro_economy", [r"\benflasyon\w*", r"\bfiyat istikrar\w*"]),
    ("interest", "Faiz", "macro_economy", [r"\bfaiz\w*"]),
    ("security", "Guvenlik", "security_conflict", [r"\bguvenlik\w*", r"\bteror\w*", r"\btehdit\w*"]),
    ("sovereignty", "Egemenlik", "security_conflict", [r"\begemenlik\w*", r"\bmilli egemenlik\b", r"\bulusal egemenlik\b", r"\bmilli irade\b"]),
    ("constitution", "Anayasa", "constitutional_conflict", [r"\banayasa\w*", r"\banayasal\w*", r"\bcumhurbaskani secimi\b", r"\b367\b"]),
    ("tutelage", "Vesayet", "constitutional_conflict", [r"\bvesayet\w*", r"\bmuhtira\w*", r"\be[- ]?muhtira\b"]),
]
POSITIVE = [
    r"\bdestek\w*", r"\bsavun\w*", r"\bguclen\w*", r"\biyiles\w*", r"\bolumlu\w*", r"\buyum\w*", r"\bcozum\w*", r"\bkatil\w*", r"\buyelik\w*", r"\bilerle\w*", r"\bgerekli\w*",
    r"\bonemli\w*", r"\bbagimsiz\w*", r"\bozgurluk\w*", r"\brefah\w*", r"\bbasari\w*", r"\bkoru\w*", r"\byatirim\w*", r"\bguvence\w*", r"\bsaglam\w*", r"\bistikrar\w*",
]
NEGATIVE = [
    r"\bkriz\w*", r"\bsorun\w*", r"\btehdit\w*", r"\byanlis\w*", r"\byetersiz\w*", r"\bbasarisiz\w*", r"\bhukuksuz\w*", r"\bantidemokrat\w*", r"\bmudahale\w*", r"\bbaski\w*", r"\bkarsi\w*", r"\bredd\w*",
    r"\byolsuzluk\w*", r"\brisk\w*", r"\bsikinti\w*", r"\bcokus\w*", r"\bissiz\w*", r"\byoksulluk\w*", r"\bzarar\w*", r"\bengel\w*", r"\bdayatma\w*", r"\bvesayet\w*", r"\bmuhtira\w*",
]
#: A text that none of these matches gets no mentions, whatever the concepts' patterns say.
PREFILTER = "demokra|reform|avrupa birligi|\\bab\\b|hukuk|yargi|ekonomi|ekonomik|kalkinma|buyume|istikrar|imf|enflasyon|faiz|guvenlik|teror|tehdit|egemenlik|milli irade|anayasa|vesayet|muhtira"
