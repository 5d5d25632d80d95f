"""Word lists and lookup tables of the normalisation rules."""

# Words of a name that carry no identity.
STOP_WORDS = (
    "inc incorporated llc ltd limited pvt private corp corporation co company llp plc pc the and of dr mr mrs ms smt shri group services "
    "holdings sarl sas sasu sci sa ets cie com net org www dba fka aka formerly nee née"
).split()
# Digits that stand for letters inside words, and the letters.
HOMOGLYPH_DIGITS, HOMOGLYPH_LETTERS = "01345678", "oleasgtb"
# Words of an address that many addresses share.
GENERIC_STREET = "road street null none city near floor door drive avenue lane nagar unit suite plot shop office flat building sector north south east west".split()
# Values of an address field that mean there is none.
NO_ADDRESS = ("", "none", "null", "nan", "<null>", "n/a")
# Address words and what they stand for; nothing means they are left out.
ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive",
    "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway", "cir": "circle", "ter": "terrace",
    "trl": "trail", "sq": "square", "mt": "mount", "ft": "fort", "n": "north", "s": "south", "e": "east", "w": "west",
    "apt": "unit", "ste": "unit", "suite": "unit", "bldg": "building", "fl": "floor", "no": "", "nr": "near", "opp": "opposite",
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in",
    "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma",
    "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "tennessee": "tn", "texas": "tx", "utah": "ut",
    "vermont": "vt", "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
    "maharashtra": "mh", "karnataka": "ka", "telangana": "tg", "delhi": "dl", "gujarat": "gj", "kerala": "kl",
    "rajasthan": "rj", "haryana": "hr", "punjab": "pb", "bihar": "br", "odisha": "od", "orissa": "od", "goa": "ga",
}
# French street words.
FRENCH_STREET = {
    "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "blvd": "boulevard", "rte": "route", "ch": "chemin",
    "pl": "place", "imp": "impasse", "all": "allee", "sq": "square", "st": "saint", "ste": "sainte", "fg": "faubourg",
    "fbg": "faubourg", "qu": "quai", "crs": "cours", "pass": "passage", "rd": "road", "dr": "drive", "ln": "lane",
}
# Words that a name core leaves out, as a pattern; any single letter is one.
NAME_FILLER = (
    "llc|l l c|inc|incorporated|corp|corporation|ltd|limited|pvt|private|co|company|lp|llp|pc|pllc|sarl|sas|sasu|sa|sci|"
    "eurl|cie|ets|the|and|a|of|center|centre|services|service|partners|dba|smt|sri|shri|mr|dr|formerly|as|aka|doing|"
    "business|fka|nee|known|trading|enterprises|group|groupe|developpement|development|[a-z]"
)
# Classes of legal forms.
LEGAL_CLASSES = {
    "inc": 1, "incorporated": 1, "llc": 2, "ltd": 3, "limited": 3, "pvt": 4, "private": 4, "corp": 5, "corporation": 5, "co": 6, "company": 6,
    "llp": 7, "plc": 8, "pc": 9, "sarl": 10, "sas": 11, "sasu": 11, "sci": 12, "sa": 13, "ets": 14,
}
# Legal forms and trade words that address-only candidates are looked up for, as a pattern.
TRADE_FORMS = (
    r"\b(llc|l l c|inc|corp|corporation|ltd|limited|pvt|private|co|company|fund|trust|holdings|group|partners|lp|llp|associates|pc|pllc|enterprises|"
    r"services|industries|capital|management|sarl|sas|sasu|sci|eurl|sa|cie|fils)\b"
)
