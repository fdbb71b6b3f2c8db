"""Word lists and patterns that results depend on."""

# Column-name tokens that hint at an identifier.
IDENTIFIER_TOKENS = [
    "id", "uuid", "guid", "zip", "zipcode", "postal", "postcode", "pin", "pincode",
    "phone", "mobile", "ssn", "ein", "isbn", "imei", "iban", "account", "acct",
    "invoice", "order", "sku", "upc", "ean", "barcode", "code", "no", "num",
    "number", "reference", "ref",
]

# Lower-cased spellings of "missing".
MISSING_WORDS = [
    "", "na", "n/a", "null", "none", "nan", "-", "--", "?", "unknown", "#n/a",
]

# Lower-cased country spellings and their standard form.
COUNTRY_ALIASES = {
    "us": "United States",
    "u.s.": "United States",
    "usa": "United States",
    "united states": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "united kingdom": "United Kingdom",
}

# Name tokens that mark date, money and e-mail columns.
DATE_TOKENS = ["date", "time", "timestamp"]
MONEY_TOKENS = ["price", "amount_paid", "cost"]

# Cell patterns.
PADDED_NUMBER = r"^0[0-9]+$"
ISO_DATE_LIKE = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?$"
DAY_MONTH_LIKE = r"^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}$"
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
NUMBER = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))"
