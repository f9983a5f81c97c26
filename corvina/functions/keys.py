"""Keys of products: identity, family, and comparable words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions.normalize import normalize

# Fixed values (also the patterns of identity_key and family_key below, whose results are join keys): words of no weight, types and strengths that must not differ, and other names of brands.
NO_WEIGHT = ["and", "ve", "the"]
PROTECTED = ["spf", "pa", "retinol", "niacinamide", "aha", "bha", "vitamin", "serum", "cream", "foundation", "concealer", "powder", "sunscreen", "toner", "shampoo", "mask", "matte", "glow", "oil", "gel", "lotion", "primer", "cleanser", "lipstick"]
TYPE_NAMES = {"allik": "blush", "fondoten": "foundation", "kapatici": "concealer", "krem": "cream", "kremi": "cream", "maskara": "mascara", "ruj": "lipstick", "tonik": "toner", "esans": "essence", "esansi": "essence"}
BRAND_NAMES = {"l oreal": "loreal", "l oreal paris": "loreal", "loreal paris": "loreal", "maybelline new york": "maybelline", "kiehl s": "kiehls", "the ordinary": "ordinary", "la roche posay": "larocheposay"}

# Brands a card shows as one, words that are one there, and the initials of a brand without any.
SHOWN_BRANDS = {"maybelline new york": "maybelline", "kiehls since 1851": "kiehls", "l oreal paris": "loreal", "loreal paris": "loreal"}
SHOWN_WORDS = {"fondoten": "foundation", "fondotenim": "foundation"}
NO_INITIALS = "SK"


def display_key(brand: Column, name: Column, category: Column) -> Column:
    """What makes two products one card: plain brand, name and category. Sizes, shades and strengths tell cards apart; null where the
    brand or the name has no letter or digit."""
    named = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    b, n = normalize(brand, "display"), normalize(name, "display")
    words = F.array_join(F.transform(F.split(n, " "), lambda w: F.coalesce(F.try_element_at(named(SHOWN_WORDS), w), w)), " ")
    return F.when((b != "") & (n != ""), F.concat_ws("|", F.coalesce(F.try_element_at(named(SHOWN_BRANDS), b), b), words, normalize(category, "display")))


def initials(brand: Column) -> Column:
    """The first letters of a brand's first two words, as capitals."""
    words = F.slice(F.filter(F.split(F.coalesce(brand, F.lit("")), r"\s+"), lambda w: w != ""), 1, 2)
    return F.coalesce(F.nullif(F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")), F.lit("")), F.lit(NO_INITIALS))


def _spelled_signs(c: Column) -> Column:
    """Signs that tell products apart as words: %, &, a + between words, a + at the end of one."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[™®©℠\\x{fe0f}]", "")
    c = F.regexp_replace(F.regexp_replace(c, "%", " pct "), "&", " and ")
    c = F.regexp_replace(c, "(?U)(?<=\\w)\\+(?=\\w)", " and ")
    c = F.regexp_replace(c, "(?U)\\s\\+\\s", " and ")
    return F.regexp_replace(c, "\\+", " plus ")


def _bare(c: Column) -> Column:
    """Letters, digits and blanks; a size's number and unit are one word."""
    c = F.regexp_replace(c, "[^a-z0-9 ]", " ")
    return F.regexp_replace(c, "(?<=\\d)\\s+(?=(?:cc|ml|gr|g|mg|oz)\\b)", "")


def identity_key(brand: Column, name: Column) -> Column:
    """brand without blanks, a bar, the name's words sorted: equal for spellings of one product. Null counts as empty."""
    b = F.regexp_replace(_bare(normalize(_spelled_signs(brand), "identity")), " ", "")
    words = F.filter(F.split(_bare(normalize(_spelled_signs(name), "identity")), "\\s+"), lambda w: (w != "") & ~w.isin(NO_WEIGHT))
    words = F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(w, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(w))
    return F.concat(b, F.lit("|"), F.array_join(F.array_sort(words), " "))


def family_key(brand: Column, name: Column) -> Column:
    """Brand and name without sizes and shade numbers, types under one name: equal for the variants of a family."""
    n = normalize(name, "link")
    n = F.regexp_replace(n, "\\b\\d+(?:[.,]\\d+)?\\s*(?:ml|gr|g|gram|oz)\\b", " ")
    n = F.regexp_replace(n, "\\b(?:no|numara|numarasi|numarali|shade)\\s*#?\\d+(?:[.,]\\d+)?\\b", " ")
    n = F.regexp_replace(n, "\\b#?\\d+(?:[.,]\\d+)?\\s*(?:numara|numarasi|numarali|shade)\\b", " ")
    words = F.filter(F.split(F.trim(n), "\\s+"), lambda w: ~w.isin("", "numara", "numarasi", "numarali"))
    types = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    words = F.transform(words, lambda w: F.coalesce(F.try_element_at(types, w), w))
    return F.concat(normalize(normalize(brand, "brand"), "link"), F.lit("::"), F.array_join(words, " "))


def comparable_brand(brand: Column) -> Column:
    """The plain brand under its one name."""
    names = F.create_map(*[F.lit(x) for kv in BRAND_NAMES.items() for x in kv])
    p = normalize(brand, "plain")
    return F.coalesce(names[p], p)


def feature_words(name: Column) -> Column:
    """A name's words without articles, in order."""
    words = F.transform(F.split(normalize(name, "plain"), " "), lambda w: F.when(w == "fondoten", "foundation").otherwise(w))
    return F.filter(words, lambda w: ~w.isin("", "the", "a", "an"))


def numeric_words(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike("[0-9]"))))


def protected_words(words: Column) -> Column:
    return F.array_sort(F.array_intersect(words, F.array(*map(F.lit, PROTECTED))))
