"""Column functions that check, clean and measure text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Language tags and their codes.
LANGUAGE_TAGS = {
    "en": "en", "en-us": "en", "en-gb": "en", "ru": "ru", "ru-ru": "ru", "de": "de", "de-de": "de", "es": "es", "es-es": "es", "es-419": "es",
    "it": "it", "it-it": "it", "fr": "fr", "fr-fr": "fr", "fr-ca": "fr", "ja": "ja", "ja-jp": "ja",
    "zh": "zh", "zh-cn": "zh", "zh-hans": "zh", "zh-hans-cn": "zh", "ko": "ko", "ko-kr": "ko", "hi": "hi", "hi-in": "hi",
}
# Marks that shape text and may stay in it.
SHAPING = r"\x{09}\x{0A}\x{0D}\x{061C}\x{200C}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FE0E}\x{FE0F}"
NONCHARACTERS = r"\x{FDD0}-\x{FDEF}" + "".join(rf"\x{{{p:X}FFFE}}\x{{{p:X}FFFF}}" for p in range(17)).replace("{0FFF", "{FFF")
# Blocks of Chinese, Japanese and Korean code points.
CJK = (
    r"\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3130}-\x{318F}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    r"\x{A960}-\x{A97F}\x{AC00}-\x{D7AF}\x{D7B0}-\x{D7FF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
)


# Apostrophes that count as one, and marks that stand against the word before them.
APOSTROPHES = "\u2018\u2019\u201b\u02bc\uff07"
GLUED = ".,!?;:%)]}。！？，、；：％）］｝」』】।॥"
HALF_JA = r"^[\x00-\x7F\x{FF61}-\x{FF9F}]+$"
HALF_KO = r"^[\x00-\x7F\p{P}\p{S}]+$"
# Characters that are a grapheme each, whichever of them stand side by side.
ALONE = (
    r"\x00-\x0C\x0E-\x{AC}\x{AE}-\x{2FF}\x{370}-\x{482}\x{48A}-\x{52F}\x{2010}-\x{2027}\x{3000}-\x{3029}\x{3041}-\x{3096}\x{309B}-\x{30FF}"
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF01}-\x{FF9D}"
)
# Characters that are composed whichever of them stand side by side, and have one lower case anywhere.
STEADY = (
    r"\x00-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{200B}-\x{205E}\x{20A0}-\x{20BF}\x{3000}-\x{3029}\x{3041}-\x{3096}\x{309B}-\x{30FF}"
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FE0F}\x{FF01}-\x{FF9D}\x{1F300}-\x{1F6FF}\x{1F900}-\x{1FAFF}"
)
# The steady characters whose folded case isn't the lower one, in lower case.
FOLDED = {"\u00b5": "\u03bc", "\u00df": "ss", "\u0149": "\u02bcn", "\u017f": "s"}
SPACE = r"(?U)\s"  # white space of all of Unicode, as NBSP and U+3000


PRIVATE = "<private-path>"


def strip(text: Column) -> Column:
    return F.regexp_extract(text, r"(?Us)^\s*(.*\S)?", 1)


def is_blank(text: Column) -> Column:
    """Nothing but white space; null for null."""
    return ~text.rlike(r"(?U)\S")


@F.pandas_udf(StringType())
def _composed(text: pd.Series, fold: pd.Series) -> pd.Series:
    """Lower or folded case in composed form; only rows with characters that aren't steady come here, the others as null."""
    nfc = lambda t: unicodedata.normalize("NFC", t)
    low = lambda t, f: nfc(nfc(t).casefold() if f else nfc(t).lower())
    return pd.Series([None if t is None else low(t, f) for t, f in zip(text, fold)], dtype=object)


def _loose(text: Column) -> Column:
    """Whether a text has characters that aren't steady."""
    # a class of many ranges is slow to match, so one range comes first that keeps most characters from it
    return text.rlike(rf"[\x{{300}}-\x{{10FFFF}}&&[^{STEADY}]]")


def _lower(text: Column) -> Column:
    """Lower case of steady text by the rules of no language; a plain lower() goes by the locale of the JVM."""
    return F.collate(F.lower(F.collate(text, "UNICODE_CI")), "UTF8_BINARY")


def _folded(low: Column, apostrophe: str) -> Column:
    """Folded case of steady text in lower case."""
    for one, folded in FOLDED.items():
        low = F.replace(low, F.lit(one), F.lit(folded.replace("\u02bc", apostrophe)))
    return low


def case_folded(text: Column) -> Column:
    """The text in composed form and folded case."""
    return F.coalesce(_composed(F.when(_loose(text), text), F.lit(True)), _folded(_lower(text), "\u02bc"))


def token_key(word: Column) -> Column:
    """What counts of a word in one case: letters, marks, digits and apostrophes; empty without a letter or digit."""
    kept = F.regexp_replace(F.translate(word, APOSTROPHES, "'" * len(APOSTROPHES)), r"[^\p{L}\p{M}\p{N}']", "")
    return F.when(kept.rlike(r"[\p{L}\p{N}]"), kept).otherwise("")


def _key(cased: Column) -> Column:
    """token_key of each word that has one, joined by spaces; the text is gone through whole, not word by word."""
    told = F.regexp_replace(cased, rf"[\x{{2BC}}-\x{{FF07}}&&[{APOSTROPHES}]]", "'")
    kept = F.regexp_replace(told, r"(?U)[\x00-\x1F!-`{-\x{10FFFF}&&[^\p{L}\p{M}\p{N}'\s]]", "")
    spaced = F.concat(F.lit(" "), F.regexp_replace(kept, r"(?U)[\x00-\x1F\x{85}-\x{3000}&&\s]", " "))
    return F.trim(F.regexp_replace(spaced, r" ['\p{M}]*+(?![^ ])", ""))


def _steady_key(text: Column) -> Column:
    """duplicate_key of texts whose characters are all steady, null for others. It stands in both keys, first in its
    coalesce, so that Spark takes it once for a text whose two keys are wanted."""
    return _key(_lower(F.when(~_loose(text), text)))


def _loose_key(text: Column, fold: bool) -> Column:
    return _key(_composed(F.when(_loose(text), text), F.lit(fold)))


def compare_key(text: Column) -> Column:
    """Letters, marks, digits and apostrophes of each word, in composed form and folded case; words without a letter or
    digit go. Null for null."""
    return F.coalesce(_folded(_steady_key(text), "'"), _loose_key(text, True))


def duplicate_key(text: Column) -> Column:
    """The same in lower case, so that Maße and Masse differ."""
    return F.coalesce(_steady_key(text), _loose_key(text, False))


def char_units(text: Column, lang: Column) -> Column:
    """Readable width: a grapheme counts one and line ends nothing; in Japanese, ASCII and half-width forms count a half,
    in Korean, ASCII, punctuation and symbols."""
    clusters = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)\X"), F.lit(0)), lambda c: ~c.isin("\n", "\r"))
    half = lambda p: F.size(F.filter(clusters, lambda c: c.rlike(p))) / F.lit(2.0)
    less = F.when(lang == "ja", half(HALF_JA)).when(lang == "ko", half(HALF_KO)).otherwise(F.lit(0.0))
    # where every character is a grapheme, what counts is what is left without the others
    left = lambda p: F.length(F.regexp_replace(text, p, ""))
    halves = F.when(lang == "ja", left(r"[\n[^\x00-\x7F\x{FF61}-\x{FF9F}]]")).when(lang == "ko", left(r"[\n[^\x00-\x7F\p{P}\p{S}]]")).otherwise(F.lit(0))
    plain = F.length(F.translate(text, "\n", "")) - halves / F.lit(2.0)
    return F.when(joined(text), F.size(clusters) - less).otherwise(plain)


def joined(text: Column) -> Column:
    """Whether a text has characters that may be a grapheme with others."""
    # a class of many ranges is slow to match, so only texts with what may join others are looked at by it
    return text.rlike(r"[\r\x{AD}\x{300}-\x{10FFFF}]") & text.rlike(f"[^{ALONE}]")


def join_words(words: Column, lang: Column) -> Column:
    """Text of an array of words in order: a word's own leading space stays, closing punctuation is joined, and other
    words get a space, but for Japanese and Chinese. Null and empty words are passed over."""
    close = lang.isin("ja", "zh")

    def step(acc, w):
        bare = F.regexp_replace(w, r"(?U)^\s+", "")
        return (
            F.when(w.isNull() | (w == ""), acc).when(acc == "", bare).when((bare == "") | w.rlike(r"(?U)^\s") | close, F.concat(acc, w))
            .when(F.instr(F.lit(GLUED), F.substring(bare, 1, 1)) > 0, F.concat(acc, bare)).otherwise(F.concat(acc, F.lit(" "), w))
        )

    return strip(F.aggregate(words, F.lit(""), step))


def graphemes(text: Column) -> Column:
    """Number of user-visible characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?s)\X"), F.lit(0)))


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def language_code(tag: Column) -> Column:
    """The code of a language tag, or null."""
    low = F.lower(F.translate(strip(tag), "_", "-"))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_TAGS.items() for x in pair])
    return F.try_element_at(known, low)


def safe_number(text: Column) -> Column:
    """The number, or null for what is none, NaN or infinite."""
    n = text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def damage(text: Column) -> Column:
    """Why a text can't be shown: empty, or the kind of its first bad code point; null where it is sound."""
    # a class of many ranges is slow to match, so only texts with what may be bad are looked at by it
    odd = F.when(text.rlike(r"[\x00-\x09\x0B-\x1F\x7F-\x9F\xAD\x{600}-\x{10FFFF}]"), text)
    bad = F.regexp_extract(strip(odd), rf"[\x{{FFFD}}{NONCHARACTERS}[\p{{Cc}}\p{{Cf}}&&[^{SHAPING}]]]", 0)
    return (
        F.when(text.isNull() | is_blank(text), "empty").when(bad.isNull() | (bad == ""), F.lit(None)).when(bad == "�", "replacementCharacter")
        .when(bad.rlike(rf"[{NONCHARACTERS}]"), "invalidUnicodeScalar").otherwise("disallowedControlCharacter")
    )


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in text], dtype=object)


def composed(text: Column) -> Column:
    """The text in composed form. Steady characters are composed already, so only texts with others are looked at."""
    return F.coalesce(_nfc(F.when(_loose(text), text)), text)


def simplified_pairs(spark) -> tuple[str, str]:
    """Traditional Chinese characters and the simplified ones for them, as two strings, by the rules of ICU, which comes with
    Spark. Characters are taken one by one; rules for words of several aren't applied."""
    every = [chr(c) for lo, hi in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)) for c in range(lo, hi + 1)]
    rules = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    pairs = [(a, b) for a, b in zip(every, rules.transliterate("\n".join(every)).split("\n")) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def caption(text: Column, lang: Column | None = None, simplified: tuple[str, str] | None = None) -> Column:
    """One line in composed form: white space collapsed, none around an apostrophe between letters. simplified: characters
    and what stands for them in Chinese (see simplified_pairs)."""
    plain = F.trim(F.regexp_replace(composed(text), r"(?U)\s{2,}|[^\S ]", " "))  # a single space stays as it is
    close = plain
    for mark in ("'", "’"):
        close = F.regexp_replace(close, rf"(?<=\p{{L}}) ?{mark} ?(?=\p{{L}})", mark)
    # a search that looks behind at every character is slow, so texts without a mark are left out
    plain = F.when(text.contains("'") | text.contains("’"), close).otherwise(plain)
    return plain if lang is None or simplified is None else F.when(lang == "zh", F.translate(plain, *simplified)).otherwise(plain)


def redact_paths(text: Column, private: Column | None = None) -> Column:
    """Private values and absolute paths replaced by a mark, line ends made one kind. private: an array of values, of which
    those of three characters or more go, longest first; of a path also its last part. Then quoted paths, whose quotes stay,
    then bare ones, which begin where no letter, digit or colon is before them and end at white space, quotes or brackets."""
    out = F.regexp_replace(text, "\r", "\n")
    if private is not None:
        whole = F.filter(private, lambda v: v.isNotNull())
        names = F.transform(F.filter(whole, lambda v: v.startswith("/")), lambda v: F.substring_index(F.regexp_replace(v, "/+$", ""), "/", -1))
        known = F.filter(F.array_distinct(F.concat(whole, names)), lambda v: F.length(v) >= 3)
        longest = F.transform(F.array_sort(F.transform(known, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])
        out = F.coalesce(F.aggregate(longest, out, lambda t, v: F.replace(t, v, F.lit(PRIVATE))), out)
    for quote in ('"', "'"):
        out = F.regexp_replace(out, rf"{quote}/[^{quote}\r\n]+{quote}", f"{quote}{PRIVATE}{quote}")
    return F.regexp_replace(out, r"""(?<![A-Za-z0-9:])/[^\s"'<>\[\](),;]+""", PRIVATE)


def without_events(text: Column, prefix: str) -> Column:
    """The lines of a text that are no events."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith(prefix)), "\n")
