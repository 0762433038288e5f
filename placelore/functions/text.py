"""Folding, splitting and phrase making as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelore import params as P

KEEP = "åäö"
#: Characters between words, as a character class. Hyphen, colon, brackets, plus and at are none.
GAPS = "[ ?!\"'#%*&()=,;._\\n\\r\\t/]+"


def _folds() -> tuple[str, str]:
    """Letters of Latin-1, Latin Extended-A and the Vietnamese block to their base letter, by canonical decomposition.

    å, ä and ö stay. Letters without a decomposition (ø, đ, ł, ...) are given below.
    """
    special = {"ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t", "ŋ": "n"}
    source, target = [], []
    for block in (range(0xE0, 0x180), range(0x1EA0, 0x1EFA)):
        for code in block:
            c = chr(code).lower()
            if len(c) != 1 or c in KEEP or c in source:
                continue
            base = special.get(c) or unicodedata.normalize("NFD", c)[0]
            if base != c and base.isascii() and base.isalpha():
                source.append(c)
                target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _folds()
DASHES = "".join(map(chr, [*range(0x2012, 0x2016), 0x2212, *range(0x2190, 0x2200)]))
#: Symbols and what they become; those of DROPPED vanish.
SYMBOLS_FROM, SYMBOLS_TO = "²´¡•“”„″‘’‚′" + DASHES, "2'!.\"\"\"\"''''" + "-" * len(DASHES)
DROPPED = "°®™"
#: Longer replacements, in order: combining marks first, then ligatures and the ellipsis.
REPLACED = (("é", "é"), ("ä", "ä"), ("ö", "ö"), ("å", "å"), ("æ", "ae"), ("ß", "ss"), ("ĳ", "ij"), ("…", "..."))


def normalise(text: Column) -> Column:
    """Lower case, accents folded except of å, ä and ö, and symbols in plain form."""
    out = F.lower(text)
    for a, b in REPLACED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, FOLD_FROM + SYMBOLS_FROM + DROPPED, FOLD_TO + SYMBOLS_TO)


def plain(text: Column) -> Column:
    """Normalised, other scripts deleted."""
    return F.regexp_replace(normalise(text), "[^\\u0000-\\u007F\\u00C0-\\u00FF]", "")


def split_words(folded: Column) -> Column:
    return F.filter(F.split(folded, GAPS), lambda w: w != "")


def tokens(text: Column) -> Column:
    """The words of a text: normalised, other scripts deleted, split at gaps."""
    return split_words(plain(text))


def read_words(text: Column, stop_words: tuple[str, ...] = P.STOP_WORDS, unique: bool = False) -> Column:
    """Words of all lines in order, without stop words and lone punctuation; unique: once for each line.

    Comment lines go first, then the whole text is folded once: no expression of a line folds it anew.
    """
    folded = plain(F.regexp_replace(text, "(?dm)^#[^\\n]*", ""))
    words = F.flatten(F.transform(F.split(folded, "\\n"), lambda s: F.array_distinct(split_words(s)))) if unique else split_words(folded)
    stop = F.array(*(F.lit(w) for w in stop_words)) if stop_words else F.array().cast("array<string>")
    return F.filter(words, lambda w: ~F.array_contains(stop, w) & ~w.rlike("^[!-/:-@\\[-`{-~]$"))


def phrase_words(words: Column) -> Column:
    """Words that may be part of a phrase: no single letters, no numbers."""
    return F.filter(words, lambda w: ~w.rlike("^([a-z]|[0-9]+)$"))


#: Forms that alternatives gives at most.
MOST_FORMS = 3


def alternatives(word: Column) -> Column:
    """The word, and what it is without a definite ending or a genitive s."""
    long = F.octet_length(word) > 4
    end = lambda n: F.expr("null") if n is None else F.substring(word, F.lit(1), F.length(word) - n)
    definite = word.rlike("[ae][tn]$")
    return (
        F.when(long & definite & word.isin(*P.NO_DEFINITE), F.array(word, end(2)))
        .when(long & definite, F.array(word, end(1), end(2)))
        .when(long & word.endswith("s"), F.array(word, end(1)))
        .otherwise(F.array(word))
    )


def spans(words: Column, forms: Column, most: int = P.MAX_WORDS, least: int = 1, vague: tuple[str, ...] = P.VAGUE_WORDS) -> Column:
    """Phrases with their place: array of (begin from 1, length, phrase), longest first; vague single words left out.

    forms: the alternatives of each word. Both should be columns of their own, for they are used many times.
    """
    n = F.size(words)
    none = F.array().cast("array<struct<begin:int,length:int,phrase:string>>")

    def of_size(size: int) -> Column:
        def at(i: Column) -> Column:
            head = F.array_join(F.slice(words, i, size - 1), " ") if size > 1 else F.lit("")
            join = lambda last: F.concat(head, F.lit(" "), last) if size > 1 else last
            return F.transform(F.get(forms, i + (size - 2)), lambda last: F.struct(i.alias("begin"), F.lit(size).alias("length"), join(last).alias("phrase")))

        every = F.when(n >= size, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), at))).otherwise(none)
        return F.filter(every, lambda s: ~s["phrase"].isin(*vague)) if size == 1 and vague else every

    return F.concat(*(of_size(size) for size in range(most, least - 1, -1)))


def combinations(words: Column, forms: Column, most: int = P.MAX_WORDS, least: int = 1, vague: tuple[str, ...] = P.VAGUE_WORDS) -> Column:
    """The distinct phrases of a text's words, in order of place."""
    return F.array_distinct(F.transform(spans(words, forms, most, least, vague), lambda s: s["phrase"]))


def code_key(phrase: Column) -> Column:
    """The join key of a phrase: letters, digits, hyphen and space; every other character is alike."""
    return F.regexp_replace(phrase, "[^a-z0-9åäöéüø\\- ]", "~")


def split_keys(words: Column) -> Column:
    """code_key of each word. Every character has its own, so the words are keyed in one go; they hold no space."""
    return F.when(F.size(words) > 0, F.split(code_key(F.array_join(words, " ")), " ")).otherwise(F.array().cast("array<string>"))


def index_phrases(words: Column, sizes: int = 3) -> Column:
    """Phrases under which a name of n words is found: all runs of n, n - 1 and n - 2 words. Repeated runs repeat."""
    n = F.size(words)
    run = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    lengths = F.sequence(n, F.greatest(n - (sizes - 1), F.lit(1)))
    return F.when(n > 0, F.flatten(F.transform(lengths, run))).otherwise(F.array().cast("array<string>"))


def admin_name(low: Column) -> Column:
    """A region's name, already normalised, without the words for its kind."""
    stem = low
    for suffix in reversed(P.ADMIN_SUFFIXES):
        stem = F.when(low.endswith(suffix), F.substring(low, F.lit(1), F.length(low) - len(suffix))).otherwise(stem)
    back = F.concat(stem, F.lit("s"))
    stem = F.when((low != stem) & back.isin(*P.S_STEMS), back).otherwise(stem)
    return F.when(low.startswith("landskapet "), F.substring(low, F.lit(len("landskapet ") + 1), F.length(low))).otherwise(stem)


def byte_position(text: Column, part: Column) -> Column:
    """Bytes of text before the first occurrence of part, or -1."""
    at = F.call_function("locate", part, text)
    return F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(F.substring(text, F.lit(1), at - 1)))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_tex(text: Column) -> Column:
    """Characters that TeX reads as commands, behind a backslash."""
    return F.regexp_replace(text, "([&%$#_{}])", "\\\\$1")
