"""Normalising and judging entity names and predicates, as column expressions.

Filters are ladders: the first rule that applies decides. Patterns carry ``(?U)``
so that classes like ``\\w`` and ``\\d`` cover all of Unicode. The patterns and their
order are fixed values.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import ALL_PREDICATES, CANONICAL, EXTENSIONS, FALLBACK, LINK_EXTENSIONS, STOPWORDS, TECH_KEYWORDS, TWO_LETTER_TERMS, WHITELIST


def strip(text: Column) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_entity(name: Column) -> Column:
    """Strip, lower, single spaces, then no closing ``.,;:`` — in this order."""
    spaced = F.regexp_replace(F.lower(strip(name)), r"(?U)\s+", " ")
    return F.rtrim(spaced, F.lit(".,;:"))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def normalize_predicate(name: Column) -> Column:
    """A vocabulary predicate: as written, in camel case, or in any case; else the fallback."""
    spelt = F.btrim(F.regexp_replace(F.lower(name), r"[_\s-]+", "-"), F.lit("-"))
    camel = F.element_at(_map({re.sub("([A-Z])", r"-\1", p).lower(): p for p in ALL_PREDICATES}), spelt)
    any_case = _map({p.lower(): p for p in ALL_PREDICATES})
    known = name.isin(*ALL_PREDICATES)
    return F.when(known, name).otherwise(F.coalesce(camel, F.element_at(any_case, F.lower(name)), F.lit(FALLBACK)))


def normalize_label(label: Column) -> Column:
    """The canonical name of a known spelling; otherwise the stripped label, case kept."""
    return F.coalesce(F.element_at(_map(CANONICAL), F.lower(strip(label))), strip(label))


def _words(name: Column) -> Column:
    return F.size(F.filter(F.split(name, r"(?U)\s+"), lambda w: w != ""))


def _extension(names: tuple[str, ...]) -> str:
    return "|".join(n.replace(".", r"\.") for n in names)


#: What no concept's name begins with, or is as a whole: one pattern, so that a name is handed to it once and not once a rule.
_NOISE = "^(?:" + "|".join([
    r"[#@$*!~.:-]",
    r"/",
    rf"(?Ui:[\w@./-][\w./-]*\.(?:{_extension(EXTENSIONS)})$)",  # file names
    r"(?Ui:[a-z]\d{2,}(\.\d+)?$)",  # classification codes
    r"(?Ui:[a-z]+_\d{3}_\d{3}$)",
    r"(?Ui:[a-z]+_\d+$)",
    r"[a-z][a-z0-9]*(_[a-z0-9]+){2,}$",  # identifiers of three parts or more
    r"(?U:\d+\s)",
    r"(?U:\d+\.\d+)",
    r"(?U:\d+px)",
    r"(?U:\d+$)",
    r"(?U:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$)",
    r"(?Ui:\d+\s*(seconds?|minutes?|hours?|days?|ms|s|m|h|kb|mb|gb|tb)\b)",
    r"(?i:[0-9a-f]{6,}$)",  # hashes
    r"(?U:\d+\s+\w+s$)",
    r"(?Ui:\d+(st|nd|rd|th)\b)",
    r"(?U:\d+/\d+)",
    r"(?U:\s*+\S++(?:\s++\S++){3})",  # more than three words
]) + ")"
#: What no concept's name holds anywhere.
_NOISE_WITHIN = r"[\\%\[\]()]|(?Ui:\d+(px|vh|vw|em|rem|pt|%)\b)"


def is_valid_entity(name: Column) -> Column:
    """First filter, on normalised names: is this a concept rather than noise?"""
    ladder = F.when(name.isNull() | (F.char_length(name) <= 1) | name.isin(*STOPWORDS), False).when(name.isin(*WHITELIST), True)
    return ladder.when((F.char_length(name) == 2) | name.rlike(_NOISE) | name.rlike(_NOISE_WITHIN), False).otherwise(True)


def is_linkable_entity(label: Column) -> Column:
    """Second filter, before linking: could a catalogue hold this?"""
    u, ui = "(?U)", "(?U)(?i)"
    s = strip(label)
    low = F.lower(s)
    letters = low.rlike(r"^\p{L}+$")
    path = r"[a-zA-Z0-9_./-]+"
    rules = [
        low.rlike(ui + rf"^[\w./-]+\.(?:{_extension(LINK_EXTENSIONS)})$"),
        s.rlike(r"^[#@$*!~.:]+") | s.startswith("--"),
        s.rlike(u + r"^\d+\s"),
        s.rlike(u + r"^\d+\.\d"),
        (F.char_length(low) == 2) & letters & ~low.isin(*TWO_LETTER_TERMS),
        F.char_length(s) == 1,
        s.rlike(r"[\[\]]"),
        s.rlike(r"[()]"),
        s.rlike(r"^@.+/"),
        s.rlike(ui + r"\d+(?:px|vh|vw|em|rem|pt|%)\b"),
        s.rlike(u + r"\d+%"),
        s.rlike(rf"(?:^|[^a-zA-Z]){path}/{path}/{path}") | s.rlike(rf"^{path}/{path}$"),
        (F.char_length(low) <= 6) & low.rlike(ui + r"^[a-z]\d{2,}") & ~letters,
        low.rlike(ui + r"^[a-z]+_\d{3}_\d{3}$"),
        low.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+){2,}$"),
        low.rlike(ui + r"^[a-z]+_\d+$"),
        low.startswith("."),
        s.contains("*"),
        F.regexp_replace(s, "[.-]", "").rlike(u + r"^\d+$"),
        s.contains("=") & (_words(s) <= 2),
        (F.char_length(s) <= 2) & ~s.rlike(r"^[\p{L}\p{N}]"),
        s.startswith("'") | s.startswith('"'),
        s.rlike("^[%&]") & (_words(s) <= 2),
        s.rlike(u + r"^\d+x\d+"),
    ]
    ladder = F.when(label.isNull() | (s == ""), False).when(low.isin(*WHITELIST), True)
    for rule in rules:
        ladder = ladder.when(rule, False)
    return ladder.otherwise(True)


def has_tech_keyword(description: Column) -> Column:
    """Whether a keyword occurs anywhere, inside longer words too."""
    low = F.lower(F.coalesce(description, F.lit("")))
    hit = F.lit(False)
    for word in TECH_KEYWORDS:
        hit = hit | low.contains(word)
    return hit
