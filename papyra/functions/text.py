r"""Text functions.

The semantics to match are Python's: ``\s``, ``\d`` and ``str.strip`` cover all of Unicode, while Java's
default classes are ASCII. Patterns below spell the classes out where the two differ.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space: Unicode's, and the four information separators.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
PLACEHOLDER = r"\{v\p{Nd}+\}|</?b\p{Nd}+>"
FORMULA_ONLY = r"^\{v\p{Nd}+\}\n?$"
WORD = r"[A-Za-z][A-Za-z'’-]+"
LINK_TOKEN = r"(?U)[0-9][\w.+\-]*|[A-Z][\w.+\-]+"
#: Where a service's web page shows its answer; what agreed terms are told by (fixed values).
ANSWER = r'(?s)class="(?:t0|result-container)">(.*?)<'
AGREED = "Use these agreed translations where they apply: "
LEADER = rf"(?:[.·]{SPACE}?){{4,}}"
MIN_CHARS = 3
#: Terms shorter than this are acronyms, whose case tells them apart from words.
CASEFOLD_FROM = 4
SCRIPTS = {
    "zh": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}",
    "zh-TW": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}",
    "ja": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}",
    "ko": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
    "ru": r"\x{0400}-\x{04FF}",
}
LATIN = r"[\p{L}&&[\x{0000}-\x{024F}]]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def without_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, "")


def is_trivial(text: Column) -> Column:
    """Fewer than three characters, or no letter, once placeholders and outer white space are gone."""
    bare = strip(without_placeholders(text))
    return (F.length(bare) < MIN_CHARS) | ~F.rlike(bare, F.lit(r"\p{L}"))


def skips_translation(text: Column) -> Column:
    """Blank, or nothing but one formula."""
    return (strip(text) == "") | F.rlike(text, F.lit(FORMULA_ONLY))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{C}", "")


def without_thinking(reply: Column) -> Column:
    """A model's reply without the deliberation that it opens with."""
    return F.regexp_replace(reply, r"(?s)\A<think>.+?</think>", "")


def without_thinking_streamed(reply: Column) -> Column:
    """The same for services whose replies are put together from a stream: what the deliberation ends with goes too, and the ends are stripped."""
    return strip(F.regexp_replace(reply, r"(?s)\A<think>.+?\n*(</think>|\n)*(</think>)\n*", ""))


def unescaped(text: Column) -> Column:
    """Character references decoded, by Python's rules, in Arrow batches."""

    @F.pandas_udf("string")
    def decode(some: pd.Series) -> pd.Series:
        return some.map(lambda t: None if t is None else html.unescape(t))

    return decode(text)


def found_translation(page: Column) -> Column:
    """The translation that a service's web page shows, decoded and without control characters; null where it shows none."""
    shown = F.regexp_extract_all(page, F.lit(ANSWER), 1)
    return without_controls(unescaped(F.get(shown, 0)))


def flat(text: Column) -> Column:
    """Hyphens as spaces, white space single."""
    return strip(F.regexp_replace(F.replace(text, F.lit("-"), F.lit(" ")), rf"{SPACE}+", " "))


def fold(form: Column) -> Column:
    """Lower case, unless the form is as short as an acronym."""
    return F.when(F.length(form) >= CASEFOLD_FROM, F.lower(form)).otherwise(form)


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), F.lower)


def adjacent(items: Column) -> Column:
    """Pairs of neighbours, as one string each."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - 1, F.lit(1))), lambda i: F.when(i < F.size(items), F.concat_ws(" ", F.get(items, i - 1), F.get(items, i))))


def script_count(text: Column, language: str) -> Column:
    """Characters of the language's script; 0 for a language written in Latin letters."""
    return F.regexp_count(text, F.lit(f"[{SCRIPTS[language]}]")) if language in SCRIPTS else F.lit(0)


def latin_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LATIN))


def font_base(font: Column) -> Column:
    """A font's name without the prefix of its subset."""
    return F.element_at(F.split(font, r"\+"), -1)


def service_and_model(spec: Column) -> Column:
    parts = F.split(spec, ":", 2)
    return F.struct(parts[0].alias("service"), F.get(parts, 1).alias("model"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def fill_template(template: str, **values: Column) -> Column:
    """``$name`` and ``${name}`` replaced where a value is given, ``$$`` as a dollar sign; other names stay."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\$(?:(\$)|([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\})", template):
        parts.append(F.lit(template[at : m.start()]))
        name = m[2] or m[3]
        parts.append(F.lit("$") if m[1] else values.get(name, F.lit(m[0])))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def replace_chain(text: Column, pairs: Column) -> Column:
    """Each (old, new) of an array applied in order to what the one before left."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["old"], p["new"]))


def hex_glyphs(text: Column, wide: bool) -> Column:
    """Code points in hexadecimal, four digits or two each."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.lower(F.lpad(F.hex(F.ascii(c)), 4 if wide else 2, "0"))), "")


def colour_operator(parts: Column) -> Column:
    """Fill-colour operator by the number of components, black by default."""
    said = F.array_join(F.transform(parts, lambda v: F.format_string("%f", v.cast("double"))), " ")
    name = F.when(F.size(parts) == 1, "g").when(F.size(parts) == 3, "rg").when(F.size(parts) == 4, "k")
    return F.coalesce(F.concat(said, F.lit(" "), name, F.lit(" ")), F.lit("0 g "))


def facts(profile: dict[str, Column], keys: tuple[str, ...] = ("field", "topic")) -> Column:
    """The sentence of known facts that precedes every prompt; empty if there is none."""
    said = F.concat_ws("; ", *[F.when(F.length(profile[k]) > 0, F.concat(F.lit(f"{k.capitalize()}: "), profile[k])) for k in keys if k in profile])
    return F.when(said != "", F.concat(F.lit("This document — "), said)).otherwise(F.lit(""))


def prompt_preface(profile: dict[str, Column], agreed: Column) -> Column:
    """Facts, and the agreed terms (structs source, target) that a paragraph shows, before its instruction; empty without either."""
    terms = F.array_join(F.transform(agreed, lambda t: F.concat(t["source"], F.lit(" -> "), t["target"])), "; ")
    use = F.when(terms != "", F.concat(F.lit(AGREED), terms))
    head = facts(profile)
    both = F.concat_ws("\n", F.when(head != "", head), use)
    return F.when(both != "", F.concat(both, F.lit("\n\n"))).otherwise(F.lit(""))


def clipped(text: Column, most: int) -> Column:
    """The first ``most`` characters."""
    return F.substring(text, 1, most)
