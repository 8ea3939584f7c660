"""Text columns: label normalisation, null tokens, defect tokens, keyword evidence."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from cyclelake.schema import NULL_TOKENS

# --- fixed values ---------------------------------------------------------------------
ACCENTS_FROM = "éèêàâùôîç"
ACCENTS_TO = "eeeaauoic"
NOT_DEFECTS = ["good", "valid", "none"]
# Words in notes or maintenance texts that count as evidence for a cause.
KEYWORDS = {
    "zone_2_note": ["short shot", "zone 2"],
    "material_change": ["changement mat", "material change", "purge"],
    "material_note": ["bulle", "sechage", "matiere", "granule"],
    "restart": ["redemarrage", "arrêt machine", "arret machine", "restart"],
    "wear_note": ["usure", "cotes", "derive dimensionnelle", "moule"],
}
# --------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Text without white space at its ends (not only spaces)."""
    return F.btrim(text, F.lit(" \t\r\n\f\v"))


def normalise_label(label: Column) -> Column:
    """Comparable form of a column label: lower case, no spaces `_ - .`, no French accents."""
    bare = F.regexp_replace(strip(F.lower(label)), r"[\s_\-.]+", "")
    return F.translate(bare, ACCENTS_FROM, ACCENTS_TO)


def fold_character(char: str) -> str:
    """What the structural form keeps of a character: compatibility decomposition, case folded, without marks, blanks and `_ . - / \\`."""
    plain = unicodedata.normalize("NFKD", char).casefold()
    return "".join(c for c in plain if not unicodedata.combining(c) and not c.isspace() and c not in "_.-/\\\ufeff")


@lru_cache(1)
def folding() -> tuple[str, str, str]:
    """The folding of all characters but Hangul syllables: characters that become one or none, as a pair
    of texts for `translate`, and those that become several, as a JSON object."""
    kept, one, dropped, several = [], [], [], {}
    for point in range(0x110000):
        if 0xAC00 <= point < 0xD7A4 or 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        folded = fold_character(char)
        if folded != char:
            if len(folded) > 1:
                several[char] = folded
            elif folded:
                kept.append(char)
                one.append(folded)
            else:
                dropped.append(char)
    return "".join(kept + dropped), "".join(one), json.dumps(several)


def fold_label(label: Column) -> Column:
    """Structural form of a label: `fold_character` of all its characters, as one `translate` and a map of the few longer forms.

    Precomposed Hangul syllables stay as they are."""
    source, target, several = folding()
    text = F.coalesce(label, F.lit(""))
    longer = F.from_json(F.lit(several), "map<string,string>")
    plain = F.translate(text, source, target)
    spread = F.array_join(F.transform(F.split(plain, ""), lambda c: F.when(c > "\x7f", F.coalesce(F.try_element_at(longer, c), c)).otherwise(c)), "")
    return F.when(plain.rlike(r"[^\x00-\x7f]"), spread).otherwise(plain)


def null_if_token(text: Column) -> Column:
    """Trimmed text, null where it only says "no value"."""
    trimmed = strip(text)
    return F.when(~F.lower(trimmed).isin(NULL_TOKENS), trimmed)


def defect_tokens(text: Column) -> Column:
    """Lower-case defect words of a `; | ,` or space separated text, order kept."""
    plain = F.translate(F.lower(strip(F.coalesce(text, F.lit("")))), ";|,", "   ")
    words = F.filter(F.split(plain, r"\s+"), lambda word: word != "")
    return F.filter(words, lambda word: ~word.isin(NOT_DEFECTS))


def mentions(text: Column, group: str) -> Column:
    """True where the text contains one of the words of a keyword group."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for word in KEYWORDS[group]:
        hit = hit | lowered.contains(word)
    return hit
