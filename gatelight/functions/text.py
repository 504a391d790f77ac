"""Text measures as native columns: words, density, risk, phrases, identity signals, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_WORDS = 300
#: In the order in which they are reported.
PLACEHOLDERS = "will be added|coming soon|not yet|planned|under construction|draft|todo|tbd|work in progress|in development|placeholder|this section".split("|")
CONTACT = "email@|contact|reach us|get in touch|linkedin|twitter|github".split("|")
CREDENTIALS = "years|experience|expert|professional|founder|ceo|engineer|developer|consultant".split("|")
#: Two neighbouring words of three letters or more that begin with capitals.
NAME = r"(?U)(^|\s)\p{Lu}\S{2,}\s+\p{Lu}\S{2,}(\s|$)"


def words(text: Column) -> Column:
    """The words, parted by Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def kilobytes(body: Column) -> Column:
    """Characters, not bytes, by 1024."""
    return F.length(body) / F.lit(1024)


def density(count: Column, kb: Column) -> Column:
    return F.when(kb > 0, count / kb).otherwise(F.lit(0.0))


def risk(count: Column, least: int = MIN_WORDS) -> Column:
    return F.when(count < least, "THIN").when(count < least * 1.5, "BORDERLINE").otherwise("OK")


def sample(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def found_phrases(text: Column, phrases: list[str], strict: bool = False) -> Column:
    """The phrases that the text holds, as substrings of its lower case, or as whole words if ``strict``."""
    low = F.lower(text)

    def holds(p: Column) -> Column:
        return F.rlike(low, F.concat(F.lit(r"\b"), p, F.lit(r"\b"))) if strict else F.contains(low, p)

    return F.filter(F.array(*map(F.lit, phrases)), holds)


def any_phrase(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    out = F.contains(low, F.lit(phrases[0]))
    for p in phrases[1:]:
        out = out | F.contains(low, F.lit(p))
    return out


def has_name(text: Column) -> Column:
    return F.rlike(text, F.lit(NAME))


def has_email(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("email")) | F.contains(text, F.lit("@"))


def percent(share: Column) -> Column:
    """A whole percentage, halves to the even number."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def padded(text: Column, width: int) -> Column:
    """Blanks after a text up to a width; a longer one is whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def clipped(text: Column, most: int) -> Column:
    """Cut to so many characters, and marked where something is gone."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


SYMBOLS = {"OK": "✓", "WARNING": "⚠️ ", "HIGH_RISK": "⚠️ ", "MISSING": "⚠️ ", "FAIL": "❌", "ERROR": "❓"}


def symbol(status: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    return F.coalesce(F.element_at(pairs, status), F.lit("?"))
