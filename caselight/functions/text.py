"""Column functions on text. White space is ASCII; word boundaries are ASCII too, written as
look-arounds because Java's ``\\b`` is not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word boundaries before and after, for letters, digits and underscore of ASCII.
WB, WE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Template labels that are no value, and markers of a form in a long capture.
TEMPLATE_LABELS = (
    "date",
    "reaction",
    "mg",
    "reporting form",
    "suspected adverse drug reaction",
    "suspected medication(s)",
    "suspected adverse reaction perit",
)
FORM_MARKERS = "adr_form|reporting form|sourcefile|traceid"


def text_of(c: Column | str) -> Column:
    """Null as the empty string, which is what "missing" is everywhere."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


#: What ``\\s`` stands for.
WHITE = " \t\n\x0b\f\r"


def trimmed(c: Column) -> Column:
    """Without ASCII white space at both ends; no pattern, which would be tried at every character."""
    return F.btrim(c, F.lit(WHITE))


def rounded(x: Column, digits: int) -> Column:
    """Half up on the binary value, away from zero for negative numbers; same on other engines."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def clean_text(c: Column) -> Column:
    """Line ends to LF, runs of blanks to one, three and more LF to two, trimmed."""
    c = F.regexp_replace(text_of(c), "\r", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return trimmed(c)


def clean_value(c: Column) -> Column:
    """White space collapsed, closing colons and bars removed, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(text_of(c), r"\s+", " "), r"[:|]+$", ""))


def first_filled(*found: Column) -> Column:
    """The first that is not empty, else empty; names each only once, so that nested uses do not
    multiply the expression."""
    return F.coalesce(F.get(F.filter(F.array(*found), lambda x: x != ""), F.lit(0)), F.lit(""))


def first_match(c: Column, patterns: list[str], group: int = 1) -> Column:
    """The first pattern's group that is not empty, cleaned; else empty."""
    return first_filled(*[clean_value(F.regexp_extract(c, p, group)) for p in patterns])


def exact_string(c: Column) -> Column:
    value = clean_value(c)
    low = F.lower(value)
    return F.when(low.isin(*TEMPLATE_LABELS) | ((F.length(low) > 90) & low.rlike(FORM_MARKERS)), "").otherwise(value)


def sha256(c: Column) -> Column:
    return F.sha2(text_of(c), 256)


def token_for(prefix: str, c: Column) -> Column:
    """``PREFIX_TKN_`` and ten hex digits; empty stays empty."""
    value = text_of(c)
    return F.when(value == "", "").otherwise(F.concat(F.lit(f"{prefix.upper()}_TKN_"), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{prefix}:"), value), 256), 1, 10))))


def tokens(c: Column, more_than: int = 2) -> Column:
    """Lower-case ASCII words of more than so many characters."""
    words = F.split(F.regexp_replace(F.lower(text_of(c)), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > more_than)


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once a row: what a lambda names is else made again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a space."""
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))
    return let(words, runs)


def sentences(c: Column, more_than: int = 10) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space."""
    return F.filter(F.transform(F.split(text_of(c), r"(?<=[.!?])\s+"), trimmed), lambda s: F.length(s) > more_than)


def capital_sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` where a capital follows, and at line starts with one."""
    parts = F.split(text_of(c), r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(trimmed(s), r"\n+", " ")), lambda s: F.length(s) > 20)


def label_key(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9_]+", " "), r"\s+", " "))


def value_key(c: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(text_of(c), r"\s+", " ")))


def initials(c: Column) -> Column:
    """``X.Y.`` from a polynomial of the characters' codes."""
    codes = F.transform(F.split(text_of(c), ""), lambda ch: F.ascii(ch))
    total = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0).cast("long"), lambda a, x: (a * 31 + x) % 9973)
    letter = lambda n: F.char(n % 26 + 65)
    return F.concat(letter(total), F.lit("."), letter(F.floor(total / 26)), F.lit("."))


def wrapped(c: Column, width: int = 105) -> Column:
    """Lines of whole words of up to ``width`` characters."""
    words = F.filter(F.split(text_of(c), r"\s+"), lambda w: w != "")
    last = lambda lines: F.element_at(lines, -1)
    fold = F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda lines, w: F.when(F.size(lines) == 0, F.array(w)).otherwise(
            F.when(F.length(F.get(lines, F.size(lines) - 1)) + 1 + F.length(w) > width, F.concat(lines, F.array(w))).otherwise(
                F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat_ws(" ", F.get(lines, F.size(lines) - 1), w)))
            )
        ),
    )
    return fold


def cer(ocr: Column, reference: Column) -> Column:
    """Character error rate to four digits; null where the reference is empty."""
    a, b = value_key(ocr), value_key(reference)
    return rounded(F.levenshtein(a, b) / F.nullif(F.length(b), F.lit(0)).cast("double"), 4)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
