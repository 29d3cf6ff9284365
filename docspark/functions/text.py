"""Text expressions. Each takes and returns Columns; null in gives the neutral value that is stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords by class, as the layout features and the augmentation count them.
LAYOUT_ANCHORS = {
    "invoice": ["invoice", "total", "due date", "bill to", "amount due"],
    "budget": ["budget", "forecast", "planned", "allocated", "cost center", "variance"],
    "resume": ["education", "experience", "skills", "objective", "employment"],
    "email": ["subject", "from", "to", "cc", "dear", "regards"],
    "form": ["name", "address", "date", "signature", "checkbox", "application", "form"],
}
CONFUSION_ANCHORS = {
    "invoice": ["invoice", "bill to", "amount due", "subtotal", "tax", "balance due"],
    "form": ["application", "signature", "name", "address", "checkbox", "date:"],
    "budget": ["budget", "forecast", "planned", "allocated", "variance", "cost center"],
}
#: The sign that stands for a missing value at the edges of the system.
DASH = "—"


def spaced(x: Column) -> Column:
    """White space runs to one blank, ends trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def normalized(x: Column) -> Column:
    """Lower case, then `spaced`."""
    return spaced(F.lower(x))


def without_ocr_marks(x: Column) -> Column:
    """Bars, backslashes, backticks, tildes and carets become blanks; then `spaced`."""
    return spaced(F.regexp_replace(x, r"[|\\`~^]", " "))


def baseline_clean(x: Column) -> Column:
    """For bag-of-words baselines: lower case; control characters and signs outside a small set become blanks; a run of repeated punctuation keeps its last sign; single letters go; `spaced`."""
    t = F.lower(F.coalesce(x, F.lit("")))
    t = F.regexp_replace(t, r"[\x00-\x1f\x7f]", " ")
    t = F.regexp_replace(t, r"[^a-z0-9\s$€£%.,:;/@#&()+\-]", " ")
    t = F.regexp_replace(t, r"([:;/,.\-]){2,}", "$1")
    t = F.regexp_replace(t, r"\b[a-z]\b", " ")
    return spaced(t)


def tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def slug(x: Column) -> Column:
    """Lower case; each run of other signs is one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def letters_and_digits(x: Column) -> Column:
    """Lower case, all but a-z and 0-9 deleted: for comparing values."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def occurrences(x: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def anchor_count(x: Column, anchors: Sequence[str]) -> Column:
    """Sum of occurrences of the anchors in the lower-cased text."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return sum((occurrences(low, a) for a in anchors[1:]), occurrences(low, anchors[0]))


def augmented(x: Column, anchors: dict[str, list[str]] = CONFUSION_ANCHORS, most: int = 20) -> Column:
    """The normalized text, and for each class a marker word as often as its anchors occur, `most` at most."""
    text = normalized(x)
    marks = [F.array_repeat(F.lit(f"anchor_{c}"), F.least(anchor_count(text, a), F.lit(most))) for c, a in anchors.items()]
    return F.array_join(F.concat(F.array(text), *marks), " ")


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))


def looks_like_currency(x: Column) -> Column:
    return x.rlike(r"[$€£]\s?\d+|\b\d{1,3}(,\d{3})*\.\d{2}\b")


def looks_like_date(x: Column) -> Column:
    return x.rlike(r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b")


def is_merged_token(x: Column) -> Column:
    """A label and its value in one token, or long camel case."""
    return x.rlike(r"^[A-Za-z]{3,}:[A-Za-z0-9]") | ((F.length(x) > 8) & x.rlike("[a-z][A-Z]"))


def character_error_rate(hypothesis: Column, reference: Column) -> Column:
    """Edits over the reference's length; an empty reference counts 0 against an empty text, else 1."""
    h, r = F.coalesce(hypothesis, F.lit("")), F.coalesce(reference, F.lit(""))
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(h, r) / F.length(r))


def first_value(*xs: Column) -> Column:
    """The first of several values that is not null, blank or the dash."""
    return F.coalesce(*[F.nullif(F.nullif(F.trim(x), F.lit("")), F.lit(DASH)) for x in xs])


def size_label(n: Column) -> Column:
    """Bytes as B, KB or MB."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


# The characters of white space and of digits, in any script.
_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_DIGIT = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"


def stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACES))


def token_flags(c: Column) -> dict[str, Column]:
    """The twelve flags of a stripped token; none holds for an empty one."""
    n = F.length(c)
    flags = {
        "numeric": c.rlike(f"^[{_DIGIT}]+$"),
        "alpha": c.rlike(r"^\p{L}+$"),
        "alnum": c.rlike(r"^[\p{L}\p{N}]+$"),
        "upper": (n > 1) & c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{Lt}]"),
        "punct": F.length(F.regexp_replace(c, rf"[\p{{L}}\p{{N}}{_SPACE}]", "")) / n >= F.lit(0.3),
        "short": n <= 2,
        "long": n >= 12,
        "currency": c.rlike(rf"^[$€£¥₹]?[{_SPACE}]*\p{{Nd}}[\p{{Nd}},.]*$"),
        "date": c.rlike(rf"^(?:\p{{Nd}}{{1,2}}[\-/]\p{{Nd}}{{1,2}}[\-/]\p{{Nd}}{{2,4}}|\p{{Nd}}{{4}}[\-/]\p{{Nd}}{{1,2}}[\-/]\p{{Nd}}{{1,2}}|\p{{Nd}}{{1,2}}[{_SPACE}]+[A-Za-z]{{3,9}}[{_SPACE}]+\p{{Nd}}{{2,4}})$"),
        "email": c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
        "url": c.rlike(r"(?iu)^(https?://|www\.)"),
        "phone": c.rlike(rf"^\+?\p{{Nd}}[\p{{Nd}}{_SPACE}().-]{{6,}}\p{{Nd}}$"),
    }
    return {k: (n > 0) & x for k, x in flags.items()}
