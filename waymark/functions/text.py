"""Text normalization, comparison and hashing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, f) -> Column:
    """f(x) with x computed once a row, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _latin() -> tuple[str, str]:
    """Accented Latin letters and their bare forms, from Unicode's decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, b) for c, b in pairs if c != b and b.isascii()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _latin()
MARKS = "[\\u0300-\\u036f]"
#: Words that a name is compared without.
NAME_STOP_WORDS = ("da", "de", "do", "das", "dos", "e", "etapa", "edicao")
#: Spellings of a gender.
GENDERS = {"Feminino": ("f", "fem", "feminino", "feminina"), "Masculino": ("m", "masc", "masculino", "masculina")}


def clean(x: Text) -> Column:
    """Null to empty; every run of Unicode white space to one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), r"(?U)\s+", " "))


def clean_or_null(x: Text) -> Column:
    return F.nullif(clean(x), F.lit(""))


def strip_accents(x: Text) -> Column:
    """Latin letters without accents, and no combining marks."""
    return F.regexp_replace(F.translate(_c(x), ACCENTED, BARE), MARKS, "")


def normalize_key(x: Text, joint: str = " ") -> Column:
    """Lower-case ASCII letters and digits; anything else between them is one `joint`. One translation and two patterns, whatever the text."""
    bare = F.lower(F.translate(F.coalesce(_c(x).cast("string"), F.lit("")), ACCENTED, BARE))
    words = F.trim(F.regexp_replace(F.regexp_replace(bare, MARKS, ""), "[^a-z0-9]+", " "))
    return words if joint == " " else F.replace(words, F.lit(" "), F.lit(joint))


def compact_key(x: Text) -> Column:
    return normalize_key(x, "-")


def slugify(x: Text, longest: int = 90, default: str = "evento") -> Column:
    """For names of records; file names take `longest` 120."""
    return F.coalesce(F.nullif(F.substring(compact_key(x), 1, longest), F.lit("")), F.lit(default))


def header_key(x: Text) -> Column:
    return normalize_key(x, "_")


def title_header(x: Text) -> Column:
    return F.initcap(F.replace(_c(x), F.lit("_"), F.lit(" ")))


def name_text(x: Text) -> Column:
    """A name's words without accents and stop words."""
    # the bounds of words are spelled out: what Java's \b takes for a letter differs by release
    stop = "(?<![0-9A-Za-z_])(" + "|".join(NAME_STOP_WORDS) + ")(?![0-9A-Za-z_])"
    bare = F.regexp_replace(F.lower(strip_accents(_c(x))), stop, " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def same_text(a: Text, b: Text) -> Column:
    """Equal but for case, accents and white space; null if either is null."""
    return F.lower(strip_accents(clean(a))) == F.lower(strip_accents(clean(b)))


def utf16_slice(x: Text, start: int, end: int) -> Column:
    """UTF-16 units start to end, without half a character at either side.

    A character past U+FFFF is two units. Without any, this is a substring; else the
    characters are kept whose units all lie in the range.
    """
    c = _c(x)
    chars = F.split(c, "")
    wide = F.transform(chars, lambda ch: F.when(ch.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1))
    ends = F.aggregate(wide, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    inside = F.filter(F.arrays_zip(chars.alias("ch"), wide.alias("n"), ends.alias("e")), lambda s: (s["e"] - s["n"] >= start) & (s["e"] <= end))
    return F.when(~c.rlike(r"[\x{10000}-\x{10FFFF}]"), F.substring(c, start + 1, end - start)).otherwise(F.array_join(F.transform(inside, lambda s: s["ch"]), ""))


def repair_mojibake(x: Text) -> Column:
    """Words that are UTF-8 read as Latin-1 are read again; all others stay as they are."""
    def word(w: Column) -> Column:
        raw = F.encode(w, "ISO-8859-1").cast("string")
        return F.when(w.rlike("[ÂÃ]") & ~w.rlike(r"[^\x{00}-\x{FF}]"), F.when(F.is_valid_utf8(raw), raw).otherwise(w)).otherwise(w)

    return F.array_join(F.transform(F.split(_c(x), " "), word), " ")


def gender(x: Text) -> Column:
    """The gender a spelling stands for; null if it's none."""
    key = normalize_key(x)
    out = F.lit(None).cast("string")
    for name, spellings in GENDERS.items():
        out = F.when(key.isin(*spellings), name).otherwise(out)
    return out


def html_escape(x: Text) -> Column:
    out = _c(x)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def first_url(x: Text) -> Column:
    """The first http(s) address in a text, without closing punctuation."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(x), r"(?i)https?://[^\s<>\"']+", 0), r"[).,;!?]+$", ""), F.lit(""))


def sha256(x: Text) -> Column:
    return F.sha2(_c(x), 256)


def parts_hash(*parts: Text, separator: str = "\n") -> Column:
    """Hash of the parts that aren't empty, cleaned and joined."""
    return F.sha2(F.array_join(F.filter(F.array(*[clean(p) for p in parts]), lambda p: p != ""), separator), 256)


def fingerprint(name: Text, date: Text, city: Text, state: Text, country: Text) -> Column:
    return F.concat_ws("|", compact_key(name), clean(date), compact_key(city), compact_key(state), compact_key(country))


def name_words(x: Text) -> Column:
    """The distinct words of a name."""
    return F.filter(F.array_distinct(F.split(name_text(x), " ")), lambda w: w != "")


def word_similarity(left: Text, right: Text) -> Column:
    """Jaccard similarity of two arrays of distinct words, to 4 decimals; 0 if either is empty."""
    a, b = _c(left), _c(right)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(both / (F.size(a) + F.size(b) - both), 4))


def token_similarity(a: Text, b: Text) -> Column:
    """word_similarity of two names. For many pairs, make the words once for each record."""
    return word_similarity(name_words(a), name_words(b))


def formula_guard(x: Text) -> Column:
    """A quote before text that a spreadsheet would run."""
    c = _c(x)
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def guarded_text(value: str) -> str:
    """formula_guard for a Python text."""
    return "'" + value if value.lstrip(" ")[:1] in tuple("=+-@") else value


def unique(x: Text) -> Column:
    return F.array_distinct(_c(x))


def semver_floor(value: Text, floor: Text) -> Column:
    """value if it's a version of at least the floor, else the floor; value if the floor is none."""
    v, f = _c(value), _c(floor)
    shape = r"^\d+\.\d+\.\d+$"
    numbers = lambda c: F.transform(F.split(clean(c), r"\."), lambda n: n.try_cast("bigint"))
    return F.when(~clean(f).rlike(shape), F.coalesce(v, f)).when(~clean(v).rlike(shape), f).when(numbers(v) >= numbers(f), v).otherwise(f)
