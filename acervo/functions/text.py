"""Text normalisation as Column expressions (no Python on the data path).

Java regular expressions are ASCII by default, so patterns that must see letters
and spaces of other alphabets carry ``(?U)``.  Compatibility decomposition and
accent stripping come from a table that is generated from ``unicodedata`` when
the module is loaded.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Single-letter folds for ``translate`` and longer ones, for the Latin, letter-like and form blocks."""
    single_from, single_to, longer = [], [], []
    gone = []
    for code in [*range(0xA0, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0x2070, 0x20A0), *range(0x20D0, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if folded == c:
            continue
        if not folded:
            gone.append(c)
        elif len(folded) == 1:
            single_from.append(c)
            single_to.append(folded)
        else:
            longer.append((c, folded))
    return "".join(single_from + gone), "".join(single_to), longer


_FROM, _TO, _LONGER = _fold_tables()
#: Characters that fold to several letters pass as marks of the last private plane, so one range finds them.
_MARKS = [chr(0x10FF00 + i) for i in range(len(_LONGER))]
_FROM = "".join(c for c, _ in _LONGER) + _FROM
_TO = "".join(_MARKS) + _TO
_MARK = "[\\x{10FF00}-\\x{10FFFD}]"
_LONG_MAP = "\x02".join(f"{m}\x01{folded}" for m, (_, folded) in zip(_MARKS, _LONGER, strict=True))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: keeps nested rules from multiplying their inputs."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def clean(c: Column) -> Column:
    """Collapse white space and trim; null becomes the empty string."""
    return F.coalesce(F.trim(F.regexp_replace(c, SPACES, " ")), F.lit(""))


def fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks, for the blocks of the table.

    Single letters are translated at once.  A text with characters that fold to
    several letters is split before those alone and each is looked up.  (Texts are
    taken to hold no characters from U+10FF00 on, the end of the last private plane.)
    """
    return let(F.translate(c, _FROM, _TO), lambda m: F.when(m.rlike(_MARK), F.array_join(_folded(m), "")).otherwise(m))


def _folded(text: Column) -> Column:
    """The parts of a text, each with the mark that it begins with looked up."""
    table = F.str_to_map(F.lit(_LONG_MAP), F.lit("\x02"), F.lit("\x01"))
    first = lambda x: F.try_element_at(table, F.substring(x, 1, 1))
    return F.transform(F.split(text, f"(?={_MARK})"), lambda x: F.when(x.rlike(f"^{_MARK}"), F.concat(first(x), F.substring(x, 2, 2147483647))).otherwise(x))


def search_key(c: Column) -> Column:
    """Upper case without accents, punctuation kept; null becomes empty."""
    return fold(F.upper(clean(c)))


def upper_fold(c: Column) -> Column:
    """Upper case, folded: what both keys are cut from."""
    return fold(F.upper(c))


def compact_key(c: Column, folded: bool = False) -> Column:
    """Only A-Z and 0-9 of the folded upper-case text; null becomes empty."""
    return F.coalesce(F.regexp_replace(c if folded else upper_fold(c), "[^A-Z0-9]+", ""), F.lit(""))


def _base_tables() -> tuple[str, str]:
    """Characters beyond ASCII whose capital is A-Z or 0-9 with marks or none, and that letter."""
    found = {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        c = chr(code)
        capital = c.upper() if len(c.upper()) == 1 else c
        base = "".join(x for x in unicodedata.normalize("NFD", capital) if not unicodedata.combining(x))
        if len(base) == 1 and base in _UPPER + "0123456789":
            found[c] = base
    return "".join(found), "".join(found.values())


_BASE_FROM, _BASE_TO = _base_tables()


def base_letters(c: Column) -> Column:
    """Number of letters A-Z and digits of the capitals without accents; forms that only compatibility folds count for none."""
    return F.coalesce(F.length(F.regexp_replace(F.translate(c, _BASE_FROM, _BASE_TO), "[^A-Za-z0-9]+", "")), F.lit(0))


def ascii_bounds(pattern: str) -> str:
    r"""``pattern`` with ``\b`` between ASCII words only, and upper and lower case of ASCII letters only, whatever flags stand before it."""
    word = "[A-Za-z0-9_]"
    return "(?-Uu)" + pattern.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


def spaced_key(c: Column, folded: bool = False) -> Column:
    """Folded upper-case words of A-Z and 0-9, one space between; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(c if folded else upper_fold(c), "[^A-Z0-9]+", " ")), F.lit(""))


# ---------------------------------------------------------------- numbers
AMBIGUOUS = "ambiguous separator"
UNKNOWN = "unknown number format"


def decimal_text(c: Column, zeros: bool = False) -> Column:
    """Locale-aware number text -> ``struct(value, error)``.

    The canonical text keeps its scale.  Blank gives null without error; one
    separator before exactly three digits is ambiguous, so it is an error.
    With ``zeros`` only whole numbers lose their leading zeros.
    """
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    whole = s.rlike(r"^[+-]?[0-9]+$")
    one = s.rlike(r"^[+-]?[0-9]+[,.][0-9]+$")
    unclear = one & s.rlike(r"[,.][0-9]{3}$")
    dotted = s.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$")
    commas = s.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+\.[0-9]+$")
    text = (
        F.when(whole, s)
        .when(one, F.replace(s, F.lit(","), F.lit(".")))
        .when(dotted, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(commas, F.replace(s, F.lit(","), F.lit("")))
    )
    text = F.regexp_replace(text, r"^\+", "")
    short = F.regexp_replace(text, r"^(-?)0+(?=[0-9])", "$1")
    text = F.when(whole, short).otherwise(text) if zeros else short
    blank = c.isNull() | (s == "")
    error = F.when(unclear, AMBIGUOUS).when(~(whole | one | dotted | commas), UNKNOWN)
    return F.struct(F.when(~blank & error.isNull(), text).alias("value"), F.when(~blank, error).alias("error"))


def loose_number(c: Column) -> Column:
    """Exploration-time parser -> ``struct(value, error)``: ``5.000,00``, ``12,5`` and ``8180.0``."""
    grouped = c.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})*(,[0-9]+)?$") | c.rlike(r"^-?[0-9]+(,[0-9]+)?$")
    pointed = c.rlike(r"^-?[0-9]+\.[0-9]+$")
    value = F.when(grouped, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(pointed, c)
    return F.struct(value.try_cast("double").alias("value"), (c.isNotNull() & ~(grouped | pointed)).alias("error"))


def number_or_null(c: Column) -> Column:
    return c.try_cast("double")


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def fixed_number(c: Column, places: int) -> Column:
    """A double with so many decimals, as ``%.2f`` prints it: rounding looks at the exact binary value, ties to even."""
    return F.call_function("format_number", c, F.lit("0." + "0" * places))


def exponent_number(c: Column, places: int) -> Column:
    """A double with one digit before the point and so many behind it, as ``%.1e`` prints it, ties to even.

    Whole numbers that lie half-way are moved towards the even neighbour first.
    """
    scientific = lambda x: F.call_function("format_number", x, F.lit("0." + "0" * places + "E0"))
    power = lambda text: F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")

    def even(v: Column) -> Column:
        step, size = F.pow(F.lit(10.0), power(scientific(v)) - places), F.abs(v)
        kept = F.floor(size / step)
        return F.when((step >= 2) & ((size - kept * step) * 2 == step) & (kept % 2 == 0), v - F.signum(v)).otherwise(v)

    def shown(text: Column) -> Column:
        n = F.abs(power(text)).cast("string")
        return F.concat(F.split_part(text, F.lit("E"), F.lit(1)), F.lit("e"), F.when(power(text) < 0, "-").otherwise("+"), F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0")))

    return let(let(c, lambda v: scientific(even(v))), shown)


def general_number(c: Column) -> Column:
    """A double with six significant digits and no trailing zeros, as ``%g`` prints it (``13``, ``2.5``, ``1.23e-05``).

    Rounding looks at the exact binary value, ties to even.
    """
    scientific = lambda x: F.call_function("format_number", x, F.lit("0.#####E0"))
    power = lambda text: F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")

    def even(v: Column) -> Column:
        """Whole numbers of seven digits and more that lie half-way: moved towards the even neighbour."""
        step, size = F.pow(F.lit(10.0), power(scientific(v)) - 5), F.abs(v)
        kept = F.floor(size / step)
        return F.when((size >= 1e6) & ((size - kept * step) * 2 == step) & (kept % 2 == 0), v - F.signum(v)).otherwise(v)

    def shown(text: Column) -> Column:
        sign, n = F.when(power(text) < 0, "-").otherwise("+"), F.abs(power(text)).cast("string")
        plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
        far = F.concat(F.split_part(text, F.lit("E"), F.lit(1)), F.lit("e"), sign, F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0")))
        return F.when(power(text).between(-4, 5), plain).otherwise(far)

    special = F.when(c == 0, F.lit("0")).when(F.isnan(c), F.lit("nan")).when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
    return F.coalesce(special, let(let(c, lambda v: scientific(even(v))), shown))


# ---------------------------------------------------------------- names
def replace_in_order(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Case-insensitive regular-expression replacements, one after another."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, "(?iU)" + pattern, replacement)
    return c


def _upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))


def sentence_case(c: Column, acronyms: Sequence[str], share: float = 0.7) -> Column:
    """Lower-case a text that is mostly upper case, except acronyms and words with digits; first letter up."""
    letters = F.length(F.regexp_replace(c, r"(?U)[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(c, r"(?U)[^\p{Lu}]", ""))
    known = F.array(*[F.lit(a) for a in sorted(acronyms)]) if acronyms else F.array().cast("array<string>")
    lowered = F.array_join(F.transform(F.split(c, " "), lambda w: F.when(F.array_contains(known, spaced_key(w)) | w.rlike("[0-9]"), w).otherwise(F.lower(w))), " ")
    return _upper_first(F.when((letters > 0) & (upper >= share * letters), lowered).otherwise(c))


def fix_words(c: Column, acronyms: Sequence[str], accents: dict[str, str]) -> Column:
    """The letters a-z of acronyms in capitals; known words with their accents, a leading capital kept."""
    known = F.array(*[F.lit(a) for a in sorted(acronyms)]) if acronyms else F.array().cast("array<string>")
    pairs = [F.lit(x) for kv in sorted(accents.items()) for x in kv]
    table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")

    def word(w: Column) -> Column:
        fixed = F.try_element_at(table, F.lower(w))
        capital = F.substring(w, 1, 1).rlike(r"^\p{Lu}")
        return F.when(F.array_contains(known, spaced_key(w)), F.translate(w, _LOWER, _UPPER)).when(fixed.isNotNull(), F.when(capital, F.concat(F.upper(F.substring(fixed, 1, 1)), F.lower(F.substring(fixed, 2, 1_000_000)))).otherwise(fixed)).otherwise(w)

    return F.array_join(F.transform(F.split(c, " "), word), " ")


def normal_name(c: Column, pack) -> Column:
    """Base name: replacements, casing, words; null where the key has fewer than three characters."""
    text = F.trim(replace_in_order(c, pack.replacements))
    cased = let(text, lambda t: sentence_case(t, pack.acronyms))
    named = let(F.trim(fix_words(cased, pack.acronyms, pack.accents)), lambda t: F.nullif(_upper_first(t), F.lit("")))
    return F.when(c.isNotNull() & (F.length(compact_key(c)) >= 3), named)


def standard_name(base: Column, brand: Column, model: Column) -> Column:
    """Base, brand and model, leaving out what the name so far already holds."""
    keys = F.struct(compact_key(base).alias("n"), compact_key(brand).alias("b"), compact_key(model).alias("m"))

    def joined(k: Column) -> Column:
        add_brand = (k["b"] != "") & ~F.contains(k["n"], k["b"])
        so_far = F.when(add_brand, F.concat(k["n"], k["b"])).otherwise(k["n"])
        add_model = (k["m"] != "") & ~F.contains(so_far, k["m"])
        return F.concat_ws(" ", base, F.when(add_brand, brand), F.when(add_model, model))

    return F.when(base.isNotNull(), let(keys, joined))


#: Result statuses.
ACTIVE, INVALID, FLAGGED = "Activo", "Revisar: descripción inválida", "Revisar: marcado no usar / eliminar"


def operational_status(description: Column, base: Column, flag_pattern: str) -> Column:
    return F.when(base.isNull(), INVALID).when(description.rlike("(?iU)" + flag_pattern), FLAGGED).otherwise(ACTIVE)


def brand_key(c: Column, placeholders: Sequence[str], aliases: dict[str, str]) -> Column:
    """Compact key of a brand, placeholders null, aliases resolved."""
    pairs = [F.lit(x) for kv in sorted(aliases.items()) for x in kv]
    table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    alias = lambda k: F.nullif(compact_key(F.try_element_at(table, k)), F.lit(""))
    return let(compact_key(c), lambda k: F.when((k != "") & ~k.isin(*placeholders), F.coalesce(alias(k), k)))


def canonical_brand(key: Column, aliases: dict[str, str]) -> Column:
    """The name that the alias table gives a brand's key; null where it has none."""
    out = F.lit(None).cast("string")
    for name in sorted(set(aliases.values()), reverse=True):
        out = F.when(key == compact_key(F.lit(name)), F.lit(name)).otherwise(out)
    return out


def standard_model(c: Column, placeholders: Sequence[str]) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"(?U)\s*[-–]\s*", "-"), SPACES, " "))
    return let(text, lambda t: let(compact_key(t), lambda k: F.when((k != "") & ~k.isin(*placeholders), t)))


def identity(c: Column, placeholders: Sequence[str]) -> Column:
    """Folded text; placeholders and null become empty."""
    key = search_key(c)
    return F.when(key.isin(*placeholders), F.lit("")).otherwise(key)


# ---------------------------------------------------------------- codes
def code_country(c: Column, countries: Sequence[str]) -> Column:
    """Country of a code's prefix, else of its suffix after a digit or underscore."""
    one = "|".join(countries)
    front = F.regexp_extract(c, rf"^({one})[\s_\-]", 1)
    back = F.regexp_extract(c, rf"(?<=[_\d])({one})$", 1)
    return F.coalesce(F.nullif(front, F.lit("")), F.nullif(back, F.lit("")))


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule ``(label, pattern)`` that is found in the text."""
    out = None
    for label, pattern in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def split_list(c: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def short_method(c: Column) -> Column:
    return F.when(c.startswith("Revisar: conflicto"), "Revisar: conflicto").otherwise(c)


#: Characters beside letters, digits and white space that descriptions may hold, and wrongly coded accents.
COMMON_MARKS = ".,;:-/()\"'#%&+°º´`!?¿¡*=<>@[]_"
GRAVE = "òàèìù"


def uncommon_characters(c: Column) -> Column:
    """Whether a text holds a character that is no letter or digit of any alphabet, no white space and no common mark."""
    return c.rlike(rf"[^\p{{L}}\p{{N}}\p{{IsWhite_Space}}{re.escape(COMMON_MARKS)}]")


def grave_accents(c: Column) -> Column:
    return c.rlike(f"[{GRAVE}]")


# ---------------------------------------------------------------- digests
def group_id(key: Column) -> Column:
    return F.concat(F.lit("DUP-"), F.upper(F.substring(F.sha1(key), 1, 6)))


def row_digest(*columns: str) -> Column:
    """SHA-256 of a row as JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def sorted_map(c: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def padded_code(prefix: Column, number: Column, digits: int = 5) -> Column:
    return F.concat(prefix, F.lit("-"), F.format_string(f"%0{digits}d", number))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(100 * part / whole, 1)).otherwise(F.lit(0.0))


def close(a: Column, b: Column, absolute: float = 1.0, relative: float = 0.001) -> Column:
    gap = F.abs(a - b)
    return (gap <= absolute) | (gap <= relative * F.abs(b))


# ---------------------------------------------------------------- JSON
def json_valid(c: Column) -> Column:
    """Whether a text is one JSON object; null for null."""
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull()) if hasattr(F, "try_parse_json") else F.when(c.isNotNull(), F.json_object_keys(c).isNotNull())


def json_map(c: Column) -> Column:
    """A JSON object as a map of text, null where it is none."""
    return F.when(json_valid(c), F.from_json(c, "map<string,string>"))
