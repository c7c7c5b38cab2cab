"""Normalisers and keys for names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEGAL = ("ltd", "limited", "plc", "inc", "llc", "gmbh", "co", "company", "corp", "group", "uk", "europe")


def norm(x: Column) -> Column:
    """Lower-cased, every run of other characters than a-z and 0-9 one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def norm_and(x: Column) -> Column:
    return norm(F.replace(x, F.lit("&"), F.lit(" and ")))


def strict_key(x: Column, suffixes: tuple[str, ...] = LEGAL) -> Column:
    """norm_and without legal forms and territories at the end, however many."""
    return F.regexp_replace(norm_and(x), rf"(\s+({'|'.join(suffixes)}))+$", "")


def loose_key(x: Column, suffixes: tuple[str, ...] = LEGAL) -> Column:
    """norm without those words anywhere."""
    return F.trim(F.regexp_replace(F.regexp_replace(norm(x), rf"\b({'|'.join(suffixes)})\b", " "), " +", " "))


def space_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")


def slug(x: Column, last: int = 60) -> Column:
    return F.right(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(last))


def significant_tokens(x: Column, least: int = 4, stop: tuple[str, ...] = ()) -> Column:
    """Distinct sorted words of at least ``least`` letters outside ``stop``."""
    words = F.filter(F.split(norm(x), " "), lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least)
    return F.array_sort(F.array_distinct(words))


def word_bag(x: Column, stop: tuple[str, ...], cap: int = 120) -> Column:
    """Unique sorted words of two letters and more outside ``stop``, joined by blanks."""
    words = F.filter(F.split(norm(x), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*stop))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, cap), " ")


def money(x: Column) -> Column:
    """A number out of text with currency signs and separators; null where there is none."""
    return F.regexp_replace(x, r"[£$€,\s]", "").try_cast("double")


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word phrase containment over normalised texts."""
    return F.instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0


def strip_blocks(html: Column, tags: tuple[str, ...] = ("script", "style", "nav", "header", "footer")) -> Column:
    return F.regexp_replace(html, rf"(?is)<({'|'.join(tags)})\b.*?</\1>", " ")


def visible_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(strip_blocks(html), r"(?s)<!--.*?-->|<[^>]*>", " "), r"\s+", " "))


def label_before_digit(x: Column, trim: str = " #-") -> Column:
    """The text before its first digit without separators at its end; the whole text where nothing is left."""
    return F.coalesce(F.nullif(F.rtrim(F.regexp_extract(x, "^[^0-9]*", 0), F.lit(trim)), F.lit("")), x)


#: Legal forms alone, those with trade words, and marks around a name that are no part of it.
FORMS, TRADE = ("ltd", "limited", "plc", "inc", "llc", "gmbh"), ("group", "holdings", "international", "trading")
DECORATION = r"(?i)(\s*(\((uk|trading|formerly[^()]*)\)|[,;:*†.-]+|\bt/a\b.*))+$"


def shallow_key(x: Column, suffixes: tuple[str, ...] = FORMS) -> Column:
    """Lower-cased without legal forms at the end; group and trade words, & and - stay."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9&-]+", " ")), rf"(\s+({'|'.join(suffixes)}))+$", "")


def form_key(x: Column) -> Column:
    """Upper-cased, single-spaced, Limited as LTD and without full stops: equal for one legal entity's spellings."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.upper(F.trim(x)), F.lit("."), F.lit("")), r"\bLIMITED\b", "LTD"), r"\s+", " ")


def undecorated(x: Column) -> Column:
    """Without marks at the end, however many; applying it again changes nothing."""
    return F.trim(F.regexp_replace(F.trim(x), DECORATION, ""))


def heads(x: Column) -> Column:
    """The strict keys of the parts of a name that brackets, commas and slashes divide, without empty ones."""
    return F.filter(F.transform(F.split(x, "[(),/]"), lambda c: strict_key(c)), lambda c: c != "")


def lead(x: Column, least: int = 4) -> Column:
    """The first word of a name's first part if it has ``least`` letters, else that part; null without any."""
    first = F.get(heads(x), F.lit(0))
    word = F.get(F.split(first, " "), F.lit(0))
    return F.when(F.length(word) >= least, word).otherwise(first)


def keyword_string(parts: list[Column], cap: int = 400) -> Column:
    """Texts and arrays of texts, lower-cased, joined by blanks, at most ``cap`` characters."""
    return F.substring(F.lower(F.concat_ws(" ", *parts)), 1, cap)


def number_forms(x: Column, width: int = 8) -> Column:
    """A registration number as it is, without leading zeros, and filled with them; distinct."""
    return F.array_distinct(F.array(x, F.regexp_replace(x, "^0+(?=.)", ""), F.lpad(x, width, "0")))


#: What a money text's unit is worth.
UNITS = {"k": 1_000, "thousand": 1_000, "m": 1_000_000, "million": 1_000_000, "bn": 1_000_000_000, "billion": 1_000_000_000}
_MONEY = r"(?i)^\s*[£$€]?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(k|thousand|m|million|bn|billion)?\s*$"


def money_units(x: Column) -> Column:
    """Whole currency units of texts like '£1.2m' or '3,400'; null where the text is no amount."""
    unit = F.lower(F.regexp_extract(x, _MONEY, 2))
    worth = F.lit(1)
    for name, n in UNITS.items():
        worth = F.when(unit == name, n).otherwise(worth)
    amount = F.replace(F.regexp_extract(x, _MONEY, 1), F.lit(","), F.lit("")).try_cast("decimal(20,4)")
    return F.round(amount * worth).cast("long")


def gbp(x: Column) -> Column:
    """Amounts shortened as text: £950, £12k, £3.4m, £1.2bn; a minus sign goes first."""
    a = F.abs(x)
    short = lambda n, unit: F.concat(F.regexp_replace(F.format_string("%.1f", a / F.lit(float(n))), r"\.0$", ""), F.lit(unit))
    text = F.when(a >= 1e9, short(1e9, "bn")).when(a >= 1e6, short(1e6, "m")).when(a >= 1e3, F.concat(F.floor(a / 1e3 + 0.5).cast("string"), F.lit("k"))).otherwise(F.floor(a + 0.5).cast("string"))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("£"), text)


def last_date(x: Column) -> Column:
    """The last dd/mm/yyyy of a text, null if it is no date."""
    return F.try_to_date(F.try_element_at(F.regexp_extract_all(x, F.lit(r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"), F.lit(1)), F.lit(-1)), "d/M/y")


def first_match(x: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The label of the first (pattern, label) whose pattern stands in ``x``; else ``otherwise``, null unless given."""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(x.rlike(pattern), label).otherwise(out)
    return out


def titled(x: Column, small: tuple[str, ...] = ("of", "and", "the", "for"), capital: tuple[str, ...] = ("NHS", "UK")) -> Column:
    """Title case; ``small`` words stay small inside, ``capital`` ones are capitals everywhere."""
    words = F.transform(F.split(F.trim(x), r"\s+"), lambda w, i: F.when(F.upper(w).isin(*capital), F.upper(w)).when((i > 0) & F.lower(w).isin(*small), F.lower(w)).otherwise(F.initcap(w)))
    return F.array_join(words, " ")


def stems(x: Column, least: int = 5, size: int = 8) -> Column:
    """Distinct beginnings of ``size`` letters of a text's words of at least ``least`` letters, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(x), F.lit(f"[a-z]{{{least},}}"), F.lit(0)), lambda w: F.substring(w, 1, size))))


def word_pairs(x: Column, cap: int = 6) -> Column:
    """Candidate queries out of a name: its first two words, its first word, and its slug, those that there are."""
    w = F.filter(F.split(norm(x), " "), lambda t: t != "")
    pair = F.when(F.size(w) > 1, F.array_join(F.slice(w, 1, 2), " "))
    return F.slice(F.array_distinct(F.array_compact(F.array(pair, F.get(w, F.lit(0)), F.nullif(F.array_join(w, "-"), F.lit(""))))), 1, cap)


def js_round(x: Column) -> Column:
    """Halves go up, below zero as well."""
    return F.floor(x + 0.5)


def linear_light(x: Column) -> Column:
    """The linear light of an sRGB channel of 0 to 255."""
    c = x / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(hexed: Column) -> Column:
    """Relative luminance of a colour rrggbb, null if it is none."""
    channel = lambda at: linear_light(F.conv(F.substring(hexed, at, 2), 16, 10).try_cast("double"))
    return F.when(hexed.rlike("^[0-9A-Fa-f]{6}$"), 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5))


def contrast(a: Column, b: Column) -> Column:
    """The contrast ratio of two colours rrggbb, from 1 to 21; null if either is none."""
    x, y = luminance(a), luminance(b)
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def mixed(a: Column, b: Column, share: float) -> Column:
    """A colour rrggbb moved towards another by ``share``: lighter with ffffff, darker with 000000."""
    value = lambda x, at: F.conv(F.substring(x, at, 2), 16, 10).cast("double")
    return F.concat(*[F.lower(F.lpad(F.hex(js_round(value(a, at) + (value(b, at) - value(a, at)) * share).cast("long")), 2, "0")) for at in (1, 3, 5)])
