"""Entities by their form, with values: amounts, shares, measures and dates in four languages, cards, accounts, phones, credentials.

Each kind is a pattern that a plain search or two precedes, and an expression that reads its matches: separators of
thousands and decimals are told apart by how they stand, dates must exist, numbers of cards and accounts must pass their
check digits. All of it is built-in functions; `detector` composes it with the rules of `detect`, and `checked` holds any
detector's output (a model's, for one) to what a text really says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import taxonomy
from hushframe.operators import detect

# Currencies by sign, code and word; magnitudes; months by their beginnings; units.
CURRENCIES = {"USD": ("$", "US$", "dollar", "dollars", "Dollar"), "EUR": ("€", "euro", "euros", "Euro"), "GBP": ("£", "pounds"), "JPY": ("¥", "yen"), "CHF": ("Fr.",), "CNY": ("yuan",)}
MAGNITUDES = {
    1e3: ("k", "thousand", "Tsd.", "mil"), 1e6: ("M", "million", "millions", "Mio.", "Million", "Millionen", "millón", "millones"),
    1e9: ("bn", "billion", "Mrd.", "Milliarde", "Milliarden", "milliard", "milliards"),
}
MONTHS = (
    ("jan", "ene"), ("feb", "fév", "fev"), ("mar", "mär", "mrz"), ("apr", "avr", "abr"), ("may", "mai"), ("jun", "juin"),
    ("jul", "juil"), ("aug", "aoû", "aou", "ago"), ("sep",), ("oct", "okt"), ("nov",), ("dec", "dez", "déc", "dic"),
)
UNITS = ("kg", "mg", "g", "km", "cm", "mm", "m", "ml", "l", "kB", "MB", "GB", "TB", "kWh", "°C", "°F")
PERCENT = ("%", "percent", "per cent", "Prozent", "pour cent", "por ciento")

_NUMBER = r"[0-9]{1,3}(?:[.,'\x{00A0}\x{202F} ][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]+)?"
_MONTH = "(?:" + "|".join(sorted({m for own in MONTHS for m in own}, key=lambda m: (-len(m), m))) + r")[a-zäéûA-Z]{0,7}\.?"


def _any(words) -> str:
    """A pattern of literal words, longer ones first."""
    quoted = lambda w: "".join(f"\\{c}" if c in r".$()[]+*?^|\\" else c for c in w)
    return "(?:" + "|".join(quoted(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


_SIGNS = [w for own in CURRENCIES.values() for w in own if not w[0].isalpha() or w == "US$"] + list(CURRENCIES)
_WORDS = [w for own in CURRENCIES.values() for w in own] + list(CURRENCIES)
_LARGE = [w for own in MAGNITUDES.values() for w in own]
#: What a match of each kind looks like; patterns keep to what Java's and RE2's expressions share.
PATTERNS = {
    "financial": rf"(?:{_any(_SIGNS)} ?(?:{_NUMBER})(?: ?{_any(_LARGE)}\b)?)|(?:\b(?:{_NUMBER})(?: {_any(_LARGE)})?(?: | de )?{_any(_WORDS)})",
    "percentage": rf"\b(?:{_NUMBER}) ?{_any(PERCENT)}",
    "measurement": rf"\b(?:{_NUMBER}) ?{_any(UNITS)}\b",
    "temporal": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}\b"
    rf"|\b[0-9]{{1,2}}\.? (?:de )?(?i:{_MONTH}) (?:de )?[0-9]{{4}}\b|\b(?i:{_MONTH}) [0-9]{{1,2}},? [0-9]{{4}}\b",
    "card": r"\b[2-6][0-9]{3}(?:[ -]?[0-9]{2,6}){2,4}\b",
    "account": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}\b|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b",
    "credential": r"(?i:\b(?:password|passwd|passwort|secret|token|api[_-]?key))[\"']?\s*[:=]\s*[\"']?[^\s\"',;]{6,}",
}
#: The entity type of a kind that isn't one itself.
TYPES = {"card": "identifier", "account": "financial"}
#: What a text must hold for a kind to match at all.
_HINTS = {"percentage": r"%|ercent|er cent|rozent|our cent|or ciento", "credential": r"[:=]"}


def _once(value: Column, use: Callable) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def number(text: Column) -> Column:
    """The value of a number with separators, null for other texts.

    Of a point and a comma the later one is the decimal sign; a sign that comes twice separates thousands, and so does one
    that stands before just three digits with one to three digits, not beginning with 0, before it. Blanks and apostrophes separate thousands.
    """
    return _once(F.regexp_replace(text, r"['\x{00A0}\x{202F} ]", ""), _number)


def _number(bare: Column) -> Column:
    count = lambda sign: F.length(bare) - F.length(F.replace(bare, F.lit(sign), F.lit("")))
    point, comma = count("."), count(",")
    last_comma = F.instr(F.reverse(bare), ",") < F.instr(F.reverse(bare), ".")  # counted from the end
    grouped = bare.rlike(r"^[1-9][0-9]{0,2}(?:[.,][0-9]{3})+$")
    only = lambda signs: F.translate(bare, signs, "")
    plain = (
        F.when((point > 0) & (comma > 0), F.when(last_comma, F.replace(only("."), F.lit(","), F.lit("."))).otherwise(only(",")))
        .when((point + comma > 1) | grouped, only(".,"))
        .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    )
    return plain.try_cast("double")


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return _once(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))  # nullif would look twice


def _named(text: Column, table: dict, value: Callable = F.lit) -> Column:
    """The key of the table whose word a text is."""
    out = F.lit(None)
    for key, words in table.items():
        out = F.when(text.isin(*words), value(key)).otherwise(out)
    return out


def amount(text: Column) -> Column:
    """An amount as struct<value double, unit string>: its number, times its magnitude, and its currency."""
    told = F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?:{_NUMBER})", ""), r" de ", " "))
    large = lambda t: _first(F.concat(F.lit(" "), t, F.lit(" ")), rf"[ €$£¥]({_any(_LARGE)}) ", 1)
    times = lambda t: _once(large(t), lambda x: F.coalesce(_named(x, MAGNITUDES).cast("double"), F.lit(1.0)))
    sign = lambda t: F.coalesce(_first(t, _any([*CURRENCIES, *(w for own in CURRENCIES.values() for w in own)])), t)
    unit = lambda t: _once(sign(t), lambda x: _named(x, {k: (k, *own) for k, own in CURRENCIES.items()}).cast("string"))
    value = number(_first(text, rf"(?:{_NUMBER})"))
    return _once(told, lambda t: F.struct((value * times(t)).alias("value"), unit(t).alias("unit")))


def date(text: Column, day_first: bool = False) -> Column:
    """The day that a date names, null where there is none such. day_first: how 03/04/2024 reads; with points the day comes first."""
    # juin and juillet begin alike in no other month; mar is March though mai is May
    starts = [(m, f"{i:02d}") for i, own in enumerate(MONTHS, 1) for m in own]
    named = lambda month: reduce(lambda rest, s: F.when(month.startswith(s[0]), F.lit(s[1])).otherwise(rest), starts, F.lit(None).cast("string"))
    year, first, second = _first(text, r"([0-9]{4})", 1), _first(text, r"^([0-9]{1,2})[./]", 1), _first(text, r"^[0-9]{1,2}[./]([0-9]{1,2})[./]", 1)
    day = _first(F.regexp_replace(text, r"[0-9]{4}", ""), r"([0-9]{1,2})", 1)
    numbered = lambda p: F.when(
        text.rlike(r"^[0-9]{1,2}\.") | (p["first"].cast("int") > 12) | F.lit(day_first), F.concat_ws("-", year, F.lpad(p["second"], 2, "0"), F.lpad(p["first"], 2, "0"))
    ).otherwise(F.concat_ws("-", year, F.lpad(p["first"], 2, "0"), F.lpad(p["second"], 2, "0")))
    month = _once(F.lower(_first(text, rf"(?i:{_MONTH})")), named)
    words = _once(month, lambda m: F.when(m.isNotNull(), F.concat_ws("-", year, m, F.lpad(day, 2, "0"))))
    parts = F.when(text.rlike(r"^[0-9]{4}-"), text).otherwise(_once(F.struct(first.alias("first"), second.alias("second")), lambda p: F.when(p["second"].isNotNull(), numbered(p)).otherwise(words)))
    return F.try_to_date(parts, "yyyy-MM-dd")


def luhn(text: Column) -> Column:
    """Whether the digits of a text (13 to 19, not all alike) pass the check of card numbers."""
    return _once(F.regexp_replace(text, "[^0-9]", ""), _luhn)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.length(digits).between(13, 19) & ~digits.rlike(r"^(.)\1+$") & (total % 10 == 0)


def iban(text: Column) -> Column:
    """Whether a text is an account number of 15 to 34 signs whose check digits are right."""
    bare = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(4)))
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97)
    return F.length(bare).between(15, 34) & (rest == 1)


def _values(kind: str, surface: Column) -> Column:
    """A match as struct<text, type, value, unit, day, good>."""
    none = F.lit(None)

    def of(value=none.cast("double"), unit=none.cast("string"), day=none.cast("date"), good=F.lit(True)) -> Column:
        fields = {"entity_text": surface, "entity_type": F.lit(TYPES.get(kind, kind)), "value": value, "unit": unit, "day": day, "good": F.coalesce(good, F.lit(False))}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    if kind == "financial":
        return _once(amount(surface), lambda a: of(value=a["value"], unit=a["unit"], good=a["value"].isNotNull()))
    if kind == "percentage":
        return of(value=number(_first(surface, rf"(?:{_NUMBER})")) / 100)
    if kind == "measurement":
        return of(value=number(_first(surface, rf"(?:{_NUMBER})")), unit=_first(surface, rf"{_any(UNITS)}$"))
    if kind == "temporal":
        return _once(date(surface), lambda day: of(day=day, good=day.isNotNull()))
    checks = {"card": luhn, "account": iban, "phone": lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")).between(8, 17)}
    return of(good=checks[kind](surface) if kind in checks else F.lit(True))


def matches(text: Column, kind: str) -> Column:
    """All matches of a kind in a text that read well, in order: array<struct<entity_text, entity_type, value, unit, day>>."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    held = text.rlike(_HINTS.get(kind, "[0-9]"))
    every = F.transform(F.transform(found, lambda s: F.trim(s)), lambda s: _values(kind, s))
    kept = F.transform(F.filter(every, lambda e: e["good"]), lambda e: F.struct(*[e[c].alias(c) for c in ("entity_text", "entity_type", "value", "unit", "day")]))
    return F.when(held, kept)


def entities(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """All matches: the columns of `docs` without text, with kind, place (among those of its kind), entity_text, entity_type, value, unit and day. A null text has none."""
    rest = [c for c in docs.columns if c != text]
    one = lambda kind: F.transform(matches(F.col(text), kind), lambda e, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("place"), *[e[c].alias(c) for c in ("entity_text", "entity_type", "value", "unit", "day")]))
    every = F.flatten(F.array_compact(F.array(*[one(k) for k in kinds])))
    return docs.select(*rest, F.inline(every))


def detector(docs: DataFrame) -> DataFrame:
    """The rules of `detect` and the kinds here, as one detector for `turn_pipeline.detect_turns`."""
    known = detect.detect(docs)
    offset = F.create_map(*[x for i, k in enumerate(PATTERNS) for x in (F.lit(k), F.lit((len(detect.RULES) + i) * 1_000_000).cast("long"))])
    rank = (offset[F.col("kind")] + F.col("place")).alias("detect_rank")
    more = entities(docs)
    return known.unionByName(more.select(*[c for c in docs.columns if c != "text"], F.lit(1).alias("source_rank"), rank, "entity_text", "entity_type"))


def checked(found: DataFrame, docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """What of a detector's entities may be believed: those of a known type whose surface, without space around it, stands in its text.

    found: (keys, entity_text, entity_type, ...); types are taken in any case. Null keys are values like others.
    """
    slug = F.lower(F.trim("entity_type"))
    clean = found.withColumn("entity_text", F.trim("entity_text")).withColumn("entity_type", slug).filter(slug.isin(*taxonomy.TAGS) & (F.col("entity_text") != ""))
    texts = docs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(text).alias("_said"))
    on = F.contains("_said", F.col("entity_text"))
    for k in keys:
        on = on & clean[k].eqNullSafe(F.col(f"_{k}"))
    return clean.join(texts, on, "left_semi")
