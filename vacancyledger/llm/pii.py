"""Format-preserving pseudonyms by keyed Feistel networks, in column expressions only."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart

#: Rounds of a network; even, so that both halves end where they started.
ROUNDS = 10
KEY = "vacancyledger"

#: Characters of an IBAN by country: the registry, and countries that use the format without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD TG",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """An IBAN ends at its country's length, whatever follows; only other countries' end is open."""

    def of(length: int, countries: str) -> str:
        groups, rest = divmod(length - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}"

    known = [of(n, c) + r"(?!\w)" for n, c in IBAN_LENGTHS.items()]
    return r"(?<!\w)(?:" + "|".join([*known, r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"]) + r")(?!\w)"


# What a candidate of each kind looks like. Kinds are tried in this order.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "iban": _iban_pattern(),
    "card": r"(?<![\w.+])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}|\+\d{8,15}|\d{3}-\d{3}-\d{4}|(?<!\d\.)(?:1\.)?\d{3}\.\d{3}\.\d{4}(?!\.\d)|\d{3} \d{3} \d{4})(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![A-SU-Za-su-z0-9_/-]|[Tt]\D|[Tt]$|\.\d)",
}
ANY = "|".join(PATTERNS.values())


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(key: str, tweak: str, turn: Column, other: Column) -> Column:
    """The round function: 64 hexadecimal digits of the key, the kind, the round and the other half."""
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), turn.cast("string"), other.cast("string")), 256)


def permute_number(x: Column, y: Column, a: int, b: int, tweak: str, key: str, use: Callable[[Column], Column]) -> Column:
    """``use(pair)`` on the permuted pair (x, y) of [0, a) times [0, b): every pair is met once."""

    def turn(pair: Column, n: Column) -> Column:
        even = n % 2 == 0
        other = F.when(even, pair["y"]).otherwise(pair["x"])
        shift = F.conv(F.substring(_digest(key, tweak, n, other), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(even, (pair["x"] + shift) % a).otherwise(pair["x"]).alias("x"),
            F.when(even, pair["y"]).otherwise((pair["y"] + shift) % b).alias("y"),
        )

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return bind(F.aggregate(F.lit(list(range(ROUNDS))), start, turn), use)


def _runs(ours: Callable[[str], bool]) -> list[tuple[int, int, int]]:
    """(first, size, how many before) of each run of code points of a class."""
    found: list[list[int]] = []
    total = 0
    for code in range(128, 0x110000):
        if not 192 <= code < 256 and ours(chr(code)):
            if found and found[-1][0] + found[-1][1] == code:
                found[-1][1] += 1
            else:
                found.append([code, 1, total])
            total += 1
    return [tuple(r) for r in found]


def _old(char: str) -> bool:
    return unicodedata.ucd_3_2_0.category(char)[0] in "LN"


#: Letters and numbers outside the small classes: those of Unicode 3.2, which every JVM knows, and later ones.
WIDE = (_runs(_old), _runs(lambda c: unicodedata.category(c)[0] in "LN" and not _old(c)))


def _shifted(char: Column, by: Column, wide: bool) -> Column:
    """The character moved on within its class: digits, a-z, A-Z, U+00C0 to U+00FF, and ``WIDE`` if asked; others stay."""
    code = F.ascii(char)
    out = char
    for runs in WIDE if wide else ():
        out = F.when(code > 127, _shifted_in(runs, code, by, out)).otherwise(char)
    for first, size in ((48, 10), (97, 26), (65, 26), (192, 64)):
        inside = (code >= first) & (code < first + size)
        out = F.when(inside, F.chr((code - first + by) % size + first)).otherwise(out)
    return out


def _shifted_in(runs: list[tuple[int, int, int]], code: Column, by: Column, other: Column) -> Column:
    """The character moved on within a class of many runs; ``other`` if the code is not in it."""
    table = F.expr("array(" + ", ".join(f"named_struct('f', {f}, 's', {s}, 'n', {n})" for f, s, n in runs) + ")")
    total = runs[-1][1] + runs[-1][2]

    def text(place: Column) -> Column:
        to = F.filter(table, lambda r: (place >= r["n"]) & (place < r["n"] + r["s"]))
        return bind(to[0], lambda r: F.decode(F.unhex(F.lpad(F.hex(r["f"] + place - r["n"]), 8, "0")), "UTF-32"))

    def moved(run: Column) -> Column:
        return F.when(run.isNull(), other).otherwise(bind((run["n"] + code - run["f"] + by) % total, text))

    return bind(F.get(F.filter(table, lambda r: (code >= r["f"]) & (code < r["f"] + r["s"])), F.lit(0)), moved)


def permute_text(value: Column, tweak: str, key: str, wide: bool = False) -> Column:
    """A permutation of the strings of the same length whose characters have the same classes."""

    def turn(pair: Column, n: Column) -> Column:
        def shift(hexes: Column) -> Column:
            at = F.sequence(F.lit(1), F.length(pair["l"]))

            def char(i: Column) -> Column:
                by = F.conv(F.call_function("substring", hexes, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                return _shifted(F.call_function("substring", pair["l"], i, F.lit(1)), by, wide)

            return F.when(F.length(pair["l"]) == 0, F.lit("")).otherwise(F.array_join(F.transform(at, char), ""))

        return F.struct(pair["r"].alias("l"), bind(_digest(key, tweak, n, pair["r"]), shift).alias("r"))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(
        F.call_function("substring", value, F.lit(1), half).alias("l"),
        F.call_function("substring", value, half + 1, F.length(value)).alias("r"),
    )
    return bind(F.aggregate(F.lit(list(range(ROUNDS))), start, turn), lambda p: F.concat(p["l"], p["r"]))


def _refilled(value: Column, marks: str, filling: Column) -> Column:
    """``value`` with its characters outside the class ``marks`` replaced, in order, by ``filling``."""

    def put(chars: Column) -> Column:
        def at(i: Column) -> Column:
            before = F.length(F.regexp_replace(F.call_function("substring", value, F.lit(1), i), marks, ""))
            own = F.call_function("substring", value, i, F.lit(1))
            return F.when(own.rlike(marks), own).otherwise(F.call_function("substring", chars, before, F.lit(1)))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), at), "")

    return bind(filling, put)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        digit = F.call_function("substring", digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(places, F.lit(0), add)


def iban_rest(iban: Column) -> Column:
    """The number of an IBAN (check digits moved to the end) modulo 97; 1 if valid."""
    start = F.call_function("substring", iban, F.lit(1), F.lit(4))
    turned = F.concat(F.call_function("substring", iban, F.lit(5)), start)

    def rest(text: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            code = F.ascii(F.call_function("substring", text, i, F.lit(1)))
            return F.when(code < 65, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)

    return bind(turned, rest)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    name = F.regexp_replace(local, "[._%+-]", "")
    return F.concat(_refilled(local, "[._%+-]", permute_text(name, "email", key, wide=True)), F.lit("@"), F.substring_index(m, "@", -1))


def _card(m: Column, key: str) -> Column:
    """All but the check digit are permuted; the check digit is computed anew."""
    digits = F.regexp_replace(m, "[ -]", "")

    def made(d: Column) -> Column:
        front = permute_text(F.call_function("substring", d, F.lit(1), F.length(d) - 1), "card", key)
        full = bind(front, lambda f: F.concat(f, ((10 - luhn_sum(F.concat(f, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _refilled(m, "[ -]", full))

    return bind(digits, made)


def _iban(m: Column, key: str) -> Column:
    def made(text: Column) -> Column:
        country = F.call_function("substring", text, F.lit(1), F.lit(2))
        account = permute_text(F.call_function("substring", text, F.lit(5)), "iban", key)

        def checked(a: Column) -> Column:
            check = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), a))).cast("string"), 2, "0")
            return F.concat(country, check, a)

        valid = F.length(text).between(15, 34) & (iban_rest(text) == 1)
        return F.when(valid, _refilled(m, " ", bind(account, checked)))

    return bind(F.regexp_replace(m, " ", ""), made)


def _ssn(m: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999: 88902 times 9999 numbers."""
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    order = area - 1 - F.when(area > 666, 1).otherwise(0)

    def text(p: Column) -> Column:
        at = F.floor(p["x"] / 99).cast("int")
        new = at + 1 + F.when(at >= 665, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", new, (p["x"] % 99 + 1).cast("int"), (p["y"] + 1).cast("int"))

    return F.when(valid, permute_number(order * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn", key, text))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; all other digits are permuted."""
    code = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    rest = F.call_function("substring", m, F.length(code) + 1)
    digits = F.regexp_replace(rest, r"\D", "")
    long_enough = F.length(F.regexp_replace(m, r"\D", "")).between(8, 15)
    return F.when(long_enough, F.concat(code, _refilled(rest, r"\D", permute_text(digits, "phone", key))))


def _ip(m: Column, key: str) -> Column:
    part = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    valid = (part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256)

    def text(p: Column) -> Column:
        numbers = [F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256]
        return F.concat_ws(".", *[n.cast("string") for n in numbers])

    pair = permute_number(part[0] * 256 + part[1], part[2] * 256 + part[3], 1 << 16, 1 << 16, "ip", key, text)
    return F.when(valid, pair)


def _date(m: Column, key: str) -> Column:
    """A valid date is permuted among the days of its century, which hold 92 * 397 days, or 75 * 487 in
    one whose first year is a leap year. Days stand before months with dots, after them with slashes,
    unless the number can only be the other."""
    iso = m.contains("-")
    part = F.split(m, "[./-]")
    one, two, three = (part[i].cast("int") for i in range(3))
    day_first = F.when(m.contains("."), two <= 12).otherwise(one > 12)
    year = F.when(iso, one).otherwise(three)
    month = F.when(iso, two).when(day_first, two).otherwise(one)
    day = F.when(iso, three).when(day_first, one).otherwise(two)
    valid = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    stated = F.when(valid, F.format_string("%04d-%02d-%02d", year, month, day)).try_cast("date")
    padded = F.length(m) == 10

    def made(d: Column) -> Column:
        first = F.make_date(F.floor(F.year(d) / 100).cast("int") * 100, F.lit(1), F.lit(1))

        def text(new: Column) -> Column:
            two = iso | padded

            def number(n: Column) -> Column:
                return F.concat(F.when(two & (n < 10), "0").otherwise(""), n.cast("string"))

            mark = F.when(m.contains("."), ".").otherwise("/")
            y = F.lpad(F.year(new).cast("string"), 4, "0")
            a = F.when(day_first, F.dayofmonth(new)).otherwise(F.month(new))
            b = F.when(day_first, F.month(new)).otherwise(F.dayofmonth(new))
            international = F.concat_ws("-", y, number(F.month(new)), number(F.dayofmonth(new)))
            return F.when(iso, international).otherwise(F.concat(number(a), mark, number(b), mark, y))

        days = F.date_diff(d, first)
        common = permute_number(F.floor(days / 397), days % 397, 92, 397, "date", key, lambda p: p["x"] * 397 + p["y"])
        leap = permute_number(F.floor(days / 487), days % 487, 75, 487, "date", key, lambda p: p["x"] * 487 + p["y"])
        is_leap = F.floor(F.year(d) / 100) % 4 == 0
        return bind(F.date_add(first, F.when(is_leap, leap).otherwise(common).cast("int")), text)

    return F.when(stated.isNotNull(), bind(stated, made))


_MAKERS = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


def pseudonym(match: Column, key: str = KEY) -> Column:
    """Struct of kind and pseudonym of a candidate; kind null where it is not valid."""
    # A whole candidate of a kind needs no look around.
    kinds = {k: "^(?:" + _bare(p) + ")$" for k, p in PATTERNS.items()}
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in reversed(kinds):
        out = F.when(match.rlike(kinds[kind]), bind(_MAKERS[kind](match, key), _labelled(kind))).otherwise(out)
    return out


def _labelled(kind: str) -> Callable[[Column], Column]:
    return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _bare(pattern: str) -> str:
    """A pattern without its conditions on the characters around the match."""
    import re

    return re.sub(r"^\(\?<![^)]*\)|\(\?![^)]*\)$", "", pattern)


def pseudonymised(documents: DataFrame, key: str = KEY, found: str | None = "found") -> DataFrame:
    """All columns of ``documents`` with ``text`` rewritten, and ``found``: the kinds replaced, in order.

    E-mail names, IBANs, card numbers (Luhn), social security numbers, telephone numbers, IPv4
    addresses and calendar dates are replaced by pseudonyms of the same format, valid by the same
    check. A pseudonym depends on the key and the value alone, so equal values stay equal in all
    documents, and different values of a format stay different. Candidates that fail their check and
    everything else stay as they are. Null texts stay null with nothing found. ``n_chars``, where the
    table has it, follows the new text of changed rows. Rows never meet, so order, ties and repeated rows
    do not matter; an empty table gives no rows. A column called like ``found`` is returned with
    ``_input`` after its name; with ``found=None`` nothing is added.
    """
    if found:
        documents = apart(documents, found)
    text = F.col("text")
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = documents.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hits", hits)
    rows = rows.withColumn("made", F.transform("hits", lambda m: pseudonym(m, key)))
    parts = F.split(text, ANY, -1)
    filled = F.zip_with(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.zip_with("hits", "made", lambda m, p: F.coalesce(p["value"], m)),
        lambda gap, value: F.concat(value, gap),
    )
    changed = F.exists("made", lambda p: p.isNotNull())
    new = F.when(changed, F.concat(F.element_at(parts, 1), F.array_join(filled, ""))).otherwise(text)
    kinds = F.transform(F.filter("made", lambda p: p.isNotNull()), lambda p: p["kind"])
    rows = rows.select("doc", new.alias("new"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))
    fields = {f.name: f.dataType for f in documents.schema.fields}
    made = {"text": F.col("new")}
    if "n_chars" in fields:
        made["n_chars"] = F.when(F.size("kinds") > 0, F.length("new")).otherwise(F.col("doc.n_chars"))
    out = [made.get(n, F.col("doc").getField(n)).cast(t).alias(n) for n, t in fields.items()]
    return rows.select(*out, *([F.col("kinds").alias(found)] if found else []))
