"""Format-preserving pseudonyms for personal data, keyed, by Feistel networks in SQL expressions.

What a pattern finds and a validity test confirms is replaced by another value of the same format: card numbers keep
their first digit, length, separators and Luhn check; IBANs their country and a right check number; dates their
order, separators and validity; phone numbers their country code and punctuation. Each of these is a keyed
permutation of its format, so equal values are equal afterwards in whichever document they stand, different values
stay different, and the holder of the key can invert it. Letters in addresses and secrets are replaced by keyed ones of
the same class, which keeps links too but is not a permutation.

Only built-in functions; rows stay where they are. A text without a digit or ``@`` costs one scan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import named, numbered, once

#: Length of the IBANs of each country, length of the national part of phone numbers by country code.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 "
    "SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()
PHONE_LENGTHS = {8: "45 47 65", 9: "27 31 33 34 41 48 61 351", 10: "1 7 30 44 52 90 91", 11: "86"}

#: Patterns (Java), in the order in which they are tried at a place. None repeats a group without a bound, which would take
#: stack for every repetition, and none is tried from every character of a long run.
EMAIL = (
    r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}(?![A-Za-z])"
)
SECRET = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.~-]{8,}[\"']?"
)
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4})(?![0-9/-])"


def _iban() -> str:
    """Two letters, a check number and as many characters as the country has; any number of them for other countries."""
    countries: dict[int, list[str]] = {}
    for item in IBAN_LENGTHS:
        countries.setdefault(int(item[2:]), []).append(item[:2])
    known = "|".join(item[:2] for item in IBAN_LENGTHS)
    exact = [rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[0-9A-Z]){{{length - 4}}}" for length, names in countries.items()]
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[0-9A-Z]{{4}}){{2,7}}(?:\x20?[0-9A-Z]{{1,3}})?"
    return rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*exact, other])})(?![0-9A-Za-z])"


def _phone() -> str:
    """Numbers of known length first, so that a number standing behind is not taken along; then any after a plus, then three groups."""
    exact = [rf"(?:{codes.replace(' ', '|')})(?:[\x20.()-]{{0,2}}[0-9]){{{length}}}(?![0-9])" for length, codes in PHONE_LENGTHS.items()]
    other = r"[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9])"
    return rf"\+(?:{'|'.join([*exact, other])})|(?<![0-9(])\(?[0-9]{{3}}\)?[\x20.-][0-9]{{3}}[.-][0-9]{{4}}(?![0-9])"


IBAN = _iban()
ADDRESS = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = _phone()
#: Where a card number may stand, whatever stands around it: groups of four, of four, six and four or five, no groups.
CARDS = (
    r"(?<![0-9])(?=([0-9]{4}([\x20-])[0-9]{4}\2[0-9]{4}\2[0-9]{4})(?![0-9]))",
    r"(?<![0-9])(?=([0-9]{4}([\x20-])[0-9]{4}\2[0-9]{4}\2[0-9]{4}\2[0-9]{1,3})(?![0-9]))",
    r"(?<![0-9])(?=([0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})(?![0-9]))",
    r"(?<![0-9])([0-9]{13,19})(?![0-9])",
)
KINDS = {"email": EMAIL, "secret": SECRET, "date": DATE, "iban": IBAN, "address": ADDRESS, "social": SOCIAL, "phone": PHONE, "card": CARD}
#: All kinds but cards, which are looked for by their check digit.
ANY = "|".join(f"(?:{pattern})" for kind, pattern in KINDS.items() if kind != "card")
MAYBE = r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)"

ROUNDS = 10
#: Dates are permuted among the days of 1900 to 2099: 17 x 4297 days.
FIRST_DAY, DAY_LEFT, DAY_RIGHT = "1900-01-01", 17, 4297


def number(text: Column) -> Column:
    return text.cast("bigint")


def drawn(key: Column | str, kind: str, *parts: Column) -> Column:
    """A keyed number of 60 bits."""
    digest = F.sha2(F.concat_ws("|", key if isinstance(key, Column) else F.lit(key), F.lit(kind), *[part.cast("string") for part in parts]), 256)
    return number(F.conv(F.substring(digest, 1, 15), 16, 10))


def feistel(key: Column | str, kind: str, context: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Permute pairs (l, r) with 0 <= l < left_size and 0 <= r < right_size; sizes up to 10^18. A struct of l and r.

    In each round one half is moved by a keyed function of the other, modulo its own size, and the halves change
    places. ``context`` separates formats of one kind.
    """
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"), left_size.cast("bigint").alias("m"), right_size.cast("bigint").alias("n"))

    def step(s: Column, turn: Column) -> Column:
        moved = F.pmod(s["l"] + F.pmod(drawn(key, kind, context, turn, s["r"]), s["m"]), s["m"])
        return F.struct(s["r"].alias("l"), moved.alias("r"), s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(F.array(*[F.lit(turn) for turn in range(ROUNDS)]), start, step)


def ten_to(count: Column) -> Column:
    return F.rpad(F.lit("1"), count + 1, "0").cast("bigint")


def digits_permuted(key: Column | str, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits permuted among all strings of its length; a single digit is permuted in its ten."""
    half = (F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    left = F.coalesce(F.substr(digits, F.lit(1), half).try_cast("bigint"), F.lit(0).cast("bigint"))
    right = F.substr(digits, half + 1).try_cast("bigint")
    out = feistel(key, kind, F.length(digits), left, right, ten_to(half), ten_to(rest))
    return with_value(out, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0")))


def with_value(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once: an expression that is read in several places of a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(shape: Column, characters: Column, replaced: str = "[0-9]") -> Column:
    """``shape`` with its characters of a class replaced, in order, by those of another string."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(replaced)
        return F.struct(
            F.concat(s["out"], F.when(hit, F.substr(characters, s["next"], F.lit(1))).otherwise(c)).alias("out"),
            (s["next"] + hit.cast("int")).alias("next"),
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def scrambled(key: Column | str, kind: str, value: Column) -> Column:
    """Each letter and digit replaced by a keyed one of its class: the same value always becomes the same one."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def of(letters: str, draw: Column) -> Column:
        return F.substr(F.lit(letters), (F.pmod(draw, F.lit(len(letters))) + 1).cast("int"), F.lit(1))

    def written(s: Column) -> Column:
        def character(c: Column, place: Column) -> Column:
            draw = drawn(key, kind, s["mark"], place)
            return (
                F.when(c.rlike("[a-z]"), F.when(s["hexadecimal"], of(lower[:6], draw)).otherwise(of(lower, draw)))
                .when(c.rlike("[A-Z]"), of(upper, draw))
                .when(c.rlike("[0-9]"), of(digit, draw))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(s["value"], ""), character), "")

    # A value of hexadecimal digits only stays one. What holds for the whole value is found once, not for each character.
    whole = F.struct(value.alias("value"), value.rlike("^[0-9a-f]+$").alias("hexadecimal"), F.sha2(value.cast("binary"), 256).alias("mark"))
    return with_value(whole, written)


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of digits, every second one from the right doubled and its digits added up."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, place: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(F.pmod(place, F.lit(2)) == F.lit(1 if doubled_last else 0), doubled).otherwise(digit)

    return F.aggregate(places, F.lit(0), add)


def card(key: Column | str, found: Column) -> Column:
    """Null unless the Luhn check holds."""

    def replaced(digits: Column) -> Column:
        body = F.substr(digits, F.lit(2), F.length(digits) - 2)

        def checked(payload: Column) -> Column:
            check = F.pmod(F.lit(10) - F.pmod(luhn_sum(payload, True), F.lit(10)), F.lit(10))
            return F.concat(payload, check.cast("string"))

        new = with_value(F.concat(F.substr(digits, F.lit(1), F.lit(1)), digits_permuted(key, "card", body)), checked)
        return F.when(F.pmod(luhn_sum(digits, False), F.lit(10)) == 0, with_value(new, lambda n: refilled(found, n)))

    return with_value(only_digits(found), replaced)


def remainder_97(value: Column) -> Column:
    """A number in digits and capital letters (A = 10), modulo 97."""

    def add(total: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), F.pmod(total * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(total * 100 + letter, F.lit(97)))

    return F.aggregate(F.split(value, ""), F.lit(0), add)


def iban(key: Column | str, found: Column) -> Column:
    """Null unless the check number is right. Letters stay; the digits after the check number are permuted."""

    def replaced(plain: Column) -> Column:
        country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
        valid = remainder_97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1
        digits = only_digits(body)

        def checked(new: Column) -> Column:
            check = F.lit(98) - remainder_97(F.concat(new, country, F.lit("00")))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

        new = with_value(refilled(body, digits_permuted(key, "iban", digits)), checked)
        return F.when(valid & (F.length(digits) > 1), with_value(new, lambda n: refilled(found, n, "[0-9A-Z]")))

    return with_value(F.regexp_replace(found, "\\x20", ""), replaced)


def date(key: Column | str, found: Column) -> Column:
    """Null unless it is a day of 1900 to 2099. Two leading numbers are day and month, or month and day if only that is a date."""
    orders = [("^[0-9]{4}", "yyyy", 1, 6, 9), ("^[0-9]{2}[^0-9]", "dd", 7, 4, 1), ("^[0-9]{2}[^0-9]", "mm", 7, 1, 4)]

    def parsed(year: int, month: int, day: int) -> Column:
        iso = F.concat_ws("-", F.substr(found, F.lit(year), F.lit(4)), F.substr(found, F.lit(month), F.lit(2)), F.substr(found, F.lit(day), F.lit(2)))
        return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")

    def mover(name: str):
        # One order of the parts is one format, so each has a permutation of its own.
        shape = {"yyyy": "yyyyMMdd", "dd": "ddMMyyyy", "mm": "MMddyyyy"}[name]

        def moved(value: Column) -> Column:
            days = F.datediff(value, F.lit(FIRST_DAY).cast("date"))
            out = feistel(key, "date", F.lit(name), (days / DAY_RIGHT).cast("int"), F.pmod(days, F.lit(DAY_RIGHT)), F.lit(DAY_LEFT), F.lit(DAY_RIGHT))
            new = with_value(out, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAY_RIGHT + s["r"]).cast("int")))
            inside = (days >= 0) & (days < DAY_LEFT * DAY_RIGHT)
            return F.when(inside, with_value(F.date_format(new, shape), lambda digits: refilled(found, digits)))

        return moved

    result = F.lit(None).cast("string")
    for pattern, name, year, month, day in reversed(orders):
        value = parsed(year, month, day)
        result = F.when(found.rlike(pattern) & value.isNotNull(), with_value(value, mover(name))).otherwise(result)
    return result


def address(key: Column | str, found: Column) -> Column:
    """IPv4: null unless every part is at most 255. The 2^32 addresses are permuted."""

    def replaced(parts: Column) -> Column:
        part = [F.element_at(parts, place).cast("int") for place in range(1, 5)]
        valid = (part[0] <= 255) & (part[1] <= 255) & (part[2] <= 255) & (part[3] <= 255)
        size = F.lit(1 << 16)
        out = feistel(key, "address", F.lit(4), part[0] * 256 + part[1], part[2] * 256 + part[3], size, size)
        halves = lambda s, half: [(s[half] / 256).cast("int").cast("string"), F.pmod(s[half], F.lit(256)).cast("string")]
        return F.when(valid, with_value(out, lambda s: F.concat_ws(".", *halves(s, "l"), *halves(s, "r"))))

    return with_value(F.split(found, "[.]"), replaced)


def social(key: Column | str, found: Column) -> Column:
    """Social security numbers: null unless area, group and serial are among those given out; permuted among these."""
    area, group, serial = (F.substr(found, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area < 900) & (area != 666) & (group >= 1) & (serial >= 1)
    place = area - 1 - (area > 666).cast("int")
    out = feistel(key, "social", F.lit(9), place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))

    def written(s: Column) -> Column:
        new_area = s["l"] + 1 + (s["l"] >= 665).cast("int")
        parts = [(new_area, 3), ((s["r"] / 9999).cast("int") + 1, 2), (F.pmod(s["r"], F.lit(9999)) + 1, 4)]
        return F.concat_ws("-", *[F.lpad(part.cast("string"), width, "0") for part, width in parts])

    return F.when(valid, with_value(out, written))


def phone(key: Column | str, found: Column) -> Column:
    """Null unless it has 7 to 15 digits. A country code after ``+`` stays; the other digits are permuted."""
    prefix = F.regexp_extract(found, r"^\+[0-9]{1,3}(?=[^0-9])", 0)

    def replaced(lead: Column) -> Column:
        national = F.substr(found, F.length(lead) + 1)
        new = with_value(only_digits(national), lambda digits: digits_permuted(key, "phone", digits))
        valid = F.length(only_digits(found)).between(7, 15) & (F.length(only_digits(national)) > 1)
        return F.when(valid, F.concat(lead, with_value(new, lambda digits: refilled(national, digits))))

    return with_value(prefix, replaced)


def email(key: Column | str, found: Column) -> Column:
    """Local part and host are replaced, each on its own; the top-level domain stays."""
    local, host = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    ending = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    name = F.substr(host, F.lit(1), F.length(host) - F.length(ending))
    return F.concat(scrambled(key, "local", local), F.lit("@"), scrambled(key, "host", name), ending)


def secret(key: Column | str, found: Column) -> Column:
    """The value after the name of a secret is replaced; the name and the first four letters of an access key stay."""
    lead = F.regexp_extract(found, r"^(?:AKIA|ASIA|[A-Za-z_-]+\x20?[=:]\x20?[\"']?)", 0)
    value = F.regexp_extract(F.substr(found, F.length(lead) + 1), "^[^\"']*", 0)
    tail = F.substr(found, F.length(lead) + F.length(value) + 1)
    return F.concat(lead, with_value(value, lambda v: scrambled(key, "secret", v)), tail)


MAKERS = {"email": email, "secret": secret, "date": date, "iban": iban, "address": address, "social": social, "phone": phone, "card": card}


def _valid(candidates: Column) -> Column:
    """Distinct candidates whose check digit is right, longest first. Nothing but zeros is no number of anybody."""
    right = F.filter(F.array_distinct(candidates), lambda c: with_value(only_digits(c), lambda d: (F.pmod(luhn_sum(d, False), F.lit(10)) == 0) & ~d.rlike("^0+$")))
    return F.array_sort(right, lambda a, b: F.length(b) - F.length(a))


def _one_of(cards: Column) -> Column:
    """A pattern for any of some texts. Cards hold digits, spaces and hyphens only, so they stand in it as they are."""
    return F.concat(F.lit("(?<![0-9])(?:"), F.array_join(cards, "|"), F.lit(")(?![0-9])"))


def with_cards(df: DataFrame, content: Column) -> DataFrame:
    """Append ``_cards``: distinct card numbers as they stand, in the usual groups first, then those in any groups beside them."""
    none, long = F.array().cast("array<string>"), content.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    usual = F.concat(*[F.regexp_extract_all(content, F.lit(pattern), F.lit(1)) for pattern in CARDS])
    df = once(df, _usual=F.when(long, _valid(usual)).otherwise(none))
    rest = F.when(F.size("_usual") > 0, F.regexp_replace(content, _one_of(F.col("_usual")), F.lit("x"))).otherwise(content)
    other = F.when(long, _valid(F.regexp_extract_all(rest, F.lit(CARD), F.lit(0)))).otherwise(none)
    return once(df, _cards=F.concat("_usual", other)).drop("_usual")


def _key(df: DataFrame, key: str) -> Column:
    """The key as a value that no plan shows."""
    one = df.sparkSession.createDataFrame(pa.table({"key": [key]}))
    return one.scalar()


def pseudonymise(df: DataFrame, key: str, text: str = "text", into: str = "found") -> DataFrame:
    """Replace personal data in ``text`` by pseudonyms under ``key``, and append ``into``: what was replaced.

    ``into`` is an array of structs (kind, value): the kind and the *new* value of each replacement, in order. Values
    that fail their validity test stay as they are and are not listed. Null texts stay null, empty ones empty, both
    with nothing found. A column already named ``into`` is replaced; all others, and all rows, stay as they are.

    Card numbers are found whatever digits stand beside them: of the usual groupings, and of runs of 13 to 19 digits, each
    that passes the check is taken, the longest of those that begin together. The key is kept out of plans and logs.
    """
    original = [name for name in df.columns if name != into]
    content = F.col("_text")
    df = df.select(*numbered(original), F.col(f"`{text}`").alias("_text"), _key(df, key).alias("_key"))
    none = F.array().cast("array<string>")
    df = with_cards(df, content)
    df = once(df, _pattern=F.when(F.size("_cards") > 0, F.concat(F.lit(f"{ANY}|"), _one_of(F.col("_cards")))).otherwise(F.lit(ANY)))
    df = once(df, _found=F.when(content.rlike(MAYBE), F.regexp_extract_all(content, F.col("_pattern"), F.lit(0))).otherwise(none))

    def made(found: Column) -> Column:
        none = F.struct(F.lit(None).cast("string").alias("kind"), found.alias("value"))
        result = none
        for kind in reversed(MAKERS):
            new = F.struct(F.lit(kind).alias("kind"), MAKERS[kind](F.col("_key"), found).alias("value"))
            made = with_value(new, lambda s: F.when(s["value"].isNull(), none).otherwise(s))
            result = F.when(found.rlike(f"^(?:{KINDS[kind]})$"), made).otherwise(result)
        return result

    df = once(df, _new=F.transform("_found", made))
    pieces = F.zip_with(F.split(content, F.col("_pattern"), -1), F.col("_new"), lambda piece, new: F.concat(piece, F.coalesce(new["value"], F.lit(""))))
    changed = F.when(F.exists("_new", lambda new: new["kind"].isNotNull()), F.array_join(pieces, "")).otherwise(content)
    return df.select(*named(original, **{text: changed}), F.filter("_new", lambda new: new["kind"].isNotNull()).alias(into))
