"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern, validated where their kind has a rule, and permuted within their own
format by a keyed Feistel network: digits stay digits, separators, lengths and check rules stay.
A permutation depends on key, kind and length alone, so equal values get equal pseudonyms in every
document and different values stay different; `restored` inverts it with the same key.

Kinds: card (13 to 19 digits, also in groups of 4-4-4-4 or 4-6-5, that pass the Luhn test and keep passing it, by permuting all but
the check digit and computing that anew), iban (of 15 to 34 signs, also in groups of four, whose check digits are right: the account's digits and letters are
permuted within their alphabets and the check digits computed anew), ssn (AAA-GG-SSSS, permuted among the numbers that can be issued), phone (with + and 8 to 15 digits, also
grouped by blanks, dots, dashes or one pair of brackets; without +, AAA BBB CCCC with such separators or (AAA), a 1 in front or
not, and numbers with a trunk 0: 0AA BBBBBB, 0A/BBBBB, (0AA) BBBBBB, 0A AA AA AA AA; country code, leading 1 and trunk 0 stay, the
other digits are permuted; ten bare digits aren't taken for a phone), ip (four octets from 0 to 255: permuted as one 32-bit number), ip6 (eight groups or with one ::, in small or capital
letters; digits and letters within their alphabets), token (keys that begin with sk-, AKIA, ghp_ and the like or xoxb- and the like: what follows),
date (real days from 1900 to 2099 with a year of four digits: YYYY-MM-DD, and with one of . / - and one or two digits
each D.M.YYYY, M/D/YYYY, YYYY/M/D: permuted among the days that can be written with as many digits; M/D/YYYY is read with
slashes and D.M.YYYY otherwise, the other order where only that is a day), secret (32 to 64 hex
digits: permuted as hex digits) and email (the letters and digits of the local part, as two
alphabets in one sequence; the domain stays).

Rounds are SHA-256 of key, tweak, round and the other half; whoever has the key can invert pseudonyms, so there is no
key by default. Numbers with an impossible octet, date or check digit aren't values of that kind and stay as they are. A text without values is passed on unread
by the later steps; work follows the number of values, not the length of a group.

Defined cases: null text stays null with no values, empty text stays empty; any length of text;
equal rows are treated alike; extra columns ride along and columns with the result's names are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import OWN

# Fixed patterns, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_GROUPED = r"\+\d{1,3}[ .-]?\(\d{1,5}\)(?:[ .-]?\d){5,10}(?!\d)|\+\d(?:[ .-]?\d){7,14}(?!\d)"
#: The numbers without +, by where their digits stand: three, three and four; those behind a trunk 0.
_NATIONAL = r"(?<![\d.+-])(?<!\d )(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![ .-]?\d)"
_TRUNK = r"(?<![\d.+-])(?<!\d )(?:0\d(?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4})|\(0\d{1,4}\) ?\d{5,8}|0\d{1,4}[ /-]\d{5,8})(?![ .-]?\d)"
PHONE = r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}(?!\d)|" + _GROUPED
LOCAL_PHONE = f"{_NATIONAL}|{_TRUNK}"
#: What stays: country codes as far as they go, a leading 1, a trunk 0. Each is decided by what stays itself.
_PREFIX = r"^\+\d{1,3}(?=\D)|^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
DATE = r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])"
_YEAR, _ENDS = "(?:19|20)\\d\\d", r"(?!\d|[./-]\d)"
OTHER_DATE = r"(?<![\d./-])(?:" + "|".join(rf"\d{{1,2}}{c}\d{{1,2}}{c}{_YEAR}|{_YEAR}{c}\d{{1,2}}{c}\d{{1,2}}" for c in (r"\.", "/", "-")) + ")" + _ENDS
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
CARD = r"(?<![\d.])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])"
_TOKEN_PREFIX = "sk-|AKIA|gh[pousr]_|xox[abprs]-"
TOKEN = r"(?<![A-Za-z0-9])(?:sk-[A-Za-z0-9_-]{16,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])"
IP6 = "(?<![0-9A-Za-z:.])(?:" + "|".join(rf"(?:{h}:){{7}}{h}|(?:{h}:){{1,6}}(?::{h}){{1,6}}|(?:{h}:){{1,7}}:|:(?::{h}){{1,7}}" for h in ("[0-9a-f]{1,4}", "[0-9A-F]{1,4}")) + ")(?![0-9A-Za-z:]|\\.\\d)"
#: All of them; what begins with a digit is tried at digits only.
_AT_DIGITS = "|".join((IP, SSN, DATE, OTHER_DATE))
ANY = rf"{EMAIL}|{TOKEN}|{IBAN}|(?=\+)(?:{PHONE})|(?=[0-9A-Fa-f:])(?:{IP6})|(?=\d)(?:{_AT_DIGITS})|{SECRET}|(?=\d)(?:{CARD})|(?=[\d(])(?:{LOCAL_PHONE})"
#: A text without any of these has no value.
HINT = f"[0-9@]|::|{_TOKEN_PREFIX}"

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31


def _round(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """60 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half), 256), 1, 15), 16, 10).cast("long")


def _network(left: Column, right: Column, step, undo: bool) -> Column:
    """ROUNDS rounds over (a, b): step(i, changed, other, sign) gives the changed half."""
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if not undo else F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))

    def one(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, step(i, s["a"], s["b"])).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(step(i, s["b"], s["a"]))
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(rounds, F.struct(left.alias("a"), right.alias("b")), one, lambda s: s)


def _digits(value: Column, kind: str, key: str, undo: bool) -> Column:
    """A string of 2 to 36 decimal digits to another of the same length."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    tweak = F.concat(F.lit(kind + ":"), n.cast("string"))

    def step(i: Column, x: Column, other: Column) -> Column:
        size = F.pow(F.lit(10.0), F.length(x)).cast("long")
        f = F.pmod(_round(key, tweak, i, other), size)
        y = F.pmod(x.cast("long") - f if undo else x.cast("long") + f, size)
        return F.lpad(y.cast("string"), F.length(x), F.lit("0"))

    out = _network(F.substring(value, F.lit(1), half), F.substring(value, half + 1, n - half), step, undo)
    return F.when(n >= 2, F.concat(out["a"], out["b"])).otherwise(value)


def _alphabet(value: Column, kind: str, key: str, undo: bool, letters: int = 26) -> Column:
    """Each letter (of the first so many) or digit of a string moves within its own alphabet, by a network over two halves of the string."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    # What has the value's shape is permuted alike: digits as 0, letters as a or A.
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\d", "0"), "[a-z]", "a"), "[A-Z]", "A")
    tweak = F.concat(F.lit(kind + ":"), shape)

    def moved(c: Column, f: Column) -> Column:
        code = F.ascii(c)
        turn = lambda low, size: F.char(F.pmod(code - low + (-f if undo else f), F.lit(size)) + low)
        return F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 122), turn(97, letters)).when(code.between(65, 90), turn(65, letters)).otherwise(c)

    def step(i: Column, x: Column, other: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), other), 256)
        chars = F.filter(F.split(x, ""), lambda c: c != "")
        # Four hex digits of the digest for each place; 16 places, then they repeat with the place added.
        f = lambda j: F.conv(F.substring(seed, F.pmod(j, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int") + j
        return F.concat_ws("", F.transform(chars, lambda c, j: moved(c, f(j))))

    out = _network(F.substring(value, F.lit(1), half), F.substring(value, half + 1, n - half), step, undo)
    return F.concat(out["a"], out["b"])


def _hex(value: Column, kind: str, key: str, undo: bool) -> Column:
    """Hex digits as numbers of 8 digits at most per half-word: each eighth is moved by the rest's digest."""
    n = F.length(value)
    upper = value.rlike("[A-F]")
    low = F.lower(value)
    half = F.floor(n / 2).cast("int")
    tweak = F.concat(F.lit(kind + ":"), n.cast("string"))

    def step(i: Column, x: Column, other: Column) -> Column:
        words = F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 8).cast("int"))

        def word(j: Column) -> Column:
            w = F.substring(x, j * 8 + 1, F.lit(8))
            size = F.pow(F.lit(16.0), F.length(w)).cast("long")
            f = F.pmod(_round(key, tweak, i * 100 + j, other), size)
            number = F.conv(w, 16, 10).cast("long")
            return F.lpad(F.lower(F.hex(F.pmod(number - f if undo else number + f, size))), F.length(w), F.lit("0"))

        return F.concat_ws("", F.transform(words, word))

    out = _network(F.substring(low, F.lit(1), half), F.substring(low, half + 1, n - half), step, undo)
    joined = F.concat(out["a"], out["b"])
    return F.when(upper, F.upper(joined)).otherwise(joined)


def _range(number: Column, size: int, kind: str, key: str, undo: bool, allowed=lambda x: F.lit(True), steps: int = 64) -> Column:
    """0 <= number < size to another such number: a network over two bytes or words, walked until it is in the range and allowed."""
    width = 1 << ((size - 1).bit_length() + 1) // 2  # each half

    def once(x: Column) -> Column:
        def step(i: Column, h: Column, other: Column) -> Column:
            f = F.pmod(_round(key, F.lit(f"{kind}:{size}"), i, other.cast("string")), F.lit(width))
            return F.pmod(h - f if undo else h + f, F.lit(width))

        out = _network(F.floor(x / width).cast("long"), F.pmod(x, F.lit(width)).cast("long"), step, undo)
        return out["a"] * width + out["b"]

    if width * width == size:
        return once(number.cast("long"))
    # Cycle walking: each step leaves the range with chance 1 - size / width**2, under 3 in 4; 64 steps always do, and if they didn't the value stays.
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(number.cast("long").alias("x"), F.lit(False).alias("done")),
        lambda s, _: F.when(s["done"], s).otherwise(_checked(once(s["x"]), size, allowed)),
        lambda s: F.when(s["done"], s["x"]).otherwise(number.cast("long")),
    )
    return walked


def _checked(x: Column, size: int, allowed) -> Column:
    return F.transform(F.array(x), lambda v: F.struct(v.alias("x"), ((v < size) & allowed(v)).alias("done")))[0]


def _luhn_sum(digits: Column, check: bool) -> Column:
    """The Luhn sum of a digit string; check: its last digit is the check digit."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def weighed(c: Column, j: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(j % 2 == (1 if check else 0), doubled).otherwise(d)

    return F.aggregate(F.transform(chars, weighed), F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str, undo: bool) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    moved = _digits(body, "card", key, undo)
    checked = F.concat(moved, F.pmod(-_luhn_sum(moved, False), F.lit(10)).cast("string"))
    return _refilled(value, checked)


def _is_card(value: Column) -> Column:
    return _luhn_sum(F.regexp_replace(value, "[ -]", ""), True) % 10 == 0


def _mod97(signs: Column) -> Column:
    """The rest by 97 of a string read as a number, letters as 10 to 35."""
    chars = F.filter(F.split(signs, ""), lambda c: c != "")

    def add(r: Column, c: Column) -> Column:
        return F.when(c.rlike(r"\d"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), add)


def _is_iban(value: Column) -> Column:
    flat = F.regexp_replace(value, " ", "")
    check = F.substring(flat, 3, 2).cast("int")
    rest = F.substring(flat, F.lit(5), F.length(flat))
    return F.length(flat).between(15, 34) & check.between(2, 98) & (_mod97(F.concat(rest, F.substring(flat, 1, 4))) == 1)


def _iban(value: Column, key: str, undo: bool) -> Column:
    flat = F.regexp_replace(value, " ", "")
    country = F.substring(flat, 1, 2)
    moved = _alphabet(F.substring(flat, F.lit(5), F.length(flat)), "iban", key, undo)
    check = 98 - _mod97(F.concat(moved, country, F.lit("00")))
    signs = F.concat(country, F.lpad(check.cast("string"), 2, "0"), moved)
    return F.when(F.contains(value, F.lit(" ")), F.rtrim(F.regexp_replace(signs, "(.{4})", "$1 "))).otherwise(signs)


def _ssn(value: Column, key: str, undo: bool) -> Column:
    def allowed(x: Column) -> Column:
        area = F.floor(x / 1_000_000)
        return area.between(1, 899) & (area != 666) & (F.floor(x / 10_000) % 100 != 0) & (x % 10_000 != 0)

    number = F.regexp_replace(value, "-", "").cast("long")
    return _refilled(value, F.lpad(_range(number, 10**9, "ssn", key, undo, allowed).cast("string"), 9, "0"))


def _token(value: Column, key: str, undo: bool) -> Column:
    prefix = F.regexp_extract(value, f"^(?:{_TOKEN_PREFIX})", 0)
    return F.concat(prefix, _alphabet(F.substring(value, F.length(prefix) + 1, F.length(value)), "token", key, undo))


def _refilled(value: Column, digits: Column) -> Column:
    """value with its digits, in order, replaced by those of digits."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike(r"\d")
        n = s["n"] + F.when(digit, 1).otherwise(0)
        return F.struct(n.alias("n"), F.concat(s["out"], F.when(digit, F.substring(digits, n, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), put, lambda s: s["out"])


def _phone(value: Column, key: str, undo: bool) -> Column:
    trunk = F.when(value.rlike(f"^(?:{_TRUNK})$"), F.regexp_extract(value, r"^\(?0", 0)).otherwise(F.regexp_extract(value, r"^1[ .-]", 0))
    prefix = F.when(F.startswith(value, F.lit("+")), F.regexp_extract(value, _PREFIX, 0)).otherwise(trunk)
    rest = F.substring(value, F.length(prefix) + 1, F.length(value))
    return F.concat(prefix, _refilled(rest, _digits(F.regexp_replace(rest, r"\D", ""), "phone", key, undo)))


def _ip(value: Column, key: str, undo: bool) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    moved = F.transform(F.array(_range(number, 1 << 32, "ip", key, undo)), lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
    return moved[0]


def _date(value: Column, key: str, undo: bool) -> Column:
    day = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), _range(day, DAYS, "date", key, undo).cast("int"))
    return F.coalesce(F.date_format(moved, "yyyy-MM-dd"), value)


def _fields(value: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Of a date in another layout: its day, year first or not, month first or not, and month and day as written."""
    part = F.split(value, "[./-]")
    year_first = F.length(part[0]) == 4
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    by_month, by_day = made(part[2], part[0], part[1]), made(part[2], part[1], part[0])
    slashed = F.contains(value, F.lit("/"))
    month_first = F.when(slashed, by_month.isNotNull()).otherwise(by_day.isNull())
    day = F.when(year_first, made(part[0], part[1], part[2])).when(month_first, by_month).otherwise(by_day)
    month = F.when(year_first, part[1]).when(month_first, part[0]).otherwise(part[1])
    return day, year_first, month_first, month, F.when(year_first, part[2]).when(month_first, part[1]).otherwise(part[0])


def _once(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def _other_date(value: Column, key: str, undo: bool) -> Column:
    """Days are permuted as in _date, walked on until one can be written, and is read again, in the same way."""
    names = ("day", "year_first", "month_first", "month", "of_month")
    fields = F.struct(*[c.alias(n) for c, n in zip(_fields(value), names, strict=True)], F.regexp_extract(value, "[./-]", 0).alias("sep"))

    def of(f: Column) -> Column:
        month, of_month, sep = f["month"], f["of_month"], f["sep"]
        short_month, short_day = F.length(month) == 1, F.length(of_month) == 1
        # The order that is not the layout's own is only for days that its own order can't mean.
        turned = ~f["year_first"] & (f["month_first"] != (sep == "/"))

        def allowed(x: Column) -> Column:
            d = F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))
            return (~short_month | (F.month(d) <= 9)) & (~short_day | (F.dayofmonth(d) <= 9)) & (~turned | (F.dayofmonth(d) > 12))

        def written(d: Column) -> Column:
            y, m, dd = F.date_format(d, "yyyy"), F.lpad(F.month(d).cast("string"), F.length(month), F.lit("0")), F.lpad(F.dayofmonth(d).cast("string"), F.length(of_month), F.lit("0"))
            return F.when(f["year_first"], F.concat_ws("", y, sep, m, sep, dd)).when(f["month_first"], F.concat_ws("", m, sep, dd, sep, y)).otherwise(F.concat_ws("", dd, sep, m, sep, y))

        number = F.datediff(f["day"], F.lit(FIRST_DAY).cast("date"))
        # About 1 in 16 numbers is allowed where the fewest are.
        moved = F.date_add(F.lit(FIRST_DAY).cast("date"), _range(number, DAYS, "date", key, undo, allowed, 800).cast("int"))
        return _once(moved, written)

    return F.coalesce(_once(fields, of), value)


def _email(value: Column, key: str, undo: bool) -> Column:
    local = F.regexp_extract(value, "^[^@]*", 0)
    return F.concat(_alphabet(local, "email", key, undo), F.substring(value, F.length(local) + 1, F.length(value)))


def kind_of(value: Column) -> Column:
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(whole(TOKEN), "token")
        .when(whole(IBAN), F.when(_is_iban(value), "iban"))
        .when(F.startswith(value, F.lit("+")), "phone")
        .when(whole(IP6), "ip6")
        .when(whole(IP), "ip")
        .when(whole(SSN), "ssn")
        .when(whole(DATE), F.when(F.try_to_date(value, "yyyy-MM-dd").isNotNull(), "date"))
        .when(whole(OTHER_DATE), F.when(_fields(value)[0].isNotNull(), "other date"))
        .when(whole(CARD), F.when(_is_card(value), "card"))
        .when(whole(SECRET), "secret")
        .when(whole(LOCAL_PHONE), "phone")
    )


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """A value of any kind to its pseudonym; what is no valid value stays."""
    return _once(F.struct(value.alias("value"), kind_of(value).alias("kind")), lambda s: _moved(s["value"], s["kind"], key, undo))


def _moved(value: Column, kind: Column, key: str, undo: bool) -> Column:
    return (
        F.when(kind == "email", _email(value, key, undo))
        .when(kind == "phone", _phone(value, key, undo))
        .when(kind == "token", _token(value, key, undo))
        .when(kind == "iban", _iban(value, key, undo))
        .when(kind == "ip6", _alphabet(value, "ip6", key, undo, 6))
        .when(kind == "ip", _ip(value, key, undo))
        .when(kind == "ssn", _ssn(value, key, undo))
        .when(kind == "date", _date(value, key, undo))
        .when(kind == "other date", _other_date(value, key, undo))
        .when(kind == "card", _card(value, key, undo))
        .when(kind == "secret", _hex(value, "secret", key, undo))
        .otherwise(value)
    )


def pseudonymised(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """docs with values in text replaced, and n_values, the number of valid values found."""
    found, out = f"{OWN}found", f"{OWN}out"
    names = [c for c in docs.columns if c.lower() not in ("text", "n_values")]
    values = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)))
    rows = docs.withColumn(found, F.coalesce(values, F.array().cast("array<string>")))
    some = F.size(found) > 0
    pieces = F.split(F.col("text"), ANY, -1)
    # The text between values, each value's pseudonym behind it; the last piece has none.
    woven = F.concat_ws("", F.zip_with(pieces, F.transform(found, lambda v: pseudonym(v, key, undo)), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))))
    n = F.size(F.filter(found, lambda v: kind_of(v).isNotNull()))
    changed = rows.withColumn(out, F.when(some, woven).otherwise(F.col("text")))
    return changed.select(*names, F.col(out).alias("text"), F.when(some, n).otherwise(0).alias("n_values"))


def restored(docs: DataFrame, key: str) -> DataFrame:
    """The inverse of pseudonymised, with the same key."""
    return pseudonymised(docs, key, undo=True)
