"""PII: format-preserving Feistel pseudonyms, in Spark expressions only.

One pattern cuts a text into matches and the gaps between them. A match that validates (check
digit, octets, calendar, number plan) is permuted inside the set of valid values of its kind by a
keyed Feistel network; separators and layout stay. Equal values get equal pseudonyms in every
document, different values different ones, and no table of values is kept. Mail names and
secrets, which are no numbers, are replaced by keyed digests of the same length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
# The key of the pseudonyms comes from this setting of the session. The default is public: it links equal
# values but keeps no secret, and serves tests and the check of the registered query.
KEY_SETTING, KEY = "spark.touchline.pseudonym.key", "touchline"

_MAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"
_SECRET = r"(?i:\b(?:password|passwd|pwd|token|secret|api[_\-]?key)\b\s{0,4}[=:]\s{0,4}[\"']?)[A-Za-z0-9_+/\-]{8,}+"
_ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_DATE = r"(?<![\d\-/.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./\-]\d{2}[./\-]\d{4})(?!\d|[\-/.]\d)"
_ABROAD = r"(?<![\d+])\+(?!1\D)\d{1,3}(?:[ .\-]?\(?\d{2,5}\)?){2,4}(?!\d)"
_PHONE = r"(?<![\d\-])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])"
_CARD = r"(?<!\d)(?:\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?!\d)"
# The first kind that matches at a place takes it.
KINDS = {
    "mail": _MAIL, "secret": _SECRET, "address": _ADDRESS, "ssn": _SSN, "date": _DATE,
    "abroad": _ABROAD, "phone": _PHONE, "card": _CARD,
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())

# Days from 1900-01-01 to 2099-12-31, as the product that the network works on.
_DATE_SIDES = (17, 4297)


def _number(digits: Column) -> Column:
    return digits.cast("bigint")


def _round(key: str, kind: str, step: Column, half: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), size)


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str, back: bool = False) -> Column:
    """Struct(l, r): a keyed permutation of the pairs below (left_size, right_size); ``back`` undoes it."""
    steps = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    sign = -1 if back else 1

    def turn(state: Column, step: Column) -> Column:
        even = step % 2 == 0
        moved_left = F.pmod(state["l"] + sign * _round(key, kind, step, state["r"], left_size), left_size)
        moved_right = F.pmod(state["r"] + sign * _round(key, kind, step, state["l"], right_size), right_size)
        return F.struct(
            F.when(even, moved_left).otherwise(state["l"]).cast("bigint").alias("l"),
            F.when(even, state["r"]).otherwise(moved_right).cast("bigint").alias("r"),
        )

    return F.aggregate(steps, F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _permuted_digits(digits: Column, key: str, kind: str, back: bool) -> Column:
    """A permutation of the digit strings of one length (up to 36)."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    rest = (n - half).cast("int")
    size = [F.pow(F.lit(10.0), w).cast("bigint") for w in (half, rest)]
    pair = feistel(
        _number(F.substr(digits, F.lit(1), half)), _number(F.substr(digits, half + 1, rest)), *size, f"{key}|{kind}", "digits", back
    )
    return F.concat(_padded(pair["l"], half), _padded(pair["r"], rest))


def _laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""

    def at(char: Column, index: Column) -> Column:
        place = F.length(_digits(F.substr(value, F.lit(1), (index + 1).cast("int"))))
        return F.when(char.rlike(r"^\d$"), F.substr(digits, place, F.lit(1))).otherwise(char)

    return F.array_join(F.transform(F.split(value, ""), at), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum with every second digit from the right doubled, the last one single."""

    def share(char: Column, index: Column) -> Column:
        twice = char.cast("int") * 2
        return F.when(index % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(char.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), share), F.lit(0), lambda total, x: total + x)


def _card(value: Column, key: str, back: bool) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    body = _permuted_digits(F.substr(digits, F.lit(1), n - 1), key, "card", back)
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, _laid_out(value, F.concat(body, check.cast("string"))))


def _address(value: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("bigint"))
    side = F.lit(65536)
    pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], side, side, key, "address", back)
    parts = [x for c in ("l", "r") for x in (F.floor(pair[c] / 256), pair[c] % 256)]
    return F.when(F.forall(octets, lambda o: o <= 255), F.concat_ws(".", *(x.cast("string") for x in parts)))


def _ssn(value: Column, key: str, back: bool) -> Column:
    area, group, serial = (_number(F.substring(value, at, n)) for at, n in ((1, 3), (5, 2), (8, 4)))
    # Areas 001-899 without 666, groups 01-99, serials 0001-9999.
    rank = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    pair = feistel(rank, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", back)
    new_area = F.floor(pair["l"] / 99) + 1
    new_area = F.when(new_area >= 666, new_area + 1).otherwise(new_area)
    text = F.concat_ws("-", _padded(new_area, 3), _padded(pair["l"] % 99 + 1, 2), _padded(pair["r"] + 1, 4))
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), text)


def _date(value: Column, key: str, back: bool) -> Column:
    """Dates of 1900 to 2099. Without a leading year the day comes first, unless only the month can."""
    year_first = value.rlike(r"^\d{4}")
    numbers = F.split(value, r"\D")
    year = F.when(year_first, numbers[0]).otherwise(numbers[2])
    middle, last = numbers[1], F.when(year_first, numbers[2]).otherwise(numbers[0])

    def day(month: Column, day_of_month: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws("-", year, month, day_of_month), F.lit("yyyy-MM-dd")).cast("date")

    day_first = day(middle, last)
    month_first = F.when(~year_first, day(last, middle))
    days = F.datediff(F.coalesce(day_first, month_first), F.lit("1900-01-01").cast("date"))
    left, right = _DATE_SIDES
    pair = feistel(F.floor(days / right), F.pmod(days, F.lit(right)), F.lit(left), F.lit(right), key, "date", back)
    moved = F.date_add(F.lit("1900-01-01").cast("date"), (pair["l"] * right + pair["r"]).cast("int"))
    layout = (
        F.when(year_first, F.date_format(moved, "yyyyMMdd"))
        .when(day_first.isNotNull(), F.date_format(moved, "ddMMyyyy"))
        .otherwise(F.date_format(moved, "MMddyyyy"))
    )
    return F.when(days.between(0, left * right - 1), _laid_out(value, layout))


def _phone(value: Column, key: str, back: bool) -> Column:
    digits = _digits(value)
    lead = F.length(digits) - 10
    area, rest = _number(F.substr(digits, lead + 1, F.lit(3))), _number(F.substr(digits, lead + 4, F.lit(7)))
    # North American plan: area and exchange start with 2 to 9.
    pair = feistel(area - 200, rest - 2_000_000, F.lit(800), F.lit(8_000_000), key, "phone", back)
    new = F.concat(F.substr(digits, F.lit(1), lead), _padded(pair["l"] + 200, 3), _padded(pair["r"] + 2_000_000, 7))
    return F.when((area >= 200) & (rest >= 2_000_000), _laid_out(value, new))


def _abroad(value: Column, key: str, back: bool) -> Column:
    lead = F.length(F.regexp_extract(value, r"^\+(\d{1,3})", 1))
    digits = _digits(value)
    n = F.length(digits)
    new = F.concat(F.substr(digits, F.lit(1), lead), _permuted_digits(F.substr(digits, lead + 1, n - lead), key, "abroad", back))
    return F.when(n - lead >= 6, _laid_out(value, new))


def _keyed_letters(value: Column, key: str, kind: str) -> Column:
    """Letters of a keyed digest, as many as ``value`` has characters."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 512)
    letters = F.translate(F.repeat(digest, F.ceil(F.length(value) / 128).cast("int")), "0123456789abcdef", "ghijklmnopqrstuv")
    return F.substr(letters, F.lit(1), F.length(value))


def _mail(value: Column, key: str) -> Column:
    return F.concat(_keyed_letters(F.substring_index(value, "@", 1), key, "mail"), F.lit("@"), F.substring_index(value, "@", -1))


def _secret(value: Column, key: str) -> Column:
    lead = F.regexp_extract(value, r"^(.*?[=:]\s*[\"']?)[A-Za-z0-9_+/\-]+$", 1)
    return F.concat(lead, _keyed_letters(F.substr(value, F.length(lead) + 1, F.length(value)), key, "secret"))


_PERMUTED = {"address": _address, "ssn": _ssn, "date": _date, "abroad": _abroad, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str = KEY, back: bool = False) -> Column:
    """The pseudonym of one match; a value that does not validate stays. ``back`` undoes the numbers and dates."""
    out = F.when(F.lit(False), value)
    for kind, pattern in KINDS.items():
        whole = value.rlike(f"^(?:{pattern})$")
        if kind in _PERMUTED:
            new = F.coalesce(_PERMUTED[kind](value, key, back), value)
        elif back:
            new = value
        else:
            new = (_mail if kind == "mail" else _secret)(value, key)
        out = out.when(whole, new)
    return out.otherwise(value)


def masked(text: Column, key: str = KEY, back: bool = False) -> Column:
    """The text with every validated value replaced; null stays null, other text is unchanged."""
    gaps = F.split(text, PATTERN, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key, back))
    whole = F.array_join(F.zip_with(gaps, matches, lambda gap, match: F.concat(gap, F.coalesce(match, F.lit("")))), "")
    return F.when(text.rlike(PATTERN), whole).otherwise(text)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with personal values in ``text_col`` replaced by pseudonyms; rows and other columns stay as they are.

    ``key`` defaults to the setting ``spark.touchline.pseudonym.key``. A null text stays null, an empty
    one empty; texts, and mail names and secrets in them, are replaced whole, however long. Rows that
    repeat an id, or a text, are treated alike. An empty table comes back empty.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    return docs.withColumn(text_col, masked(F.col(text_col), key))
