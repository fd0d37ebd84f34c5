"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions alone.

Card numbers (Luhn-valid), phone numbers, social security numbers, IPv4 addresses, calendar dates and the
local parts of e-mail addresses are found, validated and permuted under a key inside their own format: a
Feistel network over the digits (of an address also the letters) whose rounds are HMAC-SHA256, so equal values
get equal pseudonyms in every document, different values different ones, and the key's owner can undo it (but for
the case of an e-mail address). Marks between the digits stay and results are valid in their turn: a card's last
digit is recomputed; social security numbers have no area 000, 666 or 9xx, no group 00 and no serial 0000; area
codes of North American phone numbers start with 2 to 9, other numbers have 7 to 15 digits; dates move inside
a 400-year cycle, whose 146,097 days are 189 x 773; address bytes move inside 256.

Null stays null, empty stays empty; a candidate that isn't valid stays as it is. Rows return as often as
they stand, other columns unchanged, whatever their names; an empty table gives no rows. A text is held whole, in a few
copies; the time it takes is in proportion to its length, however long its tokens are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The text of a match tells its kind; the alternatives are tried in this order at each place.
DATE = r"(?<![0-9./-])(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])(?!\.[0-9])"
PLUS = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z@])"
PHONE = PLUS + r"|(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z@])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
#: From the first letter or digit of a run of its characters (or of what a match before has left of the run), with the marks
#: before that, which stay. A run is tried once, so a long token takes time in proportion; marks that are a phone's + aren't taken.
EMAIL = rf"(?:(?<![A-Za-z0-9._%+-])|\G)(?:[._%-]|(?!{PLUS})\+)*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
FOUND = "|".join(f"(?:{p})" for p in (EMAIL, DATE, SSN, IP, PHONE, CARD))

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
LETTERS = ALPHABET[10:]
#: Characters of an e-mail address's local part that move together.
LOCAL_PIECE = 512


def digest(key: str, tag: Column, turn: Column, half: Column) -> Column:
    """A round's number below 2^60: the head of the HMAC-SHA256 of tag, turn and half."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in secret)) for pad in (0x36, 0x5C))
    message = F.concat_ws("|", tag, turn.cast("string"), half.cast("string")).cast("binary")
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.conv(F.substring(mac, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, wide_a: Column, wide_b: Column, key: str, tag: Column, undo: bool = False) -> Column:
    """A permutation of the pairs (a, b), 0 <= a < wide_a, 0 <= b < wide_b: even rounds shift a by a keyed
    hash of b, odd rounds b by one of a. Any two sizes do, so no value leaves its domain."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        sign = F.lit(-1 if undo else 1)
        new_a = F.pmod(s["a"] + sign * F.pmod(digest(key, tag, i, s["b"]), wide_a), wide_a)
        new_b = F.pmod(s["b"] + sign * F.pmod(digest(key, tag, i, s["a"]), wide_b), wide_b)
        return F.when(i % 2 == 0, F.struct(new_a.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), new_b.alias("b")))

    order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    return F.aggregate(F.array(*(F.lit(i) for i in order)), start, turn)


def power(base: int, n: Column) -> Column:
    """base^n as an integer; n up to 12."""
    return F.element_at(F.array(*(F.lit(base**k) for k in range(13))), n + 1)


def permute(text: Column, base: int, key: str, tag: str | Column, undo: bool = False) -> Column:
    """A string of up to 24 digits of this base (lower case) to one of the same length."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    n = F.length(text)
    u = F.ceil(n / 2).cast("int")
    v = n - u
    left, right = F.substr(text, F.lit(1), u), F.substr(text, u + 1, v)
    number = lambda s: F.coalesce(F.conv(s, base, 10).cast("long"), F.lit(0))
    out = feistel(number(left), number(right), power(base, u), power(base, v), key, F.concat(tag, n.cast("string")), undo)
    digits = lambda x, m: F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), m, "0")
    both = lambda s: F.concat(digits(s["a"], u), F.when(v > 0, digits(s["b"], v)).otherwise(""))
    return F.element_at(F.transform(F.array(out), both), 1)


def refill(mask: Column, digits: Column) -> Column:
    """mask with its digits, in order, replaced by these."""
    at = F.array_compact(F.transform(F.split(mask, ""), lambda c: F.when(c != "", c)))
    state = F.struct(F.lit(1).alias("i"), F.lit("").alias("s"))
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct((s["i"] + 1).alias("i"), F.concat(s["s"], F.substr(digits, s["i"], F.lit(1))).alias("s"))).otherwise(F.struct(s["i"].alias("i"), F.concat(s["s"], c).alias("s")))
    return F.aggregate(at, state, step, lambda s: s["s"])


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn's sum; of the digits from the right, those at odd (1) or even (0) places, counted from 0, double."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == doubled_from_right, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def card(m: Column, key: str, undo: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permute(F.substr(digits, F.lit(1), F.length(digits) - 1), 10, key, "card", undo)
    fresh = F.element_at(F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string"))), 1)
    return F.when(luhn_sum(digits, 1) % 10 == 0, refill(m, fresh)).otherwise(m)


def number(digits: Column, start: int, size: int) -> Column:
    return F.substr(digits, F.lit(start), F.lit(size)).cast("long")


def padded(x: Column, size: int) -> Column:
    return F.lpad(x.cast("string"), size, "0")


def each(values: Column, show) -> Column:
    """show of one value, which is computed once."""
    return F.element_at(F.transform(F.array(values), show), 1)


def phone(m: Column, key: str, undo: bool) -> Column:
    """The country code of a number with + stays; without marks after it its first digit does."""
    head = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])[ .-]?|^\+[0-9]", 0)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    american = ((head == "") | head.rlike(r"^\+1[^0-9]*$")) & (F.length(digits) == 10)
    moved = each(digits, lambda d: feistel(number(d, 1, 6) - 200_000, number(d, 7, 4), F.lit(800_000), F.lit(10_000), key, F.lit("phone"), undo))
    fresh = each(moved, lambda s: F.concat(padded(s["a"] + 200_000, 6), padded(s["b"], 4)))
    valid = digits.rlike("^[2-9][0-9]{9}$")
    size = F.length(F.regexp_replace(m, "[^0-9]", ""))
    free = F.when(size.between(7, 15), permute(digits, 10, key, "phone", undo))
    return F.concat(head, refill(rest, F.when(american, F.when(valid, fresh).otherwise(digits)).otherwise(F.coalesce(free, digits))))


def social(m: Column, key: str, undo: bool) -> Column:
    """Area, group and serial in their valid ranges: 898 areas by 99 groups, and 9,999 serials."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    area = lambda d: number(d, 1, 3) - F.when(number(d, 1, 3) > 666, 2).otherwise(1)
    moved = each(digits, lambda d: feistel(area(d) * 99 + number(d, 4, 2) - 1, number(d, 6, 4) - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"), undo))
    back = lambda x: F.when(x >= 665, x + 2).otherwise(x + 1)
    shown = each(moved, lambda s: F.concat(padded(back(F.floor(s["a"] / 99)), 3), F.lit("-"), padded(s["a"] % 99 + 1, 2), F.lit("-"), padded(s["b"] + 1, 4)))
    return F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), shown).otherwise(m)


def address(m: Column, key: str, undo: bool) -> Column:
    """Two Feistel halves of two bytes each."""
    part = lambda i: F.split(m, r"\.")[i].cast("long")
    two = F.lit(65536)
    out = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), two, two, key, F.lit("ip"), undo)
    dots = lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)))
    valid = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255) & ~m.rlike(r"(^|\.)0[0-9]")
    return F.when(valid, F.element_at(F.transform(F.array(out), dots), 1)).otherwise(m)


def date(m: Column, key: str, undo: bool) -> Column:
    """Year first, or day first; dates of the years 1800 to 2199 move anywhere in these years.

    A date that reads month-first only (its day is over 12) must stay one to be undone, so these 88,497 = 9 x 9,833
    days of the cycle move among themselves.
    """
    year_first = m.rlike("^[0-9]{4}")
    mark = F.when(year_first, F.substr(m, F.lit(5), F.lit(1))).otherwise(F.substr(m, F.lit(3), F.lit(1)))
    plain = F.regexp_replace(m, "[/.]", "-")
    dmy, mdy = F.try_to_date(plain, "dd-MM-yyyy"), F.try_to_date(plain, "MM-dd-yyyy")
    value = F.when(year_first, F.try_to_date(plain, "yyyy-MM-dd")).otherwise(dmy)
    start = F.lit("1800-01-01").cast("date")
    day = F.datediff(value, start)
    moved = feistel(F.floor(day / 773), day % 773, F.lit(189), F.lit(773), key, F.when(year_first, "ymd").otherwise("dmy"), undo)
    shown = lambda s: F.date_format(F.date_add(start, (s["a"] * 773 + s["b"]).cast("int")), "yyyy-MM-dd")
    iso = F.element_at(F.transform(F.array(moved), shown), 1)
    text = F.when(year_first, iso).otherwise(F.concat_ws("-", F.substr(iso, F.lit(9), F.lit(2)), F.substr(iso, F.lit(6), F.lit(2)), F.substr(iso, F.lit(1), F.lit(4))))

    months = (F.year(mdy) - 1800) * 12 + F.month(mdy) - 1
    late = F.datediff(mdy, start) - 12 * (months + 1)  # its number among the days over 12
    other = feistel(F.floor(late / 9833), late % 9833, F.lit(9), F.lit(9833), key, F.lit("mdy"), undo)
    before = lambda n: F.datediff(F.add_months(start, n.cast("int")), start) - 12 * n  # noqa: E731 - days over 12 before month n

    def put(x: Column) -> Column:
        near = F.floor(x / 18.436875)  # the month is this one or a neighbour
        found = F.filter(F.sequence(F.greatest(near - 2, F.lit(0)), F.least(near + 2, F.lit(4799))), lambda n: (before(n) <= x) & (x < before(n + 1)))
        text_of = lambda n: F.concat_ws("-", padded(n % 12 + 1, 2), padded(x - before(n) + 13, 2), (F.floor(n / 12) + 1800).cast("string"))
        return F.element_at(F.transform(found, text_of), 1)

    american = each(each(other, lambda s: s["a"] * 9833 + s["b"]), put)

    known = F.when(day.between(0, 146096), text).when(value.isNull() & ~year_first & months.between(0, 4799), american)
    same_marks = m.rlike(r"^[0-9]+([-/.])[0-9]+\1[0-9]+$")
    return F.when(known.isNotNull() & same_marks, F.replace(known, F.lit("-"), mark)).otherwise(m)


def in_chunks(text: Column, base: int, key: str, tag: Column, undo: bool) -> Column:
    """permute over consecutive runs of 24, each under its own tweak; empty stays empty."""
    runs = F.sequence(F.lit(1), F.greatest(F.ceil(F.length(text) / 24), F.lit(1)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: permute(F.substr(text, i * 24 - 23, F.lit(24)), base, key, F.concat(tag, i.cast("string"), F.lit("/")), undo)), "")


def email(m: Column, key: str, undo: bool) -> Column:
    """The local part's letters and its digits move among themselves, in lower case; other marks and the domain stay.
    A local part longer than LOCAL_PIECE moves piece by piece, so the work stays in proportion to it."""
    pieces = F.regexp_extract_all(F.lower(F.substring_index(m, "@", 1)), F.lit(f".{{1,{LOCAL_PIECE}}}"), F.lit(0))
    tag = lambda i: F.when(i == 0, "mail").otherwise(F.concat(F.lit("mail"), i.cast("string"), F.lit(":")))
    moved = F.transform(pieces, lambda p, i: local_part(p, key, tag(i), undo))
    return F.concat(F.array_join(moved, ""), F.lit("@"), F.substring_index(m, "@", -1))


def local_part(local: Column, key: str, tag: Column, undo: bool) -> Column:
    letters, digits = F.regexp_replace(local, "[^a-z]", ""), F.regexp_replace(local, "[^0-9]", "")
    new_letters = F.translate(in_chunks(F.translate(letters, LETTERS, ALPHABET[:26]), 26, key, tag, undo), ALPHABET[:26], LETTERS)
    new_digits = in_chunks(digits, 10, key, tag, undo)
    at = F.filter(F.split(local, ""), lambda c: c != "")
    state = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit("").alias("s"))

    def moved(pair: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            letter = F.struct((s["i"] + 1).alias("i"), s["j"].alias("j"), F.concat(s["s"], F.substr(pair["l"], s["i"], F.lit(1))).alias("s"))
            digit = F.struct(s["i"].alias("i"), (s["j"] + 1).alias("j"), F.concat(s["s"], F.substr(pair["d"], s["j"], F.lit(1))).alias("s"))
            return F.when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[0-9]$"), digit).otherwise(F.struct(s["i"].alias("i"), s["j"].alias("j"), F.concat(s["s"], c).alias("s")))

        return F.aggregate(at, state, step, lambda s: s["s"])

    return each(F.struct(new_letters.alias("l"), new_digits.alias("d")), moved)


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """What a match of FOUND becomes."""
    return (
        F.when(F.contains(m, F.lit("@")), email(m, key, undo))
        .when(m.rlike(f"^(?:{DATE})$"), date(m, key, undo))
        .when(m.rlike(f"^(?:{SSN})$"), social(m, key, undo))
        .when(m.rlike(f"^(?:{IP})$"), address(m, key, undo))
        .when(m.rlike(r"^[+(]") | m.rlike(f"^(?:{PHONE})$"), phone(m, key, undo))
        .otherwise(card(m, key, undo))
    )


def pseudonymise(docs: DataFrame, key: str, undo: bool = False, column: str = "text") -> DataFrame:
    """docs with the column's personal values replaced. The text is split at its matches once; only texts
    with a digit run or an @ are touched at all. undo takes the values back."""
    text = F.col(column)
    whole = F.transform(F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)), lambda m: pseudonym(m, key, undo))
    between = F.split(text, FOUND, -1)
    joined = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(between.alias("t"), whole.alias("m")), lambda z: F.array(F.coalesce(z["t"], F.lit("")), F.coalesce(z["m"], F.lit(""))))))
    return docs.withColumn(column, F.when(text.rlike("@|[0-9][^A-Za-z]{0,3}[0-9]"), joined).otherwise(text))
