"""Keys of document numbers, party names and tax ids; similarity; text guards. All but indel_ratio are native."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .money import format_inr

# Document words before a number, in order of preference.
DOCUMENT_WORDS = ("INVOICE", "TAXINV", "GSTINV", "PURCHASE", "PURCH", "INV", "BILL", "TAX", "GST", "PUR", "PINV", "SINV", "TI", "PI", "SI")

# Legal endings of names, in order of preference.
LEGAL_WORDS = (
    "PRIVATE LIMITED", "PVT LIMITED", "PRIVATE LTD", "PVT LTD", "P LTD", "LIMITED", "LTD", "LLP", "ENTERPRISES", "ENTERPRISE",
    "TRADERS", "TRADING CO", "AND SONS", "& SONS", "AND COMPANY", "AND CO", "& COMPANY", "& CO", "INDIA", "INDUSTRIES",
    "CORPORATION", "CORP", "INCORPORATED", "INC",
)

# Words of payment channels in bank narrations.
CHANNEL_WORDS = ("NEFT", "RTGS", "IMPS", "UPI", "ACH", "ECS", "CHQ", "CR", "DR", "PAYMENT", "COLLECTION", "TRANSFER", "INB", "MB", "BIL", "TPT", r"N\d{8,}", r"\d{6,}")

# The tax id's shape and its digits' alphabet.
GSTIN_SHAPE = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
GSTIN_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Statutory names whose digits are no amounts.
STATUTORY = (
    r"GSTR[\s-]?(?:1A|2A|2B|3B|9C|1|4|9)", r"ITC[\s-]?0?4", r"(?:DRC|ASMT|ADT|REG|PMT)[\s-]?\d{1,2}", r"(?:section|sec\.?|u/s)\s*\d{1,3}(?:\s*\([0-9a-z]+\))*",
    r"rule\s*\d{1,3}[a-z]?(?:\s*\([0-9a-z]+\))*", r"table\s*\d{1,2}[a-z]?(?:\.\d+)?(?:\s*\([0-9a-z]+\))*", "B2BA|B2B|B2CL|B2CS|B2C",
    "CDNRA|CDNR|ISDA|ISD|IMPGSEZ|IMPG|ECOA|ECO", "2B|3B", "GSTIN|HSN|SAC|PAN|TDS|TCS|QRMP|IMS",
)

# How a financial year, a courtesy prefix, a year run in a number and a number in a sentence are written; keys
# and guards are only equal to others' if these are.
_YEARS = r"(?:F\.?\s?Y\.?\s?)?(?<![0-9])(\d{4}|\d{2})\s*[-/]\s*(\d{4}|\d{2})(?![0-9])"
_COURTESY, _YEAR_RUN, _NUMBER = r"^M\s*/?\s*S\.?\s+", r"^(.*?)20\d{2}(?:20)?\d{2}", r"\d[\d,]*(?:\.\d+)?"


def alnum(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Z0-9]", "")


def _without_year_ranges(x: Column) -> Column:
    """Drops ranges of consecutive years; other pairs of numbers, which the same scan takes, stay."""
    gaps = F.split(x, _YEARS, -1)
    whole, left, right = (F.regexp_extract_all(x, F.lit(_YEARS), F.lit(g)) for g in (0, 1, 2))
    keep = F.transform(
        whole,
        lambda w, i: F.when((F.try_element_at(left, (i + 1)).cast("int") + 1) % 100 == F.try_element_at(right, (i + 1)).cast("int") % 100, "").otherwise(w),
    )
    return F.concat_ws("", F.zip_with(gaps, keep, lambda g, k: F.concat(g, F.coalesce(k, F.lit("")))))


def norm_invoice_no(raw: Column) -> Column:
    """A document number without its document words, financial year and leading zeros; null is empty."""
    upper = F.trim(F.upper(F.coalesce(raw, F.lit(""))))
    bare = alnum(upper)
    x = F.regexp_replace(alnum(_without_year_ranges(upper)), f"^(?:{'|'.join(DOCUMENT_WORDS)})+(?:NUMBER|NUM|NO)?", "")
    shorter = F.regexp_replace(x, _YEAR_RUN, "$1")
    x = F.when(F.length(shorter) >= 2, shorter).otherwise(x)
    stripped = F.regexp_replace(x, "^0+", "")
    x = F.when(stripped != "", stripped).otherwise(x)
    return F.when(x != "", x).otherwise(bare)


def norm_party(raw: Column) -> Column:
    """A name without its courtesy prefix and legal words; without these only if something is left."""
    x = F.trim(F.upper(F.coalesce(raw, F.lit(""))))
    x = F.regexp_replace(F.regexp_replace(x, _COURTESY, ""), r"\s+", " ")
    words = f"(?<![A-Z0-9])(?:{'|'.join(LEGAL_WORDS)})(?![A-Z0-9])"
    short = alnum(F.regexp_replace(x, words, " "))
    return F.when(short != "", short).otherwise(alnum(x))


def display_party(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), r"\s+", " ")


def clean_narration(raw: Column) -> Column:
    return norm_party(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), rf"\b(?:{'|'.join(CHANNEL_WORDS)})\b", " "))


def norm_gstin(raw: Column) -> Column:
    return F.nullif(alnum(F.upper(raw)), F.lit(""))


def gstin_check_digit(gstin: Column) -> Column:
    """The check digit of a tax id's first 14 characters: base-36 digits, every second doubled, folded, summed."""
    value = lambda i: (F.position(F.substr(gstin, i, F.lit(1)), F.lit(GSTIN_DIGITS)) - 1) * F.when(i % 2 == 0, 2).otherwise(1)
    folded = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.floor(value(i) / 36).cast("int") + value(i) % 36)
    total = F.aggregate(folded, F.lit(0), lambda a, v: (a + v).cast("int"))
    return F.substr(F.lit(GSTIN_DIGITS), (36 - total % 36) % 36 + 1, F.lit(1))


def is_valid_gstin(raw: Column) -> Column:
    g = norm_gstin(raw)
    return F.coalesce(F.when(g.rlike(GSTIN_SHAPE), F.substring(g, 15, 1) == gstin_check_digit(g)).otherwise(False), F.lit(False))


def pan_of(gstin: Column) -> Column:
    return F.when(is_valid_gstin(gstin), F.substring(norm_gstin(gstin), 3, 10))


def state_of(gstin: Column) -> Column:
    return F.when(is_valid_gstin(gstin), F.substring(norm_gstin(gstin), 1, 2))


def doc_type(norm_number: Column) -> Column:
    return F.when(norm_number.startswith("CN"), "credit_note").when(norm_number.startswith("DN"), "debit_note").otherwise("invoice")


def document_key(rule: str, supplier: Column, number: Column, row_id: Column) -> Column:
    """rule:supplier:number; what is missing is named after the row."""
    known = lambda x, name: F.coalesce(F.nullif(x, F.lit("")), F.concat(F.lit(f"no-{name}-"), row_id.cast("string")))
    return F.concat_ws(":", F.lit(rule), known(supplier, "gstin"), known(number, "number"))


#: Fixed value: the namespace of stable ids.
NAMESPACE = "6f9b2b1e7c2a5d3f8a4b1c2d3e4f5a6b"


def stable_id(*parts: Column | str) -> Column:
    """The name-based (version 5) UUID of the parts joined by colons; null parts read None."""
    name = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), name.cast("binary")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# Names of the statement's sections beside the supplies, and of notes by their direction.
SECTION_LABELS = {
    "CDNR": "Credit and debit notes", "CDNRA": "Credit and debit notes, amended", "ISD": "Input service distributor", "ISDA": "Input service distributor, amended",
    "IMPG": "Imports of goods", "IMPGSEZ": "Imports from an SEZ unit", "ECO": "Supplies through an e-commerce operator", "ECOA": "E-commerce supplies, amended",
    "ITC_REVERSED": "Credit reversed", "B2B_DNR": "Notes, supplier not registered",
}
NOTE_LABELS = {"C": "Credit notes", "D": "Debit notes"}


def section_label(section: Column, note_type: Column) -> Column:
    """A section's name; notes are named by their direction and keep what stands after a comma."""
    names = lambda table, x: F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), x)
    base = F.coalesce(names(SECTION_LABELS, section), section)
    rest = F.regexp_extract(base, r",.*$", 0)
    return F.coalesce(F.concat(names(NOTE_LABELS, note_type), rest), base)


def short_inr(paise: Column) -> Column:
    """Rupees in crore or lakh with two decimals, as a headline shows them; smaller ones exactly."""
    size = F.abs(paise).cast("decimal(25,2)")
    shown = lambda unit, name: F.concat(F.round(size / unit, 2).cast("decimal(25,2)").cast("string"), F.lit(name))
    return F.concat(F.when(paise < 0, "\u2212").otherwise(""), F.lit("\u20b9"), F.when(size >= 10**9, shown(10**9, " Cr")).when(size >= 10**7, shown(10**7, " L")).otherwise(format_inr(F.abs(paise))))


def exact_inr(paise: Column) -> Column:
    """The exact rupees where short_inr rounds, else null."""
    return F.when(F.abs(paise) >= 10**7, F.concat(F.when(paise < 0, "\u2212").otherwise(""), F.lit("\u20b9"), format_inr(F.abs(paise))))


def facts_text(metrics: Column) -> Column:
    """A finding's metrics as lines `name: value`, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(metrics)), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.try_element_at(metrics, k), F.lit("none")))), "\n")


def plain_explanation(title: Column, severity: Column, calculation: Column, rule: Column) -> Column:
    """What a finding says without any model: its title, weight, arithmetic and rule."""
    return F.concat_ws(" ", F.concat(title, F.lit(" ("), severity, F.lit("):")), F.concat(calculation, F.lit(".")), rule)


def numbers_in(text: Column) -> Column:
    """The numbers of a text as decimals, statutory names left out."""
    rest = F.regexp_replace(text, rf"(?i)\b(?:{'|'.join(STATUTORY)})(?!\w)", " ")
    return F.transform(F.regexp_extract_all(rest, F.lit(_NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("decimal(25,2)"))


def unsupported_numbers(sentence: Column, facts: Column) -> Column:
    """Numbers of a sentence that its facts don't have."""
    return F.array_except(numbers_in(sentence), numbers_in(facts))


def subsequence_score(needle: Column, haystack: Column) -> Column:
    """0 unless all of needle's characters come in order; each counts 1, and more in a run."""
    chars = F.filter(F.split(F.lower(needle), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("sum"))
    hay = F.lower(haystack)

    def step(s: Column, c: Column) -> Column:
        at = F.when(s["at"] < 0, -1).otherwise(F.position(c, hay, s["at"] + 1))
        run = F.when(at == s["at"] + 1, s["run"] + 1).otherwise(1)
        return F.struct(F.when(at > 0, at).otherwise(-1).alias("at"), run.alias("run"), (s["sum"] + run).alias("sum"))

    end = F.aggregate(chars, start, step)
    return F.when((F.size(chars) > 0) & (end["at"] > 0), end["sum"]).otherwise(0)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """100 * 2 LCS / (len a + len b): no built-in has insertions and deletions alone. Two empty texts are 100."""
    for left, right in batches:
        yield pd.Series([200.0 * lcs_length(a or "", b or "") / n if (n := len(a or "") + len(b or "")) else 100.0 for a, b in zip(left, right, strict=True)])


def _lengths(a: str, b: str) -> list[int]:
    """The longest common subsequence of a with each beginning of b, the empty one first."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row


def _kept(a: str, b: str) -> str:
    """A longest common subsequence, in memory of one text's length: a is halved, b where both halves keep most."""
    if not a or not b:
        return ""
    if len(a) == 1:
        return a if a in b else ""
    half = len(a) // 2
    left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = max(range(len(b) + 1), key=lambda j: left[j] + right[j])
    return _kept(a[:half], b[:cut]) + _kept(a[half:], b[cut:])


#: Characters of a text that is compared with another.
MOST_DIFFED = 10_000


def char_diff(a: str, b: str) -> list[tuple[str, str]]:
    """Runs of characters that are kept, removed from a or added in b; what is kept is a longest common subsequence. Texts longer
    than MOST_DIFFED are an error: the time it takes grows with their product."""
    if max(len(a), len(b)) > MOST_DIFFED:
        raise ValueError(f"texts of over {MOST_DIFFED} characters aren't compared by characters")
    out: list[list[str]] = []

    def tell(op: str, text: str) -> None:
        if text and out and out[-1][0] == op:
            out[-1][1] += text
        elif text:
            out.append([op, text])

    i = j = 0
    for c in _kept(a, b):
        at, to = a.index(c, i), b.index(c, j)
        tell("remove", a[i:at])
        tell("add", b[j:to])
        tell("keep", c)
        i, j = at + 1, to + 1
    tell("remove", a[i:])
    tell("add", b[j:])
    return [(op, c) for op, c in out]


@F.pandas_udf(ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())])))
def diff_chars(left: pd.Series, right: pd.Series) -> pd.Series:
    """char_diff of two short texts, such as document numbers; null is empty."""
    return pd.Series([[{"op": op, "text": t} for op, t in char_diff(a or "", b or "")] for a, b in zip(left, right, strict=True)])
