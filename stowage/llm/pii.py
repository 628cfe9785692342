"""Format-preserving pseudonyms for personal numbers, in SQL expressions alone.

Card numbers (13 to 19 digits with a right check digit), phone numbers (ten digits, or 7 to 15 after +), IPv4 addresses, dates
that exist (yyyy-MM-dd, dd/MM/yyyy, else MM/dd/yyyy, dd.MM.yyyy) and mail addresses are replaced by a keyed permutation within their own format, so equal values stay linked across documents. A
pseudonym comes from an alternating Feistel network over Z_a x Z_b: left += F(right) mod a, right += F(left) mod b, with F
from SHA-256 of key, kind, round and half. That is a bijection of 0 .. a*b-1 for any a and b. Cards keep their length and
get a right check digit, phones keep country code and punctuation, addresses stay addresses, dates stay dates of the
years 1900 to 2100 in their layout; the part of a mail address before the @ becomes a keyed name (it has no numeric format).

Defined cases: null text gives null and no counts; digits that fail validation stay as they are; a hit needs no Latin letter or digit
next to it, but a date can go on with the T of a time and a phone with x or ext and an extension, which both stay; repeated rows get equal results; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "replace this key in production"
ROUNDS = 8
KINDS = ("card", "phone", "ip", "date", "email")
FIRST_DAY = "DATE'1900-01-01'"
# Days 0 .. 256 * 286 - 1 from the first day, to 2100-06-16.
DAY_SIDES = (256, 286)
# A hit starts where its run of name characters starts, and the run is never given back: linear time on any text.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
# Assigned country codes of one, two and three digits.
CODES = (
    "[17]",
    "(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    r"(?:21[12368]|2[2-6]\d|29[01789]|3[578]\d|42[013]|50\d|59\d|67[02-9]|68\d|69[0-2]|80[08]|85[02356]|87[08]|88[0-368]|96[0-8]|97\d|99[2-68])",
)
APART = r"[ \u00A0\u202F./-]"
TRUNK = rf"(?:{APART}?\(0\))?"
# Three, three and four digits, with or without a country code or a leading 1.
GROUPED = r"(?:\+\d{1,3}[ .-]?|1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
# Any grouping after a country code, 15 digits at most; an area code may stand in brackets.
GLOBAL = (
    r"\+(?:"
    + "|".join(rf"{code}{TRUNK}(?:{APART}?\d){{{6 - k},{14 - k}}}" for k, code in enumerate(CODES))
    + rf"|(?:{'|'.join(CODES)}){APART}?\(\d{{1,3}}\)(?:{APART}?\d){{4,9}})"
)
UNDIVIDED = r"[2-9]\d{2}[2-9]\d{6}"
PHONE = rf"{GROUPED}|{GLOBAL}|{UNDIVIDED}"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
CARD = r"\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19}"
# Neither digits nor Latin letters stand next to a hit, but for the T of a time after a date and an extension after a phone.
END = r"(?!-?\d|\.\d|\p{IsLatin})"
EXTENSION = r"(?=(?:[xX]|[eE][xX][tT])\.?[ ]?\d)"
# One pass finds every kind; the order settles which kind a text position is tried as first.
FOUND = (
    rf"{EMAIL}|(?<![\p{{IsLatin}}\p{{N}}])(?<!\d[.-])"
    rf"(?:(?:{DATE})(?:(?=[Tt]\d)|{END})|(?:{CARD}|{IP}){END}|(?:{PHONE})(?:{EXTENSION}|{END}))"
)
# Steps to another day that a month-first date takes at most; two in five days call for another step.
WALK = 64


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def digits(x: str) -> str:
    return rf"regexp_replace({x}, '\\D', '')"


def feistel(number: str, a: str, b: str, kind: str, key: str, inverse: bool = False) -> str:
    """SQL of the pseudonym of ``number`` in 0 .. a*b-1; ``inverse`` undoes it."""
    mark = f"{key}:{kind}:".replace("\\", "\\\\").replace("'", "\\'")

    def f(half: str, step: str, side: str) -> str:
        return f"pmod(CAST(conv(substr(sha2(concat('{mark}', {step}, ':', {half}), 256), 1, 15), 16, 10) AS bigint), {side})"

    start = f"named_struct('l', CAST(({number}) DIV ({b}) AS bigint), 'r', pmod(CAST(({number}) AS bigint), CAST(({b}) AS bigint)))"
    left, right = f("p.r", "i", f"CAST(({a}) AS bigint)"), f("q.l", "i", f"CAST(({b}) AS bigint)")
    if inverse:
        steps = f"sequence({ROUNDS} - 1, 0)"
        one = f"transform(array(named_struct('l', p.l, 'r', pmod(p.r - {f('p.l', 'i', f'CAST(({b}) AS bigint)')}, CAST(({b}) AS bigint)))), q -> named_struct('l', pmod(q.l - {f('q.r', 'i', f'CAST(({a}) AS bigint)')}, CAST(({a}) AS bigint)), 'r', q.r))[0]"
    else:
        steps = f"sequence(0, {ROUNDS} - 1)"
        one = f"transform(array(named_struct('l', pmod(p.l + {left}, CAST(({a}) AS bigint)), 'r', p.r)), q -> named_struct('l', q.l, 'r', pmod(q.r + {right}, CAST(({b}) AS bigint))))[0]"
    return f"aggregate({steps}, {start}, (p, i) -> {one}, p -> p.l * CAST(({b}) AS bigint) + p.r)"


def check_sum(x: str) -> str:
    """The sum of a digit string whose last digit counts once, the one before it twice, and so on."""
    return f"aggregate(transform(split(reverse({x}), ''), (d, i) -> transform(array(CAST(d AS int) * (1 + i % 2)), v -> v - 9 * CAST(v > 9 AS int))[0]), 0, (s, v) -> s + v)"


def layout(m: str) -> str:
    """SQL of the layout of a date; with slashes the month comes first only if no day-first date exists."""
    return f"CASE WHEN instr({m}, '-') > 0 THEN 'yyyy-MM-dd' WHEN instr({m}, '.') > 0 THEN 'dd.MM.yyyy' WHEN try_to_date({m}, 'dd/MM/yyyy') IS NOT NULL THEN 'dd/MM/yyyy' ELSE 'MM/dd/yyyy' END"


def kind_of(m: str = "m") -> str:
    """SQL of the kind of a hit; null if it fails validation."""
    d = digits(m)
    return f"""CASE WHEN instr({m}, '@') > 0 THEN 'email'
      WHEN {m} RLIKE {quoted(f'^(?:{DATE})$')} THEN CASE WHEN coalesce(try_to_date({m}, {layout(m)})
          BETWEEN {FIRST_DAY} AND date_add({FIRST_DAY}, {DAY_SIDES[0] * DAY_SIDES[1] - 1}), false) THEN 'date' END
      WHEN {m} RLIKE {quoted(f'^(?:{CARD})$')} THEN CASE WHEN {check_sum(d)} % 10 = 0 THEN 'card' END
      WHEN {m} RLIKE {quoted(f'^{IP}$')} THEN CASE WHEN forall(split({m}, '[.]'), o -> CAST(o AS int) < 256) THEN 'ip' END
      WHEN length({d}) >= 7 THEN 'phone' END"""


def in_layout(m: str, replacement: str) -> str:
    """SQL that puts the digits of ``replacement`` in the places of the digits of ``m``."""
    return f"""transform(array({replacement}), ds -> array_join(aggregate(split({m}, ''), named_struct('o', CAST(array() AS array<string>), 'k', 0),
        (s, c) -> CASE WHEN c RLIKE '^[0-9]$' THEN named_struct('o', array_append(s.o, substr(ds, s.k + 1, 1)), 'k', s.k + 1) ELSE named_struct('o', array_append(s.o, c), 'k', s.k) END, s -> s.o), ''))[0]"""


def pseudonym(kind: str, m: str, key: str) -> str:
    """SQL of the pseudonym of a valid hit."""
    d = digits(m)
    if kind == "card":
        n = f"(length({d}) - 1)"
        body = f"lpad(CAST({feistel(f'CAST(substr({d}, 1, {n}) AS bigint)', f'CAST(pow(10, {n} DIV 2) AS bigint)', f'CAST(pow(10, {n} - {n} DIV 2) AS bigint)', 'card', key)} AS string), {n}, '0')"
        return in_layout(m, f"transform(array({body}), c -> concat(c, CAST(pmod(10 - {check_sum(chr(39).join(['concat(c, ', '0', ')']))} % 10, 10) AS string)))[0]")
    if kind == "phone":
        # What a country code keeps in place: the code itself, and a zero in brackets after it.
        kept = digits(f"regexp_extract({m}, {quoted(rf'^[+](?:{'|'.join(CODES)}){TRUNK}')}, 0)")
        n = f"(CASE WHEN {m} RLIKE {quoted(f'^(?:{GROUPED}|{UNDIVIDED})$')} THEN 10 ELSE length({d}) - length({kept}) END)"
        body = f"transform(array({n}), n -> lpad(CAST({feistel(f'CAST(right({d}, n) AS bigint)', 'CAST(pow(10, n DIV 2) AS bigint)', 'CAST(pow(10, n - n DIV 2) AS bigint)', 'phone', key)} AS string), n, '0'))[0]"
        return in_layout(m, f"transform(array({body}), c -> concat(substr({d}, 1, length({d}) - length(c)), c))[0]")
    if kind == "ip":
        number = f"aggregate(split({m}, '[.]'), 0L, (s, o) -> s * 256 + CAST(o AS bigint))"
        return f"transform(array({feistel(number, '65536L', '65536L', 'ip', key)}), v -> concat_ws('.', v DIV 16777216, v DIV 65536 % 256, v DIV 256 % 256, v % 256))[0]"
    if kind == "date":
        sides = (f"{DAY_SIDES[0]}L", f"{DAY_SIDES[1]}L", "date", key)
        day = feistel(f"datediff(try_to_date({m}, way), {FIRST_DAY})", *sides)
        # A month-first date walks on to a day that can only be read month first, so that no two dates share a pseudonym.
        walked = f"aggregate(sequence(1, CASE WHEN way = 'MM/dd/yyyy' THEN {WALK} ELSE 1 END), {day}, (y, w) -> CASE WHEN way <> 'MM/dd/yyyy' OR day(date_add({FIRST_DAY}, CAST(y AS int))) > 12 THEN y ELSE {feistel('y', *sides)} END)"
        return f"transform(array({layout(m)}), way -> date_format(date_add({FIRST_DAY}, CAST({walked} AS int)), way))[0]"
    mark = f"{key}:email:".replace("\\", "\\\\").replace("'", "\\'")
    # The domain may name a person as well: only its last label stays.
    return f"concat('u', substr(sha2(concat('{mark}', lower({m})), 256), 1, 16), '@masked.', lower(regexp_extract({m}, '[.]([^.]+)$', 1)))"


def masked(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, and how many values of each kind were replaced."""
    shown = " ".join(f"WHEN '{k}' THEN {pseudonym(k, 'm', key)}" for k in KINDS)
    hits = f"""CASE WHEN text RLIKE '[0-9@]' THEN transform(regexp_extract_all(text, {quoted(FOUND)}, 0),
        m -> transform(array({kind_of()}), k -> named_struct('kind', k, 'shown', CASE k {shown} ELSE m END))[0]) END"""
    pieces = f"CASE WHEN size(hits) > 0 THEN array_join(flatten(zip_with(split(text, {quoted(FOUND)}, -1), hits, (p, h) -> array(p, coalesce(h.shown, '')))), '') ELSE text END"
    counts = {f"n_{k}": F.expr(f"CAST(coalesce(size(filter(hits, h -> h.kind = '{k}')), 0) AS bigint)") for k in KINDS}
    found = docs.select("doc_id", "text", F.expr(hits).alias("hits"))
    return found.select("doc_id", F.expr(pieces).alias("text"), *[c.alias(n) for n, c in counts.items()])
