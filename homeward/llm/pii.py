"""Format-preserving pseudonyms for personal data, with built-in functions only.

A value found in a text is checked (card numbers by Luhn's digit, IBANs modulo 97, dates by the
calendar, addresses by their range), read as a list of symbols, each of an alphabet of its own
size, and permuted by a keyed Feistel network over these lists; what results is written in the
value's own format, with check digits made anew. The permutation depends on the key, the kind and
the value alone, so equal values have equal pseudonyms in all documents, however they are
written, and different ones have different ones. What fails its check is left as it is; a card or an IBAN ends
where its check passes, so digits or words behind it do not hide it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward.llm.common import fresh

ROUNDS = 10
#: Characters that a pseudonym keeps within their class; any other character stays.
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
HEX_LOW, HEX_HIGH = "0123456789abcdef", "0123456789ABCDEF"
EDGE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Kinds in the order in which they are tried at a place, and what they look like.
KINDS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + END,
    "ssn": r"\d{3}-\d{2}-\d{4}(?!-?\d)" + END,
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + END,
    "phone": r"(?:1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + END,
    "card": r"\d(?:[ -]?\d){12,18}" + END,
    "secret": r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})" + END,
}
#: Kinds whose values end where their check passes, and the numbers of characters they can have.
LENGTHS = {"iban": (12, 34), "card": (13, 19)}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}
#: Two spans of about a century, each with the number of its days as a product.
CENTURIES = [("1901-01-01", 75, 487), ("2001-01-01", 92, 397)]


def chars(text: Column) -> Column:
    return F.split(text, "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def stream(key: str, kind: str, step: Column, half: Column, n: Column) -> Column:
    """128 hex digits that depend on all that is given."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), n.cast("string"), F.array_join(half.cast("array<string>"), ",")), 512)


def feistel(symbols: Column, sizes: Column, key: str, kind: str) -> Column:
    """A permutation of the lists of symbols with these alphabet sizes.

    The halves take turns: to each symbol of one a number is added that the whole other half and
    the key decide, modulo the size of its alphabet. That can be undone, so no two lists meet.
    """
    n = F.size(symbols)
    left = F.floor(n / 2).cast("int")

    def moved(half: Column, of: Column, other: Column, step: Column) -> Column:
        hexed = stream(key, kind, step, other, n)
        part = lambda i: F.conv(F.substr(hexed, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.transform(half, lambda x, i: F.pmod(x + part(i), F.greatest(F.get(of, i), F.lit(1))))

    a_sizes, b_sizes = F.slice(sizes, 1, left), F.slice(sizes, left + 1, n)

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(
            F.when(even, moved(s["a"], a_sizes, s["b"], i)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(moved(s["b"], b_sizes, s["a"], i)).alias("b"),
        )

    begin = F.struct(F.slice(symbols, 1, left).alias("a"), F.slice(symbols, left + 1, n).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda s: F.concat(s["a"], s["b"]))


def permuted(text: Column, key: str, kind: str, classes: list[str] = CLASSES) -> Column:
    """The text with every character moved within its class; the others stay and count as well."""
    cs = chars(text)
    place = lambda c, k: F.instr(F.lit(k), c)

    def by_class(c: Column, found, other: Column) -> Column:
        out = other
        for k in reversed(classes):
            out = F.when(place(c, k) > 0, found(k)).otherwise(out)
        return out

    symbols = F.transform(cs, lambda c: by_class(c, lambda k: place(c, k) - 1, F.lit(0)))
    sizes = F.transform(cs, lambda c: by_class(c, lambda k: F.lit(len(k)), F.lit(1)))
    moved = feistel(symbols, sizes, key, kind)
    return F.array_join(F.zip_with(cs, moved, lambda c, m: by_class(c, lambda k: F.substr(F.lit(k), m + 1, F.lit(1)), c)), "")


def in_format(text: Column, new: Column) -> Column:
    """``text`` with its digits, in order, replaced by those of ``new``."""
    cs = chars(text)
    so_far = lambda i: F.char_length(digits(F.substr(text, F.lit(1), i + 1)))
    return F.array_join(F.transform(cs, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(new, so_far(i), F.lit(1))).otherwise(c)), "")


def luhn_sum(number: Column) -> Column:
    """Luhn's sum of a digit string, its last digit counted once."""
    each = F.transform(chars(F.reverse(number)), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") > 4).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def mod97(text: Column) -> Column:
    """Letters count from A = 10; the text read as one number, modulo 97."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(chars(text), F.lit(0), lambda s, c: F.pmod(F.when(value(c) > 9, s * 100 + value(c)).otherwise(s * 10 + value(c)), F.lit(97)))


def card_valid(m: Column) -> Column:
    return F.pmod(luhn_sum(digits(m)), F.lit(10)) == 0


def iban_valid(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return mod97(F.concat(F.substr(plain, F.lit(5), F.char_length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1


def valid_values(text: Column, kind: str) -> Column:
    """The distinct values of a kind in LENGTHS that start anywhere in ``text``, long ones first:
    of each start an IBAN of its country's length if that is valid, else the longest valid one."""
    least, most = LENGTHS[kind]
    first, more, valid = {"card": (r"^(\d(?:[ -]?\d){", 1, card_valid), "iban": (r"^([A-Z]{2}\d{2}(?: ?[A-Z0-9]){", 4, iban_valid)}[kind]
    starts = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{EDGE}(?=({KINDS[kind]}))"), F.lit(1)))

    def longest(m: Column) -> Column:
        lengths = F.sequence(F.lit(most), F.lit(least), F.lit(-1))
        if kind == "iban":
            own = F.lit(None).cast("int")
            for n, lands in IBAN_LENGTHS.items():
                own = F.when(F.substr(m, F.lit(1), F.lit(2)).isin(lands.split()), n).otherwise(own)
            lengths = F.concat(F.filter(F.array(own), lambda n: n.isNotNull()), lengths)
        cut = F.transform(lengths, lambda n: F.call_function("regexp_extract", m, F.concat(F.lit(first), (n - more).cast("string"), F.lit("})" + END)), F.lit(1)))
        return F.get(F.filter(cut, lambda v: F.when(v != "", valid(v)).otherwise(False)), F.lit(0))

    found = F.array_distinct(F.filter(F.transform(starts, longest), lambda v: v.isNotNull()))
    keyed = F.transform(found, lambda v: F.struct((-F.char_length(v)).alias("n"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def scanned(values: dict[str, Column]) -> Column:
    """The pattern of a text's values: KINDS, but of those in LENGTHS just the ``values`` found."""
    parts = []
    for kind, looks in KINDS.items():
        own = F.lit(looks)
        if kind in values:
            own = F.when(F.size(values[kind]) > 0, F.concat(F.lit("(?:"), F.array_join(values[kind], "|"), F.lit(")" + END)))
        parts.append(own)
    return F.concat(F.lit(f"{EDGE}(?:"), F.concat_ws("|", *parts), F.lit(")"))


def card(m: Column, key: str) -> Column:
    number = digits(m)
    body = permuted(F.substr(number, F.lit(1), F.char_length(number) - 1), key, "card", CLASSES[:1])
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(number), F.lit(10)) == 0, in_format(m, F.concat(body, check.cast("string")))).otherwise(m)


def iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    land, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.char_length(plain))
    valid = mod97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1
    new = permuted(body, key, "iban", [CLASSES[0], CLASSES[2]])
    check = F.lpad((98 - mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0")
    whole = chars(F.concat(land, check, new))
    cs = chars(m)
    so_far = lambda i: F.char_length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), " ", ""))
    spaced = F.array_join(F.transform(cs, lambda c, i: F.when(c == " ", c).otherwise(F.get(whole, so_far(i) - 1))), "")
    return F.when(valid, spaced).otherwise(m)


def ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    moved = feistel(parts, F.transform(parts, lambda _: F.lit(256)), key, "ip")
    return F.when(F.forall(parts, lambda x: x < 256), F.array_join(moved.cast("array<string>"), ".")).otherwise(m)


def ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001."""
    p = F.transform(F.split(m, "-"), lambda x: x.cast("int"))
    area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    moved = feistel(F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    a = F.get(moved, F.lit(0))
    new = F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((a + F.when(a >= 665, 2).otherwise(1), 3), (F.get(moved, F.lit(1)) + 1, 2), (F.get(moved, F.lit(2)) + 1, 4))))
    return F.when(valid, new).otherwise(m)


def date(m: Column, key: str) -> Column:
    """A day of the same century; the separators and the order of the parts stay."""
    iso, slash = m.contains("-"), m.contains("/")
    american = F.try_to_date(F.when(slash, m), "MM/dd/yyyy")
    day = F.coalesce(F.try_to_date(F.when(iso, m), "yyyy-MM-dd"), american, F.try_to_date(F.when(slash, m), "dd/MM/yyyy"), F.try_to_date(F.when(~iso & ~slash, m), "dd.MM.yyyy"))
    out = F.lit(None).cast("date")
    for start, a, b in CENTURIES:
        n = F.datediff(day, F.lit(start).cast("date"))
        moved = feistel(F.array(F.floor(n / b).cast("int"), F.pmod(n, F.lit(b))), F.array(F.lit(a), F.lit(b)), key, f"date{start}")
        out = F.when((n >= 0) & (n < a * b), F.date_add(F.lit(start).cast("date"), F.get(moved, F.lit(0)) * b + F.get(moved, F.lit(1)))).otherwise(out)
    written = F.when(iso, F.date_format(out, "yyyy-MM-dd")).when(american.isNotNull(), F.date_format(out, "MM/dd/yyyy")).when(slash, F.date_format(out, "dd/MM/yyyy")).otherwise(F.date_format(out, "dd.MM.yyyy"))
    return F.coalesce(written, m)


def phone(m: Column, key: str) -> Column:
    """The last ten digits; a country code before them stays."""
    number = digits(m)
    n = F.char_length(number)
    new = permuted(F.substr(number, n - 9, F.lit(10)), key, "phone", CLASSES[:1])
    return in_format(m, F.concat(F.substr(number, F.lit(1), n - 10), new))


def email(m: Column, key: str) -> Column:
    """The local part; the domain stays."""
    at = F.instr(m, "@")
    return F.concat(permuted(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at, F.char_length(m)))


def secret(m: Column, key: str) -> Column:
    low = permuted(F.lower(m), key, "secret", [HEX_LOW])
    return F.when(m.rlike("[A-F]"), F.upper(low)).otherwise(low)


def pseudonym(m: Column, key: str) -> Column:
    """What stands for a match of one of KINDS; the match itself if it fails its kind's check."""
    out = m
    for kind, made in reversed({"email": email, "ip": ip, "date": date, "ssn": ssn, "iban": iban, "phone": phone, "card": card, "secret": secret}.items()):
        out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), made(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "n_values") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and the number of values replaced as ``found``.

    All rows and the other columns stay, whatever their names; a column named as ``found`` is
    replaced. A null text stays null, with 0 values, an empty one empty; texts without personal
    data stay as they are, byte for byte; very long ones are searched whole. Repeated rows change
    alike, null ids change nothing, an empty table gives an empty one.
    """
    cols = docs.columns
    values, new, looks = (fresh(f"_pii_{c}", cols) for c in ("values", "new", "looks"))
    own = {k: fresh(f"_pii_{k}", cols) for k in LENGTHS}
    df = docs.withColumns({own[k]: valid_values(F.col(text), k) for k in LENGTHS})
    df = df.withColumn(looks, scanned({k: F.col(own[k]) for k in LENGTHS}))
    df = df.withColumn(values, F.regexp_extract_all(F.col(text), F.col(looks), F.lit(0)))
    df = df.withColumn(new, F.when(F.size(values) > 0, F.transform(values, lambda m: pseudonym(m, key))))
    between = F.split(F.col(text), F.col(looks), -1)
    whole = F.array_join(F.zip_with(between, F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(values, new, lambda a, b: a != b), lambda x: x))
    df = df.withColumn(found, F.when(F.size(values) > 0, changed).otherwise(0).cast("bigint"))
    df = df.withColumn(text, F.when(F.size(values) > 0, whole).otherwise(F.col(text)))
    return df.select(*cols, *([found] if found not in cols else []))
