"""Structural validators as Column predicates: everything stays inside the JVM.

Each function takes a string column and returns a boolean column that is false for null, empty
and malformed values.  Digit-based checks ignore everything that isn't a digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


def only_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def only_alnum(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z]", ""))


def cells(s: Column) -> Column:
    """Digits of a digit string as an array of integers."""
    return F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: x.cast("int"))


def letters36(s: Column) -> Column:
    """Characters as 0-9 and A=10 .. Z=35."""
    return F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: F.conv(x, 36, 10).cast("int"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def weighted(a: Column, weights: list[int]) -> Column:
    """Sum of the first cells times their weights."""
    n = len(weights)
    return total(F.zip_with(F.slice(a, 1, n), F.array(*[F.lit(w) for w in weights]), lambda x, w: F.coalesce(x, F.lit(0)) * w))


def not_same(s: Column) -> Column:
    return ~s.rlike(r"^(.)\1*$")


def luhn_sum(s: Column) -> Column:
    back = cells(F.reverse(s))
    return total(F.transform(back, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2)))


def mod_string(s: Column, modulus: int) -> Column:
    """Remainder of a long digit string, digit by digit."""
    return F.aggregate(cells(s), F.lit(0), lambda r, x: (r * 10 + x) % modulus)


def expanded(s: Column) -> Column:
    """Letters replaced by their two digits (A=10 .. Z=35)."""
    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: F.conv(x, 36, 10)), "")


def sized(s: Column, *lengths: int) -> Column:
    return F.length(s).isin(*lengths)


def between(s: Column, at: int, size: int, low: int, high: int) -> Column:
    return F.substring(s, at, size).try_cast("int").between(low, high)


def luhn(c: Column) -> Column:
    d = only_digits(c)
    return (F.length(d) >= 12) & not_same(d) & (luhn_sum(d) % 10 == 0)


def ssn(c: Column) -> Column:
    d = only_digits(c)
    area = F.substring(d, 1, 3)
    return (
        sized(d, 9) & ~area.isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
        & not_same(d) & ~d.isin("123456789", "987654321", "012345678", "876543210", "078051120")
    )


#: Top-level domains longer than two letters that are accepted beside all two-letter ones.
LONG_TLDS = "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel asia cat post app dev cloud online site tech store blog xyz shop agency email example test invalid".split()


def email(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    tld = F.lower(F.substring_index(domain, ".", -1))
    shape = s.rlike(r"^[^@\s]+@[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$")
    known = tld.rlike("^[a-z]{2}$") | tld.isin(*LONG_TLDS)
    return shape & F.length(local).between(1, 64) & (F.length(domain) <= 253) & ~local.rlike(r"^\.|\.$|\.\.") & known


def cusip(c: Column) -> Column:
    s = only_alnum(c)
    v = F.transform(F.slice(letters36(s), 1, 8), lambda x, i: F.when(i % 2 == 1, x * 2).otherwise(x))
    digit_sum = total(F.transform(v, lambda x: F.floor(x / 10).cast("int") + x % 10))
    return s.rlike("^[0-9A-Z]{8}[0-9]$") & ((10 - digit_sum % 10) % 10 == F.substring(s, 9, 1).try_cast("int"))


def sedol(c: Column) -> Column:
    s = only_alnum(c)
    return s.rlike("^[0-9B-DF-HJ-NP-TV-Z]{6}[0-9]$") & ((10 - weighted(letters36(s), [1, 3, 1, 7, 3, 9]) % 10) % 10 == F.substring(s, 7, 1).try_cast("int"))


def isin(c: Column) -> Column:
    s = only_alnum(c)
    return s.rlike("^[A-Z]{2}[0-9A-Z]{9}[0-9]$") & (luhn_sum(expanded(s)) % 10 == 0)


def lei(c: Column) -> Column:
    s = only_alnum(c)
    return s.rlike("^[0-9A-Z]{18}[0-9]{2}$") & (mod_string(expanded(s), 97) == 1)


def uli(c: Column) -> Column:
    s = only_alnum(c)
    return s.rlike("^[0-9A-Z]{23,45}$") & (mod_string(expanded(s), 97) == 1)


#: Lengths of international bank account numbers by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()


def iban(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    sizes = F.create_map(*[F.lit(x) for e in IBAN_LENGTHS for x in (e[:2], int(e[2:]))])
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & F.coalesce(F.try_element_at(sizes, F.substring(s, 1, 2)) == F.length(s), F.lit(False)) & (mod_string(expanded(F.when(s.rlike("^[A-Z0-9]*$"), turned).otherwise(F.lit(""))), 97) == 1)


#: Country codes, and words that look like a code.
SWIFT_COUNTRIES = "AD AE AF AG AI AL AM AO AR AT AU AZ BA BB BD BE BF BG BH BI BJ BM BN BO BR BS BT BW BY BZ CA CD CG CH CI CL CM CN CO CR CU CV CY CZ DE DJ DK DM DO DZ EC EE EG ER ES ET FI FJ FR GA GB GD GE GH GI GM GN GQ GR GT GW GY HK HN HR HT HU ID IE IL IN IQ IR IS IT JM JO JP KE KG KH KM KN KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MG MK ML MM MN MO MR MT MU MV MW MX MY MZ NA NE NG NI NL NO NP NZ OM PA PE PG PH PK PL PT PY QA RO RS RU RW SA SB SC SD SE SG SI SK SL SM SN SO SR SV SY SZ TD TG TH TJ TL TM TN TO TR TT TW TZ UA UG US UY UZ VA VC VE VN VU WS XK YE ZA ZM ZW".split()
SWIFT_WORDS = "DEADBEEF CAFEBABE BUSINESS PRODUCTS SERVICES DOCUMENT RESEARCH ANALYSIS TRAINING SECURITY PERSONAL CUSTOMER".split()


def swift(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    return s.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$") & F.substring(s, 5, 2).isin(*SWIFT_COUNTRIES) & ~F.substring(s, 1, 8).isin(*SWIFT_WORDS)


def tfn(c: Column) -> Column:
    d = only_digits(c)
    nine, eight = weighted(cells(d), [1, 4, 3, 7, 5, 8, 6, 9, 10]), weighted(cells(d), [10, 7, 8, 4, 6, 3, 5, 1])
    return not_same(d) & ((sized(d, 9) & (nine % 11 == 0)) | (sized(d, 8) & (eight % 11 == 0)))


def sin(c: Column) -> Column:
    d = only_digits(c)
    return sized(d, 9) & not_same(d) & ~F.substring(d, 1, 1).isin("0", "8") & (luhn_sum(d) % 10 == 0)


def us_phone(c: Column) -> Column:
    raw = only_digits(c)
    d = F.when((F.length(raw) == 11) & raw.startswith("1"), F.substring(raw, 2, 10)).otherwise(raw)
    area, exchange, line = F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)
    return d.rlike("^[2-9][0-9]{2}[1-9][0-9]{6}$") & ~area.endswith("11") & ~exchange.endswith("11") & not_same(line) & ~((exchange == "555") & line.startswith("01"))


def plausible_phone(c: Column) -> Column:
    d = only_digits(c)
    n = F.length(d)
    a = cells(d)
    longest = F.aggregate(
        a, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"], s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["best"], F.when(x == s["last"], s["run"] + 1).otherwise(1)).alias("best")),
        lambda s: s["best"],
    )
    rising = F.lit("01234567890123456789").contains(d) | F.lit("98765432109876543210").contains(d)
    return n.between(8, 15) & not_same(d) & (longest < n / 2) & ~rising


#: Country code and the least and largest number of digits behind it.
E164_PLANS = "7:10-10 20:8-10 27:9-9 30:10-10 31:9-9 32:8-9 33:9-9 34:9-9 36:8-9 39:6-11 40:9-9 41:9-9 43:4-13 44:9-10 45:8-8 46:7-9 47:8-8 48:9-9 49:6-11 51:8-9 52:10-10 54:10-11 55:10-11 56:9-9 57:10-10 60:8-10 61:9-9 62:8-12 63:10-10 64:8-10 65:8-8 66:8-9 81:9-10 82:8-10 84:9-10 86:10-11 90:10-10 91:10-10 92:9-10 351:9-9 353:7-9 358:5-10 380:9-9 420:9-9 852:8-8 966:8-9 971:8-9 972:8-9".split()


def e164(c: Column) -> Column:
    """A plus sign, a known country code and a subscriber number of that code's length (NANP rules for +1)."""
    s, d = F.coalesce(c, F.lit("")), only_digits(c)
    ok = F.lit(False)
    for plan in E164_PLANS:
        code, span = plan.split(":")
        low, high = map(int, span.split("-"))
        ok = ok | (d.startswith(code) & (F.length(d) - len(code)).between(low, high))
    nanp = d.startswith("1") & (F.length(d) == 11) & us_phone(d) & (F.substring(d, 2, 3) != "555")
    return s.startswith("+") & plausible_phone(c) & (ok | nanp)


def dea(c: Column) -> Column:
    s = only_alnum(c)
    d = cells(F.substring(s, 3, 7))
    check = weighted(d, [1, 0, 1, 0, 1]) + 2 * weighted(d, [0, 1, 0, 1, 0, 1])
    return s.rlike("^[ABCDEFGHJKLMPRX][A-Z0-9][0-9]{7}$") & (check % 10 == F.substring(s, 9, 1).try_cast("int"))


def iccid(c: Column) -> Column:
    d = only_digits(c)
    return F.length(d).between(18, 20) & d.startswith("89") & (luhn_sum(d) % 10 == 0)


def medicare_au(c: Column) -> Column:
    d = only_digits(c)
    return sized(d, 10, 11) & d.rlike("^[2-6]") & (weighted(cells(d), [1, 3, 7, 9, 1, 3, 7, 9]) % 10 == F.substring(d, 9, 1).try_cast("int"))


def pan_in(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("^[A-Z]{3}[PCHABGJLFT][A-Z][0-9]{4}[A-Z]$")


def za_id(c: Column) -> Column:
    d = only_digits(c)
    return sized(d, 13) & between(d, 3, 2, 1, 12) & between(d, 5, 2, 1, 31) & between(d, 11, 1, 0, 1) & (luhn_sum(d) % 10 == 0)


def mers_min(c: Column) -> Column:
    d = only_digits(c)
    return sized(d, 18) & not_same(d) & (luhn_sum(d) % 10 == 0)


def imad(c: Column) -> Column:
    s = only_alnum(c)
    return s.rlike("^[0-9]{8}[0-9A-Z]{18}$") & between(s, 1, 4, 1990, 2099) & between(s, 5, 2, 1, 12) & between(s, 7, 2, 1, 31)


def vin(c: Column) -> Column:
    s = only_alnum(c)
    plain = F.translate(s, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    remainder = weighted(cells(F.when(plain.rlike("^[0-9]{17}$"), plain).otherwise("")), [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    mark = F.when(remainder == 10, F.lit("X")).otherwise(remainder.cast("string"))
    return s.rlike("^[0-9A-HJ-NPR-Z]{17}$") & not_same(s) & (mark == F.substring(s, 9, 1))


def ipv4(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    p = [F.split_part(s, F.lit("."), F.lit(i)).try_cast("int") for i in range(1, 5)]
    shape = s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    a, b, d3 = p[0], p[1], p[2]
    reserved = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & d3.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (d3 == 100)) | ((a == 203) & (b == 0) & (d3 == 113))
    )
    return F.coalesce(shape & (p[0] <= 255) & (p[1] <= 255) & (p[2] <= 255) & (p[3] <= 255) & ~reserved, F.lit(False))


def ipv6(c: Column) -> Column:
    """Public addresses; the compressed and the full writing, no embedded IPv4."""
    s = F.lower(F.substring_index(F.coalesce(c, F.lit("")), "%", 1))
    full = s.rlike("^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$")
    parts = F.size(F.filter(F.split(s, ":"), lambda x: x != ""))
    short = s.rlike("^[0-9a-f:]+$") & (F.length(s) - F.length(F.replace(s, F.lit("::"), F.lit(""))) == 2) & ~s.contains(":::") & (parts <= 7) & ~s.rlike("[0-9a-f]{5}") & ~s.rlike("^:[^:]|[^:]:$")
    first = F.conv(F.split_part(s, F.lit(":"), F.lit(1)), 16, 10).try_cast("int")
    second = F.conv(F.split_part(s, F.lit(":"), F.lit(2)), 16, 10).try_cast("int")
    blocked = s.isin("::", "::1") | first.between(0xFE80, 0xFEBF) | first.between(0xFC00, 0xFDFF) | (first >= 0xFF00) | ((first == 0x2001) & (second == 0xDB8)) | ((first == 0x64) & (second == 0xFF9B))
    return (full | short) & ~F.coalesce(blocked, F.lit(False))


def mac(c: Column) -> Column:
    h = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Fa-f]", ""))
    return sized(h, 12) & ~h.isin("0" * 12, "f" * 12)


def gps(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    lat, lon = F.split_part(s, F.lit(","), F.lit(1)).try_cast("double"), F.split_part(s, F.lit(","), F.lit(2)).try_cast("double")
    return F.coalesce(s.rlike(r"^-?[0-9.]+,-?[0-9.]+$") & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def char_entropy(c: Column) -> Column:
    """Shannon entropy of a string in bits per character; 0 for null and empty."""
    chars = F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    n = F.greatest(F.size(chars), F.lit(1))
    shares = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


#: Words that stand for a secret without being one.
PLACEHOLDERS = "example sample test dummy placeholder changeme your_token your_api_key xxxxxxxx password secret token undefined null none redacted".split()


def bearer(c: Column) -> Column:
    token = F.regexp_replace(F.coalesce(c, F.lit("")), r"^(?i:bearer)\s+", "")
    return (F.octet_length(token) >= 16) & ~F.lower(token).isin(*PLACEHOLDERS)


def url_token(c: Column) -> Column:
    value = F.regexp_extract(F.substring_index(F.coalesce(c, F.lit("")), "=", -1), "^[^&#]*", 0)
    return F.coalesce(c, F.lit("")).contains("=") & (F.octet_length(value) >= 8) & ~F.lower(value).isin(*PLACEHOLDERS)


def slack_webhook(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^https://hooks\.slack\.com/services/T[A-Za-z0-9]{8,}/B[A-Za-z0-9]{8,}/[A-Za-z0-9]{16,}/?$")


def assigned_value(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"[:=]\s*(.*)$", 1), "[\"'\\s]", "")


def api_key(c: Column) -> Column:
    v = assigned_value(c)
    return (F.length(v) >= 16) & ~F.lower(v).isin(*PLACEHOLDERS) & (char_entropy(v) >= 3.0)


def secret_assignment(c: Column) -> Column:
    v = assigned_value(c)
    return (F.length(v) >= 12) & ~F.lower(v).isin(*PLACEHOLDERS) & (char_entropy(v) >= 2.5)


def bsn(c: Column) -> Column:
    d = only_digits(c)
    nine = F.lpad(d, 9, "0")
    s = weighted(cells(nine), [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return sized(d, 8, 9) & (s >= 0) & (s % 11 == 0)


def cpf(c: Column) -> Column:
    d = only_digits(c)
    a = cells(d)
    one, two = weighted(a, list(range(10, 1, -1))) * 10 % 11 % 10, weighted(a, list(range(11, 1, -1))) * 10 % 11 % 10
    return sized(d, 11) & not_same(d) & (one == F.substring(d, 10, 1).try_cast("int")) & (two == F.substring(d, 11, 1).try_cast("int"))


def cnpj(c: Column) -> Column:
    d = only_digits(c)
    a = cells(d)
    check = lambda w: F.when(weighted(a, w) % 11 < 2, 0).otherwise(11 - weighted(a, w) % 11)
    one, two = check([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]), check([6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
    return sized(d, 14) & not_same(d) & (one == F.substring(d, 13, 1).try_cast("int")) & (two == F.substring(d, 14, 1).try_cast("int"))


def aba(c: Column) -> Column:
    d = only_digits(c)
    head = F.substring(d, 1, 2).try_cast("int")
    return sized(d, 9) & not_same(d) & (head.between(0, 12) | head.between(21, 32) | head.between(61, 72) | (head == 80)) & (weighted(cells(d), [3, 7, 1] * 3) % 10 == 0)


def nrn(c: Column) -> Column:
    d = only_digits(c)
    n, check = F.substring(d, 1, 9).try_cast("bigint"), F.substring(d, 10, 2).try_cast("bigint")
    return sized(d, 11) & between(d, 3, 2, 1, 12) & between(d, 5, 2, 1, 31) & ((97 - n % 97 == check) | (97 - (n + 2_000_000_000) % 97 == check))


def pesel(c: Column) -> Column:
    d = only_digits(c)
    month = F.substring(d, 3, 2).try_cast("int") % 20
    return sized(d, 11) & month.between(1, 12) & between(d, 5, 2, 1, 31) & ((10 - weighted(cells(d), [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == F.substring(d, 11, 1).try_cast("int"))


#: The rotation of the Verhoeff scheme and its group table.
VERHOEFF_TURN = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def verhoeff_tables() -> tuple[list[int], list[int]]:
    """Flat 10 x 10 product table of the dihedral group and flat 8 x 10 table of repeated rotation."""
    product = [((a + b) % 5 if b < 5 else 5 + (a + b) % 5) if a < 5 else (5 + (a - b) % 5 if b < 5 else (a - b) % 5) for a in range(10) for b in range(10)]
    turns, row = [], list(range(10))
    for _ in range(8):
        turns += row
        row = [VERHOEFF_TURN[x] for x in row]
    return product, turns


def aadhaar(c: Column) -> Column:
    d = only_digits(c)
    product, turns = (F.array(*[F.lit(x) for x in t]) for t in verhoeff_tables())
    turned = F.transform(cells(F.reverse(d)), lambda x, i: F.element_at(turns, (i % 8 * 10 + x + 1).cast("int")))
    return d.rlike("^[2-9][0-9]{11}$") & not_same(d) & (F.aggregate(turned, F.lit(0), lambda s, x: F.element_at(product, s * 10 + x + 1)) == 0)


def my_number(c: Column) -> Column:
    d = only_digits(c)
    r = weighted(cells(d), [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return sized(d, 12) & (F.when(r <= 1, 0).otherwise(11 - r) == F.substring(d, 12, 1).try_cast("int"))


#: Odd-place values of the Italian tax code for 0-9 and A-Z.
CODICE_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def codice_fiscale(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    odd = F.array(*[F.lit(x) for x in CODICE_ODD])
    value = lambda x, i: F.when(i % 2 == 0, F.element_at(odd, x + 1)).when(x >= 10, x - 10).otherwise(x)
    check = total(F.transform(F.slice(letters36(s), 1, 15), value)) % 26
    return s.rlike("^[A-Z0-9]{15}[A-Z]$") & (F.char(check + 65) == F.substring(s, 16, 1))


def dni(c: Column) -> Column:
    s = only_alnum(c)
    number = F.concat(F.translate(F.substring(s, 1, 1), "XYZ", "012"), F.substring(s, 2, 7)).try_cast("bigint")
    return s.rlike("^[XYZ0-9][0-9]{7}[A-Z]$") & (F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (number % 23 + 1).cast("int"), F.lit(1)) == F.substring(s, 9, 1))


def teudat(c: Column) -> Column:
    d = only_digits(c)
    return sized(d, 9) & not_same(d) & (luhn_sum(d) % 10 == 0)


def nhs(c: Column) -> Column:
    d = only_digits(c)
    check = 11 - weighted(cells(d), list(range(10, 1, -1))) % 11
    return sized(d, 10) & not_same(d) & (check != 10) & (check % 11 == F.substring(d, 10, 1).try_cast("int"))


def china_id(c: Column) -> Column:
    s = only_alnum(c)
    mark = F.substring(F.lit("10X98765432"), weighted(cells(F.substring(F.regexp_replace(s, "[^0-9]", "0"), 1, 17)), [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]) % 11 + 1, F.lit(1))
    return s.rlike("^[0-9]{17}[0-9X]$") & between(s, 7, 4, 1800, 2099) & between(s, 11, 2, 1, 12) & between(s, 13, 2, 1, 31) & (mark == F.substring(s, 18, 1))


def rrn(c: Column) -> Column:
    d = only_digits(c)
    check = (11 - weighted(cells(d), [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10
    return sized(d, 13) & not_same(d) & between(d, 3, 2, 1, 12) & between(d, 5, 2, 1, 31) & between(d, 7, 1, 1, 8) & (check == F.substring(d, 13, 1).try_cast("int"))


def nir(c: Column) -> Column:
    s = only_alnum(c)
    plain = F.replace(F.replace(s, F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    return s.rlike("^[0-9]{5}[0-9][0-9AB][0-9]{8}$") & (97 - F.substring(plain, 1, 13).try_cast("bigint") % 97 == F.substring(plain, 14, 2).try_cast("bigint"))


def curp(c: Column) -> Column:
    s = only_alnum(c)
    # letters behind N make room for one more: O .. Z count one higher than in base 36
    values = F.transform(F.slice(letters36(s), 1, 17), lambda x, i: F.when(x > 23, x + 1).otherwise(x) * (18 - i))
    return s.rlike("^[A-Z]{4}[0-9]{6}[HM][A-Z]{5}[0-9A-Z][0-9]$") & between(s, 7, 2, 1, 12) & between(s, 9, 2, 1, 31) & ((10 - total(values) % 10) % 10 == F.substring(s, 18, 1).try_cast("int"))


def personnummer(c: Column) -> Column:
    d = only_digits(c)
    return sized(d, 10) & not_same(d) & between(d, 3, 2, 1, 12) & between(d, 5, 2, 1, 31) & (luhn_sum(d) % 10 == 0)


def cpr(c: Column) -> Column:
    d = only_digits(c)
    return sized(d, 10) & not_same(d) & between(d, 1, 2, 1, 31) & between(d, 3, 2, 1, 12)


def cuil(c: Column) -> Column:
    d = only_digits(c)
    r = weighted(cells(d), [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return sized(d, 11) & F.substring(d, 1, 2).isin("20", "23", "24", "27", "30", "33", "34") & (r != 1) & (F.when(r == 0, 0).otherwise(11 - r) == F.substring(d, 11, 1).try_cast("int"))


def nric(c: Column) -> Column:
    """Singapore identity cards, of citizens (S, T) and foreigners (F, G)."""
    s = only_alnum(c)
    r = (weighted(cells(F.regexp_replace(F.substring(s, 2, 7), "[^0-9]", "0")), [2, 7, 6, 5, 4, 3, 2]) + F.when(F.substring(s, 1, 1).isin("T", "G"), 4).otherwise(0)) % 11
    table = F.when(F.substring(s, 1, 1).isin("S", "T"), F.lit("JZIHGFEDCBA")).otherwise(F.lit("XWUTRQPNMLK"))
    return s.rlike("^[STFG][0-9]{7}[A-Z]$") & (F.substring(table, r + 1, F.lit(1)) == F.substring(s, 9, 1))


def hkid(c: Column) -> Column:
    s = only_alnum(c)
    nine = F.when(F.length(s) == 8, F.concat(F.lit(" "), s)).otherwise(s)
    number = lambda x: F.conv(x, 36, 10).cast("int")
    # the pad counts 36, letters count from A = 1, the check mark counts from A = 10
    a = F.transform(F.filter(F.split(nine, ""), lambda x: x != ""), lambda x, i: F.when(x == " ", 36).when((number(x) > 9) & (i < 8), number(x) - 9).otherwise(number(x)))
    return s.rlike("^[A-Z]{1,2}[0-9]{6}[0-9A]$") & (weighted(a, [8, 7, 6, 5, 4, 3, 2, 1, 1]) % 11 == 0)


def npi(c: Column) -> Column:
    d = only_digits(c)
    return sized(d, 10) & not_same(d) & d.rlike("^[12]") & (luhn_sum(F.concat(F.lit("80840"), d)) % 10 == 0)


def emirates(c: Column) -> Column:
    d = only_digits(c)
    return sized(d, 15) & d.startswith("784") & (luhn_sum(d) % 10 == 0)


def steuer_id(c: Column) -> Column:
    d = only_digits(c)
    head = F.filter(F.split(F.substring(d, 1, 10), ""), lambda x: x != "")
    distinct = F.array_distinct(head)
    most = F.aggregate(distinct, F.lit(0), lambda s, x: F.greatest(s, F.size(F.filter(head, lambda y: y == x))))
    step = lambda p, x: F.when((p + x) % 10 == 0, 10).otherwise((p + x) % 10) * 2 % 11
    product = F.aggregate(cells(F.substring(d, 1, 10)), F.lit(10), step)
    return sized(d, 11) & not_same(d) & (F.size(distinct) >= 7) & (most <= 3) & ((11 - product) % 10 == F.substring(d, 11, 1).try_cast("int"))


def rut(c: Column) -> Column:
    s = only_alnum(c)
    body = F.substring(s, 1, F.length(s) - 1)
    back = F.transform(cells(F.reverse(F.regexp_replace(body, "[^0-9]", "0"))), lambda x, i: x * (i % 6 + 2))
    r = 11 - total(back) % 11
    mark = F.when(r == 11, F.lit("0")).when(r == 10, F.lit("K")).otherwise(r.cast("string"))
    return s.rlike("^[0-9]{7,8}[0-9K]$") & not_same(body) & (mark == F.right(s, F.lit(1)))


def micr(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[⑆-⑉]")


def ramq(c: Column) -> Column:
    s = only_alnum(c)
    return s.rlike("^[A-Z]{4}[0-9]{8}$") & (between(s, 7, 2, 1, 12) | between(s, 7, 2, 51, 62)) & between(s, 9, 2, 1, 31)


#: Sub-category to predicate; sub-categories without an entry accept every match.
BY_SUB_CATEGORY: dict[str, Predicate] = {
    "Visa": luhn, "MasterCard": luhn, "Amex": luhn, "Discover": luhn, "JCB": luhn, "Diners Club": luhn, "UnionPay": luhn, "PAN": luhn, "IMEI": luhn,
    "USA SSN": ssn, "Email Address": email, "EDU Email": email, "SWIFT/BIC": swift, "CUSIP": cusip, "SEDOL": sedol, "Australia TFN": tfn, "IBAN Generic": iban, "Canada SIN": sin, "ISIN": isin,
    "UK Phone Number": plausible_phone, "E.164 Phone Number": e164, "US Phone Number": us_phone, "DEA Number": dea, "ICCID": iccid, "LEI": lei, "Australia Medicare": medicare_au, "India PAN": pan_in,
    "South Africa ID": za_id, "MERS MIN": mers_min, "Fedwire IMAD": imad, "Universal Loan Identifier": uli, "VIN": vin, "IPv4 Address": ipv4, "IPv6 Address": ipv6, "MAC Address": mac, "GPS Coordinates": gps,
    "Bearer Token": bearer, "URL with Token": url_token, "Slack Webhook": slack_webhook, "Generic API Key": api_key, "Generic Secret Assignment": secret_assignment, "Netherlands BSN": bsn, "Brazil CPF": cpf,
    "ABA Routing Number": aba, "USA Routing Number": aba, "Belgium NRN": nrn, "Poland PESEL": pesel, "India Aadhaar": aadhaar, "Japan My Number": my_number, "Italy Codice Fiscale": codice_fiscale, "Italy SSN": codice_fiscale,
    "Spain DNI": dni, "Israel Teudat Zehut": teudat, "British NHS": nhs, "Brazil CNPJ": cnpj, "China Resident ID": china_id, "South Korea RRN": rrn, "France NIR": nir, "Mexico CURP": curp, "Sweden PIN": personnummer,
    "Denmark CPR": cpr, "Argentina CUIL/CUIT": cuil, "Singapore NRIC": nric, "Singapore FIN": nric, "Hong Kong ID": hkid, "US NPI": npi, "UAE Emirates ID": emirates, "Germany Tax ID": steuer_id, "Chile RUN/RUT": rut,
    "MICR Line": micr, "Quebec HC": ramq,
}


def structural(sub_category: Column, value: Column) -> Column:
    """Whether a match passes its sub-category's validator; true where there is none."""
    out = None
    for name, predicate in BY_SUB_CATEGORY.items():
        out = (F if out is None else out).when(sub_category == name, predicate(value))
    return F.coalesce(out.otherwise(F.lit(True)), F.lit(False))
