"""The structural checks for single values, for use inside the Arrow scan stage on the few matches it finds.

Same definitions as the Column predicates in ``validators``; ``tests/test_validators.py`` holds them together.
"""

from __future__ import annotations

import base64
import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Callable

from veilframe.functions.validators import CODICE_ODD, E164_PLANS, SWIFT_COUNTRIES, SWIFT_WORDS, IBAN_LENGTHS, LONG_TLDS, PLACEHOLDERS, verhoeff_tables

PRODUCT, TURNS = verhoeff_tables()
PHONE_PLANS = [(p.partition(":")[0], *map(int, p.partition(":")[2].split("-"))) for p in E164_PLANS]
LENGTHS = {x[:2]: int(x[2:]) for x in IBAN_LENGTHS}


def digits(s: str) -> list[int]:
    return [int(c) for c in s if c in "0123456789"]


def alnum(s: str) -> str:
    return re.sub("[^0-9A-Za-z]", "", s).upper()


def dot(d: list[int], weights: list[int]) -> int:
    return sum(a * b for a, b in zip(d, weights))


def luhn_ok(d: list[int]) -> bool:
    return bool(d) and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def varied(d: list[int]) -> bool:
    return len(set(d)) > 1


def whole(d: list[int], a: int, b: int) -> int:
    return int("".join(map(str, d[a:b])) or 0)


def month_day(d: list[int], at: int) -> bool:
    return 1 <= whole(d, at, at + 2) <= 12 and 1 <= whole(d, at + 2, at + 4) <= 31


def spelled(s: str) -> str:
    return "".join(str(int(c, 36)) for c in s)


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def luhn(s: str) -> bool:
    d = digits(s)
    return len(d) >= 12 and varied(d) and luhn_ok(d)


def ssn(s: str) -> bool:
    t = "".join(map(str, digits(s)))
    return len(t) == 9 and t[:3] not in ("000", "666") and t[0] != "9" and t[3:5] != "00" and t[5:] != "0000" and len(set(t)) > 1 and t not in ("123456789", "987654321", "012345678", "876543210", "078051120")


def email(s: str) -> bool:
    local, _, host = s.rpartition("@")
    labels = host.split(".")
    tld = labels[-1].lower()
    return (
        s.count("@") == 1 and 1 <= len(local) <= 64 and len(host) <= 253 and len(labels) > 1 and not local.startswith(".") and not local.endswith(".") and ".." not in local
        and all(re.fullmatch("[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?", x) for x in labels) and (bool(re.fullmatch("[a-z]{2}", tld)) or tld in LONG_TLDS)
    )


def iban(s: str) -> bool:
    s = re.sub(r"\s", "", s)
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and LENGTHS.get(s[:2]) == len(s) and int(spelled(s[4:] + s[:4])) % 97 == 1


def mod97(s: str, low: int, high: int) -> bool:
    s = alnum(s)
    return low <= len(s) <= high and int(spelled(s)) % 97 == 1


def cusip(s: str) -> bool:
    s = alnum(s)
    return len(s) == 9 and s[8].isdigit() and -sum(sum(divmod(int(c, 36) * (1 + i % 2), 10)) for i, c in enumerate(s[:8])) % 10 == int(s[8])


def sedol(s: str) -> bool:
    s = alnum(s)
    return bool(re.fullmatch("[0-9B-DF-HJ-NP-TV-Z]{6}[0-9]", s)) and -dot([int(c, 36) for c in s], [1, 3, 1, 7, 3, 9]) % 10 == int(s[6])


def figi(s: str) -> bool:
    """Check digit over the values of all characters, every second one doubled. Not applied by the catalogue, as issued codes are looked up."""
    s = alnum(s)
    return bool(re.fullmatch("[B-DF-HJ-NP-TV-Z0-9]{2}G[B-DF-HJ-NP-TV-Z0-9]{8}[0-9]", s)) and s[:2] not in ("BS", "BM", "GG", "GB", "GH", "KY", "VG") and -sum(sum(divmod(int(c, 36) * (1 + i % 2), 10)) for i, c in enumerate(s[:11])) % 10 == int(s[11])


def isin(s: str) -> bool:
    s = alnum(s)
    return bool(re.fullmatch("[A-Z]{2}[0-9A-Z]{9}[0-9]", s)) and luhn_ok(digits(spelled(s)))


def tfn(s: str) -> bool:
    d = digits(s)
    return varied(d) and ((len(d) == 9 and dot(d, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0) or (len(d) == 8 and dot(d, [10, 7, 8, 4, 6, 3, 5, 1]) % 11 == 0))


def sin(s: str) -> bool:
    d = digits(s)
    return len(d) == 9 and varied(d) and d[0] not in (0, 8) and luhn_ok(d)


def us_phone(s: str) -> bool:
    t = "".join(map(str, digits(s)))
    t = t[1:] if len(t) == 11 and t[0] == "1" else t
    return bool(re.fullmatch("[2-9][0-9]{2}[1-9][0-9]{6}", t)) and t[1:3] != "11" and t[4:6] != "11" and len(set(t[6:])) > 1 and not (t[3:6] == "555" and t[6:8] == "01")


def plausible_phone(s: str) -> bool:
    t = "".join(map(str, digits(s)))
    longest = max((len(m.group()) for m in re.finditer(r"(.)\1*", t)), default=0)
    return 8 <= len(t) <= 15 and len(set(t)) > 1 and longest < len(t) / 2 and t not in "01234567890123456789" and t not in "98765432109876543210"


def e164(s: str) -> bool:
    t = "".join(map(str, digits(s)))
    if not s.startswith("+") or not plausible_phone(s):
        return False
    if t[0] == "1":
        return len(t) == 11 and us_phone(t) and t[1:4] != "555"
    return any(t.startswith(code) and low <= len(t) - len(code) <= high for code, low, high in PHONE_PLANS)


def dea(s: str) -> bool:
    d = digits(alnum(s)[2:])
    return len(d) == 7 and (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


def vin(s: str) -> bool:
    s = alnum(s)
    plain = s.translate(str.maketrans("ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"))
    return len(s) == 17 and len(set(s)) > 1 and plain.isdigit() and "0123456789X"[dot(digits(plain), [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11] == s[8]


def public_ip(s: str) -> bool:
    try:
        a = ipaddress.ip_address(s.split("%")[0])
    except ValueError:
        return False
    return a.is_global and not a.is_multicast


def mac(s: str) -> bool:
    h = re.sub("[^0-9a-f]", "", s.lower())
    return len(h) == 12 and len(set(h)) > 1 or h not in ("0" * 12, "f" * 12) and len(h) == 12


def gps(s: str) -> bool:
    lat, _, lon = s.replace(" ", "").partition(",")
    try:
        return abs(float(lat)) <= 90 and abs(float(lon)) <= 180 and (float(lat), float(lon)) != (0, 0)
    except ValueError:
        return False


def assigned(s: str, least: int, bits: float) -> bool:
    m = re.search(r"[:=]\s*(.*)$", s)
    v = re.sub("[\"'\\s]", "", m.group(1)) if m else ""
    return len(v) >= least and v.lower() not in PLACEHOLDERS and entropy(v) >= bits


def bsn(s: str) -> bool:
    d = digits(s)
    d = [0] * (9 - len(d)) + d
    total = dot(d, [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return len(digits(s)) in (8, 9) and total >= 0 and total % 11 == 0


def cpf(s: str) -> bool:
    d = digits(s)
    return len(d) == 11 and varied(d) and all(dot(d, list(range(n + 1, 1, -1))) * 10 % 11 % 10 == d[n] for n in (9, 10))


def cnpj(s: str) -> bool:
    d = digits(s)
    w = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    check = lambda n: 0 if (r := dot(d, w[13 - n :]) % 11) < 2 else 11 - r
    return len(d) == 14 and varied(d) and check(12) == d[12] and check(13) == d[13]


def aba(s: str) -> bool:
    d = digits(s)
    head = whole(d, 0, 2)
    return len(d) == 9 and varied(d) and (head <= 12 or 21 <= head <= 32 or 61 <= head <= 72 or head == 80) and dot(d, [3, 7, 1] * 3) % 10 == 0


def nrn(s: str) -> bool:
    d = digits(s)
    return len(d) == 11 and month_day(d, 2) and whole(d, 9, 11) in (97 - whole(d, 0, 9) % 97, 97 - (2_000_000_000 + whole(d, 0, 9)) % 97)


def pesel(s: str) -> bool:
    d = digits(s)
    return len(d) == 11 and 1 <= whole(d, 2, 4) % 20 <= 12 and 1 <= whole(d, 4, 6) <= 31 and dot(d, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1]) % 10 == 0


def aadhaar(s: str) -> bool:
    d = digits(s)
    state = 0
    for i, x in enumerate(reversed(d)):
        state = PRODUCT[state * 10 + TURNS[i % 8 * 10 + x]]
    return len(d) == 12 and d[0] > 1 and varied(d) and state == 0


def my_number(s: str) -> bool:
    d = digits(s)
    r = dot(d, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return len(d) == 12 and (0 if r <= 1 else 11 - r) == d[11]


def codice(s: str) -> bool:
    value = lambda i, c: CODICE_ODD[int(c, 36)] if i % 2 == 0 else int(c, 36) % 10 if c.isdigit() else int(c, 36) - 10
    return bool(re.fullmatch("[A-Z0-9]{15}[A-Z]", s)) and chr(65 + sum(value(i, c) for i, c in enumerate(s[:15])) % 26) == s[15]


def dni(s: str) -> bool:
    s = alnum(s)
    s = s[:1].translate(str.maketrans("XYZ", "012")) + s[1:]
    return bool(re.fullmatch("[0-9]{8}[A-Z]", s)) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[8]


def nhs(s: str) -> bool:
    d = digits(s)
    return len(d) == 10 and varied(d) and dot(d, list(range(10, 0, -1))) % 11 == 0


def china(s: str) -> bool:
    s = alnum(s)
    return bool(re.fullmatch("[0-9]{17}[0-9X]", s)) and 1800 <= int(s[6:10]) <= 2099 and month_day(digits(s), 10) and "10X98765432"[dot(digits(s[:17]), [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]) % 11] == s[17]


def rrn(s: str) -> bool:
    d = digits(s)
    return len(d) == 13 and varied(d) and month_day(d, 2) and 1 <= d[6] <= 8 and (11 - dot(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == d[12]


def nir(s: str) -> bool:
    s = alnum(s).replace("2A", "19").replace("2B", "18")
    return len(s) == 15 and s.isdigit() and 97 - int(s[:13]) % 97 == int(s[13:])


def curp(s: str) -> bool:
    s = alnum(s)
    value = lambda c: int(c, 36) + (int(c, 36) > 23)
    return bool(re.fullmatch("[A-Z]{4}[0-9]{6}[HM][A-Z]{5}[0-9A-Z][0-9]", s)) and 1 <= int(s[6:8]) <= 12 and 1 <= int(s[8:10]) <= 31 and -sum(value(c) * (18 - i) for i, c in enumerate(s[:17])) % 10 == int(s[17])


def cuil(s: str) -> bool:
    d = digits(s)
    r = dot(d, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return len(d) == 11 and whole(d, 0, 2) in (20, 23, 24, 27, 30, 33, 34) and r != 1 and (11 - r) % 11 == d[10]


def nric(s: str) -> bool:
    s = alnum(s)
    if not re.fullmatch("[STFG][0-9]{7}[A-Z]", s):
        return False
    return ("JZIHGFEDCBA" if s[0] in "ST" else "XWUTRQPNMLK")[(dot(digits(s[1:8]), [2, 7, 6, 5, 4, 3, 2]) + 4 * (s[0] in "TG")) % 11] == s[8]


def hkid(s: str) -> bool:
    s = alnum(s)
    return bool(re.fullmatch("[A-Z]{1,2}[0-9]{6}[0-9A]", s)) and dot([36] * (9 - len(s)) + [ord(c) - 64 if c.isalpha() else int(c) for c in s[:-1]], [8, 7, 6, 5, 4, 3, 2, 1]) % 11 == -int(s[-1], 36) % 11


def steuer(s: str) -> bool:
    d = digits(s)
    product = 10
    for x in d[:10]:
        product = ((product + x) % 10 or 10) * 2 % 11
    return len(d) == 11 and len(set(d[:10])) >= 7 and max(Counter(d[:10]).values()) <= 3 and (11 - product) % 10 == d[10]


def rut(s: str) -> bool:
    s = alnum(s)
    if not re.fullmatch("[0-9]{7,8}[0-9K]", s) or len(set(s[:-1])) == 1:
        return False
    return "0123456789K0"[11 - sum(int(c) * (i % 6 + 2) for i, c in enumerate(reversed(s[:-1]))) % 11] == s[-1]


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
RIPPLE58 = "rpshnaf39wBUDNEGHJKLM4PQRST7VWXYZ2bcdeCg65jkm8oFqi1tuvAxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def base58check(s: str, versions: tuple[int, ...], alphabet: str = BASE58) -> bool:
    n = 0
    for c in s:
        if c not in alphabet:
            return False
        n = n * 58 + alphabet.index(c)
    raw = n.to_bytes(25, "big") if n < 1 << 200 else b""
    return len(raw) == 25 and raw[0] in versions and hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def bech32(s: str) -> bool:
    if s.lower() != s and s.upper() != s:
        return False
    human, _, data = s.lower().rpartition("1")
    if not human or any(c not in BECH32 for c in data):
        return False
    chk = 1
    for v in [*(ord(c) >> 5 for c in human), 0, *(ord(c) & 31 for c in human), *(BECH32.index(c) for c in data)]:
        top = chk >> 25
        chk = (chk & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            chk ^= g if top >> i & 1 else 0
    return chk in (1, 0x2BC830A3)


def swift(s: str) -> bool:
    return bool(re.fullmatch("[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", s)) and s[4:6] in SWIFT_COUNTRIES and s[:8] not in SWIFT_WORDS


def cash_address(s: str) -> bool:
    """Base-32 body with a 40-bit checksum over the prefix and the body."""
    body = s.lower().rpartition(":")[2]
    if len(body) != 42 or any(c not in BECH32 for c in body):
        return False
    chk = 1
    for v in [*(ord(c) & 31 for c in "bitcoincash"), 0, *(BECH32.index(c) for c in body)]:
        top = chk >> 35
        chk = (chk & 0x07FFFFFFFF) << 5 ^ v
        for i, g in enumerate((0x98F2BC8E61, 0x79B76D99E2, 0xF33E5FB3C4, 0xAE2EABE2A8, 0x1E4F43E470)):
            chk ^= g if top >> i & 1 else 0
    return chk == 1 or chk ^ 1 == 0


def jwt(s: str) -> bool:
    head = s.split(".")[0]
    try:
        return base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)).startswith(b"{")
    except ValueError:
        return False


LUHN_AT = {"ICCID": lambda d: 18 <= len(d) <= 20 and d[:2] == [8, 9], "MERS MIN": lambda d: len(d) == 18 and varied(d), "Israel Teudat Zehut": lambda d: len(d) == 9 and varied(d), "UAE Emirates ID": lambda d: len(d) == 15 and d[:3] == [7, 8, 4], "Sweden PIN": lambda d: len(d) == 10 and varied(d) and month_day(d, 2), "South Africa ID": lambda d: len(d) == 13 and month_day(d, 2) and d[10] <= 1}

CHECKS: dict[str, Callable[[str], bool]] = {
    **dict.fromkeys(("Visa", "MasterCard", "Amex", "Discover", "JCB", "Diners Club", "UnionPay", "PAN", "IMEI"), luhn),
    **{name: (lambda s, shape=shape: shape(digits(s)) and luhn_ok(digits(s))) for name, shape in LUHN_AT.items()},
    "USA SSN": ssn, "Email Address": email, "EDU Email": email, "CUSIP": cusip, "SEDOL": sedol, "Australia TFN": tfn, "IBAN Generic": iban, "Canada SIN": sin, "ISIN": isin, "UK Phone Number": plausible_phone, "E.164 Phone Number": e164,
    "US Phone Number": us_phone, "DEA Number": dea, "LEI": lambda s: mod97(s, 20, 20), "Universal Loan Identifier": lambda s: mod97(s, 23, 45), "VIN": vin, "IPv4 Address": public_ip, "IPv6 Address": public_ip, "MAC Address": mac, "GPS Coordinates": gps,
    "Bearer Token": lambda s: len(re.sub(r"(?i)^bearer\s+", "", s)) >= 16 and re.sub(r"(?i)^bearer\s+", "", s).lower() not in PLACEHOLDERS, "URL with Token": lambda s: len(re.split("[&#]", s.rpartition("=")[2])[0]) >= 8 and s.rpartition("=")[2].lower() not in PLACEHOLDERS,
    "Generic API Key": lambda s: assigned(s, 16, 3.0), "Generic Secret Assignment": lambda s: assigned(s, 12, 2.5), "Netherlands BSN": bsn, "Brazil CPF": cpf, "ABA Routing Number": aba, "USA Routing Number": aba, "Belgium NRN": nrn, "Poland PESEL": pesel,
    "India Aadhaar": aadhaar, "Japan My Number": my_number, "Italy Codice Fiscale": codice, "Italy SSN": codice, "Spain DNI": dni, "British NHS": nhs, "Brazil CNPJ": cnpj, "China Resident ID": china, "South Korea RRN": rrn, "France NIR": nir, "Mexico CURP": curp,
    "Denmark CPR": lambda s: len(d := digits(s)) == 10 and varied(d) and 1 <= whole(d, 0, 2) <= 31 and 1 <= whole(d, 2, 4) <= 12, "Argentina CUIL/CUIT": cuil, "Singapore NRIC": nric, "Singapore FIN": nric, "Hong Kong ID": hkid,
    "US NPI": lambda s: len(d := digits(s)) == 10 and varied(d) and d[0] in (1, 2) and luhn_ok([8, 0, 8, 4, 0, *d]), "Germany Tax ID": steuer, "Chile RUN/RUT": rut, "India PAN": lambda s: bool(re.fullmatch("[A-Z]{3}[PCHABGJLFT][A-Z][0-9]{4}[A-Z]", s)),
    "SWIFT/BIC": swift,
    "Fedwire IMAD": lambda s: len(t := alnum(s)) == 26 and t[:8].isdigit() and 1990 <= int(t[:4]) <= 2099 and month_day(digits(t), 4), "Slack Webhook": lambda s: bool(re.fullmatch(r"https://hooks\.slack\.com/services/T[A-Za-z0-9]{8,}/B[A-Za-z0-9]{8,}/[A-Za-z0-9]{16,}/?", s)),
    "Australia Medicare": lambda s: len(d := digits(s)) in (10, 11) and 2 <= d[0] <= 6 and dot(d, [1, 3, 7, 9, 1, 3, 7, 9]) % 10 == d[8], "Quebec HC": lambda s: bool(re.fullmatch("[A-Z]{4}[0-9]{8}", t := alnum(s))) and (1 <= int(t[6:8]) <= 12 or 51 <= int(t[6:8]) <= 62) and 1 <= int(t[8:10]) <= 31,
    "Bitcoin Address (Legacy)": lambda s: base58check(s, (0, 5)), "Litecoin Address": lambda s: base58check(s, (0x30, 0x32, 5)), "Ripple Address": lambda s: base58check(s, (0,), RIPPLE58), "Bitcoin Address (Bech32)": bech32, "Bitcoin Cash Address": cash_address, "JWT Token": jwt,
}


def passes(sub_category: str, value: str) -> bool:
    check = CHECKS.get(sub_category)
    return check is None or check(value)
