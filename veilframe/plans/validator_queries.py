"""One query per validator, over numbers and codes built from every order key, with its SQL oracle.

The oracle states the same check in another way: sums over substrings with explicit places
instead of higher-order functions over digit arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import validators as V
from veilframe.session import table

#: 27 digits from an order key, in SQL that both engines read.
DIGITS = "concat(lpad(cast((o_orderkey * 7919 + 13) % 1000000007 as string), 9, '0'), lpad(cast((o_orderkey * 104729 + 31) % 998244353 as string), 9, '0'), lpad(cast((o_orderkey * 1299709 + 77) % 982451653 as string), 9, '0'))"


def d(n: int, at: int = 1) -> str:
    return f"substr({DIGITS}, {at}, {n})"


def letters(n: int, at: int = 1) -> str:
    return f"translate({d(n, at)}, '0123456789', 'ABCDEFGHJK')"


def month_day(at: int) -> str:
    return f"concat(lpad(cast(1 + o_orderkey % 13 as string), 2, '0'), lpad(cast(1 + o_orderkey % 29 as string), 2, '0'))"


# ---- pieces of oracle SQL over a value v
def digit(i: int) -> str:
    return f"cast(substr(v, {i}, 1) as int)"


def wsum(weights: list[int], at: int = 1) -> str:
    return "(" + " + ".join(f"{w} * {digit(i)}" for i, w in enumerate(weights, at)) + ")"


def luhn_sql(v: str, n: int) -> str:
    terms = []
    for i in range(n, 0, -1):
        x = f"cast(substr({v}, {i}, 1) as int)"
        terms.append(x if (n - i) % 2 == 0 else f"(2 * {x} - case when {x} > 4 then 9 else 0 end)")
    return "((" + " + ".join(terms) + ") % 10 = 0)"


SAME = "(length(replace(v, substr(v, 1, 1), '')) = 0)"
BASE36 = "case when substr({v}, {i}, 1) between '0' and '9' then ascii(substr({v}, {i}, 1)) - 48 else ascii(substr({v}, {i}, 1)) - 55 end"


def c36(i: int, v: str = "v") -> str:
    return "(" + BASE36.format(v=v, i=i) + ")"


def expanded_sql(v: str) -> str:
    return f"array_to_string(list_transform(string_split({v}, ''), lambda x: case when x between '0' and '9' then x else cast(ascii(x) - 55 as varchar) end), '')"


def mod97(v: str) -> str:
    """Remainder of a digit string in three chunks of at most 15 digits behind the remainder before."""
    return f"list_reduce(list_transform(string_split({v}, ''), lambda x: cast(x as int)), lambda r, x: (r * 10 + x) % 97)"


def luhn_any(v: str) -> str:
    return f"(list_sum(list_transform(range(1, length({v}) + 1), lambda i: case when (length({v}) - i) % 2 = 0 then cast(substr({v}, i, 1) as int) when cast(substr({v}, i, 1) as int) > 4 then 2 * cast(substr({v}, i, 1) as int) - 9 else 2 * cast(substr({v}, i, 1) as int) end)) % 10 = 0)"


def int_at(i: int, n: int) -> str:
    return f"cast(substr(v, {i}, {n}) as bigint)"


MD = lambda i: f"({int_at(i, 2)} between 1 and 12 and {int_at(i + 2, 2)} between 1 and 31)"
PRODUCT, TURNS = V.verhoeff_tables()
IBANS = " or ".join(f"(substr(v, 1, 2) = '{x[:2]}' and length(v) = {x[2:]})" for x in ("DE22", "BE16", "NO15"))

#: name, predicate, value built from an order key, oracle condition on v
CASES: list[tuple[str, V.Predicate, str, str]] = [
    ("v_luhn", V.luhn, f"concat('4', {d(15)})", f"not {SAME} and {luhn_sql('v', 16)}"),
    ("v_ssn", V.ssn, d(9), f"substr(v, 1, 3) not in ('000', '666') and substr(v, 1, 1) <> '9' and substr(v, 4, 2) <> '00' and substr(v, 6, 4) <> '0000' and not {SAME} and v not in ('123456789', '987654321', '012345678', '876543210', '078051120')"),
    ("v_sin", V.sin, d(9), f"not {SAME} and substr(v, 1, 1) not in ('0', '8') and {luhn_sql('v', 9)}"),
    ("v_npi", V.npi, f"concat('1', {d(9)})", f"not {SAME} and " + luhn_sql("('80840' || v)", 15)),
    ("v_emirates", V.emirates, f"concat('784', {d(12)})", luhn_sql("v", 15)),
    ("v_teudat", V.teudat, d(9), f"not {SAME} and {luhn_sql('v', 9)}"),
    ("v_mers", V.mers_min, d(18), f"not {SAME} and {luhn_sql('v', 18)}"),
    ("v_iccid", V.iccid, f"concat('89', {d(17)})", luhn_sql("v", 19)),
    ("v_za_id", V.za_id, f"concat({d(2)}, {month_day(3)}, {d(7, 3)})", f"{MD(3)} and {digit(11)} <= 1 and {luhn_sql('v', 13)}"),
    ("v_personnummer", V.personnummer, f"concat({d(2)}, {month_day(3)}, {d(4, 3)})", f"not {SAME} and {MD(3)} and {luhn_sql('v', 10)}"),
    ("v_cusip", V.cusip, f"concat({letters(3)}, {d(6, 4)})", "(10 - (" + " + ".join(f"({x} // 10 + {x} % 10)" for x in (f"({c36(i)} * {1 + (i - 1) % 2})" for i in range(1, 9))) + f") % 10) % 10 = {digit(9)}"),
    ("v_sedol", V.sedol, f"concat(translate({d(1)}, '0123456789', 'BCDFGHJKLM'), {d(6, 2)})", "(10 - (" + " + ".join(f"{w} * {c36(i)}" for i, w in enumerate([1, 3, 1, 7, 3, 9], 1)) + f") % 10) % 10 = {digit(7)}"),
    ("v_isin", V.isin, f"concat('US', {d(10)})", luhn_any(expanded_sql("v"))),
    ("v_lei", V.lei, f"concat({letters(4)}, {d(16, 5)})", mod97(expanded_sql("v")) + " = 1"),
    ("v_uli", V.uli, f"concat({letters(4)}, {d(20, 5)})", mod97(expanded_sql("v")) + " = 1"),
    ("v_iban_mod97", V.iban, f"concat(case o_orderkey % 4 when 0 then 'DE' when 1 then 'BE' when 2 then 'NO' else 'QQ' end, {d(13)}, case o_orderkey % 4 when 0 then {d(7, 14)} when 1 then {d(1, 14)} else '' end)", f"({IBANS}) and " + mod97(expanded_sql("(substr(v, 5) || substr(v, 1, 4))")) + " = 1"),
    ("v_swift", V.swift, f"concat({letters(4)}, case o_orderkey % 3 when 0 then 'DE' when 1 then 'FR' else 'QQ' end, {letters(2, 5)})", "substr(v, 5, 2) in ('DE', 'FR')"),
    ("v_tfn", V.tfn, d(9), f"not {SAME} and {wsum([1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0"),
    ("v_us_phone", V.us_phone, d(10, 3), "regexp_full_match(v, '[2-9][0-9]{2}[1-9][0-9]{6}') and substr(v, 2, 2) <> '11' and substr(v, 5, 2) <> '11' and length(replace(substr(v, 7, 4), substr(v, 7, 1), '')) > 0 and not (substr(v, 4, 3) = '555' and substr(v, 7, 2) = '01')"),
    ("v_dea", V.dea, f"concat('B', {letters(1)}, {d(7, 2)})", f"({digit(3)} + {digit(5)} + {digit(7)} + 2 * ({digit(4)} + {digit(6)} + {digit(8)})) % 10 = {digit(9)}"),
    ("v_medicare", V.medicare_au, d(10, 3), f"substr(v, 1, 1) between '2' and '6' and {wsum([1, 3, 7, 9, 1, 3, 7, 9])} % 10 = {digit(9)}"),
    ("v_pan_in", V.pan_in, f"concat({letters(5)}, {d(4, 6)}, {letters(1, 10)})", "substr(v, 4, 1) in ('A', 'B', 'C', 'F', 'G', 'H', 'J')"),
    ("v_imad", V.imad, f"concat(lpad(cast(1980 + o_orderkey % 130 as string), 4, '0'), {month_day(5)}, {letters(8)}, {d(10, 9)})", f"{int_at(1, 4)} between 1990 and 2099 and {MD(5)}"),
    ("v_vin", V.vin, d(17), f"(case when {wsum([8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 = 10 then 'X' else cast({wsum([8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 as varchar) end) = substr(v, 9, 1)"),
    ("v_bsn", V.bsn, d(9), f"{wsum([9, 8, 7, 6, 5, 4, 3, 2, -1])} >= 0 and {wsum([9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0"),
    ("v_cpf", V.cpf, f"concat({d(8)}, {d(3, 11)})", f"not {SAME} and {wsum([10, 9, 8, 7, 6, 5, 4, 3, 2])} * 10 % 11 % 10 = {digit(10)} and {wsum([11, 10, 9, 8, 7, 6, 5, 4, 3, 2])} * 10 % 11 % 10 = {digit(11)}"),
    ("v_cnpj", V.cnpj, d(14), f"not {SAME} and (case when {wsum([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 < 2 then 0 else 11 - {wsum([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 end) = {digit(13)} and (case when {wsum([6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 < 2 then 0 else 11 - {wsum([6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 end) = {digit(14)}"),
    ("v_aba", V.aba, d(9), f"not {SAME} and ({int_at(1, 2)} between 0 and 12 or {int_at(1, 2)} between 21 and 32 or {int_at(1, 2)} between 61 and 72 or {int_at(1, 2)} = 80) and {wsum([3, 7, 1] * 3)} % 10 = 0"),
    ("v_nrn", V.nrn, f"concat({d(2)}, {month_day(3)}, {d(5, 3)})", f"{MD(3)} and (97 - {int_at(1, 9)} % 97 = {int_at(10, 2)} or 97 - (2000000000 + {int_at(1, 9)}) % 97 = {int_at(10, 2)})"),
    ("v_pesel", V.pesel, f"concat({d(2)}, {month_day(3)}, {d(5, 3)})", f"{int_at(3, 2)} % 20 between 1 and 12 and {int_at(5, 2)} between 1 and 31 and {wsum([1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1])} % 10 = 0"),
    ("v_verhoeff", V.aadhaar, f"concat('3', {d(11)})", "list_reduce(list_prepend(0, list_transform(range(1, 13), lambda i: " + f"({TURNS})[((i - 1) % 8) * 10 + cast(substr(v, 13 - i, 1) as int) + 1])), lambda s, x: ({PRODUCT})[s * 10 + x + 1]) = 0"),
    ("v_mynumber", V.my_number, d(12), f"(case when {wsum([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 <= 1 then 0 else 11 - {wsum([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 end) = {digit(12)}"),
    ("v_codice_fiscale", V.codice_fiscale, f"concat({letters(6)}, {d(2, 7)}, {letters(1, 9)}, {d(2, 10)}, {letters(1, 12)}, {d(3, 13)}, {letters(1, 16)})", "chr(cast(65 + (" + " + ".join(f"({V.CODICE_ODD})[{c36(i)} + 1]" if i % 2 else f"(case when {c36(i)} > 9 then {c36(i)} - 10 else {c36(i)} end)" for i in range(1, 16)) + ") % 26 as int)) = substr(v, 16, 1)"),
    ("v_dni", V.dni, f"concat({d(8)}, {letters(1, 9)})", f"substr('TRWAGMYFPDXBNJZSQVHLCKE', cast({int_at(1, 8)} % 23 + 1 as int), 1) = substr(v, 9, 1)"),
    ("v_nhs", V.nhs, d(10), f"not {SAME} and {wsum([10, 9, 8, 7, 6, 5, 4, 3, 2, 1])} % 11 = 0"),
    ("v_china_id", V.china_id, f"concat({d(6)}, lpad(cast(1790 + o_orderkey % 250 as string), 4, '0'), {month_day(11)}, {d(4, 7)})", f"{int_at(7, 4)} between 1800 and 2099 and {MD(11)} and substr('10X98765432', {wsum([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])} % 11 + 1, 1) = substr(v, 18, 1)"),
    ("v_rrn", V.rrn, f"concat({d(2)}, {month_day(3)}, {d(7, 3)})", f"not {SAME} and {MD(3)} and {digit(7)} between 1 and 8 and (11 - {wsum([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])} % 11) % 10 = {digit(13)}"),
    ("v_nir", V.nir, d(15), f"97 - {int_at(1, 13)} % 97 = {int_at(14, 2)}"),
    ("v_curp", V.curp, f"concat({letters(4)}, {d(2, 5)}, {month_day(7)}, 'H', {letters(5, 7)}, {d(2, 12)})", f"{MD(7)} and (10 - (" + " + ".join(f"(case when {c36(i)} > 23 then {c36(i)} + 1 else {c36(i)} end) * {19 - i}" for i in range(1, 18)) + f") % 10) % 10 = {digit(18)}"),
    ("v_cpr", V.cpr, f"concat(lpad(cast(1 + o_orderkey % 34 as string), 2, '0'), {d(8)})", f"not {SAME} and {int_at(1, 2)} between 1 and 31 and {int_at(3, 2)} between 1 and 12"),
    ("v_cuil", V.cuil, f"concat('20', {d(9)})", f"{wsum([5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 <> 1 and (case when {wsum([5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 = 0 then 0 else 11 - {wsum([5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 end) = {digit(11)}"),
    ("v_nric", V.nric, f"concat(case o_orderkey % 2 when 0 then 'S' else 'T' end, {d(7)}, {letters(1, 8)})", f"substr('JZIHGFEDCBA', ({wsum([2, 7, 6, 5, 4, 3, 2], 2)} + case when substr(v, 1, 1) = 'T' then 4 else 0 end) % 11 + 1, 1) = substr(v, 9, 1)"),
    ("v_fin", V.nric, f"concat(case o_orderkey % 2 when 0 then 'F' else 'G' end, {d(7)}, translate({d(1, 8)}, '0123456789', 'XWUTRQPNML'))", f"substr('XWUTRQPNMLK', ({wsum([2, 7, 6, 5, 4, 3, 2], 2)} + case when substr(v, 1, 1) = 'G' then 4 else 0 end) % 11 + 1, 1) = substr(v, 9, 1)"),
    ("v_hkid", V.hkid, f"concat({letters(1)}, {d(7, 2)})", "(8 * 36 + 7 * (ascii(substr(v, 1, 1)) - 64) + " + " + ".join(f"{w} * {digit(i)}" for i, w in enumerate([6, 5, 4, 3, 2, 1, 1], 2)) + ") % 11 = 0"),
    ("v_steuer", V.steuer_id, d(11), f"not {SAME} and len(list_distinct(string_split(substr(v, 1, 10), ''))) >= 7 and list_max(list_transform(string_split(substr(v, 1, 10), ''), lambda x: 10 - length(replace(substr(v, 1, 10), x, '')))) <= 3 and (11 - list_reduce(list_prepend(10, list_transform(string_split(substr(v, 1, 10), ''), lambda x: cast(x as int))), lambda p, x: (case when (p + x) % 10 = 0 then 10 else (p + x) % 10 end) * 2 % 11)) % 10 = {digit(11)}"),
    ("v_rut", V.rut, f"concat({d(8)}, case o_orderkey % 11 when 10 then 'K' else cast(o_orderkey % 11 as string) end)", f"length(replace(substr(v, 1, 8), substr(v, 1, 1), '')) > 0 and (case 11 - {wsum([3, 2, 7, 6, 5, 4, 3, 2])} % 11 when 11 then '0' when 10 then 'K' else cast(11 - {wsum([3, 2, 7, 6, 5, 4, 3, 2])} % 11 as varchar) end) = substr(v, 9, 1)"),
    ("v_ramq", V.ramq, f"concat({letters(4)}, {d(2, 5)}, lpad(cast(o_orderkey % 70 as string), 2, '0'), lpad(cast(o_orderkey % 37 as string), 2, '0'), {d(2, 7)})", f"({int_at(7, 2)} between 1 and 12 or {int_at(7, 2)} between 51 and 62) and {int_at(9, 2)} between 1 and 31"),
    ("v_ipv4_public", V.ipv4, "concat_ws('.', cast(o_orderkey % 256 as string), cast((o_orderkey * 7) % 256 as string), cast((o_orderkey * 13) % 256 as string), cast((o_orderkey * 29) % 256 as string))",
     "not (cast(split_part(v, '.', 1) as int) in (0, 10, 127) or cast(split_part(v, '.', 1) as int) >= 224 or (v like '100.%' and cast(split_part(v, '.', 2) as int) between 64 and 127) or v like '169.254.%' or (v like '172.%' and cast(split_part(v, '.', 2) as int) between 16 and 31) or v like '192.168.%' or v like '192.0.0.%' or v like '192.0.2.%' or v like '198.18.%' or v like '198.19.%' or v like '198.51.100.%' or v like '203.0.113.%')"),
    ("v_ipv6_public", V.ipv6, f"concat(case o_orderkey % 6 when 0 then 'fe80' when 1 then 'fd12' when 2 then '2001:db8' when 3 then 'ff02' when 4 then '2a00' else '2001' end, '::', {d(4)})", "substr(v, 1, 4) = '2a00' or (substr(v, 1, 4) = '2001' and v not like '2001:db8%')"),
    ("v_mac", V.mac, f"case when o_orderkey % 5 = 0 then '00:00:00:00:00:00' when o_orderkey % 5 = 1 then 'ff-ff-ff-ff-ff-ff' else {d(12)} end", "v not in ('00:00:00:00:00:00', 'ff-ff-ff-ff-ff-ff')"),
    ("v_gps", V.gps, "concat(cast(o_orderkey % 120 as string), '.5, ', cast(o_orderkey % 230 as string), '.25')", "cast(split_part(v, ',', 1) as double) <= 90 and cast(trim(split_part(v, ',', 2)) as double) <= 180"),
    ("v_e164", V.e164, f"concat('+49', {d(10)})", "not contains('01234567890123456789', substr(v, 2)) and list_max(list_transform(regexp_extract_all(v, '0+|1+|2+|3+|4+|5+|6+|7+|8+|9+'), lambda x: length(x))) < 6"),
    ("v_plausible_phone", V.plausible_phone, d(9), f"not {SAME} and not contains('01234567890123456789', v) and not contains('98765432109876543210', v) and list_max(list_transform(regexp_extract_all(v, '0+|1+|2+|3+|4+|5+|6+|7+|8+|9+'), lambda x: length(x))) < 4.5"),
    ("v_bearer", V.bearer, f"concat('Bearer ', {d(20)}, case when o_orderkey % 3 = 0 then 'abc' else '' end)", "length(v) >= 23"),
    ("v_url_token", V.url_token, f"concat('https://h.example/a?x=1', chr(38), 'token=', case when o_orderkey % 3 = 0 then 'password' else {d(9)} end)", "v not like '%password'"),
    ("v_slack", V.slack_webhook, f"concat('https://hooks.slack.com/services/T', {d(9)}, '/B', {d(9, 3)}, '/', case when o_orderkey % 2 = 0 then {d(24)} else {d(9)} end)", "length(v) > 70"),
    ("v_api_key_entropy", V.api_key, f"concat('api_key = ', {letters(20)})", "list_sum(list_transform(list_distinct(string_split(substr(v, 11), '')), lambda x: -(20 - length(replace(substr(v, 11), x, ''))) / 20.0 * log2((20 - length(replace(substr(v, 11), x, ''))) / 20.0))) >= 3.0"),
    ("v_secret_entropy", V.secret_assignment, f"concat('secret: ', {letters(12)})", "list_sum(list_transform(list_distinct(string_split(substr(v, 9), '')), lambda x: -(12 - length(replace(substr(v, 9), x, ''))) / 12.0 * log2((12 - length(replace(substr(v, 9), x, ''))) / 12.0))) >= 2.5"),
    ("v_micr", V.micr, f"concat(case when o_orderkey % 2 = 0 then '⑆' else '|' end, {d(9)})", "substr(v, 1, 1) = '⑆'"),
    ("v_email", V.email, f"concat('u', {d(4)}, case when o_orderkey % 3 = 0 then '..' else '.' end, 'x@host', {d(2)}, case o_orderkey % 4 when 0 then '.com' when 1 then '.de' when 2 then '.qqqq' else '' end)", "not contains(v, '..') and (v like '%.com' or v like '%.de')"),
]


def query(predicate: V.Predicate, value: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        built = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(value).alias("value"))
        return built.where(predicate(F.col("value")))

    return run


def queries() -> dict:
    return {name: query(predicate, value) for name, predicate, value, _ in CASES}


def oracle_sql() -> dict[str, str]:
    return {name: f"SELECT o_orderkey, v AS value FROM (SELECT o_orderkey, {value.replace('as string', 'as varchar')} AS v FROM orders) WHERE {condition}" for name, _, value, condition in CASES}
