"""Column predicates and single-value checks agree, on known values and on random ones."""

import random

from pyspark.sql import functions as F

from veilframe.functions import checks
from veilframe.functions import validators as V

GOOD = {
    "Visa": "4111 1111 1111 1111", "USA SSN": "219-09-9999", "IBAN Generic": "DE89 3704 0044 0532 0130 00", "ISIN": "US0378331005", "CUSIP": "037833100", "SEDOL": "0263494", "British NHS": "943 476 5919", "Canada SIN": "130 692 544",
    "Netherlands BSN": "111222333", "Spain DNI": "12345678Z", "Poland PESEL": "44051401359", "Brazil CPF": "529.982.247-25", "Brazil CNPJ": "11.222.333/0001-81", "Italy Codice Fiscale": "RSSMRA85T10A562S", "VIN": "1M8GDM9AXKP042788", "Singapore NRIC": "S1234567D",
    "Hong Kong ID": "A123456(1)", "US NPI": "1234567893", "LEI": "5493001KJTIIGC8Y1R12", "ABA Routing Number": "021000021", "India Aadhaar": "2341 2341 2346", "Germany Tax ID": "86095742719", "France NIR": "2 55 08 14 168 025 38", "China Resident ID": "11010519491231002X",
    "Australia TFN": "123456782", "Email Address": "a.b@example.com", "IPv4 Address": "8.8.8.8", "MAC Address": "00:1b:44:11:3a:b7", "Japan My Number": "123456789018",
}


def columns(spark, sub, values):
    predicate = V.BY_SUB_CATEGORY[sub]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.ok for r in df.select("i", predicate(F.col("v")).alias("ok")).orderBy("i").collect()]


def test_known_values(spark):
    for sub, value in GOOD.items():
        changed = value[:-2] + ("0" if value[-2] != "0" else "1") + value[-1]
        got = columns(spark, sub, [value, None, "", "x"])
        assert got == [True, False, False, False], (sub, got)
        assert checks.passes(sub, value), sub
        if sub not in ("USA SSN", "Email Address", "IPv4 Address", "MAC Address"):
            assert not checks.passes(sub, changed), sub


def test_columns_and_checks_agree(spark):
    rnd = random.Random(5)
    shapes = {"digits": lambda n: "".join(rnd.choices("0123456789", k=n)), "mixed": lambda n: "".join(rnd.choices("0123456789ABCKX", k=n))}
    sizes = {"USA SSN": 9, "Canada SIN": 9, "Netherlands BSN": 9, "British NHS": 10, "Poland PESEL": 11, "Brazil CPF": 11, "Germany Tax ID": 11, "India Aadhaar": 12, "Japan My Number": 12, "ABA Routing Number": 9, "US NPI": 10, "Australia TFN": 9, "South Africa ID": 13, "Sweden PIN": 10, "Argentina CUIL/CUIT": 11}
    for sub, n in sizes.items():
        values = [shapes["digits"](n) for _ in range(300)] + [shapes["mixed"](n) for _ in range(20)] + ["0" * n, "1" * n]
        assert columns(spark, sub, values) == [checks.passes(sub, v) for v in values], sub


def test_structural_accepts_unknown_kinds(spark):
    df = spark.createDataFrame([("No Such Kind", "x"), ("Visa", "4111111111111112"), ("Visa", None)], "s string, v string")
    assert [r.ok for r in df.select(V.structural(F.col("s"), F.col("v")).alias("ok")).collect()] == [True, False, False]


def test_figi_check_digit():
    from veilframe.functions.checks import figi

    assert figi("BBG000BLNQ16") and figi("BBG000BLNNH6") and not figi("BBG000BLNQ17") and not figi("GBG000BLNQ16")
