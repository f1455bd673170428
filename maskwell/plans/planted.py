"""Message tables derived from the given tables.

The random prose of the test data holds few kinds of personal data. These texts are
computed from the keys of whole tables by SQL that any engine runs alike, so their number
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwell.sources.tables import spread


def digits(key: str, n: int, mul: int | None = None, add: int = 271828183) -> str:
    """``n`` pseudo-random digits from a key; keys repeat their digits after a million."""
    if mul is None:
        mul = 104729 if n < 10 else 6180339887
    return f"lpad(CAST(((({key} % 1000003) * {mul} + {add}) % {10**n}) AS STRING), {n}, '0')"


def pick(key: str, *options: str) -> str:
    """One of several texts, by key."""
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options[:-1]))
    return f"CASE {key} % {len(options)} {cases} ELSE {options[-1]} END"


def cut(value: str, sizes: tuple[int, ...], sep: str) -> str:
    parts, at = [], 1
    for size in sizes:
        parts.append(f"substr({value}, {at}, {size})")
        at += size
    return "concat(" + f", '{sep}', ".join(parts) + ")"


def spelled(key: str, value: str, sizes: tuple[int, ...], seps: tuple[str, ...]) -> str:
    return pick(f"({key} // 3)", *(cut(value, sizes, s) for s in seps))


O, C = "o_orderkey", "c_custkey"
HEX = f"concat(md5(CAST({C} AS STRING)), md5(concat(CAST({C} AS STRING), 'b')))"


def _orders(text: str) -> tuple[str, str, str]:
    return ("orders", O, text)


def _customer(text: str) -> tuple[str, str, str]:
    return ("customer", C, text)


def _near(key: str, word: str, value: str, other: str = "item") -> str:
    return f"concat({pick(key, repr(word + ' '), repr('my ' + word + ' is '), repr(other + ' '))}, {value})"


def _iban() -> str:
    account = f"concat({digits(O, 10)}, {digits(O, 8, 7919, 12345)})"
    check = digits(O, 2, 31, 7)
    compact = f"concat('DE', {check}, {account})"
    return f"concat({pick(O, repr('iban '), repr('code '))}, {spelled(O, compact, (4, 4, 4, 4, 4, 2), ('', ' '))}, ' end')"


# name -> (table, key column, text expression)
PLANTED: dict[str, tuple[str, str, str]] = {
    "email": _customer(
        f"concat('write to user', CAST({C} AS STRING), '@', "
        + pick(C, "'mail.corp.io'", "'example.com'", "'sub.example.org'", "'shop.co.test'", "'x-y.co.uk'")
        + f", ' or a.b+', CAST({C} AS STRING), '@y', CAST({C} AS STRING), '.org.')"
    ),
    "ssn": _orders(
        f"concat({pick(O, repr('my ssn is '), repr('id '), repr('social security '), repr('no '))}, "
        + spelled(O, digits(O, 9), (3, 2, 4), ("-", " ", "")) + ", ' ok')"
    ),
    "credit_card": _orders(
        f"concat({pick(O, repr('visa '), repr('nr '))}, "
        + spelled(O, f"concat('4', {digits(O, 15)})", (4, 4, 4, 4), ("", " ", "-")) + ", ' ok')"
    ),
    "phone_us": _orders(
        f"concat({pick(O, repr('call '), repr('at '))}, "
        + pick(
            f"({O} // 2)",
            f"concat('(', substr({digits(O, 10)}, 1, 3), ') ', substr({digits(O, 10)}, 4, 3), '-', substr({digits(O, 10)}, 7, 4))",
            f"concat('+1-', {cut(digits(O, 10), (3, 3, 4), '-')})",
            cut(digits(O, 10), (3, 3, 4), "."),
        ) + ", ' ok')"
    ),
    "phone_intl": _orders(
        f"concat({pick(O, repr('whatsapp '), repr('at '))}, '+', "
        + pick(f"({O} // 2)", "'44'", "'33'", "'91'", "'49'", "'61'")
        + f", ' ', substr({digits(O, 10)}, 1, 2), ' ', substr({digits(O, 10)}, 3, 4), ' ', substr({digits(O, 10)}, 7, 3), ' ok')"
    ),
    "ipv4": _orders(
        f"concat({pick(O, repr('server '), repr('release '), repr('version '))}, CAST({O} % 251 AS STRING), '.', "
        f"CAST(({O} * 7) % 40 AS STRING), '.', CAST(({O} * 11) % 40 AS STRING), '.', CAST(({O} * 13) % 40 AS STRING), "
        + pick(f"({O} // 5)", "' ok'", "'-beta1'", "'.'") + ")"
    ),
    "ipv6": _customer(
        f"concat({pick(C, repr('host '), repr('see '))}, "
        + pick(
            f"({C} // 2)",
            f"concat('2001:db8:85a3:', substr({HEX}, 1, 4), ':', substr({HEX}, 5, 4), ':8a2e:370:', substr({HEX}, 9, 4))",
            f"concat('fe80:', substr({HEX}, 1, 4), ':', substr({HEX}, 5, 4))",
            f"concat(substr({HEX}, 1, 2), ':', substr({HEX}, 3, 2), ':', substr({HEX}, 5, 2), ':', substr({HEX}, 7, 2), ':', substr({HEX}, 9, 2), ':', substr({HEX}, 11, 2))",
        ) + ", ' ok')"
    ),
    "iban": _orders(_iban()),
    "crypto_wallet": _customer(
        f"concat({pick(C, repr('wallet '), repr('item '))}, "
        + pick(
            f"({C} // 2)",
            f"concat('0x', substr({HEX}, 1, 40))",
            f"concat('0xAb', substr({HEX}, 1, 38))",
            f"concat('bc1', substr({HEX}, 1, 42))",
            f"concat('1', replace(substr({HEX}, 1, 28), '0', 'z'))",
        ) + ", ' ok')"
    ),
    "uk_nin": _customer(
        _near(C, "nino", f"concat({pick(C, repr('AB'), repr('TN'), repr('QQ'), repr('ce'))}, "
              + spelled(C, digits(C, 6), (2, 2, 2), ("", " ")) + f", {pick(C, repr('A'), repr('D'), repr('E'))})")
    ),
    "de_tax_id": _orders(_near(O, "steuer", digits(O, 11))),
    "fr_ssn": _orders(
        _near(O, "securite sociale", f"concat('1', {digits(O, 2)}, '0', CAST({O} % 9 + 1 AS STRING), {digits(O, 8)}, {digits(O, 2, 37, 11)})")
    ),
    "es_dni": _orders(
        _near(O, "dni", f"concat({pick(O, digits(O, 8), 'concat(' + repr('X') + ', ' + digits(O, 7) + ')')}, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(({O} * 5) % 23 AS INT) + 1, 1))")
    ),
    "it_fiscal_code": _customer(
        _near(C, "codice fiscale", f"concat('RSSMRA', {digits(C, 2)}, {pick(C, repr('A'), repr('H'), repr('G'), repr('t'))}, {digits(C, 2, 7919)}, 'F', {digits(C, 3)}, 'Z')")
    ),
    "nl_bsn": _orders(_near(O, "bsn", digits(O, 9))),
    "mac_address": _customer(
        f"concat({pick(C, repr('mac '), repr('wifi color: '), repr('see '))}, "
        + pick(
            f"({C} // 3)",
            f"concat(substr({HEX}, 1, 2), ':', substr({HEX}, 3, 2), ':', substr({HEX}, 5, 2), ':', substr({HEX}, 7, 2), ':', substr({HEX}, 9, 2), ':', substr({HEX}, 11, 2))",
            f"concat(substr({HEX}, 1, 4), '.', substr({HEX}, 5, 4), '.', substr({HEX}, 9, 4))",
            "'ff:ff:ff:ff:ff:ff'",
        ) + ", ' ok')"
    ),
    "ca_sin": _orders(_near(O, "social insurance", spelled(O, digits(O, 9), (3, 3, 3), ("", " ", "-")))),
    "in_aadhaar": _orders(_near(O, "aadhaar", spelled(O, digits(O, 12), (4, 4, 4), ("", " ", "-")))),
    "swift_bic": _customer(
        _near(C, "swift", f"concat({pick(C, repr('DEUTDE'), repr('CHASUS'), repr('ABCDQQ'), repr('BNPAFR'))}, {digits(C, 2)}, {pick('(' + C + ' // 3)', repr(''), repr('XXX'), repr('XX'))})")
    ),
    "us_ein": _orders(_near(O, "employer id", cut(digits(O, 9), (2, 7), "-"))),
    "passport_us": _customer(
        _near(C, "passport", pick(f"({C} // 3)", digits(C, 9), f"concat('C', {digits(C, 7)})", f"concat('xg', {digits(C, 6)})"))
    ),
    "drivers_license": _customer(
        _near(C, "driver", pick(f"({C} // 3)", digits(C, 8), f"concat('D', {digits(C, 8)})", f"concat('d', {digits(C, 6)})"))
    ),
    "date_of_birth": _orders(
        _near(O, "born", pick(
            f"({O} // 3)",
            f"concat({digits(O, 2, 7, 1)}, '/', {digits(O, 2, 11, 3)}, '/19', {digits(O, 2)})",
            f"concat('20', {digits(O, 2)}, '-', {digits(O, 2, 7, 1)}, '-', {digits(O, 2, 11, 3)})",
            f"concat('March ', CAST({O} % 31 + 1 AS STRING), ', 19', {digits(O, 2)})",
        ))
    ),
    "street_address": _customer(
        _near(C, "lives at", f"concat(CAST({C} % 9000 + 1 AS STRING), {pick(C, repr(' Oak Street'), repr(' North Elm Ave'), repr(' Main'), repr(' Old Mill Rd Apt 4'))}, ' now')")
    ),
    "zip_code": _customer(
        _near(C, "zip", pick(f"({C} // 3)", digits(C, 5), cut(digits(C, 9), (5, 4), "-"), digits(C, 6)))
    ),
    "vin": _customer(
        _near(C, "vin", f"upper(concat({pick(C, repr('1HG'), repr('6HG'))}, substr(replace(replace({HEX}, '0', 'x'), 'e', 'u'), 1, 14)))")
    ),
    "medical_license": _orders(
        f"concat({pick(O, repr('dea '), repr('npi '), repr('ref '))}, "
        + pick(f"({O} // 3)", f"concat('AB', {digits(O, 7)})", f"concat('1', {digits(O, 9)})") + ")"
    ),
    "au_tfn": _orders(
        _near(O, "tax file", pick(f"({O} // 3)", digits(O, 9), cut(digits(O, 9), (3, 3, 3), " "), digits(O, 8)))
    ),
    "br_cpf": _orders(
        _near(O, "cpf", pick(
            f"({O} // 3)", digits(O, 11), "'11111111111'",
            f"concat(substr({digits(O, 11)}, 1, 3), '.', substr({digits(O, 11)}, 4, 3), '.', substr({digits(O, 11)}, 7, 3), '-', substr({digits(O, 11)}, 10, 2))",
        ))
    ),
    "br_cnpj": _orders(
        _near(O, "cnpj", f"concat(substr({digits(O, 12)}, 1, 2), '.', substr({digits(O, 12)}, 3, 3), '.', substr({digits(O, 12)}, 6, 3), '/', substr({digits(O, 12)}, 9, 4), '-', {digits(O, 2, 41, 3)})")
    ),
    "kr_rrn": _orders(
        _near(O, "rrn", f"concat({digits(O, 2)}, '0', CAST({O} % 10 AS STRING), {digits(O, 2, 11, 1)}, '-', CAST({O} % 5 AS STRING), {digits(O, 6, 7919)})")
    ),
    "jp_my_number": _orders(_near(O, "my number", spelled(O, digits(O, 12), (4, 4, 4), ("", " ", "-")))),
    "passport_uk": _customer(_near(C, "passport", digits(C, 9))),
    "us_routing": _orders(_near(O, "routing", digits(O, 9))),
    "medicare_mbi": _customer(
        _near(C, "medicare", f"concat('1', {pick(C, repr('E'), repr('S'))}, 'G', 'T', {digits(C, 1)}, 'M', {digits(C, 1, 7)}, 'KA', {digits(C, 2)})")
    ),
    "pt_nif": _orders(_near(O, "nif", digits(O, 9))),
    "pl_pesel": _orders(_near(O, "pesel", digits(O, 11))),
    "ch_ahv": _orders(
        _near(O, "ahv", pick(
            f"({O} // 3)", f"concat('756', {digits(O, 10)})",
            f"concat('756.', substr({digits(O, 10)}, 1, 4), '.', substr({digits(O, 10)}, 5, 4), '.', substr({digits(O, 10)}, 9, 2))",
        ))
    ),
    "mx_curp": _customer(
        _near(C, "curp", f"concat('ABCD', {digits(C, 2)}, '0', CAST({C} % 10 AS STRING), {digits(C, 2, 11, 1)}, 'H', {pick(C, repr('DF'), repr('ZZ'), repr('JC'))}, 'XYZ0', CAST({C} % 10 AS STRING))")
    ),
    "in_pan": _customer(
        f"concat({pick(C, repr('pan card '), repr('my pan is '), repr('japan trip '), repr('company '))}, 'ABC', {pick('(' + C + ' // 4)', repr('P'), repr('X'))}, 'K', {digits(C, 4)}, 'Z')"
    ),
    "cn_national_id": _orders(
        _near(O, "id card", f"concat({pick(O, repr(''), repr('CN'))}, '110101', {pick(O, repr('19'), repr('17'), repr('20'))}, {digits(O, 2)}, '0', CAST({O} % 10 AS STRING), {digits(O, 2, 11, 1)}, {digits(O, 3)}, {pick(O, repr('X'), digits(O, 1, 7), digits(O, 1, 3))})")
    ),
}


def portable(text: str, engine: str) -> str:
    """Whole-number division is the one operator that is spelled differently."""
    return text.replace(" // ", " DIV ") if engine == "spark" else text


def planted_sql(name: str) -> str:
    table, key, text = PLANTED[name]
    return f"SELECT {key} AS id, {text} AS text FROM {table}"


def planted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, text = PLANTED[name]
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")).selectExpr(
        f"{key} AS id", f"{portable(text, 'spark')} AS text"
    )
