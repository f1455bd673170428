"""Check-digit and structure rules as SQL expressions over a column of digits or text."""

from __future__ import annotations

from maskwell.functions.sqltext import (
    all_of,
    any_of,
    digit,
    in_list,
    let,
    number,
    quote,
    weighted_sum,
)


def luhn(digits: str) -> str:
    return f"luhn_check({digits})"


def all_same(digits: str) -> str:
    return f"(replace({digits}, left({digits}, 1), '') = '')"


def ssn_digits(digits: str, allow_sequential: str = "true") -> str:
    """Area, group and serial rules; the famous sequences pass only where allowed."""
    return all_of(
        [
            f"length({digits}) = 9",
            f"left({digits}, 3) NOT IN ('000', '666')",
            f"left({digits}, 1) <> '9'",
            f"substr({digits}, 4, 2) <> '00'",
            f"right({digits}, 4) <> '0000'",
            f"{digits} <> '078051120'",
            f"NOT {all_same(digits)}",
            f"({allow_sequential} OR {digits} NOT IN ('123456789', '987654321'))",
        ]
    )


# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BY": 28, "BE": 16, "BA": 20,
    "BR": 29, "BG": 22, "CR": 22, "HR": 21, "CY": 28, "CZ": 24, "DK": 18, "DO": 28,
    "TL": 23, "EE": 20, "FI": 18, "FR": 27, "GE": 22, "DE": 22, "GI": 23, "GR": 27,
    "GL": 18, "GT": 28, "HU": 28, "IS": 26, "IE": 22, "IL": 23, "IT": 27, "JO": 30,
    "KZ": 20, "XK": 20, "KW": 30, "LV": 21, "LB": 28, "LI": 21, "LT": 20, "LU": 20,
    "MK": 19, "MT": 31, "MR": 27, "MU": 30, "MC": 27, "MD": 24, "ME": 22, "NL": 18,
    "NO": 15, "PK": 24, "PS": 29, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "SM": 27,
    "SA": 24, "RS": 22, "SK": 24, "SI": 19, "ES": 24, "SE": 24, "CH": 21, "TN": 24,
    "TR": 26, "AE": 23, "GB": 22, "VA": 22, "VG": 24,
}


def mod97(alnum: str) -> str:
    """Remainder by 97 of a text whose letters stand for 10 to 35."""
    return (
        f"aggregate(filter(split({alnum}, ''), c -> c <> ''), 0, (a, c) -> "
        "if(c BETWEEN '0' AND '9', (a * 10 + ascii(c) - 48) % 97, "
        "(a * 100 + ascii(c) - 55) % 97))"
    )


def iban(compact: str) -> str:
    """Length by country, then the ISO 7064 remainder."""
    by_length: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    lengths = any_of(
        f"(length({compact}) = {n} AND {in_list(f'left({compact}, 2)', cs)})"
        for n, cs in sorted(by_length.items())
    )
    rotated = f"concat(substr({compact}, 5), left({compact}, 4))"
    return all_of([lengths, f"{mod97(rotated)} = 1"])


def mod11_complement(total: str, over: int) -> str:
    """11 minus the remainder by 11, with results of ``over`` and above read as 0."""
    return f"if(11 - {total} % 11 >= {over}, 0, 11 - {total} % 11)"


def australian_tfn(d: str) -> str:
    nine = weighted_sum(d, (1, 4, 3, 7, 5, 8, 6, 9, 10))
    eight = weighted_sum(d, (10, 7, 8, 4, 6, 3, 5, 1))
    return (
        f"CASE length({d}) WHEN 9 THEN {nine} % 11 = 0 "
        f"WHEN 8 THEN {eight} % 11 = 0 ELSE false END"
    )


def brazilian_cnpj(d: str) -> str:
    first = weighted_sum(d, (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
    second = weighted_sum(d, (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
    return all_of(
        [
            f"length({d}) = 14",
            f"NOT {all_same(d)}",
            f"{mod11_complement(first, 10)} = {digit(d, 13)}",
            f"{mod11_complement(second, 10)} = {digit(d, 14)}",
        ]
    )


def korean_rrn(d: str) -> str:
    total = weighted_sum(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5))
    return all_of(
        [
            f"length({d}) = 13",
            f"substr({d}, 7, 1) BETWEEN '1' AND '4'",
            f"{number(d, 3, 2)} BETWEEN 1 AND 12",
            f"{number(d, 5, 2)} BETWEEN 1 AND 31",
            f"(11 - {total} % 11) % 10 = {digit(d, 13)}",
        ]
    )


def japanese_my_number(d: str) -> str:
    total = weighted_sum(d, (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2))
    return all_of(
        [f"length({d}) = 12", f"{mod11_complement(total, 10)} = {digit(d, 12)}"]
    )


def portuguese_nif(d: str) -> str:
    total = weighted_sum(d, (9, 8, 7, 6, 5, 4, 3, 2))
    return all_of(
        [
            f"left({d}, 1) IN ('1', '2', '3', '5', '6', '9')",
            f"{mod11_complement(total, 10)} = {digit(d, 9)}",
        ]
    )


def polish_pesel(d: str) -> str:
    total = weighted_sum(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))
    return all_of(
        [
            f"(10 - {total} % 10) % 10 = {digit(d, 11)}",
            f"{number(d, 3, 2)} % 20 BETWEEN 1 AND 12",
            f"{number(d, 5, 2)} BETWEEN 1 AND 31",
        ]
    )


def dutch_bsn(d: str) -> str:
    total = weighted_sum(d, (9, 8, 7, 6, 5, 4, 3, 2, -1))
    return all_of([f"{total} > 0", f"{total} % 11 = 0"])


def us_routing(d: str) -> str:
    total = weighted_sum(d, (3, 7, 1, 3, 7, 1, 3, 7, 1))
    district = number(d, 1, 2)
    return all_of(
        [
            f"{total} % 10 = 0",
            f"({district} BETWEEN 1 AND 12 OR {district} BETWEEN 21 AND 32 "
            f"OR {district} BETWEEN 61 AND 72 OR {district} = 80)",
        ]
    )


def ean13(d: str) -> str:
    total = weighted_sum(d, (1, 3) * 6)
    return all_of([f"length({d}) = 13", f"(10 - {total} % 10) % 10 = {digit(d, 13)}"])


def chinese_id_check(body: str) -> str:
    """ISO 7064 MOD 11-2 over 17 digits and a final digit or X."""
    total = weighted_sum(body, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2))
    return f"substr('10X98765432', {total} % 11 + 1, 1) = right({body}, 1)"


def french_ssn(d: str) -> str:
    return all_of(
        [
            f"length({d}) = 15",
            f"97 - {number(d, 1, 13)} % 97 = {number(d, 14, 2)}",
        ]
    )


def spanish_dni(value: str) -> str:
    """Mod-23 letter; a leading X, Y or Z stands for 0, 1 or 2."""
    numeric = f"translate(left({value}, length({value}) - 1), 'XYZ', '012')"
    return all_of(
        [
            f"length({numeric}) = 8",
            f"substr('TRWAGMYFPDXBNJZSQVHLCKE', "
            f"CAST(try_cast({numeric} AS BIGINT) % 23 AS INT) + 1, 1) = right({value}, 1)",
        ]
    )


def italian_code(value: str) -> str:
    day = number(value, 10, 2)
    return f"({day} BETWEEN 1 AND 31 OR {day} BETWEEN 41 AND 71)"


def german_tax_id(d: str) -> str:
    """Some digit absent, some repeated, none more than three times."""
    counts = (
        "transform(array('0','1','2','3','4','5','6','7','8','9'), "
        f"k -> length({d}) - length(replace({d}, k, '')))"
    )
    return let(
        "f",
        counts,
        "(array_contains(f, 0) AND exists(f, n -> n >= 2) AND NOT exists(f, n -> n > 3))",
    )


def dea_number(value: str) -> str:
    total = weighted_sum(value, (1, 2, 1, 2, 1, 2), first=3)
    return f"{total} % 10 = {digit(value, 9)}"


def entropy(value: str) -> str:
    """Shannon entropy of a token in bits per character."""
    shares = (
        f"transform(array_distinct(filter(split({value}, ''), c -> c <> '')), "
        f"c -> (length({value}) - length(replace({value}, c, ''))) "
        f"/ CAST(length({value}) AS DOUBLE))"
    )
    return f"aggregate({shares}, 0D, (a, p) -> a - p * log2(p))"


# National number shape by calling code, from public numbering plans.
# Codes that are not listed are judged by length alone.
NATIONAL_NUMBERS = {
    "1": "[2-9][0-9]{9}",
    "7": "[3-9][0-9]{9}",
    "20": "[1-9][0-9]{7,9}",
    "27": "[1-8][0-9]{8}",
    "30": "[2689][0-9]{9}",
    "31": "[1-9][0-9]{8}",
    "32": "[1-9][0-9]{7,8}",
    "33": "[1-9][0-9]{8}",
    "34": "[5-9][0-9]{8}",
    "36": "[1-9][0-9]{7,8}",
    "39": "0[0-9]{5,10}|3[0-9]{8,9}|8[0-9]{5,9}",
    "40": "[2378][0-9]{8}",
    "41": "[2-9][0-9]{8}",
    "43": "[1-9][0-9]{3,12}",
    "44": "[1-357-9][0-9]{9}|[18][0-9]{8}|8[0-9]{6}",
    "45": "[2-9][0-9]{7}",
    "46": "[1-9][0-9]{6,9}",
    "47": "[2-9][0-9]{7}",
    "48": "[1-9][0-9]{8}",
    "49": "[1-9][0-9]{4,13}",
    "51": "[1-9][0-9]{7,8}",
    "52": "[2-9][0-9]{9}",
    "53": "[2-8][0-9]{5,7}",
    "54": "[1-9][0-9]{9,10}",
    "55": "[1-9][0-9]{9,10}",
    "56": "[2-9][0-9]{8}",
    "57": "[1-9][0-9]{7,9}",
    "58": "[2-9][0-9]{9}",
    "60": "[1-9][0-9]{7,9}",
    "61": "[2-478][0-9]{8}|1[0-9]{5,9}",
    "62": "[1-9][0-9]{6,11}",
    "63": "[2-9][0-9]{7,9}",
    "64": "[2-9][0-9]{7,9}",
    "65": "[3689][0-9]{7}",
    "66": "[1-9][0-9]{7,8}",
    "81": "[1-9][0-9]{8,9}",
    "82": "[1-9][0-9]{7,9}",
    "84": "[1-9][0-9]{8,9}",
    "86": "1[0-9]{10}|[2-9][0-9]{8,10}",
    "90": "[2-58][0-9]{9}",
    "91": "[2-9][0-9]{9}",
    "92": "[1-9][0-9]{8,9}",
    "93": "[2-7][0-9]{8}",
    "94": "[1-9][0-9]{8}",
    "98": "[1-9][0-9]{9}",
    "212": "[5-8][0-9]{8}",
    "234": "[1-9][0-9]{7,9}",
    "254": "[1-9][0-9]{6,8}",
    "351": "[236789][0-9]{8}",
    "352": "[2-9][0-9]{5,10}",
    "353": "[1-9][0-9]{6,9}",
    "358": "[1-9][0-9]{4,10}",
    "380": "[3-9][0-9]{8}",
    "420": "[2-9][0-9]{8}",
    "421": "[2-9][0-9]{8}",
    "852": "[2-9][0-9]{7}",
    "880": "[1-9][0-9]{6,9}",
    "886": "[2-9][0-9]{7,8}",
    "966": "[158][0-9]{8}",
    "971": "[2-9][0-9]{7,8}",
    "972": "[2-9][0-9]{7,8}",
}


def international_number(digits: str) -> str:
    """Calling code and national number fit a known plan, or an unlisted code."""
    listed = "|".join(f"{code}(?:{shape})" for code, shape in NATIONAL_NUMBERS.items())
    unlisted = (
        "(?!(?:" + "|".join(NATIONAL_NUMBERS) + "))[2-9][0-9]{7,14}"
    )
    return f"{digits} RLIKE {quote(f'^(?:{listed}|{unlisted})$')}"


def north_american_number(ten: str) -> str:
    """Area and exchange rules of the North American plan over the last ten digits."""
    return all_of(
        [
            f"substr({ten}, 2, 2) <> '11'",
            f"substr({ten}, 5, 2) <> '11'",
            f"NOT (substr({ten}, 4, 3) = '555' AND substr({ten}, 7, 2) = '01')",
            f"left({ten}, 1) BETWEEN '2' AND '9'",
        ]
    )
