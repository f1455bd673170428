"""The same answers in SQL for another engine, written independently of the operators.

Positions come from list functions over all matches and all gaps of a text; check digits
from list arithmetic. Patterns are the fixed values of the rules with plain word
boundaries, since this engine has no look-around.
"""

from __future__ import annotations

from maskwell.functions.checks import IBAN_LENGTHS, NATIONAL_NUMBERS
from maskwell.functions.sqltext import SPACE, WORD_END, WORD_START
from maskwell.plans.planted import planted_sql
from maskwell.rules import identifiers as ids


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def plain(pattern: str) -> str:
    out = pattern.replace(WORD_START, r"\b").replace(WORD_END, r"\b")
    out = out.replace(r"(?:(?<![a-zA-Z0-9])|\G)", "").replace(SPACE, r"\s")
    return out.replace("(?i)\\b", "(?i:\\b", 1) + ")" if out.startswith("(?i)\\b") else out


def near(words) -> str:
    return "(" + " OR ".join(f"contains(ctx, {q(w)})" for w in words) + ")"


def hits(source: str, pattern: str, type_: str, conf: str, order: int = 1) -> str:
    """All matches with position and context, scored by ``conf`` (NULL drops the match)."""
    p = q(plain(pattern))
    return f"""
    SELECT id, '{type_}' AS type, value, start, start + length(value) AS "end", {conf} AS confidence, {order} AS ord
    FROM (
      SELECT id, text, value, start, regexp_replace(value, '[^0-9]', '', 'g') AS d,
             lower(substr(text, greatest(start - 100, 0) + 1, least(start, 100))) AS ctx,
             substr(text, start + length(value) + 1, 10) AS after
      FROM (
        SELECT id, text, ms[i] AS value,
               CAST(list_sum(list_transform(ps[1:i], lambda s: length(s)))
                    + coalesce(list_sum(list_transform(ms[1:i-1], lambda s: length(s))), 0) AS INTEGER) AS start
        FROM (SELECT id, text, regexp_extract_all(text, {p}) AS ms, regexp_split_to_array(text, {p}) AS ps
              FROM ({source}) src) x,
             LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i) n
      )
    )
    """


def scored(*parts: str) -> str:
    union = " UNION ALL ".join(f"({p})" for p in parts)
    return (
        'SELECT id, type, value, start, "end", round(confidence, 4) AS confidence '
        f"FROM ({union}) WHERE confidence > 0"
    )


def at(d: str, i: int) -> str:
    return f"CAST(substr({d}, {i}, 1) AS INTEGER)"


def wsum(d: str, weights, first: int = 1) -> str:
    ws = "[" + ", ".join(str(w) for w in weights) + "]"
    return (
        f"list_sum(list_transform(range({len(weights)}), lambda i: "
        f"CAST(substr({d}, CAST(i AS INTEGER) + {first}, 1) AS INTEGER) * {ws}[i + 1]))"
    )


def luhn(d: str) -> str:
    x = f"CAST(substr(reverse({d}), CAST(i AS INTEGER) + 1, 1) AS INTEGER)"
    return (
        f"(list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {x} "
        f"WHEN {x} > 4 THEN {x} * 2 - 9 ELSE {x} * 2 END)) % 10 = 0)"
    )


def num(d: str, i: int, n: int) -> str:
    return f"TRY_CAST(substr({d}, {i}, {n}) AS BIGINT)"


def same(d: str) -> str:
    return f"(replace({d}, substr({d}, 1, 1), '') = '')"


def ssn_ok(sequential: str) -> str:
    return (
        "(length(d) = 9 AND substr(d, 1, 3) NOT IN ('000', '666') AND substr(d, 1, 1) <> '9' "
        "AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000' AND d <> '078051120' "
        f"AND NOT {same('d')} AND ({sequential} OR d NOT IN ('123456789', '987654321')))"
    )


def when(cond: str, conf: str) -> str:
    return f"CASE WHEN {cond} THEN {conf} END"


def boost(base: float, extra: float, words) -> str:
    return f"least(1.0, {base} + CASE WHEN {near(words)} THEN {extra} ELSE 0 END)"


def _rule(type_: str, name: str = ""):
    for rule in ids.identifier_rules():
        if rule.type == type_ and rule.name == name:
            return rule
    raise KeyError((type_, name))


NINE = r"\b[0-9]{9}\b"
ELEVEN = r"\b[0-9]{11}\b"


def _mod11(total: str) -> str:
    return f"(CASE WHEN 11 - {total} % 11 >= 10 THEN 0 ELSE 11 - {total} % 11 END)"


def email_conf() -> str:
    dom = "lower(split_part(value, '@', 2))"
    bad = [f"{dom} = '{d}' OR {dom} LIKE '%.{d}'" for d in ids.RESERVED_DOMAINS]
    bad += [f"{dom} LIKE '%{t}'" for t in ids.RESERVED_TLDS]
    return when(f"NOT ({' OR '.join(bad)})", "0.95")


def card_conf() -> str:
    tests = ", ".join(q(c) for c in ids.TEST_CARDS)
    return when(f"{luhn('d')} AND d NOT IN ({tests})", boost(0.95, 0.05, ids.CARD_WORDS))


def phone_us_conf() -> str:
    t = "right(d, 10)"
    ok = (
        f"substr({t}, 2, 2) <> '11' AND substr({t}, 5, 2) <> '11' "
        f"AND NOT (substr({t}, 4, 3) = '555' AND substr({t}, 7, 2) = '01')"
    )
    return when(ok, boost(0.88, 0.07, ids.PHONE_WORDS))


def phone_intl_conf() -> str:
    listed = "|".join(f"{c}(?:{s})" for c, s in NATIONAL_NUMBERS.items())
    starts = "|".join(NATIONAL_NUMBERS)
    known = f"regexp_matches(d, {q(f'^(?:{listed})$')})"
    other = (
        f"(NOT regexp_matches(d, {q(f'^(?:{starts})')}) AND regexp_matches(d, '^[2-9][0-9]{{7,14}}$'))"
    )
    return when(
        f"length(d) BETWEEN 8 AND 15 AND NOT regexp_matches(value, '^\\+[0-9]+\\.[0-9]+\\.[0-9]+') "
        f"AND ({known} OR {other})",
        boost(0.85, 0.05, ids.INTL_PHONE_WORDS),
    )


def ipv4_conf() -> str:
    known = ", ".join(q(a) for a in ids.KNOWN_ADDRESSES)
    docs = " AND ".join(f"NOT starts_with(value, '{p}')" for p in ids.DOCUMENTATION_PREFIXES)
    return when(
        f"{near(ids.IPV4_WORDS)} AND value NOT IN ({known}) AND {docs} "
        r"AND NOT regexp_matches(right(ctx, 10), '(?:^|[^0-9])v\s*$') "
        r"AND NOT regexp_matches(right(ctx, 10), 'version\s*$') "
        "AND len(list_filter(string_split(value, '.'), lambda o: CAST(o AS INTEGER) >= 30)) > 0 "
        "AND NOT regexp_matches(lower(after), '^[-.]?(?:alpha|beta|rc|dev|pre|snapshot)')",
        "0.90",
    )


def ipv6_conf() -> str:
    groups = "len(list_filter(string_split(value, ':'), lambda g: g <> ''))"
    return (
        f"CASE WHEN {groups} < 3 OR regexp_matches(value, '^[0-9a-fA-F]{{2}}(?:[:-][0-9a-fA-F]{{2}}){{5}}$') "
        f"THEN NULL WHEN {near(ids.IPV6_WORDS)} THEN 0.92 WHEN {groups} >= 6 THEN 0.85 END"
    )


def iban_conf() -> str:
    compact = "regexp_replace(value, '[^0-9A-Z]', '', 'g')"
    lengths = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in IBAN_LENGTHS.items()) + "}"
    numeric = (
        f"list_transform(string_split(substr({compact}, 5) || substr({compact}, 1, 4), ''), "
        "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS BIGINT) "
        "ELSE CAST(ascii(c) - 55 AS BIGINT) END)"
    )
    mod = (
        f"list_reduce(list_concat([CAST(0 AS BIGINT)], {numeric}), "
        "lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END)"
    )
    return when(
        f"length({compact}) = {lengths}[substr({compact}, 1, 2)] AND {mod} = 1",
        boost(0.95, 0.05, ids.IBAN_WORDS),
    )


def identifier_oracles() -> dict[str, str]:
    def one(name: str, *parts: tuple[str, str]) -> str:
        type_ = name.upper()
        return scored(*(hits(planted_sql(name), p, type_, c) for p, c in parts))

    def rule(name: str, *pairs: tuple[str, str]) -> str:
        type_ = name.upper()
        return one(name, *((_rule(type_, n).pattern, c) for n, c in pairs))

    v6 = (
        r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b|::(?:ffff:)?(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
        r"|\b(?:[0-9a-fA-F]{1,4}:){1,6}::[0-9a-fA-F]{0,4}\b"
    )
    letters = "upper(substr(value, 1, 2))"
    strict = (
        f"regexp_matches({letters}, '^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]$') "
        f"AND {letters} NOT IN ('OO', 'TN', 'XX')"
    )
    freq = (
        "list_transform(['0','1','2','3','4','5','6','7','8','9'], "
        "lambda k: length(d) - length(replace(d, k, '')))"
    )
    tax_ok = (
        f"substr(d, 1, 1) <> '0' AND list_contains({freq}, 0) AND list_max({freq}) BETWEEN 2 AND 3"
    )
    dni = "translate(substr(value, 1, length(value) - 1), 'XYZ', '012')"
    day = num("value", 10, 2)
    bsn = wsum("d", (9, 8, 7, 6, 5, 4, 3, 2, -1))
    hexa = "upper(regexp_replace(value, '[^0-9A-Fa-f]', '', 'g'))"
    mac = when(
        f"{near(ids.MAC_WORDS)} AND {hexa} NOT IN ('FFFFFFFFFFFF', '000000000000') "
        r"AND NOT regexp_matches(right(ctx, 20), '(?:color|background|fill|stroke|rgb)\s*[:=]?\s*$')",
        "0.92",
    )
    bics = ", ".join(q(c) for c in ids.BIC_COUNTRIES)
    ein = " OR ".join(f"{num('value', 1, 2)} BETWEEN {a} AND {b}" for a, b in ids.EIN_PREFIXES)
    vin = (
        "regexp_matches(substr(value, 9, 1), '[0-9X]') AND substr(value, 10, 1) NOT IN ('U','Z','0') "
        "AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') "
        "AND regexp_matches(substr(value, 1, 1), '[1-5A-HJ-NPR-Z]')"
    )
    dea = f"{wsum('value', (1, 2, 1, 2, 1, 2), 3)} % 10 = {at('value', 9)}"
    tfn = (
        f"CASE length(d) WHEN 9 THEN {wsum('d', (1, 4, 3, 7, 5, 8, 6, 9, 10))} % 11 = 0 "
        f"ELSE {wsum('d', (10, 7, 8, 4, 6, 3, 5, 1))} % 11 = 0 END"
    )
    cnpj1 = wsum("d", (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
    cnpj2 = wsum("d", (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
    rrn = wsum("d", (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5))
    routing = wsum("d", (3, 7, 1, 3, 7, 1, 3, 7, 1))
    district = num("d", 1, 2)
    pesel = wsum("d", (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))
    states = ", ".join(q(s) for s in ids.CURP_STATES)
    body = "right(upper(value), 18)"
    cn = wsum(body, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2))
    cn_conf = when(
        f"{near(ids.CN_ID_WORDS)} AND {num(body, 7, 4)} BETWEEN 1900 AND 2100 "
        f"AND {num(body, 11, 2)} BETWEEN 1 AND 12 AND {num(body, 13, 2)} BETWEEN 1 AND 31",
        f"CASE WHEN substr('10X98765432', CAST({cn} % 11 AS INTEGER) + 1, 1) = right({body}, 1) THEN 0.93 ELSE 0.85 END",
    )

    def ctx(words, conf: str, check: str = "true") -> str:
        return when(f"{near(words)} AND ({check})", conf)

    out = {
        "email": rule("email", ("", email_conf())),
        "ssn": rule(
            "ssn",
            ("separated", when(ssn_ok(near(ids.SSN_WORDS)), boost(0.95, 0.05, ids.SSN_WORDS))),
            ("bare", ctx(ids.SSN_WORDS, "0.88", ssn_ok("true"))),
        ),
        "credit_card": rule("credit_card", ("", card_conf())),
        "phone_us": rule("phone_us", ("", phone_us_conf())),
        "phone_intl": rule("phone_intl", ("", phone_intl_conf())),
        "ipv4": rule("ipv4", ("", ipv4_conf())),
        "ipv6": one("ipv6", (v6, ipv6_conf())),
        "iban": rule("iban", ("", iban_conf())),
        "crypto_wallet": rule(
            "crypto_wallet",
            ("base58", ctx(ids.CRYPTO_WORDS, "0.92")),
            ("bech32", "0.95"),
            ("hex", f"CASE WHEN {near(ids.CRYPTO_WORDS)} THEN 0.92 WHEN regexp_matches(substr(value, 3), '[A-F]') "
                    "AND regexp_matches(substr(value, 3), '[a-f]') THEN 0.85 END"),
        ),
        "uk_nin": rule("uk_nin", ("", ctx(ids.NIN_WORDS, f"CASE WHEN {strict} THEN 0.93 ELSE 0.85 END"))),
        "de_tax_id": one("de_tax_id", (ELEVEN, ctx(ids.DE_TAX_WORDS, "0.93", tax_ok))),
        "fr_ssn": rule("fr_ssn", ("", ctx(ids.FR_SSN_WORDS, "0.93",
            f"length(d) = 15 AND 97 - {num('d', 1, 13)} % 97 = {num('d', 14, 2)}"))),
        "es_dni": rule("es_dni", ("", ctx(ids.ES_DNI_WORDS, "0.93",
            f"length({dni}) = 8 AND substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(TRY_CAST({dni} AS BIGINT) % 23 AS INTEGER) + 1, 1) = right(value, 1)"))),
        "it_fiscal_code": rule("it_fiscal_code", ("", ctx(ids.IT_CODE_WORDS, "0.93",
            f"{day} BETWEEN 1 AND 31 OR {day} BETWEEN 41 AND 71"))),
        "nl_bsn": one("nl_bsn", (NINE, ctx(ids.NL_BSN_WORDS, "0.9", f"{bsn} > 0 AND {bsn} % 11 = 0"))),
        "mac_address": rule("mac_address", ("pairs", mac), ("quads", mac)),
        "ca_sin": rule("ca_sin", ("", ctx(ids.CA_SIN_WORDS, "0.92", luhn("d")))),
        "in_aadhaar": rule("in_aadhaar", ("strict", ctx(ids.AADHAAR_WORDS, "0.92")), ("loose", ctx(ids.AADHAAR_WORDS, "0.85"))),
        "swift_bic": rule("swift_bic", ("", ctx(ids.SWIFT_WORDS, "0.92", f"length(value) IN (8, 11) AND substr(value, 5, 2) IN ({bics})"))),
        "us_ein": rule("us_ein", ("", ctx(ids.EIN_WORDS, "0.90", ein))),
        "passport_us": rule("passport_us", ("digits", ctx(ids.PASSPORT_WORDS, "0.90")), ("letters", ctx(ids.PASSPORT_WORDS, "0.88"))),
        "drivers_license": rule("drivers_license", ("letter", ctx(ids.LICENSE_WORDS, "0.90")), ("digits", ctx(ids.LICENSE_WORDS, "0.85"))),
        "date_of_birth": rule("date_of_birth", *((n, ctx(ids.BIRTH_WORDS, "0.92")) for n in ("us", "iso", "named"))),
        "street_address": rule("street_address", ("", ctx(ids.ADDRESS_WORDS, "0.88"))),
        "zip_code": rule("zip_code", ("", ctx(ids.ZIP_WORDS, "0.88"))),
        "vin": rule("vin", ("", ctx(ids.VIN_WORDS, "0.92", vin))),
        "medical_license": rule("medical_license",
            ("dea", when(dea, f"0.93 + CASE WHEN {near(ids.DEA_WORDS)} THEN 0.05 ELSE 0 END")),
            ("npi", ctx(ids.NPI_WORDS, "0.90"))),
        "au_tfn": rule("au_tfn", ("", ctx(ids.TFN_WORDS, "0.92", tfn))),
        "br_cpf": rule("br_cpf", ("", ctx(ids.CPF_WORDS, "0.90", f"NOT {same('d')}"))),
        "br_cnpj": rule("br_cnpj", ("", ctx(ids.CNPJ_WORDS, "0.95",
            f"length(d) = 14 AND NOT {same('d')} AND {_mod11(cnpj1)} = {at('d', 13)} AND {_mod11(cnpj2)} = {at('d', 14)}"))),
        "kr_rrn": rule("kr_rrn", ("", ctx(ids.RRN_WORDS, "0.95",
            f"substr(d, 7, 1) BETWEEN '1' AND '4' AND {num('d', 3, 2)} BETWEEN 1 AND 12 AND {num('d', 5, 2)} BETWEEN 1 AND 31 "
            f"AND (11 - {rrn} % 11) % 10 = {at('d', 13)}"))),
        "jp_my_number": rule("jp_my_number", ("", ctx(ids.MY_NUMBER_WORDS, "0.92",
            f"{_mod11(wsum('d', (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)))} = {at('d', 12)}"))),
        "passport_uk": one("passport_uk", (NINE, ctx(ids.UK_PASSPORT_WORDS, "0.88"))),
        "us_routing": one("us_routing", (NINE, ctx(ids.ROUTING_WORDS, "0.92",
            f"{routing} % 10 = 0 AND ({district} BETWEEN 1 AND 12 OR {district} BETWEEN 21 AND 32 OR {district} BETWEEN 61 AND 72 OR {district} = 80)"))),
        "medicare_mbi": rule("medicare_mbi", ("", ctx(ids.MBI_WORDS, "0.93"))),
        "pt_nif": one("pt_nif", (r"\b[123569][0-9]{8}\b", ctx(ids.NIF_WORDS, "0.92",
            f"{_mod11(wsum('d', (9, 8, 7, 6, 5, 4, 3, 2)))} = {at('d', 9)}"))),
        "pl_pesel": one("pl_pesel", (ELEVEN, ctx(ids.PESEL_WORDS, "0.92",
            f"(10 - {pesel} % 10) % 10 = {at('d', 11)} AND {num('d', 3, 2)} % 20 BETWEEN 1 AND 12 AND {num('d', 5, 2)} BETWEEN 1 AND 31"))),
        "ch_ahv": rule("ch_ahv", ("", ctx(ids.AHV_WORDS, "0.95",
            f"(10 - {wsum('d', (1, 3) * 6)} % 10) % 10 = {at('d', 13)}"))),
        "mx_curp": rule("mx_curp", ("", ctx(ids.CURP_WORDS, "0.95",
            f"{num('value', 7, 2)} BETWEEN 1 AND 12 AND {num('value', 9, 2)} BETWEEN 1 AND 31 AND substr(value, 12, 2) IN ({states})"))),
        "in_pan": rule("in_pan", ("", when(f"{near(ids.PAN_PHRASES)} OR regexp_matches(ctx, '\\bpan\\b')", "0.93"))),
        "cn_national_id": rule("cn_national_id", ("plain", cn_conf), ("prefixed", cn_conf)),
    }
    return {f"detect_{k}": v for k, v in out.items()}
