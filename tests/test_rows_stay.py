"""No row and no personal value may be lost or left in clear, whatever is null, blank or long."""

from maskwell.operators import filters, mask
from maskwell.plans.scan import Policy, scan_messages
from maskwell.rules.credentials import credential_rules
from maskwell.sources.tables import load_rules, rules_frame

SCHEMA = "doc_id string, session_id string, turn int, ts timestamp, provider string, text string"
SSN = "234-56-7890"


def messages(spark):
    rows = [
        ("a", None, None, None, None, f"my ssn is {SSN}"),
        ("b", "s", None, None, "claude", f"my ssn is {SSN}"),
        ("c", "s", 3, None, "claude", "x " * 150_000 + f"my ssn is {SSN}"),
        ("d", "s", 4, None, "grok", f"my ssn is {SSN}"),
        ("e", "s", 5, None, None, "  "),
        ("f", "s", 6, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_scan_keeps_every_message(spark):
    out = {r.doc_id: r for r in scan_messages(messages(spark), Policy(providers={"grok": False})).collect()}
    assert {k: [s.value for s in r.spans] for k, r in out.items()} == {
        "a": [SSN], "b": [SSN], "c": [SSN], "d": [], "e": [], "f": [],
    }
    assert out["d"].text == f"my ssn is {SSN}"
    off = scan_messages(messages(spark), Policy(protection=False)).collect()
    assert len(off) == 6 and not any(r.spans for r in off)


def test_masks_without_session_or_turn(spark):
    found = scan_messages(messages(spark).filter("text IS NOT NULL"))
    spans = found.selectExpr("session_id", "turn", "doc_id", "explode(spans) AS s").select("session_id", "turn", "s.*")
    numbers = mask.assign_placeholders(spans)
    out = mask.anonymize(found, numbers).collect()
    assert len(out) == 5 and not any(SSN in r.masked_text for r in out)
    assert {r.masked_text for r in out if r.doc_id in "abd"} == {"my ssn is [SSN_1]"}
    unknown = mask.anonymize(found, numbers.limit(0)).collect()
    assert not any(SSN in r.masked_text for r in unknown)


def test_a_message_without_provider_stays(spark):
    assert filters.filter_providers(messages(spark), {"grok": False}).count() == 5


def test_rules_survive_a_table(spark):
    rules = sorted(credential_rules(), key=lambda r: r.order)
    assert load_rules(rules_frame(spark, rules)) == rules
