"""PII masking / detection: goldens, Python ``re`` parity, properties."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimflow.functions.pii_rules import BUILTIN_RULES, DEFAULT_REGISTRY, PiiRegistry
from claimflow.operators import pii
from claimflow.sources import views

GOLDEN = [
    ("SSN 123-45-6789.", "SSN XXX-XX-XXXX.", {"ssn": 1}, {"ssn": 1}),
    ("Call (555) 123-4567 now", "Call ((XXX) XXX-XXXX now", {"phone": 1}, {"phone": 1}),
    ("Account: 1234567890", "Account: (XXX) XXX-XXXX", {"phone": 1}, {"phone": 1, "bank_account": 1}),
    ("Account: 123456789012", "Account: XXXXXXXXXX", {"bank_account": 1}, {"bank_account": 1}),
    ("Acct #1234567812345678", "Acct #XXXX-XXXX-XXXX-XXXX", {"credit_card": 1}, {"credit_card": 1, "bank_account": 1}),
    ("Account: 12345678901234567", "Account: XXXXXXXXXX", {"bank_account": 1}, {"bank_account": 1, "vin": 1}),
    ("license plates were lost", "DL: XXXXXXXXX were lost", {"drivers_license": 1}, {"drivers_license": 1}),
    ("Card 4111 1111-11111111", "Card XXXX-XXXX-XXXX-XXXX", {"credit_card": 1}, {"credit_card": 1}),
    ("a@b.co, A.B+c@X.ORG", "[EMAIL_REDACTED], [EMAIL_REDACTED]", {"email": 2}, {"email": 2}),
    ("dob: 1/2/1990", "DOB: XX/XX/XXXX", {"date_of_birth": 1}, {"date_of_birth": 1}),
    ("theresblereenthea ok", "VIN: XXXXXXXXXXXXX ok", {"vin": 1}, {"vin": 1}),
    ("é123-45-6789", "é123-45-6789", {}, {}),
    ("١٢٣-٤٥-٦٧٨٩", "XXX-XX-XXXX", {"ssn": 1}, {"ssn": 1}),
    ("", "", {}, {}),
    ("sep  in 123-45-6789", "sep  in XXX-XX-XXXX", {"ssn": 1}, {"ssn": 1}),
]


def py_mask(text, rules=BUILTIN_RULES):
    dets, t = [], text
    for name, p, r, _d in rules:
        dets += [(name, m.group(), m.start(), m.end()) for m in re.finditer(p, t, re.I)]
        t = re.sub(p, r, t, flags=re.I)
    return t, dets


def py_detect(text, rules=BUILTIN_RULES):
    return [(name, m.group(), m.start(), m.end()) for name, p, _r, _d in rules for m in re.finditer(p, text, re.I)]


def _run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = pii.detect_document(pii.mask_document(df, "text"), "text", prefix="a_")
    return {r.id: r for r in out.collect()}


def test_goldens(spark):
    rows = _run(spark, [g[0] for g in GOLDEN])
    for i, (text, masked, seq, det) in enumerate(GOLDEN):
        r = rows[i]
        assert r.filtered_text == masked, text
        assert dict(r.by_type) == seq, text
        assert dict(r.a_by_type) == det, text
        assert r.total_detections == sum(seq.values())
        assert r.a_has_sensitive_data == bool(det)


def _check_parity(rows, texts):
    for i, t in enumerate(texts):
        r = rows[i]
        masked, dets = py_mask(t)
        assert r.filtered_text == masked
        assert [(d.type, d.original, d.stage_start, d.stage_end) for d in r.detections] == dets
        assert [(d.type, d.found, d.start, d.end) for d in r.a_detections] == py_detect(t)


def test_parity_with_python_re_on_claims_and_documents(spark):
    from tests.conftest import SF_SMALL
    from claimflow.sources.tables import read_table
    claims = [r.claim_text for r in views.claims(spark, SF_SMALL).collect()]
    docs = [r.text for r in read_table(spark, SF_SMALL, "documents").collect()]
    texts = claims + docs
    _check_parity(_run(spark, texts), texts)


ALPHABET = st.sampled_from(list("0123456789-() .@#:/aAbBeEsSlLtTxX\n") + ["Acct", "DOB:", "License", "é", "١", ""])


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=60).map("".join), min_size=40, max_size=40))
def test_property_parity(spark, texts):
    _check_parity(_run(spark, texts), texts)


def test_no_types_is_identity_and_subset_semantics(spark):
    df = spark.createDataFrame([(1, "SSN 123-45-6789 a@b.co")], "id int, text string")
    r = pii.mask_document(df, "text", types=[]).collect()[0]
    assert r.filtered_text == "SSN 123-45-6789 a@b.co" and r.total_detections == 0
    r = pii.mask_document(df, "text", types=["email", "bogus", "email"]).collect()[0]
    assert r.filtered_text == "SSN 123-45-6789 [EMAIL_REDACTED]" and r.n_email == 1
    assert pii.mask_text  # quick path exists
    q = df.select(pii.mask_text("text", ["ssn"]).alias("m")).collect()[0].m
    assert q == "SSN XXX-XX-XXXX a@b.co"


def test_custom_rule_append_and_overwrite(spark):
    reg = DEFAULT_REGISTRY.copy().add_custom("policy", r"\bPOL-\d{4}\b", "POL-$$", "Policy")
    reg.add_custom("email", r"\S+@\S+", "<mail>", "Email")
    assert reg.names[-1] == "policy" and reg.names.index("email") == 2
    df = spark.createDataFrame([(1, "POL-1234 x@y.z")], "id int, text string")
    r = pii.mask_document(df, "text", registry=reg).collect()[0]
    assert r.filtered_text == "POL-$$ <mail>"  # replacement inserted literally
    with pytest.raises(ValueError):
        PiiRegistry().add_custom("bad", r"x*", "y", "empty match")
    with pytest.raises(ValueError):
        PiiRegistry().add_custom("bad", r"(a)", r"\1", "backref")


def test_report_and_switch(spark):
    df = spark.createDataFrame([(1, "SSN 123-45-6789"), (2, "clean")], "id int, text string")
    rows = {r.id: r for r in pii.filter_report(pii.mask_document(df, "text")).collect()}
    assert "Total Detections: 1" in rows[1].report and "  - ssn: 1" in rows[1].report
    assert rows[2].report.endswith("No sensitive information detected.")
    off = pii.apply_filtering(df, False, "text").collect()
    assert all(r.filtered_text == r.text and r.total_detections == 0 for r in off)


def test_corpus_summary(spark):
    df = spark.createDataFrame([(1, "123-45-6789 987-65-4321"), (2, "a@b.co")], "id int, text string")
    s = {r.type: r for r in pii.corpus_summary(pii.mask_document(df, "text"), DEFAULT_REGISTRY.names).collect()}
    assert s["ssn"].n_detections == 2 and s["ssn"].n_documents == 1 and s["email"].n_detections == 1
    assert s["vin"].n_detections == 0


def test_many_matches_use_blocked_spans(spark):
    # > 512 parts per rule: start offsets come from the blocked prefix sums.
    texts = [" ".join(f"{i % 1000:03d}-{i % 100:02d}-{i:04d} a@b.co x" for i in range(1500)),
             "lead " + "4111 1111 1111 1111, " * 700]
    _check_parity(_run(spark, texts), texts)
