"""Redaction of encoded, quoted and composed forms, addresses by their canonical forms, and evidence beyond its bounds."""

import base64
import unicodedata
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from obslake.functions import privacy as P
from obslake.functions.values import configuration
from obslake.operators import contracts as C

KEY = bytes(range(32))
SECRET = "correct-horse+battery"


def redacted(spark, texts, **more):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [(r["t"], r["redactions"]) for r in P.redact(rows, ["t"], KEY, **more).orderBy("k").collect()]


def test_secrets_in_encoded_layers(spark):
    raw = SECRET.encode()
    forms = [
        SECRET, raw.hex(), raw.hex().upper(), quote(SECRET, safe=""), "".join(f"%{b:02X}" for b in raw), "".join(f"&#{b};" for b in raw), "".join(f"&#x{b:x};" for b in raw),
        base64.b64encode(raw).decode(), base64.b64encode(base64.b64encode(raw)).decode(), *(base64.b64encode(b"x" * k + raw + b"yy").decode() for k in (1, 2, 3)),
    ]
    for (text, counts), form in zip(redacted(spark, [f"a {f} b" for f in forms], secrets=(SECRET,)), forms):
        assert counts.get("secret") == 1 and "[ol:s]" in text, form


def test_matches_are_replaced_where_they_stand(spark):
    text = "1.2.3.4 and v1.2.3.4.5 and 1.2.3.4"
    ((got, counts),) = redacted(spark, [text])
    token = got.split()[0]
    assert got == f"{token} and v1.2.3.4.5 and {token}" and counts == {"ip": 2}


def test_one_address_has_one_token(spark):
    same = [("fe80::a", "fe80:0:0:0:0:0:0:000A"), ("a@Example.ORG", "a@example.org"), ("J\u00f6rg@e.org", unicodedata.normalize("NFD", "J\u00f6rg@e.org"))]
    for pair in same:
        (one, _), (two, _) = redacted(spark, pair)
        assert one == two and one.startswith("ol_ps1_e1_")
    ((clock, counts),) = redacted(spark, ["at 12:34:56 sharp"])
    assert clock == "at 12:34:56 sharp" and not counts


@pytest.mark.parametrize("path", ['"/home/me/my files/a.txt"', "'C:\\Program Files\\x y.log'", "`~/a b/c`", "file:///tmp/x", "../a/b", "\\\\host\\share\\f"])
def test_paths_quoted_and_bare(spark, path):
    ((got, counts),) = redacted(spark, [f"see {path} now"])
    assert counts == {"path": 1} and path.strip("\"'`") not in got and got.endswith("now")
    ((again, counts),) = redacted(spark, [got])
    assert again == got and not counts


def test_a_key_without_its_end_is_hidden_to_the_end(spark):
    ((got, counts),) = redacted(spark, ["x -----BEGIN EC PRIVATE KEY-----\nMII\nabc"])
    assert got == "x [ol:k]" and counts == {"private_key": 1}


def test_evidence_is_refused_not_cut(spark):
    rows = [("a\nb",), ("x" * 10_241,), ("x" * 10_240,), ("\n" * 200,), (None,)]
    df = spark.createDataFrame(rows, "t string").select(P.rendered_evidence(F.col("t")).alias("r")).select("r.*")
    got = [(None if r["value"] is None else len(r["value"]), r["error"]) for r in df.collect()]
    label = len("untrusted evidence:\n")
    assert got == [(label + 7, None), (None, "OL_EVIDENCE_BYTES"), (label + 2 + 10_240, None), (None, "OL_EVIDENCE_LINES"), (None, None)]


def test_configuration_is_counted_before_it_is_sent(spark):
    assert configuration(spark.range(5), most=5).count() == 5
    with pytest.raises(ValueError, match="at most 4"):
        configuration(spark.range(5), most=4)


def test_collector_provenance_goes_both_ways(spark):
    schema = "source struct<producer:string>, collector struct<id:string>, collector_run_id string"
    rows = [(("collector",), ("c",), "r"), (("collector",), ("c",), None), (("importer",), ("c",), None), (("importer",), None, None)]
    rule = C.envelope_rules()["OL_PROVENANCE"]
    assert [r[0] for r in spark.createDataFrame(rows, schema).select(rule).collect()] == [True, False, False, True]


def test_addresses_with_dotted_tails_and_zones(spark):
    same = ["::ffff:1.2.3.4", "::FFFF:102:304", "0:0:0:0:0:ffff:1.2.3.4", "::ffff:1.2.3.4%eth0"]
    got = redacted(spark, [f"at {t} now" for t in same] + ["fe80::1%eth0.", "fe80::1", "64:ff9b::192.0.2.33, x", "1.2.3.4:80"])
    assert len({t for t, _ in got[:4]}) == 1 and all(c == {"ip": 1} for _, c in got[:7])
    assert got[4][0] == got[5][0] + "." and "eth0" not in got[3][0] and "192" not in got[6][0]
    assert not any("." in t.split()[1] for t, _ in got[:4])


def test_secrets_in_digits_of_either_case(spark):
    raw = SECRET.encode()
    mixed = lambda s: "".join(c.upper() if k % 3 else c.lower() for k, c in enumerate(s))
    forms = [mixed(raw.hex()), "".join(mixed(f"%{b:02x}") for b in raw), quote(SECRET, safe="").replace("%2B", "%2b"), "".join(f"&#x{b:{'X' if k % 2 else 'x'}};" for k, b in enumerate(raw))]
    for (text, counts), form in zip(redacted(spark, [f"a {f} b" for f in forms], secrets=(SECRET,)), forms):
        assert counts.get("secret") == 1 and text == "a [ol:s] b", form
    ((text, counts),) = redacted(spark, [f"a {SECRET.upper()} b"], secrets=(SECRET,))
    assert "secret" not in counts  # a secret itself is told by its case


def test_emails_in_long_domains_and_in_urls(spark):
    long = "a@" + ".".join("bcdefghijk") + ".example.com"
    (one, _), (two, counts), (three, _) = redacted(spark, ["alice@x.example", "https://example.org/u/alice@x.example/z", "mail a/b@x.example now"])
    assert redacted(spark, [long])[0][0].startswith("ol_ps1_e1_email_") and "example" not in redacted(spark, [long])[0][0]
    assert two == f"https://example.org/u/{one}/z" and counts["email"] == 1
    assert "a/" not in three and three.endswith(" now")


@pytest.mark.parametrize("text", ["https://a.example/p.", "(see https://a.example/p)", "https://a.example/p?!", "[https://a.example/p]", "https://a.example/p;"])
def test_urls_end_before_the_sentence_does(spark, text):
    ((got, counts),) = redacted(spark, [text])
    assert got == text and counts == {"url": 1}


@pytest.mark.parametrize("text", ["and/or", "a / b", "yes/no/", "1/2", "/. then", "x /, y"])
def test_slashes_that_are_no_paths(spark, text):
    ((got, counts),) = redacted(spark, [text])
    assert got == text and not counts


@pytest.mark.parametrize("text", ["/etc/passwd", "/.ssh/id", "/..", "/tmp/a\\ b", "~/x", "/é/z", "/home/u|x"])
def test_posix_paths(spark, text):
    ((got, counts),) = redacted(spark, [f"in {text}"])
    assert counts == {"path": 1} and "/" not in got and (got.endswith("|x") or "|" not in text)


def test_a_match_is_searched_and_its_token_computed_once(spark):
    rows = spark.createDataFrame([(0, "1.2.3.4 a@b.example")], "k int, t string")
    plan = P.redact(rows, ["t"], KEY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 10  # two for each of email, both kinds of addresses, phone and path
    assert plan.count(P.IPV4) == plan.count(P.EMAIL) == 1
