"""Identity, privacy and alert functions against plain Python."""

import base64
import hashlib
import hmac
import json
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obslake.functions import identity as I
from obslake.functions import privacy as P
from obslake.functions import values as V
from obslake.operators import alerts as AL
from obslake.operators import warehouse as WH
from obslake.sources.registry import Registry, collect

KEY = bytes(range(32))
leaves = st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 63) - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=8)


def test_base32_is_rfc_4648(spark):
    rows = [(hashlib.sha256(bytes([i])).hexdigest(),) for i in range(50)]
    got = spark.createDataFrame(rows, "h string").select("h", I.base32(F.col("h")).alias("b")).collect()
    assert all(r["b"] == base64.b32encode(bytes.fromhex(r["h"])).decode().lower().rstrip("=") for r in got)


def test_pseudonym_is_hmac(spark):
    texts = ["a", "é x\r\ny", "z" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(P.keyed_digest(KEY, 3, "pseudonym", "email", F.col("t")).alias("d"), P.pseudonym(KEY, 3, "email", F.col("t")).alias("p")).collect()
    for t, r in zip(texts, got):
        d = hmac.digest(KEY, b"obslake-pseudonym-v1\0" + (3).to_bytes(4, "big") + b"email\0" + t.replace("\r\n", "\n").encode(), "sha256")
        assert r["d"] == d.hex() and r["p"] == "ol_ps1_e3_email_" + base64.b32encode(d[:16]).decode().lower().rstrip("=")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), leaves | st.lists(leaves, max_size=3), max_size=5))
def test_canonical_text_ignores_order(doc):
    normal = [unicodedata.normalize("NFC", k.replace("\r\n", "\n").replace("\r", "\n")) for k in doc]
    if len(set(normal)) < len(normal) or any(isinstance(x, float) and x == int(x) and abs(x) >= 2**63 and abs(x) < 1e21 for v in doc.values() for x in (v if isinstance(v, list) else [v])):
        with pytest.raises(ValueError):
            I.canonical_text(doc)
        return
    text = I.canonical_text(doc)
    assert text == I.canonical_text(dict(reversed(list(doc.items()))))
    assert I.canonical_text(json.loads(text)) == text


@pytest.mark.parametrize(("a", "b"), [("-0.0", "0"), ("1e-7", "0.0000001"), ("1.0", "1"), ('"e\\u0301"', '"é"'), ('{"b":1,"a":2}', '{"a":2,"b":1}'), ('"a\\r\\nb"', '"a\\nb"')])
def test_equal_inputs_have_one_form(a, b):
    assert I.canonical_text(json.loads(a)) == I.canonical_text(json.loads(b))


@pytest.mark.parametrize("bad", ["1e400", "9223372036854775808", '{"a":1,"a":2}', "[" * 40 + "]" * 40, '{"e\\u0301":1,"é":2}', "{"])
def test_refused_inputs_have_none(spark, bad):
    assert spark.createDataFrame([(bad,), ("[1]",)], "t string").select(I.canonical_json("t").alias("c")).collect() == [(None,), ("[1]",)]


def test_values(spark):
    rows = spark.createDataFrame([("90s",), ("2d",), ("0s",), ("5w",), (None,)], "t string").select(V.duration_seconds(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == [90, 172_800, None, None, None]


@pytest.mark.parametrize(
    ("url", "value", "removed"),
    [
        ("HTTPS://User:pw@Example.COM:443/a?x=1&page=2&page=b%20#f", "https://example.com/a?page=2", ["fragment", "query", "userinfo"]),
        ("http://e.org:8080", "http://e.org:8080", []), ("http://e.org:80/?page=1", "http://e.org/?page=1", []), ("http://e.org/?", "http://e.org/", []), ("ftp://e.org/", None, None), ("http://e.org/a%2", None, None), ("http:///x", None, None),
    ],
)
def test_urls(spark, url, value, removed):
    r = spark.createDataFrame([(url,)], "u string").select(P.sanitized_url(F.col("u"), ("page",)).alias("s")).first()["s"]
    assert (r and (r["value"], list(r["removed"]))) == (None if value is None else (value, removed))


def test_hosts_and_addresses(spark):
    r = spark.createDataFrame([("http://bücher.example/", "[2001:DB8::1]")], "u string, a string").select(P.sanitized_url(F.col("u"), idna=True)["value"].alias("u"), P.canonical_ip("a").alias("a")).first()
    assert tuple(r) == ("http://xn--bcher-kva.example/", "2001:db8::1")


def test_redaction_leaves_no_planted_value(spark):
    planted = {
        "email": "Jörg.x@mail.example.org", "ip": "10.1.2.3", "phone": "+1 555-123-4567", "path": "/etc/passwd", "tilde": "~/.ssh/id", "win": r"C:\Users\me\a.txt", "unc": r"\\host\share\f", "rel": "../a/b", "file": "file:///tmp/x",
        "v6": "fe80:0:0:0:1:2:3:4", "secret": "correct-horse-battery", "b64": base64.b64encode(b"correct-horse-battery").decode(),
    }
    text = "\n".join(f"{k} is {v} here" for k, v in planted.items()) + "\npassword = hunter22\nAuthorization: Bearer abc\n-----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY-----\nsee https://u:p@e.org/p?q=1#f."
    out = P.redact(spark.createDataFrame([(text,), (None,), ("plain text\u200b",)], "t string"), ["t"], KEY, secrets=("correct-horse-battery",)).collect()
    got = out[0]["t"]
    assert not [v for v in (*planted.values(), "hunter22", "Bearer", "MII", "u:p", "q=1") if v in got] and "https://e.org/p." in got
    assert out[0]["redactions"] == {"secret": 2, "private_key": 1, "credential": 2, "url": 1, "email": 1, "path": 6, "ip": 2, "phone": 1}
    assert out[1]["t"] is None and out[2]["t"] == "plain text" and out[2]["redactions"] == {"control": 1}


def brute_fold(samples, failures, successes, cooldown):
    state, fails, wins, until, out = "inactive", 0, 0, None, []
    for k, (at, record, outcome) in enumerate(samples, 1):
        fails, wins = (fails + 1, 0) if outcome == "failure" else (0, wins + 1)
        if record and outcome == "failure" and state != "firing" and fails >= failures and (until is None or at >= until):
            out.append((state, "firing", k))
            state, until = "firing", at + cooldown
        elif record and outcome == "success" and state == "firing" and wins >= successes:
            out.append((state, "resolved", k))
            state = "resolved"
    return out


@pytest.mark.parametrize("cooldown", [0, 900])
def test_alerts_match_a_plain_fold(spark, cooldown):
    import random

    r, rows, want = random.Random(cooldown), [], {}
    for k in range(12):
        f, s = r.randint(1, 4), r.randint(1, 4)
        samples = [(60 * n, None if r.random() < 0.2 else f"r{n:03d}", r.choice(("failure", "success"))) for n in range(60)]
        rows += [(f"rule{k}", 1, "t", pd.Timestamp(a, unit="s").to_pydatetime(), rec, o, f, s, cooldown) for a, rec, o in samples]
        want[f"rule{k}"] = brute_fold(samples, f, s, cooldown)
    df = spark.createDataFrame(rows, "rule_id string, rule_version int, target string, sampled_at timestamp, record_id string, outcome string, consecutive_failures int, consecutive_successes int, cooldown_seconds int")
    for make in [AL.transitions_with_cooldown] + ([] if cooldown else [AL.transitions]):
        got = {k: [] for k in want}
        for x in make(df).orderBy("rule_id", "revision").collect():
            got[x["rule_id"]].append((x["previous_state"], x["state"], x["revision"]))
        assert got == want


def test_current_view_ignores_order_and_repeats(spark):
    rows = [(f"t{i % 2}", "event", f"r{i % 5}", i // 5, f"h{i}", 100 + i) for i in range(20)]
    schema = "target_id string, record_type string, record_id string, ingested_at int, content_hash string, x int"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(rows[::-1] + rows, schema)
    newest = [sorted(map(tuple, WH.newest(d, WH.CURRENT_KEY, "ingested_at", "content_hash").collect())) for d in (a, b)]
    assert newest[0] == newest[1] and len(newest[0]) == 10


def test_restricted_rows_refuse_the_export(spark):
    rows = spark.createDataFrame([("restricted",)], "privacy_class string").selectExpr("privacy_class", "named_struct('id', 't') AS target", "named_struct('id', 's') AS source", "'event' AS record_type", "'r' AS record_id", "'d' AS dedupe_key", "'c' AS content_hash", "'n' AS name", "'i' AS severity", "'a' AS trust_level", "'target' AS scope", "current_timestamp() AS occurred_at", "current_timestamp() AS observed_at", "current_timestamp() AS ingested_at", "current_timestamp() AS expires_at", "named_struct('type', 'event') AS data")
    with pytest.raises(Exception, match="OL_EGRESS_RESTRICTED"):
        WH.export(rows)[0]["records"].collect()


def test_registry(spark):
    r = Registry()
    r.register("a", lambda s, c: s.range(c["n"]))
    with pytest.raises(ValueError, match="DUPLICATE"):
        r.register("a", None)
    with pytest.raises(KeyError):
        r.resolve("b")
    assert collect(r, "a", spark, {"n": 3}).count() == 3 and r.names() == ["a"]
    with pytest.raises(ValueError, match="DRAFTS"):
        collect(r, "a", spark, {"n": 3, "most_drafts": 2})
