"""Identity and privacy queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import privacy as P
from ..functions.values import parse_position, position_text, timestamp_text
from ..sources import adapters as A
from ..sources.adapters import INSTALLATION, NAMESPACE, table

KEY = bytes(range(32))
col = F.col


def record_digests(spark, d):
    """The three digests before they become tokens."""
    e = A.event_drafts(table(spark, d, "events"))
    return e.select("source_event_id", I.digest("record-id", I.identity_text(INSTALLATION)).alias("record_digest"), I.digest("dedupe", I.dedupe_text(INSTALLATION)).alias("dedupe_digest"))


def record_tokens(spark, d):
    r = I.finalize(A.event_drafts(table(spark, d, "events")), INSTALLATION)
    return r.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("ids"), F.countDistinct("dedupe_key").alias("keys"), F.min(I.is_token("record-id", col("record_id"))).alias("ids_ok"), F.min(I.is_token("dedupe", col("dedupe_key"))).alias("keys_ok"))


def verified_identity(spark, d):
    """Every seventh record's message was changed after its hash, every eleventh its name."""
    r = I.finalize(A.event_drafts(table(spark, d, "events")), INSTALLATION)
    n = col("source_event_id").cast("long")
    r = r.withColumn("data", col("data").withField("message", F.when(n % 7 == 0, "tampered").otherwise(col("data")["message"]))).withColumn("name", F.when(n % 11 == 0, "source.other").otherwise(col("name")))
    return I.verify_identity(r, INSTALLATION).groupBy("id_ok", "dedupe_ok", "content_ok").agg(F.count(F.lit(1)).alias("n"))


def content_is_stable(spark, d):
    """Delivery fields and the collector's version do not change the content hash."""
    a = A.event_drafts(table(spark, d, "events"))
    b = a.withColumn("ingested_at", col("ingested_at") + F.expr("INTERVAL 1 DAY")).withColumn("operation_id", F.lit("other")).withColumn("collector", col("collector").withField("implementation_version", F.lit("9.9")))
    ha, hb = (I.finalize(x, INSTALLATION).select("record_id", "content_hash") for x in (a, b))
    return ha.join(hb.withColumnRenamed("content_hash", "other"), "record_id").agg(F.count(F.lit(1)).alias("n"), F.sum((col("content_hash") == col("other")).cast("long")).alias("same"))


def generation_digests(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", I.generation_digest(col("s_name"), col("s_nationkey").cast("string")).alias("digest"))


def canonical_props(spark, d):
    """General canonical JSON of documents with unsorted keys, floats and nulls."""
    e = table(spark, d, "events")
    doc = F.concat(F.lit('{"z": '), col("user_id").cast("string"), F.lit('.0, "a": {"y": "\\u0065\\u0301", "b": [1, true, null]}, "e": "'), col("event_type"), F.lit('"}'))
    return e.select("event_id", I.canonical_json(doc).alias("canonical"))


def pseudonyms(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", P.keyed_digest(KEY, 1, "pseudonym", "name", col("c_name")).alias("digest"), F.length(P.pseudonym(KEY, 1, "name", col("c_name"))).alias("n"), F.length(P.fingerprint(KEY, 1, "name", col("c_name"))).alias("f"))


def sanitized_urls(spark, d):
    u = P.sanitized_url(col("url"), ("page",))
    return table(spark, d, "pages").select("page_id", u["value"].alias("url"), F.array_join(u["removed"], ",").alias("removed"))


def path_tokens(spark, d):
    p = table(spark, d, "part")
    token = P.local_path_token(KEY, 1, F.concat(F.lit("C:\\"), col("p_brand"), F.lit("\\"), col("p_name")))
    same = P.local_path_token(KEY, 1, F.concat(F.lit("C:/"), col("p_brand"), F.lit("/"), col("p_name")))
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum((token == same).cast("long")).alias("same"), F.countDistinct(token).alias("tokens"))


def normalized_documents(spark, d):
    text = F.concat(col("text"), F.when(col("doc_id") % 3 == 0, "\r\n\x07\u200b").otherwise("\r"))
    clean, n = P.normalized_text(text)
    return table(spark, d, "documents").select("doc_id", F.char_length(clean).alias("n_chars"), n.alias("removed"))


def redaction_totals(spark, d):
    """Planted rows: a line of each category, as often as digits of the key say."""
    o = table(spark, d, "orders")
    n = col("o_orderkey")
    lines = {3: "mail a.b@example.org", 4: "call +1 (212) 555-0147", 5: "host 10.1.2.3", 6: "file /var/log/a.log", 7: "password = hunter22", 8: "go https://example.org/a?b=c", 9: "Cookie: a=b", 10: "use correct-horse-battery", 11: "use 636f72726563742d686f7273652d62617474657279"}
    text = F.concat_ws("\n", F.col("o_comment") if "o_comment" in o.columns else F.lit("plain"), *[F.when(n % k == 0, line) for k, line in lines.items()])
    return P.redaction_counts(P.redact(o.select(text.alias("text")), ["text"], KEY, secrets=("correct-horse-battery",)))


def redacted_documents(spark, d):
    """Counts over all whole documents."""
    docs = P.redact(table(spark, d, "documents").select("doc_id", "text"), ["text"], KEY, secrets=("correct-horse-battery",))
    return P.redaction_counts(docs)


def redacted_conversations(spark, d):
    """Whole turns with planted addresses and secrets behind them: what the planted part adds to the counts, and whether any of it is left."""
    t = table(spark, d, "conversations")
    tail = F.concat(F.lit("\n mail joe.doe"), col("conv_id"), F.lit("@example.org from 10.0.0."), col("turn") % 250, F.lit(" see https://u:p@Example.com:443/a?b=1#c or /etc/passwd and ~/x/y\npassword: hunter22 correct-horse-battery Y29ycmVjdC1ob3JzZS1iYXR0ZXJ5"))
    rows = t.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("before"), F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))
    with_tail = P.redact(rows, ["text"], KEY, secrets=("correct-horse-battery",)).withColumnRenamed("redactions", "all")
    out = P.redact(with_tail, ["before"], KEY, secrets=("correct-horse-battery",))
    more = lambda c: F.coalesce(F.element_at("all", c), F.lit(0)) - F.coalesce(F.element_at("redactions", c), F.lit(0))
    return out.select("conv_id", "turn", more("email").alias("email"), more("credential").alias("credential"), col("text").rlike("joe\\.doe|hunter22|battery|Y29y|/etc/passwd|u:p@").alias("leak"))


def redacted_addresses(spark, d):
    """Planted forms of one address each: digits of a version are none, and all forms of an address have one token."""
    e = table(spark, d, "events")
    n = col("event_id") % 200
    text = F.concat(F.lit("1.2.3."), n, F.lit(" and v1.2.3."), n, F.lit(".5, fe80::"), F.hex(n + 1), F.lit(" fe80:0:0:0:0:0:0:"), F.lower(F.hex(n + 1)), F.lit(" at 12:34:56, a@Example.COM a@example.com"))
    out = P.redact(e.select("event_id", text.alias("text")), ["text"], KEY)
    ip, mail = F.regexp_extract_all("text", F.lit("ol_ps1_e1_ip_[a-z2-7]+"), F.lit(0)), F.regexp_extract_all("text", F.lit("ol_ps1_e1_email_[a-z2-7]+"), F.lit(0))
    return out.select("event_id", F.size(ip).alias("ips"), F.size(F.array_distinct(ip)).alias("addresses"), F.size(F.array_distinct(mail)).alias("mails"), F.contains(col("text"), F.concat(F.lit("v1.2.3."), n, F.lit(".5"))).alias("version_left"), F.contains(col("text"), F.lit("12:34:56")).alias("time_left"))


def redaction_is_stable(spark, d):
    once = P.redact(table(spark, d, "documents").select("doc_id", "text"), ["text"], KEY)
    twice = P.redact(once.drop("redactions").withColumn("before", col("text")), ["text"], KEY)
    return twice.agg(F.count(F.lit(1)).alias("n"), F.sum((col("text") == col("before")).cast("long")).alias("same"))


def redacted_drafts(spark, d):
    e = A.event_drafts(table(spark, d, "events")).withColumn("data", col("data").withField("message", F.concat(col("data")["message"], F.lit(" by a@b.example.com"))))
    return P.redact_drafts(e, "event", KEY).select(F.element_at("redactions", "email").alias("email"), "redaction_version").groupBy("email", "redaction_version").agg(F.count(F.lit(1)).alias("n"))


def allowlisted_props(spark, d):
    e = table(spark, d, "events").withColumn("body", F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").alias("k"), F.when(col("user_id") % 5 > 0, col("event_type")).alias("kind")).alias("a"), col("user_id").alias("u"), col("value").alias("v"))))
    out = P.allowlisted(e, "body", {"a.kind!": "text", "a.k": "scalar", "w": "scalar"}, KEY)
    return out.select("event_id", col("fields")["a_kind"].alias("kind"), col("fields")["a_k"].alias("k"), "discarded", "error")


def allowlisted_nested(spark, d):
    """Documents three levels deep: discards and redactions counted at each level, and each kind of error."""
    body = F.concat(
        F.lit('{"a":{"b":'), F.when(col("event_id") % 11 == 0, F.lit("[1]")).otherwise(F.concat(F.lit('{"note":"call '), F.lpad(col("user_id").cast("string"), 3, "0"), F.lit('-555-0123","n":'), col("user_id").cast("string"), F.when(col("event_id") % 2 == 0, ',"x":1,"y":{"z":[2]}').otherwise(""), F.lit("}"))),
        F.when(col("event_id") % 3 == 0, ',"u":"https://h.example/p?t=1"').otherwise(""), F.lit(',"w":null},"k":'), F.when(col("event_id") % 7 == 0, '{"deep":true}').otherwise('"me@h.example"'), F.when(col("event_id") % 13 == 0, "").otherwise("}"))
    rules = {"a.b.note": "text", "a.b.n": "scalar", "a.u": "url", "k!": "scalar"}
    out = P.allowlisted(table(spark, d, "events").withColumn("body", body), "body", rules, KEY)
    count = lambda c: F.coalesce(F.element_at("redactions", c), F.lit(0).cast("long"))
    return out.select("event_id", col("fields")["a_b_n"].alias("n"), col("fields")["a_u"].alias("u"), "discarded", count("phone").alias("phones"), count("email").alias("emails"), count("url").alias("urls"), "error")


def egress_decisions(spark, d):
    o = table(spark, d, "orders")
    pick = lambda v, n: F.element_at(F.array(*[F.lit(x) for x in v]), (n % len(v) + 1).cast("int"))
    allowed = F.when(col("o_custkey") % 3 == 0, F.array(F.lit("public"))).when(col("o_custkey") % 3 == 1, F.array(F.lit("public"), F.lit("sensitive"))).otherwise(F.array().cast("array<string>"))
    r = o.select("o_orderkey", pick((*P.EGRESS, "moon"), col("o_orderkey")).alias("surface"), pick(P.CLASSES, F.floor(col("o_orderkey") / 12)).alias("privacy_class"), (col("o_custkey") % 2 == 0).alias("explicitly_enabled"), allowed.alias("allowed"))
    return P.authorize(r).select("o_orderkey", "disposition", "denied")


def disclosed_events(spark, d):
    """Records as a log, a report and a query may show them."""
    e = table(spark, d, "events").select("event_id", "event_type", "value", A.privacy_of(col("user_id")).alias("privacy_class"), F.element_at(F.array(F.lit("local_log"), F.lit("repo_brief"), F.lit("cli_query")), (col("event_id") % 3 + 1).cast("int")).alias("surface"), F.lit(False).alias("explicitly_enabled"), F.lit(None).cast("array<string>").alias("allowed"))
    out = P.authorize(e).select("event_id", "event_type", "value", "disposition")
    return P.shaped(out, ["event_id", "event_type"], [])


def rendered_parts(spark, d):
    """Some parts have a text beyond the bounds of evidence: refused, not cut."""
    big = F.when(col("p_partkey") % 7 == 0, F.repeat(F.lit("x"), 10_300)).when(col("p_partkey") % 11 == 0, F.repeat(F.lit("\n"), 250)).otherwise("")
    p = table(spark, d, "part").withColumn("t", F.concat(col("p_name"), F.lit("\n<b>&\x07"), big))
    html, plain = P.rendered_evidence(col("t"), "html"), P.rendered_evidence(col("t"))
    return p.select("p_partkey", html["value"].alias("html"), plain["value"].alias("plain"), plain["error"].alias("error"))


def positions_round_trip(spark, d):
    s = table(spark, d, "supplier").withColumn("t", position_text(col("s_name"), col("s_suppkey"), col("s_suppkey") * 3, F.when(col("s_suppkey") % 9 == 0, F.lit(-1)).otherwise(col("s_nationkey")).cast("long"), F.sha2("s_name", 256)))
    p = parse_position(col("t"))
    return s.select("s_suppkey", p["offset"].alias("offset"), p["source"].alias("source"))


def canonical_times(spark, d):
    return table(spark, d, "events").select("event_id", timestamp_text(F.date_trunc("MILLISECOND", col("ts"))).alias("at"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_SRC = f"'\"observation_namespace_id\":\"{NAMESPACE}\"'"
_OBS = "'\"observation\":{\"kind\":\"source.event\",\"parts\":{\"event_id\":' || event_id || '}}'"
_IDENTITY = f"""'{{"identity_version":1,"installation_id":"{INSTALLATION}","name":"source.event",' || {_OBS} || ',"record_type":"event","redaction_version":"r2-e1","schema_version":"1.0","scope":"target","source":{{"id":"events",' || {_SRC} || ',"source_generation_digest":"' || sha256('events' || chr(0) || 'c' || user_id) || '","type":"site.canary"}},"source_event_id":"' || event_id || '","target_id":"t' || (user_id % 10) || '"}}'"""
_DEDUPE = f"""'{{"dedupe_version":1,"installation_id":"{INSTALLATION}","name":"source.event",' || {_OBS} || ',"record_type":"event","scope":"target","source":{{"id":"events",' || {_SRC} || ',"type":"site.canary"}},"target_id":"t' || (user_id % 10) || '"}}'"""
_PICK = "(['" + "', '".join((*P.EGRESS, "moon")) + "'])[o_orderkey % 12 + 1]"
_CELLS = ", ".join(f"('{s}', '{c}', '{v}')" for s, cells in P.EGRESS.items() for c, v in cells.items())
#: HMAC by its definition: the pads are those of the 32-byte key, filled up to 64 bytes; \xHH stands for a byte of a blob
_pad = lambda x: "".join(f"\\x{b ^ x:02X}" for b in KEY.ljust(64, b"\0"))
_HEAD = "".join(f"\\x{b:02X}" for b in b"obslake-pseudonym-v1\0" + (1).to_bytes(4, "big") + b"name\0")
_PSEUDONYMS = rf"""SELECT c_custkey, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || '{_HEAD}'::BLOB || encode(c_name)))) AS digest,
    (length('ol_ps1_e1_name_') + 26)::INTEGER AS n, (length('ol_fp1_e1_name_') + 52)::INTEGER AS f FROM customer"""
ORACLES = {
    "record_digests": f"SELECT event_id::VARCHAR AS source_event_id, sha256('obslake-record-id-v1' || chr(0) || {_IDENTITY}) AS record_digest, sha256('obslake-dedupe-v1' || chr(0) || {_DEDUPE}) AS dedupe_digest FROM events",
    "record_tokens": "SELECT count(*) AS n, count(*) AS ids, count(*) AS keys, true AS ids_ok, true AS keys_ok FROM events",
    "verified_identity": "SELECT event_id % 11 <> 0 AS id_ok, event_id % 11 <> 0 AS dedupe_ok, event_id % 11 <> 0 AND event_id % 7 <> 0 AS content_ok, count(*) AS n FROM events GROUP BY ALL",
    "content_is_stable": "SELECT count(*) AS n, count(*) AS same FROM events",
    "generation_digests": "SELECT s_suppkey, sha256(s_name || chr(0) || s_nationkey) AS digest FROM supplier",
    "canonical_props": """SELECT event_id, '{"a":{"b":[1,true,null],"y":"é"},"e":"' || event_type || '","z":' || user_id || '}' AS canonical FROM events""",
    "sanitized_urls": r"""WITH u AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages), k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '') AS a, list_sort(list_filter(string_split(q, '&'), lambda x: regexp_full_match(x, 'page=[A-Za-z0-9._~-]*'))) AS s FROM u)
        SELECT page_id, base || CASE WHEN len(s) > 0 THEN '?' || array_to_string(s, '&') ELSE '' END AS url, concat_ws(',', CASE WHEN f <> '' THEN 'fragment' END, CASE WHEN q <> '' AND len(s) < greatest(len(a), 1) THEN 'query' END) AS removed FROM k""",
    "path_tokens": "SELECT count(*) AS n, count(*) AS same, count(DISTINCT (p_brand, p_name)) AS tokens FROM part",
    "normalized_documents": r"""WITH t AS (SELECT doc_id, replace(replace(text || CASE WHEN doc_id % 3 = 0 THEN chr(13) || chr(10) || chr(7) || chr(8203) ELSE chr(13) END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents), c AS (SELECT *, regexp_replace(t, '[\x00-\x08\x0B-\x1F\x7F-\x9F]|\p{Cf}', '', 'g') AS c FROM t)
        SELECT doc_id, length(c)::INTEGER AS n_chars, (length(t) - length(c))::INTEGER AS removed FROM c""",
    "redacted_conversations": "SELECT conv_id, turn, 1::BIGINT AS email, 1::BIGINT AS credential, false AS leak FROM conversations",
    "redacted_addresses": "SELECT event_id, 3::INTEGER AS ips, 2::INTEGER AS addresses, 1::INTEGER AS mails, true AS version_left, true AS time_left FROM events",
    "redaction_totals": "WITH k(category, m) AS (VALUES ('email', 3), ('phone', 4), ('ip', 5), ('path', 6), ('credential', 7), ('url', 8), ('credential', 9), ('secret', 10), ('secret', 11)) SELECT category, count(*) AS n FROM orders, k WHERE o_orderkey % m = 0 GROUP BY category",
    "pseudonyms": _PSEUDONYMS,
    "redaction_is_stable": "SELECT count(*) AS n, count(*) AS same FROM documents",
    "redacted_drafts": "SELECT 1::BIGINT AS email, 'r1-e1' AS redaction_version, count(*) AS n FROM events",
    "allowlisted_props": "SELECT event_id, CASE WHEN user_id % 5 > 0 THEN event_type END AS kind, CASE WHEN user_id % 5 > 0 THEN props->>'$.k' END AS k, 2::INTEGER AS discarded, CASE WHEN user_id % 5 = 0 THEN 'OL_ALLOWLIST_REQUIRED' END AS error FROM events",
    "allowlisted_nested": """SELECT event_id, CASE WHEN error IS NULL THEN user_id::VARCHAR END AS n, CASE WHEN error IS NULL AND event_id % 3 = 0 THEN 'https://h.example/p' END AS u, CASE error WHEN 'OL_ALLOWLIST_DOCUMENT' THEN 0 WHEN 'OL_ALLOWLIST_OBJECT' THEN 1 ELSE 1 + 2 * (event_id % 2 = 0)::INTEGER END::INTEGER AS discarded,
            (error IS NULL)::BIGINT AS phones, (error IS NULL)::BIGINT AS emails, (error IS NULL AND event_id % 3 = 0)::BIGINT AS urls, error
        FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'OL_ALLOWLIST_DOCUMENT' WHEN event_id % 11 = 0 THEN 'OL_ALLOWLIST_OBJECT' WHEN event_id % 7 = 0 THEN 'OL_ALLOWLIST_KIND' END AS error FROM events)""",
    "egress_decisions": f"""WITH m(surface, privacy_class, cell) AS (VALUES {_CELLS}), r AS (SELECT o_orderkey, {_PICK} AS surface, (['public', 'internal', 'sensitive', 'restricted'])[(o_orderkey // 12) % 4 + 1] AS privacy_class, o_custkey % 2 = 0 AS en, CASE o_custkey % 3 WHEN 0 THEN ['public'] WHEN 1 THEN ['public', 'sensitive'] ELSE [] END AS al FROM orders),
        q AS (SELECT r.*, cell, surface IN ('telegram', 'github_issues', 'hosted_clickhouse') AS ext FROM r LEFT JOIN m USING (surface, privacy_class)),
        x AS (SELECT *, CASE WHEN surface = 'moon' THEN 'OL_EGRESS_SURFACE' WHEN privacy_class = 'restricted' THEN 'OL_EGRESS_RESTRICTED' WHEN NOT ext AND (en OR len(al) > 0) THEN 'OL_EGRESS_POLICY' WHEN ext AND surface <> 'hosted_clickhouse' AND list_contains(al, 'sensitive') THEN 'OL_EGRESS_POLICY'
            WHEN ext AND NOT en THEN 'OL_EGRESS_DISABLED' WHEN ext AND NOT list_contains(al, privacy_class) THEN 'OL_EGRESS_NOT_ALLOWLISTED' WHEN cell IS NULL THEN 'OL_EGRESS_CLASS_DENIED' END AS denied FROM q) SELECT o_orderkey, CASE WHEN denied IS NULL THEN cell END AS disposition, denied FROM x""",
    "disclosed_events": """WITH e AS (SELECT *, user_id % 4 AS p, event_id % 3 AS s FROM events), x AS (SELECT *, CASE WHEN p = 3 THEN NULL WHEN s = 0 THEN CASE p WHEN 0 THEN 'metadata' WHEN 1 THEN 'redacted_metadata' END WHEN s = 1 THEN CASE WHEN p < 2 THEN 'policy_filtered_summary' END ELSE CASE WHEN p < 2 THEN 'redacted_record' ELSE 'policy_filtered_summary' END END AS disposition FROM e)
        SELECT CASE WHEN disposition IS NOT NULL THEN event_id END AS event_id, CASE WHEN disposition <> 'redacted_metadata' THEN event_type END AS event_type, CASE WHEN disposition = 'redacted_record' THEN value END AS value, disposition FROM x""",
    "rendered_parts": """SELECT p_partkey, CASE WHEN error IS NULL THEN '<pre data-trust="untrusted">' || p_name || chr(10) || '&lt;b&gt;&amp;</pre>' END AS html, CASE WHEN error IS NULL THEN 'untrusted evidence:' || chr(10) || '| ' || p_name || chr(10) || '| <b>&' END AS plain, error
        FROM (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'OL_EVIDENCE_BYTES' WHEN p_partkey % 11 = 0 THEN 'OL_EVIDENCE_LINES' END AS error FROM part)""",
    "positions_round_trip": "SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN s_nationkey::BIGINT END AS offset, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END AS source FROM supplier",
    "canonical_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events",
}
