"""Content-addressed identity: canonical JSON, domain-separated digests, tokens."""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

DOMAINS = {k: f"obslake-{k}-v1\0" for k in ("record-id", "content", "dedupe", "alert-key", "alert-transition", "notification-intent")}
PREFIXES = {"record-id": "ol_", "dedupe": "ol_d1_", "alert-key": "ol_ak1_", "alert-transition": "ol_atr1_", "notification-intent": "ol_nin1_"}
TOKEN = "[a-z2-7]{51}[aq]"
INT_BOUND = 1 << 63
#: bounds of one canonical value
MAX_DEPTH, MAX_NODES, MAX_BYTES = 32, 10_000, 262_144


def canonical(fields: dict) -> Column:
    """Canonical JSON of named columns (a dict is an object), sorted by name, nulls left out.

    For leaves that are ASCII text, integers and booleans; general values take canonical_json().
    """

    def struct(values: dict) -> Column:
        return F.struct(*[(struct(v) if isinstance(v, dict) else v).alias(k) for k, v in sorted(values.items(), key=lambda kv: kv[0].encode())])

    return F.to_json(struct(fields))


def digest(domain: str, text: Column) -> Column:
    """Lower-case hex SHA-256 of the domain and the canonical text."""
    return F.sha2(F.concat(F.lit(DOMAINS[domain]), text), 256)


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32 of a 256-bit hex digest, lower case, without padding: 52 characters."""
    padded = F.concat(hex_digest, F.lit("0"))  # 260 bits, 52 groups of five
    parts = [F.lpad(F.conv(F.substring(padded, a, min(10, 66 - a)), 16, 32), 8 if a < 61 else 4, "0") for a in range(1, 66, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567")


def base32_start(hex_digest: Column) -> Column:
    """The 26 characters of base32 that the first 128 bits of a hex digest have by themselves."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, a, 10), 16, 32), 8, "0") for a in (1, 11, 21)]
    tail = F.substring(F.lpad(F.conv(F.concat(F.substring(hex_digest, 31, 2), F.lit("00000000")), 16, 32), 8, "0"), 1, 2)
    return F.translate(F.concat(*parts, tail), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567")


def token(domain: str, text: Column) -> Column:
    return F.concat(F.lit(PREFIXES[domain]), base32(digest(domain, text)))


def is_token(domain: str, value: Column) -> Column:
    return value.rlike(f"^{PREFIXES[domain]}{TOKEN}$")


def generation_digest(*parts: Column) -> Column:
    """Digest that names one generation of a source."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def alert_key(rule_id: Column, rule_version: Column, collector: Column, target: Column) -> Column:
    return token("alert-key", canonical({"rule_id": rule_id, "rule_version": rule_version, "collector": collector, "target": target}))


def transition_id(key: Column, previous: Column, state: Column, observation: dict) -> Column:
    return token("alert-transition", canonical({"alert_key": key, "previous_state": previous, "state": state, "observation": observation}))


def intent_id(transition: Column, channel: Column) -> Column:
    return token("notification-intent", canonical({"transition_id": transition, "channel_id": channel}))


IDENTITY = ("source.id", "source.type", "source.observation_namespace_id", "source.source_generation_digest")


def _observation(parts: Column) -> dict:
    return {"kind": parts["kind"], "parts": parts["parts"]}


def identity_text(installation: str) -> Column:
    """Canonical identity of a draft: all that names the observation."""
    s = F.col("source")
    return canonical({
        "identity_version": F.lit(1), "installation_id": F.lit(installation), "schema_version": F.col("schema_version"), "redaction_version": F.col("redaction_version"),
        "source": {"id": s["id"], "type": s["type"], "observation_namespace_id": s["observation_namespace_id"], "source_generation_digest": s["source_generation_digest"]},
        "scope": F.col("scope"), "target_id": F.col("target")["id"], "record_type": F.col("record_type"), "name": F.col("name"),
        "source_event_id": F.col("source_event_id"), "source_entity_id": F.col("source_entity_id"), "observation": _observation(s["observation"]),
    })


def dedupe_text(installation: str) -> Column:
    """The identity without what may differ between deliveries of one observation."""
    s = F.col("source")
    return canonical({
        "dedupe_version": F.lit(1), "installation_id": F.lit(installation), "source": {"id": s["id"], "type": s["type"], "observation_namespace_id": s["observation_namespace_id"]},
        "scope": F.col("scope"), "target_id": F.col("target")["id"], "record_type": F.col("record_type"), "name": F.col("name"), "observation": _observation(s["observation"]),
    })


#: fields that say when and by which run a record came, not what it says
DELIVERY_FIELDS = ("record_id", "dedupe_key", "content_hash", "operation_id", "collector_run_id", "observed_at", "ingested_at", "expires_at")


def content_projection(df) -> Column:
    """The content of a record: no delivery fields, no collector implementation version."""
    cols = []
    for name in sorted(df.columns, key=str.encode):
        if name in DELIVERY_FIELDS or name.startswith("_"):
            continue
        c = F.col(name)
        kind = dict(df.dtypes)[name]
        if name == "collector":
            c = c.dropFields("implementation_version")
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        cols.append(c.alias(name))
    return F.struct(*cols)


def finalize(drafts, installation: str):
    """Drafts with record_id, dedupe_key and content_hash."""
    return drafts.withColumns({
        "record_id": token("record-id", identity_text(installation)), "dedupe_key": token("dedupe", dedupe_text(installation)),
        "content_hash": digest("content", F.to_json(content_projection(drafts))),
    })


def verify_identity(records, installation: str):
    """records with id_ok, dedupe_ok and content_ok: whether each derives again from the rest."""
    again = finalize(records.drop("record_id", "dedupe_key", "content_hash"), installation)
    told = {f"_{c}": F.col(c) for c in ("record_id", "dedupe_key", "content_hash")}
    bare = [c for c in records.columns if c not in ("record_id", "dedupe_key", "content_hash")]
    both = records.select(*bare, *[v.alias(k) for k, v in told.items()])
    again = both.withColumns({
        "record_id": token("record-id", identity_text(installation)), "dedupe_key": token("dedupe", dedupe_text(installation)),
        "content_hash": digest("content", F.to_json(content_projection(again.select(*bare)))),
    })
    ok = {f"{n}_ok": F.col(c).eqNullSafe(F.col(f"_{c}")) for n, c in (("id", "record_id"), ("dedupe", "dedupe_key"), ("content", "content_hash"))}
    return again.withColumns(ok).select(*bare, *[F.col(f"_{c}").alias(c) for c in ("record_id", "dedupe_key", "content_hash")], *ok)


def _float_text(x: float) -> str:
    if x != x or x in (math.inf, -math.inf):
        raise ValueError("not finite")
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        if not -INT_BOUND <= int(x) < INT_BOUND:
            raise ValueError("beyond 64 bits")
        return str(int(x))
    sign, digits, e = ("-" if x < 0 else ""), *_shortest(abs(x))
    n = len(digits)
    if 0 < e <= 21:
        text = digits[:e] + "." + digits[e:]
    elif -6 < e <= 0:
        text = "0." + "0" * -e + digits
    else:
        text = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e - 1)}"
    return sign + text


def _shortest(x: float):
    """Shortest digits of x and the place of the point."""
    mantissa, _, exponent = f"{x!r}".lower().partition("e")
    whole, _, part = mantissa.partition(".")
    digits, point = whole + part, len(whole) + int(exponent or 0)
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    return stripped.rstrip("0"), point


def canonical_text(value) -> str:
    """Canonical JSON of one parsed value: sorted keys, NFC, LF line ends, plain numbers."""
    nodes = 0

    def text(s: str) -> str:
        if re.search("[\ud800-\udfff]", s):
            raise ValueError("surrogate")
        return json.dumps(unicodedata.normalize("NFC", s.replace("\r\n", "\n").replace("\r", "\n")), ensure_ascii=False)

    def walk(v, depth: int) -> str:
        nonlocal nodes
        nodes += 1
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            raise ValueError("too large")
        if v is None or isinstance(v, bool):
            return json.dumps(v)
        if isinstance(v, str):
            return text(v)
        if isinstance(v, int):
            if not -INT_BOUND <= v < INT_BOUND:
                raise ValueError("beyond 64 bits")
            return str(v)
        if isinstance(v, float):
            return _float_text(v)
        if isinstance(v, list):
            return "[" + ",".join(walk(x, depth + 1) for x in v) + "]"
        keys = {text(k): x for k, x in v.items()}
        if len(keys) != len(v):
            raise ValueError("keys collide")
        return "{" + ",".join(f"{k}:{walk(x, depth + 1)}" for k, x in sorted(keys.items(), key=lambda kv: json.loads(kv[0]).encode())) + "}"

    out = walk(value, 1)
    if len(out.encode()) > MAX_BYTES:
        raise ValueError("too large")
    return out


@pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical JSON of JSON texts of any content; null where a text has none (the general path)."""

    def one(t):
        if t is None:
            return None
        try:
            return canonical_text(json.loads(t, object_pairs_hook=_unique))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out
