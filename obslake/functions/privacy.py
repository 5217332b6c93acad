"""Privacy transforms as columns: pseudonyms, URLs, paths, redaction, egress.

Redaction works category by category on JVM regular expressions, after Unicode NFC.
A category's matches are found once and replaced where they stand; no token can be
matched by a later category, so redacting twice changes nothing.  Java needs (?U) for
Unicode \\w.
"""

from __future__ import annotations

import base64
import html
import ipaddress
import json
import re
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .identity import base32, base32_start

BLOCK = 64
POLICY_VERSION = 1


def _hmac(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column; the pads are literals."""
    key = key.ljust(BLOCK, b"\0")
    inner, outer = (bytearray(bytes(b ^ p for b in key)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def keyed_digest(key: bytes, epoch: int, domain: str, kind: str, value: Column) -> Column:
    """Hex digest of domain, epoch, kind and the text with LF line ends (NFC is the caller's: see composed)."""
    text = F.replace(F.replace(value, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    head = bytearray(f"obslake-{domain}-v1\0".encode() + epoch.to_bytes(4, "big") + kind.encode() + b"\0")
    return _hmac(key, F.concat(F.lit(head), F.encode(text, "UTF-8")))


def _spelled(epoch: int, kind: str, digest: Column) -> Column:
    """The token of the first 128 bits of a digest."""
    return F.concat(F.lit(f"ol_ps1_e{epoch}_{kind}_"), base32_start(digest))


def pseudonym(key: bytes, epoch: int, kind: str, value: Column) -> Column:
    """128-bit keyed token of a text."""
    return _spelled(epoch, kind, keyed_digest(key, epoch, "pseudonym", kind, value))


def fingerprint(key: bytes, epoch: int, kind: str, value: Column) -> Column:
    """256-bit keyed token of a text."""
    return F.concat(F.lit(f"ol_fp1_e{epoch}_{kind}_"), base32(keyed_digest(key, epoch, "fingerprint", kind, value)))


def composed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns in Unicode NFC, by Arrow's own function; Spark has none."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.utf8_normalize(c, form="NFC") if name in columns else c for name, c in zip(batch.schema.names, batch.columns)], names=batch.schema.names)

    return df.mapInArrow(work, df.schema)


def normalized_text(text: Column) -> tuple[Column, Column]:
    """(text with LF line ends and no control or format characters but \\n and \\t, how many were removed)."""
    lf = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    clean = F.regexp_replace(lf, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    return clean, F.char_length(lf) - F.char_length(clean)


def local_path_token(key: bytes, epoch: int, path: Column) -> Column:
    return F.concat(F.lit("local-path:"), pseudonym(key, epoch, "path", F.replace(path, F.lit("\\"), F.lit("/"))))


@pandas_udf(StringType())
def ascii_host(hosts: pd.Series) -> pd.Series:
    """IDNA form of a host, null where it has none."""

    def one(h):
        try:
            return h.encode("idna").decode("ascii").lower()
        except (UnicodeError, AttributeError):
            return None

    return hosts.map(one)


@pandas_udf(StringType())
def canonical_ip(texts: pd.Series) -> pd.Series:
    """Canonical form of an IP address, null for any other text."""

    def one(t):
        try:
            return str(ipaddress.ip_address(t.strip("[]")))
        except (ValueError, AttributeError):
            return None

    return texts.map(one)


def sanitized_url(url: Column, allowed: tuple[str, ...] = (), idna: bool = False) -> Column:
    """STRUCT<value, removed ARRAY>: an http(s) URL without user info, fragment, default port and unlisted query fields; null if it is no such URL.

    Non-ASCII hosts are refused, or take the IDNA path with idna=True (a Python function).
    """
    ok = url.rlike(r"^(?i)https?://[^/?#\s]+[^\s]*$")
    scheme = F.lower(F.regexp_extract(url, r"^(?i)(https?)://", 1))
    authority = F.regexp_extract(url, r"^(?i)https?://([^/?#]*)", 1)
    userinfo, server = F.regexp_extract(authority, r"^(.*)@", 1), F.regexp_replace(authority, r"^.*@", "")
    name, port = F.lower(F.regexp_replace(server, r":\d*$", "")), F.regexp_extract(server, r":(\d*)$", 1)
    host = F.coalesce(ascii_host(name), F.lit("")) if idna else F.when(name.rlike(r"^[\x21-\x7E]+$"), name).otherwise("")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    place = F.when(default, host).otherwise(F.concat(host, F.lit(":"), port))
    path = F.regexp_extract(url, r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    query, fragment = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"#(.*)$", 1)
    fields = F.filter(F.split(query, "&"), lambda f: f != "")
    safe = F.filter(fields, lambda f: F.substring_index(f, "=", 1).isin(*allowed) & f.rlike(r"^[A-Za-z0-9_.-]+=[A-Za-z0-9._~-]*$")) if allowed else F.filter(fields, lambda f: F.lit(False))
    kept = F.array_join(F.array_sort(safe), "&")
    value = F.concat(scheme, F.lit("://"), place, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    removed = F.array_compact(F.array(F.when(fragment != "", "fragment"), F.when((query != "") & (F.size(safe) < F.greatest(F.size(fields), F.lit(1))), "query"), F.when(userinfo != "", "userinfo")))
    good = ok & (host != "") & (port != "0") & ~path.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(good, F.struct(value.alias("value"), removed.alias("removed")))


#: fixed values: request headers that carry credentials, and key words of assignments (a joint is _, - or nothing)
CREDENTIAL_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token")
CREDENTIAL_WORDS = ("api[_-]?key", "access[_-]?token", "refresh[_-]?token", "client[_-]?secret", "password", "passwd", "secret", "token")

# The patterns follow the definitions: RFC 7468 (armour of keys), RFC 3986 and 4291 (addresses, with RFC 4007 zones), RFC 5322 (dot-atoms), E.164
# and the North American plan (telephone numbers), and the roots of POSIX, Windows and UNC paths. A key without its end line is hidden to the end.
PRIVATE_KEY = r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----[\s\S]*?(?:-----END \1-----|\z)"
HEADER = rf"(?im)^[ \t]*({'|'.join(CREDENTIAL_HEADERS)})[ \t]*:(?! ?\[ol:c\]$)[^\n]*$"
ASSIGNMENT = rf"(?i)\b({'|'.join(CREDENTIAL_WORDS)})\b(\s*[:=]\s*+)(?!\[ol:c\](?:\n|$))[^\n]+"
URL = r"(?i)https?://[^\s<>\"`]+"
#: a URL in running text goes as far as a letter, a digit, or a sign that ends no sentence and closes nothing
URL_ENDS = r"^[\s\S]*[\p{L}\p{N}/_~%+=&#$@*'(\[{|^\\-]"
_ATOM = r"[\w!#$%&'*+=?^`{|}~-]"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
#: a local part may hold slashes only where the address stands by itself: inside a URL or a path they part names
_SLASHED = rf"(?:(?<=^|[\s<(\[{{\"',;])(?:{_ATOM}{{1,64}}/){{1,16}})?"
EMAIL = rf"(?U)(?<!{_ATOM}|\.){_SLASHED}{_ATOM}{{1,64}}(?:\.{_ATOM}{{1,64}}){{0,16}}@(?:{_LABEL}\.){{1,126}}{_LABEL}(?![\p{{L}}\p{{N}}-])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOTTED = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV4 = rf"(?U)(?<![\w.]){_DOTTED}(?![\w.])"
_H16 = "[0-9A-Fa-f]{1,4}"
_GROUPS = f"{_H16}(?::{_H16}){{0,6}}"
_MIXED = rf"(?:(?:{_H16}:){{6}}|(?:{_H16}(?::{_H16}){{0,4}})?::(?:{_H16}:){{0,5}}){_DOTTED}(?!\.?[0-9])"
_ZONE = r"(?:%[A-Za-z0-9_~-]+(?:\.[A-Za-z0-9_~-]+)*)?"
IPV6 = rf"(?U)(?<![\w:.])(?:{_MIXED}|(?:{_H16}:){{7}}{_H16}|{_GROUPS}::(?:{_GROUPS})?|::{_GROUPS}){_ZONE}(?![\w:])"
_GAP = "[ .-]"
_NATIONAL = rf"(?:\(\d{{3}}\)|\d{{3}}){_GAP}?\d{{3}}{_GAP}\d{{4}}"
_ABROAD = rf"\+[1-9]\d{{0,2}}{_GAP}?(?:\(\d{{1,4}}\){_GAP}?)?\d{{2,4}}(?:{_GAP}\d{{2,4}}){{1,3}}"
PHONE = rf"(?U)(?<![\w+])(?:(?:\+[1-9]\d{{0,2}}{_GAP}?)?{_NATIONAL}|{_ABROAD})(?!\w)"
#: what a shell leaves in a name without quotes: no space unless escaped, no control, no quote, no redirection or pipe
_IN_NAME = r"(?:\\[\p{Zs}\t]|[^\p{Z}\p{Cc}<>|\"`])"
#: a POSIX path begins with a name: a letter, digit or sign, or a dot and then one of these or a dot
_POSIX = r"/(?=[\p{L}\p{N}_~%@+$#*\[('{=&^-]|\.[\p{L}\p{N}._~-])"
_ROOT = rf"(?:file:(?://)?/?|[A-Za-z]:[\\/]|\\\\(?=[^\\/\s])|~[\w.-]*/|\.{{1,2}}/|{_POSIX})"
_QUOTED = "|".join(rf"(?<={q}){_ROOT}[^{q}\n]+(?={q})" for q in "\"'`")
PATH = rf"(?iU)(?:{_QUOTED}|(?<![<\w:/\\.~]){_ROOT}{_IN_NAME}+)"
CATEGORIES = ("control", "secret", "private_key", "credential", "url", "email", "path", "ip", "phone")


def secret_forms(secret: str) -> list[str]:
    """A secret as it is and encoded: base64 at any place of a longer text, hex, percent signs, character references, JSON; longest first."""
    raw = secret.encode()
    forms = {secret, html.escape(secret), json.dumps(secret)[1:-1], quote(secret, safe="")}
    for encode in (base64.b64encode, base64.urlsafe_b64encode):
        once = encode(raw).decode()
        forms |= {once, once.rstrip("="), quote(once, safe=""), encode(once.encode()).decode(), encode(once.encode()).decode().rstrip("=")}
        for shift in (1, 2):  # the characters that depend on the secret's bytes alone
            whole = encode(b"\0" * shift + raw).decode().rstrip("=")
            forms.add(whole[shift + 1 : 8 * (len(raw) + shift) // 6])
        forms.add(once[: 8 * len(raw) // 6])
    return sorted((f for f in forms | set(secret_digits(secret)) if len(f) >= 8), key=lambda s: (-len(s), s))


def secret_digits(secret: str) -> list[str]:
    """The forms whose hex digits may be of either case: hex, percent signs, character references."""
    raw = secret.encode()
    some = "".join(c if quote(c, safe="") == c else "".join(f"%{b:02x}" for b in c.encode()) for c in secret)
    return [raw.hex(), "".join(f"%{b:02x}" for b in raw), some, "".join(f"&#{ord(c)};" for c in secret), "".join(f"&#x{ord(c):x};" for c in secret)]


def _plain(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def _any_case(form: str) -> str:
    """A pattern of a form in which escapes take hex digits of either case, and all else stays as it is."""
    if re.fullmatch("[0-9a-f]+", form):
        return f"(?i:{form})"
    return "".join(f"(?i:{_plain(p)})" if p[:1] in "%&" else _plain(p) for p in re.split("((?:%[0-9a-f]{2})+|(?:&#x?[0-9a-f]+;)+)", form) if p)


def secret_pattern(secrets: tuple[str, ...]) -> str:
    """All forms of all secrets, longest first."""
    digits = {d for s in secrets for d in secret_digits(s)}
    every = sorted({f for s in secrets for f in secret_forms(s)}, key=lambda f: (-len(f), f))
    return "|".join(_any_case(f) if f in digits else _plain(f) for f in every)


def _once(value: Column, use) -> Column:
    """use(value), the value evaluated once: in the function of an array Spark evaluates what stands there n times n times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_ipv6(text: Column) -> Column:
    """Eight groups of four hex digits, without the zone; a dotted tail is two groups. Text that has not eight groups stays, in lower case."""
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")

    def undotted(bare: Column) -> Column:
        pair = lambda octets, k: F.lower(F.hex(F.get(octets, F.lit(k)) * 256 + F.get(octets, F.lit(k + 1))))
        octets = F.transform(F.split(F.regexp_extract(bare, r"([0-9.]+)$", 1), r"\."), lambda o: o.cast("int"))
        return F.when(bare.contains("."), F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), _once(octets, lambda o: F.concat(pair(o, 0), F.lit(":"), pair(o, 2))))).otherwise(bare)

    def filled(halves: Column) -> Column:
        """Groups of each half, and between them as many zeros as are left out."""
        gap = F.greatest(F.lit(8) - F.size(F.get(halves, F.lit(0))) - F.size(F.get(halves, F.lit(1))), F.lit(0))
        none = F.array().cast("array<string>")
        second = F.coalesce(F.get(halves, F.lit(1)), none)
        return F.when(F.size(halves) > 1, F.concat(F.get(halves, F.lit(0)), F.array_repeat(F.lit("0"), gap), second)).otherwise(F.get(halves, F.lit(0)))

    def joined(bare: Column) -> Column:
        every = _once(F.transform(F.split(bare, "::"), groups), filled)
        return _once(every, lambda e: F.when(F.size(e) == 8, F.array_join(F.transform(e, lambda g: F.lpad(g, 4, "0")), ":")).otherwise(bare))

    return _once(_once(F.regexp_replace(F.lower(text), "%.*$", ""), undotted), joined)


def canonical_email(text: Column) -> Column:
    """The domain in lower case; a local part is what it is."""
    return F.concat(F.regexp_extract(text, "^(.*)@", 1), F.lit("@"), F.lower(F.substring_index(text, "@", -1)))


#: stands around a match; texts have no control character by then
_MARK = "\x01"


def _parted(text: Column, pattern: str) -> Column:
    """The text in parts, by one search: the matches are those of odd places."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _rebuilt(text: Column, parts: Column, steps) -> Column:
    """text with each match in its parts replaced, where it stands, by what the steps make of it, one after the other."""
    made = F.filter(parts, lambda _, i: i % 2 == 1)
    for step in steps:
        made = F.transform(made, step)
    rest = F.filter(parts, lambda _, i: i % 2 == 0)
    return F.when(F.size(parts) > 1, F.array_join(F.flatten(F.zip_with(rest, made, lambda before, m: F.array(before, F.coalesce(m, F.lit(""))))), "")).otherwise(text)


def redact(df: DataFrame, columns: list[str], key: bytes, epoch: int = 1, secrets: tuple[str, ...] = (), allowed_query: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns redacted and `redactions`, counts by category over them; stamps `redaction_version`.

    secrets are the known ones (128 at most, 8 characters at least), sent with the plan.
    """
    if len(secrets) > 128 or any(len(s) < 8 for s in secrets):
        raise ValueError("at most 128 secrets of at least 8 characters")
    counts = {c: [] for c in CATEGORIES}
    out = composed(df, columns)
    known = secret_pattern(secrets)
    for name in columns:
        step, at, parts = 0, F.col(f"__r_{name}_t"), F.col(f"__r_{name}_m")

        def keep(value: Column, n: Column, category: str):
            nonlocal out, step
            out = out.withColumns({f"__r_{name}_t": value, f"__r_{name}_{step}": n})
            counts[category].append(f"__r_{name}_{step}")
            step += 1

        def replace(pattern: str, steps, category: str, hint: Column):
            """One search for all matches of a row that the hint, a plain look, does not rule out. A step makes one thing of one thing, so that none is evaluated twice."""
            nonlocal out
            out = out.withColumn(f"__r_{name}_m", F.when(hint, _parted(at, pattern)).otherwise(F.array().cast("array<string>")))
            keep(_rebuilt(at, parts, steps), F.when(F.size(parts) > 1, F.floor(F.size(parts) / 2).cast("int")).otherwise(0), category)

        def tokens(kind: str, canonical):
            return [canonical, lambda m: keyed_digest(key, epoch, "pseudonym", kind, m), lambda m: _spelled(epoch, kind, m)]

        def swap(pattern: str, by: str, category: str, hint: Column):
            keep(F.when(hint, F.regexp_replace(at, pattern, by)).otherwise(at), F.when(hint, F.regexp_count(at, F.lit(pattern))).otherwise(0), category)

        def url_token(m):
            token = lambda bare: F.concat(F.coalesce(sanitized_url(bare, allowed_query)["value"], F.lit("[ol:u]")), F.substring(m, F.length(bare) + 1, F.length(m)))
            return _once(F.regexp_extract(m, URL_ENDS, 0), token)

        keep(*normalized_text(F.col(name)), "control")
        if known:
            keep(F.regexp_replace(at, known, "[ol:s]"), F.regexp_count(at, F.lit(known)), "secret")
        swap(PRIVATE_KEY, "[ol:k]", "private_key", at.contains("PRIVATE KEY-----"))
        swap(HEADER, "$1: [ol:c]", "credential", at.contains(":"))
        replace(URL, [url_token], "url", at.contains("://"))
        swap(ASSIGNMENT, "$1$2[ol:c]", "credential", at.contains(":") | at.contains("="))
        replace(EMAIL, tokens("email", canonical_email), "email", at.contains("@"))
        replace(IPV6, tokens("ip", canonical_ipv6), "ip", at.contains(":"))
        replace(IPV4, tokens("ip", lambda m: m), "ip", at.contains("."))
        replace(PHONE, tokens("phone", lambda m: F.regexp_replace(m, r"\D", "")), "phone", at.rlike(r"\d\d[ .-]\d\d"))
        replace(PATH, [*tokens("path", lambda m: F.replace(m, F.lit("\\"), F.lit("/"))), lambda m: F.concat(F.lit("local-path:"), m)], "path", at.rlike(r"[/\\]|(?i)file:"))
        out = out.withColumn(name, at)
    total = F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), sum((F.coalesce(F.col(n), F.lit(0)) for n in counts[c]), F.lit(0)).cast("long"))])
    out = out.withColumn("redactions", F.map_filter(total, lambda _, n: n > 0)).withColumn("redaction_version", F.lit(f"r{POLICY_VERSION}-e{epoch}"))
    return out.drop(*[c for c in out.columns if c.startswith("__r_")])


def redaction_counts(redacted: DataFrame) -> DataFrame:
    """(category, n). Sums first, then one row is unfolded: an explode of the rows would push its filter down through every redaction step."""
    sums = redacted.agg(*[F.sum(F.coalesce(F.element_at("redactions", c), F.lit(0))).alias(c) for c in CATEGORIES])
    return sums.select(F.explode(F.map_filter(F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), F.col(c))]), lambda _, n: n > 0)).alias("category", "n"))


#: free-text fields of each record type's payload
FREE_TEXT = {"event": ("message",), "metric": (), "run": (), "span": (), "alert": ("summary",), "notification_intent": ("summary",), "feedback_item": ("title", "summary", "recommendation"), "feedback_transition": ("rationale",)}


def redact_drafts(drafts: DataFrame, record_type: str, key: bytes, epoch: int = 1, secrets: tuple[str, ...] = ()) -> DataFrame:
    """Drafts of one type with their payload's free text redacted; a type without a listing is refused."""
    if record_type not in FREE_TEXT:
        raise ValueError("OL_REDACTION_UNMAPPED")
    fields = [f for f in FREE_TEXT[record_type] if f in drafts.schema["data"].dataType.names]
    named = drafts.withColumns({f"__f_{f}": F.col("data")[f] for f in fields})
    out = redact(named, [f"__f_{f}" for f in fields], key, epoch, secrets)
    data = F.col("data")
    for f in fields:
        data = data.withField(f, F.col(f"__f_{f}"))
    return out.withColumn("data", data).drop(*[f"__f_{f}" for f in fields])


#: fixed values: fields of one object, rules, and names in a rule at most
MOST_FIELDS, MOST_RULES, MOST_DEPTH = 1_000, 100, 8


def _pointer(names: tuple[str, ...]) -> str:
    return "$" + "".join(f"['{n}']" for n in names)


def allowlisted(df: DataFrame, body: str, rules: dict[str, str], key: bytes, epoch: int = 1, secrets: tuple[str, ...] = (), allowed_query: tuple[str, ...] = ()) -> DataFrame:
    """df with `fields` (the listed leaves of a JSON document), `discarded`, `redactions` and `error`.

    rules: {"a.b": kind}, kind being scalar, text, url or path; a name that ends in "!" is required where the objects around it are
    there, as are those around it at the top. The document is walked as a VARIANT along the rules: at each object on the way, the fields
    that no rule names are discarded and counted, whatever they hold. Strings are redacted, and redactions counted by
    category over all leaves. error, a code: no object, a listed object that is none, too many fields, a required leaf
    that isn't there, a leaf of another kind. A document with an error has no fields
    and no redactions.
    """
    names = {tuple(k.rstrip("!").split(".")): (kind, k.endswith("!")) for k, kind in rules.items()}
    if len(rules) > MOST_RULES or any(len(n) > MOST_DEPTH for n in names) or any(n[:k] in names for n in names for k in range(1, len(n))):
        raise ValueError(f"at most {MOST_RULES} rules of at most {MOST_DEPTH} names, none inside another")
    doc = "__al_doc"
    out = df.withColumn(doc, F.try_parse_json(body))
    at = lambda n: F.try_variant_get(doc, _pointer(n), "variant")
    kind_of = lambda v: F.schema_of_variant(v)
    nodes = sorted({n[:k] for n in names for k in range(len(n))}, key=lambda n: (len(n), n))
    objects = {n: f"__al_o{i}" for i, n in enumerate(nodes)}
    out = out.withColumns({c: F.col(doc) if not n else at(n) for n, c in objects.items()})
    is_object = lambda n: kind_of(F.col(objects[n])).startswith("OBJECT")
    fields = {n: F.when(is_object(n), F.json_object_keys(F.to_json(F.col(c)))) for n, c in objects.items()}
    out = out.withColumns({f"{c}_k": fields[n] for n, c in objects.items()})
    known = {n: sorted({m[len(n)] for m in names if m[: len(n)] == n and len(m) > len(n)}) for n in nodes}
    extra = [F.coalesce(F.size(F.array_except(f"{objects[n]}_k", F.array(*[F.lit(x) for x in known[n]]))), F.lit(0)) for n in nodes]
    error = F.when(F.col(doc).isNull() | ~is_object(()), "OL_ALLOWLIST_DOCUMENT")
    for n in nodes[1:]:
        needed = any(required for m, (_, required) in names.items() if m[: len(n)] == n)
        error = error.when(F.col(objects[n]).isNotNull() & ~is_object(n), "OL_ALLOWLIST_OBJECT")
        if needed:
            error = error.when(F.col(f"{objects[n[:-1]]}_k").isNotNull() & F.col(objects[n]).isNull(), "OL_ALLOWLIST_REQUIRED")
    for n in nodes:
        error = error.when(F.size(f"{objects[n]}_k") > MOST_FIELDS, "OL_ALLOWLIST_LARGE")
    leaves, strings = {n: f"__al_l{i}" for i, n in enumerate(sorted(names))}, {}
    for n, c in leaves.items():
        kind, required = names[n]
        v, text = at(n), F.try_variant_get(doc, _pointer(n), "string")
        shape, there = kind_of(v), F.array_contains(f"{objects[n[:-1]]}_k", F.lit(n[-1]))
        if required:
            error = error.when(F.col(f"{objects[n[:-1]]}_k").isNotNull() & ~there, "OL_ALLOWLIST_REQUIRED")
        wrong = shape.startswith("OBJECT") | shape.startswith("ARRAY") if kind == "scalar" else shape != "STRING"
        error = error.when(F.coalesce(there, F.lit(False)) & wrong, "OL_ALLOWLIST_KIND")
        strings[c] = text
    out = out.withColumns({"discarded": sum(extra, F.lit(0)), "error": error, **strings})
    out = out.drop(doc, *objects.values(), *[f"{c}_k" for c in objects.values()])
    texts = [c for n, c in leaves.items() if names[n][0] in ("scalar", "text")]
    before = [c for c in ("redactions", "redaction_version") if c in df.columns]
    out = redact(out.drop(*before), texts, key, epoch, secrets, allowed_query)
    shown, more = [], {"url": F.lit(0).cast("long"), "path": F.lit(0).cast("long")}
    for n, c in leaves.items():
        kind = names[n][0]
        v = {"url": sanitized_url(F.col(c), allowed_query)["value"], "path": local_path_token(key, epoch, F.col(c))}.get(kind, F.col(c))
        if kind == "path":
            more["path"] = more["path"] + F.col(c).isNotNull().cast("long")
        if kind == "url":
            more["url"] = more["url"] + (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(v)).cast("long")
        shown.append(v.alias("_".join(n)))
    every = F.map_zip_with("redactions", F.create_map(*[x for c, n in more.items() for x in (F.lit(c), n)]), lambda _, a, b: F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(b, F.lit(0).cast("long")))
    good = F.col("error").isNull()
    out = out.withColumns({"fields": F.when(good, F.struct(*shown)), "redactions": F.when(good, F.map_filter(every, lambda _, n: n > 0))})
    return out.drop(*leaves.values())


#: fixed values: the most that each surface may show of each privacy class
R, S, M, Q = "redacted_record", "policy_filtered_summary", "metadata", "redacted_metadata"
EGRESS = {
    "local_spool": {"public": R, "internal": R, "sensitive": R}, "local_sqlite": {"public": R, "internal": R, "sensitive": R}, "local_clickhouse": {"public": R, "internal": R, "sensitive": R},
    "cli_query": {"public": R, "internal": R, "sensitive": S}, "local_mcp": {"public": R, "internal": R, "sensitive": S}, "repo_brief": {"public": S, "internal": S}, "telegram": {"public": S, "internal": S},
    "github_issues": {"public": S, "internal": S}, "hosted_clickhouse": {"public": R, "internal": R, "sensitive": R}, "diagnostics": {"public": M, "internal": Q}, "local_log": {"public": M, "internal": Q},
}
CLASSES = ("public", "internal", "sensitive", "restricted")
EXTERNAL = ("telegram", "github_issues", "hosted_clickhouse")


def egress_matrix(spark: SparkSession) -> DataFrame:
    """The matrix as a table: 44 rows, fixed."""
    rows = [(s, c, cells.get(c), s in EXTERNAL, sorted(cells) if s in EXTERNAL else []) for s, cells in EGRESS.items() for c in CLASSES]
    return spark.createDataFrame(rows, "surface STRING, privacy_class STRING, disposition STRING, external BOOLEAN, ceiling ARRAY<STRING>")


def authorize(requests: DataFrame) -> DataFrame:
    """requests(surface, privacy_class, explicitly_enabled, allowed) with `disposition`, or `denied`, the code of the first refusal."""
    out = requests.join(F.broadcast(egress_matrix(requests.sparkSession)), ["surface", "privacy_class"], "left")
    allowed, enabled = F.coalesce("allowed", F.array().cast("array<string>")), F.coalesce("explicitly_enabled", F.lit(False))
    known, classes = F.array(*[F.lit(s) for s in EGRESS]), F.array(*[F.lit(c) for c in CLASSES])
    denied = (
        F.when(~F.array_contains(known, F.col("surface")), "OL_EGRESS_SURFACE").when(~F.array_contains(classes, F.col("privacy_class")), "OL_EGRESS_PRIVACY_CLASS").when(F.col("privacy_class") == "restricted", "OL_EGRESS_RESTRICTED")
        .when(F.size(F.array_except(allowed, classes)) > 0, "OL_EGRESS_ALLOWLIST").when(~F.col("external") & (enabled | (F.size(allowed) > 0)), "OL_EGRESS_POLICY")
        .when(F.col("external") & (F.size(F.array_except(allowed, "ceiling")) > 0), "OL_EGRESS_POLICY").when(F.col("external") & ~enabled, "OL_EGRESS_DISABLED")
        .when(F.col("external") & ~F.array_contains(allowed, F.col("privacy_class")), "OL_EGRESS_NOT_ALLOWLISTED").when(F.col("disposition").isNull(), "OL_EGRESS_CLASS_DENIED")
    )
    return out.withColumn("denied", denied).withColumn("disposition", F.when(F.col("denied").isNull(), F.col("disposition"))).drop("external", "ceiling")


def shaped(df: DataFrame, metadata: list[str], summary: list[str], disposition: str = "disposition") -> DataFrame:
    """df with what each row's disposition doesn't allow nulled: records keep all, summaries and metadata their columns."""
    d, cols = F.col(disposition), []
    for c in df.columns:
        if c == disposition:
            cols.append(F.col(c))
        elif c in metadata:
            cols.append(F.when(d.isNotNull() & ((d != Q) | (c == metadata[0])), F.col(c)).alias(c))
        elif c in summary:
            cols.append(F.when(d.isin(R, S), F.col(c)).alias(c))
        else:
            cols.append(F.when(d == R, F.col(c)).alias(c))
    return df.select(*cols)


def _swap(a: str, b: str):
    return lambda x: F.replace(x, F.lit(a), F.lit(b))


def rendered_evidence(text: Column, form: str = "plain", most_bytes: int = 10_240, most_lines: int = 200) -> Column:
    """STRUCT<value, error>: untrusted text as labelled evidence, without control characters and escaped for plain, markdown or html. Text beyond the bounds is refused as a whole, never cut."""
    clean = normalized_text(text)[0]
    lines = F.split(clean, "\n")
    error = F.when(F.octet_length(clean) > most_bytes, "OL_EVIDENCE_BYTES").when(F.size(lines) > most_lines, "OL_EVIDENCE_LINES")
    if form == "html":
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            lines = F.transform(lines, _swap(a, b))
        value = F.concat(F.lit("<pre data-trust=\"untrusted\">"), F.array_join(lines, "\n"), F.lit("</pre>"))
    elif form == "markdown":
        value = F.concat(F.lit("untrusted evidence:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> "), F.regexp_replace(x, r"([\\`*_{}\[\]()<>#+.!|~-])", r"\\$1"))), "\n"))
    else:
        value = F.concat(F.lit("untrusted evidence:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("| "), x)), "\n"))
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))
