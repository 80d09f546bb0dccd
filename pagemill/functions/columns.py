"""Scalar functions as column expressions: they stay in the JVM and inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.redact import SENSITIVE_NAMES
from pagemill.functions.urls import TRACKING_PATTERN

# ---- URLs


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    """Lower-cased host without credentials and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(url_authority(url), "^.*@", ""), r":\d*$", ""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def kept_parameters(query: Column, remove_tracking: bool = True) -> Column:
    """Query parameters as an array: trimmed, not empty, without those that only track."""
    parts = F.filter(F.transform(F.split(query, "&"), lambda x: F.trim(x)), lambda q: q != "")
    if remove_tracking:
        parts = F.filter(parts, lambda q: ~F.split_part(q, F.lit("="), F.lit(1)).rlike(f"^(?i:{TRACKING_PATTERN})$"))
    return parts


def url_normalize(url: Column, remove_tracking: bool = True) -> Column:
    """Normal form of an absolute URL; anything else is returned as it is."""
    scheme = url_scheme(url)
    host = F.lower(F.regexp_replace(url_authority(url), "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(host)
    path = F.when(url_path(url) == "", "/").otherwise(url_path(url))
    query = F.array_join(F.array_sort(kept_parameters(url_query(url), remove_tracking)), "&")
    base = F.concat(scheme, F.lit("://"), host, path)
    return F.when((scheme == "") | (host == ""), url).otherwise(F.when(query == "", F.regexp_replace(base, "/+$", "")).otherwise(F.concat(base, F.lit("?"), query)))


def url_crawl_key(url: Column, remove_tracking: bool = False) -> Column:
    """URL without fragment and, if asked, without tracking parameters; order, case and slash stay."""
    u = F.regexp_replace(url, "#.*$", "")
    if not remove_tracking:
        return u
    q = F.array_join(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda x: ~F.split_part(x, F.lit("="), F.lit(1)).rlike(f"^(?i:{TRACKING_PATTERN})$")), "&")
    head = F.regexp_replace(u, r"\?.*$", "")
    return F.when(F.instr(u, "?") == 0, u).when(q == "", head).otherwise(F.concat(head, F.lit("?"), q))


def _port(url: Column) -> Column:
    p = F.regexp_extract(url_authority(url), r":(\d+)$", 1)
    return F.when(p != "", p).when(url_scheme(url) == "https", "443").when(url_scheme(url) == "http", "80").otherwise("")


def same_origin(a: Column, b: Column) -> Column:
    return (url_scheme(a) == url_scheme(b)) & (url_host(a) == url_host(b)) & (_port(a) == _port(b))


def host_in_scope(host: Column, start: Column, subdomains: bool = True) -> Column:
    same = F.lower(host) == F.lower(start)
    return same | F.endswith(F.lower(host), F.concat(F.lit("."), F.lower(start))) if subdomains else same


def glob(value: Column, patterns: list[str]) -> Column:
    """Whether the whole value matches one of the '*' patterns, case ignored."""
    out = F.lit(False)
    for p in patterns:
        body = ".*".join("".join("\\" + c if not c.isalnum() else c for c in x) for x in p.split("*"))
        out = out | value.rlike(f"(?i)^{body}$")
    return out


# ---- text


def squash(text: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def collapse_markup(html: Column) -> Column:
    """White space collapsed in markup and dropped between tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"\s+", " "), r">\s+<", "><"))


def words_text(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"))


def words_crawl(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b[\p{L}\p{N}][\p{L}\p{N}'_-]*\b"))


def words_plan(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}[\p{L}\p{M}\p{N}'-]*"))


def words_split(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != ""))


def summary_crawl(text: Column, limit: int = 180) -> Column:
    """At most ``limit`` characters, cut at the last space if that is in the second half, with '...'."""
    t = squash(text)
    head = F.left(t, F.lit(limit))
    cut = F.length(head) - F.instr(F.reverse(head), " ")
    at = F.when((F.instr(head, " ") > 0) & (cut >= limit // 2), cut).otherwise(F.lit(limit))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(head, at)), F.lit("...")))


def summary_dataset(text: Column, limit: int = 240) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit("...")))


def strip_markdown(text: Column) -> Column:
    return F.translate(text, "#*`", "")


def fingerprint(text: Column, html: Column | None = None) -> Column:
    """SHA-256, upper hex, of the text with one kind of line end, trimmed; of the markup where the text is blank."""
    t = text if html is None else F.when(F.trim(F.coalesce(text, F.lit(""))) != "", text).otherwise(html)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), r"^\s+", ""), r"\s+$", "")
    return F.upper(F.sha2(t, 256))


def text_hash(text: Column) -> Column:
    return F.left(F.sha2(F.left(text, F.lit(256)), 256), F.lit(32))


def slug(text: Column, number: Column, limit: int = 48) -> Column:
    body = F.regexp_replace(F.left(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit(limit)), "^-+|-+$", "")
    return F.concat(F.lpad(number.cast("string"), 4, "0"), F.lit("-"), F.when(body == "", "page").otherwise(body))


def table_name(text: Column) -> Column:
    t = F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "_")
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("_"), t)).otherwise(t)


def strong_entity_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


# ---- dates

#: RFC 822 zone names.
_ZONES = {"GMT": "+00:00", "UTC": "+00:00", "UT": "+00:00", "Z": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}


#: Date forms besides ISO ones; two-digit years from 50 on are of the last century.
DATE_FORMS = (
    "d MMM yyyy HH:mm:ss XXX", "d MMM yyyy HH:mm XXX", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d-MMM-yyyy", "MM/dd/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM-yyyy", "MMMM yyyy",
)


def web_date(text: Column) -> Column:
    """Instant of a date as the web writes it: ISO day, month or instant, RFC 822, or a written day; null otherwise.

    A date without a zone is UTC; more than 64 characters are no date.
    """
    t = F.trim(text)
    r = F.regexp_replace(t, r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    r = F.regexp_replace(r, r"(:\d\d\s*[+-]\d\d)(\d\d)$", "$1:$2")
    for name, off in _ZONES.items():
        r = F.regexp_replace(r, rf"(?i)(\d)\s+{name}$", f"$1 {off}")
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?\s*(Z|[+-]\d\d:?\d\d)?)?$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(:\d\d(?:\.\d+)?\s*[+-]\d\d)(\d\d)$", "$1:$2"), "^(.{10}) ", "$1T"), r"^(.{10}T\d\d:\d\d)(?!:\d\d(?!$|:?\d?$)|:\d\d$|:\d\d[.Z\s+-])", "$1:00")))
    month = F.when(t.rlike(r"^\d{4}-\d\d$"), F.try_to_timestamp(F.concat(t, F.lit("-01"))))
    r = F.regexp_replace(F.regexp_replace(r, r"^(\d{1,2} [A-Za-z]{3}) ([0-4]\d) (\d\d:)", "$1 20$2 $3"), r"^(\d{1,2} [A-Za-z]{3}) ([5-9]\d) (\d\d:)", "$1 19$2 $3")
    return F.when(F.length(t) <= 64, F.coalesce(iso, month, *[F.try_to_timestamp(r, F.lit(f)) for f in DATE_FORMS]))


# ---- tokens


def base64url(text: Column) -> Column:
    t = F.translate(text, "-_", "+/")
    return F.try_to_binary(F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")).cast("string")


def jwt(token: Column) -> Column:
    """Header and claims of a JSON web token, unverified: struct of header, payload, algorithm, issuer, subject, times; null if it is none."""
    t = F.regexp_replace(F.trim(token), r"^(?i)bearer\s+", "")
    head, body = base64url(F.split_part(t, F.lit("."), F.lit(1))), base64url(F.split_part(t, F.lit("."), F.lit(2)))
    at = lambda k: F.timestamp_seconds(F.expr("cast(null as bigint)") if k is None else F.get_json_object(body, f"$.{k}").try_cast("bigint"))
    s = F.struct(
        head.alias("header"), body.alias("payload"), F.get_json_object(head, "$.alg").alias("algorithm"), F.get_json_object(body, "$.iss").alias("issuer"),
        F.get_json_object(body, "$.sub").alias("subject"), F.get_json_object(body, "$.aud").alias("audience"), F.get_json_object(body, "$.scope").alias("scope"),
        at("exp").alias("expires"), at("nbf").alias("not_before"), at("iat").alias("issued"),
    )
    return F.when(t.rlike(r"^[\w-]+\.[\w-]+\.[\w-]*$") & F.get_json_object(head, "$").isNotNull() & F.get_json_object(body, "$").isNotNull(), s)


def redact_query(url: Column) -> Column:
    """URL whose user information and sensitive parameters, by the whole words of their names, show '<redacted>'."""
    words = "|".join(sorted(SENSITIVE_NAMES, key=len, reverse=True))
    u = F.regexp_replace(url, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//)[^/?#@]+@", "$1<redacted>@")
    return F.regexp_replace(u, rf"(?i)([?&#](?:[^=&#]*[^A-Za-z0-9=&#])?(?:{words})(?:[^A-Za-z0-9=&#][^=&#]*)?=)[^&#]*", "$1<redacted>")


def enum_value(text: Column, names: list[str], default: str | None = None) -> Column:
    """The name of a fixed set that a text spells, case and outer spaces ignored; the default for any other text, null for null."""
    t = F.lower(F.trim(text))
    out = F.lit(default).cast("string")
    for n in reversed(names):
        out = F.when(t == n.lower(), F.lit(n)).otherwise(out)
    return F.when(text.isNotNull(), out)
