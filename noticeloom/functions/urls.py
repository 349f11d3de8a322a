"""URL expressions built on one split of the generic URI syntax."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from noticeloom import rules
from noticeloom.functions.text import WHITESPACE, bind, col, contains_any, strip

# scheme, authority, path, query - the split of the generic URI grammar.
_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
_PARTS = _SCHEME + r"(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?s:#.*)?$"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@]*)"


def _clean(url: Column | str) -> Column:
    """What a URL parser drops first: leading controls, and tabs and line ends anywhere."""
    return F.regexp_replace(col(url), r"^[\x{00}-\x{20}]+|[\t\r\n]+", "")


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, _PARTS, index)


def _decode(piece: Column) -> Column:
    # A stray percent sign stays as it is: escape it so that decoding always succeeds.
    return F.url_decode(F.regexp_replace(piece, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(piece: Column) -> Column:
    # The form encoder leaves the asterisk and escapes the tilde; undo both.
    return F.replace(F.replace(F.url_encode(piece), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _identity_query(query: Column) -> Column:
    """Re-encoded query without tracking parameters, order and blank values kept."""

    def name(pair: Column) -> Column:
        return _decode(F.split_part(pair, F.lit("="), F.lit(1)))

    def is_identity(pair: Column) -> Column:
        key = F.lower(name(pair))
        return (pair != "") & (key != "tracking") & ~key.startswith("utm_")

    def rebuild(pair: Column) -> Column:
        value = F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1)
        return F.concat(_encode(name(pair)), F.lit("="), _encode(_decode(value)))

    pairs = F.filter(F.split(query, "&"), is_identity)
    return F.array_join(F.transform(pairs, rebuild), "&")


def canonical_url(url: Column | str) -> Column:
    """Lower-case scheme and authority, no trailing slash, fragment or tracking parameters."""
    text = _clean(url)
    scheme, authority = F.lower(_part(text, 1)), F.lower(_part(text, 2))
    path = F.regexp_replace(_part(text, 3), "/+$", "")
    raw_query = _part(text, 4)
    # Most URLs carry no query: skip the decode and encode work for them.
    query = F.when(raw_query == "", F.lit("")).otherwise(_identity_query(raw_query))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def host(url: Column | str) -> Column:
    """Lower-case host name, NULL when there is none."""
    return F.nullif(F.lower(F.regexp_extract(_clean(url), _HOST, 1)), F.lit(""))


def path(url: Column | str) -> Column:
    return _part(_clean(url), 3)


def allowed_host(url: Column | str, domains: Column | str | list[str] | tuple[str, ...]) -> Column:
    """Exact host membership; no suffix match."""
    name = host(url)
    if isinstance(domains, (list, tuple)):
        member = name.isin(list(domains))
    else:
        member = F.array_contains(col(domains), name)
    return F.coalesce(member, F.lit(False))


def safe_url(url: Column | str) -> Column:
    """Drop credentials, query and fragment."""
    text = _clean(url)
    scheme = F.lower(_part(text, 1))
    authority = F.regexp_replace(_part(text, 2), "^.*@", "")
    server = F.concat(
        F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1)),
        F.regexp_extract(authority, r"(:[0-9]+)$", 1),
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(server != "", F.concat(F.lit("//"), server)).otherwise(""),
        _part(text, 3),
    )


def url_hosts(urls: Column | str) -> Column:
    """Distinct hosts in first-seen order."""
    return F.array_distinct(F.filter(F.transform(col(urls), host), lambda name: name.isNotNull()))


def valid_links(cell: Column | str) -> Column:
    """Keep the http and https links of a cell, one per line; unchanged when none is valid."""
    pieces = F.transform(F.split(col(cell), "[、\n;；]+"), strip)
    links = F.filter(pieces, lambda piece: piece.rlike("^[hH][tT][tT][pP][sS]?://[^/?#]"))
    return F.when(F.size(links) > 0, F.array_join(links, "\n")).otherwise(col(cell))


def is_gov_domain(domain: Column | str, suffix: str = rules.GOV_SUFFIX) -> Column:
    return col(domain).endswith(suffix)


def robots_allows(raw: Column | str, target_path: Column | str) -> Column:
    """False when any disallow line holds a nonblank prefix of the path; groups are ignored."""
    wanted = col(target_path)
    lines = F.split(col(raw), r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]")
    rule = f"(?i)^{WHITESPACE}*disallow:{WHITESPACE}*(.*?){WHITESPACE}*$"
    prefixes = F.transform(lines, lambda line: F.regexp_extract(line, rule, 1))
    blocked = F.exists(prefixes, lambda prefix: (prefix != "") & wanted.startswith(prefix))
    return ~F.coalesce(blocked, F.lit(False))


def restricted_reason(
    status: Column | str,
    html: Column | str,
    final_host: Column | str,
    domains: Column | str | list[str] | tuple[str, ...] | None = None,
    login_words=rules.LOGIN_WORDS,
    captcha_markers=rules.CAPTCHA_MARKERS,
    password_word: str = rules.PASSWORD_WORD,
) -> Column:
    """First reason a portal page is restricted: status, domain, login wall, captcha."""
    code = col(status)
    reason = F.when(code >= 400, F.concat(F.lit("http_"), code.cast("string")))
    if domains is not None:
        name = col(final_host)
        inside = (
            name.isin(list(domains))
            if isinstance(domains, (list, tuple))
            else F.array_contains(col(domains), name)
        )
        reason = reason.when(~F.coalesce(inside, F.lit(False)), "cross_domain")

    def walled(low: Column) -> Column:
        login = low.contains(password_word) & contains_any(low, [word.lower() for word in login_words])
        captcha = contains_any(low, [marker.lower() for marker in captcha_markers])
        return F.when(login, "login").when(captcha, "captcha")

    # A page is put into lower case once, not once a word.
    return reason.otherwise(bind(F.lower(col(html)), walled))


def fetch_restricted(
    status: Column | str,
    body: Column | str,
    statuses=rules.FETCH_RESTRICTED_STATUSES,
    markers=rules.FETCH_RESTRICTED_MARKERS,
) -> Column:
    """True when a document fetch met an access restriction."""
    low = F.lower(F.coalesce(col(body), F.lit("")))
    return col(status).isin(list(statuses)) | contains_any(low, [item.lower() for item in markers])
