"""URL keys, hosts, scopes and shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query with its mark, fragment with its mark
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

# Query parameters that only track, for the key of search rows and for that of crawled pages.
SEARCH_TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid yclid msclkid ref ref_src source _ga mc_cid mc_eid "
    "igshid si _hsenc _hsmi mkt_tok trk trkcampaign sc_cid vero_id wickedid oly_anon_id oly_enc_id"
).split()
CRAWL_TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid ref ref_src source _ga mc_cid mc_eid".split()

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk com.cn net.cn org.cn gov.cn edu.cn com.au net.au org.au co.jp ne.jp or.jp co.kr com.br com.tw "
    "com.hk com.sg co.in com.mx com.tr co.nz co.za com.es com.it"
).split()

# First path parts of github.com that own no repositories.
NO_OWNERS = (
    "about apps codespaces collections dashboard explore features issues login marketplace new notifications orgs pricing pulls search security "
    "settings sponsors topics trending"
).split()


def part(url: Column, k: int) -> Column:
    """Part k (1 scheme to 5 fragment) of an absolute URL; '' where it has none."""
    return F.regexp_extract(F.trim(url), URL, k)


def host(url: Column) -> Column:
    """Lower-case host without user, port and brackets."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:[^@]*@)?([^:]*)", 1))


def bare_host(url: Column) -> Column:
    """Host without a leading www. label."""
    return F.regexp_replace(host(url), r"^www\.", "")


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, or three under a public suffix of two; addresses of numbers stay whole."""
    name = bare_host(url)
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return (
        F.when((F.size(labels) <= 2) | F.forall(labels, lambda x: x.rlike("^[0-9]+$")), name)
        .when(two.isin(TWO_LABEL_SUFFIXES), F.array_join(F.slice(labels, -3, 3), "."))
        .otherwise(two)
    )


def _kept_query(url: Column, names: list[str], prefixed: bool) -> Column:
    def keep(kv: Column) -> Column:
        name = F.lower(F.substring_index(kv, "=", 1))
        drop = name.isin(names) | name.startswith("utm_") if prefixed else name.isin(names)
        return (kv != "") & ~drop

    joined = F.array_join(F.filter(F.split(F.substring(part(url, 4), 2, 1_000_000), "&"), keep), "&")
    return F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def search_key(url: Column) -> Column:
    """Key under which search rows of one page meet: no tracking, default port, www., closing slash or fragment; owner and repository in lower case."""
    u = F.when(F.trim(url).startswith("//"), F.concat(F.lit("https:"), F.trim(url))).otherwise(F.trim(url))
    scheme, netloc, path = F.lower(part(u, 1)), F.lower(part(u, 2)), part(u, 3)
    name, port = F.regexp_extract(netloc, r"^([^:]*)", 1), F.regexp_extract(netloc, r":([0-9]+)$", 1)
    name = F.when(name.rlike(r"^www\.[^.]+\."), F.substring(name, 5, 1_000_000)).otherwise(name)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    address = F.when(netloc.contains("@"), netloc).when((port == "") | default, name).otherwise(F.concat(name, F.lit(":"), port))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    repository = F.regexp_extract(path, "^(/*[^/]+/+[^/]+)", 1)
    owned = (name == "github.com") & ~netloc.contains("@") & (repository != "") & ~F.lower(F.regexp_extract(path, "^/*([^/]+)", 1)).isin(NO_OWNERS)
    path = F.when(owned, F.concat(F.lower(repository), F.substring(path, F.length(repository) + 1, F.length(path)))).otherwise(path)
    return F.concat(scheme, F.lit("://"), address, path, _kept_query(u, SEARCH_TRACKING, True))


def crawl_key(url: Column) -> Column:
    """Key of a crawled page: keeps www., drops tracking by name only, and has a path."""
    scheme, netloc, path = F.lower(part(url, 1)), F.lower(part(url, 2)), part(url, 3)
    netloc = F.when(scheme == "http", F.regexp_replace(netloc, ":80$", "")).when(
        scheme == "https", F.regexp_replace(netloc, ":443$", "")
    ).otherwise(netloc)
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    return F.concat(scheme, F.lit("://"), netloc, path, _kept_query(url, CRAWL_TRACKING, False))


def page_key(url: Column) -> Column:
    """Host without www. and path, without a closing slash."""
    return F.concat(bare_host(url), F.regexp_replace(part(url, 3), "/+$", ""))


def within(name: Column, domain: Column) -> Column:
    """The host is the domain or one of its sub-domains."""
    return (name == domain) | name.endswith(F.concat(F.lit("."), domain))


def path_allowed(path: Column, include: list[str], exclude: list[str]) -> Column:
    """The path lies in one of the included subtrees (if any are named) and in no excluded one."""

    def under(p: str) -> Column:
        return (path == p) | path.startswith(p.rstrip("/") + "/")

    inside = F.lit(True) if not include else under(include[0])
    for p in include[1:]:
        inside = inside | under(p)
    for p in exclude:
        inside = inside & ~under(p)
    return inside


def path_of(url: Column) -> Column:
    """Path with a leading and without a closing slash."""
    p = F.regexp_replace(part(url, 3), "/+$", "")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def without_locale(path: Column) -> Column:
    """Path without a leading /xx or /xx-YY."""
    return F.regexp_replace(path, "^/[a-z]{2}(-[A-Z]{2})?(/|$)", "/")


def locale_of(path: Column) -> Column:
    return F.regexp_extract(path, "^/([a-z]{2}(-[A-Z]{2})?)(/|$)", 1)


def resolve(base: Column, link: Column) -> Column:
    """An absolute URL of a link on a page: absolute, scheme-relative, root-relative, fragment, query or relative to the folder."""
    scheme, netloc, path = part(base, 1), part(base, 2), part(base, 3)
    root = F.concat(scheme, F.lit("://"), netloc)
    whole = F.concat(root, path)
    folder = F.concat(root, F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#"), F.concat(whole, part(base, 4), link))
        .when(link.startswith("?"), F.concat(whole, link))
        .otherwise(F.concat(folder, link))
    )


def news_target(link: Column) -> Column:
    """The url parameter of a redirecting link, decoded; else the link."""
    raw = F.regexp_extract(link, "[?&]url=([^&#]*)", 1)
    return F.when(raw == "", link).otherwise(F.try_url_decode(raw))


def click_target(link: Column) -> Column:
    """The target in the u parameter of a click link: 'a1' and base64 for URLs; else the link."""
    raw = F.regexp_extract(link, "[?&]u=a1([A-Za-z0-9_-]*)", 1)
    padded = F.rpad(F.translate(raw, "-_", "+/"), (F.ceil(F.length(raw) / 4) * 4).cast("int"), "=")
    return F.when(raw == "", link).otherwise(F.decode(F.unbase64(padded), "UTF-8"))


def segment_target(link: Column) -> Column:
    """The target in the /RU=…/ segment of a link; else the link."""
    raw = F.regexp_extract(link, "/RU=([^/]*)/", 1)
    return F.when(raw == "", link).otherwise(F.try_url_decode(raw))


def shape_flags(url: Column) -> Column:
    """Names of conspicuous shapes of the address."""
    name = host(url)
    port = F.regexp_extract(part(url, 2), ":([0-9]+)$", 1)
    labels = F.split(name, r"\.")
    return F.array_compact(
        F.array(
            F.when(F.size(labels) >= 5, "many_labels"),
            F.when(F.length(name) - F.length(F.replace(name, F.lit("-"), F.lit(""))) >= 4, "many_hyphens"),
            F.when(F.exists(labels, lambda x: x.startswith("xn--")), "punycode"),
            F.when(name.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip_literal"),
            F.when((port != "") & ~port.isin("80", "443", "8080"), "odd_port"),
        )
    )


def farm_shaped(url: Column) -> Column:
    """Two host labels or more mix letters and digits, or a first label of ten characters or more has digits inside."""
    labels = F.split(host(url), r"\.")
    mixed = F.filter(labels, lambda x: x.rlike("[a-z]") & x.rlike("[0-9]"))
    first = F.element_at(labels, 1)
    return (F.size(mixed) >= 2) | ((F.length(first) >= 10) & first.rlike("^[a-z]+[0-9]+[a-z]"))


def dotted_ip(name: Column) -> Column:
    """A host written as one decimal or hexadecimal number, as a dotted address; null for others."""
    n = F.when(name.rlike("^[0-9]{1,10}$"), name.cast("long")).when(
        name.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(name, 3, 8), 16, 10).cast("long")
    )
    byte = lambda k: F.pmod(F.floor(n / F.lit(256**k)), F.lit(256)).cast("string")
    return F.when(n < 2**32, F.concat_ws(".", byte(3), byte(2), byte(1), byte(0)))
