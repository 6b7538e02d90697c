"""Location columns: source classification, URL checks and output names.

All are native Column expressions.  http(s) URLs are read by the rules of the
public URL standard, which URL parsers follow: white space around and line
breaks inside go, backslashes are slashes and any number of them may follow the
scheme, user names and ports are dropped, the host is percent-decoded and
lower-cased (an IPv6 address gets its shortest form), an empty host, a forbidden
character in it or a port beyond 65535 makes it no URL; in the path ``.`` and
``..`` (percent-encoded too) are resolved and characters that may not stand
there are percent-encoded as UTF-8.  Not done: Punycode for hosts beyond ASCII,
IPv4 addresses in other bases.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
VALID_URL_PREFIXES = ("http://", "https://")
HTML_EXTS = ("html", "htm")
URL_NAME_UNSAFE_RE = r"[^\p{L}\p{N}_.-]"
CRAWL_NAME_UNSAFE = '<>:"|?*'
DEFAULT_HOST = "webpage"
INDEX_PAGE = "index"
MAX_PORT = 65535
HOST_FORBIDDEN_RE = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"
# characters of a path that stay as they are (printable ASCII but space and " # < > ? ` { })
PATH_SAFE = r"!$%&'()*+,./0-9:;=@A-Z\[\\\]^_a-z|~-"
ONE_DOT, TWO_DOTS = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")
# -----------------------------------------------------------------------------------

URL_RE = r"(?is)^https?:[/\\]*([^/\\?#]*)([^?#]*)"
IPV6_PORT_RE, NAME_PORT_RE = r"^\[([0-9A-Fa-f:]+)\](?::([0-9]*))?\z", r"(?s)^([^:\[\]]+)(?::([0-9]*))?\z"
FILE_NAME_RE = r"([^/]*)\z"
FILE_DIR_RE = r"^(.*/)"
HAS_EXT_RE = r"^.+\.[^.]*\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ipv6(text: Column) -> Column:
    """Shortest form of an IPv6 address: eight groups, then ``::`` for the first longest run of zeros."""
    parts = F.split(text, "::", -1)
    groups = lambda c: F.filter(F.split(c, ":", -1), lambda g: g != "")
    left, right = groups(F.element_at(parts, 1)), groups(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    fill = F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right))
    full = F.when(F.size(parts) == 2, F.concat(left, F.array_repeat(F.lit("0"), fill), right)).otherwise(F.split(text, ":", -1))
    valid = (F.size(parts) <= 2) & (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    whole = F.concat(F.lit(":"), F.array_join(F.transform(full, lambda g: F.regexp_replace(F.lower(g), "^0+([0-9a-f])", "$1")), ":"), F.lit(":"))

    def shortest(whole):
        out = whole
        for n in range(2, 9):  # the longest run is tried first
            zeros = ":" + "0:" * n
            at = F.instr(whole, zeros)
            out = F.when(at > 0, F.concat(F.substring(whole, F.lit(1), at - 1), F.lit("::"), F.substring(whole, at + len(zeros), F.length(whole)))).otherwise(out)
        # the outer colons go, those of a run at either end stay
        return F.regexp_replace(F.regexp_replace(out, "^:([^:])", "$1"), "([^:]):$", "$1")
    return F.when(valid, F.concat(F.lit("["), _let(whole, shortest), F.lit("]")))


def parse_http_url(col) -> Column:
    """struct<host, path> of an http(s) URL, NULL for anything else."""
    clean = F.translate(F.regexp_replace(_c(col), r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), "\t\n\r", "")

    def parts(c):
        place = F.regexp_replace(F.regexp_extract(c, URL_RE, 1), r"(?s)^.*@", "")
        return F.struct(c.rlike(URL_RE).alias("http"), F.regexp_extract(c, URL_RE, 2).alias("raw"),
                        F.regexp_extract(place, IPV6_PORT_RE, 1).alias("v6"), F.regexp_extract(place, NAME_PORT_RE, 1).alias("name"),
                        F.regexp_replace(F.concat(F.regexp_extract(place, IPV6_PORT_RE, 2), F.regexp_extract(place, NAME_PORT_RE, 2)), "^0+", "").alias("port"))

    def read(x):
        port_ok = (F.length(x["port"]) <= 5) & (F.coalesce(x["port"].try_cast("int"), F.lit(0)) <= MAX_PORT)
        plain = F.lower(F.try_url_decode(F.replace(x["name"], F.lit("+"), F.lit("%2B"))))
        plain = _let(plain, lambda h: F.when((h != "") & ~h.rlike(HOST_FORBIDDEN_RE), h))
        host = F.when(x["v6"] != "", _ipv6(x["v6"])).otherwise(plain)
        return _let(host, lambda h: F.when(x["http"] & port_ok & h.isNotNull(), F.struct(h.alias("host"), url_path(x["raw"]).alias("path"))))
    return _let(clean, lambda c: _let(parts(c), read))


def url_path(raw: Column) -> Column:
    """A URL's path with its dot segments resolved (an ordered fold over the segments
    with a stack) and encoded; it always begins with ``/``."""
    segs = F.split(F.regexp_replace(raw, r"^[/\\]", ""), r"[/\\]", -1)
    low = lambda s: F.lower(s)
    stack = F.aggregate(segs, F.expr("cast(array() as array<string>)"), lambda acc, s: F.when(
        low(s).isin(*TWO_DOTS), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(
        low(s).isin(*ONE_DOT), acc).otherwise(F.array_append(acc, s)))
    ends = low(F.element_at(segs, -1)).isin(*ONE_DOT, *TWO_DOTS)  # then the path ends with a slash
    joined = F.array_join(F.when(ends, F.array_append(stack, F.lit(""))).otherwise(stack), "/")
    runs = F.regexp_extract_all(joined, F.lit(f"(?s)[{PATH_SAFE}]+|[^{PATH_SAFE}]+"), 0)
    safe = F.transform(runs, lambda r: F.when(r.rlike(f"^[{PATH_SAFE}]"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))))
    return F.concat(F.lit("/"), F.array_join(safe, ""))


def classify_source(col, base_dir: str = "/") -> Column:
    """struct<kind, location>: an http(s) URL -> url; else a file path, made
    absolute against ``base_dir`` when relative."""
    c = _c(col)
    is_url = parse_http_url(c).isNotNull()
    base = base_dir.rstrip("/") + "/"
    loc = F.when(is_url | c.startswith("/"), c).otherwise(F.concat(F.lit(base), c))
    return F.struct(F.when(is_url, F.lit("url")).otherwise(F.lit("file")).alias("kind"), loc.alias("location"))


def is_http_url(col) -> Column:
    c = _c(col)
    return F.coalesce((c != "") & (c.startswith(VALID_URL_PREFIXES[0]) | c.startswith(VALID_URL_PREFIXES[1])),
                      F.lit(False))


def file_ext(col) -> Column:
    name = F.regexp_extract(_c(col), FILE_NAME_RE, 1)
    return F.when(name.rlike(HAS_EXT_RE), F.regexp_extract(name, r"^.+\.([^.]*)\z", 1))


def ext_warning(col) -> Column:
    """Extension present and neither html nor htm (case-sensitive)."""
    e = file_ext(col)
    return e.isNotNull() & ~e.isin(*HTML_EXTS)


def output_name_file(col, lang: str, explicit: Column | None = None) -> Column:
    """``{dir}/{stem}_{lang}.{ext}``; no extension leaves a trailing dot.  A name given wins."""
    c = _c(col)
    d = F.regexp_extract(c, FILE_DIR_RE, 1)
    name = F.regexp_extract(c, FILE_NAME_RE, 1)
    has = name.rlike(HAS_EXT_RE)
    stem = F.when(has, F.regexp_extract(name, r"^(.+)\.[^.]*\z", 1)).otherwise(name)
    ext = F.when(has, F.regexp_extract(name, r"^.+\.([^.]*)\z", 1)).otherwise(F.lit(""))
    out = F.concat(d, stem, F.lit(f"_{lang}."), ext)
    return out if explicit is None else F.coalesce(explicit, out)


def output_name_url(col, lang: str, explicit: Column | None = None) -> Column:
    """``{host}_{page}_{lang}.html``, page = last non-empty path segment cut at its
    last dot (``index`` when there is none); unsafe characters -> ``_``.  A name given wins."""
    def name(url):
        last = F.try_element_at(F.filter(F.split(url["path"], "/", -1), lambda s: s != ""), F.lit(-1))
        page = _let(last, lambda p: F.when(p.contains("."), F.regexp_extract(p, r"^(.*)\.[^.]*\z", 1)).otherwise(p))
        return F.concat(F.coalesce(url["host"], F.lit(DEFAULT_HOST)), F.lit("_"), F.coalesce(page, F.lit(INDEX_PAGE)), F.lit(f"_{lang}.html"))
    out = F.regexp_replace(_let(parse_http_url(col), name), URL_NAME_UNSAFE_RE, "_")
    return out if explicit is None else F.coalesce(explicit, out)


def crawl_name(col, epoch: int) -> Column:
    """Crawler default file name: host + path with ``/`` -> ``_``, unsafe -> ``_``,
    one pass of ``__`` -> ``_``, ``_`` trimmed at the ends, ``_{epoch}.html``."""
    def start(url):
        host, path = F.coalesce(url["host"], F.lit("unknown")), F.coalesce(url["path"], F.lit("/"))
        return F.when(path == "/", F.concat(host, F.lit("_index"))).otherwise(F.concat(host, F.replace(path, F.lit("/"), F.lit("_"))))
    base = _let(parse_http_url(col), start)
    base = F.translate(base, CRAWL_NAME_UNSAFE, "_" * len(CRAWL_NAME_UNSAFE))
    base = F.replace(base, F.lit("__"), F.lit("_"))
    base = F.regexp_replace(base, r"^_+|_+\z", "")
    return F.concat(base, F.lit(f"_{epoch}.html"))


def with_provenance(html, url, ts: str) -> Column:
    """Three provenance comments, a blank line, then the page."""
    stamp = F.date_format(F.to_timestamp(F.lit(ts)), "yyyy-MM-dd HH:mm:ss")
    return F.concat(F.lit("<!-- generated by babelfold -->\n<!-- source URL: "), _c(url),
                    F.lit(" -->\n<!-- generated at: "), stamp, F.lit(" UTC -->\n\n"), _c(html))
