"""URL split and canonical form as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions.hosts import IPV6
from hostlens.functions.text import after_first, col

CONTROL_AND_SPACE = "".join(chr(i) for i in range(0x21))
BRACKET_HOST = rf"^\[(?:v[a-fA-F0-9]+\..+|{IPV6})\](?::.*)?\z"


@lru_cache(maxsize=1)
def _lookalike_delimiters() -> str:
    """Class of characters whose compatibility form holds a URL delimiter."""
    bad = [
        chr(c)
        for c in range(0x80, 0x110000)
        if not 0xD800 <= c <= 0xDFFF and set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:")
    ]
    return "[" + "".join(bad) + "]"


def tidy(value: Column | str) -> Column:
    """Drop leading control characters and any tab or line break inside."""
    text = col(value)
    front = F.when(text.rlike(r"^[\x00-\x20]"), F.ltrim(text, F.lit(CONTROL_AND_SPACE))).otherwise(text)
    return F.when(front.rlike(r"[\t\r\n]"), F.translate(front, "\t\r\n", "")).otherwise(front)


def scheme_of(tidied: Column) -> Column:
    has = tidied.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.when(has, F.lower(F.substring_index(tidied, ":", 1))).otherwise(F.lit(""))


def split_rest(rest: Column) -> dict[str, Column]:
    """Authority, path with parameters, query and fragment of the text behind `scheme:`."""
    no_fragment = F.substring_index(rest, "#", 1)
    body = F.substring_index(no_fragment, "?", 1)
    has_authority = F.startswith(body, F.lit("//"))
    netloc = F.when(has_authority, F.substring_index(F.substr(body, F.lit(3)), "/", 1)).otherwise(F.lit(""))
    full_path = F.when(has_authority, F.substr(body, F.length(netloc) + 3)).otherwise(body)
    return {
        "netloc": netloc,
        "path": strip_params(full_path),
        "query": after_first(no_fragment, "?"),
        "fragment": after_first(rest, "#"),
    }


def strip_params(path: Column) -> Column:
    """Cut the `;parameters` of the last path segment."""
    return F.when(F.contains(path, F.lit(";")), F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path)


def bad_authority(netloc: Column) -> Column:
    """Unbalanced or misplaced brackets, or look-alike delimiters."""
    opened, closed = F.contains(netloc, F.lit("[")), F.contains(netloc, F.lit("]"))
    host_port = F.substring_index(netloc, "@", -1)
    brackets = (opened != closed) | (opened & closed & ~host_port.rlike(BRACKET_HOST))
    lookalike = netloc.rlike(r"[^\x00-\x7F]") & netloc.rlike(_lookalike_delimiters())
    return brackets | lookalike


def host_and_port(netloc: Column) -> tuple[Column, Column]:
    host_port = F.substring_index(netloc, "@", -1)
    bracketed = F.contains(host_port, F.lit("["))
    inner = after_first(host_port, "[")
    host = F.when(bracketed, F.substring_index(inner, "]", 1)).otherwise(F.substring_index(host_port, ":", 1))
    port = F.when(bracketed, after_first(after_first(inner, "]"), ":")).otherwise(after_first(host_port, ":"))
    return host, port


def port_number(port: Column) -> Column:
    """Port as a number; null for none; -1 for unusable text."""
    number = F.expr("int(null)")
    return (
        F.when(port == "", number)
        .when(port.rlike(r"^[0-9]+\z"), F.coalesce(port.try_cast("bigint"), F.lit(-1)))
        .otherwise(F.lit(-1))
        .cast("bigint")
    )


def port_ok(port: Column) -> Column:
    return port.isNull() | port.between(0, 65535)


def query_pairs(query: Column) -> Column:
    """Decoded, filtered and sorted (key, value) pairs of a raw query string."""

    def decode(text: Column) -> Column:
        escaped = F.contains(text, F.lit("%")) | F.contains(text, F.lit("+"))
        plain = F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))
        return F.when(escaped, plain).otherwise(text)

    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("k"), decode(after_first(p, "=")).alias("v")
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*V.TRACKING_PARAMS))
    return F.array_sort(kept)


def canonical_query(query: Column) -> Column:
    def encode(text: Column) -> Column:
        # Java leaves `*` and escapes `~`; the form wanted here is the reverse.
        return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    joined = F.array_join(
        F.transform(query_pairs(query), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&"
    )
    return F.when(query == "", F.lit("")).otherwise(joined)


def build_url(scheme: Column, host: Column, port: Column, path: Column, query: Column) -> Column:
    default = F.lit(None).cast("bigint")
    for name, number in V.DEFAULT_PORTS.items():
        default = F.when(scheme == name, F.lit(number).cast("bigint")).otherwise(default)
    shown = F.when((port > 0) & (port != default), F.concat(F.lit(":"), port.cast("string")))
    return F.concat(
        scheme,
        F.lit("://"),
        host,
        F.coalesce(shown, F.lit("")),
        F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def resolve_reference(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution of `ref` against an absolute http(s) `base`."""
    base_scheme = F.substring_index(base, ":", 1)
    b = split_rest(after_first(base, ":"))
    base_path = F.substring_index(F.substring_index(after_first(base, ":"), "#", 1), "?", 1)
    base_path = F.substr(base_path, F.length(b["netloc"]) + 3)
    root = F.concat(base_scheme, F.lit("://"), b["netloc"])
    base_dir = F.regexp_replace(base_path, r"[^/]*\z", "")
    ref_tail_at = F.length(F.substring_index(F.substring_index(ref, "#", 1), "?", 1))
    ref_path = F.substr(ref, F.lit(1), ref_tail_at)
    ref_tail = F.substr(ref, ref_tail_at + 1)
    merged = F.when(F.startswith(ref_path, F.lit("/")), ref_path).otherwise(
        F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), ref_path)
    )
    has_scheme = ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    base_query = F.when(b["query"] != "", F.concat(F.lit("?"), b["query"])).otherwise(F.lit(""))
    return (
        F.when(ref == "", base)
        .when(has_scheme, ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(base_scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(root, base_path, base_query, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(root, base_path, ref))
        .otherwise(F.concat(root, _remove_dot_segments(merged), ref_tail))
    )


def _remove_dot_segments(path: Column) -> Column:
    def step(acc: Column, seg: Column) -> Column:
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(seg == "..", popped).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))

    segments = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    closing = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    flat = F.concat(F.lit("/"), F.array_join(kept, "/"), closing)
    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), flat).otherwise(path)
