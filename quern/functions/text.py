"""Text functions as column expressions; Python helpers where Spark has no built-in."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from functools import cache
from urllib.parse import parse_qsl, urlencode, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.arrays import once, running_sums


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def phrase(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column, longest: int = 80) -> Column:
    """Lower-case words joined by hyphens; beyond ``longest`` characters cut and marked with a digest."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(s) > longest, F.concat(F.substring(s, 1, longest - 9), F.lit("-"), F.substring(F.sha2(s, 256), 1, 8))).otherwise(s)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


#: Accented letters and the plain letters that stand for them, in order (fixed values).
ACCENTED = "àáâãäåąçćèéêëęìíîïłñńòóôõöśùúûüýÿźż"
PLAIN = "aaaaaaacceeeeeiiiilnnooooosuuuuyyzz"


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def fold_german(c: Column) -> Column:
    out = F.lower(c)
    for letter, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def word_line(text: Column) -> Column:
    """The lower-case runs of letters and digits of a text, each between blanks."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def name_line(name: Column) -> Column:
    """The words that a name can be found by, between blanks: split at punctuation, and with hyphens left out, in both foldings."""
    forms = [form for folded in (fold_accents(name), fold_german(name)) for form in (folded, F.replace(folded, F.lit("-"), F.lit("")))]
    return F.concat(F.lit(" "), F.regexp_replace(F.concat_ws(" ", *forms), r"[^a-z0-9]+", " "), F.lit(" "))


def mentions(body: Column, name: str) -> Column:
    """Whether ``name`` stands in ``body`` as whole words."""
    return body.rlike(r"(?i)(?<![\p{L}\p{N}_])" + re.escape(name) + r"(?![\p{L}\p{N}_])")


def contains_words(text: Column, part: Column) -> Column:
    """Whether the words of ``part`` stand in ``text`` one after the other."""
    pad = lambda c: F.concat(F.lit(" "), phrase(c), F.lit(" "))
    return F.contains(pad(text), pad(part))


#: What parts sentences: white space behind their end, or line ends. White space is looked for first, for most characters are none.
SENTENCE_GAP = r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\n*)"


def sentences(c: Column) -> Column:
    """Sentences; a point between digits does not end one."""
    # trim alone would take the place of a piece as its second argument, the characters to cut off
    return F.filter(F.transform(F.split(c, SENTENCE_GAP), lambda s: F.trim(s)), lambda s: s != "")


def probability(c: Column) -> Column:
    """An explicit probability: ``10%``, ``0.1``, ``.1`` or ``1``; null otherwise."""
    t = F.trim(c)
    percent = F.when(t.rlike(r"^[0-9]+(?:\.[0-9]+)?\s*%$"), F.regexp_extract(t, r"^([0-9.]+)", 1).cast("double") / 100)
    plain = F.when(t.rlike(r"^(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)$"), F.try_to_number(t, F.lit("999999999.999999999")).cast("double"))
    value = F.coalesce(percent, plain)
    return F.when(value.between(0, 1), value)


def trim_zeros(c: Column) -> Column:
    """A decimal text without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def escape_xml(c: Column) -> Column:
    for raw, out in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def stable_uuid(space: str, name: Column) -> Column:
    """A name-based UUID (version 5 layout) from SHA-1 of the namespace text and the name."""
    h = F.sha1(F.concat(F.lit(space), name))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def number_text(c: Column) -> Column:
    """A number as hashes need it: 1 rather than 1.0."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def content_key(*fields: Column) -> Column:
    """SHA-256 of fields joined by line feeds; null fields are empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def prefixed_key(prefix: str, key: Column, size: int = 20) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(key, 1, size))


def git_blob(c: Column) -> Column:
    """The object name that git gives to a file with this text."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(c).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def quarter_key(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def target_dates(horizon: Column) -> Column:
    """struct(start, end) of "by Y" (end of Y), "before Y" (end of the year before) and "in Y" (the whole year)."""
    word, year = F.lower(F.regexp_extract(horizon, r"(?i)\b(by|before|in)\s+((?:20|21)[0-9]{2})\b", 1)), F.regexp_extract(horizon, r"(?i)\b(by|before|in)\s+((?:20|21)[0-9]{2})\b", 2)
    y = F.when(year != "", year.cast("int"))
    end = F.make_date(F.when(word == "before", y - 1).otherwise(y), F.lit(12), F.lit(31))
    return F.struct(F.when(word == "in", F.make_date(y, F.lit(1), F.lit(1))).alias("start"), end.alias("end"))


def inverted_text(index: Column) -> Column:
    """The text behind a map of word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


#: Licence families with the patterns of their tokens and URLs in lower case; the first that matches is taken.
LICENCES = (
    ("cc0", r"(?<![a-z0-9])cc0(?![a-z0-9])|publicdomain/zero"),
    ("cc-by-nc", r"cc[ -]by[ -]nc|licenses/by-nc"),
    ("cc-by-sa", r"cc[ -]by[ -]sa|licenses/by-sa"),
    ("cc-by-nd", r"cc[ -]by[ -]nd|licenses/by-nd"),
    ("cc-by", r"cc[ -]by|licenses/by|creative commons attribution"),
    ("apache-2.0", r"apache"),
    ("mit", r"(?<!\w)mit license|licenses/mit"),
    ("gpl", r"gnu general public|licenses/gpl"),
    ("reserved", r"all rights reserved"),
)
#: Those that running text names by words.
NAMED_LICENCES = (("cc-by-nc", r"cc[ -]by[ -]nc"), ("apache-2.0", r"apache"), ("mit", r"(?<!\w)mit license"), ("gpl", r"gnu general public"), ("reserved", r"all rights reserved"))


def licence_family(c: Column, rules: tuple[tuple[str, str], ...] = LICENCES) -> Column:
    """The licence family that a token or URL names; for running text, ``rules`` are ``NAMED_LICENCES``."""
    t = F.lower(F.replace(c, F.lit("İ"), F.lit("i")))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


#: Query parameters that only track a visit (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, tracking parameter or slash at the end; sorted parameters."""
    t = F.trim(c)
    scheme, rest = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_replace(t, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_extract(rest, r"^([^#]*)", 1)
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(*TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path, tail))


def ipv4_number(c: Column) -> Column:
    parts = F.split(c, r"\.")
    ok = c.rlike(r"^(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    return F.when(ok, sum((F.get(parts, F.lit(i)).cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0)))


def blocked_ipv4(c: Column) -> Column:
    """Addresses that a fetch must not reach: private, loopback, link-local, shared, multicast, reserved."""
    n = ipv4_number(c)
    out = F.lit(False)
    for net in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/3"):
        block = ipaddress.ip_network(net)
        out = out | n.between(int(block.network_address), int(block.broadcast_address))
    return out


@cache
def _combining() -> str:
    """A class of all characters that combine with the one before them."""
    found, ranges = [c for c in range(0x110000) if unicodedata.combining(chr(c))], []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def name_words(names: Column) -> Column:
    """The words of a person's name: no marks, lower case, letters and digits of any script.

    An apostrophe joins what stands beside it, any other sign parts words; null has no words.
    """
    apart = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(names, F.lit("")), F.lit(True))
    plain = F.replace(F.lower(F.regexp_replace(apart, _combining(), "")), F.lit("'"), F.lit(""))
    return F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def name_keys(names: Column) -> Column:
    """A person's name for matching: its words of two letters and more; null gives an empty key."""
    return F.array_join(F.filter(name_words(names), lambda w: F.length(w) > 1), " ")


def sorted_query(url: str) -> str:
    """Driver-side form of ``canonical_url`` for single parameters, with percent-decoding."""
    parts = urlsplit(url)
    kept = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in TRACKING)
    return parts._replace(scheme=parts.scheme.lower(), netloc=parts.netloc.lower(), path=parts.path.rstrip("/"), query=urlencode(kept), fragment="").geturl()


def canonical_json(c: Column) -> Column:
    """A JSON text in compact form with the keys of all objects in order; null if it is no JSON."""
    return F.to_json(F.try_parse_json(c))


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts are equal whatever the order of their keys; texts that are no JSON equal nothing."""
    return F.coalesce(canonical_json(a) == canonical_json(b), F.lit(False))


#: Hosts of profiles and the pattern of the handle in the path (fixed values).
PROFILES = (("orcid", r"^orcid\.org$", r"^/(\d{4}-\d{4}-\d{4}-\d{3}[\dX])/?$"), ("github", r"^(?:www\.)?github\.com$", r"^/([A-Za-z0-9-]+)/?$"), ("mastodon", r"^[a-z0-9.-]+$", r"^/@([A-Za-z0-9_]+)/?$"))


def profile_link(url: Column) -> Column:
    """struct(kind, handle) of a link to a person's profile; null for other links."""
    host, path = F.lower(F.parse_url(url, F.lit("HOST"))), F.parse_url(url, F.lit("PATH"))
    return F.coalesce(*[F.when(host.rlike(h) & path.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(path, p, 1).alias("handle"))) for k, h, p in PROFILES])


def sentence_spans(c: Column) -> Column:
    """Sentences with their place: array of (start, stop, text), in characters, stop exclusive; as ``sentences`` cuts them."""
    cut = F.struct(F.split(c, SENTENCE_GAP, -1).alias("pieces"), F.regexp_extract_all(c, F.lit(SENTENCE_GAP), F.lit(0)).alias("gaps"))

    def place(raw: Column, end: Column) -> Column:
        at = end["end"] - end["length"] + F.length(raw) - F.length(F.ltrim(raw))
        return F.struct(at.cast("int").alias("start"), (at + F.length(F.trim(raw))).cast("int").alias("stop"), F.trim(raw).alias("text"))

    def placed(z: Column) -> Column:
        lengths = F.zip_with(z["pieces"], z["gaps"], lambda p, g: F.length(p) + F.coalesce(F.length(g), F.lit(0)))
        ends = once(lengths, lambda ns: F.zip_with(running_sums(ns), ns, lambda e, n: F.struct(e.alias("end"), n.alias("length"))))
        return F.filter(F.zip_with(z["pieces"], ends, place), lambda s: s.text != "")

    return once(cut, placed)


def ipv6_groups(c: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; null if it is none."""
    t = F.lower(c)
    halves = F.split(t, "::", -1)
    left, right = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda g: g != ""), F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda g: g != "")
    missing = 8 - F.size(left) - F.size(right)
    whole = F.when(F.size(halves) == 1, left).otherwise(F.concat(left, F.array_repeat(F.lit("0"), missing.cast("int")), right))
    ok = t.rlike(r"^[0-9a-f:]+$") & t.contains(":") & ~t.rlike(r":::|^:[^:]|[^:]:$") & (F.size(halves) <= 2) & (F.size(whole) == 8) & F.forall(whole, lambda g: F.length(g) <= 4) & ((F.size(halves) == 1) | (missing >= 1))
    return F.when(ok, F.transform(whole, lambda g: F.conv(g, 16, 10).cast("int")))


def blocked_ipv6(c: Column) -> Column:
    """IPv6 addresses that a fetch must not reach: unspecified, loopback, local, link-local, multicast, and mapped IPv4 ones that are blocked."""
    g = ipv6_groups(c)
    at = lambda i: F.get(g, F.lit(i))
    zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
    low = F.concat_ws(".", (at(6) / 256).cast("int"), at(6) % 256, (at(7) / 256).cast("int"), at(7) % 256)
    local = at(0).between(0xFC00, 0xFDFF) | at(0).between(0xFE80, 0xFEBF) | (at(0) >= 0xFF00)
    return F.when(g.isNotNull(), (zero(7) & (at(7) <= 1)) | local | (zero(5) & (at(5) == 0xFFFF) & F.coalesce(blocked_ipv4(low), F.lit(True))))


def mapped(vocabulary: dict[str, str], c: Column) -> Column:
    """The word that a vocabulary has for ``c``; any other word, but null, is an error."""
    found = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in vocabulary.items()])
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("not in the vocabulary: "), c)).cast("string")))
