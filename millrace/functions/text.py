"""Column expressions over text, URLs and HTML. All are built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*names: str) -> Column:
    """The first of the columns that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` made once for a row, however often it is used and behind whatever conditions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compact(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized(text: Column) -> Column:
    """Lines without trailing blanks, nothing around the whole."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"^\s+|\s+$", "")


def plain_from_html(html: Column) -> Column:
    """Scripts and styles dropped, tags turned to blanks, white space collapsed; entities stay."""
    gone = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return compact(F.regexp_replace(gone, r"(?s)<[^>]+>", " "))


def links(html: Column) -> Column:
    """Targets of href attributes that are not mail, script or telephone links, in order."""
    found = F.regexp_extract_all(html, F.lit(r"href=[\"']([^\"'#]+)[\"']"), F.lit(1))
    return F.filter(found, lambda x: ~F.lower(x).rlike("^(mailto|javascript|tel):"))


def without_fragment(url: Column) -> Column:
    return F.trim(F.regexp_replace(url, "#.*$", ""))


def host(url: Column) -> Column:
    """Lower-case host of an http or https URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    h = host(url)
    return F.coalesce(reduce(lambda a, b: a | b, [(h == d) | h.endswith("." + d) for d in domains], F.lit(False)), F.lit(False))


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page: absolute ones stay, those from the root get scheme and host, others the page's folder."""
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def license_name(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(low.isin("", "none", "null", "unknown"), "unknown").otherwise(low)


def word_count(text: Column) -> Column:
    """Words between white space, at least one."""
    c = compact(text)
    return F.greatest(F.lit(1), F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))).cast("long")


def quarter_count(text: Column) -> Column:
    """A token for each four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def policy_tokens(text: Column) -> Column:
    """Hexadecimal numbers, names, numbers, and single other characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"0x[0-9a-fA-F]+|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]"), F.lit(0))).cast("long")


# Shapes of secrets.
SECRET = r"(?i)(-----BEGIN [A-Z ]*PRIVATE KEY-----|AKIA[0-9A-Z]{16}|(api[_-]?key|token|secret|password)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{16,}[\"'])"


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "[REDACTED]")


def failure_signature(error: Column) -> Column:
    """An error text without what changes from run to run; equal failures have equal signatures."""
    x = redacted(F.substring(error, 1, 32768))
    for pattern, name in (
        (r"([A-Za-z]:\\|/)[^\s:\"']+", "<path>"),
        (r"0x[0-9a-fA-F]+", "<address>"),
        (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
        (r"(?i)(line|column|col|pid)[ :=]+[0-9]+", "<location>"),
        (r"[0-9]{2,}", "<number>"),
    ):
        x = F.regexp_replace(x, pattern, name)
    return F.substring(F.lower(compact(x)), 1, 2000)


def count_terms(lowered: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur."""
    return sum((F.when(F.contains(lowered, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))


def any_term(lowered: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(t)) for t in terms])


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
