"""Column functions on text: trimming, normalising, markup, excerpts, keys. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ANCHOR = r"\b((?:NTT|SCT|SCC|GCT|GCC|FT|AA|SL|PRE)\s?\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)"
PAGE_MARKER = r"---\s*P(\d+)\s*---"
CUT = "\n...[已截断]"


def nvl(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column) -> Column:
    """Whether trim() leaves nothing; reads as far as the first character that stays."""
    return ~nvl(c).rlike(r"[^\x00-\x20]")


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[F.when(~is_blank(c), c) for c in cols])


def normalize(c: Column) -> Column:
    """One kind of line end, one blank for blanks and tabs, at most one empty line in a row, no blanks around."""
    lines = F.replace(F.replace(nvl(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    spaced = F.regexp_replace(F.replace(lines, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return trim(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def strip_html(c: Column) -> Column:
    # What is replaced, in this order.
    out = nvl(c)
    for pattern, by in (
        (r"(?is)<(script|style)[^>]*>.*?</\1>", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(p|div|tr|li|h[1-6])>", "\n"),
        (r"<[^>]+>", " "),
        ("&nbsp;", " "),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        (r"[ \t]+", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    return out


def join_pages(pages: Column) -> Column:
    """pages: array of (page_no, text). Blank pages are left out, a marker stands before each of the others."""
    kept = F.filter(F.array_sort(pages), lambda p: ~is_blank(p["text"]))
    return normalize(F.array_join(F.transform(kept, lambda p: F.concat(F.lit("--- P"), p["page_no"], F.lit(" ---\n"), p["text"], F.lit("\n\n"))), ""))


def anchor(c: Column) -> Column:
    """The first clause reference, or null."""
    return F.nullif(F.regexp_extract(c, ANCHOR, 1), F.lit(""))


def excerpt(c: Column, index: Column, before: int = 200, after: int = 520) -> Column:
    """What stands around a place (from 0), trimmed, with dots where it is cut."""
    start, end = F.greatest(F.lit(0), index - before), F.least(F.length(c), index + after)
    return F.concat(F.when(start > 0, "...").otherwise(""), trim(F.substring(c, start + 1, end - start)), F.when(end < F.length(c), "...").otherwise(""))


def truncate(c: Column, n: int, suffix: str | None = None) -> Column:
    """The first n characters; with a suffix behind a cut, null counts as empty."""
    c = nvl(c) if suffix else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix or ""))).otherwise(c)


def compact(c: Column, n: int) -> Column:
    """On one line, n characters at most and dots where it is cut."""
    one = trim(F.regexp_replace(nvl(c), r"\s+", " "))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n), F.lit("..."))).otherwise(one)


def dedupe_key(types: Column, refs: Column, location: Column, title: Column, quote: Column) -> Column:
    joined = F.concat_ws("|", nvl(types), nvl(refs), nvl(location), nvl(title), F.substring(nvl(quote), 1, 120))
    return F.regexp_replace(F.lower(joined), r"\s+", "")


def sanitize_key(c: Column) -> Column:
    return F.substring(F.regexp_replace(trim(c), r"[^A-Za-z0-9_\-]", ""), 1, 64)


def stored_path(root: str, project: Column, category: Column, name: Column, content: Column) -> Column:
    """Where a file is kept: eight hex digits, here of its content so that a task that runs twice writes one file, then its
    name without what a path can't hold."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), project, category, F.concat(F.substring(F.md5(content), 1, 8), F.lit("_"), safe_file_name(F.coalesce(name, F.lit("unnamed")))))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/:*?"<>|]', "_")


def tokens(c: Column, least: int) -> Column:
    """The parts of a reference list that have `least` characters."""
    return F.filter(F.transform(F.split(nvl(c), r"[·→↔|,;\s]+"), trim), lambda t: F.length(t) >= least)


def needles(pattern: Column, location: Column, refs: Column, expected: Column) -> Column:
    """What to search a document for: whole fields, then parts of the lists; distinct, eight at most."""
    whole = lambda c, n: F.when(F.length(trim(nvl(c))) >= n, F.array(trim(c))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(whole(pattern, 8), whole(location, 3), tokens(refs, 4), tokens(expected, 4))), 1, 8)


def needles_of(*raws: Column, least: int = 5) -> Column:
    """For each field the whole, then its parts; distinct, eight at most."""
    empty = F.array().cast("array<string>")
    one = lambda c: F.when(is_blank(c), empty).otherwise(F.concat(F.filter(F.array(trim(nvl(c))), lambda t: F.length(t) >= least), tokens(c, least)))
    return F.slice(F.array_distinct(F.concat(*map(one, raws))), 1, 8)


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), where c is computed once for a row, however often it stands there."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def loose_at(text: Column, pin: Column) -> Column:
    """Where (from 0) a text that isn't blank has a trimmed needle, whatever case and white space: the first place, if it is not past
    length(text) - length(pin); else -1."""
    quoted = F.array_join(F.transform(F.filter(F.split(pin, ""), lambda ch: ~ch.rlike(r"\p{javaWhitespace}") & (ch != "")), lambda ch: F.concat(F.lit(r"\p{javaWhitespace}*"), F.regexp_replace(ch, r"([^\p{L}\p{N}])", r"\\$1"))), "")
    # the place of the first match is what stands before it
    found = F.regexp_instr(text, F.concat(F.lit("(?iu)"), quoted))
    return _once(found, lambda at: F.when((at > 0) & (at - 1 <= F.length(text) - F.length(pin)), at - 1).otherwise(-1))


def find_loose(text: Column, needle: Column, low: Column | None = None) -> Column:
    """Where (from 0) the needle starts, whatever case and white space; -1 if nowhere. low: the text in lower case, if that is at hand.

    An exact match but for case wins; else the first start that is not past length(text) - length(needle).
    """
    pin = trim(nvl(needle))
    direct = F.position(F.lower(pin), F.lower(nvl(text)) if low is None else low)
    return F.when(is_blank(text) | is_blank(needle), -1).otherwise(_once(direct, lambda at: F.when(at > 0, at - 1).otherwise(loose_at(nvl(text), pin))))


def page_marks(text: Column) -> Column:
    """Where (from 0) a text has markers, and their pages, in order. One fold over the markers and what stands between them."""
    mark = lambda group: F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(group))
    parts = F.arrays_zip(F.split(text, r"---\s*P\d+\s*---").alias("piece"), mark(0).alias("mark"), mark(1).alias("page"))

    def step(so_far: Column, part: Column) -> Column:
        start = so_far["at"] + F.length(part["piece"])
        more = F.array_append(so_far["marks"], F.struct(start.alias("start"), part["page"].alias("page")))
        return F.when(part["mark"].isNull(), so_far).otherwise(F.struct((start + F.length(part["mark"])).alias("at"), more.alias("marks")))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,page:string>>").alias("marks")), step)["marks"]


def page_in(marks: Column, index: Column) -> Column:
    """The page of the last of page_marks() that starts at or before a place (from 0): 'P' and its number, or null."""
    # (a place that stood in the filter would be looked for once for each marker)
    return _once(index, lambda at: F.concat(F.lit("P"), F.try_element_at(F.filter(marks, lambda m: m["start"] <= at), F.lit(-1))["page"]))


def page_at(text: Column, index: Column) -> Column:
    """page_in() of a text's markers."""
    return page_in(page_marks(text), index)
