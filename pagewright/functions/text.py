"""Text expressions: trimming, lines, markers, cells, joins, numbers. Lengths are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK letters, kana, Hangul, CJK punctuation and full-width forms.
CJK = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\u3040-\\u30FF\\uAC00-\\uD7AF\\u3000-\\u303F\\uFF00-\\uFF60"
#: Characters without width.
ZERO_WIDTH = "\\uFEFF\\u200B\\u200C\\u200D\\u2060"
FENCE = "^(```|~~~)"
#: What opens a block (headings, quotes, tables, fences, bullets, numbered and lettered items).
BLOCK = (
    r"^(?:[#>|]|```|~~~|[-*+•·○■▪●◦]|[\u2460-\u246E\u2474-\u247D]"
    r"|[0-9]+\.(?U:\s)|[0-9]+[、)）:：]|[(（][0-9]+[)）]"
    r"|第.{0,4}?[章条节款项部]"
    rf"|(?!第)[{CJK}][、.．）]|[A-Za-z]\.(?U:\s))"
)
#: What ends a sentence.
SENTENCE_END = "[.。！？…；;!?」』]$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; within a lambda an expression is computed each time it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utrim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def lines(c: Column) -> Column:
    """Array of lines: one trailing carriage return goes, and so does a last empty segment."""
    parts = F.split(c, "\n", -1)
    parts = F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.when(x.contains("\r"), F.regexp_replace(x, r"\r$", "")).otherwise(x))


def page_marker(page: Column) -> Column:
    return F.format_string("<!-- Page %d -->", page)


def page_from_line(c: Column) -> Column:
    """Page number of a marker line (either wording, one space before the end), else null."""
    t = utrim(c)
    inner = F.coalesce(F.nullif(F.regexp_extract(t, r"^<!-- Page (.*) -->$", 1), F.lit("")), F.regexp_extract(t, r"^<!-- 第 (.*) 页 -->$", 1))
    number = F.regexp_extract(utrim(inner), r"^\+?([0-9]{1,18})$", 1)
    value = F.when(number != "", number.cast("long"))
    return F.when(value <= 4294967295, value)


def preview_page(c: Column) -> Column:
    """The looser marker of previews: ``Page N``, ``Image N`` or the other wording, any spacing."""
    n = F.regexp_extract(c, r"^\s*<!--\s*(?:Page|Image|第)\s*([0-9]{1,9})\s*页?\s*-->\s*$", 1)
    return F.when(n != "", n.cast("long"))


def is_delimiter(c: Column) -> Column:
    """A table's delimiter row: pipes at both ends, only ``- : |`` and spaces within, one dash at least."""
    return utrim(c).rlike(r"^\|[-:| ]*-[-:| ]*\|$")


def split_cells(c: Column) -> Column:
    """Cells of a table row, escaped pipes restored."""
    inner = F.regexp_replace(utrim(c), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda x: utrim(F.replace(x, F.lit("\\|"), F.lit("|"))))


def fence_kind(c: Column) -> Column:
    """The fence's three characters, else the empty string."""
    return F.regexp_extract(utrim(c), FENCE, 1)


def is_fence(c: Column) -> Column:
    return utrim(c).rlike(FENCE)


def starts_block(c: Column) -> Column:
    return utrim(c).rlike(BLOCK)


def ends_sentence(c: Column) -> Column:
    return rtrim(c).rlike(SENTENCE_END)


def dehyphenates(prev: Column, cur: Column) -> Column:
    return rtrim(prev).rlike("[A-Za-z]-$") & ltrim(cur).rlike("^[a-z]")


def is_cjk(c: Column) -> Column:
    return c.rlike(f"^[{CJK}]$")


def connector(prev: Column, cur: Column) -> Column:
    """Nothing between two CJK characters, else one space."""
    return F.when(F.right(prev, F.lit(1)).rlike(f"[{CJK}]") & F.left(cur, F.lit(1)).rlike(f"[{CJK}]"), "").otherwise(" ")


def join_pieces(prev: Column, cur: Column) -> Column:
    """Two pieces as one: a hyphen at the break goes, otherwise the connector stands between."""
    a, b = rtrim(prev), ltrim(cur)
    joined = F.when(dehyphenates(prev, cur), F.concat(F.regexp_replace(a, "-$", ""), b)).otherwise(F.concat(a, connector(a, b), b))
    return F.when(blank(prev), cur).when(blank(cur), prev).otherwise(joined)


def join_fragments(parts: Column) -> Column:
    """An array of fragments as one text; blank ones are passed over."""
    kept = F.filter(F.transform(parts, utrim), lambda x: x != "")
    return F.aggregate(kept, F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(join_pieces(acc, x)))


def clean_ocr(c: Column) -> Column:
    """Per line: no zero-width characters, white space as one space, and a space between CJK and ASCII letters or digits."""
    # On the whole text at once: newlines are what white space runs stop at.
    c = F.regexp_replace(c, r"\r(?=\n|\z)|\n\z", "")
    c = F.regexp_replace(c, f"[{ZERO_WIDTH}]", "")
    c = F.regexp_replace(c, r"(?U)[^\S\n]+", " ")
    return F.regexp_replace(c, f"(?<=[{CJK}])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[{CJK}])", " ")


def strip_links(c: Column) -> Column:
    return F.regexp_replace(c, r"\[([^\]]*)\]\(([^)]*)\)", "$1")


def strip_inline(c: Column) -> Column:
    """Without inline markup; line break tags become newlines."""
    c = strip_links(F.regexp_replace(c, "<br ?/?>", "\n"))
    return F.regexp_replace(c, r"\*\*|__|`|\*", "")


def sniff_number(c: Column) -> Column:
    """struct(kind, value): ``num`` or ``percent``; null where the text is not a plain number."""
    t = utrim(c)
    body = F.regexp_replace(t, "%$", "")
    fine = body.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$") & ~body.rlike(r"^0[0-9]")
    value = body.cast("double")
    percent = t.endswith("%")
    return F.when(fine, F.struct(F.when(percent, "percent").otherwise("num").alias("kind"), F.when(percent, value / 100).otherwise(value).alias("value")))


def column_gaps(c: Column) -> Column:
    """Parts between runs of two or more white space characters; null if there is one part only."""
    parts = F.filter(F.transform(F.split(c, r"(?U)\s{2,}", -1), utrim), lambda x: x != "")
    return F.when(F.size(parts) >= 2, parts)


def strip_fence(c: Column) -> Column:
    """Without one fence around the whole text."""
    t = utrim(c)
    own = lines(t)
    inner = F.array_join(F.slice(own, 2, F.greatest(F.size(own) - 2, F.lit(0))), "\n")
    wrapped = (F.size(own) > 2) & is_fence(F.element_at(own, 1)) & is_fence(F.try_element_at(own, F.lit(-1))) & ~blank(inner)
    return F.when(wrapped, inner).otherwise(t)


def escape_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def month(c: Column) -> Column:
    return F.substring(c, 1, 7)


def duration(ms: Column) -> Column:
    """``850ms``, ``1.5s``, ``2min 5s``, ``1h 2min``; nothing or less is ``0ms``."""
    ms = F.round(ms).cast("long")
    minutes, seconds = F.floor(ms / 60000), F.round((ms % 60000) / 1000).cast("long")
    short = F.regexp_replace(F.format_string("%.2f", ms / 1000), r"\.?0+$", "")
    return (
        F.when(ms.isNull() | (ms <= 0), "0ms")
        .when(ms < 1000, F.format_string("%dms", ms))
        .when(ms < 60000, F.concat(short, F.lit("s")))
        .when(minutes < 60, F.format_string("%dmin %ds", minutes, seconds))
        .otherwise(F.format_string("%dh %dmin", F.floor(minutes / 60), minutes % 60))
    )


def confidence_class(c: Column) -> Column:
    return F.when(c < 0.5, "error").when(c < 0.7, "warn").when(c.isNotNull(), "ok")


def engine_of(mode: Column) -> Column:
    """Recognition mode to engine: local, ai or null (off)."""
    return F.when(mode.startswith("local"), "local").when(mode.startswith("ai"), "ai")


def paragraph_mode(c: Column) -> Column:
    t = F.lower(utrim(c))
    return F.when(t.isin("smart", "unwrap", "paragraph"), "smart").when(t.isin("none", "single", "nolinebreak"), "none").otherwise("guided")


def layout_mode(c: Column) -> Column:
    return F.when(F.lower(utrim(c)).isin("paddle", "model", "mnn"), "paddle").otherwise("off")


def describe_positions(label: str, percents: Column) -> Column:
    """``\\nlabel: 25.0%, 50.0%``; the empty string for no positions."""
    own = F.array_join(F.transform(percents, lambda x: F.format_string("%.1f%%", x)), ", ")
    return F.when(F.size(percents) > 0, F.concat(F.lit(f"\n{label}: "), own)).otherwise("")


def mime(ext: Column) -> Column:
    """MIME type of an image by extension, in any case, with or without the dot; null for others."""
    e = F.lower(F.regexp_replace(ext, r"^\.", ""))
    return F.when(e == "png", "image/png").when(e.isin("jpg", "jpeg"), "image/jpeg")


def completions_url(base: Column, strict_reference: bool = False) -> Column:
    """The chat endpoint of a provider's base address; ``strict_reference`` leaves a base that ends in /v1 as it is."""
    b = F.regexp_replace(utrim(base), "/+$", "")
    plain = F.concat(b, F.lit("/v1/chat/completions"))
    versioned = b if strict_reference else F.concat(b, F.lit("/chat/completions"))
    return F.when(b.endswith("/chat/completions"), b).when(b.endswith("/v1"), versioned).otherwise(plain)


def display_name(c: Column, most: int = 28) -> Column:
    """A name with its middle left out if it is longer than ``most`` characters."""
    head = (most - 1 + 1) // 2
    tail = most - 1 - head
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.substr(c, F.length(c) - tail + 1, F.lit(tail))))


def is_inside(path: Column, folder: Column) -> Column:
    """Whether a path lies in a folder (whole path parts, either kind of slash)."""
    norm = lambda p: F.concat(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"))
    return F.startswith(norm(path), norm(folder))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def snippet(c: Column, most: int = 300) -> Column:
    return F.substring(c, 1, most)
