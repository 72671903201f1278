"""Fill-in-the-middle transformation by escaped marker injection, in column expressions alone.

A delimiter that stands for nothing in the text is made by escaping: the escape character becomes two characters, and so
does the delimiter. ``regexp_replace`` then appends the bare delimiter after each unit (a code point, or an escaped pair
that stands for one), so the units are counted by counting delimiters, ``substring_index`` takes out any run of them by
their numbers, and removing delimiters and escapes gives the parts back. A hash of the row's id says where a text is cut
and in which order its parts are put together, so the same row always comes out the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare

#: The markers before prefix, suffix and middle, and the shares of plain and of suffix-first texts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: The delimiter, the escape character, and what each is written as in an escaped text.
CUT, ESCAPE = "\x01", "\x02"
ESCAPED_CUT, ESCAPED_ESCAPE = "\x02d", "\x02e"
#: In an escaped text: an escape character with what follows it, or another code point.
UNIT = "(?s)\x02?."


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(CUT), F.lit(ESCAPED_CUT))


def marked(text: Column) -> Column:
    """An escaped text with a delimiter after each unit."""
    return F.regexp_replace(text, UNIT, f"$0{CUT}")


def plain(part: Column) -> Column:
    """The code points of a part of a marked text."""
    bare = F.replace(part, F.lit(CUT), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPED_CUT), F.lit(CUT)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def units(marked_text: Column, escaped_text: Column) -> Column:
    """How many delimiters were appended; an escaped text has none."""
    return (F.octet_length(marked_text) - F.octet_length(escaped_text)).cast("long")


def first_units(text: Column, n: Column) -> Column:
    """The first n units of a marked text, without the last delimiter."""
    return F.call_function("substring_index", text, F.lit(CUT), n.cast("int"))


def last_units(text: Column, n: Column) -> Column:
    """What follows the n-th delimiter from the end."""
    return F.call_function("substring_index", text, F.lit(CUT), (-n).cast("int"))


def after(text: Column, marker: str) -> Column:
    """What follows the first occurrence of a marker."""
    return F.substring(text, F.locate(marker, text) + len(marker), F.length(text))


def before(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, 1)


def draws(id_: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 of each id: the first digits of a SHA-256 of seed and id. A null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """id, ``n`` (code points), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output`` of each row.

    Texts that are empty (null ones too) or hold a marker stay plain, and so does a share of the others; of plain texts the
    two counts are null. Cuts may fall together, so any part may be empty. Texts of any length are cut whole; delimiter
    and escape character are ordinary characters of a text. Rows with equal ids and texts come out equal, and each of
    them comes back; ids that are null draw as an empty id. An empty table gives an empty result. Extra columns play no
    part, whatever their names. A text can have at most 2**31 - 1 bytes when marked, as any string of Spark's.
    """
    prepare(docs.sparkSession)
    h = draws(F.col("id"), seed)
    text, n = F.col("text"), F.col("n")
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("escaped", escaped(text))
    rows = rows.withColumn("marked", marked(F.col("escaped"))).withColumn("n", units(F.col("marked"), F.col("escaped")))
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    whole = (n == 0) | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= PLAIN_FROM)
    form = F.when(whole, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = rows.select("id", "text", "marked", "n", form.alias("form"), F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    # A marked text ends in a delimiter, and what precedes the second cut doesn't.
    upto = first_units(F.col("marked"), F.col("high"))
    parts = {
        "prefix": first_units(F.col("marked"), F.col("low")),
        "middle": last_units(upto, F.col("high") - F.col("low")),
        "suffix": last_units(F.col("marked"), n - F.col("high") + 1),
    }
    cut = F.col("form") != "plain"
    rows = rows.select("id", "text", "n", "form", "low", "high", *[F.when(cut, plain(p)).alias(name) for name, p in parts.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(~cut, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select(F.col("id").alias(id_col), "n", "form", F.when(cut, F.col("low")).alias("prefix_chars"), F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Markers have no common beginnings and ends, so the first of each is the one put in."""
    middle = after(output, MIDDLE)
    psm = F.concat(before(after(output, PREFIX), SUFFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, before(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
