"""Text expressions shared by the operators.

Character classes are spelled out because Java's `\\d`, `\\w` and `\\s` are ASCII-only, while
the artifacts are Unicode text and a digit, word character or blank may be any script's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode blanks, as the characters themselves and as a regex class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

SPACE = f"[{SPACE_SET}]"
INLINE_SPACE = f"[{SPACE_SET}&&[^\\n]]"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
WORD_START = f"(?<!{WORD})"
WORD_END = f"(?!{WORD})"

# How a text falls into lines: like a file handle, like a captured output, or on \n alone.
LINE_BREAKS = {
    "universal": r"\r\n|\r|\n",
    "captured": r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]",
    "newline": r"\n",
}

# What a log timestamp looks like.
TIMESTAMP = (
    r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?|\d{2}:\d{2}:\d{2}(?:\.\d+)?"
).replace(r"\d", DIGIT)

# Fixed value: the note left where a text was cut.
CUT_NOTE = "\n...[troncato, {} caratteri omessi]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Without blanks (of any script) at both ends."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def text_lines(text: Column, mode: str = "universal") -> Column:
    """The lines of a text as an array; a final line break opens no further line."""
    return bind(F.split(text, LINE_BREAKS[mode]), _without_open_end)


def _without_open_end(pieces: Column) -> Column:
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def mask_numbers(line: Column) -> Column:
    return F.regexp_replace(line, f"{DIGIT}+", "#")


def mask_line(line: Column) -> Column:
    """Timestamps and digit runs as `#`; a timestamp is one mark, not one per field."""
    return F.regexp_replace(line, f"{TIMESTAMP}|{DIGIT}+", "#")


def first_timestamp(line: Column) -> Column:
    """The first timestamp in the line as text, NULL when there is none."""
    return F.nullif(F.regexp_extract(line, TIMESTAMP, 0), F.lit(""))


def entropy(text: Column) -> Column:
    """Bits per character of a text by the frequencies of its characters; 0 for an empty one."""
    def bits(value: Column) -> Column:
        share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
        shares = F.transform(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), share)
        return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))

    return bind(text, bits)


def cap_text(text: Column, limit: int) -> Column:
    """The first `limit` characters, and a note with the number left out."""
    before, after = CUT_NOTE.split("{}")
    size = F.length(text)
    note = F.concat(F.lit(before), (size - limit).cast("string"), F.lit(after))
    return F.when(size > limit, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


def html_to_text(html: Column, content_type: Column | None = None) -> Column:
    """Markup, scripts and styles out; the remaining lines stripped, empty ones dropped.

    Entities stay as they are. Text of another content type passes through.
    """
    # What follows the last ">" holds no markup; left in, every "<" there would scan to the end.
    tail = F.substring_index(html, ">", -1)
    head = F.left(html, F.length(html) - F.length(tail))
    bare = F.concat(F.regexp_replace(head, r"(?isu)<script.*?</script>|<style.*?</style>|<[^>]+>", " "), tail)
    stripped = F.transform(F.split(bare, LINE_BREAKS["captured"]), strip)
    text = F.array_join(F.filter(stripped, lambda line: line != ""), "\n")
    if content_type is None:
        return text
    return F.when(F.contains(content_type, F.lit("html")), text).otherwise(html)


def utf8_text(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 become U+FFFD instead of failing the job."""
    return F.make_valid_utf8(content.cast("string"))


def utf8_text_lenient(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 are dropped."""
    return make_clean(utf8_text(content))


def make_clean(text: Column) -> Column:
    """Text without the marks that stand for undecodable bytes."""
    return F.replace(text, F.lit("\ufffd"), F.lit(""))


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\ufeff", "")


def extract_pairs(text: Column, pattern: str, first: str, second: str) -> Column:
    """Every match of a two-group pattern as an array of structs."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hit: F.struct(
            F.regexp_extract(hit, pattern, 1).alias(first), F.regexp_extract(hit, pattern, 2).alias(second)
        ),
    )


def is_json_object(text: Column) -> Column:
    """Whether the whole text is one JSON object, with nothing behind it."""
    wrapped = F.from_json(F.concat(F.lit("["), without_bom(text), F.lit("]")), "array<map<string,string>>")
    return F.coalesce((F.size(wrapped) == 1) & F.get(wrapped, F.lit(0)).isNotNull(), F.lit(False))
