"""Column functions over text: cleaning, script tests, marker handling, list parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Line ends recognised when a text is cut into lines.
LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
# Code point blocks as (first, last).
HANGUL = ((0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x3130, 0x318F))
KHMER = ((0x1780, 0x17FF),)
# Marks that close a sentence.
SENTENCE_END = ".!?\u2026\u17d4\u17d5"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` under a name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def char_class(blocks) -> str:
    """Regex class text for code point blocks."""
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in blocks)


def script_ratio(c: Column, blocks=HANGUL) -> Column:
    """Share of the non-space characters that lie in the blocks; 0 for blank text."""
    total = F.length(F.regexp_replace(c, "(?U)[\\s\\x1c-\\x1f]+", ""))
    inside = F.length(c) - F.length(F.regexp_replace(c, f"[{char_class(blocks)}]+", ""))
    return F.when(total > 0, inside / total).otherwise(F.lit(0.0))


def has_script(c: Column, blocks=KHMER) -> Column:
    return F.coalesce(c.rlike(f"[{char_class(blocks)}]"), F.lit(False))


def ends_sentence(c: Column) -> Column:
    last = F.right(strip(c), F.lit(1))
    return F.coalesce(last.isin(*SENTENCE_END), F.lit(False))


def flag_names(c: Column) -> Column:
    """True where a ``**name**`` marker is present: such a line is set bold and italic."""
    return c.rlike("\\*\\*[^*]+\\*\\*")


def strip_names(c: Column) -> Column:
    return F.regexp_replace(c, "\\*\\*([^*]+)\\*\\*", "$1")


def js_escape(c: Column) -> Column:
    """Escape backslash, double quote and newline for a script string literal."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit('"'), F.lit('\\"'))
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def split_lines(c: Column) -> Column:
    return F.split(c, LINE_END)


# Fixed value: one line of a numbered reply: number, separator, optional tag, text.
NUMBERED = "^\\s*(\\d+)\\s*[.)\\-]\\s*(?:\\[[^\\]]*\\]\\s*)?(.*\\S)?\\s*$"
# Fixed value: the list of post groups inside a reply.
POSTS = "POSTS?\\s*:\\s*([0-9\\-\\s|,]+)"
_KHMER_DIGITS = "".join(chr(0x17E0 + d) for d in range(10))


def ascii_number(digits: Column) -> Column:
    """A run of ASCII or Khmer digits as ``plain_number``; '' for a run with other digits."""
    text = plain_number(F.translate(digits, _KHMER_DIGITS, "0123456789"))
    return F.when(text.rlike("^[0-9]+$"), text).otherwise("")


def plain_number(digits: Column) -> Column:
    """A run of digits without leading zeros, as text: it has no largest value."""
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def numbered_lines(c: Column) -> Column:
    """array<struct<pos, n, text>> of the usable lines of one reply, in order; ``n`` is a number written as ``plain_number``."""
    parsed = F.transform(
        split_lines(c),
        lambda line, pos: F.struct(
            pos.alias("pos"),
            ascii_number(F.regexp_extract(line, "(?U)" + NUMBERED, 1)).alias("n"),
            strip(F.regexp_extract(line, "(?U)" + NUMBERED, 2)).alias("text"),
        ),
    )
    return F.filter(parsed, lambda r: (r.n != "") & (r.text != ""))


def parse_posts(c: Column) -> Column:
    """array<struct<lo, hi>> of the first post list in a reply, as ``plain_number``; other parts are ignored."""
    body = F.regexp_extract(c, "(?iU)" + POSTS, 1)
    pairs = F.transform(
        F.split(body, "[|,]"),
        lambda part: let(
            F.struct(
                F.regexp_extract(part, "(?U)^\\s*(\\d+)\\s*-\\s*(\\d+)", 1).alias("lo"),
                F.regexp_extract(part, "(?U)^\\s*(\\d+)\\s*-\\s*(\\d+)", 2).alias("hi"),
                F.regexp_extract(part, "(?U)^\\s*(\\d+)\\s*$", 1).alias("one"),
            ),
            lambda m: F.when(m.lo != "", F.struct(plain_number(m.lo).alias("lo"), plain_number(m.hi).alias("hi")))
            .when(m.one != "", F.struct(plain_number(m.one).alias("lo"), plain_number(m.one).alias("hi"))),
        ),
    )
    return F.filter(pairs, lambda p: p.isNotNull())


def natural_key(c: Column) -> Column:
    """Orderable key: digit runs compare as numbers, text as lower case, text first.

    The sentinel in front makes every key start with text, so that names which start
    with a digit sort before names which start with a letter.
    """
    tokens = F.regexp_extract_all(F.concat(F.lit("\x01"), F.lower(c)), F.lit("\\d+|\\D+"), 0)
    return F.transform(
        tokens,
        lambda t: F.struct(
            t.rlike("^\\d").alias("is_num"),
            # longer numbers are larger, equally long ones compare digit by digit
            F.when(t.rlike("^\\d"), F.struct(F.length(plain_number(t)).alias("size"), plain_number(t).alias("digits"))).alias("num"),
            F.when(~t.rlike("^\\d"), t).alias("txt"),
        ),
    )
