"""String functions as Column builders; NULL in, NULL out, characters not bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _n(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def length(s) -> Column:
    return F.length(_c(s))


char_length = length


def octet_length(s) -> Column:
    return F.octet_length(_c(s))


def bit_length(s) -> Column:
    return F.bit_length(_c(s))


def upper(s) -> Column:
    return F.upper(_c(s))


def lower(s) -> Column:
    return F.lower(_c(s))


def concat(*parts) -> Column:
    """NULL if any part is NULL."""
    return F.concat(*map(_c, parts))


def trim(s) -> Column:
    """Both ends, all white space."""
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def ltrim(s) -> Column:
    return F.regexp_replace(_c(s), r"^\s+", "")


def rtrim(s) -> Column:
    return F.regexp_replace(_c(s), r"\s+$", "")


def substring(s, start, size=None) -> Column:
    """From a 1-based character; 0 acts as 1, a negative start is an error."""
    start = _n(start)
    begin = F.when(start < 0, F.raise_error(F.lit("substring: negative start")).cast("int")).otherwise(F.greatest(start, F.lit(1)))
    return F.substr(_c(s), begin, _n(size)) if size is not None else F.substr(_c(s), begin)


def left(s, n) -> Column:
    return F.left(_c(s), F.greatest(_n(n), F.lit(0)))


def right(s, n) -> Column:
    return F.right(_c(s), F.greatest(_n(n), F.lit(0)))


def reverse(s) -> Column:
    return F.reverse(_c(s))


def repeat(s, n) -> Column:
    """A negative count is an error."""
    n = _n(n)
    return F.repeat(_c(s), F.when(n < 0, F.raise_error(F.lit("repeat: negative count")).cast("int")).otherwise(n))


def replace(s, old, new) -> Column:
    return F.replace(_c(s), _n(old), _n(new))


def position(needle, s) -> Column:
    """1-based character at which ``needle`` starts; 0 if absent."""
    return F.instr(_c(s), _n(needle))


def strpos(s, needle) -> Column:
    return position(needle, s)


instr = strpos


def contains(s, needle) -> Column:
    return F.contains(_c(s), _n(needle))


def starts_with(s, prefix) -> Column:
    return F.startswith(_c(s), _n(prefix))


def ends_with(s, suffix) -> Column:
    return F.endswith(_c(s), _n(suffix))


def _padded(s, size, fill, pad) -> Column:
    if isinstance(fill, str) and not fill:
        raise ValueError("the fill is empty")
    return pad(_c(s), _n(size), _n(fill))


def lpad(s, size, fill=" ") -> Column:
    """Pads on the left, or cuts what is longer."""
    return _padded(s, size, fill, F.lpad)


def rpad(s, size, fill=" ") -> Column:
    return _padded(s, size, fill, F.rpad)


def split_part(s, delimiter, index) -> Column:
    """The index-th part from 1; '' beyond the last; an index under 1 is an error."""
    index = _n(index)
    return F.split_part(_c(s), _n(delimiter), F.when(index < 1, F.raise_error(F.lit("split_part: index under 1")).cast("int")).otherwise(index))


def ascii(s) -> Column:
    """Code point of the first character; 0 for ''."""
    return F.ascii(_c(s))


def chr(n) -> Column:
    """The character of a code 0 to 127; others are an error."""
    n = _c(n)
    return F.when((n < 0) | (n > 127), F.raise_error(F.lit("chr: code outside 0..127"))).otherwise(F.chr(n))


def initcap(s) -> Column:
    return F.initcap(_c(s))


def regexp_matches(s, pattern: str) -> Column:
    """Whether some part of ``s`` matches."""
    return _c(s).rlike(pattern)


def regexp_replace(s, pattern: str, replacement: str) -> Column:
    """Replaces all matches."""
    return F.regexp_replace(_c(s), pattern, replacement)


def regexp_extract(s, pattern: str, group: int = 0) -> Column:
    """A group of the first match; NULL without a match."""
    return F.when(_c(s).rlike(pattern), F.regexp_extract(_c(s), pattern, group))


def regexp_split_to_array(s, pattern: str) -> Column:
    return F.split(_c(s), pattern)


def md5(s) -> Column:
    return F.md5(_c(s))


def sha256(s) -> Column:
    return F.sha2(_c(s), 256)


def base64_encode(s) -> Column:
    return F.regexp_replace(F.base64(_c(s)), r"\s", "")


def base64_decode(s) -> Column:
    return F.unbase64(_c(s)).cast("string")


def url_encode(s) -> Column:
    """Percent-encoding; a space is %20 and ``~`` stays."""
    once = F.url_encode(_c(s))
    return F.replace(F.replace(F.replace(once, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode(s) -> Column:
    return F.url_decode(_c(s))


def levenshtein(a, b) -> Column:
    return F.levenshtein(_c(a), _c(b))


def overlay(s, replacement, start, size=None) -> Column:
    """Replaces characters from ``start``; unchanged where ``start`` is past the end."""
    s, replacement, start = _c(s), _n(replacement), _n(start)
    size = F.length(replacement) if size is None else _n(size)
    return F.when(start > F.length(s), s).otherwise(F.overlay(s, replacement, start, size))


def quote(s) -> Column:
    """A SQL literal; 'NULL' for NULL."""
    doubled = F.concat(F.lit("'"), F.replace(_c(s), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(doubled, F.lit("NULL"))


def string_split(s, delimiter: str) -> Column:
    """Parts between literal delimiters; characters for ''."""
    return F.split(_c(s), "\\Q" + delimiter + "\\E" if delimiter else "")


def soundex(s) -> Column:
    return F.soundex(_c(s))


def format(template: str, *args) -> Column:
    """Replaces each ``{}`` by the next argument; more than there are stay."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for i, part in enumerate(parts[1:]):
        out.append(_c(args[i]).cast("string") if i < len(args) else F.lit("{}"))
        out.append(F.lit(part))
    return F.concat(*out)


printf = format


def like_escape(s, pattern: str, escape: str = "\\") -> Column:
    """LIKE with an escape character."""
    return F.like(_c(s), F.lit(pattern), F.lit(escape))


def ilike(s, pattern: str) -> Column:
    return _c(s).ilike(pattern)


def similar_to(s, pattern: str) -> Column:
    """SQL regular expression on the whole string: % any run, _ any character."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        out.append(".*" if ch == "%" else "." if ch == "_" else "\\" + ch if ch in ".^$\\" else ch)
        i += 1
    return _c(s).rlike("(?s)^(?:" + "".join(out) + ")$")


def translate(s, old: str, new: str) -> Column:
    """Maps characters one by one; those without a partner are kept."""
    return F.translate(_c(s), old, new[: len(old)] + old[len(new) :])


def hamming(a, b) -> Column:
    """Positions that differ; unequal lengths are an error."""
    a, b = _c(a), _c(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("long"))
    count = F.when(F.length(a) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("hamming: lengths differ")).cast("long")).otherwise(count)


def concat_ws(sep: str, *parts) -> Column:
    return F.concat_ws(sep, *map(_c, parts))


def regexp_full_match(s, pattern: str) -> Column:
    return _c(s).rlike(f"^(?:{pattern})$")


def regexp_extract_all(s, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(s), F.lit(pattern), F.lit(group))


def regexp_escape(s) -> Column:
    return F.regexp_replace(_c(s), r"([^A-Za-z0-9_])", r"\\$1")


def sha1(s) -> Column:
    return F.sha1(_c(s))


def md5_number(s) -> Column:
    """The digest's upper 64 bits as a decimal."""
    return F.conv(F.substring(F.md5(_c(s)), 1, 16), 16, 10).cast("decimal(38,0)")
