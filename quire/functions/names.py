"""Names, paths and identifiers: scalar functions over columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import ALNUM, LOWER

#: Content types of covers by suffix; all others are octet streams.
CONTENT_TYPES = (("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"))


#: Bytes of ASCII letters and digits in lower case; all others become spaces.
SPACED = bytes(LOWER[b] if b in ALNUM else 32 for b in range(256))


@F.arrow_udf(StringType())
def hyphenated(names: pa.Array) -> pa.Array:
    """ASCII letters and digits in lower case, one hyphen for what stands between them; by a table of bytes, as names may be whole texts."""
    found = [None if x is None else b"-".join(x.translate(SPACED).split()) for x in names.cast(pa.binary()).to_pylist()]
    return pa.array(found, pa.binary()).cast(pa.string())


def slug(c: Column, prefix: str = "book") -> Column:
    """ASCII letters and digits in lower case, all else one hyphen; a hash of the name where nothing is left."""
    s = hyphenated(c)
    return F.when(s != "", s).otherwise(F.concat(F.lit(f"{prefix}-"), F.lower(F.hex(F.xxhash64(c)))))


def letters_only(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))


def file_safe(c: Column) -> Column:
    """Without the characters that file systems refuse, trimmed."""
    return F.trim(F.translate(c, '<>:"/\\|?*', ""))


def bare(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def title_cleaned(title: Column, author: Column) -> Column:
    """Trimmed, and without a trailing " - author" in any case; a null author leaves the trimmed title."""
    t, suffix = bare(title), F.concat(F.lit(" - "), bare(author))
    hit = F.endswith(F.lower(t), F.lower(suffix))
    return F.when(hit, F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(suffix)), r"(?U)\s+\z", "")).otherwise(t)


def before_bracket(title: Column) -> Column:
    return F.split_part(title, F.lit(" ("), F.lit(1))


def chapter_titled(c: Column, number: Column) -> Column:
    """The first "ch. 3", "Chapter : 3", "CHAPTER - 3" or the like as "Chapter " and the chapter's own number."""
    own = F.concat(F.lit("$1Chapter "), number.cast("string"))
    return F.regexp_replace(c, F.lit(r"(?isU)\A(.*?)\b(?:ch\.?|chapter)\s*[:-]?\s*\d+"), own)


def resolved(root: Column, stored: Column) -> Column:
    """An absolute path as it is, another under the root."""
    base = F.regexp_replace(root, "/+$", "")
    return F.when(F.startswith(stored, F.lit("/")) | (root == ""), stored).when(stored == "", base).otherwise(F.concat_ws("/", base, stored))


def path_normalised(path: Column) -> Column:
    """Without "." and empty parts, each ".." taking back the part before it."""
    back = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", back(a)).otherwise(F.concat(a, F.array(x))),
    )
    return F.array_join(parts, "/")


def without_fragment(href: Column) -> Column:
    return F.split_part(href, F.lit("#"), F.lit(1))


def content_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for suffix, kind in reversed(CONTENT_TYPES):
        out = F.when(F.endswith(F.lower(path), F.lit("." + suffix)), F.lit(kind)).otherwise(out)
    return out


def play_order(c: Column) -> Column:
    """An order number; what is none counts as 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def series_position(c: Column) -> Column:
    """A fractional position rounded down, never negative."""
    return F.when(c.isNotNull(), F.greatest(F.floor(c), F.lit(0)).cast("int"))


def first_image(html: Column) -> Column:
    """The source of the first image that has one: quoted either way or not at all, wherever it stands among the attributes."""
    value = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    tag = F.regexp_extract(html, rf"(?is)<img\b[^>]*?\ssrc\s*=\s*{value}", 0)
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\ssrc\s*=\s*{value}", k), F.lit("")) for k in (1, 2, 3)], F.lit(""))


def cover_path(book: Column) -> Column:
    """Where a book's cover is served."""
    return F.concat(F.lit("/api/v1/books/"), book.cast("string"), F.lit("/cover"))
