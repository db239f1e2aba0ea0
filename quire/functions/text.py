"""Text of chapters: linear text from markup, sentences packed into chunks, normal forms for searching."""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that are skipped with all they hold, elements after which a sentence ends, and those of HTML whose start or end
#: closes an open paragraph.
SKIPPED = "script style head title video audio iframe canvas svg".split()
BLOCKS = "p div h1 h2 h3 h4 h5 h6 li blockquote section article pre".split()
CLOSE_P = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul li dd dt td th tr body html"
).split()

#: A tag: an attribute's value is quoted only right behind its equals sign, as in HTML.
TAG = r"""<[!/?A-Za-z](?:[^>=]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|))*+[^>=]*+(?:>|\z)"""

#: Fixed values of HTML: elements whose content is text, tags and all; in the first references are decoded, in the others not even that.
DECODED, PLAIN = ("textarea",), ("noscript", "xmp", "noembed", "noframes")

#: Stands for the end of a block; no text holds it, as it is no character.
END = "\ufdd0"

TRIM = " \n\t\r"


@dataclass(frozen=True)
class ChunkPolicy:
    """Sizes in bytes: target to pack to, least (kept for callers, not used), most for a sentence, least of a snippet."""

    target: int = 500
    least: int = 400
    most: int = 700
    snippet: int = 50


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM))


def one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def split_words(sentence: Column, most: int) -> Column:
    """Parts of at most `most` characters, cut after the last white space that fits, else anywhere."""
    white = r"[ \n\t\r]"
    parts = F.regexp_extract_all(sentence, F.lit(rf"(?s){white}*(?:(.{{1,{most}}}\z)|(.{{0,{most - 1}}}{white})|(.{{{most}}}))"), 0)
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def sentences(c: Column) -> Column:
    r"""Each up to a stop and white space; \G keeps a tail without a stop from being searched from each of its places."""
    return F.regexp_extract_all(c, F.lit(r"(?s)\G.+?[.!?](?:[ \t\n\f\r]+|\z)"), 0)


def chunks(text: Column, policy: ChunkPolicy = ChunkPolicy()) -> Column:
    """Sentences packed greedily to the target; an over-long one is split by words; what has no end is kept whole."""
    empty = F.array().cast("array<string>")

    def flushed(a: Column) -> Column:
        return F.when(trimmed(a["cur"]) != "", F.concat(a["done"], F.array(trimmed(a["cur"])))).otherwise(a["done"])

    def step(a: Column, x: Column) -> Column:
        fits = F.octet_length(a["cur"]) + F.octet_length(x) <= policy.target
        split = F.concat(flushed(a), split_words(x, policy.most))
        return (
            F.when(fits, F.struct(a["done"].alias("done"), F.concat(a["cur"], x).alias("cur")))
            .when(F.octet_length(x) > policy.most, F.struct(split.alias("done"), F.lit("").alias("cur")))
            .otherwise(F.struct(flushed(a).alias("done"), x.alias("cur")))
        )

    def fold(t: Column) -> Column:
        found = sentences(t)
        used = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))
        zero = F.struct(empty.alias("done"), F.lit("").alias("cur"))
        tail = F.substring(t, used + 1, F.length(t))
        return F.aggregate(found, zero, step, lambda a: flushed(F.struct(a["done"].alias("done"), F.concat(a["cur"], tail).alias("cur"))))

    return let(one_line(text), fold)


def chunk_spans(text: Column, policy: ChunkPolicy = ChunkPolicy()) -> Column:
    """The chunks' places in the one-line text: (start, stop) in bytes; only white space lies between two of them."""

    def placed(t: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            gap = F.call_function("locate", x, t, a["chars"] + 1) - a["chars"] - 1
            start = a["bytes"] + gap
            stop = start + F.octet_length(x)
            span = F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))
            return F.struct(F.concat(a["spans"], F.array(span)).alias("spans"), (a["chars"] + gap + F.length(x)).alias("chars"), stop.alias("bytes"))

        zero = F.struct(F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.lit(0).alias("chars"), F.lit(0).alias("bytes"))
        return F.aggregate(chunks(t, policy), zero, step, lambda a: a["spans"])

    return let(one_line(text), placed)


def sliced(text: Column, start: Column, stop: Column) -> Column:
    """The bytes start..stop-1 of text; empty if they are not all there."""
    part = F.call_function("substring", text.cast("binary"), (start + 1).cast("int"), (stop - start).cast("int")).cast("string")
    return F.when((start >= 0) & (stop <= F.octet_length(text)) & (start <= stop), part).otherwise("")


def spoken_sentences(c: Column) -> Column:
    """Sentences as they are sent to speech: split after a stop and white space, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?])[ \t\n\f\r]+"), lambda x: F.btrim(x, F.lit(" \t\n\f\r"))), lambda x: x != "")


def self_closing_fixed(html: Column) -> Column:
    """<script .../> and <style .../> given an end tag, so they don't swallow what follows."""
    return F.regexp_replace(html, r"(?i)<(script|style)([ \t\n\f\r][^>]*)?[ \t\n\f\r]*/>", "<$1$2></$1>")


def body(html: Column) -> Column:
    """What stands in the body, white space between tags removed; null if there is none."""
    inner = F.regexp_extract(self_closing_fixed(html), r"(?is)<body[^>]*>(.*)</body>", 1)
    tight = F.btrim(F.regexp_replace(inner, r">[ \t\n\f\r]+<", "><"), F.lit(" \t\n\f\r"))
    return F.when(tight != "", tight)


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references decoded, named ones as in HTML; there is no built-in function for these."""
    return texts.map(lambda x: markup.unescape(x) if x and "&" in x else x)


REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def closed_decoded(text: str) -> str:
    """References that end in a semicolon decoded; others stay, as in XHTML, where they are none."""
    return REFERENCE.sub(lambda m: markup.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


@F.pandas_udf(StringType())
def closed_unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: closed_decoded(x) if x and "&" in x else x)


#: Stand for a < and an & in content that is text; no text holds them.
LESS, AND = "\ufdd4", "\ufdd5"


def raw_marked(html: Column) -> Column:
    """Markup with other signs for < and & within elements whose content is text, so that nothing takes them for tags and references."""

    def all_marked(c: Column) -> Column:
        for name in (*DECODED, *PLAIN):
            c = F.regexp_replace(c, rf"(?is)((?:<{name}(?:\s[^>]*)?>|(?!\A)\G)[^<]*+)<(?!/{name}[\s/>])", "$1" + LESS)
        for name in PLAIN:
            c = F.regexp_replace(c, rf"(?is)((?:<{name}(?:\s[^>]*)?>|(?!\A)\G)[^<&]*+)&", "$1" + AND)
        return c

    return F.when(html.rlike(rf"(?i)<(?:{'|'.join((*DECODED, *PLAIN))})[\s>]"), all_marked(html)).otherwise(html)


def linear(html: Column, closed: bool = False) -> Column:
    """Readable text of markup: a full stop and a space where a block ends, unless a stop or a space is there.

    References are decoded, line breaks become spaces, texts of white space alone are left out. A paragraph or list
    item without an end tag ends where HTML ends it. With `closed`, only references that end in a semicolon are ones; HTML
    also reads &amp and some others without it. What is text by HTML's rules, as within textarea and noscript, stays as it is.
    """
    tag, white = f"(?s){TAG}", r"(?:[\s\u0085\u00a0]|&nbsp;|&#160;|&#[xX][aA]0;)"
    c = F.regexp_replace(self_closing_fixed(html), r"(?s)<!--.*?(?:-->|\z)", "<!>")
    for name in SKIPPED:
        until = r"</head\s*>|(?=<body)" if name == "head" else rf"</{name}\s*>|\z"
        c = F.regexp_replace(c, rf"(?is)<{name}(?:\s[^>]*)?>.*?(?:{until})", "<!>")
    c = raw_marked(c)
    c = F.regexp_replace(c, rf"(?i)(<p(?:\s[^>]*)?>[^<]*+(?:<(?!/?(?:{'|'.join(CLOSE_P)})[\s/>])[^<]*+)*+)(?=<(?!/p[\s>]))", "$1</p>")
    c = F.regexp_replace(c, r"(?i)(<li(?:\s[^>]*)?>[^<]*+(?:<(?!/?(?:li|ul|ol|menu|dir)[\s>])[^<]*+)*+)(?=<(?!/li[\s>]))(?!<(?:ul|ol|menu|dir)[\s>])", "$1</li>")
    c = F.regexp_replace(F.regexp_replace(c, rf"(?i)(^|>){white}+(?=<|\z)", "$1"), rf"(?i)</(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?>", END)
    c = F.replace((closed_unescaped if closed else unescaped)(F.regexp_replace(c, tag, "")), F.lit("\n"), F.lit(" "))
    c = F.regexp_replace(F.regexp_replace(c, f"{END}+", END), rf"(?s)\A{END}|(?<=[.!? ]){END}", "")
    c = F.replace(c, F.lit(END), F.lit(". "))
    return F.replace(F.replace(c, F.lit(LESS), F.lit("<")), F.lit(AND), F.lit("&"))


def stripped(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def visible_length(html: Column) -> Column:
    return F.length(F.trim(stripped(html)))


def entities_normalised(c: Column) -> Column:
    """Four common references replaced, all other decimal and named ones deleted, in one pass: what comes of it is not read again."""
    kept = (("&#39;", "\ufdd1", "'"), ("&apos;", "\ufdd1", "'"), ("&quot;", "\ufdd2", '"'), ("&amp;", "\ufdd3", "&"))
    for name, mark, _ in kept:
        c = F.replace(c, F.lit(name), F.lit(mark))
    c = F.regexp_replace(c, r"&#[0-9]+;|&[a-zA-Z]+;", "")
    for _, mark, sign in kept[1:]:
        c = F.replace(c, F.lit(mark), F.lit(sign))
    return c


def search_form(c: Column) -> Column:
    """ASCII letters and digits in lower case; what snippets are compared by."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


#: Bytes of ASCII letters and digits; all others, those of longer characters too, are dropped from search forms.
ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER, OTHERS = bytes(range(256)).lower(), bytes(b for b in range(256) if b not in ALNUM)


@F.arrow_udf(StringType())
def search_forms(texts: pa.Array) -> pa.Array:
    """search_form() of whole texts, by a table of bytes: the pattern is matched anew at each sign it drops. Not for use within lambdas."""
    forms = [None if x is None else x.translate(LOWER, OTHERS) for x in texts.cast(pa.binary()).to_pylist()]
    return pa.array(forms, pa.binary()).cast(pa.string())


def end_trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"[ .!?]+\z", "")


def search_offsets(c: Column) -> Column:
    """For each character of search_form(c) its 1-based character position in c."""
    letters = F.split(c, "")
    known = lambda x: ((x >= "a") & (x <= "z")) | ((x >= "0") & (x <= "9")) | ((x >= "A") & (x <= "Z"))  # noqa: E731  one letter each, compared by bytes
    return F.filter(F.transform(letters, lambda x, i: F.when(known(x), i + 1)), lambda i: i.isNotNull())


# --- the reader's side: pages of a chapter's markup, and snippets saved from them ---


def client_form(snippet: Column) -> Column:
    """A snippet as the reader compares it: four references replaced one after the other, then letters and digits in lower case."""
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"')):
        snippet = F.replace(snippet, F.lit(name), F.lit(sign))
    return search_form(snippet)


def client_offset(html: Column, snippet: Column) -> Column:
    """The byte offset in markup at which the snippet begins, tags not counted as text; 0 if it is not there."""
    parts = F.regexp_extract_all(html, F.lit(r"(?s)[^<]+|<[^>]*(?:>|\z)"), 0)
    text = lambda x: ~F.startswith(x, F.lit("<"))
    place = F.call_function("locate", client_form(snippet), search_form(F.array_join(F.filter(parts, text), "")))

    def found(p: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            here = F.when(text(x), F.length(search_form(x))).otherwise(0)
            hit = a["at"].isNull() & (a["left"] > 0) & (a["left"] <= here)
            at = F.when(hit, a["bytes"] + F.octet_length(F.left(x, F.get(search_offsets(x), a["left"] - 1) - 1)))
            return F.struct((a["left"] - here).alias("left"), (a["bytes"] + F.octet_length(x)).alias("bytes"), F.coalesce(a["at"], at).alias("at"))

        zero = F.struct(p.alias("left"), F.lit(0).alias("bytes"), F.lit(None).cast("int").alias("at"))
        return F.aggregate(parts, zero, step, lambda a: F.coalesce(a["at"], F.lit(0)))

    return let(place, found)


def page_slice(html: Column, offset: Column, top: Column) -> Column:
    """The page at a byte offset: what follows it if it is aligned at the top, else what precedes it."""
    return F.when(top, sliced(html, offset, F.octet_length(html))).otherwise(sliced(html, F.lit(0), offset))


def saved_snippet(html: Column, offset: Column, most: int = 1000, least: int = 50) -> Column:
    """What is saved as the reader's place: the markup from offset on, without a tag cut off at its start; null if too short.

    A tag is cut off if a > comes before the next <.
    """
    part = F.substring(html, offset + 1, F.lit(most))

    def whole(p: Column) -> Column:
        shut, opened = F.call_function("locate", F.lit(">"), p), F.call_function("locate", F.lit("<"), p)
        kept = F.when((shut > 0) & ((opened == 0) | (shut < opened)), F.substring(p, shut + 1, F.length(p))).otherwise(p)
        return F.when(F.octet_length(kept) > least, kept)

    return let(part, whole)


def turned(start: Column, stop: Column, length: Column, forward: Column) -> Column:
    """The page after or before the one that shows start..stop: (offset, top), null at the chapter's end or start."""
    ahead = F.when(stop < length, F.struct(stop.alias("offset"), F.lit(True).alias("top")))
    back = F.when(start > 0, F.struct(start.alias("offset"), F.lit(False).alias("top")))
    return F.when(forward, ahead).otherwise(back)
