"""Vectors of the text functions, and the invariants that hold for all texts."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions import text as T
from quire.operators.search import located


def value(spark, column, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>Rain fell</p>", "Rain fell. "),
        ("<section><h2>Rain</h2><ul><li>fell<li>long</ul></section>", "Rain. fell. long. "),
        ("<p>It <i>rained</i> all\nnight!</p><p>Then it stopped.</p>", "It rained all night!Then it stopped."),
        ("<p> Lead <!-- no --> <b> </b></p>", " Lead "),
        ("<header>Title</header>Text<nav>Menu</nav>", "TitleTextMenu"),
        ("a<script >if (x < 1) '</p>'</script ><style>p{}</style>b", "ab"),
        ("<p>One<p>Two<div>Three</div>", "One. Two. Three. "),
        ("<p>x &lt; y &amp;amp; z&nbsp;&#8211; &eacute;</p>&nbsp;<br>", "x < y &amp; z\u00a0– é. "),
        ('<p title="a > b" lang=en class=x\'>Kept</p>', "Kept. "),
        ("<textarea><p>a</p> &lt;</textarea>b<noscript><i>c &amp; d</noscript >e&amp;", "<p>a</p> <b<i>c &amp; de&"),
        ("<xmp>a</p> <b>", "a</p> <b>"),
        ("", ""),
    ],
)
def test_linear(spark, html, text):
    assert value(spark, T.linear(F.col("x")), x=html) == text


WHITE = " \n\t\r"


def folded(text, target, most):
    """The rule of chunks, read sentence by sentence: bytes are counted, a sentence ends at a stop and the white space behind it."""
    text, out, held, begin = text.replace("\n", " "), [], "", 0

    def flush():
        nonlocal held
        if held.strip(WHITE):
            out.append(held.strip(WHITE))
        held = ""

    k = 0
    while k < len(text):
        k += 1
        if k - begin < 2 or text[k - 1] not in ".!?" or (k < len(text) and text[k] not in " \t\n\f\r"):
            continue
        while k < len(text) and text[k] in " \t\n\f\r":
            k += 1
        sentence, begin = text[begin:k], k
        if len((held + sentence).encode()) <= target:
            held += sentence
        else:
            flush()
            if len(sentence.encode()) > most:
                out += parted(sentence, most)
            else:
                held = sentence
    held += text[begin:]
    flush()
    return out


def parted(sentence, most):
    """The rule of split words, by characters: a part ends after the last white space among its first `most`, else it is full; what is left at the end is a part."""
    out, rest = [], sentence.lstrip(WHITE)
    while rest:
        n = len(rest) if len(rest) <= most else next((k for k in range(most, 0, -1) if rest[k - 1] in WHITE), most)
        out, rest = out + [rest[:n].strip(WHITE)], rest[n:].lstrip(WHITE)
    return [x for x in out if x]


def scribble(r, n):
    """A text of words, stops, white space of all kinds and letters of one to four bytes."""
    return "".join(r.choice(("a", "bc", "deé", "日本", "\U0001f600", " ", " ", " ", "  ", ". ", ".", "! ", "?\n", "\t", "\r", "1.5", "loooooooong")) for _ in range(n))


def test_chunks(spark):
    r = random.Random(11)
    for target, most in ((12, 9), (30, 20), (25, 60), (500, 700)):
        texts = [scribble(r, r.randint(0, 90)) for _ in range(150)] + ["", " ", ".", ". . .", "no stop"]
        policy = T.ChunkPolicy(target=target, most=most)
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
        for row in rows.select("x", T.chunks(F.col("x"), policy).alias("c"), T.chunk_spans(F.col("x"), policy).alias("s")).collect():
            assert row["c"] == folded(row["x"], target, most)
            whole = row["x"].replace("\n", " ").encode()
            assert [whole[a:b].decode() for a, b in row["s"]] == row["c"]


def test_slices(spark):
    text = "  é one. \t日本 two!  three"
    spans = value(spark, T.chunk_spans(F.col("x"), T.ChunkPolicy(target=8, most=50)), x=text)
    assert [text.encode()[a:b].decode() for a, b in spans] == ["é one.", "日本 two!  three"]
    assert value(spark, T.sliced(F.col("x"), F.lit(2), F.lit(4)), x=text) == "é"
    assert value(spark, T.sliced(F.col("x"), F.lit(2), F.lit(400)), x=text) == ""


def test_split_words(spark):
    r = random.Random(12)
    texts = [scribble(r, r.randint(0, 40)) for _ in range(200)]
    for most in (1, 7, 20):
        rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.split_words(F.col("x"), most).alias("p")).collect()
        for row in rows:
            assert row["p"] == parted(row["x"], most) and all(len(x) <= most for x in row["p"])


def test_long_text_without_stop_is_quick(spark):
    assert value(spark, F.size(T.chunks(F.col("x"))), x="word " * 60_000) == 1


@pytest.mark.parametrize(
    ("snippet", "status", "chunk"),
    [
        ("<p>The third sentence ends here.</p>", "found", 2),
        ("<p>The thirdsentence <b>ends</b> here</p>", "found", 2),
        ("<p>The third sentence ends here!!!</p>", "found", 2),
        ("<p>&quot;The third sentence&quot; ends here</p>", "found", 2),
        ("<p>The &amp;copy;third sentence ends</p>", "found", 2),
        ("<b><i><u><s><em>short</em></s></u></i></b>", "too short", None),
        ("short................................", "too short", None),
        ("This stands nowhere at all in it", "not found", None),
        ("-----------------------------------", "found", 0),
    ],
)
def test_located(spark, snippet, status, chunk):
    text = "Here stands the first one. Here stands the second. “The third sentence” ends here. A fourth one follows. "
    policy = T.ChunkPolicy(target=30, most=40, snippet=20)
    row = located(spark.createDataFrame([(text, snippet)], "text string, snippet string"), policy).first()
    assert (row["status"], row["chunk"]) == (status, chunk)
    if status == "found" and chunk:
        assert text[row["position"] - 1 :].startswith("The third sentence")


@pytest.mark.parametrize(
    ("text", "form"),
    [("&amp;lt; &frac12; &#x27; &apos;&#39;&quot;", "&lt; &frac12; &#x27; ''\""), ("a&nbsp;b&#8211;c & d; &a&b;mp;", "abc & d; &amp;"), ("&unclosed", "&unclosed")],
)
def test_entities(spark, text, form):
    assert value(spark, T.entities_normalised(F.col("x")), x=text) == form


def test_client_offsets(spark):
    html = "<p class='a b'>É, first</p>\n<p>Second &amp; third</p>"
    at = lambda x: value(spark, T.client_offset(F.col("h"), F.col("s")), h=html, s=x)
    assert html.encode()[at("second") :].startswith(b"Second") and html.encode()[at("First") :].startswith(b"first")
    assert at("nowhere") == 0
    assert value(spark, T.saved_snippet(F.col("x"), F.lit(0)), x="p class=x>" + "y" * 60) == "y" * 60
    assert value(spark, T.saved_snippet(F.col("x"), F.lit(0)), x="<b>" + "y" * 40) is None
    assert value(spark, T.page_slice(F.col("x"), F.lit(3), F.lit(True)), x="abcdef") == "def"
    assert value(spark, T.page_slice(F.col("x"), F.lit(3), F.lit(False)), x="abcdef") == "abc"


def test_client_offsets_of_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1).alias("s"))
    for html, s, at in rows.select("html", "s", T.client_offset(F.col("html"), F.col("s")).alias("at")).collect():
        plain, places, inside = "", [], False
        for i, c in enumerate(html):
            inside = c == "<" or (inside and c != ">")
            if not inside and c.isascii() and c.isalnum():
                plain, places = plain + c.lower(), [*places, len(html[:i].encode())]
        for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"')):
            s = s.replace(name, sign)
        hit = plain.find("".join(c.lower() for c in s if c.isascii() and c.isalnum()))
        assert at == (places[hit] if hit >= 0 else 0)


def test_body(spark):
    assert value(spark, T.body(F.col("x")), x="<html><head><script src='a'/></head><body> <p>Chapter 1 content</p> </body></html>") == "<p>Chapter 1 content</p>"
    assert value(spark, T.body(F.col("x")), x="<html><body> </body></html>") is None


@pytest.mark.parametrize(
    ("root", "stored", "path"),
    [("/library", "/abs/x", "/abs/x"), ("/library/", "A/B.epub", "/library/A/B.epub"), ("/library", "A/B.epub", "/library/A/B.epub"), ("", "A/B", "A/B"), ("/library", "", "/library")],
)
def test_resolved(spark, root, stored, path):
    assert value(spark, N.resolved(F.col("r"), F.col("s")), r=root, s=stored) == path


def test_names(spark):
    assert value(spark, N.slug(F.col("x")), x=" The Héllo -- World! ") == "the-h-llo-world"
    assert value(spark, N.slug(F.col("x")), x="日本").startswith("book-")
    assert value(spark, N.letters_only(F.col("x")), x="Vol. 2") == "vol"
    assert value(spark, N.title_cleaned(F.col("t"), F.col("a")), t="\u00a0Dune  - frank herbert ", a=" Frank Herbert") == "Dune"
    assert value(spark, N.title_cleaned(F.col("t"), F.col("a")), t=" Dune ", a=None) == "Dune"
    assert value(spark, N.first_image(F.col("x")), x="<img alt='a'  src = pic.png><img src=b>") == "pic.png"
    assert value(spark, N.content_type(F.col("x")), x="a.GIF") == "application/octet-stream"
    assert value(spark, N.path_normalised(F.col("x")), x="a/./b/../../c//d") == "c/d"
    for given, titled in (("ch. 12 and Chapter 3", "Chapter 7 and Chapter 3"), ("Chapter : 3", "Chapter 7"), ("The CHAPTER - 3: x", "The Chapter 7: x"), ("Chapters 3", "Chapters 3"), ("ch3", "Chapter 7")):
        assert value(spark, N.chapter_titled(F.col("x"), F.lit(7)), x=given) == titled
    assert value(spark, N.play_order(F.col("x")), x="x1") == 0


def test_whole_texts_search_forms(spark):
    """The same as search_form(), and no pattern is matched at each sign."""
    texts = [None, "", "Aé1—日本 Zz_9\n", "\U0001f600!?", "KKİi", "\0a\x7fB", "x" * 100_000 + "É" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("x", T.search_forms(F.col("x")).alias("whole"), T.search_form(F.col("x")).alias("plain"))
    found = rows.collect()
    assert len(found) == len(texts) and all(r["whole"] == r["plain"] for r in found)
    forms = rows.select("whole")
    assert "regexp_replace" not in forms._jdf.queryExecution().executedPlan().toString().lower()


def test_slugs_of_whole_texts(spark):
    """As the pattern has them, and no pattern is matched at each gap."""
    texts = ["", "--", "Aé1—日本 Zz_9\n", "\U0001f600!?", "KKİi", "\0a\x7f\x1cB", "one long name " * 20_000]
    rows = spark.createDataFrame(list(enumerate([None, *texts])), "k int, x string")
    by_pattern = F.btrim(F.lower(F.regexp_replace("x", "[^A-Za-z0-9]+", "-")), F.lit("-"))
    found = rows.select("x", N.slug(F.col("x")).alias("slug"), by_pattern.alias("plain")).collect()
    assert all(r["slug"] == r["plain"] if r["plain"] else r["slug"].startswith("book-") for r in found[1:])
    assert found[0]["slug"] == rows.where("x is null").select(F.concat(F.lit("book-"), F.lower(F.hex(F.xxhash64("x"))))).first()[0]
    assert "regexp_replace" not in rows.select(N.slug(F.col("x")))._jdf.queryExecution().executedPlan().toString().lower()
