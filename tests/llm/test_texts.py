"""Quality rules, packing, coding, extraction and secrets: plain versions, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import html_content as H
from quire.llm import secrets as S
from quire.llm import sentencepieces as P
from quire.llm.packing import Levels, pack, tokens_of
from quire.llm.quality_rules import THRESHOLDS, keep_good, quality_rules

from . import brute


def test_quality(docs, corpus, empty):
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for i, t in corpus:
        n, chars, symbols, lines, repeated = brute.measures(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert r["kept"] == (r["broken_rules"] == "" and not r["base_failed"])
    assert quality_rules(empty).count() == 0
    loose = [t for t in THRESHOLDS if t[0] != "few_stop_words"]  # the corpus is of invented words
    assert keep_good(docs, thresholds=loose).columns == docs.columns
    assert keep_good(docs, thresholds=loose).count() == quality_rules(docs, thresholds=loose).where("kept").count() > 40


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_words >= 20").join(labels, "doc_id")
    share = {r["quality"]: r["s"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def check_packed(rows, texts, ids_of):
    """Every id in exactly one piece, digests right, sequences gapless; the padding is returned."""
    ids = {i: ids_of(t) for i, t in texts}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for name, parts in [*pieces.items(), *sequences.items()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at <= 1024 if parts is sequences.get(name) else at == len(ids[name])
    assert set(pieces) == set(ids)
    return sum(1024 - sum(n for _, n in parts) for parts in sequences.values())


def test_odd_rows(odd):
    """Repeated rows and ids are packed and judged one by one; a null id stays null."""
    rows = pack(odd).collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0) and sum(r["start"] == 0 for r in rows) == 6
    places = collections.Counter((r["sequence_id"], k) for r in rows for k in range(r["offset"], r["offset"] + r["length"]))
    assert max(places.values()) == 1
    assert quality_rules(odd).count() == 6 and keep_good(odd).columns == odd.columns


def reference_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


def test_packing(docs, corpus, empty):
    padding = check_packed(pack(docs).collect(), corpus, reference_ids())
    assert padding <= 1024 * docs.rdd.getNumPartitions()
    assert pack(empty).count() == 0


@pytest.mark.parametrize("text", [" a  b \n c\t d   ", "x <|endoftext|> y  <|endoftext|>", "é   z \x1c q", "don't  we'll\r\n\n  stop123", "日本語 и текст", "", "   "])
def test_tokens_agree(text):
    own = tokens_of(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.fast is not None
    assert list(own.encode(text)) == list(reference_ids()(text)[:-1])


def test_tokens_of_another_file():
    own = tokens_of(public_tokenizers.path("word_bpe_49k.json"))
    assert own.fast is None and len(own.encode("some words"))


def test_levels_choose_the_least_sum_of_squares():
    levels, r = Levels(16), np.random.default_rng(2)
    for size in r.integers(1, 16, 400):
        before = levels.count.copy()
        _, at = levels.place(int(size))

        def cost(h, before=before, size=int(size)):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + size < 16:
                c[h + size] += 1
            return int((c[1:16] ** 2).sum())

        assert cost(at) == min(cost(h) for h in [0, *[h for h in range(1, 17 - size) if before[h]]])


def test_pieces_round_trip(docs, corpus, empty):
    encoded = P.sample_pieces(docs)
    again = {r["doc_id"]: r["ids_crc32"] for r in P.sample_pieces(docs.repartition(2)).collect()}
    assert {r["doc_id"]: r["ids_crc32"] for r in encoded.collect()} == again
    assert {r["doc_id"]: r["text"] for r in P.decode_pieces(encoded).collect()} == {i: t or "" for i, t in corpus}
    assert P.sample_pieces(empty).count() == 0


def test_pieces_of_odd_rows(odd):
    rows = P.decode_pieces(P.sample_pieces(odd)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert len({r["ids_crc32"] for r in rows if r["doc_id"] == 1}) == 1


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "▁ ▁▁x", "\n\t\x00", "日本語😀 é", "w" * 300])
def test_pieces_lossless(text):
    p = P.pieces(public_tokenizers.path(P.MODEL))
    ids, offsets = P.encode(p, [text, "other"], [1, 2])
    assert P.decode(p, ids[offsets[0] : offsets[1]]).decode() == text


def test_pieces_distribution():
    """Segmentations of a word come up as often as the products of their pieces say."""
    p = P.pieces(public_tokenizers.path(P.MODEL))
    n, word = 20_000, P.SPACE + "ation"
    names = {}
    for k, (known, ids, _) in p.tables.items():
        for h, i in zip(known[:-1], ids, strict=True):
            names[(k, int(h))] = int(i)

    def piece(s):
        h = np.zeros(1, np.uint64)
        for c in P._codes(s).astype(np.uint64):
            h = P._rolled(c[None], h)
        return names.get((len(s), int(h[0])))

    def all_of(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if (i := piece(s[:k])) is not None:
                yield from ((i, *rest) for rest in all_of(s[k:]))

    weight = {s: float(np.exp(0.1 * sum(p.logp[i] for i in s))) for s in all_of(word)}
    ids, off = P.encode(p, ["ation"] * n, list(range(n)), alpha=0.1)
    seen = collections.Counter(tuple(int(x) for x in ids[a:b]) for a, b in zip(off[:-1], off[1:], strict=True))
    assert len(weight) > 5 and set(seen) <= set(weight)
    assert max(abs(seen[s] / n - w / sum(weight.values())) for s, w in weight.items()) < 0.015


def test_extraction_on_held_out_pages():
    weights, right = H.trained(), 0
    for seed in range(50_000, 50_200):
        page = H.labelled_page(seed)
        parts = [" " if k == "break" else v if k == "text" and (H._MARK in v or not v.strip()) else "" for k, v, _ in H.segments(page)]
        right += H.extract(page.replace(H._MARK, ""), weights) == " ".join("".join(parts).replace(H._MARK, "").split())
    assert right >= 185


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One <b>tw</b>o.<p>Three\n four<div class=ad>Buy this now</div><p>End.</article><footer>&copy; me</footer>", "T & U One two. Three four End."),
        ("<body><div id='content'><p>Only words here, and some more of them.</p></div><div class='comments'><p>I do not agree at all</p></div>", "Only words here, and some more of them."),
        ("<article><p>Cut off in the mid<b", "Cut off in the mid"),
        ("<article><p>Kept text stands here</p><script>var a='<p>no</p>'", "Kept text stands here"),
        ("<article><p>Before the remark</p><!-- <p>no</p>", "Before the remark"),
        ("<nav>only</nav>", ""),
        ("<article><h1>T</h1><div id='search-engines'><p>How they work.</p></div><p class=author-note>By me.</p><div class=ad-slot>Buy</div></article>", "T How they work. By me."),
        ('<article><p title=5">Middle</p><p class="a > b">End</p></article>', "Middle End"),
        ("<article><p>First</p>" + "<div>" * 20 + "<p>" + "a long body " * 500 + "</p>" + "</div>" * 20 + "<p>Last</p></article>", "First " + "a long body " * 500 + "Last"),
        ("<div><a href=x>One</a> <a href=y>Two</a></div><div><h1>Title</h1><p>Plain words in an unnamed box.</p></div>", "Title Plain words in an unnamed box."),
    ],
)
def test_extraction(page, text):
    assert H.extract(page, H.trained()) == text


def test_best_span():
    r = random.Random(2)
    for _ in range(500):
        x = [r.choice((-3, -1, 0, 1, 2, 5)) for _ in range(r.randint(0, 14))]
        a, b = H.best_span(x)
        most = max((sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0)
        assert sum(x[a:b]) == max(most, 0) and (most > 0 or a == b)


PROSE = "The river ran low that year, and nobody in the village remembered it lower. Boats lay on their sides in the mud. "


@pytest.mark.parametrize("name", ['class="news-reader"', 'class="entry post-meta"', "id=sidebar", 'class="comments-page"', "class=advert"])
def test_a_name_alone_empties_no_page(name):
    """The one article there is, called after something else."""
    for tag in ("div", "article", "section", "aside"):
        page = f"<body><nav><ul><li><a href=x>Menu</a></ul></nav><{tag} {name}><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></{tag}><footer>&copy; me</footer></body>"
        assert H.extract(page, H.trained()) == ("Title " + PROSE * 2).strip()


@pytest.mark.parametrize(
    "name",
    [
        'class="short-form"', 'id="weather-warning"', 'class="popular"', "class=site-search", "id=login", 'class="top-banner"', "class=subscribe", 'class="ad-hoc"', 'class="menu-planning"', "class=footer-notes",
        'class="share-holders"', "class=promotion", "class=cookies", 'class="tags-explained"', "class=author", 'class="sponsor-story"', "class=archive", "class=contact", "class=legal", "class=alert", "class=modal", "id=breadcrumb",
    ],
)
def test_ordinary_paragraphs_in_an_article_stay(name):
    page = f"<body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{PROSE}</p><div {name}><p>{PROSE}</p></div><p>End of it.</p></article><footer>me</footer></body>"
    assert H.extract(page, H.trained()) == f"Title {PROSE}{PROSE}End of it."


def test_what_is_no_article_goes():
    """Remarks, links, forms and short notices, in the article and beside it, with sentences too."""
    junk = [
        f'<div class="comments"><div><b>Ann</b><p>{PROSE}</p></div><div><b>Bo</b><p>{PROSE}</p></div></div>', '<div class="related"><ul><li><a href=a>One more story here</a><li><a href=b>And one more of them</a></ul></div>',
        '<form><label>Mail</label><input name=q><p>Get our letter each day, and never miss a single one again, as we promise.</p><button>Go</button></form>', '<div class="ad">Buy this now, it is cheap.</div>', '<div class="cookie-notice"><p>We use cookies.</p></div>',
    ]
    for x in junk:
        for page in (f"<article><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></article>{x}", f"<article><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p>{x}<p>{PROSE}</p></article>"):
            assert H.extract(page, H.trained()) == ("T " + PROSE * 3).strip(), x


class Article(HTMLParser):
    """The text of article elements by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.out = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out.append("" if tag in H.INLINE else " ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out.append("" if tag in H.INLINE else " ")

    def handle_data(self, data):
        self.out.append(data if self.depth else "")


def test_extraction_of_pages(spark):
    """All of the pages' articles, read by another parser, and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r for r in H.main_text(pages).collect()}
    for p in pages.collect():
        assert rows[p["page_id"]]["text"] == " ".join("".join(Article(p["html"]).out).split())
        assert rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"])


def test_extraction_of_odd_tables(spark):
    long = "<article>" + "<p>some words in a paragraph</p>" * 40_000 + "</article>"
    rows = [(1, None, None, "x", 3), (2, "u", "", "x", 3), (2, "u", "<p>Two words</p>", "x", 3), (2, "u", "<p>Two words</p>", "x", 3), (None, None, long, "x", 3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in H.main_text(table).collect())
    assert got == [(0, 40_000 * 26 - 1), (1, 0), (2, 0), (2, 9), (2, 9)]
    assert H.main_text(table.limit(0)).count() == 0


def test_secrets_on_held_out_findings(spark):
    model = S.fit_forest(S.labelled_findings(spark))
    held = model.transform(S.with_features(S.labelled_findings(spark, 2000, 10**6)))
    assert held.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.94


def test_planted_secrets_of_documents(spark):
    """All quoted tokens that stand in the documents are found, and nothing else is a secret."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    planted = {(r["doc_id"], x) for r in documents.collect() for x in re.findall(r'token = "([0-9a-f]{40})"', r["text"] or "")}
    found = {(r["doc_id"], r["candidate"]) for r in S.scan_secrets(documents).where("is_secret").collect()}
    assert len(planted) > 100 and len(planted - found) <= 0.02 * len(planted) and len(found - planted) <= 0.02 * len(found)


def test_secrets_of_odd_tables(spark, odd, empty):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    text = f'the token = "{token}" of it'
    rows = [(1, text, 5, "x"), (1, text, 5, "x"), (None, text, 5, "x"), (2, None, None, "x"), (3, "", 0, "x"), (4, "z" * 500_000 + " " + text, 1, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, candidate string")
    assert S.scan_secrets(table, path=None).where("is_secret").count() == 4
    clean = S.redact_secrets(table)
    assert clean.columns == table.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[-27:], r["n_chars"]) for r in clean.collect()) == [
        (0, 'he token = "[SECRET]" of it', 28), (1, 'he token = "[SECRET]" of it', 28), (1, 'he token = "[SECRET]" of it', 28), (2, "", None), (3, "", 0), (4, 'he token = "[SECRET]" of it', 500_029),
    ]
    assert S.redact_secrets(odd, path=None).count() == 6 and S.redact_secrets(empty).count() == 0


def test_secrets(spark, empty):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [
        (1, f'some words and token = "{token}" then more'), (2, f"see commit {token} for the change"), (3, "write to some.person42@mail7.example.com today"),
        (4, None), (5, ""), (6, f"{'x' * 40} password: aB3dE5fG7hJ9kL1mN3pQ5rS7tU9v twice password: aB3dE5fG7hJ9kL1mN3pQ5rS7tU9v"),
    ]
    docs = spark.createDataFrame([(*r, "src") for r in rows], "doc_id long, text string, source string")
    found = {(r["doc_id"], r["candidate"]): r["is_secret"] for r in S.scan_secrets(docs).collect()}
    assert found[(1, token)] and not found[(2, token)] and found[(6, "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9v")]
    assert not any(v for (i, _), v in found.items() if i == 3)
    clean = {r["doc_id"]: r["text"] for r in S.redact_secrets(docs).collect()}
    assert clean[1] == 'some words and token = "[SECRET]" then more' and clean[6].count(S.SECRET) == 2
    assert {i: clean[i] for i in (2, 3, 4, 5)} == {i: t for i, t in rows if i in (2, 3, 4, 5)}
    assert S.scan_secrets(empty).count() == 0


def test_secrets_of_any_length_and_in_any_quotes(spark):
    """Long signed tokens and keys, escaped quotes and line ends, other quotes and stops, short and letters-only secrets."""
    code = lambda k, n: base64.urlsafe_b64encode(b"".join(hashlib.sha256(b"%d:%d" % (k, i)).digest() for i in range(n))).decode().rstrip("=")
    jwt = f"eyJ{code(1, 1)[:17]}.eyJ{code(2, 21)[:832]}.{code(3, 1)}"
    key, token = code(4, 40)[:1500], "24be7f1c9d084c7d659a2feaa0c55ad015a3bf4f"
    assert 890 < len(jwt) < 910
    told = [
        (jwt, f"Authorization: Bearer {jwt} and more"), (key, f"secret key = {key}"), (token, f'{{\\"token\\":\\"{token}\\"}}'), (token, f"token «{token}» here"),
        (token, f"token “{token}”"), (token, f"password={token}\\nnext"), (token, f"first\\ntoken\\n{token}"), (token, f"token {token}… and so on"), (token, f"token：{token}です"),
        ("hJ4kX92qWz", "password: hJ4kX92qWz"), ("qzxvkwjtrbpnmghdlfyc", "secret = qzxvkwjtrbpnmghdlfyc"),
        (r"Qx7dTzP4\/9rLm2VbC8nYw5\/KhJ3sFg6Ea1Uo0i", r'"secret":"Qx7dTzP4\/9rLm2VbC8nYw5\/KhJ3sFg6Ea1Uo0i"'),
    ]
    plain = ["the secret garden of another winter", "key question about the section", "bearer of another message", f"commit «{token}» fixed it", "no hJ4kX92qWz1 beside it"]
    docs = spark.createDataFrame([(i, t, "src") for i, t in enumerate([t for _, t in told] + plain)], "doc_id long, text string, source string")
    found = {(r["doc_id"], r["candidate"]) for r in S.scan_secrets(docs).where("is_secret").collect()}
    assert found == {(i, c) for i, (c, _) in enumerate(told)}
    clean = {r["doc_id"]: r["text"] for r in S.redact_secrets(docs).collect()}
    assert clean == {i: t.replace(c, S.SECRET) for i, (c, t) in enumerate([*told, *(("[]", t) for t in plain)])}


def test_secrets_that_only_a_word_tells(spark):
    """Any signs, any length, numbers, and addresses; and what stands there without being a secret."""
    told = [
        ("12345678901234567890", "password: 12345678901234567890"), ("Tr0ub4dor&3horse!x", 'pw = "Tr0ub4dor&3horse!x"'), ("p@ss", "password is p@ss"), ("9f", "secret: 9f."), ("S3cr3tP4ssw0rd", "db://user:S3cr3tP4ssw0rd@host/x"),
        ("a8!kd$$01Lq", "api_key => 'a8!kd$$01Lq'"), ("#4e1b90c2", "passwd=#4e1b90c2;"), ("aB3&x7K!" * 300, "secret = " + "aB3&x7K!" * 300),
    ]
    plain = [
        "password: required", "the secret is out.", "token: true", "password: ${DB_PASSWORD}", "password = getPassword()", "the secret is été", "password: ****", "password is the best", "secret: no!", "auth: basic",
        "https://a.example.com:8080/x@y", "password:", "secret = ''", "token is" + " " * 200_000, "key: " + "z" * 300_000, ("token is a" + "://") * 30_000,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in told] + plain)], "doc_id long, text string")
    rows = S.scan_secrets(docs, path=None).collect()
    found = {(r["doc_id"], r["candidate"]) for r in rows if r["is_secret"]}
    assert {(i, c) for i, (c, _) in enumerate(told)} <= found and not {i for i, _ in found if i >= len(told)}
    assert all(any(c in t for _, t in told) for _, c in found)
    clean = {r["doc_id"]: r["text"] for r in S.redact_secrets(docs, path=None).collect()}
    assert clean == {i: t.replace(c, S.SECRET) for i, (c, t) in enumerate([*told, *(("[]", t) for t in plain)])}


def plain_candidates(text):
    """(candidate, near) that a secret word and a sign or an address make, read by another engine."""
    words, out = "|".join(S.SECRET_WORDS), set()
    for m in re.finditer(rf"(?i)(?<![a-z0-9])({words})[\"'`]?\s*(?:=>|:=|[:=]|\b(?:is|was)\b)\s*[\"'`]?([^\s\"'`]+)", text):
        value = re.sub(r"(?s)\\(?:[nrtbf]|u[0-9a-fA-F]{4}).*", "", m[2])
        bare = value.rstrip(".,;:)]}>")
        out.add((value.rstrip(".,;:") if re.search(r"[({\[<]", bare) else bare, m[1].lower()))
    out |= {(m[1], S.IN_ADDRESS) for m in re.finditer(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'`]*:([^\s/@\"'`]+)@", text)}
    return {(c, n) for c, n in out if c and (re.search(r"[^A-Za-z0-9+/_.~%@-]", c) or len(c) < S.LEAST_BESIDE or not re.search("[A-Za-z]", c) or n == S.IN_ADDRESS)}


def test_candidates_against_another_reading(spark):
    r = random.Random(3)
    part = lambda: r.choice(["password", "Token", "pw", "key", "is", "was", ":", "=", "=>", " ", " ", "\n", '"', "'", "x://u:", "@h", "a1!", "9f", "(b)", "p@ss", ".", ",", "word", "\\n", "é", "42", "/"])
    texts = ["".join(part() for _ in range(r.randint(3, 25))) for _ in range(400)]
    rows = S.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", None).where("before = '' and after = ''").collect()
    got = {}
    for x in rows:
        if re.search(r"[^A-Za-z0-9+/_.~%@-]", x["candidate"]) or len(x["candidate"]) < S.LEAST_BESIDE or not re.search("[A-Za-z]", x["candidate"]) or x["near"] == S.IN_ADDRESS:
            got.setdefault(x["doc_id"], set()).add((x["candidate"], x["near"]))
    assert got == {i: c for i, t in enumerate(texts) if (c := plain_candidates(t))}


def test_short_secrets_are_redacted_as_runs_only(spark):
    docs = spark.createDataFrame([(1, "password: hJ4kX92qWz, again hJ4kX92qWz. but zhJ4kX92qWz1"), (2, "x" * 300_000 + "1 " + r"a1\/" * 50_000)], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in S.redact_secrets(docs, path=None).collect()}
    assert clean[1] == "password: [SECRET], again [SECRET]. but zhJ4kX92qWz1" and len(clean[2]) > 400_000


def test_pieces_distribution_over_long_runs():
    """In a run of over 64 characters without a space, pieces end at each place as often as a sum over all segmentations says."""
    p = P.pieces(public_tokenizers.path(P.MODEL))
    n, run = 3000, "international" * 9
    ranked = {x.decode().replace(" ", P.SPACE): float(p.logp[i]) for i, x in enumerate(p.raw) if x and i not in set(p.byte.tolist())}
    whole = P.SPACE + run
    size = len(whole)
    weight = {(a, b): np.exp(ranked[whole[a:b]]) for a in range(size) for b in range(a + 1, min(a + p.longest, size) + 1) if whole[a:b] in ranked}
    ahead, back = np.zeros(size + 1), np.zeros(size + 1)
    ahead[0] = back[size] = 1
    for b in range(1, size + 1):
        ahead[b] = sum(ahead[a] * weight.get((a, b), 0) for a in range(b))
    for a in range(size - 1, -1, -1):
        back[a] = sum(back[b] * weight.get((a, b), 0) for b in range(a + 1, size + 1))
    ids, off = P.encode(p, [run] * n, list(range(n)))
    seen = np.zeros(size + 1)
    for a, b in zip(off[:-1], off[1:], strict=True):
        seen[np.cumsum([len(p.raw[i].decode()) for i in ids[a:b]])] += 1
    assert np.abs(seen[1:] / n - (ahead * back / ahead[size])[1:]).max() < 0.05


@pytest.mark.parametrize(
    ("page", "left_out"),
    [
        ("<article><p class=ad>Buy<p>Real text", {"Buy"}),
        ("<article><ul><li class=ad><div>Buy<li>Real text</ul><p>Real text", {"Buy"}),
        ("<article><table><tr class=ad><td><div class=promo>Buy<td>Buy<tr><td>Real text</table>Real text", {"Buy"}),
        ("<article><dl><dt class=ad>Buy<dd>Real text<p class=ad>Buy</dl>Real text", {"Buy"}),
        ("<article><p class=ad>Buy<h2>Real text</h2><p>Real text<table><tr><td><p class=ad>Buy<td>Real text</table>", {"Buy"}),
        ("<ul><li class=ad>Buy<ul><li>Buy</ul>Buy<li>Real text", {"Buy"}),
        ("<aside class=ad>" + "<div>" * 1000 + "Buy" + "</div>" * 1000 + "Buy</aside>Real text", {"Buy"}),
        ("<article>" + "<div><b id=x>" * 500 + "<div class=ad>Buy</div>Real text" + "</div>" * 500 + "Real text", {"Buy"}),
    ],
)
def test_extraction_of_left_out_end_tags_and_deep_nesting(page, left_out):
    texts = [(v, ".ad" in f) for kind, v, f in H.segments(page) if kind == "text"]
    assert {v for v, named in texts if named} == left_out and {v for v, named in texts if not named} == {"Real text"}


def test_longest_of_words():
    """The pattern finds what an alternation of the words, longest first, finds."""
    words = ("the", "there", "thermal", "her", "a.b", "a", "ab")
    plain = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    for text in ("thethere", "thermathermal", "xa.bab", "hertherth", "", "the a a.c"):
        assert re.findall(S.longest_of(words), text) == re.findall(plain, text)
    assert S.longest_of(()) == ""
