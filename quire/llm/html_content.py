"""HTML extraction: the contiguous region of a page with the greatest score, words for and tags against it."""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text, those without content, those that stand within a line.
UNSHOWN = ("script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "select", "object", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset(
    "html body main article section div nav header footer aside form ul ol dl table fieldset dialog menu figure details h1 h2 h3 h4 h5 h6".split()
)

#: Fixed values of HTML: elements whose end tags may be left out. A start tag closes the open ones listed for it, up to the nearest of the
#: elements after them; an end tag of theirs looks no further either.
_CELLS = frozenset({"table"})
_ITEMS = frozenset("ul ol dl menu table td th body article section main aside nav header footer form fieldset figure details dialog blockquote".split())
_CLOSED = {
    "li": (frozenset({"li"}), _ITEMS), "dt": (frozenset({"dt", "dd"}), _ITEMS), "dd": (frozenset({"dt", "dd"}), _ITEMS),
    "td": (frozenset("td th caption".split()), _CELLS), "th": (frozenset("td th caption".split()), _CELLS), "tr": (frozenset("tr td th caption colgroup".split()), _CELLS),
    **{x: (frozenset("thead tbody tfoot tr td th caption colgroup".split()), _CELLS) for x in ("thead", "tbody", "tfoot", "colgroup", "caption")},
    "option": (frozenset({"option"}), frozenset({"datalist", "optgroup"})), "optgroup": (frozenset({"option", "optgroup"}), frozenset({"datalist"})),
    "rt": (frozenset({"rt", "rp"}), frozenset({"ruby"})), "rp": (frozenset({"rt", "rp"}), frozenset({"ruby"})),
}
OPTIONAL = frozenset({"p", *_CLOSED})
_BLOCKS = (CONTAINERS - {"html", "body"}) | frozenset("p li dt dd address blockquote center dir figcaption hgroup hr pre summary search".split())
_AROUND_P = CONTAINERS | frozenset("td th caption button object".split())

#: Features of parts of a text, which don't tell its container from another.
WITHIN = frozenset("#prose #few #links a div section ul ol dl table figure details h1 h2 h3 h4 h5 h6".split())

#: What follows a tag's name: a quote opens a value only right behind an equals sign, as in HTML; elsewhere it is a letter like others.
_REST = r"""(?:[^>=]*+=\s*+(?:"[^"]*+"|'[^']*+'|))*+[^>=]*+"""

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<unshown>{'|'.join(UNSHOWN)})(?![A-Za-z0-9:-]){_REST}(?:>.*?(?:</(?P=unshown)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>{_REST})(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")

#: Words that say how a box is laid out and nothing of what it holds; what stands before one names it.
LAYOUT = frozenset(
    "area bar block body bottom box boxes btn button cell col column container footer group header holder inner item items layout left link links list "
    "module outer panel right row section sections slot top unit widget wrap wrapper".split()
)


def _names(rest: str) -> frozenset[str]:
    """What the names in an element's class, id and role call it: a feature of what it holds.

    A name of several words is called by its last, as in English: "search-engines" are engines and no search. Words of
    layout at its end are passed over: an "ad-slot" is an ad.
    """
    if "=" not in rest:
        return frozenset()
    found = set()
    for value in _NAMED.findall(rest):
        for name in value.strip("\"'").split():
            words = _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            while len(words) > 1 and words[-1] in LAYOUT:
                words.pop()
            if words:
                found.add("." + words[-1])
    return frozenset(found)


class Box:
    """An open element that says something of what it holds: its own features, whether it lies in an article, and what is counted in it."""

    __slots__ = ("own", "up", "in_article", "words", "prose", "controls")

    def __init__(self, own: frozenset[str], up: Box | None, in_article: bool) -> None:
        self.own, self.up, self.in_article = own, up, in_article
        self.words = self.prose = self.controls = 0

    def around(self):
        box: Box | None = self
        while box is not None:
            yield box
            box = box.up


def segments(html: str):
    """The page in order, as (kind, value, features): "text" with its features, "tag" and "break" with a tag's name and no features.

    Features of a text are its open containers' names and name parts, and "a" within a link. Elements whose end tags may
    be left out end as HTML says: at the next of their kind or, a paragraph, at the next block. Others that are never
    closed end with the container around them. Nesting may be of any depth.
    """
    for kind, value, features, _ in _boxed(html):
        yield kind, value, features


def _boxed(html: str):
    """The segments, each with the innermost box that it lies in."""
    stack: list[tuple[str, frozenset[str], Box | None]] = []  # names, own features, and the box that was open before
    opened: Counter[str] = Counter()  # of the names on the stack
    held: Counter[str] = Counter()  # of the features on the stack
    features: frozenset[str] | None = frozenset()  # of held; None after a change
    link, box = False, None

    def close(wanted: frozenset[str], up_to: frozenset[str], all_of_them: bool = False) -> None:
        """Closes the innermost open element of `wanted`, or all of them, that lies within the nearest of up_to."""
        nonlocal features, box
        if not any(opened[x] for x in wanted):
            return
        at = None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in wanted:
                at = k
                if not all_of_them:
                    break
            elif stack[k][0] in up_to:
                break
        if at is None:
            return
        box = stack[at][2]
        for gone, own, _ in stack[at:]:
            opened[gone] -= 1
            for f in own:
                held[f] -= 1
                if not held[f]:
                    del held[f]
                    features = None
        del stack[at:]

    for m in _TOKEN.finditer(html):
        text = m["text"]
        if text is not None:
            if features is None:
                features = frozenset(held)
            yield "text", text, features | {"a"} if link else features, box
            continue
        name = m["name"]
        if name is None:
            if m["unshown"]:
                yield "break", m["unshown"].lower(), frozenset(), box
            continue
        name = name.lower()
        yield ("tag" if name in INLINE else "break"), name, frozenset(), box
        if m["close"]:
            if name == "a":
                link = False
            if name in CONTAINERS:
                close(frozenset({name}), frozenset())
            else:
                close(frozenset({name}), _CLOSED[name][1] if name in _CLOSED else CONTAINERS)
            continue
        if name == "a":
            link = True
        elif name not in INLINE:
            link = False
        if name in _BLOCKS:
            close(frozenset({"p"}), _AROUND_P)
        if name in _CLOSED:
            close(*_CLOSED[name], all_of_them=True)
        rest = m["rest"]
        if name in VOID or rest.endswith("/"):
            continue
        own = _names(rest) | ({name} if name in CONTAINERS else frozenset())
        if own or name in OPTIONAL:
            stack.append((name, own, box))
            if own:
                box = Box(own, box, name in ("article", "main") or (box is not None and box.in_article))
            opened[name] += 1
            for f in own:
                if not held[f]:
                    features = None
                held[f] += 1


#: What makes a block prose: words, and a stop at its end; and how much of a box must be prose for its name to be doubted.
PROSE_WORDS, PROSE_LEAST, PROSE_SHARE, PROSE_ALL = 10, 20, 0.7, 0.9
_STOP = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*\s*\Z")

#: Elements that a reader fills in, and names of what readers have written.
CONTROLS = frozenset("input button select textarea label".split())
REMARKS = frozenset(".comment .comments .reply .replies .respond .response .responses .discussion .disqus".split())


def described(html: str, doubted: frozenset[str] = frozenset()) -> list[tuple[str, str, frozenset[str]]]:
    """The segments with features of structure: whether a text's block is prose, has few words, or is mostly links.

    What a box is called counts only as long as what it holds doesn't speak against it. The `doubted` of its own features
    are dropped from a box that holds nearly all the prose there is, whatever it is called; and from one in an article that
    is mostly prose, without anything to fill in, and not called after readers' remarks.
    """
    parts = list(_boxed(html))
    blocks: list[list[int]] = [[]]
    for i, (kind, value, _, box) in enumerate(parts):
        if kind == "break":
            if blocks[-1]:
                blocks.append([])
            if value in CONTROLS and box is not None:
                for b in box.around():
                    b.controls += 1
        elif kind == "text" and not value.isspace():
            blocks[-1].append(i)
    told: dict[int, str] = {}
    total = 0
    for block in blocks:
        words = sum(len(parts[i][1].split()) for i in block)
        if not words:
            continue
        linked = sum(len(parts[i][1].split()) for i in block if "a" in parts[i][2]) / words
        prose = words >= PROSE_WORDS and linked < 0.3 and bool(_STOP.search(parts[block[-1]][1]))
        mark = "#prose" if prose else "#links" if linked > 0.5 else "#few" if words < 5 else ""
        total += words * prose
        for i in block:
            n = len(parts[i][1].split())
            if mark:
                told[i] = mark
            if parts[i][3] is not None:
                for b in parts[i][3].around():
                    b.words += n
                    b.prose += n * prose

    def fair(b: Box) -> frozenset[str]:
        """What is believed of a box's own features."""
        all_of_it = total >= PROSE_LEAST and b.prose >= PROSE_ALL * total
        inner = b.in_article and not b.controls and b.prose >= PROSE_LEAST and b.prose >= PROSE_SHARE * b.words and not b.own & REMARKS
        return b.own - doubted if all_of_it or inner else b.own

    known: dict[Box | None, frozenset[str]] = {None: frozenset()}
    out = []
    for i, (kind, value, features, box) in enumerate(parts):
        if kind == "text":
            if box not in known:
                known[box] = frozenset().union(*(fair(b) for b in box.around()))
            features = known[box] | ({"a"} & features) | ({told[i]} if i in told else frozenset())
        out.append((kind, value, features))
    return out


#: Names that sites give to containers of each kind, for the labelled pages.
_KINDS = {
    "content": "content article post entry story body text main page single primary".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toolbar tabs topbar toc".split(),
    "header": "header masthead branding logo top site".split(),
    "footer": "footer foot copyright legal colophon bottom".split(),
    "aside": "sidebar aside related recommended widget trending popular archive tags rail".split(),
    "notice": "notice cookie cookies consent banner alert popup modal gdpr warning message".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp".split(),
    "form": "form search login signup newsletter subscribe subscription contact".split(),
    "comment": "comment comments reply replies respond discussion disqus reader".split(),
    "share": "share social sharing follow buttons pagination pager author byline meta".split(),
}
_MARK = ""


def labelled_page(seed: int) -> str:
    """A page made by rule, its content marked with _MARK at the start of each text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdlmnrst") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def say(a: int, b: int) -> str:
        """Sentences."""
        out = [w + r.choice(["", "", "", "", "", ",", ".", "?"]) for w in words(a, b).split()]
        return " ".join(out).rstrip(",.?") + r.choice("....!?")

    def named(kind: str) -> str:
        own = r.choice(_KINDS[kind])
        extra = r.choice(["", f"{own}-{r.choice(['box', 'wrap', 'area', 'inner', 'list'])}", word()])
        return f' {r.choice(["class", "class", "id"])}="{" ".join(x for x in (own, extra) if x)}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def junk(kind: str) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = tag if tag and r.random() < 0.6 else r.choice(["div", "div", "section"])
        attributes = named(kind) if tag in ("div", "section") or r.random() < 0.4 else ""
        if kind == "menu" and r.random() < 0.2:  # nothing but its links tells what it is
            return f"<div>{links(r.randint(3, 8))}</div>"
        inner = r.choice([links(r.randint(2, 8)), f"<p>{r.choice((words, say))(4, 40)}</p>", r.choice((words, say))(4, 25), f"<h3>{words(1, 4)}</h3>{links(3)}"])
        if kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + r.choice(["", f"<p>{r.choice((words, say))(5, 20)}</p>"])
        if kind == "comment":
            inner = "".join(f"<div><b>{word()}</b><p>{say(5, 60)}</p></div>" for _ in range(r.randint(1, 4)))
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def block() -> str:
        text = f"{_MARK}{say(1, 80) if r.random() < 0.8 else words(1, 80)}"
        if r.random() < 0.3:
            text = r.choice(["<b>{}</b>", "<b>{}<br>", "<em>{}</em>", "<span>{}</span>", "{}<br>", "<strong>{}</strong>", "<i>{}</i>"]).format(text)
        if r.random() < 0.2:
            text += f' <a href="/x">{_MARK}{words(1, 3)}</a>{_MARK} {say(2, 20)}'
        kind = r.random()
        if kind < 0.08:
            return "<ul>" + "".join(f"<li>{_MARK}{words(3, 15)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.14:
            return f"<h2>{_MARK}{words(1, 6)}</h2><p>{text}</p>"
        return f"<{(t := r.choice(['p', 'p', 'p', 'p', 'blockquote', 'div']))}>{text}" + (f"</{t}>" if r.random() < 0.85 or t != "p" else "")

    body = [f"<h1>{_MARK}{words(2, 9)}</h1>", *(block() for _ in range(r.randint(1, 12)))]
    for kind in ("advert", "share", "aside", "notice", "form", "menu"):
        if r.random() < 0.35:
            body.insert(r.randint(1, len(body)), junk(kind))
    tag = r.choice(["article", "article", "main", "div", "div", "section"])
    content = f"<{tag}{named('content') if r.random() < (0.6 if tag in ('div', 'section') else 0.3) else ''}>{''.join(body)}</{tag}>"
    if r.random() < 0.1:  # no container at all
        content = "".join(body)
    for _ in range(r.choice([0, 0, 1, 3])):
        content = f"<div>{content}</div>"
    before = [junk(k) for k in ("menu", "header", "notice", "advert", "form", "aside") if r.random() < 0.5]
    after = [junk(k) for k in ("comment", "aside", "share", "advert", "form", "footer", "menu") if r.random() < 0.5]
    r.shuffle(before)
    return f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(before)}{content}{''.join(after)}</body></html>"


#: Labelled pages that the weights are fitted to: all there are, made by rule.
LABELLED = 500

#: Texts that must have a feature for it to get a weight, the ridge on weights, and the least weight of a tag.
SUPPORT, RIDGE, TAG_LEAST = 8, 0.1, -4.0

#: Bounds of a word's score in a sum, so that a long advert doesn't cut an article in two.
WORD_LEAST, WORD_MOST = -0.5, 2.0


def fit(pages: list[str]) -> tuple[float, dict[str, float], dict[str, float]]:
    """The bias and feature weights of a word, and the weight of each tag, from pages marked with _MARK.

    A word's score is the log odds of lying in the content, by logistic regression on its features. A tag's is the log
    of its rate per word inside the content's span against outside, and never above zero: tags count against a region.
    """
    rows: list[frozenset[str]] = []
    labels, mass = [], []
    inside, outside = {}, {}
    n_in = n_out = 1
    for page in pages:
        parts = described(page)
        marked = [i for i, (kind, v, _) in enumerate(parts) if kind == "text" and _MARK in v]
        for i, (kind, value, features) in enumerate(parts):
            within = marked[0] <= i <= marked[-1]
            if kind == "text":
                n = len(value.split())
                n_in, n_out = n_in + n * within, n_out + n * (not within)
                if n:
                    rows.append(features)
                    labels.append(_MARK in value)
                    mass.append(n**0.5)
            else:
                side = inside if within else outside
                side[value] = side.get(value, 0) + 1
    support = Counter(f for row in rows for f in row)
    index = {f: i for i, f in enumerate(sorted(f for f, n in support.items() if n >= SUPPORT))}
    x = np.zeros((len(rows), len(index) + 1))
    x[:, -1] = 1
    for i, row in enumerate(rows):
        x[i, [index[f] for f in row if f in index]] = 1
    y, m = np.array(labels, float), np.array(mass) / np.mean(mass)
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(len(w), RIDGE)
        step = np.linalg.solve((x.T * (m * p * (1 - p))) @ x + np.diag(ridge), x.T @ (m * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    tags = {t: min(0.0, max(TAG_LEAST, float(np.log((inside.get(t, 0) + 1) / n_in) - np.log((outside.get(t, 0) + 1) / n_out)))) for t in {*inside, *outside}}
    return float(w[-1]), {f: float(w[i]) for f, i in index.items()}, tags


@lru_cache(maxsize=1)
def trained() -> tuple[float, dict[str, float], dict[str, float]]:
    return fit([labelled_page(i) for i in range(LABELLED)])


def best_span(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of greatest sum, as (start, stop), by one pass; of equal ones the first to end, then the longest of those that a sum of zero or less doesn't begin. Empty if no sum is above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(html: str, weights) -> str:
    """The text of the best region: its blocks in page order, white space made single spaces, references decoded.

    One pass scores the page's segments and keeps the contiguous run of greatest sum, the first of equals. It then grows
    over texts at its ends, up to the first that counts as content but stands in a container the run has no text of: a
    last line of one word is worth less than its tags cost. Texts inside it that score against the content, such as an advert between paragraphs, are left out.
    """
    bias, word, tag = weights
    scores: dict[frozenset[str], float] = {}
    parts, sums = [], []
    seen: set[str] = set()  # tags since the last words: several of a name running, such as wrappers, count once
    for kind, value, features in described(html, frozenset(f for f, w in word.items() if w < 0)):
        if kind == "text":
            if not value.isspace():
                seen.clear()
            n = len(value.split())
            if features not in scores:
                scores[features] = bias + sum(word.get(f, 0.0) for f in features)
            s = scores[features]
            parts.append((kind, value, s > 0, features))
            sums.append(n * min(max(s, WORD_LEAST), WORD_MOST))
        else:
            parts.append((kind, value, False, features))
            sums.append(0.0 if value in seen else tag.get(value, 0.0))
            seen.add(value)
    low, high = best_span(sums)
    box = lambda f: frozenset(x for x in f if x in word and x not in WITHIN)
    held = {box(f) for _, _, good, f in parts[low:high] if good}
    for way in (range(low - 1, -1, -1), range(high, len(parts))):
        for i in way:
            if parts[i][2] and parts[i][1].strip():
                if box(parts[i][3]) not in held:
                    break
                low, high = min(low, i), max(high, i + 1)
    out: list[str] = []
    for kind, value, good, _ in parts[low:high]:
        if kind == "break":
            out.append(" ")
        elif kind == "text" and good:
            out.append(value)
    return " ".join(unescape("".join(out)).split())


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", weights=None) -> DataFrame:
    """One row per page: page_id (bigint), url, text (empty if there is none), n_chars (its code points).

    weights are those of fit(); by default they are fitted to the labelled pages made by labelled_page(). Null html is
    empty; pages cut off in the middle of a tag, comment or script end there. Rows with equal ids are each extracted.
    An empty table gives an empty result; columns besides id, url and html are not read.
    """
    weights = weights or trained()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [extract(x or "", weights) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    own = pages.select(F.col(f"`{id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return own.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
