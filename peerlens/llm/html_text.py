"""Main text of web pages: a linear-chain CRF over the leaf blocks of a page.

A page is read in one pass into its leaf blocks (runs of text between block-level tags), each with its open
ancestors.  Features are ancestor tags, words of their class, id and role attributes, and shape of the text;
labels are "main" and "other".  The field is trained on labelled pages composed here from page plans, and
decoded by Viterbi over batches of pages.  Scripts, styles and other unseen elements never become blocks.
"""

import functools
import html
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from peerlens.llm.common import byte_slices
from peerlens.llm.crf import Chain, feature_ids

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img "
    "math mi mn mo ms mtext mspace mrow mfrac msup msub msubsup msqrt mroot mstyle mover munder munderover semantics annotation".split()
)
#: Elements whose content is not text of the page (formulas, and what stands in for an object, are).
_UNSEEN = frozenset("script style noscript template iframe svg annotation head title select textarea option datalist audio video canvas".split())
#: Of these the content is raw: it ends at the closing tag, whatever stands in it.
_RAW = frozenset("script style textarea title noscript iframe".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
#: Tags that may stand in a head; any other, or text, ends a head that is still open.
_IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template html head".split())
_SELF_CLOSING = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
                 "td": ("td th", "tr table"), "th": ("td th", "tr table")}
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*""")
_WORDS = re.compile(r"[a-z]+")


class Block:
    """A leaf block: its text, and how it lies in the page."""

    __slots__ = ("text", "tags", "marks", "linked")

    def __init__(self, text, tags, marks, linked):
        self.text, self.tags, self.marks, self.linked = text, tags, marks, linked


def _tag_end(page, at):
    """Place after the `>` of a tag whose name ends at `at`; quoted values may hold `>`."""
    end = page.find(">", at)
    if end < 0:
        return -1
    if page.find('"', at, end) < 0 and page.find("'", at, end) < 0:
        return end + 1
    stop = _ATTRIBUTES.match(page, at).end()
    return stop + 1 if stop < len(page) and page[stop] == ">" else end + 1


def blocks(page):
    """Leaf blocks of a page in page order; never fails, whatever the page."""
    out, parts, stack, linked, hidden, anchors = [], [], [], 0, 0, 0
    at, n = 0, len(page)
    lower = None

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            marks = [w for _, words in stack for w in words]
            out.append(Block(text, [t for t, _ in stack], marks, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def close(place):
        nonlocal hidden, anchors
        for tag, _ in stack[place:]:
            hidden -= tag in _UNSEEN
            anchors -= tag == "a"
        del stack[place:]

    def find(names, stop=()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                return -1
        return -1

    while at < n:
        begin = page.find("<", at)
        text = page[at:begin if begin >= 0 else n]
        if stack and stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if text and not hidden:
            text = html.unescape(text)
            parts.append(text)
            if anchors:
                linked += len(" ".join(text.split()))
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, begin)
        if not m:
            if page[begin + 1:begin + 2] in ("!", "?", "/"):
                end = page.find(">", begin)
                at = n if end < 0 else end + 1
            else:  # a bare `<` is text
                if stack and stack[-1][0] == "head":
                    close(len(stack) - 1)
                if not hidden:
                    parts.append("<")
                at = begin + 1
            continue
        tag, end = m[1].lower(), _tag_end(page, m.end())
        if end < 0:
            break  # the page ends inside a tag
        at = end
        if page[begin + 1] == "/":
            place = find((tag,), () if tag not in _INLINE else _CLOSES_P)
            if tag not in _INLINE:
                flush()
            if place >= 0:
                close(place)
            continue
        if stack and stack[-1][0] == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)
        # A block of the page cannot stand in a drawing or a list of choices: one that is still open was not closed.
        if hidden and tag in _CLOSES_P and (place := find(("svg", "select", "canvas", "audio", "video"))) >= 0:
            close(place)
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
            if tag in _CLOSES_P and (place := find(("p",), ("td", "th", "li", "div", "article", "section", "button"))) >= 0:
                close(place)
            elif tag in _SELF_CLOSING:
                names, stop = _SELF_CLOSING[tag]
                if (place := find(names.split(), stop.split())) >= 0:
                    close(place)
        if tag in _VOID or page[end - 2] == "/" and tag not in _RAW:
            continue
        attributes = page[m.end():end - 1]
        words = ()
        if attributes and "=" in attributes:
            values = [f"{x[1]}{x[2]}{x[3]}".lower() for x in _ATTRIBUTE.findall(attributes)]
            words = tuple(dict.fromkeys(_WORDS.findall(" ".join(values))))
        stack.append((tag, words))
        hidden += tag in _UNSEEN
        anchors += tag == "a"
        if tag in _RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != n:  # lower-casing changed the length: search without it
                found = re.compile(f"</{tag}", re.I).search(page, at)
                stop = found.start() if found else -1
            else:
                stop = lower.find(f"</{tag}", at)
            at = n if stop < 0 else stop
    flush()
    return out


def _features(page):
    """Active features of each block of a page."""
    out, n = [], len(page)
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        tags = set(b.tags)
        names = ["bias", f"leaf={next((t for t in reversed(b.tags) if t not in _INLINE), '-')}", f"len={min(len(b.text), 400) // 40}"]
        names += [f"in={t}" for t in tags if t not in _INLINE] + [f"mark={w}" for w in set(b.marks)]
        names += [f"words={min(words, 60) // 6}", f"link={int(b.linked * 4)}", f"stop={b.text[-1] in '.!?…:;'}|{words > 8}"]
        names += [f"copy={'©' in b.text}", f"pipes={any(c in b.text for c in '|·»')}|{'a' in tags or b.linked > 0}"]
        names += [f"place={i * 4 // n}", f"first={i == 0}", f"last={i == n - 1}", f"article={'article' in tags or 'main' in tags}|{words > 8}"]
        names += [f"bare={not (tags - {'html', 'body'})}|{n == 1}|{words > 8}"]
        out.append(feature_ids(names))
    return out


# --------------------------------------------------------------- labelled pages

#: Names that page plans give to parts of a page, by what the part is.
_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs tabs topbar links skip toc pagination pager",
    "header": "header masthead banner branding logo top head",
    "footer": "footer copyright bottom colophon legal foot imprint",
    "side": "sidebar side widget related recommended popular aside rail archive tags more",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent notice notification alert popup modal gdpr warning overlay",
    "form": "form search newsletter subscribe signup login contact",
    "comment": "comment comments reply replies discussion respond thread disqus feedback",
    "share": "share social sharing follow buttons tools meta byline author",
}
_MAIN_NAMES = "article content post entry story main text body page"
_MAIN_SIGN = "\ue001"


def _page(rng):
    """One labelled page: text of its main blocks carries a sign.  Some are nothing but an article, with or without tags."""
    syllables = "the ing and re er on an st ti he ou le de la en ei ch un ge ar os ción é ä ü que".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
    sentence = lambda: phrase(1, 14) + "."

    def attribute(name):
        named = rng.choice((f'{name}', f'{name}-{rng.choice("box wrap inner area list item block".split())}', f'{word()[:3]} {name}'))
        return rng.choice((f' class="{named}"', f' id="{named}"', f" class='{named}'"))

    def links(n):
        items = [f'<a href="/{word()}">{phrase(1, 3)}</a>' for _ in range(n)]
        return rng.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)))()

    def other(kind):
        name = rng.choice(_NAMES[kind].split())
        tag = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"),
               "form": ("form", "div"), "comment": ("section", "div", "ol")}.get(kind, ("div", "section", "p", "aside"))
        tag = rng.choice(tag)
        named = attribute(name) if tag in ("div", "section", "p", "ol", "ul") or rng.random() < 0.4 else ""
        if kind == "advert" and rng.random() < 0.5:
            tag, named = "div", rng.choice((' class="ad"', ' class="ads"', ' id="ad"'))
        plain = lambda: " ".join(sentence() for _ in range(rng.randint(1, 5)))
        inner = {
            "menu": lambda: links(rng.randint(2, 8)), "header": lambda: rng.choice((phrase(1, 4), f"<h2>{phrase(1, 4)}</h2>", links(3))),
            "footer": lambda: rng.choice((f"&copy; {word()}.example.org &middot; {plain()}", f"<p>© 2024 {phrase(1, 4)}</p>" + links(3), plain())),
            "side": lambda: f"<h3>{phrase(1, 3)}</h3>" + rng.choice((links(4), f"<p>{plain()}</p>")),
            "form": lambda: f'<label>{phrase(1, 3)}</label><input type="text"><button>{phrase(1, 2)}</button>' + rng.choice(("", f"<p>{plain()}</p>")),
            "comment": lambda: "".join(f'<div{attribute("comment")}><b>{word()}</b><p>{plain()}</p></div>' for _ in range(rng.randint(1, 4))),
        }.get(kind, plain)()
        return f"<{tag}{named}>{inner}</{tag}>"

    def main_block():
        text = _MAIN_SIGN + " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 7))))
        if rng.random() < 0.12:  # junk that is still the page's text
            text = text.replace(" ", rng.choice((" | ", "%%% ", " · ", "&amp;&amp; "))).rstrip(".")
        loose = rng.random()
        if loose < 0.12:
            return f"<p><b>{_MAIN_SIGN}{sentence()}<br>"
        if loose < 0.2:
            return f"<h{rng.randint(2, 4)}>{_MAIN_SIGN}{phrase(1, 7)}</h{rng.randint(2, 4)}>"
        if loose < 0.27:
            return "<ul>" + "".join(f"<li>{_MAIN_SIGN}{sentence()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if loose < 0.31:
            return f"<blockquote>{text}</blockquote>"
        if loose < 0.34:
            return "<table>" + "".join(f"<tr><td>{_MAIN_SIGN}{phrase(1, 4)}</td></tr>" for _ in range(2)) + "</table>"
        if loose < 0.38:
            return f"<div>{text}</div>"
        if loose < 0.45:
            return f'<p>{text} <a href="/x">{phrase(1, 3)}</a> {sentence()}</p>'
        return f"<p>{text}</p>" if rng.random() < 0.9 else f"<p>{text}"

    if rng.random() < 0.18:
        whole = "".join(main_block() for _ in range(rng.randint(1, 8)))
        plain = "\n".join(_MAIN_SIGN + " ".join(sentence() for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 3)))
        return rng.choice((f"<html><body>{whole}</body></html>", whole, plain, plain, f"<pre>{plain}</pre>", f"<html><body>{plain}"))
    title = f"<h1>{_MAIN_SIGN}{phrase(2, 12)}</h1>" if rng.random() < 0.85 else ""
    body = [main_block() for _ in range(rng.randint(1, 14))]
    if rng.random() < 0.35:
        body.insert(rng.randint(0, len(body)), other(rng.choice(("advert", "share", "side", "menu", "form", "notice"))))
    if rng.random() < 0.2:
        body.append(other("comment"))
    if title and rng.random() < 0.15:
        title = f"<header>{title}</header>"
    wrap = rng.choice(("article", "article", "article", "main", "div", "div", "section", ""))
    named = attribute(rng.choice(_MAIN_NAMES.split())) if wrap in ("div", "section") or rng.random() < 0.25 else ""
    core = title + "".join(body)
    core = f"<{wrap}{named}>{core}</{wrap}>" if wrap else core
    before = [other(k) for k in ("notice", "header", "menu", "advert", "form", "share") if rng.random() < 0.4]
    after = [other(k) for k in ("share", "side", "comment", "advert", "form", "menu", "footer") if rng.random() < 0.4]
    if rng.random() < 0.3:
        before.append(other("side"))
    return "<html><body>" + "".join(before) + core + "".join(after) + rng.choice(("</body></html>", ""))


def labelled_pages(n=520, seed=3):
    """(blocks, labels) of composed pages."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        page = blocks(_page(rng))
        labels = [int(_MAIN_SIGN in b.text) for b in page]
        for b in page:
            b.text = b.text.replace(_MAIN_SIGN, "") or "-"
        out.append((page, labels))
    return out


@functools.cache
def trained():
    pages = labelled_pages()
    return Chain(2).fit([_features(p) for p, _ in pages], [y for _, y in pages], penalty=0.05)


def main_texts(model, pages):
    """Main text of each page."""
    parsed = [blocks(p) for p in pages]
    labels = model.decode([_features(p) for p in parsed])
    return ["\n\n".join(b.text for b, y in zip(p, best) if y) for p, best in zip(parsed, labels)]


def _extract(shared):
    def run(batches):
        for batch in byte_slices(batches, "html"):
            texts = main_texts(shared.value, [h.as_py().decode("utf-8", "replace") for h in batch.column("html")])
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return run


def main_text(pages):
    """Per row of `pages`: page_id, url, text, n_chars (code points).

    NULL counts as empty; a page without main blocks has an empty text; of two labellings that score alike the one with
    more "other" blocks counts.  Repeated rows are answered each; an empty table gives an empty result; a very long page is one
    value of its task and is read whole; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # fixed size: the hashed weights
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"),
    )
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")
