"""HTML extraction by a recurrent block labeller.

A page is cut into leaves: runs of text between block-level tags, each with the path of its
open elements (tag, class and id words). A bidirectional LSTM in numpy reads for each leaf
a hashed vector of its path, a hashed vector of its words, and a few numbers, and labels
every leaf as main text or not with the whole page as context.

The model is trained here, on pages that ``sample_page`` makes up (articles in many markups
between menus, headers, footers, sidebars, notices, adverts, forms and comments); training
is deterministic and takes some seconds on the driver. No page of the input is needed. Some of the
pages are blocks without any container, or lines parted by empty ones.

Scripts, styles, templates, drawings, form fields, what stands for a script, comments and
markup are never text. A null page is empty; a page without text gives the empty string; a page
without any tag is text as a whole. Unclosed and unmatched tags are tolerated, and pages of any
length are read in one pass; elements more than ``DEEPEST`` deep count as if they lay there. Repeated
rows each get a row; an empty table gives an empty result; other columns are handed on, but for
those called like the results.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import lean, slices, table, texts

PATH, WORDS, NUMBERS, HIDDEN = 48, 24, 6, 24
INPUT = PATH + WORDS + NUMBERS
#: Pages and passes of training, and padded leaves of one step of labelling.
PAGES, PASSES, STEP = 1500, 20, 40_000
# Elements whose content is never text.
_HIDDEN = frozenset("script style noscript template svg textarea select iframe canvas".split())
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_QUOTE_OR_END = re.compile("[>\"']")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _HIDDEN}
#: Elements within one another; what is deeper is read as if it lay at this depth.
DEEPEST = 128
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements inside a block, and elements without content.
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr del".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

Leaf = tuple[tuple[str, ...], str, float]
#: A token: the text before it, a name (empty for what is no element), whether it ends the element, its attributes.
Token = tuple[str, str, bool, str]


def tokens(page: str) -> Iterator[Token]:
    """The tags of a page, each with the text before it, and the text after the last one, in one pass.

    A tag ends at the first ">" outside of quotes. Where a quote is never closed, or no such end follows,
    quotes count for nothing from there on: the page is scanned to its end in vain once at most."""
    at, said, quoted = 0, 0, True
    last = page.rfind(">")
    while found := _OPEN.search(page, at):
        start, at = found.start(), found.end()
        if start > last and not found[1]:
            break  # no tag ends any more
        if found[1]:
            end = page.find("-->", at)
            yield page[said:start], "", False, ""
            said = at = len(page) if end < 0 else end + 3
            continue
        end = page.find(">", at)
        if not found[2] and quoted:
            place, whole = at, -1
            while mark := _QUOTE_OR_END.search(page, place):
                if mark[0] == ">":
                    whole = mark.start()
                    break
                close = page.find(mark[0], mark.end())
                if close < 0:
                    break
                place = close + 1
            quoted, end = whole >= 0, whole if whole >= 0 else end
        name = (found[4] or "").lower()
        yield page[said:start], name, found[3] == "/", page[at:end]
        said = at = end + 1
        if name in _HIDDEN and not found[3]:
            close = _ENDS[name].search(page, at)
            said = at = close.end() if close else len(page)
    yield page[said:], "", False, ""


def leaves(page: str) -> list[Leaf]:
    """(path, text, share of linked characters) of each run of text."""
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked = length = links = 0

    def close() -> None:
        nonlocal linked, length
        text = " ".join("".join(held).split())
        if text:
            out.append((tuple(x for _, x in stack), text, linked / max(length, 1)))
        held.clear()
        linked = length = 0

    def say(raw: str) -> None:
        nonlocal linked, length
        held.append(entities.unescape(raw))
        length += len(raw)
        linked += len(raw) if links else 0

    deeper, broken = 0, False
    for before, name, ending, attributes in tokens(page):
        if before:
            say(before)
            broken = broken and not before.strip()
        if not name or name in _HIDDEN:
            continue
        if name == "a":
            links = max(0, links + (-1 if ending else 1))
        if name == "br":
            held.append(" ")
            if broken:  # an empty line parts blocks
                close()
            broken = True
        if name in INLINE or name in VOID:
            if name == "hr":
                close()
            continue
        close()
        if ending:
            links = 0 if name in _ENDS_P else links
            if deeper:
                deeper -= 1
            elif any(tag == name for tag, _ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in _ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            stack.pop()
        if len(stack) == DEEPEST:
            deeper += 1
            continue
        named = " ".join(f"{kind.lower()}={w}" for kind, *v in _NAMES.findall(attributes) for w in re.split(r"[\s_\-]+", "".join(v).lower()) if w)
        stack.append((name, f"{name} {named}".strip()))
    close()
    return out


@lru_cache(1 << 16)
def _direction(word: str) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(word.encode())).normal(size=PATH) / PATH**0.5


@lru_cache(1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH)
    for depth, element in enumerate(path):
        tag, *names = element.split(" ")
        out += _direction(tag)
        for name in names:  # class, id and role words count alike
            out += 1.5 * _direction("=" + name.partition("=")[2])
        if depth == len(path) - 1:
            out += 0.5 * _direction("last " + tag)
    return out * 2


def leaf_vectors(page: list[Leaf]) -> np.ndarray:
    x = np.zeros((len(page), INPUT))
    for k, (path, text, linked) in enumerate(page):
        words = text.split(" ")
        x[k, :PATH] = _path_vector(path)
        bag = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS)
        x[k, PATH : PATH + WORDS] = bag / np.sqrt((bag * bag).sum())
        x[k, PATH + WORDS :] = (np.log1p(len(words)) / 4, linked, text[-1] in ".!?", len(path) / 8, len(text) / len(words) / 10, 1.0)
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output for each leaf."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {f"{d}{n}": rng.normal(size=s) * 0.15 for d in "fb" for n, s in (("x", (INPUT, 4 * HIDDEN)), ("h", (HIDDEN, 4 * HIDDEN)))}
        self.p |= {"o": rng.normal(size=2 * HIDDEN) * 0.15, "c": np.zeros(1)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; x is steps x pages x inputs."""
        steps, pages, _ = x.shape
        gates_in = x @ self.p[d + "x"]
        h, c, out = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros((steps, pages, HIDDEN))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates_in[t] + h @ self.p[d + "h"]
            g = np.tanh(z[:, :HIDDEN])
            s = 1 / (1 + np.exp(-z[:, HIDDEN:]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, g, i, f, o, tanh, m))
            c, h = np.where(m, new, c), np.where(m, o * tanh, h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._run("f", x, mask), self._run("b", x, mask)), axis=2)
        return 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["c"])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, mask, kept[d]) for d in "fb"], axis=2)
        error = (1 / (1 + np.exp(-(both @ self.p["o"] + self.p["c"]))) - y) * mask / mask.sum()
        out = {"o": np.einsum("tp,tph->h", error, both), "c": np.array([error.sum()])}
        for n, d in enumerate("fb"):
            dh_all = error[:, :, None] * self.p["o"][n * HIDDEN : (n + 1) * HIDDEN]
            dh, dc = np.zeros(dh_all.shape[1:]), np.zeros(dh_all.shape[1:])
            dz_all, dw = np.zeros((*x.shape[:2], 4 * HIDDEN)), np.zeros_like(self.p[d + "h"])
            for t, h0, c0, g, i, f, o, tanh, m in reversed(kept[d]):
                dh = dh + dh_all[t]
                dnew = (dc + dh * o * (1 - tanh * tanh)) * m
                dz = np.concatenate((dnew * i * (1 - g * g), dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), dh * m * tanh * o * (1 - o)), axis=1)
                dw += h0.T @ dz
                dz_all[t] = dz
                dc = np.where(m, dnew * f, dc)
                dh = np.where(m, dz @ self.p[d + "h"].T, dh)
            out[d + "h"], out[d + "x"] = dw, np.einsum("tpi,tpz->iz", x, dz_all)
        return out

    def label(self, pages: list[list[Leaf]]) -> list[np.ndarray]:
        """Which leaves of each page are main text."""
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        while order:
            longest = max(len(pages[order[-1]]), 1)
            now, order = order[-max(1, STEP // longest) :], order[: -max(1, STEP // longest)]
            x, mask = _padded([leaf_vectors(pages[k]) for k in now])
            for k, column in zip(now, self.scores(x, mask).T, strict=True):
                out[k] = column[: len(pages[k])] > 0.5
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((steps, len(pages), INPUT)), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# Words of class and id names around and in articles.
_AROUND = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav pagination pager links toc skip".split(),
    "header": "header masthead top topbar branding logo tagline hero hd".split(),
    "footer": "footer bottom copyright legal colophon foot ft".split(),
    "aside": "sidebar aside widget related recommended trending popular more rail secondary sb posts stories".split(),
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner adsense adbox".split(),
    "notice": "cookie newsletter signup cookies consent notice alert popup modal gdpr privacy overlay message banner disclaimer subscribe newsletter paywall".split(),
    "form": "form search login signup subscribe newsletter contact register".split(),
    "share": "share social sharing follow buttons tags meta byline".split(),
    "comments": "comments comment commentlist discussion replies reply responses disqus respond thread reader".split(),
}
_INSIDE = "article content post entry story main body text page single blog news wrapper container column bd".split()
#: Words that say nothing of what a block is.
_ANYWHERE = "box slot bar wrap wrapper container section block area inner unit item list".split()


def sample_page(rng: random.Random) -> tuple[str, list[str]]:
    """A made-up page and the texts of its main blocks in order."""
    letters = rng.choice(["etaoinshrdlu", "enisratdhulcgmobwfkzäöü", "eaosrnidlctumpbgvyqhfzñó", "esaitnrulodcpmévqfbghàè", "аеионтсрвл", "kstnhmyrw"])
    vocab = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(120)]
    wrong = lambda: rng.random() < 0.25
    main: list[str] = []

    def words(low: int, high: int, stop: bool = True) -> str:
        text = " ".join(rng.choices(vocab, k=rng.randint(low, high)))
        text = text[:1].upper() + text[1:]
        if rng.random() < 0.1:
            text = " ".join(w + rng.choice(["***", "###", "$$$"]) for w in text.split())
        return text + (rng.choice([".", ".", "!", "?"]) if stop else "")

    def mark(kind: str) -> str:
        names = rng.sample(_AROUND[kind], k=rng.randint(1, 2)) + rng.sample(_ANYWHERE, k=rng.random() < 0.4)
        name = rng.choice([" ", "-", "_"]).join(names) + ("" if rng.random() < 0.7 else f" x{rng.randrange(999)}")
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def link(text: str) -> str:
        return f'<a href="/{rng.randrange(99)}">{text}</a>'

    def around(kind: str) -> str:
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "section", "p", "aside", "div"])
        tag = rng.choice(tag)
        own = tag == kind and rng.random() < 0.6
        attributes = "" if own else mark(kind)
        if kind == "nav":
            items = [link(words(1, 2, False)) for _ in range(rng.randint(2, 9))]
            inner = "".join(f"<li>{x}</li>" for x in items) if tag == "ul" else f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if rng.random() < 0.7 else " ".join(items)
        elif kind == "form":
            inner = f"<label>{words(1, 3, False)}</label><input name=q><select><option>{words(1, 2, False)}<option>{words(1, 2, False)}</select><textarea>{words(1, 6)}</textarea><button>{words(1, 2, False)}</button>"
            inner = f"<form>{inner}</form>" if tag == "div" else inner
        elif kind == "comments":
            item = rng.choice(["div", "li", "article", "p"])
            inner = rng.choice(["", f"<h3>{words(1, 3, False)}</h3>"]) + "".join(f"<{item}{rng.choice(['', mark('comments')])}><b>{words(1, 2, False)}</b> <p>{words(2, 45)}</p></{item}>" for _ in range(rng.randint(1, 5)))
        elif kind == "footer":
            inner = rng.choice([f"&copy; {words(2, 12)}", f"<p>{words(3, 20)}</p>", f"<ul><li>{link(words(1, 3, False))}</li><li>{link(words(1, 3, False))}</li></ul><p>&copy; {words(2, 8)}</p>"])
        elif kind == "aside":
            inner = rng.choice(["", f"<h{rng.randint(2, 4)}>{words(1, 4, False)}</h3>"]) + "".join(rng.choice([f"<p>{words(3, 40)}</p>", f"<ul><li>{link(words(2, 7, False))}</li><li>{link(words(2, 7, False))}</li></ul>"]) for _ in range(rng.randint(1, 3)))
        else:
            text = words(2, 40)
            inner = rng.choice([text, f"<p>{text}</p>", f"<span>{text}</span>", link(text)])
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def take(text: str) -> str:
        main.append(text)
        return text

    def block(heading_level: int) -> str:
        kind = rng.random()
        p_end = "" if wrong() else "</p>"
        if kind < 0.6:
            text = take(" | ".join(words(2, 40).split()) + " |" if rng.random() < 0.06 else words(1, rng.choice([3, 90, 90, 90, 90])))
            if rng.random() < 0.2:
                first, _, rest = text.partition(" ")
                return f"<p>{rng.choice([link(first), f'<b>{first}</b>', f'<em>{first}</em>'])} {rest}{p_end}"
            return f"<p>{'<b>' if rng.random() < 0.08 else ''}{text}{'<br>' if rng.random() < 0.1 else ''}{p_end}"
        if kind < 0.72:
            return f"<h{heading_level}>{take(words(1, 7, False))}</h{heading_level}>"
        if kind < 0.8:
            return "<ul>" + "".join(f"<li>{take(words(1, 14))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote>{take(words(4, 30))}</blockquote>"
        if kind < 0.9:
            return f"<pre>{take(words(2, 9))}</pre>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{take(words(1, 4, False))}</td><td>{take(words(1, 4, False))}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        return f"<div>{take(words(3, 40))}</div>"

    before = [around(rng.choice(["nav", "header", "ad", "notice", "form", "share", "aside"])) for _ in range(rng.randint(0, 4))]
    opening = rng.random()
    name = rng.choice(["-", " ", "_"]).join(rng.sample(_INSIDE, k=rng.randint(1, 2)))
    tag = "article" if opening < 0.55 else "main" if opening < 0.7 else rng.choice(["div", "section"])
    attributes = "" if opening < 0.5 else f' class="{name}"' if opening < 0.95 else f' class="c{rng.randrange(999)}"'
    inside = [f"<h1>{take(words(2, 9, False))}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 10)):
        inside.append(block(rng.randint(2, 4)))
        if rng.random() < 0.16:
            inside.append(around(rng.choice(["ad", "share", "notice", "aside", "form"])))
    if rng.random() < 0.15:
        inside.append(around("comments"))
    after = [around(rng.choice(["comments", "aside", "footer", "ad", "nav", "share", "form", "notice"])) for _ in range(rng.randint(0, 4))] + ([around("footer")] if rng.random() < 0.7 else [])
    bare = rng.random()
    if bare < 0.05:  # blocks alone
        return "".join(inside), main
    if bare < 0.12:  # lines parted by empty ones, between a line of links and a notice
        main.clear()
        said = [take(words(4, 60)) for _ in range(rng.randint(1, 8))]
        links = " | ".join(rng.choice([link, str])(words(1, 2, False)) for _ in range(rng.randint(2, 6)))
        said = [links] * (rng.random() < 0.7) + said + [f"{rng.choice(['&copy;', 'Copyright', '(c)', '\u00a9'])} {rng.choice(['', f'{rng.randrange(1990, 2030)} '])}{words(1, 5, False)}"] * (rng.random() < 0.6)
        body = rng.choice(["<br><br>", "<br/><br/>", "<br>\n<br>"]).join(said)
        return rng.choice([body, f"<html><body>{body}</body></html>"]), main
    article = "".join(inside) if bare < 0.18 else f"<{tag}{attributes}>{''.join(inside)}</{tag}>"
    wrapped = f'<div class="{rng.choice(["wrapper", "container", "page", "layout", "site"])}">{article}</div>' if rng.random() < 0.25 else article
    head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 8, False)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
    return f"{head}<body>{''.join(before)}<!-- c -->{wrapped}{''.join(after)}</body></html>", main


def labelled_page(rng: random.Random) -> tuple[list[Leaf], np.ndarray]:
    """The leaves of a made-up page and which of them are main text."""
    page, main = sample_page(rng)
    found, wanted, at = leaves(page), [" ".join(t.split()) for t in main], 0
    labels = np.zeros(len(found))
    for k, (_, text, _) in enumerate(found):
        if at < len(wanted) and text == wanted[at]:
            labels[k] = 1
            at += 1
    return found, labels


@cache
def trained(pages: int = PAGES, passes: int = PASSES, seed: int = 11) -> Labeller:
    """The labeller, fitted by Adam to ``pages`` made-up pages: the mean of its weights over the last passes."""
    rng, model = random.Random(seed), Labeller()
    made = [labelled_page(rng) for _ in range(pages)]
    made = [(leaf_vectors(found), y) for found, y in made if len(found) <= 120]
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step, steps, mean = 0, 0, {k: np.zeros_like(v) for k, v in model.p.items()}
    for n in range(passes):
        made.sort(key=lambda m: len(m[0]) + rng.random() * 8)
        groups = [made[k : k + 20] for k in range(0, len(made), 20)]
        rng.shuffle(groups)
        for group in groups:
            step += 1
            x, mask = _padded([v for v, _ in group])
            y = np.zeros(mask.shape)
            for k, (_, labels) in enumerate(group):
                y[: len(labels), k] = labels
            for k, g in model.gradients(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= 0.012 * (0.3 if n > passes * 0.7 else 1) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            if n > passes * 0.7:
                steps += 1
                mean = {k: v + model.p[k] for k, v in mean.items()}
    model.p = {k: v / max(1, steps) for k, v in mean.items()} if steps else model.p
    return model


def untagged(page: list[Leaf]) -> bool:
    return len(page) == 1 and not page[0][0]


def extract(pages: DataFrame, html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars``."""
    model = model or trained()
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            found = [leaves(x) for x in texts(batch.column(len(kept)))]
            out = [" ".join(leaf[1] for leaf, yes in zip(page, labels, strict=True) if yes or untagged(page)) for page, labels in zip(found, model.label(found), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*kept, "text", "n_chars"])

    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*kept, html_col).mapInArrow(lean(run), schema)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
