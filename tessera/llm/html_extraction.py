"""Main-text extraction: gradient-boosted trees score every DOM element, a tree-wide decoding picks what stays.

The trees (Spark ML) are fitted on pages put together from paragraphs of the table's own pages and page furniture in many
shapes, where the truth is known. Scores become a consistent choice by dynamic programming: an element can only stay if all
its ancestors stay, and the choice with the greatest total log-odds wins.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import dom
from tessera.llm.common import bounded_draw, stored, text_or_empty

#: Documented bounds of the fit: source pages drawn from the table, and training pages made of them.
SOURCE_PAGES, SOURCE_PARAGRAPHS, SOURCE_CHARS = 400, 60, 4000
TRAINING_PAGES = 1500
#: Share of training pages whose names mean nothing.
INVENTED = 0.25
#: Cells of attribute tokens: a token's cell is its CRC-32, a cell's odds of being content are learned.
CELLS = 1 << 12
#: Tokens of a cell count as so many more of either kind.
SHRINK = 3.0
#: Log-odds it takes to take an element out of a parent that stays.
PARTING = 1.0
TAGS = {
    "article": {"article"}, "main": {"main"}, "section": {"section"}, "div": {"div", "center", "body", "html", "#page"}, "p": {"p"},
    "heading": {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, "list": {"ul", "ol", "menu", "dl"}, "item": {"li", "dt", "dd"},
    "quote": {"blockquote", "pre", "figure", "figcaption"}, "table": {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, "nav": {"nav"},
    "aside": {"aside"}, "header": {"header"}, "footer": {"footer", "address"},
    "form": {"form", "fieldset", "legend", "label", "button", "select", "option"}, "dialog": {"dialog", "details", "summary"},
}
_TAG_NUMBER = {t: i for i, tags in enumerate(TAGS.values()) for t in tags}
FEATURES = (
    [f"tag_{t}" for t in TAGS]
    + ["own_sum", "own_min", "own_max", "own_unknown", "above_sum", "above_min", "above_max"]
    + ["above_nav", "above_aside", "above_header", "above_footer", "above_form", "above_article", "hidden"]
    + ["depth", "log_text", "log_own", "share", "link_share", "log_links", "stops", "words_a_block", "log_children", "text_a_tag", "log_siblings", "same_siblings", "parent_share"]
)
_ABOVE_TAGS = ("nav", "aside", "header", "footer", "form", "article")


def cell_of(token: str) -> int:
    return zlib.crc32(token.encode()) % CELLS


def tokens_of(tag: str, words: tuple[str, ...]) -> set[str]:
    """An element's attribute tokens, with its tag as one more."""
    return {f"<{tag}>", *words}


def features(page: dom.Page, odds: np.ndarray) -> np.ndarray:
    """One row for each element, in the order of FEATURES; odds: a number for each cell of attribute tokens, 0 for unknown ones.

    own_*: sum, least, greatest odds and number of unknown ones of the element's own tokens; above_*: of its ancestors' sums.
    """
    n = len(page.tag)
    parent = np.array(page.parent)
    tag = np.array([_TAG_NUMBER.get(t, 3) for t in page.tag])
    one_tag = np.zeros((n, len(TAGS)))
    one_tag[np.arange(n), tag] = 1
    own_odds = np.zeros((n, 4))
    for i, words in enumerate(page.words):
        o = odds[[cell_of(w) for w in tokens_of(page.tag[i], words)]]
        own_odds[i] = o.sum(), min(0.0, o.min()), max(0.0, o.max()), (o == 0).sum()
    own, stops, blocks = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, text in page.blocks:
        own[i] += len(text)
        stops[i] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
        blocks[i] += 1
    total = np.stack([own, stops, blocks, np.minimum(np.array(page.linked, float), own), np.array(page.links, float), np.ones(n)], axis=1)
    children = np.zeros(n)
    first_tag: dict[tuple[int, int], int] = {}
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        children[parent[i]] += 1
        key = (page.parent[i], int(tag[i]))
        first_tag[key] = first_tag.get(key, 0) + 1
    above = np.zeros((n, 3))
    above_tag = np.zeros((n, len(_ABOVE_TAGS)))
    columns = [list(TAGS).index(t) for t in _ABOVE_TAGS]
    for i in range(1, n):
        p = parent[i]
        above[i] = above[p, 0] + own_odds[p, 0], min(above[p, 1], own_odds[p, 0]), max(above[p, 2], own_odds[p, 0])
        above_tag[i] = np.maximum(above_tag[p], one_tag[p, columns])
    siblings = np.r_[1, children[parent[1:]]] if n > 1 else np.ones(1)
    same = np.array([1.0] + [first_tag[(page.parent[i], int(tag[i]))] for i in range(1, n)]) / np.maximum(1, siblings)
    text = np.maximum(total[:, 0], 1)
    rest = np.stack(
        [
            np.array(page.depth, float), np.log1p(total[:, 0]), np.log1p(own), total[:, 0] / max(1.0, total[0, 0]), total[:, 3] / text, np.log1p(total[:, 4]),
            100 * total[:, 1] / text, total[:, 0] / np.maximum(1, total[:, 2]) / 6, np.log1p(children), np.log1p(total[:, 0] / total[:, 5]),
            np.log1p(siblings), same,
            np.r_[1.0, total[1:, 0] / np.maximum(1, total[parent[1:], 0])],
        ],
        axis=1,
    )
    hidden = np.array(page.hidden, float)[:, None]
    return np.concatenate([one_tag, own_odds, above, above_tag, hidden, rest], axis=1)


@dataclass(frozen=True)
class Forest:
    """Trees as nested tuples (feature, threshold, left, right) or a leaf's value, with weights, the sum is half a log-odds; and the
    odds of attribute tokens by cell."""

    trees: tuple
    weights: tuple[float, ...]
    odds: np.ndarray

    def kept(self, page: dom.Page) -> np.ndarray:
        return decode(page, self.logits(features(page, self.odds)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        def value(tree, rows):
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            left = x[rows, tree[0]] <= tree[1]
            out = np.empty(len(rows))
            out[left], out[~left] = value(tree[2], rows[left]), value(tree[3], rows[~left])
            return out

        every = np.arange(len(x))
        return 2 * sum(w * value(t, every) for t, w in zip(self.trees, self.weights))


def forest_of(description: str, odds: np.ndarray) -> Forest:
    """Read a fitted model's toDebugString."""
    weights, trees, lines = [], [], []

    def tree(rows: list[str]):
        line = rows.pop(0)
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, threshold = re.search(r"feature (\d+) <= (\S+?)\)", line).groups()
        left = tree(rows)
        assert rows.pop(0).startswith("Else")
        return int(feature), float(threshold), left, tree(rows)

    for line in description.splitlines():
        if m := re.match(r"\s*Tree \d+ \(weight (\S+)\):", line):
            weights.append(float(m[1]))
            lines.append([])
        elif lines and line.strip():
            lines[-1].append(line.strip())
    trees = [tree(rows) for rows in lines]
    return Forest(tuple(trees), tuple(weights), odds)


def decode(page: dom.Page, logits: np.ndarray) -> np.ndarray:
    """Which elements stay: the choice with the largest total in which nothing stays below what goes.

    The total is the elements' log-odds, less PARTING for each element that goes although its parent stays.
    """
    n = len(page.tag)
    weight = np.clip(logits, -6, 6)
    stay, go = weight.copy(), -weight
    for i in range(n - 1, 0, -1):
        stay[page.parent[i]] += max(stay[i], go[i] - PARTING)
        go[page.parent[i]] += go[i]
    kept = np.zeros(n, bool)
    kept[0] = True  # the page itself is no element
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and stay[i] >= go[i] - PARTING
    return kept


# --- training pages --------------------------------------------------------------------------------------------------

# Words that class, id and role attributes of training pages are made of. What they mean is learned, not looked up.
NAMES = {
    "text": "article content main post entry story body text prose markdown news articulo contenido cuerpo texto noticia artikel inhalt corps texte contenu".split(),
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc tabs pagination pager links navegacion migas navi ariane".split(),
    "head": "header masthead topbar logo branding banner cabecera kopf kopfzeile encabezado entete".split(),
    "foot": "footer foot copyright colophon contentinfo legal bottom imprint pie impressum fuss pied mentions".split(),
    "side": "sidebar side aside widget widgets rail related recommended trending popular tags lateral relacionados seitenleiste barre".split(),
    "notice": "cookie cookies consent gdpr notice notices privacy alert warning popup modal overlay toast paywall announcement disclaimer aviso hinweis avis".split(),
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted adsense teaser publicidad anuncio werbung anzeige publicite".split(),
    "form": "form subscribe subscription newsletter signup login signin register search contact field buscar formulario suche anmeldung recherche".split(),
    "comment": "comment comments commentlist reply replies discussion disqus respond thread responses reviews feedback comentarios kommentare commentaires".split(),
    "share": "share sharing social follow toolbar actions buttons compartir teilen partager".split(),
}
_NEUTRAL = "page site wrapper container inner outer box block area item row col left right top wide group unit layout".split()
_ELEMENTS = {
    "menu": ["nav", "nav", "ul", "div", "header"], "head": ["header", "header", "div"], "foot": ["footer", "footer", "div", "section"], "side": ["aside", "aside", "div", "section"],
    "notice": ["div", "section", "aside", "p", "dialog"], "advert": ["div", "aside", "section", "p"], "form": ["form", "form", "div"], "comment": ["section", "div", "ol", "ul"],
    "share": ["div", "ul"],
}
#: Kinds whose own element tells them apart without a name.
_TELLING = {"nav", "header", "footer", "aside", "form", "dialog"}


def _name(kind: str, rng: random.Random, invented: bool) -> str:
    """A name of the kind: one of its words, often with a neutral one; or letters that mean nothing."""
    if invented:
        return "".join(rng.choices("abcdefghijklmnoprstuvwxyz", k=rng.randint(2, 7))) + rng.choice(["", "-x", "_a", "1"])
    words = [rng.choice(NAMES[kind])]
    if rng.random() < 0.4:
        words.insert(rng.randint(0, 1), rng.choice(_NEUTRAL))
    return rng.choice(["-", "-", "_", " "]).join(words)


def _element(kind: str, inner: str, rng: random.Random, invented: bool) -> str:
    # a block inside would end a paragraph, and stand outside of what is marked
    tag = rng.choice([t for t in _ELEMENTS[kind] if t != "p" or not re.search("<(p|ul|div|h[1-6]|button)\\b", inner)])
    named = "" if tag in _TELLING and rng.random() < 0.5 else f' {rng.choice(["class", "class", "id"])}="{_name(kind, rng, invented)}"'
    return f'<{tag}{named} data-mark="0">{inner}</{tag}>'


def training_page(texts: list[str], others: list[str], rng: random.Random) -> str:
    """A page whose article holds texts; furniture takes its words from others. data-mark tells content (1) from the rest.

    On a share of the pages names mean nothing; what could then not be told from text (adverts, notices and comments) is left out there.
    """
    invented = rng.random() < INVENTED

    def some(n: int) -> str:
        words = rng.choice(others).split() or ["x"]
        at = rng.randrange(len(words))
        return escape(" ".join(words[at : at + n]) or "x")

    def prose() -> str:
        return escape(rng.choice(others))

    def links(n: int) -> str:
        item = rng.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<div><a href='/x'>{}</a></div>"])
        body = "".join(item.format(some(rng.randint(1, 3))) for _ in range(n))
        return f"<ul>{body}</ul>" if item.startswith("<li>") else body

    def furniture(kind: str) -> str:
        if invented and kind in ("notice", "advert", "comment"):
            kind = rng.choice(["menu", "share", "form"])
        if kind == "menu":
            return _element(kind, links(rng.randint(2, 9)), rng, invented)
        if kind == "head":
            return _element(kind, rng.choice([f"<h1>{some(3)}</h1>", f"<a href='/'>{some(2)}</a>", f"<div class='logo'>{some(2)}</div><p>{some(6)}</p>"]) + (links(4) if rng.random() < 0.5 else ""), rng, invented)
        if kind == "foot":
            return _element(kind, rng.choice([f"&copy; {some(3)} &middot; {some(10)}", f"<p>{some(12)}</p>" + links(3), some(20)]), rng, invented)
        if kind == "side":
            return _element(kind, rng.choice([f"<h3>{some(2)}</h3>" + links(5), f"<h4>{some(3)}</h4><p>{some(25)}</p>", f"<p>{prose()}</p>"][: 1 if invented else 3]), rng, invented)
        if kind in ("notice", "advert"):
            body = some(rng.randint(4, 40)) if rng.random() < 0.8 else prose()
            return _element(kind, rng.choice([body, f"<p>{body}</p>", f"<p>{body}</p><button>{some(1)}</button>", f"{body} <a href='/x'>{some(2)}</a>"]), rng, invented)
        if kind == "form":
            return _element(kind, f"<label>{some(2)}</label><input name='q'><p>{some(rng.randint(3, 15))}</p><button>{some(1)}</button>", rng, invented)
        if kind == "comment":
            one = rng.choice(["<li><b>{0}</b><p>{1}</p></li>", "<div class='comment'><span>{0}</span><p>{1}</p></div>", "<article class='comment'><h4>{0}</h4><p>{1}</p></article>", "<p>{1}</p>"])
            body = "".join(one.format(some(1), prose() if rng.random() < 0.6 else some(12)) for _ in range(rng.randint(1, 6)))
            return _element(kind, rng.choice([f"<h2>{some(1)}</h2>", f"<h3>{some(2)}</h3>", ""]) + body, rng, invented)
        return _element(kind, links(rng.randint(2, 5)), rng, invented)

    inside = []
    if rng.random() < 0.8:
        title = escape(" ".join(rng.choice([texts[0], rng.choice(texts)]).split()[: rng.randint(1, 12)]))
        head = rng.choice(["{}", "{}", "{}", '<header data-mark="1">{}</header>', '<div class="article-header" data-mark="1">{}</div>'])
        inside.append(head.format(f'<h1 data-mark="1">{title}</h1>'))
        if rng.random() < 0.3:
            inside.append(f'<p data-mark="1"><b>{title}<br>')
    shape = rng.random()
    for t in texts:
        t = escape(t)
        r = rng.random()
        if shape < 0.12:
            inside.append(f'<div data-mark="1">{t}</div>')
        elif r < 0.05:
            inside.append(f'<h2 data-mark="1">{t[:60]}</h2>')
        elif r < 0.1:
            inside.append('<ul data-mark="1">' + "".join(f'<li data-mark="1">{x}</li>' for x in t.split(". ")[:6]) + "</ul>")
        elif r < 0.14:
            inside.append(f'<blockquote data-mark="1">{t}</blockquote>')
        elif r < 0.16:
            inside.append('<table data-mark="1"><tr>' + "".join(f'<td data-mark="1">{x}</td>' for x in t.split(", ")[:4]) + "</tr></table>")
        elif r < 0.25:
            inside.append(f'<p data-mark="1"><b>{t}<br>')
        elif r < 0.3:
            inside.append(f'<p data-mark="1">{t} <a href="/x">{t[:20]}</a></p>')
        elif r < 0.34:
            inside.append(f'<p data-mark="1">{t[: rng.randint(2, 60)]}</p>')
        else:
            inside.append(f'<p data-mark="1">{t}</p>')
        if rng.random() < 0.06:
            inside.append(furniture(rng.choice(["advert", "notice", "side", "share", "form"])))
    if rng.random() < 0.15:
        inside.append(furniture("comment"))
    body = "".join(inside)
    kind = rng.choice(["article", "article", "main", "div", "div", "div", "section", "", ""])
    if kind:
        name = "" if rng.random() < 0.25 else _name("text", rng, invented)
        if name and rng.random() < 0.15:  # a word that elsewhere names furniture
            name = " ".join(rng.sample([name, rng.choice(NAMES[rng.choice(["head", "side", "notice", "share"])]) + "-" + rng.choice(NAMES["text"])], 2))
        body = f'<{kind}{f" class={chr(34)}{name}{chr(34)}" if name else ""} data-mark="1">{body}</{kind}>'
    if rng.random() < 0.4:
        more = furniture(rng.choice(["side", "comment", "menu"])) if rng.random() < 0.6 else ""
        wrap = rng.choice(["main", "div", 'div class="container"', 'div id="page"', 'div class="wrapper"'])
        body = f"<{wrap}>{body}{more}</{wrap.split()[0]}>"
    front = "".join(furniture(k) for k in ("notice", "head", "menu", "advert", "form", "side", "share") if rng.random() < 0.5)
    back = "".join(furniture(k) for k in ("comment", "side", "share", "form", "advert", "notice", "menu", "foot") if rng.random() < 0.5)
    return f"<!DOCTYPE html><html><head><title>{some(4)}</title></head><body>{front}{body}{back}</body></html>"


def labels_of(page: dom.Page) -> np.ndarray:
    """1: holds content; 0: holds text, none of it content; -1: holds no text."""
    n = len(page.tag)
    content, text = np.zeros(n), np.zeros(n)
    mark = [False] * n
    for i in range(1, n):
        own = page.mark[i]
        mark[i] = own == "1" or (own == "" and mark[page.parent[i]])
    for i, block in page.blocks:
        text[i] += len(block)
        content[i] += len(block) * mark[i]
    for i in range(n - 1, 0, -1):
        text[page.parent[i]] += text[i]
        content[page.parent[i]] += content[i]
    return np.where(text == 0, -1, (content > 0).astype(int))


def _paragraphs(source: str) -> list[str]:
    return [t for _, t in dom.read(source).blocks if len(t) > 40]


def training_pages(pools: list[list[str]], seeds: Iterator[int]) -> Iterator[tuple[dom.Page, np.ndarray]]:
    """A page for each seed, made of the paragraphs of other pages, and the labels of its elements."""
    pools = pools or [["No page of this table has any text, so this one stands in for it."]]
    for seed in seeds:
        rng = random.Random(seed)
        own = rng.choice(pools)
        k = min(len(own), rng.choice([1, 2, 3, 5, 8, 12]))
        page = dom.read(training_page(rng.sample(own, k), rng.choice(pools), rng))
        yield page, labels_of(page)


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", seed: int = 5) -> Forest:
    """Fit the trees on TRAINING_PAGES pages made from at most SOURCE_PAGES of the table, drawn by hash (a bound, not a share)."""
    spark = pages.sparkSession
    known = pages.filter(F.col(html_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))

    def paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pools = [[t[:SOURCE_CHARS] for t in _paragraphs(h)[:SOURCE_PARAGRAPHS]] for h in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"], "pool": pools})

    ids = [r["id"] for r in bounded_draw(known.select("id"), "id", SOURCE_PAGES, seed).collect()]
    drawn = known.filter(F.col("id").isin(ids)).mapInPandas(paragraphs, "id long, pool array<string>").orderBy("id", "pool").limit(SOURCE_PAGES)
    pools = [list(r["pool"]) for r in drawn.collect() if r["pool"]]
    shipped = spark.sparkContext.broadcast(pools)  # at most SOURCE_PAGES x SOURCE_PARAGRAPHS x SOURCE_CHARS characters

    def made_of(ids):
        return training_pages(shipped.value, [seed * 1_000_003 + int(i) for i in ids])

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i % 2, cell_of(w), int(k)) for i, (page, y) in zip(pdf["id"], made_of(pdf["id"])) for tag, words, k in zip(page.tag, page.words, y) if k >= 0 for w in tokens_of(tag, words)]
            yield pd.DataFrame(rows, columns=["fold", "cell", "label"], dtype="int64")

    numbers = spark.range(0, TRAINING_PAGES, 1, 6)
    # at most 2 x 2 x CELLS rows
    seen = numbers.mapInPandas(tokens, "fold long, cell long, label long").groupBy("fold", "cell", "label").count().collect()
    counts = np.zeros((2, 2, CELLS))
    for r in seen:
        counts[r["fold"], r["label"], r["cell"]] = r["count"]

    def odds_of(c: np.ndarray) -> np.ndarray:
        return np.log(c[1] + SHRINK) - np.log(c[0] + SHRINK)

    # a page's features come from the other half's odds, or trees would trust names that only this page has
    halves = [odds_of(counts[1]), odds_of(counts[0])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(features(page, halves[i % 2])[y >= 0], y[y >= 0]) for i, (page, y) in zip(pdf["id"], made_of(pdf["id"]))]
            x, y = zip(*made)
            yield pd.DataFrame({"x": list(np.concatenate(x)), "label": np.concatenate(y).astype(float)})

    made = stored(numbers.mapInPandas(run, "x array<double>, label double"), "training")
    rows = made.select(array_to_vector("x").alias("features"), "label").coalesce(4)
    model = GBTClassifier(maxIter=50, maxDepth=4, stepSize=0.3, minInstancesPerNode=10, subsamplingRate=0.8, seed=seed, featuresCol="features").fit(rows)
    return forest_of(model.toDebugString, odds_of(counts.sum(axis=0)))


def _extracted(forest: Forest):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                read = [dom.read(h) for h in part["html"]]
                x = [features(p, forest.odds) for p in read]
                edges = np.cumsum([0, *map(len, x)])
                logits = forest.logits(np.concatenate(x))
                texts = []
                for p, a, z in zip(read, edges[:-1], edges[1:]):
                    kept = decode(p, logits[a:z])
                    texts.append("\n".join(t for i, t in p.blocks if kept[i]))
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", forest: Forest | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page from its whole html.

    Null or empty html, and pages without article, give an empty text. Null ids and urls are handed through; repeated rows
    give a row each; other columns are ignored. Without a forest, one is fitted on the table's own pages.
    """
    forest = forest or fit(pages, html_col, id_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInPandas(_extracted(forest), "page_id long, url string, text string, n_chars long")
