"""Main text of web pages by a maximum-scoring subsequence of words and tags.

Words score positive and tags negative. What surrounds a word - element names, words of
class, id and role, whether it stands in the page's own <article> or <main> - are cues with
learned weights: the log odds of a word under the cue being content on pages that label
their article, against all words. Where the cues of a word add up to less than zero it is
left out. Cues that no labelled page holds keep a weak prior.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "title", "math", "canvas")
ASIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button")
BLOCK = (
    "address article blockquote body center dd details div dl dt fieldset figure h1 h2 h3 h4 h5 h6 head hr html li main ol p pre section summary table tbody td tfoot th thead tr ul"
).split() + list(ASIDE)
VOID = "area base br col embed hr img input link meta source track wbr".split()
# Words in class, id or role that mark what is not the article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|header|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*|related|reply|replies|responses?|share|sharing|sidebar|site-?header|site-?footer|social|sponsor\w*|subscribe|toolbar|widget|alert)(?:$|[\s_-])"
)
LABEL = ("article", "main")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|</?[a-zA-Z][^<]*\Z|</?\Z", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
ENDS = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
CLASS_WORD = re.compile(r"[^\W\d_]{2,}")
# Elements whose bare name is a cue; that of a text block (p, li, h1) is a tag and costs where it stands.
CONTAINERS = {"div", "section", "body", "center", "details", "fieldset", "figure", "span", "td", *ASIDE}
INSIDE, OUTSIDE, LISTED = "#inside", "#outside", "#listed"
WORD_SCORE, TAG_SCORE, ASIDE_SCORE = 1.0, -0.4, -0.25
# Weights before any page is seen, and how far a weight reaches; weaker ones than ``WEAK`` decide nothing.
PRIOR = {INSIDE: 2.0, OUTSIDE: -4.0, LISTED: -4.0, **dict.fromkeys(ASIDE, -4.0)}
LOW, HIGH, WEAK = -6.0, 2.0, 1.0
Run = tuple[str, str, tuple[str, ...], bool]


def tokens(page: str, listed: bool = True) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """(kind, value, cues): text runs and tags ('open' or 'close' with a lower-case name).

    Comments, declarations and the contents of elements that hold no prose are left
    out; an unfinished tag at the end is dropped. A linear scan. With ``listed`` the
    fixed words of class, id or role give a cue of their own.
    """
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], ()
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ()
        at, tag = m.end(), m.group()
        named = NAME.match(tag)
        if not named or not tag.endswith(">"):
            continue
        name = named.group(1).lower()
        if tag[1] == "/":
            yield "close", name, ()
        elif name in ENDS:
            end = ENDS[name].search(page, at)
            at = end.end() if end else n
        else:
            yield "open", name, cues(name, tag, listed)
            if tag.endswith("/>"):
                yield "close", name, ()


def cues(name: str, tag: str, listed: bool) -> tuple[str, ...]:
    """What an element says about the words in it."""
    said = [v.strip("\"'").lower() for v in ROLE.findall(tag)] if len(tag) > len(name) + 2 else []
    words = [f".{w}" for v in said for w in CLASS_WORD.findall(v)]
    own = [name] if name in ASIDE or name in CONTAINERS and not words else []
    return (*own, *words, *([LISTED] if listed and any(MARKED.search(v) for v in said) else []))


def runs(page: str, listed: bool = True) -> list[Run]:
    """Tokens with the cues of all elements around them, and whether a labelled one (article or main) is among these."""
    out, stack = [], []
    for kind, value, own in tokens(page, listed):
        if kind == "open" and value not in VOID:
            around, labelled = stack[-1][1:] if stack else ((), False)
            if value == "header" and labelled:  # an article's own header is part of it
                own = tuple(c for c in own if c != "header")
            stack.append((value, around + own, labelled or value in LABEL))
        elif kind == "close":
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == value), None)
            if where is not None:
                del stack[where:]
        out.append((kind, value, *(stack[-1][1:] if stack else ((), False))))
    return out


def judged(around: tuple[str, ...], weights: dict[str, float]) -> float:
    """The cues of a word together: the best one for, at most ``HIGH``, and all against."""
    got = [weights.get(c, PRIOR.get(c, 0.0)) for c in set(around)]
    return min(HIGH, max([0.0, *(w for w in got if w >= WEAK)])) + sum(w for w in got if w <= -WEAK)


def placed(parsed: list[Run], weights: dict[str, float]) -> list[float]:
    """What the cues around each token come to.

    The page says where its article is if labelled elements that other cues do not speak
    against hold over half of the words that nothing speaks against; then standing inside
    or outside of them is a cue too.
    """
    known: dict[tuple[str, ...], float] = {}
    alone = [known[c] if (c := run[2]) in known else known.setdefault(c, judged(c, weights)) for run in parsed]
    held = [0, 0]
    for (kind, value, _, label), score in zip(parsed, alone, strict=True):
        if kind == "text" and score >= 0:
            held[label] += len(value.split())
    if held[1] <= held[0]:
        return alone
    both: dict[tuple[tuple[str, ...], bool], float] = {}
    out = []
    for _, _, around, label in parsed:
        if (around, label) not in both:
            both[around, label] = judged((*around, INSIDE if label else OUTSIDE), weights)
        out.append(both[around, label])
    return out


def evidence(page: str | None) -> Counter:
    """Counts (cue, '<tag' or '#word', content or not) of a page that labels its article.

    Content is what stands in the label and no prior cue speaks against.
    """
    seen: Counter = Counter()
    parsed = runs(page or "")
    scores = placed(parsed, {})
    if any(label and score > 0 for (*_, label), score in zip(parsed, scores, strict=True)):
        for (kind, value, around, label), score in zip(parsed, scores, strict=True):
            content = label and score > 0
            if kind == "text":
                for c in {*around, INSIDE if label else OUTSIDE, "#word"}:
                    seen[c, content] += len(value.split())
            elif kind == "open":
                seen[f"<{value}", content] += 1
    return seen


def fit_weights(pages: DataFrame, max_pages: int = 20_000, min_pages: int = 2) -> dict[str, float]:
    """Weights of words, tags and cues from pages that label their article themselves.

    Word and tag scores are log odds of standing inside and outside of content, clipped so
    that words stay positive and tags negative; those of cues are relative to all words.
    The sample of labelled pages, chosen by a hash of the page id, has about ``max_pages``
    pages at most; tokens of fewer than ``min_pages`` of its pages are not kept.
    """
    labelled = pages.select("page_id", F.col("html").cast("string").alias("html")).where(F.lower("html").rlike("<(article|main)"))
    share = min(1.0, max_pages / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64(F.col("page_id"), F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: Counter = Counter()
            on: Counter = Counter()
            for page in b["html"]:
                got = evidence(page)
                total.update(got)
                on.update({token for token, _ in got})
            yield pd.DataFrame([(k, total[k, True], total[k, False], n) for k, n in on.items()], columns=["token", "yes", "no", "pages"])

    sums = sample.select("html").mapInPandas(count, "token string, yes long, no long, pages long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("yes", "no", "pages")))
    found = {r["token"]: (r["yes"], r["no"]) for r in sums.where(F.col("pages") >= min_pages).collect()}
    odds = {k: math.log((yes + 1) / (no + 1)) for k, (yes, no) in found.items()}
    usual = odds.get("#word", 0.0)
    out = {}
    for k, v in odds.items():
        if k == "#word":
            out[k] = min(3.0, max(0.5, v))
        else:
            out[k] = min(-0.25, max(LOW, v - 2)) if k[0] == "<" else min(HIGH, max(LOW, v - usual))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum, by one scan (the first, if tied)."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float], listed: bool = True) -> str:
    """Blocks of the best-scoring region, joined by two new lines ('' for a page without one)."""
    parsed = runs(page or "", listed)
    around = placed(parsed, weights)
    labels = any(label and score > 0 for (*_, label), score in zip(parsed, around, strict=True))
    outside = weights.get(OUTSIDE, PRIOR[OUTSIDE])
    scores = []
    for (kind, value, _, label), score in zip(parsed, around, strict=True):
        if kind != "text":
            scores.append(weights.get(f"<{value}", TAG_SCORE) if value in BLOCK and not (labels and label) and score >= 0 else -0.05)
        elif score >= 0:
            scores.append(weights.get("#word", WORD_SCORE) * len(value.split()))
        elif labels:  # left out wherever it stands; in the labelled part it hardly splits a region
            scores.append(0.0 if label else outside * len(value.split()))
        else:
            scores.append(ASIDE_SCORE * len(value.split()))
    start, end = best_region(scores)
    blocks, now = [], []
    for (kind, value, _, _), score in zip(parsed[start:end], around[start:end], strict=True):
        if kind == "text":
            if score >= 0:
                now.append(value)
        elif value in BLOCK:
            blocks.append("".join(now))
            now = []
        elif value == "br":
            now.append(" ")
    blocks.append("".join(now))
    tidy = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in tidy if b)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, listed: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (null html: empty text).

    Pages are independent rows, so nothing is shuffled; whole pages are read, however
    long. Of regions that tie the first is taken. Repeated rows give repeated rows; other
    columns, of any name, are ignored; an empty table gives an empty result.
    """
    shared = fit_weights(pages) if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(p if isinstance(p, str) else None, shared, listed) for p in b["html"]]
            yield b[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
