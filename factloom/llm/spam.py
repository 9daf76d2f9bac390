"""Keyword-stuffed pages, link lists and heaps of tags among documents.

A text is a sequence of terms: words, links and tags. Its segments (lines and sentences) are joined to sections of one
shape: sentences, code, reports, or neither. In each section the terms' recurrence gaps and the positional
autocorrelation over lag windows are measured. A section is stuffed if its content words recur unnaturally often and
close, or regularly, or if links and tags recur as its beat; what recurs little is a list if nearly all of it is
distinct terms without function words and without the shape of sentences. A page is spam if most of it is such
sections. Code and reports repeat themselves by nature and are measured by none of this.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from factloom.llm.common import spread
from factloom.session import table

# Common function words of English, German, French, Spanish, Italian, Dutch and Portuguese.
FUNCTION_WORDS = frozenset(
    """a about after all although am an and another any are as at be because been before but by can could did do does each either every few from had has have he her him his how i if in into is it its may might more most
    must neither no nobody nor not of off on once one only or other our out over she should since so some such than that the their them then there these they this those though through to two under unless until up was we
    were what when where whether which while who whom whose why will with within without would you your
    aber alle als am an auch auf aus bei bevor bis damit dann das dass dem den der des die dies diese dieser doch durch ein eine einem einen einer eines er es für gegen hat ich ihr im in ist ja jede jeder jedes kann kein
    keine man mehr mit nach nachdem nicht noch nun nur ob obwohl oder ohne sein sich sie sind so solange um und uns unter vom von vor wann war was weil wenn wer werden wie wird wir wo zu zum zur zwei über
    le la les un une des du et est dans que qui pour pas sur avec ce sont par el los las y en del una con por para se il lo gli che di per non della nel het een van dat niet zijn voor o os as um uma não com
    """.split()
)
_HTML = re.compile(r"<(/?)(a|li|ul|ol|p|br|div|tr|td|th|table|h[1-6]|span|b|i|em|strong|nav|section|footer|header|img|html|head|body|title)\b[^<>]*>", re.I)
_MARKDOWN = re.compile(r"!?\[([^\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|\b[a-z0-9][a-z0-9-]*\.(?:com|net|org|io|dev|app|info|biz|shop|example|test|online|site|top|xyz|club|store|ru|cn|de|fr|uk|eu)\b(?:/[^\s<>\"')\]]*)?", re.I)
_HOST = re.compile(r"\.(?:com|net|org|io|dev|app|info|biz|shop|example|test|online|site|top|xyz|club|store|ru|cn|de|fr|uk|eu)\b|www\.|://", re.I)
_SPLIT = re.compile(r"[\r\n]+|(?<=[.!?…])\s+(?=[^\W\d_a-zäöü]|[\"'`*_\[(])|(?<=[。！？।])")
_WORD = re.compile(r"[^\W\d_]+")
_TERM = re.compile(r"[^\W\d_]+|␟|#(?=\w\w)")
_CODE = re.compile(r"^\s*(?:import|from|func|let|var|case|return|class|struct|enum|protocol|extension|def|public|private|static|final|override|fileprivate|internal|@\w+|#(?:include|define|if|else|endif|ifdef|ifndef)|}|{|//|/\*|\*/?(?:\s|$)|typedef|guard|switch|default:|break\b|\$ |>>> |\+\+\+ |--- |@@ )")
_REPORT = re.compile(r"^\s*(?:\[?\d{1,4}[-:.]\d{2}[-:.\d T]*\]?\s|[\w./+-]+:\d+(?::\d+)?:|(?:error|warning|note|info|debug|exit|failed|passed|test case|build)\b[:\s]|[-*]?\s*\d+[.)]?\s*$)", re.I)
_LINK = "␟"
_SIGNS = re.compile(r"[{}();=\[\]\"]")
_SEPARATED = re.compile(r"[|·•;/]|>>|,|\s[-–—]\s")
_LEAD = re.compile(r"^[\s\"'`*_(\[>#¿¡«„“-]*")
_END = re.compile(r"[.!?…。！？।؟][\"'`*_)\]»“”]*\s*$")

#: A segment of sentences holds function words from this share on; a list holds fewer than half of it.
SENTENCE_SHARE = 0.12
#: Terms of a lag window. Recurrences are looked for inside one window, lags up to half of it.
WINDOW = 1024
#: A gap up to this many terms is a close recurrence; in sentences, which may be repeated as a whole, a shorter one.
CLOSE, CLOSE_IN_SENTENCES = 32, 8
#: Fewer terms than this are no heap.
LEAST_TERMS = 12
#: Links and tags are the beat of a section if the gaps between them have at most this mean.
MARK_GAP = 8


@dataclass
class Segment:
    shape: str  # sentence, code, report or heap
    letters: int
    terms: list[str]  # words in small letters, ␟ for a link, # before the words of a tag
    words: int
    links: int
    tags: int


def _shaped(s: str, n: int) -> bool:
    """The outer shape of a sentence in any language: a capital (or a letter without case) first, small letters after
    it, a full stop, few separators. It stands in for function words in languages that are not listed."""
    if n < 4 or not _END.search(s):
        return False
    lead = s[_LEAD.match(s).end() :][:1]
    if not lead or lead.lower() == lead and lead.upper() != lead or lead.isdigit():
        return False
    rest = _WORD.findall(s)[1:]
    small = sum(w[0].lower() == w[0] for w in rest)
    return small * 10 >= 7 * len(rest) and len(_SEPARATED.findall(s)) * 5 <= n


def segments(text: str) -> list[Segment]:
    if "<" in text and _HTML.search(text):
        text = _HTML.sub(lambda m: f" {_LINK} " if m.group(2).lower() == "a" and not m.group(1) else "\n" if m.group(2).lower() in ("p", "br", "div", "tr", "table", "ul", "ol", "h1", "h2", "h3") else " ", text)
    if "](" in text:
        text = _MARKDOWN.sub(rf"\1 {_LINK} ", text)
    if _HOST.search(text):
        text = _URL.sub(f" {_LINK} ", text)
    out = []
    fences = text.count("```") >= 2
    code = False
    for s in _SPLIT.split(text):
        if fences and s.lstrip().startswith("```"):
            code = not code
            continue
        terms = _TERM.findall(s.lower())
        if not terms:
            continue
        links, tags = terms.count(_LINK), terms.count("#")
        n = len(terms) - links - tags
        f = sum([w in FUNCTION_WORDS for w in terms])
        few = tags * 2 <= n and links * 3 <= n
        if code:
            shape = "code"
        elif f >= SENTENCE_SHARE * n and f and few:
            # Names such as a and in stand in code as well.
            shape = "sentence" if _END.search(s) or not (_CODE.match(s) or _REPORT.match(s) or len(_SIGNS.findall(s)) * 4 > n) else "code"
        elif _REPORT.match(s):
            shape = "report"
        elif not links and not tags and (_CODE.match(s) or len(_SIGNS.findall(s)) * 4 > n):
            shape = "code"
        elif few and _shaped(s, n):
            shape = "sentence"
        else:
            shape = "heap"
        out.append(Segment(shape, sum(map(len, terms)) + 9 * links - tags, terms, n, links, tags))
    return out


@dataclass
class Beat:
    """What the recurrences of a section's terms show; shares are of its content words."""

    recurrence: float = 0.0  # words that stand in the same lag window before
    close: float = 0.0  # words that recur within CLOSE terms
    dense: float = 0.0  # words that recur within CLOSE_IN_SENTENCES terms
    regularity: float = 0.0  # 1 less the coefficient of variation of a word's gaps, weighted by its recurrences
    periodicity: float = 0.0  # the strongest autocorrelation at one lag less the mean over all lags
    distinct: float = 0.0


def beat(words: list[str]) -> Beat:
    """Recurrence gaps and positional autocorrelation of the content words of a section, in lag windows of WINDOW words;
    the measures of the windows are weighted by their words. Function words recur in any text and leave a hole."""
    total = Beat()
    n_all = 0
    codes: dict[str, int] = {}
    ids_all = np.array([-1 if w in FUNCTION_WORDS else codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    for at in range(0, len(ids_all), WINDOW):
        # A short rest joins the window before it.
        ids = ids_all[at:] if len(ids_all) - at < 2 * WINDOW else ids_all[at : at + WINDOW]
        places = np.flatnonzero(ids >= 0)
        n = len(places)
        if n >= 4:
            own = ids[places]
            order = np.argsort(own, kind="stable")
            term, where = own[order], places[order]
            same = term[1:] == term[:-1]
            gaps, of = np.diff(where)[same], term[1:][same]
            regular = 0.0
            if len(gaps) > 3:
                k = np.bincount(of)
                some = np.maximum(k, 1)
                mean = np.bincount(of, gaps) / some
                cv = np.sqrt(np.maximum(np.bincount(of, gaps.astype(float) ** 2) / some - mean**2, 0)) / np.maximum(mean, 1)
                many = k >= 2
                regular = float(((1 - np.minimum(cv, 1)) * k)[many].sum() / max(1, k[many].sum()))
            # The autocorrelation at all lags at once: every pair of equal terms counts at its distance.
            top = min(n, len(ids)) // 2
            hits = np.zeros(top + 1)
            step = 1
            while step < n and (same := term[step:] == term[:-step]).any():
                far = (where[step:] - where[:-step])[same]
                hits += np.bincount(far[far <= top], minlength=top + 1)[: top + 1]
                step += 1
            auto = hits[1:] / np.maximum(1, n - np.arange(1, top + 1))
            periodic = float(auto.max() - auto.mean()) if top else 0.0
            for name, v in (("recurrence", len(gaps) / n), ("close", float((gaps <= CLOSE).sum()) / n), ("dense", float((gaps <= CLOSE_IN_SENTENCES).sum()) / n), ("regularity", regular), ("periodicity", min(1.0, periodic)), ("distinct", 1 - len(gaps) / n)):
                setattr(total, name, getattr(total, name) + v * n)
            n_all += n
        if len(ids_all) - at < 2 * WINDOW:
            break
    if n_all:
        for name in ("recurrence", "close", "dense", "regularity", "periodicity", "distinct"):
            setattr(total, name, getattr(total, name) / n_all)
    return total


def marked(terms: list[str]) -> bool:
    """Whether links or tags beat time: the mean gap from one to the next, and from the last to the end, is short."""
    for mark in (_LINK, "#"):
        at = [k for k, t in enumerate(terms) if t == mark]
        if len(at) > 2 and (len(terms) - at[0]) / len(at) <= MARK_GAP and at[0] <= MARK_GAP * len(at):
            return True
    return False


def stuffed(b: Beat, sentences: bool) -> bool:
    """Unnaturally dense or regular repetition. Sentences repeat their subject, so most of their content words must recur within a few words."""
    if sentences:
        return b.dense >= 0.5 and b.distinct <= 0.4
    return b.close >= 0.3 or b.recurrence >= 0.5 or b.periodicity >= 0.2 or (b.regularity >= 0.5 and b.recurrence >= 0.2)


def score(text: str | None) -> tuple[float, int, int, int, float, float, float, float, float, str | None, bool]:
    """spam_share, terms, links, tags, distinct_share, recurrence, close, regularity, periodicity, kind, is_spam.

    The measures are those of the sections that are neither code nor report, sentences left out if they are no heap.
    kind is what most of the spam is: repetition, links or list. Null and empty texts, and texts of fewer than
    LEAST_TERMS terms outside code and reports, are no spam.
    """
    nothing = (0.0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, None, False)
    if not text:
        return nothing
    segs = segments(text)
    total = sum(s.letters for s in segs)
    parts = {}
    for shape in ("heap", "sentence"):
        own = [s for s in segs if s.shape == shape]
        parts[shape] = own, sum(s.letters for s in own)
    found: dict[str, int] = {}
    shown = None
    for shape, (own, letters) in parts.items():
        # Less than a quarter of a page can't decide about it.
        if letters * 4 < total or not total:
            continue
        terms = [w for s in own for w in s.terms]
        n, links, tags = sum(s.words for s in own), sum(s.links for s in own), sum(s.tags for s in own)
        if n + links < LEAST_TERMS:
            continue
        words = [t for t in terms if t != _LINK and t != "#"]
        b = beat(words)
        if shown is None:
            shown = (n + links, links, tags, b)
        if shape == "heap" and marked(terms):
            found["links"] = found.get("links", 0) + letters
        elif stuffed(b, shape == "sentence"):
            found["repetition"] = found.get("repetition", 0) + letters
        elif shape == "heap" and b.distinct >= 0.5 and sum(w in FUNCTION_WORDS for w in words) * 2 < SENTENCE_SHARE * len(words):
            found["list"] = found.get("list", 0) + letters
    if shown is None:
        return nothing
    share = sum(found.values()) / total
    n, links, tags, b = shown
    kind = max(found, key=lambda k: (found[k], k)) if found else None
    return share, n, links, tags, b.distinct, b.recurrence, b.close, b.regularity, b.periodicity, kind, share > 0.5


NAMES = ["spam_share", "terms", "links", "tags", "distinct_share", "recurrence", "close_recurrence", "regularity", "periodicity", "kind", "is_spam"]
_SCORES = "doc_id bigint, spam_share double, terms int, links int, tags int, distinct_share double, recurrence double, close_recurrence double, regularity double, periodicity double, kind string, is_spam boolean"


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = pd.DataFrame([score(t) for t in b["text"]], columns=NAMES)
        out.insert(0, "doc_id", b["doc_id"].to_numpy())
        yield out


def spam_scores(documents: DataFrame) -> DataFrame:
    """One row for each document, scored where it is read; no shuffle beyond spread(). Null doc_ids give no row."""
    return spread(documents.where("doc_id is not null").select("doc_id", "text")).mapInPandas(_score, _SCORES)


def p8_found(spark, sf_dir: str) -> DataFrame:
    return spam_scores(table(spark, sf_dir, "documents")).where("is_spam").select("doc_id")


def p8_scores(spark, sf_dir: str) -> DataFrame:
    return spam_scores(table(spark, sf_dir, "documents"))
