"""The main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read into the blocks of text between boundaries of its elements
(blocks.py). Each block has features of its ancestors (tags, what their names
speak for), its text (words, share of links, how it ends, set phrases), its
section (how much of the page's text stands there) and its place. The field gives
a page's labels the score of all features plus those of neighbouring labels; it is
trained by gradient descent on the likelihood of labelled pages (labelled.py) and
decoded by Viterbi. Pages are rows of their own: there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardamom.llm import blocks
from cardamom.llm.labelled import labelled_pages

#: Pages that the field is trained on, and from what number they are drawn.
TRAINING_PAGES, SEED = 600, 11
#: Pages whose elements' paths are kept together.
PAGES = 256
_CUES = re.compile(r"©|copyright|rights reserved|cookie|newsletter|subscribe|sign ?up|log ?in\b|advertis|sponsored|privacy|\bterms\b|\brelated\b|read more|\bcomments?\b|\breply\b|alle rechte|datenschutz|tous droits|derechos reservados", re.I)
_SHARES = (0.01, 0.05, 0.15, 0.3, 0.5, 0.7, 0.9)


def path_features(path: blocks.Path) -> list[str]:
    return [*path.has, path.near, f"own:{path.tag}", f"own:{path.tag}|{path.near}"]


def _share(part: int, whole: int) -> int:
    return sum(part > s * whole for s in _SHARES)


def text_features(page: blocks.Page) -> Iterator[list[str]]:
    """Features of each block but those of its path."""
    total, last = sum(page.sizes) or 1, len(page.blocks) - 1
    own = [_share(s, total) for s in page.sizes]
    largest = max(range(len(page.sizes)), key=page.sizes.__getitem__)
    for i, b in enumerate(page.blocks):
        size = len(b.text)
        words = b.text.count(" ") + 1
        links = 0 if not b.linked else 1 if 10 * b.linked < 3 * size else 2 if 10 * b.linked < 8 * size else 3
        many = min(words.bit_length(), 7)
        found = ["bias", f"links:{links}", f"words:{many}", f"own:{b.path.tag}|links:{links}", f"section:{own[b.section]}", f"around:{own[page.around[b.section]]}", f"section:{own[b.section]}|links:{links}"]
        if b.section == largest:
            found.append("largest")
        if b.text[-1] in ".!?…":
            found.append("ends")
        if words <= 25 and _CUES.search(b.text):
            found.append("cue")
        if i == 0:
            found.append("first")
        if i == last:
            found.append("last")
        yield found


@dataclass(frozen=True)
class Field:
    """Scores of features for the article against all else, and of neighbouring labels: step[a][b], 1 is the article."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, page: blocks.Page) -> list[bool]:
        """The labels of greatest score (Viterbi)."""
        w = self.weights.get
        (oo, oa), (ao, aa) = self.step
        other, article, came = 0.0, 0.0, []
        for i, (b, found) in enumerate(zip(page.blocks, text_features(page), strict=True)):
            score = b.path.score
            if score is None:
                score = b.path.score = sum(w(f, 0.0) for f in path_features(b.path))
            score += sum([w(f, 0.0) for f in found])
            if i:
                from_other, from_article = article + ao > other + oo, article + aa >= other + oa
                came.append((from_other, from_article))
                other, article = (article + ao if from_other else other + oo), (article + aa if from_article else other + oa)
            article += score
        label, labels = article > other, []
        for step in reversed(came):
            labels.append(label)
            label = step[label]
        return [*labels, label][::-1] if page.blocks else []


def labels_of(page: blocks.Page, main: list[str]) -> list[bool]:
    """Which blocks are the article's texts, in their order."""
    out, i = [], 0
    for b in page.blocks:
        hit = i < len(main) and b.text == main[i]
        out.append(hit)
        i += hit
    if i < len(main):
        raise ValueError("the article's texts are not all blocks of the page")
    return out


def train(pages: Iterable[tuple[str, list[str]]], steps: int = 200, rate: float = 0.1, penalty: float = 1e-4) -> Field:
    """The field that maximises the likelihood of the pages' labels, less ``penalty`` times the squares of its weights."""
    names: dict[str, int] = {}
    flat, per, labels, sizes = [], [], [], []
    for source, main in pages:
        page = blocks.page(source)
        got = labels_of(page, main)
        if not got:
            continue
        for b, found in zip(page.blocks, text_features(page), strict=True):
            every = [names.setdefault(f, len(names)) for f in (*path_features(b.path), *found)]
            flat += every
            per.append(len(every))
        labels += got
        sizes.append(len(got))
    flat, per, sizes, y = np.array(flat), np.array(per), np.array(sizes), np.array(labels, np.int64)
    begins, n, longest = np.concatenate([[0], np.cumsum(per)[:-1]]), len(sizes), int(sizes.max())
    row, col = np.repeat(np.arange(n), sizes), np.arange(len(y)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = col > 0
    weight = np.zeros(len(names) + 4)  # the last four: steps
    met = np.zeros(4)
    np.add.at(met, 2 * y[:-1][inside[1:]] + y[1:][inside[1:]], 1)
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    there = np.zeros((n, longest), bool)
    there[row, col] = True
    for k in range(1, steps + 1):
        score = np.zeros((n, longest, 2))
        score[row, col, 1] = np.add.reduceat(weight[flat], begins)
        step = weight[-4:].reshape(2, 2)
        # forward and backward in logarithms, all pages at once; behind a page's end nothing changes
        fore, back = score.copy(), np.zeros_like(score)
        for t in range(1, longest):
            now = np.logaddexp(fore[:, t - 1, 0, None] + step[0], fore[:, t - 1, 1, None] + step[1]) + score[:, t]
            fore[:, t] = np.where(there[:, t, None], now, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + back[:, t + 1]
            now = np.logaddexp(step[:, 0] + ahead[:, 0, None], step[:, 1] + ahead[:, 1, None])
            back[:, t] = np.where(there[:, t + 1, None], now, 0.0)
        whole = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        likely = np.exp(fore[row, col, 1] + back[row, col, 1] - whole[row])
        a, b = np.flatnonzero(inside) - 1, np.flatnonzero(inside)
        pair = fore[row[a], col[a]][:, :, None] + step + (score[row[b], col[b]] + back[row[b], col[b]])[:, None, :] - whole[row[b], None, None]
        slope = np.empty_like(weight)
        slope[:-4] = np.bincount(flat, weights=np.repeat(likely - y, per), minlength=len(names)) / n
        slope[-4:] = (np.exp(pair).sum(axis=0).ravel() - met) / n
        slope += penalty * weight
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weight -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    (oo, oa), (ao, aa) = weight[-4:].reshape(2, 2).tolist()
    return Field({f: float(weight[i]) for f, i in names.items()}, ((oo, oa), (ao, aa)))


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Field:
    """The field of so many labelled pages; equal arguments give equal fields."""
    return train(labelled_pages(pages, seed))


def main_text(model: Field, source: str, root: blocks.Path | None = None) -> str:
    page = blocks.page(source, root)
    return "\n\n".join(b.text for b, kept in zip(page.blocks, model.decode(page), strict=True) if kept)


def _extracted(model: Field):
    schema = pa.schema([("_page_id", pa.int64()), ("_url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), PAGES):
                part, root = batch.slice(a, PAGES), blocks.Path("html", frozenset(), "near:")
                texts = [main_text(model, h.as_py() or "", root) for h in part.column("_html")]
                yield pa.RecordBatch.from_arrays([part.column("_page_id"), part.column("_url"), pa.array(texts, pa.string())], schema=schema)

    return run


def extracted(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    text: the blocks of the article in page order, each with its character
    references decoded and white space as single spaces, joined by an empty line.
    Null, empty and textless pages have an empty text. Rows with a null or
    repeated page_id, or a null url, are pages like any other; other columns are
    ignored; an empty table stays empty. A page is one row of one task, however
    long. model: unless given, the field trained on labelled pages made by rule
    (some thousand weights, sent to each task).
    """
    base = pages.select(pages["page_id"].cast("long").alias("_page_id"), pages["url"].cast("string").alias("_url"), pages["html"].cast("string").alias("_html"))
    out = base.mapInArrow(_extracted(model or trained()), "_page_id long, _url string, text string")
    return out.select(F.col("_page_id").alias("page_id"), F.col("_url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
