"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A block's features are its ancestors' tags and class names and its text: length,
link density, punctuation, digits and cue words. The field is trained on
labelled pages by gradient ascent on the conditional likelihood (forward and
backward passes over all pages at once) and decoded by Viterbi. The main text
joins the blocks labelled main, in page order, by one space.

Training is a few seconds on the driver; its weights (as many as the features
of the training pages) are broadcast, pages are decoded over Arrow batches
and nothing is shuffled. Null and empty pages give an empty text, a very long
page is read whole, an empty table gives an empty result. Repeated rows give
repeated results; other columns are left out unless asked for, and one asked for
under the name of a result is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import pieces
from stratalog.llm.crf_pages import labelled_pages
from stratalog.llm.html_blocks import Block, Node, blocks

TRAIN_PAGES, EPOCHS = 600, 120
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose presence in a block is a feature.
CUES = frozenset(
    "about accept account ad advertisement agree all archive article articles blog buy by click comment comments consent contact continue cookie cookies copyright disagree email enter faq follow free help home "
    "imprint javascript join like login mail menu more most newsletter now offer order password policy post posted posts powered privacy read recent related reply report reserved rights sale says search send "
    "share shop sign site sponsored submit subscribe tags terms thanks trending use".split())


def own_features(node: Node | None) -> list[str]:
    """Features of an element by itself and its parent; those of all ancestors are their marks."""
    if node is None:
        return ["depth 0", "bias"]
    up = [f"up0 {node.tag}", *([f"up1 {node.parent.tag}"] if node.parent else [])]
    return [*up, f"depth {min(node.depth, 8)}", "bias"]


def path_features(node: Node | None) -> list[str]:
    out, up = own_features(node), node
    while up is not None:
        out += up.marks
        up = up.parent
    return out


def text_features(block: Block) -> list[str]:
    text = block.text
    n = len(text)
    out = [f"length {min(n, 2000).bit_length()}", f"links {4 * block.linked // n}"]
    if text[-1] in ".!?:;…\"”»":
        out.append("ends as a sentence")
    if sum(map(text.count, ".!?")) >= 2:
        out.append("sentences")
    if "©" in text:
        out.append("©")
    if n < 200:
        out += [f"cue {w}" for w in {w.lower() for w in _WORD.findall(text)} & CUES]
        if any(map(str.isdigit, text)):
            out.append("digit")
    return out


class Field:
    """Scores of main over other for each feature, and of moving between labels."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]], starts: list[float]):
        self.weights, self.moves, self.starts = weights, moves, starts

    def scores(self, page: list[Block]) -> list[float]:
        """Of each block. An element's marks add to what its parent's sum up to, so each is looked at once."""
        get, sums, out = self.weights.get, {None: 0.0}, []
        for block in page:
            ancestors, node = [], block.node
            while node not in sums:
                ancestors.append(node)
                node = node.parent
            for node in reversed(ancestors):
                sums[node] = sums[node.parent] + sum(get(f, 0.0) for f in node.marks)
            out.append(sums[block.node] + sum(get(f, 0.0) for f in own_features(block.node)) + sum(get(f, 0.0) for f in text_features(block)))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the likeliest labels of all blocks together."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves
        scores = self.scores(page)
        a, b = self.starts[0], self.starts[1] + scores[0]
        back = []
        for score in scores[1:]:
            from_a, from_b = (0, a + m00) if a + m00 >= b + m10 else (1, b + m10), (0, a + m01) if a + m01 > b + m11 else (1, b + m11)
            back.append((from_a[0], from_b[0]))
            a, b = from_a[1], from_b[1] + score
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[str, list[int]]], epochs: int = EPOCHS) -> Field:
    index: dict[str, int] = {}
    rows, at_page, at_step, y = [], [], [], []
    kept = [(b, labels) for b, labels in ((blocks(p), labels) for p, labels in pages) if b and len(b) == len(labels)]
    for i, (page, labels) in enumerate(kept):
        for t, block in enumerate(page):
            rows.append([index.setdefault(f, len(index)) for f in path_features(block.node) + text_features(block)])
            at_page.append(i)
            at_step.append(t)
            y.append(labels[t])
    n_pages, n_steps = len(kept), max(at_step) + 1
    owner = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    feature = np.array([f for r in rows for f in r])
    target = np.zeros((n_pages, n_steps))
    live = np.zeros((n_pages, n_steps), bool)
    target[at_page, at_step], live[at_page, at_step] = y, True
    w, moves, starts = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    speed: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, moves, starts)]
    lse = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    for epoch in range(1, epochs + 1):
        s = np.zeros((n_pages, n_steps, 2))
        s[at_page, at_step, 1] = np.bincount(owner, weights=w[feature], minlength=len(rows))
        fore, rear = np.zeros_like(s), np.zeros_like(s)
        fore[:, 0] = starts + s[:, 0]
        for t in range(1, n_steps):
            step = lse((fore[:, t - 1, :, None] + moves).transpose(0, 2, 1)) + s[:, t]
            fore[:, t] = np.where(live[:, t, None], step, fore[:, t - 1])
        for t in range(n_steps - 2, -1, -1):
            step = lse(moves[None] + (s[:, t + 1] + rear[:, t + 1])[:, None, :])
            rear[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = lse(fore[:, -1])
        p1 = np.exp(fore[..., 1] + rear[..., 1] - total[:, None]) * live
        g_w = np.bincount(feature, weights=(target - p1)[at_page, at_step][owner], minlength=len(index)) - 0.05 * w
        g_moves, both = np.zeros((2, 2)), live[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                expected = np.exp(fore[:, :-1, i] + moves[i, j] + s[:, 1:, j] + rear[:, 1:, j] - total[:, None]) * both
                g_moves[i, j] = (((target[:, :-1] == i) & (target[:, 1:] == j)) & both).sum() - expected.sum()
        g_starts = np.array([(1 - target[:, 0]).sum() - (1 - p1[:, 0]).sum(), target[:, 0].sum() - p1[:, 0].sum()])
        for value, grad, (m, v) in zip((w, moves, starts), (g_w, g_moves, g_starts), speed, strict=True):
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            value += 0.1 * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.98 ** epoch)) + 1e-8)
    return Field({f: float(w[i]) for f, i in index.items()}, moves.tolist(), starts.tolist())


@cache
def default_field() -> Field:
    return train(labelled_pages(TRAIN_PAGES))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, label in zip(found, field.decode(found), strict=True) if label)


def _extract(batches: Iterator[pa.RecordBatch], field: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "__html"):
        at = batch.schema.get_field_index("__html")
        texts = [main_text(p, field.value) for p in batch.column(at).to_pylist()]
        yield batch.remove_column(at).append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array(list(map(len, texts)), pa.int64()))


def extract(pages: DataFrame, field: Field | None = None, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(kept columns, text, n_chars)."""
    if clash := set(keep) & {"text", "n_chars"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    sent = pages.sparkSession.sparkContext.broadcast(field or default_field())
    given = pages.select(*keep, F.col(html).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "__html")
    return given.mapInArrow(partial(_extract, field=sent), f"{schema}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
