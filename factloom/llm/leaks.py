"""Passages of evaluation items in training documents, by a positional inverted index.

The index: documents are split into shards (a block of documents that one task reads); each shard is a row of a written
table that holds, for each term, the word positions where it stands. Only terms of the items are stored, the others
can't matter; it is made once for all items. The search: document frequencies are summed over all shards; in each run
of RUN words of an item the rarest term is an anchor; the anchors' postings, less the anchor's place in the item, give
the diagonals (document and offset) on which the item may stand, and these are intersected with the offset-adjusted
postings of all its other terms. A passage holds MIN_WORDS matching words or more, and fewer than one in ten of its
words differ, none of them next to another. It has RUN matching words in a row, so none is lost: every such run holds
an anchor.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import spread
from factloom.session import cut, table

MIN_WORDS = 20
RUN = 7
#: A run of words that this many items share is an instruction.
SHARED_WORDS, SHARED_ITEMS = 15, 3
#: Words of the items that one task looks for at once; more items are looked for in further passes over the index.
BLOCK_WORDS = 4_000_000
#: Cells (diagonals times words of the item) that are compared at once.
CELLS = 4_000_000
#: Documents and characters of a shard.
SHARD_DOCS, SHARD_CHARS = 2_000, 16_000_000

_INVISIBLE = {c: None for c in [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0xFEFF, *range(0x180B, 0x180E), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080)]}
_TAGS = re.compile(r"</?(?:a|b|i|u|s|p|em|strong|code|pre|br|div|span|mark|del|ins|sub|sup|small|big|font|li|ul|ol|td|th|tr|table|tbody|thead|h[1-6]|blockquote|q|cite|kbd|samp|var|tt|img|hr|section|article|center)\b[^<>]*>", re.I)
_LINK = re.compile(r"\]\((?:[^()\n]|\([^()\n]*\))*\)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text; case, spacing, punctuation, markup and invisible signs make no difference."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).translate(_INVISIBLE)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "&" in text:
        text = html.unescape(text).translate(_INVISIBLE)
    if "](" in text:
        text = _LINK.sub("] ", text)
    return _WORD.findall(text.lower() if text.isascii() else text.casefold())


_SHINGLE = "item_id bigint, at int, shingle bigint"
_ITEM = "item_id bigint, words array<string>"


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, ats, hashes = [], [], []
        for item, ws in zip(b["item_id"], b["words"]):
            for k in range(len(ws) - SHARED_WORDS + 1):
                ids.append(item)
                ats.append(k)
                # A stable hash: Python's own differs between workers.
                hashes.append(int.from_bytes(__import__("hashlib").blake2b(" ".join(ws[k : k + SHARED_WORDS]).encode(), digest_size=8).digest(), "big", signed=True))
        yield pd.DataFrame({"item_id": ids, "at": pd.array(ats, dtype="int32"), "shingle": pd.array(hashes, dtype="int64")})


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"item_id": b["item_id"], "words": [words(t) for t in b["text"]]})


def cleaned_items(items: DataFrame) -> DataFrame:
    """item_id, words and shared: how many items share the run of SHARED_WORDS words that starts at a word."""
    base = items.where("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    w = cut(base.mapInPandas(_item_words, _ITEM).where(F.size("words") > 0))
    s = w.mapInPandas(_shingles, _SHINGLE)
    counts = s.groupBy("shingle").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= SHARED_ITEMS)
    shared = s.join(counts, "shingle").groupBy("item_id").agg(F.collect_list(F.struct("at", "n")).alias("shared"))
    return w.join(shared, "item_id", "left")


def own_words(ws: list[str], shared: list[tuple[int, int]] | None) -> list[str | None]:
    """The words of an item, None in place of those of an instruction."""
    out: list[str | None] = list(ws)
    n = np.zeros(len(ws) + 2 * SHARED_WORDS, dtype=np.int64)
    for at, k in shared or ():
        n[at + SHARED_WORDS] = k
    for at, k in shared or ():
        # The first words after an instruction may be shared as well, but by far fewer items.
        if 2 * k >= n[at + 1 : at + 2 * SHARED_WORDS].max():
            out[at : at + SHARED_WORDS] = [None] * SHARED_WORDS
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str | None]]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        ws = own_words(r["words"], [(x["at"], x["n"]) for x in r["shared"] or ()])
        if sum(w is not None for w in ws) < MIN_WORDS:
            continue
        block.append((r["item_id"], ws))
        size += len(ws)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


_SHARD = "shard bigint, docs array<bigint>, ends array<int>, terms array<int>, n_docs array<int>, bounds array<int>, places array<int>"


def _index(vocabulary: dict[str, int]):
    """A row for each shard: ids of its documents and where each ends in the shard's words; the terms that stand in it, in
    how many documents each, and their sorted places (those of term k lie between bounds k and k + 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        get = vocabulary.get
        for b in batches:
            ids, texts, start = b["doc_id"].to_numpy(), b["text"].tolist(), 0
            while start < len(ids):
                stop, chars = start, 0
                while stop < len(ids) and stop - start < SHARD_DOCS and (stop == start or chars + len(texts[stop]) <= SHARD_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                flat, ends, total = [], [], 0
                for t in texts[start:stop]:
                    got = [get(w, -1) for w in words(t)]
                    flat += got
                    total += len(got)
                    ends.append(total)
                terms = np.array(flat, dtype=np.int32)
                places = np.flatnonzero(terms >= 0).astype(np.int32)
                terms = terms[places]
                order = np.argsort(terms, kind="stable")
                terms, places = terms[order], places[order]
                owner = np.searchsorted(np.array(ends), places, side="right")
                head = np.concatenate([[True], terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, dtype=bool)
                new = head.copy()
                new[1:] |= owner[1:] != owner[:-1]
                at = np.flatnonzero(head)
                yield pd.DataFrame(
                    {
                        "shard": [shard], "docs": [ids[start:stop].tolist()], "ends": [ends], "terms": [terms[at]], "n_docs": [np.add.reduceat(new.astype(np.int32), at) if len(at) else at.astype(np.int32)],
                        "bounds": [np.append(at, len(terms)).astype(np.int32)], "places": [places],
                    }
                )
                shard += 1
                start = stop

    return run


def passages(hit: np.ndarray) -> list[tuple[int, int]]:
    """Of a row of matches the longest passage: start and end, or nothing. It starts and ends with a match, holds
    MIN_WORDS matches or more, and fewer than one word in ten, none next to another, differs."""
    at = np.flatnonzero(hit)
    if len(at) < MIN_WORDS:
        return []
    gaps = np.diff(at)
    best = (0, 0)
    # Two words that differ side by side break a passage.
    for piece in np.split(at, np.flatnonzero(gaps > 2) + 1):
        if len(piece) < MIN_WORDS:
            continue
        # piece[j] - j counts the words that differ before; with i the first and j the last match, the passage holds
        # n = piece[j] - piece[i] + 1 words of which n - (j - i + 1) differ: 10 (n - (j - i + 1)) < n.
        j = np.arange(len(piece))
        value = 9 * piece - 10 * j  # a passage from i to j fits exactly if value[j] - value[i] < 1
        for i in range(len(piece)):
            last = np.flatnonzero((value[i:] - value[i] < 1) & (j[i:] - i + 1 >= MIN_WORDS))
            if len(last) and piece[i + last[-1]] + 1 - piece[i] > best[1] - best[0]:
                best = (int(piece[i]), int(piece[i + last[-1]]) + 1)
            if piece[-1] - piece[i] < best[1] - best[0]:
                break
    return [best] if best[1] else []


_HIT = "item_id bigint, doc_id bigint, item_start int, n_words int, n_replaced int"


def _on_lines(lines: np.ndarray, terms: np.ndarray, postings: dict[int, np.ndarray]) -> np.ndarray:
    """Which words of an item match on which diagonals: the postings of each word, less its place, intersected with them."""
    hit = np.zeros((len(lines), len(terms)), dtype=bool)
    for j, t in enumerate(terms.tolist()):
        p = postings.get(t)
        if p is not None:
            want = lines + j
            at = np.searchsorted(p, want)
            at[at == len(p)] = 0
            hit[:, j] = p[at] == want
    return hit


def _probe(items: list[tuple[int, np.ndarray, np.ndarray]]):
    """items: id, terms (-2 for words of an instruction), anchor positions."""

    def shard(docs: np.ndarray, ends: np.ndarray, postings: dict[int, np.ndarray]) -> Iterator[tuple]:
        starts = np.concatenate([[0], ends[:-1]])
        for item, terms, anchors in items:
            # Postings of each anchor less its place: the diagonals on which the item may stand.
            lists = [postings[terms[a]] - a for a in anchors if terms[a] in postings]
            if not lists:
                continue
            lines = np.unique(np.concatenate(lists))
            n = len(terms)
            step = max(1, CELLS // n)
            for part in range(0, len(lines), step):
                at = lines[part : part + step]
                hit = _on_lines(at, terms, postings)
                total = np.cumsum(np.pad(hit, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
                width = min(MIN_WORDS, n)
                # MIN_WORDS words of which at most three differ are a part of every passage.
                near = ((total[:, width:] - total[:, :-width]) >= width - 3).any(axis=1)
                for row in np.flatnonzero(near):
                    line = at[row]
                    # A diagonal may cross several documents; each is looked at by itself.
                    first = int(np.searchsorted(ends, max(line, 0), side="right"))
                    while first < len(ends) and starts[first] < line + n:
                        lo, hi = max(starts[first] - line, 0), min(ends[first] - line, n)
                        for a, b in passages(hit[row, lo:hi]):
                            found = int(hit[row, lo + a : lo + b].sum())
                            yield item, docs[first], lo + a, b - a, b - a - found
                        first += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for docs, ends, terms, bounds, places in zip(b["docs"], b["ends"], b["terms"], b["bounds"], b["places"]):
                places = np.asarray(places, dtype=np.int64)
                postings = {t: places[x:y] for t, x, y in zip(np.asarray(terms).tolist(), bounds[:-1], bounds[1:])}
                out = list(shard(np.asarray(docs), np.asarray(ends, dtype=np.int64), postings))
                yield pd.DataFrame(out, columns=["item_id", "doc_id", "item_start", "n_words", "n_replaced"])

    return run


def _anchors(ws: list[str | None], rarity: dict[str, tuple[int, int]]) -> list[int]:
    """In each run of RUN own words the place of the rarest term, of equals the last."""
    out = set()
    for k in range(len(ws) - RUN + 1):
        run = ws[k : k + RUN]
        if None not in run:
            out.add(min(range(RUN), key=lambda j: (rarity.get(run[j], (0, 0)), -j)) + k)
    return sorted(out)


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each item and document that shares a passage: the longest one's place in the item, its words and replaced words.

    Null ids and texts give no rows; repeated item_ids count once, with their greatest text; of a doc_id with several
    rows each is searched and the longest passage holds; extra columns are ignored. Empty tables give no rows. A very
    long document is a shard of its own.
    """
    spark = documents.sparkSession
    src = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    cleaned = cut(cleaned_items(items))
    # The terms of all items, not their texts, are held at once: they grow far more slowly than the items.
    vocabulary: dict[str, int] = {}
    held: list | None = None
    for n, block in enumerate(_blocks(cleaned)):
        # A single block is kept; of several each is read again when its turn comes.
        held = block if n == 0 else None
        for _, ws in block:
            for w in ws:
                if w is not None:
                    vocabulary.setdefault(w, len(vocabulary))
    found = spark.createDataFrame([], _HIT)
    if vocabulary:
        index = cut(spread(src).mapInPandas(_index(vocabulary), _SHARD))
        each = index.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("t"))
        counts = {r["term"]: r["n"] for r in each.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.n_docs").alias("n")).collect()}
        rarity = {w: (counts.get(k, 0), k) for w, k in vocabulary.items()}
        for block in [held] if held is not None else _blocks(cleaned):
            queries = [(item, np.array([-2 if w is None else vocabulary[w] for w in ws], dtype=np.int32), np.array(_anchors(ws, rarity))) for item, ws in block]
            found = found.unionByName(index.mapInPandas(_probe(queries), _HIT))
    best = F.max_by(F.struct("item_start", "n_words", "n_replaced"), F.struct("n_words", -F.col("n_replaced"), -F.col("item_start"))).alias("b")
    return found.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", "b.*")


def p6_found(spark, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p6_items(spark, sf_dir: str) -> DataFrame:
    """Of each item that leaked: the documents, and the largest part of its words that stands in one."""
    hits = leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest_passage"))
