"""Problem 9: held-out test passages inside a training corpus.

Method: a positional inverted index of the corpus, kept as a table and partitioned by document: each segment holds the
postings (word positions) of all terms of its documents. Test items come to every segment in blocks of bounded size.
Of each window of n words the rarest term over all documents is looked up; its postings are intersected, shifted by
their offsets, with those of its neighbours in the item; survivors are compared word by word over the whole window.
Proximity matches (see nearby) look up the rarest words of a window instead and count its words in a short span.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from .lookalikes import Scorer, icu_shapes

_WORD = re.compile(r"[^\W_]+")
#: Unused positions between documents, so that no window crosses an edge; windows may be as long as this.
GAP = 64
SEGMENT = "doc_ids array<{id}>, starts binary, terms array<string>, ends binary, found binary, positions binary"


def words(text: str | None, scorer: Scorer) -> list[str]:
    """Runs of letters and digits of a text in its consistent form, without letter case; [] for null."""
    return _WORD.findall(scorer.canonical(text).lower()) if text else []


class _Segment:
    def __init__(self) -> None:
        self.ids: list = []
        self.starts: list[int] = []
        self.parts: list[np.ndarray] = []
        self.terms: dict[str, int] = {}
        self.length = GAP

    def add(self, doc_id: object, found: list[str]) -> None:
        if found:
            terms = self.terms
            self.ids.append(doc_id)
            self.starts.append(self.length)
            self.parts.append(np.fromiter((terms.setdefault(w, len(terms)) for w in found), np.int32, len(found)))
            self.length += len(found) + GAP

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        starts = np.array(self.starts, np.int32)
        sizes = np.array([len(p) for p in self.parts])
        docs = np.repeat(np.arange(len(sizes)), sizes)
        flow = np.concatenate(self.parts)
        at = np.arange(len(flow)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[docs]
        order = np.argsort(flow, kind="stable")
        flow, at, docs = flow[order], at[order].astype(np.int32), docs[order]
        ends = np.searchsorted(flow, np.arange(len(self.terms)), "right").astype(np.int32)
        new = np.concatenate([[True], (flow[1:] != flow[:-1]) | (docs[1:] != docs[:-1])])
        found = np.bincount(flow[new], minlength=len(self.terms)).astype(np.int32)  # documents of each term
        blobs = [starts.tobytes(), ends.tobytes(), found.tobytes(), at.tobytes()]
        s, e, f, p = (pa.array([x], pa.binary()) for x in blobs)
        return pa.RecordBatch.from_arrays([pa.array([self.ids], pa.list_(kind)), s, pa.array([list(self.terms)], pa.list_(pa.string())), e, f, p], names=["doc_ids", "starts", "terms", "ends", "found", "positions"])


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_words: int = 2_000_000, path: str | None = None) -> DataFrame:
    """The positional index of all documents as a durable table, a row per segment of about ``segment_words`` words.

    A segment ends with a whole document; a text of any length is indexed whole. Null, empty and wordless texts have
    no postings. With a path the index is a table that outlives the session: it is appended to what stands there, and
    any later session reads it by spark.read.parquet(path).
    """
    shapes = icu_shapes(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, segment = Scorer(shapes=shapes), _Segment()
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment.add(i, words(t.as_py(), scorer))
                if segment.length > segment_words:
                    yield segment.row(kind)
                    segment = _Segment()
        if segment.ids:
            yield segment.row(kind)

    kind = documents.schema[doc_id].dataType.simpleString()
    made = documents.select(F.col(doc_id), F.col(text)).mapInArrow(run, SEGMENT.format(id=kind))
    if path is None:
        return durable(made, "postings")
    made.write.mode("append").option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.parquet(path)


def document_frequencies(index: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """Documents of the whole corpus that hold each term of a bounded vocabulary; positions aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for terms, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, n in zip(terms, np.frombuffer(blob, np.int32).tolist()):
                    if w in vocabulary:
                        total[w] = total.get(w, 0) + n
        yield pa.RecordBatch.from_pydict({"term": list(total), "n": list(total.values())})

    rows = index.select("terms", "found").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r.term: r.n for r in rows}


def _anchors(frequency: list[int], n: int) -> list[int]:
    """Positions of an item that are the rarest of a window of n words."""
    return sorted({min(range(i, i + n), key=lambda j: (frequency[j], j)) for i in range(len(frequency) - n + 1)})


def _search(segment: dict, items: list[tuple], n: int) -> Iterator[tuple]:
    """(item, document) of one segment. An item is (id, words, anchors)."""
    place = {w: i for i, w in enumerate(segment["terms"])}
    ends, at = np.frombuffer(segment["ends"], np.int32), np.frombuffer(segment["positions"], np.int32)
    starts = np.frombuffer(segment["starts"], np.int32)
    begins = np.concatenate([[0], ends[:-1]])
    flow: np.ndarray | None = None
    none = np.empty(0, np.int32)

    def postings(t: int) -> np.ndarray:
        return at[begins[t] : ends[t]] if t >= 0 else none

    def inside(x: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
        k = np.searchsorted(sorted_list, x)
        return (k < len(sorted_list)) & (sorted_list[np.minimum(k, len(sorted_list) - 1)] == x) if len(sorted_list) else np.zeros(len(x), bool)

    for item, text, anchors in items:
        own = np.array([place.get(w, -2) for w in text], np.int32)
        padded = np.concatenate([np.full(n, -2, np.int32), own, np.full(n, -2, np.int32)])
        hit: set[int] = set()
        for p in anchors:
            found = postings(own[p])
            if not len(found):
                continue
            beside = np.zeros(len(found), bool)
            if p:
                beside |= inside(found - 1, postings(own[p - 1]))
            if p + 1 < len(own):
                beside |= inside(found + 1, postings(own[p + 1]))
            if n > 1:
                found = found[beside]
            if not len(found):
                continue
            if flow is None:
                flow = np.full(int(at.max()) + 2 * GAP, -1, np.int32)
                flow[at] = np.repeat(np.arange(len(ends), dtype=np.int32), ends - begins)
            reach = np.arange(-(n - 1), n)
            for part in np.array_split(found, -(-len(found) // 100_000)):
                same = flow[part[:, None] + reach] == padded[p + n + reach]
                left = np.cumprod(same[:, n - 1 :: -1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, n - 1 :], axis=1).sum(axis=1)
                long = part[left + right - 1 >= n]
                hit.update(np.searchsorted(starts, long, "right").tolist())
        for k in hit:
            yield item, segment["doc_ids"][k - 1]


def _nearby(segment: dict, items: list[tuple], span: int, least: int) -> Iterator[tuple]:
    """(item, document) of one segment. An item is (id, [(window's words, words to look up)])."""
    place = {w: i for i, w in enumerate(segment["terms"])}
    ends, at, starts = (np.frombuffer(segment[c], np.int32) for c in ("ends", "positions", "starts"))
    begins = np.concatenate([[0], ends[:-1]])
    flow = np.full(int(at.max()) + 2 * GAP, -1, np.int32)
    flow[at] = np.repeat(np.arange(len(ends), dtype=np.int32), ends - begins)
    reach = np.arange(-(span - 1), span)
    for item, windows in items:
        hit: set[int] = set()
        for own, anchors in windows:
            terms = [place[w] for w in own if w in place]
            if len(terms) < least:
                continue
            found = np.concatenate([at[begins[place[w]] : ends[place[w]]] for w in anchors if w in place] or [np.empty(0, np.int32)])
            for part in np.array_split(found, max(1, -(-len(found) // 20_000))):
                near = flow[np.maximum(part[:, None] + reach, 0)]
                present = np.zeros((len(part), span), np.int16)
                for t in terms:  # whether a term stands in each of the spans that hold the anchor
                    seen = np.cumsum(near == t, axis=1)
                    present += (seen[:, span - 1 :] - np.concatenate([np.zeros((len(part), 1), seen.dtype), seen[:, : span - 1]], axis=1)) > 0
                hit.update(np.searchsorted(starts, part[(present >= least).any(axis=1)], "right").tolist())
        for k in hit:
            yield item, segment["doc_ids"][k - 1]


def nearby(items: DataFrame, documents: DataFrame, n: int = 12, least: int = 10, span: int = 16, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", block_chars: int = 4_000_000, index: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id), distinct: the documents in which ``least`` different words of some n consecutive words of an item stand within ``span`` words, in any order.

    Of a window with d different words any d - least + 1 hold one that must be there, so the rarest of them are looked
    up and no match is lost. Items come in blocks as in leaked; 1 <= span < 64. Nulls, empty texts and tables, and
    windows of fewer than ``least`` different words, give no rows.
    """
    if not (1 <= span < GAP and 1 <= least <= n):
        raise ValueError(f"span must lie between 1 and {GAP - 1}, least between 1 and n")
    index = build_index(documents, doc_id, text) if index is None else index

    def windows(ws: list[str], frequency: dict[str, int]) -> list[tuple]:
        out = {}
        for i in range(max(1, len(ws) - n + 1)):
            own = sorted(set(ws[i : i + n]), key=lambda w: (frequency.get(w, 0), w))
            if len(own) >= least:
                out[tuple(own)] = own[: len(own) - least + 1]
        return list(out.items())

    def listed(asked: list[tuple], frequency: dict[str, int]) -> list[tuple]:
        return [(i, w) for i, ws in asked if ws and (w := windows(ws, frequency))]

    return _matched(items, documents, index, item_id, doc_id, text, block_chars, listed, lambda segment, block: _nearby(segment, block, span, least))


def leaked(items: DataFrame, documents: DataFrame, n: int = 12, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", block_chars: int = 4_000_000, index: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id), distinct: the documents that hold n or more consecutive words of an item.

    Items come to the driver in blocks of about ``block_chars`` characters each, all blocks against the whole index.
    Items of fewer than n words, null texts and empty tables give no rows; 1 <= n < 64. Equal items are all reported.
    """
    if not 1 <= n < GAP:
        raise ValueError(f"n must lie between 1 and {GAP - 1}")
    index = build_index(documents, doc_id, text) if index is None else index

    def listed(asked: list[tuple], frequency: dict[str, int]) -> list[tuple]:
        found = [(i, ws, _anchors([frequency.get(w, 0) for w in ws], n)) for i, ws in asked if len(ws) >= n]
        # A window of which one word is nowhere in the corpus has that word as its anchor and is nowhere either.
        found = [(i, ws, [p for p in ps if frequency.get(ws[p])]) for i, ws, ps in found]
        return [x for x in found if x[2]]

    return _matched(items, documents, index, item_id, doc_id, text, block_chars, listed, lambda segment, block: _search(segment, block, n))


def _matched(items: DataFrame, documents: DataFrame, index: DataFrame, item_id: str, doc_id: str, text: str, block_chars: int, listed: Callable, search: Callable) -> DataFrame:
    """The distinct pairs of a search, the items going to all segments in blocks of bounded size."""
    source = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null and item_id is not null")
    blocks = max(1, -(-(source.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    kinds = items.schema[item_id].dataType.simpleString(), documents.schema[doc_id].dataType.simpleString()
    types = [pa.from_numpy_dtype(np.int64) if k == "bigint" else pa.int32() if k == "int" else pa.string() for k in kinds]
    scorer = Scorer(shapes=icu_shapes(documents.sparkSession))
    out = None
    for block in range(blocks):
        own = source if blocks == 1 else source.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        asked = [(r.item_id, words(r.text, scorer)) for r in own.collect()]
        frequency = document_frequencies(index, {w for _, ws in asked for w in ws})
        shared = documents.sparkSession.sparkContext.broadcast(listed(asked, frequency))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for row in batch.to_pylist():
                    pairs = list(search(row, shared.value))
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k, kind in enumerate(types)], names=["item_id", "doc_id"])

        part = index.mapInArrow(run, f"item_id {kinds[0]}, doc_id {kinds[1]}")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
