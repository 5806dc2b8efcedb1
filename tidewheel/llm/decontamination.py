"""Benchmark decontamination: pigeonhole pieces, verified by bit-parallel edit distance.

An item of m characters leaks into a document if some substring of the document is within
k = floor(m·rate) edits of it. Split into k+1 pieces, at least one piece stands unchanged in such a
substring (pigeonhole), so one Aho-Corasick pass over the document finds all places to look at; each place
is verified by Myers' bit-parallel distance over the item's window around it, with the item's bits in one
integer. Both sides are compared with letters lower-cased and runs of other characters as one space.

Items are taken in blocks of bounded size, each broadcast to one pass over the documents; documents are
not shuffled, and no pairs are built.

Items shorter than `least` characters are searched without errors, and as whole words where their script has
spaces: a place counts unless letters or digits of such a script stand on both sides of one of its edges.

Rows: null and empty texts hold no leak; items without letters or digits, null ones too, are found nowhere;
repeated documents are each reported, repeated items each match, ids of items are of any type; an empty table on
either side gives no rows; texts are searched whole, in memory that their own length bounds; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import sliced, table

RATE = 0.1
LEAST = 20
#: Scripts before this code point put spaces between words.
UNSPACED = "\u2e80"
#: Characters of items that are broadcast at a time.
BLOCK_CHARS = 4_000_000
_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _GAP.sub(" ", text.lower()).strip() if text else ""


class Pattern:
    """A text with its bit masks for Myers' algorithm and its error budget."""

    def __init__(self, text: str, k: int):
        self.text, self.m, self.k = text, len(text), k
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, start: int, end: int, anchored: int = 0) -> tuple[int, int]:
        """Least distance to a substring of text[start:end], and where that one ends (the first, of several).

        anchored: 1 if the substring must begin at start; skipping text before it then costs edits too.
        """
        ones, high = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, at = ones, 0, self.m
        least, where = self.m, start
        for i in range(start, end):
            eq = self.masks.get(text[i], 0)
            x = eq | down
            d0 = (((x & up) + up) ^ up) | x
            hp, hn = down | ~(up | d0), up & d0
            if hp & high:
                at += 1
            elif hn & high:
                at -= 1
            hp, hn = (hp << 1 | anchored) & ones, hn << 1 & ones
            up, down = (hn | ~(d0 | hp)) & ones, hp & d0 & ones
            if at < least:
                least, where = at, i + 1
        return least, where


    def begin(self, text: str, end: int) -> int:
        """Where a best match that ends at `end` begins: the same search backwards from there."""
        window = text[max(0, end - self.m - self.k) : end][::-1]
        return end - Pattern(self.text[::-1], self.k).best(window, 0, len(window), 1)[1]


class Item(Pattern):
    """An item and its pieces: (offset, piece, parent's offset, parent, parts).

    A budget of k is shared out between two parts as a + b = k - 1, down to parts with none: if an item
    matches, then so does some piece, and each part that contains it, within its own budget. `parent` is the
    smallest part around a piece. Since the piece itself has no error there, one of k+1 `parts` of the rest
    stands unchanged, within k of its place; that is looked up before anything is computed.
    """

    def __init__(self, name, text: str, rate: float, whole_words: bool = False):
        super().__init__(text, 0 if whole_words else min(int(len(text) * rate + 1e-9), len(text) - 1))
        self.name, self.whole_words = name, whole_words
        self.pieces: list[tuple] = []
        self._share(0, self.m, self.k, None, 0)

    def _share(self, start: int, end: int, k: int, parent: Pattern | None, at: int) -> None:
        if k == 0:
            parts = []
            if parent:
                rest = ((at, start), (end, at + parent.m))  # one side is empty
                for lo, hi in rest:
                    cuts = [lo + (hi - lo) * i // (parent.k + 1) for i in range(parent.k + 2)]
                    parts += [(x - start, self.text[x:y]) for x, y in zip(cuts, cuts[1:], strict=False) if x < y]
            self.pieces.append((start, self.text[start:end], at, parent, parts))
            return
        own, a = Pattern(self.text[start:end], k), (k - 1) // 2
        mid = start + (end - start) * (a + 1) // (k + 1)
        self._share(start, mid, a, own, start)
        self._share(mid, end, k - 1 - a, own, start)


def _inside(text: str, at: int) -> bool:
    """Whether text[at] goes on with the word of the character before it."""
    return 0 < at < len(text) and all(c != " " and c < UNSPACED for c in text[at - 1 : at + 1])


class Matcher:
    """All items of a block in one automaton of their pieces."""

    def __init__(self, items: list[tuple], rate: float, least: int):
        self.items = [Item(name, t, rate, len(t) < least) for name, text in items if (t := normal(text))]
        places: dict[str, list[tuple]] = {}
        for n, item in enumerate(self.items):
            for offset, piece, *more in item.pieces:
                places.setdefault(piece, []).append((n, offset, *more))
        self.automaton = ahocorasick.Automaton() if places else None
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item, distance, start, end) for each item that the normalised text holds, at its best place."""
        if not self.automaton or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, int] = {}
        for end, (length, where) in self.automaton.iter(text):
            at = end + 1 - length
            for n, offset, parent_offset, parent, parts in where:
                if self.items[n].whole_words:
                    if n not in short and not _inside(text, at) and not _inside(text, end + 1):
                        short[n] = at
                    continue
                if parent is not None:
                    k = parent.k
                    for o, part in parts:
                        if text.find(part, max(0, at + o - k), at + o + len(part) + k) >= 0:
                            break
                    else:
                        continue
                    begin = at - offset + parent_offset
                    if parent.best(text, max(0, begin - k), min(len(text), begin + parent.m + k))[0] > k:
                        continue
                item = self.items[n]
                start = at - offset  # where the item would begin without insertions or deletions
                windows.setdefault(n, []).append((start - item.k, start + item.m + item.k))
        found = [(self.items[n].name, 0, at, at + self.items[n].m) for n, at in short.items()]
        for n, spans in windows.items():
            item, best = self.items[n], (self.items[n].k + 1, 0)
            spans.sort()
            a, b = spans[0]
            for s, e in [*spans[1:], (1 << 62, 1 << 62)]:
                if s <= b:
                    b = max(b, e)
                    continue
                if min(len(text), b) - max(0, a) >= item.m - item.k:
                    best = min(best, item.best(text, max(0, a), min(len(text), b)))
                a, b = s, e
            if best[0] <= item.k:
                found.append((item.name, best[0], item.begin(text, best[1]), best[1]))
        return found


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of about BLOCK_CHARS; no more than a block and a partition is held."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end (in the normalised text) for each document and item that it holds."""
    spark, out = docs.sparkSession, None
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, start bigint, end bigint"
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    for block in _blocks(items.select("item_id", "text")):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, least)
            for b in sliced(batches):
                rows, ids = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for hit in matcher.find(normal(t)):
                        rows.append(hit)
                        ids.append(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array([r[0] for r in rows], item_kind), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["doc_id", "item_id", "distance", "start", "end"])

        one = narrow.mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """docs without those that hold an item, their columns as they are; rows with null or empty texts stay, without items all do."""
    at = docs.columns.index("text")
    for block in _blocks(items.select("item_id", "text")):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, least)
            for b in sliced(batches):
                yield b.filter(pa.array([not matcher.find(normal(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
