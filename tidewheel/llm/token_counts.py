"""Token counts with a whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges each by itself. Before any text is read, the
driver proves which vocabulary strings encode alone as one token: the string must be valid UTF-8, be one
pre-token, and the library must give exactly one id for it. Pre-tokens in that set count one; only the
rest is merged, each distinct string once per batch and worker memo.

Texts are cut at spaces between two non-space characters first: such a space always begins a pre-token,
so the count of a piece doesn't depend on its neighbours, and pieces repeat often.

What the proof rests on is read from the file. A .json whose split, normalizer or added tokens are others than those
of a plain byte-level BPE is counted by its library, text by text (`LibraryCounter`). A .model (sentencepiece) is cut
before each run of word marks, if no vocabulary string goes over such a place, and its library counts each distinct
pre-token once; the texts' normal form comes from the library, and a pre-token counts by itself only where it is its
own normal form.

Rows: null and empty texts have 0 tokens; a text of any length is handled whole; special strings inside
a text count as the library's default says (one token each); an empty table gives no rows; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import sliced, table

LIMIT = 512
#: Characters of texts whose pieces are held at a time; a longer text is held by itself.
_AT_ONCE = 1 << 20
#: The library's split of byte-level BPE; its white space has no 0x1C-0x1F, unlike the regex module's.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?(?:[^\p{White_Space}\p{L}\p{N}])+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_EDGE_SPACE = re.compile(r"^\s| [^\S ]|[^\S ] |\s$")
_INNER_SPACE = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven_whole(tokenizer_json: str) -> frozenset[str]:
    """The vocabulary strings, as text, that encode alone as one token. At most as many as the vocabulary has."""
    from tokenizers import Tokenizer

    letters = byte_letters()
    candidates = []
    for token in json.loads(tokenizer_json)["model"]["vocab"]:
        try:
            text = bytes(letters[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and SPLIT.fullmatch(text) and len(SPLIT.findall(text)) == 1:
            candidates.append(text)
    encoded = Tokenizer.from_str(tokenizer_json).encode_batch(candidates, add_special_tokens=False)
    return frozenset(t for t, e in zip(candidates, encoded, strict=True) if len(e.ids) == 1)


def splits_as_known(spec: dict) -> bool:
    """Whether SPLIT is the tokenizer's own split, and its special strings are cut out as they are."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model.get("dropout"):
        raise ValueError("with dropout a text has no one count of tokens")
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    bare = model.get("type") == "BPE" and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "unk_token"))
    return plain and bare and not spec.get("normalizer") and not any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip"))


class LibraryCounter:
    """Counts whole texts with the library, without truncation or padding."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: list[str | None]) -> list[int]:
        return [len(self.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


MARK = "\u2581"
_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCounter:
    """Counts with a sentencepiece model; keeps a bounded memo of pre-tokens, which are cut before each run of marks."""

    def __init__(self, model: bytes, whole: frozenset[str] = frozenset(), memo: int = 200_000):
        import sentencepiece

        self.library, self.whole, self.most = sentencepiece.SentencePieceProcessor(model_proto=model), whole, memo
        self.counts: dict[str, int | None] = {}
        vocabulary = self.vocabulary()
        #: No vocabulary string goes on behind such a cut, and a mark by itself is one, so pre-tokens don't meet.
        self.cuts = MARK in vocabulary and not any(re.search(f"[^{MARK}]{MARK}", v) for v in vocabulary)

    def vocabulary(self) -> set[str]:
        return {self.library.id_to_piece(i) for i in range(self.library.vocab_size())}

    def alone(self, token: str) -> int | None:
        """The library's count of a pre-token; None where no text has it as its normal form."""
        text = token.replace(MARK, " ")
        for t in (text[1:], text):
            if self.library.normalize(t) == token:
                return len(self.library.encode(t))
        return None

    def proven_whole(self) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        return frozenset(v for v in self.vocabulary() if _MARKED.fullmatch(v) and self.alone(v) == 1) if self.cuts else frozenset()

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.counts) > self.most:
            self.counts.clear()
        return [self._count(t) if t else 0 for t in texts]

    def _count(self, text: str) -> int:
        n = 0
        for token in _MARKED.findall(self.library.normalize(text)) if self.cuts else (None,):
            if token in self.whole:
                n += 1
                continue
            if token is not None and token not in self.counts:
                self.counts[token] = self.alone(token)
            own = self.counts.get(token)
            if own is None:
                return len(self.library.encode(text))
            n += own
        return n


class Counter:
    """Counts tokens; keeps a bounded memo of pieces."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str], memo: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.whole, self.most = Tokenizer.from_str(tokenizer_json), whole, memo
        self.pieces: dict[str, int] = {}
        self.special = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", ())]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def learn(self, pieces: set[str]) -> None:
        """Adds pieces to the memo: proven pre-tokens count one, the others are merged."""
        split = {p: [p] if p[1:].isalpha() and p[0] == " " else SPLIT.findall(p) for p in pieces}
        rest = {t for ts in split.values() for t in ts} - self.whole
        merged = self.merge(sorted(t for t in rest if t[0] == " " and t[1:].isalpha()))
        other = [t for t in rest if t not in merged]
        if other:
            merged.update(zip(other, (len(e.ids) for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)), strict=True))
        self.pieces.update((p, sum(merged.get(t, 1) for t in ts)) for p, ts in split.items())

    def merge(self, spaced: list[str], at_once: int = 500) -> dict[str, int]:
        """Counts of pre-tokens that are a space and letters: many are merged in one call, as each begins a new pre-token."""
        counts: dict[str, int] = {}
        for i in range(0, len(spaced), at_once):
            some = spaced[i : i + at_once]
            e = self.tokenizer.encode("".join(some), add_special_tokens=False)
            n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
            counts.update(zip(some, n.tolist(), strict=True))
        return counts

    def pieces_of(self, text: str) -> list[str]:
        words = text.split(" ")
        # plain: every space stands between two characters that aren't white space
        if all(words) and not _EDGE_SPACE.search(text):
            return [words[0], *map(" ".__add__, words[1:])]
        at = [0, *(m.start() for m in _INNER_SPACE.finditer(text)), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]

    def parts_of(self, text: str) -> tuple[int, list[str]]:
        """The special strings in a text, and the pieces of the rest."""
        if not any(s in text for s in self.special):
            return 0, self.pieces_of(text)
        parts = [p for p in self.cut.split(text) if p]
        return len(self.cut.findall(text)), [x for p in parts for x in self.pieces_of(p)]

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(texts):
            if len(self.pieces) > self.most:
                self.pieces.clear()
            held, size, new = [], 0, set()
            while at < len(texts) and size < _AT_ONCE:  # pieces are learned for many texts at once
                text = texts[at] or ""
                n, pieces = self.parts_of(text) if text else (0, [])
                held.append((n, pieces))
                new.update(pieces)
                size += len(text)
                at += 1
            new.difference_update(self.pieces)
            if new:
                self.learn(new)
            out += [n + sum(map(self.pieces.__getitem__, pieces)) for n, pieces in held]
        return out


def _plan(spark: SparkSession, tokenizer_path: str) -> tuple:
    """The counter's class, and what it is made of as a broadcast."""
    raw = Path(tokenizer_path).read_bytes()
    if tokenizer_path.endswith(".model"):
        make, parts = PieceCounter, (raw, PieceCounter(raw).proven_whole())
    else:
        spec = raw.decode()
        make, parts = (Counter, (spec, proven_whole(spec))) if splits_as_known(json.loads(spec)) else (LibraryCounter, (spec,))
    return make, spark.sparkContext.broadcast(parts)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. The vocabulary is read on the driver and broadcast (a few MB, by its file's size).

    tokenizer_path: a tokenizers .json or a sentencepiece .model.
    """
    make, shared = _plan(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = make(*shared.value)
        for b in sliced(batches):
            n = counter.count(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    counted = narrow.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
