"""Token counts by a two-tier look-up of pre-token lengths.

Tier one is a table of frequent pre-tokens that the driver broadcasts: the pieces of the
vocabulary itself, bare and after a space. A merge list is ordered by frequency, so these
are the frequent pre-tokens of public text; their number is at most twice the size of the
vocabulary. It travels as one string and one byte array. Tier two is a cache in each
Python worker for the rest, bounded by two generations. Only pre-tokens missing from both
are encoded. No pre-token is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import map_arrow, texts
from repeatlens.llm.latin import is_latin, spelled

# Fixed value: how byte-level BPE files of this family split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 512


def frequent_lengths(spec: str) -> tuple[str, bytes]:
    """Pre-tokens joined by a character that no pre-token of the table holds, and their lengths."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    pattern = regex.compile(PATTERN)
    pieces = set()
    for piece in tok.get_vocab():
        word = piece.replace("Ġ", " ")
        if word.isascii() and "\n" not in word and "\t" not in word:
            pieces.update(w for w in (word, " " + word) if pattern.fullmatch(w))
    pieces -= _specials(spec)
    ordered = sorted(pieces)
    lengths = [len(e) for e in tok.encode_batch(ordered, add_special_tokens=False)]
    return "\n".join(ordered), bytes(min(n, 255) for n in lengths)


def _specials(spec: str) -> set[str]:
    return {t["content"] for t in json.loads(spec).get("added_tokens", [])}


class TokenCounter(dict):
    """Lengths of pre-tokens: the frequent ones, then those this worker has met."""

    def __init__(self, spec: str, frequent: tuple[str, bytes], cache: int = 400_000):
        from tokenizers import Tokenizer

        words, lengths = frequent
        self.tier = dict(zip(words.split("\n"), lengths, strict=True)) if lengths else {}
        super().__init__(self.tier)
        self.old: dict[str, int] = {}
        self.most = len(self.tier) + cache
        self.tok = Tokenizer.from_str(spec)
        specials = sorted(_specials(spec), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")
        self.pattern = spelled(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = len(self.tok.encode(piece, add_special_tokens=False))
        if len(piece) <= 64:
            if len(self) >= self.most:
                # The younger generation becomes the older one, which goes.
                self.old = {k: v for k, v in self.items() if k not in self.tier}
                self.clear()
                self.update(self.tier)
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        if is_latin(text):
            return self.pattern.findall(text)
        # Beyond, regular-expression libraries differ in their classes: the file's own
        # splitter is asked.
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts if p)


_COUNTERS: dict[int, TokenCounter] = {}


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text, by the vocabulary file at ``path``.

    Null texts count as empty: 0 bytes, 0 tokens. Special strings inside a text are
    tokens of their own, as the library has it. Repeated rows give repeated rows, a null
    id stays null, and an empty table gives no rows. Texts of any length are counted whole.
    """
    spec = open(path, encoding="utf-8").read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, frequent_lengths(spec)))
    key = hash(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(key)
        if counter is None:
            counter = _COUNTERS[key] = TokenCounter(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = [counter.count(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    rows = texts(docs, id_col, text_col).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text"
    )
    counted = map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
