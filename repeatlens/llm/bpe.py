"""BPE encoding and decoding as streaming transducers.

Encoding holds back only as many symbols as later text can still change. That number,
the sufficient lookahead, follows from the merge list: whether (u, v) merges can depend
on what comes after only through an earlier rule (w, x) that takes, as its left part, a
token w standing at the end of v; and so on along a chain of ever earlier rules. The
longest such chain, in symbols, bounds what must be seen. Tokens that end further than
that before the end of the buffer are final: they are emitted and forgotten, and the rest
of the word is tokenised as if it stood alone, which holds for merge lists whose rules
join only what earlier rules make. ``MergeList`` checks that.

Decoding is a machine that takes ids one by one, turns each into its bytes and emits text
as soon as its characters are complete.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import map_arrow, texts
from repeatlens.llm.latin import is_latin, spelled

BLOCK_CHARS = 1 << 16
ROWS = 256
NEVER = 1 << 60


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others for those from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeList:
    """The merges and ids of a BPE file, and the lookahead that suffices for them."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.lookahead = self._lookahead(pairs)

    def size(self, token: str) -> int:
        return len(token.removesuffix(self.end)) if self.end else len(token)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        made: dict[str, tuple[str, str]] = {}  # token -> its parts
        chain: dict[str, int] = {}  # left part -> longest chain of a rule so far
        longest = 0
        for u, v in pairs:
            for part in (u, v):
                if part not in made and self.size(part) > 1:
                    raise ValueError(f"a merge joins {part!r} before any rule makes it")
            made.setdefault(u + v, (u, v))
            reach, token = 0, v
            while True:  # the tokens that have stood at the end of v
                reach = max(reach, chain.get(token, 0))
                if token not in made:
                    break
                token = made[token][1]
            reach += self.size(v)
            chain[u] = max(chain.get(u, 0), reach)
            longest = max(longest, reach)
        return longest + 1  # one more shows whether the word ends

    def tokens(self, symbols: list[str]) -> list[str]:
        """All merges over these symbols: lowest rank first, leftmost first."""
        ranks, parts, n = self.ranks, list(symbols), len(symbols)
        if n < 48:
            rank = ranks.get
            order = [rank(p, NEVER) for p in zip(parts, parts[1:])]
            while order and (best := min(order)) != NEVER:
                at = order.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del order[at]
                if at:
                    order[at - 1] = rank((parts[at - 1], parts[at]), NEVER)
                if at < len(order):
                    order[at] = rank((parts[at], parts[at + 1]), NEVER)
            return parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, (u, v) = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != u or parts[j] != v:
                continue
            parts[i], parts[j] = u + v, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (parts[i], parts[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, p))
            if (k := before[i]) >= 0 and (p := (parts[k], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[p], k, p))
        return [p for p in parts if p]


class WordEncoder:
    """Takes the bytes of one word piecemeal and emits its tokens once they are final."""

    def __init__(self, merges: MergeList):
        self.merges, self.held = merges, []
        self.most = 2 * merges.lookahead + 64

    def feed(self, data: bytes) -> Iterator[str]:
        """Takes bytes in portions, so that what is held stays under a fixed bound."""
        letter = self.merges.letters.__getitem__
        for at in range(0, len(data), self.merges.lookahead):
            self.held.extend(map(letter, data[at : at + self.merges.lookahead]))
            if len(self.held) > self.most:
                yield from self._stable()

    def _stable(self) -> Iterator[str]:
        final, at = len(self.held) - self.merges.lookahead, 0
        for token in self.merges.tokens(self.held):
            if at + len(token) > final:
                break
            at += len(token)
            yield token
        del self.held[:at]

    def finish(self) -> list[str]:
        if not self.held:
            return []
        self.held[-1] += self.merges.end
        done, self.held = self.merges.tokens(self.held), []
        return done


class Encoder:
    """Ids of texts, word by word; words met before come from a bounded cache."""

    def __init__(self, spec: str, cache: int = 300_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.merges = MergeList(spec)
        parsed = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words = spelled(_word_pattern(parsed["pre_tokenizer"]))
        self.cache, self.most = _Words(self._word), cache

    def _word(self, word: str) -> bytes:
        ids = self.merges.ids
        encoder = WordEncoder(self.merges)
        found = [*encoder.feed(word.encode()), *encoder.finish()]
        return array("I", [ids[t] for t in found if t in ids]).tobytes()

    def _split(self, text: str) -> list[str]:
        if is_latin(text):
            # Here NFC changes nothing and lower case keeps to single characters;
            # beyond, the file's own normaliser and splitter are asked.
            return self.words.findall(text.lower())
        plain = self.tok.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(plain)]

    def feed(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian 32-bit integers, block by block. Blocks end
        before a space, which no token spans."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
                continue
            at = 0
            while at < len(part):
                to = at + BLOCK_CHARS
                if to < len(part):
                    to = _block_end(part, at, to)
                yield b"".join(map(self.cache.__getitem__, self._split(part[at:to])))
                at = to
                self.cache.trim(self.most)

    def encode(self, text: str) -> list[int]:
        return _ids(b"".join(self.feed(text)))


class _Words(dict):
    """Word -> ids; the older half of what was met goes when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word) or self.make(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def trim(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


def _block_end(text: str, at: int, to: int) -> int:
    """The last space or line end after ``at`` and before ``to``, else the first after."""
    before = max(text.rfind(c, at + 1, to) for c in " \n")
    if before >= 0:
        return before
    return min((i for c in " \n" if (i := text.find(c, to)) >= 0), default=len(text))


def _ids(data: bytes) -> array:
    ids = array("I")
    ids.frombytes(data)
    return ids


def _word_pattern(pre: dict) -> str:
    """The regular expression by which the file splits words."""
    for step in pre.get("pretokenizers", [pre]):
        if step["type"] == "Split" and step.get("invert") and "Regex" in step["pattern"]:
            return step["pattern"]["Regex"]
    raise ValueError("the file does not split words by a pattern of words")


class Decoder:
    """Ids in, text out, piece by piece.

    ``spaced`` gives what the tokenizers library's ``decode`` gives for a file without a
    decoder: the names of the tokens, with spaces between. Otherwise the tokens' bytes
    become text, word ends become spaces, and a character split between tokens is held
    back until its last byte; bytes that form no character become U+FFFD.
    """

    def __init__(self, spec: str, spaced: bool):
        parsed = json.loads(spec)
        names = {i: t for t, i in parsed["model"]["vocab"].items()}
        names |= {t["id"]: t["content"] for t in parsed.get("added_tokens", [])}
        special = {t["id"] for t in parsed.get("added_tokens", [])}
        if spaced and parsed.get("decoder"):
            raise ValueError("names with spaces between fit only files without a decoder")
        end = parsed["model"].get("end_of_word_suffix") or ""
        back = {c: bytes([b]) for b, c in byte_letters().items()}

        def raw(i: int, name: str) -> bytes:
            if spaced or i in special:
                return name.encode()
            ends = bool(end) and name.endswith(end)
            body = name[: -len(end)] if ends else name
            return b"".join(back.get(c, c.encode()) for c in body) + b" " * ends

        self.pieces = {i: raw(i, name) for i, name in names.items()}
        self.spaced, self.begun = spaced, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        found = [self.pieces[i] for i in ids if i in self.pieces]
        if not found:
            return ""
        between = b" " if self.spaced else b""
        data = between.join(found)
        if self.begun:
            data = between + data
        self.begun = True
        return self.state.decode(data)

    def finish(self) -> str:
        rest = self.state.decode(b"", final=True)
        self.state.reset()
        self.begun = False
        return rest


_MACHINES: dict[int, tuple[Encoder, Decoder]] = {}


def _machines(key: int, spec: str, spaced: bool) -> tuple[Encoder, Decoder]:
    if (key, spaced) not in _MACHINES:
        _MACHINES[key, spaced] = Encoder(spec), Decoder(spec, spaced)
    return _MACHINES[key, spaced]


def bpe_digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (little-endian, 32 bits) and of the
    decoded text (UTF-8, as the library's ``decode`` gives it with special tokens).

    Ids and text are hashed as they are emitted, so a long text is never held twice. Null
    texts are encoded as empty: 0 tokens, digests of nothing. A null id stays null,
    repeated rows give repeated rows, an empty table gives none.
    """
    spec, key = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _machines(key, spec.value, True)
        for part in _parts(batches):
            n, ids_sha, text_sha = [], [], []
            for text in part.column(1).to_pylist():
                ids_hash, text_hash, count = hashlib.sha256(), hashlib.sha256(), 0
                for data in encoder.feed(text):
                    ids_hash.update(data)
                    count += len(data) // 4
                    text_hash.update(decoder.feed(_ids(data)).encode())
                text_hash.update(decoder.finish().encode())
                n.append(count)
                ids_sha.append(ids_hash.hexdigest())
                text_sha.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(
        texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def bpe_encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and ``token_ids`` (array of int); null texts give an empty array."""
    spec, key = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _machines(key, spec.value, False)
        for part in _parts(batches):
            ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.list_(pa.int32()))],
                names=["doc_id", "token_ids"],
            )

    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, token_ids array<int>")


def bpe_decode(
    encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids", spaced: bool = False
) -> DataFrame:
    """doc_id and ``decoded`` of encoded rows; a null array decodes as empty, and ids that
    the file does not know are passed over."""
    spec, key = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _machines(key, spec.value, spaced)
        for part in _parts(batches):
            out = [decoder.feed(ids or ()) + decoder.finish() for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(out, pa.string())], names=["doc_id", "decoded"]
            )

    rows = encoded.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{ids_col}`").cast("array<int>").alias("token_ids"),
    )
    return map_arrow(rows, run, "doc_id long, decoded string")


def bpe_round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, token_ids, n_tokens and ``decoded``, the text of the tokens; null texts give
    an empty array and an empty text."""
    spec, key = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _machines(key, spec.value, False)
        for part in _parts(batches):
            ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
            out = [decoder.feed(i) + decoder.finish() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(out, pa.string())],
                names=["doc_id", "token_ids", "n_tokens", "decoded"],
            )

    return map_arrow(
        texts(docs, id_col, text_col), run, "doc_id long, token_ids array<int>, n_tokens long, decoded string"
    )


def _shared(df: DataFrame, path: str):
    spec = open(path, encoding="utf-8").read()
    return df.sparkSession.sparkContext.broadcast(spec), hash(spec)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
