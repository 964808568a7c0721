import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repeatlens.llm import bpe, token_counts
from tests.llm.cases import AWKWARD, frame

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    *(t or "" for _, t in AWKWARD),
    "Hello  wörld's <|endoftext|> 123 x<|startoftext|>",
    "don't won'T 123abc ½ ² Σας ΟΔΟΣ x̀́ a\x1cb\x85c\xa0d",
    "!?." * 700,
    "".join(random.Random(5).choice("abcdehinotrs") for _ in range(5000)),
    "one " * 40000 + "two",
]


@pytest.fixture(scope="module")
def spec():
    return open(WORDS, encoding="utf-8").read()


def test_stream_equals_library(spec):
    library, encoder = Tokenizer.from_file(WORDS), bpe.Encoder(spec)
    for text in TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        assert list(encoder.encode(text)) == want


def test_lookahead_bounds_what_is_held(spec):
    merges = bpe.MergeList(spec)
    word = TEXTS[-2].encode()
    encoder, most, out = bpe.WordEncoder(merges), 0, []
    for byte in word:
        out += encoder.feed(bytes([byte]))
        most = max(most, len(encoder.held))
    out += encoder.finish()
    symbols = [merges.letters[b] for b in word]
    symbols[-1] += merges.end
    assert out == merges.tokens(symbols)
    assert most <= encoder.most + 1


def test_both_merge_loops_agree(spec):
    merges, r = bpe.MergeList(spec), random.Random(2)
    for _ in range(200):
        symbols = [r.choice("theranio") for _ in range(40)]
        long = merges.tokens(symbols * 2)
        assert "".join(long) == "".join(symbols * 2)
        assert merges.tokens(symbols) == _slow(merges, symbols)


def _slow(merges, parts):
    parts = list(parts)
    while pairs := [(merges.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges.ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_text_decoding_is_incremental(spec):
    encoder, decoder = bpe.Encoder(spec), bpe.Decoder(spec, spaced=False)
    ids = encoder.encode("wörld 日本 ☃")
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "wörld 日本 ☃ "


def test_digests(spark):
    library = Tokenizer.from_file(WORDS)
    got = bpe.bpe_digests(frame(spark, AWKWARD), WORDS).collect()
    want = []
    for i, text in AWKWARD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_then_decode(spark):
    docs = frame(spark, AWKWARD).filter("doc_id < 6")
    encoded = bpe.bpe_encode(docs, WORDS)
    decoded = bpe.bpe_decode(encoded, WORDS)
    again = {r["doc_id"]: r["decoded"] for r in decoded.collect()}
    assert again[3] == "the same text twice " and again[1] == ""
    both = {r["doc_id"]: r["decoded"] for r in bpe.bpe_round_trip(docs, WORDS).collect()}
    assert both == again


def test_counts_equal_library(spark):
    library = Tokenizer.from_file(BYTES)
    rows = [*AWKWARD, *((100 + k, t) for k, t in enumerate(TEXTS))]
    got = token_counts.count_tokens(frame(spark, rows), BYTES).collect()
    want = []
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False))
        want.append((i, len((text or "").encode()), n, n > 1024))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_latin_splitters_agree_with_library(spec):
    counter_spec = open(BYTES, encoding="utf-8").read()
    one, two = Tokenizer.from_str(counter_spec), Tokenizer.from_str(spec)
    counter, encoder = token_counts.TokenCounter(counter_spec, ("", b"")), bpe.Encoder(spec)
    for c in map(chr, range(0x200)):
        text = f"a{c}A 1{c} {c}{c}!{c} B{c}'s"
        assert counter.count(text) == len(one.encode(text, add_special_tokens=False))
        assert list(encoder.encode(text)) == two.encode(text, add_special_tokens=False).ids


def test_cache_of_counts_is_bounded():
    counter = token_counts.TokenCounter(open(BYTES, encoding="utf-8").read(), ("", b""), cache=50)
    text = " ".join(f"w{i}q" for i in range(300))
    assert counter.count(text) == len(counter.tok.encode(text, add_special_tokens=False))
    assert len(counter) <= 51


def test_empty_tables(spark):
    none = frame(spark, AWKWARD).filter(F.lit(False))
    assert token_counts.count_tokens(none, BYTES).count() == 0
    assert bpe.bpe_digests(none, WORDS).count() == 0
