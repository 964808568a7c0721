import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from repeatlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, j int, nid string, n int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def _tid(role, text):
    said = f"{len(role.encode())}:{role}{text}"
    return hashlib.sha256(said.encode()).digest()[:16]


def _rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), _tid(role, text), (role, text)))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        out[c] = own.get(c - rest, [])[:h] + turns[h:]
    return out


def _expected(rows):
    convs = _rebuilt(rows)
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1].encode()) if path else 0
    out = Counter()
    for path, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(nodes[path[:-1]]) if path else None
        out[
            min(members), len(path), parent, len(members), children[path],
            leaves[path], saved[path], digest,
        ] += 1
    return out


def _rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample([*range(-20, 80), 10**15, -(10**15), 2**63 - 1, 2**63 - 2, -(2**63)], n):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "user", None, ""])
            rows.append((conv, rng.choice([turn, turn, None, turn // 2]), role, rng.choice(["Hé", "b", "", None])))
    return rows + rng.sample(rows, 20)  # repeated rows


@pytest.mark.parametrize("block", [1, 2, 4, 7])
def test_against_plain_nodes(spark, block):
    rows = [*_rows(block), (None, 1, "user", "no conversation")]
    got = prefix_trie.conversation_trie(_frame(spark, rows), block)
    assert got.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    assert Counter(map(tuple, got.collect())) == _expected(rows)


def test_long_and_hot_conversations(spark, monkeypatch):
    """Many blocks in one conversation, a third of all rows in it, many equal conversations."""
    monkeypatch.setattr(prefix_trie, "PACK", 40)
    rows = [(3, t, "user", f"turn {t % 7}") for t in range(400)]
    rows += [(4, None, "user", "same")] * 150
    rows += [(5 * c, t, "user", f"turn {t}") for c in range(100, 250) for t in range(2)]
    got = prefix_trie.conversation_trie(_frame(spark, rows))
    assert Counter(map(tuple, got.collect())) == _expected(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    # 1: nothing is left of its own turns, and conversation 0 is absent.
    rows = [(1, 0, "user", "hello")]
    assert zlib.crc32(b"1") % 9 > 0
    got = prefix_trie.conversation_trie(_frame(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_no_rows(spark):
    assert prefix_trie.conversation_trie(_frame(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(_frame(spark, [(None, 1, "a", "b")])).count() == 0
