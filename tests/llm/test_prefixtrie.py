import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from patronmap.llm import prefixtrie

SCHEMA = "conv_id bigint, turn int, role string, text string, ids string, path int, shard int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    """All prefixes of all rebuilt conversations, in Python."""
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            given[conv].append(((turn is not None, turn or 0), key, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in given.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(int)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, members in nodes.items():
        gain = (len(members) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += gain
    out = []
    for path, members in nodes.items():
        text = ",".join(map(str, sorted(ends[path])))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), children[path], leaves[path], saved[path], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    return sorted([tuple(r) for r in prefixtrie.conversation_trie(df, **options).select(*prefixtrie.RESULT).collect()], key=str)


def chats(n, seed=1):
    draw = random.Random(seed)
    out = []
    for c in range(n):
        for turn in range(draw.randrange(1, 7)):
            out.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["hi there", "yes", "a b c d", ""])))
    return out


@pytest.mark.parametrize("shard_turns", [5, 60, 100_000])
def test_equals_brute_force(spark, shard_turns):
    rows = chats(150)
    assert result(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_hot_groups_nulls_ties_and_long_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(400, 700) for t in range(3)]  # copies over many shards
    rows += [(c, None, None, None) for c in range(20)] + [(None, 1, "user", "x")]
    rows += [(1000, t, "user", f"turn {t % 7}") for t in range(700)] + [(1001, t, "user", f"turn {t % 7}") for t in range(650)]
    rows += [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (-21, 2, "user", "m"), (-20, 1, "user", "n")]
    rows += [(2001, 0, "user", "long " * 50000), (2002, 1, "ab", "c"), (2003, 1, "a", "bc")]
    for shard_turns in (40, 2000):
        assert result(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    turnless = next(c for c in range(101, 120) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(turnless, 1, "user", "x")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows)[0][:7] == (turnless, 0, None, 1, 0, 1, 0)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_middles_are_balanced():
    assert sorted(prefixtrie.middles(100)) == list(range(100))
    import numpy as np

    tree, none = prefixtrie.TernaryTree(), np.zeros(1, int)
    for place in prefixtrie.middles(1023):
        tree.insert(np.array([place]), none, [place])

    def deepest(node):
        return 0 if node < 0 else 1 + max(deepest(tree.low[node]), deepest(tree.high[node]))

    assert deepest(tree.equal[0]) == 10
