"""op13 against a trie built in plain Python, with the edge cases that its docstring states."""

import hashlib
import zlib

import pytest

from quarry.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, place string"


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [x[1] for x in sorted(v)] for c, v in own.items()}
    if not own:
        return []
    nodes = [{"depth": 0, "up": None, "members": [], "ends": [], "bytes": 0, "below": {}}]
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        at = nodes[0]
        at["members"].append(c)
        for turn in own.get(base, [])[:h] + own[c][h:]:
            if turn not in at["below"]:
                at["below"][turn] = {"depth": at["depth"] + 1, "up": at, "members": [], "ends": [], "bytes": len(turn[1].encode()), "below": {}}
                nodes.append(at["below"][turn])
            at = at["below"][turn]
            at["members"].append(c)
        at["ends"].append(c)
    for n in nodes[::-1]:  # a node stands after the one above it
        n["leaves"] = sum(b["leaves"] for b in n["below"].values()) or 1
        n["saved"] = (len(n["members"]) - 1) * n["bytes"] + sum(b["saved"] for b in n["below"].values())
    return sorted(
        (n["members"][0], n["depth"], n["up"]["members"][0] if n["up"] else -1, len(n["members"]), len(n["below"]), n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest())
        for n in nodes
    )


def check(spark, rows):
    found = trie.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())
    assert got == plain_trie(rows)
    return got


def chat(c, words):
    return [(c, i, "user" if i % 2 == 0 else "assistant", w) for i, w in enumerate(words)]


def test_shared_openings_and_copies(spark):
    rows = [r for c in range(60) for r in chat(c, ["hello", "hi", f"b{c % 3}", f"c{c % 7}", "same", "x", "y", "z", "w", f"end {c}"][: 3 + c % 8])]
    rows += [r for c in range(100, 150) for r in chat(c, ["a", "copy", "é", "of", "them", "all", "and", "more", "turns", "here"])]
    got = check(spark, rows)
    assert got[0][:4] == (0, 0, -1, 110)


def test_one_long_conversation_and_prefixes_of_it(spark, monkeypatch):
    """Blocks of four places; every conversation goes on where a shorter one ends, so that the heavy path is long."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    words = [f"turn {i // 2}" for i in range(70)]
    rows = [r for c in range(0, 300, 5) for r in chat(c, words[: 10 + c // 5])] + [(10_000_000 + i, 0, "user", "hello") for i in range(7)]
    got = check(spark, rows)
    assert max(g[1] for g in got) == 69


def test_hot_end_is_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)
    rows = [(c, 0, "user", "one for all") for c in range(-40, 200)]
    check(spark, rows)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rows = [(0, None, "user", None), (0, 2, None, "x"), (0, 2, "a", "b"), (0, 1, "user", "long " * 50_000), (0, 2, "a", "b"), (0, -3, "", "")]
    rows += [(c, t, r, x) for c in (1, 2, 3, 4, 9, 13, -1, -7, 2**62) for _, t, r, x in rows[:4]]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (5, 1, "a:", "b"), (5, 2, "a", ":b"), (6, 1, "ab", ""), (7, 1, "a", "b")]
    check(spark, rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    """A conversation that loses all its turns, and whose base is not there, is left without any."""
    rows = [(c, 0, "user", "x") for c in range(1, 40) if c % 5]
    got = check(spark, rows)
    assert got[0][0] == 1 and got[0][1] == 0 and got[0][3] == 32


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")]])
def test_nothing(spark, rows):
    assert check(spark, rows) == []
