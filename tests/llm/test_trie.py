"""The prefix trie against a plain one, with blocks so small that nodes and groups of equal conversations span many."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyvane.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, words string, n long, depth double, lcps string"


def plain_trie(convs):
    """convs: id -> [(turn, words)]."""
    members = collections.defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(t for t, _ in seq[:d])].append(c)
    kids, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p, ids in members.items():
        weight = (len(ids) - 1) * convs[ids[0]][len(p) - 1][1] if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += weight
    out = []
    for p, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(p))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def in_blocks(convs, size):
    """The operator's steps over blocks of `size` conversations, without Spark."""
    code = lambda t: hashlib.md5(str(t).encode()).digest()
    rows = sorted((b"".join(code(t) for t, _ in seq), c, [w for _, w in seq]) for c, seq in convs.items())
    lcps = [-1] + [trie.common_turns(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)] + [-1]
    same = [False] + [a[0] == b[0] for a, b in zip(rows, rows[1:], strict=False)] + [False]
    blocks = []
    for at in range(0, len(rows), size):
        part, upto = rows[at : at + size], min(len(rows), at + size)
        pack = lambda x, t="<i8": np.array(x, t).tobytes()
        block = trie.Block({"ids": pack([r[1] for r in part]), "lens": pack([len(r[2]) for r in part]), "lcps": pack([-1, *lcps[at + 1 : upto]]), "words": pack(sum((r[2] for r in part), []), "<i4"), "first_lcp": lcps[at], "next_lcp": lcps[upto], "at": at})
        block.first_same = same[at]
        blocks.append((block, same[upto]))
    around = trie.contexts([trie.minima(b) for b, _ in blocks], len(rows))
    out = [r for k, ((b, nxt), (right, left)) in enumerate(zip(blocks, around, strict=True)) for batch in trie.nodes_of(b, k, right, left, nxt) for r in batch.to_pylist()]
    pieces = collections.defaultdict(list)
    for r in out:
        if r["kind"] == 1:
            pieces[r["at"]].append((r["piece"], r["body"]))
    shas = {at: hashlib.sha256(b",".join(body for _, body in sorted(x))).hexdigest() for at, x in pieces.items()}
    return [tuple(r[c] if c != "ends_sha256" or r[c] else shas[r["at"]] for c in trie.COLUMNS) for r in out if r["kind"] == 0]


order = lambda rows: sorted(rows, key=lambda r: (r[1], r[0]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=25), st.integers(1, 7), st.randoms(use_true_random=False))
def test_blocks_equal_plain_trie(seqs, size, rng):
    ids = rng.sample(range(-50, 200), len(seqs))
    convs = {c: [(t, t + 1) for t in seq] for c, seq in zip(ids, seqs, strict=True)}
    assert order(in_blocks(convs, size)) == order(plain_trie(convs))


def make_rows():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 90), *range(-25, 0), 400, 401, 1003]:
        if c % 20 == 0 and rng.random() < 0.3:
            continue
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "hi there", "", None, "a  b\tc", "é \x1c x"])))
    rows += [(c, t, "user", f"same {t}") for c in range(5000, 5100) for t in range(3)]  # one conversation, again and again
    rows += [(7000, t, "user", f"turn {t % 5} of a long one") for t in range(120)] + [(7020, t, "user", f"turn {t % 5} of a long one") for t in range(100)]
    rows += [(None, 0, "user", "nobody"), rows[0], rows[0], (9000, None, "user", "word " * 20_000)]
    return [(*r, "clash", "clash", -1, 0.5, "clash") for r in rows]


def rebuild(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, code, len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    turns = {c: [(code, w) for _, _, code, w in sorted(x)] for c, x in own.items()}
    out = {}
    for c, seq in turns.items():
        h, family = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        out[c] = turns.get(family, [])[:h] + seq[h:]
    return out


@pytest.mark.parametrize("block_turns", [None, 1, 40])
def test_trie_equals_plain(spark, block_turns):
    rows = make_rows()
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), block_turns)
    assert order(map(tuple, got.collect())) == order(plain_trie(rebuild(rows)))


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # loses its only turn: turnless
    assert [tuple(r) for r in trie.prefix_trie(spark.createDataFrame([(c, 0, None, None)], schema)).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
