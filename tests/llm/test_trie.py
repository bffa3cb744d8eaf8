import hashlib
import re
import zlib

import duckdb
import numpy as np

from spotweave.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)


def brute(rows):
    told = {}
    for c, t, role, text in rows:
        if c is not None:
            told.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    told = {c: [x[2:] for x in sorted(v)] for c, v in told.items()}
    whole = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(told.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes)]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(whole[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves),
                    sum((len(nodes[q]) - 1) * words(q) for q in under), hashlib.sha256(ends.encode()).hexdigest(), ends.count(",") + 1 if ends else 0))
    return sorted(out, key=lambda r: (r[1], r[0]))


def nodes_of(frame):
    return sorted([tuple(r) for r in trie.prefix_trie(frame).collect()], key=lambda r: (r[1], r[0]))


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 6))):
            rows.append((c, t, ["user", "assistant"][t % 2], " ".join(rng.choice(["a", "b\tc", "d\ne"], int(rng.integers(0, 3))))))
    return rows


def test_against_loops(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_PIECE", 3)
    rng = np.random.default_rng(1)
    rows = conversations(rng, 90)
    rows += [(c, t, "user", "same words here") for c in range(200, 260) for t in range(4)]  # one large group of copies
    rows += [(-7, 0, "user", "minus"), (-7, 1, "assistant", "one"), (-20, 3, "user", "base"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(300, None, "user", "first"), (300, 0, "user", "second"), (301, 1, None, None), (302, 0, "", ""), (303, 0, "us", "er x"), (304, 0, "user", " x")]
    rows += [(305, 0, "user", "again"), (305, 0, "user", "again"), (306, 5, "user", "y"), (306, 5, "assistant", "y"), (306, 5, "assistant", "x")]
    rows += [(400, t, "user", f"long {t % 3}") for t in range(300)] + [(401, t, "user", f"long {t % 3}") for t in range(150)]
    frame = table(spark, rows).repartition(7)
    want = brute(rows)
    assert nodes_of(frame) == want
    assert sum(r[8] for r in want) == len({r[0] for r in rows if r[0] is not None}) and any(r[8] > 9 for r in want)


def test_conversations_without_turns_of_their_own(spark):
    """Ids whose head is longer than they are and whose base is missing: they end at the root, which may be the only node."""
    ids = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    rows = [(c, t, "user", "gone") for c in ids for t in range(2)]
    assert nodes_of(table(spark, rows)) == brute(rows) and len(brute(rows)) == 1
    assert trie.prefix_trie(table(spark, [])).count() == 0


def test_sql_says_the_same(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = conversations(rng, 60) + [(-3, 0, "user", "m"), (None, 1, "user", "n"), (61, None, None, "o")]
    table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op13_conversation_prefix_trie"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["op13_conversation_prefix_trie"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
