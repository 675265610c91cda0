"""The conversation trie and the repair of conversations, against brute force."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from seriesmill.llm import conversation_repair, conversation_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def made(rng, convs=140):
    """Conversations in hundreds, with shared openings, repeats, ties, gaps and nulls."""
    openings = [[(rng.choice(["system", "user", None]), rng.choice(["Hi.", "", None, "é?"])) for _ in range(rng.randint(0, 7))] for _ in range(5)]
    rows = []
    for i in range(convs):
        conv = rng.choice([i, i + 100, 1000 + i])
        turns = [*rng.choice(openings), *[(rng.choice(["user", "assistant", "tool", ""]), rng.choice(["a.", "b", "c!\n", " \t", "long " * 40])) for _ in range(rng.randint(0, 4))]] or [("user", "x")]
        rows += [(conv, rng.choice([None, k, k, k, k + 1]), role, text) for k, (role, text) in enumerate(turns)]
    return rows + [(None, 0, "user", "nobody's."), (700, 1, "user", "twice"), (700, 1, "user", "twice")]


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest(role or "", text or ""), role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    full = {c: [*own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)], *own[c][h:]] for c in own}
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: [k for k in below if len(k) == len(n) + 1 and k[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(convs) if len(full[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids(node)), sum(not kids(n) for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed):
    queries.prepare(spark)
    rows = made(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("pos", "node", "rep", "depth", "tokens")}).repartition(5)
    got = [tuple(r) for r in conversation_trie.conversation_trie(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_alike_and_of_no_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(30) for t in range(40)]
    assert {tuple(r) for r in conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_trie(rows)
    assert conversation_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_repair(roles_faults):
    """Least cost and least string of edits, by looking at all of them from each row and state."""

    @cache
    def best(i, kept, inserted):
        ways = []
        if re.fullmatch("(s?(ua)+)?", kept) and i == len(roles_faults):
            ways.append((0, ""))
        if i < len(roles_faults):
            role, fault = roles_faults[i]
            more = 3 if fault == "t" else 0
            steps = [("D", 4, kept)]
            if fault not in ("b", "d"):
                steps += [("K", more, kept + role), ("R", 3 + more, kept + "u"), ("R", 3 + more, kept + "a")]
        else:
            steps = []
        steps = [(e, c, k, i + 1, 0) for e, c, k in steps]
        if inserted < 2:
            steps += [("I", 3, kept + r, i, inserted + 1) for r in "ua"]
        for edit, cost, roles, j, n in steps:
            if re.fullmatch("s?(ua)*u?", roles):
                # What is kept matters by its state only.
                state = "s" if roles == "s" else "" if not roles else "u" if roles.endswith("u") else "ua"
                if (rest := best(j, state, n)) is not None:
                    ways.append((cost + rest[0], edit + rest[1]))
        return min(ways, default=None)

    return best(0, "", 0)


def test_costs_and_audits():
    rng = random.Random(5)
    marks = {("s", ""): "s", ("u", ""): "u", ("a", ""): "a", ("x", ""): "x", ("s", "t"): "S", ("u", "t"): "U", ("a", "t"): "A", ("x", "t"): "X"}
    cases = {}
    for _ in range(1500):
        rows = [(rng.choice("suaxua"), rng.choice(["", "", "t", "b", "d"])) for _ in range(rng.randint(0, 9))]
        cases["".join(marks.get(r, "d") for r in rows)] = brute_repair(tuple(rows))
    got = {s: (cost, audit) for s, cost, audit in conversation_repair.repair_sorted(iter(sorted(cases)))}
    assert got == cases


def test_layers_are_made_once_for_a_shared_prefix(monkeypatch):
    made, layer = [], conversation_repair.next_layer
    monkeypatch.setattr(conversation_repair, "next_layer", lambda *a: made.append(1) or layer(*a))
    signatures = sorted("ua" * 50 + tail for tail in ("", "u", "ua", "S", "ds", "du"))
    assert len(list(conversation_repair.repair_sorted(iter(signatures)))) == 6
    assert len(made) == len({s[:n] for s in signatures for n in range(1, len(s) + 1)})


def brute_conversations(rows):
    plain = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = plain(role), plain(text)
        hit, at = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20, digest(role, text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        mine += [((turn is not None, turn or 0), at, n, turn, role, text) for n in range(0 if hit == 0 else 2 if hit == 3 else 1)]
    for conv, mine in convs.items():
        mine.sort(key=lambda r: r[:3])
        faults, seen = [], set()
        for *_, role, text in mine:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        roles = [r[4][:1] if r[4][:1] in ("s", "u", "a") else "x" for r in mine]
        cost, audit = brute_repair(tuple(zip(roles, faults, strict=True)))
        lines, left, state = [], iter(mine), ""
        for edit in audit:
            row = next(left) if edit != "I" else None
            need = "assistant" if state == "u" else "user"
            if edit != "D":
                role = row[4] if edit == "K" else need
                lines.append(f"{role}:{row[5] if row else ''}")
                state = role[0]
        turns = [r[3] for r in mine if r[3] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        yield conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(2))
def test_repair(spark, seed):
    queries.prepare(spark)
    rows = made(random.Random(seed + 10))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("at", "again", "lost", "signature", "audit", "part")}).repartition(5)
    got = [tuple(r) for r in conversation_repair.repair_conversations(df).collect()]
    assert sorted(got, key=repr) == sorted(brute_conversations(rows), key=repr)


def test_repaired_rows(spark):
    queries.prepare(spark)
    df = spark.createDataFrame(made(random.Random(4)), SCHEMA)
    rows = conversation_repair.damaged(df)
    audits = conversation_repair.audit_conversations(rows)
    want = {r["conv_id"]: r["repaired_sha256"] for r in conversation_repair.repair_conversations(df).collect()}
    lines = {}
    for r in conversation_repair.repaired_rows(rows, audits).orderBy("n").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, sha in want.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == sha


def test_no_rows_to_repair(spark):
    assert conversation_repair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
