import hashlib
import itertools
import random
import re
import zlib
from functools import reduce

from corpusloom.llm import conversation_repair as cr
from tests.llm.helpers import frame

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_edits(rows):
    """The least (cost, audit) and what it makes, over every list of edits, for rows (role, text, fault)."""
    best = 3 * len(rows), "D" * len(rows), []

    def go(i, cost, audit, turns, gap):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows):
            if LEGAL.fullmatch("".join(t[0][:1] or "?" for t in turns)) and (cost, audit) < best[:2]:
                best = cost, audit, turns
        if gap < 2:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*turns, (role, "")], gap + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", turns, 0)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(i + 1, cost + more, audit + "K", [*turns, (role, text)], 0)
                for other in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*turns, (other, text)], 0)

    go(0, 0, "", [], 0)
    return best


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        name = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        out.append((role, text, name))
        seen.add((role, text))
    return out


def damaged(rows):
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            yield from [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def brute(rows):
    out = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}
    left = list(damaged(rows))
    for conv in {r[0] for r in left}:
        own = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        marked = faults([r[1:] for r in own])
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit, made = brute_edits(marked)
        names = [m[2] for m in marked]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, names.count("blank"), names.count("duplicate"),
                     names.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def found(spark, rows, schema=SCHEMA):
    got = cr.repair_report(frame(spark, rows, schema)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def chats(seed, n, most=5):
    rng = random.Random(seed)
    for conv in range(n):
        for turn in range(rng.randrange(1, most + 1)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "Ärger"])
            yield conv, turn + rng.randrange(2), role, rng.choice(["Yes.", "no", " \t", "so!\n", "é?", "Yes.", "日本。"])


def test_lists_of_kinds_equals_brute_force():
    roles = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    rng = random.Random(4)
    every = [kinds for n in range(3) for kinds in itertools.product(cr.KINDS, repeat=n)]
    for kinds in every + [rng.choices(cr.KINDS, k=3) for _ in range(60)]:
        rows = [(roles[cr._role(k)], "x", (None, "truncated", "blank")[cr.KINDS.index(k) % 3]) for k in kinds]
        assert cr.solve("".join(kinds)) == brute_edits(rows)[:2]


def test_blocks_composed_in_any_tree_equal_the_whole():
    rng = random.Random(3)
    for _ in range(60):
        kinds = "".join(rng.choices(cr.KINDS, k=rng.randrange(1, 150)))
        cuts = sorted({0, len(kinds), *(rng.randrange(len(kinds)) for _ in range(rng.randrange(6)))})
        parts = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]
        nodes = [(cr.cells(p), 3 * len(p)) for p in parts]
        while len(nodes) > 1:
            at = rng.randrange(len(nodes) - 1)
            (a, n), (b, m) = nodes[at:at + 2]
            nodes[at:at + 2] = [(cr.compose(a, n, b, m), n + m)]
        assert cr.finish(*nodes[0]) == cr.solve(kinds)
        # The letters dealt out to the blocks make the same turns as all at once.
        audit = cr.solve(kinds)[1]
        rows = [{"role": {"s": "system", "u": "user", "a": "assistant", "-": "x"}[cr._role(k)], "text": str(i)} for i, k in enumerate(kinds)]
        dealt = cr._pieces({"key": "k", "audit": audit, "blocks": [{"block": i, "rows": len(p)} for i, p in enumerate(parts)]})
        assert "".join(p["letters"] for p in dealt) == audit
        made = reduce(lambda x, y: x + y, (cr.edit(p["letters"], p["seen"], p["odd"], rows[a:b]) for p, a, b in zip(dealt, cuts, cuts[1:])))
        assert made == cr.edit(audit, 0, dealt[0]["odd"], rows)
        assert LEGAL.fullmatch("".join(t["role"][:1] for t in made))


def test_equals_brute_force(spark):
    rows = list(chats(1, 50, 4))
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "b."), (1, None, "user", "b."), (1, 2, "assistant", None),
            (2, None, None, "c"), (3, 5, "assistant", "d."), (3, 5, "user", "e."), (3, 5, "user", "e.")]
    assert found(spark, rows) == brute(rows)
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert found(spark, [(lost, 0, "user", "x.")]) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_no_rows_and_clashing_columns(spark):
    assert found(spark, []) == {}
    rows = list(chats(9, 12))
    more = SCHEMA + ", key string, block int, kinds string, fault string, digest int"
    assert found(spark, [(*r, "x", 1, "y", "z", 2) for r in rows], more) == brute(rows)


def test_one_conversation_in_many_blocks(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no"]) + str(rng.randrange(900)) + rng.choice([".", ""])) for t in range(700)]
    rows += [(8, 0, "user", "x" * 200_000 + "."), (8, 1, "assistant", "fine.")]
    got = found(spark, rows)
    own = [r[2:] for r in sorted((r for r in damaged(rows) if r[0] == 7), key=lambda r: (r[1], r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))]
    marked = faults(own)
    kinds = "".join(cr.KINDS[(cr.ROLES + "-").index(r[:1]) * 3 + {None: 0, "truncated": 1}.get(f, 2)] for r, _, f in marked)
    cost, audit = cr.solve(kinds)
    assert got[7][5:7] == (cost, audit) and len(audit) > 640
    turns = cr.edit(audit, 0, len(audit.replace("D", "")) % 2 == 1, [{"role": r, "text": t} for r, t, _ in marked])
    assert got[7][7] == hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()).hexdigest()
    assert got[8] == brute([r for r in rows if r[0] == 8])[8]
