import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

from fleetlens.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text = said(role), said(text)
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        out[conv]
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest edits over whole strings: every state keeps its best (cost, audit, repaired rows)."""
    states = {"": (0, "", ())}
    after = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}

    def put(to, s, c):
        if s not in to or c < to[s]:
            to[s] = c

    def inserts(states):
        for _ in range(4):
            more = dict(states)
            for (s, (c, e, r)), x in product(states.items(), "ua"):
                if (s, x) in after:
                    put(more, x, (c + 3, e + "I", (*r, ("user:" if x == "u" else "assistant:"))))
            states = more
        return states

    for role, text, fault in rows:
        new = {}
        for s, (c, e, r) in inserts(states).items():
            put(new, s, (c + 4, e + "D", r))
            if fault in (1, 2):
                continue
            more = 3 if fault == 3 else 0
            for x, name in (("u", "user"), ("a", "assistant")):
                if (s, x) in after:
                    put(new, x, (c + 3 + more, e + "R", (*r, f"{name}:{text}")))
            if role[:1] and (s, role[0]) in after:
                put(new, role[0], (c + more, e + "K", (*r, f"{role}:{text}")))
        states = new
    return min(v for s, v in inserts(states).items() if s in ("", "a"))


def brute(rows):
    out = []
    for conv, kept in damaged(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            t = text.rstrip(SPACE)
            faults.append(1 if not t else 2 if (role, text) in seen else 3 if t[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit, fixed = brute_repair([(r, t, f) for (_, r, t), f in zip(kept, faults, strict=True)])
        count = Counter(faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count[1], count[2], count[3],
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False)),
                    cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, repair.digest(repair.edits(repair.damage(df))).collect()), key=str)


def test_repair_of_all_conversations(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    assert got(d) == brute([(r.conv_id, r.turn, r.role, r.text) for r in d.collect()])


def test_repair_of_odd_rows(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unit", "study", "äu"]
    texts = ["Yes.", "No", "", None, " \n", "A? b", "Why?\t", "\xa0", "x" * 60_000 + ".", "é!"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, -3, *range(9)]), rng.choice(roles[: rng.choice([3, 10])]), rng.choice(texts)) for _ in range(900)]
    rows += [(500, t, "user", "Same.") for t in range(400)] + [(501, t, rng.choice(roles[:3]), f"{t}.") for t in range(3000)] + [(502, None, "user", "q")] * 5
    d = spark.createDataFrame([(*r, "k", 1, False) for r in rows], "conv_id long, turn long, role string, text string, edit string, fault int, there boolean")
    assert got(d) == brute(rows)
    assert got(d.limit(0)) == []
    # The operator itself, on rows as they are: what it returns is repaired.
    whole = repair.edits(d.where("conv_id = 501"))
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in repair.repaired(d.where("conv_id = 501")).collect())) and whole.where("edit = 'K'").count() > 500


def test_conversation_that_loses_all_rows(spark):
    turn = next(t for t in range(200) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    d = spark.createDataFrame([(9, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert got(d) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_settled_parts_leave_early(monkeypatch):
    """A conversation of any length: the same edits whether parts are settled early or not at all."""
    rng = random.Random(8)
    rows = [(rng.choice("uuaas?"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(4000)]

    def run(pending):
        monkeypatch.setattr(repair, "PENDING", pending)
        fold, out, most = repair.Repair(), [], 0
        fold.look = pending
        for i, (initial, fault) in enumerate(rows):
            out += fold.add((i, initial, "", fault), initial, fault)
            most = max(most, len(fold.pending))
        return out + list(fold.finish()), most

    early, most = run(16)
    assert early == run(10**9)[0] and most < 200
    assert "".join(e for e, _, _ in early) == brute_repair([(r, "", f) for r, f in rows])[1]


def test_audits_compare_as_strings(monkeypatch):
    """Also when every hash collides: what hashes call equal is verified."""
    rng = random.Random(1)
    for modulus in (repair.MODULUS, 1, 3):
        monkeypatch.setattr(repair, "MODULUS", modulus)
        nodes = [(repair.Node(), "")]
        for _ in range(400):
            node, said = rng.choice(nodes)
            e = rng.choice("DIK")
            nodes.append((repair.Node(node, e), said + e))
        for _ in range(4000):
            (x, s), (y, t) = rng.choice(nodes), rng.choice(nodes)
            assert repair.before(x, y) == (s < t)
            assert len(shared := said_of(repair.shared(x, y))) <= min(len(s), len(t)) and s.startswith(shared) and t.startswith(shared)


def said_of(node):
    out = ""
    while node.up:
        out, node = node.edit + out, node.up[0]
    return out
