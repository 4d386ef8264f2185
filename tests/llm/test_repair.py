"""Conversation repair against all sequences of edits."""

import hashlib
import random
import re
from itertools import product
from zlib import crc32

from mailloom.llm import repair


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, initials, lines) by trying all edits of every row, with up to two inserts in each gap."""
    marks, best = faults(rows), None
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for kinds in product(*[["D"] if m in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for m in marks]):
        base = sum(4 if k == "D" else (3 if k[0] == "R" else 0) + 3 * (m == "truncated") for k, m in zip(kinds, marks, strict=True))
        if best and base > best[0]:
            continue
        for ins in product(gaps, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, ins))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for i in range(len(rows) + 1):
                audit += "I" * len(ins[i])
                lines += [f"{r}:" for r in ins[i]]
                if i < len(rows):
                    audit += kinds[i][0]
                    role, text = rows[i]
                    if kinds[i] != "D":
                        lines.append({"K": role, "Ru": "user", "Ra": "assistant"}[kinds[i]] + ":" + text)
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = crc32(f"{told[0]}:{told[1]}".encode()) % 20
        role, text = ("user" if kind == 4 else told[2]), {1: "", 2: re.sub("[.!?]", "", told[3])}.get(kind, told[3])
        out += [] if kind == 0 else [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    out, left = [], damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        pairs, turns = [(r[2], r[3]) for r in own], {r[1] for r in own} - {None}
        marks, initials = faults(pairs), [p[0][:1] for p in pairs]
        cost, audit, lines = brute(pairs)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *[marks.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_all_edits(spark):
    """Random short conversations with every kind of fault, null and odd role."""
    rng = random.Random(5)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", None, "tool"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(["Good.", "Fine!", "cut off", " \n", "", None, "Why? ", "Good."])))
    rows += [(500, t, r, x) for t, (r, x) in enumerate([("system", "Be.")])] + rows[:5]
    table = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, conv int, gone string").repartition(3)
    got = sorted(map(tuple, repair.repair_damaged(table).collect()), key=repr)
    assert got == expected(rows)


def test_memory_is_bounded_and_edits_come_early():
    """A long orderly conversation never has more than a few open edits; a tie stays open until it is decided."""
    out = []
    s = repair.Survivors(out.append, repair.Costs())
    for i in range(5000):
        s.turn("user" if i % 2 == 0 else "assistant", f"t{i}.", False, False)
        assert i - len(out) < 8
    assert s.end() == 0 and "".join(e.initial for e in out) == "K" * 5000


def test_turns_and_summary_agree(spark):
    rows = [(c, t, ("system", "user", "assistant")[(t + c) % 3], f"text {t % 4}" + "." * (t % 2)) for c in range(20) for t in range(30)]
    turns = lambda: repair.marked_turns(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), *map(repair.F.col, ("conv", "turn", "role", "text", "gone")))
    kept = {}
    for r in sorted(repair.repaired_turns(turns()).collect(), key=lambda r: (r.conv, r.place)):
        kept.setdefault(r.conv, []).append(r)
    for r in repair.repair_summary(turns()).collect():
        own = kept.get(r.conv, [])
        assert r.audit == "".join(e.edit for e in own) and [e.place for e in own] == list(range(len(own)))
        text = "\n".join(f"{e.role}:{e.text}" for e in own if e.role is not None)
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_no_conversations(spark):
    assert repair.repair_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
