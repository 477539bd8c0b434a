"""Repair of conversations against exhaustive edits and a plain table of all prefixes."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tracklore.llm import queries, repair

SF = "/root/testdata/sf0.001"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANK)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def table(rows, faults):
    """Cheapest (cost, audit, lines) of all edits: every prefix and state, with whole strings compared."""
    pattern = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for c in "ua":
                    if c in pattern[state]:
                        new = (cost + 5, audit + "I", (*lines, f"{full[c]}:"))
                        best[c] = min(best.get(c, new), new)
        return best

    best = insert(best)
    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(2, "D", state, ())]
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                if role[:1] in pattern[state]:
                    ways.append((more, "K", role[:1], (f"{role}:{text}",)))
                ways += [(1 + more, "R", c, (f"{full[c]}:{text}",)) for c in "ua" if c in pattern[state]]
            for price, letter, to, line in ways:
                new = (cost + price, audit + letter, lines + line)
                after[to] = min(after.get(to, new), new)
        best = insert(after)
    return min(best[s] for s in ("", "a") if s in best)


def exhaustive(rows, faults):
    """The same over all edit strings with at most two insertions in a place and three in all."""
    found = []
    full = {"u": "user", "a": "assistant"}
    places = [p for p in itertools.product(range(3), repeat=len(rows) + 1) if sum(p) <= 3]
    for edits in itertools.product("KUAD", repeat=len(rows)):
        if any(f in (1, 2) and e != "D" for e, f in zip(edits, faults, strict=True)):
            continue
        cost = sum({"K": 0, "U": 1, "A": 1, "D": 2}[e] + 5 * (f == 3 and e != "D") for e, f in zip(edits, faults, strict=True))
        for place in places:
            if cost + 5 * sum(place) > 2 * len(rows):  # deleting all costs no more
                continue
            for roles in itertools.product("ua", repeat=sum(place)):
                new, audit, lines, initials = iter(roles), "", [], ""
                for k in range(len(rows) + 1):
                    for _ in range(place[k]):
                        c = next(new)
                        audit, initials = audit + "I", initials + c
                        lines.append(f"{full[c]}:")
                    if k < len(rows):
                        e, (role, text) = edits[k], rows[k]
                        audit += "R" if e in "UA" else e
                        if e != "D":
                            role = full[e.lower()] if e in "UA" else role
                            initials += role[:1]
                            lines.append(f"{role}:{text}")
                if re.fullmatch("(s?(ua)+)?", initials):
                    found.append((cost + 5 * sum(place), audit, tuple(lines)))
    return min(found)


def random_rows(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "ua"], ["One.", "Two!", "cut off", " ", "", "Three?  \n", "x.y"]
    return [(rng.choice(roles[: rng.choice([2, 3, 5])]), rng.choice(texts) + rng.choice(["", f" {k}."])) for k in range(n)]


def lightest(rows, faults):
    made = repair.Repair()
    for (role, _), fault in zip(rows, faults, strict=True):
        made.add((role[:1], fault))
    cost, audit = made.finish()
    return cost, audit, tuple(f"{role}:{text}" for _, role, text in repair.repaired(rows, audit))


def test_agenda_against_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(5))
        faults = faults_of(rows)
        assert lightest(rows, faults) == exhaustive(rows, faults) == table(rows, faults), rows


@pytest.mark.parametrize("chunk", [1, 2, 7, 256])
def test_agenda_of_long_conversations(monkeypatch, chunk):
    monkeypatch.setattr(repair, "_CHUNK", chunk)
    rng = random.Random(chunk)
    for n in (1, 8, 30, 300):
        for _ in range(8):
            rows = random_rows(rng, n)
            assert lightest(rows, faults_of(rows)) == table(rows, faults_of(rows))
    rows = [("tool", f"{k}.") for k in range(301)]  # two derivations that never meet before the end
    assert lightest(rows, [0] * 301) == table(rows, [0] * 301)


def expected(rows):
    """{conv_id: columns} of (conv_id, turn, role, text) after damage, in plain loops."""
    out, grouped = {}, {}
    for c, t, role, text in rows:
        grouped.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            grouped[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, found in grouped.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        pairs, turns = [r[1:] for r in found], [r[0] for r in found if r[0] is not None]
        faults = faults_of(pairs)
        cost, audit, lines = table(pairs, faults)
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_rows(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.op11_repair(spark, SF)) == expected(rows)


def test_repair_of_odd_rows(spark, tmp_path, monkeypatch):
    """Nulls everywhere, ties, repeats, gaps, a very long conversation and text, columns with clashing names."""
    rng = random.Random(6)
    rows = [(c, t, *r) for c in range(40) for t, r in enumerate(random_rows(rng, rng.randrange(9)))]
    rows += [(100, None, "user", "No turn."), (100, None, None, None), (100, 5, "assistant", None), (100, 9, None, "x"), (None, 1, "user", "Null id."), (None, None, "assistant", "Null id.")]
    rows += [(101, 3, r, x) for r, x in random_rows(rng, 6)] + [(102, 1, "user", "Same.")] * 4 + [(103, None, None, None)] * 2
    rows += [(104, t, *r) for t, r in enumerate(random_rows(rng, 900))] + [(105, 0, "user", "word. " * 60_000), (105, 1, "assistant", "Good.")]
    rows += [(c, 0, "user", "Alone.") for c in range(200, 260)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, fault int, digest string, audit string")
    df.repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    want = expected(rows)
    assert as_rows(queries.op11_repair(spark, str(tmp_path))) == want
    assert sum(w[6:] == ("", hashlib.sha256(b"").hexdigest()) for w in want.values()) > 1
    left = repair.repair(repair.damage(df), turns=True).collect()
    for c in (0, 5, 104, None):
        lines = [f"{r.role}:{r.text}" for r in sorted((r for r in left if r.conv_id == c), key=lambda r: r.place)]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[c][-1]
    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op11_repair(spark, f"{tmp_path}/none").collect() == []


def test_turns_beyond_memory(monkeypatch):
    monkeypatch.setattr(repair, "_HELD", 100)
    turns, rows = repair._Turns(), [(f"r{k}", "t" * (k % 40)) for k in range(200)]
    for r in rows:
        turns.add(*r)
    assert list(turns) == rows == list(turns)
    turns.close()
