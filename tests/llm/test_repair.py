import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tapeloom.llm import queries, repair

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
            out += [(c, t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired lines) by a plain search over all edits; ties by the audit."""
    none = (10**9, "", ())

    def inserted(best):
        for _ in range(3):
            for q, (to, role) in {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}.items():
                c, e, x = best[to]
                best[q] = min(best[q], (c + 3, "I" + e, (role + ":", *x)), key=lambda b: b[:2])
        return best

    best = inserted({"": (0, "", ()), "a": (0, "", ()), "s": none, "u": none})
    for fault, role, text in reversed(turns):
        now = {}
        for q in best:
            ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            if fault not in "bd" or not fault:
                more = 3 * (fault == "t")
                i = role[:1]
                if (i == "s" and q == "") or (i == "u" and q != "u") or (i == "a" and q == "u"):
                    c, e, x = best[i]
                    ways.append((c + more, "K" + e, (f"{role}:{text}", *x)))
                to = "a" if q == "u" else "u"
                c, e, x = best[to]
                ways.append((c + 3 + more, "R" + e, (f"{'assistant' if to == 'a' else 'user'}:{text}", *x)))
            now[q] = min(ways, key=lambda b: b[:2])
        best = inserted(now)
    return best[""]


def brute(rows, damaged=True):
    original = list(dict.fromkeys(r[0] for r in rows))
    by = defaultdict(list)
    for c, t, r, x in damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        by[c].append((t is not None, t or 0, r, hashlib.sha256(x.encode()).digest(), x))
    out = {}
    for c in original:
        own = sorted(by[c])
        numbers = [t for has, t, *_ in own if has]
        turns, seen, roles = [], set(), [r for _, _, r, _, _ in own]
        for _, _, r, _, x in own:
            bare = x.rstrip(WHITE)
            fault = "b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((r, x))
            turns.append((fault, r, x))
        cost, audit, lines = cheapest(turns)
        faults = [f for f, _, _ in turns]
        out[c] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in "bdt"),
            sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def plain(got):
    return {r[0]: tuple(r)[1:] for r in got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(queries.op12_conversation_repair(spark, sf_dir)) == brute(rows)


ODD = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "assistant", "So."), (1, 7, "assistant", "x"), (1, 7, None, None),
    (None, 1, "tool", "a."), (None, 2, "", "b."), (None, 2, "system", ""), (2, None, None, None), (3, 5, "assistant", "Late. \n\t"), (3, 6, "assistant", "Late. \n\t"), (3, 9, "system", "Rule!"),
    (4, 1, "system", "Rule!"), (5, 1, "unknown", "?"), (5, 2, "users", "é? "), (6, 1, "user", "long. " * 30_000), (6, 2, "assistant", "long. " * 30_000),
    *[(7, i, ("user", "assistant")[i * i % 3 == 1], f"{i % 11}" + ".?x"[i % 3]) for i in range(400)],
]


@pytest.mark.parametrize("damaged", [True, False])
def test_odd_rows_equal_brute_force(spark, damaged):
    d = spark.createDataFrame([(*r, "x", 1) for r in ODD], "conv_id long, turn long, role string, text string, seq string, digest int")
    got = repair.repair(d, damage=damaged)
    assert plain(repair.digests(got)) == brute(ODD, damaged)
    turns = got.where("seq is not null")
    lines = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (str(r.conv_id), r.seq)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: v[-1] for c, v in brute(ODD, damaged).items() if c in lines}
    for x in lines.values():
        assert re.fullmatch("s?(ua)+", "".join(y[:1] for y in x))
    assert repair.digests(repair.repair(d.limit(0))).count() == 0


def test_tables_equal_plain_search():
    rnd = random.Random(5)
    for _ in range(1500):
        kinds = [rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 2, 3, 2, 3]) for _ in range(rnd.randint(0, 13))]
        turns = [("b" if k == 0 else "t" if k >= 5 else "", "suax"[(k - 1) % 4] if k else "user", "") for k in kinds]
        assert repair.tables().repair(bytes(kinds)) == cheapest(turns)[:2]
