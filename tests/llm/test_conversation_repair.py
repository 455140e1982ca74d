import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlink.llm.conversation_repair import cost_layers, damage_turns, repair_conversations, repair_report, solve

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_solve(rows):
    """Least (cost, audit) by best-first search over (place, last role), and the roles it leads to."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, place, last, made = heapq.heappop(heap)
        if place == len(rows) and last in ("", "a"):
            return cost, audit, made
        if (place, last) in done:
            continue
        done.add((place, last))
        go = lambda more, edit, to, by: heapq.heappush(heap, (cost + more, audit + edit, place + (edit != "I"), to, (*made, by) if by else made))  # noqa: E731, B023
        for x in "ua":
            if (last, x) in NEXT:
                go(2, "I", x, ("I", x, place))
        if place < len(rows):
            row = rows[place]
            go(3, "D", last, None)
            if row != "d":
                for x in "ua":
                    if (last, x) in NEXT:
                        go(2 + row.isupper(), "R", x, ("R", x, place))
                if (last, row.lower()) in NEXT:
                    go(row.isupper(), "K", row.lower(), ("K", row.lower(), place))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="dsuaxSUAX", max_size=9))
def test_cost_and_audit_equal_a_search(rows):
    cost, audit, pieces = solve(rows)
    want = plain_solve(rows)
    assert (cost, audit) == want[:2] and len(pieces) == len(rows) + 1
    made = []
    for place, piece in enumerate(pieces):
        made += [("I", x, place) for x in piece[:-1]]
        if piece[-1] in "kua":
            made.append(("K", rows[place].lower(), place) if piece[-1] == "k" else ("R", piece[-1], place))
    assert made == list(want[2]) and GRAMMAR.match("".join(x for _, x, _ in made))


def test_long_conversations_cost_their_length():
    rng = random.Random(1)
    rows = "".join(rng.choice("dsuaxUA") for _ in range(20_000))
    layers = cost_layers(rows)
    assert sum(map(len, layers)) <= 4 * (len(rows) + 1)
    assert GRAMMAR.match("".join(re.sub("d|e", "", p.replace("k", rows[min(i, len(rows) - 1)].lower())) for i, p in enumerate(solve(rows)[2])))


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_report(damaged, convs):
    out = []
    for conv in convs:
        rows = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        letters, counts, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            known = role[:1] if role[:1] in tuple("sua") else "x"
            letters += "d" if fault in ("blank", "duplicate") else known.upper() if fault else known
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, made = plain_solve(letters)
        lines = [{"I": f"{'user' if x == 'u' else 'assistant'}:", "K": f"{rows[p][2]}:{rows[p][3]}" if p < len(rows) else "", "R": f"{'user' if x == 'u' else 'assistant'}:{rows[p][3]}" if p < len(rows) else ""}[e] for e, x, p in made]
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def data(seed=6, n=150):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "a b c!", "", " \n", "Why?\t ", "é?", "ends in space ", "x\x01", None, "dot .", " "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), rng.choice(roles[: rng.choice([5, 9])]), rng.choice(texts) if rng.random() < 0.5 else f"said {rng.randint(0, 99)}."))
    return [*rows, rows[3], rows[3], (9_000, None, None, None), (9_001, -(2**63), "user", "hi."), (9_001, 5, "user", "hi.")]


SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def shown(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_report_equals_plain_python(spark, parts):
    rows = [r for r in data() if r[0] != 9_001]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    convs = {r[0] for r in rows}
    assert shown(repair_report(damage_turns(turns), turns)) == sorted(plain_report(plain_damage(rows), convs), key=repr)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert shown(repair_conversations(turns)[0]) == sorted(plain_report(filled, convs), key=repr)


def test_repaired_rows_make_the_hash(spark):
    rows = data()
    report, repaired = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(r)
    for r in report.collect():
        own = lines.get(r["conv_id"], [])
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in own).encode()).hexdigest() == r["repaired_sha256"]
        assert [x["edit"] for x in own] == [x for x in r["audit"] if x != "D"] and GRAMMAR.match("".join(x["role"][:1] for x in own))


def test_one_conversation_of_many_rows(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"row {t}" + "." * (t % 2)) for t in range(3000)]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert shown(repair_conversations(turns)[0]) == plain_report(rows, [1])


def test_names_and_empty_tables(spark):
    rows = data(n=10)[:-2]
    names = ["meta.k", "a`b", "a b", "ord", "fault", "letter", "rows", "pieces", "kind"]
    wide = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + ", " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    assert shown(repair_report(damage_turns(wide), wide)) == sorted(plain_report(plain_damage(rows), {r[0] for r in rows}), key=repr)
    report, repaired = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and repaired.count() == 0
    one = spark.createDataFrame([(7, 0, None, None)], SCHEMA)
    assert shown(repair_report(one.limit(0), one)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
