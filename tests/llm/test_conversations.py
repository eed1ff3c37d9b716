"""Conversation repair against a search over all edit strings."""

import hashlib
import random
import zlib

import pytest

from quotecurve.llm import conversations

_SPACES = " \t\n\x0b\f\r"
_NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _plain(rows):
    """Least (cost, edits, lines) by dynamic programming over whole edit strings."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.rstrip(_SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {}

    def put(i, state, path):
        if (i, state) not in best or path < best[i, state]:
            best[i, state] = path

    for i in range(len(rows), -1, -1):
        if i == len(rows):
            put(i, "", (0, "", ()))
            put(i, "a", (0, "", ()))
        else:
            role, text = rows[i]
            for state in ("", "s", "u", "a"):
                if (i + 1, state) in best:
                    cost, edits, lines = best[i + 1, state]
                    put(i, state, (cost + 4, "D" + edits, lines))
                if faults[i] in ("blank", "duplicate"):
                    continue
                for edit, named in (("K", role), ("R", "user"), ("R", "assistant")):
                    then = _NEXT.get((state, named[:1]))
                    if then and (i + 1, then) in best:
                        cost, edits, lines = best[i + 1, then]
                        extra = 3 * (edit == "R") + 3 * (faults[i] == "truncated")
                        put(i, state, (cost + extra, edit + edits, (f"{named}:{text}", *lines)))
        for _ in range(3):
            for state in ("", "s", "u", "a"):
                for named in ("user", "assistant"):
                    then = _NEXT.get((state, named[0]))
                    if then and (i, then) in best:
                        cost, edits, lines = best[i, then]
                        put(i, state, (cost + 3, "I" + edits, (f"{named}:", *lines)))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return [faults.count(f) for f in ("blank", "duplicate", "truncated")] + [sum(p not in ("su", "ua", "au") for p in pairs)], best[0, ""]


def _wanted(data):
    order = {}
    for conv, turn, role, text in data:
        rows = order.setdefault(conv, [])
        space = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{space[0]}:{space[1]}".encode()) % 20
        _, _, role, text = space
        if fate == 1:
            text = ""
        elif fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fate == 4:
            role = "user"
        rows.extend([(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1))
    want = {}
    for conv, rows in order.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, (cost, audit, lines) = _plain([r[1:] for r in rows])
        want[conv] = (gaps, *counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def _data():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "open", "", " \t", "Why?\n", "x" * 70 + ".", "x" * 70 + "!", "é.", "long " * 9000 + "."]
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice([*texts, None, f"t{turn}.", f"t{turn}"])))
    rows += [rows[5], rows[5], rows[9]]
    rows += [(1000, k, ["user", "assistant", "tool"][k % 3], f"m{k % 400}" + ".,"[k % 2]) for k in range(1500)]
    rows += [(1001, 5, "user", "again.")] * 40
    return rows


_SCHEMA = "conv_id long, turn long, role string, text string, key string, pos long, part long, code int, conv int, fate int"


@pytest.mark.parametrize("parts", [None, 9])
def test_repairs_are_the_cheapest(spark, parts):
    data = _data()
    frame = spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5) for r in data], _SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in conversations.damaged_and_repaired(frame, parts=parts).collect()}
    assert got == _wanted(data)


def test_repaired_rows_of_every_piece(spark):
    rows = [(1, k, "user", f"m{k}.") for k in range(50)]
    found = conversations.pieces(spark.createDataFrame(rows, "conv long, turn long, role string, text string"), parts=5)
    lines = [(r["part"], r["at"], r["role"]) for r in conversations.repaired(found).collect()]
    roles = [r[2] for r in sorted(lines)]
    assert len({r[0] for r in lines}) > 1 and roles == ["user", "assistant"] * 25


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.damaged_and_repaired(frame).count() == 0
    one = spark.createDataFrame([(7, 0, "user", "a.")], "conv_id long, turn long, role string, text string").where("conv_id is null")
    assert conversations.damaged_and_repaired(one).count() == 0


def test_walk_does_not_depend_on_the_block_length():
    rng = random.Random(2)
    codes = bytes(rng.randrange(16) for _ in range(500))
    steps = conversations.Steps()
    vectors = [conversations._END]
    for code in reversed(codes):
        vectors.append(steps.before(vectors[-1], code))
    state, want = 0, []
    for k, code in enumerate(codes):
        made, state = steps.edits(vectors[len(codes) - 1 - k], code, state)
        want.append(made)
    assert [w[0] for w in conversations.walk(codes, conversations._END, 0, steps)] == want
    assert len(conversations.checkpoints(codes, conversations._END, steps)[1]) == 23
