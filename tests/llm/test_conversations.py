import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import conversations as cv

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows):
    """The cheapest edits by walking all of them, state by state (no spans)."""
    best = {"": (0, "", [])}  # by what matters of the roles so far: nothing, s, u, a
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit, said) in list(out.items()):
                for n in moves[state]:
                    if n != "s":
                        new = (cost + 2, audit + "I", [*said, ({"u": "user", "a": "assistant"}[n], "")])
                        out[n] = min(out.get(n, new), new)
        return out

    for (_, role, text), fault in zip(rows, plain_faults(rows)):
        after = {}

        def offer(state, *new):
            after[state] = min(after.get(state, new), new)

        for state, (cost, audit, said) in inserted(best).items():
            offer(state, cost + 3, audit + "D", said)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for n in moves[state]:
                    if role[:1] == n:
                        offer(n, cost + more, audit + "K", [*said, (role, text)])
                    if n != "s":
                        offer(n, cost + 2 + more, audit + "R", [*said, ({"u": "user", "a": "assistant"}[n], text)])
        best = after
    cost, audit, said = min(v for k, v in inserted(best).items() if k in ("", "a"))
    assert GRAMMAR.match("".join(r[:1] for r, _ in said))
    return cost, audit, said


def plain(rows):
    """The result row of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, turns = plain_faults(rows), [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, said = plain_repair(rows)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1))
    return {k: plain(v) for k, v in out.items()}


symbols = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b!", "c", "", "d? "])), max_size=9)


@settings(max_examples=150, deadline=None)
@given(symbols)
def test_parse_is_cheapest(turns):
    rows = [(n, *t) for n, t in enumerate(turns)]
    code = {"blank": "d", "duplicate": "d", "truncated": "t", "": "k"}
    text = "".join((r[:1] if r[:1] in ("s", "u", "a") and r else "x") + code[f] for (_, r, _), f in zip(rows, plain_faults(rows)))
    cost, audit, said = plain_repair(rows)
    assert cv.cheapest(cv.block(text)) == (cost, audit)
    assert [(r, t) for _, r, t in cv._edits(audit, iter([(r, t) for _, r, t in rows]))] == said


def test_exhaustive_edits():
    """All edits of short conversations, with up to two insertions in each gap."""
    for roles in itertools.product("sua", repeat=2):
        found = []
        for edits in itertools.product("DKR", repeat=2):
            for gaps in itertools.product(range(3), repeat=3):
                audit = "I" * gaps[0] + edits[0] + "I" * gaps[1] + edits[1] + "I" * gaps[2]
                options = []
                rows = iter(roles)
                for e in audit:
                    r = None if e == "I" else next(rows)
                    options.append({"I": "ua", "R": "ua", "K": r, "D": [""]}[e])
                if any(GRAMMAR.match("".join(x)) for x in itertools.product(*options)):
                    found.append((sum({"I": 2, "R": 2, "D": 3, "K": 0}[e] for e in audit), audit))
        assert cv.cheapest(cv.block("".join(r + "k" for r in roles))) == min(found)


EDGE = [
    (1, 0, "system", "Be good."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 5, "user", "Hi?"), (1, 6, "assistant", "cut off"),
    (2, None, "user", "a."), (2, None, "user", "a."), (2, 3, None, None), (2, 3, "assistant", "x" * 200_000), (2, 3, "assistant", "b!\n"),
    (None, 1, "user", "n."), (None, 2, "assistant", "m."), (3, 0, "", "."), (4, 0, "user", ""), (5, 7, "user", " \t"), (6, 1, "User", "é?"),
    (7, None, None, None), *[(8, t, "user" if t % 2 else "assistant", f"t{t // 3}.") for t in range(60)],
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def result(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def test_query_against_plain_version(spark, sf, tmp_path):
    frame(spark, EDGE).write.parquet(str(tmp_path / "conversations.parquet"))
    assert result(cv.op13_conversations(spark, str(tmp_path))) == plain_damage(EDGE)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert result(cv.op13_conversations(spark, sf)) == plain_damage(rows)


def test_long_conversations_in_blocks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"c{t}!"])) for t in range(240)]
    rows += [(2, 0, "user", "same.")] * 90 + [(None, t % 7, "assistant", f"n{t % 5}.") for t in range(50)]
    want = {}
    for conv in (1, 2, None):
        want[conv] = plain([r[1:] for r in rows if r[0] == conv])[:7]
    got = cv.report(frame(spark, rows), rows=16, block_rows=8)
    assert {r.id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) for r in got.collect()} == want


def test_repaired_turns(spark):
    turns = frame(spark, EDGE).withColumnsRenamed({"conv_id": "id", "turn": "n"}).selectExpr("id", "n", "role", "text", "'x' AS kind", "'y' AS digest", "1 AS pos")
    found = cv.report(turns, "id", "n")
    by = {}
    for r in cv.repaired(turns, found, "id", "n").orderBy("position").collect():
        by.setdefault(r.id, []).append((r.position, r.role, r.text))
    for conv in {r[0] for r in EDGE}:
        rows = sorted([r[1:] for r in EDGE if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or " ", hashlib.md5((r[2] or " ").encode()).hexdigest()))
        _, _, said = plain_repair([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
        assert [x[1:] for x in by.get(conv, [])] == said and [x[0] for x in by.get(conv, [])] == list(range(len(said)))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_empty_table(spark, kind):
    empty = spark.createDataFrame([], f"conv_id {kind}, turn long, role string, text string")
    found = cv.report(empty)
    assert found.count() == 0 and cv.repaired(empty, found).count() == 0 and cv.digests(empty, found).count() == 0
