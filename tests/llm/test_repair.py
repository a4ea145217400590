"""Conversation repair against all edit sequences and against a plain table of weights."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from apexframe.llm import repair
from apexframe.llm.repair import ENDS, START, agenda, block_deductions, code_of, pieces_of, repair_conversations, repaired_lines, row_deductions, table_of

GOOD = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    """rows (conv, turn, role, text) -> rows after damage, by conversation and in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            kept += [row] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    """(must go, truncated) for each row, and the counts of the three faults."""
    seen, marks, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        ended = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not ended else 1 if (role, text) in seen else 2 if ended[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append((fault in (0, 1), fault == 2))
        if fault is not None:
            counts[fault] += 1
    return marks, counts


def plain(rows):
    """Lightest repair by a table over (rows, roles so far as an automaton of the pattern's prefixes), without any agenda."""
    marks, counts = faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def spread(best):
        for _ in range(2):
            for q, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if (to := step.get((q, role[0]))) and (w := (cost + 5, audit + "I", (*lines, f"{role}:"))) < best.get(to, (1 << 60,)):
                        best[to] = w
        return best

    for (_, role, text), (must, cut) in zip(rows, marks, strict=True):
        after = {}
        for q, (cost, audit, lines) in spread(best).items():
            options = [(q, 2, "D", ())]
            if not must:
                options += [(step.get((q, role[:1])), 5 * cut, "K", (f"{role}:{text}",))]
                options += [(step.get((q, x[0])), 1 + 5 * cut, "R", (f"{x}:{text}",)) for x in ("user", "assistant")]
            for to, more, letter, line in options:
                if to is not None and (w := (cost + more, audit + letter, (*lines, *line))) < after.get(to, (1 << 60,)):
                    after[to] = w
        best = after
    cost, audit, lines = min(w for q, w in spread(best).items() if q in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_agenda_against_all_edit_sequences():
    """Every sequence of edits of up to four rows with up to two inserts in each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    for codes in itertools.chain.from_iterable(itertools.product("suaUx-", repeat=n) for n in range(4)):
        found = []
        for inserts in itertools.product(gaps, repeat=len(codes) + 1):
            if sum(map(len, inserts)) > 3:
                continue
            for edits in itertools.product(*([("D", "", 2)] + ([("K", c.lower(), 5 * c.isupper()), ("R", "u", 1 + 5 * c.isupper()), ("R", "a", 1 + 5 * c.isupper())] if c != "-" else []) for c in codes)):
                roles = inserts[0] + "".join(e[1] + g for e, g in zip(edits, inserts[1:], strict=True))
                if GOOD.match(roles):
                    audit = "I" * len(inserts[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, inserts[1:], strict=True))
                    found.append((5 * sum(map(len, inserts)) + sum(e[2] for e in edits), audit))
        got = agenda(len(codes), START, row_deductions("".join(codes)), ENDS)
        assert min(w for q, w in got.items() if q in ENDS) == min(found), codes


def test_blocks_compose_to_the_whole():
    rng = random.Random(1)
    for _ in range(60):
        codes = "".join(rng.choice("suaUAX-") for _ in range(rng.randrange(1, 60)))
        whole = table_of(len(codes), row_deductions(codes))
        parts = [codes[i : i + 7] for i in range(0, len(codes), 7)]
        assert table_of(len(parts), block_deductions([table_of(len(p), row_deductions(p)) for p in parts])) == whole
        cost, audit = min(whole[START, q] for q in ENDS)
        rows = [(c, str(i)) for i, c in enumerate(codes)]
        pieces = list(pieces_of(audit, len(codes), 7))
        assert "".join(p for _, p, _ in pieces) == audit
        lines = [x for b, p, phase in pieces for x in repaired_lines(rows[7 * b : 7 * b + 7], p, phase)]
        assert lines == list(repaired_lines(rows, audit, -((len(audit) - audit.count("D")) % 2)))


def _random(rng, conv, n):
    return [(conv, rng.choice([t, t, t + 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Hi.", "So?", "no end", "", "a\tb! ", None, "Ünï.", "x" * 40, f"t{t}."])) for t in range(n)]


@pytest.mark.parametrize("size", [3, 256])
def test_query_against_plain_tables(spark, monkeypatch, size):
    """Short and long conversations; blocks of three rows joined two at a time take the same conversations the long way."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", size)
    monkeypatch.setattr(repair, "FANIN", 2 if size == 3 else 64)
    rng = random.Random(7)
    rows = [r for c in range(60) for r in _random(rng, c, rng.randrange(1, 14))] + _random(rng, None, 9) + _random(rng, 1000, 700 if size == 256 else 60)
    rows += [(2000, None, "user", "Only nulls."), (2000, None, "assistant", "Yes."), (2001, 1, "", "Empty role."), (2001, 2, "user", "a." * 100_000), (2001, 3, "assistant", "b.")]
    rows += [(3000 + k, t, "user", "Gone.") for k in range(30) for t in range(1)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    docs = docs.withColumn("key", F.lit("mine")).withColumn("pos", F.lit(1)).withColumn("block", F.lit(0)).withColumn("kind", F.lit(0))
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(docs).collect()}
    assert got == {c: plain(r) for c, r in damage(rows).items()}
    assert any(v[-2] == "" for v in got.values())
    assert repair_conversations(docs.where("false")).count() == 0


def test_codes():
    assert [code_of("system", False, False), code_of("user", False, True), code_of("tool", False, True), code_of("", False, False), code_of("user", True, False)] == ["s", "U", "X", "x", "-"]
