"""Conversation repair against every sequence of edits, and against a plain program over strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidegrid.llm import conversation_repair as cr
from tidegrid.llm.queries import QUERIES, damaged

WHITE = " \t\n\x0b\x0c\r"


def plain_audit(rows):
    """Cost and audit over (initial, fault) pairs, with audits as whole strings."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    cells = {"": (0, "")}

    def inserted(cells):
        for _ in range(3):
            for place, (cost, text) in list(cells.items()):
                way = (cost + 5, text + "I")
                lands = after[place]
                if lands not in cells or way < cells[lands]:
                    cells[lands] = way
        return cells

    for initial, fault in rows:
        new = {}
        for place, (cost, text) in inserted(dict(cells)).items():
            ways = [(place, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if initial == after[place] or (initial == "s" and place == ""):
                    ways.append((initial, more, "K"))
                ways.append((after[place], 1 + more, "R"))
            for lands, more, letter in ways:
                way = (cost + more, text + letter)
                if lands not in new or way < new[lands]:
                    new[lands] = way
        cells = new
    return min(way for place, way in inserted(dict(cells)).items() if place in ("", "a"))


def every_audit(rows):
    """All edits with up to two insertions at each place: the smallest (cost, audit)."""
    best = None
    options = []
    for initial, fault in rows:
        one = ["D"] if fault in ("blank", "duplicate") else ["K", "D", "Ru", "Ra"]
        options.append(["".join(p) + o for n in range(2) for p in itertools.product("ua", repeat=n) for o in one])
    for choice in itertools.product(*options, ["", "u", "a", "ua"]):
        cost, roles, letters = 0, "", ""
        for pick, row in itertools.zip_longest(choice, rows):
            inserted = re.match("[ua]*", pick).group()
            cost, roles, letters = cost + 5 * len(inserted), roles + inserted, letters + "I" * len(inserted)
            if row is None:
                continue
            pick, (initial, fault) = pick[len(inserted):], row
            letters += pick[0]
            roles += {"K": initial, "D": ""}.get(pick, pick[1:])
            cost += {"K": 0, "D": 2, "R": 1}[pick[0]] + (5 if fault == "truncated" and pick != "D" else 0)
        if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, letters) < best):
            best = (cost, letters)
    return best


def drawn(draw, n):
    return [(draw.choice("ssuuuaaaoo"), draw.choice(["sound"] * 4 + ["blank", "duplicate", "truncated"])) for _ in range(n)]


def codes(rows):
    return "".join(cr.code_of(i, cr.FAULTS.index(f)) for i, f in rows)


def test_against_all_edits():
    draw = random.Random(5)
    for n in (0, 1, 2, 3, 3, 3):
        for _ in range(12):
            rows = drawn(draw, n)
            assert cr.audit(codes(rows)) == plain_audit(rows) == every_audit(rows), rows


@pytest.mark.parametrize("modulus", [cr.EditTree.MODULUS, 7])  # a small one makes hashes collide
def test_long_audits_and_collisions(modulus, monkeypatch):
    monkeypatch.setattr(cr.EditTree.__init__, "__defaults__", (modulus,))
    cr.audit.cache_clear()
    draw = random.Random(6)
    for n in [*range(4, 40), 400]:
        rows = drawn(draw, n)
        assert cr.audit(codes(rows)) == plain_audit(rows), rows
    cr.audit.cache_clear()


def test_chunks_agree_with_the_whole():
    draw = random.Random(7)
    for n in range(1, 60):
        rows = drawn(draw, n)
        text, at, chunks = codes(rows), 0, []
        while at < n:
            size = draw.randint(0, 7)
            chunks.append(cr.transfer(text[at : at + size], [0] if not chunks else [0, 1, 2, 3]))
            at += size
        cost, picks, tail = cr.join_chunks([(c, r) for c, r, _ in chunks])
        assert (cost, "".join(a[p] for (_, _, a), p in zip(chunks, picks)) + tail) == plain_audit(rows)


def key(conv):
    return (conv is not None, conv or 0)


def brute(rows):
    """The contract, conversation by conversation, in plain Python."""
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        names = [" " if v is None else str(v) for v in (conv, turn)]
        how = zlib.crc32(":".join(names).encode()) % 20
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(how, 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(
            f"{'-' if conv is None else f'={conv}'}:{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(WHITE)
            faults.append(
                "blank" if not bare else "duplicate" if (role, text) in seen else "sound" if bare[-1] in ".!?" else "truncated"
            )
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, letters = plain_audit(list(zip([i if i in ("s", "u", "a") else "o" for i in initials], faults)))
        lines, place, at = [], "", 0
        for letter in letters:
            wanted = "a" if place == "u" else "u"
            name = {"u": "user", "a": "assistant"}[wanted]
            if letter == "I":
                lines.append(f"{name}:")
                place = wanted
                continue
            _, role, text = own[at]
            at += 1
            if letter != "D":
                lines.append(f"{role if letter == 'K' else name}:{text}")
                place = role[0] if letter == "K" else wanted
        turns = [t for t, _, _ in own if t is not None]
        out[conv] = (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return [out[c] for c in sorted(out, key=key)]


def repaired(spark, rows, chunk_rows=4096, folds=3):
    from tidegrid.llm.queries import repaired_conversations

    df = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, part string"
    ).repartition(folds)
    got = repaired_conversations(df, chunk_rows).collect()
    return sorted((tuple(r) for r in got), key=lambda r: key(r[0]))


def conversations(draw, n, longest):
    texts = ["Yes.", "No!", "cut off", "", "  \t", "Why?\n", "é… 日本.", "a" * 5000 + "."]
    rows = []
    for conv in range(n):
        for turn in range(draw.randint(1, longest)):
            rows.append((conv, turn * draw.choice([1, 1, 2]), draw.choice(["system", "user", "assistant", "tool", "", None]),
                         draw.choice([*texts, None, f"own {conv} {turn}."])))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (n, None, "user", "Hi."), (n, None, "user", "Hi."), (n, 3, "user", "Hi.")]
    return rows


def test_against_brute_force(spark):
    rows = conversations(random.Random(1), 60, 9)
    assert repaired(spark, rows) == brute(rows)


def test_one_conversation_in_many_chunks(spark):
    draw = random.Random(2)
    rows = conversations(draw, 8, 5)
    rows += [(3, 100 + t, draw.choice(["user", "assistant", "user"]), f"t {t}" + draw.choice([".", ""])) for t in range(400)]
    rows += [(3, 90, "user", "again and again.")] * 150
    assert repaired(spark, rows, chunk_rows=16) == brute(rows)


def test_empty_table(spark):
    assert repaired(spark, []) == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in damaged(df).collect():
        how = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        assert r["copies"] == {0: 0, 3: 2}.get(how, 1)
        assert r["text"] == {1: "", 2: "One Two"}.get(how, "One. Two!")
        assert r["role"] == ("user" if how == 4 else "assistant")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = sorted(tuple(r) for r in QUERIES["op13_conversation_repair"](spark, sf).collect())
    assert got == brute([tuple(r) for r in own.collect()])
