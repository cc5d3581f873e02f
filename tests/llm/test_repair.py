"""Repairs of conversations against all edit strings, and the query against its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from fundloom.llm import queries, repair

SF = "/root/testdata/sf0.01"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(repair.SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def applied(rows, faults, audit):
    """(cost, repaired rows) of an edit string, or None where it isn't allowed: roles of R and I follow from the grammar."""
    made = sum(e != "D" for e in audit)
    roles = (["s"] if made % 2 else []) + ["user", "assistant"] * (made // 2)
    cost, i, out = 0, 0, []
    for e in audit:
        if e == "I":
            cost += 5
            if roles[len(out)] == "s":
                return None
            out.append((roles[len(out)], ""))
            continue
        if i == len(rows):
            return None
        role, text = rows[i]
        if e == "D":
            cost += 2
        else:
            if faults[i] in ("blank", "duplicate"):
                return None
            cost += (e == "R") + 5 * (faults[i] == "truncated")
            if e == "R" and roles[len(out)] == "s":
                return None
            out.append((role if e == "K" else roles[len(out)], text))
        i += 1
    if i < len(rows) or not GRAMMAR.fullmatch("".join(r[:1] or " " for r, _ in out)):
        return None
    return cost, out


def brute(rows):
    """Cheapest, then least, of all edit strings with up to three insertions."""
    faults, best = faults_of(rows), None
    for extra in range(4):
        for word in itertools.product("DIKR", repeat=len(rows) + extra):
            if word.count("I") == extra and (found := applied(rows, faults, word)):
                best = min(best or (10**9,), (found[0], "".join(word), found[1]))
    return best


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def test_against_all_edit_strings(spark):
    rng = random.Random(11)
    convs = {}
    for c in range(250):
        n = rng.randrange(1, 5 if c % 10 else 6)
        convs[c] = [(rng.choice(["user", "assistant", "system", "tool", ""] if c % 3 else ["user", "assistant"]), rng.choice(["One.", "Two!", "x", "", " \t", f"T{rng.randrange(99)}?"])) for _ in range(n)]
    data = [(c, k, r, t) for c, rows in convs.items() for k, (r, t) in enumerate(rows)]
    rng.shuffle(data)
    docs = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    reports = {r.conv_id: r for r in repair.repair_reports(docs).collect()}
    told = {}
    for r in sorted(repair.repaired_rows(docs).collect(), key=lambda r: (r.conv_id, r.place)):
        told.setdefault(r.conv_id, []).append(r)
    assert reports.keys() == convs.keys()
    for c, rows in convs.items():
        cost, audit, out = brute(rows)
        r, faults = reports[c], faults_of(rows)
        assert (r.cost, r.audit) == (cost, audit)
        assert r.repaired_sha256 == digest(out)
        assert [faults.count(x) for x in repair.FAULTS[1:]] == [r.blank, r.duplicate, r.truncated]
        assert "".join(x.edit for x in told[c]) == audit
        assert [(x.role, x.text) for x in told[c] if x.edit != "D"] == out
        assert [x.fault or "" for x in told[c] if x.edit != "I"] == faults


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(con.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({queries.oracle_sql()['op11_repair']})").fetchall())
    got = queries.op11_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect())) == want


def kind_of(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def test_damage(spark):
    data = [(c, t, None if c % 5 == 0 else "assistant", None if c % 7 == 0 else "A. b? C!") for c in range(60) for t in (*range(4), None)] + [(None, None, "user", "x.")]
    docs = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in data:
        role, text, k = role or " ", text or " ", kind_of(c, t)
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(k, 1)
    assert {kind_of(c, t) for c, t, *_ in data} == set(range(20))
    assert sorted(map(repr, map(tuple, repair.damage(docs).collect()))) == sorted(map(repr, want))


def test_cases(spark):
    lost = next(c for c in range(10**6) if kind_of(c, 0) == 0)
    data = [(None, None, None, None), (None, 3, "user", "Hm."), (None, 3, "user", "Hm."), (None, 7, "assistant", "Y" * 200_000 + "."), (lost, 0, "user", "a.")]
    rows = spark.createDataFrame([(*r, 1, 2) for r in data], "conv_id long, turn long, role string, text string, conv int, digest int")
    found = {r.conv_id: r for r in repair.repair_reports(rows).collect()}
    r = found[None]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.audit, r.cost) == (3, 1, 1, 0, 2, "DKDK", 4)
    assert r.repaired_sha256 == digest([("user", "Hm."), ("assistant", "Y" * 200_000 + ".")])
    out = {r.conv_id: r for r in repair.repair_reports(repair.damage(rows), rows).collect()}
    assert tuple(out[lost])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert None in out
    for empty in (repair.repair_reports(rows.where("false")), repair.repaired_rows(rows.where("false")), repair.repair_reports(rows.where("false"), rows.where("false"))):
        assert empty.count() == 0


@pytest.mark.parametrize("n", [30_000])
def test_long_conversation(spark, n):
    """States that are composed stay few, however long a conversation is."""
    rng = random.Random(5)
    symbols = bytearray(4 * rng.randrange(4) + rng.randrange(4) for _ in range(n))
    steps = repair.Steps()
    cost, walk = steps.edits(symbols)
    audit = "".join(walk)
    assert len(steps.distances) < 200 and len(steps.forward) < 2000
    assert audit.count("D") * 2 + audit.count("R") + audit.count("I") * 5 <= cost
    rows = spark.createDataFrame([(1, k, rng.choice(["user", "assistant"]), f"t{k}.") for k in range(n)], "conv_id long, turn long, role string, text string")
    r = repair.repair_reports(rows.repartition(4)).collect()[0]
    assert len(r.audit) >= n and r.cost < n
