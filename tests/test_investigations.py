"""Investigations against a replay of their log, row by row, whatever the order of arrival."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quarry.operators import investigations as inv

START = dt.datetime(2024, 5, 30, 22)


def make_log(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        action = rng.choice(["start", "add", "add", "add", "pin", "note", "end", "other"])
        explicit = rng.choice([None, None, rng.randrange(n)]) if action in ("add", "pin", "note") else None
        target = rng.choice([None, "unit:a", "unit:b", "unit:c"]) if action in ("add", "pin") else None
        note = f"q{seq}" * 30 if action == "start" else rng.choice([None, f"n{seq}"])
        rows.append((seq, START + dt.timedelta(minutes=rng.randrange(0, 60 * 96, 7)), rng.choice("xyz"), action, explicit, target, note, seq % 3))
    return rows


def replay(rows, commands, sizes):
    active, state, ledger = {}, {}, []
    ids = {r[0] for r in rows if r[3] == "start"}
    # An investigation is known by its id throughout: rows for it may bear an earlier time than its start.
    state = {i: {"add": {}, "pin": {}, "notes": []} for i in ids}
    for r in sorted([*((x, True) for x in rows), *((c, False) for c in commands)], key=lambda x: (x[0][1], x[0][0])):
        row, is_log = r
        if not is_log:
            seq, ts, actor, command, keys, whole, said = row
            if actor in active and command not in ("investigate", "export"):
                ledger.append((seq, active[actor], command, sum(sizes.values()) if whole else sum(sizes.get(k, 0) for k in set(keys)), int(said / 4 + 0.5)))
            continue
        seq, ts, actor, action, explicit, target, note, run = row
        if action == "start":
            active[actor] = seq
            state[seq] |= {"actor": actor, "run": run, "question": note, "created": ts, "updated": max(ts, state[seq].get("updated", ts))}
        elif action == "end":
            active.pop(actor, None)
        elif action in ("add", "pin", "note"):
            to = explicit if explicit is not None else active.get(actor)
            if to not in state or (note is None if action == "note" else target is None):
                continue
            s = state[to]
            s["updated"] = max(ts, s.get("updated", ts))
            if action == "note":
                s["notes"].append(note)
            else:
                held = s[action].setdefault(target, [None, ts])
                held[0] = note if note is not None else held[0]
    return state, sorted(ledger)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_state_and_ledger_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    rows = make_log(seed)
    commands = [(1000 + i, START + dt.timedelta(minutes=rng.randrange(0, 60 * 96, 7)), rng.choice("xyzw"), rng.choice(["show", "scan", "investigate", "export"]), [rng.choice(["a", "b", "?"]) for _ in range(3)], rng.random() < 0.2, rng.randrange(99)) for i in range(150)]
    sizes = {"a": 10, "b": 7, "c": 100}
    want, ledger = replay(rows, commands, sizes)
    rng.shuffle(rows)
    rng.shuffle(commands)
    log = spark.createDataFrame(rows, inv.LOG).repartition(rng.randrange(1, 9))
    got = {r["investigation"]: r for r in inv.investigations_of(log).collect()}
    assert set(got) == set(want)
    for i, s in want.items():
        r = got[i]
        assert (r["actor"], r["run_id"], r["question"], r["title"], r["status"]) == (s["actor"], s["run"], s["question"], s["question"][:80], "open")
        assert (r["created_at"], r["updated_at"], r["nodes"], r["pinned"], r["notes"]) == (s["created"], s["updated"], len(s["add"]), len(s["pin"]), len(s["notes"]))
        assert r["last_note"] == (s["notes"][-1] if s["notes"] else None)
    for action in ("add", "pin"):
        held = {(r["investigation"], r["target"]): [r["note"], r["added_at"]] for r in inv.members_of(log, action).collect()}
        assert held == {(i, t): v for i, s in want.items() for t, v in s[action].items()}
    notes = sorted((r["investigation"], r["n"], r["note"]) for r in inv.notes_of(log).collect())
    assert notes == sorted((i, k, x) for i, s in want.items() for k, x in enumerate(s["notes"], 1))
    asked = spark.createDataFrame(commands, "seq long, ts timestamp, actor string, command string, keys array<string>, whole boolean, said long")
    found = inv.ledger_of(log, asked, spark.createDataFrame(list(sizes.items()), "key string, tokens long"))
    assert sorted((r["seq"], r["investigation"], r["command"], r["ingested"], r["emitted"]) for r in found.collect()) == ledger


def test_empty_and_odd_logs(spark):
    empty = spark.createDataFrame([], inv.LOG)
    assert inv.investigations_of(empty).count() == 0 and inv.members_of(empty).count() == 0
    odd = spark.createDataFrame([(None, START, "x", "start", None, None, "q", 1), (1, None, "x", "start", None, None, "q", 1), (2, START, None, "start", None, None, None, None), (3, START, "x", "add", 99, "t", None, 1), (4, START, "x", "add", 2, "t", None, 1)], inv.LOG)
    got = inv.investigations_of(odd).collect()
    assert [(r["investigation"], r["question"], r["nodes"], r["last_note"]) for r in got] == [(2, None, 1, None)]
