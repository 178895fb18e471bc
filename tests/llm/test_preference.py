"""Preference pairs: prefixes, rendering and spans, on pairs of any shape."""

import random

from pyspark.sql import functions as F

from pactline.llm import preference as pf

PAIR = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string, turns string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def naive(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    sides = [chosen[n:], rejected[n:]]
    if not all(any(r == "assistant" for r, _ in s) for s in sides):
        return None
    return n, render(chosen[:n]), render(sides[0]), render(sides[1])


def test_equals_turn_by_turn(spark):
    rng = random.Random(1)
    turn = lambda: (rng.choice(["user", "assistant", "system"]), rng.choice(["", "a", "bé", "c c"]))
    pairs = []
    for i in range(200):
        base = [turn() for _ in range(rng.randint(0, 4))]
        pairs.append((i, base + [turn() for _ in range(rng.randint(0, 3))], base + [turn() for _ in range(rng.randint(0, 3))], "x", "y"))
    pairs += [(900, None, [("assistant", "a")], "", ""), (901, [], [], None, None)]
    got = {r.pair_id: r for r in pf.preference_pairs(spark.createDataFrame(pairs, PAIR)).collect()}
    for i, chosen, rejected, *_ in pairs:
        expected = naive(chosen, rejected) if chosen is not None else None
        assert (i in got) == (expected is not None)
        if expected:
            r = got[i]
            assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == expected
            for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
                pieces = [text[int(a) : int(b)] for a, b in (s.split(":") for s in spans.split(","))]
                answers = text.split("<|im_start|>assistant\n")[1:]
                assert pieces == [a[: a.index("<|im_end|>") + 10] for a in answers]


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 2, "assistant", "b", 0), (1, 1, "user", "a", 0), (1, 2, "assistant", "b", 0), (1, None, None, None, 0), (None, 1, "user", "x", 0), (2, 1, "user", None, 0)]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in pf.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")).collect()}
    assert got == {1: [("unknown", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")], 2: [("user", "")]}


def test_very_long_and_empty(spark):
    long = "word " * 40_000
    frame = spark.createDataFrame([(1, [("user", long), ("assistant", long)], [("user", long), ("assistant", "no")], "", "")], PAIR)
    r = pf.preference_pairs(frame).first()
    assert r.prompt_turns == 1 and len(r.chosen) == len(long) + 33 and r.chosen_spans == f"22:{len(long) + 32}"
    assert pf.preference_pairs(frame.limit(0)).count() == 0
    assert pf.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_next(rows):
    """(key, value) rows to the next key with another value, around the end."""
    ordered = sorted(rows)
    out = {}
    for i, (key, value) in enumerate(ordered):
        around = ordered[i + 1 :] + ordered[:i]
        out[key] = next((k for k, v in around if v != value), None)
    return out


def test_next_key_with_another_value(spark):
    rng = random.Random(3)
    cases = [[(f"k{i:04}", rng.randint(0, 1)) for i in rng.sample(range(5000), 400)], [(i * 2, 7) for i in range(60)] + [(5, 8)], [(i, 1) for i in range(50)], [(3, 3)]]
    cases.append([(i, i // 90) for i in range(400)])
    for rows in cases:
        kind = "string" if isinstance(rows[0][0], str) else "long"
        out = pf.next_different(spark.createDataFrame(rows, f"k {kind}, v long"), "k", "v")
        assert {r["key"]: r["next"] for r in out.collect()} == brute_next(rows)
    assert pf.next_different(spark.createDataFrame([], "k long, v long"), "k", "v").count() == 0


def pairs_of(spark, rows, kind="long"):
    lists = pf.conversations(spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string"))
    texts = lambda c: F.expr(f"transform({c}, t -> t.text)").alias(c)
    return {r[0]: (r[1], r[2]) for r in pf.sampled_pairs(lists).select("pair_id", texts("chosen"), texts("rejected")).collect()}


def test_sampled_pairs_part_at_the_middle_answer(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"{c}-{t}") for c in (2, 4, 8) for t in range(2 * c + 1)]
    got = pairs_of(spark, rows)
    name = lambda c, *places: [f"{c}-{t}" for t in places]
    assert got[2] == (name(2, 0, 1, 2, 3), name(2, 0) + name(4, 3, 4, 5, 6, 7))
    assert got[4] == (name(4, *range(8)), name(4, 0, 1, 2) + name(8, *range(7, 16)))
    assert got[8] == (name(8, *range(16)), name(8, *range(7)) + name(2, 1, 2, 3))


def test_every_answered_conversation_has_a_pair(spark):
    """Even ids, text ids, the same answer in most conversations; those without an answer have none."""
    even = [(2 * c, t, ["user", "assistant"][t], "yes" if t and c % 10 else f"{c}-{t}") for c in range(50) for t in range(2)]
    assert set(pairs_of(spark, even)) == {2 * c for c in range(50)}
    named = [(f"conv-{c}", t, ["user", "assistant"][t], f"{c}-{t}") for c in range(20) for t in range(2)] + [("mute", 0, "user", "hello"), (None, 1, "assistant", "x")]
    assert set(pairs_of(spark, named, "string")) == {f"conv-{c}" for c in range(20)}
    assert pairs_of(spark, [(c, 0, "assistant", "same") for c in range(9)]) == {} == pairs_of(spark, [])


def test_query_pairs_all_answered_conversations(spark, tmp_path):
    rng = random.Random(6)
    rows = [(3 * c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, f"t{c}-{t}"])) for c in range(120) for t in range(rng.randint(1, 9))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = pf.op4_preference_pairs(spark, str(tmp_path)).collect()
    assert {r["conv_id"] for r in got} == {c for c, _, role, _ in rows if role == "assistant"}
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    names = ["conv_id", "prompt_turns", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans"]
    expected = duck.sql(f"select {', '.join(names)} from ({pf.OP4_SQL})").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(expected)
    assert max(r["chosen_spans"].count(",") for r in got) > 1 and len({r["prompt_turns"] for r in got}) > 3
