import random

from pulsegrid.llm import preferences as P

from .cases import NAMES

SCHEMA = "pair_id bigint, turn bigint, role string, text string"


def by_hand(chosen, rejected):
    """(pair, segment, turn, role, body, trains) for unique turns."""
    out = []
    for pair in {r[0] for r in chosen + rejected}:
        left = {t: (r, x) for p, t, r, x in chosen if p == pair}
        right = {t: (r, x) for p, t, r, x in rejected if p == pair}
        parting = min((t for t in left.keys() | right.keys() if left.get(t) != right.get(t)), default=None)
        for name, side in (("chosen", left), ("rejected", right)):
            for t, (role, body) in side.items():
                if parting is None or t < parting:
                    if name == "chosen":
                        out.append((pair, "prompt", t, role, body, False))
                else:
                    out.append((pair, name, t, role, body, role == "assistant"))
    return out


def test_equals_definition(spark, rows):
    pick = random.Random(1)
    chosen, rejected = [], []
    for pair in range(60):
        turns = [(pair, t, ("user", "assistant")[t % 2], pick.choice("xyz")) for t in range(pick.randint(1, 9))]
        chosen += turns
        rejected += [(p, t, r, x if pick.random() < 0.85 else x + "!") for p, t, r, x in turns[:pick.randint(0, len(turns))]]
    got = rows(P.preference_segments(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)))
    want = [(p, s, t, r, f"<|{r}|>\n{x}<|end|>\n", m) for p, s, t, r, x, m in by_hand(chosen, rejected)]
    assert sorted((r["pair_id"], r["segment"], r["turn"], r["role"], r["text"], r["trains"]) for r in got) == sorted(want)


def test_edge_rows(spark, rows):
    odd = [(None, 1, "user", "q"), (None, 1, "user", "q"), (1, None, "user", "first"), (1, 0, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"),
           (2, 0, "user", ""), (3, 0, "user", "x" * 500_000)]
    left = spark.createDataFrame(odd, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in NAMES if c not in ("text",)])
    right = spark.createDataFrame([*odd[:5], (4, 0, "user", "only here")], SCHEMA)
    got = {(r["pair_id"], r["segment"], r["turn"], r["n"]): r for r in rows(P.preference_segments(left, right))}
    first = P.FIRST_TURN
    assert set(got) == {(None, "prompt", 1, 1), (1, "prompt", first, 1), (1, "prompt", 0, 1), (1, "chosen", 1, 1), (1, "chosen", 1, 2), (1, "rejected", 1, 1),
                        (2, "chosen", 0, 1), (3, "chosen", 0, 1), (4, "rejected", 0, 1)}
    assert got[1, "prompt", 0, 1]["text"] == "<|unknown|>\n<|end|>\n" and got[1, "chosen", 1, 2]["trains"]
    none = spark.createDataFrame([], SCHEMA)
    assert P.preference_segments(none, none).count() == 0


def test_echo_pairs(spark, rows):
    talk = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, "user", "alone"),
            (3, 0, "assistant", "hello"), (None, 7, "assistant", "lost")]
    chosen, rejected = P.echo_pairs(spark.createDataFrame(talk, SCHEMA.replace("pair_id", "conv_id")))
    assert sorted(map(str, map(tuple, chosen.collect()))) == sorted(map(str, talk))
    assert {(r["pair_id"], r["turn"]): r["text"] for r in rows(rejected)} == {
        (1, 0): "q", (1, 1): "a", (1, 2): "r", (1, 3): "r", (1, 4): "bye", (2, 0): "alone", (3, 0): "", (None, 7): ""}
    kinds = sorted((str(r["pair_id"]), r["turn"], r["segment"], r["trains"]) for r in rows(P.preference_segments(chosen, rejected)) if r["pair_id"] == 1)
    assert kinds == [("1", 0, "prompt", False), ("1", 1, "prompt", False), ("1", 2, "prompt", False), ("1", 3, "chosen", True),
                     ("1", 3, "rejected", True), ("1", 4, "chosen", False), ("1", 4, "rejected", False)]
