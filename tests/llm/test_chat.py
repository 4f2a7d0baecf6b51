"""Role repair: least costs by brute force, and what is returned is legal, costs that and renders all turns."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from recordfuse.llm import chat

R = random.Random(9)
CHANGE = lambda r, to: 0 if r == to else chat.TO_SYSTEM if to == 0 else 0 if r == 3 else chat.RELABEL


def brute_cost(roles):
    best = {0: 0.0}
    for r in roles:
        new = {}
        for s, c in best.items():
            if s:
                new[s] = min(new.get(s, 1e9), c + chat.MERGE + CHANGE(r, s - 1))
            for n in range(4):
                for put in itertools.product((1, 2), repeat=n):
                    at, legal = s, True
                    for x in put:
                        legal, at = legal and chat.ROLES[x] in chat.LEGAL[at], x + 1
                    for to in chat.LEGAL[at] if legal else ():
                        k = chat.ROLES.index(to)
                        new[k + 1] = min(new.get(k + 1, 1e9), c + n * chat.INSERT + CHANGE(r, k))
        best = new
    return min(c + chat.ENDING[s] for s, c in best.items())


def test_costs_are_least():
    for _ in range(150):
        roles = [R.choice((0, 1, 2, 1, 2, 3)) for _ in range(R.randint(1, 9))]
        cut = R.randint(0, len(roles))
        parts = [p for p in (roles[:cut], roles[cut:]) if p]
        assert abs(chat._chained([(i, chat.forward(p).ravel().tolist()) for i, p in enumerate(parts)])[0][4] - brute_cost(roles)) < 1e-9
        assert abs(chat.decode(roles)[1] - brute_cost(roles)) < 1e-9


ROLES = ("system", "user", "assistant", "user", "assistant", "Human", "gpt ", "tool", None, "")


@pytest.mark.parametrize("run", [chat.RUN, 3])
def test_repairs_are_legal_and_cost_what_they_say(spark, run):
    rows = [(c, t, R.choice(ROLES), f"c{c}t{t}") for c in range(60) for t in range(R.randint(1, 14))]
    rows += [(None, 5, "assistant", "z"), (None, None, "user", None), (99, 1, "user", "same"), (99, 1, "user", "same"), (99, 1, "assistant", "first?"), (98, 0, "user", "a<|im_end|>"), (97, 0, "user", "long " * 50_000)]
    R.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("RUN", F.lit(1)).withColumn("place", F.lit("x"))
    got = {}
    for r in chat.repair(df.repartition(5), run).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for conv, turns in got.items():
        turns.sort(key=lambda r: r.place)
        assert [r.place for r in turns] == list(range(len(turns))) and len({r.cost for r in turns}) == 1
        key = lambda x: (x[1] is not None, x[1] or 0, chat.role_number(x[2]))
        assert [key((0, r.turn, r.role)) for r in turns] == sorted(key(x) for x in rows if x[0] == conv)
        text = "".join(r.before + r.piece for r in turns)
        parts = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in parts) == text
        said = [a for a, _ in parts]
        body = said[1:] if said[0] == "system" else said
        assert body == ["user", "assistant"] * (len(body) // 2) and (body or said == ["system"])
        kinds = [(chat.role_number(r.role), chat.ROLES.index(r.new_role), r.done) for r in turns]
        empty = len(said) - sum(k != "merge" for _, _, k in kinds)
        cost = sum(CHANGE(a, b) + chat.MERGE * (k == "merge") for a, b, k in kinds) + sum(chat.unknown(r.role) for r in turns) + chat.INSERT * empty
        assert cost == turns[0].cost == brute_cost([a for a, _, _ in kinds]) + sum(chat.unknown(r.role) for r in turns)
        said_texts = "\n".join(b for _, b in parts if b)
        assert all(chat.escaped(r.text if hasattr(r, "text") else "") in said_texts for r in turns)
    assert chat.repair(df.limit(0), run).count() == 0


def test_whole_texts(spark):
    rows = [(1, 0, "user", "a<|im_end|>"), (1, 1, "user", "b"), (2, 0, None, None), (3, 0, "system", "s"), (3, 1, "human", "q"), (3, 2, "gpt", "r")]
    got = {r.conv_id: r.text for r in chat.texts(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    turn = lambda role, t: f"<|im_start|>{role}\n{t}<|im_end|>\n"
    assert got[2] == turn("user", "") + turn("assistant", "") and got[1] == turn("user", "a<\\|im_end|>") + turn("assistant", "b")
    assert got[3] == turn("system", "s") + turn("user", "q") + turn("assistant", "r")
