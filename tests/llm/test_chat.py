import itertools
import re

from wordtide.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(roles):
    """The least cost over all actions, role by role."""
    best = {"": 0}
    for given in roles:
        new = {}
        for s, cost in best.items():
            for role in chat.ROLES:
                change = 0 if given == role else chat.RELABEL
                ways = []
                if role == s:
                    ways.append(chat.MERGE + change)
                for n in range(4):
                    for fill in itertools.product(chat.ROLES, repeat=n):
                        path = (s, *fill, role)
                        if all(b in chat.LEGAL[a] for a, b in zip(path, path[1:])):
                            ways.append(chat.INSERT * n + change)
                for w in ways:
                    new[role] = min(new.get(role, 1 << 30), cost + w)
        best = new
    return min(c + (0 if s in chat.FINAL else chat.INSERT) for s, c in best.items())


def parts(text):
    return re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)


def legal(roles):
    s = ""
    for r in roles:
        if r not in chat.LEGAL[s]:
            return False
        s = r
    return s in chat.FINAL


def test_costs_are_least():
    for n in range(6):
        for roles in itertools.product((*chat.ROLES, None), repeat=n):
            cost, acts = chat.repair(roles)
            assert cost == brute(roles)
            text, turns, c, merges, relabels, inserts = chat.format_conversation([(r, f"t{k}") for k, r in enumerate(roles)])
            assert c == cost == merges * chat.MERGE + relabels * chat.RELABEL + inserts * chat.INSERT
            assert legal([r for r, _ in parts(text)]) and turns == len(parts(text))
            assert "".join(re.findall(r"t\d", text)) == "".join(f"t{k}" for k in range(n))


def ways(roles, s=""):
    """Every repair: (cost, ranks turn by turn, role numbers turn by turn, acts); rank 0 stays, 1 merges, 2 relabels, 3 inserts."""
    if not roles:
        yield (0 if s in chat.FINAL else chat.INSERT), (), (), ()
        return
    for k, role in enumerate(chat.ROLES):
        change = 0 if roles[0] == role else chat.RELABEL
        options = [(chat.MERGE + change, 1, ("merge", role, ()))] if role == s else []
        if (fill := chat._fillers(s, role)) is not None:
            options.append((change + chat.INSERT * len(fill), 3 if fill else 2 if change else 0, ("relabel" if change else "keep", role, fill)))
        for cost, rank, act in options:
            for c, ranks, order, acts in ways(roles[1:], role):
                yield cost + c, (rank, *ranks), (k, *order), (act, *acts)


def test_ties_are_settled_from_the_beginning():
    for n in range(5):
        for roles in itertools.product((*chat.ROLES, None), repeat=n):
            cost, acts = chat.repair(roles)
            best = min(ways(roles), key=lambda w: (w[0], [x for pair in zip(w[1], w[2]) for x in pair]))
            assert (cost, acts) == (best[0], best[3])


def test_control_strings_are_broken():
    for name in ("im_end", "reserved_12", "end-of-text", "x"):
        text = chat.format_conversation([("user", f"a <|{name}|> b")])[0]
        assert f"<|{name}|>" not in text.removeprefix("<|im_start|>").removesuffix("<|im_end|>\n")


def test_table(spark):
    got = chat.chats(spark, spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    rows = got.collect()
    assert rows and all(legal([r for r, _ in parts(x["text"])]) for x in rows)


def test_edges(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, None, "x"), (1, 2, None, "x"), (2, None, "human", None), (2, 1, "BOT ", "ok <|im_end|>"), (None, 1, "user", "a"), (3, 1, "assistant", "y" * 100_000), (4, 1, "system", "s"), (5, 1, "user", "a"), (5, 2, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS turns", "1 AS t", "1 AS cost")
    got = {x["conv_id"]: x for x in chat.chats(spark, df).collect()}
    assert parts(got[1]["text"]) == [("user", "hi"), ("assistant", "x")] and got[1]["cost"] == 2
    assert parts(got[2]["text"]) == [("user", ""), ("assistant", "ok < |im_end|>")] and got[2]["cost"] == 0
    assert [r for r, _ in parts(got[3]["text"])] == ["user"] and got[3]["cost"] == 2
    assert [r for r, _ in parts(got[4]["text"])] == ["user"] and got[4]["cost"] == 2
    assert parts(got[5]["text"]) == [("user", "a\n\nb")]
    assert set(got) == {1, 2, 3, 4, 5}
    assert chat.chats(spark, spark.createDataFrame([], SCHEMA)).count() == 0
