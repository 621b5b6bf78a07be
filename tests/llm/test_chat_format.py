import hashlib
import random

from protolens.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, tokens long, window long, own int"


def rows():
    out = [(-7, 0, "user", C.PLANTED), (-7, 1, "assistant", C.PLANTED), (1, 0, "system", "be <kind> & brief"), (2, 0, "system", "only"), (3, None, None, None), (3, 0, "assistant", None), (4, 0, "user", "dup"), (4, 0, "user", "dup"), (4, 1, "assistant", "&lt; </turn>\n<turn user>\n"), (None, 0, "user", "q"), (None, 1, "assistant", "🙂 a"), (5, 1, "assistant", "w " * 5000), (5, 0, "user", "x " * 900)]
    out += [(1, 1 + i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i * 7 % 90)) for i in range(700)]
    return [(*r, 9, 9, 9) for r in out]


def expected(given):
    out = {}
    for conv in {r[0] for r in given}:
        own = sorted((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in given if r[0] == conv)
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.conversation_digests(C.format_chats(df)).collect()}
    assert got == expected(given)


def test_windows(spark):
    windows = C.format_chats(spark.createDataFrame(rows(), SCHEMA)).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 20
    for w in windows:
        assert w["n_tokens"] <= C.BUDGET
        assert w["text"].startswith("<turn system>\nbe &lt;kind&gt; &amp; brief</turn>\n")
    assert sum(w["n_context"] > 1 for w in windows) > len(windows) // 2
    assert sum(len(w["loss"]) for w in windows) == 350


def test_budget_with_large_turns_and_system_turns(spark):
    """No window is above the budget unless the system turn and one turn are."""
    r = random.Random(4)
    given, system, largest = [], {}, {}
    for conv in range(40):
        system[conv] = 0 if conv % 4 == 0 else r.choice([20, 500, 700, 900, 1000, 1019, 1100])
        if system[conv]:
            given.append((conv, 0, "system", "s " * system[conv]))
            system[conv] += C.OVERHEAD
        for i in range(1, 40):
            n = r.choice([3, 40, 200, 260, 700, 804, 900, 1000, 1020] if conv % 2 else [1, 5, 30, 120, 250])
            given.append((conv, i, ("user", "assistant")[i % 2], "w " * n))
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    windows = C.format_chats(df)
    for w in windows.collect():
        own = w["n_turns"] - w["n_context"]
        if own == 1:
            words = len(w["text"].rsplit("<turn ", 1)[1].split(">", 1)[1].replace("</turn>", "").split())
            assert w["n_tokens"] <= C.BUDGET or system[w["conv_id"]] + words + C.OVERHEAD > C.BUDGET
        else:
            assert w["n_tokens"] <= C.BUDGET
    got = {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in C.conversation_digests(windows).collect()}
    assert got == expected(given)


def test_empty(spark):
    assert C.conversation_digests(C.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
