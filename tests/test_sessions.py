"""Sessions: joins of hooks and subagents, inputs from prompts, and composite bindings, on small cases."""

import random
import re

from pyspark.sql import functions as F

from tracelens.operators import composites, sessions


def test_hook_join(spark):
    hook = spark.createDataFrame([("s", "u1", 1), ("s", "u2", 2), ("s", None, 3), ("t", "u1", 4)], "session string, use string, n int")
    tx = spark.createDataFrame([("s", "u1", 5, "main", 0), ("s", "u1", 9, "sub", 1), ("s", "u9", 6, "main", 0), ("s", None, 7, "main", 0)], "session string, use string, seq long, agent string, prompt_index long")
    rows, counts = sessions.join_hook_calls(hook, tx, ["session"], "use")
    assert {(r["n"], r["agent"], r["prompt_index"]) for r in rows.collect()} == {(1, "main", 0), (2, None, None), (3, None, None), (4, None, None)}
    assert {tuple(r) for r in counts.collect()} == {("s", 1, 2), ("t", 0, 1)}


def test_spawning_prompts(spark):
    agents = spark.createDataFrame(
        [("s", "by-id", "u1", "other text", "09"), ("s", "by-text", None, "do x", "00"), ("s", "as-of", "u7", "new", "25"), ("s", "early", None, None, "05"), ("s", "no-time", None, None, None), ("empty", "a", None, None, "10")],
        "session string, agent string, use_id string, instruction string, first_ts string")
    uses = spark.createDataFrame([("s", "u1", "do y", 2), ("s", "u2", "do x", 1), ("s", "u3", "do x", 0)], "session string, use_id string, instruction string, prompt_index long")
    prompts = spark.createDataFrame([("s", 0, "10"), ("s", 1, "20"), ("s", 2, "30")], "session string, prompt_index long, ts string")
    got = {(r["session"], r["agent"]): r["prompt_index"] for r in sessions.spawning_prompts(agents, uses, prompts, "session").collect()}
    assert got == {("s", "by-id"): 2, ("s", "by-text"): 1, ("s", "as-of"): 1, ("s", "early"): 0, ("s", "no-time"): 0, ("empty", "a"): -1}


def test_prompt_inputs(spark):
    prompts = spark.createDataFrame([("s", "Look at PAY-12 and PAY-99 in #alerts, token abc123secret; send to team-x"), ("t", None)], "session string, text string")
    mentions = spark.createDataFrame([("s", "jira_key", "PAY-12", 8), ("s", "jira_key", "PAY-99", 19), ("s", "email", "a@b.cd", 1)], "session string, kind string, value string, pos int")
    args = spark.createDataFrame(
        [("s", 1, "issue_key", "PAY-12"), ("s", 2, "query", "text ~ PAY-12"), ("s", 3, "channel", "#alerts"), ("s", 4, "channel", "#other"), ("s", 5, "secret", "abc123secret"), ("s", 6, "to", "team-x"), ("s", 7, "n", "at"), ("s", 8, "weird name", "team-x"), ("s", 9, "same", "PAY-12")],
        "session string, at int, name string, value string")
    got = {(r["name"], r["value"]) for r in sessions.prompt_inputs(prompts, mentions, args, ["session"], F.col("value").endswith("secret")).collect()}
    # two names pass the key, so it is named after its kind
    assert got == {("jira_key", "PAY-12"), ("channel", "#alerts"), ("to", "team-x")}


def test_composites(spark):
    cand = spark.createDataFrame(
        [("e", 1, "payments-api", "copy", False, True, "issue", "service"), ("e", 1, "payments", "copy", False, True, "issue", "short"), ("e", 2, "ab12", "ids:x", True, True, "logs", "ids"), ("e", 2, "a+b (c)", "copy", False, True, "logs", "odd"),
         ("e", 9, "late", "copy", False, True, "z", "late"), ("f", 1, "payments-api", "copy", False, True, "other", "service"), ("e", 3, None, "copy", False, True, "z", "n")],
        "ep string, at long, value string, kind string, in_list boolean, first boolean, source string, name string")
    many = " ".join(f"v{k:03}" for k in range(130))
    cand = cand.unionByName(spark.createDataFrame([("e", 4, f"v{k:03}", "copy", False, True, "m", f"n{k:03}") for k in range(130)], cand.schema))
    texts = {"q": "service=payments-api AND trace:ab12", "r": "payments-apis xab12", "s": "x a+b (c) y", "t": "late", "u": None, "v": "payments payments-api payments", "w": many}
    args = spark.createDataFrame([("e", 5, k, v) for k, v in texts.items()] + [("f", 1, "q", "payments-api here")], "ep string, at long, arg string, value string")
    got = {(r["ep"], r["arg"]): (r["template"], r["kinds"], r["sources"]) for r in composites.bind_composite(args, cand, ["ep"]).collect()}
    assert got["e", "q"] == ("service={{ issue.service }} AND trace:{{ logs.ids }}", ["copy", "ids:x"], ["issue", "logs"])
    assert got["e", "s"][0] == "x {{ logs.odd }} y" and got["e", "v"][0] == "{{ issue.short }} {{ issue.service }} {{ issue.short }}"
    assert {k: got["e", k] for k in "rtu"} == dict.fromkeys("rtu", (None, [], [])) and got["f", "q"][0] is None
    assert got["e", "w"][0] == " ".join(f"{{{{ m.n{k:03} }}}}" for k in range(130))


def test_carried_values_carry_no_text_with_words(spark):
    """Words and phrases against all pairs; no join of one-word values, and no text beside each of its words."""
    rnd = random.Random(6)
    some = ["alpha", "beta_x", "gamma", "delta-four", "epsilon", "alphabet"]
    outs = [(s, at, " ".join(rnd.choices(some, k=3))) for s in range(30) for at in range(1, 7)]
    ins = [(s, " ".join(rnd.choices(some, k=2))) for s in range(30)]
    parts = [(s, at, rnd.choice([*some, "alpha gamma", "gamma epsilon", " beta_x "])) for s in range(30) for at in range(1, 8) for _ in range(2)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = sessions.carried_values(df(parts, "s long, at long, value string"), df(outs, "s long, at long, text string"), df(ins, "s long, text string"), ["s"])
    want = set()
    for s, at, v in parts:
        v = v.strip()
        first = re.search(r"\w+", v)[0]
        holds = lambda t, v=v, first=first: v in t and first in re.findall(r"\w+", t)
        src = max((a for x, a, t in outs if x == s and a < at and holds(t)), default=None)
        if any(x == s and holds(t) for x, t in ins):
            want.add((s, at, v, "inputs"))
        elif src:
            want.add((s, at, v, f"c{src}"))
    assert {tuple(r) for r in got.collect()} == want
    one = sessions.carried_values(df(parts, "s long, at long, value string"), df(outs, "s long, at long, text string"), df(ins, "s long, text string"), ["s"])._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"[\[ ]text#\d+, _w#\d+", one)
