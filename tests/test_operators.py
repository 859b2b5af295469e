import json
import random

from tracelens.operators import binding, dataflow, flows, induce, positions, ranking


EXAMPLE = "step string, arg string, text string, start long, end long"


def learnt(spark, texts, values, arg="a"):
    rows = [("s", arg, t, t.index(v), t.index(v) + len(v)) for t, v in zip(texts, values, strict=False)]
    return positions.learn_programs(spark.createDataFrame(rows, EXAMPLE), ["step", "arg"])


REPORTS = ["Ticket for search-web opened 2026-01-02.\nCause: DiskFull: no room left\nref ref_id=0af3 end", "Ticket for api opened 2026-02-03.\nCause: Timeout: too slow\nref ref_id=77be end", "Ticket for cart-db opened 2026-03-04.\nCause: Refused: none listens\nref ref_id=d00d end"]


def test_positions_between_literals(spark):
    (row,) = learnt(spark, REPORTS, ["search-web", "api", "cart-db"]).collect()
    made = json.loads(row["program"])
    tokens = [t for side in made.values() for t in side["left"] + side["right"]]
    assert any(t.startswith("lit:") for t in tokens) and "lit:-" not in tokens
    assert positions.value_of(row["program"], "Ticket for some-queue opened 2027-01-01.") == "some-queue"


def test_positions_line_and_all(spark):
    programs = learnt(spark, REPORTS, ["DiskFull: no room left", "Timeout: too slow", "Refused: none listens"])
    program = programs.first()["program"]
    other = "Cause: A: b\nref ref_id=1 end\nCause: C: d e\nref ref_id=2 end"
    assert positions.value_of(program, REPORTS[0].replace("no room left", "x y")) == "DiskFull: x y"
    assert positions.values_of(program, other) == ["A: b", "C: d e"]
    data = spark.createDataFrame([("s", "a", other), ("s", "b", other), ("s", "a", None), ("s", "a", "")], "step string, arg string, text string")
    got = {(r["arg"], r["text"]): r["values"] for r in positions.extract(data, programs, ["step", "arg"], "text", every=True).collect()}
    assert got == {("a", other): ["A: b", "C: d e"], ("b", other): None, ("a", None): None, ("a", ""): []}


def test_positions_anchor_beats_number(spark):
    texts = ["list 11aa 22bb\nchosen=33cc\nrest=44dd", "list 55ee\nchosen=66ff\nrest=1a1a 2b2b", "list 3c3c 4d4d 5e5e\nchosen=6f6f\nrest=7a7a"]
    program = learnt(spark, texts, ["33cc", "66ff", "6f6f"]).first()["program"]
    assert positions.value_of(program, "list 1 2 3 4\nchosen=9b9b\nrest=0") == "9b9b"


def test_positions_prefer_what_fits_no_other_value(spark):
    """A number among the values cannot explain the choice, an anchor can; of two anchors the one that fits fewer others goes."""
    texts = ["box aa11bb22 cc33dd44\npick=ee55ff66\nlast=12ab34cd", "box 12121212\npick=fe98dc76\nlast=ab12cd34 98769876", "box 33334444 55556666 77778888\npick=ba76dc98\nlast=00000000"]
    values = ["ee55ff66", "fe98dc76", "ba76dc98"]
    rows = [("s", "a", t, t.index(v), t.index(v) + len(v)) for t, v in zip(texts, values, strict=True)]
    rows += [("s", "kept", t, t.index(v), t.index(v) + len(v)) for t, v in (("one two three four", "three"), ("a b c d e f", "e"))]
    (a, kept) = positions.learn_programs(spark.createDataFrame(rows, EXAMPLE), ["step", "arg"], gate=True).orderBy("arg").collect()
    assert positions.value_of(a["program"], "box 1 2 3\npick=0a0b0c0d\nlast=1") == "0a0b0c0d" and (a["examples"], a["holds"]) == (3, True)
    assert (kept["examples"], kept["holds"]) == (2, False)


def test_held_out_gate_is_leave_one_out(spark):
    """The gate from counts against learning anew without each example."""
    rnd, rows = random.Random(3), []
    for arg in range(14):
        for _ in range(rnd.randint(1, 5)):
            words = [rnd.choice(["alpha", "b7", "x-1", "99", "id:", "k=v"]) for _ in range(rnd.randint(2, 6))]
            value, place = f"v{rnd.randint(10, 99)}", rnd.randint(0, len(words))
            marked = [*words[:place], *(["at:"] if arg % 3 else []), value, *words[place:]]
            text = rnd.choice([" ", " ", "\n"]).join(marked)
            rows.append(("s", f"{arg:02}", text, text.index(value), text.index(value) + len(value)))
    rows = sorted(set(rows))
    got = {r["arg"]: (r["program"], r["examples"], r["holds"]) for r in positions.learn_programs(spark.createDataFrame(rows, EXAMPLE), ["step", "arg"], gate=True).collect()}
    folds = [(f"{i}", r[1], *r[2:]) for i, x in enumerate(rows) for r in rows if r[1] == x[1] and r != x]
    learnt = {(r["step"], r["arg"]): r["program"] for r in positions.learn_programs(spark.createDataFrame(folds, EXAMPLE), ["step", "arg"]).collect()}
    for arg in got:
        mine = [(i, x) for i, x in enumerate(rows) if x[1] == arg]
        finds = [(p := learnt.get((f"{i}", arg))) is not None and positions.value_of(p, x[2]) == x[2][x[3] : x[4]] for i, x in mine]
        assert got[arg][1:] == (len(mine), len(mine) > 1 and all(finds)), arg
    assert {True, False} == {g[2] for g in got.values()}


def test_positions_without_program(spark):
    rows = [("s", "none", "a b", 0, 1), ("s", "none", "c d", 2, 3), ("s", "class", "ab|cd", 3, 5), ("s", "class", "xy-zw", 3, 5), ("s", "place", "ab|cd", 3, 5), ("s", "place", "abcde", 3, 5), ("s", "bad", None, 0, 1), ("s", "bad", "abc", 2, 9), (None, "class", "k: v", 3, 4)]
    got = {(r["step"], r["arg"]): r["program"] for r in positions.learn_programs(spark.createDataFrame(rows, EXAMPLE), ["step", "arg"]).collect()}
    assert got["s", "none"] is None and got["s", "bad"] is None
    assert positions.value_of(got["s", "class"], "12+34") == "34"
    assert positions.value_of(got["s", "place"], "12345") == "45"
    assert positions.learn_programs(spark.createDataFrame([], EXAMPLE), ["step", "arg"]).collect() == []


def steps(spark, rows):
    data = [("t", s, i, tool, args, raw or args, kinds, classes, hits) for s, i, tool, args, raw, kinds, classes, hits in rows]
    return spark.createDataFrame(data, "trigger string, session string, idx long, tool string, args map<string,string>, raw map<string,string>, kinds map<string,string>, classes map<string,string>, hits long")


def test_collapse(spark):
    rows = [
        ("a", 0, "jira.get", {"k": "{{ inputs.key }}"}, {"k": "P-1"}, {"k": "input"}, {"k": "text"}, 1),
        ("a", 1, "logs.search", {"q": "{{ i.ids | first }}"}, {"q": "t1"}, {"q": "ids:trace_id"}, {"q": "id"}, 2),
        ("a", 2, "logs.search", {"q": "{{ i.ids | first }}"}, {"q": "t2"}, {"q": "ids:trace_id"}, {"q": "id"}, 3),
        ("a", 3, "chat.search", {"q": "{{ i.summary }}"}, {"q": "sum"}, {"q": "copy"}, {"q": "text"}, 0),
        ("a", 4, "chat.search", {"q": "plain"}, {"q": "plain"}, {"q": "literal"}, {"q": ""}, 4),
        ("a", 5, "code.grep", {"q": "x"}, None, {"q": "literal"}, {"q": ""}, 0),
        ("a", 6, "code.grep", {"q": "x"}, None, {"q": "literal"}, {"q": ""}, 5),
    ]
    got = induce.collapse(steps(spark, rows)).orderBy("idx").collect()
    assert [(r["tool"], r["each"], r["items"], r["repeated"], r["hits"], r["ladder"]) for r in got] == [
        ("jira.get", None, 1, 1, 1, []), ("logs.search", "q", 2, 1, 5, []), ("chat.search", None, 1, 1, 4, ["{{ i.summary }}", "plain"]), ("code.grep", None, 1, 2, 5, [])]


def test_collapse_changes_of_way(spark):
    rows = [("a", i, "t", {"q": q}, {"q": raw}, {"q": kind}, {"q": "x"}, hits) for i, (q, raw, kind, hits) in enumerate([
        ("{{ a }}", "1", "copy", 0), ("{{ b }}", "2", "copy", 0), ("{{ b }}", "2", "copy", 3), ("plain", "p", "literal", 1), ("{{ c }} x", "3 x", "ids:n", 2), ("{{ c }} x", "4 x", "ids:n", 2)])]
    rows += [("b", 0, "t", None, None, None, None, 1), ("b", 1, "t", None, None, None, None, 2), ("b", 2, "u", {}, {}, {}, {}, 0)]
    got = induce.collapse(steps(spark, rows)).orderBy("session", "idx").collect()
    assert [(r["session"], r["idx"], r["each"], r["items"], r["repeated"], r["hits"]) for r in got] == [
        ("a", 0, "q", 2, 2, 3), ("a", 3, None, 1, 1, 1), ("a", 4, "q", 2, 1, 4), ("b", 0, None, 1, 2, 2), ("b", 2, None, 1, 1, 0)]
    assert got[0]["args"] == {"q": "{{ item }}"}


def test_align_and_merge(spark):
    rows = []
    for s, order in (("a", "jcl"), ("b", "jlc"), ("c", "jclx")):
        for i, what in enumerate(order):
            tool = {"j": "jira.get", "c": "chat.search", "l": "logs.search", "x": "code.grep"}[what]
            arg = {"j": ("{{ inputs.key }}", "input", "text"), "c": ("{{ issue.summary }}", "copy", "text"), "l": ("{{ issue.trace }}", "ids:trace_id", "id"), "x": ("only-here", "literal", "")}[what]
            rows.append((s, i, tool, {"q": arg[0]}, {"q": f"{s}{what}"}, {"q": arg[1]}, {"q": arg[2]}, 1))
    aligned = induce.align(induce.collapse(steps(spark, rows)))
    per = {(r["session"], r["tool"]): r["step"] for r in aligned.collect()}
    assert len({per[s, "logs.search"] for s in "abc"}) == 1 and len(set(per.values())) == 4
    merged = {r["step"]: (r["kind"], r["templates"], r["seen_in"]) for r in induce.merge_arguments(aligned).collect()}
    assert merged[per["a", "chat.search"]] == ("bound", ["{{ issue.summary }}"], 3)
    assert merged[per["c", "code.grep"]] == ("constant", ["only-here"], 1)


def test_align_two_turns_and_contradictions(spark):
    call = lambda s, i, classes: (s, i, "t", dict.fromkeys(classes, "x"), None, {}, classes, 1)
    rows = [call("a", 0, {"q": "id"}), call("a", 1, {"q": "id,text"}), call("a", 2, {"q": "id", "w": "far"}), call("b", 0, {"q": "text"}), call("b", 1, {"q": "window"}), call("c", 0, {}), call("c", 1, {"q": "text", "w": "near"})]
    got = {(r["session"], r["idx"]): r["step"] for r in induce.align(steps(spark, rows)).collect()}
    assert got["a", 0] == got["b", 0] and got["a", 1] != got["a", 0] and len({got["b", 1], got["c", 0], got["a", 0]}) == 3
    assert induce.align(steps(spark, [])).collect() == []


def test_components_ignore_pseudo_sources():
    edges = [("prompt", "x", "a"), ("prompt", "x", "b"), ("a", "y", "c"), ("c", "z", "d")]
    assert dataflow.components_of(edges) == [frozenset({edges[0], edges[2], edges[3]}), frozenset({edges[1]})]


def test_few_examples_are_described_at_once():
    """Descriptions of a batch of any size come in frames of a few examples."""
    import pandas as pd

    batch = pd.DataFrame([(1, i, f"ref {i} from nation=X{i}", 4, 5 + (i > 9)) for i in range(100)], columns=["_key", "_id", "text", "start", "end"])
    frames = list(positions._described_frames(iter([batch])))
    assert max(f["_id"].nunique() for f in frames) <= positions.TEXTS < 100
    assert sorted(set(pd.concat(frames)["_id"])) == list(range(100))


def test_collapse_and_align_hold_little_of_the_input(spark):
    """A session is sorted once to be collapsed, and the number of tasks follows the rows: shuffled bytes do not tell how much a task sorts."""
    rows = steps(spark, [(f"s{i % 9}", i, "t", {"q": "x"}, None, {"q": "literal"}, {"q": ""}, 1) for i in range(90)])
    plan = induce.collapse(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [trigger") == 1
    assert ranking.dealt(rows, ["trigger", "session"], 9).rdd.getNumPartitions() == 11
    aligned = induce.align(induce.collapse(rows))
    assert "Sort" not in aligned._jdf.queryExecution().executedPlan().toString() and aligned.count() == 9


def test_bind_carries_columns(spark):
    args = spark.createDataFrame([("e", 0, "a", "v", 7), ("e", 1, "a", "v", 8)], "e string, at long, arg string, value string, more long")
    candidates = spark.createDataFrame([("e", "v", 0, "copy", False, True, "s", "n")], "e string, value string, at long, kind string, in_list boolean, first boolean, source string, name string")
    got = binding.bind(args, candidates, ["e"], ("more",)).orderBy("at").collect()
    assert [(r["more"], r["kind"], r["src"]) for r in got] == [(7, "unresolved", None), (8, "copy", 0)]


def test_steps_with_places_are_named_alike(spark):
    """Places and counts of sessions taken from ``place`` are those that named_steps finds itself."""
    rows = steps(spark, [(s, i, t, {"q": "x"}, None, {"q": "literal"}, {"q": ""}, i % 2) for s in "abc" for i, t in enumerate("uvuw" if s == "b" else "vuu")])
    collapsed = induce.collapse(rows)
    got = [sorted(flows.named_steps(f(collapsed)).collect()) for f in (induce.align, induce.place)]
    assert got[0] == got[1] and len(got[0]) > 3
    plan = induce.place(collapsed).groupBy("step").agg(induce.sessions_of(induce.place(collapsed)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "distinct" not in plan
