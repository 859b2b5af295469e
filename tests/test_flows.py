"""Induced flows, replayed bindings and stable orders against plain versions of them."""

import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracelens import api
from tracelens.operators import flows, induce, ordering, skeleton, templates
from tracelens.queries import induction

SF = "/root/testdata/sf0.001"
REF = r"\{\{[^}]*\}\}"
STEPS = "trigger string, session string, idx long, tool string, args map<string,string>, raw map<string,string>, kinds map<string,string>, classes map<string,string>, hits long"


def heads(t):
    return [re.match(r"\w+", x.strip())[0] for x in re.findall(r"\{\{([^}]*)\}\}", t)]


def changed(a, b):
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def item(t):
    return re.sub(REF, "{{ item }}", t or "")


def collapse(calls):
    """Steps of one session's calls in order."""
    out = []
    for now in calls:
        way, was = None, out and out[-1]["last"]
        if was and was["tool"] == now["tool"]:
            raw, bound = changed(now["raw"], was["raw"]), changed(now["args"], was["args"])
            listed = lambda c, k: c["kinds"].get(k) == "copy" or (c["kinds"].get(k) or "").startswith("ids:")
            if not raw:
                way = ("repeat", None)
            elif len(raw) == 1 and set(bound) <= set(raw) and listed(now, raw[0]) and listed(was, raw[0]) and item(now["args"].get(raw[0])) == item(was["args"].get(raw[0])):
                way = ("each", raw[0])
            elif len(bound) == 1 and now["args"].get(bound[0]) is not None and was["args"].get(bound[0]) is not None and was["hits"] == 0:
                way = ("ladder", bound[0])
        run = out[-1] if out else None
        if way is None or (way[0] != "repeat" and run["way"] and run["way"] != way):
            out.append({"calls": [now], "ways": [None], "way": None, "last": now})
        else:
            run["calls"].append(now)
            run["ways"].append(way)
            run["way"] = run["way"] or (way if way[0] != "repeat" else None)
            run["last"] = now
    steps = []
    for run in out:
        first, last, how, arg = run["calls"][0], run["calls"][-1], *(run["way"] or (None, None))
        tried = [c for c, w in zip(run["calls"], run["ways"], strict=True) if w and w[0] == "ladder"]
        taken = [first] + [c for c, w in zip(run["calls"], run["ways"], strict=True) if w and w[0] == "each"]
        args = dict(first["args"])
        if how == "each":
            args[arg] = item(args[arg])
        if how == "ladder":
            args = dict(last["args"])
        steps.append({
            **first, "args": args, "each": arg if how == "each" else None, "items": 1 + sum(w is not None and w[0] == "each" for w in run["ways"]), "repeated": 1 + sum(w is not None and w[0] == "repeat" for w in run["ways"]),
            "hits": sum(c["hits"] for c in run["calls"]) if how == "each" else last["hits"] if how == "ladder" else max(c["hits"] for c in run["calls"]), "rung": arg if how == "ladder" else None,
            "ladder": [(c["args"][arg], c["hits"]) for c in [first, *tried]] if how == "ladder" else [], "refs": sorted({m[0] for c in taken if (m := re.search(REF, c["args"][arg]))}) if how == "each" else [], "upto": last["idx"]})
    return steps


def named(classes):
    return tuple(sorted((k, tuple(sorted(set(v.split(","))))) for k, v in classes.items() if v))


def align(rows):
    """The common step of each row of one trigger: signatures that meet are one kind; turns of a kind in a session."""
    signs = sorted({(r["tool"], named(r["classes"])) for r in rows}, key=repr)

    def meet(x, y):
        if x[0] != y[0]:
            return False
        a, b = dict(x[1]), dict(y[1])
        if not a or not b:
            return not a and not b
        both = a.keys() & b.keys()
        return bool(both) and all(set(a[k]) & set(b[k]) for k in both)

    group = {s: i for i, s in enumerate(signs)}
    while True:
        before = dict(group)
        for x in signs:
            for y in signs:
                if meet(x, y):
                    group[x] = group[y] = min(group[x], group[y])
        if group == before:
            break
    turn, place, where = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["session"], r["idx"])):
        g = group[r["tool"], named(r["classes"])]
        r["kind"] = (r["tool"], g, turn[r["session"], r["tool"], g])
        turn[r["session"], r["tool"], g] += 1
        place[r["session"]] += 1
        where[r["kind"]].append(place[r["session"]])
    return {k: sum(v) / len(v) for k, v in where.items()}


def order(rank, edges):
    """Places of nodes by rank: each right behind its dependencies; cuts where there is no way."""
    edges, path, cuts = {k: v for k, v in edges.items() if k[0] != k[1] and k[0] in rank and k[1] in rank}, {}, []
    while len(path) < len(rank):
        ready = [n for n in rank if n not in path and all(d in path for m, d in edges if m == n)]
        if not ready:
            open_ = {e for e in edges if e[1] not in path}
            while (left := {e for e in open_ if any(d == e[0] for _, d in open_)}) != open_:
                open_ = left
            ahead = [e for e in open_ if (rank[e[1]], e[1]) > (rank[e[0]], e[0])]
            node = min({e[0] for e in ahead}, key=lambda n: (not all(edges[e] for e in ahead if e[0] == n), rank[n], n))
            cuts += [(*e, edges.pop(e)) for e in ahead if e[0] == node]
            continue
        for n in ready:
            floor = max((path[d] for m, d in edges if m == n), default=[])
            path[n] = floor + [rank[n]] if floor > [rank[n]] else [rank[n]]
    return {n: i for i, n in enumerate(sorted(path, key=lambda n: (path[n], n)))}, cuts


def plain_flow(calls):
    """Steps and arguments of one trigger's flow from its sessions' bound calls."""
    by = defaultdict(list)
    for c in sorted(calls, key=lambda c: (c["session"], c["idx"])):
        by[c["session"]].append(c)
    rows = [s for some in by.values() for s in collapse(some)]
    mean = align(rows)
    steps = {k: [r for r in rows if r["kind"] == k] for k in mean}
    return by, rows, mean, steps


def bound_rows(spark):
    c = induction.week_calls(spark, SF)
    return [r.asDict() for r in induction.bound_steps(c).collect()], c


def test_induced_flows(spark):
    calls, c = bound_rows(spark)
    got = flows.induce_flows(induction.bound_steps(c), induction.week_inputs(c))
    steps, arguments, cuts = [r.asDict() for r in got.steps.collect()], [r.asDict() for r in got.arguments.collect()], [r.asDict() for r in got.cuts.collect()]
    for trigger in {x["trigger"] for x in calls}:
        by, rows, mean, members = plain_flow([x for x in calls if x["trigger"] == trigger])
        mine = sorted((s for s in steps if s["trigger"] == trigger), key=lambda s: s["step"])
        assert len(mine) == len(mean)
        starts = {(r["session"], r["idx"]): r["kind"] for r in rows}
        pairs = {(r["session"], r["idx"]): r["step"] for r in induce.align(induce.collapse(induction.bound_steps(c))).where(F.col("trigger") == trigger).collect()}
        assert pairs.keys() == starts.keys()
        number = {}
        for at, kind in starts.items():
            assert number.setdefault(kind, pairs[at]) == pairs[at]
        assert len(set(number.values())) == len(number)
        kind_of = {v: k for k, v in number.items()}
        seen = {k: len({r["session"] for r in v}) for k, v in members.items()}
        ids, used = {}, defaultdict(int)
        for k in sorted(members, key=lambda k: (-seen[k], mean[k], number[k])):
            used[k[0]] += 1
            ids[k] = k[0] if used[k[0]] == 1 else f"{k[0]}_{used[k[0]]}"

        def renamed(t, session):
            def new(m):
                h = re.match(r"\{\{\s*(\w+)(.*?)\s*\}\}", m[0])
                if h[1] in ("inputs", "item"):
                    return m[0]
                at = int(h[1][1:])
                return "{{ " + ids[next(r["kind"] for r in rows if r["session"] == session and r["idx"] <= at <= r["upto"])] + h[2] + " }}"

            return re.sub(REF, new, t)

        plain, soft = {}, {}
        for k, some in members.items():
            tries = defaultdict(list)
            for r in some:
                for arg, t in r["args"].items():
                    for x, hits in r["ladder"] if r["rung"] == arg else [(t, r["hits"])]:
                        tries[arg].append((renamed(x, r["session"]), hits, r["session"], r["idx"], r["kinds"][arg] == "unresolved", r["raw"][arg]))
            fan = min((r for r in some if r["each"]), key=lambda r: (r["session"], r["idx"]), default=None)
            terms, most = set(), None
            if fan:
                arg, shape = fan["each"], fan["args"][fan["each"]]
                most = max(r["items"] for r in some if r["each"] == arg) + 2
                for r in some:
                    if r["each"] == arg:
                        terms |= {renamed(x, r["session"]) for x in r["refs"]}
                    elif not r["each"] and item(r["args"].get(arg)) == shape and (m := re.search(REF, r["args"][arg])):
                        terms.add(renamed(m[0], r["session"]))
            args = {}
            for arg, some_tries in tries.items():
                kinds = defaultdict(list)
                for x in some_tries:
                    kinds[x[0]].append(x)
                stat = {t: (-sum(x[1] > 0 for x in v) / len(v), -len(v), -len(re.findall(REF, t)), min((x[2], x[3]) for x in v), t) for t, v in kinds.items()}
                open_ = {x[5] for x in some_tries if x[4]}
                stays = [t for t, v in kinds.items() if re.search(REF, t) or not any(x[4] for x in v) or len({x[2] for x in v}) > 1]
                ranked = sorted(stays, key=stat.get)
                usual = min(kinds, key=lambda t: (-len(kinds[t]), stat[t][3], t))
                bounds = [t for t in kinds if re.search(REF, t)]
                if len(kinds) == 1:
                    args[arg] = ("bound" if bounds else "constant", [usual])
                elif not bounds:
                    args[arg] = ("unresolved" if len(open_) > 1 else "majority", [usual])
                elif len(stays) == 1:
                    args[arg] = ("bound", ranked)
                elif len({" ".join(re.findall(REF, t)) for t in stays}) == 1:
                    args[arg] = ("unresolved", ranked[:1])
                else:
                    args[arg] = ("ladder", ranked[:6])
            if fan:
                args[fan["each"]] = ("item", [fan["args"][fan["each"]]])
            plain[k] = {"args": args, "terms": sorted(terms), "most": most, "fan": fan}
            own = defaultdict(list)
            for _, ts in args.values():
                for h in {h for t in ts for h in heads(t)}:
                    own[h].append(sum(h in heads(t) for t in ts) < len(ts))
            for t in terms:
                own[heads(t)[0]].append(True)
            names = {v: n for n, v in ids.items()}
            for h, s in own.items():
                if h in names:
                    soft[number[k], number[names[h]]] = all(s)
        rank = {number[k]: i for i, k in enumerate(sorted(mean, key=lambda k: (mean[k], number[k])))}
        places, gone = order(rank, soft)
        lost = defaultdict(set)
        for n, d, _ in gone:
            lost[n].add(ids[kind_of[d]])
        assert sorted((ids[kind_of[n]], ids[kind_of[d]], s) for n, d, s in gone) == sorted((x["id"], x["lost"], x["soft"]) for x in cuts if x["trigger"] == trigger)
        by_arg = {(a["id"], a["arg"]): (a["kind"], a["templates"]) for a in arguments if a["trigger"] == trigger}
        for s in mine:
            k = kind_of[s["step"]]
            some, p = members[k], plain[k]
            for arg, (kind, ts) in p["args"].items():
                left = [t for t in ts if not set(heads(t)) & lost[s["step"]]] if len(ts) > 1 else ts
                assert by_arg[s["id"], arg] == (kind, left or ts), (s["id"], arg)
                assert json.loads(s["args"])[arg] == (left or ts)
            terms = [re.search(r"\{\{\s*(.*?)\s*\}\}", t)[1] for t in p["terms"] if not set(heads(t)) & lost[s["step"]]]
            expr = None if not p["fan"] else "[]" if not terms else (terms[0] if len(terms) == 1 else "(" + " + ".join(terms) + ")") + " | unique | list"
            assert (s["id"], s["place"], s["each"], s["for_each"], s["max_items"]) == (ids[k], places[s["step"]], p["fan"] and p["fan"]["each"], expr, p["most"])
            reps = sorted(r["repeated"] for r in some)
            assert (s["seen_in"], s["sessions"], s["optional"], s["repeated_max"], s["repeated_median"]) == (seen[k], len(by), seen[k] < len(by) or all(r["hits"] == 0 for r in some), reps[-1], reps[len(reps) // 2])
            assert s["unresolved"] == sorted(a for a, (kind, _) in p["args"].items() if kind == "unresolved")
    assert {(x["trigger"], x["inputs"]) for x in got.cases.collect()} == {(x["trigger"], json.dumps({"key": x["raw"]["key"]}).replace(" ", "")) for x in calls if x["idx"] == 0}


def test_collapse_of_random_calls(spark):
    """Repeats, fan-outs and ladders in any order, also where a run begins with the call that ended another."""
    rnd, rows = random.Random(5), []
    for s in range(120):
        for i in range(rnd.randint(1, 14)):
            kind = rnd.choice(["copy", "copy", "ids:x", "literal"])
            a = {"q": rnd.choice("12"), "w": rnd.choice("xxy")}
            t = {"q": "{{ c%s.q }}" % rnd.choice("01") if kind != "literal" else a["q"], "w": a["w"]}
            rows.append(("t", f"{s:03}", i, rnd.choice("aaab"), t, a, {"q": kind, "w": "literal"}, {"q": "id", "w": ""}, rnd.choice([0, 0, 1])))
    names = [x.split()[0] for x in STEPS.split(", ")]
    want = []
    for s in sorted({r[1] for r in rows}):
        want += collapse([dict(zip(names, r, strict=True)) for r in rows if r[1] == s])
    got = induce.collapse(spark.createDataFrame(rows, STEPS)).orderBy("session", "idx").collect()
    assert [(r["session"], r["idx"], r["args"], r["each"], r["items"], r["repeated"], r["hits"], r["rung"], list(zip(r["ladder"], r["rung_hits"], strict=True)), r["item_refs"]) for r in got] == [
        (w["session"], w["idx"], w["args"], w["each"], w["items"], w["repeated"], w["hits"], w["rung"], w["ladder"], w["refs"]) for w in want]


def test_flow_of_three_sessions(spark):
    """Two orders and one extra step; a literal of one session is no rung; rungs of one shape are no ladder."""
    rows = []
    for s, names in (("a", "igl"), ("b", "ilg"), ("c", "iglx")):
        for i, n in enumerate(names):
            tool, arg, kind, cls = {"i": ("jira.issue", "{{ inputs.key }}", "input", "text"), "g": ("code.grep", "{{ c0.error }}", "copy", "text"), "l": ("logs.search", "trace:{{ c0.trace }}", "composite", "id"), "x": ("pd.services", "all", "literal", "")}[n]
            rows.append(("t", s, i, tool, {"q": arg}, {"q": f"{s}{n}"}, {"q": kind}, {"q": cls}, 2))
    rows += [("t", "a", 9, "chat.find", {"q": "only words of a"}, {"q": "only words of a"}, {"q": "unresolved"}, {"q": "text"}, 1), ("t", "b", 9, "chat.find", {"q": "{{ c0.error }} now"}, {"q": "e"}, {"q": "composite"}, {"q": "text"}, 0), ("t", "c", 9, "chat.find", {"q": "{{ c0.error }} now"}, {"q": "f"}, {"q": "composite"}, {"q": "text"}, 1)]
    rows += [("t", s, 10, "code.read", {"path": f"{d}/{{{{ c0.name }}}}", "n": "1"}, {"path": d, "n": "1"}, {"path": "composite", "n": "literal"}, {"path": "text", "n": ""}, 1) for s, d in zip("abc", "xyz", strict=True)]
    inputs = spark.createDataFrame([("t", s, "key", k) for s, k in (("a", "ABC-1"), ("b", "ABC-2"), ("c", "ABC-2"))], "trigger string, session string, name string, value string")
    got = flows.induce_flows(spark.createDataFrame(rows, STEPS), inputs)
    steps = {r["id"]: r for r in got.steps.collect()}
    assert sorted(steps, key=lambda i: steps[i]["place"]) == ["issue", "grep", "search", "services", "find", "read"]
    assert steps["services"]["optional"] and steps["services"]["seen_in"] == 1 and not steps["grep"]["optional"]
    args = {(r["id"], r["arg"]): r for r in got.arguments.collect()}
    assert args["grep", "q"]["templates"] == ["{{ issue.error }}"] and args["search", "q"]["templates"] == ["trace:{{ issue.trace }}"]
    assert (args["find", "q"]["kind"], args["find", "q"]["templates"], args["find", "q"]["dropped"]) == ("bound", ["{{ issue.error }} now"], 1)
    assert args["read", "path"]["kind"] == "unresolved" and len(args["read", "path"]["templates"]) == 1 and steps["read"]["unresolved"] == ["path"]
    assert [(r["name"], r["type"], r["example"]) for r in got.inputs.collect()] == [("key", "jira_key", "ABC-1")]
    assert {(r["inputs"], r["sessions"], tuple(r["min_hits"])) for r in got.cases.collect()} == {('{"key":"ABC-1"}', 1, ("grep", "issue", "read", "search")), ('{"key":"ABC-2"}', 2, ("grep", "issue", "read", "search"))}
    (shown,) = api.card(got).collect()
    assert shown["found"] == "Every traced run had hits on: grep, issue, read, search." and [o["name"] for o in shown["outputs"]] == ["jira", "code", "logs", "pd", "chat"]
    assert api.induce(spark.createDataFrame(rows, STEPS), inputs).steps.count() == 6
    empty = flows.induce_flows(spark.createDataFrame([], STEPS), inputs.where("false"))
    assert empty.steps.collect() == empty.arguments.collect() == empty.cases.collect() == []


def test_skeletons(spark):
    """Groups by name, tool and server; required ones; what is not looked at."""
    steps = [("slack_thread", 0, "repeat_search", "jira.jira_search", None, None, False), ("slack_thread", 1, "issue", "jira.jira_get_issue", None, None, True), ("slack_thread", 2, "code", "code.grep", "(a.x) | unique | list", 4, False), ("slack_thread", 3, "read", "code.read_file", None, None, True), ("slack_thread", 4, "odd", "own.thing", None, None, False), ("bare", 0, "x", "own.thing", None, None, False)]
    df = spark.createDataFrame(steps, "trigger string, place long, id string, tool string, for_each string, max_items long, expected boolean")
    arguments = spark.createDataFrame([("slack_thread", "issue", "q", "ladder", ["a", "b"]), ("slack_thread", "issue", "w", "bound", ["a"])], "trigger string, id string, arg string, kind string, templates array<string>")
    inputs = spark.createDataFrame([("slack_thread", "key", "jira_key", "A-1"), ("slack_thread", "team", "string", None)], "trigger string, name string, type string, example string")
    got = {r["trigger"]: r.asDict(recursive=True) for r in skeleton.skeletons(df, arguments, inputs).collect()}
    one = got["slack_thread"]
    assert [(o["name"], o["steps"], o["required"]) for o in one["outputs"]] == [("repeats", ["repeat_search"], False), ("ticket", ["issue"], True), ("code", ["code", "read"], True), ("own", ["odd"], False)]
    assert one["outputs"][1]["description"] == "the Jira ticket (jira.jira_get_issue, 2-rung ladder on q)"
    assert one["outputs"][2]["description"] == "source lines that raise or log the error (code.grep, per item of `(a.x) | unique | list`, first 4); the source file that handles the request (code.read_file)"
    assert one["use_case"] == "Run it on a slack thread (key, team) to gather: repeats, ticket, code, own." and one["inputs"] == ["key (jira_key), e.g. A-1", "team (string)"]
    assert one["not_covered"] == [f"no {s} lookups" for s in ("slack", "confluence", "chronosphere", "logz", "pagerduty", "git")] + ["code looks at the first 4 items of its fan-out only"]
    assert one["found"] == "Every traced run had hits on: issue, read."
    assert got["bare"]["use_case"] == "Run it on a bare (no inputs) to gather: own." and got["bare"]["inputs"] == [] and len(got["bare"]["not_covered"]) == 8 and got["bare"]["found"] == ""


@pytest.mark.parametrize("small", [ordering.SMALL_EDGES, 1, 0])
def test_cycles_cut_fallbacks_first(spark, small):
    """Sessions in opposite orders: a ladder falls back on a later step and that one's list on the first; rungs give way, scalars stay."""
    nodes = spark.createDataFrame([("g", x, i) for i, x in enumerate("abcd")] + [("h", "a", 0), ("h", "b", 1), ("lone", "z", 3)], "graph string, node string, rank long")
    edges = spark.createDataFrame([("g", "a", "b", True), ("g", "b", "a", False), ("g", "c", "c", False), ("g", "d", "a", False), ("g", "c", "d", False), ("g", "a", "gone", False), ("h", "a", "b", False), ("h", "b", "a", False)], "graph string, node string, dep string, soft boolean")
    placed, cuts = ordering.stable_order(nodes, edges, ["graph"], small)
    got = {(r["graph"], r["node"]): r["place"] for r in placed.collect()}
    assert [n for _, n in sorted((p, n) for (g, n), p in got.items() if g == "g")] == ["a", "b", "d", "c"]
    assert sorted(map(tuple, cuts.collect())) == [("g", "a", "b", True), ("h", "a", "b", False)]
    assert ordering.stable_order(nodes.where("false"), edges, ["graph"], small)[0].collect() == []


def test_rounds_give_the_same_order(spark):
    nodes, edges = (x.where("graph % 10 = 0") for x in induction._order_graphs(spark, SF))
    slow, fast = (ordering.stable_order(nodes, edges, ["graph"], small) for small in (0, ordering.SMALL_EDGES))
    for a, b in zip(slow, fast, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("acyclic", [True, False])
def test_orders_of_the_whole_table(spark, acyclic):
    nodes, edges = induction._order_graphs(spark, SF)
    edges = edges.where("dep > node") if acyclic else edges
    ranks, links = defaultdict(dict), defaultdict(dict)
    for r in nodes.collect():
        ranks[r["graph"]][r["node"]] = r["rank"]
    for r in edges.collect():
        e = links[r["graph"]]
        e[r["node"], r["dep"]] = e.get((r["node"], r["dep"]), True) and r["soft"]
    got = (induction.dependency_order if acyclic else induction.cyclic_order)(spark, SF).collect()
    assert len(got) == sum(map(len, ranks.values()))
    for g, rank in ranks.items():
        places, cuts = order(rank, links[g])
        assert {r["node"]: r["place"] for r in got if r["graph"] == g} == places
        assert acyclic or {r["node"]: r["lost"] for r in got if r["graph"] == g} == {n: sum(c[0] == n for c in cuts) for n in rank}


def test_fill_and_rename(spark):
    texts = spark.createDataFrame([("s", "{{ a.b }}-{{a.b | short | quote}}{{ none }}!"), ("s", "plain"), ("s", None), ("t", "{{ a.b }}"), ("t", "{{ x }}{{ x }}"), ("s", "{{ a.b }}"), ("s", "{{ a.b }}"), ("s", "{ {{ x | unknown }} }}")], "key string, text string")
    context = spark.createDataFrame([("s", "a.b", "0123456789abc"), ("s", "x", None), ("t", "x", "é{{ a.b }}")], "key string, ref string, value string")
    got = sorted([(r["key"], r["text"], r["value"]) for r in templates.fill(texts, context, ["key"]).collect()], key=repr)
    want = {"{{ a.b }}-{{a.b | short | quote}}{{ none }}!": '0123456789abc-"0123456789"!', "plain": "plain", None: None, "{ {{ x | unknown }} }}": "{  }}"}
    assert got == sorted([("s", t, want[t]) for t in want] + [("s", "{{ a.b }}", "0123456789abc")] * 2 + [("t", "{{ a.b }}", ""), ("t", "{{ x }}{{ x }}", "é{{ a.b }}" * 2)], key=repr)
    names = spark.createDataFrame([("s", "a", "new_a")], "key string, head string, name string")
    out = {r["text"]: r["text_"] for r in templates.rename(texts.where("key = 's'"), names, ["key"]).collect()}
    assert out["{{ a.b }}-{{a.b | short | quote}}{{ none }}!"] == "{{ new_a.b }}-{{ new_a.b | short | quote }}{{ none }}!"


def test_replay(spark):
    proposals = spark.createDataFrame([("t", "s", "a", "{{ inputs.k }}"), ("t", "s", "a", "{{ inputs.wrong }}"), ("t", "s", "b", "{{ inputs.fixed }}"), ("t", "s", "b", "same"), ("t", "s", "c", "{{ inputs.k }}"), ("t", "s", "d", "x")], "trigger string, step string, arg string, template string")
    recorded = spark.createDataFrame([("t", e, "s", a, v) for e, a, v in (("1", "a", "p"), ("1", "a", "p"), ("2", "a", "q"), ("1", "b", "same"), ("2", "b", "same"), ("1", "c", "p"), ("1", "c", "other"))], "trigger string, session string, step string, arg string, value string")
    context = spark.createDataFrame([("t", e, r, v) for e, r, v in (("1", "inputs.k", "p"), ("2", "inputs.k", "q"), ("1", "inputs.fixed", "same"), ("2", "inputs.fixed", "same"))], "trigger string, session string, ref string, value string")
    got = {(r["arg"], r["template"]): (r["checked"], r["passed"], r["accepted"], r["why"]) for r in templates.replay(proposals, recorded, context, ["trigger"], "session").collect()}
    assert got == {("a", "{{ inputs.k }}"): (2, 2, True, "reproduced"), ("a", "{{ inputs.wrong }}"): (2, 0, False, "differs"), ("b", "{{ inputs.fixed }}"): (2, 2, False, "constant"), ("b", "same"): (2, 2, True, "reproduced"), ("c", "{{ inputs.k }}"): (1, 0, False, "several values"), ("d", "x"): (0, 0, False, "never passed")}
