"""What a user runs: verbs over the tables of a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.operators import cards, dataflow, lifecycle, search, sequences, skeleton
from tracelens.operators import flows as induced
from tracelens.sources import index, traces, workspace


def import_transcripts(spark: SparkSession, source: str, target: str, name: str, force: bool = False) -> DataFrame:
    """Read agent transcripts, write their calls by session and by episode, and report what came in."""
    got = traces.read_transcripts(spark, source)
    workspace.write_sessions(workspace.slices(got["calls"]), target, name, "part", force)
    return traces.import_report(got["prompts"], got["calls"])


def candidates(edges: DataFrame, episode: list[str], min_support: int = 2, most: int | None = None) -> DataFrame:
    """Ranked connected closed graphs of bound edges."""
    found = dataflow.graph_candidates(edges, episode, min_support)
    return found.where(F.col("rank") <= most) if most else found


def sequence_candidates(runs: DataFrame, episode: list[str], most: int | None = None) -> DataFrame:
    """Ranked closed tool sequences of collapsed runs (one row an episode)."""
    found = sequences.ranked(sequences.closed(sequences.support(sequences.ngrams(runs, episode), episode)))
    return found.where(F.col("rank") <= most) if most else found


def induce(calls: DataFrame, inputs: DataFrame) -> induced.Flows:
    """The flows of all triggers from their sessions' bound calls."""
    return induced.induce_flows(calls, inputs)


def card(found: induced.Flows) -> DataFrame:
    """What each induced flow is for, what it should find, and what it does not look at."""
    return skeleton.skeletons(found.steps, found.arguments, found.inputs)


def evidence(results: DataFrame, run: list[str], order: list[str], key: list[str]) -> DataFrame:
    """What the tools' results of a run show, without repeats, by type of information."""
    return cards.evidence(cards.cards(results, key), run, order)


def test(steps: DataFrame, expect: DataFrame, run: list[str]) -> DataFrame:
    """The expectations that runs do not meet."""
    return lifecycle.check_expectations(steps, expect, run)


test.__test__ = False  # no test of pytest


def refresh(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Bring the index of a trace folder up to date, and tell what was new, changed or gone."""
    return index.refresh(spark, folder, path)


def status(events: DataFrame, flow: list[str], order: list[str]) -> DataFrame:
    """The promotion state of each flow after its outcomes."""
    return lifecycle.fold(events, flow, order)


def flows(specs: DataFrame, name: str = "name") -> DataFrame:
    """The newest version of each flow."""
    return search.newest_version(specs, name)


def runs(records: DataFrame, name: str = "run_id", most: int = 50) -> DataFrame:
    return workspace.recent(records, F.col(name), most)


def workspaces(records: DataFrame) -> DataFrame:
    return workspace.listing(records, "workspace", "session", "ts")


def seed(have: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    return workspace.seed(have, given, key)
