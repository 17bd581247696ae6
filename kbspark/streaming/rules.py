"""Rules over the ordered events of one key, shared by streams and their batch twins.

A rule folds events into a state, a JSON-able dict or None where there is nothing to
remember.  ``apply(state, event)`` gives the next state and what to say; an event is
a dict with ``id``, ``at`` in seconds and ``kind``.  ``due(state)`` is the last moment
at which a state holds; behind it ``lapse(state)`` says what became of it, or None,
and the state is forgotten.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values, in seconds and counts.
THROTTLE_WINDOW, THROTTLE_FAILURES = 900, 5
LEASE = 300
REPEAT_TTL = 60
NEVER_STARTED, LOST = "failed: never started", "failed: lost"


class Rule:
    """The base of all rules: a state that lapses says nothing."""

    def apply(self, state: dict | None, event: dict) -> tuple[dict | None, str]:
        raise NotImplementedError

    def due(self, state: dict) -> float:
        raise NotImplementedError

    def lapse(self, state: dict) -> str | None:
        return None


@dataclass
class Throttle(Rule):
    """A window opens with the first failure and does not move; so many failures lock it; a success clears it."""

    window: float = THROTTLE_WINDOW
    failures: int = THROTTLE_FAILURES

    def apply(self, state, event):
        if state and state["fails"] >= self.failures:
            return state, "locked"
        if event["kind"] == "success":
            return None, "allowed"
        if event["kind"] != "failure":
            return state, "allowed"
        start = state["start"] if state else event["at"]
        return {"start": start, "fails": (state["fails"] if state else 0) + 1}, "allowed"

    def due(self, state):
        return state["start"] + self.window


@dataclass
class Tasks(Rule):
    """A task from queued through running to its end; claims and progress renew a lease, and a task whose lease runs out has failed.

    Only ``enqueue`` makes a task, and while one is live it answers further ones.
    A task that has ended is forgotten: whatever comes late finds nothing to change.
    """

    lease: float = LEASE

    def apply(self, state, event):
        kind = event["kind"]
        if state is None:
            if kind != "enqueue":
                return None, "ignored"
            return {"id": event["id"], "status": "queued", "seen": event["at"]}, "queued"
        if kind == "enqueue":
            return state, f"reuse {state['id']}"
        if (state["status"], kind) in (("queued", "claim"), ("running", "progress")):
            return {"id": state["id"], "status": "running", "seen": event["at"]}, "running"
        if kind == "fail":
            return None, "failed"
        if (state["status"], kind) == ("running", "finish"):
            return None, "done"
        return state, "ignored"

    def due(self, state):
        return state["seen"] + self.lease

    def lapse(self, state):
        return NEVER_STARTED if state["status"] == "queued" else LOST


@dataclass
class Repeats(Rule):
    """A search that repeats one logged less than a minute ago is not logged again."""

    ttl: float = REPEAT_TTL

    def apply(self, state, event):
        if state and event["at"] - state["start"] < self.ttl:
            return state, "repeat"
        return {"start": event["at"]}, "logged"

    def due(self, state):
        return state["start"] + self.ttl


def fold(rule: Rule, state: dict | None, event: dict) -> tuple[dict | None, list[tuple[int | None, float, str]]]:
    """The state behind an event, and what is said, (id, at, output): first of the old state if it has lapsed."""
    said = []
    if state is not None and rule.due(state) < event["at"]:
        said, state = lapsed(rule, state), None
    state, output = rule.apply(state, event)
    return state, [*said, (event["id"], event["at"], output)]


def lapsed(rule: Rule, state: dict) -> list[tuple[int | None, float, str]]:
    """What is said of a state that has lapsed; it has no event."""
    output = rule.lapse(state)
    return [] if output is None else [(None, rule.due(state), output)]
