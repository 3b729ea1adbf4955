"""What a compacted conversation keeps: visible memory, the retention selector, and replay of recorded context changes."""

from __future__ import annotations

from collections.abc import Callable

Message = dict


def visible_memory(messages: list[Message]) -> dict:
    """Goal, observations, receipts, failures and the next path, folded from messages in order.

    The goal is the first user message; observations are tool replies that did not fail, failures those that did; receipts
    are the calls' names with how often each was made, in the order first seen; `next` is what a last unanswered call asks for.
    """
    goal, observations, failures, receipts, pending = None, [], [], {}, {}
    for m in messages:
        if m["role"] == "user" and goal is None:
            goal = m["content"]
        for call in m.get("tool_calls") or []:
            receipts[call["name"]] = receipts.get(call["name"], 0) + 1
            pending[call["id"]] = call
        if m["role"] == "tool":
            pending.pop(m.get("tool_call_id"), None)
            (failures if m.get("failed") else observations).append(m["content"])
    last = list(pending.values())[-1:] or [None]
    return {"goal": goal, "observations": observations, "failures": failures, "receipts": list(receipts.items()), "next": last[0]}


def retained(groups: list[list[Message]], budget: int, cost: Callable[[list[Message]], int]) -> list[int]:
    """Places of the groups to keep: the last one if it fits the budget, else none."""
    return [len(groups) - 1] if groups and cost(groups[-1]) <= budget else []


def linkage(messages: list[Message], allow_pending: bool = False) -> str | None:
    """Why the calls and replies of a conversation do not fit, or None.

    Call ids are unique; a reply answers an open call exactly once; other messages do not come between a call and its reply.
    """
    used, open_calls = set(), set()
    for m in messages:
        if m["role"] == "tool":
            if m.get("tool_call_id") not in open_calls:
                return "reply without an open call"
            open_calls.discard(m["tool_call_id"])
            continue
        if open_calls:
            return "message before a reply"
        for call in m.get("tool_calls") or []:
            if m["role"] != "assistant":
                return "call by another role"
            if call["id"] in used:
                return "repeated call id"
            if not isinstance(call.get("arguments"), dict):
                return "arguments are no object"
            used.add(call["id"])
            open_calls.add(call["id"])
    return "unanswered call" if open_calls and not allow_pending else None


def replay(prompt: list[Message], events: list[dict]) -> list[Message]:
    """The context after the recorded events; ValueError where an event does not follow from the context before it.

    A `model` event has the input it saw and the message it gave; a `tool` event adds a reply; a `compaction` event has the
    context before and after, of which an accepted one takes the place, shorter and with the same system messages in front.
    """
    context = list(prompt)
    for at, e in enumerate(events):
        if e["type"] == "model":
            if e["input"] != context:
                raise ValueError(f"event {at} saw another context")
            context = [*context, e["message"]]
        elif e["type"] == "tool":
            context = [*context, e["message"]]
        elif e["type"] == "compaction":
            pinned = [m for m in context if m["role"] == "system"]
            if e["before"] != context or e["accepted"] and (len(e["after"]) >= len(context) or e["after"][: len(pinned)] != pinned):
                raise ValueError(f"event {at} is no compaction of the context")
            context = list(e["after"]) if e["accepted"] else context
        else:
            raise ValueError(f"event {at} is of no known type")
        why = linkage(context, allow_pending=True)
        if why:
            raise ValueError(f"event {at}: {why}")
    return context
