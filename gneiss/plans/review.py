"""A plan for the review of a code base: which analyses to run, in which order."""

from __future__ import annotations

FOCUS = ("all", "security", "architecture", "correctness", "quick")
#: Phases and their analyses.
PHASES = {
    "overview": ("Overview", [("graph", "summary"), ("map", "overview")]),
    "architecture": ("Architecture", [("graph", "dead-code"), ("graph", "cycles"), ("graph", "layer-violation"), ("graph", "hubs"), ("graph", "bridges"), ("graph", "communities"), ("graph", "surprises")]),
    "security": ("Data flow and taint", [("graph", "facts"), ("verify", "taint-propagation"), ("graph", "reachability")]),
    "resources": ("Paired operations", [("graph", "facts"), ("verify", "association-rule-check")]),
    "authorization": ("Contradicting policies", [("verify", "policy-contradiction"), ("verify", "policy-reachability")]),
    "correctness": ("Invariants, bounds and states", [("verify", "invariant-check"), ("verify", "boundary-condition"), ("verify", "state-machine-deadlock")]),
    "impact": ("Impact of what was found", [("graph", "impact")]),
}
BY_FOCUS = {
    "quick": ("overview", "architecture"),
    "architecture": ("overview", "architecture", "impact"),
    "security": ("overview", "security", "resources", "authorization"),
    "correctness": ("overview", "correctness", "impact"),
    "all": tuple(PHASES),
}


def review_plan(files: list[str], focus: str = "all", entry_points: list[str] | None = None, delta_against: str | None = None) -> dict:
    if not isinstance(files, list) or not files:
        raise ValueError("files must be a list that is not empty")
    if focus not in FOCUS:
        raise ValueError(f"focus must be one of {', '.join(FOCUS)}")
    phases = []
    for key in BY_FOCUS[focus]:
        title, actions = PHASES[key]
        steps = []
        for tool, what in actions:
            args = {"files": files, "analysis": what} if tool == "graph" else {"files": files, "mode": what} if tool == "map" else {"template": what}
            if what == "dead-code" and entry_points:
                args["entry_points"] = entry_points
            steps.append({"tool": tool, "args": args})
        phases.append({"phase": f"{len(phases) + 1}. {title}", "actions": steps})
    if delta_against:
        actions = [{"tool": "graph", "args": {"files": files, "analysis": "diff", "against": delta_against, "cache": True}}, {"tool": "graph", "args": {"files": files, "analysis": "impact"}}]
        phases.insert(0, {"phase": "0. Changes", "actions": actions})
    used = [a["args"]["template"] for p in phases for a in p["actions"] if a["tool"] == "verify"]
    return {"files": files, "focus": focus, "summary": f"{len(phases)} phases, focus {focus}", "phases": phases, "suggested_templates": list(dict.fromkeys(used)), "reporting": "Lead with the changes." * bool(delta_against) + "Report findings by phase, then what was clean."}
