"""A linter for documents of hook settings: {"hooks": {event: [{"matcher"?, "hooks": [{"type", "command", "shell"?}]}]}}."""

from __future__ import annotations

import json
import os
import shlex

SHELLS = ("bash", "powershell")
#: Endings of scripts that need a shell to run, and of all files that can be run (fixed values).
SCRIPTS = (".ps1", ".sh")
PROGRAMS = (".exe", ".ps1", ".sh", ".bat", ".cmd")
#: How a command begins that is an expression and not a path (fixed values).
INLINE = ("@{", "${", "{")


def lint(text: str, exists=os.path.exists) -> list[tuple[str, str]]:
    """(severity, message) findings: ERROR for what can't run, WARN for what looks wrong. An empty list is a clean document."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        return [("ERROR", f"not JSON: {e}")]
    if not isinstance(doc, dict):
        return [("ERROR", "not an object")]
    hooks = doc.get("hooks")
    if hooks is None:
        return [("WARN", "no hooks")]
    if not isinstance(hooks, dict):
        return [("ERROR", "hooks isn't an object")]
    out = []
    for event, entries in hooks.items():
        if not isinstance(entries, list):
            out.append(("ERROR", f"{event}: not a list"))
            continue
        for k, entry in enumerate(entries):
            at = f"{event}[{k}]"
            inner = entry.get("hooks") if isinstance(entry, dict) else None
            if not isinstance(inner, list):
                flat = isinstance(entry, dict) and "command" in entry
                out.append(("ERROR", f"{at}: {'a command without the list of hooks around it' if flat else 'no list of hooks'}"))
                continue
            for j, hook in enumerate(inner):
                out += [(s, f"{at}.hooks[{j}]: {m}") for s, m in _hook(hook, exists)]
    return out


def _hook(hook, exists):
    if not isinstance(hook, dict):
        return [("ERROR", "not an object")]
    out = []
    if hook.get("type") != "command":
        out.append(("ERROR", "type isn't command"))
    command = hook.get("command")
    if not isinstance(command, str) or not command.strip():
        return [*out, ("ERROR", "no command")]
    if hook.get("shell") not in (None, *SHELLS):
        out.append(("WARN", f"unknown shell {hook['shell']!r}"))
    head = command.split()[0].strip('"')
    if head.lower().endswith(SCRIPTS) and "shell" not in hook:
        out.append(("ERROR", f"a script without a shell: {head}"))
    a_path = not command.startswith(INLINE) and not head.startswith("$") and ("/" in head or "\\" in head or head.lower().endswith(PROGRAMS))
    if a_path and not exists(head):
        return [*out, ("ERROR", f"no such file: {head}")]
    try:
        words = shlex.split(command)[1:]
    except ValueError:
        return [*out, ("WARN", "quotes don't match")]
    out += [("WARN", f"no such file: {w}") for w in words if w.endswith((".sh", ".ps1", ".py")) and not w.startswith("$") and not exists(w)]
    return out


def exit_code(findings: list[tuple[str, str]]) -> int:
    return max(({"ERROR": 2, "WARN": 1}.get(s, 0) for s, _ in findings), default=0)
