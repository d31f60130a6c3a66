"""Kinds of message content, as one native CASE expression."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

THOUGHT, PROCEDURAL, HARNESS, TOOL_RESULT = "THOUGHT", "PROCEDURAL", "HARNESS", "TOOL_RESULT_EMBEDDED"
KINDS = (THOUGHT, PROCEDURAL, HARNESS, TOOL_RESULT)

# Tags, openers and terms that transcripts of this format contain.
WRAPPER_TAGS = (
    "<ide_opened_file>", "<ide_diagnostic>", "<ide_selection>", "<task-notification>", "<system-reminder>", "<user-summary>",
    "<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "<local-command-stderr>", "<analysis>",
)
SUMMARY_OPENERS = (
    "Your task is to create a detailed summary of the conversation so far",
    "This session is being continued from a previous conversation that ran out of context",
)
NARRATION_OPENERS = (
    "let me ", "let's ", "now let me ", "now i'll ", "now i will ", "now commit", "now push", "now run", "now build", "now check",
    "now test", "now verify", "now deploy", "i'll ", "i will check", "i will verify", "i will run", "i'm going to ", "going to ",
    "first, let me ", "first let me ", "next, let me ", "next let me ", "okay, let me ", "okay let me ", "ok, let me ",
    "ok let me ", "perfect! now ", "perfect! let me ", "perfect, now ", "perfect, let me ", "great! now ", "great! let me ",
    "great, now ", "great, let me ", "got it! ", "got it. ", "now adding ", "now removing ", "now updating ", "now fixing ",
    "now implementing ", "now wiring ", "now writing ", "now creating ", "now i need to ", "now i'm going to ", "i need to add ",
    "i need to remove ", "i need to update ", "i need to fix ", "i need to check ", "i need to verify ", "i need to ",
    "need to add ", "need to remove ", "need to update ", "need to fix ", "need to check ", "need to verify ",
    "need to implement ", "need to write ",
)
STATUS_TERMS = ("check", "verify", "test", "run", "build", "compile", "fix", "update", "rebuild", "rerun", "passed", "failing", "compiles", "passes", "all green")
CODE_WORDS = (
    "public", "private", "protected", "internal", "static", "void", "class", "interface", "struct", "enum", "namespace", "using",
    "import", "from", "return", "const", "let", "var", "func", "function", "def", "lambda", "async", "await", "throw", "throws",
    "try", "catch", "finally", "if", "else", "elif", "for", "while", "switch", "case", "break", "continue", "true", "false", "null",
    "none", "self", "this", "super", "extends", "implements", "new", "delete", "typeof", "instanceof", "yield",
)
SHORT_TITLE = r"(?i)^now\s+\S+:?\s*$"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
CODE_SHAPE = "[a-z][A-Z]|[A-Z][a-z].*[A-Z]|_"
SHORT, CODE_MIN = 200, 80
CODE_SHARE, MARK_SHARE = 0.30, 0.04


def strip_left(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _starts(c: Column, openers) -> Column:
    return c.rlike("^(?:" + "|".join(re.escape(o) for o in openers) + ")")


def is_harness(content: Column, role: Column) -> Column:
    left = strip_left(content)
    return _starts(left, SUMMARY_OPENERS + WRAPPER_TAGS) | ((role == "system") & (F.length(left) <= SHORT))


def is_procedural(content: Column) -> Column:
    text = strip(content)
    low = F.lower(text)
    status = (F.length(text) <= SHORT) & low.rlike("|".join(STATUS_TERMS))
    return (text != "") & (_starts(low, NARRATION_OPENERS) | text.rlike(SHORT_TITLE) | status)


def is_tool_result(content: Column) -> Column:
    tokens = F.regexp_extract_all(content, F.lit(IDENTIFIER), F.lit(0))
    words = F.array(*map(F.lit, CODE_WORDS))
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(words, F.lower(t)))) + F.size(F.filter(tokens, lambda t: t.rlike(CODE_SHAPE)))
    marks = F.length(content) - F.length(F.regexp_replace(content, r"[{};()=<>\[\]]", ""))
    dense = (F.size(tokens) > 0) & (hits >= CODE_SHARE * F.size(tokens))
    return (F.length(content) >= CODE_MIN) & (dense | (marks / F.length(content) >= MARK_SHARE))


def kind_of(content: Column, role: Column) -> Column:
    """The kind; rules apply in this order, and those for narration and tool output to the assistant's messages only. A null content is THOUGHT."""
    role = F.lower(F.coalesce(role, F.lit("")))
    mine = role == "assistant"
    rules = [(is_harness(content, role), HARNESS), (mine & is_tool_result(content), TOOL_RESULT), (mine & is_procedural(content), PROCEDURAL)]
    first = F.when(F.coalesce(content, F.lit("")) == "", THOUGHT)
    return reduce(lambda c, rule: c.when(rule[0], rule[1]), rules, first).otherwise(THOUGHT)
